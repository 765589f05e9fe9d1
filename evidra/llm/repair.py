"""Re-Pair grammars of many sequences at once, with numpy.

Symbols belong to one sequence, so a batch of sequences is one array and each
round handles all of them: pairs are counted by one sort, repeated pairs that
are the best of both their symbols are replaced, and what can't repeat any more
leaves the arrays. A neighbourhood whose pair stands once can never become part
of a repeated pair, since every later symbol begins and ends with symbols of
now; hence nothing is lost by cutting there.

The hash of a symbol is that of the text it stands for (a polynomial over the
hashes of its terminals), however it was derived: equal texts have equal hashes
in all sequences and batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Base of the polynomial hashes (odd).
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammars:
    """The grammars of a batch: one row per rule, and the final sequences as rows in order."""

    rule_owner: np.ndarray
    rule_hash: np.ndarray
    rule_size: np.ndarray
    final_owner: np.ndarray
    final_hash: np.ndarray
    final_size: np.ndarray
    whole_hash: np.ndarray

    def size(self, n: int) -> np.ndarray:
        """Rules and final symbols of each of ``n`` sequences."""
        return np.bincount(self.rule_owner, minlength=n) + np.bincount(self.final_owner, minlength=n)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def whole_hashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each sequence from the hashes of its terminals."""
    ends = np.cumsum(sizes)
    back = np.repeat(ends, sizes) - 1 - np.arange(len(values))
    parts = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(int(sizes.max(initial=0)))[back], dtype=np.uint64)])
    return parts[ends] - parts[ends - sizes]


def infer(tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> Grammars:
    """Grammars of the sequences that lie one after the other in ``tokens``.

    ``tokens``: numbers of terminals; ``sizes``: length of each sequence; ``hashes``: by
    number of a terminal. Of the repeated pairs of a round those are replaced that come
    first among all with either symbol: the most frequent, then the one that stands first. The
    result for a sequence doesn't depend on the others of the batch.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    # symbols of their own for each sequence
    keys, code = np.unique((owner.astype(np.int64) << 32) | tokens, return_inverse=True)
    symbol_hash = [hashes[keys & 0xFFFFFFFF]]
    symbol_size = [np.ones(len(keys), np.int64)]
    whole = whole_hashes(hashes[tokens], sizes)
    count = len(keys)
    place = np.arange(len(code))
    gap = np.ones(len(code), bool)  # whether the pair that begins here can't be replaced
    gap[:-1] = owner[1:] != owner[:-1]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rule_owner: list[np.ndarray] = []
    while len(code):
        at = np.flatnonzero(~gap)
        a, b = code[at], code[at + 1]
        # in a run of one symbol every second pair counts
        twins = a == b
        if twins.any():
            run = np.flatnonzero(twins)
            fresh = np.ones(len(run), bool)
            fresh[1:] = (at[run[1:]] != at[run[:-1]] + 1) | (a[run[1:]] != a[run[:-1]])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            skip = np.zeros(len(at), bool)
            skip[run] = (np.arange(len(run)) - begin) % 2 == 1
            counted = np.flatnonzero(~skip)
        else:
            counted = np.arange(len(at))
        pair = (a[counted].astype(np.int64) << 32) | b[counted]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(ranked)))
        often = times > 1
        single = np.ones(len(at), bool)
        if twins.any():
            single[skip] = False  # judged with the pair before
        single[counted[order[np.repeat(often, times)]]] = False
        gap[at[single]] = True
        if not often.any():
            done.append((place, code))
            break
        first = counted[order[head[often]]]
        left, right, times_o = a[first], b[first], times[often]
        rank = np.empty(len(first), np.int64)
        best_first = np.lexsort((at[first], -times_o))
        rank[best_first] = np.arange(len(first))
        chosen = np.zeros(len(first), bool)
        best = np.full(count, np.iinfo(np.int64).max)
        rest = best_first
        taken = np.zeros(count, bool)
        for _ in range(4):  # those that only lost to pairs whose symbols are taken get another chance
            down = rest[::-1]
            best[np.stack([left[down], right[down]], 1).ravel()] = np.repeat(rank[down], 2)
            win = rest[(best[left[rest]] == rank[rest]) & (best[right[rest]] == rank[rest])]
            chosen[win] = True
            taken[left[win]] = True
            taken[right[win]] = True
            best[left[rest]] = best[right[rest]] = np.iinfo(np.int64).max
            rest = rest[~(taken[left[rest]] | taken[right[rest]])]
            if not len(rest):
                break
        # replace
        new = np.full(len(head), -1, np.int64)
        new[np.flatnonzero(often)[chosen]] = count + np.arange(chosen.sum())
        per_row = np.repeat(new, times)
        hit = per_row >= 0
        spots = at[counted[order[hit]]]
        hs, ss = np.concatenate(symbol_hash), np.concatenate(symbol_size)
        symbol_hash, symbol_size = [hs], [ss]
        la, rb = left[chosen], right[chosen]
        symbol_size.append(ss[la] + ss[rb])
        power = _power_of(ss[rb])
        symbol_hash.append(hs[la] * power + hs[rb])
        rule_owner.append(owner[place[at[first[chosen]]]])
        count += int(chosen.sum())
        code[spots] = per_row[hit]
        gap[spots] = gap[spots + 1]
        keep = np.ones(len(code), bool)
        keep[spots + 1] = False
        code, place, gap = code[keep], place[keep], gap[keep]
        # what has no open neighbourhood is final
        open_ = ~gap
        live = open_.copy()
        live[1:] |= open_[:-1]
        done.append((place[~live], code[~live]))
        code, place, gap = code[live], place[live], gap[live]
    hs, ss = np.concatenate(symbol_hash), np.concatenate(symbol_size)
    spot = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
    final = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(spot, kind="stable")
    spot, final = spot[order], final[order]
    base = len(keys)
    return Grammars(
        np.concatenate(rule_owner) if rule_owner else np.zeros(0, np.int64), hs[base:], ss[base:], owner[spot], hs[final], ss[final], whole
    )


_POWERS = _powers(1 << 12)


def _power_of(sizes: np.ndarray) -> np.ndarray:
    """``BASE`` to the given powers."""
    out = _POWERS[sizes & 0xFFF]
    high = sizes >> 12
    if high.any():
        big = np.uint64(pow(int(BASE), 1 << 12, 1 << 64))
        out = out * np.array([pow(int(big), int(x), 1 << 64) for x in high], np.uint64)
    return out
