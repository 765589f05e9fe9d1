"""The structure of many JSON texts at once, from their shared buffer.

Quotes, brackets, commas and colons are found with numpy over all texts; nesting
becomes a parent index, array places come from offsets of the commas. Whether a
text is JSON at all is decided from the same arrays: each token against the one
before it and the container it stands in, scalars and escapes by pattern. No text
is parsed by itself, and depth has no limit.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COMMA, _COLON = (ord(c) for c in "{}[],:")
_BLANKS = np.frombuffer(b" \t\r\n", np.uint8)
_SIGNS = np.frombuffer(b"{}[],:", np.uint8)
_ESCAPES = np.frombuffer(b'"\\/bfnrtu', np.uint8)
_HEX = np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)
_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"

_BLANK_SET, _SIGN_SET = np.zeros(256, bool), np.zeros(256, bool)
_BLANK_SET[_BLANKS] = True
_SIGN_SET[_SIGNS] = True


class Structure:
    """Containers, members and items of JSON objects and arrays that lie one after the other in a buffer.

    ``valid`` says which texts are a JSON object or array; the other arrays hold those alone.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data = data = whole[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        n = len(starts)
        row_of = lambda at: np.searchsorted(starts, at, side="right") - 1  # noqa: E731 (empty texts hold nothing)

        # quotes that aren't escaped; inside or outside is counted anew in each text
        slash = data == 0x5C
        quotes = np.flatnonzero(data == 0x22)
        run = np.zeros(len(quotes), np.int64)
        slashes = np.flatnonzero(slash)
        if len(slashes):
            fresh = np.ones(len(slashes), bool)
            fresh[1:] = slashes[1:] != slashes[:-1] + 1
            begin = slashes[np.maximum.accumulate(np.where(fresh, np.arange(len(slashes)), 0))]
            before = np.searchsorted(slashes, quotes) - 1
            near = (before >= 0) & (slashes[np.maximum(before, 0)] == quotes - 1)
            run[near] = quotes[near] - begin[before[near]]
        quotes = quotes[run % 2 == 0]
        quote_row = row_of(quotes)
        per_row = np.bincount(quote_row, minlength=n)
        before_row = np.cumsum(per_row) - per_row
        nth = np.arange(len(quotes)) - before_row[quote_row]
        bad = per_row % 2 == 1
        opening = nth % 2 == 0
        paired = opening & ~bad[quote_row]
        opens_q = quotes[paired]
        closes_q = quotes[~opening & ~bad[quote_row]]
        step = np.zeros(len(data) + 1, np.int8)
        step[opens_q] = 1
        step[closes_q + 1] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0

        # escapes and control characters
        if len(slashes):
            start = slashes[(slashes - begin) % 2 == 0]
            follow = data[np.minimum(start + 1, len(data) - 1)]
            wrong = ~np.isin(follow, _ESCAPES) | ~inside[start]
            uni = start[follow == 0x75]
            for k in range(2, 6):
                bad[row_of(uni[~np.isin(data[np.minimum(uni + k, len(data) - 1)], _HEX)])] = True
            bad[row_of(start[wrong])] = True
        bad[row_of(np.flatnonzero(inside & (data < 0x20)))] = True

        # scalars outside strings
        other = ~inside & ~_BLANK_SET[data] & ~_SIGN_SET[data]
        edge = np.diff(np.concatenate([[False], other, [False]]).astype(np.int8))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # (a run may not cross the border of two texts)
        crossing = row_of(low) != row_of(high - 1)
        bad[row_of(low[crossing])] = bad[row_of(high[crossing] - 1)] = True
        if len(low):
            fine = pc.match_substring_regex(self.slices(low, high), _SCALAR).to_numpy(zero_copy_only=False)
            bad[row_of(low[~fine])] = True

        # all tokens in order
        sign_at = np.flatnonzero(~inside & _SIGN_SET[data])
        at = np.concatenate([sign_at, opens_q, low])
        kind = np.concatenate([data[sign_at], np.full(len(opens_q), 0x22, np.uint8), np.full(len(low), 0x30, np.uint8)])
        order = np.argsort(at, kind="stable")
        at, kind = at[order], kind[order]
        row = row_of(at)
        opens = (kind == _OPEN_OBJ) | (kind == _OPEN_ARR)
        closes = (kind == _CLOSE_OBJ) | (kind == _CLOSE_ARR)
        move = np.cumsum(opens.astype(np.int64) - closes)
        first = np.ones(len(at), bool)
        first[1:] = row[1:] != row[:-1]
        last = np.ones(len(at), bool)
        last[:-1] = first[1:]
        base = (move - (opens.astype(np.int64) - closes))[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))] if len(at) else move
        depth = move - base  # after the token
        bad[row[(depth <= 0) & ~last]] = True
        bad[row[last & (depth != 0)]] = True
        bad[row[first & ~opens]] = True
        seen = np.zeros(n, bool)
        seen[row] = True
        bad |= ~seen
        level = depth + closes
        holder = self._holders(opens, level)
        # the container in which a token stands: for brackets at the begin, the one around
        is_obj = kind[opens] == _OPEN_OBJ
        around = np.full(len(at), -1, np.int64)
        inner = ~opens
        around[inner] = holder[inner]
        number = np.flatnonzero(opens)
        up = self._parents(depth[opens], row[opens])
        around[number] = up
        in_obj = np.zeros(len(at), bool)
        known = around >= 0
        in_obj[known] = is_obj[around[known]]
        prev = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        prev_in_obj = np.concatenate([[False], in_obj[:-1]])
        text, value = kind == 0x22, opens | (kind == 0x22) | (kind == 0x30)
        fresh_obj = (prev == _OPEN_OBJ) | ((prev == _COMMA) & prev_in_obj)
        key = text & fresh_obj & ~first
        prev_key = np.concatenate([[False], key[:-1]])
        ended = ((prev == _CLOSE_OBJ) | (prev == _CLOSE_ARR) | (prev == 0x22) | (prev == 0x30)) & ~prev_key
        ok = first.copy()
        ok |= (prev == _OPEN_OBJ) & (key | (kind == _CLOSE_OBJ))
        ok |= (prev == _OPEN_ARR) & (value | (kind == _CLOSE_ARR))
        ok |= (prev == _COMMA) & prev_in_obj & key
        ok |= (prev == _COMMA) & ~prev_in_obj & value
        ok |= prev_key & (kind == _COLON)
        ok |= (prev == _COLON) & value
        ok |= ended & ((kind == _COMMA) | closes)
        ok &= ~closes | ((kind == _CLOSE_OBJ) == in_obj)
        bad[row[~ok]] = True
        self.valid = ~bad

        # what belongs to valid texts stays
        keep = self.valid[row]
        at, kind, row, opens, closes, level, depth = at[keep], kind[keep], row[keep], opens[keep], closes[keep], level[keep], depth[keep]
        good_q = self.valid[row_of(opens_q)]
        self.open_quotes, self.close_quotes = opens_q[good_q], closes_q[good_q]
        signs = (kind != 0x22) & (kind != 0x30)
        holder = self._holders(opens, level)
        self.start, self.is_obj, self.level, self.row = at[opens], kind[opens] == _OPEN_OBJ, depth[opens], row[opens]
        self.end = np.empty(len(self.start), np.int64)
        self.end[holder[closes]] = at[closes]
        self.parent = self._parents(self.level, self.row)
        self.by_level = np.split(np.argsort(self.level, kind="stable"), np.cumsum(np.bincount(self.level)[1:])[:-1]) if len(self.level) else []
        self.colons, self.colon_holder = at[signs & (kind == _COLON)], holder[signs & (kind == _COLON)]
        commas, comma_holder = at[signs & (kind == _COMMA)], holder[signs & (kind == _COMMA)]
        order = np.lexsort((commas, comma_holder))
        self.commas, self.comma_holder = commas[order], comma_holder[order]
        self.comma_first = np.searchsorted(self.comma_holder, np.arange(len(self.start) + 1))
        self.scalar_at, self.scalar_end = low[self.valid[row_of(low)]], high[self.valid[row_of(low)]]

    @staticmethod
    def _holders(opens: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Number of the container that each token but an opening one stands in: the last one opened at its level."""
        number = np.cumsum(opens) - 1
        by_level = np.argsort(level, kind="stable")
        holder = np.zeros(len(opens), np.int64)
        if len(by_level):
            last_open = np.maximum.accumulate(np.where(opens[by_level], np.arange(len(by_level)), 0))
            holder[by_level] = np.maximum(number[by_level[last_open]], 0)
        return holder

    @staticmethod
    def _parents(level: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The container around each container, or -1: the last one before it that is opened one level up."""
        parent = np.full(len(level), -1, np.int64)
        if not len(level):
            return parent
        # sorted by (level, place): the one before in the level above is found by searching its place
        order = np.argsort(level, kind="stable")
        sorted_level = level[order]
        span = np.int64(len(level) + 1)
        shift = int(min(level.min(), 0)) - 1
        keys = (sorted_level - shift) * span + order
        found = np.searchsorted(keys, (level - 1 - shift) * span + np.arange(len(level))) - 1
        ok = found >= 0
        up = order[np.maximum(found, 0)]
        ok &= (level[up] == level - 1) & (level > 1) & (row[up] == row)
        parent[ok] = up[ok]
        return parent

    def place(self, holder: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index of the item at byte ``at`` of each array: the commas of the array before it."""
        span = np.int64(len(self.data) + 1)
        key = self.comma_holder * span + self.commas
        return np.searchsorted(key, holder * span + at) - self.comma_first[holder]

    def name_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the name of the member whose value starts at ``at``."""
        colon = self.colons[np.searchsorted(self.colons, at) - 1]
        return self.name_before(colon)

    def name_before(self, colon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the name before each colon."""
        q = np.searchsorted(self.close_quotes, colon) - 1
        return self.open_quotes[q] + 1, self.close_quotes[q]

    def value_ends(self, at: np.ndarray) -> np.ndarray:
        """Where the scalars that begin at ``at`` end."""
        ends = np.empty(len(at), np.int64)
        text = self.data[at] == 0x22 if len(at) else np.zeros(0, bool)
        ends[text] = self.close_quotes[np.searchsorted(self.open_quotes, at[text])] + 1
        ends[~text] = self.scalar_end[np.searchsorted(self.scalar_at, at[~text])]
        return ends

    def solid(self, at: np.ndarray) -> np.ndarray:
        """The first byte from each place on that is no blank."""
        if not len(at):
            return at
        places = np.flatnonzero(~_BLANK_SET[self.data])
        return places[np.searchsorted(places, at)]

    def slices(self, low: np.ndarray, high: np.ndarray) -> pa.Array:
        """The texts of the spans, gathered in one buffer."""
        size = np.maximum(high - low, 0)
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        take = np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[take].tobytes()))


def valid_json(texts: list[str]) -> np.ndarray:
    """Which texts are a JSON object or array."""
    return Structure(pa.array(texts, pa.large_string())).valid


def unescape(names: pa.Array) -> pa.Array:
    """Raw JSON strings without their escapes; only those with a backslash are decoded."""
    escaped = pc.match_substring(names, "\\")
    if not pc.any(escaped).as_py():
        return names
    fixed = [json.loads(f'"{x}"') if "\\" in x else x for x in names.to_pylist()]
    return pa.array([x.encode("utf-8", "replace").decode() for x in fixed], pa.large_string())
