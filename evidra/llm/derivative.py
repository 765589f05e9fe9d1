"""Memoised parsing with derivatives over token classes.

A grammar is a set of named terms. The derivative of a language by a token is
again a language: here a set of stacks of terms, where a stack stands for the
concatenation of its terms. Derivatives of terms, stacks and whole sets are
interned and memoised, so all files of a language share one lazily built
automaton and a token costs one lookup once its context has been seen.

An empty derivative marks the token at which a text stops being a prefix of the
language; a derivative at the end that doesn't hold the empty word means that
the text stops too early.
"""

from __future__ import annotations

import re

_WORD = re.compile(r"""\s*(?:(?P<str>'[^']*')|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>[()|*+?=]))""")

#: The memo of a grammar is started anew beyond this many entries; this bounds a worker's memory and changes no result.
MEMO_LIMIT = 400_000


class Grammar:
    """A context-free grammar without left recursion, given as ``name = body`` lines.

    In a body ``'x'`` is the token class x, a capitalised name without rule is a
    token class too, and ``| * + ? ( )`` have their usual meaning.
    """

    def __init__(self, text: str, start: str) -> None:
        self.rules: dict[str, tuple] = {}
        sources: dict[str, str] = {}
        name = ""
        for line in text.splitlines():
            if m := re.match(r"(\w+) = (.*)", line):
                name = m[1]
                sources[name] = m[2]
            elif line.strip():
                sources[name] += " " + line
        self._names = set(sources)
        for name, body in sources.items():
            self.rules[name] = self._parse(body)
        self._nullable: dict[tuple, bool] = {}
        self._partial: dict[tuple, tuple] = {}
        self._fix_nullable()
        self.start = ("n", start)
        self._reset()

    # -- grammar text -> terms
    def _parse(self, body: str) -> tuple:
        tokens = [(m.lastgroup, m[m.lastgroup]) for m in _WORD.finditer(body)]
        at = 0

        def alternatives() -> tuple:
            nonlocal at
            parts = [sequence()]
            while at < len(tokens) and tokens[at] == ("op", "|"):
                at += 1
                parts.append(sequence())
            return parts[0] if len(parts) == 1 else ("|", tuple(parts))

        def sequence() -> tuple:
            nonlocal at
            items = []
            while at < len(tokens) and tokens[at] not in (("op", "|"), ("op", ")")):
                kind, word = tokens[at]
                at += 1
                if word == "(" and kind == "op":
                    item = alternatives()
                    at += 1
                elif kind == "str":
                    item = ("t", word[1:-1])
                else:
                    item = ("n", word) if word in self._names else ("t", word)
                while at < len(tokens) and tokens[at][0] == "op" and tokens[at][1] in "*+?":
                    mark = tokens[at][1]
                    at += 1
                    star = ("*", item)
                    item = star if mark == "*" else ("s", (item, star)) if mark == "+" else ("|", (item, ("s", ())))
                items.append(item)
            return items[0] if len(items) == 1 else ("s", tuple(items))

        return alternatives()

    # -- terms
    def _fix_nullable(self) -> None:
        known = dict.fromkeys(self.rules, False)

        def of(term: tuple) -> bool:
            kind, arg = term
            if kind == "t":
                return False
            if kind == "*":
                return True
            if kind == "n":
                return known[arg]
            return any(map(of, arg)) if kind == "|" else all(map(of, arg))

        changed = True
        while changed:
            changed = False
            for name, body in self.rules.items():
                if not known[name] and of(body):
                    known[name] = changed = True
        self._can_be_empty = of

    def nullable(self, term: tuple) -> bool:
        """Whether the term's language holds the empty word."""
        found = self._nullable.get(term)
        if found is None:
            found = self._nullable[term] = self._can_be_empty(term)
        return found

    def partial(self, term: tuple, token: str) -> tuple:
        """Partial derivatives of a term: sequences of terms."""
        key = (term, token)
        found = self._partial.get(key)
        if found is not None:
            return found
        kind, arg = term
        out: dict[tuple, None] = {}
        if kind == "t":
            if arg == token:
                out[()] = None
        elif kind == "n":
            out = dict.fromkeys(self.partial(self.rules[arg], token))
        elif kind == "|":
            for x in arg:
                out.update(dict.fromkeys(self.partial(x, token)))
        elif kind == "*":
            out = dict.fromkeys((*rest, term) for rest in self.partial(arg, token))
        else:
            for i, x in enumerate(arg):
                out.update(dict.fromkeys((*rest, *arg[i + 1 :]) for rest in self.partial(x, token)))
                if not self.nullable(x):
                    break
        found = self._partial[key] = tuple(out)
        return found

    # -- stacks and sets of stacks
    def _reset(self) -> None:
        self._cells: dict[tuple, tuple] = {}
        self._steps: dict[tuple, frozenset] = {}
        self._moves: dict[frozenset, dict[str, frozenset]] = {}
        self._count = 0

    def _cell(self, term: tuple, rest: tuple | None) -> tuple:
        key = (term, id(rest))
        cell = self._cells.get(key)
        if cell is None:
            empty = self.nullable(term) and (rest is None or rest[2])
            cell = self._cells[key] = (term, rest, empty, len(self._cells))
        return cell

    def _step(self, cell: tuple | None, token: str) -> frozenset:
        if cell is None:
            return frozenset()
        key = (cell[3], token)
        found = self._steps.get(key)
        if found is None:
            term, rest = cell[0], cell[1]
            out = set()
            for sequence in self.partial(term, token):
                top = rest
                for item in reversed(sequence):
                    # a repetition on top of the same repetition adds nothing
                    if not (item[0] == "*" and top is not None and top[0] == item):
                        top = self._cell(item, top)
                out.add(_Ref(top))
            if rest is not None and self.nullable(term):
                out |= self._step(rest, token)
            found = self._steps[key] = frozenset(out)
            self._count += 1
        return found

    def move(self, state: frozenset, token: str) -> frozenset:
        """The derivative of a set of stacks."""
        out: set = set()
        for ref in state:
            out |= self._step(ref.cell, token)
        self._count += 1
        return frozenset(out)

    def first(self) -> frozenset:
        """The language of the start symbol."""
        if self._count > MEMO_LIMIT:
            self._reset()
        return frozenset([_Ref(self._cell(self.start, None))])

    def parse(self, classes: list[str]) -> tuple[str, int]:
        """``("ok" | "error" | "truncated", index of the failing token)``."""
        state = self.first()
        moves = self._moves
        for i, token in enumerate(classes):
            here = moves.get(state)
            if here is None:
                here = moves[state] = {}
            after = here.get(token)
            if after is None:
                if self._count > 2 * MEMO_LIMIT:  # one file alone may fill the memo
                    moves.clear()
                    self._count = 0
                    here = moves.setdefault(state, {})
                after = here[token] = self.move(state, token)
            if not after:
                return "error", i
            state = after
        if any(ref.cell is None or ref.cell[2] for ref in state):
            return "ok", len(classes)
        return "truncated", len(classes)


class _Ref:
    """A stack by identity: equal stacks are the same interned cell."""

    __slots__ = ("cell", "number")

    def __init__(self, cell: tuple | None) -> None:
        self.cell = cell
        self.number = -1 if cell is None else cell[3]

    def __hash__(self) -> int:
        return self.number

    def __eq__(self, other: object) -> bool:
        return self.number == other.number
