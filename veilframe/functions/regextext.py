"""Texts of a regular expression by counting: its automaton, how many texts it accepts, and the text of a given rank.

The expression is read into nodes: `("chars", text)`, `("cat", nodes)`, `("alt", nodes)` and `("rep", low, high, node)`, where
`high` is None for an open end. Known are literals, classes, groups, alternation and repeats; anchors count as empty.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PRINTED = "".join(map(chr, range(33, 127)))
_SETS = {"d": _DIGITS, "w": _UPPER + _UPPER.lower() + _DIGITS + "_", "s": " "}
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}
ANY = _UPPER + _DIGITS
#: Characters beyond the shortest text that an expression with open repeats may take.
OPEN_ENDED = 12
MOST_STATES = 5_000
_WIDEST = 2**60


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def sees(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def takes(self, token: str) -> bool:
        found = self.sees(token)
        self.at += len(token) if found else 0
        return found

    def matches(self, pattern: str):
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def char(self) -> str:
        if self.at >= len(self.text):
            raise ValueError("unfinished expression")
        self.at += 1
        return self.text[self.at - 1]

    def options(self):
        found = [self.sequence()]
        while self.takes("|"):
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        nodes = []
        while self.at < len(self.text) and not self.sees("|") and not self.sees(")"):
            nodes.append(self.repeats(self.atom()))
        return ("cat", nodes)

    def repeats(self, node):
        if m := self.matches(r"\{(\d*)(,?)(\d*)\}(?<!\{\})(?<!\{,\})"):
            low = int(m[1] or 0)
            high = int(m[3]) if m[3] else (None if m[2] else low)
        elif m := self.matches(r"[?*+]"):
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[m[0]]
        else:
            return node
        if high is not None and high < low:
            raise ValueError("repeats end before they begin")
        self.matches(r"[?+]")  # lazy or possessive: the same texts
        if self.matches(r"[?*+]|\{\d"):
            raise ValueError("repeat of a repeat")
        return ("rep", low, high, node)

    def atom(self):
        if self.matches(r"\((?:\?:|\?P?<\w+>)?(?!\?)"):
            node = self.options()
            if not self.takes(")"):
                raise ValueError("open group")
            return node
        c = self.char()
        if c in "^$":
            return ("cat", [])
        if c in "?*+(":
            raise ValueError(f"cannot read {c!r} here")
        if c == ".":
            return ("chars", ANY)
        if c == "[":
            return ("chars", self.members())
        return ("chars", self.escaped()) if c == "\\" else ("chars", c)

    def escaped(self) -> str:
        c = self.char()
        if c.lower() in _SETS:
            chosen = _SETS[c.lower()]
            return chosen if c.islower() else "".join(x for x in _PRINTED if x not in chosen)
        if c in _CONTROLS:
            return _CONTROLS[c]
        if c.isalnum():
            raise ValueError(f"cannot read \\{c}")
        return c

    def members(self) -> str:
        negated, chars, first = self.takes("^"), [], True
        while first or not self.sees("]"):
            first = False
            c = self.char()
            low = self.escaped() if c == "\\" else c
            if len(low) == 1 and self.matches(r"-(?!\])"):
                c = self.char()
                high = self.escaped() if c == "\\" else c
                if len(high) != 1 or high < low:
                    raise ValueError("bad range of characters")
                low = "".join(map(chr, range(ord(low), ord(high) + 1)))
            chars += low
        self.takes("]")
        chosen = [x for x in _PRINTED if x not in chars] if negated else dict.fromkeys(chars)
        if not chosen:
            raise ValueError("empty class")
        return "".join(chosen)


def read_regex(regex: str):
    """The nodes of an expression; one outside the known forms is a ValueError."""
    reader = _Reader(regex)
    node = reader.options()
    if reader.at < len(regex):
        raise ValueError("unopened group")
    return node


class TextsOf:
    """The texts of an expression in order of length; `size` of them.

    An expression with open repeats has texts of up to `OPEN_ENDED` characters more than its shortest one, or of up to `longest`.
    """

    def __init__(self, regex: str, longest: int | None = None):
        self._free: list[list[int]] = []  # moves without a character
        self._moves: list[list[tuple[str, int]]] = []
        start, end = self._state(), self._state()
        self._build(read_regex(regex), start, end)
        edges, accepts = self._determined(start, end)
        edges, open_ended = self._useful(edges, accepts)
        self.edges = edges
        self.counts = [[int(a) for a in accepts]]  # by length, then state
        stop = len(edges) if not open_ended else longest
        while stop is None or len(self.counts) <= stop:
            if stop is None and self.counts[-1][0]:
                stop = len(self.counts) - 1 + OPEN_ENDED
                continue
            row = self.counts[-1]
            self.counts.append([sum(len(chars) * row[to] for chars, to in e) for e in edges])
            if not any(self.counts[-1]):
                break
        self.size = sum(row[0] for row in self.counts)
        if not self.size:
            raise ValueError("no text is short enough")
        del self._free, self._moves

    def _state(self) -> int:
        if len(self._free) >= 20 * MOST_STATES:
            raise ValueError("expression too large")
        self._free.append([])
        self._moves.append([])
        return len(self._free) - 1

    def _build(self, node, start: int, end: int) -> None:
        if node[0] == "chars":
            self._moves[start].append((node[1], end))
        elif node[0] == "alt":
            for option in node[1]:
                self._build(option, start, end)
        elif node[0] == "cat":
            at = start
            for part in node[1]:
                to = self._state()
                self._build(part, at, to)
                at = to
            self._free[at].append(end)
        else:
            _, low, high, body = node
            at = self._state()
            self._free[start].append(at)
            for i in range(low if high is None else high):
                if i >= low:
                    self._free[at].append(end)
                to = self._state()
                self._build(body, at, to)
                at = to
            self._free[at].append(end)
            if high is None:
                back = self._state()
                self._build(body, at, back)
                self._free[back].append(at)

    def _closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for to in self._free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def _determined(self, start: int, end: int):
        """Edges `(characters, state)` of a deterministic automaton, and which states accept."""
        first = self._closed([start])
        known, todo, edges = {first: 0}, deque([first]), []
        while todo:
            by_char: dict[str, set[int]] = {}
            for state in todo.popleft():
                for chars, to in self._moves[state]:
                    for c in chars:
                        by_char.setdefault(c, set()).add(to)
            closed = {to: self._closed(to) for to in {frozenset(x) for x in by_char.values()}}
            out: dict[int, list[str]] = {}
            for c in sorted(by_char):
                group = closed[frozenset(by_char[c])]
                if group not in known:
                    if len(known) >= MOST_STATES:
                        raise ValueError("expression too large")
                    known[group] = len(known)
                    todo.append(group)
                out.setdefault(known[group], []).append(c)
            edges.append([("".join(chars), to) for to, chars in out.items()])
        return edges, [end in group for group in known]

    @staticmethod
    def _useful(edges, accepts):
        """Edges that lead to a text, and whether they hold a circle."""
        into: list[list[int]] = [[] for _ in edges]
        for state, out in enumerate(edges):
            for _, to in out:
                into[to].append(state)
        useful = {s for s, a in enumerate(accepts) if a}
        todo = list(useful)
        while todo:
            for state in into[todo.pop()]:
                if state not in useful:
                    useful.add(state)
                    todo.append(state)
        edges = [[(c, to) for c, to in out if to in useful] if s in useful else [] for s, out in enumerate(edges)]
        arrivals = [0] * len(edges)
        for out in edges:
            for _, to in out:
                arrivals[to] += 1
        todo, left = [s for s, n in enumerate(arrivals) if not n], len(edges)
        while todo:
            left -= 1
            for _, to in edges[todo.pop()]:
                arrivals[to] -= 1
                if not arrivals[to]:
                    todo.append(to)
        return edges, left > 0

    def texts(self, ranks: np.ndarray) -> list[str]:
        """The text of each rank in [0, size), for all rows a character at a time."""
        kind = np.int64 if self.size <= 2**62 else object
        rank = np.asarray(ranks).astype(kind)
        ends = np.cumsum(np.array([row[0] for row in self.counts], dtype=kind))
        left = np.searchsorted(ends, rank, "right")
        rank = rank - np.where(left > 0, ends[left - 1], 0)
        state, width = np.zeros(len(rank), np.int64), int(left.max(initial=0))
        made = np.zeros((len(rank), max(width, 1)), np.uint32)
        for place in range(width):
            pairs = state * (width + 1) + left
            for pair in np.unique(pairs[left > 0]):
                rows, edges = np.flatnonzero(pairs == pair), self.edges[pair // (width + 1)]
                each = np.array([self.counts[pair % (width + 1) - 1][to] for _, to in edges], dtype=kind)
                sizes = np.array([len(chars) for chars, _ in edges], np.int64)
                ends = np.cumsum(each * sizes)
                edge = np.searchsorted(ends, rank[rows], "right")
                inside = rank[rows] - np.where(edge > 0, ends[edge - 1], 0)
                letters = np.array([ord(c) for chars, _ in edges for c in chars], np.uint32)
                firsts = np.cumsum(sizes) - sizes
                made[rows, place] = letters[firsts[edge] + (inside // each[edge]).astype(np.int64)]
                rank[rows] = inside % each[edge]
                state[rows] = np.array([to for _, to in edges], np.int64)[edge]
            left = np.maximum(left - 1, 0)
        return made.view(f"<U{made.shape[1]}").ravel().tolist()


def unique_text(c: Column, regex: str, key: str, label: str = "text", longest: int | None = None) -> Column:
    """A text of `regex` for each integer from 0 on: different integers get different texts, in a keyed order.

    Null stays null. An integer below 0, or beyond the number of texts (2^60 at most are used, spread over all of them), is an
    error; `TextsOf(regex).size` tells how many there are.
    """
    from veilframe.functions.fpe import permute

    texts = TextsOf(regex, longest)
    room = min(texts.size, _WIDEST)
    value = c.cast("long")
    checked = F.when(value.between(0, room - 1), value).when(
        value.isNotNull(), F.raise_error(F.concat(F.lit(f"the expression has {room} texts, none for number "), value.cast("string"))).cast("long")
    )
    index = F.coalesce(permute(checked, room, key, f"{label}.unique"), F.lit(0).cast("long"))

    @F.pandas_udf("string")
    def text_at(index: pd.Series) -> pd.Series:
        ranks = index.to_numpy()
        if texts.size > room:
            ranks = ranks.astype(object) * texts.size // room
        return pd.Series(texts.texts(ranks), dtype=object)

    return F.when(value.isNotNull(), text_at(index))
