"""Byte-pair encoding by prefix dynamic programming.

Of all ways to cut a string into tokens, the encoding is the only one in which every token encodes to itself and every two
neighbours, encoded together, stay as they are. So the encoding of a prefix is the encoding of a shorter prefix and one
last token that suits the token before it. One pass over a string gives last token and count for every prefix.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

from veilframe.llm.common import kept

#: The printable stand-ins of the 256 bytes in byte-level vocabularies. Printable bytes stand for themselves.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_TO_CHARS = str.maketrans({chr(b): c for b, c in BYTE_CHARS.items()})
_TO_BYTES = str.maketrans({c: chr(b) for b, c in BYTE_CHARS.items()})


def byte_text(data: bytes) -> str:
    """Bytes as text of one stand-in character per byte."""
    return data.decode("latin-1").translate(_TO_CHARS)


def text_byte(shown: str) -> bytes:
    return shown.translate(_TO_BYTES).encode("latin-1")


class PrefixBPE:
    """A merge list and vocabulary, and what has been learned of which neighbours suit each other.

    `suffix` is what the last symbol of a word carries, such as `</w>`.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(pair): i for i, pair in enumerate(merges)}
        self.text = {i: t for t, i in vocab.items()}
        self.inner: dict[str, int] = {}  # tokens inside a word, by their text
        self.final: dict[str, int] = {}  # tokens at its end, by their text without the suffix
        for token, i in vocab.items():
            at_end = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
            if self.merge(self.symbols(token)) == [token]:
                (self.final if at_end else self.inner)[token[: -len(suffix)] if at_end else token] = i
        if not suffix:
            self.final = self.inner
        #: A token is at most this many symbols long, so whatever comes later starts less than this before the frontier.
        self.longest = max(map(len, self.inner), default=1)
        self.suits: dict[int, bool] = {}
        self.most_suits = 1_000_000

    @cached_property
    def inner_ends(self) -> dict:
        return self._ends(self.inner)

    @cached_property
    def final_ends(self) -> dict:
        return self._ends(self.final) if self.suffix else self.inner_ends

    @staticmethod
    def _ends(tokens: dict[str, int]) -> dict:
        """The tokens by their last character, the one before it and so on; at "" the token that is complete there."""
        root: dict = {}
        for text, token in tokens.items():
            node = root
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[""] = token
        return root

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """The merge list applied as it stands: the lowest rank first, the leftmost of equal ranks."""
        parts, rank = list(parts), self.rank
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def suit(self, left: int, right: int) -> bool:
        """Whether two tokens, encoded together, stay these two."""
        key = (left << 32) | right
        known = self.suits.get(key)
        if known is None:
            if len(self.suits) > self.most_suits:  # only a memory of answers
                self.suits.clear()
            a, b = self.text[left], self.text[right]
            known = self.suits[key] = self.merge([*self.symbols(a), *self.symbols(b)]) == [a, b]
        return known

    def _last(self, s: str, j: int, last: list[int], ends: dict) -> tuple[int, int]:
        """Start and token of the last token of the encoding of s[:j]."""
        suits, node, i = self.suits, ends, j
        while i:
            i -= 1
            node = node.get(s[i])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                if not i:
                    return 0, token
                good = suits.get((last[i] << 32) | token)
                if good or (good is None and self.suit(last[i], token)):
                    return i, token
        raise ValueError(f"no token of the vocabulary ends {s[max(0, j - 20):j]!r}")

    def encode(self, s: str) -> list[int]:
        """Tokens of one piece."""
        n = len(s)
        if not n:
            return []
        whole = self.final.get(s)
        if whole is not None:
            return [whole]
        last, start, find, inner = [0] * (n + 1), [0] * (n + 1), self._last, self.inner_ends
        for j in range(1, n if self.suffix else n + 1):
            start[j], last[j] = find(s, j, last, inner)
        if self.suffix:
            start[n], last[n] = find(s, n, last, self.final_ends)
        out, j = [], n
        while j:
            out.append(last[j])
            j = start[j]
        return out[::-1]

    def prefix_counts(self, s: str) -> list[int]:
        """Token counts of s[:0], s[:1], ..., s, each as a piece of its own."""
        n = len(s)
        last, count, closed = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            closed[j] = count[self._last(s, j, last, self.final_ends)[0]] + 1
            i, last[j] = self._last(s, j, last, self.inner_ends)
            count[j] = count[i] + 1
        return closed

    def stream(self, symbols: Iterator[str]) -> Iterator[int]:
        """Tokens of a piece of any length, each as soon as no later symbol can change it. Without suffix only.

        A later token begins less than `longest` symbols before the frontier, so every continuation keeps the encoding
        of one of the last `longest` prefixes. What those encodings have in common is stable. Memory holds the window
        of `longest` symbols and the tokens since the point where the encodings of its prefixes part.
        """
        window, base = "", 0  # the symbols from position `base` on
        last, start, frontier, done = {0: 0}, {0: 0}, 0, 0
        for c in symbols:
            window += c
            frontier += 1
            node, i = self.inner_ends, frontier
            while i > done:
                i -= 1
                node = node.get(window[i - base])
                if node is None:
                    raise ValueError(f"no token of the vocabulary ends {window[-20:]!r}")
                token = node.get("")
                if token is not None and i in last and (not i or self.suit(last[i], token)):
                    start[frontier], last[frontier] = i, token
                    break
            if frontier - base >= 4 * self.longest:
                live = range(frontier - self.longest + 1, frontier + 1)
                marks = set(live)
                # Walk the youngest mark back until one is left: the last prefix that all live encodings share.
                while len(marks) > 1:
                    j = max(marks)
                    marks.discard(j)
                    marks.add(start[j])
                common = marks.pop()
                yield from self._path(last, start, done, common)
                done = common
                keep = {p for p in live if p > common} | {common}
                for p in list(keep):
                    while p > common:
                        p = start[p]
                        keep.add(p)
                last, start = {p: last[p] for p in keep}, {p: start[p] for p in keep}
                cut = frontier - self.longest
                window, base = window[cut - base :], cut
        yield from self._path(last, start, done, frontier)

    @staticmethod
    def _path(last: dict[int, int], start: dict[int, int], done: int, j: int) -> list[int]:
        out = []
        while j > done:
            out.append(last[j])
            j = start[j]
        return out[::-1]


def load_bpe(path: str) -> tuple[PrefixBPE, dict[str, int]]:
    """The merge list of a tokenizers file and its special tokens, loaded once per process."""

    def load():
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        bpe = PrefixBPE(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        return bpe, {t["content"]: t["id"] for t in content["added_tokens"]}

    return kept(("bpe", path), load, "tokens")
