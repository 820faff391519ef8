"""Exact token counts of every prefix of a text, for a word-level BPE with word ends.

The tokenizer cuts a text at white space, normalises and cuts further into pieces, and encodes every piece on its own. So the
count of a prefix is the sum over its whole words and the prefix count of the word it ends in, which comes from one pass
of dynamic programming over that word.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.llm.bpe_prefix import PrefixBPE, byte_text, load_bpe
from veilframe.llm.common import Memory, kept

MEMO_WORDS = 1_000_000
#: Fixed value: how the vocabulary cuts a normalised word into pieces; white space is dropped.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")


class PrefixCounter:
    """Token counts of words and of all their prefixes."""

    def __init__(self, bpe: PrefixBPE, special: dict[str, int]):
        self.bpe = bpe
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words = Memory(lambda word: self.count(word.decode("utf-8", "replace")), MEMO_WORDS, 200)
        self.pieces = Memory(lambda piece: len(bpe.encode(byte_text(piece.encode()))), MEMO_WORDS // 4, 200)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # one by one: no final sigma

    def count(self, text: str) -> int:
        """Tokens of a text: special strings count one each, the rest by pieces."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += self._plain(text[at : found.start()]) + 1
            at = found.end()
        return total + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, _PIECE.findall(self.normal(text))))

    def table(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the words of a text in bytes, and the exact token count of the text up to each."""
        words = text.split()
        counts = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        ends = np.zeros(len(words), np.int64)
        at = 0
        for i, w in enumerate(words):
            at = text.index(w, at) + len(w)
            ends[i] = at
        return ends, np.cumsum(counts)

    def total(self, text: bytes) -> int:
        return sum(map(self.words.__getitem__, text.split()))

    def fitting(self, text: bytes, budget: int) -> int:
        """Bytes of the longest prefix (of whole characters) with at most `budget` tokens."""
        words, used, at = text.split(), 0, 0
        for w in words:
            begin = text.index(w, at)
            n = self.words[w]
            if used + n > budget:
                return begin + self._fitting_word(w.decode("utf-8", "replace"), budget - used)
            used, at = used + n, begin + len(w)
        return len(text)

    def _fitting_word(self, word: str, budget: int) -> int:
        """The same for a word that does not fit as a whole."""
        shown = self.normal(word)
        if len(shown) != len(word) or (self.special is not None and "<" in word):
            # Characters do not correspond one to one: try the prefixes themselves, the longest first.
            return next((len(word[:n].encode()) for n in range(len(word), 0, -1) if self.count(word[:n]) <= budget), 0)
        used, best = 0, 0
        for found in _PIECE.finditer(shown):
            piece = found.group()
            if piece[0] == "'" and len(piece) > 1:
                ahead = [0, *(self._plain(piece[:n]) for n in range(1, len(piece) + 1))]
            else:
                by_byte = self.bpe.prefix_counts(byte_text(piece.encode()))
                ahead = [by_byte[len(piece[:n].encode())] for n in range(len(piece) + 1)] if not piece.isascii() else by_byte
            fits = [n for n in range(1, len(piece) + 1) if used + ahead[n] <= budget]
            if fits:
                best = found.start() + fits[-1]
            used += ahead[-1]
            if used > budget:
                break
        return len(word[:best].encode())


def _counter(path: str) -> PrefixCounter:
    return kept(("prefix counter", path), lambda: PrefixCounter(*load_bpe(path)), "tokens")


def token_count(text: Column, path: str) -> Column:
    """Tokens of a whole text (null: 0) by the vocabulary file `path`, without begin, end or added tokens."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        total = _counter(path).total
        return pa.array([total(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text.cast("binary"))


def prefix_table(text: Column, path: str) -> Column:
    """struct<ends: array<long>, counts: array<long>>: the exact token count of the text up to the end of each of its words.

    Ends are in bytes. Null and empty texts have empty arrays. A budget question is a search in `counts`.
    """

    @F.arrow_udf("struct<ends: array<long>, counts: array<long>>")
    def tables(texts: pa.Array) -> pa.Array:
        made = [_counter(path).table(t or b"") for t in texts.to_pylist()]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], kind)], ["ends", "counts"],
        )

    return tables(text.cast("binary"))


def fitting_bytes(text: Column, path: str, budget: int) -> Column:
    """Bytes of the longest prefix of whole characters with at most `budget` tokens; null: 0."""

    @F.arrow_udf("long")
    def fit(texts: pa.Array) -> pa.Array:
        counter = _counter(path)
        return pa.array([counter.fitting(t, budget) if t else 0 for t in texts.to_pylist()], pa.int64())

    return fit(text.cast("binary"))


def counts_and_fit(text: Column, path: str, budget: int) -> Column:
    """struct<n_tokens: long, fitting_bytes: long>: both answers from one table of prefix counts."""

    @F.arrow_udf("struct<n_tokens: long, fitting_bytes: long>")
    def answer(texts: pa.Array) -> pa.Array:
        counter, n, fit = _counter(path), [], []
        for t in texts.to_pylist():
            t = t or b""
            words = t.split()
            counts = np.fromiter(map(counter.words.__getitem__, words), np.int64, len(words)).cumsum()
            n.append(int(counts[-1]) if len(words) else 0)
            fit.append(len(t) if n[-1] <= budget else counter.fitting(t, budget))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fit, pa.int64())], ["n_tokens", "fitting_bytes"])

    return answer(text.cast("binary"))
