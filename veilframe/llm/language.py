"""Language identification: script ranges narrow the candidates of a word, letter trigrams score it, Viterbi labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import column, kept, sampled_text

TRIGRAMS = 1 << 16
SAMPLE_PER_LANGUAGE = 1000
SAMPLE_CHARS = 1 << 13
SAMPLE_BLOCK = 1 << 9
SWITCH = 20.0
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
SLICE_CHARS = 1 << 20
#: First and last code point of the letters of each script (Unicode blocks, roughly).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, is a letter; its lower case; its script (0: none of the list)."""

    def make():
        kind, lower, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
        for i, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = i
        for c in [*range(0x323B0), *range(0xE0100, 0xE01F0)]:
            shown = chr(c)
            category = unicodedata.category(shown)[0]
            kind[c] = 2 if category == "L" else 1 if category == "M" else 0
            small = shown.lower()
            if small != shown and len(small) == 1:
                lower[c] = ord(small)
        return kind, lower, script

    return kept("letters", make)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, log probabilities of letter trigrams (by hash) in each, and the scripts each is written in."""

    languages: tuple[str, ...]
    trigrams: np.ndarray
    scripts: np.ndarray
    switch: float


@dataclass
class Words:
    """The words of some texts: bounds in characters, offsets of the texts in them, trigram hashes of their letters."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # where each word's trigrams begin
    hashes: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Runs of letters and marks with at least one letter."""
    kind, lower, script = _tables()
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), "<u4")
    rows = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = kind[code] > 0
    flips = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = flips[::2], flips[1::2]
    many = np.concatenate([[0], np.cumsum(kind[code] == 2)])
    letters = many[ends] - many[starts]
    starts, ends, letters = starts[letters > 0], ends[letters > 0], letters[letters > 0]
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(starts) else np.zeros(0, np.int64)
    at = np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))
    small = lower[code].astype(np.uint64)
    small[~inside] = 0
    before, after = np.concatenate([[np.uint64(0)], small[:-1]]), np.concatenate([small[1:], [np.uint64(0)]])
    mixed = before[at] * np.uint64(0x9E3779B97F4A7C15) + small[at] * np.uint64(0xBF58476D1CE4E5B9) + after[at] * np.uint64(0x94D049BB133111EB)
    offsets = np.searchsorted(starts, rows)
    return Words(starts, ends, offsets, first, ((mixed >> np.uint64(40)) & np.uint64(TRIGRAMS - 1)).astype(np.int64), letters, script[code[starts]])


def fit_languages(
    docs: DataFrame, usable: Column | None = None, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id",
    sample_per_language: int = SAMPLE_PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, switch: float = SWITCH,
) -> LanguageModel:
    """Trigram statistics of a bounded sample: of each language `sample_per_language` rows that hold `usable`, drawn by a
    hash of id and text, equal rows once. Of a text longer than `sample_chars` characters that many take part, in blocks drawn
    by hash from all of it. Rows without language or text are left out. One pass finds the draws, one the texts.
    """
    rows = docs.where(column(lang_column).isNotNull() & column(text_column).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    text = column(text_column)
    rows = rows.select(column(lang_column).alias("lang"), F.xxhash64(column(id_column).cast("string"), text).alias("draw"), text.alias("text"))
    first = Window.partitionBy("lang").orderBy("draw")
    draws = rows.select("lang", "draw").groupBy("lang", "draw").agg(F.lit(1)).withColumn("n", F.row_number().over(first))
    last = F.broadcast(draws.where(F.col("n") <= sample_per_language).groupBy("lang").agg(F.max("draw").alias("last")))  # a row a language
    sample = rows.join(last, "lang").where("draw <= last").groupBy("lang", "draw").agg(F.first(sampled_text(F.col("text"), sample_chars, SAMPLE_BLOCK)).alias("text"))
    texts: dict[str, set[str]] = {}
    for r in sample.select("lang", "text").collect():
        texts.setdefault(r.lang, set()).add(r.text)
    languages = sorted(texts)
    counts, scripts = np.zeros((TRIGRAMS, len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    for i, language in enumerate(languages):
        found = words_of(sorted(texts[language]))
        counts[:, i] = np.bincount(found.hashes, minlength=TRIGRAMS)
        scripts[:, i] = np.bincount(found.script, weights=found.letters, minlength=len(SCRIPTS) + 1)
    chance = (counts + 0.02) / (counts.sum(axis=0) + 0.02 * TRIGRAMS)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(tuple(languages), np.log(chance).astype(np.float32), allowed & (scripts > 0), switch)


def word_scores(words: Words, model: LanguageModel) -> np.ndarray:
    """log P(word | language) for every word and candidate language; the words of scripts that no language uses score 0.

    Languages not written in a word's script lose as much as a change of language there and back costs.
    """
    if not len(words.starts):
        return np.zeros((0, len(model.languages)))
    scores = np.add.reduceat(model.trigrams[words.hashes], words.first, axis=0).astype(np.float64)
    allowed = model.scripts[words.script]
    some = allowed.any(axis=1)
    least = np.where(allowed, scores, np.inf).min(axis=1)
    scores = np.where(allowed, scores, (least - 2 * model.switch)[:, None])
    scores[~some] = 0
    return scores - scores.max(axis=1, keepdims=True)


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best language of every word of every text, where each change of language costs `switch`. Texts side by side."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(len(s), np.int64) for s in scores]
    if not len(order) or not lengths[0]:
        return out
    n = scores[0].shape[1]
    best, came = np.zeros((len(order), n)), []
    for t in range(lengths[0]):
        live = int(np.searchsorted(-lengths, -t, "left"))  # texts with more than t words
        now = best[:live]
        top = now.argmax(axis=1)
        jump = now[np.arange(live), top] - switch
        stay = now >= jump[:, None]
        came.append(np.where(stay, np.arange(n), top[:, None]).astype(np.int16))
        best[:live] = np.where(stay, now, jump[:, None]) + np.stack([scores[i][t] for i in order[:live]])
    for place, i in enumerate(order):
        state = int(best[place].argmax())
        for t in range(len(scores[i]) - 1, -1, -1):
            out[i][t] = state
            state = int(came[t][place, state])
    return out


def labelled(words: Words, scores: np.ndarray, switch: float) -> np.ndarray:
    """The Viterbi labels of the words of all texts.

    Where no stretch of a text favours any other language over the text's best one by more than half a switch, no switch
    can pay (m spans in other languages gain at most m/2 switches and cost at least m - 1, or m beside the best one), so
    the text has one label; only the rest is walked through.
    """
    rows, out = words.rows, np.zeros(len(scores), np.int64)
    texts = np.flatnonzero(np.diff(rows) > 0)
    if not len(texts):
        return out
    best = np.add.reduceat(scores, rows[texts], axis=0).argmax(axis=1)
    sizes = np.diff(rows)[texts]
    out[:] = np.repeat(best, sizes)
    gain = scores - scores[np.arange(len(scores)), out][:, None]
    total = np.concatenate([np.zeros((1, gain.shape[1])), np.cumsum(gain, axis=0)])
    low = -np.abs(gain).sum() - 1.0
    # Each text's running minimum starts anew, as every text lies lower than all before it.
    step = np.repeat(np.arange(len(texts)) * low, sizes)[:, None]
    before, after = total[:-1] + step, total[1:] + step
    rise = (after - np.minimum.accumulate(before, axis=0)).max(axis=1)
    open_ = texts[np.maximum.reduceat(rise, rows[texts]) > switch / 2]
    for i, path in zip(open_, viterbi([scores[rows[i] : rows[i + 1]] for i in open_], switch), strict=True):
        out[rows[i] : rows[i + 1]] = path
    return out


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def identify(texts: list[str], model: LanguageModel) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; see `language_of`."""
    for part in _slices(texts):
        words = words_of(part)
        if not model.languages:
            yield from ((UNKNOWN, 0.0, []) for _ in part)
            continue
        scores = word_scores(words, model)
        labels = labelled(words, scores, model.switch)
        chance = np.exp(scores)
        chance = chance[np.arange(len(labels)), labels] / chance.sum(axis=1) if len(labels) else np.zeros(0)
        begin = 0
        for i, text in enumerate(part):
            a, b = words.rows[i], words.rows[i + 1]
            if a == b:
                yield UNKNOWN, 0.0, []
            else:
                weight = np.bincount(labels[a:b], words.letters[a:b], len(model.languages))
                winner = int(weight.argmax())
                mine = labels[a:b] == winner
                score = float((chance[a:b] * mine * words.letters[a:b]).sum() / words.letters[a:b].sum())
                cut = np.concatenate([[a], a + 1 + np.flatnonzero(labels[a + 1 : b] != labels[a : b - 1]), [b]])
                spans = [(int(words.starts[x] - begin), int(words.ends[y - 1] - begin), model.languages[labels[x]]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield model.languages[winner], min(score, 1.0), spans
            begin += len(text) + 1


def language_of(text: Column, model: LanguageModel) -> Column:
    """struct<lang_pred, score, spans: array<struct<begin, end, lang>>> of a whole text.

    lang_pred is the language of most letters, or `und` if a text is null or has no letter; score is the mean probability
    of that language over the letters, 0 for letters in other spans. Spans are in characters, from a first to a last word.
    """
    kind = "struct<lang_pred: string, score: double, spans: array<struct<begin: int, end: int, lang: string>>>"

    @F.arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        rows = [{"lang_pred": a, "score": b, "spans": [{"begin": x, "end": y, "lang": z} for x, y, z in c]}
                for a, b, c in identify([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], model)]
        span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]))

    return find(text.cast("binary"))
