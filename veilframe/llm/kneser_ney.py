"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays that workers map into memory.

Words are known by a 64-bit hash, and in the model by their rank among all hashes; a bigram is two ranks in one 64-bit
number. Counting sends packed arrays: a task reduces what it has read to distinct keys with counts, cut by partition, and
each partition merges what it gets into one sorted array and writes it to the shared folder. Vocabulary partitions are
ranges of the hash; bigram partitions are ranges of a hash of the whole bigram, so a frequent word burdens none of them;
what the model needs per word is summed in ranges of ranks. Nothing but a few numbers per partition reaches the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column
from veilframe.llm.words import mix, text_slices, word_hashes
from veilframe.session import fresh_path, stage

HELD_KEYS = 1_500_000
SLICE = 2 << 20
_U64 = np.uint64
_END = mix(np.array([0xE0D], _U64))[0]  # the end of a text, as a word
_START = _U64(0xFFFFFFFF)  # the place before its first word, only ever a context
_NONE = _U64(0xFFFFFFFE)  # a word that training has not met


def mounted(path: str) -> str:
    """A path of the local file tree. The shared folder must be mounted where workers run, or arrays cannot be mapped."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model's folder must be on a mounted file system, not {parts.scheme}://; pass folder=")
    return parts.path


@dataclass(frozen=True)
class BigramModel:
    """Where the arrays are, and the few numbers that hold for the whole model."""

    folder: str
    partitions: int
    first_rank: tuple[int, ...]  # of each vocabulary partition
    tokens: int
    types: int
    bigrams: int
    discounts: tuple[float, float, float]  # of bigrams met once, twice, more often
    word_discounts: tuple[float, float, float]
    word_kinds: tuple[int, int, int]  # words with one, two, more left neighbours


def _write(folder: str, name: str, values: np.ndarray) -> None:
    """An array file, complete or not there: a repeated task writes the same bytes again."""
    path = os.path.join(folder, name + ".npy")
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, path)


class Maps:
    """Arrays of a model folder, mapped into memory when first asked for."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.open:
            if len(self.open) > 10_000:
                self.open.clear()
            self.open[name] = np.asarray(np.load(os.path.join(self.folder, name + ".npy"), mmap_mode="r"))
        return self.open[name]


def _part(hashes: np.ndarray, partitions: int) -> np.ndarray:
    return (((hashes >> _U64(32)) * _U64(partitions)) >> _U64(32)).astype(np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def _packed(part: np.ndarray, keys: np.ndarray, counts: np.ndarray, kind: str) -> pa.RecordBatch:
    """One row per partition, keys and counts as bytes."""
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
    ends = [*cut[1:], len(part)]
    return pa.RecordBatch.from_arrays([
        pa.array(part[cut].astype(np.int32), pa.int32()), pa.array([kind] * len(cut), pa.string()),
        pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary()),
        pa.array([counts[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary()),
    ], names=["part", "kind", "keys", "counts"])


_PACKED = "part int, kind string, keys binary, counts binary"


def _counted(docs: DataFrame, partitions: int, keys_of: Callable, part_of: Callable) -> DataFrame:
    """Packed counts of the keys of all texts, distinct within every few million."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, state = [], 0, {}
        for batch in batches:
            for _, _, data, off in text_slices(batch.column("text"), SLICE):
                held.append(keys_of(*word_hashes(data, off), state))
                number += len(held[-1])
                if number >= HELD_KEYS:
                    keys, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield _packed(part_of(keys), keys, counts.astype(np.uint32), "count")
                    held, number = [], 0
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield _packed(part_of(keys), keys, counts.astype(np.uint32), "count")

    return docs.mapInArrow(emit, _PACKED)


def _merged(packed: DataFrame, partitions: int, finish: Callable, schema: str, value_type: str) -> DataFrame:
    """Apply `finish(part, {kind: (keys, sums)})`, which returns record batches, to every partition's merged keys."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}

        def done():
            return finish(part, {
                kind: _summed(np.frombuffer(b"".join(k), _U64), np.frombuffer(b"".join(c), value_type).astype(np.int64)) for kind, (k, c) in held.items()
            })

        for batch in batches:
            for p, kind, k, c in zip(*(batch.column(n).to_pylist() for n in ("part", "kind", "keys", "counts")), strict=True):
                if p != part and held:
                    yield from done()
                    held = {}
                part = p
                keys, counts = held.setdefault(kind, ([], []))
                keys.append(k)
                counts.append(c)
        if held:
            yield from done()

    return packed.repartition(partitions, "part").sortWithinPartitions("part", "kind").mapInArrow(gather, schema)


def _with_ends(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with an end after each text, and the offsets of the texts in them."""
    out = np.insert(words, rows[1:], _END)
    return out, rows + np.arange(len(rows))


def _ranks(hashes: np.ndarray, maps: Maps, partitions: int, first_rank: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of words (_NONE where unknown) and how often each occurs in training."""
    keys, back = np.unique(hashes, return_inverse=True)
    ranks, counts = np.full(len(keys), _NONE, _U64), np.zeros(len(keys), np.int64)
    part = _part(keys, partitions)
    cuts = np.searchsorted(part, np.arange(partitions + 1))
    for p in np.unique(part).tolist():
        some, known = keys[cuts[p] : cuts[p + 1]], maps[f"words-{p}"] if first_rank[p + 1] > first_rank[p] else np.zeros(0, _U64)
        if len(known):
            at = np.minimum(np.searchsorted(known, some), len(known) - 1)
            hit = known[at] == some
            ranks[cuts[p] : cuts[p + 1]] = np.where(hit, at.astype(_U64) + _U64(first_rank[p]), _NONE)
            counts[cuts[p] : cuts[p + 1]] = np.where(hit, maps[f"counts-{p}"][at], 0)
    return ranks[back], counts[back]


def _pairs(ranks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bigram that ends in each word."""
    before = np.empty(len(ranks), _U64)
    before[1:] = ranks[:-1]
    before[rows[:-1]] = _START
    return (before << _U64(32)) | ranks


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many keys occur once, twice, three and four times; plain halves where a count lacks."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(v, 0.0), float(i)) for i, v in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


def _kinds(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)] + [int((counts >= 3).sum())]


def fit_bigrams(docs: DataFrame, text_column: str = "text", folder: str | None = None) -> BigramModel:
    """Count all texts of `docs` (null: empty) and write the model's arrays below `folder` (default: the shared folder).

    A text is its words and one end. More than 2^32 - 2 different words are refused. There are as many partitions as the
    session shuffles into. Arrays, by partition: words (hashes in order) and counts; pairs (bigrams in order) and
    pair_counts; per word by rank: left (its different left neighbours), total, and how many words follow it once, twice, more.
    """
    spark = docs.sparkSession
    folder = mounted(folder or fresh_path(spark, "bigrams"))
    os.makedirs(folder, exist_ok=True)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(column(text_column), F.lit("")).alias("text"))

    def words_of(words, rows, state):
        return _with_ends(words, rows)[0]

    def write_words(part, merged):
        keys, counts = merged["count"]
        _write(folder, f"words-{part}", keys)
        _write(folder, f"counts-{part}", counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())]})

    counted = _counted(texts, partitions, words_of, lambda keys: _part(keys, partitions))
    sizes = {r.part: r for r in _merged(counted, partitions, write_words, "part int, types long, tokens long", "u4").collect()}
    first = np.cumsum([0, *(sizes[p].types if p in sizes else 0 for p in range(partitions))])
    first_rank, types, tokens = tuple(first.tolist()), int(first[-1]), sum(r.tokens for r in sizes.values())
    if types >= int(_NONE):
        raise ValueError(f"{types} different words do not fit into 32-bit ranks")

    def pairs_of(words, rows, state):
        maps = state.setdefault("maps", Maps(folder))
        words, rows = _with_ends(words, rows)
        return _pairs(_ranks(words, maps, partitions, first_rank)[0], rows)

    def rank_part(ranks: np.ndarray) -> np.ndarray:
        return np.where(ranks == _START, partitions, ranks.astype(np.int64) * partitions // max(types, 1))

    def write_pairs(part, merged):
        keys, counts = merged["count"]
        _write(folder, f"pairs-{part}", keys)
        _write(folder, f"pair_counts-{part}", counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
        left, right = keys >> _U64(32), keys & _U64(0xFFFFFFFF)
        once, twice, more = ((counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64))
        ranks, total, once, twice, more = _summed(left, counts, once, twice, more)
        for kind, values in (("total", total), ("once", once), ("twice", twice), ("more", more)):
            keep = values > 0
            yield _packed(rank_part(ranks[keep]), ranks[keep], values[keep], kind)
        ranks, neighbours = _summed(right, np.ones(len(right), np.int64))
        yield _packed(rank_part(ranks), ranks, neighbours, "left")
        kinds = np.array([*_kinds(counts), len(keys)], np.int64)
        yield _packed(np.full(len(kinds), -1), np.arange(len(kinds), dtype=_U64), kinds, "kinds")

    counted = _counted(texts, partitions, pairs_of, lambda keys: _part(mix(keys), partitions))
    sums = stage(_merged(counted, partitions, write_pairs, _PACKED, "u4"), "bigram-sums")
    kinds = np.zeros(6, np.int64)
    for r in sums.where("part = -1").select("counts").collect():
        kinds += np.frombuffer(r["counts"], np.int64)

    def write_ranks(part, merged):
        low = -(-part * types // partitions) if part < partitions else int(_START)
        high = -(-(part + 1) * types // partitions) if part < partitions else int(_START) + 1
        left = np.zeros(high - low, np.int64)
        for kind in ("left", "total", "once", "twice", "more"):
            values = np.zeros(high - low, np.int64)
            if kind in merged:
                keys, sums_ = merged[kind]
                values[keys.astype(np.int64) - low] = sums_
            _write(folder, f"{kind}-{part}", values)
            left = values if kind == "left" else left
        one, two, three, four, more = _kinds(left)
        yield pa.RecordBatch.from_pydict({"one": [one], "two": [two], "three": [three], "four": [four], "more": [more]})

    schema = "one long, two long, three long, four long, more long"
    rest = _merged(sums.where("part >= 0"), partitions + 1, write_ranks, schema, "i8").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("one", "two", "three", "four", "more")]
    ).first()
    return BigramModel(
        folder, partitions, first_rank, tokens, types, int(kinds[5]), discounts(kinds[:4].tolist()),
        discounts([rest.one, rest.two, rest.three, rest.four]), (rest.one, rest.two, rest.more),
    )


def _looked_up(ranks: np.ndarray, names: tuple[str, ...], maps: Maps, model: BigramModel) -> list[np.ndarray]:
    """Numbers of words by rank; 0 for unknown ones."""
    keys, back = np.unique(ranks, return_inverse=True)
    out = [np.zeros(len(keys), np.int64) for _ in names]
    known = np.flatnonzero(keys != _NONE)
    start = keys[known] == _START
    part = np.where(start, model.partitions, keys[known].astype(np.int64) * model.partitions // max(model.types, 1))
    for p in np.unique(part).tolist():
        if not os.path.exists(os.path.join(model.folder, f"left-{p}.npy")):
            continue
        at = known[part == p]
        low = -(-p * model.types // model.partitions) if p < model.partitions else int(_START)
        for values, name in zip(out, names, strict=True):
            values[at] = maps[f"{name}-{p}"][keys[at].astype(np.int64) - low]
    return [v[back] for v in out]


def _pair_counts(pairs: np.ndarray, maps: Maps, model: BigramModel) -> np.ndarray:
    keys, back = np.unique(pairs, return_inverse=True)
    out, part = np.zeros(len(keys), np.int64), _part(mix(keys), model.partitions)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(model.partitions + 1))
    for p in range(model.partitions):
        at = order[cuts[p] : cuts[p + 1]]
        if len(at) and os.path.exists(os.path.join(model.folder, f"pairs-{p}.npy")):
            known = maps[f"pairs-{p}"]
            where = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            out[at] = np.where(known[where] == keys[at], maps[f"pair_counts-{p}"][where], 0)
    return out[back]


def token_log10(words: np.ndarray, rows: np.ndarray, model: BigramModel, maps: Maps) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every token (words and ends) after the one before it, and its count in training."""
    ranks, counts = _ranks(words, maps, model.partitions, model.first_rank)
    pairs = _pairs(ranks, rows)
    (left,) = _looked_up(ranks, ("left",), maps, model)
    total, once, twice, more = _looked_up(pairs >> _U64(32), ("total", "once", "twice", "more"), maps, model)
    found = _pair_counts(pairs, maps, model)
    unit = 1.0 / (model.types + 1)
    if model.bigrams:
        share = sum(d * k for d, k in zip(model.word_discounts, model.word_kinds, strict=True)) / model.bigrams
        word = np.maximum(left - np.array([0.0, *model.word_discounts])[np.minimum(left, 3)], 0) / model.bigrams + share * unit
    else:
        word = np.full(len(words), unit)
    d1, d2, d3 = model.discounts
    seen = np.maximum(total, 1)
    pair = np.maximum(found - np.array([0.0, d1, d2, d3])[np.minimum(found, 3)], 0) / seen + (d1 * once + d2 * twice + d3 * more) / seen * word
    return np.log10(np.where(total > 0, pair, word)), counts


def score_texts(df: DataFrame, model: BigramModel, text_column: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of `df` (default: all but the text) with n_tokens, n_known, base_score, score, perplexity.

    score is the log10 probability of the whole text, its end included; base_score that of single words with one added
    to each count. Null is scored as empty: only its end. Columns of these names in `df` are replaced.
    """
    made = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    keep = tuple(c for c in (keep or [c for c in df.columns if c != text_column]) if c.lower() not in made)
    inner = [f"c_{i}" for i in range(len(keep))]
    source = df.select(*[column(c).alias(n) for c, n in zip(keep, inner, strict=True)], F.coalesce(column(text_column), F.lit("")).alias("text_"))
    head = "".join(f"`{n}` {source.schema[n].dataType.simpleString()}, " for n in inner)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Maps(model.folder)
        log_all = np.log10(model.tokens + model.types + 1)
        for batch in batches:
            parts = []
            for _, _, data, off in text_slices(batch.column("text_"), SLICE):
                words, rows = _with_ends(*word_hashes(data, off))
                score, counts = token_log10(words, rows, model, maps)
                first = rows[:-1]
                parts.append((np.diff(rows), np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(np.log10(counts + 1.0) - log_all, first), np.add.reduceat(score, first)))
            n, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
            kept = batch.drop_columns(["text_"])
            values = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), pa.array(10 ** (-score / np.maximum(n, 1)))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *values], names=[*inner, *made])

    schema = head + "n_tokens long, n_known long, base_score double, score double, perplexity double"
    return source.mapInArrow(scan, schema).toDF(*keep, *made)


def train_and_score(df: DataFrame, training: Column, text_column: str = "text", folder: str | None = None) -> tuple[BigramModel, DataFrame]:
    """A model of the rows of `df` that hold `training`, and the scores of all rows."""
    model = fit_bigrams(df.where(training), text_column, folder)
    return model, score_texts(df, model, text_column)
