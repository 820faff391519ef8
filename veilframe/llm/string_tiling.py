"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilframe.llm.common import column
from veilframe.llm.words import PLAIN, text_slices, window_hashes, word_hashes

MIN_MATCH = 5
THRESHOLD = 0.6
BLOCK_BYTES = 32 << 20


def tiles(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length) of non-overlapping equal runs, the longest first.

    Windows of the search length are compared by running Karp-Rabin hashes, equal ones word by word, and drawn out as
    far as unmarked words agree. The longest matches are marked first; then the search length falls, down to `min_match`.
    Of equally long matches the first in the text, then the first in the item, is marked. A tile of at least
    min(min_match, words of the item) words is never left unmarked.
    """
    n, m = len(text), len(item)
    least = min(min_match, m)
    if not least or n < least:
        return []
    free_text, free_item = np.ones(n, bool), np.ones(m, bool)
    found, length = [], max(least, min(m, n, 4 * least))
    while True:
        matches = _matches(text, item, free_text, free_item, length)
        longest = max((x[2] for x in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        left = False
        for i, j, size in sorted(matches, key=lambda x: (-x[2], x[0], x[1])):
            if free_text[i : i + size].all() and free_item[j : j + size].all():
                free_text[i : i + size] = free_item[j : j + size] = False
                found.append((i, j, size))
            else:
                left = True  # part of it was taken by a longer one: what remains is found again
        if left and _matches(text, item, free_text, free_item, length):
            continue
        if length == least:
            return found
        length = max(least, length // 2)


def _matches(text, item, free_text, free_item, length) -> list[tuple[int, int, int]]:
    """Maximal runs of unmarked equal words of at least `length`."""
    a, b = window_hashes(text, length), window_hashes(item, length)
    if not len(a) or not len(b):
        return []
    taken_text, taken_item = np.concatenate([[0], np.cumsum(~free_text)]), np.concatenate([[0], np.cumsum(~free_item)])
    at_text = np.flatnonzero((taken_text[length:] == taken_text[:-length]) & np.isin(a, b))
    at_item = np.flatnonzero((taken_item[length:] == taken_item[:-length]) & np.isin(b, a))
    where: dict[int, list[int]] = {}
    for j in at_item.tolist():
        where.setdefault(int(b[j]), []).append(j)
    out, covered = [], {}
    for i in at_text.tolist():
        for j in where.get(int(a[i]), ()):
            if covered.get(i - j, -1) > i:  # inside a run that was drawn out already
                continue
            size = 0
            while i + size < len(text) and j + size < len(item) and free_text[i + size] and free_item[j + size] and text[i + size] == item[j + size]:
                size += 1
            if size >= length:
                out.append((i, j, size))
                covered[i - j] = i + size - length + 1
    return out


class Benchmark:
    """The words of benchmark items and their seeds: every run of `min_match` words, or all words of a shorter item."""

    def __init__(self, ids: list, texts: list[str], min_match: int):
        self.ids, self.min_match, self.words = ids, min_match, []
        seeds: dict[int, list[tuple[np.ndarray, int]]] = {}
        for _, _, data, off in text_slices(pa.array(texts, pa.large_string()), 1):
            self.words.append(word_hashes(data, off, PLAIN)[0])
        for i, words in enumerate(self.words):
            width = min(min_match, len(words))
            if width:
                seeds.setdefault(width, []).append((np.unique(window_hashes(words, width)), i))
        self.seeds = {}
        for width, lists in seeds.items():
            keys = np.concatenate([s for s, _ in lists])
            owners = np.concatenate([np.full(len(s), i) for s, i in lists])
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[keys & np.uint64((1 << 20) - 1)] = True
            self.seeds[width] = keys[order], owners[order], bits

    def shared(self, words: np.ndarray, rows: np.ndarray) -> dict[int, set[int]]:
        """Rows that share a seed with an item, and these items."""
        found: dict[int, set[int]] = {}
        for width, (keys, owners, bits) in self.seeds.items():
            windows = window_hashes(words, width)
            at = np.flatnonzero(bits[windows & np.uint64((1 << 20) - 1)])
            low, high = np.searchsorted(keys, windows[at], "left"), np.searchsorted(keys, windows[at], "right")
            hit = np.flatnonzero(high > low)
            row = np.searchsorted(rows, at[hit], "right") - 1
            for k, r in zip(hit.tolist(), row.tolist(), strict=True):
                if at[k] + width <= rows[r + 1]:  # not across the end of a text
                    found.setdefault(r, set()).update(owners[low[k] : high[k]].tolist())
        return found


def tiled_hits(texts: pa.Array, bench: Benchmark, threshold: float) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, words of the item, words covered, tiles, longest tile) of all texts that reach the threshold."""
    hits = []
    for lo, _, data, off in text_slices(texts):
        words, rows = word_hashes(data, off, PLAIN)
        for r, owners in sorted(bench.shared(words, rows).items()):
            for i in sorted(owners):
                found = tiles(words[rows[r] : rows[r + 1]], bench.words[i], bench.min_match)
                total, covered = len(bench.words[i]), sum(t[2] for t in found)
                if found and covered >= threshold * total:
                    hits.append((lo + r, i, total, covered, len(found), max(t[2] for t in found)))
    return hits


def benchmark_blocks(
    benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES,
) -> Iterator[Broadcast]:
    """The benchmark in blocks of about `block_bytes` of text, each sent to the executors as word hashes."""
    items = benchmark.select(column(item_column).alias("item"), column(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark([r.item for r in rows], [r.text for r in rows], min_match))


def is_contaminated(text: Column, blocks: list[Broadcast], threshold: float = THRESHOLD) -> Column:
    """Whether tiles of a text cover at least `threshold` of any item of any block; false for null. One narrow pass."""

    def held_against(sent: Broadcast) -> Column:
        @F.arrow_udf("boolean")
        def hit(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts), bool)
            out[[h[0] for h in tiled_hits(texts, sent.value, threshold)]] = True
            return pa.array(out)

        return hit(F.coalesce(text, F.lit("")))

    return reduce(Column.__or__, map(held_against, blocks))


def tile_coverage(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs of a document and a benchmark item whose tiles cover at least `threshold` of the item's words.

    Columns: the document's id, the item's id, item_words, covered_words, coverage, n_tiles, longest (words of the longest
    tile). Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case, so changed case and
    punctuation do not hide a passage, nor does another order of its parts of `min_match` words and more. Null and empty
    texts and items without words match nothing; an item shorter than `min_match` must occur whole; repeated rows and
    repeated items each give their own pairs.

    The benchmark is taken in blocks of about `block_bytes` of text, each sent to the executors and held against all
    documents in one narrow pass: no shuffle, so no key can be hot. A document is tiled only with items of which it has a
    seed.
    """
    id_kind, item_kind = docs.schema[id_column].dataType, benchmark.schema[item_column].dataType
    item_type = to_arrow_type(item_kind)
    schema = f"id {id_kind.simpleString()}, item {item_kind.simpleString()}, item_words long, covered_words long, coverage double, n_tiles long, longest long"
    names = ["id", "item", "item_words", "covered_words", "coverage", "n_tiles", "longest"]
    source = docs.select(column(id_column).alias("id"), F.coalesce(column(text_column), F.lit("")).alias("text"))

    def held_against(sent: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = tiled_hits(batch.column("text"), sent.value, threshold)
                row, item, total, covered, count, longest = zip(*hits, strict=True) if hits else [()] * 6
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(row, pa.int64())), pa.array([sent.value.ids[i] for i in item], item_type),
                    pa.array(total, pa.int64()), pa.array(covered, pa.int64()), pa.array([c / t for c, t in zip(covered, total, strict=True)], pa.float64()),
                    pa.array(count, pa.int64()), pa.array(longest, pa.int64()),
                ], names=names)

        return source.mapInArrow(scan, schema)

    blocks = benchmark_blocks(benchmark, item_column, item_text, min_match, block_bytes)
    return reduce(DataFrame.unionAll, map(held_against, blocks)).toDF(id_column, item_column, *names[2:])
