"""N-gram Jaccard self-join by parity sketches, and the groups of near copies that its links connect."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column
from veilframe.llm.components import components
from veilframe.llm.words import mix, shingle_sets
from veilframe.session import stage

PARTITION_SIGNATURES = 1_000_000
FLUSH_SIGNATURES = 1_000_000
TILE = 512
TILE_BYTES = 8 << 20
BROADCAST_ROWS, BROADCAST_ID_BYTES = 100_000, 10_000_000  # of a side that is broadcast; its rows have about 100 bytes and an id
SALTS = 64  # parts in which the rows of one set look for their answer
_U64 = np.uint64


class Bands:
    """Size bands and the largest symmetric difference in each, for a Jaccard similarity of `num` / `den` and more.

    Sets of a and b elements with that similarity differ in at most (a + b) * (den - num) / (den + num) elements, and
    the smaller has at least num / den of the larger one's. Band l holds sizes up to `high[l]`, half as large again as
    the band before. A pair meets in the band of its larger set.
    """

    def __init__(self, num: int, den: int):
        if not den < 2 * num <= 2 * den:
            raise ValueError("the similarity must be above 1/2 and at most 1")
        self.num, self.den = num, den
        high = [1]
        while high[-1] < 1 << 40:
            high.append(max(high[-1] + 1, high[-1] * 3 // 2))
        self.high = np.array(high)

    def difference(self, total: int) -> int:
        return total * (self.den - self.num) // (self.den + self.num)

    def of(self, n: int) -> range:
        """The bands in which a set of n elements can meet partners at least as large, and its own."""
        return range(int(np.searchsorted(self.high, n)), int(np.searchsorted(self.high, n * self.den // self.num)) + 1)


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """64-bit signatures of a set (sorted distinct hashes): two sets similar enough and not equal share at least one.

    In each of its bands the set's elements are hashed into k blocks; a block is a sparse parity sketch (elements flip
    bits, here as the XOR of one random number per bit), and its signature is made of band, block and sketch. An element
    in which two sets differ changes one block; a set with more non-empty blocks than it can have differences with any
    partner of the band has one that its partner has too. k is the most differences in the band and room for a few empty
    blocks; a set that still has too many is hashed anew, with another salt and more blocks, until it has enough, which
    comes to pass as a set has more elements than differences (that takes a similarity above 1/2). Two partners meet
    under the first salt that is enough for either of them. Empty blocks, which unrelated sets would share, are never
    used.
    """
    out = []
    for band in bands.of(len(elements)):
        d = bands.difference(2 * int(bands.high[band]))
        if not d:
            continue  # only equal sets are similar enough
        n, salt = len(elements), 0
        most = bands.difference(n + min(int(bands.high[band]), n * bands.den // bands.num))
        while True:
            k = (d + d // 12 + 3) * (salt + 1)
            placed = elements if not salt else np.sort(mix(elements + _U64(salt)))
            block = ((placed >> _U64(32)) * _U64(k)) >> _U64(32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            sketch = np.bitwise_xor.reduceat(mix(placed), first)
            out.append(mix(sketch + mix(block[first] + (_U64(band) << _U64(44)) + (_U64(salt) << _U64(54)))))
            if len(first) > most:
                break
            salt += 1
    return np.concatenate(out) if out else np.zeros(0, _U64)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """A dense parity sketch in 64-bit words: each element flips the bit its hash names. As many bits as elements, about.

    The Hamming distance of two sketches is at most the symmetric difference of their sets. XOR of its halves is the sketch
    of half the length, so sketches of any two sets can be compared.
    """
    bits = 256
    while bits < len(elements) and bits < 1 << 16:
        bits *= 2
    flips = np.bincount((mix(elements + _U64(3)) & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(_U64)


def _folded(sketch: bytes, words: int) -> np.ndarray:
    out = np.frombuffer(sketch, _U64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _digests(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    n = _U64(len(elements))
    a, b = np.add.reduce(mix(elements ^ _U64(0xA5A5A5A5))) + n, np.add.reduce(mix(elements + _U64(0x5BD1E995))) ^ mix(np.array([n]))[0]
    return int(mix(np.array([a]))[0]), int(mix(np.array([b]))[0])


def _class(d1: int, d2: int) -> bytes:
    return d1.to_bytes(8, "big") + d2.to_bytes(8, "big")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _sets(docs: DataFrame, width: int, names: dict[str, str]) -> DataFrame:
    """One row per document: its columns but for text, n, class (digest of its set, null without words) and sketch."""
    kinds = {f.name: f.dataType for f in docs.schema}
    head = ", ".join(f"`{n}` {kinds[n].simpleString()}" for n in names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, sketches = [], [], []
            for _, elements in shingle_sets(batch.column("text"), width):
                n.append(len(elements))
                classes.append(_class(*_digests(elements)) if len(elements) else None)
                sketches.append(parity_sketch(elements).tobytes() if len(elements) else None)
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(sketches, pa.binary())],
                names=[*kept.schema.names, "n", "class", "sketch"],
            )

    return docs.mapInArrow(scan, f"{head}, n long, class binary, sketch binary")


def _buckets(docs: DataFrame, width: int, bands: Bands, partitions: int) -> DataFrame:
    """(bucket, node): sets that share a signature, a node being the first digest of a set. Equal buckets are one.

    Signatures travel packed, a row per partition and million of them. A task sends those of equal sets once.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, signs, nodes, held = set(), [], [], 0

        def flush():
            nonlocal held
            sign, node = np.concatenate(signs), np.concatenate(nodes)
            part = ((sign >> _U64(32)) * _U64(partitions)) >> _U64(32)
            order = np.argsort(part, kind="stable")
            sign, node, part = (sign & _U64(0xFFFFFFFF)).astype(np.uint32)[order], node[order], part[order]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
            ends = [*cut[1:], len(part)]
            signs.clear(), nodes.clear()
            held = 0
            return pa.RecordBatch.from_arrays([
                pa.array(part[cut].astype(np.int32)), pa.array([sign[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([node[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
            ], names=["part", "signs", "nodes"])

        for batch in batches:
            for _, elements in shingle_sets(batch.column("text"), width):
                if not len(elements):
                    continue
                digests = _digests(elements)
                if digests in seen:
                    continue
                if len(seen) >= 50_000:  # only saves work, so it may forget
                    seen.clear()
                seen.add(digests)
                signs.append(signatures(elements, bands))
                nodes.append(np.full(len(signs[-1]), digests[0], _U64))
                held += len(signs[-1])
                if held >= FLUSH_SIGNATURES:
                    yield flush()
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, signs, nodes = None, [], []
        for batch in batches:
            for p, s, n in zip(*(batch.column(c).to_pylist() for c in ("part", "signs", "nodes")), strict=True):
                if p != part and signs:
                    yield shared(signs, nodes)
                    signs, nodes = [], []
                part = p
                signs.append(s)
                nodes.append(n)
        if signs:
            yield shared(signs, nodes)

    def shared(signs: list[bytes], nodes: list[bytes]) -> pa.RecordBatch:
        sign, node = np.frombuffer(b"".join(signs), np.uint32), np.frombuffer(b"".join(nodes), _U64)
        order = np.argsort(sign, kind="stable")
        sign = sign[order]
        twin = np.zeros(len(sign), bool)
        twin[1:] = sign[1:] == sign[:-1]
        twin[:-1] |= twin[1:]
        sign, node = sign[twin], node[order][twin]
        order = np.lexsort((node, sign))
        sign, node = sign[order], node[order]
        fresh = np.ones(len(sign), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
        sign, node = sign[fresh], node[fresh]
        first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]])) if len(sign) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(sign)]]))
        bucket = mix(np.add.reduceat(mix(node), first)) if len(first) else np.zeros(0, _U64)
        _, only = np.unique(bucket, return_index=True)
        take = np.zeros(len(first), bool)
        take[only] = True
        take &= size > 1
        rows = np.repeat(take, size)
        return pa.RecordBatch.from_arrays([_signed(np.repeat(bucket[take], size[take])), _signed(node[rows])], names=["bucket", "node"])

    packed = docs.select("text").mapInArrow(emit, "part int, signs binary, nodes binary")
    met = packed.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(gather, "bucket long, node long")
    return met.distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows, all of one key together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for i, v in enumerate(values):
            if v != last:
                if begin < i:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, v
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, for rows that hold whole sets."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _candidates(members: DataFrame, bands: Bands, across: bool) -> DataFrame:
    """Pairs (a, b) of sets of one bucket whose sketches do not rule the similarity out.

    `members`: bucket, class, n, sketch, label. A bucket of more than 512 sets is taken in tiles of two chunks of it, so
    no task holds it whole. Within a tile, sets are visited breadth first along pairs that pass, and only the pairs of
    this forest are returned: enough to connect what is similar. With `across`, all passing pairs of sets whose labels
    differ are returned, the exact rest.
    """
    chunks = members.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    tiled = members.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiled = tiled.select("*", other.alias("other")).select(
        "bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "class", "n", "sketch", "label",
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for run in _runs(batches, ("bucket", "low", "high")):
            names, labels = run.column("class").to_pylist(), run.column("label").to_pylist()
            n, sketches = run.column("n").to_numpy(), run.column("sketch").to_pylist()
            if len(names) < 2 or (across and len(set(labels)) < 2):
                continue
            words = min(map(len, sketches)) // 8
            dense = np.stack([_folded(s, words) for s in sketches])

            def passing(i: int, among: np.ndarray) -> np.ndarray:
                a, b = n[i], n[among]
                small, large = np.minimum(a, b), np.maximum(a, b)
                among = among[small * bands.den >= large * bands.num]
                most = (a + n[among]) * (bands.den - bands.num) // (bands.den + bands.num)
                return among[np.bitwise_count(dense[among] ^ dense[i]).sum(axis=1, dtype=np.int64) <= most]

            if across:
                code = np.unique(np.array(labels, dtype="S16"), return_inverse=True)[1]
                for i in range(len(names) - 1):
                    rest = np.arange(i + 1, len(names))
                    for j in passing(i, rest[code[rest] != code[i]]).tolist():
                        left.append(names[i]), right.append(names[j])
            else:
                open_, queue = np.arange(len(names)), []
                while len(open_):
                    i = queue.pop(0) if queue else int(open_[0])
                    open_ = open_[open_ != i]
                    near = passing(i, open_)
                    for j in near.tolist():
                        left.append(names[i]), right.append(names[j])
                    queue += near.tolist()
                    open_ = np.setdiff1d(open_, near, assume_unique=True)
            if len(left) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    pairs = tiled.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "class").mapInArrow(visit, "a binary, b binary")
    # The set met in more pairs is not known here; the smaller class is the hub, as it is for its other partners.
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fetched(docs: DataFrame, wanted: DataFrame, schema: str, width: int) -> DataFrame:
    """The rows of `wanted`, as `schema` names them, and their whole shingle sets, from the texts under `wanted_id` and `wanted_hash`.

    A class is in `wanted` under one id and the hash of one text; where rows repeat both, a task returns a set only once, but
    several tasks may.
    """
    wanted = stage(wanted, "wanted")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(F.col("wanted_id").cast("string")), F.lit(0))).alias("ids")).first()
    if size.n <= BROADCAST_ROWS and (size.ids or 0) <= BROADCAST_ID_BYTES:  # beyond, texts are shuffled by id and hash
        wanted = F.broadcast(wanted)
    same = F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))
    texts = docs.select("id", "text_hash", "text").join(wanted, same).drop("id", "text_hash", "wanted_id", "wanted_hash")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # wanted rows that this task has found, by digest
        for batch in _small(batches):
            rows, sets = [], []
            wanted_rows = zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c != "text"), strict=True)
            marks = [hashlib.blake2b(repr(w).encode(), digest_size=16).digest() for w in wanted_rows]
            fresh = [i for i, m in enumerate(marks) if m not in done]
            batch, marks = batch.take(pa.array(fresh, pa.int64())), [marks[i] for i in fresh]
            names = batch.column("class").to_pylist()
            for i, elements in shingle_sets(batch.column("text"), width):
                if marks[i] not in done and len(elements) and _class(*_digests(elements)) == names[i]:  # hashes may meet
                    done.add(marks[i])
                    rows.append(i)
                    sets.append(elements.tobytes())
            kept = batch.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=[*kept.schema.names, "set"])

    return texts.mapInArrow(fetch, f"{schema}, set binary")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough.

    Each set is sent to the hub of its pairs, and the hub's own set with them; a hub of many pairs has several places.
    """
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE).cast("int").alias("places"))
    spread = pairs.join(places, "a").select(
        F.col("b").alias("class"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"), F.lit(1).alias("role"),
    )
    hubs = places.select(
        F.col("a").alias("class"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("role"),
    )
    wanted = spread.unionAll(hubs).join(classes.select("class", F.col("best.id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash")), "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in _small(batches):
            left, right = [], []
            for name, h, role, held in zip(*(batch.column(c).to_pylist() for c in ("class", "hub", "role", "set")), strict=True):
                elements = np.frombuffer(held, _U64)
                if role == 0:
                    hub, own = h, elements
                elif hub == h:
                    at = np.searchsorted(own, elements)
                    common = int((own[np.minimum(at, len(own) - 1)] == elements).sum())
                    if bands.den * common >= bands.num * (len(own) + len(elements) - common):
                        left.append(h), right.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    sets = _fetched(docs, wanted.select("class", "hub", "place", "role", "wanted_id", "wanted_hash"), "class binary, hub binary, place int, role int", width)
    return (
        sets.repartition("hub", "place").sortWithinPartitions("hub", "place", "role")
        .select("class", "hub", "role", "set").mapInArrow(compare, "a binary, b binary").distinct()
    )


def _all_links(docs: DataFrame, classes: DataFrame, roots: DataFrame, width: int, bands: Bands, counts: bool) -> DataFrame:
    """Every link between classes: (a, b, common), a < b, with the number of shingles they have in common.

    Links lie within components, so each component's classes are compared all with all, on whole sets, once a pair. A
    component is dealt into chunks of about 512 sets and 8 MB, and a task holds two chunks of it. With `counts` the
    answer is (class, n_links), a row per class and tile: to how many rows of other classes its links there lead. So no
    rows are made per link, which a group of thousands of near copies has millions of.
    """
    grouped = roots.select(F.col("node").alias("class"), "root").join(classes, "class")
    chunks = grouped.groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("chunks")
    )
    wanted = grouped.join(chunks, "root").select(
        "class", "root", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int").alias("chunk"), "chunks", F.col("rows").alias("weight"),
        F.col("best.id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"),
    )
    sets = _fetched(docs, wanted, "class binary, root binary, chunk int, chunks int, weight long", width)
    tiled = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "root", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "class", "weight", "set",
    )

    def links(run: pa.Table) -> Iterator[tuple[list[bytes], np.ndarray, int, list[int], list[int]]]:
        """(classes, weights, i, the partners j of i, what they have in common)"""
        held = {c: row for row, c in enumerate(run.column("class").to_pylist())}  # a set may have come more than once
        sizes = pc.binary_length(run.column("set")).to_numpy()
        rows = np.array(sorted(held.values(), key=lambda row: sizes[row]))  # by size, so partners of a set are a range
        run = run.take(pa.array(rows))
        names, weights, chunk = run.column("class").to_pylist(), run.column("weight").to_numpy(), run.column("chunk").to_numpy()
        sets = [np.frombuffer(x, _U64) for x in run.column("set").to_pylist()]
        n = np.array([len(x) for x in sets])
        sketches = [parity_sketch(x).tobytes() for x in sets]
        words = min(map(len, sketches)) // 8
        dense = np.stack([_folded(x, words) for x in sketches])
        distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(codes.astype(np.int32), np.cumsum(n)[:-1])
        present = np.zeros(len(distinct), bool)
        across = run.column("low")[0].as_py() != run.column("high")[0].as_py()
        for i in range(len(names) - 1):
            among = np.arange(i + 1, int(np.searchsorted(n, n[i] * bands.den // bands.num, "right")))
            if across:  # pairs within a chunk meet in its own tile
                among = among[chunk[among] != chunk[i]]
            most = (n[i] + n[among]) * (bands.den - bands.num) // (bands.den + bands.num)
            among = among[np.bitwise_count(dense[among] ^ dense[i]).sum(axis=1, dtype=np.int64) <= most]
            if not len(among):
                continue
            present[codes[i]] = True
            common = np.array([np.count_nonzero(present[codes[j]]) for j in among.tolist()])
            present[codes[i]] = False
            linked = bands.den * common >= bands.num * (n[i] + n[among] - common)
            if linked.any():
                yield names, weights, i, among[linked].tolist(), common[linked].tolist()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(_small(batches), ("root", "low", "high")):
            for names, _, i, partners, common in links(run):
                left, right = zip(*((min(names[i], names[j]), max(names[i], names[j])) for j in partners), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(common, pa.int64())], names=["a", "b", "common"],
                )

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(_small(batches), ("root", "low", "high")):
            found: dict[bytes, int] = {}
            for names, weights, i, partners, _ in links(run):
                found[names[i]] = found.get(names[i], 0) + int(weights[partners].sum())
                for j in partners:
                    found[names[j]] = found.get(names[j], 0) + int(weights[i])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["class", "n_links"])

    dealt = tiled.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return dealt.mapInArrow(degrees, "class binary, n_links long") if counts else dealt.mapInArrow(pairs, "a binary, b binary, common long")


class _Grouped(NamedTuple):
    docs: DataFrame
    rows: DataFrame
    classes: DataFrame
    roots: DataFrame
    bands: Bands


def _grouped(df: DataFrame, num: int, den: int, width: int, id_column: str, text_column: str, carry: tuple[str, ...], partition_signatures: int) -> _Grouped:
    """Documents, their rows with class, the classes, and the components that links between classes make."""
    bands = Bands(num, den)
    docs = df.select(
        column(id_column).alias("id"), *[column(c).alias(f"c_{i}") for i, c in enumerate(carry)], F.coalesce(column(text_column), F.lit("")).alias("text"),
    )
    kept = [n for n in docs.columns if n != "text"]
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    order: Column = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.xxhash64(*kept).alias("hash"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = stage(_sets(docs, width, {n: n for n in [*kept, "text_hash"]}).withColumns({"order": order, "salt": salt}), "sets")
    classes = stage(
        rows.where("n > 0").groupBy("class").agg(F.min("order").alias("best"), F.min_by("text_hash", "order").alias("text_hash"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows")),
        "classes",
    )
    total = rows.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * 2 * (den - num) // (den + num) * 2 // partition_signatures))
    buckets = stage(_buckets(docs, width, bands, partitions), "buckets")
    node = F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long")
    members = buckets.join(classes.select(node.alias("node"), "class", "n", "sketch"), "node").drop("node")

    first = stage(_candidates(members.withColumn("label", F.col("class")), bands, False), "pairs")
    links = stage(_verified(docs, first, classes, width, bands), "links")
    roots = stage(components(links), "roots")
    labelled = members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root")
    rest = stage(_candidates(labelled, bands, True).join(first, ["a", "b"], "left_anti"), "pairs")
    more = stage(_verified(docs, rest, classes, width, bands), "links")
    if not more.isEmpty():
        roots = stage(components(links.unionAll(more)), "roots")
    return _Grouped(docs, rows, classes, roots, bands)


def near_copies(
    df: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_column: str = "doc_id", text_column: str = "text",
    carry: tuple[str, ...] = (), partition_signatures: int = PARTITION_SIGNATURES, links: bool = False,
) -> DataFrame:
    """One row per row of `df`: id, `carry` columns, n_shingles, component_id and kept; with `links` also n_links.

    A document is the set of its distinct shingles of `width` words (all its words as one, if it has fewer; nothing, if it
    has none or no text). Two documents are linked when their sets have a Jaccard similarity of num / den or more;
    component_id is the smallest id that links lead to. Of a component the row with the smallest id is `kept` (rows
    without id lose; among equal ids the one whose carried columns have the smallest hash; rows equal in id and carried
    columns are kept or not together). Documents without words are on their own.

    Equal sets are one class first, however many rows share them. Classes meet in buckets of a shared signature (see
    `signatures`); sketches rule most pairs out; what is left is verified on whole shingle sets. A first round
    tries the pairs that would connect each bucket, a second all pairs that the first left in different components, so no
    link between components is lost and a group of thousands of near copies does not cost all its pairs.

    n_links is the number of other rows that a row is linked with, rows of an equal set among them; for it every component's
    classes are compared all with all (see `_all_links`). `similar_pairs` returns the links themselves.
    """
    docs, rows, classes, roots, bands = _grouped(df, num, den, width, id_column, text_column, carry, partition_signatures)
    named = classes.select("class", "best").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    answer = named.join(named.groupBy("root").agg(F.min("best").alias("winner")), "root").select("class", "winner")
    if links:
        degrees = _all_links(docs, classes, roots, width, bands, counts=True).groupBy("class").agg(F.sum("n_links").alias("others"))
        own = classes.select("class", (F.col("rows") - 1).alias("copies")).join(degrees, "class", "left")
        answer = answer.join(own.select("class", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_links")), "class")
    # A set of very many rows sends each of its parts its answer, so no task reads all of them; rows without words need none.
    parts = rows.where("n > 0").select("class", "salt").distinct().join(answer, "class")
    found = rows.where("n > 0").join(parts, ["class", "salt"]).unionByName(rows.where("n = 0"), allowMissingColumns=True)
    found = found.withColumn("winner", F.coalesce("winner", "order"))
    return found.select(
        F.col("id").alias(id_column), *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], F.col("n").alias("n_shingles"),
        F.col("winner.id").alias("component_id"), (F.col("order") == F.col("winner")).alias("kept"),
        *([F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if links else []),
    )


def similar_pairs(
    df: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_column: str = "doc_id", text_column: str = "text",
    partition_signatures: int = PARTITION_SIGNATURES,
) -> tuple[DataFrame, DataFrame]:
    """All links between different texts, and which text a row has: (pairs, members).

    pairs: a, b (classes, a < b), a_id and b_id (the smallest id of each), a_shingles, b_shingles, common; a row for every two
    classes with a Jaccard similarity of num / den or more. members: id, class; a row per row of `df`, class null without
    words. Rows of one class have equal shingle sets, so the links of rows follow from both. The pairs of a
    group of near copies are as many as the square of its size.
    """
    docs, rows, classes, roots, bands = _grouped(df, num, den, width, id_column, text_column, (), partition_signatures)
    links = _all_links(docs, classes, roots, width, bands, counts=False)
    for side in ("a", "b"):
        named = classes.select(F.col("class").alias(side), F.col("best.id").alias(f"{side}_id"), F.col("n").alias(f"{side}_shingles"))
        links = links.join(named, side)
    return links.select("a", "b", "a_id", "b_id", "a_shingles", "b_shingles", "common"), rows.select(F.col("id").alias(id_column), "class")
