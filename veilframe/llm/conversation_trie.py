"""The prefix trie of conversations, in double arrays per range of sorted conversations.

A turn is a symbol: 16 bytes of a digest of role and text, and the code points of the text. A conversation is the bytes of
its symbols, so sorted conversations stand as in a walk of the trie. They are cut by ranges into prefix shards; a shard is
packed into BASE and CHECK arrays over its own dense turn ids, walked for its nodes, and returns those that no other shard can
have as they are. What lies on the path of its first or last conversation, or above a longer conversation's cut, it shares
with others: those upper nodes are merged by key and summed up their paths by pointer jumping.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import column
from veilframe.llm.double_array import pack
from veilframe.operators.bundle import with_offsets
from veilframe.session import stage

#: Turns of a conversation that stand in one row; longer conversations go on in a further row, below the node they reached.
SEGMENT_TURNS = 256
#: A shard ends at this many different conversations or symbols.
SHARD_ROWS, SHARD_SYMBOLS = 16_384, 1 << 19
_SYMBOL = 20
ROOT = bytes(16)


def turn_symbol(role: Column, text: Column) -> Column:
    """A turn as hex digits: 16 bytes of a digest of role and text, 4 bytes of the text's length in code points."""
    mark = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.left(F.sha2(mark, 256), F.lit(32)), F.lpad(F.hex(F.length(text)), 8, "0"))


def ordered_turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """`(c, symbol, row)`, a conversation's rows in order of turn (null first), then role, then symbol.

    Null role and text are empty; rows without conversation are left out. Rows are numbered over all conversations by one
    range sort, so a conversation of any length is dealt over several tasks.
    """
    who, what = F.coalesce(column(role), F.lit("")), F.coalesce(column(text), F.lit(""))
    rows = df.select(
        column(conv_id).cast("long").alias("c"), column(turn).alias("turn"), who.alias("role"), turn_symbol(who, what).alias("symbol"),
    ).where("c IS NOT NULL")
    return with_offsets(rows, F.lit(0), ["c", "turn", "role", "symbol"]).select("c", "symbol", F.col("__row").alias("row"))


def as_they_are(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations unchanged: `(c, at, symbol, length)` and `(c, length)`."""
    info = conversations.select("c", "first", F.col("n").alias("length"))
    return turns.join(info, "c").select("c", (F.col("row") - F.col("first")).alias("at"), "symbol", "length"), info.select("c", "length")


def with_shared_heads(turns: DataFrame, conversations: DataFrame, family: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every conversation c begins with the first h turns of conversation c - c % family, then has its own turns after its first h.

    h is crc32 of c in decimal, modulo most + 1. What there is of those h turns is taken; an absent conversation has none.
    """
    c = F.col("c")
    heads = turns.where(c % family == 0).join(conversations.select("c", "first"), "c").withColumn("at", F.col("row") - F.col("first"))
    heads = heads.where(F.col("at") < most).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    info = conversations.withColumns({"h": h, "base": c - c % family}).join(heads.withColumnRenamed("c", "base"), "base", "left")
    info = info.withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    info = stage(info.withColumn("length", F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("taken")), "trie-heads")
    own = turns.join(info.select("c", "first", "h", "taken", "length"), "c").withColumn("at", F.col("row") - F.col("first"))
    own = own.where("at >= h").select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "symbol", "length")
    taken = info.where("taken > 0").select("c", "length", F.explode(F.slice("head", 1, F.col("taken"))).alias("t"))
    return own.unionByName(taken.select("c", "t.at", "t.symbol", "length")), info.select("c", "length")


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _segments(turns: DataFrame, width: int) -> DataFrame:
    """`(c, layer, seq, last, root, next)`: conversations in rows of up to `width` turns.

    `root` is the key of the node a row begins at, `next` the key of the node that a full row ends at, from digests of all
    rows so far. Only rows of conversations that are longer than one row meet in a window.
    """
    rows = turns.groupBy("c", F.floor(F.col("at") / width).cast("int").alias("layer")).agg(
        F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("s"), F.first("length").alias("length")
    )
    rows = rows.select(
        "c", "layer", F.unhex(F.array_join(F.transform("s", lambda t: t["symbol"]), "")).alias("seq"),
        (F.col("length") <= (F.col("layer") + 1) * width).alias("last"), (F.col("length") <= width).alias("short"),
    )
    rows = stage(rows.withColumns({"x": F.xxhash64("layer", "seq"), "y": F.xxhash64("seq", "layer", F.lit("y"))}), "trie-rows")
    names = ["c", "layer", "seq", "last"]
    short = rows.where("short").select(*names, F.lit(ROOT).alias("root"), _key(F.col("x"), F.col("y")).alias("next"))
    before = Window.partitionBy("c").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    old = {n: F.coalesce(F.bit_xor(n).over(before), F.lit(0).cast("long")) for n in ("x", "y")}
    long = rows.where("NOT short").select(*names, "x", "y", old["x"].alias("u"), old["y"].alias("v"))
    return short.unionByName(long.select(
        *names, _key(F.col("u"), F.col("v")).alias("root"),
        _key(F.col("u").bitwiseXOR(F.col("x")), F.col("v").bitwiseXOR(F.col("y"))).alias("next"),
    ))


_NODE = (
    "key binary, parent binary, depth long, shared boolean, conv_id long, parent_conv_id long, n_convs long, n_ends long, "
    "end_id long, children long, leaves long, saved long, points long"
)


def _pack_shards(width: int):
    """Sorted `(root, layer, seq, next, n, least, n_ends, end_id)` to nodes, a shard at a time."""

    def packed(batches):
        held, symbols = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                held.append(row)
                symbols += len(row[2]) // _SYMBOL + 1
                if len(held) >= SHARD_ROWS or symbols >= SHARD_SYMBOLS:
                    yield _shard(held, width)
                    held, symbols = [], 0
        if held:
            yield _shard(held, width)

    return packed


def _shard(rows: list[tuple], width: int) -> pa.RecordBatch:
    """The nodes of one shard. Its roots take part as first symbols."""
    roots, layers, seqs, nexts, counts, least, n_ends, end_ids = zip(*rows, strict=True)
    sizes = np.array([len(s) // _SYMBOL for s in seqs], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    # Dense ids: the shard's different turns, then its roots.
    turns, dense = np.unique(np.frombuffer(b"".join(seqs), f"S{_SYMBOL}"), return_inverse=True)
    root_ids = {r: len(turns) + 1 + i for i, r in enumerate(dict.fromkeys(roots))}
    codes = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(codes), bool)
    inside[starts] = False
    codes[inside] = dense + 1
    codes[starts] = [root_ids[r] for r in roots]
    trie = pack(codes, ends)

    size = len(trie.check)
    convs, ending, depth = (np.zeros(size, np.int64) for _ in range(3))
    low, sample, end_id = (np.full(size, np.iinfo(np.int64).max) for _ in range(3))
    ported, shared = np.zeros(size, bool), np.zeros(size, bool)
    weight, smallest = np.array(counts, np.int64), np.array(least, np.int64)
    last, ended = np.array(n_ends, np.int64), np.array([np.iinfo(np.int64).max if e is None else e for e in end_ids], np.int64)
    goes_on = weight > last
    final, levels = np.zeros(len(rows), np.int64), []
    for level, (here, states) in enumerate(trie.levels(codes, ends)):
        np.add.at(convs, states, weight[here])
        np.minimum.at(low, states, smallest[here])
        np.minimum.at(sample, states, here)
        ported[states[goes_on[here]]] = True
        shared[states[(here == 0) | (here == len(rows) - 1)]] = True
        depth[states] = level
        final[here] = states
        levels.append(np.unique(states))
    np.add.at(ending, final, last)
    np.minimum.at(end_id, final, ended)
    shared |= ported
    shared[levels[0]] = True

    points = np.zeros(size, np.int64)
    lengths = np.frombuffer(b"".join(t.ljust(_SYMBOL, b"\0")[16:] for t in turns.tolist()), ">u4").astype(np.int64)
    for states in levels[1:]:
        points[states] = lengths[codes[starts[sample[states]] + depth[states]] - 1]
    parent = trie.check
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    for states in levels[::-1]:
        own = ~shared[states]
        mine = states[own]
        leaves[mine] += children[mine] == 0
        saved[mine] += (convs[mine] - 1) * points[mine]
        # What hangs below a shared node without being shared itself is complete and counts here.
        for total, part in ((children, 1), (leaves, leaves[mine]), (saved, saved[mine])):
            np.add.at(total, parent[mine], part)

    out, keys = [], {}
    for level, states in enumerate(levels):
        for t in states.tolist():
            i = int(sample[t])
            if not level:
                key = roots[i]
            elif level == width:
                key = nexts[i]
            else:
                key = hashlib.md5(roots[i] + seqs[i][: level * _SYMBOL]).digest()
            keys[t] = key
            up, above = int(parent[t]), layers[i] * width
            later_root = not level and above > 0  # counted where it ends a row of the layer above
            out.append((
                key, keys[up] if level else None, above + level, bool(shared[t]), None if later_root else int(low[t]),
                int(low[up]) if level and not shared[up] else None, 0 if later_root else int(convs[t]), int(ending[t]),
                int(end_id[t]) if ending[t] else None, int(children[t]), int(leaves[t]), int(saved[t]), int(points[t]),
            ))
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.bool_()] + [pa.int64()] * 9
    names = [f.split()[0] for f in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _summed_up(tree: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`(key, columns)`: of every node of `(key, parent, depth, columns)` the sums over its subtree.

    Pointer jumping: in round r every node's sums, so far of what lies less than 2^r below it, go to its ancestor 2^r above.
    """
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    now = tree.select("key", F.col("parent").alias("up"), *columns)
    for _ in range(int(deepest).bit_length()):
        given = now.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(*[F.sum(c).alias(f"more_{c}") for c in columns])
        jumped = now.select(F.col("key").alias("up"), F.col("up").alias("further"))
        more = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in columns]
        now = stage(now.join(given, "key", "left").join(jumped, "up", "left").select("key", F.col("further").alias("up"), *more), "trie-sums")
    return now.select("key", *columns)


def _end_digests(ends: DataFrame) -> DataFrame:
    """`(key, digest)`: SHA-256 over the numbers `c` of every key, ascending, comma-joined; of keys of several numbers.

    Sorted by ranges, so that a key of any size is dealt over several tasks. Each task joins the numbers of a key
    as text; keys that may go on in the next batch or task come out as pieces, and only pieces are read in order by key.
    """

    def joined(batches):
        for batch in batches:
            key, number = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(key):
                to = at + 1
                while to < len(key) and key[to] == key[at]:
                    to += 1
                piece = not at or to == len(key)
                if piece or to > at + 1:
                    text = ",".join(map(str, number[at:to]))
                    out.append((key[at], number[at], text if piece else None, None if piece else hashlib.sha256(text.encode()).hexdigest()))
                at = to
            yield _rows(out)

    def hashed(batches):
        key, running = None, None
        for batch in batches:
            out = []
            for k, _, text, _ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if running is not None:
                        out.append((key, None, None, running.hexdigest()))
                    key, running = k, hashlib.sha256()
                    running.update(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield _rows(out)
        if running is not None:
            yield _rows([(key, None, None, running.hexdigest())])

    def _rows(out):
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["key", "first", "text", "digest"])

    kind = "key binary, first long, text string, digest string"
    runs = stage(ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(joined, kind), "trie-ends")
    pieces = runs.where("text IS NOT NULL").repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, kind)
    return runs.where("text IS NULL").unionByName(pieces).select("key", "digest")


def conversation_trie(
    df: DataFrame, rebuild=as_they_are, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    width: int = SEGMENT_TURNS,
) -> DataFrame:
    """One row per different beginning of conversations: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`.

    A node of depth d is a sequence of d turns (role and text; null is empty); the root of depth 0 has no text. Its
    members are the conversations that begin with it, `conv_id` the smallest of them, `parent_conv_id` that of its parent.
    `n_leaves` counts childless nodes in its subtree, itself included; `saved_tokens` sums over the subtree a node's members
    less one, times the code points of its last text; `ends_sha256` is the SHA-256 of the conversations that end at it. Turns
    stand in order of turn (null first), then role, then a digest; repeated rows are turns like others; rows
    without conversation are left out. `rebuild` may change the conversations before. An empty table has no nodes.

    No step holds more of one conversation than `width` turns, of one group of equal conversations than a row per task, or
    of one node's children than a shard.
    """
    turns = ordered_turns(df, conv_id, turn, role, text)
    conversations = stage(turns.groupBy("c").agg(F.min("row").alias("first"), F.count("*").alias("n")), "trie-conversations")
    rebuilt, info = rebuild(turns, conversations)
    rows = _segments(rebuilt, width)
    empty = info.where("length = 0").select("c")
    distinct = rows.groupBy("root", "layer", "seq").agg(
        F.first("next").alias("next"), F.count("*").alias("n"), F.min("c").alias("least"), F.count_if("last").alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("c"))).alias("end_id"),
    )
    shards = distinct.repartitionByRange("root", "seq").sortWithinPartitions("root", "seq")
    nodes = stage(shards.mapInArrow(_pack_shards(width), _NODE), "trie-nodes")

    turnless = empty.agg(F.count("*").alias("n"), F.min("c").alias("c")).where("n > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("shared"),
        F.col("c").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n").alias("n_ends"),
        F.col("c").alias("end_id"), *[F.lit(0).cast("long").alias(x) for x in ("children", "leaves", "saved", "points")],
    )
    upper = nodes.where("shared").unionByName(turnless).groupBy("key").agg(
        *[F.max(x).alias(x) for x in ("parent", "depth", "points")], *[F.min(x).alias(x) for x in ("conv_id", "end_id")],
        *[F.sum(x).alias(x) for x in ("n_convs", "n_ends", "children", "leaves", "saved")],
    )
    upper = stage(upper, "trie-upper")
    below = upper.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    upper = upper.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    own = upper.select(
        "key", "parent", "depth", (F.col("leaves") + (F.col("children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("points")).alias("saved"),
    )
    upper = stage(upper.drop("leaves", "saved").join(_summed_up(own, ("leaves", "saved")), "key"), "trie-merged")

    known = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    names = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_ends", "end_id", "children", "leaves", "saved"]
    inner = nodes.where("NOT shared")
    whole = (
        inner.where("parent_conv_id IS NOT NULL").select(*names)
        .unionByName(inner.where("parent_conv_id IS NULL").drop("parent_conv_id").join(known, "parent").select(*names))
        .unionByName(upper.join(known, "parent", "left").select(*names))
    )
    full = F.octet_length("seq") == width * _SYMBOL
    end_key = F.when(full, F.col("next")).otherwise(F.unhex(F.md5(F.concat("root", "seq"))))
    ends = rows.where("last").select(end_key.alias("key"), "c").unionByName(empty.select(F.lit(ROOT).alias("key"), "c"))
    digests = _end_digests(ends)
    alone = F.sha2(F.coalesce(F.col("end_id").cast("string"), F.lit("")), 256)
    ended = whole.where("n_ends <= 1").withColumn("digest", alone).unionByName(whole.where("n_ends > 1").join(digests, "key"))
    return ended.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"),
    )
