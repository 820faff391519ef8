"""The conversation trie against nodes counted in dictionaries, and the double array against sets of beginnings."""

import hashlib
import random
import zlib

import compare
import numpy as np
import pytest

from veilframe.llm import conversation_trie as ct
from veilframe.llm.double_array import pack
from veilframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"

SCHEMA = "conv_id long, turn int, role string, text string"


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, f"{mark}{len(text):08X}", text))
    return {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in convs.items()}


def with_heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain(convs):
    """All nodes, by every conversation's beginnings."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, rows, **how):
    out = ct.conversation_trie(spark.createDataFrame(rows, SCHEMA), **how)
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2], *r[3:])
    return sorted(map(tuple, out.collect()), key=key)


def some_rows(rng, ids, longest, texts):
    rows = []
    for c in ids:
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


def test_against_dictionaries(spark):
    rng = random.Random(7)
    rows = some_rows(rng, [*range(0, 260, 2), 301, 302, 777], 8, ["a", "bb", "ünï 中😀", "", None])
    assert found(spark, rows, rebuild=ct.with_shared_heads) == plain(with_heads(ordered(rows)))
    assert found(spark, rows) == plain(ordered(rows))


def test_small_shards_and_long_conversations(spark, monkeypatch):
    """Shards of a few rows share most nodes; conversations of many rows hang below each other."""
    monkeypatch.setattr(ct, "SHARD_ROWS", 5)  # functions are sent by value, with this
    rng = random.Random(11)
    rows = some_rows(rng, range(60), 5, ["a", "b"]) + [(c, t, "u", "long" if t < 30 or c < 503 else f"{t % 3}") for c in range(500, 506) for t in range(20 + 7 * (c - 500))]
    rows += [(c, t, "u", "hot") for c in range(1000, 1300) for t in range(4)]
    for width in (1, 3, 4, 16):
        assert found(spark, rows, width=width) == plain(ordered(rows)), width


def test_odd_rows(spark):
    rows = [
        (None, 1, "u", "no conversation"), (3, None, "u", "first"), (3, 0, None, None), (3, 0, None, None), (3, 5, "u", "x" * 100_000),
        (3, 5, "a", "tie"), (-7, 0, "", ""), (9, 0, "1:", "u"), (10, 0, "1", ":u"), (2**62, 1, "u", "first"), (103, 9, "u", "only"),
    ]
    assert found(spark, rows, rebuild=ct.with_shared_heads) == plain(with_heads({c: t for c, t in ordered(rows).items()}))
    assert found(spark, rows) == plain(ordered(rows))
    clash = spark.createDataFrame([(1, 0, "u", "t", "x", b"k")], SCHEMA + ", symbol string, key binary")
    assert ct.conversation_trie(clash).count() == 2


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "u", "t")]) == []
    turnless = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0]
    rows = [(c, 0, "u", "gone") for c in turnless]
    assert found(spark, rows, rebuild=ct.with_shared_heads) == plain({c: [] for c in turnless})


@pytest.mark.parametrize("seed", range(20))
def test_double_array(seed):
    rng = random.Random(seed)
    seqs = sorted({tuple(rng.randint(1, rng.choice([2, 5, 40])) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 60))})
    codes, ends = np.array([c for s in seqs for c in s], np.int64), np.cumsum([len(s) for s in seqs]).astype(np.int64)
    trie, state = pack(codes, ends), {(): 0}
    for depth, (here, states) in enumerate(trie.levels(codes, ends), 1):
        for i, t in zip(here.tolist(), states.tolist(), strict=True):
            assert state.setdefault(seqs[i][:depth], t) == t > 0
    assert set(state) == {()} | {s[:d] for s in seqs for d in range(len(s) + 1)} and len(set(state.values())) == len(state)
    for p, t in state.items():
        for c in range(1, 45):
            assert trie.step(np.array([t]), np.array([c]))[0] == state.get((*p, c), -1)


def test_query_against_sql(spark):
    assert compare.compare(spark, compare.connect(SMALL), QUERIES["op11_conversation_trie"], SMALL) is None
