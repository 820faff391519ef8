import random

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import bpe_stream, token_counts
from veilframe.llm.bpe_prefix import byte_text, load_bpe, text_byte
from veilframe.llm.common import ByteMemory
from veilframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "B", "the ", " ", "  ", "\n", "\t", "'s", "'re", "'", "’", "é", "É", "é", "Σ", "ς", "中文", "語", "ا", "1", "23", "<|endoftext|>", "<|startoftext|>",
    "<", "|>", "!!", "\xa0", "　", "\x85", "\x1c", "\x0b", "😀", "İ", "ß", "ﬁ", "²", "Ⅷ", "​", "don't", "x" * 90, "\r\n", "ａ", " ", "\x00",
]


def random_texts(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randrange(14))) for _ in range(n)]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def test_counts_of_any_text(word):
    counter = token_counts.PrefixCounter(*load_bpe(WORD))
    for text in random_texts(1, 1500):
        data = text.encode()
        assert counter.total(data) == len(word.encode(text, add_special_tokens=False).ids), text
        ends, counts = counter.table(data)
        assert [len(word.encode(data[:e].decode(), add_special_tokens=False).ids) for e in ends.tolist()] == counts.tolist()


def test_longest_prefix_in_a_budget(word):
    counter, draw = token_counts.PrefixCounter(*load_bpe(WORD)), random.Random(2)
    for text in random_texts(3, 400):
        budget = draw.randrange(9)
        got = counter.fitting(text.encode(), budget)
        want = max(len(text[:n].encode()) for n in range(len(text) + 1) if len(word.encode(text[:n], add_special_tokens=False).ids) <= budget)
        # White space has no tokens, so how much of it follows the last word does not matter.
        assert text.encode()[min(got, want) : max(got, want)].decode().strip() == "", (text, budget)


def test_every_prefix_of_a_word(word):
    bpe, _ = load_bpe(WORD)
    for text in ("internationalization", "thhahaering", "x" * 40, "onwhstandereation"):
        assert bpe.prefix_counts(byte_text(text.encode()))[1:] == [len(word.encode(text[:n], add_special_tokens=False).ids) for n in range(1, len(text) + 1)]


def test_encoding_of_any_text(byte):
    both, draw = bpe_stream.Transducer(*load_bpe(BYTE)), random.Random(4)
    for text in random_texts(5, 1500):
        want = byte.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(both.encode(text), "<u4").tolist() == want, text
        cuts = sorted(draw.randrange(len(text) + 1) for _ in range(3))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert np.frombuffer(b"".join(both.stream(chunks)), "<u4").tolist() == want, chunks
        assert "".join(both.decode(want)) == byte.decode(want, skip_special_tokens=False) == text


def test_stream_of_one_long_piece(byte):
    bpe, draw = load_bpe(BYTE)[0], random.Random(6)
    text = "".join(draw.choice(["ing", "tion", "an", "the", "x", "qu", "Â", "e"]) for _ in range(4000))
    ahead = iter(byte_text(text.encode()))
    taken = []
    first = next(bpe.stream(c for c in ahead if taken.append(c) is None))
    assert len(taken) <= 8 * bpe.longest < len(text)  # tokens come before the piece has ended
    want = byte.encode(text, add_special_tokens=False).ids
    assert first == want[0] and list(bpe.stream(iter(byte_text(text.encode())))) == want == bpe.encode(byte_text(text.encode()))


@pytest.mark.parametrize("seed", range(6))
def test_long_pieces_in_chunks(byte, seed, monkeypatch):
    """Pieces of all kinds that are passed on unfinished, with special strings and white space where they end."""
    monkeypatch.setattr(bpe_stream, "OPEN", 20)
    both, draw = bpe_stream.Transducer(*load_bpe(BYTE)), random.Random(seed)
    for _ in range(150):
        text = "".join(draw.choice(["a", "é", "7", "!", "<", "<|", " ", "\n", "\u3000", "'", "中"]) * draw.randrange(1, 90)
                       + draw.choice(["", "<|endoftext|>", "'s", " x", "<|endof", "a1b2c3" * 9]) for _ in range(4))
        want = byte.encode(text, add_special_tokens=False).ids
        for size in (1, 7, 33, 1000):
            chunks = [text[i : i + size] for i in range(0, len(text), size)]
            assert np.frombuffer(b"".join(both.stream(chunks)), "<u4").tolist() == want, (size, text)


@pytest.mark.parametrize("text", ["word and " * 400_000, "ab" * 1_000_000, "a1" * 1_000_000, " " * 1_000_000 + "x", "-" * 1_000_000])
def test_tokens_leave_before_the_text_ends(byte, text):
    both, read, held = bpe_stream.Transducer(*load_bpe(BYTE)), 0, 0
    bpe_bytes = []

    def chunks():
        nonlocal read
        for i in range(0, len(text), 4096):
            read = i
            yield text[i : i + 4096]

    for block in both.stream(chunks()):
        bpe_bytes.append(block)
        if len(bpe_bytes) == 1:
            held = read
    assert held <= 150_000 < len(text) // 5  # a block of 1,024 tokens, each up to 128 characters long
    ids = np.frombuffer(b"".join(bpe_bytes), "<u4").tolist()
    assert "".join(both.decode(ids)) == text
    assert ids[: 2000] == byte.encode(text[:300_000], add_special_tokens=False).ids[:2000]


def test_memories_are_bounded_by_bytes():
    memory = ByteMemory(lambda key: key.encode() * 2, 20_000, 50)
    for i in range(5000):
        key = "k" * (i % 60) + str(i)
        assert memory[key] == key.encode() * 2
        size = sum(len(k) + len(v) + 100 for part in (memory, memory.older) for k, v in part.items())
        assert size < 20_000 and all(len(k) <= 50 for k in memory)


def test_broken_bytes_decode_to_marks():
    both = bpe_stream.Transducer(*load_bpe(BYTE))
    half = [i for i, t in both.token_bytes.items() if t == "é".encode()[:1]][:1]
    assert "".join(both.decode(half)) == "�"
    assert text_byte(byte_text(bytes(range(256)))) == bytes(range(256))


def test_count_query(spark, documents, word):
    want = {i: (len((t or "").encode()), len(word.encode(t or "", add_special_tokens=False).ids)) for i, t in documents}
    rows = QUERIES["op7_token_counts"].run(spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    texts = dict(documents)
    for r in rows:
        fits = texts[r.doc_id].encode()[: r.fitting_bytes].decode()
        assert len(word.encode(fits, add_special_tokens=False).ids) <= 2048 and (r.over_limit or fits == texts[r.doc_id])


def test_roundtrip_query(spark, documents, byte):
    want = {}
    for i, t in documents:
        ids = byte.encode(t or "", add_special_tokens=False).ids
        want[i] = len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(byte.decode(ids, skip_special_tokens=False).encode())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_bpe_roundtrip"].run(spark, SMALL).collect()} == want


def test_odd_rows(spark, odd, none, word):
    counts = token_counts.counts_and_fit(F.col("text"), WORD, 5)
    rows = odd.select("text", counts.alias("c"), token_counts.token_count(F.col("text"), WORD).alias("n"), token_counts.fitting_bytes(F.col("text"), WORD, 5).alias("f"),
                      token_counts.prefix_table(F.col("text"), WORD).alias("t"), bpe_stream.encode_text(F.col("text"), BYTE).alias("ids"))
    for r in rows.withColumn("back", bpe_stream.decode_tokens(F.col("ids"), BYTE)).collect():
        n = len(word.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.c.n_tokens, r.c.fitting_bytes) == (r.n, r.f) and r.n == n == (r.t.counts[-1] if r.t.counts else 0)
        assert r.back == (r.text or "")
    assert none.select(counts.alias("c"), bpe_stream.roundtrip_digests(F.col("text"), BYTE).alias("d")).count() == 0
