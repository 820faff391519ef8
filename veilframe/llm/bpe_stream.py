"""Byte-level BPE as a streaming transducer, and the way back from tokens to text as a state machine.

Encoding: the text is cut into pieces by the vocabulary's pattern; the tokens of a piece come out as soon as no later symbol
can change them. How far one must look ahead follows from the merge list alone: a token is at most `longest` symbols
long, so the encodings of the last `longest` prefixes are all that can go on (`PrefixBPE.stream`). All pieces take that
way; what short ones gave is remembered in a bounded number of bytes. A text is read in chunks, and no piece is held whole.

Decoding: tokens give bytes; a UTF-8 state machine gives out characters once they are complete and holds back at most three
bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.llm.bpe_prefix import PrefixBPE, byte_text, load_bpe, text_byte
from veilframe.llm.common import ByteMemory, kept

#: What a worker remembers of short words and pieces, and of pairs of tokens (about 100 bytes each).
WORD_BYTES, PIECE_BYTES, PAIRS = 80 << 20, 8 << 20, 350_000
#: Rows of a batch that are held as Python texts at a time.
ROWS = 256
SHORT = 64
#: Characters read at a time, and the length from which an unfinished piece is passed on symbol by symbol.
CHUNK, OPEN = 1 << 16, 1 << 12
#: Fixed value: how byte-level vocabularies of this family cut a text into pieces.
_WIDE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = r"\t-\r " + _WIDE
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)


#: White space other than a blank and a line break, and blanks and breaks that stand together.
_ODD = (*"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "  ", "\n\n", " \n", "\n ")


def _regular(text: str) -> bool:
    """Whether all white space of a text is single blanks and line breaks before words."""
    return bool(text) and text[-1] not in " \n" and not any(x in text for x in _ODD)


#: The runs that pieces are made of, by the kind of their last character.
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[{_WHITE}]+", rf"[^{_WHITE}\p{{L}}\p{{N}}]+")]
_WHITE_RUN = _RUNS[2]
#: White space after something else: a piece ends before it, whatever else follows.
_CUT = regex.compile(rf"(?r)(?<=[^{_WHITE}])[{_WHITE}]")


def _blocks(ids: Iterable[int]) -> Iterator[bytes]:
    """Tokens as little-endian 32-bit numbers, 1024 at a time."""
    ids = iter(ids)
    while some := list(islice(ids, 1024)):
        yield np.array(some, "<u4").tobytes()


class Transducer:
    """Text to tokens, a text at a time or in chunks."""

    def __init__(self, bpe: PrefixBPE, special: dict[str, int]):
        self.bpe, self.special = bpe, special
        self.bpe.most_suits = PAIRS
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.margin = max([3, *(len(s) for s in special)]) + 1
        self.piece = ByteMemory(self._piece, PIECE_BYTES, SHORT)
        self.first = ByteMemory(self._word, PIECE_BYTES // 4, SHORT)
        self.later = ByteMemory(lambda word: self._word(" " + word), WORD_BYTES, SHORT)
        self.begun = self._beginnings(bpe.inner)
        self.token_bytes = {i: text_byte(t) for i, t in bpe.text.items()} | {i: s.encode() for s, i in special.items()}

    @property
    def lookahead(self) -> int:
        """Symbols after which a prefix's encodings that can still go on are known, from the merge list."""
        return self.bpe.longest

    @staticmethod
    def _beginnings(tokens: dict[str, int]) -> dict:
        """Per character the token that ends with it (None: none does) and what can follow, from the first character on."""
        root: dict = {}
        leaf: dict = {}
        for text, token in sorted(tokens.items()):  # a beginning comes before what goes on from it
            node, before, at = root, None, ""
            for c in text[:-1]:
                before, at = node, c
                _, node = node.setdefault(c, (None, {}))
                if node is leaf:
                    node = {}
                    before[at] = (before[at][0], node)
            node[text[-1]] = (token, leaf)
        return root

    def _window(self, shown: str) -> list[int]:
        """Tokens of a piece that ends inside the lookahead, where all that can follow is known.

        The longest token that suits the one before it is tried first. The token before a place is the same in every way
        to get there, since a prefix has one encoding; so a place from which nothing goes on is closed for good.
        """
        n, suits, begun = len(shown), self.bpe.suits, self.begun
        whole = self.bpe.inner.get(shown)
        if whole is not None:
            return [whole]
        path, closed, at, left, open_ends = [], set(), 0, -1, []
        while at < n:
            if len(open_ends) == len(path):
                ends, node, i = [], begun, at
                while i < n and (hit := node.get(shown[i])) is not None:
                    i += 1
                    token, node = hit
                    if token is not None:
                        ends.append((token, i))
                open_ends.append(ends)
            ends = open_ends[-1]
            while ends:
                token, end = ends.pop()
                if end in closed:
                    continue
                if left >= 0:
                    good = suits.get((left << 32) | token)
                    if not (self.bpe.suit(left, token) if good is None else good):
                        continue
                path.append((left, at))
                left, at = token, end
                break
            else:
                if not path:
                    raise ValueError(f"the vocabulary has no tokens for {shown!r}")
                closed.add(at)
                open_ends.pop()
                left, at = path.pop()
        return [token for token, _ in path[1:]] + [left] if path else []

    def _piece(self, piece: str) -> bytes:
        """Tokens of a piece, as they leave the window."""
        shown = byte_text(piece.encode())
        if len(shown) <= min(SHORT, self.lookahead):
            ids = self._window(shown)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(_blocks(self.bpe.stream(shown)))

    def _word(self, word: str) -> bytes:
        pieces = _PIECE.findall(word)
        if len(pieces) == 1 and word[0] == " " < word:  # remembered as the word behind the blank
            return self._piece(word)
        return b"".join(self._met(pieces))

    def _met(self, pieces: list[str]) -> Iterator[bytes]:
        """Tokens of pieces, those that begin with a blank as words."""
        return (self.later[p[1:]] if p[0] == " " < p else self.piece[p] for p in pieces)

    def _plain(self, text: str) -> Iterable[bytes]:
        """Tokens of the pieces of a text without special strings.

        Where words are set apart by one blank or one line break, the pattern never joins what a blank or a break
        separates: a blank belongs to the word after it, a break is a piece of its own.
        """
        if not _regular(text):
            return self._met(_PIECE.findall(text))
        out, first, later, broken = [], self.first, self.later, self.piece["\n"]
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            out += map(later.__getitem__, words[1:])
            out.append(broken)
        return out[:-1]

    def _closed(self, text: str) -> bytes:
        """Tokens of text that ends where a piece ends. Special strings in it are their own tokens."""
        if self.cut is None or "<" not in text:
            return b"".join(self._plain(text))
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(self.special[found.group()].to_bytes(4, "little"))
            at = found.end()
        return b"".join([*out, *self._plain(text[at:])])

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Tokens of a text that comes in chunks, as little-endian 32-bit numbers, each as soon as it is stable.

        Text up to the last white space after a word is final, or else all pieces that no later text can change. What is
        held back is one open piece; a piece longer than `OPEN` goes symbol by symbol through the window of the merge list
        and is not held.
        """
        chunks, held = iter(chunks), ""
        for chunk in chunks:
            held += chunk
            if found := _CUT.search(held):
                yield self._closed(held[: found.start()])
                held = held[found.start() :]
            if len(held) > OPEN + self.margin and (ready := self._final_length(held)):
                yield self._closed(held[:ready])
                held = held[ready:]
            if len(held) > OPEN + self.margin:
                held = yield from self._long_piece(held, chunks)
        if held:
            yield self._closed(held)

    def encode(self, text: str) -> bytes:
        """Tokens of a whole text, streamed."""
        return b"".join(self.stream(_chunks(text)))

    def _final_length(self, text: str) -> int:
        """Length of the beginning of `text` that ends with a piece no later text can change."""
        limit, ready, at = len(text) - self.margin, 0, 0
        if limit <= 0:
            return 0
        spans = list(self.cut.finditer(text)) if self.cut is not None else []
        for found in [*spans, None]:
            stop = found.start() if found else len(text)
            for m in _PIECE.finditer(text, at, stop):
                if m.end() > limit:
                    return ready
                if not m.group().isspace():  # white space may be cut otherwise by what follows
                    ready = m.end()
            if found is None or found.end() > limit:
                return ready
            ready = at = found.end()
        return ready

    def _long_piece(self, text: str, chunks: Iterator[str]) -> Iterator[bytes]:
        """Tokens of the piece that begins `text` and goes on behind it; returns the text after the piece.

        As much is held back as a special string may need to show itself. Of white space before a word the last character
        belongs to what follows.
        """
        rest, begun = "", _PIECE.match(text).end()
        run = next(r for r in _RUNS if r.match(text, begun - 1))

        def symbols() -> Iterator[str]:
            nonlocal rest
            ahead, at, over = text, begun - 1, False
            while True:
                found = run.match(ahead, at)
                end = found.end() if found else at
                special = self.cut.search(ahead, 0, end + self.margin) if self.cut is not None else None
                if special and special.start() <= end:
                    end = special.start()
                elif run is _WHITE_RUN and 0 < end < len(ahead):
                    end -= 1
                if over or end < len(ahead) - self.margin:
                    rest = ahead[end:]
                    yield from byte_text(ahead[:end].encode())
                    return
                ready = max(0, len(ahead) - self.margin - 1)
                yield from byte_text(ahead[:ready].encode())
                more = next(chunks, None)
                ahead, at, over = ahead[ready:] + (more or ""), 0, more is None

        yield from _blocks(self.bpe.stream(symbols()))
        return rest

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of tokens, what is complete after every 1024 of them; broken UTF-8 gives U+FFFD."""
        machine = Decoder(self.token_bytes)
        for block in _blocks(ids):
            if shown := machine.feed(block):
                yield shown
        if shown := machine.finish():
            yield shown


class Decoder:
    """Tokens to text, a block at a time. It holds back the bytes of one unfinished character, three at most."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes, self.state = token_bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, block: bytes) -> str:
        """The text that little-endian 32-bit tokens complete; broken UTF-8 gives U+FFFD."""
        return self.state.decode(b"".join(map(self.token_bytes.__getitem__, np.frombuffer(block, "<u4").tolist())))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def _chunks(text: str) -> Iterable[str]:
    return (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))


def _in_slices(texts: pa.Array, make: Callable[[list], pa.Array]) -> pa.Array:
    """`make` over some rows at a time."""
    return pa.concat_arrays([make(texts.slice(i, ROWS).to_pylist()) for i in range(0, max(1, len(texts)), ROWS)])


def _transducer(path: str) -> Transducer:
    return kept(("transducer", path), lambda: Transducer(*load_bpe(path)), "tokens")


def encode_text(text: Column, path: str) -> Column:
    """Tokens of a whole text (null: none) as binary, little-endian unsigned 32-bit numbers."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        one = _transducer(path).encode
        return pa.array([one(t) if t else b"" for t in texts.to_pylist()], pa.binary())

    return encode(F.coalesce(text, F.lit("")))


def encode_and_check(text: Column, path: str) -> Column:
    """struct<tokens: binary, roundtrip: boolean>: tokens as `encode_text` gives them, and whether they decode to the text."""

    @F.arrow_udf("struct<tokens: binary, roundtrip: boolean>")
    def encode(texts: pa.Array) -> pa.Array:
        both = _transducer(path)

        def some(rows: list) -> pa.Array:
            tokens, same = [], []
            for text in rows:
                text, out, at, good, machine = text or "", [], 0, True, Decoder(both.token_bytes)
                for block in both.stream(_chunks(text)):
                    out.append(block)
                    shown = machine.feed(block)
                    good, at = good and text.startswith(shown, at), at + len(shown)
                tokens.append(b"".join(out))
                same.append(good and at == len(text) and not machine.finish())
            return pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(same, pa.bool_())], ["tokens", "roundtrip"])

        return _in_slices(texts, some)

    return encode(F.coalesce(text, F.lit("")))


def decode_tokens(tokens: Column, path: str) -> Column:
    """The text of binary tokens as `encode_text` gives them (null: empty)."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        one = _transducer(path).decode
        return pa.array(["".join(one(np.frombuffer(t or b"", "<u4").tolist())) for t in rows.to_pylist()], pa.string())

    return decode(tokens)


def roundtrip_digests(text: Column, path: str) -> Column:
    """struct<n_tokens: long, ids_sha256: string, decoded_sha256: string> of encoding a text and decoding its tokens."""

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digests(texts: pa.Array) -> pa.Array:
        both = _transducer(path)

        def some(rows: list) -> pa.Array:
            n, a, b = [], [], []
            for text in rows:
                count, ids, back, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(both.token_bytes)
                for block in both.stream(_chunks(text or "")):
                    ids.update(block)
                    count += len(block) // 4
                    back.update(machine.feed(block).encode())
                back.update(machine.finish().encode())
                n.append(count)
                a.append(ids.hexdigest())
                b.append(back.hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

        return _in_slices(texts, some)

    return digests(F.coalesce(text, F.lit("")))
