"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest-prefix match through the model's compiled character map (a double-array trie
over UTF-8 bytes, with replacement strings), recording for every normalised byte the source byte it stems from;
then white space is escaped and the model's dummy prefix is put in front, as the model says. The library
encodes; every piece is projected through the alignment to a byte span of the original text. A text's pieces must
spell its normalised bytes exactly, else an error is raised; so no span is off. Without a character map, alignment is
the same for every character and is made by numpy.

For models whose pieces never hold the space mark after another character, nor a line feed, no merge crosses
such a place. Then a text is cut there into words, each distinct word is encoded once by the library and kept in
a bounded memo, and the ids of a text are the ids of its words in order: exactly what the library gives for the
whole, at a fraction of the cost. Other models are encoded text by text.

Defined results: null is the empty text; it has the begin and end ids alone. Every byte of the original belongs
to the span of some piece, unless normalisation removes it. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import sentencepiece

MARK = "▁"
#: How many distinct words a worker remembers, beside as many older ones, and the most characters of such a word.
MEMO_WORDS, LONGEST = 40_000, 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Normalizer:
    """What a model's normalizer_spec asks for, with source alignment."""

    def __init__(self, spec: bytes):
        charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in fields(spec):
            if number == 2:
                charsmap = value
            elif number == 3:
                self.dummy_prefix = bool(value)
            elif number == 4:
                self.squeeze = bool(value)
            elif number == 5:
                self.escape = bool(value)
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if charsmap:
            n = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{n // 4}I", charsmap, 4)
            self.strings = charsmap[4 + n :]
        self.identity = not self.units and not self.squeeze

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """Length and replacement's place of the longest key of the trie that starts here."""
        units, found = self.units, None
        node = 0
        base = units[0]
        node = (base >> 10) << ((base & 512) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def normalize(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, without the dummy prefix's alignment shift: align[i] is the source byte of normalised
        byte i, and align[-1] the end of what was kept."""
        data = text.encode("utf-8", "replace")
        mark = MARK.encode() if self.escape else b" "
        out, align = bytearray(), []

        def put(piece: bytes, at: int) -> None:
            for byte in piece:
                for b in mark if byte == 32 else (byte,):
                    out.append(b)
                    align.append(at)

        steps: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            hit = self.longest(data, at) if self.units else None
            if hit:
                n, where = hit
                piece = self.strings[where : self.strings.index(b"\0", where)]
            else:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                piece = data[at : at + n]
            steps.append((piece, at, n))
            at += n
        end = len(data)
        if self.squeeze:
            while steps and steps[0][0] in (b" ", b""):
                steps.pop(0)
        if not steps:
            return b"", [0 if self.squeeze else end]
        if self.dummy_prefix:
            put(b" ", steps[0][1])
        blank = self.squeeze
        for piece, at, n in steps:
            if self.squeeze and blank:
                piece = piece.lstrip(b" ")
            put(piece, at)
            if piece:
                blank = self.squeeze and piece.endswith(b" ")
                end = at + n
        if self.squeeze:
            while out.endswith(mark) and out:
                end = align[-len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        return bytes(out), [*align, end]


    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """What normalize gives, the alignment as an array."""
        if not self.identity:
            out, align = self.normalize(text)
            return out, np.array(align, np.int32)
        data = text.encode("utf-8", "replace")
        if not data:
            return b"", np.zeros(1, np.int32)
        mark = MARK.encode() if self.escape else b" "
        head = mark if self.dummy_prefix else b""
        source = np.frombuffer(data, np.uint8)
        starts = np.arange(len(data), dtype=np.int32)
        if not data.isascii():  # every byte of a character stems from where it begins
            starts = np.maximum.accumulate(np.where(source & 0xC0 == 0x80, 0, starts))
        align = np.repeat(starts, np.where(source == 32, len(mark), 1))
        return head + data.replace(b" ", mark), np.concatenate([np.zeros(len(head), np.int32), align, [len(data)]], dtype=np.int32)


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = b""
        pieces, user_defined = [], False
        for number, value in fields(model):
            if number == 3:
                spec = value
            elif number == 1:
                parts = dict(fields(value))
                pieces.append(parts.get(1, b"").decode("utf-8", "replace"))
                user_defined |= parts.get(3, 1) == 4
        self.normalizer = Normalizer(spec)
        crossing = any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.by_word = self.normalizer.identity and self.normalizer.dummy_prefix and self.normalizer.escape and not crossing and not user_defined
        self.by_word &= self.library.piece_to_id("<0x0A>") != self.library.unk_id()
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.begin, self.end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        self.feed = struct.pack("<I", self.library.piece_to_id("<0x0A>"))
        #: What each piece stands for in normalised text, and of how many bytes it is.
        self.surfaces = [bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.surfaces], np.int64)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of words: a word w stands for mark + w, and a line feed + w for w without a mark, between which
        and the line feed nothing merges. Those of bounded length go to the memo as well; a full memo becomes the older
        one, which is searched once more before it goes."""
        out, new = {}, []
        for w in missing:
            found = self.older.get(w)
            if found is None:
                new.append(w)
            else:
                out[w] = found
        for w, ids in zip(new, self.library.encode(new, num_threads=1) if new else [], strict=True):
            if w[:1] == "\n":  # the dummy prefix and the line feed go
                ids = ids[2:]
            elif not w:
                ids = [self.library.piece_to_id(MARK)]
            out[w] = struct.pack(f"<{len(ids)}I", *ids)
        short = {w: ids for w, ids in out.items() if len(w) <= LONGEST}
        if len(short) <= MEMO_WORDS:
            if len(self.words) + len(short) > MEMO_WORDS:  # what this call still needs of the older words is in out
                out |= self.words
                self.older, self.words = self.words, {}
            self.words.update(short)
        return out

    def forget(self) -> None:
        """Release the memo; called at the end of a partition, as workers are used again."""
        self.words, self.older = {}, {}

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """For each text all its ids, begin and end included, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = []
        cut: list[list[str]] = []
        for text in texts:
            if not self.by_word or MARK in text or "  " in text or text[:1] in ("", " ") or text[-1] == " ":
                ids = self.library.encode(text)
                out.append(struct.pack(f"<{len(ids) + 2}I", self.bos, *ids, self.eos))
            else:
                out.append(None)
                cut.append(text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" "))
        once = self._learn({w for words in cut for w in words if w not in self.words})
        known, feed = self.words, self.feed
        at = iter(cut)
        for i, found in enumerate(out):
            if found is None:
                parts = [self.begin]
                for w in next(at):
                    ids = known.get(w)
                    if ids is None:
                        ids = once[w]
                    parts.append(feed + ids if w[:1] == "\n" else ids)
                out[i] = b"".join([*parts, self.end])
        return out

    def packed(self, text: str) -> bytes:
        return self.packed_all([text])[0]

    def ids(self, text: str) -> list[int]:
        data = self.packed(text)
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def spans(self, text: str) -> list[tuple[int, str, int, int]]:
        """``(id, piece, begin, end)`` of each piece between the begin and end ids; begin and end are bytes of the original."""
        normalized, align = self.normalizer.normalize(text)
        out, at = [], 0
        for i in self.ids(text)[1:-1]:
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                n = 1
            elif self.library.is_unknown(i):
                # An unknown piece stands for all characters up to the next known one.
                n = self._unknown_length(normalized, at)
            else:
                n = len(piece.encode())
            out.append((i, piece, align[at], align[at + n]))
            at += n
        return out

    def located_all(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text its packed ids, and the begin and end bytes of each piece between the begin and end ids."""
        unknown = self.library.unk_id()
        for text, packed in zip(texts, self.packed_all(texts), strict=True):
            ids = np.frombuffer(packed, "<u4")[1:-1]
            if (ids == unknown).any():
                spans = np.array([x[2:] for x in self.spans(text)], np.int32)
                yield packed, spans[:, 0], spans[:, 1]
                continue
            normalized, align = self.normalizer.aligned(text)
            surfaces = self.surfaces
            if b"".join([surfaces[i] for i in ids.tolist()]) != normalized:
                raise ValueError("the pieces of a text don't spell its normalised bytes")
            at = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.lengths[ids], out=at[1:])
            own = align[at]
            yield packed, own[:-1], own[1:]

    def covered(self, text: str, begins: np.ndarray, ends: np.ndarray) -> None:
        """Raise an error unless the spans follow one another from the text's first byte to its last. Only for models whose
        normalisation removes nothing."""
        if self.normalizer.identity and text:
            size = len(text) if text.isascii() else len(text.encode("utf-8", "replace"))
            if not len(begins) or begins[0] or ends[-1] != size or (begins[1:] != ends[:-1]).any():
                raise ValueError("the spans of a text's pieces don't cover it")

    def _unknown_length(self, data: bytes, at: int) -> int:
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        known = {self.library.id_to_piece(i) for i in range(len(self.library))} if not hasattr(self, "_known") else self._known
        self._known = known
        while at + n < len(data):
            first = data[at + n]
            m = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            if data[at + n : at + n + m].decode() in known:
                break
            n += m
        return n

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def decoded(self, text: str, packed: bytes) -> str:
        """What the library's decode gives for the ids of a text, which are all that it is given."""
        return self.decode(np.frombuffer(packed, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def digests(docs, model: bytes, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, from ids whose spans were made and found to cover the text and
    from what the library decodes them to. The model (some hundred KB) travels with the task."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        own = codec(model)
        for batch in batches:
            n, first, second = [], [], []
            for k in range(0, batch.num_rows, 256):
                texts = [text or "" for text in batch.column(1).slice(k, 256).to_pylist()]
                for text, (packed, begins, ends) in zip(texts, own.located_all(texts), strict=True):
                    own.covered(text, begins, ends)
                    n.append(len(packed) // 4)
                    first.append(hashlib.sha256(packed).hexdigest())
                    second.append(hashlib.sha256(own.decoded(text, packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encoded(docs, model: bytes, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: id, tokens as an array of ids, and the begin and end bytes of each piece between the begin and end ids."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    schema = f"id {dict(docs.dtypes)[id_col]}, tokens array<int>, begins array<int>, ends array<int>"

    def run(batches):
        own = codec(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                tokens, begins, ends = [], [], []
                for packed, begin, end in own.located_all([text or "" for text in part.column(1).to_pylist()]):
                    tokens.append(np.frombuffer(packed, "<i4"))
                    begins.append(begin)
                    ends.append(end)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (tokens, begins, ends))], names=["id", "tokens", "begins", "ends"])
        own.forget()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
