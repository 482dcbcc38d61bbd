"""Offset-preserving encoding and decoding with a SentencePiece BPE model.

The model file is read here: pieces, scores, and the normaliser with its
compiled character map, a double-array trie over UTF-8 bytes followed by
replacement strings. Normalisation replaces the longest prefix that the trie
holds, or takes over one character, and records for every normalised character
the byte of the source where it came from. Each piece is then projected back
to a span of source bytes: spans of consecutive pieces join without gaps.

Encoding: pieces never span a blank that follows a non-blank, so the
normalised text falls into chunks that are encoded alone and remembered. The
merging within a chunk (best score first, then leftmost) is a rank merge over
bytes; runs of blanks, whose pieces have equal scores, are merged here.
Characters outside the vocabulary become byte pieces; the last of them carries
the character's span.

Defined results: a null text is the empty text, with no pieces and an empty
decoded text; a very long text is encoded whole by one task, chunk by chunk; rows
are independent, so repeated rows and rows of one or no id are encoded alike, each
giving one row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_text, table

BLANK = "▁"
#: Chunks remembered per Python worker.
REMEMBERED = 400_000
# Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else _varint(b, i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class CharacterMap:
    """Longest-prefix replacement through a compiled character map."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0]
        self.units = struct.unpack(f"<{size // 4}I", compiled[4 : 4 + size])
        self.strings = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, str] | None:
        """(bytes matched, their replacement) of the longest entry at ``at``."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end].decode()


class PieceModel:
    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for field, v in _fields(data):
            if field == 1:
                d = dict(_fields(v))
                self.pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(v))
            elif field == 3:
                norm = dict(_fields(v))
        self.map = CharacterMap(norm[2]) if norm.get(2) else None
        self.prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        self._chunks: dict | None = None
        self.merges = bool(self.pieces)
        if self.merges and not (trainer.get(3, 1) == 2 and trainer.get(35, 0) and not trainer.get(24, 0)):
            raise ValueError("only BPE models with byte pieces and leading blanks are supported")
        if self.merges:
            self._prepare()

    def _prepare(self) -> None:
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif kind in (NORMAL, USER_DEFINED, UNUSED):
                if kind != NORMAL:
                    raise ValueError("user-defined and unused pieces are not supported")
                self.ids[piece], self.scores[piece] = i, score
        self.lone_newline = not any("\n" in p for p in self.ids)
        # ranks of byte strings: single bytes, then what leads to a character, characters, longer pieces by score
        order = [bytes([b]) for b in range(256)]
        chars = [p for p in self.ids if len(p) == 1 and len(p.encode()) > 1]
        order += list(dict.fromkeys(c.encode()[:k] for c in chars for k in range(2, len(c.encode()))))
        self.first_whole = len(order)
        order += [c.encode() for c in chars]
        order += [p.encode() for p in sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.scores[p], self.ids[p]))]
        self.ranked = {b: r for r, b in enumerate(dict.fromkeys(order))}
        self.by_rank = list(self.ranked)
        self.piece_of = [self.ids.get(b.decode("utf-8", "ignore")) if r >= self.first_whole or b < b"\x80" else None for r, b in enumerate(self.by_rank)]
        self.lengths = [len(b.decode("utf-8", "ignore")) for b in self.by_rank]
        self.id_text = [None if i is None else str(i) for i in self.piece_of]
        self.text_of = [None if i is None else self.surface([i]) for i in self.piece_of]
        self.core = tiktoken.Encoding("pieces", pat_str=".+", mergeable_ranks=self.ranked, special_tokens={})._core_bpe

    # -- normalisation -------------------------------------------------

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and each of its characters' source byte (and the end)."""
        blank = BLANK if self.escape else " "
        if self.map is None and not self.squeeze:
            cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            ends = np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
            if not text:
                return "", np.zeros(1, dtype=np.int64)
            starts = np.concatenate([[0, 0] if self.prefix else [0], ends])
            return (blank if self.prefix else "") + (text.replace(" ", blank) if self.escape else text), starts.astype(np.int64)
        source = text.encode()
        out: list[str] = []
        at: list[int] = []
        i = 0

        def step(i: int) -> tuple[int, str]:
            hit = self.map.longest(source, i) if self.map else None
            if hit:
                return hit
            n = 1 if source[i] < 0x80 else 2 if source[i] < 0xE0 else 3 if source[i] < 0xF0 else 4
            return n, source[i : i + n].decode()

        if self.squeeze:
            while i < len(source):
                n, s = step(i)
                if s != " ":
                    break
                i += n
        if i == len(source):
            return "", np.asarray([0 if not source else i])
        if self.prefix:
            out.append(" ")
            at.append(i)
        after_blank = self.squeeze
        while i < len(source):
            n, s = step(i)
            if after_blank:
                s = s.lstrip(" ")
            if s:
                out.extend(s)
                at.extend([i] * len(s))
                after_blank = s.endswith(" ")
            if not self.squeeze:
                after_blank = False
            i += n
        if self.squeeze:
            while out and out[-1] in (" ", blank):
                out.pop()
                i = at.pop()
        at.append(i)
        joined = "".join(out)
        return joined.replace(" ", blank) if self.escape else joined, np.asarray(at)

    # -- encoding ------------------------------------------------------

    def _merge(self, chunk: str) -> list[str]:
        """Best score first, then leftmost; for chunks with runs of blanks."""
        parts: list[str | None] = list(chunk)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.scores:
                    heapq.heappush(heap, (-self.scores[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _spell(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """Ids and lengths in characters; unknown characters as bytes, the last of which has the length."""
        ids: list[int] = []
        lengths: list[int] = []
        for p in parts:
            if p in self.ids:
                ids.append(self.ids[p])
                lengths.append(len(p))
            else:
                for c in p:
                    raw = c.encode()
                    ids.extend(self.byte_ids[b] for b in raw)
                    lengths.extend([0] * (len(raw) - 1) + [1])
        return ids, lengths

    def chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        if BLANK + BLANK in chunk:
            return self._spell(self._merge(chunk))
        ranks = self.core.encode_single_piece(chunk.encode())
        ids = [self.piece_of[r] for r in ranks]
        if None not in ids:
            return ids, [self.lengths[r] for r in ranks]
        parts, held = [], b""
        for r in ranks:  # bytes of unknown characters come together again
            if self.piece_of[r] is None:
                held += self.by_rank[r]
            else:
                if held:
                    parts.append(held.decode())
                    held = b""
                parts.append(self.by_rank[r].decode())
        if held:
            parts.append(held.decode())
        return self._spell(parts)

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the first and end source byte of each piece."""
        norm, at = self.normalize(text)
        ids: list[int] = []
        lengths: list[int] = []
        for c in re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", norm):
            a, b = self.chunk(c)
            ids += a
            lengths += b
        ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
        stop = at[ends] if len(ends) else np.zeros(0, dtype=np.int64)
        start = at[ends - np.asarray(lengths, dtype=np.int64)] if len(ends) else stop
        return ids, start, stop

    # -- decoding ------------------------------------------------------

    def surface(self, ids: list[int]) -> str:
        """The pieces' text, blanks still marked, bytes joined to characters."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append("" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else piece.replace(BLANK, " "))
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((self.pieces[i] for i in ids if self.pieces[i][2] != CONTROL), None)
        if self.prefix and first and first[2] == NORMAL and first[0].startswith(BLANK):
            text = text[1:]
        return text


def _utf8(raw: bytes) -> str:
    """Well-formed characters; every other byte is one replacement character."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if 0xC2 <= raw[i] < 0xE0 else 3 if 0xE0 <= raw[i] < 0xF0 else 4 if raw[i] < 0xF5 else 1
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


class _Remembered(dict):
    """Word -> (ids as text, lengths as bytes, decoded); a word after a newline begins with NUL."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[str, bytes, str]:
        m = self.model
        if word[:1] == "\0":
            ids, lengths = m.chunk("\n")
            ids, lengths = list(ids), list(lengths)
            if len(word) > 1:
                a, b = m.chunk(word[1:])
                ids += a
                lengths += b
        else:
            if word:
                ranks = m.core.encode_single_piece((BLANK + word).encode())
                try:  # only whole pieces, as nearly always
                    out = (",".join([m.id_text[r] for r in ranks]), bytes([m.lengths[r] for r in ranks]), "".join([m.text_of[r] for r in ranks]))
                    if len(word) < 64:
                        self[word] = out
                    return out
                except TypeError:
                    pass
            ids, lengths = m.chunk(BLANK + word)
        out = (",".join(map(str, ids)), bytes(lengths), m.surface(ids))
        if len(word) < 64:
            self[word] = out
        return out


def digests(model: PieceModel, known: _Remembered, text: str) -> tuple[int, str, str, int]:
    """Number of ids, digests of ids and decoded text, crc32 of the pieces' end bytes."""
    if not text:
        empty = hashlib.sha256(b"").hexdigest()
        return 0, empty, empty, 0
    plain = model.map is None and not model.squeeze and model.prefix and model.escape and model.lone_newline
    if plain and "  " not in text and BLANK not in text and "\0" not in text and text[0] != " ":
        ids, lengths, decoded = zip(*map(known.__getitem__, text.replace("\n", " \0").split(" ")))
        joined = ",".join(ids)
        length = np.frombuffer(b"".join(lengths), dtype=np.uint8)
        out = "".join(decoded)[1:]
        ends = np.cumsum(length, dtype=np.int64) - 1
        if not text.isascii():
            cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            ends = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))])[ends]
        n = len(length)
    else:
        found, _, ends = model.encode(text)
        joined, out, n = ",".join(map(str, found)), model.decode(found), len(found)
    return (
        n,
        hashlib.sha256(joined.encode()).hexdigest(),
        hashlib.sha256(out.encode()).hexdigest(),
        zlib.crc32(np.asarray(ends).astype("<u4").tobytes()),
    )


def read_model(path: str) -> bytes:
    """The model file, read on the driver; executors get its bytes."""
    with open(path, "rb") as f:
        return f.read()


_MODELS: dict[int, tuple[PieceModel, _Remembered]] = {}


def _model(data: bytes) -> tuple[PieceModel, _Remembered]:
    key = zlib.crc32(data)
    if key not in _MODELS:
        model = PieceModel(data)
        _MODELS[key] = (model, _Remembered(model))
    return _MODELS[key]


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ids, starts, ends (source bytes of each piece) and decoded."""
    data = spark.sparkContext.broadcast(read_model(model_path))  # one file of fixed size

    def make():
        model, _ = _model(data.value)

        def run(texts):
            rows = [model.encode(t or "") for t in texts]
            return [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [model.decode(r[0]) for r in rows]]

        return run

    return map_text(docs, make, "ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")


def digest_documents(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with the digests of what ``encode_documents`` gives, text for text."""
    data = spark.sparkContext.broadcast(read_model(model_path))

    def make():
        model, known = _model(data.value)

        def run(texts):
            rows = []
            for text in texts:
                rows.append(digests(model, known, text or ""))
                if len(known) > REMEMBERED:
                    known.clear()
            return list(zip(*rows)) if rows else [[]] * 4

        return run

    return map_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, span_ends_crc32 bigint")


def op8_piece_encoding(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return digest_documents(spark, docs, model_path).drop("text")
