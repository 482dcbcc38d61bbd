"""Fill-in-the-middle forms of documents, by piece tables.

A document is never copied while it is rearranged: it is a list of descriptors
(buffer, start, length) over two immutable buffers, its text and the sentinels.
Cutting splits a descriptor, an arrangement permutes descriptors and sets those of
sentinels between them, and a digest streams through them. The inverse
permutation over a table on the output restores the text.

Tokens are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, left to
right. With n tokens, h1 to h4 the first four groups of eight hex digits of
sha256("SEED:DOC_ID"): the prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) tokens, the middle after the larger. The form is ``plain`` if the text
is empty or holds a sentinel, or if h3 % 100 >= ``rate``; else ``spm`` if
h4 % 100 < ``spm_rate``, else ``psm``.

Defined results: null text is empty (n = 0, plain); a null doc_id is written as
the empty string; rows of one id are cut alike; every row gives one row, repeated
ones too; an empty table gives none; whole texts of any length are cut, each in
one task; further columns are ignored. A row depends on nothing but itself, so
there is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

SENTINELS = "<P><S><M>"
MARKS = {"prefix": 0, "suffix": 3, "middle": 6}
MARK = 3
#: The order in which each form writes its parts.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")
SEED, RATE, SPM_RATE = 42, 50, 80
TEXT, MARKED = 0, 1
PIECES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass
class PieceTable:
    """A text as descriptors (buffer number, start, length) over buffers that never change."""

    buffers: tuple[str, ...]
    pieces: list[tuple[int, int, int]]

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls((text, SENTINELS), [(TEXT, 0, len(text))])

    def cut(self, at: int) -> None:
        """Splits the descriptor that spans offset ``at``; afterwards one begins there, empty at an end."""
        for i, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[i : i + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length
        raise IndexError(at)

    def arranged(self, order: Sequence[int]) -> PieceTable:
        """The same buffers with the descriptors in another order; what ``order`` leaves out goes."""
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def chunks(self) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def text(self) -> str:
        return "".join(self.chunks())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk.encode("utf-8", "surrogatepass"))
        return digest.hexdigest()


def token_ends(text: str) -> np.ndarray:
    """Offset after each token."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(codes))


def marked(text: str, first: int, second: int, form: str) -> PieceTable:
    """The text cut at two offsets, its parts in the form's order behind their sentinels."""
    table = PieceTable.of(text)
    table.cut(second)
    table.cut(first)
    table.pieces += [(MARKED, MARKS[name], MARK) for name in FORMS[form]]
    return table.arranged([i for k, name in enumerate(FORMS[form]) for i in (len(PARTS) + k, PARTS.index(name))])


def restored(output: str, form: str) -> PieceTable:
    """The text again, from a form's output alone."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    names, ends = FORMS[form], [len(output)]
    for name in reversed(names[1:]):
        mark = SENTINELS[MARKS[name] : MARKS[name] + MARK]
        ends.insert(0, output.index(mark))
    for at in reversed(ends[:-1]):
        table.cut(at)
    table.pieces = [(buffer, start + MARK, length - MARK) for buffer, start, length in table.pieces]
    return table.arranged([names.index(name) for name in PARTS])


def transformed(text: str, h: Sequence[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, PieceTable]:
    """(number of tokens, form, characters of prefix and middle, the output's piece table)."""
    ends = token_ends(text)
    n = len(ends)
    if not text or any(SENTINELS[at : at + MARK] in text for at in MARKS.values()) or h[2] % 100 >= rate:
        return n, "plain", None, None, PieceTable.of(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, second = (int(ends[k - 1]) if k else 0 for k in (a, b))
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return n, form, first, second - first, marked(text, first, second, form)


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, texts: bool = True) -> DataFrame:
    """(doc_id, text) -> ``PIECES``, one row for each; without ``texts`` the output itself is left null."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, parts, digests = (batch.column(i).to_pylist() for i in range(3))
                rows = []
                for i, text, digest in zip(ids, parts, digests):
                    n, form, prefix, middle, table = transformed(text, [int(digest[k : k + 8], 16) for k in range(0, 32, 8)], rate, spm_rate)
                    output = table.text()
                    rows.append((i, n, form, prefix, middle, output if texts else None, table.sha256(), restored(output, form).sha256()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("digest")).mapInArrow(run, PIECES)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle(table(spark, sf_dir, "documents"), texts=False).drop("output")
