"""A positional inverted index of a corpus, stored once and read by any query set.

A text is indexed by its letter stream (lower case, no accents, blanks, marks
or line breaks), so that lost blanks, hyphens at line ends and line breaks do
not part a phrase. Terms are the windows of ``k`` letters of the stream; of
all windows those whose hash is divisible by ``every`` have postings, which
depends on the window alone, so equal windows have postings in every text or
in none. The index is parted by documents: a slab holds some documents' sorted
terms with their places, and their letters, by which candidates are checked
without going back to the corpus. Neither building nor reading it shuffles.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.letters import letters, row_blocks, window_hashes, window_index
from seqloom.session import materialize

SLAB = "docs binary, ends binary, letters binary, wide boolean, terms binary, places binary"

# A slab is megabytes of one row. Parquet looks at what it holds only after 100
# rows, after small ones up to 10,000, and a row group is held whole by the task
# that writes or reads it. Its least and greatest cells would be held until the
# file ends.
STORED = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.column.statistics.enabled": "false"}

_SEVERAL = 0xFFFFFFFF


def _folded(c: int) -> int:
    """The lower-case letter without accents of a code point, 0 if it is no
    letter, _SEVERAL if it stands for more than one."""
    out = [x for x in unicodedata.normalize("NFKD", chr(c)).lower() if x.isalpha()] if not 0xD800 <= c < 0xE000 else []
    return 0 if not out else ord(out[0]) if len(out) == 1 else _SEVERAL


_PLANE = np.array([_folded(c) for c in range(1 << 14)], np.uint32)
_BYTE = _PLANE[:128].astype(np.uint8)


def letter_places(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, places, raw) of the letter streams of a string column;
    places: of each letter among the raw codes of all texts. Nulls have none."""
    raw, offsets, _ = letters(col)
    low = _lower(raw)
    if low.dtype != np.uint8 and (low == _SEVERAL).any():
        raw, offsets, _ = letters(pc.utf8_normalize(col, "NFKD"))
        low = _lower(raw)
        low[low == _SEVERAL] = 0
    places = np.flatnonzero(low)
    return low[places], np.searchsorted(places, offsets), places, raw


def letter_streams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of the letter streams of a string column; nulls have none."""
    return letter_places(col)[:2]


def _lower(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint8:
        return _BYTE[codes]
    low = _PLANE[np.minimum(codes, len(_PLANE) - 1)]
    beyond = np.flatnonzero(codes >= len(_PLANE))
    if len(beyond):
        known, at = np.unique(codes[beyond], return_inverse=True)
        low[beyond] = np.array([_folded(int(c)) for c in known], np.uint32)[at]
    return low


def letter_stream(text: str) -> str:
    codes, _ = letter_streams(pa.array([text], pa.string()))
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def sampled(h: np.ndarray, every: int) -> np.ndarray:
    """Which window hashes have postings."""
    return h % np.uint64(every) == 0


def short(h: np.ndarray) -> np.ndarray:
    """The 32 bits of a window hash that the index keeps; candidates are checked by all letters."""
    return (h >> np.uint64(32)).astype(np.uint32)


@dataclass
class Slab:
    docs: np.ndarray  # ids
    offsets: np.ndarray  # of each document's letters
    codes: np.ndarray  # letters of all documents
    terms: np.ndarray  # sorted, one entry a posting
    places: np.ndarray  # of each posting, counted over all letters of the slab

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the term, place) of every posting of the sorted terms asked for."""
        lo, hi = np.searchsorted(self.terms, terms, "left"), np.searchsorted(self.terms, terms, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(which)) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
        return which, self.places[at].astype(np.int64)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def windows(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, place in it) of all windows of some documents."""
        sizes = np.diff(self.offsets)[rows]
        own = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(own[-1]) + np.repeat(self.offsets[rows] - own[:-1], sizes)
        row, start = window_index(own, k)
        h = window_hashes(self.codes[at], k)
        return h[start] if len(start) else np.zeros(0, np.uint64), rows[row], start - own[row]


def build_index(docs: DataFrame, doc_id: str, text: str, k: int = 10, every: int = 3, slab_letters: int = 1_000_000) -> DataFrame:
    """The stored index of ``docs``: rows of ``SLAB``, in the shared folder.

    doc_id: a whole-number column. every: one window in so many has postings.
    slab_letters: letters of a slab; a longer text has a slab of its own.
    Null texts are not indexed; empty ones have no postings. Repeated
    documents are indexed each. Extra columns are not read.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t")).filter(F.col("t").isNotNull() & F.col("d").isNotNull())

    return materialize(rows.mapInArrow(lambda batches: indexed(batches, k, every, slab_letters), SLAB), **STORED)


def indexed(batches: Iterator[pa.RecordBatch], k: int, every: int, slab_letters: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``SLAB`` of batches of (id, text). A batch is taken in pieces of
    at most ``slab_letters`` bytes of text, as letters take many times the bytes
    while they are sorted out; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, end in row_blocks(np.concatenate([[0], np.cumsum(sizes)]), slab_letters):
            piece = batch.slice(first, end - first)
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            codes, offsets = letter_streams(piece.column(1))
            for lo, hi in row_blocks(offsets, slab_letters):
                own, c = offsets[lo : hi + 1] - offsets[lo], codes[offsets[lo] : offsets[hi]]
                h = window_hashes(c, k)
                _, at = window_index(own, k)
                at = at[sampled(h[at], every)] if len(h) else np.zeros(0, np.int64)
                # sorted by term and place; a slab has fewer than 2**32 letters
                posting = np.sort(h[at] >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
                wide = bool(len(c)) and int(c.max()) > 255
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[lo:hi].astype("<i8").tobytes()], pa.binary()), pa.array([own.astype("<i8").tobytes()], pa.binary()), pa.array([c.astype("<u4" if wide else np.uint8).tobytes()], pa.binary()),
                        pa.array([wide]), pa.array([(posting >> np.uint64(32)).astype("<u4").tobytes()], pa.binary()), pa.array([posting.astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=["docs", "ends", "letters", "wide", "terms", "places"],
                )


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[Slab]:
    """Slabs of batches of the index; its columns may be fewer than all."""
    for batch in batches:
        names = batch.schema.names
        for r in range(batch.num_rows):
            cell = lambda name, kind: np.frombuffer(batch.column(names.index(name))[r].as_py(), kind) if name in names else np.zeros(0, kind)  # noqa: B023, E731
            wide = "wide" in names and batch.column(names.index("wide"))[r].as_py()
            yield Slab(cell("docs", "<i8"), cell("ends", "<i8"), cell("letters", "<u4" if wide else np.uint8), cell("terms", "<u4"), cell("places", "<u4"))
