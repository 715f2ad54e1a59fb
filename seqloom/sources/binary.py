"""Readers and writers of FASTQ and BAM, as Spark data sources.

Plain FASTQ and BAM files are cut into byte ranges that tasks read apart: a
task looks for the first whole record of its range and reads on to the first
that begins in the next. Paths must be readable under the same name by every
executor (a shared or mounted folder).
"""

from __future__ import annotations

import glob
import gzip
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
# Letters of packed bases and of packed operations; bytes of a BGZF end marker.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _local(path: str) -> str:
    """A path as all executors open it: without its ``file:`` scheme."""
    return re.sub(r"^file:/*(?=/)", "", path)


def _ranges(path: str, split: int) -> list[ByteRange]:
    out, path = [], _local(path)
    for name in sorted(glob.glob(path)) if not os.path.isdir(path) else sorted(glob.glob(f"{path}/*")):
        size = os.path.getsize(name)
        step = size if name.endswith(".gz") else split
        out += [ByteRange(name, a, min(size, a + step)) for a in range(0, size, max(1, step))]
    return out


class FastqSource(DataSource):
    """Format ``fastq``: name, seq, qual, input_file. Option phred=64 turns
    qualities to offset 33; trim5 and trim3 cut letters off either end."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, seq string, qual string, input_file string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.shift = int(options.get("phred", 33)) - 33
        self.trim5, self.trim3 = int(options.get("trim5", 0)), int(options.get("trim3", 0))

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.path, self.split)

    def read(self, part: ByteRange) -> Iterator[tuple]:
        with gzip.open(part.path, "rb") if part.path.endswith(".gz") else open(part.path, "rb") as f:
            if part.path.endswith(".gz"):
                records = _records(f, None)
            else:
                f.seek(_first_record(f, part.start))
                records = _records(f, part.stop)
            for name, seq, qual in records:
                if self.shift:
                    qual = "".join(chr(ord(c) - self.shift) for c in qual)
                end = len(seq) - self.trim3
                yield name, seq[self.trim5 : end], qual[self.trim5 : end], part.path


def _first_record(f, start: int) -> int:
    """Offset of the first record at or after ``start``: a line of ``@`` whose
    next but one begins with ``+``, and whose sequence is as long as its
    quality (quality lines may begin with ``@`` too)."""
    if start == 0:
        return 0
    f.seek(start - 1)
    f.readline()
    at = f.tell()
    window = []
    while len(window) < 8:
        line = f.readline()
        if not line:
            break
        window.append((at, line.rstrip(b"\r\n")))
        at = f.tell()
    for i in range(len(window) - 3):
        lines = [x for _, x in window[i : i + 4]]
        if lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1]) == len(lines[3]):
            return window[i][0]
    return at


def _records(f, stop: int | None) -> Iterator[tuple[str, str, str]]:
    while stop is None or f.tell() < stop:
        head = f.readline()
        if not head:
            return
        if not head.strip():
            continue
        seq, _, qual = f.readline(), f.readline(), f.readline()
        yield head[1:].decode().split()[0] if head[1:].strip() else "", seq.decode().strip().upper(), qual.decode().rstrip("\r\n")


class BamSource(DataSource):
    """Format ``bam``: the columns of alignment text, tags tab-separated."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags string, input_file string"

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.path, self.split)

    def read(self, part: ByteRange) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            names, skip = _header(f)
            first = 0 if part.start == 0 else _next_block(f, part.start)
            if first is None or first >= part.stop:
                return
            stream = _Unpacked(f, first)
            if part.start == 0:
                stream.take(skip)
            elif not _find_record(stream, len(names), part.stop):
                return
            while True:
                # a record belongs to the range in which its first block begins
                if stream.at_block() >= part.stop:
                    return
                size = stream.take(4)
                if len(size) < 4:
                    return
                yield (*decode(stream.take(struct.unpack("<i", size)[0]), names), part.path)


class _Unpacked:
    """Decompressed bytes of the blocks from an offset, and where they lay."""

    def __init__(self, f, at: int):
        self.f, self.next = f, at
        self.data, self.pos, self.base = bytearray(), 0, 0  # base: place of data[0] in the whole stream
        self.starts: list[tuple[int, int]] = []  # (place in the stream, offset in the file) of blocks

    def more(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(18)
        if len(head) < 18:
            return False
        size = struct.unpack("<H", head[16:18])[0] + 1
        packed = self.f.read(size - 18)
        if self.pos > 1 << 20:
            del self.data[: self.pos]
            self.base, self.pos = self.base + self.pos, 0
        self.starts.append((self.base + len(self.data), self.next))
        self.data += zlib.decompress(packed[:-8], -15)
        self.next += size
        return True

    def at_block(self) -> int:
        """Offset of the block that holds the next byte; a great number at the end."""
        while self.pos >= len(self.data):
            if not self.more():
                return 1 << 62
        here = self.base + self.pos
        while len(self.starts) > 1 and self.starts[1][0] <= here:
            self.starts.pop(0)
        return self.starts[0][1]

    def take(self, n: int) -> bytes:
        while len(self.data) - self.pos < n and self.more():
            pass
        out = bytes(self.data[self.pos : self.pos + n])
        self.pos += len(out)
        return out


def _header(f) -> tuple[list[str], int]:
    """Reference names, and the bytes of the header."""
    s = _Unpacked(f, 0)
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack("<i", s.take(4))[0]
    s.take(n)
    refs = struct.unpack("<i", s.take(4))[0]
    names, used = [], 12 + n
    for _ in range(refs):
        size = struct.unpack("<i", s.take(4))[0]
        names.append(s.take(size)[:-1].decode())
        s.take(4)
        used += 8 + size
    return names, used


def _next_block(f, start: int) -> int | None:
    """Offset of the first block at or after ``start``, proved by the next one."""
    f.seek(start)
    data = f.read(1 << 17)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        if data[at + 12 : at + 16] == b"BC\x02\x00" and at + 18 <= len(data):
            nxt = start + at + struct.unpack("<H", data[at + 16 : at + 18])[0] + 1
            f.seek(nxt)
            if f.read(4) in (b"\x1f\x8b\x08\x04", b""):
                return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


_LARGEST = 1 << 28  # bytes of a record
_CHAIN = 4  # records that must follow one another to prove where they begin


def _beginnings(data: bytearray, lo: int, hi: int, n_refs: int) -> np.ndarray:
    """Places from lo to hi at which the fixed fields of a record could lie."""
    at = np.arange(lo, min(hi, len(data) - 36))
    if not len(at):
        return at
    raw = np.frombuffer(bytes(data[at[0] : at[-1] + 36]), np.uint8).astype(np.int64)

    def field(o: int, width: int = 4) -> np.ndarray:
        v = sum(raw[o + b : o + b + len(at)] << 8 * b for b in range(width))
        return np.where(v >= 1 << 31, v - (1 << 32), v) if width == 4 else v

    size, name, ops, length = field(0), field(12, 1), field(16, 2), field(20)
    need = 32 + name + 4 * ops + (length + 1) // 2 + length
    ok = (size >= need) & (size < _LARGEST) & (length >= 0) & (name > 1)
    for ref in (field(4), field(24)):
        ok &= (ref >= -1) & (ref < n_refs)
    return at[ok & (field(8) >= -1) & (field(28) >= -1)]


def _record_size(stream: _Unpacked, at: int, n_refs: int) -> int:
    """Size of the record at ``at``, 0 if there can't be one, -1 at the end of the file."""
    data = stream.data
    while len(data) < at + 36 + 256 and stream.more():
        pass
    if at >= len(data):
        return -1
    if not len(_beginnings(data, at, at + 1, n_refs)):
        return 0
    size, name, ops = struct.unpack_from("<i", data, at)[0], data[at + 12], struct.unpack_from("<H", data, at + 16)[0]
    text = data[at + 36 : at + 36 + name]
    if len(text) < name or text[-1] != 0 or not all(33 <= c < 127 for c in text[:-1]):
        return 0
    codes = data[at + 36 + name : at + 36 + name + 4 * ops : 4]
    return size + 4 if all(c & 15 <= 8 for c in codes) else 0


def _find_record(stream: _Unpacked, n_refs: int, stop: int) -> bool:
    """Moves to the first record that begins in a block before ``stop``, the
    first place from which records follow one another; False if none begins
    there, as where one long record fills the whole range."""
    at = 0
    while True:
        if len(stream.data) < at + 292 and not stream.more() and at + 36 > len(stream.data):
            return False
        if max(offset for place, offset in stream.starts if place <= at) >= stop:
            return False
        nxt = max(at + 1, len(stream.data) - 291)
        for place in _beginnings(stream.data, at, nxt, n_refs).tolist():
            p, n = place, 0
            while n < _CHAIN and (size := _record_size(stream, p, n_refs)) > 0:
                p, n = p + size, n + 1
                while len(stream.data) < p and stream.more():
                    pass
            if n == _CHAIN or (n and size < 0 and p == len(stream.data)):
                if max(offset for begin, offset in stream.starts if begin <= place) >= stop:
                    return False
                stream.pos = place
                return True
        at = nxt


def decode(r: bytes, names: list[str]) -> tuple:
    """One packed record as the columns of alignment text."""
    ref, pos, name_n, mapq, _, ops, flag, length, mate, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", r[:32])
    at = 32 + name_n
    qname = r[32 : at - 1].decode()
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack(f"<{ops}I", r[at : at + 4 * ops])) or "*"
    at += 4 * ops
    packed = r[at : at + (length + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length] or "*"
    at += (length + 1) // 2
    qual = r[at : at + length]
    text = "*" if not length or qual[:1] == b"\xff" else bytes(q + 33 for q in qual).decode()
    name = lambda i: names[i] if i >= 0 else "*"
    mate_name = "=" if mate == ref and mate >= 0 else name(mate)
    return qname, flag, name(ref), pos + 1, mapq, cigar, mate_name, mate_pos + 1, tlen, seq, text, _tags(r[at + length :]) or None


def _tags(data: bytes) -> str:
    # Width and struct code of number tags.
    codes = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
    out, at = [], 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            end = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack("<i", data[at + 1 : at + 5])[0]
            code = codes[sub]
            width = struct.calcsize(code)
            values = struct.unpack(f"<{n}{code[1]}", data[at + 5 : at + 5 + n * width])
            out.append(f"{name}:B:{sub}," + ",".join(map(str, values)))
            at += 5 + n * width
        else:
            code = codes[kind]
            value = struct.unpack(code, data[at : at + struct.calcsize(code)])[0]
            out.append(f"{name}:{'f' if kind == 'f' else 'i'}:{value:g}" if kind == "f" else f"{name}:i:{value}")
            at += struct.calcsize(code)
    return "\t".join(out)


def encode(row: tuple, refs: dict[str, int]) -> bytes:
    """One alignment as a packed record, its size before it."""
    qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags = row
    ops = re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")
    name = qname.encode() + b"\0"
    seq = "" if seq in (None, "*") else seq.upper()
    codes = [BASES.find(c) if c in BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes) - 1, 2)) if seq else b""
    q = bytes(ord(c) - 33 for c in qual) if qual not in (None, "*") and len(qual) == len(seq) else b"\xff" * len(seq)
    ref = refs.get(rname, -1)
    mate = ref if rnext == "=" else refs.get(rnext, -1)
    span = sum(int(n) for n, o in ops if o in "MDN=X") or 1
    body = struct.pack("<iiBBHHHiiii", ref, (pos or 0) - 1, len(name), mapq or 0, _bin((pos or 0) - 1, (pos or 0) - 1 + span), len(ops), flag, len(seq), mate, (pnext or 0) - 1, tlen or 0)
    body += name + b"".join(struct.pack("<I", int(n) << 4 | OPERATIONS.index(o)) for n, o in ops) + packed + q
    for t in (tags or "").split("\t") if tags else ():
        key, kind, value = t.split(":", 2)
        body += key.encode() + (b"i" + struct.pack("<i", int(value)) if kind == "i" else b"f" + struct.pack("<f", float(value)) if kind == "f" else b"A" + value[:1].encode() if kind == "A" else b"Z" + value.encode() + b"\0")
    return struct.pack("<i", len(body)) + body


def _bin(start: int, stop: int) -> int:
    """Number of the smallest bin of the six-level index that holds the span."""
    start, stop = max(start, 0), max(stop - 1, 0)
    for level, shift in enumerate((14, 17, 20, 23, 26)):
        if start >> shift == stop >> shift:
            return ((1 << (15 - 3 * level)) - 1) // 7 + (start >> shift)
    return 0


def block(data: bytes) -> bytes:
    """One BGZF block of at most 65,280 bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[i : i + 65_280]) for i in range(0, len(data), 65_280))


def write_bam(df: DataFrame, folder: str, references: list[tuple[str, int]], sort: bool = False) -> None:
    """Rows of alignment columns as BAM files in ``folder``, one a partition,
    each whole by itself. sort: by place, over all files in order."""
    cols = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]
    refs = {n: i for i, (n, _) in enumerate(references)}
    text = f"@HD\tVN:1.0\tSO:{'coordinate' if sort else 'unknown'}\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references)
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references))
    for n, size in references:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    folder = _local(folder)
    os.makedirs(folder, exist_ok=True)
    if sort:
        from pyspark.sql import functions as F

        order = F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in references]), F.col("rname")), F.lit(0))
        df = df.orderBy(F.when(order == 0, len(references) + 1).otherwise(order), "pos")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, n, held = TaskContext.get().partitionId(), 0, bytearray()
        path = f"{folder}/part-{pid:05d}.bam"
        with open(f"{path}.{os.getpid()}.tmp", "wb") as out:
            out.write(blocks(head))
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    held += encode(row, refs)
                    n += 1
                    if len(held) > 1 << 20:
                        out.write(blocks(bytes(held)))
                        held.clear()
            out.write(blocks(bytes(held)) + END_BLOCK)
        os.replace(out.name, path)  # a task that is tried again gives the same file
        yield pa.RecordBatch.from_pydict({"n": [n]})

    df.select(*cols).mapInArrow(write, "n long").agg({"n": "sum"}).collect()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(BamSource)
