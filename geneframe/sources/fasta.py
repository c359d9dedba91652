"""Sequences read from byte ranges of FASTA files, so a chromosome is read by many tasks and never is one row.

A range is parsed twice. First it tells how many letters it has before its first header and after its last one; a window over these few rows
carries the header in force and the letters before the range. Then each range cuts chunks: a chunk belongs to the range of its first letter,
which reads on past its end until the chunk is whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.chunks import CHUNK, chunked
from .files import opened, reachable
from .readers import scan_fasta

#: Bytes of a range, and of what is parsed at once.
RANGE, BLOCK = 64 << 20, 4 << 20
#: Bytes before a range in which the start of a header line is looked for: a header is no longer.
HEADER = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Range:
    """Letters and headers of bytes a to b of a file, block by block."""

    def __init__(self, file, a: int, b: int, size: int):
        self.file, self.a, self.b, self.size = file, a, b, size

    def read(self, a: int, n: int) -> bytes:
        self.file.seek(a)
        return self.file.read(max(0, min(n, self.size - a)))

    def _in_header(self) -> bool:
        """Whether the range begins inside a header line."""
        if self.a == 0:
            return False
        lo = max(0, self.a - HEADER)
        before = self.read(lo, self.a - lo)
        line = before.rfind(b"\n") + 1
        if line == 0 and lo:
            return False  # no header is that long
        return line < len(before) and (before[line : line + 1] == b">" or line == 0 and lo == 0)

    def events(self, until=None):
        """('header', place, text) and ('letters', place, array) in order, from a to b, then on to the end of the file while until() asks."""
        header, text, start = self._in_header(), None, self.a
        at, fresh = self.a, self.a == 0 or self.read(self.a - 1, 1) == b"\n"
        while at < self.b or header and text is not None or until is not None and until():
            if at >= self.size:
                break
            block = self.read(at, min(BLOCK, self.b - at) if at < self.b else (1 << 16))
            data, i = np.frombuffer(block, np.uint8), 0
            marks = np.flatnonzero(data == 62)
            marks = marks[(marks > 0) & (data[marks - 1] == 10) | ((marks == 0) & fresh)]
            if at == 0 and not (len(marks) and marks[0] == 0):  # a file's first line is a header, with or without its mark
                marks = np.concatenate(([0], marks))
            fresh = block.endswith(b"\n")
            while i < len(block):
                if not header and at + i >= self.b and (until is None or not until()):
                    return
                if header:
                    end = block.find(b"\n", i)
                    stop = len(block) if end < 0 else end
                    if text is not None:
                        text += block[i:stop]
                    i = stop + 1
                    if end >= 0:
                        if text is not None:
                            yield "header", start, text.decode("utf-8", "replace").removeprefix(">")
                        header, text = False, None
                    continue
                k = int(np.searchsorted(marks, i))
                stop = int(marks[k]) if k < len(marks) else len(block)
                own = data[i:stop]
                own = own[~_SPACE[own]]
                if len(own):
                    yield "letters", at + i, own
                i = stop
                if i < len(block):
                    if at + i >= self.b:
                        return  # the next range's header ends what this one asked for
                    header, text, start = True, b"", at + i
            at += len(block)
        if header and text:  # a header that the file ends with
            yield "header", start, text.decode("utf-8", "replace").removeprefix(">")


def _edges(batches):
    """Ranges -> letters before the first header, whether there is one, the last header, letters after it."""
    for batch in batches:
        rows = []
        for path, a, b, size in zip(*(batch.column(c).to_pylist() for c in ("path", "a", "b", "size")), strict=True):
            lead, tail, last = 0, 0, None
            with opened(path) as f:
                for kind, _, x in Range(f, a, b, size).events():
                    if kind == "header":
                        tail, last = 0, x
                    elif last is None:
                        lead += len(x)
                    else:
                        tail += len(x)
            rows.append((path, a, b, size, lead, last, tail))
        cols = zip(*rows, strict=True) if rows else [[]] * 7
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "a", "b", "size", "lead", "last", "tail"])


def _lengths(source: Range) -> list[int]:
    """Letters of the record in force and of each that begins in the range, within it."""
    out = [0]
    for kind, _, x in source.events():
        if kind == "header":
            out.append(0)
        else:
            out[-1] += len(x)
    return out


class _Record:
    """The letters of a record that are still needed."""

    def __init__(self, header: str | None, place: int, before: int, length: int, size: int, overlap: int):
        self.seq_id = re.match(r"\S*", header or "", re.ASCII)[0]
        self.doc = (header or "")[len(self.seq_id) :].strip(" ")
        self.place, self.length, self.size, self.overlap = place, length, size, overlap
        self.next = -(-before // size)  # the first chunk that begins here
        self.at, self.held = before, []  # the place of the first letter that is held
        self.letters = 0

    def add(self, own: np.ndarray) -> None:
        self.held.append(own)
        self.letters += len(own)

    def chunks(self, last: int, done: bool):
        """Whole chunks that begin before the letter `last`; with done=True what there is."""
        end = self.at + self.letters
        while self.next * self.size < min(last, end) and (done or (self.next + 1) * self.size + self.overlap <= end):
            if len(self.held) > 1:
                self.held = [np.concatenate(self.held)]
            a = self.next * self.size - self.at
            yield self.next, self.held[0][a : a + self.size + self.overlap].tobytes().decode("latin-1")
            self.next += 1
        drop = min(self.next * self.size - self.at, self.letters)
        if drop > self.size:  # letters of chunks that are out
            self.held, self.at, self.letters = [np.concatenate(self.held)[drop:]], self.at + drop, self.letters - drop

    def waits(self, last: int) -> bool:
        return self.next * self.size < min(last, self.length) and self.at + self.letters < min((self.next + 1) * self.size + self.overlap, self.length)


def _cut(size: int, overlap: int):
    """Ranges with what is carried to them -> chunks."""

    def run(batches):
        for batch in batches:
            names = ("path", "a", "b", "size", "header", "before", "after")
            for path, a, b, total, header, before, after in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                out, weight = [], 0
                with opened(path) as f:
                    source = Range(f, a, b, total)
                    lengths = _lengths(source)
                    ends = list(lengths)  # letters of each record here
                    lengths[0] += before + (after if len(lengths) == 1 else 0)
                    if len(lengths) > 1:
                        lengths[-1] += after
                    k, first = 0, before
                    record = _Record(header, 0, before, lengths[0], size, overlap)

                    def rows(done):
                        nonlocal weight
                        got = [(path, record.place, record.seq_id, record.doc, c, part, record.length) for c, part in record.chunks(first + ends[k], done)]
                        if done and record.length == 0 and record.next == 0 and k:
                            got.append((path, record.place, record.seq_id, record.doc, 0, "", 0))
                        weight += sum(len(g[5]) for g in got)
                        return got

                    for kind, place, x in source.events(lambda: record.waits(first + ends[k])):
                        if kind == "header":
                            out += rows(True)
                            k, first = k + 1, 0
                            record = _Record(x, place, 0, lengths[k], size, overlap)
                        else:
                            record.add(x)
                            out += rows(False)
                        if weight > BLOCK:
                            yield _batch(out)
                            out, weight = [], 0
                    out += rows(True)
                if out:
                    yield _batch(out)

    return run


def _batch(rows):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "place", "seq_id", "doc", "chunk", "part", "length"])


def ranges(spark: SparkSession, path: str, bytes_each: int = RANGE) -> DataFrame:
    """path, a, b, size: the byte ranges of all files; only names and sizes are read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(bytes_each).cast("long"))).alias("a"))
    return parts.select("path", "a", F.least(F.col("a") + bytes_each, F.col("size")).alias("b"), "size")


def range_tasks(spark: SparkSession, parts: DataFrame) -> int:
    """Tasks that ranges are dealt to: one for RANGE bytes, so many small ranges share one, but the session's number at least, if there are
    as many ranges."""
    n, size = parts.agg(F.count("*"), F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0))).first()
    return max(1, min(n, max(-(-size // RANGE), int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000))


def scan_fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK, overlap: int = 0, bytes_each: int = RANGE) -> DataFrame:
    """seq_id, doc, chunk, part, length (and path, place: where the record's header stands, 0 in a record that began in a range before) of
    each record's chunks, as chunked() makes them of whole sequences; a record without letters has one empty chunk.

    Files that Spark alone can reach, or that are compressed, are read by scan_fasta and cut afterwards, as they can't be split this way.
    Headers are at most HEADER bytes long.
    """
    if not reachable(path) or re.search(r"\.(gz|bz2|zst|lz4|snappy)$", path):
        whole = scan_fasta(spark, path)
        return chunked(whole.select(F.struct("seq_id", "doc").alias("seq_id"), "seq"), size, overlap).select("seq_id.seq_id", "seq_id.doc", "chunk", "part", "length")
    parts = ranges(spark, path, bytes_each)
    tasks = range_tasks(spark, parts)
    edges = parts.repartition(tasks).mapInArrow(_edges, "path string, a long, b long, size long, lead long, last string, tail long")
    # a group is the range with the last header so far and those that it goes on in
    along = W.partitionBy("path").orderBy("a")
    group = W.partitionBy("path", "group").orderBy("a")
    back = group.rowsBetween(W.unboundedPreceding, W.currentRow)
    e = edges.withColumn("group", F.count("last").over(along))
    head = F.first("last").over(back)
    # letters of the record at the range's end, up to here; then what the next range starts with
    so_far = F.first("tail").over(back) + F.sum(F.when(F.col("last").isNull(), F.col("lead")).otherwise(0)).over(back)
    e = e.withColumn("head", head).withColumn("so_far", so_far)
    e = e.withColumn("header", F.lag("head").over(along)).withColumn("before", F.coalesce(F.lag("so_far").over(along), F.lit(0).cast("long")))
    # letters of the last record in the ranges after this one: those of its group, and what the next header's range leads with
    rest = F.sum(F.when(F.col("last").isNull(), F.col("lead")).otherwise(0)).over(group.rowsBetween(1, W.unboundedFollowing))
    e = e.withColumn("own", F.coalesce(rest, F.lit(0)))
    starts = e.where("last is not null").select("path", (F.col("group") - 1).alias("group"), F.col("lead").alias("next_lead"))
    e = e.join(starts, ["path", "group"], "left").withColumn("after", F.col("own") + F.coalesce("next_lead", F.lit(0)))
    e = e.select("path", "a", "b", "size", "header", "before", "after").repartition(tasks)
    return e.mapInArrow(_cut(size, overlap), "path string, place long, seq_id string, doc string, chunk long, part string, length long")
