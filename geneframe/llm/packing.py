"""Token ids packed into rows of fixed length: best fit decreasing, with a segment tree over the room left."""

from __future__ import annotations

import json
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .bpe import _encoding, default_path, default_pattern
from .common import slices, table, trimmed

#: Ids in a packed row, code points of text packed together, the id that fills a row's end (free in the vocabulary).
LENGTH, WINDOW, PAD = 2048, 8 << 20, 50256
#: Code points up to which a text is encoded at once; packed rows in a batch.
LONG_TEXT, ROWS = 1 << 20, 512


class Room:
    """Open rows by room left. A segment tree over room 0..length finds the smallest room that is enough in O(log length)."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (room, row) with the smallest room >= need, removed; the last one put wins a tie."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of item numbers; items by falling size (ties: in order), each into the fullest row that holds it."""
    room, rows = Room(length), []
    for item in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        need = int(sizes[item])
        found = room.take(need)
        if found is None:
            found = (length, len(rows))
            rows.append([])
        rows[found[1]].append(item)
        if found[0] > need:
            room.put(found[0] - need, found[1])
    return rows


def token_ids(text: str | None, path: str, pattern: str) -> np.ndarray:
    """The ids of a text. A long one is encoded match by match, so no list of all its ids is ever made."""
    enc = _encoding(path, pattern)
    if not text or len(text) <= LONG_TEXT:
        return np.array(enc.encode_ordinary(text) if text else [], np.uint32)
    out = array("I")
    for m in regex.finditer(pattern, text):
        out.extend(enc._encode_single_piece(m[0].encode()))
    return np.frombuffer(out, np.uint32)


def _pack(length: int, path: str, pattern: str, pad: int):
    @trimmed
    def run(batches):
        from pyspark import TaskContext

        task, window = TaskContext.get().partitionId(), 0
        docs, ids, held = [], [], 0

        def flush():
            pieces = [(k, a, min(a + length, len(x))) for k, x in enumerate(ids) for a in range(0, len(x), length)]
            rows = best_fit_decreasing(np.array([b - a for _, a, b in pieces], np.int64), length)
            lists = pa.list_(pa.int64())
            kinds = {"pack_id": pa.string(), "doc_ids": lists, "doc_starts": lists, "cu_seqlens": lists, "ids": pa.binary(), "positions": pa.binary()}
            for at in range(0, len(rows), ROWS):
                out = {n: [] for n in kinds}
                for r, items in enumerate(rows[at : at + ROWS], at):
                    own = [pieces[i] for i in items]
                    sizes = [b - a for _, a, b in own]
                    used = sum(sizes)
                    out["pack_id"].append(f"{task}-{window}-{r}")
                    out["doc_ids"].append([docs[k] for k, _, _ in own])
                    out["doc_starts"].append([a for _, a, _ in own])
                    out["cu_seqlens"].append([0, *np.cumsum(sizes).tolist()])
                    out["ids"].append(np.concatenate([*(ids[k][a:b] for k, a, b in own), np.full(length - used, pad, np.uint32)]).astype("<u4").tobytes())
                    out["positions"].append(np.concatenate([*(np.arange(s, dtype="<u4") for s in sizes), np.zeros(length - used, "<u4")]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds.items()], names=list(kinds))

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    docs.append(doc)
                    ids.append(token_ids(text, path, pattern))
                    held += len(text or "")
                    if held >= WINDOW:
                        yield from flush()
                        docs.clear()
                        ids.clear()
                        held, window = 0, window + 1
        yield from flush()

    return run


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, pattern: str | None = None, pad: int = PAD) -> DataFrame:
    """One row for each packed row: pack_id, doc_ids, doc_starts (a piece's first id in its document), cu_seqlens, ids, positions.

    A document longer than `length` is cut into pieces of `length` ids and a rest; all pieces stay. Rows hold pieces of any documents, are
    filled up with `pad`, and positions start again at 0 in each piece. ids and positions are `length` little-endian 32-bit integers.
    Packing runs where the documents are read, over windows of WINDOW code points of text, whatever the batches that bring them, so there
    is no shuffle, memory is bounded, and a lost task is simply run again. pack_id is unique; which documents share a window follows the
    input's partitions. Null or empty text: no piece. Repeated rows and null ids: packed each on its own, as given; ties in size: in order.
    Other columns are not read. An empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _pack(length, path or default_path(), pattern or default_pattern(), pad),
        "pack_id string, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<long>, ids binary, positions binary",
    )


# Binary files

#: File ending -> type of its numbers. ids and positions are matrices of `length` columns; cu and doc are rows one behind the other.
FILES = {"ids": "<u4", "positions": "<u4", "cu": "<i8", "doc": "<i8", "start": "<i8"}
NO_DOC = -(1 << 63)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class PackedWriter(DataSourceArrowWriter):
    """A set of files for each task, under names of their own attempt; the manifest, written last, names those that count. So a task that is
    run twice or lost leaves nothing that a reader sees."""

    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options.get("length", LENGTH))

    def write(self, batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out = {k: store.open_output_stream(f"{root}/{name}.{k}") for k in FILES}
        rows = segments = 0
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in ("ids", "positions"):
                for x in column[k].to_pylist():
                    out[k].write(x)
            for k, c, null in (("cu", "cu_seqlens", 0), ("doc", "doc_ids", NO_DOC), ("start", "doc_starts", 0)):
                out[k].write(column[c].flatten().fill_null(null).to_numpy(zero_copy_only=False).astype(FILES[k]).tobytes())
            rows += len(batch)
            segments += len(column["doc_ids"].flatten())
        for f in out.values():
            f.close()
        return Part(name, rows, segments)

    def commit(self, messages):
        store, root = _filesystem(self.path)
        parts = [{"name": m.name, "rows": m.rows, "segments": m.segments} for m in messages if m is not None and m.rows]
        with store.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps({"length": self.length, "parts": sorted(parts, key=lambda p: p["name"])}).encode())

    def abort(self, messages):
        store, root = _filesystem(self.path)
        for m in messages:
            for k in FILES if m is not None else ():
                store.delete_file(f"{root}/{m.name}.{k}")


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    segments: int


class PackedFiles(DataSource):
    """df.write.format("packed_ids").option("length", ...).mode("append").save(path) for the rows of packed()."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def writer(self, schema, overwrite: bool):
        return PackedWriter(dict(self.options))


def save(rows: DataFrame, path: str, length: int = LENGTH) -> None:
    """Writes the rows of packed() as binary files in a folder that all executors reach (a path or a URI that Arrow knows)."""
    rows.sparkSession.dataSource.register(PackedFiles)
    rows.write.format("packed_ids").option("length", length).mode("append").save(path)


def load(path: str):
    """The rows of saved files, part by part: doc_ids, doc_starts, cu_seqlens, ids, positions of each row."""
    store, root = _filesystem(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    for p in manifest["parts"]:
        data = {}
        for k, kind in FILES.items():
            with store.open_input_stream(f"{root}/{p['name']}.{k}") as f:
                data[k] = np.frombuffer(f.read(), kind)
        ids, positions = (data[k].reshape(p["rows"], manifest["length"]) for k in ("ids", "positions"))
        heads = np.append(np.flatnonzero(data["cu"] == 0), len(data["cu"]))  # each row's cumulative lengths begin with 0
        for r, (a, b) in enumerate(zip(heads[:-1], heads[1:], strict=True)):
            own = slice(a - r, b - r - 1)
            yield [None if x == NO_DOC else x for x in data["doc"][own].tolist()], data["start"][own].tolist(), data["cu"][a:b].tolist(), ids[r], positions[r]


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in packed rows; see packed."""
    return packed(table(spark, sf_dir, "documents"))
