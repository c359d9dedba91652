"""Byte-level BPE: each distinct pre-token is encoded once for the whole table, then joined back and put in order."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import hashes, slices, table, text_bytes, trimmed

#: Text bytes whose pre-tokens form one block: a word leaves it once, however often it occurs, so no word is hot. Text split at a time.
BLOCK_BYTES, SPLIT_BYTES = 16 << 20, 1 << 20
#: Distinct words whose ids a task keeps.
KNOWN = 1 << 20
#: zstd level of the blobs that are shuffled.
LEVEL = 9


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes by id, one after another, and their offsets: a table of fixed size."""
    ranks = _ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in by_id])))


def varint(values: np.ndarray) -> np.ndarray:
    """LEB128 bytes of non-negative integers, all at once."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= np.uint64(1 << (7 * k))
    out, at = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    for k in range(5):
        has = size > k
        out[at[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unvarint(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        has = first + k <= last
        out[has] |= (data[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _pack(*parts: np.ndarray) -> bytes:
    """Arrays of bytes in one compressed blob, behind their sizes."""
    raw = np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 + 8 * n].view(np.int64)
    ends = 8 + 8 * n + np.concatenate(([0], np.cumsum(sizes)))
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _spread(heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """heads[0], heads[0]+1, ... (sizes[0] of them), heads[1], ..."""
    return np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _explode(pattern: str, buckets: int):
    """Documents -> for each block one row with the word number at each position, and one for each bucket with its distinct words. Each row
    names its partition: that of its bucket, or for positions any."""

    @trimmed
    def run(batches):
        from pyspark import TaskContext

        find, task, number = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in slices(batch, "text", BLOCK_BYTES):
                counts, chunks = [], []
                for part in slices(block, "text", SPLIT_BYTES):
                    found = [find(t) if t else () for t in part.column("text").to_pylist()]
                    counts += [len(x) for x in found]
                    chunks.append(pa.array([w for x in found for w in x], pa.string()).dictionary_encode())
                whole = pa.chunked_array(chunks, chunks[0].type).unify_dictionaries()
                words_of = whole.chunk(whole.num_chunks - 1).dictionary
                codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks]).astype(np.int64)
                # frequent words get small numbers
                by = np.argsort(-np.bincount(codes, minlength=len(words_of)), kind="stable")
                rank = np.zeros(len(by), np.int64)
                rank[by] = np.arange(len(by))
                words_of = words_of.take(pa.array(by))
                data, offsets = text_bytes(words_of)
                bucket = (hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
                name = (task << 32) | number
                who = np.array([block.column("doc_id").is_null().to_numpy(zero_copy_only=False), block.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), counts], np.int64)
                rows = [((task + number) % buckets, name, True, _pack(who.view(np.uint8).ravel(), varint(rank[codes])[0]))]
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                size = np.diff(offsets)
                for k in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[k] : cuts[k + 1]]
                    rows.append((k, name, False, _pack(varint(np.diff(own, prepend=0))[0], varint(size[own])[0], data[_spread(offsets[own], size[own])])))
                number += 1
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "block", "places", "blob"])

    return run


def _encode(path: str, pattern: str):
    """One bucket's words of all blocks -> their ids, batch by batch, so none is too large for memory. Each distinct word is encoded once
    (again only if the bucket has more than KNOWN). A block's positions pass as they are."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, known = _encoding(path, pattern)._encode_single_piece, {}
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for block, places, blob in zip(*(column[c].to_pylist() for c in ("block", "places", "blob")), strict=True):
                if not places:
                    own, sizes, data = _unpack(blob)
                    ends, raw, got = np.cumsum(unvarint(sizes)).tolist(), data.tobytes(), []
                    for a, b in zip([0, *ends[:-1]], ends, strict=True):
                        ids = known.get(w := raw[a:b])
                        if ids is None:
                            if len(known) >= KNOWN:
                                known.clear()
                            ids = known[w] = piece(w)
                        got.append(ids)
                    blob = _pack(own, varint(np.array([len(x) for x in got], np.int64))[0], varint(np.array([i for x in got for i in x], np.int64))[0])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([places], pa.bool_()), pa.array([blob], pa.binary())], names=["block", "places", "blob"])

    return run


def _assemble(path: str, digest: bool):
    """A block's positions and the ids of its words -> its documents' ids, in order, and their bytes again."""

    def run(t: pa.Table) -> pa.Table:
        code, who, own, sizes, ids = None, None, [], [], []
        for places, blob in zip(t.column("places").to_pylist(), t.column("blob").to_pylist(), strict=True):
            parts = _unpack(blob)
            if places:
                who, code = parts[0].view(np.int64).reshape(3, -1), unvarint(parts[1])
            else:
                own.append(np.cumsum(unvarint(parts[0])))
                sizes.append(unvarint(parts[1]))
                ids.append(unvarint(parts[2]))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        number, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (own, sizes))
        size_of, head_of = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        size_of[number], head_of[number] = count, np.cumsum(count) - count
        n_ids = size_of[code]
        out = flat[_spread(head_of[code], n_ids)]
        ends = np.concatenate(([0], np.cumsum(n_ids)))[np.concatenate(([0], np.cumsum(who[2])))]
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        # decoding: ids joined with the token-byte table
        table_bytes, at = _token_bytes(path)
        raw = out.astype("<u4")

        def text(a: int, b: int) -> bytes:
            i = out[a:b]
            return table_bytes[_spread(at[i], at[i + 1] - at[i])].tobytes()

        columns = {"doc_id": pa.array(who[1], pa.int64(), mask=who[0].astype(bool)), "n_tokens": pa.array(np.diff(ends), pa.int64())}
        if digest:
            columns |= {"ids_sha256": pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(text(a, b)).hexdigest() for a, b in spans], pa.string())}
        else:
            columns |= {"ids": pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()), "decoded": pa.array([text(a, b) for a, b in spans], pa.binary())}
        return pa.table(columns)

    return run


def encoded(docs: DataFrame, digest: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and ids (little-endian 32-bit) with decoded bytes, or with digest=True the SHA-256 of both.

    Pre-tokens are exploded with their positions in blocks of documents. A block's positions are a list of word numbers; its distinct words
    go to buckets by hash, where the words of all blocks meet and each is encoded once; the ids join the block's positions again and are
    put in order. A word leaves a block once however often it occurs, so a word that is a third of all text is not a hot key; the dictionary
    is never broadcast, as it grows with the data. Two shuffles, both of few compressed rows; a lost task is simply run again.
    Texts of any length: split and joined in blocks, a longer text is a block of its own. Ties don't arise; other columns are not read.
    Null text: as empty, no tokens. Null or repeated doc_id: a row each, as given. An empty table gives an empty result.
    The tokenizer file must be readable on the executors at the same path.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = docs.select("doc_id", "text").mapInArrow(_explode(pattern, buckets), "part int, block long, places boolean, blob binary")
    words_in = exploded.repartitionById(buckets, "part").mapInArrow(_encode(path, pattern), "block long, places boolean, blob binary")
    kind = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    return words_in.groupBy("block").applyInArrow(_assemble(path, digest), f"doc_id long, n_tokens long, {kind}")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes as digests; see encoded."""
    return encoded(table(spark, sf_dir, "documents"), digest=True)
