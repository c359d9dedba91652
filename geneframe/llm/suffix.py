"""Removal of byte strings that occur twice: fingerprints gather candidates, external induced sorting of their suffixes decides."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, discard, mix, slices, table, text_bytes, trimmed, written

#: Length of a repeated string, and of the substring whose fingerprint stands for it.
LENGTH, GRAM = 200, 48
#: Bytes of distinct candidate text that one task sorts, and bytes of a queue, or of an array that lasts, that it holds in memory before it
#: goes to disk.
SHARD_BYTES, QUEUE_BYTES = 3 << 20, 4 << 20
#: Sorted suffixes that are looked at together.
RUN = 1 << 16
#: Starts that are winnowed at once.
STARTS = 1 << 18
#: A gram with over one in HOT of the repeated grams' places is dealt to SALTS tasks. There are fewer than HOT, so they are broadcast.
HOT, SALTS = 1_000, 64
#: How a shard is sorted: see suffix_order.
SORT: dict[str, int] = {"memory": 1 << 22, "limit": QUEUE_BYTES}


# Sorting of suffixes


class BucketQueue:
    """A monotone priority queue of suffix tuples (position, common prefix with the one before). The key is the first symbol, then the order
    of arrival. What exceeds the memory limit goes to an unnamed file that ends with the task."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.chunks: dict[int, list] = {}
        self.limit, self.held, self.file = limit, 0, None

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.chunks.setdefault(key, []).append((at, len(pos)))
        else:
            self.held += size
            self.chunks.setdefault(key, []).append((pos, lcp))

    def pop(self, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """What has come for the key so far, as one run; nothing if nothing has."""
        out = []
        for a, b in self.chunks.pop(key, ()):
            if isinstance(a, int):
                self.file.seek(a)
                out.append((np.frombuffer(self.file.read(4 * b), np.int32), np.frombuffer(self.file.read(2 * b), np.int16)))
            else:
                self.held -= a.nbytes + b.nbytes
                out.append((a, b))
        return [tuple(np.concatenate(x) for x in zip(*out, strict=True))] if out else []


def _held(a: np.ndarray, limit: int) -> np.ndarray:
    """a, or if it is larger than the limit the same from an unnamed file, mapped into memory as far as it is looked at."""
    if a.nbytes <= limit:
        return a
    f = tempfile.TemporaryFile()
    a.tofile(f)
    f.flush()
    return np.asarray(np.memmap(f, a.dtype, "r", shape=a.shape))


def _chunk_keys(t: np.ndarray) -> tuple[np.ndarray, int]:
    """For each position the next symbols as one integer, most significant first, and how many fit: 8, 4 or 1. Positions after the end are 0."""
    width = 8 if t.max() < 1 << 8 else 4 if t.max() < 1 << 16 else 1
    pad, n = np.concatenate((t, np.zeros(width, t.dtype))).astype(np.uint64), len(t)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out |= pad[k : n + k] << np.uint64(64 // width * (width - 1 - k))
    return out, width


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, keys: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, `most` at most. The text's end differs from everything."""
    n, out, live, at = len(t), np.zeros(len(a), np.int64), np.arange(len(a)), 0
    if keys is not None:
        x, width = keys
        while at + width <= most and len(live):
            live = live[np.maximum(a[live], b[live]) + at + width <= n]
            live = live[x[a[live] + at] == x[b[live] + at]]
            at += width
            out[live] = at
    live = np.arange(len(a)) if keys is None else np.flatnonzero(out < most)
    for _ in range(most):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[t[x] == t[y]]
        if not len(live):
            break
        out[live] += 1
        live = live[out[live] < most]
    return out


def _doubled(names: np.ndarray, steps: int) -> np.ndarray:
    """The recursion's base in memory: suffix order of a string of names by prefix doubling, up to 2**steps names deep. A round sorts only
    what is still tied."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    places, h = np.arange(n), 1
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    for _ in range(steps):
        sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
        tied = np.repeat(sizes > 1, sizes)
        places = places[tied]
        if not len(places):
            break
        own = order[places]
        first, second = rank[own], rank[np.minimum(own + h, n)]
        by = np.lexsort((second, first))
        own, first, second = own[by], first[by], second[by]
        order[places] = own
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[own] = places[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        h *= 2
    return order


def suffix_order(t: np.ndarray, depth: int = LENGTH, memory: int = 1 << 22, limit: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the symbols t and each entry's common prefix with the one before, up to `depth` symbols (deeper ties in any order)."""
    if len(t) < 2:
        return np.arange(len(t)), np.zeros(len(t), np.int64)
    pos, lcp = (np.concatenate(x)[::-1] for x in zip(*suffix_runs(t, depth, memory, limit), strict=True))
    return pos, np.concatenate(([0], lcp[:-1])).astype(np.int64)


def suffix_runs(t: np.ndarray, depth: int = LENGTH, memory: int = 1 << 22, limit: int = QUEUE_BYTES):
    """The suffixes of the symbols t (two at least) from the largest to the smallest, in runs: positions, and the common prefix of each with
    the one given before it, up to `depth` symbols (deeper ties in any order).

    Induced sorting as in eSAIS (Bingmann, Fischer, Osipov, 2013): the S*-substrings are sorted and named; the string of names is sorted by
    recursion (in memory by doubling, once it has `memory` names at most); then queues, scanned by first symbol, induce the L-suffixes from
    the S*-suffixes and the S-suffixes from the L-suffixes, and carry the common prefixes along: that of two induced suffixes is one more
    than the least between their sources. A queue takes and gives whole runs of tuples, so all steps work on arrays. Queues, the sorted
    L-suffixes, the text, its types and the sorted S*-suffixes go to disk where they are over `limit` bytes; the result is never held. The
    working arrays of naming are in memory: a few numbers for each S*-suffix, of which there is one for two symbols at most.
    """
    n = len(t)
    t = _held(t.astype(np.int32) + np.int32(1), limit)  # 0 is the end; positions are 32-bit, a shard is far smaller
    # S (True) or L: by the next symbol that differs; the end is the smallest
    differs = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))
    after = differs[np.searchsorted(differs, np.arange(n))]
    follow = np.concatenate((t, [0]))
    small = _held(follow[after + 1] > t, limit)
    star = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    del differs, after, follow
    symbol_kind = np.uint16 if t.max() < 1 << 16 else np.int32  # 16-bit keys are sorted by radix
    if len(star):
        ends = np.concatenate((star[1:] + 1, [n]))
        typed = 2 * t + small  # of equal symbols, an L-suffix is the smaller
        wide = typed.max() < 1 << 16
        keys = _chunk_keys(np.append(typed, 1 << 15))[0][:-1] if wide else typed.astype(np.uint64)
        step, at = (4 if wide else 1), 0
        rank = np.zeros(len(star), np.int64)
        live = np.arange(len(star))
        while len(live):
            pos = star[live] + at
            inside = pos < ends[live]
            k = np.where(inside, keys[np.minimum(pos, n - 1)], 0)
            if wide:  # symbols past the substring's end don't count
                left = np.clip(ends[live] - pos, 0, 4)
                k &= np.array([0, 0xFFFF << 48, 0xFFFFFFFF << 32, 0xFFFFFFFFFFFF << 16, 0xFFFFFFFFFFFFFFFF], np.uint64)[left]
            order = np.lexsort((k, rank[live]))
            a, b = rank[live][order], k[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.concatenate(([True], a[1:] != a[:-1]))
            heads = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
            offset = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) - heads
            rank[live[order]] = a + offset
            at += step
            sizes = np.diff(np.append(np.flatnonzero(new), len(a)))
            tied = np.repeat(sizes > 1, sizes)
            live = live[order][tied]
            live = live[star[live] + at <= ends[live]]
            if at >= depth:
                break
        names = np.unique(rank, return_inverse=True)[1]
        if names.max() + 1 == len(star):
            by = np.argsort(names, kind="stable")
        elif len(star) <= memory:
            by = _doubled(names, max(1, int(np.ceil(np.log2(depth)))))
        else:
            by = suffix_order(names, depth, memory, limit)[0]
        del rank, names, ends, typed, keys
        star = star[by]
        star_lcp = _held(np.concatenate(([0], _common(t, star[:-1], star[1:], depth, _chunk_keys(t)))).astype(np.int16), limit)
        star = _held(star, limit)
    else:
        star_lcp = np.zeros(0, np.int16)
    symbols = np.unique(t)
    far = np.int16(depth)

    def induce(queue, least, pos, lcp, want):
        """Pushes the predecessors of a run of scanned suffixes that `want` takes, by their symbol."""
        if not len(pos):
            return
        prev = pos - 1
        ok = prev >= 0
        idx = np.flatnonzero(ok)
        idx = idx[want(prev[idx], t[pos[idx]])]
        c = t[prev[idx]].astype(symbol_kind)
        by = np.argsort(c, kind="stable")
        idx, c = idx[by], c[by]
        cuts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else []
        whole = lcp.min()
        before = dict(least)
        for k in least:
            least[k] = min(least[k], whole)
        for a, b in zip(cuts, [*cuts[1:], len(c)][: len(cuts)], strict=True):
            d, i = int(c[a]), idx[a:b]
            starts = np.concatenate(([0], i[:-1] + 1))
            got = np.minimum.reduceat(lcp, starts)
            if len(starts) > 1:  # reduceat's last part reaches the end of the run
                got[-1] = lcp[starts[-1] : i[-1] + 1].min()
            else:
                got[0] = lcp[: i[0] + 1].min()
            got[0] = min(got[0], before[d]) if d in before else -1
            queue.push(d, prev[i], np.minimum(got + 1, far).astype(np.int16))
            least[d] = lcp[i[-1] + 1 :].min(initial=far)

    queue, least = BucketQueue(limit), {}
    # the last suffix is L-type and follows the end, which is scanned first
    queue.push(int(t[-1]), np.array([n - 1], np.int32), np.zeros(1, np.int16))
    least[int(t[-1])] = np.int16(0)
    heads = np.searchsorted(t[star], symbols) if len(star) else np.zeros(len(symbols), int)
    tails = np.searchsorted(t[star], symbols, "right") if len(star) else heads
    larges = BucketQueue(limit)
    takes_l = lambda p, c: ~small[p]
    for s, symbol in enumerate(symbols.tolist()):
        got, last = [], None
        while True:
            fresh = queue.pop(symbol)
            if not fresh:
                break
            for pos, lcp in fresh:
                lcp = lcp.copy()
                if last is None:
                    lcp[0] = 0
                got.append((pos, lcp))
                last = int(pos[-1])
                induce(queue, least, pos, lcp, takes_l)
        for pos, lcp in got:
            larges.push(symbol, pos, lcp)
        own, own_lcp = star[heads[s] : tails[s]], star_lcp[heads[s] : tails[s]].copy()
        if len(own):
            own_lcp[0] = _common(t, np.array([last]), own[:1], depth)[0] if last is not None else 0
            induce(queue, least, own, own_lcp, takes_l)
    # S-suffixes from the largest down; in a scan from the right, lcp is with the suffix scanned before
    queue, least = BucketQueue(limit), {}
    takes_s = lambda p, c: small[p]
    for symbol in symbols[::-1].tolist():
        last = None
        while True:
            fresh = queue.pop(symbol)
            if not fresh:
                break
            for pos, lcp in fresh:
                lcp = lcp.copy()
                if last is None:
                    lcp[0] = 0
                yield pos, lcp
                last = int(pos[-1])
                induce(queue, least, pos, lcp, takes_s)
        for pos, lcp in larges.pop(symbol):
            down, down_lcp = pos[::-1], np.concatenate(([0], lcp[:0:-1])).astype(np.int16)
            down_lcp[0] = _common(t, np.array([last]), down[:1], depth)[0] if last is not None else 0
            yield down, down_lcp
            induce(queue, least, down, down_lcp, takes_s)


def repeated_starts(t: np.ndarray, sizes: np.ndarray, several: np.ndarray, length: int = LENGTH, **options) -> np.ndarray:
    """Which starts of `length` symbols occur at another place. t: strings one behind the other, each with a 0 at its end; sizes: of each with
    its 0. Suffixes never run on into the next string. A string with several places stands for all of them: its suffixes count twice."""
    again = np.zeros(len(t), bool)
    if len(t) < 2:
        return again
    starts = np.concatenate(([0], np.cumsum(sizes)))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, need = 0, RUN

    def settle(last: bool):
        """Runs of suffixes that share `length` symbols; a run repeats if it stands for two places or more. The last run may go on."""
        pos, lcp = (np.concatenate(x) for x in zip(*held, strict=True))
        row = np.searchsorted(starts, pos, "right") - 1
        full = starts[row + 1] - 1 - pos >= length
        heads = np.flatnonzero(~((lcp >= length) & full))  # equal symbols, so the one before is full as well
        heads = heads if len(heads) and heads[0] == 0 else np.concatenate(([0], heads))
        places = np.add.reduceat(several[row].astype(np.int64) + 1, heads)
        stop = len(pos) if last else int(heads[-1])
        places = np.repeat(places, np.diff(np.append(heads, len(pos))))
        again[pos[:stop][(full & (places > 1))[:stop]]] = True
        return [(pos[stop:], lcp[stop:])] if stop < len(pos) else []

    for pos, lcp in suffix_runs(t, length, **options):
        held.append((pos, lcp))
        waiting += len(pos)
        if waiting >= need:
            held = settle(False)
            waiting, need = 0, max(RUN, sum(len(p) for p, _ in held))  # a run that goes on doubles before it is looked at again
    if held:
        settle(True)
    return again


# Candidates


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return np.minimum(key[: len(key) - (width - span)], key[width - span :]) if width > span else key


def _selected(data: np.ndarray, offsets: np.ndarray, roll: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing of texts that lie one behind the other (fewer than 2**24 bytes): the gram that stands for each start of LENGTH bytes (the
    least hash in it, the last of equals), as runs of starts of one text with the same gram: first start, one past the last, gram, text.
    Equal strings choose the same gram at the same place in them."""
    n, mask = len(data) - LENGTH + 1, np.uint64((1 << 24) - 1)
    key = roll.every(GRAM)
    key &= ~mask
    key |= mask - np.arange(len(key), dtype=np.uint64)
    least = _least(key, LENGTH - GRAM + 1)
    first, end = np.clip(offsets[:-1], 0, n), np.clip(offsets[1:] - LENGTH + 1, 0, n)
    has = first < end
    new = np.ones(n + 1, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:n])
    new[first[has]] = new[end[has]] = True
    heads = np.flatnonzero(new[:n])
    ends = np.append(heads[1:], n)
    rows = np.searchsorted(offsets, heads, "right") - 1
    ok = heads < end[rows]
    heads, ends, rows = heads[ok], ends[ok], rows[ok]
    return heads, ends, (mask - (least[heads] & mask)).astype(np.int64), rows


def _winnow(with_places: bool):
    @trimmed
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                out = [[], [], [], [], []]
                for at in range(0, max(0, len(data) - LENGTH + 1), STARTS):  # a longer text is cut between two starts, so memory is bounded
                    own = data[at : at + STARTS + LENGTH - 1]
                    roll = Rolling(own)
                    a, b, g, rows = _selected(own, offsets - at, roll)
                    out[0].append(roll.of(g, g + GRAM))
                    if with_places:
                        out[1].append(mix(roll.of(a, b + LENGTH - 1) + (g - a).astype(np.uint64)))
                        out[2].append(rows)
                        out[3].append(a + at - offsets[rows])
                        out[4].append(b - a + LENGTH - 1)
                flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
                columns = [pa.array(flat[0].astype(np.uint64).view(np.int64))]
                if with_places:
                    columns += [pa.array(flat[1].astype(np.uint64).view(np.int64)), part.column("node").take(pa.array(flat[2])), pa.array(flat[3].astype(np.int32)), pa.array(flat[4].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "region", "node", "a", "size"][: len(columns)])

    return run


@trimmed
def _cut(batches):
    """Texts with the regions that they stand for -> the regions' bytes, and whether the region has several places."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = {n: [] for n in ("shard", "fp", "region", "bytes", "several")}
            for text, regions in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("regions").to_pylist(), strict=True):
                for r in regions:
                    for n in ("shard", "fp", "region"):
                        rows[n].append(r[n])
                    rows["bytes"].append(text[r["a"] : r["a"] + r["size"]])
                    rows["several"].append(r["n"] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int64()), pa.array(rows["fp"], pa.int64()), pa.array(rows["region"], pa.int64()), pa.array(rows["bytes"], pa.binary()), pa.array(rows["several"], pa.bool_())], names=list(rows))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sort(options: dict[str, int]):
    """A shard's regions, which come batch by batch and go to a file -> for each the runs of starts that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = tempfile.TemporaryFile()
        sizes, several, keys = [], [], []
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("bytes")))
            own = np.diff(offsets)
            out = np.zeros(len(data) + len(own), np.int16)
            out[np.arange(len(data)) + np.repeat(np.arange(len(own)), own)] = data.astype(np.int16) + 1
            out.tofile(f)
            sizes.append(own + 1)
            several.append(batch.column(batch.schema.get_field_index("several")).to_numpy(zero_copy_only=False))
            keys.append(batch.select(["fp", "region"]))
        f.flush()
        sizes = np.concatenate(sizes)
        again = repeated_starts(np.asarray(np.memmap(f, np.int16, "r", shape=(int(sizes.sum()),))), sizes, np.concatenate(several), **options)
        at = 0
        ends = np.cumsum(sizes)
        for batch in keys:
            runs = [_runs(again[ends[at + i] - sizes[at + i] : ends[at + i]]) for i in range(len(batch))]
            at += len(batch)
            keep = [i for i, r in enumerate(runs) if r]
            column = pa.array([[{"s": a, "e": b} for a, b in runs[i]] for i in keep], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("fp", "region")), column], names=["fp", "region", "runs"])

    return run


@trimmed
def _starts(batches):
    """Texts with regions of grams that are too large for a shard -> each start of the regions, with a hash of its LENGTH bytes."""
    for batch in batches:
        for part in slices(batch, "text"):
            for text, regions in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("regions").to_pylist(), strict=True):
                for at in range(0, len(regions), 1000):
                    rows = {n: [] for n in ("fp", "region", "s", "start", "n")}
                    for r in regions[at : at + 1000]:
                        size = r["size"] - LENGTH + 1
                        for name, values in (("fp", [r["fp"]] * size), ("region", [r["region"]] * size), ("s", range(size)), ("n", [r["n"]] * size)):
                            rows[name] += values
                        rows["start"] += [hashlib.md5(text[a : a + LENGTH], usedforsecurity=False).digest() for a in range(r["a"], r["a"] + size)]
                    kinds = {"fp": pa.int64(), "region": pa.int64(), "s": pa.int32(), "start": pa.binary(), "n": pa.int64()}
                    yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in kinds.items()], names=list(kinds))


def _folded(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """fp, region, runs of the starts that repeat, for regions of any number: starts are counted by the hash of all their bytes.

    Counts are added up before they are dealt out. Starts of over one in HOT of all places are fewer than HOT, so they are broadcast.
    """
    wanted = regions.select(F.col("at.node").alias("node"), F.struct("fp", "region", F.col("at.a").alias("a"), "size", "n").alias("r"))
    wanted = wanted.groupBy("node").agg(F.collect_list("r").alias("regions"))
    one = texts.join(written(wanted), "node").groupBy("node").agg(F.any_value("text").alias("text"), F.any_value("regions").alias("regions"))
    starts = written(one.select("text", "regions").mapInArrow(_starts, "fp long, region long, s int, start binary, n long"))
    again = written(starts.groupBy("start").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where("all > 1"))
    most = (again.agg(F.sum("rows")).first()[0] or 0) // HOT
    hot = F.broadcast(again.where(F.col("rows") > most).select("start"))
    rest = starts.join(hot, "start", "left_anti").join(again.where(F.col("rows") <= most).select("start"), "start", "left_semi")
    every = F.array_sort(F.collect_list("s"))
    found = starts.join(hot, "start", "left_semi").unionByName(rest).groupBy("fp", "region").agg(every.alias("x"))
    x = F.col("x")
    first, last = F.filter(x, lambda v: ~F.array_contains(x, v - 1)), F.filter(x, lambda v: ~F.array_contains(x, v + 1))
    return found.select("fp", "region", F.zip_with(first, last, lambda a, b: F.struct(a.alias("s"), (b + 1).alias("e"))).alias("runs"))


@trimmed
def _strip(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for text, spans in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
                text = text or b""
                merged: list[list[int]] = []
                for a, b in sorted((s["s"], s["e"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                ends = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(merged), kept))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), pa.array([x[3] for x in out], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def stripped(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of each document of docs (doc_id, text).

    1. Copies of a text are known by its hash: it is sorted once, with the number of its copies.
    2. Winnowing cuts each text into regions of starts that share a gram. Equal strings of LENGTH bytes share it, so only regions whose
       gram occurs twice can hold a repeat. Of equal regions one is kept, with the note that there are several.
    3. Distinct regions are dealt into shards by gram, about SHARD_BYTES each, and the suffixes of each shard are sorted by induced sorting,
       a region's suffixes with its number of places; starts that share LENGTH bytes with another place repeat. A gram whose regions
       alone exceed SHARD_BYTES isn't gathered in a shard: its starts are counted one by one, by a hash of all their LENGTH bytes.
    4. The starts go back to all places of the region, and from there to the texts.
    Null text: as empty. Under LENGTH bytes: nothing is removed. Repeated rows are copies. Nothing is sampled or capped.
    """
    docs = docs.select("doc_id", "text").withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    texts = docs.select("node", "text").where(F.octet_length("text") >= LENGTH)
    twice = written(texts.select("node", "text").mapInArrow(_winnow(False), "fp long").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"))
    most = (twice.agg(F.sum("n")).first()[0] or 0) // HOT
    salts = F.when(F.col("n") > most, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hot = F.broadcast(twice.where(F.col("n") > most).select("fp", F.lit(True).alias("hot")))
    places = texts.mapInArrow(_winnow(True), "fp long, region long, node binary, a int, size int").join(hot, "fp", "left")
    places = places.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node", "a"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    places = places.join(twice.select("fp", F.explode(salts).alias("salt")), ["fp", "salt"], "left_semi")
    places = written(places.groupBy("fp", "region", "node", "a", "size").agg(F.count("*").alias("c")))  # c: copies of the text
    regions = places.groupBy("fp", "region", "size").agg(F.sum("c").alias("n"), F.min(F.struct("node", "a")).alias("at"))
    # written before it is joined, so that the join's sides are plain shuffles and Spark can split a gram with many regions
    more = written(regions.groupBy("fp").agg(F.sum("n").alias("all")).where("all > 1").select("fp"))
    regions = every = written(regions.join(more, "fp", "left_semi"))
    large = written(regions.groupBy("fp").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > SHARD_BYTES).select("fp"))
    folded = None
    if not large.isEmpty():
        folded = written(_folded(texts, regions.join(F.broadcast(large), "fp", "left_semi")))
        regions = regions.join(F.broadcast(large), "fp", "left_anti")
    total = regions.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard")
    asked = regions.select(F.col("at.node").alias("node"), F.struct(shard, "fp", "region", F.col("at.a").alias("a"), "size", "n").alias("r")).groupBy("node").agg(F.collect_list("r").alias("regions"))
    asked = written(asked)
    one = texts.join(asked, "node").groupBy("node").agg(F.any_value("text").alias("text"), F.any_value("regions").alias("regions"))
    pieces = one.select("text", "regions").mapInArrow(_cut, "shard long, fp long, region long, bytes binary, several boolean")
    found = written(pieces.groupBy("shard").applyInArrow(_sort(dict(SORT)), "fp long, region long, runs array<struct<s:int,e:int>>"))
    done = [twice, more, every, large, asked, places, found, *([] if folded is None else [folded])]
    found = found if folded is None else found.unionByName(folded)
    hits = places.join(found, ["fp", "region"]).select("node", F.explode(F.transform("runs", lambda r: F.struct((F.col("a") + r["s"]).alias("s"), (F.col("a") + r["e"] + LENGTH - 1).alias("e")))).alias("span"))
    spans = hits.groupBy("node").agg(F.collect_list("span").alias("spans"))
    info = written(spans)
    discard(*done)
    joined = docs.join(info, "node", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that occur elsewhere; see stripped."""
    d = stripped(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
