"""Hard negatives: the rows most like an anchor among those of other labels that are clearly less like it than its positives.

The largest inner products are the nearest neighbours once each row x gets one more component, sqrt(M - |x|^2) with M the largest squared norm,
and each anchor a zero. In that space pivots make Voronoi cells. An anchor cell knows its radius and the scores its anchors can still use;
the triangle inequality over the pivot bounds a row's score with all of them. Cells are packed into groups of anchors, and a row is sent once
to each group that it might serve. A group's rows are dealt out in blocks by hash; each task joins its block exactly, and the best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, table, trimmed, written

ANCHORS, POSITIVES, NEGATIVES = 50, 5, 3
#: Rows of smallest hash from which pivots are taken and which give the first bounds; pivots; anchors of a group, which a task holds.
PROBES, PIVOTS, GROUP = 4096, 64, 4096
#: Rows of a block, which a task reads as a stream; at least FEWEST blocks; rows that meet the anchors at once.
BLOCK, FEWEST, AT_ONCE = 1 << 20, 32, 256
#: Sums of products below this are exact in doubles; larger ones are added as whole numbers of any size.
EXACT = 1 << 53


def _finite(e: Column) -> Column:
    return F.coalesce(~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, x, norm: rows that take part, damaged labels, components as whole numbers (doubles), squared norm."""
    e = embeddings.where(F.col("label").isNotNull() & _finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = e.select("vec_id", label.alias("label"), F.transform("embedding", lambda v: v.cast("double") * 256).alias("x"))
    return v.mapInArrow(_floored, f"vec_id {dict(v.dtypes)['vec_id']}, label {dict(v.dtypes)['label']}, x array<double>, norm double")


def _floored(batches):
    for b in batches:
        x = b.column("x")
        flat = np.floor(x.flatten().to_numpy(zero_copy_only=False))
        at = np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
        with np.errstate(over="ignore"):
            norm = np.where(np.diff(at) > 0, np.add.reduceat(np.append(flat * flat, 0), at[:-1]), 0.0) if len(b) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(norm, pa.float64())], names=["vec_id", "label", "x", "norm"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers."""
    if exact:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(x).T


class Cells:
    """What tasks know of pivots and anchor cells: a table of bounded size."""

    def __init__(self, pivots: np.ndarray, largest: float, width: int):
        self.pivots, self.largest, self.width = pivots, largest, width
        self.exact = largest < EXACT
        n = len(pivots)
        self.size, self.first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.radius, self.most, self.least = np.zeros(n), np.zeros(n), np.zeros(n)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)

    def far(self, x: np.ndarray, norm: np.ndarray | None) -> np.ndarray:
        """Distances from the pivots: of rows with their last component, of anchors (no norm) with none. In units of the largest norm."""
        if not self.exact:  # such large numbers are compared with all
            return np.zeros((len(x), len(self.pivots)))
        unit = max(np.sqrt(self.largest), 1.0)
        last = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(self.largest - norm, 0)) / unit
        y = np.column_stack([x / unit, last])
        return np.sqrt(np.maximum((y * y).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (y @ self.pivots.T), 0))

    def serves(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Rows x cells: whether a score of the row with an anchor of the cell may lie between the cell's low and high."""
        if not self.exact:
            return np.tile(self.size > 0, (len(x), 1))
        d, unit, slack = self.far(x, norm), max(self.largest, 1.0), 1e-6
        best = (self.most / unit + 1 - np.maximum(d - self.radius - slack, 0) ** 2) / 2 + slack
        worst = (self.least / unit + 1 - (d + self.radius + slack) ** 2) / 2 - slack
        return (self.size > 0) & (best >= self.low / unit) & (worst <= self.high / unit)

    def pack(self) -> None:
        """Cells in order into groups of about GROUP anchors; a larger cell is several groups, its anchors dealt by hash."""
        self.parts, group, room = np.ones(len(self.size), np.int64), -1, 0
        for c in np.argsort(-self.size, kind="stable").tolist():
            n = int(self.size[c])
            if n > GROUP:
                self.parts[c] = -(-n // GROUP)
                self.first[c] = group + 1
                group, room = group + int(self.parts[c]), 0
            elif n:
                if n > room:
                    group, room = group + 1, GROUP
                self.first[c], room = group, room - n


def _anchored(cells: Cells):
    """Anchors with their cell and distance from its pivot."""

    def run(batches):
        for b in batches:
            d = cells.far(_matrix(b.column("x"), cells.width), None) if len(b) else np.zeros((0, 1))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(b)), cell])], names=[*b.schema.names, "cell", "away"])

    return run


def _bounds(cells: Cells, probes: pa.Table, negatives: bool):
    """Anchors (for negatives with the scores of their positives) -> cell, low, high: the scores of rows that may still count. What the
    probes offer already is a bound from below."""

    def run(batches):
        y, labels, own = _matrix(probes.column("x"), cells.width), probes.column("label").to_numpy(), probes.column("gid").to_numpy()
        for b in batches:
            n = len(b)
            low, high = np.full(n, -np.inf), np.full(n, np.inf)
            for a in range(0, n, AT_ONCE) if cells.exact else ():
                few = b.slice(a, AT_ONCE)
                s = _scores(_matrix(few.column("x"), cells.width), y, True).astype(float)
                same = few.column("label").to_numpy()[:, None] == labels
                if not negatives:
                    s[~same | (few.column("gid").to_numpy()[:, None] == own)] = -np.inf
                    if s.shape[1] >= POSITIVES:
                        low[a : a + len(few)] = np.partition(s, -POSITIVES, axis=1)[:, -POSITIVES]
                    continue
                for i, p in enumerate(few.column("scores").to_pylist()):
                    p = [v for v in p if v >= 0]
                    least = np.inf
                    for v in p:
                        lo, hi = -(-v // 2), 95 * v // 100
                        hit = s[i][~same[i] & (s[i] >= lo) & (s[i] <= hi)]
                        least = min(least, np.partition(hit, -NEGATIVES)[-NEGATIVES] if len(hit) >= NEGATIVES else lo)
                    low[a + i], high[a + i] = least, max((95 * v // 100 for v in p), default=-np.inf)
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(low), pa.array(high)], names=["cell", "low", "high"])

    return run


def _sent(cells: Cells, blocks: int, anchors: bool):
    """Rows -> (group, block) of each task that needs them: an anchor all blocks of its group, a row its block of each group it may serve."""

    def run(batches):
        for b in batches:
            gid = b.column("gid").to_numpy()
            h = (gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            if anchors:
                cell = b.column("cell").to_numpy()
                group = cells.first[cell] + (h % cells.parts[cell].astype(np.uint64)).astype(np.int64)
                row, group, block = np.repeat(np.arange(len(b)), blocks), np.repeat(group, blocks), np.tile(np.arange(blocks), len(b))
            else:
                near = cells.serves(_matrix(b.column("x"), cells.width), b.column("norm").to_numpy()) if len(b) else np.zeros((0, len(cells.size)), bool)
                row, cell = np.nonzero(near)
                times = cells.parts[cell]
                row = np.repeat(row, times)
                group = np.repeat(cells.first[cell], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                pairs = np.unique(np.column_stack([row, group]), axis=0) if len(row) else np.zeros((0, 2), np.int64)  # once to each group
                row, group = pairs[:, 0], pairs[:, 1]
                block = (h[row] % np.uint64(blocks)).astype(np.int64)
            take = pa.array(row)
            names = ["gid", "vec_id", "label", "x", *(["scores"] if "scores" in b.schema.names else [])]
            yield pa.RecordBatch.from_arrays([pa.array(group * blocks + block), pa.array([not anchors] * len(row), pa.bool_()), *(b.column(c).take(take) for c in names)], names=["task", "other", *names])

    return run


def _best(key: np.ndarray, score: np.ndarray, ident: np.ndarray, gid: np.ndarray, k: int) -> np.ndarray:
    """The first k of each key: the highest scores, ties by the smaller identifier."""
    order = np.lexsort((gid, ident, -score, key))
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return order[place < k]


def _joined(cells: Cells, negatives: bool):
    """Tasks' rows, anchors before others -> for each anchor (and each of its positives) the best rows of the block."""
    k = NEGATIVES if negatives else POSITIVES
    whole = np.int64 if cells.exact else object

    def task(held: list, stream):
        q = np.concatenate([_matrix(b.column("x"), cells.width) for b in held])
        label, gid = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("label", "gid"))
        if negatives:  # one line for each positive
            lists = [p for b in held for p in b.column("scores").to_pylist()]
            line = np.repeat(np.arange(len(q)), [len(p) for p in lists])
            score = np.array([v for p in lists for v in p], whole)
            place = np.array([j for p in lists for j in range(len(p))], np.int64)
            low, high = np.where(score >= 0, -(-score // 2), 1), np.where(score >= 0, 95 * score // 100, 0)
        else:
            line = place = np.arange(len(q))
            low, high = None, None
        n = len(line)
        key, got, ident, other = np.zeros(0, np.int64), np.zeros(0, whole), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in stream:
            for a in range(0, len(b), AT_ONCE):
                few = b.slice(a, AT_ONCE)
                s = _scores(q, _matrix(few.column("x"), cells.width), cells.exact)
                fits = label[:, None] == few.column("label").to_numpy()[None, :]
                own = few.column("gid").to_numpy()
                if negatives:
                    fits = ~fits[line]
                    s = s[line]
                    fits &= (s >= low[:, None]) & (s <= high[:, None])
                else:
                    fits &= gid[:, None] != own[None, :]
                    if low is not None:
                        fits &= s >= low[:, None]
                i, j = np.nonzero(fits)
                if not len(i):
                    continue
                key, got = np.concatenate([key, i]), np.concatenate([got, s[i, j]])
                # a null identifier comes last
                ids = few.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
                ident, other = np.concatenate([ident, ids[j]]), np.concatenate([other, own[j]])
                keep = _best(key, got, ident, other, k)
                key, got, ident, other = key[keep], got[keep], ident[keep], other[keep]
                full = np.flatnonzero(np.bincount(key, minlength=n) == k)
                if len(full):  # from here on only what is as good as the last of these
                    low = np.full(n, -(1 << 62) if cells.exact else -np.inf, whole) if low is None else low
                    low[full] = got[np.searchsorted(key, full, "right") - 1]
        clip = np.array([max(min(int(v), 2**63 - 1), -(2**63)) for v in got], np.int64) if whole is object else got
        null = ident == np.iinfo(np.int64).max
        return pa.RecordBatch.from_arrays([pa.array(gid[line[key]]), pa.array(place[key].astype(np.int32)), pa.array(clip), pa.array(ident, mask=null), pa.array(other)], names=["anchor", "place", "score", "other_id", "other"])

    @trimmed
    def run(batches):
        def pieces():  # of batches: rows of one task and one side
            for b in batches:
                mark = b.column("task").to_numpy() * 2 + b.column("other").to_numpy(zero_copy_only=False)
                cut = np.flatnonzero(np.diff(mark)) + 1
                for a, z in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(b)).tolist(), strict=True):
                    if z > a:
                        yield int(mark[a]), b.slice(a, z - a)

        source = pieces()
        pending = next(source, None)
        while pending is not None:
            name, held = pending[0] // 2, []
            while pending is not None and pending[0] == name * 2:
                held.append(pending[1])
                pending = next(source, None)

            def stream():
                nonlocal pending
                while pending is not None and pending[0] == name * 2 + 1:
                    yield pending[1]
                    pending = next(source, None)

            if held:
                yield task(held, stream())
            for _ in stream():  # rows of a task without anchors
                pass

    return run


def _search(v: DataFrame, anchors: DataFrame, cells: Cells, blocks: int, negatives: bool) -> DataFrame:
    """anchor, place, score, other_id, other: the best rows of each anchor, over all blocks."""
    kinds = dict(v.dtypes)
    kind = f"task long, other boolean, gid long, vec_id {kinds['vec_id']}, label {kinds['label']}, x array<double>"
    side = anchors.mapInArrow(_sent(cells, blocks, True), kind + (", scores array<long>" if negatives else ""))
    rows = v.mapInArrow(_sent(cells, blocks, False), kind)
    both = side.unionByName(rows, allowMissingColumns=True).repartition("task").sortWithinPartitions("task", "other")
    found = both.mapInArrow(_joined(cells, negatives), "anchor long, place int, score long, other_id long, other long")
    by = ["anchor", "place"] if negatives else ["anchor"]
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (NEGATIVES if negatives else POSITIVES))


def _bound(cells: Cells, anchors: DataFrame, probes: pa.Table, negatives: bool) -> None:
    """The cells' bounds, a row a cell at the driver."""
    d = anchors.mapInArrow(_bounds(cells, probes, negatives), "cell int, low double, high double").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in d.collect():
        cells.low[r["cell"]], cells.high[r["cell"]] = r["low"], r["high"]


def mined(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of embeddings (vec_id, label, embedding).

    An anchor's positives and their negatives are those of all rows: exact, as a row is left out of a group only where the triangle
    inequality shows that no anchor there can use it. In random data of many dimensions that is seldom, and the work is anchors times rows;
    each task then holds at most GROUP anchors and reads its block as a stream. Rows with a null label or vector, or a null or non-finite
    component, take no part. Vectors of different length: the shorter counts as filled with zeros; an empty one is zero. A row with a null
    vec_id is no anchor and stands last among ties; repeated rows or identifiers are rows of their own. A score beyond 64 bits is returned as
    the largest such number (or the smallest). Other columns aren't read. No rows or no anchors: an empty result.
    """
    spark = embeddings.sparkSession
    kinds = dict(embeddings.dtypes)
    v = written(vectors(embeddings).withColumn("gid", F.monotonically_increasing_id()))
    total = v.agg(F.count("*").alias("n"), F.max("norm").alias("largest"), F.max(F.size("x")).alias("width")).first()
    schema = f"anchor_id {kinds['vec_id']}, positive_id {kinds['vec_id']}, rank int, negative_id {kinds['vec_id']}, positive_score long, negative_score long"
    if not total["n"]:
        return spark.createDataFrame([], schema)
    probes = v.select("gid", "label", "x", "norm", F.xxhash64("gid", "vec_id").alias("h")).orderBy("h", "gid").limit(PROBES).toArrow()
    width, largest = max(total["width"], 1), total["largest"]
    cut = np.unique(np.linspace(0, len(probes) - 1, min(PIVOTS, len(probes))).astype(int))
    some = probes.take(pa.array(cut))
    if largest < EXACT:
        unit = max(np.sqrt(largest), 1.0)
        pivots = np.column_stack([_matrix(some.column("x"), width) / unit, np.sqrt(np.maximum(largest - some.column("norm").to_numpy(), 0)) / unit])
    else:
        pivots = np.zeros((len(cut), width + 1))
    cells = Cells(pivots, largest, width)
    kind = f"gid long, vec_id {kinds['vec_id']}, label {dict(v.dtypes)['label']}, x array<double>"
    anchors = written(v.where(F.col("vec_id") % ANCHORS == 0).select("gid", "vec_id", "label", "x").mapInArrow(_anchored(cells), kind + ", cell int, away double"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)
    for r in anchors.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max(square).alias("most"), F.min(square).alias("least")).collect():  # a row a cell
        cells.size[r["cell"]], cells.radius[r["cell"]], cells.most[r["cell"]], cells.least[r["cell"]] = r["n"], r["away"], r["most"], r["least"]
    cells.pack()
    blocks = max(FEWEST, -(-total["n"] // BLOCK))
    _bound(cells, anchors, probes, False)
    positives = written(_search(v, anchors, cells, blocks, False))
    best = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select(F.col("anchor").alias("gid"), F.transform("p", lambda x: x["score"]).alias("scores"))
    asking = written(anchors.join(best, "gid"))
    _bound(cells, asking, probes, True)
    negatives = written(_search(v, asking, cells, blocks, True))
    n = negatives.select("anchor", (F.col("place") + 1).alias("of"), F.col("rank").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    p = positives.select("anchor", F.col("rank").alias("of"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("gid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    discard(asking)
    return n.join(p, ["anchor", "of"]).join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor among all vectors; see mined."""
    return mined(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
 n AS (SELECT p.a, p.b AS positive, p.score AS positive_score, s.b AS negative, s.score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
 SELECT a AS anchor_id, positive AS positive_id, r::INTEGER AS rank, negative AS negative_id, positive_score, score AS negative_score FROM n WHERE r <= 3"""
