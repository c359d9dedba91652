"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative of each group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, table, trimmed, written

COSINE = 0.93
#: k-means is fitted on at most SAMPLE vectors (those of smallest hash) and has a cell for each PER_CELL vectors of the most frequent label,
#: MOST_CELLS at most. Only vectors of one label are compared, so cells that are finer than that add copies and save nothing.
SAMPLE, PER_CELL, MOST_CELLS, ROUNDS = 20_000, 1_000, 4_096, 8
#: Vectors of a cell that are compared in one task with as many others; a larger cell is compared block by block.
BLOCK = 8_192
_SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by Lloyd's rounds on unit vectors. Starts from evenly spaced rows; a cell that is empty keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c[norm > 1e-12] = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    return np.unique(c, axis=0)


def _assign(centroids):
    """Each vector to its cell, and to every cell that may hold a vector linked with it.

    The vectors nearer to centroid d than to c lie beyond a hyperplane through the origin; a vector at angle b from it is at least b from
    each of them. So a vector whose sine to the hyperplane is over sin(acos(COSINE)) has no link beyond, and no link is lost.
    """
    reach = math.sqrt(1 - COSINE * COSINE) + _SLACK

    def run(batches):
        c = centroids.value
        gaps = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-300))
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(_matrix(batch.column("embedding")))
            if x.shape[1] != c.shape[1]:
                home, near = np.zeros(len(x), int), np.zeros((len(x), 1), bool)
            else:
                s = x @ c.T
                home = np.argmax(s, axis=1)
                near = (s[np.arange(len(x)), home][:, None] - s) <= reach * gaps[home]
            near[np.arange(len(x)), home] = True
            row, cell = np.nonzero(near)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(n).take(take) for n in ("label", "gid", "n", "embedding")] + [pa.array(cell.astype(np.int32)), pa.array(cell == home[row])], names=["label", "gid", "n", "embedding", "cell", "home"])

    return run


def _compare(t: pa.Table) -> pa.Table:
    """Rows of side h (one block), o (another) or b (both): links of those of h and b among those of o and b, and what links join."""
    gid, n, side = t.column("gid").to_numpy(), t.column("n").to_numpy(), np.array(t.column("side").to_pylist())
    order = np.argsort(gid, kind="stable")
    gid, n, side = gid[order], n[order], side[order]
    x = _unit(_matrix(t.column("embedding"))[order])
    homes, others = np.flatnonzero(side != "o"), np.flatnonzero(side != "h")
    links, group = np.zeros(len(gid), np.int64), np.arange(len(gid))
    y = x[others]
    for a in range(0, len(homes), 512):
        rows = homes[a : a + 512]
        hit = (x[rows] @ y.T) >= COSINE
        hit &= rows[:, None] != others[None, :]
        links[rows] = hit @ n[others]
        for r, h in zip(rows[hit.any(axis=1)], hit[hit.any(axis=1)], strict=True):
            met = np.unique(np.append(group[others[h]], group[r]))
            if len(met) > 1:
                group[np.isin(group, met)] = met[0]
    out = np.flatnonzero((side != "o") | (group != np.arange(len(gid))))
    return pa.table({"gid": pa.array(gid[out]), "links": pa.array(np.where(side[out] != "o", links[out], 0)), "to": pa.array(gid[group[out]])})


def _valid(label: Column, e: Column, vec_id: Column) -> Column:
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return label.isNotNull() & e.isNotNull() & vec_id.isNotNull() & F.coalesce(~F.exists(e, odd) & F.exists(e, lambda v: v != 0), F.lit(False))


def linked(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Two vectors of one label link if their cosine, in double precision, is COSINE or more. Equal vectors are compared once and counted as
    often as they occur. Cells, labels and lengths never split a link: see _assign. A vector without label or vec_id, null, zero, or with
    a null or non-finite component has no link and is a component of its own; vectors of unequal length have no link. Rows that repeat a
    vec_id are vectors of their own, each with its own links. Equal vectors are linked. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", "label", "embedding")
    ok = _valid(F.col("label"), F.col("embedding"), F.col("vec_id"))
    keys = [F.when(ok, F.xxhash64("embedding")).alias("k1"), F.when(ok, F.xxhash64(F.reverse("embedding"))).alias("k2"), F.when(ok, F.size("embedding")).alias("dim")]
    v = written(v.select("vec_id", "label", "embedding", *keys))
    by = ["label", "dim", "k1", "k2"]
    # gid is the group's own number, fixed by writing it: a vec_id may stand for several vectors
    groups = v.where("k1 is not null").groupBy(*by).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    groups = written(groups.withColumn("gid", F.monotonically_increasing_id()))
    edges, counts, done = [], [], []
    for dim in sorted(r[0] for r in groups.select("dim").distinct().collect()):
        own = groups.where(F.col("dim") == dim).select("label", "gid", "n", "embedding")
        size = own.groupBy("label").count().agg(F.max("count")).first()[0]
        fit = own.select("embedding", F.xxhash64("embedding", "label").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
        centroids = spark.sparkContext.broadcast(spherical_kmeans(_unit(_matrix(fit.column("embedding"))), max(1, min(MOST_CELLS, math.ceil(size / PER_CELL)))))
        kinds = {f.name: f.dataType.simpleString() for f in own.schema}
        cells = written(own.mapInArrow(_assign(centroids), f"label {kinds['label']}, gid long, n long, embedding {kinds['embedding']}, cell int, home boolean"))
        sizes = cells.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = cells.join(sizes, ["label", "cell"]).withColumn("b", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        asked = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("b").alias("j"), F.when(F.col("home") & (i == F.col("b")), "b").otherwise("o").alias("side")))
        asks = F.transform(F.filter(every, lambda j: F.col("home") & (j != F.col("b"))), lambda j: F.struct(F.col("b").alias("i"), j.alias("j"), F.lit("h").alias("side")))
        tasks = placed.withColumn("t", F.explode(F.concat(asked, asks))).select("label", "cell", "t.i", "t.j", "t.side", "gid", "n", "embedding")
        done.append(cells)
        found = written(tasks.groupBy("label", "cell", "i", "j").applyInArrow(_compare, "gid long, links long, to long"))
        counts.append(found)
        edges.append(found.where("gid <> to").select(F.col("gid").alias("u"), F.col("to").alias("v")))
    if counts:
        found, pairs = counts[0], edges[0]
        for a, b in zip(counts[1:], edges[1:], strict=True):
            found, pairs = found.unionByName(a), pairs.unionByName(b)
        known = components(pairs).withColumnRenamed("id", "gid")
        found = found.groupBy("gid").agg(F.sum("links").alias("links")).join(known, "gid", "left").withColumn("component", F.coalesce("component", "gid"))
        groups = written(groups.drop("embedding").join(found, "gid"))
        discard(*done)
        roots = written(groups.groupBy("component").agg(F.min("least").alias("root")))
        v = v.drop("embedding").join(groups.join(roots, "component"), by, "left")
    else:
        v = v.drop("embedding").withColumns({c: F.lit(None).cast("long") for c in ("n", "links", "root")})
    component = F.coalesce("root", "vec_id")
    return v.select("vec_id", F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component; see linked."""
    return linked(table(spark, sf_dir, "embeddings"))
