"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, hashes, mix, shingles, slices, table, text_bytes, trimmed, words, written

SIMILARITY, WIDTH = 0.8, 5
#: A pair of similarity 0.8 shares none of BANDS bands of ROWS samples with probability (1 - 0.8**3)**12 = 0.0002.
BANDS, ROWS = 12, 3
#: Counters of the document-frequency sketch: fixed in size, so it may be broadcast.
SKETCH_WIDTH, SKETCH_DEPTH = 1 << 16, 2
#: A shingle in one of RARE documents, or in fewer, weighs most.
RARE = 1000
#: Pairs that share a text are dealt to one task for each so many of them.
PAIRS = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _shingle_sets(column: pa.Array):
    """Rows, hashes and counts of the distinct shingles of each row, rows in order. A text under five words is one shingle."""
    data, offsets = text_bytes(column)
    starts, ends, rows = words(data, offsets)
    word = hashes(data, starts, ends)
    del starts, ends
    h, at = shingles(word, rows, WIDTH)
    of = rows[at]
    n_words = np.bincount(rows, minlength=len(column))
    first = np.cumsum(n_words) - n_words
    for r in np.flatnonzero((n_words > 0) & (n_words < WIDTH)):
        x = np.zeros(1, np.uint64)
        for w in word[first[r] : first[r] + n_words[r]]:
            x = mix(x + w)
        h, of = np.append(h, x), np.append(of, r)
    key = mix(h + of.astype(np.uint64) * _GOLDEN)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    heads = np.flatnonzero(new)
    h, of, tf = h[order][heads], of[order][heads], np.diff(np.append(heads, len(key)))
    order = np.argsort(of, kind="stable")
    return of[order], h[order], tf[order]


def _cells(h: np.ndarray):
    return [(mix(h + np.uint64(d + 1)) % np.uint64(SKETCH_WIDTH)).astype(np.int64) for d in range(SKETCH_DEPTH)]


@trimmed
def _count(batches):
    counts = np.zeros((SKETCH_DEPTH, SKETCH_WIDTH), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            _, h, _ = _shingle_sets(part.column("text"))
            for d, cell in enumerate(_cells(h)):
                counts[d] += np.bincount(cell, minlength=SKETCH_WIDTH)
    flat = counts.ravel()
    has = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(flat[has])], names=["cell", "n"])


class Weights:
    """TF-IDF weights from the sketch: the count in the text times 1 + log(N / df) / log(RARE), 2 at most, so a shingle of one document in
    RARE or of fewer weighs twice one that is in all. A counter is lowered by what other shingles put into its cell on average
    (count-mean-min). What remains of them is a share of all documents that doesn't grow with their number, and shares are all that weights
    depend on: so a sketch of one size serves every corpus."""

    def __init__(self, flat: np.ndarray, n_docs: int):
        counts = flat.reshape(SKETCH_DEPTH, SKETCH_WIDTH).astype(np.float64)
        self.df = np.maximum(1.0, counts - (counts.sum(axis=1, keepdims=True) - counts) / (SKETCH_WIDTH - 1)).astype(np.float32)
        self.n = max(1, n_docs)

    def idf(self, h: np.ndarray) -> np.ndarray:
        df = np.minimum.reduce([self.df[d][cell] for d, cell in enumerate(_cells(h))])
        return (1 + np.clip(np.log(self.n / df) / np.log(RARE), 0, 1)).astype(np.float32)


def weights(docs: DataFrame) -> Weights:
    """The document frequencies of all shingles of all documents, as SKETCH_WIDTH x SKETCH_DEPTH counters."""
    rows = docs.select("text").mapInArrow(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(SKETCH_WIDTH * SKETCH_DEPTH, np.int64)
    flat[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return Weights(flat, docs.count())


_NEG_LOG = -np.log((np.arange(65536) + 0.5) / 65536).astype(np.float32)


def samples(rows: np.ndarray, h: np.ndarray, w: np.ndarray, n_rows: int, number: int):
    """Improved consistent weighted sampling (Ioffe, 2010): for k < number, the identity (shingle, t) that row's set draws.

    Two weighted sets draw the same with the probability of their weighted Jaccard similarity. rows must be sorted.
    """
    sizes = np.bincount(rows, minlength=n_rows)
    full = np.flatnonzero(sizes)
    heads = (np.cumsum(sizes) - sizes)[full]
    log_w = np.log(w.astype(np.float32))
    for k in range(number):
        out = np.zeros(n_rows, np.uint64)
        if len(full):
            x = mix(h + np.uint64((k + 1) * int(_GOLDEN) % 2**64))
            part = x.view(np.uint16).reshape(-1, 4)
            r, c = _NEG_LOG[part[:, 0]] + _NEG_LOG[part[:, 1]], _NEG_LOG[part[:, 2]] + _NEG_LOG[part[:, 3]]
            beta = ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_w / r + beta)
            a = np.log(c) - r * (t - beta) - r
            least = np.minimum.reduceat(a, heads)
            hit = np.flatnonzero(a == np.repeat(least, sizes[full]))[::-1]
            first = np.zeros(n_rows, np.int64)
            first[rows[hit]] = hit
            got = first[full]
            out[full] = mix(h[got] ^ mix(t[got].astype(np.int64).view(np.uint64) + np.uint64(k)))
        yield out


def _sign(weigh):
    @trimmed
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                rows, h, tf = _shingle_sets(texts)
                w, n = tf * weigh.value.idf(h), len(part)
                has = np.bincount(rows, minlength=n) > 0
                total, count = np.bincount(rows, weights=w, minlength=n), np.bincount(rows, weights=tf.astype(float), minlength=n)
                drawn = samples(rows, h, w, n, BANDS * ROWS)
                bands = []
                for _ in range(BANDS):
                    key = np.zeros(n, np.uint64)
                    for _ in range(ROWS):
                        key = mix(key + next(drawn))
                    bands.append(key.view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(np.stack(bands, 1).ravel()))
                raw = texts.cast(pa.large_binary()).to_pylist()
                nodes = [hashlib.md5(x, usedforsecurity=False).digest() if ok else None for x, ok in zip(raw, has.tolist(), strict=True)]
                total, count = total.astype(float), count.astype(float)  # bincount of nothing is whole
                rarity = np.round(total / np.maximum(count, 1), 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.binary()), keys, pa.array(rarity, pa.float64()), pa.array(total, pa.float64())], names=["doc_id", "node", "keys", "rarity", "total"])

    return run


def _verify(weigh):
    """Pairs with both texts -> those whose weighted Jaccard similarity is enough."""

    @trimmed
    def run(batches):
        for batch in batches:
            size = pc.add(pc.fill_null(pc.binary_length(batch.column("text_u")), 0), pc.fill_null(pc.binary_length(batch.column("text_v")), 0))
            for part in slices(batch, "text_u", sizes=size):
                n, both = len(part), [_shingle_sets(part.column(c)) for c in ("text_u", "text_v")]
                rows, h, tf = (np.concatenate(x) for x in zip(*both, strict=True))
                w = tf * weigh.value.idf(h).astype(np.float64)
                key = mix(h + rows.astype(np.uint64) * _GOLDEN)
                order = np.argsort(key, kind="stable")
                same = np.flatnonzero(key[order][1:] == key[order][:-1])
                shared = np.bincount(rows[order[same]], weights=np.minimum(w[order[same]], w[order[same + 1]]), minlength=n)
                union = np.bincount(rows, weights=w, minlength=n) - shared
                good = pa.array(shared >= (SIMILARITY - 1e-9) * union)
                yield pa.RecordBatch.from_arrays([part.column("u").filter(good), part.column("v").filter(good)], names=["u", "v"])

    return run


def _prefixes(weigh):
    """For each text, its rarest shingles up to (1 - s) of its weight, the weight before each, and a flag for those within 1 - 2s / (1 + s)."""

    @trimmed
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, h, tf = _shingle_sets(part.column("text"))
                idf = weigh.value.idf(h)
                w = (tf * idf).astype(np.float64)
                order = np.lexsort((h, -idf, rows))
                rows, h, w = rows[order], h[order], w[order]
                total = np.bincount(rows, weights=w, minlength=len(part))
                upto = np.cumsum(w)
                before = upto - w - (np.cumsum(total) - total)[rows]
                within = before <= (1 - SIMILARITY + 1e-9) * total[rows]
                short = before <= (1 - 2 * SIMILARITY / (1 + SIMILARITY) + 1e-9) * total[rows]
                nodes = part.column("node").take(pa.array(rows[within]))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(h[within].view(np.int64)), pa.array(before[within], pa.float64()), pa.array(short[within])], names=["node", "shingle", "before", "short"])

    return run


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, class_size): a row for each document of docs (doc_id, text).

    A node is a distinct text; exact copies never meet in pairs. Two nodes of one class are joined by a chain of pairs whose weighted
    Jaccard similarity over five-word shingles is 0.8 or more. class_id is the smallest doc_id of the class (null if all are null).
    Candidates share a band. In a bucket, each node is first compared with the one whose shingles are most common (in a group of edited
    copies, the text they come from): as many pairs as nodes. Texts of buckets that then still hold different components are compared where
    prefix filtering allows the similarity, which is exact: for 0.8, the longer text's rarest fifth must share a shingle with the
    shorter one's rarest ninth, with enough weight left in both. So no bucket has a cap and none is expanded into all pairs.
    Null, empty and wordless texts are alone: node null, class_id their doc_id, class_size 1. Repeated rows: rows of one class.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    weigh = spark.sparkContext.broadcast(weights(docs))
    signed = written(docs.mapInArrow(_sign(weigh), "doc_id long, node binary, keys array<long>, rarity double, total double"))
    nodes = signed.where("node is not null").groupBy("node").agg(F.any_value("keys").alias("keys"), F.min("rarity").alias("rarity"), F.min("total").alias("total"))
    banded = nodes.select("node", "rarity", "total", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("members"), F.min(F.struct("rarity", "node")).alias("first")).where("members > 1")
    # written before it is joined, as all aggregates here: the join's sides are plain shuffles, so Spark can split a large bucket
    buckets = written(buckets)
    banded = written(banded.join(buckets.select("band", "key", F.col("first.node").alias("first")), ["band", "key"]))
    done = [signed, buckets, banded]  # to be deleted at the end
    texts = docs.where("text is not null").withColumn("node", F.unhex(F.md5("text")))
    wanted = banded.select("node").distinct()
    texts = written(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text")))
    done.append(texts)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose similarity is enough. A text that is in many pairs goes to several tasks, PAIRS of its pairs in each."""
        pairs = written(pairs)
        often = written(pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("shares")))
        dealt = pairs.join(often, "u").withColumn("share", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int")).select("u", "v", "share")
        hubs = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")).join(often, "u").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        both = dealt.join(hubs, ["u", "share"]).join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        out = written(both.select("u", "v", "text_u", "text_v").mapInArrow(_verify(weigh), "u binary, v binary"))
        discard(pairs, often)
        return out

    stars = banded.where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    found = [verified(stars)]
    links = found[0]
    known = components(links)
    banded = banded.join(known.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = banded.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band", "key")
    mixed = written(mixed)
    left = written(banded.join(mixed, ["band", "key"]).select("node", "component", "total").distinct())
    prefixes = texts.join(left.select("node"), "node", "left_semi").mapInArrow(_prefixes(weigh), "node binary, shingle long, before double, short boolean")
    keyed = written(left.join(prefixes, "node"))
    both_keyed = [keyed]
    several = keyed.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("shingle")
    several = written(several)
    keyed = written(keyed.join(several, "shingle"))
    both_keyed.append(keyed)
    x = keyed.where("short").select("shingle", *(F.col(c).alias(f"{c}_x") for c in ("node", "component", "total", "before")))
    y = keyed.select("shingle", *(F.col(c).alias(f"{c}_y") for c in ("node", "component", "total", "before")))
    # at the first shingle that two texts share, what is left of both must be enough
    fits = F.least(F.col("total_x") - F.col("before_x"), F.col("total_y") - F.col("before_y")) >= (SIMILARITY / (1 + SIMILARITY) - 1e-6) * (F.col("total_x") + F.col("total_y"))
    near = (F.col("component_x") != F.col("component_y")) & (F.col("total_y") >= F.col("total_x") - 1e-6) & (F.col("total_x") >= (SIMILARITY - 1e-6) * F.col("total_y"))
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & near & fits & (F.col("node_x") != F.col("node_y")))
    pairs = pairs.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct()
    found.append(verified(pairs))
    links = links.unionByName(found[1])
    known = written(components(links)).withColumnRenamed("id", "node")
    ids = signed.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = written(ids.select("doc_id", "node", "component"))
    discard(*done, mixed, left, several, *both_keyed, *found)
    totals = ids.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    totals = written(totals)
    ids = ids.join(totals, "component", "left")
    alone = F.col("node").isNull()
    return ids.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "component")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: its smallest doc_id (null last; then the smallest text hash; of repeated rows one).

    Null, empty and wordless texts all stay. Columns may have any names, null ids any number; an empty table stays empty.
    """
    names = docs.columns
    c = written(classes(docs))
    first = c.where("component is not null and class_size > 1").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("x"))
    member = c.where("component is not null and class_size > 1").select("component", "node").distinct().join(first, "component").select(F.col("node").alias("_node"), F.col("x").alias("_first"))
    inner = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"), _node_of(F.col("text")).alias("_own"))
    joined = inner.join(member, F.col("_own") == F.col("_node"), "left")
    mine = F.col("_first.node").eqNullSafe(F.col("_own")) & F.col("_row.doc_id").eqNullSafe(F.col("_first.doc_id"))
    # written before rows are grouped: so the join can be split where one text is a third of all rows, and only what stays is grouped
    stays = written(joined.where(F.col("_node").isNull() | mine).select("_row", "_own", F.col("_node").isNull().alias("_alone")))
    chosen = stays.where(~F.col("_alone")).groupBy("_own").agg(F.any_value("_row").alias("_row")).select("_row")
    return stays.where("_alone").select("_row").unionByName(chosen).select(*(F.col(f"_row.`{n}`").alias(n) for n in names))


def _node_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies, and whether it is the one that stays; see classes."""
    c = classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
