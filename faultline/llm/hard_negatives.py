"""Hard negatives: cover trees over norm-augmented candidates, searched for windows of inner products.

1. Vectors become whole numbers. Rows are sorted by the nearest of ``PIVOTS`` vectors, which are taken from a sample of
   ``SAMPLE`` rows (the smallest hashes of ids), and dealt to range partitions of up to about ``GROUP`` rows; a pivot that
   attracts a third of all rows spans many of them. Every row is in one partition, and each partition has a cover tree.
2. Anchors are dealt to slabs of about ``SLAB``. Each slab visits each partition once, in a task that holds one of both.
3. First pass: of each anchor the ``k`` rows of its label that score highest. Second pass: each positive opens a window of
   scores, from ``least`` percent of its own up to its own, and the ``k`` highest rows of other labels within it are kept.
   A tree is descended best first; nodes whose bounds lie outside all windows of an anchor are skipped, and so are
   nodes that cannot reach its worst kept score. Leaves are scored exactly, so the result is exact.
4. At most ``k`` rows for each anchor, window and partition are shuffled to merge the partitions.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that repeat an
id are one row, that of the smallest label and then vector. A shorter vector counts as filled with zeros; an empty one
scores 0. A score beyond 64 bits fails the job. Negative positives open no window. Empty tables give empty results. Columns
other than the three named ones are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm import cover_tree
from faultline.llm.common import numbers, table, written

GROUP = 65_536
LEAST_GROUP = 4_096
SLAB = 8_192
PIVOTS = 64
SAMPLE = 4_096
SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST = 80


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v``: one row for each id, with the components of ``vector`` times ``scale``, rounded down."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad))
    return kept.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(
        F.min(F.struct(F.col(label).cast("long").alias("label"), whole.alias("v"))).alias("r")).select("vec_id", "r.label", "r.v")


def _padded(lists: pa.Array, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), dim))
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _kind(largest: int) -> str:
    """The narrowest number type for whole numbers of this size."""
    return "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"


def _placed(rows: DataFrame, dim: int, kind: str, parts: int, pivots: np.ndarray) -> DataFrame:
    """``rows`` with bytes for vectors and the number of a partition of near ones."""
    half = (pivots**2).sum(axis=1) / 2

    def run(batches):
        for b in batches:
            v = _padded(b.column("v"), dim)
            near = (v @ pivots.T - half).argmax(axis=1)
            packed = [x.tobytes() for x in v.astype(kind)]
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(packed, pa.binary()), pa.array(near.astype(np.int32))],
                                  ["vec_id", "label", "v", "pivot"])

    near = rows.mapInArrow(run, "vec_id long, label long, v binary, pivot int")
    return written(near.repartitionByRange(parts, "pivot", "vec_id").select(
        "vec_id", "label", "v", F.spark_partition_id().alias("part")), "placed")


def _unpacked(t: pa.Table, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(t.num_rows, dim).astype(float)


def _visits(placed: DataFrame, anchors: DataFrame, slabs: int, parts: int, search, schema: str) -> DataFrame:
    """``search(candidates, anchors)`` for each partition of candidates and slab of anchors."""
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = placed.select("*", every(slabs, "slab")).groupBy("part", "slab")
    right = anchors.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(slabs)).cast("int").alias("slab"), every(parts, "part")).groupBy("part", "slab")
    return left.cogroup(right).applyInArrow(search, schema)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of each anchor and positive.

    ``rows`` has ``vec_id, label, v`` with a row for each id, as ``usable`` returns; ``anchors`` is a part of it (ids).
    """
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(rows.select("vec_id", "label", "v"), "rows")
    largest = F.array_max(F.transform("v", lambda x: F.greatest(x, -x)))
    n, dim, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(largest)).first()
    if not n:
        return spark.createDataFrame([], out)
    dim, kind = max(1, dim), _kind(largest or 0)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = _padded(taken.column("v"), dim)
    pivots = cover_tree.build(sample, fan=PIVOTS, leaf=1).levels[min(1, len(sample) - 1)].centre if len(sample) > 1 else sample
    group = min(GROUP, max(LEAST_GROUP, n // (4 * spark.sparkContext.defaultParallelism)))
    placed = _placed(rows, dim, kind, -(-n // group), pivots)
    asked = written(placed.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "label", "v"), "anchors")
    parts, slabs = placed.agg(F.max("part")).first()[0] + 1, max(1, -(-asked.count() // SLAB))

    def same(held: pa.Table, asking: pa.Table) -> pa.Table:
        ids, labels = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
        own, own_label = asking.column("vec_id").to_numpy(), asking.column("label").to_numpy()
        edge = np.full((len(own), 1), np.inf)
        allowed = lambda a, p: (own_label[a] == labels[p]) & (own[a] != ids[p])
        a, _, p, s = cover_tree.search(cover_tree.build(_unpacked(held, kind, dim)), _unpacked(asking, kind, dim), ids, -edge, edge,
                                       allowed, positives)
        return pa.table({"vec_id": own[a], "positive_id": ids[p], "positive_score": s})

    found = _visits(placed, asked, slabs, parts, same, "vec_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = numbers(found.withColumn("place", place).where(F.col("place") <= positives), "positives")
    listed = best.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("of"))
    windows = written(asked.join(listed, "vec_id").select("vec_id", "label", "v", F.col("of.positive_id").alias("of"), F.col("of.positive_score").alias("score")), "windows")

    def other(held: pa.Table, asking: pa.Table) -> pa.Table:
        ids, labels = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
        own, own_label = asking.column("vec_id").to_numpy(), asking.column("label").to_numpy()
        of, score = asking.column("of").to_pylist(), asking.column("score").to_pylist()
        low, high = np.full((len(own), positives), np.inf), np.full((len(own), positives), -np.inf)
        for i, scores in enumerate(score):
            low[i, : len(scores)] = [-(-least * s // 100) for s in scores]
            high[i, : len(scores)] = scores
        a, w, p, s = cover_tree.search(cover_tree.build(_unpacked(held, kind, dim)), _unpacked(asking, kind, dim), ids, low, high,
                                       lambda x, y: own_label[x] != labels[y], negatives)
        pick = lambda lists: np.array([lists[i][j] for i, j in zip(a, w, strict=True)], np.int64)
        return pa.table({"anchor_id": own[a], "positive_id": pick(of), "negative_id": ids[p], "positive_score": pick(score), "negative_score": s})

    hits = _visits(placed, windows, slabs, parts, other,
                   "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings").withColumn(
        "label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""
