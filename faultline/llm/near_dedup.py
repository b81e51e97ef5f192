"""Near-duplicate documents: an LSH forest over MinHash signatures.

1. A document is its set of distinct word shingles, as hashes. Equal sets are one node, so exact
   copies never meet each other again. A node keeps a signature of one byte for each of ``HASHES``
   minimum hashes.
2. The signature is cut into ``TREES`` labels. For each tree all nodes are sorted by label, in
   range partitions of bounded size; the nodes with the longest common prefix are then neighbours,
   and how deep a prefix must be to part two regions adapts to how crowded the region is. A
   node's candidates are the nearest nodes on both sides that are not in its component yet, if
   the whole signatures make the similarity possible.
3. Each node's best candidates are confirmed on full sets. Components are found; the nodes that had any
   like neighbour are sorted again, once, to find neighbours in other components further away.
4. Nodes of a crowded region that are still apart are compared with all others of it, by signature and
   then by a sketch of ``SKETCH`` bytes and the full set of those that have a partner.

Pairs are linear in nodes: a group of copies costs its size, not its square.

Defined results: null and wordless texts have an empty set and are linked with nothing; a text of
fewer words than a shingle is one shingle; rows that repeat id and text are one document and stay
or go together; null ids are never smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words as ws
from faultline.llm.common import small_or_shuffled, table, written
from faultline.llm.linking import linked_components

SHINGLE = 5
PERCENT = 80
TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
#: Labels that begin with so many equal bytes are compared in full where nodes crowd: all trees miss a pair at the limit once in ten millions.
REGION = 2
#: Candidates may look so much less similar by signature than they must be: five standard deviations.
SLACK = 0.18
#: Minimum hashes of a sketch, and the same five deviations for it.
SKETCH = 1024
SKETCH_SLACK = SLACK * (HASHES / SKETCH) ** 0.5


def hashing(seed: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of so many hash functions."""
    rows = np.random.Generator(np.random.PCG64(seed))
    times = rows.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return times, rows.integers(0, 2**32, hashes, dtype=np.uint32)


_SIGNATURE, LONG = hashing(1, HASHES), hashing(2, SKETCH)


def _sets(texts: list[bytes], shingle: int):
    """Sorted distinct shingle hashes of a chunk of texts, laid end to end, and where each text's begin."""
    w = ws.split(texts, ws.is_word())
    h, of = ws.shingles(w, shingle)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, begin: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _SIGNATURE) -> np.ndarray:
    """A byte of each minimum hash of each set; sets must not be empty."""
    small = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin) - 1, len(functions[0])), np.uint8)
    for k, (times, plus) in enumerate(zip(*functions, strict=True)):
        out[:, k] = np.minimum.reduceat(small * times + plus, begin[:-1])
    return out


def _digests(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else b"" for a, b in zip(begin[:-1], begin[1:], strict=True)]


def shingled(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """``doc_id, fingerprint, n_shingles, digest, signature``; an empty set has an empty digest and no signature."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for first, part in ws.chunks(ws.encoded(batch.column("text").to_pylist())):
                h, begin = _sets(part, shingle)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                rows: list[bytes | None] = [None] * len(part)
                if len(full):
                    for i, s in zip(full, signatures(h, np.append(begin[full], len(h))), strict=True):
                        rows[i] = s.tobytes()
                own = slice(first, first + len(part))
                at = own.stop
                yield pa.record_batch(
                    [batch.column(0)[own], batch.column(1)[own], pa.array(size, pa.int64()),
                     pa.array(_digests(h, begin), pa.binary()), pa.array(rows, pa.binary())],
                    ["doc_id", "fingerprint", "n_shingles", "digest", "signature"])
            assert at == batch.num_rows

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("fingerprint"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint long, n_shingles long, digest binary, signature binary")


def _sets_of(ends: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, doc_id: str, shingle: int, sketched: bool) -> DataFrame:
    """``node, shingles`` of the ``ends``, or ``node, signature, shingles`` with their sketches, from one text of each."""
    wanted = written(ends.join(nodes.select("node", "digest", "fingerprint"), "node"), "wanted")
    near = docs.select(F.xxhash64(doc_id, text).alias("fingerprint"), F.col(text).alias("text")).join(
        small_or_shuffled(wanted.select("fingerprint").distinct()), "fingerprint", "left_semi").select("text")
    names, kinds = ("signature, shingles", "signature binary, shingles binary") if sketched else ("shingles", "shingles array<long>")

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for _, part in ws.chunks(ws.encoded(batch.column("text").to_pylist())):
                h, begin = _sets(part, shingle)
                digests = _digests(h, begin)
                new = [i for i, d in enumerate(digests) if d and not (d in seen or seen.add(d))]
                if not new:
                    continue
                sets = [h[begin[i] : begin[i + 1]] for i in new]
                if sketched:
                    own = np.append(0, np.cumsum([len(x) for x in sets]))
                    values = [pa.array([x.tobytes() for x in signatures(np.concatenate(sets), own, LONG)], pa.binary()),
                              pa.array([x.tobytes() for x in sets], pa.binary())]
                else:
                    values = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
                yield pa.record_batch([pa.array([digests[i] for i in new], pa.binary()), *values], ["digest", *names.split(", ")])

    made = near.mapInArrow(run, f"digest binary, {kinds}").join(small_or_shuffled(wanted.select("node", "digest")), "digest")
    made = made.select("node", *names.split(", "))
    return made.dropDuplicates(["node"]) if sketched else made


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, doc_id: str, shingle: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets_of(ends, nodes, docs, text, doc_id, shingle, False), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return small_or_shuffled(pairs.select("a", "b")).join(one, "a").join(two, "b").where(
        100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, fingerprint, n_shingles, component_id`` (the smallest reachable id), one row for each row of ``docs``."""
    found = written(shingled(docs, text, doc_id, shingle), "shingled")
    nodes = written(found.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.min("fingerprint").alias("fingerprint"), F.first("n_shingles").alias("size"),
        F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    turned = F.expr(f"concat(substring(signature, tree * {DEPTH} + 1, {HASHES}), substring(signature, 1, tree * {DEPTH}))")
    in_trees = lambda rows: rows.select("node", "size", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "node", "size", "tree", turned.alias("label"))
    of = lambda some: in_trees(written(nodes.select("node", "size", "signature").join(small_or_shuffled(some), "node", "left_semi"), "again"))
    confirm = lambda pairs: confirmed(pairs, nodes, docs, text, doc_id, shingle, percent)
    sketch = lambda ends: _sets_of(ends, nodes, docs, text, doc_id, shingle, True)
    begins = ", ".join(f"substring(label, pmod({t} - tree, {TREES}) * {DEPTH} + 1, {REGION})" for t in range(TREES))
    places = lambda rows: rows.withColumn("nth", F.col("tree")).withColumn("places", F.expr(f"concat({begins})"))
    labels = linked_components(in_trees(nodes), confirm, sketch, places, REGION, percent, SLACK, SKETCH_SLACK, DEPTH, REGION, of)
    classes = nodes.select("digest", "node", "first_id")
    if labels is not None:
        classes = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
        classes = classes.join(least, "component").select("digest", "component_id")
    else:
        classes = classes.select("digest", F.col("first_id").alias("component_id"))
    out = found.select("doc_id", "fingerprint", "n_shingles", "digest").join(classes, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "fingerprint", "n_shingles", own.alias("component_id"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest id."""
    marks = linked(docs, text, doc_id, shingle, percent)
    gone = written(marks.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("fingerprint").distinct(), "dropped")
    return docs.join(small_or_shuffled(gone), F.xxhash64(docs[doc_id], docs[text]) == gone["fingerprint"], "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
