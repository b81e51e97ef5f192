"""Ranked lexical search: hashed max-sketches give upper bounds, exact scores in descending order of the bounds.

1. Each document's terms are hashed to ``width`` coordinates; of the terms of a coordinate the largest number of
   occurrences stays. With the document's length fixed, a term's impact grows with its occurrences, so this is the
   coordinatewise maximum of impacts, and it needs no statistics of the corpus. Only coordinates that are not zero
   are kept. The sketches are written once and serve any number of query batches.
2. One more pass counts in how many documents each query term occurs.
3. Queries go in blocks of ``BLOCK``. Of each document all queries of a block are looked up at once: the sum over coordinates
   of the impact there times the query's weight there is at least the score.
4. The ``FIRST`` documents of the highest bounds of each query are scored exactly on whole texts; the k-th score is the
   threshold. Then, again in descending order of the bounds, all others whose bound reaches it follow, ``FURTHER`` times
   as many in each round with the threshold raised after it, until no bound of an unscored document reaches it.
   Equal bounds are never parted, and nothing is cut: the result is that of scoring every document.

Defined results: null texts and ids of queries without a term match nothing. Documents are rows: rows that repeat an id or a
text count each, and both can be found; a null id comes last among equal scores. Queries that repeat id and text are one.
Empty tables give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import numbers, small_or_shuffled, table, written
from faultline.plans.staging import globally_ranked

WIDTH = 1 << 16
#: Queries looked up together; their terms and weights are sent to the tasks.
BLOCK = 256
FIRST, FURTHER = 128, 16
TOP = 20
#: Documents whose coordinates are laid out together, so that a task holds a few tens of megabytes.
ROWS = 512

_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.translate(_LOWER)) if text else []


def coordinate(term: str, width: int) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) % width


def _key(doc_id: str, text: str):
    """Rows of one id and text are equal in all that is looked at; the second hash parts ids with several texts."""
    return F.xxhash64(F.lit(1), F.col(doc_id), F.col(text))


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``doc_id, key, n, at, most`` of documents with a term: ``at`` are coordinates, 16 bits each, and ``most`` the largest
    number of occurrences of a term there, 32 bits each."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for i, value in enumerate(b.column("text").to_pylist()):
                found = Counter(terms(value))
                if found:
                    at = np.fromiter((coordinate(t, width) for t in found), np.int64, len(found))
                    often = np.fromiter(found.values(), np.int64, len(found))
                    turn = np.lexsort((-often, at))
                    at, often = at[turn], often[turn]
                    new = np.append(True, at[1:] != at[:-1])
                    rows.append((i, int(often.sum()), at[new].astype("<u2").tobytes(), often[new].astype("<u4").tobytes()))
            if rows:
                place, n, at, most = zip(*rows, strict=True)
                own = b.select(["doc_id", "key"]).take(pa.array(place, pa.int64()))
                yield pa.record_batch([own.column(0), own.column(1), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(most, pa.binary())],
                                      ["doc_id", "key", "n", "at", "most"])

    return docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, key long, n long, at binary, most binary")


def _holders(docs: DataFrame, wanted: frozenset[str], text: str) -> dict[str, int]:
    """In how many documents each of the ``wanted`` terms occurs."""
    def run(batches):
        found = Counter()
        for b in batches:
            for value in b.column("text").to_pylist():
                found.update(wanted.intersection(terms(value)))
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counted.collect()}


class Queries:
    """A block of queries with weights: ``items`` are lists of terms."""

    def __init__(self, items: list[list[str]], df: dict[str, int], documents: int, length: int, width: int = WIDTH):
        self.documents, self.length = documents, length
        self.items = [Counter(x) for x in items]
        self.weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for x in self.items for t in x if df.get(t)}
        places = {t: coordinate(t, width) for t in self.weight}
        used = sorted(set(places.values()))
        self.column = np.full(width, -1, np.int32)
        self.column[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used), len(items)))
        for i, x in enumerate(self.items):
            for t, times in x.items():
                if t in places:
                    self.matrix[self.column[places[t]], i] += times * self.weight[t]

    def m(self, n):
        return 100 - 25 + (25 * n * self.documents) // self.length

    def bounds(self, n: np.ndarray, at: list[bytes], most: list[bytes]) -> np.ndarray:
        """A row of upper bounds for each document; whole numbers under 2^53, so exact."""
        size = np.array([len(x) // 2 for x in at])
        doc = np.repeat(np.arange(len(n)), size)
        column = self.column[np.frombuffer(b"".join(at), "<u2")]
        keep = column >= 0
        doc, column, tf = doc[keep], column[keep], np.frombuffer(b"".join(most), "<u4")[keep].astype(np.int64)
        impact = np.zeros((len(n), self.matrix.shape[0]))
        impact[doc, column] = (1_000_000_000 * tf) // (1000 * tf + 12 * self.m(n)[doc])
        return impact @ self.matrix

    def score(self, item: int, found: Counter, n: int) -> int:
        m = self.m(n)
        return sum(times * self.weight[t] * (1_000_000_000 * found[t] // (1000 * found[t] + 12 * m))
                   for t, times in self.items[item].items() if t in found)


def _bounded(index: DataFrame, block: Queries, over: list[float], under: list[float], most: int) -> DataFrame:
    """``item, key, bound`` of documents with ``over <= bound < under`` for an item; of each item those of the ``most`` highest
    bounds, and all that equal the last of them."""
    low, high = np.array(over), np.array(under)

    def cut(held):
        item, key, bound = held
        turn = np.lexsort((-bound, item))
        item, key, bound = item[turn], key[turn], bound[turn]
        start = np.searchsorted(item, item)
        last = np.minimum(start + most - 1, np.searchsorted(item, item, side="right") - 1)
        keep = bound >= bound[last]
        return item[keep], key[keep], bound[keep]

    def run(batches):
        held, rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), 0
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                part = b.slice(first, ROWS)
                value = block.bounds(part.column("n").to_numpy(), part.column("at").to_pylist(), part.column("most").to_pylist())
                d, i = np.nonzero((value >= low) & (value < high) & (value > 0))
                held = tuple(np.concatenate(x) for x in zip(held, (i, part.column("key").to_numpy()[d], value[d, i]), strict=True))
                if len(held[0]) > rows + 500_000:
                    held = cut(held)
                    rows = len(held[0])
        held = cut(held)
        yield pa.record_batch([pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2])], ["item", "key", "bound"])

    found = index.select("key", "n", "at", "most").mapInArrow(run, "item int, key long, bound double").distinct()
    place = F.rank().over(Window.partitionBy("item").orderBy(F.desc("bound")))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _scored(docs: DataFrame, pairs: DataFrame, block: Queries, text: str, doc_id: str) -> DataFrame:
    """``item, doc_id, score`` of the given pairs of items and document keys, on whole texts."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    asked = numbers(pairs.groupBy("key").agg(F.collect_list("item").alias("items")), "asked")

    def run(batches):
        for b in batches:
            place, item, score = [], [], []
            for i, (value, items) in enumerate(zip(b.column("text").to_pylist(), b.column("items").to_pylist(), strict=True)):
                found = Counter(terms(value))
                n = found.total()
                for k in items:
                    place.append(i)
                    item.append(k)
                    score.append(block.score(k, found, n))
            yield pa.record_batch([pa.array(item, pa.int32()), b.column("doc_id").take(pa.array(place, pa.int64())), pa.array(score, pa.int64())],
                                  ["item", "doc_id", "score"])

    near = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _key(doc_id, text).alias("key")).join(
        small_or_shuffled(asked), "key")
    return near.select("doc_id", "text", "items").mapInArrow(run, f"item int, doc_id {kind}, score long").where("score > 0")


def _best(scored: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def _block(docs: DataFrame, index: DataFrame, block: Queries, top: int, text: str, doc_id: str) -> DataFrame:
    """``item, rank, doc_id, score`` of one block of queries."""
    count = len(block.items)
    need, under, most = [0.0] * count, [math.inf] * count, max(FIRST, top)
    best = None
    while True:
        pairs = numbers(_bounded(index, block, need, under, most), "pairs")
        seen = {r["item"]: r for r in pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("bound").alias("least")).collect()}
        if not seen:
            break
        scored = _scored(docs, pairs, block, text, doc_id)
        best = numbers(_best(scored if best is None else scored.unionByName(best.drop("rank")), top), "best")
        worst = {r["item"]: r["worst"] for r in best.groupBy("item").agg(
            F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).collect()}
        # an equal score may still win by its id, so bounds must reach the threshold, not pass it
        need = [float(worst.get(i, 0)) for i in range(count)]
        under = [seen[i]["least"] if i in seen and seen[i]["n"] >= most else -math.inf for i in range(count)]
        if all(u <= n for u, n in zip(under, need, strict=True)):
            break
        most *= FURTHER
    return best


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", query: str = "text",
           query_id: str = "item_id", index: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """``query_id, rank, doc_id, score``: of each query the ``top`` documents of the highest scores above 0.

    ``index`` are the written sketches of ``docs`` of the same ``width`` (up to 65,536), if they exist already.
    """
    spark, kind = docs.sparkSession, docs.select(doc_id).schema[0].dataType.simpleString()
    index = written(sketches(docs, text, doc_id, width), "sketches") if index is None else index
    documents, length = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    asked = queries.select(F.col(query_id).alias("id"), F.col(query).alias("text")).where(F.col(query).isNotNull()).distinct()
    placed = written(globally_ranked(asked, ["id", "text"], "place", "queries"), "placed")
    out, first, total = None, 1, placed.count() if documents else 0
    while first <= total:  # a block of queries against all documents
        rows = placed.where((F.col("place") >= first) & (F.col("place") < first + BLOCK)).orderBy("place").collect()
        items = [terms(r["text"]) for r in rows]
        df = _holders(docs, frozenset(t for x in items for t in x), text)
        found = _block(docs, index, Queries(items, df, documents, length, width), top, text, doc_id)
        if found is not None:
            names = placed.select((F.col("place") - first).cast("int").alias("item"), F.col("id").alias("query_id"))
            ready = found.join(F.broadcast(names.where((F.col("item") >= 0) & (F.col("item") < BLOCK))), "item").select(
                F.col("query_id").alias(query_id), "rank", "doc_id", "score")
            out = ready if out is None else out.unionByName(ready)
        first += BLOCK
    if out is None:
        return spark.createDataFrame([], f"{query_id} {queries.select(query_id).schema[0].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
f AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
x AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT nn FROM c) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f GROUP BY term),
i AS (
  SELECT f.r, f.doc_id, f.term, x.weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c.nn) // c.l))) AS impact
  FROM f JOIN x USING (term), c),
q AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT item_id, text, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER w <= 20
"""
