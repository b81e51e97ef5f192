"""Benchmark decontamination with DataFrame functions only.

Words are what is left of a text between ASCII characters other than letters and digits,
with A-Z in lower case. The test n-grams are all windows of ``n`` consecutive words of an
item; an item with fewer words is one window. They form a broadcast hash set. A training
text is scanned in one pass: each of its words is looked up among the anchor words (of each
window, the word that is rarest in the benchmark, then longest), which says where windows
around it may begin; those windows are looked up in the set by hash and verified by their
words. Nothing but verified hits and one row per document is shuffled.

The set grows with the benchmark only. It holds each different window once, with a number; which
items have a window is a table of its own (number, item), joined with the numbers that documents hit,
so an instruction line that stands in every item is one row of the set. Windows are counted; if there
are more than ``block_windows``, the benchmark is taken in blocks of about that many windows, each
with a scan of its own, so a broadcast never exceeds the bound.

Defined results: null and wordless texts have no words and no hits; null items and items
without words have no window; a null ``item_id`` counts as an item with an empty name; rows
that repeat an item count once, rows that repeat a document are separate documents; empty
tables give empty or all-clean results. Other columns of either table are kept out of the way.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import fresh, small_or_shuffled, table, written

N = 10
BLOCK_WINDOWS = 200_000

_KEPT = string.digits + string.ascii_lowercase
_SEPARATORS = "".join(chr(c) for c in range(128) if chr(c) not in _KEPT + string.ascii_uppercase)


def words(text: Column) -> Column:
    """Array of words; empty for null and for texts without words."""
    plain = F.trim(F.translate(
        text, string.ascii_uppercase + _SEPARATORS, string.ascii_lowercase + " " * len(_SEPARATORS)))
    return F.when(plain.isNull() | (plain == ""), F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def benchmark_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", n: int = N) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``window, size, anchor, shift, number``, the different windows with their anchor word and its
    place, and ``number, item``, the different items of each."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    rarity = items.select(F.explode("w").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("uses"))
    own = items.where(F.size("w") > 0).select("item", F.explode(F.expr(
        f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n}))")).alias("w"))
    places = own.select("w").distinct().select("w", F.posexplode("w").alias("shift", "anchor")).join(rarity, "anchor")
    best = F.struct(-F.col("uses"), F.length("anchor"), -F.col("shift"), "anchor", "shift")
    windows = written(places.groupBy("w").agg(F.max(best).alias("b")).select(
        F.array_join("w", " ").alias("window"), F.size("w").alias("size"), "b.anchor", "b.shift",
        F.monotonically_increasing_id().alias("number")), "windows")
    named = own.select(F.array_join("w", " ").alias("window"), "item").distinct().join(windows, "window").select("number", "item")
    return windows, written(named, "window_items")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  item_id: str = "item_id", item_text: str = "text", n: int = N,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` of id and text, ``n_words``, ``n_hit``,
    ``items`` (sorted names) and ``spans`` (``first`` and ``last`` hit word, from 0, of each run of hit words)."""
    found, named = benchmark_windows(benchmark, item_text, item_id, n)
    blocks = max(1, -(-found.count() // block_windows))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                         F.xxhash64(doc_id, text).alias("fingerprint"), words(F.col(text)).alias("w"))
    hits = None
    for b in range(blocks):
        block = found if blocks == 1 else found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        part = _scan(source, block)
        hits = part if hits is None else hits.unionByName(part)
    merged = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"),
                 F.array().cast("array<struct<first:int,last:int>>").alias("runs")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["start"] + h["size"] - 1).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["start"] + h["size"] - 1 - F.greatest(a["end"], h["start"] - 1))).alias("n"),
            F.when((h["start"] > a["end"] + 1) | (F.size(a["runs"]) == 0),
                   F.concat(a["runs"], F.array(F.struct(h["start"].alias("first"), (h["start"] + h["size"] - 1).alias("last")))))
            .otherwise(F.concat(F.slice(a["runs"], 1, F.size(a["runs"]) - 1), F.array(F.struct(
                F.element_at(a["runs"], -1)["first"].alias("first"),
                F.greatest(a["end"], h["start"] + h["size"] - 1).alias("last"))))).alias("runs")))
    marked = written(hits.groupBy("row", "doc_id", "fingerprint").agg(
        F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("number").alias("numbers"),
    ).select("row", "doc_id", "fingerprint", "n_words", "numbers", merged.alias("m")), "marked")
    items = marked.select("row", F.explode("numbers").alias("number")).join(small_or_shuffled(named), "number").groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return marked.join(items, "row", "left").select(
        "doc_id", "fingerprint", "n_words", F.col("m.n").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("m.runs").alias("spans"))


def _scan(source: DataFrame, windows: DataFrame) -> DataFrame:
    """Verified hits of one block, and a row without hit for each document.

    The empty string is no word: in front of a document's words it stands for the document
    itself and matches an anchor row of size 0.
    """
    spark = source.sparkSession
    document = spark.range(1).select(F.lit("").alias("anchor"), F.lit(0).alias("shift"), F.lit(0).alias("size"))
    anchors = windows.select("anchor", "shift", "size").distinct().unionByName(document)
    known = windows.select(F.xxhash64("window").alias("hash"), F.col("size").alias("known_size"), "window", "number")
    begin = F.col("place") - F.col("shift")
    cut = F.slice("w", begin, F.col("size"))
    fits = (F.col("size") == 0) | ((begin >= 1) & (begin + F.col("size") - 1 <= F.size("w")))
    near = source.select("*", F.posexplode_outer(F.concat(F.array(F.lit("")), "w")).alias("place", "anchor")).join(
        F.broadcast(anchors), "anchor").where(fits).select(
        "row", "doc_id", "fingerprint", F.when(F.col("size") == 0, F.size("w")).cast("long").alias("n_words"),
        (begin - 1).alias("start"), "size", F.when(F.col("size") > 0, F.array_join(cut, " ")).alias("seen"))
    checked = near.join(F.broadcast(known), (F.xxhash64("seen") == F.col("hash")) & (F.col("seen") == F.col("window"))
                        & (F.col("size") == F.col("known_size")), "left")
    return checked.where((F.col("size") == 0) | F.col("window").isNotNull()).select(
        "row", "doc_id", "fingerprint", "n_words",
        F.when(F.col("size") > 0, F.struct("start", "size")).alias("hit"), "number")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   spans: bool = False, **kw) -> DataFrame:
    """``docs`` without contaminated documents, or with their hit words cut out (``spans``); columns stay as they are."""
    mark, key = fresh(docs.columns, "spans", "fingerprint")
    dirty = written(contamination(docs, benchmark, text, doc_id, **kw).where("n_hit > 0").select(
        F.col("fingerprint").alias(key), F.col("spans").alias(mark)).dropDuplicates([key]), "contaminated")
    keyed = docs.withColumn(key, F.xxhash64(doc_id, text))
    if not spans:
        return keyed.join(small_or_shuffled(dirty.select(key)), key, "left_anti").select(docs.columns)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"({word}[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"))
    left = F.filter(pieces, lambda p, i: ~F.exists(F.col(mark), lambda s: (i >= s["first"]) & (i <= s["last"])))
    head = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    cut = F.when(F.col(mark).isNull(), F.col(text)).otherwise(F.concat(head, F.array_join(left, "")))
    return keyed.join(small_or_shuffled(dirty), key, "left").withColumn(text, cut).select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT row, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT row, i, k, item FROM p JOIN g USING (g, k)),
c AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (
    SELECT row, unnest(generate_series(i, i + k - 1)) AS pos FROM (SELECT DISTINCT row, i, k FROM h)) GROUP BY row),
n AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN n USING (row)
"""
