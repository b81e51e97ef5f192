"""Quality rules: counted rules, then a band of n-gram perplexities for each language.

The model is a modified Kneser-Ney model of four characters. Spark counts the n-grams of all
documents of a language (each task adds up its own first), derives continuation counts,
discounts, back-off weights and interpolated probabilities with joins, and writes them as a
table sorted by n-gram hash. A hash packs the characters' 16-bit codes, so it is exact; any
white space counts as a space, any digit as 0. Scoring looks sorted arrays up by bisection.

The arrays are sent to the executors only while the table has at most ``MODEL_ROWS`` rows
(48 MB); beyond, ``joined_scores`` gives the same figures by joining the n-grams of each
document with the table, level by level.

A document's log perplexity must lie at most ``BELOW`` scaled median deviations under its
language's median and ``ABOVE`` over it; the band is that of all documents of the language which pass the counted
rules. A language whose documents are all alike keeps them all.

Defined results: null and empty texts have no words, fail the counted rules and have no
perplexity; null languages form a language of their own; repeated rows count and are returned
as often as they come; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words as ws
from faultline.llm.common import small_or_shuffled, table, written

LEVELS = 4
MODEL_ROWS = 4_000_000
#: Scaled median deviations from the median: below it (text too uniform) and above it (text too odd).
BELOW, ABOVE = 8.0, 5.0
MINIMUM_WORDS = 50
SYMBOLS = b"#*$%&|<>"

U = np.uint64
_CODES = np.arange(1 << 16, dtype=U)
for _c in range(1 << 16):
    if chr(_c).isspace():
        _CODES[_c] = 32
    elif chr(_c).isdigit():
        _CODES[_c] = 48


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram of every character, in order, and the number of its text. Three spaces stand before a text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(f"   {t}" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _CODES[np.minimum(flat, 0xFFFF)]
    packed = code.copy()
    for k in range(1, LEVELS):
        packed[k:] |= code[:-k] << U(16 * k)
    text = np.repeat(np.arange(len(texts)), sizes)
    return packed[np.arange(len(text)) + 3 * (text + 1)], text


def _by_language(batch: pa.RecordBatch):
    """Chunks of texts of one language: language, places in the batch, texts."""
    langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
    places: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        places.setdefault(lang, []).append(i)
    for lang, own in places.items():
        size, run = 0, []
        for i in own:
            run.append(i)
            size += len(texts[i])
            if size >= ws.CHUNK // 2:
                yield lang, run, [texts[j] for j in run]
                size, run = 0, []
        if run:
            yield lang, run, [texts[j] for j in run]


def _counts_of(batches):
    """n-gram counts of a task, added up whenever they have grown to a few million."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def added(parts):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        return keys[first], np.add.reduceat(n, first)

    for batch in batches:
        for lang, _, texts in _by_language(batch):
            keys, n = np.unique(ngrams(texts)[0], return_counts=True)
            if len(keys):
                held.setdefault(lang, []).append((keys, n))
                size += len(keys)
            if size > 2_000_000:
                held = {k: [added(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > 1_000_000:
                    yield from _count_rows(held, added)
                    held, size = {}, 0
    yield from _count_rows(held, added)


def _count_rows(held, added):
    for lang, parts in held.items():
        keys, n = added(parts)
        yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                              ["lang", "key", "n"])


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def kneser_ney(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, level, kind, key, value``: log probabilities of n-grams (kind p) and log back-off weights of contexts (g)."""
    counted = _texts(docs, text, lang).mapInArrow(_counts_of, "lang string, key long, n long")
    level = {LEVELS: written(counted.groupBy("lang", "key").agg(F.sum("n").alias("n")), "counts")}
    for k in range(LEVELS - 1, 0, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("key")
        level[k] = level[k + 1].select("lang", shorter).groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n"))
    out, lower = [], None
    for k in range(1, LEVELS + 1):
        times = [F.count(F.when(F.col("n") == i, 1)).alias(f"t{i}") for i in range(1, 5)]
        y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
        share = [F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")) for i in range(1, 4)]
        cut = [F.when(share[i - 1].isNull() | y.isNull(), 0.5).otherwise(F.least(
            F.lit(i - 0.1), F.greatest(F.lit(0.1), i - (i + 1) * y * share[i - 1]))).alias(f"d{i}") for i in range(1, 4)]
        discounts = written(level[k].groupBy("lang").agg(*times).select("lang", *cut), f"discounts{k}")
        rows = level[k].join(small_or_shuffled(discounts), "lang").select(
            "lang", "key", F.shiftrightunsigned("key", 16).alias("context"), "n",
            F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = rows.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.sum("d").alias("kept"), F.count(F.lit(1)).alias("kinds"))
        seen = rows.join(contexts, ["lang", "context"])
        if k == 1:
            base = (F.col("kept") / F.col("total")) / (F.col("kinds") + 1)
        else:
            seen = seen.withColumn("short", F.col("key").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))).join(
                lower.select("lang", F.col("key").alias("short"), F.col("value").alias("below")), ["lang", "short"])
            base = F.col("kept") / F.col("total") * F.exp("below")
        seen = written(seen.select("lang", F.lit(k).alias("level"), F.lit("p").alias("kind"), "key", F.log(
            (F.col("n") - F.col("d")) / F.col("total") + base).alias("value")), f"level{k}")
        weights = contexts.select("lang", F.lit(k).alias("level"), F.lit("g").alias("kind"), F.col("context").alias("key"), F.log(
            F.col("kept") / F.col("total") / (F.col("kinds") + 1 if k == 1 else F.lit(1.0))).alias("value"))
        out += [seen, weights]
        lower = seen
    return written(reduce(DataFrame.unionByName, out), "model")


def sorted_arrays(model: DataFrame) -> DataFrame:
    """``lang, level, kind, keys, values``: the table in arrays sorted by hash, several for one language and level."""
    def run(batches):
        for batch in batches:
            lang, level, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "level", "kind"))
            key, value = batch.column("key").to_numpy(), batch.column("value").to_numpy().astype("<f4")
            new = (lang[1:] != lang[:-1]) | (level[1:] != level[:-1]) | (kind[1:] != kind[:-1])
            edges = [0, *(np.flatnonzero(new) + 1), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    yield pa.record_batch([pa.array([lang[a]]), pa.array([level[a]], pa.int32()), pa.array([kind[a]]),
                                           pa.array([key[a:b].tobytes()]), pa.array([value[a:b].tobytes()])],
                                          ["lang", "level", "kind", "keys", "values"])

    order = ["lang", "level", "kind", "key"]
    return model.select(*order, "value").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "lang string, level int, kind string, keys binary, values binary")


class Arrays:
    """The model as arrays sorted by hash, by language, level and kind."""

    def __init__(self, rows) -> None:
        parts: dict[tuple, list] = {}
        for r in rows:
            parts.setdefault((r["lang"], r["level"], r["kind"]), []).append(
                (np.frombuffer(r["keys"], np.int64), np.frombuffer(r["values"], "<f4")))
        self.at = {}
        for name, own in parts.items():
            keys, values = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(keys.view(U))
            self.at[name] = keys.view(U)[order], values[order]

    def find(self, lang: str, level: int, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.at.get((lang, level, kind), (np.empty(0, U), np.empty(0, np.float32)))
        if not len(known):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        i = np.searchsorted(known, keys)
        i[i == len(known)] = 0
        hit = known[i] == keys
        return np.where(hit, values[i], np.float32(0)), hit

    def score(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each packed n-gram."""
        value, hit = self.find(lang, LEVELS, "p", keys)
        left = np.flatnonzero(~hit)
        carried = np.zeros(len(left))
        for k in range(LEVELS, 1, -1):
            if not len(left):
                return value
            part = keys[left] & U((1 << 16 * k) - 1)
            carried += self.find(lang, k, "g", part >> U(16))[0]
            v, hit = self.find(lang, k - 1, "p", part & U((1 << 16 * (k - 1)) - 1))
            value[left] = carried + v
            left, carried = left[~hit], carried[~hit]
        value[left] = carried + self.find(lang, 1, "g", np.zeros(len(left), U))[0]
        return value


def counted_rules(texts: list[str]) -> dict[str, np.ndarray]:
    """Figures of each text: words, their code points, symbols, repeated lines, words in repeated windows of three."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    word = ws.is_word()
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for first, part in ws.chunks(ws.encoded(texts)):
        w = ws.split(part, word, lower=False)
        m, at = len(part), slice(first, first + len(part))
        out["n_words"][at] = np.bincount(w.text, minlength=m)
        per_text = lambda marks: np.add.reduceat(marks.astype(np.int64), w.begin[:-1])
        out["word_chars"][at] = per_text(word[w.data] & ((w.data & 0xC0) != 0x80))
        out["n_symbols"][at] = per_text(symbol[w.data])
        end = np.flatnonzero(w.data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        line, of = ws.hashes_of(w.data, start[full], end[full]), np.searchsorted(w.begin, start[full], side="right") - 1
        kinds = np.bincount(_different(line, of)[1], minlength=m)
        out["n_dup_lines"][at] = np.bincount(of, minlength=m) - kinds
        if len(w.hashes) >= 3:
            tri = ws.pair(ws.pair(w.hashes[:-2], w.hashes[1:-1]), w.hashes[2:])
            whole = np.flatnonzero(w.text[:-2] == w.text[2:])
            keyed = ws.pair(tri[whole], w.text[whole].astype(U))
            order = np.argsort(keyed, kind="stable")
            same = keyed[order][1:] == keyed[order][:-1]
            twice = np.zeros(len(keyed), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(len(w.hashes), bool)
            for k in range(3):
                covered[whole[twice] + k] = True
            out["n_repeat_words"][at] = np.bincount(w.text[covered], minlength=m)
    return out


def _different(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of key and text."""
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return k[new], o[new]


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _keyed(docs: DataFrame, text: str, lang: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def scores(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
           model_rows: int = MODEL_ROWS) -> DataFrame:
    """``doc_id, lang``, the counted figures and ``log_perplexity`` (null without characters), one row for each row."""
    if model.limit(model_rows + 1).count() > model_rows:
        return joined_scores(docs, model, text, lang, doc_id)
    sent = docs.sparkSession.sparkContext.broadcast(Arrays(sorted_arrays(model).collect()))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for own, places, texts in _by_language(batch):
                keys, of = ngrams(texts)
                total[places] = np.bincount(of, sent.value.score(own, keys), len(texts))
                size[places] = [len(t) for t in texts]
            figures = counted_rules(batch.column("text").to_pylist())
            value = pa.array(-total / np.maximum(size, 1), mask=size == 0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), *map(pa.array, figures.values()), value],
                                  ["doc_id", "lang", *figures, "log_perplexity"])

    return _keyed(docs, text, lang, doc_id).mapInArrow(run, f"doc_id {kind}, lang string, {_FIGURES}, log_perplexity double")


def joined_scores(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """As ``scores``, with a model of any size: n-grams of each document are joined with the table by hash."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            figures = counted_rules(texts := batch.column("text").to_pylist())
            grams = []
            for t in texts:
                key, n = np.unique(ngrams([t])[0], return_counts=True)
                grams.append([{"key": int(a), "n": int(b)} for a, b in zip(key.view(np.int64), n, strict=True)])
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), batch.column("lang"), *map(pa.array, figures.values()),
                 pa.array(grams, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))],
                ["row", "doc_id", "lang", *figures, "grams"])

    keyed = _keyed(docs, text, lang, doc_id).withColumn("row", F.monotonically_increasing_id())
    rows = written(keyed.select("row", "doc_id", "lang", "text").mapInArrow(
        run, f"row long, doc_id {kind}, lang string, {_FIGURES}, grams array<struct<key:long,n:long>>"), "grams")
    left = rows.select("row", "lang", F.inline("grams")).withColumn("carried", F.lit(0.0))
    parts = []
    for k in range(LEVELS, 0, -1):
        own = lambda what: model.where((F.col("level") == k) & (F.col("kind") == what))  # noqa: B023
        tried = left.join(own("p").select("lang", "key", F.col("value").alias("p")), ["lang", "key"], "left")
        parts.append(tried.where("p IS NOT NULL").select("row", (F.col("n") * (F.col("carried") + F.col("p"))).alias("s")))
        missed = tried.where("p IS NULL").withColumn("context", F.shiftrightunsigned("key", 16)).join(
            own("g").select("lang", F.col("key").alias("context"), F.col("value").alias("g")), ["lang", "context"], "left")
        left = missed.select("row", "lang", F.col("key").bitwiseAND(F.lit((1 << 16 * max(1, k - 1)) - 1)).alias("key"), "n",
                             (F.col("carried") + F.coalesce("g", F.lit(0.0))).alias("carried"))
    parts.append(left.select("row", (F.col("n") * F.col("carried")).alias("s")))
    total = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("s").alias("s"))
    size = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + g["n"])
    return rows.withColumn("size", size).drop("grams").join(total, "row", "left").withColumn(
        "log_perplexity", F.when(F.col("size") > 0, -F.col("s") / F.col("size"))).drop("row", "size", "s")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                  below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The figures of ``scores`` with ``base_failed``, the language's band (``low``, ``high``) and ``kept``."""
    failed = (F.col("n_words") < MINIMUM_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = written(scores(docs, kneser_ney(docs, text, lang), text, lang, doc_id).withColumn("base_failed", failed), "scores")
    good = found.where("NOT base_failed").select("lang", "log_perplexity")
    middle = written(good.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")), "middle")
    spread = good.join(small_or_shuffled(middle), "lang").groupBy("lang").agg(
        F.first("middle").alias("middle"),
        (1.4826 * F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000)).alias("spread"))
    bands = written(spread.select("lang", (F.col("middle") - below * F.col("spread")).alias("low"),
                                  (F.col("middle") + above * F.col("spread")).alias("high")), "bands")
    inside = (F.col("low") == F.col("high")) | F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return found.join(small_or_shuffled(bands), "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "log_perplexity", "low", "high")
