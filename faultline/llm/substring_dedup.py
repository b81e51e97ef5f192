"""Repeated passages: MinHash banding of paragraphs, and runs of repeated sentences inside them.

A paragraph is a line of at least ``MINIMUM`` words, a set of five-word shingles. Bands of
``ROWS`` minimum hashes are as many as the wanted recall at the similarity limit takes. Paragraphs
that collide in a band are joined with those of the band which look most alike by their signatures,
and confirmed by the exact Jaccard similarity of their full sets; components of confirmed links are
clusters. Paragraphs that share a band but no component yet are joined with further ones once more, and at
last with all of the band that may be similar enough: pairs stay linear in paragraphs but for those of
different, alike texts, and a band that a group of copies of any size fills is dealt to blocks of bounded size.

A passage may also stand inside a longer line. For that, sentences (long ones cut further after
words that their own hash chooses) of four words and more that occur in several documents are
joined by hash; runs of them in a document with ``MINIMUM`` words or more are repeated passages.

Of each cluster the document with the smallest id keeps its text; the others lose the span. Sequences
of words are told apart by 64-bit hashes.

Defined results: null and wordless texts have no span; what one document repeats within itself stays;
documents without an id keep everything; rows that repeat an id are one document with several texts,
each cut where its own text repeats another id's; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words as ws
from faultline.llm.common import fresh, small_or_shuffled, table, written
from faultline.llm.linking import linked_components
from faultline.llm.near_dedup import LONG, SKETCH_SLACK, signatures

SHINGLE = 5
PERCENT = 80
MINIMUM = 25
ROWS = 3
RECALL = 0.9995
SENTENCE = 4
LONG_SENTENCE = 24
#: Candidates may look so much less similar by signature than they must be: four standard deviations.
SLACK = 0.28

#: A broadcast table of a single number may have so many rows, 32 MB.
KEYS = 2_000_000

U = np.uint64


def bands(percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> int:
    """How many bands find a pair at the limit with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


_random = np.random.Generator(np.random.PCG64(3))
_TIMES = _random.integers(0, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 2**32, 256, dtype=np.uint32)


def _sequence_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``start`` up to ``end`` (numbers of words), for any number of sequences."""
    up, down = ws.powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return ws.mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


class Cut:
    """Paragraphs and sentences of a chunk of texts, as numbers of words."""

    def __init__(self, texts: list[bytes], minimum: int) -> None:
        w = self.words = ws.split(texts, ws.is_word())
        n = len(w.hashes)
        lines = np.cumsum(w.data == 10)
        line = lines[w.start] if n else np.empty(0, np.int64)
        last = np.ones(n, bool)
        last[:-1] = line[1:] != line[:-1]
        self.line_end = np.flatnonzero(last) + 1
        self.line_start = np.append(0, self.line_end[:-1]) if n else self.line_end
        long = self.line_end - self.line_start >= minimum
        self.line_start, self.line_end = self.line_start[long], self.line_end[long]
        stop = last | np.isin(w.data[w.end - 1], np.frombuffer(b".!?", np.uint8)) if n else last
        size = np.diff(np.append(0, np.flatnonzero(stop) + 1))
        stop = stop | ((w.hashes % U(8) == 0) & (np.repeat(size, size) > LONG_SENTENCE))
        self.end = np.flatnonzero(stop) + 1
        self.start = np.append(0, self.end[:-1]) if n else self.end
        enough = self.end - self.start >= SENTENCE
        self.start, self.end = self.start[enough], self.end[enough]
        self.place = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # characters before each byte

    def spans(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, and first and one-past-last character in it, of runs of words."""
        w = self.words
        of = w.text[start]
        base = self.place[w.begin[of]]
        return of, self.place[w.start[start]] - base, self.place[w.end[end - 1]] - base

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all paragraphs end to end, and where each paragraph's begin."""
        h = self.words.hashes
        m = max(0, len(h) - SHINGLE + 1)
        roll = h[:m]
        for k in range(1, SHINGLE):
            roll = ws.pair(roll, h[k : m + k])
        count = self.line_end - self.line_start - SHINGLE + 1
        begin = np.append(0, np.cumsum(count))
        at = np.arange(begin[-1]) - np.repeat(begin[:-1] - self.line_start, count)
        return roll[at], begin

    def nodes(self) -> np.ndarray:
        return _sequence_hashes(self.words.hashes, self.line_start, self.line_end).view(np.int64)


def _band_keys(h: np.ndarray, begin: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and the low byte of each minimum hash, of every paragraph."""
    out = np.zeros((len(begin) - 1, count), dtype=U)
    low = np.zeros((len(out), count * ROWS), dtype=np.uint8)
    if not len(out):
        return out, low
    small = (h >> U(32)).astype(np.uint32)
    for b in range(count):
        key = np.full(len(out), b, dtype=U)
        for k in range(b * ROWS, (b + 1) * ROWS):
            least = np.minimum.reduceat(small * _TIMES[k] + _PLUS[k], begin[:-1])
            low[:, k] = least
            key = ws.pair(key, least.astype(U))
        out[:, b] = key
    return out, low


_PARAGRAPH = "node long, start int, stop int, words int, bands array<long>, signature binary"
_SENTENCE = "key long, start int, stop int, words int"


def units(docs: DataFrame, text: str, doc_id: str, minimum: int, count: int) -> DataFrame:
    """``doc_id, fingerprint, paragraphs, sentences`` of each row."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def listed(of, n, fields):
        offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    def run(batches):
        for batch in batches:
            for first, part in ws.chunks(ws.encoded(batch.column("text").to_pylist())):
                cut = Cut(part, minimum)
                of, start, stop = cut.spans(cut.line_start, cut.line_end)
                keys, low = _band_keys(*cut.sets(), count)
                keys = keys.view(np.int64)
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * count
                paragraphs = listed(of, len(part), {
                    "node": pa.array(cut.nodes()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32()),
                    "words": pa.array(cut.line_end - cut.line_start, pa.int32()),
                    "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    "signature": pa.array([x.tobytes() for x in low], pa.binary())})
                of, start, stop = cut.spans(cut.start, cut.end)
                sentences = listed(of, len(part), {
                    "key": pa.array(_sequence_hashes(cut.words.hashes, cut.start, cut.end).view(np.int64)),
                    "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32()),
                    "words": pa.array(cut.end - cut.start, pa.int32())})
                own = slice(first, first + len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0)[own], batch.column(1)[own], paragraphs, sentences],
                                                 names=["doc_id", "fingerprint", "paragraphs", "sentences"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("fingerprint"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint long, paragraphs array<struct<{_colons(_PARAGRAPH)}>>, sentences array<struct<{_colons(_SENTENCE)}>>")


def _colons(fields: str) -> str:
    return ", ".join(":".join(f.split(" ")) for f in fields.split(", "))


def _sets_of(ends: DataFrame, lines: DataFrame, docs: DataFrame, text: str, doc_id: str, minimum: int, sketched: bool) -> DataFrame:
    """``node, shingles`` of the paragraphs ``ends``, or ``node, signature, shingles`` with their sketches, from one text of each."""
    wanted = written(lines.select("node", "fingerprint").join(ends, "node").groupBy("node").agg(
        F.min("fingerprint").alias("fingerprint")), "wanted")
    near = docs.select(F.xxhash64(doc_id, text).alias("fingerprint"), F.col(text).alias("text")).join(
        small_or_shuffled(wanted.select("fingerprint").distinct()), "fingerprint", "left_semi").select("text")
    names, kinds = ("signature, shingles", "signature binary, shingles binary") if sketched else ("shingles", "shingles array<long>")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, part in ws.chunks(ws.encoded(batch.column("text").to_pylist())):
                cut = Cut(part, minimum)
                h, begin = cut.sets()
                nodes = cut.nodes().tolist()
                new = [i for i, k in enumerate(nodes) if not (k in seen or seen.add(k))]
                if not new:
                    continue
                sets = [h[begin[i] : begin[i + 1]] for i in new]
                if sketched:
                    own = np.append(0, np.cumsum([len(x) for x in sets]))
                    values = [pa.array([x.tobytes() for x in signatures(np.concatenate(sets), own, LONG)], pa.binary()),
                              pa.array([np.unique(x).tobytes() for x in sets], pa.binary())]
                else:
                    values = [pa.array([np.unique(x).view(np.int64) for x in sets], pa.list_(pa.int64()))]
                yield pa.record_batch([pa.array([nodes[i] for i in new], pa.int64()), *values], ["node", *names.split(", ")])

    made = near.mapInArrow(run, f"node long, {kinds}").join(small_or_shuffled(wanted.select("node")), "node")
    return made.dropDuplicates(["node"]) if sketched else made


def _confirmed(pairs: DataFrame, lines: DataFrame, docs: DataFrame, text: str, doc_id: str, minimum: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` of paragraphs whose full shingle sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets_of(ends, lines, docs, text, doc_id, minimum, False), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return small_or_shuffled(pairs.select("a", "b")).join(one, "a").join(two, "b").where(
        100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def _clusters(lines: DataFrame, docs: DataFrame, text: str, doc_id: str, minimum: int, percent: int, hashes: int) -> DataFrame | None:
    """``node, component`` of paragraphs that are linked with another; none if no two are."""
    keyed = lines.select(F.explode("bands").alias("key"), "node")
    shared = written(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"), "bands")
    found = written(keyed.join(small_or_shuffled(shared, KEYS), "key").distinct(), "collisions")
    turned = F.expr(f"concat(substring(signature, pmod(key, {hashes}) + 1, {hashes}), substring(signature, 1, pmod(key, {hashes})))")
    known = written(lines.select("node", "signature", "bands").join(small_or_shuffled(written(
        found.select("node").distinct(), "colliding"), KEYS), "node").groupBy("node").agg(
        F.min("signature").alias("signature"), F.min("bands").alias("bands")), "known")
    members = found.join(small_or_shuffled(known.select("node", "signature")), "node").select(
        "node", F.lit(1).alias("size"), F.col("key").alias("tree"), turned.alias("label"))
    confirm = lambda pairs: _confirmed(pairs, lines, docs, text, doc_id, minimum, percent)
    sketch = lambda ends: _sets_of(ends, lines, docs, text, doc_id, minimum, True)
    keys = F.unhex(F.array_join(F.transform("bands", lambda k: F.lpad(F.hex(k), 16, "0")), ""))
    places = lambda rows: rows.join(small_or_shuffled(known.select("node", "bands")), "node").withColumn(
        "nth", F.expr("cast(array_position(bands, tree) - 1 as int)")).withColumn("places", keys)
    return linked_components(members, confirm, sketch, places, 8, percent, SLACK, SKETCH_SLACK, hashes)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", minimum: int = MINIMUM,
                   percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """``doc_id, fingerprint, kind, start, stop, words, kept_doc_id``: what to cut, in characters from 0, and who keeps it.

    ``kind`` is paragraph or passage; spans of the two kinds may overlap.
    """
    found = written(units(docs, text, doc_id, minimum, bands(percent, ROWS, recall)).where(F.col("doc_id").isNotNull()), "units")
    lines = found.select("doc_id", "fingerprint", F.inline("paragraphs"))
    labels = _clusters(lines, docs, text, doc_id, minimum, percent, bands(percent, ROWS, recall) * ROWS)
    lines = lines.drop("bands", "signature")
    flat = lines.withColumn("class", F.col("node")) if labels is None else lines.join(
        small_or_shuffled(labels), "node", "left").withColumn("class", F.coalesce("component", "node"))
    whole = _later(flat, "class").select(
        "doc_id", "fingerprint", F.lit("paragraph").alias("kind"), "start", "stop", "words", "kept_doc_id")
    sentences = found.select("doc_id", "fingerprint", F.posexplode("sentences").alias("nth", "s")).select(
        "doc_id", "fingerprint", "nth", "s.*")
    runs = _later(sentences, "key").groupBy("doc_id", "fingerprint").agg(
        F.array_sort(F.collect_set(F.struct("nth", "start", "stop", "words", "kept_doc_id"))).alias("found"))
    # runs of neighbouring sentences
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    one = f"array<struct<nth:int,start:int,stop:int,words:int,kept_doc_id:{kind}>>"
    joined = F.aggregate("found", F.array().cast(one), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1)))["nth"] == s["nth"] - 1),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_longer(F.element_at(done, F.greatest(F.size(done), F.lit(1))), s)))
    ).otherwise(F.concat(done, F.array(s))).cast(one))
    passages = runs.select("doc_id", "fingerprint", F.inline(F.filter(joined, lambda r: r["words"] >= minimum))).select(
        "doc_id", "fingerprint", F.lit("passage").alias("kind"), "start", "stop", "words", "kept_doc_id")
    return whole.unionByName(passages)


def _longer(run, s):
    return F.struct(s["nth"].alias("nth"), run["start"].alias("start"), s["stop"].alias("stop"),
                    (run["words"] + s["words"]).alias("words"), F.least(run["kept_doc_id"], s["kept_doc_id"]).alias("kept_doc_id"))


def _later(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key also occurs in a document of a smaller id, with the smallest as ``kept_doc_id``."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last")).where("kept_doc_id < last").drop("last")
    return rows.join(ends, key).where("doc_id > kept_doc_id")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without repeated spans; documents that have no word left are dropped, others keep their columns."""
    key, cuts, before = fresh(docs.columns, "fingerprint", "cuts", "before")
    spans = repeated_spans(docs, text, doc_id, **kw).groupBy("fingerprint").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(cuts)).withColumnRenamed("fingerprint", key)
    spans = written(spans, "cuts")
    rest = F.aggregate(cuts, F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")), lambda a, s: F.struct(
        F.greatest(a["at"], s["stop"]).alias("at"),
        F.concat(a["kept"], F.substring(F.col(text), a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))).alias("kept")))
    tail = lambda r: F.concat(r["kept"], F.substring(F.col(text), r["at"] + 1, F.length(F.col(text))))
    joined = docs.withColumn(key, F.xxhash64(doc_id, text)).join(small_or_shuffled(spans), key, "left").withColumn(before, rest)
    cut = F.regexp_replace(tail(F.col(before)), r"\n{2,}", "\n")
    out = joined.withColumn(text, F.when(F.col(cuts).isNull(), F.col(text)).otherwise(cut))
    return out.where(F.col(cuts).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("fingerprint")
