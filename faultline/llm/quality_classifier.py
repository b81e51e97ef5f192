"""Quality classifier by compression.

Two zstandard dictionaries are built from pieces of good and of bad labelled texts. A text is
compressed whole with either; the difference of the two sizes, divided by the text's length and
again by the sum of the two sizes, becomes a probability by a logistic fit, with the compressed
share of the text as a third term (endless repetition compresses to nothing with either). The fit
is on labelled texts that gave nothing to the dictionaries, weighted to the share of good labels.

The fit takes a bounded sample of labelled rows: for each label the ``SAMPLE`` rows of lowest id
hash, of documents with at most ``SAMPLE_BYTES`` bytes. Scores cover every text whole.

Defined results: null and empty texts get the score of no difference; null labels are not used;
without labels every score is 0.5, with one kind of label the share of good ones among them;
rows that repeat a document are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import fresh, table
from faultline.llm.words import encoded

SAMPLE = 1200
SAMPLE_BYTES = 20_000
DICTIONARY = 65_536
PIECE = 400
LEVEL = 3
THRESHOLD = 0.3


def _dictionary(texts: list[bytes]) -> bytes:
    """Dictionary of pieces that are spread evenly over each text."""
    pieces = []
    for t in texts:
        n = max(1, min(4, len(t) // PIECE))
        pieces += [t[int(s) : int(s) + PIECE] for s in np.linspace(0, max(0, len(t) - PIECE), n)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: their content serves
        return b"\n".join(pieces)[:DICTIONARY]


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    @classmethod
    def fit(cls, good: list[bytes], bad: list[bytes], share: float) -> QualityModel:
        """``share``: of good ones among all labels."""
        if not good or not bad:
            return cls(weights=(0.0, 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
        model = cls(_dictionary(good[::2]), _dictionary(bad[::2]))
        held = [good[1::2] or good, bad[1::2] or bad]
        x = model.features(held[0] + held[1])
        y = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
        each = np.repeat([share / len(held[0]), (1 - share) / len(held[1])], [len(held[0]), len(held[1])])
        scale = np.maximum(np.abs(x).std(axis=0), 1e-6)
        z = np.column_stack([x / scale, np.ones(len(x))])
        w, ridge = np.zeros(4), np.diag([0.5, 0.5, 0.5, 0.0]) / len(x)  # few labels: close to their share
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (each * (p - y)) + ridge @ w
            w = w - np.clip(np.linalg.solve((z.T * (each * np.maximum(p * (1 - p), 1e-6))) @ z + ridge, slope), -5, 5)
        model.weights = tuple(float(v) for v in w / np.append(scale, 1.0))
        return model

    def features(self, texts: list[bytes]) -> np.ndarray:
        sizes = []
        for d in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_AUTO
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind)) if d \
                else zstandard.ZstdCompressor(level=LEVEL)
            sizes.append(np.array([len(packer.compress(t)) if t else 0 for t in texts], dtype=float))
        good, bad = sizes
        length = np.maximum([len(t) for t in texts], 1) if texts else np.empty(0)
        return np.column_stack([(bad - good) / length, (bad - good) / np.maximum(bad + good, 1), np.minimum(good / length, 1)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        *w, b = self.weights
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(w) + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id",
        label: str = "quality", label_id: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on labelled rows; ``train`` is a condition on the column ``id`` that says which rows may be learned from."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & train)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    body = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") <= sample_bytes)
    texts = {}
    for k in (1, 0):
        order = [F.xxhash64("id"), F.col("id")]
        chosen = known.where(F.col("label") == k).orderBy(*order).limit(sample).select("id").distinct()
        texts[k] = encoded([r["text"] for r in body.join(F.broadcast(chosen), "id").orderBy(*order, "text").limit(sample).collect()])
    total = sum(counts.values())
    return QualityModel.fit(texts[1], texts[0], counts.get(1, 0) / total if total else 0.5)


def scored(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in a new last column."""
    (out,) = fresh(docs.columns, out)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            score = model.score(encoded(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*columns, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a score of at least ``threshold``, in the same columns."""
    model = fit(docs, labels, F.lit(True), text, doc_id)
    out = scored(docs, model, text)
    return out.where(F.col(out.columns[-1]) >= threshold).select(docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5))
    model = fit(docs, table(spark, sf_dir, "labels"), fold("id") != 0)
    return scored(docs, model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
