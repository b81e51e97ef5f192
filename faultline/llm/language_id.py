"""Language identification by a convolutional network over bytes.

Every text is cut into windows of ``WINDOW`` bytes that overlap by the widest filter, so each
byte and each byte n-gram of the whole text is seen. A window's bytes are embedded; filters of two, three and four bytes slide
over them; the maximum of each filter over the window, after a rectifier, goes to a softmax. A text's
probabilities are the normalised product of those of its windows, each weighted by its bytes.

The network is trained in numpy on the driver (Adam on the log loss of windows, about half of them
short, so that short texts are learned) from a bounded sample: of each language the ``SAMPLE``
documents of lowest id hash with at most ``SAMPLE_BYTES`` bytes. For scoring, embedding and filters
are folded into one table per place in a filter and pair of bytes, so a filter is a sum of look-ups.

Defined results: texts that are null or have no letter are ``und`` with score 0; null languages are
not learned; without any language every text is ``und``; with one language every text with a letter
is that one; rows that repeat a document are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.common import fresh, table
from faultline.llm.words import CHUNK, chunks, encoded

SAMPLE = 300
SAMPLE_BYTES = 20_000
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
STEPS = 700
BATCH = 128
RATE = 0.01
UNKNOWN = "und"


@dataclass
class Network:
    names: list[str]
    embedding: np.ndarray = field(default_factory=lambda: np.empty(0))
    filters: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.empty(0))
    out_bias: np.ndarray = field(default_factory=lambda: np.empty(0))

    @classmethod
    def fit(cls, texts: dict[str, list[bytes]]) -> Network:
        net = cls(sorted(k for k, v in texts.items() if any(v)))
        n = len(net.names)
        if n < 2:
            return net
        rng = np.random.default_rng(7)
        pools = [[t for t in texts[k] if t] for k in net.names]
        net.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        net.embedding[0] = 0
        net.filters = [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        net.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        net.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)).astype(np.float32)
        net.out_bias = np.zeros(n, np.float32)
        weights = [net.embedding, *net.filters, *net.biases, net.out, net.out_bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for step in range(1, STEPS + 1):
            y = rng.integers(0, n, BATCH)
            x = np.zeros((BATCH, WINDOW), np.uint8)
            for i, k in enumerate(y):
                t = pools[k][rng.integers(len(pools[k]))]
                size = WINDOW if rng.random() < 0.5 else int(rng.integers(8, WINDOW))
                at = int(rng.integers(0, max(1, len(t) - size + 1)))
                part = t[at : at + size]
                x[i, : len(part)] = np.frombuffer(part, np.uint8)
            rate = RATE * (1 - 0.9 * step / STEPS)
            for w, (m, v), g in zip(weights, moments, net._gradients(x, y), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.embedding[0] = 0
        return net

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        e = self.embedding[x]
        rows = np.arange(len(x))
        tops, places, columns = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            cols = np.concatenate([e[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
            a = cols @ f + b
            p = a.argmax(axis=1)
            tops.append(np.take_along_axis(a, p[:, None], 1)[:, 0])
            places.append(p)
            columns.append(cols)
        h = np.concatenate(tops, axis=1)
        r = np.maximum(h, 0)
        z = r @ self.out + self.out_bias
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[rows, y] -= 1
        q /= len(x)
        back = (q @ self.out.T) * (h > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_biases = [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = columns[i][rows[:, None], places[i]]
            d_filters.append(np.einsum("nfc,nf->cf", at, g).astype(np.float32))
            d_biases.append(g.sum(axis=0))
            inner = (g[:, :, None] * f.T[None]).reshape(len(x), FILTERS, w, EMBEDDING)
            for k in range(w):
                np.add.at(d_embedding, x[rows[:, None], places[i] + k].ravel(), inner[:, :, k].reshape(-1, EMBEDDING))
        return [d_embedding, *d_filters, *d_biases, r.T @ q, q.sum(axis=0)]

    def tables(self) -> list[list[np.ndarray]]:
        """For each filter width, what each single byte or pair of bytes adds, pair after pair."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            each = [self.embedding @ f[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            each[0] = each[0] + b
            pairs = [(each[k][:, None] + each[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            out.append(pairs + ([each[-1]] if w % 2 else []))
        return out

    def score(self, texts: list[bytes], tables: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities, a row for each text."""
        step = WINDOW - max(WIDTHS) + 1
        count = np.array([max(1, -(-(len(t) - max(WIDTHS) + 1) // step)) for t in texts])
        first = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(int(first[-1]) * step + WINDOW, np.uint8)
        size = np.zeros(int(first[-1]))
        for i, t in enumerate(texts):
            at = first[i] * step
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            left = len(t) - step * np.arange(count[i])
            size[first[i] : first[i + 1]] = np.clip(left, 0, step)
        # a text's last window may reach into the next text's first bytes: blank those
        total = np.zeros((len(texts), len(self.names)))
        of = np.repeat(np.arange(len(texts)), count)
        last = np.zeros(int(first[-1]), bool)
        last[first[1:] - 1] = True
        length = np.array([len(t) for t in texts])
        for a in range(0, int(first[-1]), 512):
            b = min(a + 512, int(first[-1]))
            x = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[a * step : (b - 1) * step + 1 : step].copy()
            for i in np.flatnonzero(last[a:b]):
                t = of[a + i]
                x[i, max(0, length[t] - (a + i - first[t]) * step) :] = 0
            two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            tops = []
            for w, parts in zip(WIDTHS, tables, strict=True):
                n = WINDOW - w + 1
                value = np.take(parts[0], two[:, :n], axis=0)
                for k, p in enumerate(parts[1:], 1):
                    value += np.take(p, two[:, 2 * k : 2 * k + n] if len(p) > 256 else x[:, 2 * k : 2 * k + n], axis=0)
                tops.append(value.max(axis=1))
            z = np.maximum(np.concatenate(tops, axis=1), 0) @ self.out + self.out_bias
            z = z - z.max(axis=1, keepdims=True)
            logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            np.add.at(total, of[a:b], logs * (size[a:b] / step)[:, None])
        q = np.exp(total - total.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on a bounded sample; ``train`` is a condition on the column ``id``."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), F.col("id"))
    chosen = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") <= sample_bytes) & train).select(
        "id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample).select("id", "lang").distinct()
    texts: dict[str, list[bytes]] = {}
    for r in rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "id").agg(
            F.min("text").alias("text")).orderBy("lang", "id").collect():
        texts.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass"))
    return Network.fit(texts)


def identified(docs: DataFrame, net: Network, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and its probability in two new columns."""
    lang, score = fresh(docs.columns, lang, score)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches):
        tables = net.tables() if len(net.names) > 1 else []
        for batch in batches:
            values = batch.column(at).to_pylist()
            texts = encoded(values)
            names, scores = [], []
            for first, part in chunks(texts, CHUNK):
                q = net.score(part, tables) if len(net.names) > 1 else np.ones((len(part), len(net.names)))
                for i, row in enumerate(q):
                    known = len(row) and any(map(str.isalpha, values[first + i] or ""))
                    names.append(net.names[int(row.argmax())] if known else UNKNOWN)
                    scores.append(float(row.max()) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, lang, score])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{lang}` string, `{score}` double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4))
    found = identified(docs.select("doc_id", "text"), fit(docs, fold("id") != 2))
    return found.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")
