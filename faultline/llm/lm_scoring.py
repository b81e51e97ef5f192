"""Language-model scores with stupid back-off, by joins on n-gram hashes.

Documents are dealt into blocks of about ``block_bytes``. A block explodes its documents into word
n-grams of orders 1 to ``order`` and adds equal ones up. Count tables are partitioned by ranges of the
n-gram hash: each partition sums the counts of all blocks, so a frequent n-gram costs one entry for each
block, however many documents have it, and joins the sums with the entries that asked for them. Each
block then takes the logarithms at every word and sums them per document.

A word scores c(n-gram) / c(context) at the longest order whose n-gram is in the table, times ``alpha``
for each longer order that its place in the document allows but the table lacks; order 1 divides by the
number of words. N-grams of two words and more are in the table if the corpus has them ``minimum`` times.

Entries travel as sorted 60-bit hashes, stored as compressed differences: a row of the shuffle holds
those of one block and one range. Texts travel compressed too, those of one input batch and block a row. There are as many ranges as blocks, so with executors of more memory, larger
``block_bytes`` keep both few.

Words are separated by white space; A-Z count as a-z. Defined results: null and wordless texts have no
words, a sum of 0 and no mean; rows that repeat a document count and are scored each; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words as ws
from faultline.llm.common import table

ORDER = 3
ALPHA = 0.4
MINIMUM = 2
BLOCK_BYTES = 4 << 20
#: Length of an n-gram's hash. Of a million million different n-grams, one in a million shares its hash.
BITS = 60

U = np.uint64
#: Entry of every block that counts its words.
_ALL = U(0)


def _key(h: np.ndarray) -> np.ndarray:
    return np.maximum(ws.mix(h) >> U(64 - BITS), U(1))


def _block(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each order that end at each word (0 where there is none), text of each word, words per text."""
    parts: list[list[np.ndarray]] = [[] for _ in range(order)]
    of, count = [], []
    for first, part in ws.chunks(texts):
        w = ws.split(part, ws.is_word())
        h = w.hashes
        roll = h
        for k in range(order):
            full = np.zeros(len(h), U)
            if k:
                m = max(0, len(h) - k)
                roll = ws.pair(roll[: m], h[k : k + m])
                same = w.text[:m] == w.text[k : k + m]
                full[k : k + m][same] = _key(roll + U(k))[same]
            else:
                full = _key(h)
            parts[k].append(full)
        of.append(w.text + first)
        count.append(np.bincount(w.text, minlength=len(part)))
    none = np.empty(0, U)
    return ([np.concatenate(p) if p else none for p in parts], np.concatenate(of) if of else none.astype(np.int64),
            np.concatenate(count) if count else none.astype(np.int64))


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, first the lowest bytes of all, compressed: the high ones shrink to nothing."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(U).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=U(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=U)


def _joined(texts: list[bytes]) -> bytes:
    sizes = np.array([len(t) for t in texts], "<u8")
    return zstandard.compress(len(texts).to_bytes(8, "little") + sizes.tobytes() + b"".join(texts), 3)


def _parted(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = 8 + 8 * n + np.cumsum(np.frombuffer(raw[8 : 8 + 8 * n], "<u8")).astype(np.int64)
    return [raw[a:b] for a, b in zip([8 + 8 * n, *ends[:-1]], ends, strict=True)] if n else []


def _texts(block: pa.Table) -> list[bytes]:
    return [t for row in block.column("texts").to_pylist() for t in _parted(row)]


def _entries(grams: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.full(len(grams[0]), _ALL), *(g[g > 0] for g in grams)])


def document_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, alpha: float = ALPHA,
                    minimum: int = MINIMUM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, log_score`` (sum over words, natural logarithm) and ``mean_log_score`` of each row."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.pmod(
        F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"))

    def deal(batches):
        for batch in batches:
            texts, number = ws.encoded(batch.column("text").to_pylist()), batch.column("block").to_numpy()
            for one in np.unique(number):
                own = np.flatnonzero(number == one)
                ids = batch.column("doc_id").take(pa.array(own))
                yield pa.record_batch([pa.array([one], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids),
                                       pa.array([_joined([texts[i] for i in own])], pa.binary())], ["block", "ids", "texts"])

    dealt = rows.mapInArrow(deal, f"block int, ids array<{kind}>, texts binary").repartition(blocks, "block")
    limits = np.array([(2**BITS * r) // blocks for r in range(1, blocks)], dtype=U)

    def asked(block: pa.Table) -> pa.Table:
        keys, n = np.unique(_entries(_block(_texts(block), order)[0]), return_counts=True)
        edges = np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
        rows = [(r, _packed(keys[a:b]), _planes(n[a:b])) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        part, data, counts = zip(*rows, strict=True) if rows else ((), (), ())
        own = block.column("block")[0].as_py()
        return pa.table({"part": pa.array(part, pa.int32()), "block": pa.array([own] * len(rows), pa.int32()),
                         "keys": pa.array(data, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def summed(part: pa.Table) -> pa.Table:
        keys = [_unpacked(k) for k in part.column("keys").to_pylist()]
        n = np.concatenate([_numbers(c) for c in part.column("counts").to_pylist()])
        flat = np.concatenate(keys)
        by_key = np.argsort(flat, kind="stable")
        start = np.flatnonzero(np.diff(flat[by_key], prepend=~flat[by_key[:1]]) != 0)
        sums = np.add.reduceat(n[by_key], start)
        each = np.empty(len(flat), U)
        each[by_key] = np.repeat(sums, np.diff(np.append(start, len(flat))))
        ends = np.cumsum([len(k) for k in keys])
        return pa.table({"block": part.column("block"), "part": part.column("part"), "counts": pa.array(
            [_planes(each[b - len(k) : b]) for k, b in zip(keys, ends, strict=True)], pa.binary())})

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams, of, size = _block(_texts(block), order)
        sums = np.zeros(len(size))
        if len(of):
            flat = _entries(grams)
            keys, at = np.unique(flat, return_inverse=True)
            answers = answers.sort_by("part")
            counts = np.concatenate([_numbers(c) for c in answers.column("counts").to_pylist()]).astype(np.float64)
            assert len(counts) == len(keys)
            logs = np.log(counts)[at]
            words, used = len(of), len(of)
            everything, by_order = logs[0], []
            for g in grams:
                log = np.zeros(words)
                here = g > 0
                log[here] = logs[used : used + int(here.sum())]
                used += int(here.sum())
                by_order.append(log)
            value = by_order[0] - everything
            for k in range(1, order):
                here = grams[k] > 0
                value[here] += np.log(alpha)
                known = np.flatnonzero(here & (by_order[k] >= np.log(minimum) - 1e-9))
                value[known] = by_order[k][known] - by_order[k - 1][known - 1]
            sums = np.bincount(of, value, len(size))
        return pa.table({"doc_id": block.column("ids").combine_chunks().flatten(), "n_words": pa.array(size, pa.int64()), "log_score": pa.array(sums),
                         "mean_log_score": pa.array(sums / np.maximum(size, 1), mask=size == 0)})

    entries = dealt.groupBy("block").applyInArrow(
        asked, "part int, block int, keys binary, counts binary")
    answers = entries.groupBy("part").applyInArrow(summed, "block int, part int, counts binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP1_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT row, i, w[i] AS z, CASE WHEN i > 1 THEN w[i - 1] END AS y, CASE WHEN i > 2 THEN w[i - 2] END AS x
  FROM (SELECT row, w, unnest(generate_series(1, len(w))) AS i FROM t)),
u AS (SELECT z, count(*) AS c FROM p GROUP BY z),
b AS (SELECT y, z, count(*) AS c FROM p WHERE i > 1 GROUP BY y, z),
g AS (SELECT x, y, z, count(*) AS c FROM p WHERE i > 2 GROUP BY x, y, z),
s AS (
  SELECT row, CASE
    WHEN i > 2 AND g.c >= 2 THEN ln(g.c / h.c)
    WHEN i > 1 AND b.c >= 2 THEN ln(b.c / v.c) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(u.c / (SELECT count(*) FROM p)) + (CASE WHEN i > 1 THEN 1 ELSE 0 END + CASE WHEN i > 2 THEN 1 ELSE 0 END) * ln(0.4) END AS l
  FROM p JOIN u USING (z) LEFT JOIN b USING (y, z) LEFT JOIN g USING (x, y, z)
  LEFT JOIN b h ON h.y = p.x AND h.z = p.y LEFT JOIN u v ON v.z = p.y),
d AS (SELECT row, sum(l) AS l FROM s GROUP BY row)
SELECT doc_id, len(w) AS n_words, round(coalesce(l, 0), 6) AS log_score, round(l / len(w), 6) AS mean_log_score
FROM t LEFT JOIN d USING (row)
"""
