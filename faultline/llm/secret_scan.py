"""Secrets in texts: three counted patterns, and strings that a battery of randomness tests tells from ordinary text.

1. Patterns give the base spans: assignments to names of secrets, access keys, and long hexadecimal numbers.
2. Other strings of ``SHORTEST`` or more symbols of an encoding are candidates. The encoding is the narrowest alphabet that
   holds all symbols; a string of mixed marks is parted at ``/`` and ``+``. Chi-squared of the alphabet's frequencies, runs
   and serial correlation give its distance from random strings of that alphabet.
3. What is expected of ordinary text is learned from all documents: counts of neighbouring symbols in shorter strings. For each encoding and
   length, ``DRAWS`` strings from that chain give the distances that ordinary strings have; a candidate's p-value is the
   part of them that are as near to random. Beyond what draws can show, a normal tail on the logarithm of the distance serves.
4. False discoveries are bounded by the Benjamini-Hochberg rule over all candidates of the corpus, with weights
   in proportion to the information that a string may hold (length times bits of a symbol), so that short strings, which
   look random by chance, need more evidence. The rule works on bins of p-values, rounded up.

Texts are read twice (neighbours, candidates); candidates are written without texts. Nothing is shuffled but counts.

Defined results: a null text is empty, an empty text has no spans. Rows are documents of their own: repeated rows are repeated
results, null ids stay. Very long texts are read whole. Without candidates nothing is added. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import randomness as rn
from faultline.llm.common import small_or_shuffled, table, written

#: Kinds in the order of listing; base patterns with the group that is measured and its least length. Fixed values.
KINDS = ("assign", "access", "hex", "random")
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}

SHORTEST = 16
#: Longer strings are judged as of this length, which asks more of them than they need.
LONGEST = 256
DRAWS = 2_000
FALSE_RATE = 0.01
#: Bins of p-values for each power of ten.
FINE = 20
SEED = 7

_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
_PART = re.compile(rf"[A-Za-z0-9_-]{{{SHORTEST},}}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the base patterns, by start and kind."""
    found = []
    for at, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), at, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, np.ndarray]]:
    """``start, end, encoding, symbols`` of strings that overlap no base span."""
    out, at = [], 0
    spans = sorted((s, e) for s, e, _ in base)
    for m in _RUN.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at < len(spans) and spans[at][0] < m.end():
            continue
        run = m.group().rstrip("=")
        both = ("+" in run or "/" in run) and ("-" in run or "_" in run)
        for start, part in [(x.start(), x.group()) for x in _PART.finditer(run)] if both else [(0, run)]:
            classes = rn.CLASS[np.frombuffer(part.encode("ascii"), np.uint8)]
            encoding = rn.encoding_of(classes)
            whole = m.end() if not both else m.start() + start + len(part)
            out.append((m.start() + start, whole, encoding, rn.PLACE[encoding][classes].astype(np.int64)))
    return out


def neighbours(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each symbol follows each other one, over all texts but for strings as long as candidates."""
    k = len(rn.SYMBOLS)

    def pairs(value: str) -> np.ndarray:
        c = rn.CLASS[np.frombuffer((value + "\n").encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int64)
        edge = np.diff((c >= 0).astype(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        short = np.repeat(end - start < SHORTEST, end - start)
        inside = np.flatnonzero(c >= 0)[short]
        first = inside[:-1][np.diff(inside) == 1]  # two runs never touch
        return c[first] * k + c[first + 1]

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for value in b.column("text").to_pylist():
                total += np.bincount(pairs(value or ""), minlength=k * k)
        yield pa.record_batch([pa.array(np.arange(k * k)), pa.array(total)], ["pair", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(k * k)
    for r in counted.collect():
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, found``: base spans, and candidates with encoding and distance."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    span = "struct<start:long,end:long,kind:string>"
    judged = "struct<start:long,end:long,encoding:int,length:int,distance:double>"

    def run(batches):
        for b in batches:
            base, found = [], []
            for value in b.column("text").to_pylist():
                spans = base_spans(value or "")
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                found.append([{"start": s, "end": e, "encoding": k, "length": min(len(x), LONGEST),
                               "distance": float(rn.distances(x[None, :], int(rn.SIZE[k]))[0])}
                              for s, e, k, x in candidates(value or "", spans)])
            count = lambda k: pa.array([sum(x["kind"] == k for x in spans) for spans in base], pa.int64())
            yield pa.record_batch(
                [b.column("doc_id"), count("assign"), count("access"), count("hex"),
                 pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))),
                 pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()),
                                                     ("length", pa.int32()), ("distance", pa.float64())])))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "found"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base array<{span}>, found array<{judged}>")


def log_p(distance: float, drawn: np.ndarray) -> float:
    """Logarithm to base 10 of the chance that an ordinary string of this kind is as near to random."""
    near = int((drawn <= distance).sum())
    if near >= 10:
        return math.log10((near + 1) / (len(drawn) + 1))
    x = np.log(np.maximum(drawn, 0.0) + 1.0)
    z = (x.mean() - math.log(max(distance, 0.0) + 1.0)) / max(float(x.std()), 0.05)
    tail = math.log10(max(math.erfc(max(z, 0.0) / math.sqrt(2)) / 2, 1e-300))
    return max(tail, -30.0) if near == 0 else max(tail, math.log10((near + 1) / (len(drawn) + 1)) - 1)


def weighed(kinds: list, pairs: np.ndarray, draws: int) -> dict:
    """A table of draws for each encoding and length that candidates have."""
    return {(e, n): rn.ordinary(pairs, e, n, draws, SEED) for e, n in kinds}


def judged(found: DataFrame, pairs: np.ndarray, draws: int = DRAWS) -> DataFrame:
    """``doc_row, start, end, bin`` of candidates: the bin of the p-value divided by the string's weight."""
    each = found.select("doc_row", F.explode("found").alias("c")).select("doc_row", "c.*")
    kinds = each.groupBy("encoding", "length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most encodings times lengths
    if not kinds:
        return None
    total = sum(r["n"] for r in kinds)
    bits = {(r["encoding"], r["length"]): r["length"] * math.log2(int(rn.SIZE[r["encoding"]])) for r in kinds}
    mean = sum(bits[r["encoding"], r["length"]] * r["n"] for r in kinds) / total
    sent = found.sparkSession.sparkContext.broadcast(weighed(sorted(bits), rn.softened(pairs), draws))

    def run(batches):
        for b in batches:
            out = []
            for e, n, d in zip(*(b.column(c).to_pylist() for c in ("encoding", "length", "distance")), strict=True):
                p = log_p(d, sent.value[e, n]) - math.log10(bits[e, n] / mean)
                out.append(math.ceil(min(p, 0.0) * FINE))
            yield pa.record_batch([b.column("doc_row"), b.column("start"), b.column("end"), pa.array(out, pa.int32())],
                                  ["doc_row", "start", "end", "bin"])

    return each.mapInArrow(run, "doc_row long, start long, end long, bin int")


def threshold(bins: list[tuple[int, int]], rate: float) -> int | None:
    """The highest bin up to which false discoveries are expected to be at most ``rate`` of all; none if there is no such bin."""
    total, seen, best = sum(n for _, n in bins), 0, None
    for b, n in sorted(bins):
        seen += n
        if 10 ** (b / FINE) * total <= rate * seen:
            best = b
    return best


def secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: float = FALSE_RATE, draws: int = DRAWS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, extra``: base spans and those that the tests add, as arrays of structs."""
    found = written(scanned(docs, text, doc_id).withColumn("doc_row", F.monotonically_increasing_id()), "scanned")
    graded = judged(found, neighbours(docs, text), draws)
    empty = F.array().cast("array<struct<start:long,end:long>>")
    edge = None
    if graded is not None:
        graded = written(graded, "graded")
        edge = threshold([(r["bin"], r["n"]) for r in graded.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()], rate)
    if edge is None:
        return found.select("doc_id", "n_assign", "n_access", "n_hex", "base", empty.alias("extra"))
    extra = written(graded.where(F.col("bin") <= edge).groupBy("doc_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("extra")), "extra")
    return found.join(small_or_shuffled(extra), "doc_row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("extra", empty).alias("extra"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    place = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.transform(F.concat("base", F.transform("extra", lambda x: F.struct(x["start"], x["end"], F.lit("random").alias("kind")))),
                        lambda x: F.struct(x["start"].alias("start"), place(x).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
                        shown(F.sort_array(keyed)).alias("spans"))
