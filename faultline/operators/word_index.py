"""Which of many words occur in which texts: an inverted index of character grams.

Every word is filed under one of its grams of ``Q`` characters, or of ``LONG`` if it is that long, the one that fewest words have;
shorter words are their own gram. Texts are read once, whatever the number of words: the runs of bytes of the lengths that grams have
are hashed, and a bit set of the hashes of all grams, which every task gets, lets through those that may be filed. Only these meet the
index, by an equality join, and the words found there are compared with the text. So the work for a text grows with its
length and the words it nearly holds, and the rows that travel with the words that are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

Q, LONG = 4, 8
#: Up to this many words the index is sent to all tasks, some tens of megabytes at most; a larger one is joined by size.
SLICE = 200_000
#: Bits of the set for each gram, and bytes of text that are hashed at once.
BITS, CHUNK = 32, 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)  # fixed by the seed


def grams(text: Column, q: int = Q) -> Column:
    """All runs of ``q`` characters, overlapping, in one scan."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def filed(words: DataFrame, word: str) -> DataFrame:
    """``words`` with ``gram``: the rarest gram of the text in ``word``, which should be in lower case."""
    size = F.length("_word")
    own = F.when(size < Q, F.array("_word")).otherwise(F.array_distinct(
        F.when(size < LONG, grams(F.col("_word"))).otherwise(grams(F.col("_word"), LONG))))
    listed = words.select(F.col(word).alias("_word")).distinct().select(
        "_word", F.explode(F.filter(own, lambda g: F.contains("_word", g))).alias("gram"))  # none that begins inside a pair of surrogates
    often = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("_often"))
    best = listed.join(often, "gram").groupBy("_word").agg(F.min_by("gram", F.struct("_often", "gram")).alias("gram"))
    return words.join(best, words[word] == best["_word"]).drop("_word")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(data: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each length, the hashes of all runs of so many bytes; equal runs have equal hashes wherever they begin."""
    back = _powers(_STEP, len(data) + 1)
    upto = np.append(U(0), np.cumsum(_BYTES[data] * _powers(_BASE, len(data) + 1)[:-1], dtype=U))
    for n in sizes:
        if n <= len(data):
            h = (upto[n:] - upto[: len(upto) - n]) * back[: len(upto) - n]
            h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
            yield n, h ^ (h >> U(29))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> U(64 - bits), h & U((1 << bits) - 1)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts without nulls, and where each text begins and the last one ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)), ends - ends[0]


def _gram_hashes(index: DataFrame) -> DataFrame:
    """``index`` with ``_gram``, the hash of its gram."""
    def run(batches):
        for batch in batches:
            data = [np.frombuffer(g.encode(), np.uint8) for g in batch.column("gram").to_pylist()]
            own = np.array([next(run_hashes(d, [len(d)]))[1][0] for d in data], U)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.view(np.int64))], names=[*batch.schema.names, "_gram"])

    return index.mapInArrow(run, StructType([*index.schema.fields, StructField("_gram", LongType())]))


def found_in(texts: DataFrame, text: str, index: DataFrame, word: str, test: Column, on: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``texts`` with every row of ``index`` that has equal ``on`` columns, if its gram occurs in the text ignoring
    case and ``test`` holds.

    ``index`` is a table made by ``filed`` and written; words without a gram (``''``) are compared with all texts.
    """
    sizes = {r["n"]: r["words"] for r in index.groupBy(F.octet_length("gram").alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()}
    hashed = _gram_hashes(index)
    words = sum(sizes.values())
    bits = min(31, max(16, (BITS * words).bit_length()))
    marked = np.zeros(1 << (bits - 3), np.uint8)
    for place in _places(hashed.select("_gram").distinct().toArrow().column("_gram").to_numpy().view(U), bits):
        np.bitwise_or.at(marked, place >> U(3), np.left_shift(1, (place & U(7)).astype(np.uint8), dtype=np.uint8))
    sent = texts.sparkSession.sparkContext.broadcast(marked)
    lengths = sorted(sizes)

    def run(batches):
        held = lambda place: (sent.value[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 == 1
        for batch in batches:
            data, ends = _bytes_of(batch.column("_low"))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
                rows, own = [np.empty(0, np.int64)], [np.empty(0, U)]
                for n, h in run_hashes(data[ends[at] : ends[to]], lengths):
                    if n == 0:
                        rows.append(np.arange(to - at))
                        own.append(np.full(to - at, h[0]))
                        continue
                    first, second = _places(h, bits)
                    place = np.flatnonzero(held(first))
                    place = place[held(second[place])]
                    row = np.searchsorted(ends[at : to + 1], place + ends[at], side="right") - 1
                    inside = place + ends[at] + n <= ends[at + row + 1]
                    rows.append(row[inside])
                    own.append(h[place[inside]])
                row, gram = np.concatenate(rows), np.concatenate(own)
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                new = np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))[: len(row)]
                row, gram = row[new], gram[new]
                some = np.unique(row)
                if len(some):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, some), len(row)), pa.int32()), pa.array(gram.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some + at)) for c in columns), lists], names=[*columns, "_grams"])
                at = to

    columns = texts.columns
    schema = StructType([*texts.schema.fields, StructField("_grams", ArrayType(LongType()))])
    low = texts.withColumn("_low", F.lower(F.col(text))).where("_low IS NOT NULL")
    each = low.mapInArrow(run, schema).select(*columns, F.explode("_grams").alias("_gram"))
    return each.join(F.broadcast(hashed) if words <= SLICE else hashed, ["_gram", *on]).where(test).drop("_gram", "gram")


# Escapes that stand for the character itself, and letters that would have to be read further. Fixed values.
_PLAIN = set("\\.[]{}()*+-?^$|/\"'#&%,:;<>=!@_~` ")
_SPECIAL = set(".[](){}*+?^$|\\")
_CLASS = re.compile(r"\[\^?(?:\\.|[^\[\]\\&^])(?:\\.|[^\[\]\\&])*\]")


def required_literal(pattern: str) -> str:
    """The longest run of characters that every match of a regular expression must hold, in lower case; ``''`` if none is certain.

    Only what stands outside groups and classes counts. Alternatives at the top, quoting, comments mode, Unicode case, nested
    classes and characters beyond ASCII give no certainty.
    """
    if re.search(r"\\Q|\\E|\(\?[a-zA-Z-]*[xuU]", pattern):
        return ""
    runs, run, depth, i = [], "", 0, 0

    def close():
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        literal = None
        if c == "\\" and i + 1 < len(pattern):
            literal = pattern[i + 1] if pattern[i + 1] in _PLAIN else None
            if literal is None and pattern[i + 1] not in "dDwWsSbBhHvV":
                return ""  # an escape with arguments, a back reference or an unusual anchor
            i += 2
        elif c == "[":
            found = _CLASS.match(pattern, i)
            if not found:
                return ""  # nested or combined classes
            i = found.end()
        elif c in "()":
            depth += 1 if c == "(" else -1
            i += 1
        elif c == "|" and depth == 0:
            return ""
        else:
            literal = c if c not in _SPECIAL and c.isascii() else None
            i += 1
        maybe = i < len(pattern) and (pattern[i] in "?*" or re.match(r"\{0*[,}]", pattern[i:]) is not None)
        if depth == 0 and literal is not None and c not in "()" and not maybe:
            run += literal
            if i < len(pattern) and pattern[i] in "+{":
                close()
        elif depth == 0 or c == "(":
            close()
        while i < len(pattern) and pattern[i] in "?*+{" and c != "(":  # a quantifier with what makes it lazy or possessive
            i = pattern.find("}", i) + 1 if pattern[i] == "{" else i + 1
            if i == 0:
                return ""
    close()
    return max(runs, key=len).lower()


@F.pandas_udf(StringType())
def required_literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: required_literal(p or ""))
