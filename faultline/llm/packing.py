"""Packing of token sequences by a configuration linear program over the histogram of lengths.

1. Texts become token ids (byte-level BPE) and one end id. Documents longer than a sequence are
   cut into full pieces; the first piece takes what is over.
2. Spark counts the pieces of each length: at most ``capacity`` numbers, whatever the input.
3. On the driver, multiplicative weights solve the linear program "cover every length with as few
   configurations as possible": a round prices the lengths, a knapsack dynamic program, bounded by the
   number of pieces of each length, finds the configuration of highest price that fits into a sequence, it is
   raised, and prices of what it covers fall. The solution is rounded to whole sequences; pieces that
   no rounded configuration holds are placed best-fit, longest first, into the rooms that are left.
4. Each piece learns its place from its rank among the pieces of its length. Ranks come from
   counts per file of the written table, so no task sees all pieces of a frequent length.

Defined results: null and empty texts are the end id alone; rows that repeat a document are packed
each; an empty table gives no piece. The ids are those of ``tokenizers`` for the same vocabulary,
also where a text spells the end-of-text token.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm import words as ws
from faultline.llm.common import small_or_shuffled, table, written

CAPACITY = 2048
END = 0
#: Rounds of the weights are about this many, in which a length is covered so often at least and at most.
ROUNDS = 4000
LEAST_UNITS, MOST_UNITS = 8, 500
#: Lengths that a round prices at once.
POOL = 128
#: Roundings leave lengths up to these parts of a sequence to best-fit.
SMALL = (0, 1 / 16, 1 / 8, 1 / 4, 1 / 3)
#: A sequence is well filled if no more than this part of it is left.
TOLERANCE = 1 / 200
SPECIAL = "<|endoftext|>"


@cache
def _encoders(ranks: str, vocabulary: str):
    """The fast encoder, and a function for texts that spell the special token."""
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cache
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            ids = exact().encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.array([*ids, END], dtype="<u4")

    return encode


def cuts(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``size`` ids."""
    head = size % capacity
    starts = ([0] if head else []) + list(range(head, size, capacity))
    return [(s, (e - s)) for s, e in zip(starts, [*starts[1:], size], strict=True)]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           ranks: str | None = None, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian 32-bit) of every piece.

    ``ranks`` and ``vocabulary`` are paths of the same vocabulary for the two libraries, on every executor.
    """
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        encode = _encoders(ranks, vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                own, rows, size = [], [], 0
                while at < len(texts) and size < ws.CHUNK:
                    ids = encode(texts[at])
                    size += len(ids)
                    for i, (start, length) in enumerate(cuts(len(ids), capacity)):
                        part = ids[start : start + length].tobytes()
                        own.append(at)
                        rows.append((i, start, length, zlib.crc32(part), part))
                    at += 1
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([batch.column("doc_id").take(pa.array(own)), pa.array(columns[0], pa.int32()),
                                       *(pa.array(c, pa.int64()) for c in columns[1:4]),
                                       *([pa.array(columns[4], pa.binary())] if with_ids else [])], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_value(price: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """A configuration of highest price that takes no length more often than it is ``left``, by dynamic programming over
    the room used. ``price[k]`` is that of length ``k``; copies of a length are taken in powers of two."""
    value = np.zeros(capacity + 1)
    items: list[tuple[int, int]] = []
    for k in (np.flatnonzero(left[1:]) + 1).tolist():
        most, step = int(min(left[k], capacity // k)), 1
        while most:
            items.append((k, min(step, most)))
            most -= items[-1][1]
            step *= 2
    taken = np.zeros((len(items), capacity + 1), dtype=bool)
    for i, (k, often) in enumerate(items):
        size = k * often
        total = value[: capacity + 1 - size] + often * price[k]
        taken[i, size:] = total > value[size:]
        value[size:] = np.maximum(total, value[size:])
    out: dict[int, int] = {}
    room = capacity
    for i in reversed(range(len(items))):
        if taken[i, room]:
            k, often = items[i]
            out[k] = out.get(k, 0) + often
            room -= k * often
    return out


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (length: how often) and how many sequences use each; together they hold every piece."""
    full = [({capacity: 1}, counts[capacity])] if counts.get(capacity) else []
    return full + priced({k: n for k, n in counts.items() if n and k < capacity}, capacity)


def covering(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, pool: int = POOL) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional solution of the covering program, and a lower bound on every solution.

    The program: as few sequences as possible, in configurations that hold every length as often as it occurs. Multiplicative
    weights: the price of a length falls with the part of its pieces that is covered, a configuration of highest price is raised
    until it covers one of its lengths once, and all is scaled when each length is covered ``units`` times. The bound is
    the worth of all pieces, over that of the best configuration, at the first or at the last prices.
    """
    sizes = np.array(sorted(counts))
    number = np.array([counts[k] for k in sizes.tolist()], dtype=np.int64)
    at = {k: i for i, k in enumerate(sizes.tolist())}
    units = min(MOST_UNITS, max(LEAST_UNITS, rounds // max(1, len(sizes))))
    rate = np.sqrt(np.log(len(sizes) + 1) / units)
    cover = np.zeros(len(sizes))
    raised: dict[tuple, float] = {}
    draw = np.random.default_rng(len(sizes))

    def best(some):
        price, most = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
        price[sizes[some]] = sizes[some] / capacity * weight[some]
        most[sizes[some]] = number[some]
        chosen = best_value(price, most, capacity)
        return chosen, sum(price[k] * v for k, v in chosen.items())

    if not len(sizes):
        return [], 0.0
    weight = np.ones(len(sizes))
    worth = lambda: float((number * sizes / capacity * weight).sum() / best(np.arange(len(sizes)))[1])
    bound = worth()
    while cover.min() < units:
        weight = np.exp(-rate * (cover - cover.min()))
        # Of many lengths, a draw by their weights is priced at once, and one that is furthest behind.
        some = np.arange(len(sizes)) if len(sizes) <= pool else np.union1d(
            draw.choice(len(sizes), pool, replace=False, p=weight / weight.sum()), [cover.argmin()])
        chosen, _ = best(some)
        step = min(number[at[k]] / v for k, v in chosen.items())
        key = tuple(chosen.items())
        raised[key] = raised.get(key, 0.0) + step / units
        for k, v in chosen.items():
            cover[at[k]] += v * step / number[at[k]]
    weight = np.exp(-rate * (cover - cover.min()))
    return [(dict(key), x) for key, x in raised.items()], max(bound, worth())


def rounded(solution: list[tuple[dict[int, int], float]], counts: dict[int, int], small: int = 0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole sequences instead of fractions, without lengths up to ``small``, and how many pieces of each length are left.

    Fractions are carried on from one configuration to the next, the largest first; no length is taken more often than it is left.
    """
    left, out, carried = dict(counts), [], 0.0
    for content, x in sorted(solution, key=lambda c: -c[1]):
        large = {k: v for k, v in content.items() if k > small}
        if not large:
            continue
        carried += x
        wanted = int(carried + 0.5)
        carried -= wanted
        times = min(wanted, *(left[k] // v for k, v in large.items()))
        if times > 0:
            out.append((large, times))
            for k, v in large.items():
                left[k] -= v * times
    return out, {k: n for k, n in left.items() if n}


def priced(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The covering program, rounded; pieces that no rounded configuration holds are placed best-fit into the rooms that are left.

    Of the roundings of all or of the well filled configurations, which leave lengths up to a part of a sequence to best-fit,
    the one that takes fewest sequences counts.
    """
    solution, _ = covering(counts, capacity)
    well = [(content, x) for content, x in solution if sum(k * v for k, v in content.items()) >= (1 - TOLERANCE) * capacity]
    ways = []
    for chosen in (solution, well):
        for part in SMALL:
            groups, left = rounded(chosen, counts, int(part * capacity))
            ways.append(best_fit(left, capacity, groups))
    return min(ways, key=lambda groups: sum(times for _, times in groups))


def best_fit(counts: dict[int, int], capacity: int, groups=()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram, into the rooms of ``groups`` first: sequences with the same content are handled together."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for content, times in groups:
        by_room.setdefault(capacity - sum(k * v for k, v in content.items()), []).append((content, times))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                content, same, room = {}, n, capacity
            else:
                content, same = by_room[room].pop()
            fit = room // length
            use = min(same, n // fit) if n >= fit else 1
            take = fit if n >= fit else n
            if content and same > use:
                by_room[room].append((content, same - use))
            if room in by_room and not by_room[room]:
                del by_room[room]
            n -= take * use
            by_room.setdefault(room - take * length, []).append(({**content, length: content.get(length, 0) + take}, use))
    return [group for groups in by_room.values() for group in groups]


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces with a ``length``."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for content, times in configurations(counts, capacity):
        offset = 0
        for length, often in content.items():
            starts.setdefault(length, []).append((used.get(length, 0), often, sequence, offset))
            used[length] = used.get(length, 0) + often * times
            offset += often * length
        sequence += times
    places = found.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in starts.items()})

    columns = found.columns
    rows = found.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.partitionBy("length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = written(rows.groupBy("_file", "length").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "files")
    inside = F.row_number().over(Window.partitionBy("_file", "length").orderBy("_row")) - 1
    ranked = rows.withColumn("_inside", inside).join(small_or_shuffled(files), ["_file", "length"]).select(
        *columns, (F.col("_first") + F.col("_inside")).alias("_rank"))

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            ids, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                own = np.flatnonzero(length == one)
                first, often, base, offset = places.value[int(one)]
                g = np.searchsorted(first, rank[own], side="right") - 1
                nth = rank[own] - first[g]
                ids[own], offsets[own] = base[g] + nth // often[g], offset[g] + nth % often[g] * one
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(ids), pa.array(offsets)],
                names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, **tokenizer) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` ids."""
    return packed(written(pieces(docs, text, doc_id, capacity, **tokenizer), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
