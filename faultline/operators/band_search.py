"""Nearest lines inside a time band, for every set of fields that agrees.

What an entry scores with another one further away depends only on *which* fields agree. So of each set of
its fields, the nearest ``limit`` lines on either side that agree on the set and lie in the band hold all that
a ranking by score, then distance, can ask for. One path finds them, however crowded a stretch of time is and
whether or not stamps follow line order:

1. A unit is a time bin of the band's width. Each entry goes to its own bin as one that asks, and to the bins beside it as
   one that may be found, all fields as 64-bit hashes. Bins of more than ``block`` rows are cut into blocks of about that
   many by line, one unit each: rows are counted, so however far apart the lines of a bin are, a bin of few rows
   is one unit. Nothing is copied once for each set of fields.
2. Within a task the rows of a set's equal values are a run in line order. An entry walks to both sides until it
   has ``limit`` lines in the band; stretches whose earliest and latest stamp lie outside the band are stepped over.
   Sets go by falling points and end for an entry that has ``limit`` partners of more points.
3. Where a bin goes on in other blocks, an entry that ran out of lines on a side asks for lines beyond its block, unless its
   ``limit`` best so far outdo all that can be there. If a field of the set has a value of few rows in the bin, it
   asks in a unit of all rows of that value, once for all blocks; rows are copied once for such a field, not for each set.
4. Sets of frequent values only are asked for in the next block on that side which has the same values in that bin,
   until the entry has ``limit`` lines or no block is left. Each such step finds
   the block by an equality join with the list of (values, block), so no pair of blocks without equal values meets.

Entries are told apart by (source, line); values are compared by 64-bit hashes, within one bin of one source.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.plans.staging import staged

#: Rows handled at once in a task, in whole units.
BATCH = 100_000
#: Blocks of a bin end between runs of ``block`` / ``CELLS`` lines, which are what is counted.
CELLS = 16
#: Pairs that a task holds before it keeps the best of each entry.
HELD = 4_000_000
#: Lengths of the stretches that keep their earliest and latest stamp.
STRETCHES = (64, 4096)

U = np.uint64


def field_sets(points: dict[str, int], cap: int) -> list[tuple[int, list[int], list[int]]]:
    """``(points, fields, fields that must differ)`` of all sets that matter, by falling points.

    Fields that reach ``cap`` alone make a set alone, whatever else agrees; pairs of another set agree on nothing more.
    """
    names = list(points)
    rest = [i for i, f in enumerate(names) if points[f] < cap]
    sets = [(cap, [i], []) for i in range(len(names)) if i not in rest]
    for n in range(1, len(rest) + 1):
        for chosen in combinations(rest, n):
            worth = min(cap, sum(points[names[i]] for i in chosen))
            sets.append((worth, list(chosen), [i for i in range(len(names)) if i not in chosen]))
    return sorted(sets, key=lambda w: -w[0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def walk(times: np.ndarray, first: np.ndarray, last: np.ndarray, step: int, t: np.ndarray, need: np.ndarray, band: int,
         inside: np.ndarray | None = None):
    """Of each asking row, the first ``need`` places from ``first`` to ``last`` whose time is at most ``band`` from ``t``.

    ``inside`` tells of rows for which all these places are known to be. Returns numbers of asking rows, their places, and how
    many places each row has.
    """
    got = np.zeros(len(t), np.int64)
    place = first.copy()
    whom, where = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if inside is not None:
        got = np.where(inside, np.maximum(0, np.minimum(need, (last - first) * step + 1)), 0)
        sure = np.repeat(np.arange(len(t)), got)
        whom.append(sure)
        where.append(first[sure] + step * (np.arange(len(sure)) - np.repeat(np.cumsum(got) - got, got)))
        need = np.where(inside, 0, need)
    edges = [(w, np.minimum.reduceat(times, np.arange(0, len(times), w)), np.maximum.reduceat(times, np.arange(0, len(times), w)))
             for w in STRETCHES if len(times) > w]
    q = np.flatnonzero(((last - first) * step >= 0) & (need > 0))
    while len(q):
        p, at = place[q], t[q]
        hit = np.abs(times[p] - at) <= band
        whom.append(q[hit])
        where.append(p[hit])
        got[q[hit]] += 1
        move = np.ones(len(q), np.int64)
        for width, low, high in edges:
            c = p // width
            move[(p % width == (0 if step > 0 else width - 1)) & ((high[c] < at - band) | (low[c] > at + band))] = width
        place[q] = p + step * move
        q = q[(got[q] < need[q]) & ((last[q] - place[q]) * step >= 0)]
    return np.concatenate(whom), np.concatenate(where), got


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, about ``BATCH`` rows or one unit long, with the number of each row's unit."""

    def numbered(table: pa.Table) -> np.ndarray:
        code = table.column("source").combine_chunks().dictionary_encode()
        code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        bins, blk = table.column("bin").to_numpy(), table.column("blk").to_numpy()
        new = (code[1:] != code[:-1]) | (bins[1:] != bins[:-1]) | (blk[1:] != blk[:-1])
        return np.append(0, np.cumsum(new))

    held, rows, enough = [], 0, BATCH
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            unit = numbered(table)
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks(), unit[:cut]
            held, rows = table.slice(cut).to_batches(), rows - cut
            enough = max(BATCH, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, numbered(table)


_OUT = "kind string, source string, bin long, blk long, place long, line long, t long, other long, other_t long, score int, s int, key long, side int, need int, field int"
_PAIR = "source string, line long, other long, other_t long, score int"


def _searched(rows: DataFrame, names: list[str], sets: list, band: int, limit: int, skip: int, whole: bool = False) -> DataFrame:
    """Walks of all asking ``rows``, in whole units.

    Rows have ``source, bin, blk, place`` (their order), ``line, t``, the fields, ``member`` (may be found), ``asks`` (on every set: -1;
    on one: its number; not at all: -2), ``need``, and ``before`` and ``after``: whether blocks on that side are to be looked at.
    With ``whole`` units hold all rows that can be found, so that nothing is looked for in others: only pairs come back, without ``kind``.
    Rows with -3 for ``asks`` only tell that ``t`` is a frequent value of field number ``line`` in their bin, the only one if ``need`` is 1.
    Returns rows of four kinds: ``pair``; ``open``, a set of frequent values and a side which lack ``need`` lines; ``ask``, the same for
    a set whose ``field`` has a rarer value, with the ``place`` where the block ends; and ``key``, the frequent values found in
    a unit that other blocks share a bin with.
    """
    schema = _PAIR if whole else _OUT + "".join(f", {f} long" for f in names)
    cap = max(points for points, _, _ in sets)

    def run(batches):
        for table, unit in _whole_units(batches):
            column = lambda c: table.column(c).to_numpy()
            tells = column("asks") == -3
            sole = {(i, u) for i, u in zip(column("line")[tells & (column("need") == 1)].tolist(), unit[tells & (column("need") == 1)].tolist())}
            often = [(i, _mix(unit[own].astype(U) + U(1)) ^ column("t")[own].view(U)) for i in range(len(names)) if len(
                own := np.flatnonzero(tells & (column("line") == i)))]
            if tells.any():
                table, unit = table.filter(pa.array(~tells)).combine_chunks(), unit[~tells]
            if not len(unit):
                continue
            line, t, member, asks, need = (column(c) for c in ("line", "t", "member", "asks", "need"))
            sides = {-1: column("before"), 1: column("after")}
            value = np.stack([column(f) for f in names]).view(U)
            source, bins, blk = table.column("source").combine_chunks(), column("bin"), column("blk")
            salt = _mix(unit.astype(U) + U(1))
            frequent = np.zeros(len(line), np.int64)  # a bit for each field
            for i, codes in often:
                frequent |= np.isin(value[i] ^ salt, codes).astype(np.int64) << i
            begins = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            several = (sides[-1] | sides[1])[begins]
            # Fields on which all rows agree that can meet: sets that want them to differ find nothing.
            agreed = {i for i in range(len(names)) if (asks == -1).any() and value[i, 0] != 0 and (
                np.minimum.reduceat(value[i], begins) == np.maximum.reduceat(value[i], begins)).all() and (value[i, begins] != 0).all() and all(
                (i, u) in sole for u in unit[begins[several]].tolist())}
            partners = np.zeros(len(line), np.int64)  # of points that are not under those of the last sets
            alive = asks >= -1
            full = asks == -1
            score = None
            found, still, known, held = [], [], [], 0

            def best(found):
                """The best ``limit`` pairs of every entry."""
                x, y, worth = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(x):
                    return x, y, worth
                far, low = np.abs(line[x] - line[y]), cap - worth.astype(np.int64)
                wide, deep = int(far.max()).bit_length(), cap.bit_length()
                if wide + deep + len(line).bit_length() < 64:  # entry, score and distance as one number; only ties look at more
                    code = x << (wide + deep) | low << wide | far
                    order = np.argsort(code)
                    code = code[order]
                    equal = code[1:] == code[:-1]
                    ties = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
                    tied = order[ties]
                    order[ties] = tied[np.lexsort((line[y[tied]], t[y[tied]], code[ties]))]
                else:
                    order = np.lexsort((line[y], t[y], far, low, x))
                x = x[order]
                heads = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                kept = np.arange(len(x)) - np.repeat(heads, np.diff(np.append(heads, len(x)))) < limit
                return x[kept], y[order[kept]], worth[order[kept]]

            def rowed(kind, at, **more):
                have = {"kind": pa.array([kind] * len(at), pa.string()), "source": source.take(pa.array(at)), "bin": pa.array(bins[at]),
                        "blk": pa.array(blk[at]), **{c: pa.array(v) for c, v in more.items()}}
                return pa.record_batch([have[c] if c in have else pa.nulls(len(at), k) for c, k in kinds], [c for c, _ in kinds])

            def beyond(x, y, worth):
                """Rows for the lines that ``still`` lacks, as far as they can be among the best: ``x, y, worth`` are the best within the unit."""
                far = np.abs(line[x] - line[y])
                last = np.flatnonzero(np.append(x[1:] != x[:-1], True)) if len(x) else x
                last = last[np.bincount(x[far > 0], minlength=len(line))[x[last]] >= limit]
                least, reach = np.full(len(line), -1, np.int64), np.zeros(len(line), np.int64)
                least[x[last]], reach[x[last]] = worth[last], far[last]
                run = np.cumsum(np.append(0, unit[1:] != unit[:-1]))
                edge = {-1: line[begins][run], 1: line[np.append(begins[1:], len(line)) - 1][run]}
                rarest = sorted(range(len(names)), key=lambda i: -len(np.unique(value[i])))
                for number, side, w, key, lacks in still:
                    points, fields, _ = sets[number]
                    all_of = sum(1 << i for i in fields)
                    first = full[w]
                    can = ~first | (least[w] < points) | ((least[w] == points) & (np.abs(edge[side][w] - line[w]) < reach[w]))
                    w, key, lacks, first = w[can], key[can], lacks[can], first[can]
                    step = ~first | (frequent[w] & all_of == all_of)
                    common = lambda at: dict(line=line[at], t=t[at], s=np.full(len(at), number, np.int32), side=np.full(len(at), side, np.int32),
                                             **{f: value[i, at].view(np.int64) for i, f in enumerate(names)})
                    if step.any():
                        yield rowed("open", w[step], key=key[step].view(np.int64), need=lacks[step].astype(np.int32), **common(w[step]))
                    if not step.all():
                        at = w[~step]
                        field = np.full(len(at), -1, np.int32)
                        for i in rarest:
                            if i in fields:
                                field[(field < 0) & (frequent[at] >> i & 1 == 0)] = i
                        yield rowed("ask", at, place=2 * edge[side][at] + side, need=lacks[~step].astype(np.int32), field=field, **common(at))

            kinds = [("kind", pa.string()), ("source", pa.string()), *[(c, pa.int64()) for c in ("bin", "blk", "place", "line", "t", "other", "other_t")],
                     ("score", pa.int32()), ("s", pa.int32()), ("key", pa.int64()), ("side", pa.int32()), ("need", pa.int32()), ("field", pa.int32()),
                     *[(f, pa.int64()) for f in names]]
            if whole:
                kinds = [(c, k) for c, k in kinds if c in ("source", "line", "other", "other_t", "score")]
            for number, (points, fields, differ) in enumerate(sets):
                if points != score:
                    alive = alive & ~(full & (partners >= limit))
                    score = points
                if agreed.intersection(differ):
                    continue
                asking = alive & (full | (asks == number))
                linked = member & (sides[-1] | sides[1]) & (asks < 0)  # members of bins that go on in other blocks
                if not asking.any() and not linked.any():
                    continue
                rows_of = np.flatnonzero((value[fields] != 0).all(axis=0))
                if not len(rows_of):
                    continue
                key = np.full(len(rows_of), number + 1, U)
                for f in fields:
                    key = _mix(key * U(0xD6E8FEB86659FD93) + value[f, rows_of])
                order = np.argsort(group := key ^ salt[rows_of], kind="stable")
                at, key, group = rows_of[order], key[order], group[order]
                new = np.append(True, group[1:] != group[:-1])
                has = member[at]
                ahead = np.cumsum(has) - has
                begin = np.flatnonzero(new)
                run_of = np.cumsum(new) - 1
                run_start = ahead[begin]
                run_end = np.append(run_start[1:], has.sum())
                listed = at[has]
                all_of = sum(1 << i for i in fields)
                heads = begin[linked[at[begin]] & (frequent[at[begin]] & all_of == all_of)]
                if len(heads):
                    known.append(rowed("key", at[heads], key=key[heads].view(np.int64)))
                q = np.flatnonzero(asking[at])
                if not len(q) or not len(listed):
                    continue
                a = at[q]
                times = t[listed]
                more = np.append(times, times[-1])  # runs without members begin behind the last one
                soonest, latest = np.minimum.reduceat(more, run_start)[run_of[q]], np.maximum.reduceat(more, run_start)[run_of[q]]
                inside = (latest <= t[a] + band) & (soonest >= t[a] - band)  # all of the run
                for side, goes_on in sides.items():
                    on = np.flatnonzero(full[a] | goes_on[a])
                    p, r = q[on], a[on]
                    first = ahead[p] - 1 if side < 0 else ahead[p] + has[p]
                    last = run_start[run_of[p]] if side < 0 else run_end[run_of[p]] - 1
                    whom, where, got = walk(times, first, last, side, t[r], need[r], band, inside[on])
                    x, y = r[whom], listed[where]
                    more = np.zeros(len(x), bool)
                    for f in differ:
                        more |= (value[f, x] == value[f, y]) & (value[f, x] != 0)
                    x, y = x[~more], y[~more]  # the others belong to a set of more points
                    partners += np.bincount(x, minlength=len(partners))
                    found.append((x, y, np.full(len(x), points, np.int32)))
                    held += len(x)
                    if held > HELD:
                        found = [best(found)]
                        held = len(found[0][0])
                    short = np.flatnonzero((got < need[r]) & goes_on[r] & (not whole))
                    if len(short):
                        still.append((number, side, r[short], key[p[short]], need[r[short]] - got[short]))
            yield from known
            none = np.empty(0, np.int64)
            x, y, worth = best(found) if found else (none, none, none)
            yield from beyond(x, y, worth)
            far = np.abs(line[x] - line[y]) > skip
            x, y, worth = x[far], y[far], worth[far]
            if len(x):
                yield rowed("pair", x, line=line[x], t=t[x], other=line[y], other_t=t[y], score=worth)

    unit = ["source", "bin", "blk"]
    return rows.repartition(*unit).sortWithinPartitions(*unit, "place").mapInArrow(run, schema)


def far_pairs(keys: DataFrame, points: dict[str, int], cap: int, seconds: int, limit: int, skip: int, block: int) -> DataFrame:
    """``source, line, other, other_t, score, distance``: all that the best ``limit`` of an entry can hold, over ``skip`` lines away.

    ``keys`` has ``source, line, t`` (microseconds) and the fields of ``points``; entries without a stamp take no part.
    """
    names, sets, band = list(points), field_sets(points, cap), seconds * 1_000_000
    hashed = [F.when(F.col(f).isNotNull(), F.xxhash64(f)).otherwise(0).alias(f) for f in names]
    base = staged(keys.where(F.col("t").isNotNull()).select(
        "source", "line", "t", F.floor(F.col("t") / F.lit(band)).alias("own"), F.floor(F.col("line") / F.lit(max(1, block // CELLS))).alias("cell"), *hashed), "band_keys")
    around = F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("bin")
    one = F.count(F.lit(1)).alias("n")
    occupied = staged(base.select("source", F.col("own").alias("bin")).distinct(), "band_bins")  # the others have nobody who asks
    crowded = staged(base.groupBy("source", "own").agg(one).select("source", around, "n").groupBy("source", "bin").agg(F.sum("n").alias("n")).where(
        F.col("n") > block).select("source", "bin", F.col("n").alias("rows")), "band_crowded")
    spread = base.select("source", "line", "t", "own", "cell", *names, around).join(occupied, ["source", "bin"], "left_semi")
    whole = Window.partitionBy("source", "bin")
    earlier = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / F.lit(block)).alias("blk")
    units = staged(spread.select("source", "bin", "cell").join(crowded, ["source", "bin"], "left_semi").groupBy("source", "bin", "cell").agg(one).select(
        "source", "bin", "cell", cut).withColumns({"before": F.col("blk") > F.min("blk").over(whole), "after": F.col("blk") < F.max("blk").over(whole)}), "band_units")
    # A value is frequent if it fills a unit, or most blocks have enough rows of it.
    often = F.least(F.lit(block), F.greatest(F.lit(block // CELLS), 2 * limit * F.ceil(F.col("rows") / F.lit(block))))
    valued = lambda rows, fields: rows.withColumn("one", F.explode(F.array(
        *[F.struct(F.lit(i).alias("field"), F.col(names[i]).alias("value")) for i in fields]))).select(*rows.columns, "one.*").where("value <> 0")
    frequent = staged(valued(spread.join(crowded, ["source", "bin"]).select("source", "bin", "rows", *names), range(len(names))).groupBy(
        "source", "bin", "rows", "field", "value").agg(one).where(F.col("n") > often).select(
        "source", "bin", "field", "value", (F.col("n") == F.col("rows")).alias("sole")), "band_frequent")
    no, place = F.lit(False), (2 * F.col("line")).alias("place")
    members = spread.join(units, ["source", "bin", "cell"], "left").select(
        "source", "bin", F.coalesce("blk", F.lit(0)).alias("blk"), place, "line", "t", "own", *names, F.coalesce("before", no).alias("before"), F.coalesce("after", no).alias("after"))
    told = frequent.join(units.select("source", "bin", "blk").distinct(), ["source", "bin"]).select(
        "source", "bin", "blk", F.lit(0).alias("place"), F.col("field").cast("long").alias("line"), F.col("value").alias("t"), *[F.lit(0).alias(f) for f in names],
        no.alias("member"), F.lit(-3).alias("asks"), F.col("sole").cast("int").alias("need"), no.alias("before"), no.alias("after"))
    asked = members.select(
        "source", "bin", "blk", "place", "line", "t", *names, F.lit(True).alias("member"), F.when(F.col("own") == F.col("bin"), -1).otherwise(-2).alias("asks"),
        F.lit(limit).alias("need"), "before", "after").unionByName(told)
    found_only = [F.lit(True).alias("member"), F.lit(-2).alias("asks"), F.lit(0).alias("need"), no.alias("before"), no.alias("after")]
    asking = [F.lit(False).alias("member"), F.col("s").alias("asks"), "need", (F.col("side") < 0).alias("before"), (F.col("side") > 0).alias("after")]
    search = lambda rows, name, whole=False: staged(_searched(rows, names, sets, band, limit, skip, whole), name)
    found = search(asked, "band_found")
    pair = lambda df: df.where("kind = 'pair'").select("source", "line", "other", "other_t", "score")
    pairs = pair(found)
    asks = found.where("kind = 'ask'")
    if wanted := sorted(r.field for r in asks.select("field").distinct().collect()):
        by_value, own_unit = ["source", "bin", "field", "value"], F.xxhash64("field", "value").alias("blk")
        asks = asks.withColumn("value", F.element_at(F.array(*names), F.col("field") + 1))
        there = valued(spread.join(crowded, ["source", "bin"], "left_semi").select("source", "bin", "line", "t", *names), wanted).join(
            asks.select(*by_value).distinct(), by_value, "left_semi").select("source", "bin", own_unit, place, "line", "t", *names, *found_only)
        pairs = pairs.unionByName(search(there.unionByName(asks.select("source", "bin", own_unit, "place", "line", "t", *names, *asking)), "band_rare", True))
    same = Window.partitionBy("source", "bin", "key").orderBy("blk")
    links = staged(found.where("kind = 'key'").select(
        "source", "bin", "key", "blk", F.lag("blk").over(same).alias("left"), F.lead("blk").over(same).alias("right")).where(
        "left IS NOT NULL OR right IS NOT NULL"), "band_links")
    while True:
        next_block = F.when(F.col("side") < 0, F.col("left")).otherwise(F.col("right"))
        waiting = staged(found.where("kind = 'open'").join(links, ["source", "bin", "key", "blk"]).withColumn("blk", next_block).where(
            "blk IS NOT NULL").select("source", "bin", "blk", place, "line", "t", *names, *asking), "band_waiting")
        if waiting.isEmpty():
            return pairs.withColumn("distance", F.abs(F.col("line") - F.col("other")))
        there = members.join(waiting.select("source", "bin", "blk").distinct(), ["source", "bin", "blk"], "left_semi").select(
            "source", "bin", "blk", "place", "line", "t", *names, *found_only)
        found = search(there.unionByName(waiting), "band_found")
        pairs = pairs.unionByName(pair(found))
