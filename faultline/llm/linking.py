"""Links of similar items, found as neighbours in sorted MinHash signatures.

Items stand in several orders: a row of ``orders`` has ``node, size, tree, label``, and rows of one ``tree`` sorted by
``label`` are neighbours. A label is the whole signature, turned so that it begins with what the tree sorts by. All
orders are sorted in range partitions of bounded size, so a tree or label that holds a third of all rows is split like
any other. A node's candidates are the nearest nodes on both sides that are not in its component yet, and the first node
with its very label, if the whole signatures make the similarity possible. Pairs are linear in rows: a group of
copies costs its size, not its square. A range border parts two neighbours in one order only.

What is still apart then is compared within regions, the rows of one tree whose labels begin alike. A region is dealt to
blocks of bounded size, and every two blocks meet in a group of their own, so no border parts two rows and no task sees
a whole region. Signatures tell which nodes may still have a link; only these get a longer sketch and their full set and are
compared again. What the sketches leave is confirmed in the same task, which returns only links that join two components.
Two nodes are compared in the first region that they share, and not within a component, so the work grows with the square only
for crowds of different items that are alike but not linked, and nothing is kept of a pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from faultline.llm.common import numbers, small_or_shuffled, written
from faultline.llm.components import components

#: Rows of a range partition, about 200 bytes each.
RUN = 75_000
#: So many best candidates of each node are confirmed in a round; what they join needs no further link.
BEST = 2
#: Candidates that a row of an order may give; a node has a row in each order.
KEPT = 3
#: Neighbouring components looked at on each side, of all nodes and then of nodes in crowded regions.
REACH = (2, 8)
#: Rows of a block of a region; two blocks are compared at once.
BLOCK = 2048
#: Bytes of a block's signatures and sets; a region of more has more blocks.
BLOCK_BYTES = 8_000_000
#: A node without any neighbour of this likeness is in no crowded region: nothing hides its near copies.
CROWD = 0.4


def _known(orders: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``orders`` with the ``component`` that ``labels`` has of linked nodes; others are their own."""
    return orders.withColumn("component", F.col("node")) if labels is None else orders.join(
        small_or_shuffled(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))


def neighbours(orders: DataFrame, rows: int, labels: DataFrame | None, percent: int, slack: float, reach: int, depth: int) -> DataFrame:
    """``a, b, likeness, fits``: of each node in each of ``rows`` rows of ``orders``, the nearest nodes of ``reach`` other
    components on each side, and the first whose label begins with the same ``depth`` bytes.

    ``labels`` has ``node, component`` of linked nodes. Pairs of a likeness under ``CROWD`` are left out; ``fits``
    says whether a pair may reach ``percent``, with ``slack`` for the error of the likeness.
    """
    sorted_rows = _known(orders, labels).repartitionByRange(max(1, -(-rows // RUN)), "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    least = percent / 100 - slack

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        column = lambda c: np.concatenate([b.column(c).to_numpy() for b in held])
        node, size, comp, tree = (column(c) for c in ("node", "size", "component", "tree"))
        n = len(node)
        sign = np.concatenate([np.frombuffer(b"".join(b.column("label").to_pylist()), np.uint8) for b in held]).reshape(n, -1)
        edge = np.flatnonzero((comp[1:] != comp[:-1]) | (tree[1:] != tree[:-1])) + 1  # where runs of a component begin
        start, end = np.append(0, edge), np.append(edge, n)
        run_of = np.repeat(np.arange(len(start)), end - start)
        row = np.arange(n)
        same = np.append(False, (sign[1:, :depth] == sign[:-1, :depth]).all(axis=1) & (tree[1:] == tree[:-1]))
        first = np.maximum.accumulate(np.where(same, 0, row))  # of rows with this very label
        partners = [first] + [np.where((o := run_of + away) < len(start), start[np.minimum(o, len(start) - 1)], row) for away in range(1, reach + 1)]
        partners += [np.where((o := run_of - away) >= 0, end[np.maximum(o, 0)] - 1, row) for away in range(1, reach + 1)]
        for a in range(0, n, 20_000):  # of each row, the partners that look most alike
            i = row[a : a + 20_000]
            best = np.zeros((KEPT, len(i)))
            whom = np.tile(i, (KEPT, 1))
            for partner in partners:
                j = partner[i]
                other = (tree[i] == tree[j]) & (comp[i] != comp[j]) & ~(whom == j).any(axis=0)
                like = np.where(other, ((sign[i] == sign[j]).mean(axis=1) * 256 - 1) / 255, 0)
                least_at = best.argmin(axis=0)
                better = np.flatnonzero(like > best[least_at, np.arange(len(i))])
                best[least_at[better], better], whom[least_at[better], better] = like[better], j[better]
            k, at = np.nonzero(best >= CROWD)
            i, j, like = i[at], whom[k, at], best[k, at]
            fits = (like >= least) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            yield pa.record_batch([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])),
                                   pa.array(like), pa.array(fits)], ["a", "b", "likeness", "fits"])

    return sorted_rows.mapInArrow(run, "a long, b long, likeness double, fits boolean").groupBy("a", "b").agg(
        F.first("likeness").alias("likeness"), F.first("fits").alias("fits"))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of regions with several components, once for each two blocks ``i, j`` of which one is ``own``, dealt by these."""
    held = sum((F.length(f.name) for f in rows.schema if f.dataType == BinaryType()), F.lit(60))
    regions = numbers(rows.groupBy("tree", "region").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum(held).alias("bytes")
    ).where("low < high").select("tree", "region", "bytes", F.greatest(
        F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "regions")
    bytes_of = regions.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    met = rows.join(small_or_shuffled(regions.drop("bytes")), ["tree", "region"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn(
        "j", F.greatest("own", "other")).drop("blocks", "other")
    keys = ["tree", "region", "i", "j"]
    return met.repartition(max(1, -(-bytes_of // (RUN * 200))), *keys).sortWithinPartitions(*keys, "own", "node")


def _linking(x: np.ndarray, away: int, sets: list[np.ndarray], group: np.ndarray, percent: int) -> list[int]:
    """Those of the rows ``x`` whose sets link them with the row ``away``, but for pairs in one ``group``; links join groups."""
    found = []
    for i in x.tolist():
        if group[i] == group[i + away]:
            continue
        one, two = sets[i], sets[i + away]
        at = np.minimum(one.searchsorted(two), len(one) - 1)
        shared = np.count_nonzero(one[at] == two)
        if 100 * shared >= percent * (len(one) + len(two) - shared):
            found.append(i)
            group[group == group[i]] = group[i + away]
    return found


def compared(rows: DataFrame, percent: int, slack: float, width: int, as_links: bool) -> DataFrame:
    """All of each region compared by ``signature``, but for pairs of one component: the rows that have a partner which
    may reach ``percent``, without their signatures, or links ``a, b`` that join the components of all linked rows.

    ``rows`` has ``node, size, component, tree, region, nth, places, signature``; ``places`` are the places of ``width`` bytes
    that the node has in all orders, ``nth`` of them is this one. Two nodes are compared in the first place that they share. For links,
    ``shingles`` has the sorted set of each node, by which pairs are confirmed at once: a task returns fewer links than it has rows.
    """
    dealt = _dealt(rows)
    least = percent / 100 - slack
    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    kept = ["node", "size", "component", "tree", "region", "nth", "places"]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        column = lambda c: np.concatenate([b.column(c).to_numpy() for b in held])
        node, size, comp, tree, own, i_of, j_of, nth = (column(c) for c in ("node", "size", "component", "tree", "own", "i", "j", "nth"))
        n = len(node)
        text = lambda c: np.frombuffer(b"".join(b"".join(b.column(c).to_pylist()) for b in held), np.uint8).reshape(n, -1)
        sign, begins, places = text("signature"), text("region"), text("places").reshape(n, -1, width)
        sets = [np.frombuffer(x, np.uint64) for b in held for x in b.column("shingles").to_pylist()] if as_links else []
        joined = np.unique(comp, return_inverse=True)[1]
        new = (begins[1:] != begins[:-1]).any(axis=1)
        for x in (tree, i_of, j_of):
            new |= x[1:] != x[:-1]
        group = np.append(0, np.cumsum(new))
        within = i_of == j_of  # other groups compare rows of two blocks
        some = np.zeros(n, bool)
        i, away = np.arange(n), 0
        while True:
            away += 1
            i = i[: np.searchsorted(i, n - away)]
            i = i[group[i] == group[i + away]]  # a row without one at this distance has none further away
            if not len(i):
                break
            x = i[(joined[i] != joined[i + away]) & (within[i] | (own[i] != own[i + away]))]
            x = x[100 * np.minimum(size[x], size[x + away]) >= percent * np.maximum(size[x], size[x + away])]
            for first in range(0, len(x), 20_000):
                y = x[first : first + 20_000]
                like = ((sign[y] == sign[y + away]).mean(axis=1) * 256 - 1) / 255
                y = y[like >= least]
                y = y[(places[y] == places[y + away]).all(axis=2).argmax(axis=1) == nth[y]]
                if not as_links:
                    some[y] = some[y + away] = True
                elif links := _linking(y, away, sets, joined, percent):
                    a, b = node[links], node[np.array(links) + away]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        if not as_links:
            at = 0
            for b in held:
                found = pa.array(some[at : at + b.num_rows])
                at += b.num_rows
                yield b.select(kept).filter(found)

    if as_links:
        return dealt.mapInArrow(run, "a long, b long").distinct()
    return dealt.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept)).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def linked_components(orders: DataFrame, confirm: Callable[[DataFrame], DataFrame], sketch: Callable[[DataFrame], DataFrame],
                      places: Callable[[DataFrame], DataFrame], width: int,
                      percent: int, slack: float, sketch_slack: float, depth: int, prefix: int = 0,
                      of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """``node, component`` of nodes that are linked with another; none if no two are.

    ``confirm`` returns those of a written table of pairs ``a, b`` which are links, ``sketch`` the ``node, signature, shingles`` of a
    written table of nodes, longer signatures whose error ``sketch_slack`` allows for and sorted sets, and ``of`` the orders of such nodes.
    ``places`` adds ``nth, places`` to rows of orders: equal ``width`` bytes at one place stand for one tree and region.
    First, all nodes are sorted and the best candidates of each confirmed. Then nodes in crowded regions are sorted
    again, to look past what they are linked with, and again the best confirmed. These two rounds only join most of what
    belongs together; then all of each crowded region are compared that are still apart, which leaves nothing out.
    ``prefix`` says how many first bytes the labels of a region share.
    """
    of = of or (lambda nodes: written(orders.join(small_or_shuffled(nodes), "node", "left_semi"), "again"))
    near = numbers(neighbours(orders, orders.count(), None, percent, slack, REACH[0], depth), "near")
    crowd = numbers(_ends(near), "crowd")
    if crowd.isEmpty():
        return None
    best = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("likeness"), "a", "b"))
    best_of = lambda found: numbers(found.where("fits").withColumn("at_a", best("a")).withColumn("at_b", best("b")).where(
        (F.col("at_a") <= BEST) | (F.col("at_b") <= BEST)).select("a", "b"), "pairs")
    pairs, labels = best_of(near), None
    if not pairs.isEmpty():
        labels = _joined(written(confirm(pairs), "links"), None)
        again = of(crowd)
        more = neighbours(again, again.count(), labels, percent, slack, REACH[1], depth)
        pairs = best_of(more.join(small_or_shuffled(pairs), ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            labels = _joined(written(confirm(pairs), "links"), labels)
    rows = places(_known(of(crowd), labels)).select(
        "node", "size", "component", "tree", F.expr(f"substring(label, 1, {prefix})").alias("region"), "nth", "places", F.col("label").alias("signature"))
    rows = numbers(compared(rows, percent, slack, width, False), "alike")
    if rows.isEmpty():
        return labels
    sketches = written(sketch(numbers(rows.select("node").distinct(), "sketched")), "sketches")
    return _joined(written(compared(rows.join(sketches, "node"), percent, sketch_slack, width, True), "links"), labels)


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """Components of ``labels`` and the written ``links`` together."""
    if links.isEmpty():
        return labels
    stars = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return numbers(components(stars), "labels")
