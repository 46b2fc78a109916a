"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.storage import cut, release

#: Links that a task holds at least, so that few links are few tasks.
LINKS_A_TASK, FEWEST_TASKS = 200_000, 8
#: A point with more links than this, and than links / HUBS, is a hub: there
#: are at most 2 x HUBS of them, whatever the table.
HUB_LINKS, HUBS = 2500, 1000


def _hubs(links: DataFrame, n: int) -> dict[int, int]:
    """The points with most links, and the least of their neighbours and
    themselves; at most 2 x HUBS rows reach the driver."""
    most = max(HUB_LINKS, n // HUBS)
    if n <= most:
        return {}
    found = links.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("m")).filter(F.col("n") > most)
    return {r.a: r.m for r in found.collect()}


def _with_least(links: DataFrame, least: DataFrame, hubs: dict[int, int], tasks: int) -> DataFrame:
    """``links`` (a, b) with ``m`` of each a: hubs' links get theirs from a
    (bounded) literal where they are, the others' by a join on a."""
    if not hubs:  # both lie by a already
        return links.join(least, "a")
    hub = F.col("a").isin(list(hubs))
    near = links.filter(hub).withColumn("m", F.create_map(*[F.lit(x).cast("long") for pair in hubs.items() for x in pair])[F.col("a")])
    return near.unionByName(links.filter(~hub).coalesce(tasks).repartition("a").join(least.filter(~hub), "a"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links to (id, root): the smallest id that links lead to.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step is a grouped minimum over links (partial minima first, so a hub's
    links are one row of each task) and a join that gives links their minimum.
    The links of hubs, of which there is a bounded number, are told
    their minimum where they lie.  Nothing is gathered on the driver but counts
    and the hubs' ids.  A round's tasks are as many as its links need; its
    files are released when the next is written.  Stops when no link changes;
    raises if it has not after ``rounds``.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(links)
    seen = None
    for _ in range(rounds):
        n, mix = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (n, mix) == seen or not n:
            release(now.sparkSession)
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = n, mix
        tasks = max(FEWEST_TASKS, -(-n // LINKS_A_TASK))
        held = now.coalesce(tasks)
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        hubs = _hubs(both, n)
        if not hubs:
            both = both.repartition("a")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a point at a's minimum
        large = _with_least(both.filter("b > a"), low, hubs, tasks).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        if hubs:
            large = cut(large.distinct())
        # small star: neighbours below a, and a itself, point at the minimum
        low_hubs = _hubs(large, n) if hubs else {}
        large = large if low_hubs else large.coalesce(tasks).repartition("a")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least, low_hubs, tasks).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut(small.filter("a <> b").coalesce(tasks).distinct().coalesce(tasks))
    raise RuntimeError(f"links still changed after {rounds} rounds")
