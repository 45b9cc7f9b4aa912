"""The lineage graph of derived events. Depths are iterations of joins, as many as the graph is deep; closures of
deep graphs take logarithmic rounds. Each round is written to the shared folder. Circles end them as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.staging import staged

COLLAPSE_FROM = 6
#: Levels of a closure that are looked up one by one before jumps are made.
LEVELS = 8


def edges(events: DataFrame, id_column: str = "id", parents: str = "derived_from") -> DataFrame:
    """(child_id, parent_id)."""
    return events.select(F.col(id_column).alias("child_id"), F.explode(parents).alias("_p")).select("child_id", F.col("_p.id").alias("parent_id")).distinct()


def depths(events: DataFrame, links: DataFrame) -> DataFrame:
    """(id, depth): 1 without parents among events, else one more than the deepest parent. Parents that are on a circle, or
    descend from one, don't count."""
    ids = events.select("id").distinct()
    here = lambda c: ids.withColumnRenamed("id", c)
    waiting = staged(links.join(here("parent_id"), "parent_id", "left_semi").join(here("child_id"), "child_id", "left_semi").select("child_id", "parent_id"), "links")
    offers = None
    while True:
        # parents that wait for no other: their depth is known
        ready = waiting.join(waiting.select(F.col("child_id").alias("parent_id")).distinct(), "parent_id", "left_anti")
        known = ready if offers is None else ready.join(offers.groupBy(F.col("id").alias("parent_id")).agg(F.max("depth").alias("_d")), "parent_id", "left")
        found = known.groupBy(F.col("child_id").alias("id")).agg((F.max(F.coalesce("_d", F.lit(1)) if offers is not None else F.lit(1)) + 1).alias("depth"))
        found = staged(found, "depths")
        if not found.limit(1).count():
            break
        offers = found if offers is None else offers.unionByName(found)
        waiting = staged(waiting.join(ready, ["child_id", "parent_id"], "left_anti"), "links")
    every = ids.withColumn("depth", F.lit(1))
    return (every if offers is None else every.unionByName(offers)).groupBy("id").agg(F.max("depth").alias("depth"))


def depth_by_type(events: DataFrame, depth: DataFrame) -> DataFrame:
    """name, depth of its latest event, all its depths and the deepest, deepest types first."""
    e = events.join(depth, "id")
    per = e.groupBy("name").agg(F.max_by("depth", F.struct("ts", "id")).alias("depth"), F.sort_array(F.collect_set("depth")).alias("depths"), F.max("depth").alias("deepest"))
    return per.orderBy(F.desc("depth"), "name")


def closure(links: DataFrame, start: DataFrame, up: bool = True, levels: int = LEVELS) -> DataFrame:
    """(root, id, distance): all ancestors (up) or descendants of the ids in start (id), each at its least distance.

    The first `levels` levels go one by one, which ends most lineages. What lies deeper is reached in logarithmic rounds: jumps of
    1, 2, 4, ... links are made by joining each with itself, then taken from the longest down, so that every distance is a sum of
    different jumps. A part of a shortest way is a shortest way itself, so the least distance found so far is all a pair has to keep.
    A circle ends the doubling once jumps are as long as there are links."""
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    steps = staged(links.select(F.col(a).alias("_from"), F.col(b).alias("_to")).dropna().distinct(), "links")
    seen = None
    level = start.select(F.col("id").alias("root"), F.col("id"))
    for n in range(1, levels + 1):
        level = level.join(steps, level["id"] == steps["_from"]).select("root", F.col("_to").alias("id")).distinct()
        if seen is not None:
            level = level.join(seen, ["root", "id"], "left_anti")
        level = staged(level, "closure")
        if not level.limit(1).count():
            break
        found = level.withColumn("distance", F.lit(n))
        seen = found if seen is None else seen.unionByName(found)
    else:
        jumps, longest = [steps], steps.count()
        while 2 ** len(jumps) <= longest:
            first, second = jumps[-1], jumps[-1].select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
            twice = staged(first.join(second, first["_to"] == second["_mid"]).select("_from", F.col("_end").alias("_to")).distinct(), "jumps")
            if not twice.limit(1).count():
                break
            jumps.append(twice)
        deep = level.withColumn("distance", F.lit(levels))
        for i in reversed(range(len(jumps))):
            further = deep.join(jumps[i], deep["id"] == jumps[i]["_from"]).select("root", F.col("_to").alias("id"), (F.col("distance") + 2**i).cast("int").alias("distance"))
            deep = staged(deep.unionByName(further).groupBy("root", "id").agg(F.min("distance").alias("distance")), "closure")
        seen = seen.unionByName(deep).groupBy("root", "id").agg(F.min("distance").alias("distance"))
    return start.select(F.col("id").alias("root"), "id", F.lit(0).alias("distance")).limit(0) if seen is None else seen


def grouped_children(links: DataFrame, events: DataFrame, collapse_from: int = COLLAPSE_FROM) -> DataFrame:
    """An event's contributors by type: their number, time range, and ids unless they are collapse_from or more."""
    e = links.join(events.select(F.col("id").alias("parent_id"), "name", "ts"), "parent_id")
    per = e.groupBy("child_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_list("parent_id")).alias("ids"))
    return per.withColumns({"collapsed": F.col("n") >= collapse_from, "ids": F.when(F.col("n") < collapse_from, F.col("ids"))})


def absorbed(links: DataFrame, spans: DataFrame) -> DataFrame:
    """Ids that are contributors of a visible span (spans: id)."""
    return links.join(spans.select(F.col("id").alias("child_id")), "child_id", "left_semi").select(F.col("parent_id").alias("id")).distinct()
