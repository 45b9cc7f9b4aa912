"""What the corpus operators share: working folders, hot keys and component labelling."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.staging import new_path

T = TypeVar("T")

#: Stands for a missing doc_id inside operators; greater than any real id, so that real ids win.
NO_ID = 2**63 - 1


#: Lets a query's shuffle files go when it ends; what later steps read is in the shared folder by then.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


_store: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What make() gives, kept in a worker until another operator's store is asked for: workers outlive a stage, and their
    stores would add up."""
    if name not in _store:
        released()
        _store[name] = make()
    return _store[name]


def released() -> None:
    """Lets a worker's store go. For operators without one: a worker that comes to them from another still holds that one's."""
    if _store:
        _store.clear()
        pa.default_memory_pool().release_unused()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Ids up to this number are broadcast to pick documents, beyond it they are joined by a shuffle: the same rows either way.
BROADCAST_IDS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few enough rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


#: Keys with over 1/HOT of all rows (and over HOT rows) are hot: there are at most HOT of them, whatever the data's size,
#: so that their rows of a lookup table may be broadcast.
HOT = 1000


def hot_share(total: int) -> int:
    return max(HOT, total // HOT)


def join_by_count(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right on `key`, unique in right, whose column _n says how many rows of left have the key.
    Hot keys' rows of right are broadcast, so that no task gets all rows of a hot key; the rest is shuffled. _n goes."""
    total = right.agg(F.sum("_n")).first()[0] or 0
    hot = right.filter(F.col("_n") > hot_share(total))
    cold = right.filter(F.col("_n") <= hot_share(total)).drop("_n")
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    return (
        marked.filter("_hot").drop("_hot").join(F.broadcast(hot.drop("_n")), key).unionByName(marked.filter("_hot is null").drop("_hot").join(cold, key, how))
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(a, b) links between long ids -> (id, component): the smallest id that each id reaches.

    Repeats two joins until nothing changes: every node hands its smallest neighbour's label on, then labels jump to
    the label of their label. Star-shaped link sets end after two or three rounds, paths in logarithmic rounds.
    Each round is written to the shared folder. Ids without links do not appear."""
    spark = edges.sparkSession
    both = staged(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        label,
    )
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), label)
    while True:
        # the smallest label among neighbours; summed before the join so that a hub costs no more than its links
        offered = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("_c")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("_c").alias("_c"))
        )
        hooked = labels.join(offered, "id", "left").select(
            "id", F.col("component").alias("_old"), F.least("component", F.coalesce("_c", "component")).alias("_new")
        )
        # a root that was offered something smaller takes its whole tree along
        roots = hooked.groupBy(F.col("_old").alias("_root")).agg(F.min("_new").alias("_to"))
        moved = hooked.join(roots, hooked["_old"] == roots["_root"]).select("id", "_old", F.least("_new", "_to").alias("_new"))
        parents = moved.select(F.col("id").alias("_p"), F.col("_new").alias("_pp"))
        jumped = moved.join(parents, moved["_new"] == parents["_p"], "left").select(
            "id", "_old", F.least("_new", F.coalesce("_pp", "_new")).alias("component")
        )
        done = staged(jumped, label)
        labels = done.select("id", "component")
        if not done.filter("_old <> component").limit(1).count():
            return labels
