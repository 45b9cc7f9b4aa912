"""Quality of sources: latency, contract violations, duplicates, problems. Rows are events with a JSON body (message):
source_app, name, user_id, occurred_at and ingested_at (epoch seconds, fractions allowed), message."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.settings import FIRST_PARTY, KIND_FIELD

#: Limits of the report.
STALE_HOURS, TRIGGER_P95, PIPELINE_P95, TOP = 24, 900, 10, 20


def _is_number(path: str, body: str = "message") -> Column:
    return F.schema_of_variant(F.variant_get(F.try_parse_json(F.col(body)), path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")


def with_latency(rows: DataFrame) -> DataFrame:
    """e2e_s, and trigger_s and pipeline_s where the body says as a number when its source was polled."""
    polled = F.when(_is_number("$.n8n_polled_at"), F.get_json_object("message", "$.n8n_polled_at").cast("double"))
    return rows.withColumn("polled_at", polled).withColumns(
        {
            "e2e_s": F.col("ingested_at") - F.col("occurred_at"),
            "trigger_s": F.col("polled_at") - F.col("occurred_at"),
            "pipeline_s": F.col("ingested_at") - F.col("polled_at"),
            "backfill": F.coalesce(F.get_json_object("message", "$.backfill") == "true", F.lit(False)),
            "upstream_id": F.get_json_object("message", "$.upstream_id"),
        }
    )


def with_contract_flags(rows: DataFrame, users: list[str] | None = None) -> DataFrame:
    """bad_timestamp, derived_fields, bad_user. As in SQL, what is missing isn't counted as wrong."""
    stamp = F.get_json_object("message", "$.timestamp")
    derived = F.get_json_object("message", f"$.{KIND_FIELD}").isNotNull() | F.get_json_object("message", "$.derived_from").isNotNull()
    return rows.withColumns(
        {
            "bad_timestamp": F.coalesce(stamp.isNotNull() & ~_is_number("$.timestamp"), F.lit(False)),
            "derived_fields": derived,
            "bad_user": F.coalesce(~F.col("user_id").isin(users), F.lit(False)) if users else F.lit(False),
        }
    )


def without(rows: DataFrame, sources: list[str] | None = None, everything: bool = False) -> DataFrame:
    return rows if everything else rows.filter(~F.col("source_app").isin(FIRST_PARTY if sources is None else sources))


#: Cells of a histogram per unit of the values' logarithm.
CELLS = 256


def percentiles(values: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(keys, p50, p95, ...): exact percentiles, interpolated, of values (keys, value). A histogram over logarithmic cells says
    which cells hold the wanted ranks; only their values are put in order, so no task holds all values of a key."""
    v = F.col("value").cast("double")
    rows = values.filter(v.isNotNull()).select(*keys, v.alias("value"), F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELLS).alias("_cell"))
    cells = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumns({"_before": F.sum("_n").over(by_cell) - F.col("_n"), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
    rank = {p: F.lit(p) * (F.col("_total") - 1) for p in at}
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))
    wanted = cells.filter(reduce(or_, [holds(f(r)) for r in rank.values() for f in (F.floor, F.ceil)])).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_cell").alias("_c"), "_before", "_total")
    same = reduce(and_, [rows[k].eqNullSafe(wanted[f"_{k}"]) for k in keys], F.col("_cell") == F.col("_c"))
    found = rows.join(wanted, same).groupBy(*keys, "_before", "_total", "value").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys, "_before").orderBy("value")
    found = found.withColumn("_before", F.col("_before") + F.sum("_n").over(within) - F.col("_n"))
    ends = {p: [F.max(F.when(holds(f(r)), F.col("value"))) for f in (F.floor, F.ceil)] + [F.max(r - F.floor(r))] for p, r in rank.items()}
    return found.groupBy(*keys).agg(*[(lo + (hi - lo) * part).alias(f"p{round(p * 100)}") for p, (lo, hi, part) in ends.items()])


def by_source(rows: DataFrame, as_of: float) -> DataFrame:
    """rows: of with_latency and with_contract_flags. Percentiles leave backfilled rows out."""
    live = lambda c: F.when(~F.col("backfill"), F.col(c))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("name").alias("names"),
        F.max("ingested_at").alias("last_seen"),
        ((F.lit(float(as_of)) - F.max("ingested_at")) / 3600).alias("age_hours"),
        F.count("polled_at").alias("stamped"),
        F.count_if("backfill").alias("backfilled"),
        F.count("upstream_id").alias("with_upstream_id"),
        F.count_if("bad_timestamp").alias("bad_timestamps"),
        F.count_if("derived_fields").alias("derived_fields"),
        F.count_if("bad_user").alias("bad_users"),
    ]
    lags = ("e2e_s", "trigger_s", "pipeline_s")
    aggs += [F.max(live(c)).alias(f"{c}_max") for c in lags]
    aggs.append(F.min(live("pipeline_s")).alias("pipeline_s_min"))
    each = F.array(*[F.struct(F.lit(c).alias("lag"), F.col(c).cast("double").alias("value")) for c in lags])
    values = rows.filter(~F.col("backfill")).select("source_app", F.explode(each).alias("_v")).select("source_app", "_v.*")
    found = percentiles(values, ["source_app", "lag"], [0.5, 0.95])
    picked = [F.max(F.when(F.col("lag") == c, F.col(p))).alias(f"{c}_{p}") for c in lags for p in ("p50", "p95")]
    of = found.groupBy("source_app").agg(*picked).withColumnRenamed("source_app", "_source")
    summed = rows.groupBy("source_app").agg(*aggs)
    return summed.join(of, summed["source_app"].eqNullSafe(of["_source"]), "left").drop("_source")


def duplicates(rows: DataFrame, top: int = TOP) -> DataFrame:
    """upstream ids that a source sent more than once."""
    found = rows.filter("upstream_id is not null").groupBy("source_app", "upstream_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("ingested_at").alias("first_seen"), F.max("ingested_at").alias("last_seen")
    )
    return found.filter("copies > 1").orderBy(F.desc("copies"), F.desc("last_seen"), "source_app", "upstream_id").limit(top)


def problems(summary: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(source_app, problem, value): a row for each limit that a source breaks."""
    rules = {
        "stale": (F.col("age_hours") > STALE_HOURS, F.col("age_hours")),
        "no_live_rows": (F.col("n") == F.col("backfilled"), F.col("n")),
        "unstamped": (F.col("stamped") < F.col("n") - F.col("backfilled"), F.col("n") - F.col("backfilled") - F.col("stamped")),
        "negative_pipeline": (F.col("pipeline_s_min") < 0, F.col("pipeline_s_min")),
        "slow_trigger": (F.col("trigger_s_p95") > TRIGGER_P95, F.col("trigger_s_p95")),
        "slow_pipeline": (F.col("pipeline_s_p95") > PIPELINE_P95, F.col("pipeline_s_p95")),
        "contract": (F.col("bad_timestamps") + F.col("derived_fields") + F.col("bad_users") > 0, F.col("bad_timestamps") + F.col("derived_fields") + F.col("bad_users")),
        "no_upstream_ids": (F.col("with_upstream_id") == 0, F.col("n")),
    }
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(k).alias("problem"), v.cast("double").alias("value"))) for k, (bad, v) in rules.items()])
    out = summary.select("source_app", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_p")).select("source_app", "_p.*")
    if repeated is not None:
        extra = repeated.groupBy("source_app").agg(F.sum(F.col("copies") - 1).cast("double").alias("value"))
        out = out.unionByName(extra.select("source_app", F.lit("redundant_rows").alias("problem"), "value"))
    return out
