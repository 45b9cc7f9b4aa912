"""Long-running processes as queries over their milestone log.

Log rows: id, process, cycle_key, stage, ts, arrival (order of writing), body (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK_SECONDS = 900
#: Evidence is looked up by periods of this length.
BUCKET_SECONDS = 3600
RESERVED = ["id", "name", "user_id", "timestamp", "process", "cycle_key"]


def cycles(log: DataFrame, genesis: str) -> DataFrame:
    """The first genesis event of each cycle key, with its context: the body without reserved keys."""
    first = log.filter(F.col("stage") == genesis).groupBy("process", "cycle_key").agg(F.min_by(F.struct("id", "ts", "body"), F.struct("ts", "arrival")).alias("_g"))
    body = F.from_json("_g.body", "map<string,string>")
    return first.select("process", "cycle_key", F.col("_g.id").alias("genesis_id"), F.col("_g.ts").alias("opened_at"), F.map_filter(body, lambda k, _: ~k.isin(RESERVED)).alias("context"))


def milestones(log: DataFrame) -> DataFrame:
    """The last written milestone of each stage of a cycle."""
    last = Window.partitionBy("process", "cycle_key", "stage").orderBy(F.desc("arrival"), F.desc("id"))
    return log.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def frontier(cycle: DataFrame, done: DataFrame, stages: DataFrame, void: str = "void") -> DataFrame:
    """(process, cycle_key, stage, state, look_from, status): a stage is done, ready (all of `after` done) or blocked; look_from
    is when its predecessors were reached, or the cycle opened. A cycle with a void milestone is inert.
    stages: process, stage, position, after (array)."""
    have = done.groupBy("process", "cycle_key").agg(F.map_from_entries(F.collect_list(F.struct("stage", "ts"))).alias("_done"))  # as many as the process has stages
    rows = cycle.join(have, ["process", "cycle_key"], "left").withColumn("_done", F.coalesce("_done", F.create_map().cast("map<string,bigint>")))
    rows = rows.join(F.broadcast(stages), "process")
    held = F.map_keys("_done")
    state = F.when(F.array_contains(held, F.col("stage")), "done").when(F.forall("after", lambda a: F.array_contains(held, a)), "ready").otherwise("blocked")
    times = F.transform("after", lambda a: F.try_element_at("_done", a))
    rows = rows.withColumns({"state": state, "look_from": F.coalesce(F.array_max(times), F.col("opened_at")), "_void": F.array_contains(held, F.lit(void))})
    rows = rows.withColumn("_open", F.count_if(F.col("state") != "done").over(Window.partitionBy("process", "cycle_key")))
    status = F.when(F.col("_void"), "voided").when(F.col("_open") == 0, "complete").otherwise("waiting")
    look = F.when((F.col("state") == "ready") & ~F.col("_void"), F.col("look_from"))
    return rows.select("process", "cycle_key", "stage", "position", F.when(F.col("_void") & (F.col("state") != "done"), "inert").otherwise(F.col("state")).alias("state"), look.alias("look_from"), status.alias("status"))


def zero_stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?<!\d)0+(\d)", "$1")


def mentions(text: Column, value: Column) -> Column:
    low = F.lower(text)
    return low.contains(F.lower(value)) | low.contains(F.lower(zero_stripped(value)))


def first_from(times: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t and the first candidate (_e: ts, id) of the same keys from t on. times: keys, t; candidates: keys, ts, id.

    Both are merged in time order within periods of BUCKET_SECONDS, where one window hands every time the next candidate; where a
    period has none left, the first of the next period that has any is it. A period holds each second once from either side,
    so that no key is too large for a task and rows stay linear in both inputs."""
    period = lambda c: F.floor(F.col(c) / BUCKET_SECONDS).alias("_p")
    c = candidates.dropna(subset=[*keys, "ts"]).groupBy(*keys, "ts").agg(F.min("id").alias("id"))
    c = c.select(*keys, period("ts"), F.col("ts").alias("t"), F.struct("ts", "id").alias("_e"))
    t = times.dropna(subset=[*keys, "t"]).select(*keys, period("t"), "t").distinct()
    back = Window.partitionBy(*keys, "_p").orderBy(F.desc("t"), F.desc(F.col("_e").isNotNull())).rowsBetween(Window.unboundedPreceding, 0)
    merged = t.withColumn("_e", F.lit(None).cast(c.schema["_e"].dataType)).unionByName(c)
    found = merged.withColumn("_f", F.last("_e", ignorenulls=True).over(back)).filter("_e is null").select(*keys, "_p", "t", "_f")
    periods = merged.groupBy(*keys, "_p").agg(F.min("_e").alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    periods = periods.withColumn("_n", F.last("_first", ignorenulls=True).over(later)).drop("_first")
    return found.join(periods, [*keys, "_p"]).select(*keys, "t", F.coalesce("_f", "_n").alias("_e")).filter("_e is not null")


def match_evidence(waiting: DataFrame, candidates: DataFrame, slack: int = SLACK_SECONDS, correlate: bool = False, mention: bool = False, where: Column | None = None) -> DataFrame:
    """Waiting stages with their first candidate by time from look_from - slack on.
    waiting: key, event (wanted name), look_from and, if used, correlate (required value; null matches nothing) and mention.
    candidates: event, id, ts and, if used, correlate and text. The names are an equality key. Where a text has to mention something,
    each stage is held against all its candidates; else only the first one is looked up."""
    c = candidates if where is None else candidates.filter(where)
    keys = ["event", "correlate"] if correlate else ["event"]
    start = F.greatest(F.lit(0), F.col("look_from") - slack).cast("bigint")
    w = waiting.select("key", *keys, start.alias("t"), *(["mention"] if mention else []))
    if not mention:
        rows = w.join(first_from(w, c.select(*keys, F.col("ts").cast("bigint").alias("ts"), "id"), keys), [*keys, "t"])
        return rows.groupBy("key").agg(F.min("_e").alias("_e")).select("key", F.col("_e.id").alias("evidence_id"), F.col("_e.ts").alias("evidence_ts"))
    rows = w.join(c.select(*keys, "id", "ts", "text"), keys).filter((F.col("ts") >= F.col("t")) & mentions(F.col("text"), F.col("mention")))
    return rows.groupBy("key").agg(F.min(F.struct("ts", "id")).alias("_e")).select("key", F.col("_e.id").alias("evidence_id"), F.col("_e.ts").alias("evidence_ts"))


def stamped(matched: DataFrame, run_at: int) -> DataFrame:
    """The milestone's time is its evidence's, or the run's."""
    return matched.withColumn("ts", F.coalesce("evidence_ts", F.lit(run_at).cast("bigint")))


def advance(cycle: DataFrame, done: DataFrame, stages: list[tuple[str, list[str]]], find, run_at: int) -> DataFrame:
    """Runs the stages in their order, so that a stage completed in this run opens the next: a round of joins a stage.
    find(ready, stage) returns (process, cycle_key, evidence_ts) of those that found evidence. Returns all milestones."""
    spark = cycle.sparkSession
    for stage, after in stages:
        table = spark.createDataFrame([(stage, 0, list(after))], "stage string, position int, after array<string>")
        plan = table.crossJoin(cycle.select("process").distinct())  # one stage of each process
        ready = frontier(cycle, done, plan).filter("state = 'ready' and status <> 'voided'")
        found = stamped(find(ready, stage), run_at).select("process", "cycle_key", F.lit(stage).alias("stage"), "ts")
        done = done.select("process", "cycle_key", "stage", "ts").unionByName(found)
    return done


def next_sequence(keys: DataFrame, pattern: str = r"^(\d{2,})-(\d{4})$", form: str = "%02d-%d") -> DataFrame:
    """(year, next): one more than the largest number used in a year; keys that the form wouldn't give are ignored."""
    n, year = F.regexp_extract("key", pattern, 1).try_cast("int"), F.regexp_extract("key", pattern, 2).try_cast("int")
    rows = keys.select("key", n.alias("_n"), year.alias("year")).filter("_n is not null and year is not null")
    rows = rows.filter(F.format_string(form, "_n", "year") == F.col("key"))
    return rows.groupBy("year").agg((F.max("_n") + 1).alias("next"))


def line_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Exact totals of lines (amount decimal), rounded half up to cents, and their number. Lines that a milestone only echoes
    (`echoed`) aren't counted again."""
    own = lines.filter(~F.coalesce("echoed", F.lit(False))) if "echoed" in lines.columns else lines
    exact = F.sum(F.col("amount").cast("decimal(28,10)"))
    return own.groupBy(*keys).agg(F.round(exact, 2).cast("decimal(28,2)").alias("total"), F.count(F.lit(1)).alias("n_lines"))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays from start to end, both included; 0 if end comes first. A closed form."""
    days = F.datediff(end, start) + 1
    first, rest = F.weekday(start), days % 7  # Monday is 0; the days beyond whole weeks are first, first + 1, ...
    saturday = ((first <= 5) & (first + rest > 5)) | (first + rest > 12)
    sunday = (first + rest > 6)
    weekend = F.when(rest == 0, 0).otherwise(saturday.cast("int") + sunday.cast("int"))
    return F.when(days <= 0, 0).otherwise(F.floor(days / 7) * 5 + rest - weekend).cast("int")


def worked_days_line(rows: DataFrame, start: str, end: str, rate: str, hours_a_day: int = 8) -> DataFrame:
    n = business_days(F.col(start), F.col(end))
    return rows.withColumn("days", n).withColumns({"amount": (F.col(rate) * F.col("days")).cast("decimal(18,2)"), "hours": F.col("days") * hours_a_day})


def cleaned_amount(text: Column) -> Column:
    """struct(amount, reason): an exact decimal, or why there is none. Of two kinds of separators the last is the decimal one;
    one that repeats groups digits; a single one before exactly three digits could be either and is rejected."""
    bare = F.regexp_replace(text, r"[\s  ']|[A-Za-z$€£¥]+", "")
    dot, comma = F.instr(bare, ".") > 0, F.instr(bare, ",") > 0
    last_dot = F.length(bare) - F.instr(F.reverse(bare), ".") > F.length(bare) - F.instr(F.reverse(bare), ",")
    both = F.when(last_dot, F.regexp_replace(bare, ",", "")).otherwise(F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    many = (F.length(bare) - F.length(F.regexp_replace(bare, "[.,]", ""))) > 1
    plain = F.when(dot & comma, both).when(many, F.regexp_replace(bare, "[.,]", "")).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    ambiguous = bare.rlike(r"^[+-]?\d{1,3}[.,]\d{3}$")
    wellformed = plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    amount = F.when(~ambiguous & wellformed, plain.try_cast("decimal(28,10)"))
    reason = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(ambiguous, "ambiguous").when(amount.isNull(), "not a number")
    return F.struct(amount.alias("amount"), reason.alias("reason"))


def clean_amounts(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with `amount`, and the rejected ones with a `reason`."""
    judged = rows.withColumn("_a", cleaned_amount(F.col(column)))
    return judged.filter("_a.reason is null").withColumn("amount", F.col("_a.amount")).drop("_a"), judged.filter("_a.reason is not null").withColumn("reason", F.col("_a.reason")).drop("_a")


def document_fields(rows: DataFrame, number: str, opened: str, period_end: str) -> DataFrame:
    """document_no, document_date (the period's end, else the opening date) and the calendar month before the opening date."""
    opening = F.to_date(F.timestamp_seconds(opened))
    day = F.coalesce(F.col(period_end), opening)
    return rows.withColumns(
        {
            "document_date": day,
            "document_no": F.concat_ws("-", F.when(F.length(F.col(number).cast("string")) < 2, F.lpad(F.col(number).cast("string"), 2, "0")).otherwise(F.col(number).cast("string")), F.year(day).cast("string")),
            "month_start": F.trunc(F.add_months(opening, -1), "month"),
            "month_end": F.last_day(F.add_months(opening, -1)),
        }
    )
