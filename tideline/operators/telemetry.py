"""Telemetry change detection: device descriptor updates to events. Windows over (device, descriptor) in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say true and false.
TRUE_WORDS = ["true", "1", "on", "moving", "open", "opened", "active", "yes"]
FALSE_WORDS = ["false", "0", "off", "notmoving", "not_moving", "closed", "inactive", "no"]
LOCKED, UNLOCKED = ["secured", "locked"], ["unlocked"]

_ITEMS = "array<struct<name: string, descriptor: string, id: string, value: string, timestamp: string>>"
_MAP = "map<string, string>"


def unnest(messages: DataFrame, body: str = "body", device: str = "device") -> DataFrame:
    """(device, arrival_seq, descriptor, value, stamp) of messages whose `data` is a list of updates or a dictionary of
    them; without `data` the message is the dictionary. value and stamp are JSON texts without quotes."""
    data = F.get_json_object(body, "$.data")
    is_list = F.ltrim(data).startswith("[")
    rows = messages.withColumn("_data", F.coalesce(data, F.col(body)))
    listed = rows.filter(F.coalesce(is_list, F.lit(False))).select(device, "arrival_seq", F.explode(F.from_json("_data", _ITEMS)).alias("_u"))
    listed = listed.select(
        device, "arrival_seq", F.coalesce("_u.name", "_u.descriptor", "_u.id").alias("descriptor"), F.col("_u.value").alias("value"), F.col("_u.timestamp").alias("stamp")
    )
    mapped = rows.filter(~F.coalesce(is_list, F.lit(False))).select(device, "arrival_seq", F.explode(F.from_json("_data", _MAP)).alias("descriptor", "_v"))
    nested = F.ltrim("_v").startswith("{")
    mapped = mapped.select(
        device,
        "arrival_seq",
        "descriptor",
        F.when(nested, F.get_json_object("_v", "$.value")).otherwise(F.col("_v")).alias("value"),
        F.when(nested, F.get_json_object("_v", "$.timestamp")).alias("stamp"),
    )
    return listed.unionByName(mapped).filter("descriptor is not null")


def epoch_seconds(stamp: Column, otherwise: Column) -> Column:
    """Milliseconds, seconds or ISO text to epoch seconds."""
    number = stamp.try_cast("double")
    iso = F.unix_timestamp(stamp.try_cast("timestamp"))
    return F.when(number > 1e12, (number / 1000).cast("long")).when(number.isNotNull(), number.cast("long")).otherwise(F.coalesce(iso, otherwise))


def to_boolean(value: Column) -> Column:
    """true, false, or null for what says neither."""
    word, number = F.lower(F.trim(value)), value.try_cast("double")
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).when(number.isNotNull(), number != 0)


def to_locked(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(LOCKED), True).when(word.isin(UNLOCKED), False)


def to_number(value: Column) -> Column:
    """Booleans are no numbers."""
    return F.when(~F.lower(F.trim(value)).isin("true", "false"), value.try_cast("double"))


def _along(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("arrival_seq")


def edges(readings: DataFrame, state: Column, keys: list[str], both: bool = True) -> DataFrame:
    """Changes of a two-valued state: the first reading is silent, unknown ones don't touch the baseline; with both=False
    only changes to true."""
    known = readings.withColumn("state", state).filter("state is not null")
    changed = known.withColumn("previous", F.lag("state").over(_along(keys))).filter("previous is not null and previous <> state")
    return changed if both else changed.filter("state")


def readings_changed(readings: DataFrame, number: Column, keys: list[str]) -> DataFrame:
    """Readings that differ from the one before; the first one counts."""
    known = readings.withColumn("reading", number).filter("reading is not null")
    return known.withColumn("previous", F.lag("reading").over(_along(keys))).filter("previous is null or previous <> reading")


def states_changed(readings: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Any change of any value; null is a value; the first one is silent."""
    w = _along(keys)
    rows = readings.withColumns({"state": value, "_n": F.row_number().over(w)}).withColumn("previous", F.lag("state").over(w))
    return rows.filter((F.col("_n") > 1) & ~F.col("state").eqNullSafe(F.col("previous"))).drop("_n")


def vocabulary(readings: DataFrame, value: str = "value") -> DataFrame:
    """Each descriptor's first appearance."""
    first = F.min(F.struct("arrival_seq", value))
    return readings.groupBy("descriptor").agg(first.alias("_f")).select("descriptor", F.col("_f.arrival_seq").alias("first_seq"), F.col(f"_f.{value}").alias("first_value"))


#: Descriptors with a meaning of their own. Edges: the signal for true and for false (None: not sent); a lock is
#: read as secured or not. Readings: the signal and the field that carries the number.
_NAV = "vehicle.cabin.infotainment.navigation.currentLocation"
LOCK = "vehicle.cabin.door.status"
EDGES = {
    "vehicle.isMoving": ("car_started_moving", "car_stopped_moving"),
    "vehicle.drivetrain.engine.isActive": ("car_ignition_on", "car_ignition_off"),
    "vehicle.cabin.door.row1.driver.isOpen": ("car_driver_door_opened", None),
    "vehicle.vehicle.deepSleepModeActive": ("car_deep_sleep", None),
    LOCK: ("car_locked", "car_unlocked"),
}
READINGS = {
    "vehicle.vehicle.travelledDistance": ("car_odometer", "odometer_km"),
    "vehicle.drivetrain.fuelSystem.level": ("car_fuel_level", "fuel_level"),
    f"{_NAV}.latitude": ("car_gps_latitude", "latitude"),
    f"{_NAV}.longitude": ("car_gps_longitude", "longitude"),
    f"{_NAV}.altitude": ("car_gps_altitude", "altitude"),
}
STATE_CHANGE = "car_state_change"


def signals(updates: DataFrame) -> DataFrame:
    """(device, arrival_seq, descriptor, signal, field, value) of updates (device, arrival_seq, descriptor, value): edges and
    readings under their own names, any other change as a state change."""
    keys = ["device", "descriptor"]
    out = ["device", "arrival_seq", "descriptor", "signal", "field", "value"]
    pick = lambda table, i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]), F.col("descriptor"))
    name = F.col("descriptor")
    state = F.when(name == LOCK, to_locked(F.col("value"))).otherwise(to_boolean(F.col("value")))
    edge = edges(updates.filter(name.isin(list(EDGES))), state, keys)
    edge = edge.withColumns({"signal": F.when(F.col("state"), pick(EDGES, 0)).otherwise(pick(EDGES, 1)), "field": F.lit(None).cast("string")}).filter("signal is not null")
    number = readings_changed(updates.filter(name.isin(list(READINGS))), to_number(F.col("value")), keys)
    number = number.withColumns({"signal": pick(READINGS, 0), "field": pick(READINGS, 1)})
    other = states_changed(updates.filter(~name.isin([*EDGES, *READINGS])), F.col("value"), keys)
    other = other.withColumns({"signal": F.lit(STATE_CHANGE), "field": F.lit("value")})
    return edge.select(out).unionByName(number.select(out)).unionByName(other.select(out))
