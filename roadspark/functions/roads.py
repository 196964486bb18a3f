"""Speeds and weights of road edges, and small text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Driveable highway types and their default speeds in km/h.
DEFAULT_KPH = {
    "motorway": 110.0, "motorway_link": 70.0, "trunk": 90.0, "trunk_link": 60.0, "primary": 80.0, "primary_link": 50.0,
    "secondary": 70.0, "secondary_link": 50.0, "tertiary": 60.0, "tertiary_link": 40.0, "unclassified": 50.0,
    "residential": 35.0, "living_street": 10.0, "service": 20.0, "road": 40.0,
}
OTHER_KPH = 30.0
#: Speed caps by surface, track type and service, and maxspeed words without a number.
SURFACE_KPH = {"unpaved": 30.0, "gravel": 30.0, "ground": 25.0, "dirt": 20.0, "sand": 15.0, "mud": 10.0}
TRACK_KPH = {"grade1": 40.0, "grade2": 30.0, "grade3": 20.0, "grade4": 15.0, "grade5": 10.0}
SERVICE_KPH = {"parking_aisle": 10.0, "driveway": 10.0, "alley": 15.0}
NO_SPEED = ("signals", "walk", "none", "variable", "unposted", "unknown")
MPH = 1.60934


def _lookup(values: dict[str, float], key: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def driveable(highway: Column) -> Column:
    return highway.isin(*DEFAULT_KPH)


def maxspeed_kph(raw: Column, fractional: bool = False) -> Column:
    """The first number of a maxspeed tag; decimals are cut off unless fractional."""
    text = F.lower(F.trim(raw))
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)" if fractional else "([0-9]+)", 1)
    speed = F.when(number != "", number).cast("double")
    return F.when(~text.isin(*NO_SPEED), F.when(text.contains("mph"), speed * MPH).otherwise(speed))


def default_kph(highway: Column, surface: Column, tracktype: Column, service: Column) -> Column:
    base = F.coalesce(_lookup(DEFAULT_KPH, highway), F.lit(OTHER_KPH))
    return F.least(base, _lookup(SURFACE_KPH, surface), _lookup(TRACK_KPH, tracktype), _lookup(SERVICE_KPH, service))


def chosen_kph(direction: Column, maxspeed: Column, forward: Column, backward: Column, default: Column) -> Column:
    """The speed of an edge: its direction's tag (0 counts as absent) or maxspeed, never above the default."""
    own = F.when(direction > 0, F.nullif(forward, F.lit(0.0))).when(direction < 0, F.nullif(backward, F.lit(0.0)))
    return F.least(F.coalesce(own, maxspeed), default)


def whole(x: Column) -> Column:
    """Rounded half to even, as LONG."""
    return F.bround(x.cast("double")).cast("long")


def seconds(length_m: Column, kph: Column) -> Column:
    return F.when(kph <= 0, F.lit(0).cast("long")).otherwise(whole(length_m / (kph * (1000.0 / 3600.0))))


def stored_weight(x: Column) -> Column:
    """A weight as the export stores it: not a number, infinite or negative is 0."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0).cast("long")).otherwise(F.greatest(whole(x), F.lit(0).cast("long")))


def hrw_score(key: Column, node: Column) -> Column:
    """First 8 bytes of sha256(key-node) as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("-", key, node), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def shard_of_path(path: Column) -> Column:
    found = F.regexp_extract(path, r"/shard_id=(\d+)/", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no shard in path: "), path)).cast("string"))


def travel_time(total_seconds: Column) -> Column:
    """Minutes rounded half up, as "5 min", "1 h" or "1 h 5 min"."""
    minutes = F.floor(total_seconds / 60 + 0.5).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    return F.when(minutes.isNull(), None).when(hours == 0, F.format_string("%d min", minutes)).when(rest == 0, F.format_string("%d h", hours)).otherwise(F.format_string("%d h %d min", hours, rest))
