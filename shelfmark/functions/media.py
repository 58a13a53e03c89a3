"""Capture times, positions and units of media tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns: any well-formed stamp, and one whose clock was set.
_USABLE = (
    r"(?s)^(?!0+[:/-])(\d+)[:/-](?!00[:/-])(\d+)[:/-](?!00 )(\d+) (\d+)[:.](\d+)[:.](\d+)(?:[:.].*)?\z"
)
_STAMP = r"^(\d+)[:/-](\d+)[:/-](\d+) (\d+)[:.](\d+)[:.](\d+)(?:[:.].*)?$"


def _parts(stamp: Column) -> list[Column]:
    return [F.regexp_extract(stamp, f"(?s){_STAMP}", i) for i in range(1, 7)]


def exif_time(stamp: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as a file-name-safe text; NULL for a malformed or never-set clock."""
    return F.when(stamp.rlike(_USABLE), F.regexp_replace(stamp, _USABLE, "$1-$2-$3 $4.$5.$6"))


def local_to_utc(stamp: Column, zone: str) -> Column:
    """Camera wall-clock to a UTC timestamp; NULL when the clock was never set or is impossible."""
    year, month, day, hour, minute, second = _parts(stamp)
    iso = F.concat(
        F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"),
        F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"), F.lit(":"),
        F.lpad(second, 2, "0"),
    )
    usable = (year != "") & year.rlike("[1-9]") & month.rlike("[1-9]") & day.rlike("[1-9]")
    local = F.when(usable, iso).try_cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds to decimal degrees; south and west are negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.substring(ref, 1, 1).isin("S", "W"), -value).otherwise(value)


def to_dpi(resolution: Column, unit: Column) -> Column:
    """Pixels per inch (unit 3 means per centimetre); zero means absent."""
    inches = F.when(F.coalesce(unit, F.lit(2)) == 3, resolution * 2.54).otherwise(resolution)
    return F.when(inches > 0, inches)


def to_ticks(duration_ms: Column) -> Column:
    """Milliseconds to 100-nanosecond units; zero means absent."""
    return F.when(duration_ms > 0, duration_ms.cast("bigint") * 10_000)


def to_bits_per_second(kbps: Column) -> Column:
    return F.when(kbps > 0, kbps.cast("bigint") * 1000)
