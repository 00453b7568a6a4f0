"""Feed dates, ages and ISO weeks. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import squish

FUTURE_HOURS = 36


def parse_feed_date(raw: Column, zone: Column | None = None, now: Column | None = None) -> Column:
    """struct(date, precision, confident, warning). Formats: ISO 8601, plain dates (noon UTC), 'Mon d, yyyy h:mmam' in ``zone``,
    'd Mon yyyy' (noon UTC), RFC 822 with a zone. Anything else is null with a warning. Dates over 36 hours ahead of ``now``
    become that limit and are not confident."""
    zone = F.coalesce(zone, F.lit("UTC")) if zone is not None else F.lit("UTC")
    limit = (now if now is not None else F.current_timestamp()) + F.expr(f"interval {FUTURE_HOURS} hours")
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  # binds a value, so that it is worked out once

    def checked(text: Column, parsed: Column) -> Column:
        date = parsed["date"]
        late = F.coalesce(date > limit, F.lit(False))
        return F.struct(
            F.when(late, limit).otherwise(date).alias("date"),
            F.when(date.isNull(), "unknown").otherwise(parsed["precision"]).alias("precision"),
            (date.isNotNull() & ~late).alias("confident"),
            F.when(late, "date in the future").when(date.isNull() & (text != ""), "date not understood").alias("warning"),
        )

    return once(F.coalesce(squish(raw), F.lit("")), lambda text: once(_parsed(text, zone), lambda parsed: checked(text, parsed)))


# Zone names of RFC 822 and their hours.
ZONES = {"GMT": 0, "UT": 0, "UTC": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def _parsed(text: Column, zone: Column) -> Column:
    """struct(date, precision) of the first format that fits."""
    clock = r"(?i)^([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),\s+(\d{4})\s+(\d{1,2}):(\d{2})\s*([ap])\.?m\.?$"
    bare = r"^(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{4})$"
    rfc = r"(?i)^(?:[A-Za-z]{3},\s*)?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}(?::\d{2})?)\s+([A-Z]{1,5}|[+-]\d{4})$"
    part = lambda p, i: F.regexp_extract(text, p, i)
    as_struct = lambda date, precision: F.struct(date.cast("timestamp").alias("date"), precision.alias("precision"))
    noon = F.expr("interval 12 hours")
    iso = as_struct(F.try_to_timestamp(F.regexp_replace(text, r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")), F.when(text.rlike(r"T\d{2}:\d{2}:\d{2}"), "second").otherwise("minute"))
    wall = F.concat_ws(" ", F.initcap(part(clock, 1)), part(clock, 2), part(clock, 3), F.concat(part(clock, 4), F.lit(":"), part(clock, 5)), F.upper(F.concat(part(clock, 6), F.lit("M"))))
    local = F.to_utc_timestamp(F.try_to_timestamp(wall, F.lit("MMM d yyyy h:mm a")), zone)
    plain = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")) + noon
    named = F.try_to_timestamp(F.concat_ws(" ", part(bare, 1), F.initcap(part(bare, 2)), part(bare, 3)), F.lit("d MMM yyyy")) + noon
    seconds = F.regexp_replace(part(rfc, 1), r"( \d{2}:\d{2})$", "$1:00")
    mark = F.upper(part(rfc, 2))
    offset = F.substring(mark, 1, 3).try_cast("int") * 60 + F.concat(F.substring(mark, 1, 1), F.substring(mark, 4, 2)).try_cast("int")
    hours = F.element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), mark)
    minutes = F.coalesce(hours * 60, offset)
    shifted = F.timestamp_micros(F.unix_micros(F.try_to_timestamp(seconds, F.lit("d MMM yyyy HH:mm:ss"))) - minutes.cast("long") * 60_000_000)
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), iso)
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), as_struct(plain, F.lit("day")))
        .when(text.rlike(clock), as_struct(local, F.lit("minute")))
        .when(text.rlike(bare), as_struct(named, F.lit("day")))
        .when(text.rlike(rfc), as_struct(shifted, F.lit("second")))
        .otherwise(as_struct(F.lit(None), F.lit("unknown")))
    )


def age_hours(published: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published)) / 3.6e9)


def iso_week(date: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def iso_week_start(date: Column) -> Column:
    return F.to_date(F.date_trunc("week", date))


def iso_day(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def shift_month(month: Column, by: int) -> Column:
    """'2026-01' and -1 give '2025-12'."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), by), "yyyy-MM")
