"""Clock units, tick arithmetic and the calendar of ticks.

Functions return SQL expressions as columns; ``div`` keeps long arithmetic exact and truncates toward zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of 0.1 ns in a count of the module clock (25 ns) and of the card clock (50 ns).
DOM_TICKS, DOR_TICKS = 250, 500


def dom_ticks(clock: str) -> Column:
    return F.col(clock) * DOM_TICKS


def dor_ticks(clock: str) -> Column:
    return F.col(clock) * DOR_TICKS


def as_seconds(utc: str) -> Column:
    """Ticks as seconds, a double."""
    return F.col(utc) * F.lit(1e-10)


def event_time(utc: str, year: int) -> Column:
    """Ticks of a year as a timestamp of microseconds; for watermarks and windows only."""
    return F.expr(f"timestamp_micros(unix_micros(make_timestamp({year}, 1, 1, 0, 0, 0, 'UTC')) + {utc} div 10000)")


def date_string(utc: str, year: int) -> Column:
    """``yyyy-MM-dd HH:mm:ss.`` and ten digits of a second."""
    return F.concat(F.date_format(event_time(utc, year), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad((F.col(utc) % 10**10).cast("string"), 10, "0"))


def gps_offset(day="day", hour="hour", minute="minute", second="second", leap="leap", dorclk="dorclk") -> Column:
    """Ticks between a card's clock and the year's time, from a GPS reading (days count from 1)."""
    return F.expr(f"(cast({day} - 1 as bigint) * 86400 + {hour} * 3600 + {minute} * 60 + {second} + {leap}) * 10000000000L - {dorclk} * {DOR_TICKS}")


def gps_time_parts(text: str) -> dict[str, Column]:
    """Parts of ``ddd:hh:mm:ss``."""
    at = {"day": (1, 3), "hour": (5, 2), "minute": (8, 2), "second": (11, 2)}
    return {name: F.substring(text, *where).cast("int") for name, where in at.items()}


def gps_millis(year: int, day="day", hour="hour", minute="minute", second="second") -> Column:
    """Milliseconds since 1970 of a day of a year and a time."""
    return F.expr(f"unix_millis(make_timestamp({year}, 1, 1, 0, 0, 0, 'UTC')) + ((cast({day} - 1 as bigint) * 24 + {hour}) * 60 + {minute}) * 60000 + {second} * 1000")


# Labels of GPS quality characters.
QUALITY = {32: "very good", 46: "good", 42: "average", 35: "bad", 63: "very bad"}


def quality_label(quality: str) -> Column:
    """Label of a GPS quality character; any other is ``unknown``."""
    labels = F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.col(quality)), F.lit("unknown"))


def hub_class(hub_id: str) -> Column:
    """Class of a hub from its id modulo 1000: 0, in-ice up to 78, deep core up to 86, surface from 200 on."""
    return F.expr(f"case when {hub_id} % 1000 = 0 then 'legacy' when {hub_id} % 1000 <= 78 then 'in-ice' when {hub_id} % 1000 <= 86 then 'deep-core' when {hub_id} % 1000 >= 200 then 'surface' end")


def display_id(mbid: str) -> Column:
    """Twelve hex digits of a module id."""
    return F.lpad(F.lower(F.hex(mbid)), 12, "0")


def month_token(event_ts: Column) -> Column:
    return F.date_format(event_ts, "MMMM-yyyy")
