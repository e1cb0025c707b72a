"""Times without zone as microseconds, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp as it is written.  Days and times
    of day are taken apart, as a cast would shift hours the session's zone skips."""
    c = (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    fraction = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.unix_date(c.cast("date")).cast("bigint") * DAY + seconds.cast("bigint") * 1_000_000 + fraction


def from_micros(c: Column) -> Column:
    """The time without zone of microseconds since 1970."""
    day = F.date_from_unix_date(F.floor(c / DAY).cast("int")).cast("timestamp_ntz")
    within = F.pmod(c, F.lit(DAY))
    return day + F.make_dt_interval(secs=(within.cast("decimal(20,6)") / 1_000_000).cast("decimal(18,6)"))
