"""Time keys and labels as Column expressions (session time zone: UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema as S

# Accepted date formats for text dates, day first, tried in order (P3). Day, month and hour
# may have one digit; seconds may have a fraction; ISO dates may have a zone (read as UTC).
DATE_FORMATS = ["d/M/yyyy H:mm:ss[.SSSSSSSSS]", "d/M/yyyy H:mm", "d/M/yyyy",
                "yyyy-M-d H:mm:ss[.SSSSSSSSS][XXX]", "yyyy-M-d'T'H:mm:ss[.SSSSSSSSS][XXX]",
                "yyyy-M-d H:mm", "yyyy-M-d'T'H:mm", "yyyy-M-d"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_start(ts) -> Column:
    """Monday of the week (weeks run Monday..Sunday), as DATE."""
    return F.to_date(F.date_trunc("week", _c(ts)))


def week_end(ts) -> Column:
    return F.date_add(week_start(ts), 6)


def week_label(ts) -> Column:
    """'dd/MM-dd/MM' (no year: display only, never a key)."""
    return F.concat(F.date_format(week_start(ts), "dd/MM"), F.lit("-"),
                    F.date_format(week_end(ts), "dd/MM"))


def month_start(ts) -> Column:
    """First day of the month, as DATE."""
    return F.to_date(F.date_trunc("month", _c(ts)))


def month_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def month_label(ts) -> Column:
    return F.date_format(_c(ts), "MMM/yyyy")


def trend(change) -> Column:
    """AUMENTO / REDUÇÃO / ESTÁVEL by the sign of a change."""
    c = _c(change)
    return (F.when(c > 0, F.lit(S.TREND_UP)).when(c < 0, F.lit(S.TREND_DOWN))
            .otherwise(F.lit(S.TREND_FLAT)))


def pct_change(new, old) -> Column:
    """(new - old) / old * 100 as DOUBLE; null when old is 0 or null."""
    n, o = _c(new).cast("double"), _c(old).cast("double")
    return F.when(o != 0, (n - o) / o * 100.0)


def parse_timestamp(col, formats: list[str] | None = None) -> Column:
    """Text -> TIMESTAMP_NTZ trying each format; unparseable -> null.

    Typed timestamps pass through unchanged."""
    c = _c(col).cast("string")
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in (formats or DATE_FORMATS)]
    return F.coalesce(*tries).cast("timestamp_ntz")


def elapsed_days(t_max, t_min) -> Column:
    """Whole 24-hour blocks between two timestamps (not calendar-day difference)."""
    a = F.unix_micros(_c(t_max).cast("timestamp"))
    b = F.unix_micros(_c(t_min).cast("timestamp"))
    return F.floor((a - b) / F.lit(86_400_000_000)).cast("bigint")
