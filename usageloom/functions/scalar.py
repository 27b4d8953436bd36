"""Column expressions shared by the operators (all of them stay in the JVM)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from usageloom import fixed_values as fixed
from usageloom.model import Window


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    return F.unix_micros(_col(ts))


def seconds(ts) -> Column:
    """Epoch seconds with fraction."""
    return F.unix_micros(_col(ts)) / F.lit(1_000_000.0)


def _day_of(shifted: Column) -> Column:
    """Calendar date of a shifted instant, whatever the session time zone is."""
    days = F.floor(F.unix_micros(shifted) / F.lit(86_400_000_000.0))
    return F.date_from_unix_date(days.cast("int"))


def local_day(ts, tz: str) -> Column:
    return _day_of(F.from_utc_timestamp(_col(ts), tz))


def utc_day(ts) -> Column:
    return _day_of(_col(ts))


def iso_week(ts, tz: str) -> Column:
    day = local_day(ts, tz)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def utc_month(ts) -> Column:
    return F.date_format(utc_day(ts), "yyyy-MM")


def in_window(ts, w: Window, tz: str) -> Column:
    """Period predicate on the raw instant, so that it reaches the file scan (F-01)."""
    lo, hi = w.instants(tz)
    return (_col(ts) >= F.lit(lo)) & (_col(ts) < F.lit(hi))


#: Partition column of ledger tables.
UTC_DAY = "utc_day"


def in_days(df: DataFrame, w: Window, tz: str) -> DataFrame:
    """Rows of the UTC days that a period touches, if ``df`` has them: a partition filter (F-01)."""
    if UTC_DAY not in df.columns:
        return df
    lo, hi = w.instants(tz)
    last = hi - dt.timedelta(microseconds=1)
    days = [x.astimezone(dt.timezone.utc).date() for x in (lo, last)]
    return df.where(F.col(UTC_DAY).between(F.lit(days[0]), F.lit(days[1])))


def context_tokens(prefix: str = "") -> Column:
    """Input-side tokens of a request (F-07)."""
    names = ("input_tok", "cache_read_tok", "cache_w5m_tok", "cache_w1h_tok")
    return F.expr(" + ".join(f"coalesce({prefix}{name}, 0)" for name in names))


def normalize_model(model) -> Column:
    """Strip a trailing ``-YYYYMMDD``; empty becomes NULL (T-01)."""
    return F.regexp_replace(F.nullif(_col(model), F.lit("")), r"-\d{8}$", "")


def model_family(model, families=fixed.MODEL_FAMILIES, other: str = "other") -> Column:
    """First family whose name occurs in the model id (F-04)."""
    lowered = F.lower(F.coalesce(_col(model), F.lit("")))
    out = F.lit(other)
    for name in reversed(tuple(families)):
        out = F.when(lowered.contains(name), F.lit(name)).otherwise(out)
    return out


def is_automatic(
    project, contains=fixed.AUTOMATIC_CONTAINS, prefixes=fixed.AUTOMATIC_PREFIXES
) -> Column:
    """Whether a project is driven by machines and not by a person (F-04)."""
    name = F.coalesce(_col(project), F.lit(""))
    hit = F.lit(False)
    for part in contains:
        hit = hit | name.contains(part)
    for part in prefixes:
        hit = hit | name.startswith(part)
    return hit


def project_display(project, home: str | None = None) -> Column:
    """Readable project name; ``home`` is the encoded home prefix to shorten (F-04)."""
    name = F.when(F.coalesce(_col(project), F.lit("")) == "", F.lit("—")).otherwise(_col(project))
    if not home:
        return name
    prefix = home.replace("/", "-") + "-"
    at = F.instr(name, prefix)
    return F.when(
        at > 0,
        F.concat(
            F.substring(name, F.lit(1), at - 1),
            F.lit("~"),
            F.substring(name, at + len(prefix), F.length(name)),
        ),
    ).otherwise(name)


def price_factor(tier="service_tier", speed="speed", geo="geo", price: str = "") -> Column:
    """Multiplier for batch, fast and regional requests (F-05)."""
    return (
        F.when(_col(tier) == "batch", F.col(price + "batch_x")).otherwise(F.lit(1.0))
        * F.when(_col(speed) == "fast", F.col(price + "fast_x")).otherwise(F.lit(1.0))
        * F.when(F.lower(_col(geo)).startswith("us"), F.col(price + "geo_us_x")).otherwise(F.lit(1.0))
    )


def clip_text(text, n: int = 60) -> Column:
    """One line, at most ``n`` characters and an ellipsis (F-08)."""
    line = F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.concat(
        F.substring(line, 1, n), F.when(F.length(line) > n, F.lit("…")).otherwise(F.lit(""))
    )


def nz(c) -> Column:
    """NULL as zero."""
    return F.coalesce(_col(c), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """Percentage, NULL when the whole is zero or unknown."""
    return F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0))


def salted_null_key(key, spread_by, prefix: str = "\u0000", salts: int = 1024) -> Column:
    """Join key in which NULLs are spread over ``salts`` values that match nothing.

    In an outer join all rows with a NULL key hash to one partition; main-thread
    requests have no agent, so that partition would hold most of the table.
    """
    salt = F.pmod(F.xxhash64(_col(spread_by)), F.lit(salts)).cast("string")
    return F.coalesce(_col(key), F.concat(F.lit(prefix), salt))
