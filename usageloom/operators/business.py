"""Invoices, return on investment and the effect of nudges (A-29 … A-31)."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame, functions as F

from usageloom.functions.scalar import share
from usageloom.model import Window
from usageloom.operators.rollups import period_filter

CALIBRATABLE_PCT = 5.0


def nudge_summary(nudge: DataFrame, as_of: dt.datetime, days: int = 14) -> DataFrame:
    """Fired, decided and followed nudges per rule (A-29)."""
    decided = F.col("outcome").isin("followed", "not_followed")
    return (
        nudge.where(F.col("fired_ts") >= F.lit(as_of - dt.timedelta(days=days)))
        .groupBy("rule")
        .agg(
            F.count(F.lit(1)).alias("fired"),
            F.count("decided_ts").alias("decided"),
            F.count_if(F.col("outcome") == "followed").alias("followed"),
            F.count_if(F.col("outcome") == "not_followed").alias("not_followed"),
            F.count_if(F.col("outcome") == "unknown").alias("unknown"),
            F.avg(F.when(decided, F.col("followed"))).alias("followed_rate"),
        )
    )


def recent_nudges(nudge: DataFrame, n: int = 20) -> DataFrame:
    """The latest nudges with their outcome (A-29)."""
    return (
        nudge.orderBy(F.desc("fired_ts"), F.asc("rule"), F.asc("session_id")).limit(n)
        .select("fired_ts", "rule", "session_id", "followed", "outcome", "outcome_reason")
    )


def in_month(cost: DataFrame, month: str) -> DataFrame:
    """Rows of a UTC month (``YYYY-MM``), between two instants that reach the scan."""
    first = dt.datetime.strptime(month, "%Y-%m").replace(tzinfo=dt.timezone.utc)
    last = dt.date(first.year, first.month, calendar.monthrange(first.year, first.month)[1])
    return period_filter(cost, Window(first.date(), last), "UTC")


def invoice_check(
    invoice: DataFrame, cost: DataFrame, unaccounted: DataFrame, month: str
) -> DataFrame:
    """Billed amount of a UTC month against the ledger and its known gaps (A-30)."""
    ledger = in_month(cost, month).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).scalar()
    lost = (
        unaccounted.where(F.col("month_utc") == month)
        .agg(F.coalesce(F.sum("input_side_lower_usd"), F.lit(0.0))).scalar()
    )
    row = (
        invoice.where(F.col("month") == month).select("month", "billed_usd")
        .withColumn("ledger_usd", ledger)
        .withColumn("unaccounted_usd", lost)
        .withColumn(
            "residual_usd", F.col("billed_usd") - (F.col("ledger_usd") + F.col("unaccounted_usd"))
        )
        .withColumn("residual_pct", share(F.col("residual_usd"), F.col("billed_usd")))
    )
    close = F.abs("residual_pct") <= CALIBRATABLE_PCT
    return row.withColumn("calibratable", F.coalesce(close, F.lit(False)).cast("int"))


def invoice_allocation(check: DataFrame, cost: DataFrame, month: str) -> DataFrame:
    """Residual of a calibratable month spread over models by their cost (A-30)."""
    models = (
        in_month(cost, month)
        .groupBy(F.coalesce("model", F.lit("?")).alias("model")).agg(F.sum("cost_usd").alias("cost_usd"))
    )
    one = check.where((F.col("calibratable") == 1) & (F.col("ledger_usd") != 0))
    return (
        models.withColumn("residual_usd", one.select("residual_usd").scalar())
        .withColumn("ledger_usd", one.select("ledger_usd").scalar())
        .where(F.col("ledger_usd").isNotNull())
        .select(
            "model", "cost_usd",
            share(F.col("cost_usd"), F.col("ledger_usd")).alias("cost_share_pct"),
            (F.col("residual_usd") * F.col("cost_usd") / F.col("ledger_usd")).alias(
                "allocated_residual_usd"
            ),
        )
    )


def roi(
    marker: DataFrame, cost: DataFrame, session: DataFrame, roi_cost: DataFrame,
    hourly_usd: float, since: dt.datetime, analyst_project: str,
) -> DataFrame:
    """Savings of winning markers against what finding them cost (A-31).

    ``analyst_project`` is the text by which the analyst's own sessions are known.
    """
    start = F.lit(since)
    wins = marker.where(
        (F.col("verdict") == "win") & (F.coalesce("verdict_ts", "ts_start") >= start)
    ).agg(
        F.coalesce(F.sum("saving_usd"), F.lit(0.0)).alias("saving_usd"),
        F.coalesce(F.sum(F.coalesce("saving_low_usd", "saving_usd")), F.lit(0.0)).alias("saving_low_usd"),
        F.coalesce(F.sum(F.coalesce("saving_high_usd", "saving_usd")), F.lit(0.0)).alias("saving_high_usd"),
        F.count(F.lit(1)).alias("winning_markers"),
    )
    analysts = session.where(F.col("project").contains(analyst_project)).select("session_id")
    own = (
        cost.where(F.col("ts") >= start).join(analysts, "session_id", "left_semi")
        .agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).scalar()
    )
    spent = roi_cost.where(F.col("ts") >= start).agg(
        F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes"),
        F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"),
    )
    rows = (
        wins.withColumn("analyst_cost_usd", own)
        .withColumn("recorded_cost_usd", spent.select("usd").scalar())
        .withColumn("recorded_minutes", spent.select("minutes").scalar())
    )
    time_usd = F.col("recorded_minutes") * F.lit(float(hourly_usd)) / F.lit(60.0)
    total = F.col("analyst_cost_usd") + F.col("recorded_cost_usd") + F.col("time_cost_usd")
    whole = F.nullif(F.col("total_known_cost_usd"), F.lit(0.0))
    out = rows.withColumn("time_cost_usd", time_usd).withColumn("total_known_cost_usd", total)
    incomplete = (F.col("recorded_minutes") > 0) & F.lit(hourly_usd <= 0)
    return (
        out.withColumn("cost_complete", (~incomplete).cast("int"))
        .withColumn("roi_ratio", F.col("saving_usd") / whole)
        .withColumn("roi_low", F.col("saving_low_usd") / whole)
        .withColumn("roi_high", F.col("saving_high_usd") / whole)
    )


def roi_breakdown(roi_cost: DataFrame, since: dt.datetime) -> DataFrame:
    """Recorded minutes and money per kind of effort (A-31)."""
    return roi_cost.where(F.col("ts") >= F.lit(since)).groupBy("kind").agg(
        F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes"),
        F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"),
    )
