"""Pricing: requests joined with a slowly changing price list at read time (J-01, J-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usageloom.functions.scalar import nz, price_factor, utc_day

#: Most validity segments of tool rates that are evaluated inside the scan.
MOST_TOOL_RATES = 1000
PRICE_COLUMNS = (
    "in_usd", "out_usd", "cache_read_x", "cache_w5m_x", "cache_w1h_x",
    "batch_x", "fast_x", "geo_us_x",
)


def price_segments(price: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """Disjoint validity segments ``[seg_from, seg_to)`` per key.

    Where periods overlap the row with the latest ``valid_from`` wins.  Solving
    that once on the price list (a few rows per key) leaves a fact at most one
    match, so that pricing needs neither a sort nor a shuffle of the facts.
    """
    columns = ", ".join(("valid_from", "valid_to", *values))
    grouped = price.groupBy(key).agg(F.expr(f"collect_list(struct({columns}))").alias("rows"))
    bounds = (
        "array_sort(array_distinct(concat(transform(rows, r -> r.valid_from), "
        "filter(transform(rows, r -> r.valid_to), d -> d IS NOT NULL)))) AS bounds"
    )
    # Of the rows that cover a bound, the largest struct is the one that starts last.
    pieces = (
        "explode(transform(bounds, (day, i) -> struct(day AS seg_from, get(bounds, i + 1) AS seg_to, "
        "array_max(filter(rows, r -> r.valid_from <= day AND (r.valid_to IS NULL OR day < r.valid_to))) "
        "AS row))) AS s"
    )
    return (
        grouped.selectExpr(key, "rows", bounds)
        .selectExpr(key, pieces)
        .where("s.row IS NOT NULL")
        .selectExpr(key, "s.seg_from", "s.seg_to", *[f"s.row.{v} AS {v}" for v in values])
    )


def covers(day: Column, start: str = "seg_from", end: str = "seg_to") -> Column:
    return (day >= F.col(start)) & (F.col(end).isNull() | (day < F.col(end)))


def tool_units(server_tool_use) -> Column:
    """``map<tool, units as text>``; NULL unless the text is a JSON object."""
    return F.from_json(server_tool_use, "map<string,string>")


def _inline_tool_usd(req: DataFrame, price_tool: DataFrame) -> DataFrame:
    """Rates are looked up inside the scan; the list is read once, with the query, and its length is checked there."""
    segments = price_segments(price_tool, "tool", ("usd_per_unit",))
    rates = segments.limit(MOST_TOOL_RATES + 1).agg(F.expr(
        f"CASE WHEN count(*) > {MOST_TOOL_RATES} THEN raise_error('more than {MOST_TOOL_RATES} tool rates: give tool_usd=server_tool_cost(...)') "
        "ELSE collect_list(struct(tool, seg_from, seg_to, usd_per_unit)) END")).scalar()
    day = "date_from_unix_date(CAST(floor(unix_micros(ts) / 8.64E10) AS INT))"
    usd = (
        "CASE WHEN server_tool_use IS NULL THEN 0.0D ELSE coalesce(aggregate("
        "map_entries(from_json(server_tool_use, 'map<string,string>')), 0.0D, "
        "(acc, unit) -> acc + coalesce(try_cast(unit.value AS DOUBLE) * get(filter(_rates, r -> r.tool = unit.key "
        f"AND r.seg_from <= {day} AND (r.seg_to IS NULL OR {day} < r.seg_to)), 0).usd_per_unit, 0.0D)), 0.0D) END"
    )
    return req.withColumn("_rates", rates).withColumn("server_tool_usd", F.expr(usd)).drop("_rates")


def server_tool_cost(req: DataFrame, price_tool: DataFrame) -> DataFrame:
    """``(request_id, server_tool_usd)`` of requests with at least one priced tool (J-02)."""
    units = req.where(F.col("server_tool_use").isNotNull()).select(
        "request_id",
        utc_day("ts").alias("day"),
        F.explode(tool_units("server_tool_use")).alias("tool", "units"),
    )
    segments = price_segments(price_tool, "tool", ("usd_per_unit",))
    usd = F.coalesce(F.col("units").try_cast("double"), F.lit(0.0)) * F.col("usd_per_unit")
    return (
        units.join(segments, (units["tool"] == segments["tool"]) & covers(F.col("day")))
        .groupBy("request_id")
        .agg(F.sum(usd).alias("server_tool_usd"))
    )


def with_tool_cost(req: DataFrame, price_tool: DataFrame, tool_usd: DataFrame | None = None) -> DataFrame:
    """Add ``server_tool_usd``: looked up inside the scan, or joined from ``tool_usd`` if that is given."""
    if tool_usd is None:
        return _inline_tool_usd(req, price_tool)
    return req.join(tool_usd, "request_id", "left").withColumn("server_tool_usd", F.coalesce("server_tool_usd", F.lit(0.0)))


def cost_requests(
    req: DataFrame, price: DataFrame, price_tool: DataFrame, tool_usd: DataFrame | None = None
) -> DataFrame:
    """Non-synthetic requests with rates and money columns (J-01 and J-02).

    A list of more than ``MOST_TOOL_RATES`` tool rates is an error unless
    ``tool_usd`` (``server_tool_cost``, for lists of any length) is given.

    Unpriced requests stay, with NULL cost.  The price segments are small and
    carry their size, so the planner broadcasts them below its threshold and
    otherwise shuffles on ``model``.
    """
    facts = with_tool_cost(req.where("is_synthetic = 0"), price_tool, tool_usd)
    rates = price_segments(price, "model", PRICE_COLUMNS).withColumnRenamed("model", "_model")
    priced = facts.join(
        rates, (facts["model"] == rates["_model"]) & covers(utc_day(facts["ts"])), "left"
    ).withColumn("price_factor", price_factor())
    writes = (
        "coalesce(cache_w5m_tok, 0) * in_usd * cache_w5m_x + coalesce(cache_w1h_tok, 0) * in_usd * cache_w1h_x"
    )
    tokens = (
        "coalesce(input_tok, 0) * in_usd + coalesce(cache_read_tok, 0) * in_usd * cache_read_x "
        f"+ {writes} + coalesce(output_tok, 0) * out_usd"
    )
    carried = [*req.columns, *PRICE_COLUMNS[:5], "price_factor", "server_tool_usd"]
    return priced.selectExpr(
        *carried,
        f"({tokens}) / 1E6 * price_factor AS token_cost_usd",
        f"({tokens}) / 1E6 * price_factor + server_tool_usd AS cost_usd",
        f"({writes}) / 1E6 * price_factor AS cache_write_usd",
    )


def component_usd() -> dict[str, Column]:
    """Money per component of one priced request; the parts add up to ``cost_usd``."""
    unit = F.col("in_usd") * F.col("price_factor") / F.lit(1e6)
    return {
        "input": nz("input_tok") * unit,
        "output": nz("output_tok") * F.col("out_usd") * F.col("price_factor") / F.lit(1e6),
        "cache_read": nz("cache_read_tok") * unit * F.col("cache_read_x"),
        "cache_w5m": nz("cache_w5m_tok") * unit * F.col("cache_w5m_x"),
        "cache_w1h": nz("cache_w1h_tok") * unit * F.col("cache_w1h_x"),
        "server_tool": F.col("server_tool_usd"),
    }


def join_project(df: DataFrame, session: DataFrame, how: str = "left") -> DataFrame:
    """Add ``project`` of the session (J-03)."""
    return df.join(session.select("session_id", "project"), "session_id", how)
