"""Human judgments, task links, commits and reverts (T-16 … T-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usageloom import fixed_values as fixed
from usageloom.functions.scalar import micros
from usageloom.operators.temporal import asof_backward

TASK_LINK_TOLERANCE_S = 120
COMMIT_TOLERANCE_S = 21_600
REVERT_PATTERN = "This reverts commit ([0-9a-fA-F]+)"
REVERT_KEY = 7

# Keys that must be present, per kind of judgment.
REQUIRED = {
    "marker_start": ("marker_id", "ts_start", "category", "hypothesis"),
    "marker_end": ("marker_id", "ts_end"),
    "marker_verdict": ("marker_id", "verdict", "decided_by", "verdict_ts"),
    "outcome": ("prompt_id", "ts", "label", "source"),
    "task_label": ("prompt_id", "label"),
    "task_start": ("task_id", "title", "category", "ts_start"),
    "task_attach": ("task_id", "prompt_id", "attached_ts"),
    "task_finish": ("task_id", "ts_end", "outcome"),
    "roi_cost": ("cost_id", "ts", "cost_kind"),
    "regime": ("ts", "regime_kind", "detail"),
    "invoice": ("month", "billed_usd", "ts"),
}


def _s(name: str) -> Column:
    return F.try_variant_get("p", f"$.{name}", "string")


def _d(name: str) -> Column:
    return F.try_variant_get("p", f"$.{name}", "double")


def _t(name: str) -> Column:
    return F.timestamp_micros(F.round(_d(name) * 1e6).cast("bigint"))


def _shape(name: str) -> Column:
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get("p", f"$.{name}", "variant")), F.lit("VOID")
    )


def _missing(kind: str) -> Column:
    absent = F.filter(
        F.array(*[F.when(_s(k).isNull(), F.lit(k)) for k in REQUIRED[kind]]), lambda x: x.isNotNull()
    )
    return F.when(F.size(absent) > 0, F.concat(F.lit("missing keys: "), F.array_join(absent, ",")))


def _enum(name: str, allowed, message: str) -> Column:
    return F.when(~F.coalesce(_s(name).isin(*allowed), F.lit(False)), F.lit(message))


def _shape_checks(kind: str) -> list[Column]:
    """Checks on the values alone, in order of precedence."""
    checks = [_missing(kind)]
    if kind == "marker_verdict":
        checks += [
            _enum("verdict", fixed.VERDICTS, "invalid verdict"),
            _enum("decided_by", fixed.DECIDERS, "invalid decided_by"),
        ]
    elif kind == "outcome":
        checks += [
            _enum("label", fixed.PROMPT_OUTCOMES, "invalid outcome"),
            _enum("source", fixed.OUTCOME_SOURCES, "invalid outcome"),
        ]
    elif kind == "task_label":
        checks.append(_enum("label", fixed.TASK_LABELS, "invalid task label"))
    elif kind == "task_start":
        checks.append(_enum("category", fixed.TASK_LABELS, "invalid task category"))
    elif kind == "task_finish":
        quality, rework = _shape("quality_score"), _shape("rework_minutes")
        number = rework.startswith("BIGINT") | rework.startswith("DOUBLE") | rework.startswith("DECIMAL")
        checks += [
            _enum("outcome", fixed.TASK_OUTCOMES, "invalid task outcome"),
            F.when(
                (quality != "VOID")
                & ~((quality == "BIGINT") & F.coalesce(_d("quality_score").between(1, 5), F.lit(False))),
                F.lit("quality_score must be 1..5"),
            ),
            F.when(
                (rework != "VOID") & ~(number & F.coalesce(_d("rework_minutes") >= 0, F.lit(False))),
                F.lit("rework_minutes must be non-negative"),
            ),
        ]
    elif kind == "roi_cost":
        checks.append(
            F.when(_s("minutes").isNull() & _s("usd").isNull(), F.lit("roi cost requires minutes or usd"))
        )
    return checks


def _needs(df: DataFrame, known: DataFrame, key: str, message: str, ordered: bool) -> DataFrame:
    """Reject rows whose ``key`` is not known (``ordered``: not known yet at their time)."""
    ref = known.select(
        F.col(key).alias("_ref"), (F.col("ord") if ordered else F.lit(True)).alias("_since")
    )
    found = df.withColumn("_key", _s(key)).join(ref, F.col("_key") == F.col("_ref"), "left")
    fine = F.col("_since") < F.col("ord") if ordered else F.col("_since")
    return found.withColumn(
        "reason",
        F.coalesce("reason", F.when(~F.coalesce(fine, F.lit(False)), F.lit(message))),
    ).drop("_key", "_ref", "_since")


def replay_judgments(hooks: DataFrame, prompt: DataFrame) -> dict[str, DataFrame]:
    """Judgment events in (time, payload) order turned into tables; bad ones into ``rejected`` (T-16).

    Starts, outcomes, costs and regimes count once, the first time; ends,
    verdicts, labels, attachments, finishes and invoices the last time.  A
    reference must be known before the event that uses it.
    """
    v = F.try_parse_json("payload_json")
    rows = hooks.where(F.col("kind") == "judgment").select(
        "ts", "payload_json", F.struct("ts", "payload_json").alias("ord"),
        F.try_variant_get(v, "$.payload", "variant").alias("p"),
    )
    rows = rows.withColumn("what", _s("kind"))
    shape = F.coalesce(F.schema_of_variant("p"), F.lit("VOID"))
    broken = F.when(~shape.startswith("OBJECT"), F.lit("payload must be an object")).when(
        ~F.coalesce(F.col("what").isin(*REQUIRED), F.lit(False)),
        F.concat(F.lit("unknown judgment kind: "), F.coalesce("what", F.lit("none"))),
    )
    rows = rows.withColumn("broken", broken)
    rejected = [rows.where(F.col("broken").isNotNull()).select("ts", F.col("broken").alias("reason"), "payload_json")]

    def of(kind: str, *references: tuple[DataFrame, str, str, bool]) -> DataFrame:
        checks = F.coalesce(*_shape_checks(kind))
        out = rows.where(F.col("broken").isNull() & (F.col("what") == kind)).withColumn("reason", checks)
        for known, key, message, ordered in references:
            out = _needs(out, known, key, message, ordered)
        rejected.append(out.where(F.col("reason").isNotNull()).select("ts", "reason", "payload_json"))
        return out.where(F.col("reason").isNull())

    def first(df: DataFrame, keys: dict[str, Column], **columns: Column) -> DataFrame:
        picked = F.min_by(F.struct(*[c.alias(n) for n, c in columns.items()], "ord"), "ord")
        return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(picked.alias("v")).select(*keys, "v.*")

    def last(df: DataFrame, keys: dict[str, Column], **columns: Column) -> DataFrame:
        picked = F.max_by(F.struct(*[c.alias(n) for n, c in columns.items()]), "ord")
        return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(picked.alias("v")).select(*keys, "v.*")

    marker_id, task_id, prompt_id = {"marker_id": _s("marker_id")}, {"task_id": _s("task_id")}, {"prompt_id": _s("prompt_id")}
    started = first(
        of("marker_start"), marker_id, ts_start=_t("ts_start"), category=_s("category"),
        hypothesis=_s("hypothesis"), expected_effect=_s("expected_effect"),
    )
    marker_known = (started, "marker_id", "marker not found", True)
    ended = last(of("marker_end", marker_known), marker_id, ts_end=_t("ts_end"))
    judged = last(
        of("marker_verdict", marker_known), marker_id, verdict=_s("verdict"), decided_by=_s("decided_by"),
        verdict_ts=_t("verdict_ts"), saving_usd=_d("saving_usd"), saving_low_usd=_d("saving_low_usd"),
        saving_high_usd=_d("saving_high_usd"), saving_basis=_s("saving_basis"), verdict_note=_s("note"),
    )
    marker = started.drop("ord").join(ended, "marker_id", "left").join(judged, "marker_id", "left")

    outcome = first(
        of("outcome"), {"prompt_id": _s("prompt_id"), "ts": _t("ts"), "source": _s("source")},
        label=_s("label"), lines_added=_d("lines_added").cast("bigint"),
        lines_removed=_d("lines_removed").cast("bigint"), commits=_d("commits").cast("bigint"),
    ).drop("ord")
    prompt_known = (prompt.select("prompt_id"), "prompt_id", "prompt not found", False)
    labels = last(of("task_label", prompt_known), prompt_id, task_label=_s("label"))

    begun = first(
        of("task_start"), task_id, title=_s("title"), goal=_s("goal"), category=_s("category"),
        project=_s("project"), ts_start=_t("ts_start"),
        created_by=F.coalesce(F.nullif(_s("created_by"), F.lit("")), F.lit("human")),
    )
    task_known = (begun, "task_id", "task not found", True)
    attached = last(
        of("task_attach", task_known, prompt_known), prompt_id, task_id=_s("task_id"),
        attached_ts=_t("attached_ts"),
        source=F.coalesce(F.nullif(_s("source"), F.lit("")), F.lit("manual")),
        confidence=F.coalesce(_d("confidence"), F.lit(1.0)),
    )
    finished = last(
        of("task_finish", task_known), task_id, ts_end=_t("ts_end"), status=F.lit("finished"),
        outcome=_s("outcome"), quality_score=_d("quality_score").cast("int"),
        rework_minutes=_d("rework_minutes"), note=_s("note"),
    )
    work_task = begun.drop("ord").join(finished, "task_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("active"))
    )
    roi_cost = first(
        of("roi_cost"), {"cost_id": _s("cost_id")}, ts=_t("ts"), kind=_s("cost_kind"), minutes=_d("minutes"),
        usd=_d("usd"), note=_s("note"), source=F.coalesce(F.nullif(_s("source"), F.lit("")), F.lit("human")),
    ).drop("ord")
    regime = first(of("regime"), {"kind": _s("regime_kind"), "detail": _s("detail")}, ts=_t("ts")).drop("ord")
    invoice = last(of("invoice"), {"month": _s("month")}, billed_usd=_d("billed_usd"), note=_s("note"), ts=_t("ts"))

    bad = rejected[0]
    for part in rejected[1:]:
        bad = bad.unionByName(part)
    bad = bad.groupBy("reason", F.col("payload_json").alias("raw")).agg(F.min("ts").alias("ts")).select(
        "ts", F.lit("judgment").alias("src"), "reason", "raw"
    )
    return {
        "marker": marker, "outcome": outcome, "task_label": labels, "work_task": work_task,
        "task_prompt": attached, "roi_cost": roi_cost, "regime_event": regime, "invoice": invoice,
        "rejected": bad,
    }


def label_prompts(prompt: DataFrame, labels: DataFrame) -> DataFrame:
    """Prompts with the last label given to them."""
    return prompt.drop("task_label").join(labels, "prompt_id", "left")


def nearest_prompt(events: DataFrame, prompt: DataFrame, tolerance_s: int) -> DataFrame:
    """The prompt of the same session closest in time, at most ``tolerance_s`` away.

    Looked up backwards and forwards as of the event; no pairs are formed.  Of
    equally distant prompts the earlier one is taken.
    """
    us = micros("ts")
    back = asof_backward(events, prompt, "session_id", us, us, "prompt_id", ("prompt_id",), "_back")
    both = asof_backward(back, prompt, "session_id", -micros("ts"), -us, "prompt_id", ("prompt_id",), "_ahead")
    behind = micros("ts") - F.col("_back.match_us")
    ahead = -F.col("_ahead.match_us") - micros("ts")
    take_back = F.coalesce(behind <= ahead, F.col("_back").isNotNull())
    distance = F.when(take_back, behind).otherwise(ahead)
    near = distance <= tolerance_s * 1_000_000
    chosen = F.when(take_back, F.col("_back.prompt_id")).otherwise(F.col("_ahead.prompt_id"))
    return (
        both.withColumn("near_prompt_id", F.when(near, chosen))
        .withColumn("distance_s", F.when(near, distance / F.lit(1e6)))
        .drop("_back", "_ahead")
    )


def link_tasks(
    hooks: DataFrame, prompt: DataFrame, task: DataFrame, existing: DataFrame,
    tolerance_s: int = TASK_LINK_TOLERANCE_S,
) -> DataFrame:
    """Attach prompts submitted while a task was active; existing links stay (T-17).

    ``hooks``: ts, session_id, prompt_id, task_id of prompt submissions.  An
    event without a prompt id goes to the nearest prompt of its session, with a
    confidence that falls with the distance.
    """
    events = hooks.where(F.col("task_id").isNotNull()).join(
        task.select("task_id"), "task_id", "left_semi"
    )
    direct = events.where(F.col("prompt_id").isNotNull()).select(
        "task_id", "prompt_id", F.col("ts").alias("attached_ts"), F.lit(1.0).alias("confidence")
    )
    guessed = nearest_prompt(
        events.where(F.col("prompt_id").isNull()).drop("prompt_id"),
        prompt.select("session_id", "ts", "prompt_id"), tolerance_s,
    ).where(F.col("near_prompt_id").isNotNull()).select(
        "task_id", F.col("near_prompt_id").alias("prompt_id"), F.col("ts").alias("attached_ts"),
        F.greatest(F.lit(0.5), F.lit(1.0) - F.col("distance_s") / F.lit(2.0 * tolerance_s)).alias("confidence"),
    )
    links = (
        direct.unionByName(guessed)
        .join(prompt.select("prompt_id"), "prompt_id", "left_semi")
        .join(existing.select("prompt_id"), "prompt_id", "left_anti")
        .groupBy("prompt_id")
        .agg(F.min_by(F.struct("task_id", "attached_ts", "confidence"), F.struct("attached_ts", "task_id")).alias("l"))
    )
    return links.select("l.task_id", "prompt_id", "l.attached_ts", F.lit("active_task_hook").alias("source"), "l.confidence")


def commit_events(hooks: DataFrame) -> DataFrame:
    """Commits from hook events; the first report of a sha counts (T-18).

    ``hooks``: ts, payload_json.
    """
    v = F.try_parse_json("payload_json")
    rows = hooks.where(F.col("kind") == "git_commit").withColumn("p", F.try_variant_get(v, "$.payload", "variant"))
    rows = rows.where(F.coalesce(_s("sha"), F.lit("")) != "")
    fields = F.struct(
        "ts", _s("repo").alias("repo"), _s("repo_path").alias("repo_path"), _s("branch").alias("branch"),
        _s("subject").alias("subject"), _s("body").alias("body"),
        _d("insertions").cast("bigint").alias("insertions"), _d("deletions").cast("bigint").alias("deletions"),
        F.coalesce(F.to_json(F.try_variant_get("p", "$.files", "variant")), F.lit("[]")).alias("files_json"),
    )
    return rows.groupBy(_s("sha").alias("sha")).agg(
        F.min_by(fields, F.struct("ts", "payload_json")).alias("c")
    ).select("sha", "c.*")


def attribute_commits(
    commits: DataFrame, prompt: DataFrame, session: DataFrame, tolerance_s: int = COMMIT_TOLERANCE_S
) -> DataFrame:
    """Add to each commit the latest prompt of its project at most six hours before (T-18)."""
    keyed = commits.withColumn("project", F.replace(F.coalesce("repo_path", F.lit("")), F.lit("/"), F.lit("-")))
    asked = prompt.select("prompt_id", "session_id", "ts").join(
        session.where(F.col("project").isNotNull()).select("session_id", "project"), "session_id"
    )
    us = micros("ts")
    found = asof_backward(keyed, asked, "project", us, us, "prompt_id", ("prompt_id",), "_p")
    fresh = us - F.col("_p.match_us") <= tolerance_s * 1_000_000
    return found.withColumn("prompt_id", F.when(fresh, F.col("_p.prompt_id"))).drop("_p", "project")


def commit_outcomes(attributed: DataFrame) -> DataFrame:
    """A commit completes the prompt it belongs to (T-18)."""
    rows = attributed.where(F.col("prompt_id").isNotNull())
    return rows.groupBy("prompt_id", "ts").agg(
        F.min_by(F.struct("insertions", "deletions"), "sha").alias("c")
    ).select(
        "prompt_id", "ts", F.lit("completed").alias("label"),
        F.col("c.insertions").alias("lines_added"), F.col("c.deletions").alias("lines_removed"),
        F.lit(1).cast("bigint").alias("commits"), F.lit("auto").alias("source"),
    )


def detect_reverts(commits: DataFrame, attributed: DataFrame) -> DataFrame:
    """Commits whose text reverts an earlier one, as outcomes of that one's prompt (T-19).

    A sha prefix of ``REVERT_KEY`` characters or more is joined on that many
    characters and then compared in full; for a shorter one the winner among
    all commits with that prefix is prepared in advance.  The shortest matching
    sha wins.
    """
    prefix = F.lower(F.regexp_extract(F.coalesce("body", F.lit("")), REVERT_PATTERN, 1))
    reverts = commits.select("sha", "ts", prefix.alias("prefix")).where(F.col("prefix") != "")
    reverts = reverts.withColumn("k", F.least(F.length("prefix"), F.lit(REVERT_KEY))).withColumn(
        "key", F.substring(F.col("prefix"), F.lit(1), F.col("k"))
    )
    known = attributed.where(F.col("prompt_id").isNotNull()).select(
        F.lower("sha").alias("full"), "sha", "prompt_id"
    )
    order = F.struct(F.length("sha"), F.col("sha"))
    short = (
        known.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(REVERT_KEY - 1))))
        .groupBy("k", F.substring(F.col("full"), F.lit(1), F.col("k")).alias("key"))
        .agg(F.min_by(F.struct("full", "sha", "prompt_id"), order).alias("o"))
        .select("k", "key", "o.*")
    )
    exact = known.select(F.lit(REVERT_KEY).alias("k"), F.substring("full", 1, REVERT_KEY).alias("key"), "full", "sha", "prompt_id")
    candidates = short.unionByName(exact).withColumnRenamed("sha", "original")
    hits = reverts.join(candidates, ["k", "key"]).where(F.col("full").startswith(F.col("prefix")))
    found = hits.groupBy("sha", "ts").agg(
        F.min_by("prompt_id", F.struct(F.length("original"), F.col("original"))).alias("prompt_id")
    )
    nothing = F.lit(None).cast("bigint")
    return found.groupBy("prompt_id", "ts").agg(F.lit(1).cast("bigint").alias("commits")).select(
        "prompt_id", "ts", F.lit("reverted").alias("label"), nothing.alias("lines_added"),
        nothing.alias("lines_removed"), "commits", F.lit("auto").alias("source"),
    )


def merge_outcomes(judged: DataFrame, completed: DataFrame, reverted: DataFrame) -> DataFrame:
    """Outcomes of people and of commits; a revert replaces an outcome with the same key (T-19)."""
    rows = (
        judged.withColumn("_rank", F.lit(1))
        .unionByName(completed.withColumn("_rank", F.lit(2)))
        .unionByName(reverted.withColumn("_rank", F.lit(0)))
    )
    keys = ("prompt_id", "ts", "source")
    rest = ("label", "lines_added", "lines_removed", "commits")
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_rank").alias("o")).select(*keys, "o.*")
