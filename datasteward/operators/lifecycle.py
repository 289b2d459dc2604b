"""The decision log: history, notes, current states, feedback, versions.

Events are rows (concept_id, ts, action, actor, reason, details). States are the last
event per concept, taken with ``max_by``, which combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# States, review states and the actions that record them.
STATUS_ACTIONS = {"activo": "reactivated", "deprecado": "deprecated", "retirado": "retired"}
REVIEW_ACTIONS = {"proposed": "proposed", "under_review": "review_started", "approved": "approved", "rejected": "rejected"}
FEEDBACK_ORDER = {"rejected": 0, "approved": 1, "deprecated": 2, "reactivated": 3}


def history(events: DataFrame, concept: str | None = None) -> DataFrame:
    """Events in order; for one concept, or for all of them as a range-sorted table."""
    e = events if concept is None else events.filter(F.col("concept_id") == concept)
    return e.orderBy("concept_id", "ts", "event_id")


def last_events(events: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("concept_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= k)


def explanatory_note(events: DataFrame) -> DataFrame:
    """One line of the note per reasoned event; sorting by (concept_id, ts) gives the note."""
    who = F.when(F.col("actor") == "human", "(humano) ").otherwise("(auto) ")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), who, "action", F.lit(": "), "reason")
    return events.filter(F.coalesce("reason", F.lit("")) != "").select("concept_id", "event_id", "ts", line.alias("line"))


def _last(events: DataFrame, actions: list[str]) -> DataFrame:
    return (events.filter(F.col("action").isin(actions)).groupBy("concept_id")
            .agg(F.max_by("action", F.struct("ts", "event_id")).alias("last_action")))


def deprecated(events: DataFrame) -> DataFrame:
    return _last(events, ["deprecated", "retired", "reactivated", "status_changed"]).filter(
        F.col("last_action").isin("deprecated", "retired"))


def pending_reviews(events: DataFrame) -> DataFrame:
    last = _last(events, list(REVIEW_ACTIONS.values()))
    status = F.when(F.col("last_action") == "review_started", "under_review").otherwise(F.col("last_action"))
    return last.filter(F.col("last_action").isin("proposed", "review_started")).select("concept_id", status.alias("review_status"))


def recall_feedback(events: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Past decisions whose concept or reason shares a word with the query; a top-k report."""
    words = sorted({w for w in query.lower().strip().replace("_", " ").split() if len(w) > 2})
    concept = F.split(F.replace(F.replace(F.lower("concept_id"), F.lit("concept:"), F.lit("")), F.lit("_"), F.lit(" ")), r"\s+")
    reason = F.lower(F.coalesce("reason", F.lit("")))
    hit = F.arrays_overlap(concept, F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    for w in words:
        hit = hit | reason.contains(w)
    order = F.coalesce(*[F.when(F.col("action") == a, F.lit(p)) for a, p in FEEDBACK_ORDER.items()], F.lit(9))
    return events.filter(hit).orderBy(order, "ts", "event_id").limit(limit)


def change_status(requests: DataFrame, states: dict[str, str] = STATUS_ACTIONS) -> DataFrame:
    """Event rows for requested state changes; unknown states are marked, not recorded.

    ``requests``: concept_id, ts, new_status, actor, reason, replacement.
    """
    action = F.coalesce(*[F.when(F.col("new_status") == s, F.lit(a)) for s, a in states.items()])
    details = F.when(F.coalesce("replacement", F.lit("")) != "", F.concat(F.lit("reemplazado_por="), "replacement")).otherwise("")
    return requests.select("concept_id", "ts", action.alias("action"), "actor", "reason", details.alias("details"),
                           action.isNotNull().alias("accepted"))


def version_history(changes: DataFrame, start: tuple[int, int, int] = (1, 0, 0)) -> DataFrame:
    """Running semantic version of each catalog: ``changes`` (catalog, ts, seq, kind, and columns such as reason, nodes
    and edges, which are kept) with major, minor, patch, from_version and to_version.

    A major change resets minor and patch, a minor change resets patch. Running counts are
    taken inside each day and added to the counts of the days before, so a long history is
    never one window partition.
    """
    keys = ["catalog", "day"]
    c = changes.withColumn("day", F.to_date("ts"))
    one = {k: (F.col("kind") == k).cast("long") for k in ("major", "minor", "patch")}
    inner = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    local = c.withColumns({f"l_{k}": F.sum(v).over(inner) for k, v in one.items()})
    days = c.groupBy(*keys).agg(*[F.sum(v).alias(f"d_{k}") for k, v in one.items()])
    prior = Window.partitionBy("catalog").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(*keys, *[F.coalesce(F.sum(f"d_{k}").over(prior), F.lit(0)).alias(f"o_{k}") for k in one])
    run = local.join(offsets, keys).withColumns({f"n_{k}": F.col(f"l_{k}") + F.col(f"o_{k}") for k in one})
    # counts at the last reset: running counts never fall, so the maximum over resets is the last one
    at_major = F.when(F.col("kind") == "major", F.col("n_minor"))
    at_reset = F.when(F.col("kind").isin("major", "minor"), F.col("n_patch"))
    run = run.withColumns({"lm": F.max(at_major).over(inner), "lr": F.max(at_reset).over(inner)})
    day_max = run.groupBy(*keys).agg(F.max(at_major).alias("dm"), F.max(at_reset).alias("dr"))
    before = day_max.select(*keys, F.max("dm").over(prior).alias("om"), F.max("dr").over(prior).alias("orr"))
    t = run.join(before, keys)
    minor0, patch0 = F.coalesce(F.greatest("lm", "om"), F.lit(0)), F.coalesce(F.greatest("lr", "orr"), F.lit(0))
    untouched_minor = F.coalesce("lm", "om").isNull()
    untouched_patch = F.coalesce("lr", "orr").isNull()
    major = F.col("n_major") + start[0]
    minor = F.col("n_minor") - minor0 + F.when(untouched_minor, F.lit(start[1])).otherwise(0)
    patch = F.col("n_patch") - patch0 + F.when(untouched_patch, F.lit(start[2])).otherwise(0)
    named = t.select(*changes.columns, "day", major.alias("major"), minor.alias("minor"), patch.alias("patch"),
                     F.concat_ws(".", major, minor, patch).alias("to_version"))
    # the version before: of the row before in the day, else the last one of the days before
    ends = named.groupBy(*keys).agg(F.max_by("to_version", F.struct("ts", "seq")).alias("_end"))
    opened = ends.select(*keys, F.lag("_end").over(Window.partitionBy("catalog").orderBy("day")).alias("_open"))
    step = F.lag("to_version").over(Window.partitionBy(*keys).orderBy("ts", "seq"))
    return (named.withColumn("_step", step).join(opened, keys)
            .select(*changes.columns, "major", "minor", "patch",
                    F.coalesce("_step", "_open", F.lit(".".join(map(str, start)))).alias("from_version"), "to_version"))
