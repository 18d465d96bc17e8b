"""Labels derived from values: job category, option outcome, traffic lights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenchlight.functions.numbers import number_or
from wrenchlight.functions.text import clean, col, contains_any, has_any_tag

# Tags behind the job categories.
NEW_CONSTRUCTION_TAGS = (
    "new construction",
    "new-construction",
    "new build",
    "new-build",
    "newconstruction",
)
INSTALL_TAGS = ("install", "installation", "change out", "change-out", "changeout")
MAINTENANCE_TAGS = ("maintenance",)
SERVICE_TAGS = ("service", "demand service", "demand")

# Category names.
NEW_CONSTRUCTION = "New Construction"
UNCLASSIFIED = "Other / Unclassified"

# Job states that count as completed, invoice states that count as billed.
COMPLETED_STATES = ("complete unrated", "complete rated")
BILLED_STATES = ("open", "pending_payment")

# Option states that count as won or lost. Anything else is pending.
WON_STATES = (
    "approved",
    "pro approved",
    "accepted",
    "won",
    "sold",
    "selected",
    "created job from estimate",
    "complete rated",
    "complete unrated",
    "scheduled",
    "in progress",
)
LOST_STATES = (
    "declined",
    "pro declined",
    "rejected",
    "lost",
    "expired",
    "canceled",
    "cancelled",
    "deleted",
    "void",
)

# Outcomes of an estimate by weight: the heaviest outcome of its options decides.
OUTCOMES = {3: "won", 2: "lost", 1: "pending"}


def job_category(tags: Column | str) -> Column:
    """One of eight categories: new construction, else segment and kind of work."""
    text = F.lower(col(tags))
    segment = F.when(text.contains("residential"), "Residential").when(text.contains("commercial"), "Commercial")
    work = (
        F.when(has_any_tag(tags, INSTALL_TAGS), "Install")
        .when(has_any_tag(tags, MAINTENANCE_TAGS), "Maintenance")
        .when(has_any_tag(tags, SERVICE_TAGS), "Service")
    )
    named = F.concat(segment, F.lit(" "), work)
    is_new = has_any_tag(tags, NEW_CONSTRUCTION_TAGS)
    return F.when(is_new, NEW_CONSTRUCTION).otherwise(F.coalesce(named, F.lit(UNCLASSIFIED)))


def may_have_category(tags: Column | str) -> Column:
    """False only for jobs that ``job_category`` leaves unclassified: a cheap test for early filters."""
    return contains_any(tags, ("residential", "commercial", "new"))


def may_be_install(tags: Column | str) -> Column:
    """False only for jobs whose category is no install: a cheap test for early filters."""
    return contains_any(tags, ("install", "change"))


def is_install_category(category: Column | str) -> Column:
    return F.lower(col(category)).contains("install")


def outcome_weight(approval: Column | str, status: Column | str) -> Column:
    """3 won, 2 lost, 1 pending; a won state in either field beats a lost one."""
    a, s = clean(approval), clean(status)
    won = a.isin(*WON_STATES) | s.isin(*WON_STATES)
    lost = a.isin(*LOST_STATES) | s.isin(*LOST_STATES)
    return F.when(won, 3).when(lost, 2).otherwise(1)


def outcome_name(weight: Column | str) -> Column:
    label = F.when(col(weight) == 3, OUTCOMES[3]).when(col(weight) == 2, OUTCOMES[2])
    return label.otherwise(OUTCOMES[1])


def option_bucket(approval: Column | str, status: Column | str) -> Column:
    """The approval state, else the status, else 'unknown'."""
    empty = F.lit("")
    return F.coalesce(F.nullif(clean(approval), empty), F.nullif(clean(status), empty), F.lit("unknown"))


def at_least(value: Column | str, target: float) -> Column:
    """success from ``target`` on; unusable values count as 0."""
    return F.when(number_or(value, 0.0) >= target, "success").otherwise("danger")


def below_levels(value: Column | str, good: float, fair: float) -> Column:
    """success below ``good``, warning below ``fair`` (both limits excluded)."""
    return F.when(col(value) < good, "success").when(col(value) < fair, "warning").otherwise("danger")


def up_to_levels(value: Column | str, good: float, fair: float) -> Column:
    """success up to ``good``, warning up to ``fair`` (both limits included)."""
    return F.when(col(value) <= good, "success").when(col(value) <= fair, "warning").otherwise("danger")

