"""Ordered decision lists as CASE expressions: the first rule that holds gives the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule whose condition is true (null is not true), else `otherwise`."""
    out = F.lit(otherwise).cast("string")
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def tags(text: Column, patterns: dict[str, str], fallback: str) -> Column:
    """The names of all patterns that the text matches, in the order given; [fallback] where there is none."""
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(fallback)))


def derived_status(stored: Column, deadline: Column, published: Column, today: Column, stale_days: int = 45, *, preview: Column | None = None, valid_until: Column | None = None, clarifies_today: Column | None = None, closed_by_import: Column | None = None) -> Column:
    """A notice's status on a day, by the first rule that holds: final and suspended states stay; a planned one of a preview
    source stays; an award stays unless bids are still open; a past deadline or end of validity closes; a clarification
    meeting today shows; a long silence without any end date closes, unless the source's own import closes its rows; else
    the notice is open."""
    never = F.lit(False)
    valid_until = F.lit(None).cast("date") if valid_until is None else valid_until
    silent = deadline.isNull() & valid_until.isNull() & ~F.coalesce(never if closed_by_import is None else closed_by_import, never)
    return F.coalesce(
        F.when(stored.isin("cancelled", "deserted", "suspended"), stored),
        F.when((stored == "planned") & (never if preview is None else preview), stored),
        F.when((stored == "awarded") & ~F.coalesce(deadline >= today, never), stored),
        F.when((deadline < today) | (valid_until < today), F.lit("submission_closed")),
        F.when(never if clarifies_today is None else clarifies_today, F.lit("clarification")),
        F.when(silent & (published < F.date_sub(today, stale_days)), F.lit("submission_closed")),
        F.lit("open"),
    )


def deadline_class(status: Column, deadline: Column, today: Column) -> Column:
    """0 open with a coming deadline, 1 planned, 2 suspended, 3 awarded, 4 another coming deadline, 5 the rest."""
    coming = F.coalesce(deadline >= today, F.lit(False))
    return (
        F.when(coming & status.isin("open", "clarification"), 0)
        .when(status == "planned", 1)
        .when(status == "suspended", 2)
        .when(status == "awarded", 3)
        .when(coming, 4)
        .otherwise(5)
    )
