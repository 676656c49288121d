"""Who may see what: entitlement, release of closed notices, search scope, redacted projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRACE_DAYS = 3
RELEASE_DAYS = 3
ENDED = ("awarded", "cancelled", "deserted")


def entitled(status: Column, period_start: Column, period_end: Column, now: Column, grace_days: int = GRACE_DAYS) -> Column:
    """Active and trial periods until their end (an open end counts), a failed renewal for grace_days from its start."""
    running = status.isin("active", "trialing") & (period_end.isNull() | (period_end >= now))
    grace = (status == "past_due") & (now < period_start + F.expr(f"interval {grace_days} days"))
    return F.coalesce(running | grace, F.lit(False))


def release_day(status: Column, deadline: Column, awarded: Column, closed: Column, days: int = RELEASE_DAYS) -> Column:
    """The day a notice opens to all: days after its deadline, or after its award or close where it ended without one."""
    ended = F.when(status.isin(*ENDED), F.coalesce(awarded, closed))
    return F.when(status.eqNullSafe("suspended"), F.lit(None).cast("date")).otherwise(F.date_add(F.coalesce(deadline, ended), days))


def scoped(country: Column, entitled_countries: list[str], full: Column, public: Column) -> Column:
    """The text that a search may use: all of it in the viewer's own countries, the public part elsewhere."""
    return F.when(country.isin(*entitled_countries), full).otherwise(public) if entitled_countries else public


def searchable(*parts: Column) -> Column:
    """Lower-cased parts in a row; blank ones and repeats of the part before are left out."""
    kept, last = [], F.lit(None).cast("string")
    for p in parts:
        clean = F.nullif(F.trim(p), F.lit(""))
        kept.append(F.when(~clean.eqNullSafe(last), clean))
        last = clean
    return F.lower(F.concat_ws(" ", *kept))


def redacted(member: Column, exact: Column, coarse: Column) -> Column:
    """exact for members, coarse for everyone else."""
    return F.when(member, exact).otherwise(coarse)


def bid_window_action(tier: Column, value: Column, published: Column, estimated: Column, deadline: Column, reason: Column, locked: Column, own_reason: str, least_days: int = 12) -> Column:
    """exclude, restore or null: standard notices without an amount whose window is short go; those that went for this very
    reason come back when it no longer holds; locked rows and estimated dates decide nothing."""
    days = F.when(~F.coalesce(estimated, F.lit(False)), F.datediff(deadline, published))
    short = F.coalesce(days < least_days, F.lit(False))
    return (
        F.when(F.coalesce(locked, F.lit(False)), F.lit(None).cast("string"))
        .when(short & (tier == "standard") & value.isNull(), "exclude")
        .when(~short & (tier == "excluded") & (reason == own_reason), "restore")
    )
