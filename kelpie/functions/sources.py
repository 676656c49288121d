"""Decision lists of single sources over folded text: kind of work, scope and amount give a tier. Keywords are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions.rules import first_match

#: Keywords of the engine's own lists, as patterns over lower-cased text.
WORDS = {
    "target": r"\b(power|grid|road|water|bolt|gear|valve|pipe|ring|widget|screw)",
    "build": r"\b(build|works?|construct|large|cold)",
    "service": r"\b(service|small|maintenance)",
    "equipment": r"\b(widget|gear|valve|pump)",
    "major": r"\b(large|plant|station)",
    "routine": r"\b(small|cleaning|paper)",
}


def has(text: Column, name: str, words: dict[str, str] = WORDS) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(words[name])


def by_amount(value: Column, floor: float, significant: float, flagship: float) -> Column:
    return first_match([("excluded", value < floor), ("flagship", value >= flagship), ("significant", value >= significant)], "standard")


def auction(text: Column) -> Column:
    """Every lot of the auction counts alike."""
    return F.lit("significant")


def grid_utility(text: Column) -> Column:
    return first_match([("excluded", has(text, "routine")), ("excluded", has(text, "service") & ~has(text, "build")), ("excluded", ~has(text, "target")), ("significant", has(text, "major"))], "standard")


def state_utility(text: Column, kind: Column, international: Column) -> Column:
    """By the kind that the number tells: services go; works by size; goods abroad only as equipment, at home only if major."""
    major = has(text, "major")
    return first_match([
        ("excluded", kind == "service"), ("significant", (kind == "works") & major & international), ("standard", (kind == "works") & (major | international)),
        ("excluded", kind == "works"), ("standard", (kind == "goods") & F.when(international, has(text, "equipment")).otherwise(major)),
    ], "excluded")


def concession(text: Column, value: Column, floor: float = 20_000.0, significant: float = 200_000.0, flagship: float = 400_000.0) -> Column:
    return F.when(~has(text, "build"), "excluded").when(value.isNull(), "significant").otherwise(by_amount(value, floor, significant, flagship))


def mining_company(text: Column, corporate: Column) -> Column:
    service = has(text, "service")
    return first_match([("excluded", ~has(text, "target")), ("excluded", service & ~has(text, "build")), ("significant", corporate & ~service)], "standard")


def equipment_auction(text: Column, value: Column, floor: float = 20_000.0, significant: float = 200_000.0, flagship: float = 400_000.0) -> Column:
    return F.when(~has(text, "equipment"), "excluded").when(value.isNull(), "excluded").otherwise(by_amount(value, floor, significant, flagship))


def small_state(text: Column, international: Column, value: Column, large: float = 400_000.0) -> Column:
    return first_match([("excluded", ~has(text, "target")), ("excluded", has(text, "service")), ("flagship", international & has(text, "major")), ("significant", international), ("significant", value >= large)], "excluded")


def metro(text: Column, value: Column, large: float = 200_000.0) -> Column:
    return first_match([("excluded", ~F.coalesce(value >= large, F.lit(False))), ("flagship", has(text, "build"))], "significant")


def oil_company(text: Column, kind: Column, international: Column) -> Column:
    return first_match([
        ("significant", (kind == "lease") & has(text, "major")), ("excluded", kind == "lease"), ("flagship", (kind == "works") & has(text, "major")), ("excluded", (kind == "works") & has(text, "routine")),
        ("significant", (kind == "works") & international), ("standard", (kind == "service") & has(text, "build")), ("standard", (kind == "goods") & (has(text, "equipment") | international)),
    ], "excluded")


def oil_portal(text: Column, kind: Column, international: Column) -> Column:
    return first_match([("excluded", has(text, "routine")), ("excluded", kind == "other"), ("excluded", (kind == "service") & ~has(text, "target")), ("flagship", (kind == "works") & has(text, "major")), ("significant", international)], "standard")


def refinery(text: Column) -> Column:
    return first_match([("excluded", ~has(text, "target")), ("excluded", has(text, "service") & ~has(text, "build"))], "significant")


def goods_auction(text: Column, value: Column, renewable: Column, floor: float = 50_000.0, low_floor: float = 20_000.0, significant: float = 200_000.0, flagship: float = 400_000.0) -> Column:
    """Only equipment; without an amount only renewable energy, which also has a floor of its own."""
    least = F.when(renewable, low_floor).otherwise(floor)
    return F.when(~has(text, "equipment"), "excluded").when(value.isNull(), F.when(renewable, "standard").otherwise("excluded")).when(value < least, "excluded").otherwise(by_amount(value, 0.0, significant, flagship))


def loan_notice(text: Column, international: Column) -> Column:
    return first_match([("excluded", has(text, "routine") & ~has(text, "build")), ("excluded", has(text, "service")), ("flagship", international & has(text, "major")), ("significant", international)], "excluded")
