"""What sources call things, as patterns over folded text. The lists are the engine's own and parameters."""

from __future__ import annotations

from pyspark.sql import Column

from kelpie.functions.rules import first_match
from kelpie.functions.text import folded

PORTUGUESE = {"excluded": r"\b(locacao|limpeza|vigilancia)\b", "small works": r"\b(reforma|praca|quadra)\b", "roads": r"\b(rodovia|pavimentacao|ponte)\b", "water": r"\b(agua|esgoto|saneamento)\b"}
STATES = {"cancelled": r"\b(cancelad[oa]|anulad[oa])\b", "deserted": r"\b(desert[oa]|fracassad[oa])\b", "awarded": r"\b(adjudicad[oa]|homologad[oa])\b", "suspended": r"\bsuspens[oa]\b", "open": r"\b(abert[oa]|abiert[oa]|publicad[oa])\b"}
SCOPES = {"works": r"\b(obras?|construccion)\b", "services": r"\b(servicios?|servicos?|consultoria)\b", "goods": r"\b(bienes|adquisicion|suministro)\b"}
RENEWABLE = r"\b(solar|fotovoltaic[oa]|eolic[oa]|wind farm|battery storage|hidrogeno)\b"


def worded(text: Column, patterns: dict[str, str], otherwise: str) -> Column:
    """The first name whose pattern the folded text has; null texts have none."""
    return first_match([(name, folded(text).rlike(p)) for name, p in patterns.items()], otherwise)


def renewable(text: Column) -> Column:
    return folded(text).rlike(RENEWABLE)
