"""Text classification columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbwise import settings as S

BLANKS = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def contains(value: Column, pattern: str) -> Column:
    """Case-insensitive search for ``pattern`` anywhere in the text."""
    return value.rlike("(?iu)" + pattern)


def text_signal(description: Column) -> Column:
    """1 when only congestion words occur, -1 when only all-clear words occur, else 0.

    Written as a difference so that each pattern is searched once per text.
    """
    text = F.coalesce(description, F.lit(""))
    return contains(text, S.TEXT_AFFECTED).cast("int") - contains(text, S.TEXT_CLEAR).cast("int")


def archetype(
    description: Column,
    rules: Sequence[tuple[str, str]] = S.REPORT_RULES,
    default: str = S.DEFAULT_ARCHETYPE,
) -> Column:
    """Label of the first rule whose pattern occurs in the text."""
    text = F.coalesce(description, F.lit(""))
    labels = [F.when(contains(text, pattern), F.lit(label)) for pattern, label in rules]
    return F.coalesce(*labels, F.lit(default))


def urgency_tier(cause: Column, archetype_label: Column | None = None) -> Column:
    """Response tier of a cause; an archetype known in advance is always green."""
    table = F.create_map(*[F.lit(x) for pair in S.URGENCY_TIERS.items() for x in pair])
    tier = F.coalesce(F.try_element_at(table, cause), F.lit("std"))
    if archetype_label is None:
        return tier
    return F.when(archetype_label.isin(*S.GREEN_ARCHETYPES), F.lit("green")).otherwise(tier)


def urgency_label(tier: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in S.URGENCY_LABELS.items() for x in pair])
    return F.try_element_at(table, tier)
