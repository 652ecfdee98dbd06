"""Text search patterns and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def like_pattern(value: Column, pattern: str | None) -> Column:
    """Case-insensitive match where only a leading or trailing ``%`` is special.

    ``%x%`` contains, ``x%`` starts with, ``%x`` ends with, ``x`` equals; an underscore
    and a ``%`` inside the text are ordinary characters. An empty pattern matches all.
    """
    if not pattern:
        return F.lit(True)
    text = F.lower(or_blank(value))
    wanted = pattern.lower()
    opens, closes = wanted.startswith("%"), wanted.endswith("%")
    if opens and closes:
        return F.contains(text, F.lit(wanted[1:-1]))
    if closes:
        return F.startswith(text, F.lit(wanted[:-1]))
    if opens:
        return F.endswith(text, F.lit(wanted[1:]))
    return text == F.lit(wanted)


def converted_label(satuan: Column, konversi: Column) -> Column:
    """Unit name of a converted quantity; marked when the factor changed it."""
    return F.when(konversi != 1, F.concat(satuan, F.lit(" (Conv)"))).otherwise(satuan)
