"""Map tags: three different rules of what is missing, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty values in first-seen order, joined by '; '; null if nothing is left."""
    kept = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "") & (F.lower(v) != "nan")))
    return F.nullif(F.array_join(kept, "; "), F.lit(""))


def tag_text(value: Column) -> Column:
    """Trimmed text; '', 'nan' and 'none' in any case are missing."""
    t = F.trim(value)
    return F.when(F.lower(t).isin("", "nan", "none"), None).otherwise(t)


def flag(value: Column) -> Column:
    """Present, and neither 'no' nor 'false'."""
    return F.coalesce(~F.lower(tag_text(value)).isin("no", "false"), F.lit(False))


def label(value: Column) -> Column:
    """Parts of a ';' list, underscores as spaces, first letter capital, joined by ' / '."""
    parts = F.filter(F.transform(F.split(value, ";"), lambda v: F.trim(v)), lambda v: v != "")
    said = F.transform(parts, lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.translate(F.substring(v, 2, 1000), "_", " ")))
    return F.array_join(said, " / ")


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def short_name(value: Column) -> Column:
    """The first three parts between commas, trimmed; nothing for a missing name."""
    return F.coalesce(F.trim(F.array_join(F.slice(F.split(value, ","), 1, 3), ",")), F.lit(""))


def axis_keeps(state: Column, has: Column) -> Column:
    """Three-state filter: 0 any, positive has, negative has not."""
    return (state == 0) | ((state > 0) == has)


def plural(n: Column, lang: str) -> Column:
    """Plural category; Polish has three."""
    if lang != "pl":
        return F.when(n == 1, "one").otherwise("other")
    few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(n == 1, "one").when(few, "few").otherwise("many")
