"""Keys by which versions sort, as columns; comparisons that are no total order have a total one, documented here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_key(version: Column) -> Column:
    """Digits and dots only, compared number by number, the shorter first, ties by the text."""
    parts = F.filter(F.split(F.regexp_replace(version, "[^0-9.]", ""), r"\."), lambda x: x != "")
    return F.struct(F.transform(parts, lambda x: x.cast("long")).alias("numbers"), version.alias("text"))


def tool_key(version: Column) -> Column:
    """Segments between dots and dashes: numbers by value, before words, which compare as text; ties by the text.

    The comparison it stands for skips pairs with a word and so isn't transitive; where it compares numbers both agree.
    """
    parts = F.split(F.replace(version, F.lit("-"), F.lit(".")), r"\.")
    number = lambda x: F.when(x.rlike("^[0-9]{1,18}$"), x.cast("long"))
    return F.struct(F.transform(parts, lambda x: F.struct(F.coalesce(number(x), F.lit(-1)).alias("n"), F.when(number(x).isNull(), x).otherwise("").alias("w"))).alias("parts"), version.alias("text"))


def tag_key(tag: Column) -> Column:
    """major.minor.patch of a tag, a missing patch before 0, tags without numbers last; ties by the text."""
    at = lambda i: F.nullif(F.regexp_extract(tag, r"(\d+)\.(\d+)(?:\.(\d+))?", i), F.lit("")).cast("long")
    return F.struct(at(1).isNull().alias("unparsed"), F.coalesce(at(1), F.lit(0)).alias("major"), F.coalesce(at(2), F.lit(0)).alias("minor"), F.coalesce(at(3), F.lit(-1)).alias("patch"), tag.alias("text"))


def version_of_tag(tag: Column, pattern: str | None = None) -> Column:
    """What stands at ${version} in the pattern; else what follows the last dash."""
    if pattern and "${version}" in pattern:
        before, after = pattern.split("${version}")
        esc = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
        found = F.regexp_extract(tag, f"^{esc(before)}(.+){esc(after)}$", 1)
        return F.when(found != "", found).otherwise(F.substring_index(tag, "-", -1))
    return F.substring_index(tag, "-", -1)
