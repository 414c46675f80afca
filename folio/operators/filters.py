"""Predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scopes that a dependency scope includes.
SCOPES = {"compile": ("compile", "provided", "system"), "runtime": ("compile", "runtime"), "compile+runtime": ("compile", "provided", "system", "runtime"), "runtime+system": ("compile", "runtime", "system"), "test": ("compile", "provided", "system", "runtime", "test")}
# Beginnings of commit messages that a change log leaves out.
NOISE = ("[maven-release-plugin]", "skip changelog", "Merge pull request #")


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def matches_any(value: Column, rules: list[str]) -> Column:
    """Rules "regex:..." (whole value), "prefix:..." or equality; false without rules."""
    exact = [r for r in rules if not r.startswith(("regex:", "prefix:"))]
    parts = [value.rlike(f"^(?:{r[6:]})$") for r in rules if r.startswith("regex:")] + [F.startswith(value, F.lit(r[7:])) for r in rules if r.startswith("prefix:")]
    return F.coalesce(_any([*parts, *([value.isin(exact)] if exact else [])]), F.lit(False))


def included(name: Column, include: list[str], exclude: list[str]) -> Column:
    """File names that a rule of include matches (all without rules) and none of exclude; "regex:", "r:", "i:" or equality."""

    def one(r: str) -> Column:
        if r.startswith(("regex:", "r:")):
            return name.rlike(f"^(?:{r.split(':', 1)[1]})$")
        return F.lower(name) == r[2:].lower() if r.startswith("i:") else name == r

    return (_any([one(r) for r in include]) if include else F.lit(True)) & ~_any([one(r) for r in exclude])


def listing_page(path: Column) -> Column:
    """Generated pages of a blog: page-* and index.html below blog/."""
    file = F.substring_index(path, "/", -1)
    return F.contains(path, F.lit("blog/")) & (F.startswith(file, F.lit("page-")) | (file == "index.html"))


def skipped(html: Column, mark: str = ":index-skip: true") -> Column:
    """A line equal to the mark with which a site keeps a page out of its index."""
    return F.array_contains(F.split(html, "\r\n|\r|\n", -1), mark)


def skip_attribute(attributes: Column, name: str = "skip") -> Column:
    return F.map_contains_key(attributes, name)


def visible(published: Column, now: Column) -> Column:
    """Published strictly before now; a missing date counts as now."""
    return F.coalesce(published, now) < now


def in_scope(scope: Column, wanted: str) -> Column:
    if wanted == "all":
        return F.lit(True)
    if wanted.endswith("_only"):
        return scope == wanted.removesuffix("_only")
    if wanted not in SCOPES:
        raise ValueError(f"unknown scope {wanted}")
    return scope.isin(list(SCOPES[wanted]))


def in_group(group: Column, wanted: str, any_of: bool = False) -> Column:
    """All of the comma list's names equal the group, so two names match nothing; any_of: one of them does."""
    names = [x.strip() for x in wanted.split(",") if x.strip()]
    return group.isin(names) if any_of else reduce(lambda a, b: a & b, [group == x for x in names], F.lit(True))


def commit_in(ts: Column, zone: Column, mail: Column, start: str | None = None, end: str | None = None, mail_regex: str | None = None) -> Column:
    """Dates inclusive in the committer's time zone; the whole mail matches."""
    day = F.to_date(F.from_utc_timestamp(ts, zone))
    parts = ([day >= F.lit(start).cast("date")] if start else []) + ([day <= F.lit(end).cast("date")] if end else []) + ([mail.rlike(f"^(?:{mail_regex})$")] if mail_regex else [])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def released_between(ts: Column, start: str | None, end: str | None) -> Column:
    """Inclusive at both ends; with one end only the window is a year."""
    if start is None and end is None:
        return F.lit(True)
    a, b = (F.lit(x).cast("timestamp") if x else None for x in (start, end))
    year = F.expr("INTERVAL 1 YEAR")
    return ts.between(a if a is not None else b - year, b if b is not None else a + year)


def released_within(day: Column, start: str, end: str) -> Column:
    """Exclusive at both ends, dates as dd/MM/yyyy."""
    return (day > F.to_date(F.lit(start), "dd/MM/yyyy")) & (day < F.to_date(F.lit(end), "dd/MM/yyyy"))


def is_noise(message: Column) -> Column:
    return _any([F.startswith(message, F.lit(x)) for x in NOISE])


def embeddable(path: Column, has_source: Column) -> Column:
    """Not 404.html or page-*; index.html only where its source exists."""
    file = F.substring_index(path, "/", -1)
    return ~((file == "404.html") | F.startswith(file, F.lit("page-"))) & ((file != "index.html") | F.coalesce(has_source, F.lit(False)))


def named(value: Column, names: str | None) -> Column:
    """One of a comma list; all if it is blank."""
    wanted = [x.strip() for x in (names or "").split(",") if x.strip()]
    return value.isin(wanted) if wanted else F.lit(True)


def version_matches(wanted: Column, version: Column, key: Column, relaxed: Column) -> Column:
    return (version == wanted) | (key == wanted) | (relaxed & F.startswith(version, wanted))


def condition(attributes: Column, kind: str, expression: str) -> Column:
    """ifdef::a[], ifndef::a[] ("," any, "+" all), ifeval with == != < <= > >=: as text, or as numbers for the order."""
    if kind in ("ifdef", "ifndef"):
        split = "+" if "+" in expression else ","
        has = [F.map_contains_key(attributes, x.strip()) for x in expression.split(split)]
        defined = reduce(lambda a, b: a & b if split == "+" else a | b, has)
        return defined if kind == "ifdef" else ~defined
    for op in ("==", "!=", "<=", ">=", "<", ">"):
        if op in expression:
            sides = []
            for side in expression.split(op, 1):
                side = side.strip().strip("\"'")
                sides.append(F.coalesce(F.element_at(attributes, side[1:-1]), F.lit("")) if side.startswith("{") and side.endswith("}") else F.lit(side))
            a, b = sides
            x, y = a.try_cast("double"), b.try_cast("double")
            return {"==": a == b, "!=": a != b, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    raise ValueError(f"no comparison in {expression}")


def first_branch(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The content of the first true branch."""
    out = None
    for test, content in branches:
        out = F.when(test, content) if out is None else out.when(test, content)
    return out.otherwise(otherwise) if otherwise is not None else out  # type: ignore[union-attr, return-value]
