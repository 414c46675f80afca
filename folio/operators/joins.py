"""Lookups: resolution of versions, previous versions, precedence, fuzzy and spatial joins, plans of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import ordering


def _cut(n: Column, k: Column, parts: int) -> tuple[Column, Column]:
    """Start and length of part k of parts of a word with n characters."""
    start = F.floor(k * n / parts).cast("int")
    return start, F.floor((k + 1) * n / parts).cast("int") - start


def near_words(left: DataFrame, right: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b, distance): distinct pairs of words of left (a) and right (b) at 1 to distance edits.

    Of distance + 1 parts of a word one is untouched by distance edits, and moved by no more than that. So words meet by
    length and part: an equi-join whose keys are as selective as the parts, instead of a comparison of all pairs.
    """
    parts = distance + 1
    each = F.sequence(F.lit(0), F.lit(parts - 1))
    mine = left.select("a").where("a <> ''").distinct().withColumn("n", F.length("a")).withColumn("k", F.explode(each))
    start, size = _cut(F.col("n"), F.col("k"), parts)
    mine = mine.select("a", "n", "k", F.substring(F.col("a"), start + 1, size).alias("part"))
    other = right.select("b").where("b <> ''").distinct().withColumn("m", F.length("b")).withColumn("n", F.explode(F.sequence(F.greatest(F.col("m") - distance, F.lit(1)), F.col("m") + distance))).withColumn("k", F.explode(each))
    start, size = _cut(F.col("n"), F.col("k"), parts)
    other = other.withColumn("at", start).withColumn("size", size).withColumn("from", F.explode(F.sequence(F.lit(-distance), F.lit(distance)))).withColumn("from", F.col("at") + F.col("from"))
    other = other.where("`from` >= 0 AND `from` + size <= m").select("b", "n", "k", F.substring(F.col("b"), F.col("from") + 1, F.col("size")).alias("part")).distinct()
    pairs = mine.join(other, ["n", "k", "part"]).select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", distance)).where(F.col("distance").between(1, distance))


def fuzzy(left: DataFrame, right: DataFrame, a: str, b: str, distance: int = 2) -> DataFrame:
    """Rows of left and right whose words a and b are at 1 to distance edits, with the distance."""
    pairs = near_words(left.select(F.col(a).alias("a")), right.select(F.col(b).alias("b")), distance).select(F.col("a").alias("__a"), F.col("b").alias("__b"), "distance")
    return left.join(pairs, F.col(a) == F.col("__a")).join(right, F.col(b) == F.col("__b")).drop("__a", "__b")


def resolved(requests: DataFrame, versions: DataFrame, matches: Column) -> DataFrame:
    """The version for each request: of the first provider in rank with a match, installed ones first, then by place.

    requests (request_id, tool, ...), versions (tool, provider_rank, is_remote, pos, ...); matches: a condition on both.
    """
    return ordering.first_of(requests.join(versions, "tool").where(matches), ["request_id"], "provider_rank", "is_remote", "pos")


def resolved_above(requests: DataFrame, versions: DataFrame, wanted: str, offered: str) -> DataFrame:
    """As resolved() for versions whose offered is above the request's wanted, without pairs; unknown ranks come last.

    Per tool, from the largest value down, a request meets all versions that are above it before its own row: the first of
    them in rank is a running minimum. Columns of versions must have an order.
    """
    ranks = ["provider_rank", "is_remote", "pos"]
    more = [c for c in versions.columns if c != "tool"]
    place = F.struct(*[x for c in ranks for x in (F.col(c).isNull(), F.col(c))])
    asked = requests.where(F.col("tool").isNotNull() & F.col(wanted).isNotNull()).select("tool", F.col(wanted).alias("__x"), F.lit(0).alias("__side"), F.struct(*requests.columns).alias("__r"))
    given = versions.where(F.col("tool").isNotNull() & F.col(offered).isNotNull()).select("tool", F.col(offered).alias("__x"), F.lit(1).alias("__side"), F.struct(place.alias("place"), F.struct(*more).alias("v")).alias("__offer"))
    both = asked.unionByName(given, allowMissingColumns=True)
    found = ordering.running_least(both, "tool", "__offer", "__best", F.desc("__x"), "__side").where("__r IS NOT NULL AND __best IS NOT NULL")
    return ordering.first_of(found.select("__r.*", "__best.v.*"), ["request_id"], *[F.asc_nulls_last(c) for c in ranks])


def overridden(sets: DataFrame, key: str, rank: str) -> DataFrame:
    """One row for each key: of the set with the smallest rank."""
    return ordering.first_of(sets, [key], rank)


def with_previous(tags: DataFrame, group: str, key: Column, value: str) -> DataFrame:
    """tags with previous: the value of the tag before in the order of key."""
    return tags.withColumn("previous", F.lag(value).over(Window.partitionBy(group).orderBy(key)))


def between_tags(commits: DataFrame, bounds: DataFrame, ts: str, since: str, until: str, group: str) -> DataFrame:
    """Commits with since < ts <= until of a bound of their group; bounds without since start with the first commit."""
    return commits.join(bounds, group).where((F.col(since).isNull() | (F.col(ts) > F.col(since))) & (F.col(ts) <= F.col(until)))


def update_plan(wanted: DataFrame, existing: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action): create what is new, update what differs, leave the rest unchanged."""
    old = existing.select(F.col(key), F.col(content).alias("__old"), F.lit(True).alias("__has"))
    action = F.when(F.col("__has").isNull(), "create").when(F.col(content).eqNullSafe(F.col("__old")), "unchanged").otherwise("update")
    return wanted.join(old, key, "left").select(key, action.alias("action"))


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def first_icon(categories: DataFrame, icons: DataFrame, key: str, pos: str, name: str, normalise) -> DataFrame:
    """(key, icon): of the first category with an icon, under its own name or else its normalised one."""
    small = icons.select(F.col(name).alias("__n"), F.col("icon"))
    own = categories.join(small.withColumnRenamed("__n", name).withColumnRenamed("icon", "__exact"), name, "left")
    own = own.withColumn("__n", normalise(F.col(name))).join(small.withColumnRenamed("icon", "__folded"), "__n", "left")
    return own.withColumn("icon", F.coalesce("__exact", "__folded")).where("icon IS NOT NULL").groupBy(key).agg(F.min_by("icon", pos).alias("icon"))


def inside(points: DataFrame, shapes: DataFrame, x: str, y: str, polygon: str) -> DataFrame:
    """Pairs of points and shapes (polygon: array of (x, y)) that contain them: bounding boxes first, then ray casting.

    Shapes of a drawing are few; both sides meet by drawing id, the column they share.
    """
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    boxed = shapes.withColumns({"__x0": F.array_min(xs), "__x1": F.array_max(xs), "__y0": F.array_min(ys), "__y1": F.array_max(ys)})
    shared = [c for c in points.columns if c in shapes.columns]
    near = points.join(boxed, shared).where(F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1")))
    return near.where(contains(F.col(x), F.col(y), F.col(polygon))).drop("__x0", "__x1", "__y0", "__y1")


def contains(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting: whether an odd number of edges is crossed to the right."""
    edges = F.zip_with(polygon, F.concat(F.slice(polygon, 2, 1 << 20), F.slice(polygon, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def links_rewritten(pages: DataFrame, rules: DataFrame, content: str) -> DataFrame:
    """pages with the rules (seq, regex, url), a small catalogue of known size, applied to content in order."""
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("seq", "regex", "url"))).alias("__rules"))
    return pages.crossJoin(F.broadcast(listed)).withColumn(content, F.aggregate("__rules", F.col(content), lambda s, r: F.regexp_replace(s, r["regex"], r["url"]))).drop("__rules")


def with_detail(rows: DataFrame, details: DataFrame, keys: list[str], wanted: bool = True) -> DataFrame:
    """rows with the columns of their detail; without, if details aren't wanted."""
    return rows.join(details, keys, "left") if wanted else rows


def contributed(registry: dict, requested: list[tuple[str, str]]) -> dict[str, object]:
    """{context name: contributor} of (contributor, context name) pairs; "noop" gives nothing; unknown and repeated names are errors."""
    out: dict[str, object] = {}
    for contributor, name in requested:
        if contributor == "noop":
            continue
        if contributor not in registry:
            raise ValueError(f"unknown contributor {contributor}, known: {sorted(registry)}")
        if name in out:
            raise ValueError(f"context name {name} is taken")
        out[name] = registry[contributor]
    return out
