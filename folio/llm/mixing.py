"""Operator 10: mixing sources to target weights, in DataFrame expressions only.

Leaves are the (domain, language, source) groups. The token budget goes down the tree: at each node the children share
their parent's budget by their weights, but none gets more than its subtree can give (its tokens times MAX_EPOCHS), and
what one can't use goes to its siblings in proportion to their weights. So a shortage is made up by siblings first, and
by more distant relatives only if the siblings are used up. All amounts are integers, and budgets add up exactly.

A leaf with budget b and t tokens gives b div t full epochs and, of one more, the prefix whose tokens fit into the
rest. The order of an epoch is the md5 of seed, epoch and id. The prefix is found over 4096 ranges of that order: their
sums are added up for each leaf, in two steps, and only the range in which the budget ends is sorted. So no task holds a whole leaf,
however large, and the rows themselves are not shuffled.

Null domains, languages and sources are the group "unknown"; null texts and texts without words have no tokens, fit in
any prefix that reaches them, and are in no full epoch beyond those. Repeated rows count each. A leaf without tokens
gives its rows once if its parent's budget is not 0. Weights not named are DEFAULT_WEIGHT; weights of 0 get nothing
while a sibling has room. Empty tables give empty results. Columns of any name are kept, in the struct row of mixed()
and by repeated(). Children of one node are sorted in one task, on narrow rows, one for each child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import column, positional, scope, stored

SEED, MAX_EPOCHS, DEFAULT_WEIGHT = 17, 4, 10
#: Leaves up to which their table is broadcast (a few MB); beyond it Spark joins by its own means.
BROADCAST_LEAVES = 50_000
LEVELS = ("domain", "lang", "source")
#: Hex digits of the order that make the ranges.
RANGE_DIGITS = 3


def domain_of(source: Column) -> Column:
    """A stand-in for the domain that the tables don't have: four groups of sources by their last character."""
    return F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 4).cast("string"))


def words(text: Column) -> Column:
    """Tokens of a text: runs of characters other than spaces and the controls 9 to 13."""
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _known(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def _weight(level: Column, weights: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for k, v in sorted(weights.items()):
        out = F.when(level == k, F.lit(v).cast("long")).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_WEIGHT).cast("long"))


def _share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, cap, w, budget of the parent): adds got, the node's part of the budget."""
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.expr("IF(w > 0, cap / w, DOUBLE('Infinity'))"), name)
    at = nodes.withColumn("filled", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # In this order those that reach their capacity come first: the rest, shared by weight, would give them more than it.
    wide = "decimal(38,0)"
    at = at.withColumn("full", F.expr(f"(w > 0 AND CAST(cap AS {wide}) * open_w <= CAST(w AS {wide}) * (budget - filled)) OR (w = 0 AND cap <= budget - filled)"))
    at = at.withColumn("rest", F.greatest(F.lit(0), F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group))).withColumn("rest_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(group))
    at = at.withColumn("part", F.expr(f"CASE WHEN full THEN cap WHEN rest_w > 0 THEN CAST(CAST(w AS {wide}) * rest div rest_w AS BIGINT) ELSE 0 END"))
    over = F.col("rest") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("part"))).over(group)
    at = at.withColumn("over", over).withColumn("turn", F.row_number().over(group.orderBy(F.expr("IF(full OR w = 0, 1, 0)"), name)))
    got = F.col("part") + F.when(~F.col("full") & (F.col("w") > 0) & (F.col("turn") <= F.col("over")), 1).otherwise(0)
    return at.withColumn("got", got.cast("long")).drop("filled", "open_w", "full", "rest", "rest_w", "part", "over", "turn")


def leaf_budgets(tokens: DataFrame, weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int) -> DataFrame:
    """(levels, tokens, budget) of each leaf. tokens: (levels, n_tokens); weights: for each level the weights by name."""
    leaves = stored(tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs), "leaves")
    n, total = leaves.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if n <= BROADCAST_LEAVES:  # a table that one task holds needs no shuffles
        leaves = leaves.coalesce(1)
    at = leaves.withColumn("budget", F.floor(F.lit(total) * budget_share).cast("long"))
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[: i + 1])
        nodes = at.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget")).withColumn("w", _weight(F.col(level), weights.get(level, {})))
        got = _share_out(nodes, path[:-1], level).select(*path, F.col("got").alias("budget"))
        at = at.drop("budget").join(got, path)
    return at.select(*LEVELS, "tokens", "budget")


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _cuts(ranges: DataFrame, leaves: DataFrame, hint) -> DataFrame:
    """leaves (levels, epochs, rest) with cut, the range where the running sum of ranges (levels, range, n) first passes rest, and before, the sum of those before it.

    Found in two steps, first by all digits but one, so that few rows of a leaf are in one task. "~", which sorts behind
    all digits: none passes.
    """

    def step(cuts: DataFrame, start: int, stop: int) -> DataFrame:
        rows = ranges.join(hint(cuts), list(LEVELS)).where(F.left("range", F.lit(start)) == F.col("cut"))
        sums = rows.groupBy(*LEVELS, "epochs", "rest", "before", F.left("range", F.lit(stop)).alias("p")).agg(F.sum("n").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("p"))
        found = sums.withColumn("upto", upto).groupBy(*LEVELS, "epochs", "rest", "before").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("p"))).alias("p"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("upto"))
        return found.select(*LEVELS, "epochs", "rest", F.coalesce("p", F.lit("~")).alias("cut"), F.coalesce("upto", "before").cast("long").alias("before"))

    first = stored(step(leaves.withColumn("cut", F.lit("")).withColumn("before", F.lit(0).cast("long")), 0, RANGE_DIGITS - 1), "first")
    return first.where("cut = '~'").unionByName(step(first.where("cut <> '~'"), RANGE_DIGITS - 1, RANGE_DIGITS))


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies (how often the row is taken, 0 too) and row, a struct of docs' columns by position.

    weights: by level (LEVELS), then by name. domain: an expression over the columns of docs; a stand-in if none is given.
    """
    at = docs if domain is None else docs.withColumn("__folio_domain", domain)
    names, at = docs.columns, positional(at)
    of = lambda name: F.col(column(docs, name))
    source = _known(of(source_col))
    top = _known(F.col(f"c{len(names)}")) if domain is not None else domain_of(source)
    row = F.struct(*[f"c{i}" for i in range(len(names))])
    at = at.select(top.alias("domain"), _known(of(lang_col)).alias("lang"), source.alias("source"), words(of(text_col)).alias("n_tokens"), of(id_col).alias("doc_id"), row.alias("row"))
    with scope() as needed:
        # Counted once: a narrow table of a few dozen bytes a row, written to the shared folder.
        narrow = stored(at.select(*LEVELS, "doc_id", "n_tokens"), "mix")
        leaves = leaf_budgets(narrow, weights or {}, budget_share, max_epochs)
        plan = stored(leaves.withColumn("epochs", F.expr("IF(tokens > 0, budget div tokens, 0)")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
        few = plan.where("rest > 0 OR tokens = 0").select(*LEVELS, "epochs", "rest")
        hint = F.broadcast if plan.count() <= BROADCAST_LEAVES else lambda x: x
        order = _order(seed, F.col("epochs"), F.col("doc_id"))
        ranges = narrow.join(hint(few), list(LEVELS)).groupBy(*LEVELS, F.left(order, F.lit(RANGE_DIGITS)).alias("range")).agg(F.sum("n_tokens").alias("n"))
        ranges = stored(ranges, "ranges")
        cuts = stored(_cuts(ranges, few.select(*LEVELS, "epochs", "rest"), hint), "cuts")
        inside = narrow.join(hint(cuts), list(LEVELS)).withColumn("order", order).where(F.left("order", F.lit(RANGE_DIGITS)) == F.col("cut"))
        run = Window.partitionBy(*LEVELS).orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
        # Rows of one range of each leaf: the last order value that still fits. Rows with one id stand or fall together.
        last = inside.withColumn("sum", F.col("before") + F.sum("n_tokens").over(run)).where("sum <= rest").groupBy(*LEVELS).agg(F.max("order").alias("last"))
        ends = cuts.join(last, list(LEVELS), "left").select(*LEVELS, F.col("epochs").alias("next"), "cut", "last")
        rules = stored(plan.select(*LEVELS, F.col("epochs").alias("full")).join(ends, list(LEVELS), "left"), "rules")
        needed.append(rules)
    taken = at.join(hint(rules), list(LEVELS), "left")
    key = _order(seed, F.col("next"), F.col("doc_id"))
    extra = F.coalesce(F.left(key, F.lit(RANGE_DIGITS)) < F.col("cut"), F.lit(False)) | F.coalesce(key <= F.col("last"), F.lit(False))
    return taken.select("doc_id", *LEVELS, "n_tokens", (F.col("full") + F.when(extra, 1).otherwise(0)).cast("long").alias("copies"), "row")


def repeated(mix: DataFrame, names: list[str]) -> DataFrame:
    """The rows of mixed(), each as often as it is taken, with docs' columns, which were called names."""
    every = mix.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select(*[F.col("row")[f"c{i}"].alias(f"c{i}") for i in range(len(names))]).toDF(*names)
