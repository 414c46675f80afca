"""Reports: commits, test runs, metrics, site maps, feeds, grouped posts and version lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import ordering


def joined(df: DataFrame, group: list[str], value: Column, order: list[Column | str], separator: str, name: str) -> DataFrame:
    """(group, name): the values of each group in order, joined; groups are report-sized."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    item = F.struct(*[k.alias(f"o{i}") for i, k in enumerate(keys)], value.alias("v"))
    listed = df.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("x")) if group else df.agg(F.array_sort(F.collect_list(item)).alias("x"))
    return listed.select(*group, F.array_join(F.transform("x", lambda x: x["v"]), separator).alias(name))


def posts_by(df: DataFrame, attribute: Column, name: str) -> DataFrame:
    """One row for each value of a comma list."""
    return df.withColumn(name, F.explode(T.csv_values(attribute)))


def author_key(mail: Column, name: Column, by: str = "mail") -> Column:
    at = F.instr(mail, "@")
    key = F.when(at > 1, F.substring(mail, F.lit(1), at - 1)).otherwise(mail) if by == "mail" else F.lower(name)
    return F.coalesce(key, F.lit("unknown"))


def commits_by_author(commits: DataFrame, by: str = "mail") -> DataFrame:
    """(key, name, commits): groups with the name of their first commit; commits (seq, name, email)."""
    return commits.groupBy(author_key(F.col("email"), F.col("name"), by).alias("key")).agg(F.min_by("name", "seq").alias("name"), F.count("*").alias("commits"))


def commit_line(parts: list[str]) -> Column:
    """A line of a commit log from the names of its parts."""
    known = {"star": F.lit("* "), "sha": F.col("sha"), "short_sha": F.substring("sha", 1, 7), "space": F.lit(" "), "dash": F.lit(" - "), "date": F.date_format("ts", "yyyy-MM-dd"), "author": F.col("name"), "mail": F.col("email"), "message": F.col("message"), "first_line": F.substring_index("message", "\n", 1), "open": F.lit("("), "close": F.lit(")")}
    return F.concat(*[known[p] for p in parts])


def git_sections(commits: DataFrame, by: str = "mail") -> DataFrame:
    """(key, section): a heading "=== Name (#n)" for each author by key, and its commits, newest first."""
    groups = commits.withColumn("key", author_key(F.col("email"), F.col("name"), by))
    lines = joined(groups, ["key"], commit_line(["star", "short_sha", "space", "first_line"]), [-F.col("ts").cast("long"), "sha"], "\n", "lines")
    return commits_by_author(commits, by).join(lines, "key").select("key", F.concat(F.lit("=== "), "name", F.lit(" (#"), F.col("commits").cast("string"), F.lit(")\n\n"), "lines").alias("section"))


def git_report(commits: DataFrame, by: str = "mail") -> DataFrame:
    """The sections as one document, for the authors of a project; tables of sections are the normal output."""
    return joined(git_sections(commits, by), [], F.col("section"), ["key"], "\n\n", "document")


CUCUMBER = "uri string, keyword string, id string, name string, line int, description string, elements array<struct<keyword:string,id:string,name:string,line:int,type:string,start_timestamp:timestamp,steps:array<struct<keyword:string,name:string,line:int,result:struct<status:string,duration:bigint,error_message:string>>>>>"


def scenario_results(features: DataFrame) -> DataFrame:
    """(feature, scenario, status, nanos, start): the status is the last step's, "undefined" without one."""
    each = features.select(F.col("name").alias("feature"), F.explode("elements").alias("e"))
    status = F.lower(F.coalesce(F.when(F.size("e.steps") > 0, F.element_at("e.steps", -1)["result"]["status"]), F.lit("undefined")))
    return each.select("feature", F.col("e.name").alias("scenario"), status.alias("status"), F.aggregate(F.coalesce("e.steps", F.array().cast("array<struct<keyword:string,name:string,line:int,result:struct<status:string,duration:bigint,error_message:string>>>")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["result"]["duration"], F.lit(0))).alias("nanos"), F.col("e.start_timestamp").alias("start"))


def run_summary(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts, the share passed (0 to 1), the summed time and the first start."""
    g = results.groupBy(*group) if group else results.groupBy()
    passed = F.sum(F.when(F.col("status") == "passed", 1).otherwise(0))
    return g.agg(F.count("*").alias("executed"), passed.alias("passed"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"), (passed / F.greatest(F.count("*"), F.lit(1))).alias("passed_share"), F.sum("nanos").alias("nanos"), F.min("start").alias("first_start"))


def metrics_document(metrics: DataFrame, level: str = "== ", header: str = "", group: list[str] | None = None) -> DataFrame:
    """AsciiDoc, one text for each group or one of all, of metrics (name, help, type, values array of (pos, tags, value)): a value, or a table of tags and values."""
    number = lambda v: v.cast("string")
    tag = lambda e: F.concat(F.lit("! "), F.replace(F.replace(e["key"], F.lit("!"), F.lit("\\!")), F.lit("|"), F.lit("\\|")), F.lit(" ! "), e["value"])
    cell = lambda x: F.concat(F.lit("| "), F.when(F.size(x["tags"]) == 0, "-").otherwise(F.concat(F.lit('\n[stripes=none,cols="a,m"]\n!===\n'), F.array_join(F.transform(F.map_entries(x["tags"]), tag), "\n"), F.lit("\n!===\n"))), F.lit("| "), number(x["value"]))
    table = F.concat(F.lit('[cols="2a,6", options="header"]\n.'), "name", F.lit("\n|===\n| Tag(s) | Value\n"), F.array_join(F.transform("values", cell), "\n\n"), F.lit("\n|===\n"))
    first = F.get("values", F.lit(0))
    single = (F.size("values") == 1) & (F.size(first["tags"]) == 0)
    body = F.when(single, F.concat(F.lit("Value: `"), number(first["value"]), F.lit("`.\n\n"))).otherwise(table)
    text = F.concat(F.lit(level + " "), "name", F.lit("\n\n"), F.coalesce("help", F.lit("")), F.lit("\n\n"), body)
    return joined(metrics, group or [], text, ["name"], "\n", "document").select(*(group or []), F.concat(F.lit(header + "\n"), "document").alias("document"))


def sitemap(pages: DataFrame, title: str, path: str, lastmod: str, today: Column) -> DataFrame:
    """(title, path, lastmod) with '' and today for what is missing; write it in the order of title and path."""
    return pages.select(F.coalesce(title, F.lit("")).alias("title"), F.col(path).alias("path"), F.coalesce(lastmod, today).alias("lastmod"))


def rss_lines(posts: DataFrame, site: str, title: str) -> DataFrame:
    """(seq, line): the feed of posts (path, title, published, summary), newest first, without listing pages; write it in the order of seq."""
    file = F.substring_index("path", "/", -1)
    kept = posts.where(~F.startswith(file, F.lit("page-")) & (file != "index.html"))
    when = lambda c: F.date_format(c, "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item><title>"), T.xml_escape(F.col("title")), F.lit("</title><link>"), F.lit(site), "path", F.lit("</link><pubDate>"), when(F.col("published")), F.lit("</pubDate><description>"), T.xml_escape(F.coalesce("summary", F.lit(""))), F.lit("</description></item>"))
    items = ordering.numbered(kept, F.desc("published"), "path").select(F.col("rank").alias("seq"), item.alias("line"))
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>{title}</title><link>{site}</link><lastBuildDate>'), F.coalesce(when(F.col("last")), F.lit("")), F.lit("</lastBuildDate>"))
    ends = kept.agg(F.max("published").alias("last"), F.count("*").alias("n"))
    return items.unionByName(ends.select(F.lit(0).cast("long").alias("seq"), head.alias("line"))).unionByName(ends.select((F.col("n") + 1).alias("seq"), F.lit("</channel></rss>").alias("line")))


def rss(posts: DataFrame, site: str, title: str) -> DataFrame:
    """The feed as one text, for a site's posts; rss_lines() is the normal output."""
    return joined(rss_lines(posts, site, title), [], F.col("line"), ["seq"], "\n", "value")


def by_kind(properties: DataFrame, parent: str, name: str, kind: str) -> DataFrame:
    """(parent, primitives, objects, arrays): sorted names of each kind of a JSON schema's properties."""
    part = lambda test: F.array_sort(F.collect_list(F.when(test, F.col(name))))
    k = F.col(kind)
    return properties.groupBy(parent).agg(part(~k.isin("object", "array")).alias("primitives"), part(k == "object").alias("objects"), part(k == "array").alias("arrays"))


def versions_by_tool(versions: DataFrame, key: Column) -> DataFrame:
    """(tool, versions): the distinct versions of each tool, newest first, joined."""
    once = versions.select("tool", "version", key.alias("k")).dropDuplicates(["tool", "version"])
    order = F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("k")))
    return joined(once.withColumn("o", order), ["tool"], F.col("version"), ["o"], ", ", "versions")


def running_number(nodes: DataFrame, group: str, *order: Column | str) -> DataFrame:
    return nodes.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
