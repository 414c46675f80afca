"""A site from markup pages: rendered pages, search index, chunks, feed, map and list for language models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import asciidoc
from folio.functions import text as T
from folio.operators import filters, index, ordering, reports, retrieval
from folio.sources import files


@dataclass
class Site:
    pages: DataFrame
    index: index.Index
    chunks: DataFrame
    sitemap: DataFrame
    feed: DataFrame
    llms: DataFrame
    blog: DataFrame


def built(sources: DataFrame, now: Column, path: str = "path", text: str = "text", site: str = "https://example.org", title: str = "Site", page_size: int = 10) -> Site:
    """sources: (path, text) of *.adoc files. Pages with the attribute "skip" and posts of the future are left out."""
    head = files.markup_pages(sources, path, text).where(~filters.skip_attribute(F.col("attributes"))).withColumnRenamed("path", "source")
    day = F.element_at("attributes", "published-date")
    head = head.withColumn("published", T.published(day, now)).withColumn("post", F.startswith("source", F.lit("blog/")))
    head = head.where(~F.col("post") | filters.visible(F.col("published"), now + F.expr("INTERVAL 1 MICROSECOND")))
    body = asciidoc.html(F.col(text))
    pages = sources.select(F.col(path).alias("source"), F.col(text)).join(head, "source")
    pages = pages.select("source", F.concat(F.lit("/"), "output").alias("url"), "title", "attributes", "published", "post", F.concat(F.lit("<html><head><title>"), T.xml_escape(F.coalesce("title", F.lit(""))), F.lit('</title></head><body><div class="page-content-body">'), body, F.lit("</div></body></html>")).alias("html"))
    found = index.build(pages.where(~filters.listing_page(F.col("url"))).select("url", "html"))
    fields = index.fields_of(pages, ".page-content-body", "content")
    posts = pages.where("post").select(F.col("url").alias("path"), F.coalesce("title", F.lit("")).alias("title"), "published", F.element_at("attributes", "description").alias("summary"))
    ranked = ordering.numbered(posts, F.desc("published"), "path")
    return Site(
        pages, found, retrieval.chunks(fields, F.col("title"), F.coalesce("body", F.lit("")), F.col("url")),
        reports.sitemap(pages.withColumn("m", F.try_to_date(F.element_at("attributes", "lastmod"))), "title", "url", "m", now.cast("date")),
        reports.rss(posts, site, title), reports.joined(pages, [], F.col("url"), ["url"], "\n", "value"),
        ordering.paged(ordering.neighbours(ranked, "path"), page_size, posts.count()),
    )
