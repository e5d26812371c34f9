"""Pages, links and the bounded walk over stored pages.

A page table takes the place of fetching: a link is followed by joining it
with the stored page of that address. All rows of a site are never put in
one group unless bounds are asked for; those are rank limits that also run
before the shuffle. Without them everything stored is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import MIN_PER_SITE
from ..functions.html import headline_of, hrefs_of, visible
from ..functions.text import digest, norm_key
from ..functions.urls import canonical_url, is_article_link, resolve_url, site_links
from ..lineage import removed, scratch_path, written
from .dedup import dedup_headlines, keep_first, not_collected
from .layout import ByKey


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, title, hrefs: one pass over the markup; the first page of an address wins."""
    parsed = pages.select("page_id", canonical_url("url").alias("url"), visible("html").alias("_m"))
    facts = parsed.select(
        "page_id", "url", headline_of(F.col("_m")).alias("title"), hrefs_of(F.col("_m")).alias("hrefs")
    )
    return keep_first(written(facts, "parsed"), [F.col("url")], [F.col("page_id")])


def page_headlines(pages: DataFrame) -> DataFrame:
    """page_id, url, headline of the pages that have a title."""
    parsed = pages.select("page_id", "url", visible("html").alias("_m"))
    titled = parsed.select("page_id", "url", headline_of(F.col("_m")).alias("headline"))
    return titled.filter(F.col("headline") != "")


def page_links(pages: DataFrame, mode: str = "suffix") -> DataFrame:
    """page_id, link: distinct canonical links of each page that stay on the site of ``base``."""
    parsed = pages.select("page_id", "base", visible("html").alias("_m"))
    raw = parsed.select("page_id", "base", hrefs_of(F.col("_m")).alias("_h"))
    return raw.select("page_id", F.explode(site_links("base", F.col("_h"), mode)).alias("link"))


def seed_urls(sections: DataFrame) -> DataFrame:
    """source, position, url from (source, base, position, section) rows."""
    return sections.select("source", "position", resolve_url("base", "section").alias("url"))


def site_quota(n_sites: int, target: int) -> int:
    """Headlines wanted from each site for ``target`` in all."""
    return max(MIN_PER_SITE, int(target / max(1, n_sites) + 0.5))


def _first(df: DataFrame, by: list[str], order: list, n: int | None) -> DataFrame:
    """First ``n`` rows of each group, all if None; each task cuts to ``n`` before the shuffle."""
    if n is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def frontier(
    facts: DataFrame,
    sites: DataFrame,
    seeds: DataFrame,
    max_pages: int | None = None,
    max_queue: int | None = None,
    mode: str = "suffix",
) -> DataFrame:
    """Breadth-first walk from the seeds: source, base, url, level, title, links.

    All stored pages that links reach, or at most ``max_pages`` of a site, in
    order of level, then seed position or url; ``max_queue`` bounds the links a
    site follows from one level. Pages are laid out by url once: a level moves its links,
    never the pages, and where it has few links it reads only their buckets. Every level
    is written to the shared folder, which cuts lineage and gives the next join true sizes.
    """
    spark = facts.sparkSession
    path = scratch_path(spark, "frontier")
    links = F.sort_array(site_links("base", F.col("hrefs"), mode))
    schema = "source string, base string, url string, title string, links array<string>, level int"

    def save(found: DataFrame, level: int) -> None:
        out = found.withColumn("links", links)
        out.select("source", "base", "url", "title", "links").write.parquet(f"{path}/level={level}")

    start = (
        seeds.groupBy("source", canonical_url("url").alias("url"))
        .agg(F.min("position").alias("_position"))
        .join(sites.select("source", "base"), "source")
    )
    with ByKey(facts.select("url", "title", "hrefs"), "url") as pages:
        start = pages.joined(written(start, "seeds"))
        save(_first(start, ["source"], ["_position", "url"], max_pages), 0)
        level = 0
        while True:
            visited = spark.read.schema(schema).parquet(path)
            last = visited.filter(F.col("level") == level)
            if last.isEmpty():
                return visited
            level += 1
            queue = (
                last.select("source", "base", F.explode("links").alias("url"))
                .distinct()
                .join(visited.select("source", "url"), ["source", "url"], "left_anti")
            )
            queued = scratch_path(spark, "queue")
            _first(queue, ["source"], ["url"], max_queue).write.parquet(queued)
            found = pages.joined(spark.read.schema(queue.schema).parquet(queued))
            if max_pages is not None:
                used = visited.groupBy("source").agg(F.count("*").alias("_used"))
                rank = F.row_number().over(Window.partitionBy("source").orderBy("url"))
                found = found.withColumn("_rank", rank).filter(F.col("_rank") <= max_pages)
                found = found.join(used, "source").filter(F.col("_rank") + F.col("_used") <= max_pages)
            save(found, level)
            removed(spark, queued)


def site_headlines(
    visited: DataFrame, facts: DataFrame, quota: int | None = None, max_links: int | None = None
) -> DataFrame:
    """source, level, kind, url, headline: titles of visited pages (kind 0) and of the
    articles they link to (kind 1), each title once per site.

    With ``max_links`` only the first links of each page that were not
    visited up to its level count, in url order; with ``quota`` only so many
    titles of a site, in order of level, kind and url.
    """
    own = visited.select(
        "source", "level", F.lit(0).alias("kind"), "url", F.col("title").alias("headline")
    )
    links = visited.select(
        "source", "level", F.col("url").alias("_from"), F.explode("links").alias("url")
    )
    seen = visited.select(
        F.col("source").alias("_s"), F.col("url").alias("_u"), F.col("level").alias("_l")
    )
    unseen = links.join(
        seen,
        (F.col("source") == F.col("_s")) & (F.col("url") == F.col("_u")) & (F.col("_l") <= F.col("level")),
        "left_anti",
    )
    wanted = _first(unseen, ["source", "_from"], ["url"], max_links).filter(is_article_link("url"))
    wanted = wanted.groupBy("source", "url").agg(F.min("level").alias("level"))
    articles = written(wanted, "wanted").join(facts.select("url", "title"), "url").select(
        "source", "level", F.lit(1).alias("kind"), "url", F.col("title").alias("headline")
    )
    found = own.unionByName(articles).filter(F.col("headline") != "")
    order = [F.col("level"), F.col("kind"), F.col("url")]
    once = dedup_headlines(found, order, within=["source"])
    return _first(once, ["source"], ["level", "kind", "url"], quota)


def attach_source(headlines: DataFrame, sites: DataFrame) -> DataFrame:
    """Add category and source_rank of the site."""
    return headlines.join(sites.select("source", "category", "source_rank"), "source")


def top_up(
    collected: DataFrame,
    facts: DataFrame,
    sites: DataFrame,
    needed: int | None = None,
    max_links: int | None = None,
    mode: str = "suffix",
) -> DataFrame:
    """New headlines from articles linked on the home pages of the sites.

    headline, url, source, category. ``needed`` bounds how many, in order of
    source_rank, then url; ``max_links`` how many links of a home page count.
    """
    own = site_links("base", F.col("hrefs"), mode)
    home = sites.withColumn("url", canonical_url("base")).join(facts.select("url", "hrefs"), "url")
    links = home.select(
        "source", "source_rank", "category",
        F.explode(own if max_links is None else F.slice(F.sort_array(own), 1, max_links)).alias("url"),
    )
    titles = facts.select("url", F.col("title").alias("headline"))
    found = written(links, "links").join(titles, "url").filter(F.col("headline") != "")
    once = dedup_headlines(found, [F.col("source_rank"), F.col("url")])
    fresh = not_collected(once, collected)
    if needed is not None:
        fresh = fresh.orderBy("source_rank", "url").limit(max(0, needed))
    return fresh.select("headline", "url", "source", "category")


def source_counts(df: DataFrame) -> DataFrame:
    """source, n_rows, n_titles: rows and distinct titles per source."""
    return df.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(digest(norm_key("headline"))).alias("n_titles"),
    )


def title_total(df: DataFrame) -> DataFrame:
    """n_rows, n_titles: rows and distinct titles of all sources together."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(digest(norm_key("headline"))).alias("n_titles"),
    )
