"""From stored pages to a table of unique headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from ..operators.dedup import dedup_headlines
from ..operators.links import (
    attach_source,
    frontier,
    page_facts,
    seed_urls,
    site_headlines,
    site_quota,
    top_up,
)


def collect(
    pages: DataFrame,
    sites: DataFrame,
    sections: DataFrame,
    target: int | None = None,
    max_pages: int | None = None,
    max_queue: int | None = None,
    max_article_links: int | None = None,
    max_home_links: int | None = None,
) -> DataFrame:
    """headline, url, source, category.

    ``pages`` has page_id, url, html; ``sites`` has source, base, category,
    source_rank; ``sections`` has source, base, position, section. The
    markup is read once: titles and links are written to the shared folder
    and all later steps read that narrow table. Everything stored is
    collected, unless bounds are given; ``fixed_values`` has those of a polite
    crawl. With a ``target`` every site has a quota, and the home pages are
    looked at only for what is missing.
    """
    facts = written(page_facts(pages), "facts")
    visited = frontier(facts, sites, seed_urls(sections), max_pages, max_queue)
    quota = None if target is None else site_quota(sites.count(), target)
    first = site_headlines(visited, facts, quota, max_article_links)
    order = [F.col("source_rank"), F.col("level"), F.col("kind"), F.col("url")]
    unique = dedup_headlines(attach_source(first, sites), order)
    collected = written(unique.select("headline", "url", "source", "category"), "collected")
    missing = None if target is None else target - collected.count()
    if missing is not None and missing <= 0:
        return collected
    return collected.unionByName(top_up(collected, facts, sites, missing, max_home_links))
