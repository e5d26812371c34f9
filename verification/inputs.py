"""Job inputs derived from the given tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions.html import extract_links
from framewise.functions.urls import authority
from framewise.functions.scores import known_words, lexical_scores
from framewise.sources.tables import read_pages

FIVE = ["Left", "Left-Center", "Center", "Center-Right", "Right"]
RAW_CATEGORIES = ["Left", " Left-Center\t", "Center", "Center-Right ", "Right", "Unknown", None, "left"]
TOPICS = [
    "",
    "Hyderabad weather forecast for tomorrow",
    "Opposition criticizes govt on farm laws",
    "Modi to launch metro rail",
    "Supreme Court hears plea",
    "By-election results",
    "The ruling party supports the government policies",
    "anti-national remark",
    "Article 370 verdict",
    "cold  wave grips north",
    "Cold wave grips north",
    "Political news report without opinion or bias",
    "citizenship and social justice, minority rights",
    "Lok Sabha vote demands accountability from people in power",
    "चुनाव परिणाम",
    "CBI on corruption of the establishment",
]


def prepared(spark: SparkSession) -> None:
    """Where no shared folder is named, use one under the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not (named or spark.conf.get("spark.checkpoint.dir", None)):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.conf.set("spark.checkpoint.dir", f"{warehouse}/framewise-scratch")


def odd_text(text: Column, number: Column) -> Column:
    """``text``; in some rows null, blank, or with an address in it."""
    return (
        F.when(number % 50 == 7, F.lit(None))
        .when(number % 50 == 8, F.lit("  \t"))
        .when(number % 50 == 9, F.concat(text, F.lit(" see HTTP://example.org/a?b=c now")))
        .otherwise(text)
    )


def odd_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with some repeated and some ids null."""
    number = F.col("headline_id")
    both = rows.unionByName(rows.filter(number % 40 == 0))
    return both.withColumn("headline_id", F.when(number % 41 != 0, number))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def headlines(spark: SparkSession, sf: str, topics: bool = True) -> DataFrame:
    """headline_id, headline, url, source, category, source_rank from documents.

    The headline is the whole text, followed by a topic where both gates
    and the hypotheses should have something to find; see ``odd_text``.
    """
    d = table(spark, sf, "documents")
    rank = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    topic = pick(TOPICS, F.col("doc_id") % len(TOPICS))
    body = odd_text(F.col("text"), F.col("doc_id"))
    text = F.concat(body, F.lit(" "), topic) if topics else body
    return d.select(
        F.col("doc_id").alias("headline_id"),
        text.alias("headline"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"),
        "source",
        pick(FIVE, rank % 5).alias("category"),
        rank.alias("source_rank"),
    )


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def varied_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages, some with a shared title, some without a title, some with an empty one."""
    n, html = F.col("page_id"), F.col("html")
    no_title = F.regexp_replace(html, "(?is)<title\\b[^<>]*>.*?</title>", "")
    shared = F.concat(F.lit('<meta property="og:title" content="Shared &amp; &rarr; '), n, F.lit(' &eacute;">'))
    heading = F.concat(F.lit("<h1 class=top> Heading <b>"), n, F.lit("</b>&nbsp;</h1>"))
    return pages(spark, sf).withColumn(
        "html",
        F.when(n % 7 == 1, F.concat(shared, html))
        .when(n % 7 == 2, F.concat(heading, no_title))
        .when(n % 7 == 3, F.concat(F.lit('<meta property="og:title" content="">'), html))
        .when(n % 7 == 4, F.concat(F.lit("<title> </title>"), no_title, heading))
        .when(n % 7 == 5, F.regexp_replace(no_title, "(?is)<h1\\b[^<>]*>.*?</h1>", ""))
        .otherwise(html),
    )


ANCHORS = [
    "mailto:a@b.c", "javascript:void(0)", "//{host}/two", "https://other.example.invalid/z",
    "https://evil{host}/suffix?x=1", "rel/path/", "../up", "./here", "?q=1", "#part", "/video/1", "/a/./b/../c",
]


def based_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with more kinds of links than they have, and the site they belong to."""
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    links = "".join(f"<a class='x' href='{a}'>x</a>" for a in ANCHORS)
    more = F.replace(F.lit(links), F.lit("{host}"), authority("url"))
    return pages(spark, sf).withColumn("base", origin).withColumn("html", F.concat("html", more))


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, url, html: the given pages and, for each of their links, stored pages to follow.

    A link ``/w`` leads to ``/w``, which links to ``/x/w`` and to ``/video/w``, a path that no
    article has; ``/x/w`` links to ``/x/x/w``. The home page of a host links to ``/top/w``.
    """
    p = pages(spark, sf).select(
        "page_id",
        F.regexp_replace("url", "^http:", "https:").alias("url"),
        "html",
        authority("url").alias("host"),
        F.array_distinct(extract_links("html")).alias("hrefs"),
    )
    given = p.select((F.col("page_id") * 10).alias("page_id"), "url", "html")
    site = F.concat(F.lit("https://"), "host")

    def anchors(prefix: str) -> F.Column:
        return F.array_join(
            F.transform("hrefs", lambda h: F.concat(F.lit(f'<a href="{prefix}'), h, F.lit('">'))), ""
        )

    def stored(n: int, prefix: str, before: str, after: str, links: F.Column) -> DataFrame:
        word = F.substring("href", 2, 1 << 30)
        title = F.concat(F.lit(f"<title>{before}"), word, F.lit(f"{after}</title>"))
        return p.select(
            (F.col("page_id") * 10 + n).alias("page_id"), "host", "hrefs", F.explode("hrefs").alias("href")
        ).select(
            "page_id",
            F.concat(site, F.lit(prefix), "href").alias("url"),
            F.concat(title, links).alias("html"),
        )

    home = p.select(
        (F.col("page_id") * 10 + 5).alias("page_id"),
        F.concat(site, F.lit("/")).alias("url"),
        F.concat(F.lit("<title>Home "), "host", F.lit("</title>"), anchors("/top")).alias("html"),
    )
    return (
        given.unionByName(stored(1, "", "Story ", "", F.concat(anchors("/x"), anchors("/video"))))
        .unionByName(stored(2, "/x", " STORY ", " ", anchors("/x/x")))
        .unionByName(stored(3, "/x/x", "Report ", "", anchors("/x/x/x")))
        .unionByName(stored(4, "/top", "Top ", "", F.lit("")))
        .unionByName(stored(6, "/video", "Clip ", "", F.lit("")))
        .unionByName(home)
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """source, base, category, source_rank: the hosts of the given pages."""
    return (
        table(spark, sf, "pages")
        .groupBy(authority("url").alias("source"))
        .agg(F.min("page_id").alias("source_rank"))
        .select(
            "source",
            F.concat(F.lit("https://"), "source").alias("base"),
            pick(FIVE, F.col("source_rank") % 5).alias("category"),
            "source_rank",
        )
    )


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """source, base, position, section: the paths of all pages of each host."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    place = F.row_number().over(W.partitionBy("source").orderBy("page_id")) - 1
    return (
        table(spark, sf, "pages")
        .select("page_id", authority("url").alias("source"), path.alias("section"))
        .select("source", F.concat(F.lit("https://"), "source").alias("base"), place.alias("position"), "section")
    )


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """headline_id, hypothesis, score: the lexical scores, as rows an outside scorer would leave."""
    from framewise.fixed_values import HYPOTHESES

    words = headlines(spark, sf).select("headline_id", known_words("headline").alias("_words"))
    names = F.array(*[F.lit(h) for _, h in HYPOTHESES])
    scored = words.select("headline_id", lexical_scores(F.col("_words")).alias("_s"), names.alias("_h"))
    return scored.select("headline_id", F.inline(F.arrays_zip("_h", "_s")).alias("hypothesis", "score"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """headline_id, logits: three sums over the whole of each embedding."""

    def third(k: int) -> Column:
        own = F.filter("embedding", lambda x, i: i % 3 == k)
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double"))

    rows = table(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("headline_id"), F.array(*[third(k) for k in range(3)]).alias("logits"))
