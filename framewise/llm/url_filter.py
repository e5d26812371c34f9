"""URL filtering: rules first, boosted trees on lexical features for what no rule names.

The trees learn from URLs whose verdict is known, here those that a rule names.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: host, path, verdict: a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: At most about so many labelled URLs are fitted, chosen by a hash of the URL.
FIT_ROWS = 50_000
TREES, DEPTH, SEED = 12, 3, 7
FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio",
    "entropy", "parameters", "hyphens", "longest_label", "has_fragment", "is_https",
    "suffix_block_rate", "suffix_share",
]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: str) -> tuple[Column, Column]:
    """Host and path: empty where the URL is null or has no ``://``.

    The host goes from there to the first ``/``, ``?``, ``#`` or the end, A-Z
    in lower case; the path from there to ``?``, ``#`` or the end.
    """
    given = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(given, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(given, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together) that fits, as struct(rule, verdict); null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(c: Column, what: str) -> Column:
    return F.regexp_count(c, F.lit(what)).cast("double")


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path and more) with the lexical features and the host's suffix."""
    url, n = F.coalesce(F.col("url"), F.lit("")), F.char_length(F.coalesce(F.col("url"), F.lit("")))
    rows = rows.withColumns({"_chars": F.array_sort(F.split(F.substring_index(url, "://", -1), "")), "_labels": F.split("host", "\\.")})
    # runs in the sorted characters give the counts of each
    runs = F.aggregate(
        "_chars",
        F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("s")),
        lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["k"] + 1).alias("k"), a["s"].alias("s"))).otherwise(
            F.struct(c.alias("c"), F.lit(1).alias("k"), (a["s"] + F.when(a["k"] > 0, a["k"] * F.log2(a["k"].cast("double"))).otherwise(0.0)).alias("s"))
        ),
        lambda a: a["s"] + F.when(a["k"] > 0, a["k"] * F.log2(a["k"].cast("double"))).otherwise(0.0),
    )
    size = F.greatest(F.size("_chars"), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return rows.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "query_length": F.char_length(query).cast("double"),
            "depth": _count(F.col("path"), "/[^/]"),
            "labels": F.size("_labels").cast("double"),
            "digit_ratio": _count(url, "[0-9]") / F.greatest(n, F.lit(1)),
            "entropy": F.log2(size) - runs / size,
            "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0.0),
            "hyphens": _count(F.col("host"), "-"),
            "longest_label": F.array_max(F.transform("_labels", lambda x: F.char_length(x))).cast("double"),
            "has_fragment": url.contains("#").cast("double"),
            "is_https": _ascii_lower(url).startswith("https://").cast("double"),
            "suffix": _suffix("host"),
        }
    ).drop("_chars", "_labels")


def _with_suffix(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    known = rows.join(suffixes, "suffix", "left")
    return known.fillna({"suffix_block_rate": 0.5, "suffix_share": 0.0})


def _suffix(host: str) -> Column:
    return F.element_at(F.split(host, "\\."), -1)


def suffix_table(rows: DataFrame) -> DataFrame:
    """suffix, suffix_share, suffix_block_rate over all ``rows`` (host, _rule): a stored table.

    The share is of all rows, the rate of those that a rule names, drawn towards a half.
    """
    blocked = F.count_if(F.col("_rule.verdict") == "block")
    table = rows.groupBy(_suffix("host").alias("suffix")).agg(
        F.count("*").alias("n"), ((blocked + 1) / (F.count("_rule") + 2)).alias("suffix_block_rate")
    )
    table = stored(table, "suffix-counts")
    total = table.agg(F.sum("n")).first()[0]
    return table.select("suffix", (F.col("n") / total).alias("suffix_share"), "suffix_block_rate")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, most: int = FIT_ROWS, id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score: one row per row of ``pages``.

    The verdict is the longest fitting rule's. Other URLs are blocked where
    the trees give blocking 0.5 or more; if all known verdicts are alike, that is
    the verdict, and if none is known, allow. Null URLs have empty host and
    path and are judged like any. Ids are only handed on; repeated rows are judged alike.
    URLs are read whole, however long. The trees are fitted on at most about ``most`` different
    URLs that a rule names, weighted by their rows; counts per suffix cover all pages. Other columns are not
    read, whatever their names. An empty table gives an empty table.
    """
    host, path = url_parts(url)
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    known = rows.filter("_rule is not null").select(
        "url", "host", "path", (F.col("_rule.verdict") == "block").cast("double").alias("label")
    )
    # each different URL once, with the number of its rows as its weight
    known = stored(known.groupBy("url", "host", "path", "label").agg(F.count("*").cast("double").alias("weight")), "known-urls")
    n = known.groupBy("label").count().collect()  # two rows
    plain = [F.col(c) for c in ("page_id", "host", "path")] + [F.col("_rule.rule").alias("rule")]
    if len(n) < 2:
        only = "block" if n and n[0]["label"] == 1 else "allow"
        score = F.lit(1.0 if only == "block" else 0.0)
        return rows.select(*plain, F.coalesce("_rule.verdict", F.lit(only)).alias("verdict"), score.alias("block_score"))
    share = int((1 << 30) * min(1.0, most / sum(r["count"] for r in n)))
    fit = known.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < share)
    fit = stored(with_features(fit).drop("host", "path", "url"), "labelled-urls")
    suffixes = suffix_table(rows)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, subsamplingRate=1.0)
    data = assemble.transform(_with_suffix(fit, suffixes)).select("features", "label", "weight")
    # a few ten thousand rows: as many tasks as cores work on them, not one for each tiny file
    model = PipelineModel([assemble, trees.fit(data.coalesce(pages.sparkSession.sparkContext.defaultParallelism))])
    judged = model.transform(_with_suffix(with_features(rows), suffixes))
    block = vector_to_array("probability")[1]
    verdict = F.coalesce("_rule.verdict", F.when(block >= 0.5, "block").otherwise("allow"))
    return judged.select(*plain, verdict.alias("verdict"), block.alias("block_score"))
