"""URL filtering by association rules, in DataFrame operations only.

FP-growth mines combinations of URL tokens from labelled pages; rules ``tokens -> bad`` are
kept by support, confidence and lift. A rule is filed under its rarest token, so matching is
one join of URL tokens with that inverted index and a test that the other tokens are there.
Fixed host and path rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: (verdict, rule); a rule is a host and a path that urls of the host or a subdomain begin with.
HOST_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.7, 1.2
BAD = "!bad"


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Host behind the first ``://``, A-Z lower-cased; empty for null or without ``://``."""
    return _lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host, its parent domains, path segments, query names.

    A url without ``://`` has none. Order and repeats within the url do not matter.
    """
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    scheme = _lower_ascii(F.regexp_extract(text, r"(?s)^(.*?)://", 1))
    parents = F.regexp_extract_all(F.concat(F.lit("."), host), F.lit(r"(?=\.([^.].*))"), 1)
    segments = F.regexp_extract_all(_lower_ascii(path), F.lit("([^/]+)"), 1)
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.regexp_extract_all(_lower_ascii(query), F.lit("(?:^|&)([^=&]+)"), 1)
    tag = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind + ":"), x))
    found = F.array_distinct(F.concat(F.array(F.concat(F.lit("scheme:"), scheme)), tag("host", parents), tag("path", segments), tag("query", names)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def mine_rules(
    labelled: DataFrame, url: str = "url", bad: str = "bad",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT,
) -> DataFrame:
    """(anchor, tokens, confidence, support, lift) of the rules from tokens to bad pages.

    ``bad`` is boolean; rows with a null there, and urls without tokens, teach nothing. Every
    labelled row counts, repeated rows too. The anchor is the rule's rarest token, of equally
    rare ones the first by name. Nothing labelled gives no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.select(url_tokens(F.col(url)).alias("t"), F.col(bad).alias("b")).where("b is not null and size(t) > 0")
    rows = materialize(rows.select(F.when(F.col("b"), F.array_append("t", BAD)).otherwise(F.col("t")).alias("items")))
    empty = "anchor string, tokens array<string>, confidence double, support double, lift double"
    if rows.isEmpty():
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(F.col("lift") >= min_lift)
    often = rows.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    keyed = (
        rules.withColumn("tokens", F.sort_array("antecedent")).withColumn("token", F.explode("tokens")).join(often, "token")
        .groupBy("tokens", "confidence", "support", "lift").agg(F.min(F.struct("c", "token")).alias("a"))
    )
    return materialize(keyed.select(F.col("a.token").alias("anchor"), "tokens", "confidence", "support", "lift"))


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Per different url that a rule fits: (url, confidence, tokens) of its strongest rule.

    Of equal confidences the rule first by its tokens counts.
    """
    tokens = urls.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("have", url_tokens(F.col("url")))
    hits = (
        tokens.withColumn("anchor", F.explode("have")).join(rules, "anchor")
        .where(F.size(F.array_except("tokens", "have")) == 0)
    )
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "tokens")).alias("r"))
    return best.select("url", (-F.col("r.c")).alias("confidence"), F.col("r.tokens").alias("tokens"))


def judge_urls(pages: DataFrame, rules: DataFrame, fixed: Sequence[tuple[str, str]] = HOST_RULES,
               key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence, tokens) per row of ``pages``.

    The longest fixed rule that fits decides; else a matching mined rule blocks, and all
    other pages are allowed, null and odd urls among them. Keys may be null or repeated.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    return (
        rows.join(match_rules(pages, rules, url), "url", "left")
        .withColumn("host", host).withColumn("path", path)
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("tokens").isNotNull(), "block"), F.lit("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "confidence", "tokens")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge_urls(pages, mine_rules(pages.join(labels, "page_id")))
