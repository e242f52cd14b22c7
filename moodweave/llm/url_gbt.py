"""URL filtering: host and path rules, then gradient-boosted trees on lexical features.

A rule names a host and a path prefix; it fits the host and its subdomains
when the url's path starts with the prefix, and the longest fitting rule wins.
Urls without a rule are judged by a gradient-boosted tree classifier trained
from labelled urls: lengths, path depth, digit and hyphen shares, character
entropy, parameter counts, and the block shares of the host's last label and
of its second-to-last label among the training urls.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled urls per
class, in order of a hash of the url.  Every url is judged.

Defined results: null urls and urls without '://' have an empty host and path,
fit no rule and are allowed; rows with equal urls get equal verdicts; extra
columns are ignored; with labels of one class or none every url without a rule
is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Host words of unwanted sites, which label training urls.
UNWANTED = ("spam", "pills", "casino", "bets", "ads", "adult", "poker", "porn", "viagra", "loans")

FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digit_share", "hyphens",
            "entropy", "parameters", "query_length", "last_label_share", "domain_share")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def entropy(s: Column) -> Column:
    """Bits per character of a string."""
    n = F.length(s)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")), F.lit(0.0),
                       lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


class Model(NamedTuple):
    trees: GBTClassificationModel | None
    shares: dict            # block share by host ending, of the training urls
    prior: float


def _endings(host: Column) -> tuple[Column, Column]:
    parts = F.split(host, r"\.")
    return F.element_at(parts, -1), F.concat(F.lit("."), F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(""))


def features(df: DataFrame, shares: dict, prior: float) -> DataFrame:
    """Add the lexical features of columns ``url``, ``host`` and ``path``."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    last, domain = _endings(host)
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in shares]), F.array(*[F.lit(v) for v in shares.values()])) \
        if shares else F.map_from_arrays(F.array(F.lit("")), F.array(F.lit(prior)))
    share = lambda key: F.coalesce(F.try_element_at(known, key), F.lit(prior))
    count = lambda s, pattern: F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0))).cast("double")
    return df.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "labels": count(host, r"[^.]+"),
        "depth": count(path, r"/[^/]+"), "digit_share": count(url, r"[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "hyphens": count(host, "-"), "entropy": entropy(host), "parameters": count(query, r"[^&]+"),
        "query_length": F.length(query).cast("double"), "last_label_share": share(last), "domain_share": share(domain)})


def weak_labels(urls: DataFrame) -> DataFrame:
    """(url, label): 1 where a label of the host holds an unwanted word as a hyphen-separated part."""
    host = host_of(F.col("url"))
    parts = F.split(host, r"[.\-]")
    return urls.where(F.col("url").isNotNull() & (host != "")).select(
        "url", F.arrays_overlap(parts, F.array(*[F.lit(w) for w in UNWANTED])).cast("int").alias("label"))


def train(labelled: DataFrame, sample: int = SAMPLE, rounds: int = 10, depth: int = 3, seed: int = 7) -> Model:
    """Fit on at most ``sample`` distinct urls per class of (url, label)."""
    rows = labelled.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("double").alias("label")).distinct()
    pick = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(sample)
    data = pick(0).unionByName(pick(1)).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    data = data.coalesce(2).checkpoint()
    size = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Model(None, {}, 0.0)
    prior = size[1.0] / (size[0.0] + size[1.0])
    last, domain = _endings(F.col("host"))
    ends = data.select("label", F.explode(F.array(last, domain)).alias("ending")).groupBy("ending") \
        .agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    # shrunk towards the prior; at most 2 * sample / 20 endings per class
    shares = {r["ending"]: (r["b"] + 10 * prior) / (r["n"] + 10) for r in ends.orderBy("ending").collect()}
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="lexical")
    ready = gather.transform(features(data, shares, prior)).select("lexical", "label").checkpoint()
    trees = GBTClassifier(featuresCol="lexical", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed).fit(ready)
    return Model(trees, shares, prior)


def judge(pages: DataFrame, model: Model, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")) \
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}) \
        .withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    if model.trees is None:
        scored = rows.withColumn("block_score", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array

        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="lexical")
        out = model.trees.transform(gather.transform(features(rows, model.shares, model.prior)))
        scored = out.withColumn("block_score", vector_to_array("probability")[1])
    guess = F.when((F.col("block_score") >= 0.5) & (F.col("host") != ""), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
                         F.coalesce(F.col("by_rule.verdict"), guess).alias("verdict"), "block_score")
