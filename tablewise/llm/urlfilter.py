"""URL filters (operator 3): host rules, else a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

Host, path, rules, features and scores are DataFrame expressions and Spark ML;
nothing is collected but the class counts of the training table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) plus rule and rule_verdict, null where no rule fits.

    ``rules``: pattern (host, then the path from its first ``/``) and verdict.
    A rule fits its host and all subdomains when the path starts with its own;
    the longest pattern wins, of equals the smaller verdict. Each distinct
    (host, path) is looked up once, by its host suffixes, so a common host
    costs one row a suffix; Spark splits or broadcasts by measured size.
    """
    r = rules.select(F.lower(F.substring_index("pattern", "/", 1)).alias("r_host"), F.col("pattern").alias("rule"), F.col("verdict").alias("rule_verdict"))
    r = r.withColumn("r_path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
    seen = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = seen.withColumn("r_host", F.explode(F.array_distinct(suffixes))).join(r, "r_host").where("startswith(path, r_path)")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*[urls[c] for c in urls.columns], "best.rule", "best.rule_verdict")


def grams(value: Column, tag: str, low: int, high: int) -> Column:
    """Tagged character n-grams of ``^value$``."""
    v = F.concat(F.lit("^"), value, F.lit("$"))
    parts = [F.when(F.length(v) >= n, F.transform(F.sequence(F.lit(1), F.length(v) - n + 1), lambda i, n=n: F.concat(F.lit(tag), F.substring(v, i, F.lit(n)))))
             .otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*parts)


def features(urls: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    return urls.withColumn("grams", F.concat(grams(F.col("host"), "h:", low, high), grams(F.col("path"), "p:", low, high)))


def fit(labelled: DataFrame, fit_rows: int = 20_000, buckets: int = 1 << 16, seed: int = 0):
    """Fit on (host, path, blocked 0/1): the ``fit_rows`` distinct rows of lowest hash.

    A table with one class gives that class (a float) as its model, an empty
    table 0.0 (allow).
    """
    small = labelled.select("host", "path", F.col("blocked").cast("double").alias("label")).distinct()
    small = save(small.orderBy(F.xxhash64("host", "path", F.lit(seed)), "label").limit(fit_rows), "url-train")
    n, blocked = small.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0.0, float(n)):
        return 1.0 if n and blocked else 0.0
    steps = Pipeline(stages=[HashingTF(numFeatures=buckets, inputCol="grams", outputCol="features", binary=True),
                             LogisticRegression(regParam=1e-3, maxIter=50)])
    return steps.fit(features(small))


def score(urls: DataFrame, model) -> DataFrame:
    """``urls`` plus p_block, from a model of ``fit``."""
    if isinstance(model, float):
        return urls.withColumn("p_block", F.lit(model))
    out = model.transform(features(urls))
    return out.select(*[F.col(f"`{c}`") for c in urls.columns], vector_to_array("probability")[1].alias("p_block"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", labelled: DataFrame | None = None,
          threshold: float = 0.5, fit_rows: int = 20_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, p_block.

    Where a rule fits, its verdict holds; else ``block`` if the model's
    probability reaches ``threshold``. Without a ``labelled`` table (host,
    path, blocked) the model learns from urls that rules decide. Null urls and
    urls without ``://`` have empty host and path and are scored like others.
    Repeated pages are judged alike; other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    matched = save(match_rules(rows, rules), "url-matched")
    if labelled is None:
        labelled = matched.where("rule is not null").select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked"))
    scored = score(matched, fit(labelled, fit_rows))
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
