"""URL rules found through their rarest literal token.

Every rule is compiled to a regular expression and filed under one token that any url it fits must contain: of its
literal tokens, the one that occurs least in the urls at hand. The tokens of a url fetch the rules filed under them,
and only those rules' expressions run. Everything is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflux.llm.common import ascii_lower

#: The rule list is broadcast up to so many rules; a longer one is joined by a shuffle on the token.
BROADCAST_RULES = 100_000

_TOKEN = "[A-Za-z0-9]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def compile_rule(host: str, path: str) -> str:
    """An expression over host followed by path: the host and its subdomains (an empty one: all), the path from its start."""
    literal = lambda s: re.sub(r"([^A-Za-z0-9])", r"\\\1", s) if s.isascii() else "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    tail = literal(path) if path else r"(?=/|\z)"
    return rf"^(?:[^/]*\.)?{literal(host)}{tail}" if host else rf"^[^/]*{tail}"


def literal_tokens(host: str, path: str) -> list[str]:
    """Tokens that stand whole in every url the rule fits; the last of a path that ends in mid-token may not."""
    whole = re.findall(_TOKEN, host)
    of_path = re.findall(_TOKEN, path)
    if of_path and re.search(r"[A-Za-z0-9]$", path):
        of_path.pop()
    return whole + of_path


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rule, verdict, pattern, rank_length, tokens from (verdict, host, path); the rule list is the caller's, not data."""
    rows = [(host + path, verdict, compile_rule(host, path), len(host + path), literal_tokens(host, path)) for verdict, host, path in rules]
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, rank_length int, tokens array<string>")


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of host and path, and the empty one under which rules without a literal token are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.concat_ws("/", host, path), F.lit(f"({_TOKEN})"), 1)))


def small(rules: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rules) if count <= BROADCAST_RULES else rules


def index_rules(urls: DataFrame, rules: DataFrame, count: int) -> DataFrame:
    """``rules`` with the token each is filed under: its rarest over all of ``urls``, the first of equals."""
    wanted = rules.select("rule", F.explode_outer("tokens").alias("token")).withColumn("token", F.coalesce("token", F.lit(""))).distinct()
    seen = urls.select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    counts = seen.join(small(wanted.select("token").distinct(), count), "token", "left_semi").groupBy("token").count()
    rarest = wanted.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
    return rules.drop("tokens").join(rarest.select("rule", F.col("least.token").alias("token")), "rule")


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``rules`` holds (verdict, host, path). The longest rule that fits decides; of equally long ones a block goes first,
    then the rule's text. Where none fits, rule is null and the verdict is ``default``. A null url or one without
    ``://`` has an empty host and path. Repeated rows are all returned; other columns are not read.
    """
    rules = sorted(set(rules))
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    filed = index_rules(urls, rule_table(pages.sparkSession, rules), len(rules))
    # The rows of a key stay in their partition from here on, so collecting a url's best rule needs no second shuffle.
    alike = urls.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    spread = alike.withColumn("token", F.explode(tokens_of(F.col("host"), F.col("path"))))
    met = spread.join(small(filed, len(rules)), "token", "left")
    fits = F.expr("concat(host, path) rlike pattern")
    best = F.max(F.when(fits, F.struct("rank_length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")))
    found = met.groupBy("page_id", "host", "path").agg(best.alias("best"), F.max("copies").alias("copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
