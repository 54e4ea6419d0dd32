"""URL filters: host-suffix and path-prefix expressions joined with rules by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import small_enough

#: A rule table of at most so many rows (about 200 bytes each) is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_RULES = 50_000
SALTS = 16
#: Hex digits of the digest that the equi-join compares.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's URL by the longest rule that fits it.

    rules: host, path, verdict. A rule fits its host and all subdomains, if the URL's path starts with the rule's.
    The longest host + path wins; equally long ones: the longer host, then block before allow.
    Returns id, host, path, rule (host + path, or null) and verdict, one row for each row of pages.

    Nulls: a null or malformed URL has an empty host and path and gets `default`; a null id stays null. Rules with a
    null or empty host are left out, a null rule path counts as empty. Repeated rows each get their own row; repeated
    rules count once. No rules, or no pages: defaults, or no rows. Other columns of pages are not carried.

    Only suffixes with as many labels and prefixes as long as some rule's are made, so a long URL yields no more
    expressions than the rules have shapes. Equal rows are counted before the expansion and repeated at the end.
    """
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host <> ''")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block sorts after allow
        .withColumn("labels", F.size(F.split("rule_host", r"\.")))
        .withColumn("rule_digest", digest(F.concat("rule_host", F.lit("\n"), "rule_path")))
        .withColumn("short", F.substring("rule_digest", 1, PREFIX))
    )
    # One row for each shape of rule (labels of its host, length of its path): bounded by the lengths that rules have.
    shapes = [(r[0], r[1]) for r in rules.select("labels", F.length("rule_path")).distinct().collect()]
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).groupBy(id_col, "host", "path").agg(F.count("*").alias("copies"))
    labels = F.split("host", r"\.")
    made = [
        F.when((F.size(labels) >= n) & (F.length("path") >= size), F.concat(F.substring_index("host", ".", -n), F.lit("\n"), F.substring("path", 1, size)))
        for n, size in sorted(shapes)
    ]
    expressions = F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")
    found = urls.select(id_col, "host", "path", "copies", F.explode_outer(expressions).alias("expression"))
    found = found.withColumn("full", digest(F.col("expression"))).withColumn("short", F.substring("full", 1, PREFIX)).drop("expression")
    if small_enough(rules, BROADCAST_RULES):
        joined = found.join(F.broadcast(rules.select("short", "rule_digest", "rule_host", "rule_path", "rule_verdict")), "short", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = found.withColumn("salt", F.pmod(F.xxhash64(id_col, "host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    rule = F.concat("rule_host", "rule_path")
    hit = F.when(F.col("full") == F.col("rule_digest"), F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("host_size"), F.col("rule_verdict").alias("verdict"), rule.alias("rule")))
    best = joined.groupBy(id_col, "host", "path").agg(F.first("copies").alias("copies"), F.max(hit).alias("hit"))
    return best.select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
