"""Rules on hosts and paths, matched by hashed expressions (DataFrame functions only).

Each distinct url gives one expression for every suffix of its host (at label
boundaries) with every prefix of its path (up to each slash, and none). The
expressions meet the rules' in an equi-join on the first 8 hex digits of their
SHA-256; the full digest confirms, then the rest of the rule's path. The longest
rule wins. Only suffixes and prefixes as deep as some rule's are made, so a very
long url costs no more than its depth allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to so many characters in all; beyond, both sides are shuffled.
BROADCAST_CHARS = 4 << 20
#: Parts that the rows of one url are dealt to.
PARTS = 256


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
    Path: from there up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _host_suffixes(host: F.Column, most: int) -> F.Column:
    """The last label, the last two, and so on up to ``most``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))


def _path_prefixes(path: F.Column, most: int) -> F.Column:
    """Nothing, and the path up to its first slash, its second, and so on up to the slash ``most``."""
    parts = F.split(path, "/", most + 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict appended (columns of these names are replaced).

    ``rules``: host, path, verdict. A rule fits its host and all subdomains, for
    urls whose path starts with the rule's. The longest (host and path together,
    then host, then text, then verdict ``block``) wins; ``rule`` is its host and
    path, null with the verdict ``default`` if none fits. Every row gets a result;
    a null url has an empty host and path and no rule. Rules with a null are ignored.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("__url"))
    stem = F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    rules = rules.select("r_host", "r_path", "r_verdict", _digest(F.col("r_host"), stem).alias("r_digest"))
    rules = rules.withColumn("short", F.substring("r_digest", 1, 8))
    deep = rules.agg(F.sum(F.length("r_host") + F.length("r_path") + 100), F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")) - 1)).first()
    if (deep[0] or 0) <= BROADCAST_CHARS:
        rules = F.broadcast(rules)

    # A url that many rows have (null too) is dealt to parts by the rows' other columns.
    plain = [f.name for f in pages.schema if f.name != url_col and isinstance(f.dataType, T.AtomicType)]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0), F.lit(PARTS)).cast("int")
    rows = pages.withColumn("__part", part)
    seen = rows.select(F.col(url_col).alias("__url"), "__part").filter(F.col("__url").isNotNull()).distinct()
    urls = seen.groupBy("__url").agg(F.collect_set("__part").alias("__parts")).select("__url", "__parts", host.alias("h"), path.alias("p"))
    tried = urls.select("__url", "__parts", "h", "p", F.explode(_host_suffixes(F.col("h"), deep[1] or 1)).alias("s")).select("__url", "__parts", "p", "s", F.explode(_path_prefixes(F.col("p"), deep[2] or 0)).alias("q"))
    tried = tried.withColumn("digest", _digest(F.col("s"), F.col("q"))).select("__url", "__parts", "p", "digest", F.substring("digest", 1, 8).alias("short"))
    fits = tried.join(rules, "short").filter((F.col("digest") == F.col("r_digest")) & F.startswith("p", "r_path"))
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy("__url").agg(F.max(F.struct(F.length(rule).alias("l"), F.length("r_host").alias("k"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("b"), F.first("__parts").alias("__parts"))
    best = best.select("__url", F.explode("__parts").alias("__of"), F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    host, path = host_and_path(F.col(url_col))
    out = rows.join(best, (F.col(url_col) == F.col("__url")) & (F.col("__part") == F.col("__of")), "left").drop("__url", "__of", "__part")
    return out.withColumn("host", host).withColumn("path", path).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
