"""Packages inside a repository, found by their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus

# Manifests of the ecosystems.
MANIFESTS = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "setup.py", "pom.xml")


def detected(corpus: Corpus) -> DataFrame:
    """(scope, ecosystem) of the folders below the top that hold a manifest, each folder once.

    Of several manifests in one folder the first of ``MANIFESTS`` counts. If the top's ``package.json`` lists
    workspaces (``dir`` or ``dir/*``; other patterns are left out), only those of its ecosystem's folders are scopes."""
    base, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    found = corpus.files.select("path", "text", base.alias("base"), folder.alias("scope")).filter(F.col("base").isin(*MANIFESTS))
    rank = F.array_position(F.array(*map(F.lit, MANIFESTS)), F.col("base"))
    first = found.filter("scope <> ''").groupBy("scope").agg(F.min_by("base", rank).alias("ecosystem"))
    listed = F.coalesce(F.from_json("text", "struct<workspaces:array<string>>")["workspaces"], F.from_json("text", "struct<workspaces:struct<packages:array<string>>>")["workspaces"]["packages"])
    globs = found.filter("path = 'package.json'").select(F.explode(listed).alias("g")).select(F.regexp_replace("g", r"^\./|/$", "").alias("g")).filter("g not like '%**%' and g not like '!%'")
    few = globs.select(F.when(F.endswith("g", F.lit("/*")), F.regexp_replace("g", r"/\*$", "")).alias("under"), F.when(~F.endswith("g", F.lit("/*")), F.col("g")).alias("exact"))
    inside = first.withColumn("above", F.regexp_replace("scope", "/?[^/]*$", ""))
    named = inside.join(few, (F.col("above") == F.col("under")), "left_semi").select("scope").unionAll(inside.join(few, F.col("scope") == F.col("exact"), "left_semi").select("scope")).distinct().withColumn("named", F.lit(True))
    any_listed = globs.agg((F.count(F.lit(1)) > 0).alias("any"))
    out = first.join(named, "scope", "left").join(F.broadcast(any_listed))
    return out.filter((F.col("ecosystem") != "package.json") | ~F.col("any") | F.col("named")).select("scope", "ecosystem").orderBy("scope")
