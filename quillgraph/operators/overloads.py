"""Which declaration of several a call means, by its number of arguments.

Declarations of one name share a qualified name; those of base classes, level by level, join in for languages
that tell them apart. An override hides a base's declaration with the same range and written types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.shared import cut

#: Levels of base classes that are looked through.
LEVELS = 8
TYPED = ("java", "c_sharp")


def _fits(n: str) -> F.Column:
    return (F.col(n) >= F.col("min_args")) & (F.col("max_args").isNull() | (F.col(n) <= F.col("max_args")))


def levels(asked: DataFrame, symbols: DataFrame, heritage: DataFrame, most: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The declarations of (holder, member), level by level: holder, member, level, qualified_name, file, line, min_args, max_args,
    types, overrides; and the (holder, member) for which some base can't be followed, or more than one is declared."""
    own = symbols.filter("kind = 'method' and min_args is not null").select(F.concat("file", F.lit("#"), "scope").alias("at"), F.col("name").alias("member"), "qualified_name", "file", F.col("start_line").alias("line"), "min_args", "max_args", "types", F.coalesce("overrides", F.lit(False)).alias("overrides"))
    kinds = symbols.groupBy("qualified_name").agg(F.first("kind").alias("kind"))
    up = heritage.join(kinds.withColumnsRenamed({"qualified_name": "base", "kind": "bk"}), "base", "left").join(kinds.withColumnsRenamed({"qualified_name": "holder", "kind": "hk"}), "holder", "left")
    # What a class takes from interfaces adds nothing to its overloads.
    up = up.filter("not (bk = 'interface' and hk <> 'interface') or bk is null").groupBy(F.col("holder").alias("at")).agg(F.count_distinct("base").alias("n"), F.max(F.col("base").isNull()).alias("open"), F.max("base").alias("base"))
    now = cut(asked.select("holder", "member", F.col("holder").alias("at")).distinct())
    found = lost = None
    for level in range(most + 1):
        here = now.join(own, ["at", "member"]).select("holder", "member", F.lit(level).alias("level"), "qualified_name", "file", "line", "min_args", "max_args", "types", "overrides")
        found = here if found is None else found.unionByName(here)
        above = cut(now.join(up, "at"))
        bad = above.filter("open or n > 1").select("holder", "member")
        lost = bad if lost is None else lost.unionByName(bad)
        now = above.filter("not open and n = 1").select("holder", "member", F.col("base").alias("at"))
        if above.isEmpty():
            break
    return cut(found), cut(lost.distinct())


def chosen(edges: DataFrame, symbols: DataFrame, heritage: DataFrame, files: DataFrame) -> DataFrame:
    """``edges`` with ``overload`` as JSON (line; or line and from, where the edge moved to a base's declaration; or
    candidates and elsewhere), for calls with a number of arguments. ``edges`` has ``holder``, the class a receiver was found to be, or null."""
    language = files.select(F.col("path").alias("to_file"), F.col("language").alias("lang"))
    calls = edges.filter("kind = 'calls' and arguments is not null and to_symbol is not null").select("to_symbol", "to_file", "arguments", "holder").distinct().join(language, "to_file")
    calls = calls.withColumn("own_holder", F.coalesce("holder", F.regexp_extract("to_symbol", r"^(.*)\.[^.]*$", 1))).withColumn("member", F.element_at(F.split(F.substring_index("to_symbol", "#", -1), r"\."), -1))
    declared = symbols.filter("kind in ('method', 'function') and min_args is not null").select(F.col("qualified_name").alias("to_symbol"), F.col("start_line").alias("line"), "min_args", "max_args").distinct()
    mine = calls.join(declared, "to_symbol").groupBy("to_symbol", "to_file", "arguments", "holder").agg(F.count(F.lit(1)).alias("all"), F.array_sort(F.collect_list(F.when(_fits("arguments"), F.col("line")))).alias("fits"))
    line = lambda c: F.struct(c.alias("line"))
    local = F.when((F.col("all") == 1) & (F.size("fits") == 1), None).when(F.size("fits") == 1, F.to_json(line(F.col("fits")[0]))).otherwise(F.to_json(F.struct(F.col("fits").alias("candidates"))))
    mine = mine.withColumn("local", local)

    typed = calls.filter(F.col("lang").isin(*TYPED) & (F.col("own_holder") != ""))
    # Constructors aren't inherited.
    typed = cut(typed.filter(F.element_at(F.split(F.substring_index("own_holder", "#", -1), r"\."), -1) != F.col("member")))
    if not typed.isEmpty():
        found, lost = levels(typed.select(F.col("own_holder").alias("holder"), "member"), symbols, heritage)
        e = typed.select("to_symbol", "to_file", "arguments", F.col("holder").alias("given"), F.col("own_holder").alias("holder"), "member").join(found, ["holder", "member"]).filter(_fits("arguments"))
        keys = ["to_symbol", "arguments", "given", "holder"]
        same = Window.partitionBy(*keys, "min_args", "max_args", "types").orderBy("level").rangeBetween(Window.unboundedPreceding, -1)
        e = e.drop("to_file").withColumn("hidden", F.coalesce(F.max("overrides").over(same), F.lit(False))).filter("not hidden")
        mark = F.col("qualified_name") == F.col("to_symbol")
        sums = e.groupBy(*keys, "member").agg(F.count(F.lit(1)).alias("slots"), F.count(F.when(~mark, 1)).alias("others"), F.max(F.struct("qualified_name", "file", "line")).alias("one"), F.array_sort(F.collect_list(F.when(mark, F.col("line")))).alias("candidates"), F.array_sort(F.collect_list(F.when(~mark, F.struct("file", "line")))).alias("elsewhere"))
        sums = sums.join(lost.withColumn("open", F.lit(True)), ["holder", "member"], "left").drop("holder", "member").withColumnsRenamed({"given": "h", "to_symbol": "ts", "arguments": "args"})
        mine = mine.join(sums, (F.col("to_symbol") == F.col("ts")) & (F.col("arguments") == F.col("args")) & F.col("holder").eqNullSafe(F.col("h")), "left").drop("ts", "args", "h")
        withdrawn = F.when(F.col("local").isNotNull() & (F.size("fits") == 1), F.to_json(F.struct(F.col("fits").alias("candidates")))).otherwise(F.col("local"))
        moves = (F.col("others") > 0) & (F.col("slots") == 1) & F.col("open").isNull()
        moved = F.to_json(F.struct(F.col("one.line").alias("line"), F.col("to_symbol").alias("from")))
        many = F.to_json(F.struct("candidates", "elsewhere"))
        mine = mine.withColumn("new", F.when(moves, F.col("one"))).withColumn("local", F.when(F.col("slots").isNull(), F.col("local")).when(F.col("open") & (F.col("slots") < 2), withdrawn).when(F.col("others") == 0, F.col("local")).when(moves, moved).otherwise(many))
    else:
        mine = mine.withColumn("new", F.lit(None).cast("struct<qualified_name:string,file:string,line:int>"))
    mine = mine.select(F.col("to_symbol").alias("ts"), F.col("arguments").alias("args"), F.col("holder").alias("h"), "local", "new")
    out = edges.join(mine, (F.col("kind") == "calls") & (F.col("to_symbol") == F.col("ts")) & (F.col("arguments") == F.col("args")) & F.col("holder").eqNullSafe(F.col("h")), "left")
    names = [c for c in edges.columns if c not in ("holder", "overload", "to_symbol", "to_file")]
    return out.select(*names, F.coalesce("new.qualified_name", "to_symbol").alias("to_symbol"), F.coalesce("new.file", "to_file").alias("to_file"), F.col("local").alias("overload"))
