"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source_size`` copies. The
documents stand in a fixed order (by size band, hash of id and text, size, id, text); the
running sum of expected copies plus one random offset of the source crosses a
whole number once for each copy that is emitted. Size bands keep the words taken
close to the target. The order is cut into many cells by band and hash, so the
running sum is a sum over cells plus a rank within one, and a source that holds
most rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.shared import cut

#: Cells per source and size band.
CELLS = 256
WEIGHTS = (5, 2, 1)


def word_count(text: F.Column) -> F.Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``sources`` (source, source_size) with target: ``percent`` of all sizes shared by the
    weights, dealt to the sources in code point order (null last) again and again. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight until
    none is above. The windows run over one row per source."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("long"))
    # Sources reach their cap in the order of cap / weight as the level rises.
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after, all_of = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(all_of) * percent / F.lit(100.0)
    s = s.withColumn("total", total).withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # The first source that the level leaves below its cap fixes the level for all after it.
    held = F.col("level") * F.col("weight") < F.col("cap")
    level = F.first(F.when(held, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("final", level)
    target = F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") >= F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _unit(text: F.Column) -> F.Column:
    """A number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with size (words) and __tie (a digest of the text) appended: all that the mix needs of a text."""
    return docs.withColumn("size", word_count(F.col(text_col))).withColumn("__tie", F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **how) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size) appended
    (columns of these names are replaced); every row once, copies may be 0. ``docs`` may be
    ``sized`` already and then needs no text.

    Sizes are word counts. Null and empty texts have size 0. A null source is a source.
    Rows that repeat an id count one by one; those with the same text too are alike, so
    reruns agree. Without any words all targets are 0.
    """
    names = ["source_size", "target", "copies", "taken"]
    if "__tie" not in docs.columns:
        docs = sized(docs, text_col)
    docs = docs.drop(*[c for c in names if c not in (id_col, text_col, source_col)])
    bits = F.bin("size")
    band = F.length(bits) * 4 + F.conv(F.substring(F.rpad(F.substring(bits, 2, 2), 2, "0"), 1, 2), 2, 10).cast("int")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("__tie"))
    own = docs.withColumn("__band", band).withColumn("__cell", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % CELLS)
    own = own.withColumn("__s", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("__n", F.col(source_col).isNull())
    place = ["__s", "__n", "__band", "__cell"]
    # At most CELLS rows for each source and band; kept, so the texts are counted for this once.
    cells = cut(own.groupBy(*place).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")))
    sources = cells.groupBy("__s", "__n").agg(F.sum("words").alias("source_size")).select(F.when(~F.col("__n"), F.col("__s")).alias("source"), "source_size")
    goal = targets(sources, **how).select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__n"), "source_size", "target")
    before = Window.partitionBy("__s", "__n").orderBy("__band", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__ahead", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(goal, ["__s", "__n"]).drop("rows", "words")
    inside = Window.partitionBy(*place).orderBy("size", F.col(id_col).asc_nulls_last(), "__tie")
    placed = own.withColumn("__r", F.row_number().over(inside)).join(cells, place)
    upto = F.col("__ahead") + F.col("__r")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(seed + ":"), F.when(F.col("__n"), F.lit("null:")).otherwise(F.lit("of:")), F.col("__s")))
    copies = F.floor(upto * rate + offset) - F.floor((upto - 1) * rate + offset)
    out = placed.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop(*place, "__ahead", "__r", "__tie")


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` once for each of its copies, numbered by ``copy``."""
    return mixed(docs, **how).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
