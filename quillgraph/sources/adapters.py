"""Corpora from tables: prose, web pages, a star schema, conversations. Plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.corpus import EDGES, SYMBOLS, Corpus


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _files(path: Column, text: Column, language: Column | str = "fallback") -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    lang = F.lit(language) if isinstance(language, str) else language
    lines = F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return [path.alias("path"), lang.alias("language"), F.sha2(text, 256).alias("hash"), F.octet_length(text).cast("long").alias("size"), lines.cast("int").alias("line_count"), text.alias("text")]


def doc_path() -> Column:
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt"))


def docs(spark: SparkSession, folder: str) -> Corpus:
    """Each document is a prose file without symbols."""
    d = table(spark, folder, "documents")
    return Corpus(d.select(*_files(doc_path(), F.col("text"))), spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], EDGES))


def _symbol(qualified: Column, file: Column, name: Column, kind: str | Column, start: Column, end: Column | None = None, signature: Column | None = None) -> list[Column]:
    k = F.lit(kind) if isinstance(kind, str) else kind
    end = start if end is None else end
    return [qualified.alias("qualified_name"), file.alias("file"), name.alias("name"), k.alias("kind"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"), (F.lit("") if signature is None else signature).alias("signature"), F.lit(0).alias("ord"), F.lit(False).alias("shadowed"), F.lit(False).alias("exported")]


def _edge(kind: str, from_file: Column, from_symbol: Column, to_name: Column, line: Column, to_symbol: Column | None, to_file: Column | None, method: str = "import-binding") -> list[Column]:
    none = F.lit(None).cast("string")
    to_symbol = none if to_symbol is None else to_symbol
    return [F.lit(kind).alias("kind"), from_file.alias("from_file"), from_symbol.alias("from_symbol"), to_name.alias("to_name"), line.cast("int").alias("line"), to_symbol.alias("to_symbol"), (none if to_file is None else to_file).alias("to_file"), F.when(to_symbol.isNotNull(), "resolved").otherwise("unresolved").alias("status"), F.when(to_symbol.isNotNull(), method).alias("method"), F.when(to_symbol.isNull(), "no-matching-symbol").alias("reason"), none.alias("external"), F.lit(None).cast("array<string>").alias("candidates"), none.alias("binding"), F.lit(None).cast("int").alias("arguments"), none.alias("constructs"), none.alias("overload")]


def star(spark: SparkSession, folder: str, orders: DataFrame | None = None, lineitem: DataFrame | None = None) -> Corpus:
    """Rows are symbols ``table/part#key``, foreign keys are references. Parts of tables are files: orders by status,
    line items by return flag; flag R plays the tests (``tests/lineitem_r``)."""
    o = table(spark, folder, "orders") if orders is None else orders
    l = table(spark, folder, "lineitem") if lineitem is None else lineitem  # noqa: E741
    text = lambda c: F.col(c).cast("string")
    lit = F.lit
    of = F.concat(lit("orders/"), F.lower("o_orderstatus"))
    lf = F.when(F.col("l_returnflag") == "R", lit("tests/lineitem_r")).otherwise(F.concat(lit("lineitem/"), F.lower("l_returnflag")))
    ln = F.concat(text("l_orderkey"), lit("-"), text("l_linenumber"))
    lq, oq = F.concat(lf, lit("#"), ln), F.concat(of, lit("#"), text("o_orderkey"))
    lline, oline = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("o_orderkey") + 1
    small = {t: table(spark, folder, t) for t in ("customer", "supplier", "part", "nation", "region")}
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey"}
    names = {"customer": "c_name", "supplier": "s_name", "part": "p_name", "nation": "n_name", "region": "r_name"}
    symbols = [l.select(*_symbol(lq, lf, ln, "function", lline)), o.select(*_symbol(oq, of, text("o_orderkey"), "class", oline, signature=text("o_orderpriority")))]
    symbols += [d.select(*_symbol(F.concat(lit(f"{t}/all#"), text(keys[t])), lit(f"{t}/all"), text(keys[t]), "class", F.col(keys[t]) + 1, signature=F.col(names[t]))) for t, d in small.items()]
    to = lambda t, k: (F.concat(lit(f"{t}/all#"), text(k)), lit(f"{t}/all"))
    status = o.select("o_orderkey", oq.alias("oq"), of.alias("ofile"))
    lo = l.join(status, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    edges = [lo.select(*_edge("calls", lf, lq, text("l_orderkey"), lline, F.col("oq"), F.col("ofile")))]
    edges += [l.select(*_edge("references", lf, lq, text(k), lline, *to(t, k))) for t, k in (("part", "l_partkey"), ("supplier", "l_suppkey"))]
    edges += [o.select(*_edge("calls", of, oq, text("o_custkey"), oline, *to("customer", "o_custkey")))]
    edges += [small[t].select(*_edge("extends", lit(f"{t}/all"), F.concat(lit(f"{t}/all#"), text(keys[t])), text(k), F.col(keys[t]) + 1, *to(u, k))) for t, k, u in (("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("nation", "n_regionkey", "region"))]
    rows = reduce(DataFrame.unionByName, symbols)
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("qualified_name").cast("decimal(38,0)")).alias("h")).select(F.col("file").alias("path"), F.substring_index("file", "/", 1).alias("language"), F.sha2(F.col("h").cast("string"), 256).alias("hash"), F.col("n").alias("size"), F.col("n").cast("int").alias("line_count"), F.lit("").alias("text"))
    return Corpus(files, rows, reduce(DataFrame.unionByName, edges))


def web(spark: SparkSession, folder: str) -> Corpus:
    """Each page is a file with one symbol, named by the first word of its heading; links name symbols by their target word."""
    p = table(spark, folder, "pages")
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    path = F.concat(host, F.lit("/page_"), F.col("page_id"), F.lit(".html"))
    word = F.lower(F.regexp_extract(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1), r"^[^\p{L}]*(\p{L}+)", 1))
    lang = F.coalesce(F.regexp_extract("html", r"<html lang=\"(\w+)\"", 1), F.lit("fallback"))
    d = p.select(path.alias("path"), word.alias("word"), lang.alias("lang"), "html")
    files = d.select(*_files(F.col("path"), F.col("html"), F.col("lang")))
    q = F.concat("path", F.lit("#"), "word")
    symbols = d.filter("word <> ''").select(*_symbol(q, F.col("path"), F.col("word"), "class", F.lit(1)))
    own = F.when(F.col("word") != "", q).otherwise(F.lit(""))
    links = d.select("path", own.alias("own"), F.posexplode(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))).alias("i", "target"))
    target = F.lower(F.regexp_extract("target", r"^[^\p{L}]*(\p{L}+)", 1))
    edges = links.filter(target != "").select(*_edge("calls", F.col("path"), F.col("own"), target, F.col("i") + 1, None, None))
    return Corpus(files, symbols, edges)


def chat(spark: SparkSession, folder: str) -> Corpus:
    """Each conversation is a file; its turns stand one after the other and are symbols with the lines they take; each answers the one before."""
    t = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = t.groupBy("conv_id").agg(turns.alias("t")).withColumn("path", F.concat(F.lit("conv_"), "conv_id", F.lit(".txt")))
    files = c.select(*_files(F.col("path"), F.array_join(F.transform("t", lambda x: x["text"]), "\n")))
    size = lambda x: F.size(F.split(x["text"], "\n", -1))
    spans = c.select("path", F.posexplode("t").alias("i", "x"), "t").withColumn("before", F.aggregate(F.slice("t", F.lit(1), F.col("i")), F.lit(0), lambda a, y: a + size(y)))
    q = F.concat("path", F.lit("#"), F.col("x.turn"))
    symbols = spans.select(*_symbol(q, F.col("path"), F.col("x.turn").cast("string"), "function", F.col("before") + 1, F.col("before") + size(F.col("x")), F.col("x.role")))
    prior = F.element_at("t", F.col("i"))
    edges = spans.filter("i > 0").select(*_edge("calls", F.col("path"), q, prior["turn"].cast("string"), F.col("before") + 1, F.concat("path", F.lit("#"), prior["turn"]), F.col("path")))
    return Corpus(files, symbols, edges)
