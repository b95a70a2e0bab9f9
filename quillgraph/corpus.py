"""The data model: files, symbols and edges that share one generation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = "path string, language string, hash string, size bigint, line_count int, text string"
SYMBOLS = "qualified_name string, file string, name string, kind string, start_line int, end_line int, start_col int, end_col int, signature string, ord int, shadowed boolean, exported boolean"
EDGES = "kind string, from_file string, from_symbol string, to_name string, line int, to_symbol string, to_file string, status string, method string, reason string, external string, candidates array<string>, binding string, arguments int, constructs string, overload string"
ROUTES = "file string, method string, path string, line int, handler string"

# Order of the edge kinds.
KINDS = ("calls", "references", "imports", "extends", "routes", "implements")
# Ways of resolving that go by a name alone, or by a hint on the receiver.
WEAK = ("same-file-name", "imported-file-name", "unique-name", "receiver-hint")
# Paths of tests.
TEST_PATHS = (r"(^|/)(tests?|__tests__)/", r"(^|/)test_[^/]+\.py$", r"(\.(test|spec)\.[^/]+|_test\.(go|py))$")


def is_reliable() -> Column:
    """Resolved, and not by a name or a hint alone."""
    return (F.col("status") == "resolved") & ~F.coalesce(F.col("method"), F.lit("")).isin(*WEAK)


def is_test_file(path: str | Column) -> Column:
    """Paths that test runners take for tests."""
    p = F.col(path) if isinstance(path, str) else path
    return p.rlike("|".join(TEST_PATHS))


def dir_of(path: str | Column) -> Column:
    """The folder of a path with a slash at its end; a dot at the top."""
    p = F.col(path) if isinstance(path, str) else path
    d = F.regexp_extract(p, r"^(.*/)[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def in_path(path: str | Column, scope: str | None) -> Column:
    """Whether a path is the scope or lies below it; no scope takes all."""
    scope = (scope or "").rstrip("/")
    if not scope:
        return F.lit(True)
    p = F.col(path) if isinstance(path, str) else path
    return (p == scope) | F.startswith(p, F.lit(scope + "/"))


def checked_limit(value: int | None, name: str, least: int = 0) -> int | None:
    """Limits are whole numbers; 0 is a limit, not its absence."""
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < least):
        raise ValueError(f"{name} must be a whole number of {least} or more")
    return value


@dataclass(frozen=True)
class Corpus:
    """One snapshot. ``symbols`` may repeat a qualified name (overloads); ``unique_symbols`` holds its last declaration."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    routes: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def unique_symbols(self) -> DataFrame:
        order = F.struct("file", "start_line", "end_line", "name", "ord")
        names = [c for c in self.symbols.columns if c != "qualified_name"]
        # Dealt out first, so that rows are sorted once: before it, hardly any name repeats.
        last = self.symbols.repartition("qualified_name").groupBy("qualified_name").agg(F.max_by(F.struct(*names), order).alias("s"))
        return last.select("qualified_name", "s.*")

    def degree(self) -> DataFrame:
        """(qualified_name, in_edges, in_files, out_edges) of the symbols that have any edge to or from them."""
        by_file = self.edges.filter("to_symbol is not null").groupBy(F.col("to_symbol").alias("qualified_name"), "from_file").agg(F.count(F.lit(1)).alias("n"))
        into = by_file.groupBy("qualified_name").agg(F.sum("n").alias("in_edges"), F.count("from_file").alias("in_files"))
        out = self.edges.filter("from_symbol <> ''").groupBy(F.col("from_symbol").alias("qualified_name")).agg(F.count(F.lit(1)).alias("out_edges"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return into.join(out, "qualified_name", "full_outer").select("qualified_name", zero("in_edges"), zero("in_files"), zero("out_edges"))

    def generation(self) -> DataFrame:
        """One row: the number of files, symbols and edges, and a digest that depends on their contents but on no order.

        Each row's canonical JSON is hashed to 128 bits, whose halves are added up apart, so the digest
        takes one aggregation per table; a row that occurs twice counts twice."""
        wide = "decimal(38,0)"

        def total(df: DataFrame, names: list[str]) -> DataFrame:
            h = df.select(F.md5(canonical(df, [c for c in names if c in df.columns])).alias("h"))
            half = lambda k: F.coalesce(F.sum(F.conv(F.substring("h", k, 16), 16, 10).cast(wide)), F.lit(0)).cast("string")
            return h.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("+", half(1), half(17)).alias("h"))

        columns = lambda schema: [c.split()[0] for c in schema.split(", ")]
        parts = {"files": (self.files, [c for c in columns(FILES) if c != "text"]), "symbols": (self.symbols, columns(SYMBOLS)), "edges": (self.edges, columns(EDGES))}
        rows = None
        for name, (df, names) in parts.items():
            one = total(df, names).select(F.lit(name).alias("part"), "*")
            rows = one if rows is None else rows.unionAll(one)
        return rows.groupBy().agg(*(F.max(F.when(F.col("part") == p, F.col("n"))).alias(p) for p in parts), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "n", "h"))), "\n"), 256).alias("generation"))

    def with_edges(self, edges: DataFrame) -> Corpus:
        return replace(self, edges=edges)


def canonical(df: DataFrame, names: list[str] | None = None) -> Column:
    """A row as JSON with its columns by name and without nulls: equal rows give equal texts."""
    return F.to_json(F.struct(*sorted(names or df.columns)))


#: Columns that make two edges the same one.
SAME_EDGE = ("from_file", "line", "kind", "to_name", "to_symbol", "to_file", "from_symbol", "binding", "arguments", "constructs")


def edge_order() -> list[Column]:
    """The total order of edges: what makes them the same one, then their evidence."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = [F.coalesce(F.col(c), F.lit(-1)) if c in ("line", "arguments") else text(c) for c in SAME_EDGE]
    return [*keys, *(text(c) for c in ("status", "method", "reason", "external")), F.coalesce(F.to_json("candidates"), F.lit("")), text("overload")]


def deduplicated_edges(edges: DataFrame) -> DataFrame:
    """Of the edges that are the same one the first in order."""
    place = Window.partitionBy(*SAME_EDGE).orderBy(*edge_order()[len(SAME_EDGE) :])
    return edges.withColumn("__n", F.row_number().over(place)).filter("__n = 1").drop("__n")


def empty(spark: SparkSession) -> Corpus:
    return Corpus(*(spark.createDataFrame([], s) for s in (FILES, SYMBOLS, EDGES, ROUTES)))
