"""Exhaustive pattern search by line, grouped by the innermost symbol, with exact counts of what is left out."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus, checked_limit, in_path
from quillgraph.plans.shared import cut


class PatternRefused(ValueError):
    """A pattern that can't be compiled or took longer than its budget."""


def nullable(pattern: str) -> bool:
    return re.compile(pattern).search("") is not None


def is_cheap(pattern: str) -> bool:
    """Whether the JVM may run a pattern without a deadline: no repeat of a group that repeats or branches, no
    reference back, no look-around, not two open repeats in a row that could trade signs, and never an empty match."""
    if nullable(pattern) or re.search(r"\\[1-9]|\(\?[=!<P]", pattern):
        return False
    depth_has: list[bool] = []
    opens = 0
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3)
            if i < 0:
                return False
        elif c == "(":
            depth_has.append(False)
        elif c == ")":
            inner = depth_has.pop() if depth_has else False
            if inner and pattern[i + 1 : i + 2] in ("*", "+", "{"):
                return False
            if depth_has:
                depth_has[-1] = depth_has[-1] or inner
        elif c in "*+{|":
            if depth_has:
                depth_has[-1] = True
            opens += c in "*+{"
        i += 1
    return opens <= 3


def _lines(files: DataFrame) -> DataFrame:
    rows = files.filter("length(text) > 0").select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return rows.select("file", (F.col("i") + 1).alias("line"), "text")


def matches(files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, budget_ms: int = 5000, within: str | None = None) -> DataFrame:
    """(file, line, col, length, text) of every match; lines from 1, columns from 0 in code points. A pattern never spans lines.

    A pattern that isn't known to be cheap is run at once, by all tasks against one deadline, and what it found is kept;
    past the deadline it is refused as a whole."""
    if isinstance(budget_ms, bool) or not isinstance(budget_ms, int) or budget_ms <= 0:
        raise ValueError("the budget must be a positive whole number of milliseconds")
    source = re.escape(pattern) if fixed else pattern
    try:
        re.compile(source)
    except re.error as e:
        raise PatternRefused(f"invalid pattern {pattern!r}: {e}") from e
    lines = _lines(files.filter(in_path("path", within)))
    java = ("(?i)" if ignore_case else "") + ("\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if fixed else source)
    if pattern and is_cheap(source):
        # The pieces between matches and the matches themselves give the places.
        hits = lines.filter(F.col("text").rlike(java)).select("*", F.split("text", java, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(f"({java})"), F.lit(0)).alias("got"))
        ends = F.transform("got", lambda g, i: F.struct(F.length(g).alias("length"), F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)).alias("before"), F.aggregate(F.slice("got", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)).alias("earlier")))
        return hits.select("file", "line", "text", F.explode(ends).alias("m")).select("file", "line", (F.col("m.before") + F.col("m.earlier")).alias("col"), F.col("m.length").alias("length"), "text")

    ends = time.time() + budget_ms / 1000

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            # This module can stop within a line; the standard one only between two.
            import regex

            timed = regex.compile(source, regex.I if ignore_case else 0)
            found = lambda t: timed.finditer(t, timeout=max(1e-3, ends - time.time()))
        except ImportError:
            found = re.compile(source, re.I if ignore_case else 0).finditer
        for batch in batches:
            out = []
            for f, n, t in zip(*(batch.column(c).to_pylist() for c in ("file", "line", "text")), strict=True):
                if time.time() > ends:
                    raise PatternRefused(f"pattern {pattern!r} took more than {budget_ms} ms")
                try:
                    out += [(f, n, m.start(), m.end() - m.start(), t) for m in found(t)]
                except TimeoutError as e:
                    raise PatternRefused(f"pattern {pattern!r} took more than {budget_ms} ms") from e
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "line", "col", "length", "text"), x, strict=True)) for x in out], schema=pa.schema([("file", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("length", pa.int32()), ("text", pa.string())]))

    try:
        return cut(lines.mapInArrow(run, "file string, line int, col int, length int, text string"))
    except Exception as e:
        if "PatternRefused" in str(e):
            raise PatternRefused(f"pattern {pattern!r} took more than {budget_ms} ms") from e
        raise


#: Lines of a bucket: a span meets only the lines of the buckets that it touches.
BUCKET = 256


def at_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``lines`` (file, line, ...) joined with the spans (file, start_line, end_line, ...) around each, bucket by bucket, so that a
    file with many lines and symbols costs what its nesting does and not their product. Spans lose ``file``."""
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.greatest("start_line", "end_line") / BUCKET)))).withColumnRenamed("file", "__f")
    near = (F.col("file") == F.col("__f")) & (F.floor(F.col("line") / BUCKET) == F.col("__b"))
    return lines.join(s, near & F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("__b", "__f")


def innermost(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """``sites`` (file, line, ...) with the smallest symbol around each line; of equal ones the first of the file."""
    spans = symbols.select("file", F.col("qualified_name").alias("q"), "start_line", "end_line", "ord")
    best = at_lines(sites.select("file", "line").distinct(), spans)
    best = best.groupBy("file", "line").agg(F.min_by("q", F.struct(F.col("end_line") - F.col("start_line"), F.col("ord"), F.col("q"))).alias("symbol"))
    return sites.join(best, ["file", "line"], "left")


def find_text(corpus: Corpus, pattern: str, fixed: bool = False, ignore_case: bool = False, within: str | None = None, limit: int | None = None, matches_per_group: int | None = None, budget_ms: int = 5000, plain: bool = False) -> DataFrame:
    """Groups by file and symbol, those with most incoming edges first: rank, file, symbol, incoming_edges, matches (array),
    group_matches, and on each row total_groups, total_matches, omitted_groups, omitted_matches."""
    checked_limit(limit, "limit")
    checked_limit(matches_per_group, "matches_per_group")
    hits = matches(corpus.files, pattern, fixed, ignore_case, budget_ms, within)
    hits = hits.withColumn("symbol", F.lit(None).cast("string")) if plain else innermost(hits, corpus.symbols)
    place = Window.partitionBy("file", "symbol").orderBy("line", "col")
    hits = hits.withColumn("n", F.row_number().over(place))
    kept = F.lit(True) if matches_per_group is None else F.col("n") <= matches_per_group
    one = F.struct("line", "col", "length", "text")
    groups = hits.groupBy("file", "symbol").agg(F.count(F.lit(1)).alias("group_matches"), F.array_sort(F.collect_list(F.when(kept, one))).alias("matches"))
    if plain:
        groups = groups.withColumn("incoming_edges", F.lit(0).cast("long"))
    else:
        into = corpus.edges.filter("to_symbol is not null").groupBy(F.col("to_symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("incoming_edges"))
        groups = groups.join(into, "symbol", "left").withColumn("incoming_edges", F.coalesce("incoming_edges", F.lit(0)))
    totals = groups.agg(F.count(F.lit(1)).alias("total_groups"), F.coalesce(F.sum("group_matches"), F.lit(0)).alias("total_matches"))
    by = [F.desc("incoming_edges"), F.asc("file"), F.coalesce("symbol", F.lit("")).asc()]
    shown = groups.orderBy(*by) if limit is None else groups.orderBy(*by).limit(limit)
    everything = Window.partitionBy()
    shown = shown.join(F.broadcast(totals))
    shown = shown.withColumn("omitted_groups", F.col("total_groups") - F.count(F.lit(1)).over(everything)).withColumn("omitted_matches", F.col("total_matches") - F.sum(F.size("matches")).over(everything))
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(*by))).select("rank", "file", "symbol", "incoming_edges", "matches", "group_matches", "total_groups", "total_matches", "omitted_groups", "omitted_matches").orderBy("rank")


def unsearched(corpus: Corpus, most: int = 1_000_000) -> DataFrame:
    """Paths whose text was too large to be kept."""
    return corpus.files.filter((F.col("size") > most) & (F.length("text") == 0)).select("path").orderBy("path")
