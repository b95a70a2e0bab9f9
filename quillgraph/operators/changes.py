"""What changed between two snapshots, and what depends on it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus
from quillgraph.operators.find_text import at_lines
from quillgraph.operators.graph import few_of, in_files, touching
from quillgraph.plans.shared import cut


@dataclass
class FileDiff:
    """One file of a unified diff: paths before and after (None: it wasn't or isn't there), and changed line numbers on each side."""

    before: str | None
    after: str | None
    old_lines: list[int] = field(default_factory=list)
    new_lines: list[int] = field(default_factory=list)


def parse_diff(text: str) -> list[FileDiff]:
    """The files of a unified diff. Context lines don't count as changed; hunks that don't add up raise,
    unless both sides fall short alike (blank context lines that were cut off)."""
    out: list[FileDiff] = []
    now: FileDiff | None = None
    lines = text.split("\n")
    i = 0
    path = lambda p, side: None if p == "/dev/null" else re.sub(rf"^{side}/", "", p)
    while i < len(lines):
        line = lines[i]
        if line.startswith("diff --git "):
            now = None
            m = re.fullmatch(r"diff --git a/(.+) b/(.+)", line)
            renamed = FileDiff(m[1], m[2]) if m and m[1] != m[2] else None
            j = i + 1
            while j < len(lines) and not lines[j].startswith(("diff --git ", "--- ")):
                j += 1
            if renamed and (j == len(lines) or not lines[j].startswith("--- ")):
                out.append(renamed)
        elif line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            a, b = (x[4:].split("\t")[0].strip() for x in (line, lines[i + 1]))
            now = FileDiff(path(a, "a"), path(b, "b"))
            out.append(now)
            i += 1
        elif line.startswith("@@"):
            m = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
            if m is None or now is None:
                raise ValueError(f"malformed diff at line {i + 1}")
            old, new = int(m[1]), int(m[3])
            left, right = int(m[2] or 1), int(m[4] or 1)
            while (left > 0 or right > 0) and i + 1 < len(lines):
                body = lines[i + 1]
                if body.startswith("-") and left:
                    now.old_lines.append(old)
                    old, left = old + 1, left - 1
                elif body.startswith("+") and right:
                    now.new_lines.append(new)
                    new, right = new + 1, right - 1
                elif body.startswith(" ") or body == "":
                    if body == "" and i + 2 >= len(lines):
                        break
                    old, new, left, right = old + 1, new + 1, left - 1, right - 1
                elif not body.startswith("\\"):
                    break
                i += 1
            if left != right:
                raise ValueError("a hunk's sides don't add up")
        i += 1
    return out


def freshness(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files (path, hash): added, changed, deleted."""
    a, b = before.select("path", F.col("hash").alias("h1")), after.select("path", F.col("hash").alias("h2"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "deleted").when(F.col("h1") != F.col("h2"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def health(before: DataFrame, after: DataFrame, diagnostics: int = 0) -> str:
    """fresh, stale or partial."""
    if not freshness(before, after).isEmpty():
        return "stale"
    return "partial" if diagnostics else "fresh"


def renames(before: DataFrame, after: DataFrame, diff: list[FileDiff] | None = None) -> DataFrame:
    """(old_path, new_path): those the diff names, else removed and added files whose content is the same and unique on both sides."""
    a, b = before.select(F.col("path").alias("old_path"), "hash"), after.select(F.col("path").alias("new_path"), "hash")
    gone = a.join(b, F.col("old_path") == F.col("new_path"), "left_anti")
    come = b.join(a, F.col("old_path") == F.col("new_path"), "left_anti")
    named = [(d.before, d.after) for d in diff or [] if d.before and d.after and d.before != d.after]
    spark = before.sparkSession
    told = spark.createDataFrame(named, "old_path string, new_path string").join(a.select("old_path"), "old_path", "left_semi").join(b.select("new_path"), "new_path", "left_semi").select("old_path", "new_path")
    only = lambda d, p: d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(p).alias(p)).filter("n = 1").drop("n")
    same = only(gone, "old_path").join(only(come, "new_path"), "hash").select("old_path", "new_path")
    return told.unionByName(same.join(told, "old_path", "left_anti").join(told, "new_path", "left_anti")) if named else same


def _texts(corpus: Corpus) -> DataFrame:
    """Symbols with a digest of what they say: the span's lines where the file has a text, and the signature."""
    s = corpus.unique_symbols().select("qualified_name", "file", "kind", "start_line", "start_col", "end_line", "signature")
    lines = corpus.files.filter("length(text) > 0").select(F.col("path").alias("file"), F.split("text", "\n", -1).alias("l"))
    if lines.isEmpty():  # else a file's symbols meet in one task, to no purpose
        return s.select("qualified_name", "file", "kind", "start_line", "start_col", F.sha2(F.concat_ws("\x1f", F.lit(""), "signature"), 256).alias("says"))
    body = F.coalesce(F.array_join(F.slice("l", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n"), F.lit(""))
    return s.join(lines, "file", "left").select("qualified_name", "file", "kind", "start_line", "start_col", F.sha2(F.concat_ws("\x1f", body, "signature"), 256).alias("says"))


def _innermost(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(qualified_name) of the innermost symbol at each changed (file, line): it starts last, then further right, then ends first."""
    at = at_lines(changed, symbols.select("file", "qualified_name", "start_line", "start_col", "end_line", "end_col"))
    return at.groupBy("file", "line").agg(F.max_by("qualified_name", F.struct("start_line", "start_col", -F.col("end_line"), -F.col("end_col"))).alias("qualified_name")).select("qualified_name").distinct()


def changed_lines(spark, diff: list[FileDiff]) -> tuple[DataFrame, DataFrame]:
    """(file, line) changed on the old side and on the new one."""
    old = [(d.before, n) for d in diff if d.before for n in d.old_lines]
    new = [(d.after, n) for d in diff if d.after for n in d.new_lines]
    return tuple(spark.createDataFrame(x, "file string, line int") for x in (old, new))


def symbol_changes(base: Corpus, current: Corpus, diff: list[FileDiff] | None = None) -> DataFrame:
    """(old_name, new_name, change): added, changed, deleted, renamed.

    Partners are the same name (in a renamed file, the new file's); else the only new symbol of the
    same kind at the same place of the same file. Without a diff a symbol changed if its text or
    signature did, with one if a changed line is its own."""
    moved = renames(base.files, current.files, diff)
    a = _texts(base).select(*(F.col(c).alias(f"a_{c}") for c in ("qualified_name", "file", "kind", "start_line", "start_col", "says")))
    b = _texts(current).select(*(F.col(c).alias(f"b_{c}") for c in ("qualified_name", "file", "kind", "start_line", "start_col", "says")))
    moved = cut(moved)
    a = a.join(F.broadcast(moved) if few_of(moved, "old_path") is not None else moved, F.col("a_file") == F.col("old_path"), "left").withColumn("now_file", F.coalesce("new_path", "a_file"))
    a = a.withColumn("now_name", F.when(F.col("new_path").isNotNull(), F.concat("new_path", F.substring("a_qualified_name", F.length("a_file") + 1, F.length("a_qualified_name")))).otherwise(F.col("a_qualified_name"))).drop("old_path", "new_path")
    by_name = a.join(b, F.col("now_name") == F.col("b_qualified_name"), "full_outer")
    paired = by_name.filter("a_qualified_name is not null and b_qualified_name is not null")
    left = by_name.filter("b_qualified_name is null").select([c for c in a.columns])
    new = by_name.filter("a_qualified_name is null").select([c for c in b.columns])
    place = ["file", "kind", "start_line", "start_col"]
    one = lambda d, keys: d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("n = 1").drop("n")
    l1 = one(left, ["now_file", "a_kind", "a_start_line", "a_start_col"])
    n1 = one(new, [f"b_{c}" for c in place])
    placed = l1.join(n1, (F.col("now_file") == F.col("b_file")) & (F.col("a_kind") == F.col("b_kind")) & (F.col("a_start_line") == F.col("b_start_line")) & (F.col("a_start_col") == F.col("b_start_col")))
    deleted = left.join(placed.select("a_qualified_name"), "a_qualified_name", "left_anti")
    added = new.join(placed.select("b_qualified_name"), "b_qualified_name", "left_anti")
    differs = F.col("a_says") != F.col("b_says")
    if diff is not None:
        old_lines, new_lines = changed_lines(base.spark, diff)
        inner = _innermost(base.symbols, old_lines).withColumnRenamed("qualified_name", "a_qualified_name").withColumn("o", F.lit(True))
        outer = _innermost(current.symbols, new_lines).withColumnRenamed("qualified_name", "b_qualified_name").withColumn("w", F.lit(True))
        paired = paired.join(inner, "a_qualified_name", "left").join(outer, "b_qualified_name", "left")
        differs = F.coalesce("o", F.lit(False)) | F.coalesce("w", F.lit(False))
    names = [F.col("a_qualified_name").alias("old_name"), F.col("b_qualified_name").alias("new_name")]
    none = F.lit(None).cast("string")
    renamed = F.col("a_qualified_name") != F.col("b_qualified_name")
    kept = paired.filter(differs | renamed).select(*names, F.when(renamed, "renamed").otherwise("changed").alias("change"))
    return kept.unionByName(placed.select(*names, F.lit("renamed").alias("change"))).unionByName(deleted.select(F.col("a_qualified_name").alias("old_name"), none.alias("new_name"), F.lit("deleted").alias("change"))).unionByName(added.select(none.alias("old_name"), F.col("b_qualified_name").alias("new_name"), F.lit("added").alias("change")))


def dependents(corpus: Corpus, seeds: DataFrame, depth: int | None = 3) -> DataFrame:
    """(node, depth, via, path, reliable) of all that depends on ``seeds`` (node: a symbol or a file), each once with one shortest path.

    Of several ways to a node the first wins: by the parent's path, then the edge. ``frontier`` is true
    at the last level where edges lead further."""
    e = corpus.edges.filter("to_symbol is not null or to_file is not null")
    src = F.coalesce("to_symbol", "to_file")
    dst = F.when(F.col("from_symbol") != "", F.col("from_symbol")).otherwise(F.col("from_file"))
    weak = ("same-file-name", "imported-file-name", "unique-name", "receiver-hint")
    steps = e.select(src.alias("src"), dst.alias("dst"), "kind", "line", (~F.coalesce(F.col("method"), F.lit("")).isin(*weak)).alias("sure"), "to_file", "from_file")
    start = seeds.select("node").distinct()
    seen = cut(start.select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.array("node").alias("path"), F.lit(True).alias("reliable")))
    few, at = few_of(seen), None
    if few is None:
        # Many seeds: if all are symbols or files of the corpus, edges into other files needn't be dealt out.
        own = corpus.symbols.select(F.col("qualified_name").alias("node"), "file").unionAll(corpus.files.select(F.col("path").alias("node"), "path"))
        at = cut(touching(own, "node", seen, few).distinct())
        at = at.select("file") if seen.join(at, "node", "left_anti").isEmpty() else None
    level, frontier = 0, seen
    while depth is None or level < depth:
        level += 1
        near = steps if at is None else in_files(steps, "to_file", at, "file")
        met = touching(near, "src", frontier, few).join(frontier.select(F.col("node").alias("src"), "path", "reliable"), "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        best = met.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("path", "kind", "line", "reliable", "sure")).alias("b"), F.min("from_file").alias("file"))
        reached = cut(best.select("node", F.lit(level).alias("depth"), F.col("b.kind").alias("via"), F.concat("b.path", F.array("node")).alias("path"), (F.col("b.reliable") & F.col("b.sure")).alias("reliable"), "file"))
        if reached.isEmpty():
            break
        frontier, at, few = reached.drop("file"), reached.select("file"), few_of(reached)
        seen = seen.unionAll(frontier)
    return seen.filter("depth > 0")


def frontier_edges(corpus: Corpus, found: DataFrame, depth: int) -> DataFrame:
    """One row: edges that lead from the last level to what wasn't visited (each edge counts)."""
    e = corpus.edges.filter("to_symbol is not null or to_file is not null").select(F.coalesce("to_symbol", "to_file").alias("src"), F.when(F.col("from_symbol") != "", F.col("from_symbol")).otherwise(F.col("from_file")).alias("node"))
    last = found.filter(F.col("depth") == depth).select(F.col("node").alias("src"))
    return e.join(last, "src", "left_semi").join(found.select("node"), "node", "left_anti").agg(F.count(F.lit(1)).alias("dependent_frontier"))


def impact(base: Corpus, current: Corpus, diff: list[FileDiff] | None = None, depth: int | None = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbol changes, file changes, and the dependents in either snapshot (``side``)."""
    symbols = cut(symbol_changes(base, current, diff))
    files = cut(freshness(base.files, current.files))
    moved = renames(base.files, current.files, diff).select(F.col("old_path").alias("path"))
    edited = files.join(moved, "path", "left_anti").select(F.col("path").alias("node"))
    out = None
    for side, corpus, name in (("base", base, "old_name"), ("current", current, "new_name")):
        seeds = symbols.filter(f"{name} is not null").select(F.col(name).alias("node")).unionAll(edited.join(corpus.files.select(F.col("path").alias("node")), "node", "left_semi"))
        found = dependents(corpus, seeds, depth).withColumn("side", F.lit(side))
        out = found if out is None else out.unionByName(found)
    return symbols, files, out
