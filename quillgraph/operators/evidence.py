"""What the edges prove: claims, tests, unused symbols, coverage of resolution."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus, checked_limit, is_reliable, is_test_file
from quillgraph.functions.text import share
from quillgraph.operators.graph import callers, few_of, in_files, targets, test_imports, touching
from quillgraph.plans.shared import cut


def parse_claims(text: str | list[str]) -> list[tuple[str, int]]:
    """Distinct (file, line) of ``path:line`` claims, in order; anything else raises."""
    rows = text.split() if isinstance(text, str) else text
    out: dict[tuple[str, int], None] = {}
    for x in rows:
        m = re.fullmatch(r"\s*(.+):(\d+)\s*", x)
        if not m or int(m[2]) < 1:
            raise ValueError(f"not a path and line: {x!r}")
        out[(m[1].removeprefix("./"), int(m[2]))] = None
    return list(out)


def plumb(corpus: Corpus, symbol: str, claims: DataFrame, direction: str = "in", depth: int | None = 1) -> DataFrame:
    """(file, line, verdict) of each claim, and of each proven site that no claim names (``missing``).

    ``confirmed``: a resolved edge to the symbol lies there. ``name-only``: a call of that name does
    (in), or a call out of the symbol does (out), whatever it resolves to. ``no-call``: neither. ``not-indexed``: no such file."""
    t = targets(corpus, symbol)
    hits = callers(corpus, t.withColumnRenamed("qualified_name", "node"), direction, depth).filter("status = 'resolved'").select("file", "line").distinct()
    calls = corpus.edges.filter("kind = 'calls'")
    if direction == "in":
        names = corpus.unique_symbols().join(t, "qualified_name", "left_semi").select("name").distinct()
        loose = calls.join(names, F.col("to_name") == F.col("name"), "left_semi")
    else:
        loose = calls.join(t, F.col("from_symbol") == F.col("qualified_name"), "left_semi")
    loose = loose.select(F.col("from_file").alias("file"), "line").distinct()
    c = claims.select("file", F.col("line").cast("int").alias("line")).distinct()
    judged = c.join(hits.withColumn("h", F.lit(True)), ["file", "line"], "left").join(loose.withColumn("l", F.lit(True)), ["file", "line"], "left")
    # Claims are many and their files few: no file's claims meet in one task to be told whether it is there.
    named = cut(c.select(F.col("file").alias("node")).distinct())
    files = touching(corpus.files.select(F.col("path").alias("file")), "file", named, few_of(named))
    there = few_of(files.distinct(), "file")
    judged = judged.withColumn("i", F.coalesce(F.col("file").isin(*there), F.lit(False))) if there is not None else judged.join(files.withColumn("i", F.lit(True)), "file", "left")
    verdict = F.when(~F.coalesce("i", F.lit(False)), "not-indexed").when(F.col("h"), "confirmed").when(F.col("l"), "name-only").otherwise("no-call")
    missing = hits.join(c, ["file", "line"], "left_anti").withColumn("verdict", F.lit("missing"))
    return judged.select("file", "line", verdict.alias("verdict")).unionByName(missing).orderBy("file", "line", "verdict")


def tests_for(corpus: Corpus, symbols: DataFrame, limit: int | None = 20, sites: int | None = 10, import_only: bool = True) -> DataFrame:
    """Tests of each symbol (qualified_name): test_file, basis, sites, omitted_sites, omitted_tests.

    Files with a reliable edge to the symbol first, then those that only import its file."""
    checked_limit(limit, "limit")
    checked_limit(sites, "sites")
    s = corpus.unique_symbols().join(symbols.select("qualified_name").distinct(), "qualified_name", "left_semi").select("qualified_name", "file")
    direct = corpus.edges.filter(is_test_file("from_file") & is_reliable() & F.col("to_symbol").isNotNull()).join(s, F.col("to_symbol") == F.col("qualified_name")).select("qualified_name", F.col("from_file").alias("test_file"), "line", "kind", "from_symbol")
    direct = direct.withColumn("basis", F.lit("test-path-and-resolved-edge"))
    found = direct
    if import_only:
        via = s.join(test_imports(corpus), "file").select("qualified_name", "test_file", "line", F.lit("imports").alias("kind"), F.lit("").alias("from_symbol"), F.lit("test-path-and-file-import").alias("basis"))
        found = direct.unionByName(via.join(direct.select("qualified_name", "test_file").distinct(), ["qualified_name", "test_file"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("qualified_name", "test_file").orderBy("line", "kind", "from_symbol"))
    kept = F.lit(True) if sites is None else F.col("n") <= sites
    files = found.withColumn("n", place).groupBy("qualified_name", "test_file", "basis").agg(F.count(F.lit(1)).alias("all_sites"), F.array_sort(F.collect_list(F.when(kept, F.struct("line", "kind", "from_symbol")))).alias("sites"))
    order = Window.partitionBy("qualified_name").orderBy(F.col("basis") == "test-path-and-file-import", "test_file")
    total = F.count(F.lit(1)).over(Window.partitionBy("qualified_name"))
    out = files.withColumn("rank", F.row_number().over(order)).withColumn("omitted_tests", F.greatest(total - (1 << 60 if limit is None else limit), F.lit(0)))
    out = out if limit is None else out.filter(F.col("rank") <= limit)
    return out.select("qualified_name", "rank", "test_file", "basis", "sites", (F.col("all_sites") - F.size("sites")).alias("omitted_sites"), "omitted_tests").orderBy("qualified_name", "rank")


def symbols_under_test(corpus: Corpus, test_files: DataFrame, limit: int | None = 50, sites: int | None = 10) -> DataFrame:
    """What each test file (path) exercises: qualified_name (null for an imported file), file, lines, omitted_sites, omitted_symbols, unresolved_edges."""
    checked_limit(limit, "limit")
    tests = cut(test_files.select(F.col("path").alias("node")).distinct())
    e = touching(corpus.edges, "from_file", tests, few_of(tests))
    ok = is_reliable() & F.when(F.col("kind") == "imports", F.col("to_file").isNotNull()).otherwise(F.col("to_symbol").isNotNull())
    open_ends = e.filter(~ok).groupBy("from_file").agg(F.count(F.lit(1)).alias("unresolved_edges"))
    used = e.filter(ok & (F.col("kind") != "imports"))
    imports = e.filter(ok & (F.col("kind") == "imports") & ~is_test_file("to_file"))
    # Counts first, then which of them are shown; only these have their lines looked up. So no file's edges or symbols meet in one task.
    near = in_files(corpus.symbols, "file", used.select("to_file").distinct(), "to_file")
    u = Corpus(corpus.files, near, corpus.edges).unique_symbols().select(F.col("qualified_name").alias("to_symbol"), F.col("file").alias("sfile")).filter(~is_test_file("sfile"))
    counts = used.groupBy("from_file", "to_symbol").agg(F.count(F.lit(1)).alias("all_sites")).join(u, "to_symbol")
    total = counts.groupBy("from_file").agg(F.count(F.lit(1)).alias("total"))
    if limit is not None:
        counts = counts.withColumn("rank", F.row_number().over(Window.partitionBy("from_file").orderBy("to_symbol"))).filter(F.col("rank") <= limit).drop("rank")
    counts = cut(counts)
    shown = counts.select(F.col("to_symbol").alias("node"))
    mine = touching(used, "to_symbol", shown, few_of(shown)).join(counts, ["from_file", "to_symbol"]).select("from_file", F.col("to_symbol").alias("qualified_name"), F.col("sfile").alias("file"), "line")
    known = corpus.files.select(F.col("path").alias("to_file"))
    imported = imports.join(known, "to_file", "left_semi").select("from_file", F.lit(None).cast("string").alias("qualified_name"), F.col("to_file").alias("file"), "line")
    n = F.row_number().over(Window.partitionBy("from_file", "qualified_name", "file").orderBy("line"))

    def first(rows: DataFrame) -> DataFrame:
        key = ["from_file", "qualified_name", "file"]
        every = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("all_sites"))
        kept = rows if sites is None else rows.withColumn("n", n).filter(F.col("n") <= sites)
        lines = kept.groupBy(*key).agg(F.array_sort(F.collect_list("line")).alias("lines"))
        same = [every[c].eqNullSafe(lines[c]) for c in key]
        return every.join(lines, reduce(and_, same), "left").select(*(every[c] for c in key), "all_sites", F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))

    g = first(mine.unionByName(imported)).join(total, "from_file", "left")
    omitted = F.greatest(F.coalesce("total", F.lit(0)) - (1 << 60 if limit is None else limit), F.lit(0))
    return g.join(open_ends, "from_file", "left").select(F.col("from_file").alias("test_file"), "qualified_name", "file", "lines", (F.col("all_sites") - F.size("lines")).alias("omitted_sites"), omitted.alias("omitted_symbols"), F.coalesce("unresolved_edges", F.lit(0)).alias("unresolved_edges"))


def _nested(inner, outer) -> F.Column:
    return (inner == outer) | F.startswith(inner, F.concat(outer, F.lit(".")))


def unreferenced(corpus: Corpus, scope: str = "", kinds: list[str] | None = None, exported: bool = False) -> DataFrame:
    """Symbols that no edge from outside themselves reaches but from tests, with the rule that explains them.

    qualified_name, file, line, kind, rule (null: a candidate; else shadowed, an entry point's rule, or exported),
    test_sites, unresolved_same_name. ``scope`` is a bare prefix of the path."""
    e = corpus.edges.filter("kind <> 'imports'")
    reached = e.filter(F.col("to_symbol").isNotNull() & ~_nested(F.col("from_symbol"), F.col("to_symbol")))
    referenced = reached.filter(~is_test_file("from_file")).select(F.col("to_symbol").alias("qualified_name")).distinct()
    tests = reached.filter(is_test_file("from_file")).groupBy(F.col("to_symbol").alias("qualified_name")).agg(F.count(F.lit(1)).alias("test_sites"))
    loose = e.filter("to_symbol is null").groupBy(F.element_at(F.split("to_name", r"\."), -1).alias("name")).agg(F.count(F.lit(1)).alias("unresolved_same_name"))
    s = corpus.unique_symbols().filter(F.startswith("file", F.lit(scope)))
    s = s.filter(F.col("kind").isin(*(kinds or ["function", "method", "class"])))
    s = s.join(referenced, "qualified_name", "left_anti").join(tests, "qualified_name", "left").join(loose, "name", "left")
    base = F.element_at(F.split("file", "/"), -1)
    rule = (
        F.when(F.col("shadowed"), "shadowed").when(is_test_file("file"), "test-file").when(base.rlike(r"^(index|mod|lib|__init__)\.[a-z]+$"), "index-file").when(F.col("name") == "default", "default-export").when(F.col("name").isin("main", "Main"), "main")
        .when(F.col("name").isin("constructor", "__init__", "new"), "constructor").when(F.col("name").rlike(r"^__\w+__$"), "python-dunder").when(F.col("exported") & F.lit(not exported), "exported")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.select("qualified_name", "file", F.col("start_line").alias("line"), "kind", rule.alias("rule"), zero("test_sites"), zero("unresolved_same_name")).orderBy("file", "line", "qualified_name")


def mentions(corpus: Corpus, names: DataFrame) -> DataFrame:
    """(qualified_name, mentions) of symbols (qualified_name, name, file, start_line, end_line): whole-word occurrences of the
    name in files that aren't tests, outside the symbol's own lines."""
    texts = corpus.files.filter(~is_test_file("path")).select(F.col("path").alias("file"), "text")
    found = lambda c: F.explode(F.regexp_extract_all(c, F.lit(r"([\p{L}_$][\p{L}\p{N}_$]*)"), F.lit(1))).alias("name")
    # A word is counted where it is read; only those in the symbols' own files are looked at by line.
    wanted = cut(names.select("name").distinct())
    known = wanted.withColumnRenamed("name", "node")
    total = touching(texts.select(found("text")), "name", known, few_of(known)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    places = cut(names.select(F.col("file").alias("node")).distinct())
    lines = touching(texts, "file", places, few_of(places)).select("file", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    near = lines.select("file", (F.col("i") + 1).alias("line"), found("t"))
    inside = names.join(near, ["file", "name"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy("qualified_name").agg(F.count(F.lit(1)).alias("own"))
    every = names.join(total, "name", "left").groupBy("qualified_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return every.join(inside, "qualified_name", "left").select("qualified_name", (F.col("n") - F.coalesce("own", F.lit(0))).alias("mentions"))


def resolution_coverage(corpus: Corpus) -> DataFrame:
    """How calls resolved by language, and over all (language ``all``): files, symbols, edges, calls, resolved, ambiguous,
    unresolved, imports_unresolved, unbound, three shares, and calls by method and by reason as JSON."""
    lang = corpus.files.select(F.col("path").alias("file"), "language")
    f = lang.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    s = corpus.symbols.select("file").join(lang, "file").groupBy("language").agg(F.count(F.lit(1)).alias("symbols"))
    e = corpus.edges.join(lang, F.col("from_file") == F.col("file")).withColumn("status", F.coalesce("status", F.lit("unresolved"))).withColumn("reason", F.when(F.col("status") == "unresolved", F.coalesce("reason", F.lit("unknown-provenance"))))
    n = e.groupBy("language", "kind", "status", "method", "reason").agg(F.count(F.lit(1)).alias("n"))
    call = F.col("kind") == "calls"
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))

    def counts(rows: DataFrame, key: str, cond) -> DataFrame:
        each = rows.filter(call & cond).groupBy("language", key).agg(F.sum("n").alias("n"))
        return each.groupBy("language").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n")))))).alias(f"by_{key}"))

    both = n.unionByName(n.withColumn("language", F.lit("all")))
    total = both.groupBy("language").agg(F.sum("n").alias("edges"), when(call).alias("calls"), when(call & (F.col("status") == "resolved")).alias("resolved"), when(call & (F.col("status") == "ambiguous")).alias("ambiguous"), when(call & (F.col("status") == "unresolved")).alias("unresolved"), when(call & (F.col("reason") == "import-target-unresolved")).alias("imports_unresolved"), when(call & (F.col("reason") == "unbound-global")).alias("unbound"))
    everything = lambda d, c: d.unionByName(d.agg(F.sum(c).alias(c)).select(F.lit("all").alias("language"), c))
    out = everything(f, "files").join(everything(s, "symbols"), "language", "left").join(total, "language", "left").na.fill(0)
    out = out.join(counts(both, "method", F.col("status") == "resolved"), "language", "left").join(counts(both, "reason", F.col("status") == "unresolved"), "language", "left")
    return out.select("*", share(F.col("resolved"), F.col("calls")).alias("resolved_share"), share(F.col("resolved"), F.col("calls") - F.col("imports_unresolved")).alias("internal_share"), share(F.col("resolved"), F.col("calls") - F.col("imports_unresolved") - F.col("unbound")).alias("bound_share")).na.fill("{}", ["by_method", "by_reason"]).orderBy(F.col("language") == "all", "language")


def ranking_metrics(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, recall, reciprocal_rank, precision). hits: case_id, rank, item; expected: case_id, item."""
    top = hits.filter(F.col("rank") <= k).groupBy("case_id", "item").agg(F.min("rank").alias("rank"))
    want = expected.select("case_id", "item").distinct()
    found = want.join(top, ["case_id", "item"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("rank").alias("got"), F.min("rank").alias("first"))
    shown = top.groupBy("case_id").agg(F.count(F.lit(1)).alias("shown"))
    return found.join(shown, "case_id", "left").select("case_id", (F.col("got") / F.col("wanted")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.when(F.coalesce("shown", F.lit(0)) > 0, F.col("got") / F.col("shown")).otherwise(F.lit(0.0)).alias("precision"))


def nearest_rank(values: DataFrame, column: str, share_of: float) -> DataFrame:
    """The nearest-rank percentile: the least value with at least that share at or below it, from counts by value."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(column)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return ranked.filter(F.col("upto") >= F.greatest(F.ceil(F.col("all") * share_of), F.lit(1))).agg(F.min(column).alias("value"))


def oracle_scores(claimed: DataFrame, truth: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row of claimed, decided, wrong, precision, recall. claimed: caller_file, line, callee, target_file, target_start, target_end;
    truth: file, line, name, verdict, def_file, def_line. A claim meets the nearest entry of its file and name within ``tolerance`` lines."""
    t = truth.select(F.col("file").alias("caller_file"), F.col("name").alias("callee"), F.explode(F.sequence(F.col("line") - tolerance, F.col("line") + tolerance)).alias("line"), F.col("line").alias("at"), "verdict", "def_file", "def_line")
    met = claimed.join(t, ["caller_file", "callee", "line"], "left")
    right = (F.col("def_file") == F.col("target_file")) & F.col("def_line").between(F.col("target_start") - tolerance, F.col("target_end") + tolerance)
    best = met.groupBy("caller_file", "line", "callee", "target_file", "target_start", "target_end").agg(F.max_by(F.struct("verdict", right.alias("right")), F.struct(right.alias("right"), -F.abs(F.col("at") - F.col("line")))).alias("b"))
    decided = F.coalesce(F.col("b.verdict"), F.lit("undecided")) != "undecided"
    sums = best.agg(F.count(F.lit(1)).alias("claimed"), F.count(F.when(decided, 1)).alias("decided"), F.count(F.when(decided & ~F.coalesce(F.col("b.right"), F.lit(False)), 1)).alias("wrong"))
    inside = truth.filter("verdict = 'in-repo'").select("file", "line", "name").distinct().agg(F.count(F.lit(1)).alias("inside"))
    return sums.join(F.broadcast(inside)).select("claimed", "decided", "wrong", share(F.col("decided") - F.col("wrong"), F.col("decided")).alias("precision"), share(F.col("decided") - F.col("wrong"), F.col("inside")).alias("recall"))


def matched_locations(edges: DataFrame, locations: DataFrame) -> DataFrame:
    """External reference locations (file, line) against edges' lines: exact, else one line off, else none. Returns file, line, match."""
    lines = edges.select(F.col("from_file").alias("file"), F.col("line").alias("at")).distinct()
    near = locations.distinct().select("file", "line", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("d")).withColumn("at", F.col("line") + F.col("d"))
    hit = near.join(lines.withColumn("h", F.lit(True)), ["file", "at"], "left").groupBy("file", "line").agg(F.min(F.when(F.col("h"), F.abs("d"))).alias("d"))
    return hit.select("file", "line", F.when(F.col("d") == 0, "exact").when(F.col("d") == 1, "neighbour").otherwise("none").alias("match"))


def receipts(corpus: Corpus, edges: DataFrame | None = None) -> DataFrame:
    """Resolved edges with what proves them: the edge's columns, generation, source_hash, target_file, target_hash, uncertainty
    (null: none). An edge of which either file isn't in the corpus has no receipt."""
    e = (corpus.edges if edges is None else edges).filter("status = 'resolved'")
    files = corpus.files.select(F.col("path").alias("at"), "hash")
    own = corpus.unique_symbols().select(F.col("qualified_name").alias("q"), F.col("file").alias("qfile"))
    e = e.join(own, F.col("to_symbol") == F.col("q"), "left").withColumn("target_file", F.coalesce("qfile", "to_file")).drop("q", "qfile")
    e = e.join(files.withColumnsRenamed({"at": "from_file", "hash": "source_hash"}), "from_file").join(files.withColumnsRenamed({"at": "target_file", "hash": "target_hash"}), "target_file")
    doubt = F.when(is_reliable(), None).when(F.col("method") == "receiver-hint", "receiver-hint-not-runtime-type-proof").otherwise("name-heuristic-or-unknown-provenance")
    return e.withColumn("uncertainty", doubt).join(F.broadcast(corpus.generation().select("generation")))
