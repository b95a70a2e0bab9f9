"""Callers and callees, reach, and the map of folders: joins on edges, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus, checked_limit, dir_of, is_reliable, is_test_file
from quillgraph.plans.shared import cut

#: Edges that the second level of reach counts at most.
REACH_CAP = 2_000
#: Nodes that are looked up by their names in a filter that the files' statistics answer; more are joined.
FEW = 500
HUBS, HOTSPOTS, DIRS = 3, 10, 8


def targets(corpus: Corpus, symbol: str) -> DataFrame:
    """(qualified_name) of the symbol named exactly so; else of all with that bare or dotted name."""
    u = corpus.unique_symbols().select("qualified_name", "name")
    exact = u.filter(F.col("qualified_name") == symbol).select("qualified_name")
    if not exact.isEmpty():
        return exact
    hit = F.col("name") == symbol
    local = symbol.split("#", 1)[-1]
    if "." in local:
        hit = hit | F.endswith("qualified_name", F.lit("#" + local))
    return u.filter(hit).select("qualified_name")


def candidates(corpus: Corpus, symbol: str) -> DataFrame:
    """The symbols that a name may mean, most used first: qualified_name, in_edges."""
    d = targets(corpus, symbol).join(corpus.degree().select("qualified_name", "in_edges"), "qualified_name", "left")
    return d.select("qualified_name", F.coalesce("in_edges", F.lit(0)).alias("in_edges")).orderBy(F.desc("in_edges"), "qualified_name")


def last_segment(name) -> F.Column:
    return F.element_at(F.split(name, r"\."), -1)


def unresolved_by_name(edges: DataFrame) -> DataFrame:
    """Edges without a target, imports apart, with ``key``: the last part of the name they mean."""
    named = F.col("imported_name") if "imported_name" in edges.columns else F.lit(None).cast("string")
    return edges.filter("kind <> 'imports' and to_symbol is null").withColumn("key", last_segment(F.coalesce(named, F.col("to_name"))))


def few_of(nodes: DataFrame, column: str = "node") -> list[str] | None:
    """The nodes, if there are few."""
    got = [r[0] for r in nodes.select(column).limit(FEW + 1).collect()]
    return got if len(got) <= FEW else None


def touching(df: DataFrame, column: str, nodes: DataFrame, few: list[str] | None) -> DataFrame:
    """The rows of ``df`` whose column is one of the nodes (node)."""
    if few is not None:
        return df.filter(F.col(column).isin(*few))
    return df.join(nodes.select(F.col("node").alias(column)).distinct(), column, "left_semi")


def in_files(df: DataFrame, column: str, nodes: DataFrame, file: str) -> DataFrame:
    """The rows of ``df`` whose file is null or that of a node: if these files are few, the others needn't be dealt out."""
    few = few_of(nodes.select(file).distinct(), file)
    return df if few is None or None in few else df.filter(F.col(column).isNull() | F.col(column).isin(*few))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, known: DataFrame | None = None) -> DataFrame:
    """(node, depth) of all that ``edges`` (src, dst) reach from ``seeds`` (node), each at its least depth, seeds at 0.

    A level looks up the frontier's edges (by name while it is small, in a join beyond) and leaves out what has been seen; it is
    written to the shared folder, so neither lineage nor memory grows with depth. ``known``: nodes that may be entered.
    Edges may have the files of their ends (src_file, dst_file): a join then meets only those into the frontier's files.
    """
    if depth is not None and (isinstance(depth, bool) or not isinstance(depth, int) or depth < 1):
        raise ValueError("depth must be a positive whole number")
    placed = "src_file" in edges.columns
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, level = seen.select("node"), 0
    few = few_of(frontier)
    while (depth is None or level < depth) and few != []:
        level += 1
        near = in_files(edges, "src_file", frontier, "file") if few is None and "file" in frontier.columns else edges
        step = touching(near, "src", frontier, few).filter("dst is not null")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.min("dst_file").alias("file")) if placed else step.select(F.col("dst").alias("node")).distinct()
        new = step.join(seen.select("node"), "node", "left_anti")
        if known is not None:
            new = cut(new)
            few = few_of(new)
            new = new.join(touching(known, "node", new, few), "node", "left_semi") if few != [] else new
        new = cut(new.withColumn("depth", F.lit(level)))
        frontier = new.drop("depth")
        few = few_of(frontier)
        if few != []:
            seen = seen.unionAll(new.select("node", "depth"))
    return seen


def callers(corpus: Corpus, symbol: str | DataFrame, direction: str = "in", depth: int | None = 1) -> DataFrame:
    """Edges into (or out of) a symbol, and on to those of its callers: depth, file, line, kind, symbol, node, status.

    Resolved edges are followed; edges without a target that mean a node by name are
    listed at its depth with status ``unresolved`` or ``ambiguous`` and never followed.
    ``symbol`` is the other end: the caller (``in``) or what is called (``out``), null at module level.
    """
    if direction not in ("in", "out"):
        raise ValueError("direction is in or out")
    seeds = targets(corpus, symbol).withColumnRenamed("qualified_name", "node") if isinstance(symbol, str) else symbol
    e = corpus.edges.filter("to_symbol is not null")
    near, far = ("to_symbol", "from_symbol") if direction == "in" else ("from_symbol", "to_symbol")
    known = corpus.symbols.select(F.col("qualified_name").alias("node"))
    own = {"to_symbol": "to_file", "from_symbol": "from_file"}
    steps = e.select(F.col(near).alias("src"), F.col(far).alias("dst"), F.col(own[near]).alias("src_file"), F.col(own[far]).alias("dst_file")).filter("src <> '' and dst <> ''")
    nodes = bfs(steps, seeds, depth, known)
    inner = cut(nodes if depth is None else nodes.filter(F.col("depth") < depth))
    few = few_of(inner)
    hits = touching(e, near, inner, few).join(inner, F.col(near) == F.col("node")).select((F.col("depth") + 1).alias("depth"), F.col("from_file").alias("file"), "line", "kind", F.when(F.col(far) != "", F.col(far)).alias("symbol"), "node", "status")
    loose = unresolved_by_name(corpus.edges)
    if direction == "in":
        mine = touching(corpus.symbols, "qualified_name", inner, few)
        named = inner.join(Corpus(corpus.files, mine, corpus.edges).unique_symbols().select(F.col("qualified_name").alias("node"), "name"), "node")
        open_ends = loose.join(named, F.col("key") == F.col("name"))
    else:
        open_ends = touching(loose, "from_symbol", inner, few).join(inner, F.col("from_symbol") == F.col("node"))
    first = open_ends.select((F.col("depth") + 1).alias("depth"), F.col("from_file").alias("file"), "line", "kind", F.when(F.col("from_symbol") != "", F.col("from_symbol")).alias("symbol"), "node", "status", "to_name")
    once = first.withColumn("n", F.row_number().over(Window.partitionBy("file", "line", "kind", "symbol", "to_name").orderBy("depth", "node"))).filter("n = 1").drop("n", "to_name")
    return hits.unionByName(once).orderBy("depth", "file", "line", "kind", F.coalesce("symbol", F.lit("")), "node")


def name_matches(corpus: Corpus, families: DataFrame, symbol: str, most: int = 5) -> DataFrame:
    """Functions, methods and classes of the same bare name and language family: total, and the first few. families: (language, family)."""
    name = F.substring_index(F.substring_index(F.lit(symbol), "#", -1), ".", -1)
    family = corpus.files.select(F.col("path").alias("file"), "language").join(F.broadcast(families), "language", "left").select("file", F.coalesce("family", "language").alias("family"))
    s = corpus.unique_symbols().filter(F.col("kind").isin("function", "method", "class")).join(family, "file").filter(F.col("name") == name)
    own = s.filter(F.col("qualified_name") == symbol).select(F.col("family").alias("f"))
    rest = s.join(F.broadcast(own), F.col("family") == F.col("f"), "left_semi").filter(F.col("qualified_name") != symbol)
    top = rest.groupBy().agg(F.count(F.lit(1)).alias("total"), F.slice(F.array_sort(F.collect_set("qualified_name")), 1, most).alias("names"))
    return top


def test_imports(corpus: Corpus) -> DataFrame:
    """(file, test_file, line) of the reliable imports of files by tests."""
    return corpus.edges.filter((F.col("kind") == "imports") & F.col("to_file").isNotNull() & is_test_file("from_file") & is_reliable()).select(F.col("to_file").alias("file"), F.col("from_file").alias("test_file"), "line")


def reach(corpus: Corpus, symbols: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """How far a change of each symbol reaches: d1_edges, d1_files, d1_dirs, unresolved_same_name, tests; with depth 2 also d2_edges, d2_files, d2_capped.

    The second level counts the edges into the distinct callers, in the order of callers, up to a cap."""
    s = corpus.unique_symbols().select("qualified_name", "name", "file")
    if symbols is not None:
        s = s.join(symbols.select("qualified_name").distinct(), "qualified_name", "left_semi")
    e = corpus.edges.filter("to_symbol is not null")
    # Counts by caller's file first, then by its folder, then in all: each edge is dealt out once, and as a part of a count.
    sure = is_test_file("from_file") & is_reliable()
    by_file = e.groupBy(F.col("to_symbol").alias("qualified_name"), "from_file").agg(F.count(F.lit(1)).alias("n"), F.max(sure).alias("sure"))
    by_dir = by_file.groupBy("qualified_name", dir_of("from_file").alias("dir")).agg(F.sum("n").alias("n"), F.count("from_file").alias("files"), F.sum(F.col("sure").cast("long")).alias("tests"))
    one = by_dir.groupBy("qualified_name").agg(F.sum("n").alias("d1_edges"), F.sum("files").alias("d1_files"), F.count("dir").alias("d1_dirs"), F.sum("tests").alias("tests"))
    out = s.join(one, "qualified_name", "left")
    imports = test_imports(corpus).select("file", "test_file").distinct()
    if not imports.isEmpty():
        direct = by_file.filter("sure").select("qualified_name", F.col("from_file").alias("test_file"))
        tests = direct.unionAll(s.join(imports, "file").select("qualified_name", "test_file")).groupBy("qualified_name").agg(F.countDistinct("test_file").alias("tests"))
        out = out.drop("tests").join(tests, "qualified_name", "left")
    loose = unresolved_by_name(corpus.edges)
    if loose.isEmpty():
        out = out.withColumn("unresolved_same_name", F.lit(0).cast("long"))
    else:
        out = out.join(loose.groupBy(F.col("key").alias("name")).agg(F.count(F.lit(1)).alias("unresolved_same_name")), "name", "left")
    names = ["d1_edges", "d1_files", "d1_dirs", "unresolved_same_name", "tests"]
    if depth == 2:
        # Callers that nothing calls have no second level; their files are no edge's target.
        called = e.select("to_file").distinct()
        first = in_files(e.filter("from_symbol <> '' and from_symbol <> to_symbol"), "from_file", called, "to_file").select(F.col("to_symbol").alias("root"), F.col("from_symbol").alias("caller"))
        if symbols is not None:
            first = first.join(symbols.select(F.col("qualified_name").alias("root")).distinct(), "root", "left_semi")
        known = in_files(corpus.symbols, "file", called, "to_file").select(F.col("qualified_name").alias("caller")).distinct()
        degree = by_file.groupBy(F.col("qualified_name").alias("caller")).agg(F.sum("n").alias("all"))
        first = first.join(known.join(degree, "caller"), "caller").groupBy("root", "caller").agg(F.first("all").alias("all"))
        total = first.groupBy("root").agg(F.sum("all").alias("d2"))
        # Each caller has an edge at least, so those of the first callers by name, as many as the cap, fill it.
        heads = first.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("caller"))).filter(F.col("k") <= REACH_CAP)
        before = F.sum("all").over(Window.partitionBy("root").orderBy("caller").rowsBetween(Window.unboundedPreceding, -1))
        heads = heads.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < REACH_CAP)
        # Within a caller edges come by file, so the files of those under the cap follow from counts.
        met = heads.join(by_file.select(F.col("qualified_name").alias("caller"), "from_file", "n"), "caller")
        upto = F.sum("n").over(Window.partitionBy("root", "caller").orderBy("from_file").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        shown = met.withColumn("first", F.col("before") + upto - F.col("n")).filter(F.col("first") < REACH_CAP)
        files = shown.select("root", "from_file").distinct().groupBy("root").agg(F.count("from_file").alias("d2_files"))
        capped = total.join(files, "root").select(F.col("root").alias("qualified_name"), F.least("d2", F.lit(REACH_CAP)).alias("d2_edges"), "d2_files", (F.col("d2") > REACH_CAP).alias("d2_capped"))
        out = out.join(capped, "qualified_name", "left")
        names += ["d2_edges", "d2_files"]
        return out.select("qualified_name", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names), F.coalesce("d2_capped", F.lit(False)).alias("d2_capped"))
    return out.select("qualified_name", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names))


def directories(corpus: Corpus, most: int | None = DIRS) -> DataFrame:
    """Folders with file_count, symbol_count, internal_edges, external_edges, the busiest first; ``dropped_dirs`` on each row.

    An edge within a folder counts once as internal; any other once as external for the
    folder it leaves, and once for the one it enters if it has a target there."""
    checked_limit(most, "most", 1)
    files = corpus.files.groupBy(dir_of("path").alias("dir")).agg(F.count(F.lit(1)).alias("file_count"))
    symbols = corpus.symbols.groupBy(dir_of("file").alias("dir")).agg(F.count(F.lit(1)).alias("symbol_count"))
    ends = corpus.edges.groupBy(dir_of("from_file").alias("a"), dir_of("to_file").alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.when(F.col("b") != "", F.col("b")))
    same = F.col("a").eqNullSafe(F.col("b"))
    leaving = ends.select(F.col("a").alias("dir"), F.when(same, F.col("n")).otherwise(0).alias("i"), F.when(same, 0).otherwise(F.col("n")).alias("o"))
    entering = ends.filter(~same & F.col("b").isNotNull()).select(F.col("b").alias("dir"), F.lit(0).alias("i"), F.col("n").alias("o"))
    edges = leaving.unionAll(entering).groupBy("dir").agg(F.sum("i").alias("internal_edges"), F.sum("o").alias("external_edges"))
    out = files.join(symbols, "dir", "left").join(edges, "dir", "left").na.fill(0)
    out = out.withColumn("dropped_dirs", F.greatest(F.count(F.lit(1)).over(Window.partitionBy()) - (most if most is not None else 1 << 60), F.lit(0)))
    out = out.orderBy(F.desc(F.col("internal_edges") + F.col("external_edges")), F.desc("symbol_count"), "dir")
    return out if most is None else out.limit(most)


def _hubs(corpus: Corpus) -> DataFrame:
    s = corpus.unique_symbols().select("qualified_name", "kind", "file", "start_line")
    return s.join(corpus.degree(), "qualified_name").withColumn("degree", F.col("in_edges") + F.col("out_edges")).filter("degree > 0")


def hubs(corpus: Corpus, each: int = HUBS) -> DataFrame:
    """The most connected symbols of each folder, with how many were left out. First cut to ``each`` per folder and
    hash, then per folder, so no folder's symbols meet in one sort."""
    h = _hubs(corpus).withColumn("dir", dir_of("file"))
    by = [F.desc("degree"), F.asc("qualified_name")]
    total = h.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    first = h.withColumn("r", F.row_number().over(Window.partitionBy("dir", F.pmod(F.xxhash64("qualified_name"), F.lit(64))).orderBy(*by))).filter(F.col("r") <= each)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(*by))).filter(F.col("rank") <= each)
    return top.join(total, "dir").select("dir", "rank", "qualified_name", "kind", "in_edges", "in_files", "out_edges", F.greatest(F.col("n") - each, F.lit(0)).alias("dropped_hubs"))


def hotspots(corpus: Corpus, most: int = HOTSPOTS) -> DataFrame:
    """The most connected symbols of all: qualified_name, kind, file, line, in_edges, in_files, out_edges.

    The first names by degree are looked up among the symbols; if too few of them are symbols, more are."""
    by = [F.desc("degree"), F.asc("qualified_name")]
    degree = corpus.degree().withColumn("degree", F.col("in_edges") + F.col("out_edges")).filter("degree > 0")
    ask = 4 * most
    while True:
        head = cut(degree.orderBy(*by).limit(ask))
        names = head.select(F.col("qualified_name").alias("node"))
        mine = touching(corpus.symbols, "qualified_name", names, few_of(names))
        found = cut(Corpus(corpus.files, mine, corpus.edges).unique_symbols().select("qualified_name", "kind", "file", "start_line").join(head, "qualified_name"))
        if found.count() >= most or head.count() < ask:
            return found.orderBy(*by).limit(most).select("qualified_name", "kind", "file", F.col("start_line").alias("line"), "in_edges", "in_files", "out_edges")
        ask *= 16


def skeleton(corpus: Corpus, path: str) -> DataFrame:
    """The symbols of one file in order."""
    return corpus.symbols.filter(F.col("file") == path).select("qualified_name", "name", "kind", "start_line", "end_line", "signature").orderBy("start_line", "end_line", "name")
