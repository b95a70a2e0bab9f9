"""Graph operators on a small hand-written corpus."""

import pytest
from pyspark.sql import functions as F

from quillgraph import corpus as cp
from quillgraph.operators import changes, evidence, find_text, graph, search

FILES = [(p, "python", p, 10, 12, "") for p in ("a.py", "b.py", "c.py", "tests/test_a.py")] + [("docs/n.md", "fallback", "h", 20, 2, "the fox f runs\nfox fox")]
SYMBOLS = [("a.py#f", "a.py", "f", "function", 1, 3), ("a.py#K", "a.py", "K", "class", 5, 12), ("a.py#K.m", "a.py", "m", "method", 6, 8), ("b.py#g", "b.py", "g", "function", 1, 4), ("c.py#main", "c.py", "main", "function", 1, 2), ("tests/test_a.py#test_f", "tests/test_a.py", "test_f", "function", 1, 3)]
EDGES = [
    ("calls", "b.py", "b.py#g", "f", 2, "a.py#f", "a.py", "resolved", "import-binding", None),
    ("calls", "c.py", "c.py#main", "g", 2, "b.py#g", "b.py", "resolved", "import-binding", None),
    ("calls", "tests/test_a.py", "tests/test_a.py#test_f", "f", 2, "a.py#f", "a.py", "resolved", "import-binding", None),
    ("imports", "b.py", "", "a", 1, None, "a.py", "resolved", "import-path", None),
    ("calls", "c.py", "c.py#main", "m", 2, None, None, "unresolved", None, "receiver-unresolved"),
    ("calls", "b.py", "b.py#g", "f", 3, None, None, "ambiguous", None, None),
    ("calls", "b.py", "b.py#g", "m", 4, "a.py#K.m", "a.py", "resolved", "receiver-hint", None),
]


@pytest.fixture(scope="module")
def c(spark):
    files = spark.createDataFrame(FILES, cp.FILES)
    symbols = spark.createDataFrame([(*s, 0, 0, "", 0, False, False) for s in SYMBOLS], cp.SYMBOLS)
    edges = spark.createDataFrame([(*e, None, ["a.py#f", "x"] if e[7] == "ambiguous" else None, None, None, None, None) for e in EDGES], cp.EDGES)
    return cp.Corpus(files, symbols, edges, spark.createDataFrame([], cp.ROUTES))


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_callers(c):
    got = graph.callers(c, "a.py#f", depth=2)
    assert rows(got.filter("status = 'resolved'"), "depth", "symbol") == [(1, "b.py#g"), (1, "tests/test_a.py#test_f"), (2, "c.py#main")]
    assert rows(got.filter("status = 'ambiguous'"), "depth", "symbol", "line") == [(1, "b.py#g", 3)]
    with pytest.raises(ValueError):
        graph.callers(c, "a.py#f", depth=0)


def test_reach_and_tests(c, spark):
    one = graph.reach(c).filter("qualified_name = 'a.py#f'").first()
    assert (one["d1_edges"], one["d1_files"], one["d1_dirs"], one["unresolved_same_name"], one["tests"]) == (2, 2, 2, 1, 1)
    asked = spark.createDataFrame([("a.py#f",), ("a.py#K.m",)], "qualified_name string")
    assert rows(evidence.tests_for(c, asked), "qualified_name", "test_file") == [("a.py#f", "tests/test_a.py")]


def test_unreferenced(c):
    names = {r["qualified_name"] for r in evidence.unreferenced(c).collect()}
    assert "a.py#K.m" not in names and "a.py#f" not in names


def test_plumb(c, spark):
    claims = spark.createDataFrame([("b.py", 2), ("b.py", 3), ("c.py", 1), ("zz.py", 1)], "file string, line int")
    assert rows(evidence.plumb(c, "a.py#f", claims), "file", "line", "verdict") == [("b.py", 2, "confirmed"), ("b.py", 3, "name-only"), ("c.py", 1, "no-call"), ("tests/test_a.py", 2, "missing"), ("zz.py", 1, "not-indexed")]


def test_coverage(c):
    total = evidence.resolution_coverage(c).filter("language = 'all'").first()
    assert (total["edges"], total["calls"], total["resolved"], total["ambiguous"], total["unresolved"]) == (7, 6, 4, 1, 1)


def test_dependents_cycle(c, spark):
    ring = spark.createDataFrame([("calls", "a", x, y, 1, y, "a", "resolved", "import-binding", *[None] * 7) for x, y in (("p", "q"), ("q", "r"), ("r", "p"))], cp.EDGES)
    got = changes.dependents(c.with_edges(ring), spark.createDataFrame([("p",)], "node string"), None)
    assert rows(got, "node", "depth") == [("q", 2), ("r", 1)]


def test_find_text_limits(c):
    assert rows(find_text.matches(c.files, "fox"), "line", "col") == [(1, 4), (2, 0), (2, 4)]
    for bad in (-1, 0.5):
        with pytest.raises(ValueError):
            find_text.find_text(c, "fox", limit=bad)
    with pytest.raises(find_text.PatternRefused):
        find_text.matches(c.files.withColumn("text", F.lit("a" * 40 + "!")), r"(a|aa)+(?:\1)*[b]", budget_ms=300).collect()


def test_same_answer_with_any_partitioning(c):
    spread = cp.Corpus(c.files.repartition(7), c.symbols.repartition(5), c.edges.repartition(8))
    assert c.generation().first() == spread.generation().first()
    assert [tuple(r) for r in search.ask(c, "fox").collect()] == [tuple(r) for r in search.ask(spread, "fox").collect()]


@pytest.mark.parametrize("question", ["fox", "f", "where is K.m of a", "tests of the fox", "nothing", "the"])
def test_stored_index_gives_the_same_scores(c, question):
    index = search.indexed(c)
    names = ["file", "qualified_name", "start_line", "score", "exact"]
    key = lambda df: sorted(((tuple(r[:3]), round(r[3], 9), r[4]) for r in df.select(*names).collect()), key=repr)
    assert repr(key(search.scored(c, question))) == repr(key(search.scored(c, question, index=index)))


def test_map_card(c):
    from quillgraph.operators import card

    whole = card.map_card(c, "demo", stale=2)
    lines = whole.split("\n")
    assert lines[0] == "demo | files 5 | symbols 6 | edges 7 | stale: 2 files" and "hotspots:" in lines and lines[-1] != "hotspots:"
    assert "  a.py#f (in 2 from 2 files, out 0) a.py:1" in lines and not whole.startswith("dropped")
    for most in (len(whole) // 2, 80):
        small = card.map_card(c, "demo", most, stale=None)
        assert len(small) <= most and small.startswith("demo | files 5") and "unavailable" in small and ("dropped: " in small or small.endswith("…"))
    # Hotspots go before hubs, hubs before folders.
    small = card.map_card(c, "demo", len(whole) - 10, stale=2)
    assert "hub " in small and "hotspot lines" in small
    assert card.map_card(c, "demo", 0) == "" and len(card.map_card(c, "demo", 5)) == 5
    with pytest.raises(ValueError):
        card.map_card(c, "demo", -1)


def test_receipts(c):
    got = {(r["from_symbol"], r["line"]): (r["source_hash"], r["target_hash"], r["uncertainty"]) for r in evidence.receipts(c).collect()}
    assert got["b.py#g", 2] == ("b.py", "a.py", None) and got["b.py#g", 4][2] == "receiver-hint-not-runtime-type-proof"
    assert ("c.py#main", 2) in got and len(got) == 5


def test_diff():
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
    d = changes.parse_diff(text)[0]
    assert (d.before, d.after, list(d.old_lines), list(d.new_lines)) == ("x.py", "x.py", [2], [2])
    with pytest.raises(ValueError):
        changes.parse_diff("--- a/x\n+++ b/x\n@@ -1,3 +1,1 @@\n a\n")


def test_empty(spark):
    c = cp.empty(spark)
    assert graph.reach(c).count() == search.ask(c, "nothing").count() == evidence.unreferenced(c).count() == 0


def test_scopes(spark):
    from quillgraph.operators import scopes

    tops = [("package.json", '{"workspaces": ["packages/*", "tool", "!packages/no"]}'), ("packages/a/package.json", "{}"), ("other/package.json", "{}"), ("tool/package.json", "{}"), ("py/pyproject.toml", ""), ("py/setup.py", "")]
    files = spark.createDataFrame([(p, "fallback", "h", 1, 1, t) for p, t in tops], cp.FILES)
    c = cp.empty(spark)
    assert rows(scopes.detected(cp.Corpus(files, c.symbols, c.edges)), "scope", "ecosystem") == [("packages/a", "package.json"), ("py", "pyproject.toml"), ("tool", "package.json")]
    assert scopes.detected(c).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_corpus(spark, n=40, m=400):
    import random

    r = random.Random(5)
    file = lambda k: ("tests/t" if k % 5 == 0 else "src/f") + f"{k % 4}.py"
    name = lambda k: f"{file(k)}#s{k}"
    edges = [("calls", file(a), name(a), f"s{b}", line, name(b), file(b), "resolved", "import-binding", None, None, None, None, None, None, None) for line in range(m) for a, b in [(r.randrange(n), int(n * r.random() ** 2))]]
    symbols = [(name(k), file(k), f"s{k}", "function", k + 1, k + 1, 0, 0, "", 0, False, False) for k in range(n - 3)]
    files = [(p, "python", p, 1, 1, "") for p in sorted({file(k) for k in range(n)})]
    return cp.Corpus(spark.createDataFrame(files, cp.FILES), spark.createDataFrame(symbols, cp.SYMBOLS), spark.createDataFrame(edges, cp.EDGES), spark.createDataFrame([], cp.ROUTES)), edges, [x[0] for x in symbols]


def test_second_level_of_reach_counts_up_to_the_cap_from_counts_by_file(spark, monkeypatch):
    c, edges, symbols = random_corpus(spark)
    for cap in (7, 60, 2_000):
        monkeypatch.setattr(graph, "REACH_CAP", cap)
        want = []
        for s in symbols:
            one = [e for e in edges if e[5] == s]
            callers = {e[2] for e in one if e[2] != s and e[2] in symbols}
            two = sorted((e[5], e[1], e[4]) for e in edges if e[5] in callers)
            want.append((s, len(one), len({e[1] for e in one}), len({e[1].split("/")[0] for e in one}), len({e[1] for e in one if e[1].startswith("tests/")}), min(len(two), cap), len({x[1] for x in two[:cap]}), len(two) > cap))
        got = graph.reach(c, depth=2)
        assert rows(got, "qualified_name", "d1_edges", "d1_files", "d1_dirs", "tests", "d2_edges", "d2_files", "d2_capped") == sorted(want)
    # Edges are dealt out as counts, not once for each thing that is counted.
    assert "Expand" not in plan_of(graph.reach(c)) and "Expand" not in plan_of(c.degree())


def test_walks_with_many_nodes_equal_those_by_name(spark, monkeypatch):
    c, edges, symbols = random_corpus(spark, m=70)
    e = c.edges.select(F.col("to_symbol").alias("src"), F.col("from_symbol").alias("dst"), F.col("to_file").alias("src_file"), F.col("from_file").alias("dst_file"))
    seeds = spark.createDataFrame([(s,) for s in symbols[:6]], "node string")
    run = lambda: (rows(graph.bfs(e, seeds, 3), "node", "depth"), rows(graph.bfs(e.drop("src_file", "dst_file"), seeds, 3), "node", "depth"), rows(changes.dependents(c, seeds, 3), "node", "depth", "via", "path"), rows(graph.callers(c, symbols[0], depth=3), "depth", "file", "line", "node"))
    want = run()
    assert want[0] == want[1] and len(want[2]) > 5
    monkeypatch.setattr(graph, "FEW", 5)
    assert run() == want


def test_tested_symbols_meet_in_no_task_by_their_test_file(spark, monkeypatch):
    c, edges, symbols = random_corpus(spark)
    tests = spark.createDataFrame([("tests/t0.py",), ("tests/t1.py",)], "path string")
    want = []
    for t in ("tests/t0.py", "tests/t1.py"):
        used = sorted({e[5] for e in edges if e[1] == t and e[5] in symbols and not e[6].startswith("tests/")})
        for s in used[:4]:
            lines = sorted(e[4] for e in edges if e[1] == t and e[5] == s)
            want.append((t, s, s.split("#")[0], lines[:2], max(len(lines) - 2, 0), max(len(used) - 4, 0), 0))
    names = ("test_file", "qualified_name", "file", "lines", "omitted_sites", "omitted_symbols", "unresolved_edges")
    got = evidence.symbols_under_test(c, tests, limit=4, sites=2)
    assert rows(got, *names) == sorted(want)
    import re

    assert not [x for x in re.findall(r"Window \[.*?\], \[(\w+)#\d+\]", plan_of(got)) if x == "from_file"]
    monkeypatch.setattr(graph, "FEW", 1)
    assert rows(evidence.symbols_under_test(c, tests, limit=4, sites=2), *names) == sorted(want)


def test_words_are_counted_before_they_are_dealt_out(spark):
    files = spark.createDataFrame([("a.py", "python", "h", 1, 3, "foo bar\nfoo foo\nbar"), ("b.py", "python", "h", 1, 1, "foo"), ("tests/x.py", "python", "h", 1, 1, "foo")], cp.FILES)
    c = cp.Corpus(files, *(spark.createDataFrame([], s) for s in (cp.SYMBOLS, cp.EDGES)))
    names = spark.createDataFrame([("a#foo", "foo", "a.py", 1, 1), ("a#foo", "foo", "a.py", 3, 3), ("b#foo", "foo", "b.py", 1, 1), ("a#bar", "bar", "a.py", 2, 3), ("a#no", "no", "a.py", 1, 1)], "qualified_name string, name string, file string, start_line int, end_line int")
    got = evidence.mentions(c, names)
    assert rows(got, "qualified_name", "mentions") == [("a#bar", 1), ("a#foo", 7), ("a#no", 0), ("b#foo", 3)]
    words = plan_of(got).split("regexp_extract_all(text")[0].rstrip().split("\n")
    assert any("partial_count" in x for x in words[-6:])


def test_index_of_a_plain_corpus_is_counted_in_its_rows(spark):
    texts = [("src/a1.md", "fox FoxDen fox the\nden"), ("src/b.md", ""), ("fox/c.md", "a src 1 " + "x" * 65), ("d.md", None)]
    plain = cp.Corpus(spark.createDataFrame([(p, "fallback", p, 1, 1, t) for p, t in texts], cp.FILES), *(spark.createDataFrame([], s) for s in (cp.SYMBOLS, cp.EDGES)))
    built = search.counted(plain)
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    index, whole = search.counted_index(built), search.indexed(plain, plain=True)
    columns = ("doc", "term", "in_name", "in_signature", "in_documentation", "in_path", "tf")
    assert rows(index.postings, *columns) == rows(whole.postings, *columns)
    assert rows(index.documents, "doc", "file", "len") == rows(whole.documents, "doc", "file", "len")
    for question in ("fox den", "src", "md", "nothing", "where is the"):
        got, want = (sorted((r["file"], round(r["score"], 12), r["exact"]) for r in search.scored(plain, question, plain=True, index=i).collect()) for i in (index, whole))
        assert got == want == sorted((r["file"], round(r["score"], 12), r["exact"]) for r in search.scored(plain, question, plain=True).collect())


def test_task_context(c):
    from quillgraph.operators import context

    whole = context.task_context(c, ["a.py#f"])
    # g calls f, test_f calls f, main calls g; the edge that goes by a hint on the receiver doesn't count.
    assert whole.omitted == {"definitions": 0, "relationships": 0, "tests": 0}
    assert whole.kept == {"definitions": 1, "relationships": 3, "tests": 1} and "test tests/test_a.py" in whole.text
    small = context.task_context(c, ["a.py#f"], mode="change", budget=60)
    assert len(small.text) <= 60 and {k: small.kept[k] + small.omitted[k] for k in small.kept} == whole.kept
    assert context.task_context(c, ["nothing"]).text == ""
    assert "a.py#K:5" in context.task_context(c, "K").text
    with pytest.raises(ValueError):
        context.task_context(c, "K", mode="else")
