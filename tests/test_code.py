"""Extraction and resolution of small bodies of code."""

from pyspark.sql import functions as F

from quillgraph.operators import changes, evidence, find_text, graph, search
from quillgraph.sources import code

PROJECT = {
    "pkg/__init__.py": "from .a import K as Kay\n",
    "pkg/a.py": "class Base:\n    def run(self):\n        return 1\n\n\nclass K(Base):\n    def stop(self):\n        return self.run()\n\n\ndef f():\n    return K()\n",
    "pkg/b.py": "from .a import K, f as ff\nfrom pkg import Kay\nimport os\n\n\ndef go():\n    k = K()\n    k.run()\n    ff()\n    Kay()\n    nowhere()\n",
    "tests/test_b.py": "from pkg.b import go\n\n\ndef test_go():\n    go()\n",
    "web/a.ts": "export class K {\n  run() { return 1; }\n}\nexport function f() { return new K(); }\n",
    "web/index.ts": 'export * from "./a";\n',
    "web/b.ts": 'import { f } from "./index";\nexport function g() { return f(); }\n',
    "docs/n.md": "Kay runs.\n",
    "bin/x.bin": "\0\1",
}


def rows(df, *c):
    return sorted(tuple(r) for r in df.select(*c).collect())


def files(spark, project):
    return code.files_of(spark.createDataFrame([(p, t.encode()) for p, t in project.items()], "path string, content binary"))


def test_scan_folder(tmp_path, spark):
    for p, t in (PROJECT | {".gitignore": "*.log\n!keep.log\nsecret/\n", "a.log": "x", "keep.log": "y", "secret/s.py": "z = 1", "node_modules/m.js": "1"}).items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert code.scan_paths(str(tmp_path)) == sorted([*PROJECT, "keep.log"])
    assert code.scan_folder(spark, str(tmp_path), block=40).count() == len(PROJECT) + 1


def test_files(spark):
    got = {r["path"]: r for r in files(spark, PROJECT | {"e.py": "", "t.d.ts": "x"}).collect()}
    assert got["pkg/a.py"]["language"] == "python" and got["web/a.ts"]["language"] == "typescript"
    assert got["bin/x.bin"]["language"] == got["t.d.ts"]["language"] == got["docs/n.md"]["language"] == "fallback"
    assert got["bin/x.bin"]["text"] == "" and got["e.py"]["line_count"] == 0 and got["docs/n.md"]["line_count"] == 2


def test_resolution(spark):
    c = code.corpus(files(spark, PROJECT))
    e = {(r["from_symbol"] or r["from_file"], r["kind"], r["to_name"]): r for r in c.edges.collect()}
    def hit(*k):
        return e[k]["to_symbol"], e[k]["method"] or e[k]["reason"]

    assert hit("pkg/b.py#go", "calls", "K") == ("pkg/a.py#K", "import-binding")
    assert hit("pkg/b.py#go", "calls", "ff") == ("pkg/a.py#f", "import-binding")
    assert hit("pkg/b.py#go", "calls", "k.run") == ("pkg/a.py#Base.run", "receiver-hint")
    assert hit("pkg/b.py#go", "calls", "Kay") == ("pkg/a.py#K", "re-export-binding")
    assert hit("pkg/b.py#go", "calls", "nowhere") == (None, "unbound-global")
    assert hit("pkg/a.py#K.stop", "calls", "self.run") == ("pkg/a.py#Base.run", "receiver-hint")
    assert hit("pkg/a.py#K", "extends", "Base") == ("pkg/a.py#Base", "lexical-definition")
    assert hit("web/b.ts#g", "calls", "f") == ("web/a.ts#f", "re-export-binding")
    assert e["pkg/b.py", "imports", "os"]["reason"] == "import-target-unresolved" and e["pkg/b.py", "imports", "os"]["external"] == "os"
    assert e["tests/test_b.py", "imports", "pkg.b"]["to_file"] == "pkg/b.py"
    tests = evidence.tests_for(c, spark.createDataFrame([("pkg/b.py#go",)], "qualified_name string"))
    assert rows(tests, "test_file", "basis") == [("tests/test_b.py", "test-path-and-resolved-edge")]
    assert rows(graph.callers(c, "pkg/a.py#f").filter("status = 'resolved'"), "symbol", "line") == [("pkg/b.py#go", 9)]
    assert search.ask(c, "Base").first()["qualified_name"] == "pkg/a.py#Base"
    found = find_text.find_text(c, "return", fixed=True)
    assert found.agg(F.sum("group_matches")).first()[0] == 6


def test_incremental_equals_full(spark):
    from quillgraph.streaming import refresh

    before = refresh.snapshot(files(spark, PROJECT))
    edited = PROJECT | {"pkg/a.py": PROJECT["pkg/a.py"].replace("def f", "def h"), "pkg/c.py": "from .a import h\n\n\ndef new():\n    h()\n"}
    del edited["web/b.ts"]
    now = files(spark, edited)
    step, full = refresh.applied(before, now).corpus, code.corpus(now)
    assert rows(step.symbols, *step.symbols.columns) == rows(full.symbols, *step.symbols.columns)
    columns = [c for c in full.edges.columns if c != "candidates"]
    text = lambda d: sorted(repr(tuple(r)) for r in d.select(*columns).collect())
    assert text(step.edges) == text(full.edges)
    assert step.generation().first()["generation"] == full.generation().first()["generation"]
    assert rows(changes.freshness(before.corpus.files, now), "path", "change") == [("pkg/a.py", "changed"), ("pkg/c.py", "added"), ("web/b.ts", "deleted")]


def test_partial_resolution_equals_full(spark, monkeypatch):
    from quillgraph.operators import resolve
    from quillgraph.streaming import refresh

    seen = []
    whole = resolve.resolved
    monkeypatch.setattr(resolve, "resolved", lambda p, only=None: (seen.append(only is None or sorted(r[0] for r in only.collect())), whole(p, only))[1])
    before = refresh.snapshot(files(spark, PROJECT))
    before.corpus.edges.count()
    # A body changes, what the file offers doesn't: names of this file alone are resolved again.
    body = PROJECT | {"pkg/b.py": PROJECT["pkg/b.py"].replace("    ff()", "    ff(), K()")}
    step = refresh.applied(before, files(spark, body))
    text = lambda d: sorted(repr(tuple(r)) for r in d.collect())
    assert seen == [True, ["pkg/b.py"]] and text(step.corpus.edges) == text(whole(code.parsed(files(spark, body))))
    # A definition is new: all is resolved again.
    grown = body | {"pkg/a.py": PROJECT["pkg/a.py"] + "\n\ndef nowhere():\n    pass\n"}
    refresh.applied(step, files(spark, grown)).corpus.edges.count()
    assert seen[2:] == [True]


def test_empty(spark):
    c = code.corpus(files(spark, {"x.md": "prose"}))
    assert c.symbols.count() == c.edges.count() == 0


def test_followed_stream(tmp_path, spark):
    from quillgraph.streaming import refresh

    schema = "path string, content binary, deleted boolean, sequence long"
    put = lambda name, rows_: spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    seen = []
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    publish = lambda corpus, number: seen.append(sorted(r["qualified_name"] for r in corpus.symbols.collect()))
    put("a", [("a.py", b"def f():\n    pass\n", False, 1), ("b.py", b"def z():\n    pass\n", None, 1), ("b.py", b"def g():\n    pass\n", None, 2), ("c.py", b"zz = 1\n", False, 1), ("c.py", None, True, 2)])
    refresh.followed(stream(), publish, str(tmp_path / "state")).awaitTermination(120)
    # A deletion after contents, and a content after a deletion, in one batch.
    put("b", [("a.py", b"def zz():\n    pass\n", False, 3), ("a.py", b"", True, 4), ("b.py", None, True, 3), ("b.py", b"def h():\n    pass\n", False, 5)])
    refresh.followed(stream(), publish, str(tmp_path / "state")).awaitTermination(120)
    assert seen == [["a.py#f", "b.py#g"], ["b.py#h"]]


def test_published_versions(tmp_path, spark):
    import pytest

    from quillgraph.corpus import Corpus
    from quillgraph.streaming import refresh

    c = code.corpus(files(spark, {"a.py": "def f():\n    return g()\n\n\ndef g():\n    pass\n"}))
    folder = str(tmp_path / "kept")
    with pytest.raises(FileNotFoundError):
        refresh.loaded(spark, folder)
    refresh.saved(c, folder)
    first = refresh.loaded(spark, folder)
    assert first.generation().first() == c.generation().first()

    class Broken(Corpus):
        @property
        def edges(self):
            raise RuntimeError("the executors are gone")

    broken = object.__new__(Broken)
    broken.__dict__.update(files=c.files, symbols=c.symbols, routes=None)
    with pytest.raises(RuntimeError):  # a crash between two tables: the version before stays
        refresh.saved(broken, folder)
    assert refresh.loaded(spark, folder).generation().first() == c.generation().first()
    for _ in range(3):
        last = refresh.saved(Corpus(c.files, c.symbols, c.edges.limit(0)), folder)
    assert refresh.loaded(spark, folder).edges.count() == 0 and first.files.sparkSession is spark
    assert len(list((tmp_path / "kept" / "versions").iterdir())) == 3  # two published ones, and the broken one
    spark.createDataFrame([("x", "python", "h", 1, 1, "")], c.files.schema if len(c.files.columns) == 6 else "path string, language string, hash string, size bigint, line_count int, text string").write.mode("append").parquet(f"{last}/files")
    with pytest.raises(ValueError, match="isn't what was published"):
        refresh.loaded(spark, folder)
