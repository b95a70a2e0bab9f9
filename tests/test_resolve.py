"""Imports by manifests, creations and overloads, on one small workspace of several languages."""

import json

import pytest

from quillgraph.operators import resolve, workspace
from quillgraph.sources import code

PROJECT = {
    # Aliases: an extended configuration, an exact key, the longest prefix, two that fit alike, a base folder.
    "web/tsconfig.json": '{ // comment\n  "extends": "./conf/base",\n}',
    "web/conf/base.json": "{}",
    "web/conf/tsconfig.base.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"@/*": ["src/*"], "@/deep/*": ["src/inner/*"], "exact": ["src/one.ts"], "x*": ["a"], "x*z": ["b"]}}}',
    "web/app/tsconfig.json": '{"extends": "../conf/tsconfig.base.json", "compilerOptions": {}}',
    "web/app/main.ts": 'import { one } from "exact";\nimport { two } from "@/two";\nimport { three } from "@/deep/three";\nimport { four } from "src/four";\nimport { bad } from "xyz";\nimport { lib } from "@acme/lib";\nimport { sub } from "@acme/lib/sub";\nimport { z } from "zod/v4";\nimport fs from "node:fs";\nexport function go() { one(); two(); three(); four(); lib(); sub(); z(); missingGlobal(); declared(); }\n',
    "web/src/one.ts": "export function one() {}\n",
    "web/src/two.tsx": "export function two() {}\n",
    "web/src/inner/three/index.ts": "export function three() {}\n",
    "web/src/four.ts": "export function four() {}\n",
    "web/types.d.ts": "declare function declared(): void;\n",
    "web/package-lock.json": json.dumps({"packages": {"": {}, "node_modules/zod": {"version": "3.22.4"}}}),
    "packages/lib/package.json": '{"name": "@acme/lib", "exports": {".": {"types": "./dist/index.d.ts", "default": "./src/index.ts"}, "./*": "./src/*.js"}}',
    "packages/lib/src/index.ts": "export function lib() {}\n",
    "packages/lib/src/sub.ts": "export function sub() {}\n",
    # Roots of Python: a manifest and its src folder; two roots that both have a module.
    "py/pyproject.toml": '[project]\nname = "p"\n',
    "py/src/core/__init__.py": "def core():\n    pass\n",
    "py/tool.py": "import requests\nfrom core import core\nfrom twice import t\n\n\ndef run():\n    core()\n    t()\n    requests.get()\n",
    "py/twice.py": "def t():\n    pass\n",
    "py/src/twice.py": "def t():\n    pass\n",
    "py/requirements-dev.txt": "requests[security]==2.31.0 ; python_version > '3'\n",
    # A module of Go with a package of two files.
    "go/go.mod": "module ex.org/m\n\nrequire github.com/a/b v1.2.3\n",
    "go/util/a.go": "package util\n\nfunc Help() {}\n",
    "go/main.go": 'package main\n\nimport (\n\t"ex.org/m/util"\n\t"github.com/a/b/c"\n\t"fmt"\n)\n\nfunc main() {\n\tutil.Help()\n\tfmt.Println()\n}\n',
    # Crates of Rust.
    "rs/core/Cargo.toml": '[package]\nname = "my-core"\n',
    "rs/core/src/lib.rs": "pub fn base() {}\n",
    "rs/app/Cargo.toml": '[package]\nname = "app"\n[dependencies]\nserde = "1"\n',
    "rs/app/Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.9"\n',
    "rs/app/src/main.rs": "use my_core::base;\nuse crate::util::aid;\nuse serde::Serialize;\nuse std::fmt;\nfn main() {\n    base();\n    aid();\n}\n",
    "rs/app/src/util.rs": "pub fn aid() {}\n",
    # Creations and overloads of Java.
    "j/a/Base.java": "package a;\n\npublic class Base {\n  void act(int x, int y) {\n  }\n  void lone(int x) {\n  }\n  static class Nest {\n  }\n}\n",
    "j/a/Kid.java": "package a;\n\npublic class Kid extends Base {\n  Kid(int x) {\n  }\n  void act(int x) {\n  }\n  void go() {\n    this.act(1);\n    this.act(1, 2);\n    this.lone(1);\n    new Kid(1);\n    new Far(2);\n    new Nest();\n    new Outside();\n    new Base.Nest();\n  }\n}\n",
    "j/b/Far.java": "package b;\n\npublic class Far {\n  Far(int x) {\n  }\n  Far(int x, int y) {\n  }\n}\n",
}
PROJECT["j/a/Kid.java"] = PROJECT["j/a/Kid.java"].replace("package a;\n\n", "package a;\nimport b.*;\n")


@pytest.fixture(scope="module")
def edges(spark):
    files = code.files_of(spark.createDataFrame([(p, t.encode()) for p, t in PROJECT.items()], "path string, content binary"))
    return [r.asDict() for r in code.corpus(files).edges.collect()]


def of(edges, file, kind, name, line=None):
    hits = [e for e in edges if e["from_file"] == file and e["kind"] == kind and e["to_name"] == name and line in (None, e["line"])]
    assert len(hits) == 1, (file, kind, name, hits)
    return hits[0]


def test_aliases_packages_and_ambient_names(edges):
    main = "web/app/main.ts"
    for name, file in {"one": "web/src/one.ts", "two": "web/src/two.tsx", "three": "web/src/inner/three/index.ts", "four": "web/src/four.ts", "lib": "packages/lib/src/index.ts", "sub": "packages/lib/src/sub.ts"}.items():
        assert of(edges, main, "calls", name)["to_symbol"] == f"{file}#{name}", name
    assert of(edges, main, "imports", "xyz")["reason"] == "import-target-ambiguous"
    assert (of(edges, main, "imports", "zod/v4")["external"], of(edges, main, "imports", "node:fs")["external"]) == ("zod@3.22.4", "node:fs")
    assert of(edges, main, "imports", "@acme/lib")["external"] is None


def test_python_roots(edges):
    assert of(edges, "py/tool.py", "calls", "core")["to_symbol"] == "py/src/core/__init__.py#core"
    assert of(edges, "py/tool.py", "imports", "twice")["reason"] == "import-target-ambiguous"
    assert of(edges, "py/tool.py", "imports", "requests")["external"] == "requests@2.31.0"


def test_go_and_rust(edges):
    assert of(edges, "go/main.go", "calls", "util.Help")["to_symbol"] == "go/util/a.go#Help"
    assert of(edges, "go/main.go", "imports", "github.com/a/b/c")["external"] == "github.com/a/b@v1.2.3"
    assert of(edges, "go/main.go", "imports", "fmt")["external"] == "fmt"
    assert of(edges, "rs/app/src/main.rs", "calls", "base")["to_symbol"] == "rs/core/src/lib.rs#base"
    assert of(edges, "rs/app/src/main.rs", "calls", "aid")["to_symbol"] == "rs/app/src/util.rs#aid"
    assert of(edges, "rs/app/src/main.rs", "imports", "serde::Serialize")["external"] == "serde@1.0.9"
    assert of(edges, "rs/app/src/main.rs", "imports", "std::fmt")["external"] == "std"


def test_java_creations(edges):
    kid = "j/a/Kid.java"
    assert (of(edges, kid, "calls", "Kid")["to_symbol"], of(edges, kid, "calls", "Kid")["method"]) == ("j/a/Kid.java#Kid.Kid", "same-file-name")
    far = of(edges, kid, "calls", "Far")
    assert (far["to_symbol"], far["method"], json.loads(far["overload"])) == ("j/b/Far.java#Far.Far", "imported-file-name", {"line": 4})
    assert (of(edges, kid, "calls", "Nest")["to_symbol"], of(edges, kid, "calls", "Nest")["method"]) == ("j/a/Base.java#Base.Nest", "lexical-definition")
    assert of(edges, kid, "calls", "Base.Nest")["to_symbol"] == "j/a/Base.java#Base.Nest"
    assert of(edges, kid, "calls", "Outside")["reason"] == "unbound-global"


def test_overloads_by_number_of_arguments(edges):
    kid = "j/a/Kid.java"
    first, second = sorted((e for e in edges if e["from_file"] == kid and e["to_name"] == "this.act"), key=lambda e: e["line"])
    assert (first["to_symbol"], first["overload"]) == ("j/a/Kid.java#Kid.act", None)
    assert (second["to_symbol"], json.loads(second["overload"])) == ("j/a/Base.java#Base.act", {"line": 4, "from": "j/a/Kid.java#Kid.act"})
    assert of(edges, kid, "calls", "this.lone")["to_symbol"] == "j/a/Base.java#Base.lone"


def test_lock_files():
    facts = lambda p, t: [(f[1], f[2], f[3]) for f in workspace.manifest_facts(p, t) if f[3] != "\t" and f[1].startswith("lock")]
    assert facts("yarn.lock", '"@a/b@^1", "@a/b@~1.0":\n  version "1.0.4"\nzod@^3:\n  version "3.1.0"\nx@1:\n  version "1"\nx@2:\n  version "2"\n') == [("lock:npm", "2:.", "@a/b\t1.0.4"), ("lock:npm", "2:.", "zod\t3.1.0")]
    assert facts("uv.lock", '[[package]]\nname = "My_Pkg"\nversion = "2"\n') == [("lock:python", "0:", "my-pkg\t2")]
    assert facts("Pipfile.lock", '{"default": {"a.b": {"version": "==1"}, "c": {"version": "*"}}}') == [("lock:python", "2:", "a-b\t1")]
    assert facts("go.sum", "x.y/z v1.0.0 h1:aa=\nx.y/z v1.0.0/go.mod h1:bb=\n") == [("lock:go", "1:", "x.y/z\tv1.0.0")]
    assert facts("pnpm-lock.yaml", "importers:\n  pkg/a:\n    dependencies:\n      zod:\n        specifier: ^3\n        version: 3.2.1(x@1)\npackages:\n  '@s/p@1.0.0':\n    a: b\n") == [("lock:npm", "0:pkg/a", "zod\t3.2.1"), ("lock:npm", "0:", "@s/p\t1.0.0")]
    assert workspace.manifest_facts("package.json", "[1") == workspace.manifest_facts("tsconfig.json", "") == []


def test_ambient_names():
    assert resolve.ambient_names('declare const A: string;\nfunction b() {}\ndeclare module "m" { function c(): void }\ndeclare global { interface D {} var e: any }') == {"A", "D", "e"}
    assert resolve.ambient_names("export {};\ndeclare const A: string;\ndeclare global { const G: number }") == {"G"}
    assert resolve.ambient_names("// declare const A: 1\n/* declare const B: 1 */") == set()


CHAINS = {
    "p/a.py": "class Engine:\n    def start(self):\n        return self\n\n    def stop(self):\n        pass\n\n\nclass Car:\n    spare: Engine\n\n    def __init__(self, given: Engine):\n        self.engine = Engine()\n        self.given = given\n\n    def motor(self) -> Engine:\n        return self.engine\n\n    def run(self):\n        self.engine.stop()\n        self.given.start().stop()\n        self.spare.stop()\n\n\ndef built():\n    return Car(None)\n\n\ndef unsure(x):\n    if x:\n        return Car(None)\n    return Engine()\n",
    "p/b.py": "from .a import built, unsure, Car\nimport p.a as q\n\n\ndef go():\n    car = built()\n    car.run()\n    built().motor().stop()\n    car.motor().start().stop()\n    unsure(1).run()\n    q.built().run()\n    m = car.motor()\n    m.stop()\n    Car(None).engine.start()\n",
    "T.java": "class Wheel {\n  void turn() {\n  }\n}\nclass Cart {\n  private Wheel left;\n  void go(Wheel other) {\n    left.turn();\n    other.turn();\n    this.left.turn();\n  }\n}\n",
}


def test_receivers_through_returns_and_fields(spark):
    files = code.files_of(spark.createDataFrame([(p, t.encode()) for p, t in CHAINS.items()], "path string, content binary"))
    got = {(r["from_file"], r["line"], r["to_name"]): r["to_symbol"] for r in code.corpus(files).edges.filter("kind = 'calls'").collect()}
    stop, run = "p/a.py#Engine.stop", "p/a.py#Car.run"
    assert [got["p/a.py", n, t] for n, t in ((20, "self.engine.stop"), (21, "self.given.start.stop"), (22, "self.spare.stop"))] == [stop] * 3
    b = {line: [v for (f, n, _), v in got.items() if f == "p/b.py" and n == line] for line in range(6, 15)}
    assert run in b[7] and stop in b[8] and stop in b[9] and run in b[11] and stop in b[13] and "p/a.py#Engine.start" in b[14]
    assert run not in b[10]
    assert [got["T.java", n, t] for n, t in ((8, "left.turn"), (9, "other.turn"), (10, "this.left.turn"))] == ["T.java#Wheel.turn"] * 3
