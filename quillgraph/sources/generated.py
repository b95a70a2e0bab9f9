"""Code written from the star schema's tables: a corpus of five languages of which SQL knows every symbol and edge.

Each nation is a class or function, each supplier a file that uses its nation: through a class of Python that
inherits from its region's, through a path alias and a star export of TypeScript, through a single import, a
constructor and an overload of a base class of Java, a package of Go and a crate of Rust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.adapters import table


def _filled(text: str) -> Column:
    """A text with ``{column}`` filled in."""
    parts = []
    for k, piece in enumerate(text.replace("}", "{").split("{")):
        parts.append(F.lit(piece) if k % 2 == 0 else F.col(piece).cast("string"))
    return F.concat(*parts)


#: Path and text of a file for each supplier (s, n), nation (n, r) and region (r). Braces of the languages are brackets here.
SUPPLIERS = {
    "py/supply/supplier_{s}.py": "from geo.nation_{n} import Nation{n}\n\n\ndef supplier_{s}():\n    home = Nation{n}()\n    return home.name()\n",
    "web/supply/supplier_{s}.ts": 'import ⟨ nation{n} ⟩ from "@geo";\nexport function supplier{s}() ⟨ return nation{n}(); ⟩\n',
    "j/supply/Supplier{s}.java": "package supply;\nimport geo.Nation{n};\npublic class Supplier{s} ⟨\n  void open() ⟨\n    new Nation{n}(1);\n  ⟩\n⟩\n",
    "go/supply/supplier_{s}.go": 'package supply\n\nimport "ex.org/star/geo"\n\nfunc Supplier{s}() int ⟨\n\treturn geo.Nation{n}()\n⟩\n',
    "rs/src/supplier_{s}.rs": "use crate::geo::nation_{n};\npub fn supplier_{s}() -> i32 ⟨\n    nation_{n}()\n⟩\n",
}
NATIONS = {
    "py/geo/nation_{n}.py": "from .region_{r} import Region{r}\n\n\nclass Nation{n}(Region{r}):\n    def name(self):\n        return self.title()\n",
    "j/geo/Nation{n}.java": "package geo;\n\npublic class Nation{n} extends Region{r} ⟨\n  Nation{n}(int a) ⟨\n  ⟩\n  void rank(int a) ⟨\n    this.rank(1, 2);\n  ⟩\n⟩\n",
}
REGIONS = {
    "py/geo/region_{r}.py": "class Region{r}:\n    def title(self):\n        return 1\n",
    "j/geo/Region{r}.java": "package geo;\n\npublic class Region{r} ⟨\n  void rank(int a, int b) ⟨\n  ⟩\n⟩\n",
}
#: Files of one line for each nation, in order, after a first line.
LISTS = {
    "web/geo/nations.ts": ("// nations", "export function nation{n}() ⟨ return {n}; ⟩"),
    "go/geo/nations.go": ("package geo", "func Nation{n}() int ⟨ return {n} ⟩"),
    "rs/src/geo.rs": ("// nations", "pub fn nation_{n}() -> i32 ⟨ {n} ⟩"),
}
ALONE = {
    "py/pyproject.toml": '[project]\nname = "star"\n', "py/geo/__init__.py": "", "web/geo/index.ts": 'export * from "./nations";\n', "web/tsconfig.json": '{"compilerOptions": {"paths": {"@geo": ["geo/index.ts"],},},}',
    "go/go.mod": "module ex.org/star\n", "rs/Cargo.toml": '[package]\nname = "star"\n',
}


def contents(spark: SparkSession, folder: str, moved: bool = False) -> DataFrame:
    """(path, content). ``moved``: every tenth supplier has gone to the next nation."""
    braces = lambda text: text.replace("⟨", "<<").replace("⟩", ">>")
    text = lambda t: F.encode(F.replace(F.replace(_filled(braces(t)), F.lit("<<"), F.lit("{")), F.lit(">>"), F.lit("}")), "utf-8")
    n = F.col("s_nationkey")
    n = F.when(F.col("s_suppkey") % 10 == 0, (n + 1) % 25).otherwise(n) if moved else n
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("s"), n.cast("int").alias("n"))
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    regions = table(spark, folder, "region").select(F.col("r_regionkey").alias("r"))
    out = spark.createDataFrame([(p, t.encode()) for p, t in ALONE.items()], "path string, content binary")
    for rows, files in ((suppliers, SUPPLIERS), (nations, NATIONS), (regions, REGIONS)):
        for path, t in files.items():
            out = out.unionAll(rows.select(_filled(path).alias("path"), text(t).alias("content")))
    for path, (first, line) in LISTS.items():
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text(line).cast("string").alias("t")))), lambda x: x["t"]), "\n")
        out = out.unionAll(nations.agg(F.encode(F.concat(F.lit(first + "\n"), lines, F.lit("\n")), "utf-8").alias("content")).select(F.lit(path).alias("path"), "content"))
    return out
