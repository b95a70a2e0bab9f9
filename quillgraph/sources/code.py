"""Source code as a corpus: a folder or a table of contents, read, parsed on the executors, and resolved.

Contents come as a table (path, content), so a large body of code is read by Spark's own
sources; ``scan_folder`` makes that table from a workspace on the driver's disk.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus
from quillgraph.plans.shared import cut

#: Bytes from which a file keeps its row but not its text; bytes that are looked at for a zero byte.
LARGEST, HEAD = 1_000_000, 8_192
#: Bytes of an ignore file, and patterns in all.
IGNORE_BYTES, IGNORE_PATTERNS = 1_000_000, 10_000
# File name endings by language.
ENDINGS = {
    "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs jsx", "python": "py", "go": "go", "rust": "rs", "java": "java", "c_sharp": "cs", "c": "c h", "cpp": "cc cpp cxx hpp hh hxx",
    "objc": "m mm", "ruby": "rb", "php": "php", "kotlin": "kt kts", "swift": "swift", "scala": "scala sc", "dart": "dart", "elixir": "ex exs", "ocaml": "ml mli", "zig": "zig", "bash": "sh bash",
}
# Folders that hold no source of the project.
SKIPPED = frozenset(".git .hg .svn node_modules dist build out coverage __pycache__ .venv venv target .next .turbo .cache .gradle obj .idea".split())

SYMBOL = "struct<local_name:string,name:string,kind:string,start_line:int,end_line:int,start_col:int,end_col:int,signature:string,member_kind:string,min_args:int,max_args:int,types:string,overrides:boolean,returns:struct<binding:string,source:string,imported:string>,fields:array<struct<name:string,binding:string,source:string,imported:string>>,scope:string,exported:boolean,heritage:array<struct<name:string,binding:string,source:string,imported:string>>>"
RAW = "struct<kind:string,to_name:string,line:int,enclosing:string,binding:string,source:string,imported:string,owner:string,member:string,mode:string,basis:string,reason:string,arguments:int,constructs:string,root:string,chain:array<string>>"
EXPORT = "struct<kind:string,exported_name:string,source:string,imported_name:string,line:int>"
ROUTE = "struct<method:string,path:string,line:int,handler:string>"
EXTRACTED = f"path string, symbols array<{SYMBOL}>, raw array<{RAW}>, exports array<{EXPORT}>, routes array<{ROUTE}>, diagnostics array<string>"


def language_of(path: Column) -> Column:
    """By the ending; declaration files (``.d.ts``) and unknown endings are ``fallback``."""
    pairs = [F.lit(x) for lang, ends in ENDINGS.items() for e in ends.split() for x in (e, lang)]
    ending = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    return F.when(path.rlike(r"\.d\.[mc]?ts$"), "fallback").otherwise(F.coalesce(F.element_at(F.create_map(*pairs), ending), F.lit("fallback")))


def _pattern(line: str, folder: str) -> tuple[re.Pattern, bool, bool] | None:
    """(expression on paths, negated, folders only) of a line of an ignore file."""
    line = line.rstrip("\n")
    if not line.strip() or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.lstrip("!").rstrip()
    only, line = line.endswith("/"), line.rstrip("/")
    rooted, line = "/" in line, line.lstrip("/")
    body = ""
    for token in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\]|\\.|[^*?\[\\]+|.", line):
        body += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or (token.replace("[!", "[^") if token[0] == "[" and len(token) > 1 else re.escape(token.removeprefix("\\") if len(token) == 2 and token[0] == "\\" else token))
    return re.compile("^" + re.escape(folder) + ("" if rooted else "(?:.*/)?") + body + "$"), negated, only


def scan_paths(root: str, ignore_files: tuple[str, ...] = (".gitignore",)) -> list[str]:
    """Sorted paths below a folder: no hidden files, no links, no folders that hold no sources, nothing that an
    ignore file (of these names, nested ones layered, the last match decides) excludes; ``package.json`` stays."""
    found: list[str] = []
    total = 0

    def walk(folder: str, rules: list) -> None:
        nonlocal total
        here = os.path.join(root, folder)
        for ignore in (os.path.join(here, name) for name in ignore_files):
            if not os.path.isfile(ignore) or os.path.islink(ignore):
                continue
            if os.path.getsize(ignore) > IGNORE_BYTES:
                raise ValueError(f"{ignore} has over {IGNORE_BYTES} bytes")
            with open(ignore, encoding="utf-8", errors="replace") as f:
                own = [p for p in (_pattern(x, folder) for x in f) if p]
            total += len(own)
            if total > IGNORE_PATTERNS:
                raise ValueError(f"over {IGNORE_PATTERNS} ignore patterns")
            rules = [*rules, *own]
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            is_dir = entry.is_dir(follow_symlinks=False)
            if entry.name.startswith(".") or entry.is_symlink() or is_dir and entry.name in SKIPPED:
                continue
            path = folder + entry.name
            out = False
            for expression, negated, only in rules:
                if (is_dir or not only) and expression.match(path):
                    out = not negated
            if out and entry.name != "package.json":
                continue
            if is_dir:
                walk(path + "/", rules)
            elif entry.is_file(follow_symlinks=False):
                found.append(path)

    walk("", [])
    return sorted(found)


def scan_folder(spark: SparkSession, root: str, block: int = 64 << 20) -> DataFrame:
    """(path, content) of a workspace on the driver's disk, sent in blocks of bounded size."""
    out, rows, size = None, [], 0
    schema = "path string, content binary"

    def flush() -> None:
        nonlocal out, rows, size
        part = spark.createDataFrame(rows, schema)
        out = part if out is None else cut(out.unionAll(part))
        rows, size = [], 0

    for path in scan_paths(root):
        with open(os.path.join(root, path), "rb") as f:
            data = f.read()
        rows.append((path, data))
        size += len(data)
        if size >= block:
            flush()
    if rows or out is None:
        flush()
    return out


def files_of(contents: DataFrame) -> DataFrame:
    """Files (path, language, hash, size, line_count, text, diagnostic) of contents (path, content).

    Binary files (a zero byte in their head, or no UTF-8) are ``fallback`` with an empty text, files above the
    largest size keep no text. A null content is an empty file; of rows that repeat a path the largest content stays."""
    c = contents.groupBy("path").agg(F.max(F.coalesce("content", F.lit(b""))).alias("content")).filter("path is not null")
    size = F.octet_length("content")
    text = F.col("content").cast("string")
    binary = (F.instr(F.hex(F.substring("content", 1, HEAD)), "00") > 0) & F.regexp_like(F.hex(F.substring("content", 1, HEAD)), F.lit("^(?:..)*?00")) | ~F.is_valid_utf8(text)
    large = size > LARGEST
    shown = F.when(binary | large, "").otherwise(text)
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = c.select("path", F.when(binary, "fallback").otherwise(language_of(F.col("path"))).alias("language"), F.sha2("content", 256).alias("hash"), size.cast("long").alias("size"), shown.alias("text"), F.when(large, "file-too-large").alias("diagnostic"))
    return out.withColumn("line_count", lines.cast("int")).select("path", "language", "hash", "size", "line_count", "text", "diagnostic")


def extracted(files: DataFrame) -> DataFrame:
    """Symbols, raw edges, re-exports, routes and diagnostics of each file with a language, as nested columns; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillgraph.extract import generic, python_code

        kinds = {f.name: f.type for f in schema}
        for batch in batches:
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
                found = python_code.extract(path, text) if language == "python" else generic.extract(path, text, language)
                yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([found[k]], kinds[k]) for k in ("symbols", "raw", "exports", "routes", "diagnostics"))], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(EXTRACTED))
    # Parsing is the cost, not reading: rows are dealt out so that a few folders don't end in one task.
    todo = files.filter("language <> 'fallback' and text <> ''").select("path", "language", "text")
    return todo.repartition(F.xxhash64("path")).mapInArrow(run, EXTRACTED)


@dataclass(frozen=True)
class Parsed:
    """What extraction found, before names are resolved."""

    files: DataFrame
    symbols: DataFrame
    raw: DataFrame
    exports: DataFrame
    routes: DataFrame
    diagnostics: DataFrame


def parsed(files: DataFrame, nested: DataFrame | None = None) -> Parsed:
    x = cut(extracted(files)) if nested is None else nested
    rows = lambda c: x.select(F.col("path").alias("file"), F.posexplode(c).alias("ord", "x"))
    s = rows("symbols").select("file", "ord", "x.*").withColumn("qualified_name", F.concat("file", F.lit("#"), "local_name"))
    # A name that is declared in several scopes of a file is no sure target.
    scopes = s.groupBy("file", "local_name").agg((F.size(F.collect_set(F.coalesce("scope", F.lit("")))) > 1).alias("shadowed"))
    s = s.join(scopes, ["file", "local_name"])
    language = files.select(F.col("path").alias("file"), "language")
    raw = rows("raw").select("file", "x.*").join(language, "file").withColumn("from_symbol", F.when(F.col("enclosing") == "", "").otherwise(F.concat("file", F.lit("#"), "enclosing")))
    told = x.select("path", F.explode("diagnostics").alias("code")).unionAll(files.filter("diagnostic is not null").select("path", "diagnostic"))
    return Parsed(files, s, raw, rows("exports").select("file", "x.*").join(language, "file"), rows("routes").select("file", "x.method", "x.path", "x.line", "x.handler"), told)


def corpus(files: DataFrame, nested: DataFrame | None = None, edges: DataFrame | None = None) -> Corpus:
    """The corpus of a body of code: extraction, then resolution, unless its edges are known."""
    from quillgraph.operators import resolve

    p = parsed(files, nested)
    symbols = p.symbols.select("qualified_name", "file", "name", "kind", "start_line", "end_line", "start_col", "end_col", "signature", "ord", "shadowed", "exported")
    return Corpus(p.files.drop("diagnostic"), symbols, resolve.resolved(p) if edges is None else edges, p.routes)
