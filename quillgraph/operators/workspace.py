"""What manifests say about imports: path aliases, packages, roots, modules, crates, pinned versions.

Manifests are read once, on the executors, to one table of facts (folder, kind, key, value). An import meets the
facts of the folders above its file and of the names it begins with in equi-joins, so neither all manifests nor
all files ever come together; what it may mean is then a short ranked list of paths, joined with the files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.shared import cut

FACTS = "folder string, kind string, key string, value string"
#: Steps of a chain of ``extends``, and of aliases from crate to crate.
CHAIN, ALIASES = 16, 4

# Endings that an import of the JavaScript family may leave out, in order; standard crates of Rust.
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
RUST_STD = ("std", "core", "alloc", "proc_macro", "test")
# Lock files of each ecosystem, the first that a folder has counts.
LOCKS = {"npm": ("pnpm-lock.yaml", "package-lock.json", "yarn.lock"), "python": ("uv.lock", "poetry.lock", "Pipfile.lock", "requirements"), "go": ("go.mod", "go.sum"), "cargo": ("Cargo.lock",)}
# End of the fixed values.

MANIFEST = r"(^|/)((ts|js)config[^/]*\.json|package\.json|go\.mod|go\.sum|Cargo\.(toml|lock)|pyproject\.toml|setup\.(py|cfg)|pnpm-lock\.yaml|package-lock\.json|yarn\.lock|uv\.lock|poetry\.lock|Pipfile\.lock|requirements[^/]*\.txt)$"


def joined(base: str, path: str) -> str | None:
    """A path relative to a folder, with dots taken out; none above the top."""
    out = [x for x in base.split("/") if x]
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def relaxed_json(text: str):
    """JSON with comments and commas at ends; None for anything else."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|,(?=\s*[}\]])')
    plain = token.sub(lambda m: m[0] if m[0][0] == '"' else "", text.removeprefix("\ufeff"))
    try:
        return json.loads(re.sub(r",(\s*[}\]])", r"\1", plain) if plain != text else plain)
    except ValueError:
        return None


def _sections(text: str) -> Iterator[tuple[str, list[str]]]:
    """(header, lines) of the tables of a TOML file."""
    header, lines = "", []
    for line in text.split("\n"):
        if m := re.fullmatch(r"\s*\[(.+)\]\s*(?:#.*)?", line):
            yield header, lines
            header, lines = m[1].strip(), []
        else:
            lines.append(line)
    yield header, lines


def _value(lines: list[str], key: str) -> str | None:
    return next((m[1] for x in lines if (m := re.match(rf'\s*{key}\s*=\s*"([^"]+)"', x))), None)


def _once(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Names that are pinned to one version only."""
    seen: dict[str, set[str]] = {}
    for name, version in pairs:
        seen.setdefault(name, set()).add(version)
    return [(name, next(iter(v))) for name, v in seen.items() if len(v) == 1]


def python_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.lower())


def _at(key: str) -> tuple[str, str] | None:
    """``name@version`` apart; the name may begin with an at sign."""
    k = key.find("@", 1)
    return (key[:k], key[k + 1 :]) if k > 0 else None


def _pnpm(text: str) -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    packages: list[tuple[str, str]] = []
    bare = lambda v: re.sub(r"[(_].*$", "", v.strip().strip("'\""))
    part = importer = dependency = ""
    for line in text.split("\n"):
        depth, word = len(line) - len(line.lstrip()), line.strip()
        if not word or word.startswith("#"):
            continue
        if depth == 0:
            part, importer, dependency = word.rstrip(":"), "", ""
        elif part == "packages" and depth == 2:
            key = word.rstrip(":").strip("'\"").lstrip("/")
            old = re.fullmatch(r"(@?[^@/]+(?:/[^@/]+)?)/(\d.*)", key)
            if pair := _at(key) or (old and (old[1], old[2])):
                packages.append((pair[0], bare(pair[1])))
        elif part == "importers" and depth == 2:
            importer, dependency = re.sub(r":.*$", "", word).strip("'\""), ""
        elif part == "importers" and depth == 6:
            dependency = word.rstrip(":").strip("'\"")
        elif part == "importers" and depth == 8 and dependency and (m := re.match(r"version:\s*(.+)", word)) and re.match(r"\d", bare(m[1])):
            out.append((importer, dependency, bare(m[1])))
    return out + [("", *p) for p in _once(packages)]


def _locked(base: str, text: str) -> list[tuple[str, str, str]]:
    """(importer, name, version) of a lock file; the importer is ``.`` or, in pnpm's, a folder; empty: any."""
    pairs: list[tuple[str, str]] = []
    if base == "pnpm-lock.yaml":
        return _pnpm(text)
    if base in ("package-lock.json", "Pipfile.lock"):
        data = relaxed_json(text)
        data = data if isinstance(data, dict) else {}
        version = lambda e: e.get("version") if isinstance(e, dict) and isinstance(e.get("version"), str) else None
        if base == "Pipfile.lock":
            pairs = [(python_name(n), version(e)[2:]) for s in ("default", "develop") if isinstance(data.get(s), dict) for n, e in data[s].items() if (version(e) or "").startswith("==")]
        elif isinstance(data.get("packages"), dict):
            pairs = [(m[1], version(e)) for k, e in data["packages"].items() if (m := re.fullmatch(r"node_modules/((?:@[^/]+/)?[^/]+)", k)) and version(e)]
        elif isinstance(data.get("dependencies"), dict):
            pairs = [(n, version(e)) for n, e in data["dependencies"].items() if version(e)]
    elif base == "yarn.lock":
        names: list[str] = []
        for line in text.split("\n"):
            if line and line[0] not in "# ":
                names = [p[0] for part in re.sub(r":\s*$", "", line).split(",") if (p := _at(part.strip().strip("'\"")))]
            elif m := re.match(r'\s+version:?\s+"?([^"\s]+)"?', line):
                pairs += [(n, m[1]) for n in names]
    elif base in ("uv.lock", "poetry.lock", "Cargo.lock"):
        for header, lines in _sections(text):
            name, version = _value(lines, "name"), _value(lines, "version")
            if header == "[package]" and name and version:
                pairs.append((name if base == "Cargo.lock" else python_name(name), version))
    elif base == "go.sum":
        pairs = [(m[1], m[2]) for x in text.split("\n") if (m := re.match(r"(\S+)\s+(v\S+?)\s+h1:", x)) and not m[2].endswith("/go.mod")]
    elif base == "go.mod":
        inside = False
        for line in text.split("\n"):
            word = re.sub(r"//.*$", "", line).strip()
            if word == "require (":
                inside = True
            elif word == ")":
                inside = False
            elif m := re.fullmatch(r"(\S+)\s+(v\S+)" if inside else r"require\s+(\S+)\s+(v\S+)", word):
                pairs.append((m[1], m[2]))
    else:
        pairs = [(python_name(m[1]), m[2]) for x in text.split("\n") if (m := re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;\\#]+)", x))]
    return [("." if base in LOCKS["npm"] else "", *p) for p in _once(pairs)]


def _config(path: str, folder: str, text: str) -> tuple[str, str] | None:
    data = relaxed_json(text)
    if not isinstance(data, dict):
        return None
    options = data.get("compilerOptions") if isinstance(data.get("compilerOptions"), dict) else {}
    parents = data.get("extends")
    parents = [p for p in ([parents] if isinstance(parents, str) else parents if isinstance(parents, list) else []) if isinstance(p, str) and p.startswith(("./", "../"))]
    paths = options.get("paths") if isinstance(options.get("paths"), dict) else None
    listed = None if paths is None else json.dumps([[k, [t for t in ([v] if isinstance(v, str) else v if isinstance(v, list) else []) if isinstance(t, str)]] for k, v in paths.items()])
    base = joined(folder, options["baseUrl"]) if isinstance(options.get("baseUrl"), str) else None
    above = [joined(folder, p if p.endswith(".json") else p + ".json") for p in parents]
    return path, json.dumps({"base": base, "paths": listed, "above": above})


def manifest_facts(path: str, text: str) -> list[tuple[str, str, str, str]]:
    """The facts of one manifest."""
    folder, _, base = path.rpartition("/")
    out: list[tuple[str, str, str, str]] = []
    if re.fullmatch(r"(ts|js)config[^/]*\.json", base):
        if found := _config(path, folder, text):
            out.append((folder, "config", *found))
    elif base == "package.json":
        data = relaxed_json(text)
        if isinstance(data, dict) and isinstance(data.get("name"), str) and data["name"]:
            main = [data[k] for k in ("module", "main", "types") if isinstance(data.get(k), str)]
            out.append((folder, "package", data["name"], json.dumps({"main": main} | ({"exports": data["exports"]} if "exports" in data else {}))))
    elif base in ("pyproject.toml", "setup.py", "setup.cfg"):
        out.append((folder, "python", folder, ""))
    elif base == "go.mod" and (m := re.search(r"^\s*module\s+(\S+)", text, re.M)):
        out.append((folder, "go", m[1], ""))
    elif base == "Cargo.toml":
        name = source = None
        needs: list[str] = []
        for header, lines in _sections(text):
            if header == "package":
                name = _value(lines, "name")
            elif header in ("lib", "[bin]") and source is None:
                source = _value(lines, "path")
            table = re.fullmatch(r"(?:workspace\.|target\..+\.)?(?:dev-|build-)?dependencies(?:\.([\w-]+))?", header)
            if table and table[1]:
                needs.append(table[1])
            elif table:
                needs += [m[1] for x in lines if (m := re.match(r"\s*([\w-]+)\s*=", x))]
        src = (joined(folder, source) or "").rpartition("/")[0] if source else f"{folder}/src".lstrip("/")
        out.append((folder, "cargo", (name or "").replace("-", "_"), src))
        out += [(folder, "needs", n.replace("-", "_"), "") for n in needs]
    kind = "requirements" if re.fullmatch(r"requirements[^/]*\.txt", base) else base
    for system, names in LOCKS.items():
        if kind in names:
            place = names.index(kind)
            out += [(folder, f"lock:{system}", f"{place}:{importer}", f"{name}\t{version}") for importer, name, version in _locked(base, text)]
            if kind != "go.mod":
                out.append((folder, f"lock:{system}", f"{place}:", "\t"))
    return out


def _rows(columns: dict[str, list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in schema], names=[n for n, _ in schema])


def facts(files: DataFrame) -> DataFrame:
    """The table of facts of a body of files (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["folder", "kind", "key", "value"]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if re.search(MANIFEST, path):
                    rows += manifest_facts(path, text or "")
                else:
                    # A crate's root may give others a crate under a name of its own.
                    rows += [(path.rpartition("/")[0], "alias", m[2], m[1]) for m in re.finditer(r"^\s*pub(?:\([^)]*\))?\s+(?:extern\s+crate|use)\s+(\w+)\s+as\s+(\w+)\s*;", text or "", re.M)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=names)

    wanted = files.filter(F.col("path").rlike(MANIFEST) | (F.col("path").rlike(r"(^|/)lib\.rs$"))).select("path", "text")
    return cut(wanted.mapInArrow(run, FACTS))


def above(folder: Column) -> Column:
    """A folder and those above it, the top (an empty path) last."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def folder_of(path: str | Column) -> Column:
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, "/?[^/]*$", "")


def _configs(known: DataFrame) -> DataFrame:
    """(folder, base, paths, root) of each configuration that imports look for: its own options, else those of what it extends."""
    c = known.filter("kind = 'config'").select(F.col("key").alias("at"), F.col("folder").alias("dir"), F.from_json("value", "base string, paths string, above array<string>").alias("x"))
    c = cut(c.select("at", "dir", F.col("x.base").alias("base"), F.col("x.paths").alias("paths"), F.col("x.above").alias("up")))
    asked = c.filter(F.substring_index("at", "/", -1).isin("tsconfig.json", "jsconfig.json"))
    # Of what is extended later ones come first, each with what it extends itself: the order of the arrays.
    front = asked.select(F.col("at").alias("of"), "at", F.array().cast("array<int>").alias("rank"))
    seen = None
    for _ in range(CHAIN):
        step = cut(front.join(c, "at"))
        seen = step if seen is None else seen.unionByName(step)
        front = step.select("of", F.posexplode("up").alias("i", "at"), "rank").select("of", "at", F.concat("rank", F.array(-F.col("i"))).alias("rank")).filter("at is not null")
        if front.isEmpty():
            break
    first = lambda c, v: F.min_by(v, F.when(F.col(c).isNotNull(), F.col("rank")))
    has = seen.withColumn("some", F.when(~F.col("paths").isin("[]"), F.col("paths")))
    one = has.groupBy("of").agg(first("base", F.col("base")).alias("base"), first("some", F.struct("paths", "dir")).alias("p"), F.max("base").isNotNull().alias("based"), F.max("some").isNotNull().alias("pathed"))
    one = one.select(F.col("of").alias("at"), F.when(F.col("based"), F.col("base")).alias("base"), F.when(F.col("pathed"), F.col("p")).alias("p"))
    out = one.select(folder_of("at").alias("folder"), F.endswith("at", F.lit("tsconfig.json")).alias("ts"), "base", F.col("p.paths").alias("paths"), F.coalesce("base", F.col("p.dir")).alias("root"))
    return out.groupBy("folder").agg(F.max_by(F.struct("base", "paths", "root"), "ts").alias("c"))


def _nearest(folders: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """(folder, name) with the value of the nearest place (at, value) at or above each folder."""
    each = folders.select("folder", F.explode(above(F.col("folder"))).alias("at")).join(places, "at")
    return each.groupBy("folder").agg(F.max_by("value", F.length("at")).alias(name))


def _probed(base: str) -> list[str]:
    """Paths that a specifier of the JavaScript family may mean, in order."""
    out = [base, *(base + e for e in JS_ENDINGS), *(f"{base}/index{e}" for e in JS_ENDINGS)]
    if m := re.fullmatch(r"(.*)\.([mc]?)js", base):
        out += [m[1] + ".ts", m[1] + ".mts"] + ([] if m[2] else [m[1] + ".tsx"])
    return out


def _aliased(paths: list, spec: str) -> list[str] | None:
    """The targets that aliases give a specifier; None if no alias fits, and an error if two fit equally well."""
    exact = {k: v for k, v in paths}
    if spec in exact:
        return exact[spec]
    fits: dict[int, list[tuple[str, list[str]]]] = {}
    for key, targets in paths:
        head, star, tail = key.partition("*")
        if star and "*" not in tail and len(head) + len(tail) <= len(spec) and spec.startswith(head) and spec.endswith(tail):
            fits.setdefault(len(head), []).append((spec[len(head) : len(spec) - len(tail)], targets))
    if not fits:
        return None
    best = fits[max(fits)]
    if len(best) > 1:
        raise LookupError(spec)
    return [t.replace("*", best[0][0]) for t in best[0][1]]


def _leaves(value) -> list[str]:
    return [value] if isinstance(value, str) else [x for v in (value if isinstance(value, list) else value.values()) for x in _leaves(v)] if isinstance(value, (list, dict)) else []


def _package_paths(folder: str, entry: dict, rest: str) -> list[str]:
    """Paths that a workspace package gives for what stands after its name."""

    def files(targets: list[str]) -> list[str]:
        out = []
        for t in targets:
            if (p := joined(folder, t)) is not None:
                stem = re.sub(r"\.[mc]?jsx?$", "", re.sub(r"\.d\.[cm]?ts$", "", p))
                out += [p, *(stem + e for e in (".ts", ".tsx", ".mts", ".cts") if stem != p), *_probed(p)]
        return out

    if "exports" not in entry:
        return files([*entry["main"], "./index", "./src/index"] if not rest else [f"./{rest}", f"./src/{rest}"])
    table = entry["exports"]
    if not isinstance(table, dict) or not any(k.startswith(".") for k in table):
        table = {".": table}
    sub = f"./{rest}" if rest else "."
    if sub in table:
        targets = _leaves(table[sub])
    else:
        fits = [(len(h), len(t), sub[len(h) : len(sub) - len(t)], v) for k, v in table.items() if k.count("*") == 1 for h, t in [k.split("*")] if sub.startswith(h) and sub.endswith(t) and len(sub) >= len(h) + len(t)]
        best = max(fits, key=lambda f: f[:2], default=None)
        targets = [x.replace("*", best[2]) for x in _leaves(best[3])] if best else []
    source = [t for t in targets if re.search(r"\.[cm]?tsx?$", t) and not re.search(r"\.d\.[cm]?ts$", t)]
    return files(source + [t for t in targets if t not in source])


def _rust_paths(file: str, spec: str, own: str | None, head_src: str | None, rest: list[str] | None) -> list[str]:
    parts = [p for p in spec.split("::") if p]
    here, _, name = file.rpartition("/")
    home = here if name in ("mod.rs", "lib.rs", "main.rs") else f"{here}/{name.removesuffix('.rs')}".lstrip("/")
    last: list[str] = []
    start, todo, least = home, parts, 1
    if parts[0] == "crate":
        if own is None:
            return []
        start, todo, least = own, parts[1:], 0
    elif parts[0] in ("self", "super"):
        k = 0
        while k < len(parts) and parts[k] in ("self", "super"):
            start = start.rpartition("/")[0] if parts[k] == "super" else start
            k += 1
        todo, least = parts[k:], 0
        # What no file holds is a module within this one.
        last, least = ([file], 1) if start == home else (last, least)
    elif head_src is not None:
        start, todo, least = head_src, rest or [], 0
    out = []
    for k in range(len(todo), least - 1, -1):
        p = "/".join(x for x in (start, *todo[:k]) if x)
        out += [f"{p}.rs", f"{p}/mod.rs"] if k else [f"{p}/{n}.rs".lstrip("/") for n in ("lib", "main", "mod")]
    return out + last


def candidates(file: str, fam: str, source: str, c: dict) -> list[tuple[int, int, str, str]]:
    """(group, rank, how, path) of the files that an import may mean: of each group the least rank counts. how: ``path``
    is one, ``suffix`` ends one, ``folder`` holds it; ``several`` says that it can't be told. ``c``: what the manifests say."""
    here = file.rpartition("/")[0]
    one = lambda paths: [(0, k, "path", p) for k, p in enumerate(dict.fromkeys(p for p in paths if p is not None))]
    if fam == "javascript":
        if source.startswith(("./", "../")) or source in (".", ".."):
            base = joined(here, source)
            return [] if base is None else one(_probed(base))
        if source.startswith(("node:", "/")):
            return []
        tried: list[str] = []
        try:
            for target in (_aliased(json.loads(c["paths"]), source) if c.get("paths") else None) or []:
                base = joined(c["root"] or "", target)
                tried += [] if base is None else _probed(base)
        except LookupError:
            return [(0, 0, "several", "")]
        if c.get("base") is not None and (base := joined(c["base"], source)) is not None:
            tried += _probed(base)
        if c.get("package") and not source.startswith("#"):
            p = c["package"]
            tried += _package_paths(p["folder"], json.loads(p["value"]), source[len(p["key"]) + 1 :])
        return one(tried)
    if fam == "python":
        dots = len(source) - len(source.lstrip("."))
        rest = source[dots:].replace(".", "/")
        if dots:
            folder = here.split("/") if here else []
            if dots - 1 > len(folder):
                return []
            base = "/".join([*folder[: len(folder) - dots + 1], *([rest] if rest else [])])
            return one([f"{base}/__init__.py".lstrip("/"), *([base + ".py"] if base else [])])
        out = []
        for k, root in enumerate(dict.fromkeys(c.get("roots") or [""])):
            base = f"{root}/{rest}".lstrip("/")
            out += [(k, 0, "path", f"{base}/__init__.py"), (k, 1, "path", f"{base}.py")]
        return out if rest else []
    if fam == "go":
        m = c.get("module")
        return [] if m is None else [(0, 0, "folder", "/".join(x for x in (m["folder"], source[len(m["key"]) :].strip("/")) if x))]
    if fam == "java":
        return [] if source.endswith("*") else [(0, 0, "suffix", source.replace(".", "/") + ".java")]
    if fam == "rust":
        return one(_rust_paths(file, source, c.get("own"), c.get("head"), c.get("rest"))) if source.strip(":") else []
    if fam == "c":
        base = joined(here, source)
        return [] if base is None else [(0, 0, "path", base), (0, 1, "path", source), (0, 2, "suffix", source)]
    return []


def _contexts(asked: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """``asked`` (file, fam, source) with config, package, roots, module, own (crate), head and rest (of another crate)."""
    a = asked.withColumn("folder", folder_of("file"))
    folders = a.select("folder").distinct()
    configs = _configs(known).select(F.col("folder").alias("at"), F.col("c").alias("value"))
    a = a.join(_nearest(folders, configs, "config"), "folder", "left")

    parts = F.split("source", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    heads = a.filter("fam in ('javascript', 'go') and not startswith(source, '.')").select("fam", "source").distinct().select("fam", "source", F.explode(begins).alias("key"))
    named = known.filter("kind in ('package', 'go')").groupBy(F.when(F.col("kind") == "go", "go").otherwise("javascript").alias("fam"), "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("folder", "key", "value")).alias("x"))
    # A package that two folders claim is neither's.
    longest = heads.join(named, ["fam", "key"]).groupBy("fam", "source").agg(F.max_by(F.struct("n", "x"), F.length("key")).alias("b"))
    found = longest.select("fam", "source", F.when((F.col("fam") == "go") | (F.col("b.n") == 1), F.col("b.x")).alias("named"))
    a = a.join(found, ["fam", "source"], "left")

    python = known.filter("kind = 'python'").select(F.col("folder").alias("at")).distinct()
    src = files.filter("language = 'python'").select(F.explode(above(folder_of("path"))).alias("d")).filter("d = 'src' or endswith(d, '/src')").distinct()
    deep = python.withColumn("d", F.when(F.col("at") == "", "src").otherwise(F.concat("at", F.lit("/src")))).join(src, "d").select("at", F.col("d").alias("root"))
    roots = python.select("at", F.col("at").alias("root")).unionByName(deep)
    of = folders.select("folder", F.explode(above(F.col("folder"))).alias("at")).join(roots, "at").groupBy("folder").agg(F.collect_set("root").alias("more"))
    a = a.join(of, "folder", "left").withColumn("roots", F.array_sort(F.array_union(F.array(F.lit("")), F.coalesce("more", F.array().cast("array<string>"))))).drop("more")

    crates = known.filter("kind = 'cargo'")
    a = a.join(_nearest(folders, crates.select(F.col("folder").alias("at"), F.col("value")), "own"), "folder", "left")
    named_crate = crates.filter("key <> ''").groupBy(F.col("key").alias("word")).agg(F.max("value").alias("head"))
    a = a.withColumn("rest", F.when(F.col("fam") == "rust", F.filter(F.split("source", "::"), lambda x: x != ""))).withColumn("word", F.when(F.size("rest") > 0, F.col("rest")[0]))
    a = a.join(named_crate, "word", "left").withColumn("rest", F.slice("rest", F.lit(2), F.greatest(F.size("rest"), F.lit(1)))).drop("word")
    # A crate may give another one's root under a name of its own; each step takes one part of the path.
    given = known.filter("kind = 'alias'").select(F.col("folder").alias("head"), F.col("key").alias("hop"), F.col("value").alias("word"))
    given = cut(given.join(named_crate.withColumnRenamed("head", "next"), "word").groupBy("head", "hop").agg(F.max("next").alias("next")))
    if not given.isEmpty():
        for _ in range(ALIASES):
            a = a.withColumn("hop", F.when(F.size("rest") > 0, F.col("rest")[0])).join(given, ["head", "hop"], "left")
            a = a.withColumn("rest", F.when(F.col("next").isNotNull(), F.slice("rest", F.lit(2), F.greatest(F.size("rest"), F.lit(1)))).otherwise(F.col("rest"))).withColumn("head", F.coalesce("next", "head")).drop("hop", "next")
    return a


def import_targets(files: DataFrame, wanted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(file, source, to_file, several, external) of distinct imports (file, language, source): the file it means, or whether
    several fit, or the package outside that it names, with the version that the nearest lock file pins."""
    from quillgraph.operators.resolve import family

    known = facts(files) if known is None else known
    asked = cut(wanted.select("file", family("language").alias("fam"), "source").filter("source is not null and source <> ''").distinct())
    told = _contexts(asked, known, files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("file", pa.string()), ("source", pa.string()), ("grp", pa.int32()), ("rank", pa.int32()), ("how", pa.string()), ("cand", pa.string())]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                c = dict(r["config"] or {}) | {"roots": r["roots"], "own": r["own"], "head": r["head"], "rest": r["rest"], ("module" if r["fam"] == "go" else "package"): r["named"]}
                rows += [(r["file"], r["source"], *x) for x in candidates(r["file"], r["fam"] or "", r["source"], c)]
            yield _rows({n: [x[k] for x in rows] for k, (n, _) in enumerate(schema)}, schema)

    tried = cut(told.select("file", "fam", "source", "config", "named", "roots", "own", "head", "rest").mapInArrow(run, "file string, source string, grp int, rank int, how string, cand string"))
    paths = files.select("path", F.substring_index("path", "/", -1).alias("base"), folder_of("path").alias("folder"))
    exact = tried.filter("how = 'path'").join(paths.select("path"), F.col("cand") == F.col("path"))
    ends = tried.filter("how = 'suffix'").withColumn("base", F.substring_index("cand", "/", -1)).join(paths.select("path", "base"), "base").filter((F.col("path") == F.col("cand")) | F.endswith("path", F.concat(F.lit("/"), "cand")))
    go = paths.filter("endswith(path, '.go')").groupBy("folder").agg(F.min(F.struct(F.endswith("path", F.lit("_test.go")).alias("t"), "path")).alias("m")).select(F.col("folder").alias("cand"), F.col("m.path").alias("path"))
    held = tried.filter("how = 'folder'").join(go, "cand")
    keys = ["file", "source", "grp", "rank", "path"]
    hits = exact.select(*keys).unionAll(ends.select(*keys)).unionAll(held.select(*keys)).distinct()
    best = hits.groupBy("file", "source", "grp", "rank").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).groupBy("file", "source", "grp").agg(F.min_by(F.struct("path", "n"), "rank").alias("b"))
    one = best.groupBy("file", "source").agg(F.countDistinct("b.path").alias("paths"), F.max("b.n").alias("n"), F.min("b.path").alias("path"))
    unclear = tried.filter("how = 'several'").select("file", "source").distinct().withColumn("unclear", F.lit(True))
    met = asked.join(one, ["file", "source"], "left").join(unclear, ["file", "source"], "left")
    sure = (F.col("paths") == 1) & (F.col("n") == 1)
    out = cut(met.select("file", "fam", "source", F.when(sure, F.col("path")).alias("to_file"), F.coalesce(F.col("unclear") | (F.col("paths") > 1) | (F.col("n") > 1), F.lit(False)).alias("several")))
    labels = external_labels(out.filter("to_file is null and not several").select("file", "fam", "source"), known, files)
    return out.drop("fam").join(labels, ["file", "source"], "left")


def _package_name(fam: str, source: str) -> Column:
    """The name of the package that a specifier names, by language family; null where it names none."""
    s, f = F.col(source), F.col(fam)
    js = F.when(s.rlike(r"^[./#~]"), None).when(F.startswith(s, F.lit("@")), F.regexp_extract(s, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(s, r"^([^/]+)", 1))
    js = F.when(F.startswith(s, F.lit("node:")), s).when(js.rlike(r"(?i)^(?:@[a-z0-9][\w.-]*/)?[a-z0-9][\w.-]*$"), js)
    python = F.when(~F.startswith(s, F.lit(".")), F.regexp_extract(s, r"^([^.]+)", 1))
    rust = F.regexp_extract(s, r"^(?:::)?([^:]+)", 1)
    name = F.when(f == "javascript", js).when(f == "python", python).when(f == "go", s).when((f == "rust") & ~rust.isin("crate", "self", "super"), rust)
    return F.when(name != "", name)


def external_labels(loose: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """(file, source, external) of imports that no file answers: package, with its version if a lock file above pins one.
    Packages, modules and crates of the workspace itself have no label."""
    e = loose.withColumn("name", _package_name("fam", "source")).filter("name is not null").withColumn("folder", folder_of("file"))
    inside = known.filter("kind in ('package', 'cargo')").select(F.when(F.col("kind") == "cargo", "rust").otherwise("javascript").alias("fam"), F.col("key").alias("name"))
    # The first part of every module below a root of Python.
    roots = known.filter("kind = 'python'").select(F.explode(F.array(F.col("folder"), F.ltrim(F.concat("folder", F.lit("/src")), F.lit("/")))).alias("at")).unionAll(known.sparkSession.createDataFrame([("",)], "at string")).distinct()
    py = files.filter("language = 'python'").select("path", F.explode(above(folder_of("path"))).alias("at")).join(roots, "at")
    tail = F.when(F.col("at") == "", F.col("path")).otherwise(F.expr("substring(path, length(at) + 2)"))
    tops = py.select(F.lit("python").alias("fam"), F.regexp_extract(tail, r"^([^/]+?)(?:/__init__)?\.py$", 1).alias("name")).filter("name <> ''").distinct()
    e = e.join(inside.unionByName(tops).distinct(), ["fam", "name"], "left_anti")

    begins = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), F.lit(1), k), "/"))
    modules = known.filter("kind = 'go'").select(F.col("key").alias("begin")).distinct()
    own = e.filter("fam = 'go'").select("source", F.explode(begins(F.col("source"))).alias("begin")).join(modules, "begin").select("source", F.lit("go").alias("fam")).distinct()
    e = cut(e.join(own, ["fam", "source"], "left_anti"))

    locks = known.filter("startswith(kind, 'lock:')").select(F.col("folder").alias("at"), F.substring("kind", 6, 9).alias("system"), F.split_part("key", F.lit(":"), F.lit(1)).cast("int").alias("place"), F.expr("substring(key, instr(key, ':') + 1)").alias("importer"), F.split_part("value", F.lit("\t"), F.lit(1)).alias("pinned"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("version"))
    firsts = locks.groupBy("at", "system").agg(F.min("place").alias("place"))
    locks = cut(locks.join(firsts, ["at", "system", "place"]).filter("pinned <> ''"))
    system = F.when(F.col("fam") == "javascript", "npm").when(F.col("fam") == "rust", "cargo").otherwise(F.col("fam"))
    e = e.withColumn("system", system)
    near = e.select("folder", "system").distinct().select("folder", "system", F.explode(above(F.col("folder"))).alias("at")).join(firsts, ["at", "system"]).groupBy("folder", "system").agg(F.max_by("at", F.length("at")).alias("at"))
    e = e.join(near, ["folder", "system"], "left")
    wanted = F.when(F.col("fam") == "python", F.regexp_replace(F.lower("name"), "[-_.]+", "-")).otherwise(F.col("name"))
    tried = e.select("file", "source", "folder", "at", "system", F.explode(F.when(F.col("fam") == "go", begins(F.col("source"))).otherwise(F.array(wanted))).alias("pin"))
    pinned = locks.withColumn("pin", F.when(F.col("system") == "cargo", F.replace("pinned", F.lit("-"), F.lit("_"))).otherwise(F.col("pinned")))
    below = F.when(F.col("at") == "", F.col("folder")).when(F.col("folder") == F.col("at"), "").otherwise(F.expr("substring(folder, length(at) + 2)"))
    met = tried.join(pinned, ["at", "system", "pin"]).withColumn("below", below).filter("importer in ('', '.') or below = importer or startswith(below, concat(importer, '/'))")
    rank = F.when(F.col("importer") == "", -1).when(F.col("importer") == ".", 0).otherwise(F.length("importer"))
    best = met.groupBy("file", "source").agg(F.max_by(F.struct("pin", "version"), F.struct(F.length("pin"), rank, "version")).alias("v"))
    declared = known.filter("kind = 'needs'").select(F.col("folder").alias("at"), F.col("key").alias("name")).distinct()
    needs = e.filter("fam = 'rust'").select("file", "source", "name", F.explode(above(F.col("folder"))).alias("at")).join(declared, ["at", "name"]).select("file", "source").distinct().withColumn("needed", F.lit(True))
    out = e.join(best, ["file", "source"], "left").join(needs, ["file", "source"], "left")
    real = (F.col("fam") != "rust") | F.col("name").isin(*RUST_STD) | F.col("needed") | F.col("v").isNotNull()
    label = F.when(F.col("v").isNotNull(), F.concat(F.when(F.col("fam") == "go", F.col("v.pin")).otherwise(F.col("name")), F.lit("@"), F.col("v.version"))).otherwise(F.col("name"))
    return out.filter(F.coalesce(real, F.lit(False))).select("file", "source", label.alias("external")).distinct()
