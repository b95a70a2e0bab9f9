"""Other languages by rules on lines: definitions, spans by braces or indentation, imports, calls.

Comments and strings are blanked first, so braces and names in them don't count. This finds
what a file declares and calls; names are bound by imports, by declarations of the file, by
``this`` and by variables that are assigned a construction once.
"""

from __future__ import annotations

import re

from quillgraph.extract.python_code import LONGEST_NAME, LONGEST_PATH, signature

ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|export|default|declare|partial|readonly|inline|unsafe|extern|const|pub(?:\([^)]*\))?|data|suspend|implicit|lazy|case|mutating|fileprivate|required|convenience|synchronized|native|new|external|factory|late)\s+)*"
_TYPED = rf"^\s*(?!(?:return|else|new|throw|case|await|yield|delete|goto|using|package|import)\b){_MODS}[\w$:<>,\[\]?&*. ]+?[\s&*]+(?P<name>~?{ID})\s*(?:<[^>]*>)?\((?P<args>[^;{{]*)\)[^;=]*(?:\{{|$|=>)"
#: Language to (kind, pattern) in the order in which they are tried on a line.
RULES: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        ("class", rf"^\s*{_MODS}class\s+(?P<name>{ID})"), ("function", rf"^\s*{_MODS}function\s*\*?\s*(?P<name>{ID})"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>{ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{ID})"),
        ("module", rf"^\s*{_MODS}(?:namespace|module)\s+(?P<name>{ID})\s*\{{"), ("type", rf"^\s*{_MODS}type\s+(?P<name>{ID})\s*(?:<[^=]*>)?\s*="),
        ("function", rf"^\s*{_MODS}(?:const|let|var)\s+(?P<name>{ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{ID}\s*=>)"), ("constant", rf"^(?:export\s+)?const\s+(?P<name>{ID})\b"),
        ("method", rf"^\s+{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>#?{ID})\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{"),
    ],
    "go": [("method", rf"^func\s*\(\s*\w*\s*\*?(?P<owner>{ID})[^)]*\)\s*(?P<name>{ID})"), ("function", rf"^func\s+(?P<name>{ID})"), ("struct", rf"^\s*(?:type\s+)?(?P<name>{ID})\s+struct\b"), ("interface", rf"^\s*(?:type\s+)?(?P<name>{ID})\s+interface\b"), ("type", rf"^type\s+(?P<name>{ID})\s"), ("constant", rf"^const\s+(?P<name>{ID})")],
    "rust": [("function", rf"^\s*{_MODS}(?:const\s+)?fn\s+(?P<name>{ID})"), ("struct", rf"^\s*{_MODS}struct\s+(?P<name>{ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{ID})"), ("trait", rf"^\s*{_MODS}trait\s+(?P<name>{ID})"), ("impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:(?P<trait>[\w:<>, ]+?)\s+for\s+)?(?P<name>{ID})"), ("module", rf"^\s*{_MODS}mod\s+(?P<name>{ID})"), ("type", rf"^\s*{_MODS}type\s+(?P<name>{ID})"), ("constant", rf"^\s*{_MODS}(?:const|static)\s+(?P<name>{ID})\s*:")],
    "java": [("class", rf"^\s*{_MODS}(?:class|record)\s+(?P<name>{ID})"), ("interface", rf"^\s*{_MODS}@?interface\s+(?P<name>{ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{ID})"), ("method", rf"^\s+{_MODS}(?P<name>[A-Z]\w*)\s*\((?P<args>[^;{{]*)\)[^;=]*\{{"), ("method", _TYPED)],
    "c_sharp": [("module", rf"^\s*namespace\s+(?P<name>[\w.]+)"), ("class", rf"^\s*{_MODS}(?:class|record)\s+(?P<name>{ID})"), ("struct", rf"^\s*{_MODS}struct\s+(?P<name>{ID})"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>{ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{ID})"), ("method", rf"^\s+{_MODS}(?P<name>[A-Z]\w*)\s*\((?P<args>[^;{{]*)\)[^;=]*(?:\{{|$)"), ("method", _TYPED)],
    "c": [("struct", rf"^\s*(?:typedef\s+)?struct\s+(?P<name>{ID})\s*(?:\{{|$)"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?P<name>{ID})"), ("function", _TYPED)],
    "cpp": [("module", rf"^\s*namespace\s+(?P<name>{ID})"), ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>{ID})[^;]*$"), ("struct", rf"^\s*struct\s+(?P<name>{ID})[^;]*$"), ("enum", rf"^\s*enum\s+(?:class\s+)?(?P<name>{ID})"), ("method", rf"^\s*[\w:<>,&*\s]*?(?P<owner>{ID})::(?P<name>~?{ID})\s*\([^;]*$"), ("function", _TYPED)],
    "objc": [("class", rf"^\s*@(?:interface|implementation)\s+(?P<name>{ID})"), ("interface", rf"^\s*@protocol\s+(?P<name>{ID})"), ("method", rf"^\s*[-+]\s*\([^)]*\)\s*(?P<name>{ID})"), ("function", _TYPED)],
    "ruby": [("module", r"^\s*module\s+(?P<name>[A-Z]\w*)"), ("class", r"^\s*class\s+(?P<name>[A-Z]\w*)"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")],
    "php": [("module", r"^\s*namespace\s+(?P<name>[\w\\]+)"), ("class", rf"^\s*{_MODS}class\s+(?P<name>{ID})"), ("interface", rf"^\s*interface\s+(?P<name>{ID})"), ("trait", rf"^\s*trait\s+(?P<name>{ID})"), ("enum", rf"^\s*enum\s+(?P<name>{ID})"), ("function", rf"^\s*{_MODS}function\s+&?(?P<name>{ID})")],
    "kotlin": [("class", rf"^\s*{_MODS}(?:enum\s+|inner\s+|annotation\s+)?(?:class|object)\s+(?P<name>{ID})"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>{ID})"), ("function", rf"^\s*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?(?P<name>{ID})")],
    "swift": [("class", rf"^\s*{_MODS}(?:class|actor|extension)\s+(?P<name>{ID})"), ("struct", rf"^\s*{_MODS}struct\s+(?P<name>{ID})"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>{ID})"), ("interface", rf"^\s*{_MODS}protocol\s+(?P<name>{ID})"), ("function", rf"^\s*{_MODS}func\s+(?P<name>{ID})")],
    "scala": [("class", rf"^\s*{_MODS}(?:class|object)\s+(?P<name>{ID})"), ("trait", rf"^\s*{_MODS}trait\s+(?P<name>{ID})"), ("function", rf"^\s*{_MODS}def\s+(?P<name>{ID})")],
    "dart": [("class", rf"^\s*{_MODS}(?:class|mixin|extension)\s+(?P<name>{ID})"), ("enum", rf"^\s*enum\s+(?P<name>{ID})"), ("function", _TYPED)],
    "elixir": [("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>\w+[?!]?)")],
    "ocaml": [("module", r"^\s*module\s+(?P<name>[A-Z]\w*)"), ("type", r"^\s*type\s+(?:'\w+\s+)?(?P<name>\w+)"), ("function", r"^\s*let\s+(?:rec\s+)?(?P<name>[a-z_]\w*)\s+[^=\s]"), ("constant", r"^let\s+(?P<name>[a-z_]\w*)\s*=")],
    "zig": [("function", rf"^\s*{_MODS}(?:export\s+)?fn\s+(?P<name>{ID})"), ("struct", rf"^\s*{_MODS}const\s+(?P<name>{ID})\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union)\b"), ("enum", rf"^\s*{_MODS}const\s+(?P<name>{ID})\s*=\s*enum\b")],
    "bash": [("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)"), ("function", r"^\s*function\s+(?P<name>[\w-]+)")],
}
RULES |= {"typescript": RULES["javascript"], "tsx": RULES["javascript"]}
_COMPILED = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in RULES.items()}
_BY_END = ("ruby", "elixir")
_HASH = ("ruby", "elixir", "bash", "php")
_NOT_CALLS = frozenset("if for while switch catch return function sizeof typeof new await super elif elsif unless until match fn func fun def defp and or not in is else do with try except throw raise assert yield delete void case when guard where let var const import from lambda select go defer loop impl struct enum class interface constructor using lock foreach checked nameof".split())
_HOLDERS = ("class", "interface", "struct", "trait", "enum", "impl", "module", "type")
_CALL = re.compile(rf"(?P<new>\bnew\s+)?(?P<name>{ID}(?:(?:\.|::|->|\?\.){ID})*[!?]?)\s*(?:<[\w<>, ]*>)?\(")
_BLANK = {"c": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"), "hash": re.compile(r"#[^\n]*|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"), "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"), "ocaml": re.compile(r"\(\*[\s\S]*?(?:\*\)|\Z)|\"(?:\\.|[^\"\\])*\"")}
_IMPORTS = {
    "javascript": re.compile(r"""^\s*(?:import\s+(?:type\s+)?(?P<what>[\w$*{}\s,]+?)\s+from\s+|import\s*|export\s+(?P<out>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+|(?:const|let|var)\s+(?P<req>[\w${}\s,:]+?)\s*=\s*require\s*\(\s*)["'](?P<source>[^"']+)["']""", re.M),
    "go": re.compile(r"""^\s*(?:import\s+)?(?:(?P<what>[\w.]+)\s+)?"(?P<source>[\w./-]+)"\s*$""", re.M),
    "rust": re.compile(r"^\s*(?P<out>pub(?:\([^)]*\))?\s+)?use\s+(?P<source>[^;]+);", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<source>\w+(?:\.\w+)*(?:\.\*)?)", re.M),
    "c_sharp": re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<source>[\w.]+)\s*;", re.M),
    "c": re.compile(r"^\s*#\s*(?:include|import)\s*[\"<](?P<source>[^\">]+)[\">]", re.M),
    "ruby": re.compile(r"^\s*require(?:_relative)?\s+[\"'](?P<source>[^\"']+)[\"']", re.M),
    "php": re.compile(r"^\s*use\s+(?P<source>[\w\\]+)", re.M),
    "swift": re.compile(r"^\s*import\s+(?P<source>\w+)", re.M),
    "dart": re.compile(r"^\s*(?:import|export)\s+[\"'](?P<source>[^\"']+)[\"']", re.M),
    "elixir": re.compile(r"^\s*(?:alias|import|use|require)\s+(?P<source>[\w.]+)", re.M),
    "ocaml": re.compile(r"^\s*open\s+(?P<source>[\w.]+)", re.M),
    "zig": re.compile(r"@import\(\"(?P<source>[^\"]+)\"\)"),
    "bash": re.compile(r"^\s*(?:source|\.)\s+(?P<source>\S+)", re.M),
}
_IMPORTS |= {"typescript": _IMPORTS["javascript"], "tsx": _IMPORTS["javascript"], "kotlin": _IMPORTS["java"], "scala": _IMPORTS["java"], "cpp": _IMPORTS["c"], "objc": _IMPORTS["c"]}
#: A variable, parameter or field with its declared type.
_DECLARED = {
    "java": re.compile(rf"\b(?P<type>[A-Z]\w*)(?:<[\w<>,? ]*>)?\s+(?P<var>[a-z_]\w*)\s*(?=[=;,):])"),
    "go": re.compile(r"\b(?P<var>[a-z_]\w*)\s+\*?(?P<type>[A-Z]\w*)\b(?!\.)"),
    "rust": re.compile(r"\b(?P<var>[a-z_]\w*)\s*:\s*(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?(?P<type>[A-Z]\w*)\b(?!::|<)"),
    "typescript": re.compile(rf"\b(?P<var>{ID})\??\s*:\s*(?P<type>[A-Z][\w$]*)\b(?![.<\[])"),
}
_DECLARED |= {"c_sharp": _DECLARED["java"], "tsx": _DECLARED["typescript"]}
#: Languages where a type of the same package or namespace needs no import.
_FREE_TYPES = ("java", "c_sharp", "go", "rust")
_VERBS = r"(?P<verb>get|post|put|delete|patch|options|head|all|use)"
_EXPRESS = re.compile(rf"\b(?P<app>{ID})\.{_VERBS}\(\s*(?:[\"'`](?P<path>[^\"'`]*)[\"'`]\s*,)?(?P<rest>[^;\n]*)")
_NEST = re.compile(rf"^\s*@(?P<verb>Get|Post|Put|Delete|Patch|Options|Head|All|Controller)\(\s*(?:[\"'`](?P<path>[^\"'`]*)[\"'`])?")


def blanked(text: str, language: str) -> str:
    """The text without comments and strings, every other sign at its place."""
    rule = _BLANK["hash" if language in _HASH else "rust" if language in ("rust", "zig") else "ocaml" if language == "ocaml" else "c"]
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(lines: list[str], i: int, language: str) -> int:
    """The last line of what starts on line i (from 0)."""
    if language in _BY_END or language == "ocaml":
        depth = len(lines[i]) - len(lines[i].lstrip())
        for j in range(i + 1, len(lines)):
            s = lines[j]
            if s.strip() and len(s) - len(s.lstrip()) <= depth:
                return j if language in _BY_END and s.strip().startswith("end") else j - 1
        return len(lines) - 1
    depth, opened = 0, False
    for j in range(i, len(lines)):
        for c in lines[j]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened and depth == 0:
                return j
        if opened and depth <= 0:
            return j
        if not opened and j - i >= 6:
            return i
    return len(lines) - 1 if opened else i


def _named(what: str | None) -> list[tuple[str, str]]:
    """(own name, imported name) of an import clause."""
    out = []
    for clause in re.findall(r"\{[^}]*\}|\*\s+as\s+[\w$]+|[\w$]+", what or ""):
        if clause.startswith("{"):
            for part in clause[1:-1].split(","):
                m = re.match(r"\s*(?:type\s+)?([\w$]+)(?:\s*(?:as|:)\s*([\w$]+))?", part)
                if m:
                    out.append((m[2] or m[1], m[1]))
        elif clause.startswith("*"):
            out.append((clause.split()[-1], "*"))
        elif clause not in ("type", "from"):
            out.append((clause, "default"))
    return out


def _arity(args: str | None) -> tuple[int | None, int | None]:
    if args is None:
        return None, None
    args = re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\]]*\]", "", args).strip()
    parts = [p for p in args.split(",") if p.strip()] if args else []
    if any("..." in p or re.search(r"\bparams\b", p) for p in parts):
        return sum("..." not in p and not re.search(r"\bparams\b", p) for p in parts), None
    return sum("=" not in p for p in parts), len(parts)


def _types(args: str | None) -> str | None:
    """The written types of a parameter list: each parameter without its name, annotations and default."""
    if args is None:
        return None
    depth, parts, now = 0, [], ""
    for c in args:
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    bare = (re.sub(r"@\w+(?:\([^)]*\))?|\b(?:final|this|params|ref|out|in)\b|=.*$", " ", p).split() for p in [*parts, now])
    return ",".join(" ".join(p[:-1]) for p in bare if p)


def extract(path: str, text: str, language: str) -> dict:
    """Symbols, raw edges, re-exports, routes and diagnostics of one file."""
    out: dict = {"symbols": [], "raw": [], "exports": [], "routes": [], "diagnostics": []}
    rules = _COMPILED.get(language)
    if rules is None:
        return out
    clean = blanked(text, language)
    lines, source = clean.split("\n"), text.split("\n")
    js = language in ("javascript", "typescript", "tsx")
    found: list[dict] = []
    for i, line in enumerate(lines):
        if not line.strip() or len(line) > 2000:
            continue
        for kind, rule in rules:
            m = rule.match(line)
            if not m or m["name"] in _NOT_CALLS:
                continue
            g = m.groupdict()
            low, high = _arity(g.get("args"))
            found.append({"name": m["name"], "kind": kind, "start_line": i + 1, "end_line": _end(lines, i, language) + 1, "start_col": len(line) - len(line.lstrip()), "end_col": 0, "signature": signature(source[i]), "owner": g.get("owner"), "trait": g.get("trait"), "min_args": low, "max_args": high, "types": _types(g.get("args")), "overrides": bool(re.search(r"\boverride\b|@Override\b", " ".join(lines[max(0, i - 2) : i + 1][-(2 if i and lines[i - 1].strip().startswith("@") else 1) :]))), "static": bool(re.search(r"\bstatic\b|def\s+self\.", line)), "exported": bool(re.match(r"\s*(?:export|pub|public)\b", line)) or not js, "line": line})
            break
    # Nesting by containment; a function right inside a holder is a method.
    stack: list[dict] = []
    for d in found:
        while stack and stack[-1]["end_line"] < d["start_line"]:
            stack.pop()
        holder = next((s for s in reversed(stack) if s["kind"] in _HOLDERS or s["kind"] in ("function", "method")), None)
        if d["kind"] == "method" and js and (holder is None or holder["kind"] not in ("class", "interface")):
            d["skip"] = True
            continue
        prefix = d["owner"] or (holder["local_name"] if holder else "")
        if holder is not None and holder["kind"] in ("class", "interface", "struct", "trait", "enum", "impl") and d["kind"] == "function" or holder is not None and language in _BY_END and holder["kind"] == "module" and d["kind"] == "function" and language == "ruby":
            d["kind"] = "method"
        if d["kind"] == "impl":
            d["local_name"] = d["name"] + (f".{re.sub(r'<.*', '', d['trait']).split('::')[-1].strip()}" if d["trait"] else "")
            d["inner"] = True
        else:
            d["local_name"] = f"{prefix}.{d['name']}" if prefix else d["name"]
        member = None
        if d["kind"] == "method":
            member = "static" if d["static"] or language == "rust" and "self" not in d["line"] else "instance"
        d["member_kind"] = member
        heritage = []
        if d["kind"] in ("class", "interface", "struct", "trait"):
            tail = re.sub(r"^.*?\b" + re.escape(d["name"]) + r"\b(?:<[^>]*>)?", "", d["line"])
            for word, names in re.findall(r"(extends|implements|with|:|<)\s*([\w$.,\s<>:]+?)(?=\bimplements\b|\bwith\b|\{|$)", tail):
                if word == "<" and language != "ruby":
                    continue
                for name in re.split(r",", re.sub(r"<[^>]*>|\b(?:public|private|protected|virtual)\b", "", names)):
                    if re.fullmatch(r"\s*[\w$.:]+\s*", name):
                        heritage.append((name.strip(), "implements" if word == "implements" else "extends"))
        d["bases"] = heritage
        stack.append(d)
    defs = [d for d in found if not d.get("skip")]
    top = {d["name"]: d["local_name"] for d in defs if "." not in d["local_name"] and d["kind"] != "impl"}
    bound: dict[str, tuple[str, str]] = {}
    spots: set[tuple[int, str]] = {(d["start_line"], d["name"]) for d in defs}

    def enclosing(line: int) -> str:
        around = [d for d in defs if d["start_line"] <= line <= d["end_line"] and d["kind"] != "impl"]
        return max(around, key=lambda d: (d["start_line"], -d["end_line"]))["local_name"] if around else ""

    def edge(kind: str, name: str, line: int, where: str | None = None, **more) -> None:
        if name and len(name) <= LONGEST_NAME:
            out["raw"].append({"kind": kind, "to_name": name, "line": line, "enclosing": enclosing(line) if where is None else where} | more)

    in_go_block = False
    rule = _IMPORTS.get(language)
    for m in rule.finditer(text) if rule else ():
        line = text.count("\n", 0, m.start("source")) + 1
        g, spec = m.groupdict(), m["source"].strip()
        if language == "go":
            start = text.rfind("import", 0, m.start())
            in_go_block = "import" in m[0] or start >= 0 and ")" not in text[start : m.start()] and "(" in text[start : m.start() + 1]
            if not in_go_block:
                continue
            bound[g.get("what") or spec.split("/")[-1]] = (spec, "*")
        elif js:
            for own, name in _named(g.get("what") or g.get("req")):
                bound[own] = (spec, name if not g.get("req") or name != "default" else "*")
            if g.get("out"):
                star = g["out"].startswith("*")
                if star and "as" in g["out"]:
                    out["exports"].append({"kind": "namespace", "exported_name": g["out"].split()[-1], "source": spec, "imported_name": None, "line": line})
                elif star:
                    out["exports"].append({"kind": "star", "exported_name": None, "source": spec, "imported_name": None, "line": line})
                else:
                    for own, name in _named(g["out"]):
                        out["exports"].append({"kind": "named", "exported_name": own, "source": spec, "imported_name": name, "line": line})
        elif language == "rust":
            for one in _rust_uses(spec):
                own = one.split(" as ")[-1].split("::")[-1].strip()
                target = one.split(" as ")[0].strip()
                base, _, name = target.rpartition("::")
                bound[own] = (base, name)
                if g.get("out"):
                    out["exports"].append({"kind": "star" if name == "*" else "named", "exported_name": None if name == "*" else own, "source": base, "imported_name": None if name == "*" else name, "line": line})
                edge("imports", target, line, "", binding="import", source=base, imported=name)
            continue
        elif language in ("java", "kotlin", "scala"):
            base, _, name = spec.rpartition(".")
            if name != "*":
                bound[name] = (spec, name)
        edge("imports", spec, line, "", binding="import", source=spec, imported="*")
    made = {m[1]: m[2] for m in re.finditer(rf"(?:const|let|var|final|auto)\s+({ID})\s*(?::[^=\n]+)?=\s*new\s+({ID})", clean)}
    made |= {m[2]: m[1] for m in re.finditer(rf"\b([A-Z]\w*)\s+({ID})\s*=\s*new\s+\1\b", clean)}
    made |= {m[1]: m[2] for m in re.finditer(rf"({ID})\s*:=\s*&?([A-Z]\w*)\{{", clean)} | {m[1]: m[2] for m in re.finditer(rf"let\s+(?:mut\s+)?({ID})\s*=\s*([A-Z]\w*)::new\(", clean)}
    # Declared types of variables, parameters and fields, where all declarations of a name in the file agree.
    typed: dict[str, set[str]] = {}
    if language in _DECLARED:
        for m in _DECLARED[language].finditer(clean):
            typed.setdefault(m["var"], set()).add(m["type"])
    for name, kinds in typed.items():
        if len(kinds) == 1 and name not in top and name not in _NOT_CALLS:
            made.setdefault(name, next(iter(kinds)))
        elif len(kinds) > 1:
            made.pop(name, None)
    params = re.compile(rf"({ID})")

    def bind(name: str, line: int) -> dict:
        parts = re.split(r"\.|::|->|\?\.", name.rstrip("!?"))
        head = parts[0]
        if len(parts) == 1:
            if head in bound and bound[head][1] != "*":
                return {"binding": "import", "source": bound[head][0], "imported": bound[head][1]}
            if head in top:
                return {"binding": "local", "imported": top[head]}
            return {}
        if len(parts) == 3 and head in ("this", "self") and parts[1] in typed and parts[1] in made:
            return bind(f"{parts[1]}.{parts[2]}", line)
        if len(parts) != 2:
            return {"binding": "blocked", "reason": "unknown-receiver"} if js or language in ("go", "rust", "java", "c_sharp") else {}
        if head in ("this", "self", "Self"):
            own = enclosing(line).split(".")
            holder = ".".join(own[:-1]) if len(own) > 1 else own[0]
            return {"binding": "member", "owner": "local", "source": "", "imported": holder, "member": parts[1], "mode": "instance", "basis": "lexical"} if holder else {"binding": "blocked", "reason": "unknown-receiver"}
        if head in made:
            c = made[head]
            if c in bound:
                return {"binding": "member", "owner": "import", "source": bound[c][0], "imported": bound[c][1], "member": parts[1], "mode": "instance", "basis": "constructor"}
            if c in top:
                return {"binding": "member", "owner": "local", "source": "", "imported": top[c], "member": parts[1], "mode": "instance", "basis": "constructor"}
            if language in _FREE_TYPES:
                return {"binding": "member", "owner": "local", "source": "", "imported": c, "member": parts[1], "mode": "instance", "basis": "annotation"}
        if head in bound:
            if bound[head][1] == "*":
                return {"binding": "import", "source": bound[head][0], "imported": parts[1]}
            return {"binding": "member", "owner": "import", "source": bound[head][0], "imported": bound[head][1], "member": parts[1], "mode": "class", "basis": "class-reference"}
        if head in top:
            return {"binding": "member", "owner": "local", "source": "", "imported": top[head], "member": parts[1], "mode": "class", "basis": "class-reference"}
        return {"binding": "blocked", "reason": "unknown-receiver"} if js or language in ("go", "rust", "java", "c_sharp") else {}

    for d in defs:
        for base, kind in d["bases"]:
            edge(kind, base, d["start_line"], d["local_name"], **bind(base, d["start_line"]))
        if d["kind"] == "impl":
            if d["trait"]:
                name = re.sub(r"<.*", "", d["trait"]).strip()
                edge("implements", name, d["start_line"], d["name"], **bind(name, d["start_line"]))
            continue
        out["symbols"].append({k: d[k] for k in ("local_name", "name", "kind", "start_line", "end_line", "start_col", "end_col", "signature", "member_kind", "min_args", "max_args", "types", "overrides", "exported")} | {"heritage": [{"name": b} | {k: bind(b, d["start_line"]).get(k) for k in ("binding", "source", "imported")} for b, _ in d["bases"]], "scope": d["local_name"].rpartition(".")[0]})
    frameworks = {own for own, (spec, _) in bound.items() if spec == "express"}
    apps = {m[1] for m in re.finditer(rf"({ID})\s*=\s*(?:{'|'.join(map(re.escape, frameworks)) or '(?!)'})(?:\.\w+)?\(", clean)}
    nest = any(spec == "@nestjs/common" for spec, _ in bound.values())
    for i, line in enumerate(lines):
        if len(line) > 20_000:
            continue
        for m in _CALL.finditer(line):
            name = re.sub(r"::|->|\?\.", ".", m["name"]).rstrip("!?")
            if name in _NOT_CALLS or (i + 1, name.split(".")[-1]) in spots and not m["new"]:
                continue
            rest = line[m.end() :].split(")")[0]
            count = 0 if not rest.strip() else rest.count(",") + 1
            more = {"constructs": name} if m["new"] else {}
            edge("calls", name, i + 1, arguments=count, **bind(m["name"], i + 1), **more)
        if apps:
            for m in _EXPRESS.finditer(source[i]):
                if m["app"] in apps and (m["path"] is not None or m["verb"] == "use"):
                    last = params.findall(m["rest"] or "")
                    handler = last[-1] if last and re.fullmatch(rf"\s*(?:{ID}\s*,\s*)*{ID}\s*\)?\s*", m["rest"]) else None
                    path_of = m["path"] if m["path"] is None or len(m["path"]) <= LONGEST_PATH else None
                    verb = "ANY" if m["verb"] in ("all", "use") else m["verb"].upper()
                    out["routes"].append({"method": verb, "path": path_of, "line": i + 1, "handler": handler if handler in top else None})
                    if handler:
                        edge("routes", handler, i + 1, **bind(handler, i + 1))
                    elif m["verb"] != "use":
                        edge("routes", m["verb"], i + 1, binding="blocked", reason="inline-handler")
        if nest and (m := _NEST.match(source[i])):
            owner = next((d for d in defs if d["start_line"] > i + 1), None)
            if owner is not None:
                out["routes"].append({"method": "ANY" if m["verb"] in ("All", "Controller") else m["verb"].upper(), "path": m["path"], "line": i + 1, "handler": owner["local_name"]})
                edge("routes", owner["name"], i + 1, binding="local", imported=owner["local_name"])
    if js:
        for own in {d["name"] for d in defs if d["exported"] and "." not in d["local_name"]} | {a for m in re.finditer(r"^\s*export\s*\{([^}]*)\}\s*;?\s*$", clean, re.M) for a, _ in _named("{" + m[1] + "}")}:
            for s in out["symbols"]:
                if s["local_name"] == own:
                    s["exported"] = True
    return out


def _rust_uses(spec: str) -> list[str]:
    """The single paths of a use tree."""
    m = re.match(r"^(.*?)\{(.*)\}\s*$", spec, re.S)
    if not m:
        return [re.sub(r"\s+", " ", spec)]
    parts, depth, now = [], 0, ""
    for c in m[2]:
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    return [x for p in [*parts, now] if p.strip() for x in _rust_uses(m[1].strip() + ("" if p.strip() != "self" else "") + p.strip())]
