"""Python sources by the standard library's parser: definitions, raw edges with what binds their names, re-exports, routes.

A name means its innermost binding; parameters and other plain values block it, a name
bound in several ways is ambiguous. A method's first parameter is an instance of its class
(or the class itself), a variable that is assigned a construction once is an instance of
what it constructs, annotated names are instances of what they name.
"""

from __future__ import annotations

import ast
import re

VERBS = frozenset("delete get head options patch post put".split())
#: Package to (verbs, mounts): only receivers that come from these make routes.
FRAMEWORKS = {"flask": (VERBS | {"route"}, {"register_blueprint", "add_url_rule"}), "fastapi": (VERBS | {"api_route", "websocket"}, {"include_router"})}
LONGEST_NAME, LONGEST_PATH = 300, 2048
#: Steps from a name to a receiver that are followed.
CHAIN = 6


def signature(line: str) -> str:
    s = re.sub(r"\s+", " ", line).strip()
    return s if len(s) <= 160 else s[:160] + "…"


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Call):
        return dotted(node.func)
    return ""


class _Scope:
    def __init__(self, kind: str, name: str, parent: _Scope | None):
        self.kind, self.name, self.parent = kind, name, parent
        self.bound: dict[str, list[tuple]] = {}
        self.declared: set[str] = set()

    def bind(self, name: str, what: tuple) -> None:
        have = self.bound.setdefault(name, [])
        if what not in have:
            have.append(what)

    def find(self, name: str) -> list[tuple] | None:
        s: _Scope | None = self
        first = True
        while s is not None:
            if (first or s.kind != "class") and (name in s.bound or "*" in s.bound and s.kind == "module"):
                return s.bound.get(name) or [("blocked", "unsupported")]
            first = False
            s = s.parent
        return None


class Extractor(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.lines = path, text.split("\n")
        self.symbols: list[dict] = []
        self.raw: list[dict] = []
        self.exports: list[dict] = []
        self.routes: list[dict] = []
        self.scope = _Scope("module", "", None)
        self.owner: list[str] = []
        self.classes: list[str] = []
        self.this: list[tuple[str, str, str] | None] = []
        self.fields: list[dict[str, list[dict | None]]] = []

    # Bindings of a scope are collected before its body is walked.
    def _collect(self, body: list[ast.stmt], scope: _Scope, prefix: str) -> None:
        todo: list[ast.AST] = list(body)
        plain: dict[str, list[ast.AST | None]] = {}
        while todo:
            n = todo.pop(0)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                scope.bind(n.name, ("local", f"{prefix}{n.name}", isinstance(n, ast.ClassDef)))
                continue
            if isinstance(n, ast.Lambda):
                continue
            if isinstance(n, ast.Import):
                for a in n.names:
                    scope.bind(a.asname or a.name.split(".")[0], ("import", a.name if a.asname else a.name.split(".")[0], "*"))
            elif isinstance(n, ast.ImportFrom):
                source = "." * n.level + (n.module or "")
                for a in n.names:
                    scope.bind("*" if a.name == "*" else a.asname or a.name, ("blocked", "unsupported") if a.name == "*" else ("import", source, a.name))
            elif isinstance(n, (ast.Global, ast.Nonlocal)):
                for name in n.names:
                    scope.bind(name, ("blocked", "local-value"))
            elif isinstance(n, ast.Match):
                scope.bind("*", ("blocked", "unsupported"))
            elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                plain.setdefault(n.targets[0].id, []).append(n.value)
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                plain.setdefault(n.target.id, []).append(n.annotation if n.value is None or not isinstance(n.value, ast.Call) else n.value)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
                plain.setdefault(n.id, []).append(None)
            elif isinstance(n, ast.ExceptHandler) and n.name:
                plain.setdefault(n.name, []).append(None)
            todo[:0] = [c for c in ast.iter_child_nodes(n) if not (isinstance(n, ast.Assign) and len(n.targets) == 1 and c is n.targets[0] and isinstance(c, ast.Name)) and not (isinstance(n, ast.AnnAssign) and c is n.target)]
        for name, values in plain.items():
            value = values[0]
            made = dotted(value.func) if isinstance(value, ast.Call) else dotted(value) if isinstance(value, (ast.Name, ast.Attribute)) and len(values) == 1 and isinstance(value, ast.Name) and value.id[:1].isupper() else ""
            scope.bind(name, ("instance", made, "constructor", value) if made and len(values) == 1 and isinstance(value, ast.Call) else ("blocked", "local-value"))

    def _meaning(self, name: str) -> tuple:
        found = self.scope.find(name)
        if found is None:
            return ("blocked", "unbound")
        if len(found) > 1:
            local = [f for f in found if f[0] == "local"]
            return local[0] if len(local) == 1 else ("blocked", "ambiguous")
        return found[0]

    def _owner_of(self, node: ast.AST) -> tuple | None:
        """(owner kind, source, name, mode, basis) of what stands left of a dot."""
        if isinstance(node, ast.Name):
            if self.this and self.this[-1] and node.id == self.this[-1][0]:
                return ("local", "", self.this[-1][1], self.this[-1][2], "lexical")
            m = self._meaning(node.id)
            if m[0] == "import":
                return ("module", m[1], "", "class", "class-reference") if m[2] == "*" else ("import", m[1], m[2], "class", "class-reference")
            if m[0] == "local":
                return ("local", "", m[1], "class", "class-reference")
            if m[0] == "instance":
                head, _, rest = m[1].partition(".")
                k = self._meaning(head)
                if k[0] == "local" and not rest:
                    return ("local", "", k[1], "instance", m[2])
                if k[0] == "import":
                    if k[2] == "*" and rest and "." not in rest:
                        return ("import", k[1], rest, "instance", m[2])
                    if k[2] != "*" and not rest:
                        return ("import", k[1], k[2], "instance", m[2])
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id == "super" and self.classes:
                return ("super", "", self.classes[-1], "instance", "lexical")
            inner = dotted(node.func)
            if inner and "." not in inner:
                k = self._meaning(inner)
                if k[0] == "local" and len(k) > 2 and k[2]:
                    return ("local", "", k[1], "instance", "constructor")
                if k[0] == "import" and k[2] != "*":
                    return ("import", k[1], k[2], "instance", "constructor")
        return None

    def _chain(self, node: ast.AST, depth: int = 0) -> tuple[tuple, list[str]] | None:
        """(root, steps) of an expression: what a name means, then ``()`` for each call and ``.name`` for each attribute."""
        if depth > CHAIN:
            return None
        if isinstance(node, ast.Await):
            return self._chain(node.value, depth + 1)
        if isinstance(node, ast.Call):
            inner = self._chain(node.func, depth + 1)
            return inner and (inner[0], [*inner[1], "()"])
        if isinstance(node, ast.Attribute):
            inner = self._chain(node.value, depth + 1)
            if inner and inner[0][0] == "module" and not inner[1]:
                return ("import", inner[0][1], node.attr, "class"), []
            return inner and (inner[0], [*inner[1], "." + node.attr])
        if isinstance(node, ast.Name):
            m = self._meaning(node.id)
            if m[0] == "instance" and len(m) > 3 and not (self.this and self.this[-1] and node.id == self.this[-1][0]):
                return self._chain(m[3], depth + 1)
            o = self._owner_of(node)
            return o and (o[:4], [])
        return None

    def _type(self, node: ast.AST | None) -> dict | None:
        """What an annotation or a construction names: binding, source, imported; ``this`` for the instance itself."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                node = ast.parse(node.value, mode="eval").body
            except SyntaxError:
                return None
        if isinstance(node, ast.Name) and (node.id == "Self" or self.this and self.this[-1] and node.id == self.this[-1][0]):
            return {"binding": "this", "source": None, "imported": None}
        if isinstance(node, (ast.Name, ast.Attribute)):
            b = self._bind(node)
            if b["binding"] in ("local", "import"):
                return {"binding": b["binding"], "source": b.get("source"), "imported": b["imported"]}
        return None

    def _returned(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> dict | None:
        """What a function is annotated to return, else what all its return statements construct."""
        if n.returns is not None:
            return self._type(n.returns)
        found: list[dict | None] = []
        todo: list[ast.AST] = list(n.body)
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            if isinstance(x, (ast.Yield, ast.YieldFrom)):
                return None
            if isinstance(x, ast.Return):
                v = x.value
                found.append(self._type(v.func) if isinstance(v, ast.Call) and isinstance(v.func, (ast.Name, ast.Attribute)) and dotted(v.func).split(".")[-1][:1].isupper() else self._type(v) if isinstance(v, ast.Name) and self.this and self.this[-1] and v.id == self.this[-1][0] else None)
            todo += ast.iter_child_nodes(x)
        return found[0] if found and all(f == found[0] for f in found) else None

    def _bind(self, node: ast.AST) -> dict:
        if isinstance(node, ast.Name):
            m = self._meaning(node.id)
            if m[0] == "import" and m[2] != "*":
                return {"binding": "import", "source": m[1], "imported": m[2]}
            if m[0] == "local":
                return {"binding": "local", "imported": m[1]}
            return {"binding": "blocked", "reason": m[1] if m[0] == "blocked" else "local-value"}
        if isinstance(node, ast.Attribute):
            o = self._owner_of(node.value)
            chain = self._chain(node.value) if o is None or o[4] == "constructor" else None
            if chain and chain[1] not in ([], ["()"]) or chain and o is None and chain[1]:
                root = chain[0]
                return {"binding": "member", "owner": "return", "root": root[0], "source": root[1], "imported": root[2], "member": node.attr, "mode": root[3], "basis": "return", "chain": chain[1]}
            if o is None:
                return {"binding": "blocked", "reason": "unknown-receiver"}
            if o[0] == "module":
                return {"binding": "import", "source": o[1], "imported": node.attr}
            return {"binding": "member", "owner": o[0], "source": o[1], "imported": o[2], "member": node.attr, "mode": o[3], "basis": o[4]}
        return {"binding": "blocked", "reason": "unknown-receiver"}

    def _edge(self, kind: str, name: str, line: int, **more) -> None:
        if name and len(name) <= LONGEST_NAME:
            self.raw.append({"kind": kind, "to_name": name, "line": line, "enclosing": ".".join(self.owner)} | more)

    def _symbol(self, node: ast.AST, name: str, kind: str, member: str | None = None, heritage: list | None = None) -> None:
        local = ".".join([*self.owner, name])
        line = self.lines[node.lineno - 1] if node.lineno <= len(self.lines) else ""
        col = len(line.encode()[: node.col_offset].decode(errors="ignore"))
        last = self.lines[node.end_lineno - 1] if node.end_lineno <= len(self.lines) else ""
        self.symbols.append({"local_name": local, "name": name, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "start_col": col, "end_col": len(last.encode()[: node.end_col_offset].decode(errors="ignore")), "signature": signature(line), "member_kind": member, "heritage": heritage or [], "min_args": None, "max_args": None, "returns": None, "fields": [], "scope": self.scope.name, "exported": self.scope.kind == "module"})

    def run(self, tree: ast.Module) -> None:
        self._collect(tree.body, self.scope, "")
        for n in ast.walk(tree):
            if isinstance(n, ast.ImportFrom) and any(n is x for x in tree.body):
                source = "." * n.level + (n.module or "")
                for a in n.names:
                    self.exports.append({"kind": "star" if a.name == "*" else "named", "exported_name": None if a.name == "*" else a.asname or a.name, "source": source, "imported_name": None if a.name == "*" else a.name, "line": n.lineno})
        for n in tree.body:
            self.visit(n)

    def visit_Import(self, n: ast.Import) -> None:
        for a in n.names:
            self._edge("imports", a.name, n.lineno, binding="import", source=a.name, imported="*")

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        source = "." * n.level + (n.module or "")
        self._edge("imports", source, n.lineno, binding="import", source=source, imported="*")

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        bases = []
        for b in n.bases:
            head = b.value if isinstance(b, ast.Subscript) else b
            bound = self._bind(head)
            bases.append({"name": dotted(head), "binding": bound.get("binding"), "source": bound.get("source"), "imported": bound.get("imported")})
        self._symbol(n, n.name, "class", heritage=bases)
        mine = self.symbols[-1]
        for d in n.decorator_list:
            self._decorator(d)
        local = ".".join([*self.owner, n.name])
        self.owner.append(n.name)
        for b in n.bases:
            head = b.value if isinstance(b, ast.Subscript) else b
            self._edge("extends", dotted(head), b.lineno, **self._bind(head))
        self.classes.append(local)
        outer, self.scope = self.scope, _Scope("class", local, self.scope)
        self._collect(n.body, self.scope, local + ".")
        self.fields.append({x.target.id: [self._type(x.annotation)] for x in n.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)})
        for x in n.body:
            self.visit(x)
        # A field counts if all that is assigned to it agrees.
        mine["fields"] = [{"name": name} | kinds[0] for name, kinds in self.fields.pop().items() if kinds[0] and kinds[0]["binding"] != "this" and all(k == kinds[0] for k in kinds)]
        self.scope = outer
        self.classes.pop()
        self.owner.pop()

    def _function(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        in_class = self.scope.kind == "class"
        marks = {dotted(d).split(".")[-1] for d in n.decorator_list}
        member = None
        if in_class:
            member = "static" if "staticmethod" in marks else "class" if "classmethod" in marks else "property" if marks & {"property", "cached_property"} else "unknown" if marks and not any(dotted(d) in ("abstractmethod", "abc.abstractmethod", "override", "overload") or dotted(d).endswith(".setter") for d in n.decorator_list) else "instance"
        self._symbol(n, n.name, "method" if in_class else "function", member)
        mine = self.symbols[-1]
        for d in n.decorator_list:
            self._decorator(d, ".".join([*self.owner, n.name]))
        self.owner.append(n.name)
        local = ".".join(self.owner)
        a = n.args
        every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *(x for x in (a.vararg, a.kwarg) if x)]
        owner_class = self.classes[-1] if in_class and self.classes else None
        outer, self.scope = self.scope, _Scope("function", local, self.scope)
        first = [*a.posonlyargs, *a.args][:1]
        this = (first[0].arg, owner_class, "class" if member == "class" else "instance") if owner_class and first and member in ("instance", "class", "property") else None
        self.this.append(this if this else self.this[-1] if self.this and not in_class else None)
        self._collect(n.body, self.scope, local + ".")
        for x in every:
            if this and x is first[0]:
                continue
            name = dotted(x.annotation) if x.annotation is not None and not isinstance(x.annotation, ast.Constant) else x.annotation.value if isinstance(x.annotation, ast.Constant) and isinstance(x.annotation.value, str) and re.fullmatch(r"[\w.]+", x.annotation.value) else ""
            self.scope.bound[x.arg] = [("instance", name, "annotation")] if name and x.arg not in self.scope.bound else [("blocked", "local-value")]
        mine["returns"] = self._returned(n)
        if this and this[2] == "instance" and self.fields:
            for x in ast.walk(n):
                t = x.target if isinstance(x, ast.AnnAssign) else x.targets[0] if isinstance(x, ast.Assign) and len(x.targets) == 1 else None
                if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == this[0]:
                    value = x.annotation if isinstance(x, ast.AnnAssign) else x.value.func if isinstance(x.value, ast.Call) else x.value
                    if isinstance(value, ast.Name) and not isinstance(x, ast.AnnAssign) and not isinstance(x.value, ast.Call):
                        m = self._meaning(value.id)
                        value = ast.parse(m[1], mode="eval").body if m[0] == "instance" and m[2] == "annotation" else None
                    self.fields[-1].setdefault(t.attr, []).append(self._type(value))
        for x in [*a.defaults, *(k for k in a.kw_defaults if k)]:
            self.visit(x)
        for x in n.body:
            self.visit(x)
        self.this.pop()
        self.scope = outer
        self.owner.pop()

    visit_FunctionDef = _function
    visit_AsyncFunctionDef = _function

    def _decorator(self, d: ast.expr, handler: str | None = None) -> None:
        target = d.func if isinstance(d, ast.Call) else d
        if isinstance(d, ast.Call) and isinstance(target, ast.Attribute) and handler:
            self._route(d, target, handler)
        self._edge("references", dotted(target), d.lineno, **self._bind(target))
        if isinstance(d, ast.Call):
            for x in [*d.args, *(k.value for k in d.keywords)]:
                self._value(x)
                self.visit(x)

    def _framework(self, node: ast.AST) -> str | None:
        m = self._meaning(node.id) if isinstance(node, ast.Name) else ("", "")
        if m[0] == "instance":
            k = self._meaning(m[1].split(".")[0])
            if k[0] == "import":
                return k[1].split(".")[0] if k[1].split(".")[0] in FRAMEWORKS else None
        return None

    def _route(self, call: ast.Call, target: ast.Attribute, handler: str | None) -> None:
        framework = self._framework(target.value)
        if framework is None:
            return
        verbs, mounts = FRAMEWORKS[framework]
        if target.attr not in verbs and target.attr not in mounts:
            return
        method = "ANY" if target.attr in mounts or target.attr in ("route", "api_route") else "WEBSOCKET" if target.attr == "websocket" else target.attr.upper()
        path = call.args[0].value if call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str) else None
        if path is not None and len(path) > LONGEST_PATH:
            path = None
        self.routes.append({"method": method, "path": path, "line": call.lineno, "handler": handler})
        if handler:
            self._edge("routes", handler.split(".")[-1], call.lineno, binding="local", imported=handler)

    def _value(self, x: ast.expr) -> None:
        """A bare name where a value is meant refers to what it names."""
        if isinstance(x, (ast.Name, ast.Attribute)) and isinstance(x.ctx, ast.Load):
            b = self._bind(x)
            if b["binding"] in ("import", "local", "member"):
                self._edge("references", dotted(x), x.lineno, **b)

    def visit_Call(self, n: ast.Call) -> None:
        name = dotted(n.func)
        if isinstance(n.func, ast.Attribute):
            self._route(n, n.func, dotted(n.args[1]) if len(n.args) > 1 and isinstance(n.args[1], ast.Name) else None) if n.func.attr in ("add_url_rule", "register_blueprint", "include_router") else None
        self._edge("calls", name, n.lineno, arguments=len(n.args) + len(n.keywords), **self._bind(n.func))
        self.visit(n.func)
        for x in [*n.args, *(k.value for k in n.keywords)]:
            self._value(x)
            self.visit(x)

    def visit_Return(self, n: ast.Return) -> None:
        if n.value is not None:
            self._value(n.value)
            self.visit(n.value)

    def visit_Assign(self, n: ast.Assign) -> None:
        for t in n.targets:
            if isinstance(t, ast.Name) and self.scope.kind == "module" and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                self._symbol(n, t.id, "constant")
                self.scope.bound[t.id] = [("local", t.id, False)]
        self._value(n.value)
        self.visit(n.value)
        for t in n.targets:
            self.visit(t)


def extract(path: str, text: str) -> dict:
    """Symbols, raw edges, re-exports, routes and diagnostics of one file. A syntax error leaves only the text."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"symbols": [], "raw": [], "exports": [], "routes": [], "diagnostics": ["extraction-failed"]}
    x = Extractor(path, text)
    try:
        x.run(tree)
    except RecursionError:
        return {"symbols": [], "raw": [], "exports": [], "routes": [], "diagnostics": ["extraction-failed"]}
    return {"symbols": x.symbols, "raw": x.raw, "exports": x.exports, "routes": x.routes, "diagnostics": []}
