"""Raw edges to definitions: joins in tiers, each with a test for uniqueness; evidence on every edge, never a guess.

Holders of a name are gathered once per (file, name) and per (family, name), with their
number and the first few; edges meet those rows and never each single holder, so a name that
many files define costs no more than one that one does.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus
from quillgraph.operators.workspace import facts, import_targets

#: Languages that see each other's definitions.
FAMILIES = {"typescript": "javascript", "tsx": "javascript", "javascript": "javascript", "c": "c", "cpp": "c", "objc": "c", "java": "java", "kotlin": "java", "scala": "java"}
#: Families where a plain name without holder is known to be none of the code's.
TYPED = ("go", "rust", "java", "c_sharp")
#: Candidates that an ambiguous edge lists.
LISTED = 50
#: Re-export steps that are followed; a chain that is longer stays unresolved.
HOPS = 128
ENDS = {"references": ("function", "method", "class"), "extends": ("class", "interface", "struct", "trait", "type"), "implements": ("class", "interface", "struct", "trait", "type")}


def family(language) -> F.Column:
    c = F.col(language) if isinstance(language, str) else language
    out = c
    for k, v in FAMILIES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _holders(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, names): how many distinct symbols a name has, and the first few of them."""
    each = symbols.select(*keys, "qualified_name", "sfile").distinct()
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(F.struct("qualified_name", "sfile"))), 1, LISTED).alias("names"))


def by_name(corpus: Corpus, edges: DataFrame | None = None) -> DataFrame:
    """Edges that no binding resolves, by the last part of their name: a symbol of the same file, else of a file that
    is imported, else of the whole language family. One holder: resolved; several: ambiguous; none: unresolved."""
    e = corpus.edges if edges is None else edges
    lang = corpus.files.select(F.col("path").alias("f"), family("language").alias("fam"))
    s = corpus.symbols.join(lang, F.col("file") == F.col("f"))
    if "scope" in s.columns:
        # A plain name of Rust never means a member of a type.
        holds = corpus.symbols.filter("kind in ('class', 'interface', 'struct', 'trait', 'enum', 'impl')").select("file", F.col("local_name").alias("scope")).distinct().withColumn("inside", F.lit(True))
        s = s.join(holds, ["file", "scope"], "left").withColumn("bare", ~F.coalesce(F.col("inside") & (F.col("fam") == "rust"), F.lit(False)))
    else:
        s = s.withColumn("bare", F.lit(True))
    rust = F.col("fam") == "rust"
    both = F.when(rust & F.col("bare"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.coalesce(rust, F.lit(False))))
    s = s.select("name", "qualified_name", F.col("file").alias("sfile"), "fam", "kind", F.explode(both).alias("dotted"))
    here = e.join(lang, F.col("from_file") == F.col("f"), "left").drop("f").withColumn("key", F.element_at(F.split("to_name", r"\."), -1)).withColumn("dotted", F.coalesce((F.col("fam") == "rust") & F.contains("to_name", F.lit(".")), F.lit(False)))
    own = _holders(s.withColumn("from_file", F.col("sfile")).withColumnRenamed("name", "key"), ["from_file", "key", "dotted"]).withColumnsRenamed({"n": "n1", "names": "l1"})
    imported = corpus.edges.filter("kind = 'imports' and to_file is not null").select("from_file", F.col("to_file").alias("sfile")).distinct()
    wanted = here.select("from_file", "key", "dotted").distinct().join(imported, "from_file").join(s.withColumnRenamed("name", "key").select("key", "dotted", "sfile", "qualified_name"), ["sfile", "key", "dotted"])
    near = _holders(wanted, ["from_file", "key", "dotted"]).withColumnsRenamed({"n": "n2", "names": "l2"})
    far = _holders(s.withColumnRenamed("name", "key"), ["fam", "key", "dotted"]).withColumnsRenamed({"n": "n3", "names": "l3"})
    met = here.join(own, ["from_file", "key", "dotted"], "left").join(near, ["from_file", "key", "dotted"], "left").join(far, ["fam", "key", "dotted"], "left")
    n, names = F.coalesce("n1", "n2", "n3"), F.coalesce("l1", "l2", "l3")
    method = F.when(F.col("n1").isNotNull(), "same-file-name").when(F.col("n2").isNotNull(), "imported-file-name").when(F.col("n3").isNotNull(), "unique-name")
    none = F.when(F.col("fam").isin(*TYPED), "unbound-global").otherwise("no-matching-symbol")
    one = n == 1
    listed = F.transform(names, lambda x: x["qualified_name"])
    return met.select("kind", "from_file", "from_symbol", "to_name", "line", F.when(one, names[0]["qualified_name"]).alias("to_symbol"), F.when(one, names[0]["sfile"]).alias("to_file"), F.when(one, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"), F.when(one, method).alias("method"), F.when(n.isNull(), none).alias("reason"), F.lit(None).cast("string").alias("external"), F.when(n > 1, listed).alias("candidates"), "binding", "arguments", "constructs")


def kept_kinds(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """References that resolve to nothing are dropped; references and supertypes must end at kinds that fit."""
    kind = symbols.groupBy(F.col("qualified_name").alias("to_symbol")).agg(F.first("kind").alias("k"))
    e = edges.join(kind, "to_symbol", "left")
    fits = F.lit(True)
    for k, ends in ENDS.items():
        fits = fits & ((F.col("kind") != k) | F.col("to_symbol").isNull() | F.col("k").isin(*ends))
    lost = ~fits
    e = e.withColumns({"status": F.when(lost, "unresolved").otherwise(F.col("status")), "reason": F.when(lost, "no-matching-symbol").otherwise(F.col("reason")), "method": F.when(~lost, F.col("method")), "to_file": F.when(~lost, F.col("to_file")), "to_symbol": F.when(~lost, F.col("to_symbol"))})
    return e.filter("not (kind = 'references' and status <> 'resolved')").drop("k").select(edges.columns)


# What follows resolves edges that carry a binding: imports, exports, definitions of the file, members.

#: Supertypes that a member is looked for through at most.
HERITAGE = 8


def exported(symbols: DataFrame, exports: DataFrame, hops: int = HOPS) -> DataFrame:
    """(file, name, n, qualified_name, to_file, hops): what a name means that a file exports, through re-exports.

    exports: (file, kind, exported_name, imported_name, to_file). A file's own definition or named link goes before
    its star links, which never forward ``default``; a chain is followed until nothing new is found, cycles end there."""
    from quillgraph.plans.shared import cut

    own = symbols.filter("exported and scope = ''").select("file", "name", "qualified_name", F.col("file").alias("to_file"), F.lit(0).alias("hops")).distinct()
    links = cut(exports.filter("to_file is not null and kind in ('named', 'star')").select("file", "kind", "exported_name", "imported_name", F.col("to_file").alias("far")).distinct())
    taken = own.select("file", "name").unionAll(links.filter("kind = 'named'").select("file", F.col("exported_name").alias("name"))).distinct()
    seen = frontier = cut(own)
    if not links.isEmpty():
        for step in range(1, hops + 1):
            f = frontier.select(F.col("file").alias("far"), F.col("name").alias("far_name"), "qualified_name", "to_file")
            named = links.filter("kind = 'named'").join(f, (links["far"] == f["far"]) & (F.col("imported_name") == F.col("far_name"))).select("file", F.col("exported_name").alias("name"), "qualified_name", "to_file")
            star = links.filter("kind = 'star'").join(f.filter("far_name <> 'default'"), "far").select("file", F.col("far_name").alias("name"), "qualified_name", "to_file").join(taken, ["file", "name"], "left_anti")
            new = cut(named.unionAll(star).distinct().join(seen.select("file", "name", "qualified_name"), ["file", "name", "qualified_name"], "left_anti").withColumn("hops", F.lit(step)))
            if new.isEmpty():
                break
            seen, frontier = seen.unionAll(new), new
    return seen.groupBy("file", "name").agg(F.count_distinct("qualified_name").alias("n"), F.min("qualified_name").alias("qualified_name"), F.min("to_file").alias("to_file"), F.max("hops").alias("hops"), F.slice(F.array_sort(F.collect_set("qualified_name")), 1, LISTED).alias("names"))


def _classes(bindings: DataFrame, targets: DataFrame, exports: DataFrame, symbols: DataFrame, language: DataFrame) -> DataFrame:
    """Adds ``holder``: the qualified name that (file, kind of binding, source, imported) means, null if it isn't sure; and
    ``outside``: no file of the family has a symbol of that name. In families that need no import of a type its only holder counts."""
    local = symbols.filter("not shadowed").select("file", F.col("local_name").alias("imported"), F.col("qualified_name").alias("q1")).distinct()
    far = targets.filter("to_file is not null").select("file", "source", F.col("to_file").alias("tf"))
    named = exports.filter("n = 1").select(F.col("file").alias("tf"), F.col("name").alias("imported"), F.col("qualified_name").alias("q2"))
    b = bindings.join(local, ["file", "imported"], "left").join(far, ["file", "source"], "left").join(named, ["tf", "imported"], "left")
    b = b.join(language.select("file", family("language").alias("fam")), "file", "left").withColumn("word", F.substring_index("imported", ".", -1)).join(_unique_holders(symbols, language), ["fam", "word"], "left")
    mine = symbols.select("file", F.col("local_name").alias("imported")).distinct().withColumn("own", F.lit(True))
    b = b.join(mine, ["file", "imported"], "left")
    holder = F.when(F.col("how") == "import", F.col("q2")).when(F.col("own"), F.col("q1")).when(F.col("how") == "local", F.col("q3"))
    return b.withColumn("holder", holder).withColumn("outside", (F.col("how") == "local") & F.col("known").isNull()).drop("q1", "q2", "q3", "tf", "fam", "word", "known", "own")


def callables(symbols: DataFrame) -> DataFrame:
    """(at, member, qualified_name) of what a holder can be asked for."""
    return symbols.filter("scope <> '' and kind in ('method', 'function', 'constant')").select(F.concat("file", F.lit("#"), "scope").alias("at"), F.col("name").alias("member"), "qualified_name").distinct()


def members(asked: DataFrame, own: DataFrame, heritage: DataFrame, most: int = HERITAGE) -> DataFrame:
    """(holder, member, n, qualified_name) for asked (holder, member): own members first, then those of the supertypes, level by level.

    own: (at, member, qualified_name). heritage: (holder, base), base null where a supertype is unknown; that leaves a member
    open (n is 0), and two bases that differ leave it ambiguous."""
    from quillgraph.plans.shared import cut

    own = own.distinct()
    open_ = cut(asked.select("holder", "member", F.col("holder").alias("at")).distinct())
    done = None
    for _ in range(most + 1):
        met = open_.join(own, ["at", "member"], "left")
        hits = cut(met.filter("qualified_name is not null").select("holder", "member", "qualified_name"))
        up = open_.join(hits.select("holder", "member"), ["holder", "member"], "left_anti").join(heritage.withColumnRenamed("holder", "at"), "at").select("holder", "member", F.col("base").alias("at"))
        lost = up.filter("at is null").select("holder", "member").distinct()
        hits = hits.unionAll(lost.select("holder", "member", F.lit(None).cast("string")))
        done = hits if done is None else done.unionAll(hits)
        open_ = cut(up.join(lost, ["holder", "member"], "left_anti").distinct())
        if open_.isEmpty():
            break
    found = F.when(F.count_if(F.col("qualified_name").isNull()) > 0, 0).otherwise(F.count_distinct("qualified_name"))
    return done.groupBy("holder", "member").agg(found.alias("n"), F.min("qualified_name").alias("qualified_name"))


#: Steps from a name to a receiver that are followed.
CHAIN = 6


def receivers(chains: DataFrame, symbols: DataFrame, targets: DataFrame, names: DataFrame, heritage: DataFrame, language: DataFrame) -> DataFrame:
    """(file, how, source, imported, mode, chain, holder): the class of what a chain of calls and attributes gives, null if it isn't sure.

    A step at a time: a call takes what a function returns (or makes an instance of a class), an attribute a member or
    the declared type of a field. Functions of one name must agree on what they return."""
    from quillgraph.plans.shared import cut

    holds = ("class", "interface", "struct", "trait", "enum")
    kinds = symbols.groupBy(F.col("qualified_name").alias("at")).agg(F.first("kind").alias("kind"))
    meant = lambda df: _classes(df, targets.drop("several", "external"), names, symbols, language)
    r = symbols.filter("returns is not null").select("file", F.col("qualified_name").alias("callee"), F.col("returns.binding").alias("how"), F.col("returns.source").alias("source"), F.col("returns.imported").alias("imported"))
    given = meant(r.filter("how <> 'this'")).select("callee", F.col("holder").alias("ret")).unionByName(r.filter("how = 'this'").select("callee", F.lit("this").alias("ret")))
    declared = symbols.filter("kind in ('function', 'method')").groupBy(F.col("qualified_name").alias("callee")).agg(F.count(F.lit(1)).alias("all"))
    returns = cut(given.filter("ret is not null").groupBy("callee").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ret").alias("kinds"), F.min("ret").alias("ret")).join(declared, "callee").filter("kinds = 1 and n = all").select("callee", "ret"))
    f = symbols.filter("size(fields) > 0").select("file", "qualified_name", F.explode("fields").alias("x")).select("file", F.col("qualified_name").alias("at"), F.col("x.name").alias("member"), F.col("x.binding").alias("how"), F.col("x.source").alias("source"), F.col("x.imported").alias("imported"))
    fields = cut(meant(f).filter("holder is not null").select("at", "member", F.col("holder").alias("qualified_name")))
    own = callables(symbols)

    key = ["file", "how", "source", "imported", "mode", "chain"]
    s = meant(chains.select(*key).distinct()).withColumn("at", F.col("holder")).drop("holder", "outside").join(kinds, "at", "left")
    is_class = F.col("kind").isin(*holds)
    # A variable that was assigned a function's result stands for what that returns.
    s = s.join(returns.withColumnRenamed("callee", "at"), "at", "left")
    first = F.when(is_class, F.col("at")).when((F.col("mode") == "instance") & (F.col("ret") != "this"), F.col("ret"))
    s = cut(s.select(*key, first.alias("holder"), F.when(~is_class & (F.col("mode") != "instance"), F.col("at")).alias("callee"), F.lit(None).cast("string").alias("self")))
    for k in range(CHAIN + 1):
        step = F.when(F.size("chain") > k, F.col("chain")[k])
        s = s.withColumn("step", step)
        if s.filter("step is not null and (holder is not null or callee is not null)").isEmpty():
            break
        asked = s.filter("startswith(step, '.') and holder is not null").select("holder", F.expr("substring(step, 2)").alias("member")).distinct()
        got = members(asked, own, heritage).filter("n = 1").select("holder", "member", F.col("qualified_name").alias("called"))
        typed = members(asked, fields, heritage).filter("n = 1").select("holder", "member", F.col("qualified_name").alias("field"))
        s = s.withColumn("member", F.when(F.startswith("step", F.lit(".")), F.expr("substring(step, 2)"))).join(got, ["holder", "member"], "left").join(typed, ["holder", "member"], "left").join(returns, "callee", "left")
        call = F.col("step") == "()"
        back = F.when(F.col("ret") == "this", F.col("self")).otherwise(F.col("ret"))
        holder = F.when(F.col("step").isNull(), F.col("holder")).when(call & F.col("callee").isNotNull(), back).when(call, F.col("holder")).otherwise(F.col("field"))
        callee = F.when(F.col("step").isNull(), F.col("callee")).when(~call & F.col("field").isNull(), F.col("called"))
        s = cut(s.select(*key, holder.alias("holder2"), callee.alias("callee2"), F.col("holder").alias("self")).withColumnsRenamed({"holder2": "holder", "callee2": "callee"}))
    return s.select(*key, "holder")


_AMBIENT = re.compile(r"\b(?P<open>declare\s+global|declare\s+module\s+\"[^\"]*\")\s*\{|\b(?P<module>import\b(?!\s*\()|export\b)|\b(?P<declare>declare\s+)?(?P<kind>function|const|let|var|class|enum|interface|type|namespace|module)\s+(?P<name>[A-Za-z_$][\w$]*)|[{}]")
_QUOTED = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<!module )\"(?:[^\"\\\n]|\\.)*\"")


def ambient_names(text: str) -> set[str]:
    """Global names that a declaration file declares: at its top with ``declare`` (if it is no module), and in ``declare global``."""
    stack: list[str] = []
    top: set[str] = set()
    everywhere: set[str] = set()
    is_module = False
    for m in _AMBIENT.finditer(_QUOTED.sub(" ", text)):
        if m[0] == "}":
            del stack[-1:]
        elif m["open"]:
            stack.append("global" if m["open"].endswith("global") and not stack else "module")
        elif m[0] == "{":
            stack.append("block")
        elif m["module"]:
            is_module |= not stack
        elif not stack and m["declare"]:
            top.add(m["name"])
        elif stack == ["global"] and m["kind"] not in ("namespace", "module"):
            everywhere.add(m["name"])
    return everywhere if is_module else everywhere | top


def ambient(files: DataFrame) -> DataFrame:
    """(to_name) of the global names that declaration files (``.d.ts``) declare."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n for t in batch.column("text").to_pylist() for n in ambient_names(t or "")], pa.string())], names=["to_name"])

    return files.filter("endswith(path, '.d.ts')").select("text").mapInArrow(run, "to_name string").distinct()


def _unique_holders(symbols: DataFrame, language: DataFrame) -> DataFrame:
    """(fam, word, q3, known): the one holder of a name in a family without imports of types, and whether any symbol has the name."""
    s = symbols.join(language.select("file", family("language").alias("fam")), "file")
    holds = F.col("kind").isin("class", "interface", "struct", "trait", "enum", "module")
    one = F.when((F.count_distinct(F.when(holds, F.col("qualified_name"))) == 1) & F.col("fam").isin(*TYPED), F.min(F.when(holds, F.col("qualified_name"))))
    return s.groupBy("fam", F.col("name").alias("word")).agg(one.alias("q3"), F.lit(True).alias("known"))


def resolved(p, only: DataFrame | None = None) -> DataFrame:
    """The edges of a parsed body of code (see ``sources.code.Parsed``), each with its evidence; of the files ``only`` (file), if given."""
    from quillgraph.corpus import EDGES, deduplicated_edges
    from quillgraph.operators import java_types, overloads
    from quillgraph.plans.shared import cut

    none = F.lit(None).cast("string")
    language = p.files.select(F.col("path").alias("file"), "language")
    raw = cut((p.raw if only is None else p.raw.join(only, "file", "left_semi")).dropDuplicates())
    sources = raw.filter("source is not null").select("file", "language", "source").unionAll(p.exports.select("file", "language", "source"))
    bases = p.symbols.filter("size(heritage) > 0").select("file", F.concat("file", F.lit("#"), "local_name").alias("holder"), F.explode("heritage").alias("h")).select("file", "holder", F.col("h.name").alias("written"), F.col("h.binding").alias("how"), F.col("h.source").alias("source"), F.col("h.imported").alias("imported"))
    # A base that is written without a binding may be the only type of its name.
    bases = bases.withColumn("imported", F.when(F.col("how").isNull(), F.col("written")).otherwise(F.col("imported"))).withColumn("how", F.coalesce("how", F.lit("local")))
    sources = sources.unionAll(bases.filter("source is not null").join(language, "file").select("file", "language", "source"))
    targets = cut(import_targets(p.files, sources.distinct(), facts(p.files)))
    names = cut(exported(p.symbols, p.exports.join(targets, ["file", "source"], "left")))
    heritage = cut(_classes(bases.withColumnRenamed("holder", "child"), targets, names, p.symbols, language).select(F.col("child").alias("holder"), F.col("holder").alias("base")).distinct())

    e = raw.join(targets, ["file", "source"], "left")
    keep = [F.col(c) for c in ("kind", "file", "from_symbol", "to_name", "line")]
    bound = F.when(F.col("binding").isNotNull(), F.to_json(F.struct("basis", F.col("binding").alias("binding"), "imported", "member", "mode", "owner", "source")))

    def shaped(df: DataFrame, symbol, to_file, status, method, reason, external=none, candidates=None, holder=none) -> DataFrame:
        listed = F.lit(None).cast("array<string>") if candidates is None else candidates
        return df.select(keep[0], F.col("file").alias("from_file"), *keep[2:], symbol.alias("to_symbol"), to_file.alias("to_file"), status.alias("status"), method.alias("method"), reason.alias("reason"), external.alias("external"), listed.alias("candidates"), bound.alias("binding"), "arguments", "constructs", holder.alias("holder"))

    hit = F.col("to_file").isNotNull()
    why_not = F.when(F.col("several"), "import-target-ambiguous").otherwise("import-target-unresolved")
    label = F.when(why_not == "import-target-unresolved", F.col("external"))
    imports = shaped(e.filter("kind = 'imports'"), none, F.col("to_file"), F.when(hit, "resolved").otherwise("unresolved"), F.when(hit, "import-path"), F.when(~hit, why_not), F.when(~hit, label))
    rest = e.filter("kind <> 'imports' and not (language = 'java' and constructs is not null)")

    found = names.select(F.col("file").alias("to_file"), F.col("name").alias("imported"), "n", F.col("qualified_name").alias("q"), F.col("to_file").alias("tf"), "hops", "names")
    b = rest.filter("binding = 'import'").join(found, ["to_file", "imported"], "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    status = F.when(one, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    lost = F.when(status != "unresolved", none).when(F.col("several"), "import-target-ambiguous").when(F.col("to_file").isNull(), "import-target-unresolved").otherwise("bound-symbol-missing")
    by_import = shaped(b, F.when(one, F.col("q")), F.when(one, F.col("tf")), status, F.when(one, F.when(F.col("hops") > 0, "re-export-binding").otherwise("import-binding")), lost, F.when(lost == "import-target-unresolved", F.col("external")), F.when(F.col("n") > 1, F.col("names")))

    own = p.symbols.groupBy("file", F.col("local_name").alias("imported")).agg(F.min("qualified_name").alias("q"), F.max("shadowed").alias("shadowed"))
    l = rest.filter("binding = 'local'").join(own, ["file", "imported"], "left")  # noqa: E741
    sure = F.col("q").isNotNull() & ~F.coalesce("shadowed", F.lit(False))
    by_file = shaped(l, F.when(sure, F.col("q")), F.when(sure, F.col("file")), F.when(sure, "resolved").otherwise("unresolved"), F.when(sure, "lexical-definition"), F.when(~sure, F.when(F.col("shadowed"), "shadowed-declaration").otherwise("bound-symbol-missing")))

    # What a source gives as a whole is a namespace: its members are what the file exports.
    m = rest.filter("binding = 'member'").withColumn("how", F.when(F.col("owner") == "super", "local").otherwise(F.col("owner"))).withColumn("open_file", F.col("to_file").isNull()).drop("to_file")
    m = m.withColumn("how", F.when(F.col("owner") == "return", F.col("root")).otherwise(F.col("how")))
    m = cut(_classes(m, targets.drop("several", "external"), names, p.symbols, language))
    chains = m.filter("owner = 'return' or (owner <> 'super' and basis = 'constructor' and language = 'python')").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>")))
    if not chains.isEmpty():
        given = receivers(chains, p.symbols, targets, names, heritage, language)
        same = ["file", "how", "source", "imported", "mode", "chain"]
        g = given.withColumnsRenamed({c: f"g_{c}" for c in [*same, "holder"]})
        match = F.lit(True)
        for c in same:
            match = match & F.coalesce(c, F.array().cast("array<string>") if c == "chain" else F.lit("")).eqNullSafe(F.coalesce(f"g_{c}", F.array().cast("array<string>") if c == "chain" else F.lit("")))
        follows = (F.col("owner") == "return") | (F.col("basis") == "constructor") & (F.col("language") == "python")
        m = m.join(g, match, "left").withColumn("holder", F.when(follows & (F.col("owner") != "super"), F.col("g_holder")).otherwise(F.col("holder"))).withColumn("outside", F.col("outside") & (F.col("owner") != "return"))
        m = cut(m.drop(*[f"g_{c}" for c in [*same, "holder"]]))
    parents = m.filter("owner = 'super'").join(heritage, "holder").select("holder", "member", F.col("base").alias("at")).filter("at is not null").distinct()
    asked = m.filter("owner <> 'super' and holder is not null").select("holder", "member").unionAll(parents.select(F.col("at").alias("holder"), "member")).distinct()
    got = cut(members(asked, callables(p.symbols), heritage))
    up = parents.join(got.select(F.col("holder").alias("at"), "member", "n", "qualified_name"), ["at", "member"]).groupBy("holder", "member").agg(F.sum("n").alias("n"), F.min("qualified_name").alias("qualified_name")).withColumn("up", F.lit(True))
    answers = got.select("holder", "member", "n", "qualified_name", F.lit(False).alias("up")).unionByName(up)
    mm = m.withColumn("up", F.col("owner") == "super").join(answers, ["holder", "member", "up"], "left")
    no_file = (F.col("how") == "import") & F.col("open_file")
    no_way = F.when(no_file, F.when(F.col("several"), "import-target-ambiguous").otherwise("import-target-unresolved")).when(F.col("outside") & F.col("holder").isNull(), "unbound-global").otherwise("receiver-unresolved")
    by_member = shaped(mm, F.when(one, F.col("qualified_name")), F.when(one, F.substring_index("qualified_name", "#", 1)), F.when(one, "resolved").otherwise("unresolved"), F.when(one, "receiver-hint"), F.when(~one, no_way), F.when(~one & no_file & ~F.coalesce("several", F.lit(False)), F.col("external")), None, F.when(one & (F.col("owner") != "super"), F.col("holder")))

    known = ambient(p.files).withColumn("ambient", F.lit(True))
    blocked = rest.filter("binding = 'blocked'").join(known, "to_name", "left")
    ours = F.coalesce(F.col("ambient") & (family("language") == "javascript"), F.lit(False))
    why = F.when(F.col("reason") == "inline-handler", "route-handler-inline").when(F.col("reason") == "wrapped-handler", "route-handler-wrapped").when(F.col("reason") == "unknown-receiver", "receiver-unresolved").when((F.col("reason") == "unbound") & ~ours, "unbound-global").otherwise("binding-blocked")
    blocked = shaped(blocked, none, none, F.lit("unresolved"), none, why)

    made = e.filter("kind <> 'imports' and language = 'java' and constructs is not null")
    types = java_types.created(made, p.files, p.symbols, heritage)
    runs = java_types.constructors(p.symbols)
    made = made.drop("to_file").join(types, ["file", "enclosing", "to_name"], "left").join(runs, "type", "left")
    is_one, many = F.col("type").isNotNull(), F.size(F.coalesce("listed", F.array().cast("array<string>"))) > 1
    created = shaped(made, F.coalesce("constructor", "type"), F.when(is_one, F.col("type_file")), F.when(is_one, "resolved").when(many, "ambiguous").otherwise("unresolved"), F.when(is_one, F.col("type_method")), F.when(~is_one & ~many, F.coalesce("type_reason", F.lit("no-matching-symbol"))), none, F.when(many, F.col("listed")))

    free = shaped(rest.filter("binding is null"), none, none, F.lit("unresolved"), none, F.lit("no-matching-symbol"))
    sure_edges = cut(imports.unionAll(by_import).unionAll(by_file).unionAll(by_member).unionAll(blocked).unionAll(created))
    plain = p.symbols.select("qualified_name", "file", "name", "kind", "local_name", "scope")
    by_names = by_name(Corpus(p.files, plain, sure_edges), free).withColumn("holder", none)
    fitting = cut(kept_kinds(sure_edges.unionByName(by_names), p.symbols))
    chosen = overloads.chosen(fitting, p.symbols, heritage, p.files)
    return cut(deduplicated_edges(chosen.select(*[c.split()[0] for c in EDGES.split(", ")])))
