"""Which type an object creation of Java names: ranked equi-joins, one for each place that a name may come from.

Member types of the enclosing types (declared or inherited) go before a type of the file, a single import, the
package, and imports on demand. A place that may supply the name but can't be followed leaves it unresolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOLDERS = ("class", "interface", "enum", "struct", "trait", "module")
_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*"
_IMPORT = r"\bimport\s+(?:static\s+)?[\w$]+(?:\s*\.\s*[\w$]+)*(?:\s*\.\s*\*)?\s*;"


def packages(files: DataFrame) -> DataFrame:
    """(file, package) of the files in Java."""
    return files.filter("language = 'java'").select(F.col("path").alias("file"), F.regexp_extract(F.regexp_replace("text", _COMMENT, " "), r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"))


def imports(files: DataFrame) -> DataFrame:
    """(file, static, star, target) of the import declarations of the files in Java."""
    found = files.filter("language = 'java'").select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(F.regexp_replace("text", _COMMENT, " "), F.lit(_IMPORT), F.lit(0))).alias("x"))
    static = F.col("x").rlike(r"^import\s+static\s")
    target = F.regexp_replace(F.regexp_replace("x", r"^import\s+(static\s+)?|;$", ""), r"\s+", "")
    return found.select("file", static.alias("static"), F.endswith(target, F.lit(".*")).alias("star"), F.regexp_replace(target, r"\.\*$", "").alias("target"))


def _package_and_path(name) -> tuple[F.Column, F.Column]:
    """``a.b.Outer.Inner`` as its package, the parts before the first that begins with a capital, and the rest."""
    parts = F.split(name, r"\.")
    first = F.array_position(F.transform(parts, lambda p: p.rlike("^[A-Z_$]")), True).cast("int")
    some = first > 0
    return F.when(some, F.array_join(F.slice(parts, F.lit(1), first - 1), ".")), F.when(some, F.array_join(F.slice(parts, F.greatest(first, F.lit(1)), F.size(parts)), "."))


def created(sites: DataFrame, files: DataFrame, symbols: DataFrame, heritage: DataFrame) -> DataFrame:
    """(file, enclosing, to_name, type, type_file, n, candidates, method, reason) of distinct creations (file, enclosing, to_name).

    ``heritage``: (holder, base) as for members. ``type`` is null where the name isn't sure: several fit (``candidates``),
    or none is proven (``no-matching-symbol``), or none of the code's can be meant (``unbound-global``)."""
    from quillgraph.operators.resolve import members

    pkg = packages(files)
    types = symbols.filter(F.col("kind").isin(*HOLDERS)).join(pkg, "file").select("file", "local_name", "name", "qualified_name", "package").distinct()
    several = lambda df, keys: df.groupBy(*keys).agg(F.count_distinct("qualified_name").alias("n"), F.min("qualified_name").alias("q"), F.array_sort(F.collect_set("qualified_name")).alias("all"))
    by_path = several(types, ["package", "local_name"])
    asked = sites.select("file", "enclosing", "to_name").distinct().join(pkg, "file")
    p, path = _package_and_path(F.col("to_name"))
    asked = asked.withColumn("p", p).withColumn("path", path).filter("path is not null")
    asked = asked.withColumn("simple", F.split("path", r"\.")[0]).withColumn("rest", F.expr("substring(path, length(simple) + 2)"))
    key = ["file", "enclosing", "simple"]
    plain = asked.filter("p = ''").select(*key, "package").distinct()

    # Enclosing scopes, innermost first: a type's member types count, a local class of a method leaves the name open.
    scopes = plain.filter("enclosing <> ''").select(*key, F.split("enclosing", r"\.").alias("s"))
    scopes = scopes.select(*key, F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"), "s").withColumn("scope", F.array_join(F.slice("s", F.lit(1), F.col("depth")), "."))
    holder = types.select("file", F.col("local_name").alias("scope"), F.col("qualified_name").alias("holder")).distinct()
    scopes = scopes.join(holder, ["file", "scope"], "left")
    local = types.select("file", F.col("local_name").alias("inner")).distinct().withColumn("hidden", F.lit(True))
    scopes = scopes.withColumn("inner", F.concat("scope", F.lit("."), "simple")).join(local, ["file", "inner"], "left")
    nested = symbols.filter(F.col("kind").isin(*HOLDERS)).select(F.concat("file", F.lit("#"), "scope").alias("at"), F.col("name").alias("member"), "qualified_name").join(types.select("qualified_name"), "qualified_name", "left_semi")
    got = members(scopes.filter("holder is not null").select("holder", F.col("simple").alias("member")), nested, heritage).select("holder", F.col("member").alias("simple"), F.col("n").alias("mn"), F.col("qualified_name").alias("mq"))
    scopes = scopes.join(got, ["holder", "simple"], "left")
    decided = scopes.filter("mn is not null or (holder is null and hidden)")
    inner = decided.groupBy(*key).agg(F.max_by(F.struct(F.coalesce(F.when(F.col("mn") == 1, 1), F.lit(0)).alias("sure"), F.when(F.col("mn") == 1, F.col("mq")).alias("q")), "depth").alias("enc"))

    listed = imports(files)
    simple_of = F.substring_index("target", ".", -1)
    ip, ipath = _package_and_path(F.col("target"))
    single = listed.filter("not static and not star").select("file", simple_of.alias("simple"), ip.alias("package"), ipath.alias("local_name")).dropDuplicates(["file", "simple"]).join(by_path, ["package", "local_name"], "left").select("file", "simple", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q", "all").alias("single"))
    static = listed.filter("static and not star").select("file", simple_of.alias("simple")).distinct().withColumn("static", F.lit(True))
    static_star = listed.filter("static and star").select("file").distinct().withColumn("static_star", F.lit(True))
    top = several(types, ["file", "local_name"]).select("file", F.col("local_name").alias("simple"), F.col("q").alias("top"))
    same = by_path.select("package", F.col("local_name").alias("simple"), F.struct("n", "q", "all").alias("same"))
    star = listed.filter("not static and star").select("file", "target").distinct()
    wanted = plain.select("file", "simple").distinct().join(star, "file").withColumn("whole", F.concat("target", F.lit("."), "simple"))
    sp, spath = _package_and_path(F.col("whole"))
    wanted = wanted.select(F.col("file").alias("of"), "simple", sp.alias("package"), spath.alias("local_name")).join(types, ["package", "local_name"])
    demand = several(wanted.select(F.col("of").alias("file"), "simple", "qualified_name"), ["file", "simple"]).select("file", "simple", F.struct("n", "q", "all").alias("demand"))

    m = plain.join(inner, key, "left").join(top, ["file", "simple"], "left").join(static, ["file", "simple"], "left").join(single, ["file", "simple"], "left").join(same, ["package", "simple"], "left").join(static_star, "file", "left").join(demand, ["file", "simple"], "left")
    outcome = "struct<q:string,all:array<string>,method:string,reason:string>"
    none = F.lit(None).cast("string")

    def found(q, method, many=None, reason=none):
        return F.struct(q.alias("q"), (F.lit(None).cast("array<string>") if many is None else many).alias("all"), (F.lit(method) if method else none).alias("method"), reason.alias("reason")).cast(outcome)

    def of(c: str, method: str):
        return F.when(F.col(f"{c}.n") == 1, found(F.col(f"{c}.q"), method)).when(F.col(f"{c}.n") > 1, found(none, None, F.col(f"{c}.all")))

    unknown, outside = found(none, None, None, F.lit("no-matching-symbol")), found(none, None, None, F.lit("unbound-global"))
    own = F.when(F.substring_index("enc.q", "#", 1) == F.col("file"), found(F.col("enc.q"), "same-file-name")).otherwise(found(F.col("enc.q"), "lexical-definition"))
    answer = (
        F.when(F.col("enc.sure") == 1, own).when(F.col("enc.sure") == 0, unknown).when(F.col("top").isNotNull(), found(F.col("top"), "same-file-name")).when(F.col("static"), unknown)
        .when(F.col("single").isNotNull(), F.coalesce(of("single", "imported-file-name"), outside)).when(F.col("same").isNotNull(), of("same", "lexical-definition")).when(F.col("static_star"), unknown)
        .when(F.col("demand").isNotNull(), of("demand", "imported-file-name")).otherwise(outside)
    )
    simple = m.select(*key, answer.alias("a"))
    near = asked.filter("p = ''").join(simple, key)
    # ``Outer.Inner``: the outer one as a simple name, then a member type that it declares.
    deep = near.filter("rest <> ''").withColumn("want", F.concat("a.q", F.lit("."), "rest")).join(types.select(F.col("qualified_name").alias("want")).distinct().withColumn("is", F.lit(True)), "want", "left")
    deep = deep.withColumn("a", F.when(F.col("a.q").isNull(), F.col("a")).when(F.col("is"), found(F.col("want"), None).withField("method", F.col("a.method"))).otherwise(unknown))
    far = asked.filter("p <> ''").select("file", "enclosing", "to_name", F.col("p").alias("package"), F.col("path").alias("local_name")).join(by_path, ["package", "local_name"], "left").withColumn("single", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "q", "all")).withColumn("a", F.coalesce(of("single", "imported-file-name"), outside))
    names = ["file", "enclosing", "to_name", "a"]
    whole = near.filter("rest = ''").select(*names).unionByName(deep.select(*names)).unionByName(far.select(*names))
    return whole.select("file", "enclosing", "to_name", F.col("a.q").alias("type"), F.substring_index("a.q", "#", 1).alias("type_file"), F.col("a.all").alias("listed"), F.col("a.method").alias("type_method"), F.col("a.reason").alias("type_reason"))


def constructors(symbols: DataFrame) -> DataFrame:
    """(type, constructor): what a creation of a type runs, where it declares one; records with a header run themselves."""
    types = symbols.filter(F.col("kind").isin(*HOLDERS)).groupBy(F.col("qualified_name").alias("type")).agg(F.max(F.col("signature").rlike(r"\brecord\s")).alias("primary"))
    own = symbols.filter((F.col("kind") == "method") & (F.col("name") == F.substring_index("scope", ".", -1))).select(F.concat("file", F.lit("#"), "scope").alias("type"), F.col("qualified_name").alias("constructor")).distinct()
    return types.join(own, "type").filter("not primary").select("type", "constructor")
