"""Near-duplicate groups by bottom-k sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. Its
sketch is the ``k`` smallest of them (one hash function). Documents with equal
sets form a class; only class representatives take part in what follows.

1. Inverted lists of retained values give, for each representative, how many of
   its values some other sketch retains. Too few: no partner.
2. Lists of up to ``small`` members give pairs; the sketch of the union
   estimates their similarity and drops clear misses.
3. Members of longer lists are never paired with each other outright. Those that
   share only a passage go by their runs of neighbouring hashes, if they are long enough to tell. Over
   the rest alone, exact counts of every shingle put the rarest first, and
   the prefix bound (a pair at the threshold shares one of the first
   ``n - ceil(t * n) + 1``) leaves few, shorter lists. Those are worked through
   in rounds: each list names leaders, every other member that isn't already
   in a leader's component is compared with them, and the lists whose members
   have all come together are done. Nothing is dropped: a list stays until
   every pair in it has been compared or lies in one component.
4. Every link is confirmed on the full sets.

Every test on part of a set asks for what a pair at the threshold falls short of
with odds of 10^-8 (``least_runs``), so it follows from the similarity; where a
sketch of ``k`` can't tell at these odds (under 0.54 at 24), longer ones are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import text as tx
from quillgraph.llm.components import components
from quillgraph.plans.shared import cut, drop, release

#: Retained values of a sketch.
K = 24
#: Members up to which a list gives all its pairs.
SMALL = 24
#: Components of a long list that name leaders in its rounds, and how many each; four times as many in each round after.
ROUNDS = ((1, 1), (16, 4), (256, 16))
#: Smallest hashes of a set whose runs of neighbours are looked at.
FEW = 128
#: Parts that the members of one long list are dealt to.
PARTS = 64
#: Members for which the leaders of a list are dealt to one more part.
MEMBERS = 100


def shingle_sets(batch: pa.RecordBatch, text: str, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text; (first row, sets) by slices of a batch."""
    import pyarrow.compute as pc

    row = 0
    for part in tx.slices(batch, text):
        flat, offsets = tx.pure(pc.ascii_lower(tx.texts_of(part, text)))
        codes, distinct = tx.coded(flat)
        h = tx.word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        full = tx.windows(h, words).view(np.int64)
        sets = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= words:
                sets.append(np.unique(full[a : b - words + 1]))
            elif b > a:
                sets.append(tx.windows(h[a:b], b - a).view(np.int64))
            else:
                sets.append(np.zeros(0, np.int64))
        yield row, sets
        row += part.num_rows


def _sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n, digest, sketch) of every row; digest is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for row, sets in shingle_sets(batch, "text", words):
                ids = batch.column("doc_id").slice(row, len(sets))
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "sketch"],
                )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, digest binary, sketch array<bigint>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(rep, hashes) of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch, "text", words):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "hashes"])

    return docs.mapInArrow(run, f"rep {docs.schema['doc_id'].dataType.simpleString()}, hashes array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |intersection| >= num * |union|."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("ha") + F.size("hb")).alias("s"))
    return joined.filter(den * F.col("i") >= num * (F.col("s") - F.col("i"))).select("a", "b")


def _apart(t: float, n: str, m: str) -> F.Column:
    """True where sizes alone rule a pair out."""
    return F.least(n, m) < F.greatest(n, m) * F.lit(t) - F.lit(1e-6)


def _small_pairs(lists: DataFrame, reps: DataFrame, t: float, k: int, floor: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the short lists that sizes and union sketches allow."""
    member = F.struct("rep", "n")
    own = lists.groupBy("v").agg(F.array_sort(F.collect_list(member)).alias("m"))
    first = own.select(F.posexplode("m").alias("i", "x"), "m")
    pairs = first.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y")).filter(~_apart(t, "x.n", "y.n") & (F.col("x.rep") < F.col("y.rep"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    sa = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    sb = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    same = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return pairs.join(sa, "a").join(sb, "b").filter(same >= F.greatest(F.lit(1), F.floor(F.size(union) * floor))).select("a", "b")


def _prefixes(members: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(v, rep, n, u): the rarest-first prefixes of the members' sets; u counts the shingles that come before v,
    those that no other member has first."""
    own = sets.join(members, "rep", "left_semi").select("rep", F.size("hashes").alias("n"), F.explode("hashes").alias("v"))
    often = own.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = own.join(often, "v").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("e"))
    u = F.col("n") - F.size("e")
    length = F.col("n") - F.ceil(F.col("n") * t - 1e-6) + 1 - u
    own = shared.filter(length > 0).select("rep", "n", u.alias("u"), F.posexplode(F.slice("e", F.lit(1), length.cast("int"))).alias("i", "x"))
    return own.select(F.col("x.v").alias("v"), "rep", "n", (F.col("u") + F.col("i")).alias("u"))


def least_runs(t: float, places: int, width: int, odds: float = 1e-8) -> int:
    """The most runs of ``width`` neighbours, all in both sets, that a pair at similarity ``t`` has
    among the ``places`` smallest hashes of its union, but for ``odds``."""
    p = np.zeros((width, places + 1))
    p[0, 0] = 1.0
    for _ in range(places):
        new = np.zeros_like(p)
        new[0] = (1 - t) * p.sum(0)
        new[1:] += t * p[:-1]
        new[-1, 1:] += t * p[-1, :-1]
        p = new
    return int(np.searchsorted(np.cumsum(p.sum(0)), odds, side="right"))


def _alike(members: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The members (rep) that share enough runs of three neighbours among their 128 smallest shingle hashes with others.

    Enough is what a pair at the threshold falls short of with odds of 10^-8, by the size of the set; sets
    for which that is none pass without a test. Texts that have only a passage in common share few runs."""
    need = [least_runs(t, n, 3) for n in range(FEW + 1)]
    short = next((n for n in range(FEW + 1) if need[n]), None)
    mine = sets.join(members, "rep", "left_semi")
    if short is None:
        return mine.select("rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [np.asarray(h.values)[:FEW].view(np.uint64) for h in batch.column("hashes")]
            keys = [tx.windows(h, 3).view(np.int64) for h in few]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "keys"])

    rep = sets.schema["rep"].dataType.simpleString()
    # Shorter sets are no partners of tested ones.
    own = mine.filter(F.size("hashes") >= int(t * short)).mapInArrow(run, f"rep {rep}, keys array<bigint>")
    keys = own.select("rep", F.size("keys").alias("of"), F.explode("keys").alias("v"))
    often = keys.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("v")
    met = keys.join(often, "v").groupBy("rep").agg(F.count(F.lit(1)).alias("met"), F.max("of").alias("of")).filter(F.col("of") >= short - 2)
    enough = met.filter(F.col("met") >= F.element_at(F.lit(need), F.col("of") + 3)).select("rep")
    return enough.unionAll(mine.filter(F.size("hashes") < short).select("rep"))


def _by_list(entries: DataFrame, *aggregates: F.Column) -> DataFrame:
    """Aggregates of each list, and the parts it has. A list's members are dealt to ``PARTS`` parts
    by their hash, so that one that holds much of all rows is summed and joined in as many tasks."""
    return entries.groupBy("v", "part").agg(*aggregates).groupBy("v")


def _feasible(entries: DataFrame, t: float) -> DataFrame:
    """The members that can have their first common shingle here with a member of another component, with the size ``c`` of their list.

    The smaller of a pair leaves ``n - u >= 2 * share * n`` (``able``), so lists without such a member have no pair either.
    ``low`` is the smallest size and ``top`` the largest ``n - u - share * n`` among members of other components."""
    share = t / (1 + t)
    room = F.col("n") - F.col("u") - F.col("n") * F.lit(share)
    own = entries.select("v", "part", "rep", "n", "u", "comp", room.alias("room")).withColumn("able", F.col("room") >= F.col("n") * F.lit(share) - 1e-6)
    first = _by_list(own, F.min(F.struct("n", "comp")).alias("l"), F.max(F.struct("room", "comp")).alias("h"), F.min("comp").alias("p"), F.max("comp").alias("q"), F.max("able").alias("able"), F.count(F.lit(1)).alias("c"))
    first = first.agg(F.min("l").alias("l"), F.max("h").alias("h"), F.min("p").alias("p"), F.max("q").alias("q"), F.max("able").alias("any"), F.sum("c").alias("c"), F.collect_set("part").alias("parts")).filter("p < q and any")
    own = own.join(first.select("v", "l", "h", "c", F.explode("parts").alias("part")), ["v", "part"])
    second = _by_list(own, F.min(F.when(F.col("comp") != F.col("l.comp"), F.col("n"))).alias("l2"), F.max(F.when(F.col("comp") != F.col("h.comp"), F.col("room"))).alias("h2"))
    second = second.agg(F.min("l2").alias("l2"), F.max("h2").alias("h2"), F.collect_set("part").alias("parts")).select("v", "l2", "h2", F.explode("parts").alias("part"))
    low = F.when(F.col("comp") != F.col("l.comp"), F.col("l.n")).otherwise(F.col("l2"))
    top = F.when(F.col("comp") != F.col("h.comp"), F.col("h.room")).otherwise(F.col("h2"))
    least = F.greatest(low, F.ceil(F.col("n") * t - 1e-6)) * F.lit(share) - 1e-6
    return own.join(second, ["v", "part"]).filter((F.col("room") >= least) & (top >= F.col("n") * F.lit(share) - 1e-6)).select("v", "part", "rep", "n", "u", "comp", "able", "c")


def _leaders(entries: DataFrame, step: int) -> DataFrame:
    """(v, lead, ln, lu, lc, lp, c): members of each list for all others to be compared with.

    Of each component a few, of many components: a component that holds most of a list needs no more of
    its own than the others do, and when those outside it have led, the list is done."""
    comps, each = ROUNDS[min(step, len(ROUNDS) - 1)]
    more = 4 ** max(0, step - len(ROUNDS) + 1)
    salts = [F.pmod(F.xxhash64("comp"), F.lit(comps * more)).alias("s"), F.pmod(F.xxhash64("rep", F.lit(step)), F.lit(each * more)).alias("r")]
    best = entries.filter("able").groupBy("v", *salts).agg(F.min(F.struct("u", "n", "rep", "comp", "part", "c")).alias("l"))
    return best.select("v", F.col("l.rep").alias("lead"), F.col("l.n").alias("ln"), F.col("l.u").alias("lu"), F.col("l.comp").alias("lc"), F.col("l.part").alias("lp"), F.col("l.c").alias("c"))


def _dealt(c: str) -> F.Column:
    """The parts that leaders of a list of ``c`` members go to: one for each ``MEMBERS``, up to ``PARTS``."""
    return F.least(F.lit(PARTS), F.ceil(F.col(c) / MEMBERS)).cast("int")


def _long_lists(entries: DataFrame, sets: DataFrame, t: float, num: int, den: int) -> DataFrame:
    """Links that join all that the lists (v, rep, n, u) connect: rounds of leaders against members.

    A pair meets in the list of its first common shingle at least; there ``n - u`` is all that either can share.
    Each round first leaves out the members that no other component has a partner for."""
    share = t / (1 + t)
    entries = cut(entries.withColumn("comp", F.col("rep")).withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS)).cast("int")))
    links = comp = None
    step, spent = 0, []
    while True:
        release(entries.sparkSession)
        before, entries = entries, cut(_feasible(entries, t))
        drop(before if step == 0 else None, *spent)
        if entries.isEmpty():
            drop(entries, comp)
            return links
        leaders = cut(_leaders(entries, step))
        need = (F.col("n") + F.col("ln")) * F.lit(share) - 1e-6
        dealt = leaders.drop("lp").withColumn("deal", F.explode(F.sequence(F.lit(0), _dealt("c") - 1))).drop("c")
        met = entries.withColumn("deal", F.pmod("part", _dealt("c"))).join(dealt, ["v", "deal"])
        met = met.filter((F.col("comp") != F.col("lc")) & ~_apart(t, "n", "ln") & (F.col("n") - F.col("u") >= need) & (F.col("ln") - F.col("lu") >= need))
        pairs = met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
        new = cut(_confirmed(pairs, sets, num, den))
        spent = [entries, leaders]
        if not new.isEmpty():
            links = new if links is None else links.unionAll(new)
            spent.append(comp)
            comp = cut(components(links).select(F.col("node").alias("rep"), F.col("component").alias("c2")))
        rest = entries.join(leaders.select("v", F.col("lp").alias("part"), F.col("lead").alias("rep")), ["v", "part", "rep"], "left_anti")
        entries = rest if comp is None else rest.join(comp, "rep", "left").select("v", "part", "rep", "n", "u", F.coalesce("c2", "comp").alias("comp"))
        step += 1


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (80, 100), k: int = K) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    The set of a text with fewer than ``words`` words is its whole sequence; without
    words (null, empty, white space) it is empty and linked with nothing. Rows are
    linked if ``similarity[1] * |intersection| >= similarity[0] * |union|``;
    ``component_id`` is the smallest id reachable, ``kept`` is true for that one.
    Equal texts are linked always. A repeated id counts as one document: each of
    its rows gets a result. A null id never becomes a component's id; a null id
    without partners gets a null component and is kept. Other columns are ignored.
    """
    num, den = similarity
    t, spark = num / den, docs.sparkSession
    while not least_runs(t, k, 1) and k < 1_000:
        k += 8
    floor = least_runs(t, k, 1) / k + 1e-9
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_sketches(texts, words, k))
    reps = cut(rows.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")).filter("rep is not null"))
    release(spark)
    values = reps.select("rep", "n", F.size("sketch").cast("tinyint").alias("kept"), F.explode("sketch").alias("v"))
    sizes = values.groupBy("v").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    hits = cut(values.join(sizes, "v"))
    able = hits.groupBy("rep").agg(F.count(F.lit(1)).alias("met"), F.max("kept").alias("kept")).filter(F.col("met") >= F.greatest(F.lit(1), F.floor(F.col("kept") * floor))).select("rep")
    lists = cut(hits.join(able, "rep", "left_semi").select("v", "rep", "n", "kept", "size"))

    drop(hits)
    del hits, able
    release(spark)
    pairs = cut(_small_pairs(lists.filter(F.col("size") <= SMALL), reps, t, k, floor))
    # A pair without a short list in common shares as much of its sketch as it must in long lists alone.
    often = lists.filter(F.col("size") > SMALL).groupBy("rep").agg(F.count(F.lit(1)).alias("met"), F.max("kept").alias("kept"))
    far = cut(often.filter(F.col("met") >= F.greatest(F.lit(1), F.floor(F.col("kept") * floor))).select("rep"))
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).unionAll(far).distinct()
    drop(lists)
    del lists, often
    sets = cut(_full_sets(texts.join(wanted, "doc_id", "left_semi"), words))
    release(spark)
    links = cut(_confirmed(pairs, sets, num, den))
    if not far.isEmpty():
        release(spark)
        alike = cut(_alike(far, sets, t))
        release(spark)
        more = _long_lists(_prefixes(alike, sets, t), sets, t, num, den)
        links = links if more is None else links.unionAll(more)
    drop(sets, pairs, far)
    comp = components(links).withColumnRenamed("node", "rep")
    classes = reps.join(comp, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("sketch").join(classes, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``; of rows that repeat an id and its text, one.

    Where ids are null or stand for several texts, each id with its text is a document of its own; a null id
    stays only if its group has no other, and each row with a null id and no words stays.
    """
    own = F.xxhash64(F.coalesce(text_col, F.lit("")))
    many = docs.groupBy(id_col).agg(F.min(own).alias("p"), F.max(own).alias("q")).filter((F.col("p") < F.col("q")) | F.col(id_col).isNull())
    plain = many.isEmpty()
    key = F.col(id_col)
    if not plain:
        key = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.coalesce(F.md5(F.encode(text_col, "utf-8")), F.lit("")).alias("of"))
    keyed = docs.withColumn("__key", key)
    groups = near_groups(keyed.select("__key", text_col), "__key", text_col, **how)
    first = groups.filter("kept").select(F.col("__key").alias("__kept")).distinct()
    kept = keyed.join(first, F.col("__key").eqNullSafe(F.col("__kept")), "left_semi")
    # Rows with a null id and no words are linked with nothing; they don't come together in one task.
    bare = F.col(id_col).isNull() & ~F.coalesce(F.col(text_col), F.lit("")).rlike("[^\\x20\\x09-\\x0d]")
    order = Window.partitionBy("__key").orderBy(text_col)
    once = (kept if plain else kept.filter(~bare)).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__key")
    return once if plain else once.unionAll(docs.filter(bare))
