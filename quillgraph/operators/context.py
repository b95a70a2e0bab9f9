"""What to read for a task: seed definitions, their reliable relationships and tests, packed into a budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.corpus import Corpus, checked_limit, in_path, is_reliable, is_test_file
from quillgraph.operators import evidence, graph, search
from quillgraph.plans.shared import cut

#: Hits that are fetched for each seed, levels that are walked, characters that any item takes at least.
OVERFETCH, DEPTH, LEAST_ITEM = 4, 3, 16
#: Share of the budget that the seeds after the first may fill.
SEED_SHARE = 0.6


@dataclass
class Context:
    """The packed lines, and how many items of each kind there were no room for."""

    text: str = ""
    kept: dict[str, int] = field(default_factory=dict)
    omitted: dict[str, int] = field(default_factory=dict)


def seeds(corpus: Corpus, task: str | list[str], limit: int = 5, within: str | None = None) -> DataFrame:
    """(rank, qualified_name) of named symbols (exact names), else of the symbols among the best hits: those outside
    of tests that aren't one-line constants or types first."""
    checked_limit(limit, "limit")
    s = corpus.unique_symbols().filter(in_path("file", within))
    if not isinstance(task, str):
        names = corpus.spark.createDataFrame([(i, n) for i, n in enumerate(dict.fromkeys(task), 1)], "rank int, qualified_name string")
        return names.join(s.select("qualified_name"), "qualified_name", "left_semi").orderBy("rank").limit(limit).select("rank", "qualified_name")
    hits = search.ask(corpus, task, within, OVERFETCH * limit).filter("qualified_name is not null").select(F.col("rank").alias("r"), "qualified_name")
    known = hits.join(s.select("qualified_name", "file", "kind", "start_line", "end_line"), "qualified_name")
    small = F.col("kind").isin("constant", "type") & (F.col("start_line") == F.col("end_line"))
    top = known.orderBy(is_test_file("file") | small, "r").limit(limit)
    return top.select(F.row_number().over(search.Window.orderBy(is_test_file("file") | small, "r")).alias("rank"), "qualified_name")


def relationships(corpus: Corpus, start: DataFrame, within: str | None = None, depth: int = DEPTH) -> DataFrame:
    """(depth, direction, kind, from_symbol, to_symbol, file, line) of the reliable edges around ``start`` (qualified_name), each once, by its least depth."""
    e = corpus.edges.filter(is_reliable() & F.col("to_symbol").isNotNull() & (F.col("from_symbol") != "") & in_path("from_file", within) & in_path("to_file", within))
    out = None
    for direction, near, far in (("out", "from_symbol", "to_symbol"), ("in", "to_symbol", "from_symbol")):
        nodes = graph.bfs(e.select(F.col(near).alias("src"), F.col(far).alias("dst")), start.select(F.col("qualified_name").alias("node")), depth)
        found = e.join(nodes.filter(F.col("depth") < depth).select(F.col("node").alias(near), (F.col("depth") + 1).alias("depth")), near).select("depth", F.lit(direction).alias("direction"), "kind", "from_symbol", "to_symbol", F.col("from_file").alias("file"), "line")
        out = found if out is None else out.unionByName(found)
    ends = ["kind", "from_symbol", "to_symbol", "file", "line"]
    return out.groupBy(*ends).agg(F.min(F.struct("depth", "direction")).alias("d")).select("d.depth", "d.direction", *ends)


def task_context(corpus: Corpus, task: str | list[str], limit: int = 5, within: str | None = None, mode: str = "understand", budget: int = 4_096) -> Context:
    """Packs seed definitions, then relationships and tests, into ``budget`` characters.

    ``understand`` puts relationships before tests; ``change`` and ``review`` let them take turns and put callers
    first. Only as many rows as could fit the budget ever come to the driver; omissions are counted over all."""
    if mode not in ("understand", "change", "review"):
        raise ValueError("mode is understand, change or review")
    most = max(1, budget // LEAST_ITEM)
    start = cut(seeds(corpus, task, limit, within))
    lines = corpus.files.select(F.col("path").alias("file"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    spans = corpus.unique_symbols().join(start, "qualified_name").join(lines, "file", "left")
    body = F.substring(F.array_join(F.slice("l", "start_line", F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n"), 1, budget + 1)
    head = F.concat("qualified_name", F.lit(":"), "start_line")
    definitions = [r["t"] for r in spans.select("rank", F.concat_ws("\n", head, body).alias("t")).orderBy("rank").collect()]
    edges = cut(relationships(corpus, start, within))
    first = "out" if mode == "understand" else "in"
    told = edges.orderBy("depth", F.col("direction") != first, "file", "line", "kind", "from_symbol", "to_symbol").limit(most)
    related = [f"{r['from_symbol']} {r['kind']} {r['to_symbol']} at {r['file']}:{r['line']}" for r in told.collect()]
    near = cut(evidence.tests_for(corpus, start, limit=None, sites=1).select("test_file").distinct())
    tests = [f"test {r['test_file']}" for r in near.orderBy("test_file").limit(most).collect()]
    totals = {"definitions": start.count(), "relationships": edges.count(), "tests": near.count()}

    parts: list[str] = []
    kept, room = dict.fromkeys(totals, 0), budget

    def put(kind: str, item: str, within_room: int) -> bool:
        nonlocal room
        size = len(item) + 1
        if size > min(room, within_room):
            return False
        parts.append(item)
        room -= size
        kept[kind] += 1
        return True

    deferred = []
    for k, d in enumerate(definitions):
        left = room if k == 0 else int(budget * SEED_SHARE) - (budget - room)
        if not put("definitions", d, left):
            deferred.append(d)
    pairs = [("relationships", x) for x in related] + [("tests", x) for x in tests]
    if mode != "understand":
        turns = max(len(related), len(tests))
        pairs = [p for i in range(turns) for p in ([("relationships", related[i])] if i < len(related) else []) + ([("tests", tests[i])] if i < len(tests) else [])]
    for kind, item in [*pairs, *(("definitions", d) for d in deferred)]:
        put(kind, item, room)
    return Context("\n".join(parts), kept, {k: n - kept[k] for k, n in totals.items()})
