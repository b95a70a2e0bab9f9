import random

import brute
import pytest

from quillgraph.llm import near_dedup
from quillgraph.llm.components import components


def grouped(spark, rows, words=3, similarity=(85, 100)):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df, words=words, similarity=similarity).collect()}


def test_against_brute_force_with_large_groups(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = r.choices(vocabulary, k=150)
    passage = r.choices(vocabulary, k=60)
    rows = []
    for i in range(150):  # near copies with independent edits, more than a short list holds
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(150, 260):  # a passage that many share
        rows.append((i, " ".join(r.choices(vocabulary, k=40) + passage + r.choices(vocabulary, k=40))))
    rows += [(300 + i, "The SAME text of Six words") for i in range(40)] + [(400 + i, "the same\ttext  of six words") for i in range(3)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "One"), (505, "two words"), (506, "a b c d"), (507, "b c d e")]
    r.shuffle(rows)
    expected = brute.near_groups(rows, 3, 85, 100)
    got = grouped(spark, rows)
    assert {i: g[:2] for i, g in got.items()} == expected
    assert all(g[2] == (g[1] == i) for i, g in got.items())
    assert got[500] == (0, 500, True) and got[501][0] == 0 and got[504][1] == 503


def test_five_words_and_deduplicated(spark):
    text = " ".join(f"x{i}" for i in range(100))
    rows = [(3, text), (1, text + " end"), (2, "other words stand here alone today"), (2, "other words stand here alone today"), (9, None)]
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, n_shingles string, kept int")
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 9]


def test_deduplicated_with_null_and_repeated_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcde"}
    rows = [(None, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["c"] + " end"), (4, text["c"]), (5, text["d"]), (5, text["e"]), (5, text["e"] + " end"), (5, None), (6, text["d"] + " end"), (None, None), (None, " ")]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [(r["doc_id"], (r["text"] or "").replace(" end", "")) for r in got]
    want = [(None, text["a"]), (None, text["b"]), (4, text["c"]), (5, text["d"]), (5, text["e"]), (5, ""), (None, ""), (None, " ")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_short_texts_in_long_lists(spark):
    # The sets of 8 words and of 9 that begin with them have 4 of 5 shingles in common, all in long lists.
    rows = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(8)]
        rows += [(1000 * g + i, " ".join([*base, f"end{i}"])) for i in range(40)] + [(1000 * g + 999, " ".join(base))]
    got = grouped(spark, rows, 5, (80, 100))
    assert {i: g[:2] for i, g in got.items()} == brute.near_groups(rows, 5, 80, 100)
    assert sum(g[2] for g in got.values()) == 25


def rows_made(spark, word, of):
    """Rows that the plan nodes named ``word`` make while ``of`` runs, and what it returns."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def ids():
        bus.waitUntilEmpty()
        runs = store.executionsList()
        return {runs.apply(i).executionId() for i in range(runs.size())}

    before, out, made = ids(), of(), 0
    for run in ids() - before:
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if node.name() == word else []
            found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            made += sum(int(x.get().replace(",", "")) for x in found if x.isDefined())
    return made, out


def test_rows_of_a_long_list_that_one_member_keeps_open(spark):
    # 600 of a list come together in the first round; one more is like none of them, but its place in the list doesn't tell.
    sets = [(i, [*(x for x in range(100) if x != i % 50), 1000 + i]) for i in range(600)] + [(600, [*range(85), *range(5000, 5015)])]
    entries = spark.createDataFrame([(7, i, 100, 8 if i == 600 else i % 3) for i, _ in sets], "v long, rep long, n int, u int")
    made, links = rows_made(spark, "Generate", lambda: near_dedup._long_lists(entries, spark.createDataFrame(sets, "rep long, hashes array<long>"), 0.85, 85, 100))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == dict.fromkeys(range(600), 0)
    assert 0 < made <= 3 * len(sets)


def test_long_lists_against_brute_force(spark):
    # Families at the threshold, of equal and of many sizes: some members come together late, some never.
    r = random.Random(11)
    rows, i = [], 0
    for family, size, edits in ((0, 160, (3, 9)), (1, 120, (2, 7)), (2, 90, (0, 12))):
        base = [f"f{family}w{x}" for x in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(*edits)):
                w[r.randrange(len(w))] = r.choice([f"e{r.randrange(60)}", f"own{i}"])
            rows.append((i, " ".join(w[: len(w) - (r.randrange(20) if family == 2 else 0)])))
            i += 1
    expected = brute.near_groups(rows, 3, 85, 100)
    assert {x: g[:2] for x, g in grouped(spark, rows).items()} == expected
    assert 3 < len({c for _, c in expected.values()}) < len(rows) - 20


@pytest.mark.parametrize(("t", "places", "width"), [(0.8, 12, 3), (0.5, 10, 1), (0.3, 9, 2)])
def test_least_runs(t, places, width):
    share = {}
    for x in range(1 << places):
        runs = sum((x >> i) % (1 << width) == (1 << width) - 1 for i in range(places - width + 1))
        share[runs] = share.get(runs, 0) + t ** x.bit_count() * (1 - t) ** (places - x.bit_count())
    for odds in (0.01, 0.2, 0.6):
        m = near_dedup.least_runs(t, places, width, odds)
        assert sum(p for n, p in share.items() if n < m) <= odds < sum(p for n, p in share.items() if n <= m)


def test_empty_table_and_null_id(spark):
    assert grouped(spark, []) == {}
    got = grouped(spark, [(None, "a b c d"), (5, "a b c d"), (None, None)])
    assert got[5] == (2, 5, True)


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 3), (3, 9), (20, 21), (5, 3)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent)}
