"""Queries of the catalogue against DuckDB, on the smallest tables."""

import math
import os

import pytest

from quillgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["find_text_docs", "find_text_groups", "tokenize_docs", "corpus_stats", "ask_docs", "scoped_ask_round_robin", "callers_d1", "degree_hotspots", "map_directories", "resolve_hrefs", "coverage_by_lang", "freshness_delta", "tests_for", "unreferenced_parts", "mentions", "innermost_symbol_by_line"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", QUICK)
def test_equals_duckdb(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    want = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=repr) == want
