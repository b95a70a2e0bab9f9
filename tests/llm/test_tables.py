"""URL rules, mixing, and the pipeline."""

import re

import brute
import corpus_pipeline
import pytest

from quillgraph.llm import mixing, queries, url_filter


SF = "/root/testdata/sf0.001"


def test_main_texts_against_another_parser(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op1_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == brute.article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)] if url else []
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/", "http://net/", "http://xnet/", "http://example.com/de/1", "http://example.com/de", "ftp://b.org/fr/", "://x.org/fr/a", "http://a.org?/fr/", "http://u@Ünet.net:80/ä", "http://example.net.org/fr/q", "http://..net/", "http://a.b.c.d.example.net//en/", "http://h.io/a/b/c", "http://h.io/a/bx", "http://" + "a." * 3_000 + "net/" + "x/" * 20_000, "http://h.io/" + "a/" * 30_000 + "?q"]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_CHARS, 0])
def test_rules_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_CHARS", limit)
    rules = [*queries.RULES, ("h.io", "/a/b", "block"), ("h.io", "", "allow"), ("H.io", "/a/b/", "allow")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[3:6])], "page_id long, url string, rule string")
    got = url_filter.judge(pages, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")).collect()
    low = [(h.lower(), p, v) for h, p, v in rules]
    assert len(got) == len(URLS) + 3
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], low), r["url"]
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


def test_popular_urls_and_rules_without_paths(spark):
    urls = [None] * 300 + ["http://a.net/"] * 300 + ["http://b.net/x/y"] * 3
    pages = spark.createDataFrame([(i % 290, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame([("net", "", "block")], "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) and all(r["verdict"] == ("block" if r["url"] else "allow") for r in got)
    assert {r["verdict"] for r in url_filter.judge(pages.select("url"), spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


def filled(sizes, weights=(5, 2, 1)):
    """Targets by dealing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, cap, target, open_ = 1.5 * sum(sizes.values()), {s: 2 * sizes[s] for s in sizes}, {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap[s]}
        target |= {s: float(cap[s]) for s in over} if over else {s: level * w[s] for s in open_}
        open_ -= over or open_
    return target


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), ["b", "a", None, "ä", "c"][i % 5 if i % 3 else 0]) for i in range(600)] + [(700, None, "empty"), (701, "", "empty"), (702, " ", "b"), (1, "w w", "a"), (1, "w w", "a"), (None, "w", "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")
    out = mixing.mixed(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 200 for s in sizes)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.emitted(df).count() == sum(r["copies"] for r in out)
    assert mixing.mixed(df.limit(0)).collect() == []
    assert {r["taken"] for r in mixing.mixed(df.filter("source = 'empty'")).collect()} == {0}


def test_mix_takes_by_systematic_sampling(spark):
    """Copies are what the running sum of expected copies gives, whatever the order: each document of a source gets
    the rate rounded down or up, the source as a whole its number of rows times the rate within one copy, and the
    words come near the target; a source, an id or a text that most rows have changes nothing."""
    rows = [(7 if i % 3 else i, f"w{i % 50} " * (1 + i % 40), "hot" if i % 4 else "small") for i in range(4_000)] + [(None, f"n{i} m", "small") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(df).collect()
    for source in ("hot", "small"):
        own = [r for r in out if r["source"] == source]
        rate = own[0]["target"] / own[0]["source_size"]
        assert {r["copies"] for r in own} <= {int(rate), int(rate) + 1}
        assert abs(sum(r["copies"] for r in own) - len(own) * rate) <= 1
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.01 * own[0]["target"]
    key = lambda r: (str(r["doc_id"]), r["source"], r["text"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, mixing.mixed(df.orderBy("text").repartition(9)).collect()))
    slim = mixing.mixed(mixing.sized(df).drop("text")).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in slim) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in out)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, name):
    import duckdb
    from test_oracles import TABLES, plain

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    want = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=repr) == want


def test_quality_rules_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_quality_rules(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(brute.WORD, t)
        failed = len(w) < 20 or 100 * brute.repeated_words(w) > 30 * len(w)
        assert (r["n_words"], r["base_failed"], r["kept"]) == (len(w), failed, not failed and brute.compressed(t)), r["doc_id"]


def test_pipeline_against_brute_force(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    r = random.Random(17)
    words = {"en": "the heather and thin other weather with thorn that".split(), "fr": "le chien dans les élans où été vient une".split()}
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    items = [" ".join("".join(r.choices("bcdfgaeiou", k=5)) for _ in range(n)) for n in (24, 15, 2)]
    rows = []
    for i in range(70):
        lang = "en" if i % 3 else "fr"
        rows.append([i, " ".join(x + r.choice(["", "", "s", "er"]) for x in r.choices(words[lang], k=r.randint(30, 90))) + f" end{i}", lang, [None, "a", "b", "c"][i % 4]])
    rows += [[100 + i, rows[i * 7][1] + " more", rows[i * 7][2], "a"] for i in range(8)] + [[120, rows[3][1], "en", None]]
    rows += [[200, "text before " + items[0] + " and after", "en", "a"], [201, " ".join(w if k % 6 else "thorn" for k, w in enumerate(items[1].split())), "en", "b"], [202, rows[4][1].replace("the", items[2], 1), "en", "b"]]
    rows += [[300, f'the weather and token = "{key}" with the thorn', "en", "c"], [301, "12 34 !", "en", "c"], [302, None, "en", "a"], [303, "", None, "a"]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    learn = [(t, lang) for _, t, lang, _ in rows if t is not None and lang is not None]
    said = brute.naive_bayes(learn, [t for _, t, _, _ in rows], scores=True)
    kept = [x for x, (lang, score) in zip(rows, said, strict=True) if lang != "und" and score >= 0.5]
    first = brute.near_groups([(x[0], x[1]) for x in kept], 5, 80, 100)
    kept = [x for x in kept if first[x[0]][1] == x[0]]
    kept = [x for x in kept if not brute.leaks(x[1], items)]
    kept = [(i, t.replace(key, "<SECRET>"), s) for i, t, _, s in kept]
    want = sorted((i, t, k) for (i, t, _), n in brute.copies(kept).items() for k in range(1, n + 1))
    assert 40 < len({w[0] for w in want}) and not {w[0] for w in want} & {120, 200, 201, 301, 302, 303}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x["doc_id"], x["text"], x["copy"]) for x in got.collect()) == want


def test_pipeline_stages(spark, tmp_path):
    from pyspark.sql import functions as F

    item = " ".join(f"item{chr(97 + i)}word" for i in range(20))
    prose = {"en": "the thing with heather and other weather", "fr": "le chien est dans les élans où l'été vient"}
    rows = [(i, " ".join([prose["en" if i % 2 else "fr"].split()[(i * k) % 7] + str(i % 11) * (k % 3 == 0) for k in range(1, 80)]) + f" id{i}", "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[5][1], "en", "s0", 0), (101, "12 34 !", "en", "s0", 0), (102, "hello there " + item + " and more of it", "en", "s0", 0), (103, 'the key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here with other words', "en", "s1", 0), (104, None, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {100, 101, 102, 104}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(range(40)) | {103} and "<SECRET>" in got[103]
