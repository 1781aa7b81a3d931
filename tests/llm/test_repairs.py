"""Cases that once went wrong: leaves split three times, rows that differ in their source alone."""

import re
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from leafmill.llm import mixing, pii, similar_texts, simhash, url_filter, vector_dedup, vector_search
from leafmill.llm.common import Scratch, connected_components


def test_leaves_are_split_on_every_level(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "LEAF_SAMPLE", 48)
    levels = []
    grow = vector_dedup.grow
    monkeypatch.setattr(vector_dedup.Scratch, "table", lambda self, df, name, make=vector_dedup.Scratch.table: (levels.append(name), make(self, df, name))[1])
    rng = np.random.default_rng(11)
    x = rng.standard_normal((6000, 12))
    x[5000:] = x[:1000] + 0.01 * rng.standard_normal((1000, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_dedup.vector_groups(df, leaf_rows=12, max_sample=40, margin=0.1).collect()}
    assert grow is vector_dedup.grow and levels.count("numbers") == vector_dedup.LEVELS == 3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    assert [got[i]["n_links"] for i in range(6000)] == want.tolist()
    assert all(got[i]["component_id"] <= i for i in range(6000)) and sum(r["kept"] for r in got.values()) < 6000


ROWS = [(1, "w " * 50, s, n) for s in "abc" for n in range(2)] + [(2, "x y z " * 40, "a", 0), (3, "q " * 30, "b", 0), (None, None, None, 0), (None, None, None, 0), (4, "", "c", 0)]


@pytest.mark.parametrize("order", [1, -1])
def test_one_text_in_several_sources(spark, order):
    rows = spark.createDataFrame(ROWS[::order], "doc_id long, text string, source string, row int").repartition(3)
    counts = sorted((r["doc_id"] or 0, r["size"], r["source_size"], r["taken"]) for r in mixing.mix_counts(rows).collect())
    mixed = mixing.mix_documents(rows).collect()
    sizes = {s: sum(len(r[1].split()) for r in ROWS if r[2] == s and r[1]) for s in "abc"}
    words = lambda t: len(re.findall(r"\S+", t))
    assert all(words(r["text"]) == r["taken"] for r in mixed)
    got = sorted((r["doc_id"], words("w " * 50) if r["doc_id"] == 1 else words(next(t for i, t, *_ in ROWS if i == r["doc_id"])), sizes[r["source"]], r["taken"]) for r in mixed)
    assert got == [c for c in counts if c[3]]
    # by source and row, the same for either order of the input
    assert sorted((r["source"], r["doc_id"], r["row"], r["taken"]) for r in mixed) == sorted((r["source"], r["doc_id"], r["row"], r["taken"]) for r in mixing.mix_documents(spark.createDataFrame(ROWS, rows.schema)).collect())


def test_long_values_are_one_candidate():
    key = "aB3" * 170
    text = f"token: {key} x, {'7-' * 60}7 and {'l' * 90}@{'d' * 80}.org"
    found = {(text[s:e], k) for s, e, k in pii.candidates(text)}
    assert {(key, "secret"), ("7-" * 60 + "7", "other"), ("l" * 90 + "@" + "d" * 80 + ".org", "other")} <= found


def test_long_runs_take_linear_time():
    start = time.process_time()
    assert pii.candidates("a" * 1_000_000 + " b@ " + "x." * 300_000 + " @c.d") is not None
    assert time.process_time() - start < 20


def test_rules_that_contradict_each_other(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://a.org/y")], "page_id long, url string")
    rules = [("block", "a.org", "/x"), ("allow", "a.org", "/x"), ("allow", "a.org", "/")]
    for given in (rules, rules[::-1], spark.createDataFrame(rules, "verdict string, host string, path string"), spark.createDataFrame(rules[::-1], "verdict string, host string, path string")):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, given).collect()}
        assert got == {1: ("a.org/x", "block"), 2: ("a.org/", "allow")}


def test_variants_are_never_broadcast(spark):
    # 66 variants a fingerprint, which Spark's estimate doesn't know of: the driver's memory would grow with them
    prints = spark.createDataFrame([(i,) for i in (0, 1, 7, 31, 1 << 40)], "fp long")
    found = simhash.near_pairs(prints)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(0, 1), (0, 7), (1, 7), (7, 31), (0, 1 << 40), (1, 1 << 40)}


def test_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    # a table under Spark's limit in files is several times as large on the driver: bitmaps of fixed size and centres of common shingles alone go there
    plans: list[tuple[str, str]] = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, make=Scratch.table: (plans.append((name, plan(df))), make(self, df, name))[1])
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join(words[::-1]), " ".join([*words[::-1], "y"]), "a b c", "a b c", None]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = similar_texts.without_copies(docs)
    mixed = mixing.mix_documents(docs)
    path = connected_components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"), Scratch(spark, "path"))
    fixed = {"buckets": 1, "sets": 1}
    assert {n for n, _ in plans} >= {"pairs", "near", "links", "placed", "members", "rest", "groups", "large", "small", "met"}
    for name, found in plans:
        if name not in ("ranges", "plan"):  # of sources and shuffle partitions
            assert found.count("BroadcastExchange") == fixed.get(name, 0), name
    assert "SortMergeJoin" in plan(kept) and "BroadcastHashJoin [id" not in plan(kept)
    assert "BroadcastExchange" not in plan(mixed)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6]
    assert mixed.count() == len([t for t in texts if t])
    assert {tuple(r) for r in path.collect()} == {(i, 1) for i in range(1, 5)}


def test_queries_unlike_the_other_rows(spark):
    rng = np.random.default_rng(2)
    n, d = 6000, 32
    x = rng.standard_normal((12, d))[rng.integers(0, 12, n)] * 3 + 0.3 * rng.standard_normal((n, d))
    x[::20] = 2 * rng.standard_normal((n // 20, d))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = vector_search.nearest(df, F.col("vec_id") % 20 == 0).collect()
    scores = x[::20] @ x.T
    scores[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert len({(r["query_id"], r["vec_id"]) for r in got} & {(20 * i, int(j)) for i, w in enumerate(want) for j in w}) >= 0.93 * want.size
