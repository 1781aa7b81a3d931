"""What steps hold and shuffle, where it once grew with the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.operators import chunking, facts, retrieval, tree, units
from leafmill.sources import shared


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_nested_tree_reads_its_chunks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("A > x", 1), ("A > x", 1), ("A > y > z", 2), ("B", 3)], "section_context string, page_number int").coalesce(1)
    rows = rows.withColumn("section_context", counted("section_context")).withColumn("doc", F.lit(1))
    assert tree.nodes(rows, ("doc",)).count() == 5
    once = seen.value
    found = tree.read_nested(tree.nested(tree.nodes(rows, ("doc",)), ("doc",)), ("doc",)).collect()
    assert {(r["node_id"], r["chunk_count"]) for r in found} == {("a", 3), ("a/x", 2), ("a/y", 1), ("a/y/z", 1), ("b", 1)}
    assert seen.value == 2 * once


def test_nodes_need_sections_and_pages_only(spark):
    rows = spark.range(2000).selectExpr("concat('A > ', id % 3) AS section_context", "cast(id % 5 AS int) AS page_number")
    found = {r["node_id"]: (r["chunk_count"], r["pages_covered"], r["min_page"], r["max_page"]) for r in tree.nodes(rows).collect()}
    assert found == {"a": (2000, 5, 0, 4), "a/0": (667, 5, 0, 4), "a/1": (667, 5, 0, 4), "a/2": (666, 5, 0, 4)}


def test_chunks_are_shuffled_before_their_facts_are_spelled_out(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "SPREAD_BYTES", 1000)
    rows = [("s", 1, "In 1999 and 2001 for $5", "h1"), ("s", 1, "in 1999 FOR $5 usd 7", "h1"), ("t", 1, "In 1999", "h1"), ("s", 2, "5% of $5 or $5", "h2"), ("s", 2, "5%", ""), ("s", 2, "9%", None), (None, 2, "9%", "h3")]
    spark.createDataFrame(rows, "section_context string, page_number int, content string, content_hash string").coalesce(1).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    found = facts.distinct_of(chunks)
    assert sorted(map(str, found.collect())) == sorted(map(str, facts.distinct(facts.extract(chunks)).collect()))
    steps = plan(facts.distinct_of(chunks))
    assert steps.count("Exchange") == 1 and steps.index("Generate") < steps.index("Exchange")


def test_units_are_dealt_by_their_size(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([(d, p, f"u{p}", "text", "a b c") for d in range(40) for p in range(3)], "doc_id long, page_number int, uid string, unit_type string, content string")
    assert shared.spread(rows, "doc_id") is rows or shared.spread(rows, "doc_id").rdd.getNumPartitions() < 9  # of unknown size
    rows.coalesce(1).write.parquet(f"{tmp_path}/units")
    rows = spark.read.parquet(f"{tmp_path}/units")
    few = chunking.table_islands(rows)
    monkeypatch.setattr(shared, "SPREAD_BYTES", 500)
    many = chunking.table_islands(rows)
    assert "REPARTITION_BY_NUM" in plan(many) and plan(many).count("Exchange") == 1
    assert sorted(few.collect()) == sorted(many.collect())


def test_distances_are_held_in_parts():
    rng = np.random.default_rng(5)
    q, x = rng.standard_normal((1000, 8)), rng.standard_normal((20_000, 8))
    column = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 8).cast(pa.list_(pa.float64()))
    asked, found = pa.table({"query_id": np.arange(1000), "vector": column(q)}), pa.table({"id": np.arange(20_000), "vector": column(x)})
    tracemalloc.start()
    got = retrieval._block_best(asked, found, 3)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    want = [np.argsort(((x - v) ** 2).sum(1), kind="stable")[:3] for v in q[[0, 51, 52, 999]]]
    assert got["id"].to_numpy().reshape(1000, 3)[[0, 51, 52, 999]].tolist() == np.array(want).tolist()


def test_words_become_lines_inside_their_text(spark):
    texts = spark.createDataFrame([(1, [f"w{i}" for i in range(40)]), (2, ["b"]), (2, ["a", "c", "d"]), (3, []), (4, None), (None, ["x"])], "doc_id long, words array<string>")
    found = units.height_lines(texts, F.lit(0.4))
    word = texts.select("doc_id", F.posexplode("words").alias("pos", "word"))
    want = word.groupBy("doc_id", F.bround(F.col("pos") * 0.4).cast("long").alias("line_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("line"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    steps = plan(found)
    assert steps.index("Exchange") < steps.index("Generate")
