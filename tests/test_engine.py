"""Operators on small inputs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.config import Config, from_mapping, strategy_of
from leafmill.functions import text as T
from leafmill.operators import chunking, extraction, facts, ledger, retrieval, tree, triage
from leafmill.plans import qa, refine
from leafmill.sources import tables as S
from leafmill.streaming import ledger as stream

BOX = (0.0, 0.0, 1.0, 1.0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def units(spark, rows):
    return spark.createDataFrame([(1, 1, f"u{i:03d}", kind, text, *BOX) for i, (kind, text) in enumerate(rows)], "doc_id long, page_number int, uid string, unit_type string, content string, x1 double, y1 double, x2 double, y2 double")


def test_layout_confidence(spark):
    c = Config(min_clarity=0.25)
    conf = lambda ok, d: extraction.layout_confidence(F.lit(ok), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0), F.lit(1 if ok else 0), F.lit(d), c)
    assert one(spark, conf(True, 0.02)) == pytest.approx(0.9125)
    assert one(spark, conf(False, 0.02)) == pytest.approx(0.07)


def test_cost_tiers_and_chains(spark):
    tier = lambda *a: one(spark, triage.cost_tier(*map(F.lit, a), None, Config()))
    assert [tier(*a) for a in [("scanned", "Low", "General"), ("born_digital", "High", "General"), ("born_digital", "Medium", "General"), ("born_digital", "Low", "Public_Sector"), ("born_digital", "Low", "General")]] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    chain = lambda o, s: "".join(x[-1] for x in one(spark, extraction.strategy_chain(F.lit(o), F.lit(s))))
    assert (chain("hybrid", "STRATEGY_C"), chain("scanned_image", "STRATEGY_A"), chain("born_digital", "STRATEGY_A")) == ("ABC", "BC", "ABC")


def test_domain_hints(spark):
    hint = lambda t: one(spark, triage.domain_hint(F.lit(t), Config()))
    assert [hint(t) for t in ("CBE internal security notice", "Bank disclosure update", "Ministry report for FY2025", "Woreda operational survey", "a poem")] == ["Banking/Security"] * 2 + ["Public_Sector"] * 2 + ["General"]


def test_strategies_of_actions():
    assert [strategy_of(x) for x in ("A", "STRATEGY_B", {"strategy": "C"}, "other")] == ["STRATEGY_A", "STRATEGY_B", "STRATEGY_C", "STRATEGY_C"]


def test_tables_stay_together_beyond_the_limit(spark):
    rows = [("header", "Introduction"), ("text", "a few words here"), ("table", " ".join(["c"] * 40)), ("table", " ".join(["d"] * 40)), ("text", "the end")]
    c = chunking.pack(units(spark, rows), Config(max_chunk=30, min_chunk=5)).collect()
    assert max(r["tokens"] for r in c) == 80
    assert any("c c" in r["content"] and "d d" in r["content"] for r in c)


def fold(sizes, cap):
    out, held, k = [], 0, 0
    for i, s in enumerate(sizes):
        if i and held + s > cap:
            k, held = k + 1, 0
        held += s
        out.append(k)
    return out


def merge(tokens, least):
    out, i = [], 0
    while i < len(tokens):
        if tokens[i] >= least or i == len(tokens) - 1:
            out.append(tokens[i])
            i += 1
        else:
            out.append(tokens[i] + tokens[i + 1])
            i += 2
    return out


def test_packing_and_orphans_match_folds(spark):
    rng = random.Random(4)
    docs = {d: [rng.randint(1, 30) for _ in range(rng.randint(1, 40))] for d in range(40)}
    rows = [(d, 1, f"u{i:03d}", "text", " ".join(["w"] * n), *BOX) for d, sizes in docs.items() for i, n in enumerate(sizes)]
    u = spark.createDataFrame(rows, "doc_id long, page_number int, uid string, unit_type string, content string, x1 double, y1 double, x2 double, y2 double")
    config = Config(max_chunk=30, min_chunk=12)
    packed = chunking.pack(u, config)
    merged = chunking.merge_orphans(packed, config)
    got, got_merged = {}, {}
    for r in packed.orderBy("chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["tokens"])
    for r in merged.orderBy("merged_no").collect():
        got_merged.setdefault(r["doc_id"], []).append(r["tokens"])
    for d, sizes in docs.items():
        packs = fold(sizes, 30)
        want = [sum(s for s, p in zip(sizes, packs) if p == k) for k in range(packs[-1] + 1)]
        assert got[d] == want
        assert got_merged[d] == merge(want, 12)


def test_facts_and_guard(spark):
    c = spark.createDataFrame([("Sales", 3, "Paid $1,234.50 and USD 7 at 5% in 2019.", "h1"), ("Sales", 3, "nothing", "h2")], "section_context string, page_number int, content string, content_hash string")
    f = facts.extract(c)
    assert sorted((r["fact_key"], r["fact_value"]) for r in f.collect()) == [("currency_amount", "$1,234.50"), ("currency_amount", "USD 7"), ("percentage", "5%"), ("year", "2019")]
    assert facts.run_select(spark, f, "SELECT count(*) AS n FROM document_facts WHERE fact_key = ?", ["year"]).first()["n"] == 1
    for bad in ("SELECT d.* FROM document_facts d JOIN orders o ON true", "SELECT fact_key FROM document_facts UNION SELECT x FROM other", "SELECT * FROM document_facts WHERE fact_key IN (SELECT a FROM `parquet`.`/etc`)", "DELETE FROM document_facts", "SELECT 1", "SELECT * FROM document_facts; DROP TABLE x", "SELECT * FROM document_facts WHERE replace(fact_key, 'a', '') = ''"):
        with pytest.raises(ValueError):
            facts.run_select(spark, f, bad)


def test_answers_cite_their_evidence(spark):
    c = spark.createDataFrame([("Finance > Forecasting", 1, "Revenue forecast improved.", "a" * 64), ("Operations > Support", 2, "Support handled tickets.", "b" * 64), ("Finance > Treasury", 3, "Cash flow is stable.", "c" * 64)], "section_context string, page_number int, content string, content_hash string")
    engine = qa.Engine(c)
    a = engine.ask("What changed in revenue forecast?")
    assert "content_hash=" in a.text and a.provenance[0]["page_number"] == 1
    assert {r["title"] for r in qa.tree.search(c, "finance forecast and cash flow").collect()} == {"Finance"}
    assert engine.ask("Show the outline").text.splitlines()[0] == "- Finance"
    assert engine.ask("zzz qqq").text == qa.NOTHING
    assert engine.audit("revenue improved").status == "UNVERIFIABLE"


def test_questions_of_amounts_go_to_the_facts(spark):
    c = spark.createDataFrame([("Revenue > North", 1, "Revenue was $5 in 2020.", "a" * 64), ("Costs", 2, "Costs were $3.", "b" * 64)], "section_context string, page_number int, content string, content_hash string")
    engine = qa.Engine(c)
    a = engine.ask("What is the total revenue?")
    assert a.tools == ["semantic_search", "extract_and_store_facts", "sql_query_tool"] and "$5" in a.text and "$3" not in a.text
    assert engine.ask("list all amounts").text.count("fact_key=") >= 2
    planned = qa.Engine(c, plan_sql=lambda q: {"select_mode": "count", "fact_key_like": "currency"})
    assert "total_rows=" in planned.ask("sum of revenue").text
    assert qa.Engine(c, max_lines=1).ask("").text.splitlines() == ["- Revenue", "... (the first 1 lines)"]


def test_styles_make_headings(spark):
    look = lambda raw: one(spark, chunking.styled_heading(F.lit(raw), Config()))
    assert look('{"font_size": 14, "bold": true}') and look('{"size": 12, "weight": 600}') and look('{"size": "13", "is_bold": "yes"}')
    assert not look('{"font_size": 11, "bold": true}') and not look('{"font_size": 14}') and not look("plain") and not look('{"style": {"font_size": 14, "bold": true}}')


def test_budget_changes_results(spark):
    rows = [(1, p, n, f"STRATEGY_{s}", ok, 0.5, 10.0, 0.4) for p in (1, 2, 3, 4) for n, s, ok in ((1, "A", "fail"), (2, "C", "success"))] + [(1, 5, 1, "STRATEGY_A", "success", 0.5, 1.0, 0.0)]
    a = spark.createDataFrame(rows, "file_id long, page_number int, attempt_no int, strategy string, status string, confidence double, processing_time_ms double, cost double")
    got = {r["page_number"]: r for r in extraction.page_results(extraction.stop_loss(a, 0.8)).collect()}
    assert [got[p]["final_status"] for p in range(1, 6)] == ["success", "success", "fail", "fail", "success"]
    assert [got[p]["total_cost"] for p in range(1, 6)] == [0.8, 0.8, 0.4, 0.4, 0.0]


def test_mappings(spark):
    c = from_mapping({"chunking": {"max_chunk_size": 30, "min_chunk_size": -1, "semantic_boundaries": ["x"]}, "rules": [{"if": "rects > 3", "then": {"strategy": "B"}}], "extraction": {"budget_cap_usd": "7"}})
    assert (c.max_chunk, c.min_chunk, c.markers, c.budget, c.rules[0][1]) == (30, 50, ("x",), 7.0, "rects > 3")


def test_sinks_and_hooks(spark, tmp_path):
    u = units(spark, [("text", "one"), ("header", "two")])
    refine.write_documents(u, str(tmp_path / "docs"))
    assert sorted(r["content"] for r in S.refined_units(spark, str(tmp_path / "docs")).collect()) == ["one", "two"]
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/a.json").write_text('[1]\n"x"\n{"file_id": "f", "units": [{"content": "c"}]}\n')
    assert S.refined_units(spark, str(tmp_path / "odd")).count() == 1
    failures = refine.write({"bad": spark.range(3).select(F.raise_error(F.lit("no"))), "good": spark.range(3)}, str(tmp_path / "run"))
    assert list(failures) == ["bad"] and spark.read.parquet(str(tmp_path / "run/good")).count() == 3
    rows = lambda *xs: spark.createDataFrame(xs, "row_id string, v int")
    retrieval.upsert(rows(("a", 1), ("b", 1)), str(tmp_path / "vectors"))
    retrieval.upsert(rows(("b", 2), ("c", 2)), str(tmp_path / "vectors"))
    assert sorted(map(tuple, retrieval.versioned(spark, str(tmp_path / "vectors"), "row_id string, v int").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    (tmp_path / "x.pdf").write_bytes(b"p1\np2")

    def parse(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                lines = content.decode().split("\n")
                yield b.iloc[:0].reindex(columns=["path", "page_number", "text"]).assign(path=[path] * len(lines), page_number=range(1, len(lines) + 1), text=lines)

    assert [r["text"] for r in S.parse_files(S.binary_pages(spark, str(tmp_path)), parse, "path string, page_number int, text string").collect()] == ["p1", "p2"]
    chunks = spark.createDataFrame([("A", 1, "text", "h")], "section_context string, page_number int, content string, content_hash string")
    assert tree.section_summaries(chunks, lambda t, c: F.upper(c)).first()["summary"] == "TEXT"
    tree.export(tree.nodes(chunks), str(tmp_path / "tree"))
    with pytest.raises(ValueError):
        tree.export(tree.nodes(chunks.limit(0)), str(tmp_path / "none"))


def test_metadata_and_paths(spark):
    assert one(spark, retrieval.from_metadata(F.lit("3, x, -1,7"))) == [3, 7]
    assert one(spark, retrieval.from_metadata(F.lit(""))) == [1]
    assert one(spark, T.section_path(F.lit("# A > b > "))) == ["A", "b"]
    assert one(spark, T.slug(F.lit("--"))) == "untitled"
    assert one(spark, T.short_summary(F.lit("t"), F.lit("One two.  Three"))) == "One two."


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    rows = stream.deduplicated(stream.read(spark, folder, events.schema), "60 days")
    q = stream.hourly(rows).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("hourly")) == key(stream.hourly(events.withColumn("ts", F.col("ts").cast("timestamp"))))


def test_batch_run_and_sinks(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    out = refine.refine(S.doc_pages(spark, d).where("doc_id < 20"), S.line_units(spark, d).where("doc_id < 20"), Config(max_chunk=60, min_chunk=12))
    refine.write(out, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/doc_profiles")).count() == 20
    n = facts.append(facts.extract(S.fact_chunks(spark, d).limit(10)), str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == n
    ledger.append(ledger.entries(extraction.page_results(extraction.escalate(S.attempts(spark, d)))), str(tmp_path / "ledger"))
    assert spark.read.schema(ledger.EVENT_SCHEMA).json(str(tmp_path / "ledger")).where("cost_estimate IS NULL").count() == 0
