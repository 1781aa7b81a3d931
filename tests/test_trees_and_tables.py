"""Trees walked and nested, tables of queries and questions, versions of a table, guarded statements."""

import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from leafmill.operators import facts, retrieval, tree
from leafmill.plans import qa

CHUNK = "section_context string, page_number int, content string, content_hash string"


def chunks(spark, *sections):
    return spark.createDataFrame([(s, n + 1, f"Text {n} of {s}.", f"h{n}") for n, s in enumerate(sections)], CHUNK)


def test_the_outline_keeps_children_under_their_parents(spark):
    c = chunks(spark, "Asia > China", "Asia > Japan", "Asia Pacific", "Asia > China > South", "Africa")
    rows = tree.outline(tree.nodes(c)).orderBy("place").collect()
    assert [r["node_id"] for r in rows] == ["asia", "asia/china", "asia/china/south", "asia/japan", "asia-pacific", "africa"]
    assert qa.Engine(c).ask("Show the outline").text.splitlines() == ["- Asia", "  - China", "    - South", "  - Japan", "- Asia Pacific", "- Africa"]


def test_a_nested_tree_read_back_equals_the_table(spark):
    c = chunks(spark, "A > x", "A > y > \"deep\"", "B", "A", "C / d").selectExpr("*", "page_number % 2 AS doc")
    nodes = tree.nodes(c, ("doc",))
    trees = tree.nested(nodes, ("doc",))
    found = json.loads(trees.where("doc = 0").first()["tree"])
    assert [n["title"] for n in found["children"]] == ["A"] and found["children"][0]["children"][0]["children"][0]["title"] == '"deep"'
    columns = ("doc", *tree.FIELDS, "parent_id", "depth", "place")
    key = lambda df: sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))
    assert key(tree.read_nested(trees, ("doc",))) == key(tree.placed(nodes, ("doc",)))
    assert tree.nested(nodes.limit(0), ("doc",)).count() == 0
    with pytest.raises(ValueError):
        tree.nested(nodes, ("doc",), levels=2)


def test_summaries_know_every_separator(spark):
    c = chunks(spark, "Costs :: Year", "Gains | Year", "Costs :: Month")
    assert [r["title"] for r in tree.summaries_of(c, c.where("page_number <> 2")).collect()] == ["Costs"]


def test_search_of_many_questions_equals_one_by_one(spark):
    c = chunks(spark, "Finance > Plan", "Cash flow", "People", "Finance > Cash", "Plans of people")
    asked = [(1, "finance plan"), (2, "people cash"), (3, "nothing here"), (4, ""), (5, None), (6, "Text of TEXT")]
    got = {}
    for r in tree.search_each(c, spark.createDataFrame(asked, "question_id long, question string")).collect():
        got.setdefault(r["question_id"], {})[r["title"]] = round(r["score"], 9)
    for number, text in asked[:4]:
        one = {r["title"]: round(r["score"], 9) for r in tree.search(c, text).collect()}
        assert got.get(number, {}) == one
    assert 5 not in got and len(got[6]) == 3


def test_nearest_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 60)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6))
    x[300:] = x[:100]  # ties
    x[5] = x[6] + 1e-9
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(900, None, ""), (901, [1.0], ""), (None, [1.0] * 6, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in retrieval.nearest_each(df, df.where("vec_id % 9 = 0"), 5).collect()}
    for q in range(0, 400, 9):
        d = ((x - x[q]) ** 2).sum(1)
        want = sorted(range(400), key=lambda i: (d[i], i))[:5]
        assert [got[q, k][0] for k in range(1, 6)] == want and np.allclose([got[q, k][1] for k in range(1, 6)], d[want])
    assert retrieval.nearest_each(df, df.limit(0), 5).count() == 0 and retrieval.nearest_each(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 3


def test_a_stopped_upsert_leaves_the_old_table(spark, tmp_path, monkeypatch):
    kind, path = "row_id string, v int", str(tmp_path / "t")
    rows = lambda *xs: spark.createDataFrame(xs, kind)
    now = lambda: sorted(map(tuple, retrieval.versioned(spark, path, kind).collect()))
    assert now() == []
    retrieval.upsert(rows(("a", 1), ("b", 1), ("b", 3), ("b", 2)), path)
    assert now() == [("a", 1), ("b", 3)]

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(retrieval, "commit", stop)
        with pytest.raises(OSError):
            retrieval.upsert(rows(("a", 9)), path)
    assert now() == [("a", 1), ("b", 3)]
    for v in (4, 5, 6):
        retrieval.upsert(rows(("c", v), ("a", v)), path)
    assert now() == [("a", 6), ("b", 3), ("c", 6)]
    with pytest.raises(RuntimeError):
        retrieval.commit(spark, path, 1, "0000000002-late")


@pytest.fixture(scope="module")
def some_facts(spark):
    return facts.extract(spark.createDataFrame([("Costs", 1, "Paid $10 in 2024 and 5% more.", "h1"), ("Gains", 2, "Got $7.50 in 2023.", "h2")], CHUNK))


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM document_facts",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS x FROM document_facts",
    "SELECT try_reflect('java.lang.System', 'exit', 1) AS x FROM document_facts",
    "SELECT 'from document_facts' AS x",
    "SELECT (SELECT max(fact_value) FROM document_facts) AS x FROM document_facts",
    "SELECT fact_key FROM document_facts WHERE fact_value IN (SELECT fact_value FROM document_facts)",
    "SELECT input_file_name() AS x FROM document_facts",
    "SELECT current_user() AS x FROM document_facts",
    "SELECT explode(sequence(1, 1000000000)) AS x FROM document_facts",
    "SELECT rand() AS x FROM document_facts",
    "SELECT id FROM range(3), document_facts",
    "SELECT * FROM (VALUES (1)) AS v JOIN document_facts",
    "SELECT 1 AS x FROM document_facts, other",
])
def test_what_a_statement_may_not_do(spark, some_facts, sql):
    with pytest.raises(ValueError):
        facts.run_select(spark, some_facts, sql)


@pytest.mark.parametrize("sql, n", [
    ("SELECT fact_key, count(*) AS n, min(fact_value) AS low, avg(page_number) AS p FROM document_facts GROUP BY fact_key HAVING count(*) > 1 ORDER BY n DESC LIMIT 5", 2),
    ("SELECT DISTINCT upper(entity) AS e FROM document_facts WHERE fact_value LIKE '%20%' OR page_number BETWEEN 5 AND 6", 2),
    ("SELECT CASE WHEN page_number = 1 THEN 'a' ELSE coalesce(entity, '') END AS x, round(page_number / 3, 2) AS y FROM document_facts f WHERE NOT f.entity IN ('none');", 5),
    ("SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY fact_value) AS k FROM document_facts", 5),
    ("SELECT sum(cast(regexp_replace(fact_value, '[$,]', '') AS decimal(10,2))) AS total FROM document_facts WHERE fact_key = 'currency_amount'", 1),
    ("SELECT a.entity FROM document_facts a JOIN document_facts b ON a.fact_value = b.fact_value", 5),
])
def test_what_a_statement_may_do(spark, some_facts, sql, n):
    assert facts.run_select(spark, some_facts, sql).count() == n


def test_the_view_is_gone_afterwards(spark, some_facts):
    facts.run_select(spark, some_facts, "SELECT count(*) AS n FROM document_facts")
    with pytest.raises(AnalysisException):
        spark.table("document_facts")


def test_tools_are_told_by_name_and_navigation_tells_sections(spark):
    c = chunks(spark, "Finance > Plan", "Cash flow", "Finance > Cash")
    answer = qa.Engine(c).ask("Which section is about finance?")
    assert answer.tools == ["pageindex_navigate"] and answer.sections == ["Finance: Text 0 of Finance > Plan."]
    mine = qa.Engine(c, tools={"semantic_search": lambda q: c.where("page_number = 2")})
    assert "Text 1" in mine.ask("anything").text and mine.ask("anything").sections == []
    with pytest.raises(ValueError, match="no tool other"):
        mine.run_tool("other", "x")
