"""Runs over files, what they leave, and what questions need of it."""

import pytest

from leafmill.config import Config
from leafmill.operators import triage, units, validation
from leafmill.plans import qa, refine


def parser():
    def parse(path, content):
        text = content.decode()
        if "broken" in text:
            raise ValueError("no document")
        for n, line in enumerate(text.splitlines()):
            yield {"page_number": 1 + n // 2, "uid": f"u{n:03d}", "unit_type": "header" if line.startswith("#") else "text", "content": line, "x1": 0.0, "y1": n / 10, "x2": 1.0, "y2": n / 10 + 0.1, "width": 600.0, "height": 800.0, "rect_count": n, "image_count": 0}

    return parse


def test_a_bad_file_leaves_the_run_going(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", bytearray(b"# Costs\nPaid $10 in 2024.\nMore.")), ("b.pdf", bytearray(b"broken")), ("c.pdf", bytearray(b"# Gains\nGot 5%."))], "path string, content binary")
    out = str(tmp_path / "run")
    manifest, failures = refine.refine_files(files, parser(), Config(min_chunk=2), out)
    assert failures == {} and {r["path"]: (r["status"], r["n_rows"], r["error"]) for r in manifest.collect()} == {"a.pdf": ("done", 3, None), "b.pdf": ("failed", 0, "ValueError: no document"), "c.pdf": ("done", 2, None)}
    tables = refine.finished(spark, out)
    assert {r["doc_id"] for r in tables["doc_profiles"].collect()} == {"a.pdf", "c.pdf"} and tables["page_profiles"].count() == 3
    assert {(r["fact_key"], r["fact_value"]) for r in tables["facts"].collect()} >= {("currency_amount", "$10"), ("year", "2024"), ("percentage", "5%")}
    boxes = {r["section"]: {b["page_number"]: (b["y1"], b["y2"]) for b in r["boxes"]} for r in tables["chunks"].collect()}
    assert boxes["# Costs"] == {1: (0.0, pytest.approx(0.2)), 2: (pytest.approx(0.2), pytest.approx(0.3))}
    assert "Paid $10" in qa.open_engine(spark, out).ask("What was paid in 2024?").text


def test_questions_need_a_finished_run(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "chunks"))
    with pytest.raises(FileNotFoundError) as e:
        qa.open_engine(spark, str(tmp_path))
    assert str(tmp_path / "facts") in str(e.value) and "chunks" not in str(e.value)


def test_pages_without_words_are_cut_at_blank_lines(spark):
    words = spark.createDataFrame([(1, 1, 2, 9.6, "c"), (1, 1, 0, 10.4, "a"), (1, 1, 1, 9.5, " b "), (1, 1, 3, 30.0, " ")], "doc_id long, page_number int, pos int, top double, word string")
    pages = spark.createDataFrame([(1, 1, "not read"), (1, 2, "one\ntwo\n\n \n\nthree"), (1, 3, None), (2, 1, "out of plan")], "doc_id long, page_number int, text string")
    plan = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 9)], "doc_id long, page_number int")
    got = [(r["page_number"], r["uid"], r["content"]) for r in units.fast_text_units(words, pages, plan).orderBy("page_number", "uid").collect()]
    assert got == [(1, "p1_000000", "a b c"), (2, "p2_000000", "one\ntwo"), (2, "p2_000001", "three")]
    assert units.fast_text_units(words, pages).where("doc_id = 2").count() == 1


def test_texts_of_documents_and_page_zero(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, 10, "c")], "doc_id long, page_number int, text string")
    assert triage.document_texts(pages).first()["text"] == "\nb\nc"
    bad = lambda checks: {r["check_name"]: r["bad_rows"] for r in validation.violations(spark.createDataFrame([(0,), (1,), (-1,), (None,)], "page_number int"), checks).collect()}
    assert bad(validation.CHECKS) == {"page_number": 3} and bad(validation.FROM_ZERO) == {"page_number": 2}
