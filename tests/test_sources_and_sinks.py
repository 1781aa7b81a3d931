"""Files through parsers, refined documents, the exactly-once sink, and attempts as a stream."""

import json
import time
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from leafmill.operators import attempts, extraction
from leafmill.sources import parsing
from leafmill.streaming import attempts as stream
from leafmill.streaming import ledger, sink


def line_parser():
    def lines(path, content):
        if b"bad" in content:
            raise RuntimeError("can't read " + path[-6:])
        for i, x in enumerate(content.decode().split()):
            yield {"n": i, "word": int(x) if x == "7" else x}

    return lines


def test_one_broken_file_of_ten(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"f{i}.pdf").write_text("a bad b" if i == 3 else "one two" if i else " ")
    (tmp_path / "other.txt").write_text("bad")
    found = parsing.listing(spark, str(tmp_path)).collect()
    assert [r["path"][-6:] for r in found] == [f"f{i}.pdf" for i in range(10)] and found[1]["length"] == 7
    rows, manifest = parsing.parse_to(parsing.files(spark, str(tmp_path)), line_parser(), "n int, word string", str(tmp_path / "parsed"))
    assert rows.count() == 16 and sorted(rows.columns) == ["n", "path", "word"]
    m = {r["path"][-6:]: (r["status"], r["n_rows"], r["error"]) for r in manifest.collect()}
    assert len(m) == 10 and m["f0.pdf"] == ("done", 0, None) and m["f3.pdf"] == ("failed", 0, "RuntimeError: can't read f3.pdf") and m["f4.pdf"] == ("done", 2, None)


def test_rows_that_do_not_fit_are_the_files_error(spark):
    df = spark.createDataFrame([("x", bytearray(b"7 a")), ("y", bytearray(b"a")), ("z", None)], "path string, content binary")
    parsed = parsing.parse(df, line_parser(), "n int, word string")
    assert [r["path"] for r in parsing.dead_letters(parsed).collect()] == ["x"] and parsing.rows(parsed).count() == 1 and parsing.manifest(parsed).count() == 3


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        parsing.files(spark, str(tmp_path))


def test_indented_documents_and_broken_ones(spark, tmp_path):
    unit = {"uid": "u", "unit_type": "table", "content_raw": "r", "content_markdown": "| m |", "bbox": {"x1": 0.1, "y1": 0, "x2": 0.9, "y2": 1}, "provenance": {"page_number": 4}}
    (tmp_path / "a_refined.json").write_text(json.dumps({"file_id": "A", "units": [unit, {"content_raw": "plain"}, "no unit", {"content_raw": " "}]}, indent=4))
    (tmp_path / "b_refined.json").write_text('{"units": [{"content_markdown": "x", "provenance": {"page_number": 0}}')
    (tmp_path / "c_refined.json").write_text('{"units": [{"content_markdown": "x", "provenance": {"page_number": 0}}]}')
    (tmp_path / "d_refined.json").write_text("[1, 2]")
    (tmp_path / "e_refined.json").write_text('{"file_id": "E", "units": 3}')
    units, broken = parsing.refined(spark, str(tmp_path))
    got = {(r["file_id"], r["n"]): (r["page_number"], r["content"], r["x1"], r["x2"], r["section_context"]) for r in units.collect()}
    assert got == {("A", 0): (4, "| m |", 0.1, 0.9, "A > table"), ("A", 1): (1, "plain", 0.0, 1.0, "A > text"), ("c_refined", 0): (1, "x", 0.0, 1.0, "c_refined > text")}
    assert sorted((r["path"][-14:-5], r["error"]) for r in broken.collect()) == [("b_refined", "no JSON"), ("d_refined", "no JSON object")]


ROWS = "file_id string, page_number int, attempt_no int, strategy string, status string, confidence double, cost double, processing_time_ms double, breaks boolean"


def chain(file, page, a, b, c, cost=0.4, breaks=False):
    each = [("STRATEGY_A", a), ("STRATEGY_B", b), ("STRATEGY_C", c)]
    return [(file, page, i + 1, s, ok, 0.5, cost, 3.0, breaks and s == "STRATEGY_C") for i, (s, ok) in enumerate(each)]


OUTCOMES = [
    *chain("budget", 1, "fail", "fail", "success"), *chain("budget", 2, "success", "fail", "fail"), *chain("budget", 3, "fail", "fail", "success"), *chain("budget", 4, "fail", "fail", "success"), *chain("budget", 5, "fail", "success", "success"),
    *chain("outage", 1, "fail", "fail", "fail", 0.1, True), *chain("outage", 2, "fail", "fail", "success"), *chain("outage", 3, "success", "fail", "success"),
    # an outage that is never reached, and one that comes when the budget is gone
    *chain("calm", 1, "fail", "success", "fail", 0.1, True), *chain("calm", 2, "fail", "fail", "success", 0.9), *chain("calm", 3, "fail", "fail", "fail", 0.1, True), *chain("calm", 4, "fail", "fail", "success"),
]


def by_hand(rows, budget):
    """The loop over a document's pages, one attempt after the other."""
    out = {}
    for file in {r[0] for r in rows}:
        spend, off, done = Decimal(0), False, None
        for r in sorted(x for x in rows if x[0] == file):
            if done == r[1]:
                continue
            vision = r[3] == "STRATEGY_C"
            why = "disabled" if vision and off else "budget" if vision and spend >= Decimal(str(budget)) else None
            status = "fail" if why else r[4]
            out[file, r[1], r[2]] = (status, why, float(spend), 0.0 if why else r[6])
            if vision and not why:
                spend, off = spend + Decimal(str(r[6])), off or r[8]
            done = r[1] if status == "success" else done
    return out


def outcome_of(df):
    return {(r["file_id"], r["page_number"], r["attempt_no"]): (r["status"], r["skipped"], r["spend_before"], r["cost"]) for r in df.collect()}


def test_spending_and_outages_change_later_pages(spark):
    got = outcome_of(attempts.made(spark.createDataFrame(OUTCOMES, ROWS), 0.8))
    assert got == by_hand(OUTCOMES, 0.8)
    assert got["budget", 4, 3][:2] == ("fail", "budget") and got["outage", 2, 3][:2] == ("fail", "disabled") and got["calm", 3, 3][1] == got["calm", 4, 3][1] == "budget"
    pages = {(r["file_id"], r["page_number"]): r["final_status"] for r in extraction.page_results(attempts.made(spark.createDataFrame(OUTCOMES, ROWS), 0.8)).collect()}
    assert pages["budget", 3] == "success" and pages["budget", 4] == "fail" and pages["outage", 3] == "success"


def test_random_attempts(spark):
    import random

    r = random.Random(5)
    rows = [x for f in range(40) for p in range(1, 12) for x in chain(f"f{f}", p, *(r.choice(["fail", "fail", "success"]) for _ in range(3)), r.choice([0.0, 0.1, 0.3]), r.random() < 0.1)]
    assert outcome_of(attempts.made(spark.createDataFrame(rows, ROWS), 0.6)) == by_hand(rows, 0.6)


def test_errors_decide_outcomes(spark):
    rows = [("STRATEGY_C", True, 0.9, None), ("STRATEGY_C", True, 0.9, "Insufficient Credits left"), ("STRATEGY_B", True, 0.9, "host cannot be reached"), ("STRATEGY_C", True, 0.9, "cannot be reached"), ("STRATEGY_C", True, 0.9, "timeout"), ("STRATEGY_A", False, 0.2, None)]
    got = attempts.outcomes(spark.createDataFrame(rows, "strategy string, success boolean, confidence double, error string").coalesce(1)).collect()
    assert [(r["status"], r["confidence"], r["breaks"]) for r in got] == [("success", 0.9, False), ("fail", 0.0, True), ("fail", 0.0, False), ("fail", 0.0, True), ("fail", 0.0, False), ("fail", 0.2, False)]


def test_attempts_as_a_stream_equal_the_batch(spark, tmp_path):
    for n, pages in enumerate(((1, 2), (3,), (4, 5), (2,))):  # the last batch comes late
        spark.createDataFrame([r for r in OUTCOMES if r[1] in pages], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.run(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), 0.8, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    out = sink.read(spark, f"{tmp_path}/out", stream.OUT)
    assert outcome_of(out.where("skipped IS NULL OR skipped <> 'late'")) == by_hand(OUTCOMES, 0.8)
    assert {r["page_number"] for r in out.where("skipped = 'late'").collect()} == {2}


def events(spark, folder, *rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)


def test_a_stop_in_mid_batch_gives_each_event_once(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    source, kind = f"{tmp_path}/in", "event_id long, ts timestamp, event_type string, value double"
    stopping = []

    def commit(session, folder, name, entry):
        if stopping:
            raise OSError("stopped between the data and its entry")
        sink._commit(session, folder, name, entry)

    def start():
        rows = ledger.deduplicated(spark.readStream.schema(kind).parquet(source), "1 day")
        return sink.write(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint", commit=commit)

    events(spark, source, (1, t, "a", 1.0), (2, t, "a", 1.0), (1, t, "a", 1.0))
    start().awaitTermination()
    events(spark, source, (3, t, "a", 1.0), (2, t, "a", 1.0))
    stopping.append(True)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped between"):
            start().awaitTermination()
        assert sorted(r["event_id"] for r in sink.read(spark, f"{tmp_path}/out", kind).collect()) == [1, 2]
    stopping.clear()
    start().awaitTermination()
    assert sorted(r["event_id"] for r in sink.read(spark, f"{tmp_path}/out", kind).collect()) == [1, 2, 3]
    assert sorted(r["rows"] for r in sink.log(spark, f"{tmp_path}/out").collect() if r["rows"]) == [1, 2]
    # another query's batches, numbered from 0 again, are kept as well
    sink.write(spark.readStream.schema(kind).parquet(source), f"{tmp_path}/out", f"{tmp_path}/other").awaitTermination()
    assert sink.read(spark, f"{tmp_path}/out", kind).count() == 3 + 5


def test_a_batch_that_is_taken_again_changes_nothing(spark, tmp_path):
    take = sink.taker(f"{tmp_path}/out")
    for n in (0, 0, 1):
        take(spark.range(3), n)
    assert sink.read(spark, f"{tmp_path}/out", "id long").count() == 6
    assert sink.read(spark, f"{tmp_path}/none", "id long").count() == 0


def test_hours_once_and_late_events_counted(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    source, kind = f"{tmp_path}/in", "event_id long, ts timestamp, event_type string, value double"
    late = sink.LateRows()
    spark.streams.addListener(late)
    try:
        for batch in ([(1, t, "a", 1.0), (2, t + timedelta(minutes=30), "a", 2.0)], [(3, t + timedelta(hours=3), "a", 5.0)], [(4, t, "a", 9.0), (5, t + timedelta(hours=5), "b", 1.0)], [(6, t + timedelta(hours=9), "b", 1.0)]):
            events(spark, source, *batch)
            rows = ledger.hourly_final(spark.readStream.schema(kind).parquet(source), "30 minutes")
            q = sink.write(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
            q.awaitTermination()
        for _ in range(50):
            if late.dropped.get(str(q.id)):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    got = sink.read(spark, f"{tmp_path}/out", "hour_start timestamp, event_type string, n long, value double").orderBy("hour_start").collect()
    assert [(r["hour_start"].hour, r["n"], r["value"]) for r in got] == [(10, 2, 3.0), (13, 1, 5.0), (15, 1, 1.0)] and late.dropped[str(q.id)] == 1


def test_vision_may_be_unsure_of_what_it_has_found(spark):
    from leafmill.config import Config
    from leafmill.operators import units

    pages = spark.createDataFrame([(1, 1, "STRATEGY_C", "hybrid", 0.0, False, None, True), (1, 2, "STRATEGY_C", "hybrid", 0.0, False, None, False)], "doc_id long, page_number int, strategy string, origin_type string, char_density double, has_fonts boolean, engine double, uncertain boolean")
    found = spark.createDataFrame([(1, 1, "u", "text", "x"), (1, 2, "u", "text", "x")], "doc_id long, page_number int, uid string, unit_type string, content string")
    assert {r["page_number"]: r["confidence"] for r in units.judged_pages(pages, found, Config()).collect()} == {1: 0.7, 2: 0.95}
