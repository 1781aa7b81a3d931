"""Rule conditions against Python's own answers, and rules files."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from leafmill.config import METRICS, Config, condition_column, from_mapping, from_text, read_settings
from leafmill.functions import conditions
from leafmill.operators import triage

PAGES = [(0.0, 0, 612, 792), (0.0007, 51, 792, 612), (0.25, 10, 600, 600), (1.5, 66, 1, 2), (0.0005, 3, 0, 0)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "char_density double, rect_count int, width int, height int").withColumn("n", F.monotonically_increasing_id()).repartition(1).cache()


def python_says(text, page, config=Config()):
    names = dict(zip(("char_density", "rect_count", "width", "height"), page)) | {"rects": page[1]}
    limits = {"MIN_DIGITAL_DENSITY": config.min_digital, "TABLE_RECT_THRESHOLD": config.table_high, "TRIAGE_CONFIDENCE_GATE": config.confidence_gate}
    try:
        return bool(eval(text, {"__builtins__": {}}, names | limits))
    except Exception:
        return False


def random_text(r, depth):
    if depth == 0 or r.random() < 0.15:
        return r.choice(["rects", "width", "height", "char_density", "rect_count", "TABLE_RECT_THRESHOLD", "MIN_DIGITAL_DENSITY", "0", "3", "0.5", "50", "unheard", "True", "-1"])
    a, b, c = (random_text(r, depth - 1) for _ in range(3))
    kind = r.random()
    if kind < 0.3:
        return f"({a}) {r.choice(['and', 'or'])} ({b})"
    if kind < 0.4:
        return f"not ({a})"
    if kind < 0.5:
        return f"({a}) {r.choice(['<', '<='])} ({b}) {r.choice(['<', '>', '!='])} ({c})"
    if kind < 0.75:
        return f"({a}) {r.choice(['<', '<=', '>', '>=', '==', '!='])} ({b})"
    return f"({a}) {r.choice(['+', '-', '*', '/', '%', '//'])} ({b})"


def test_random_conditions_equal_python(pages):
    r = random.Random(8)
    texts = [random_text(r, 3) for _ in range(240)]
    for at in range(0, len(texts), 60):
        part = texts[at : at + 60]
        rows = pages.select(*METRICS.values(), *[condition_column(t, Config())[0].alias(f"c{i}") for i, t in enumerate(part)]).collect()
        for row in rows:
            want = [python_says(t, (row["char_density"], row["rect_count"], row["width"], row["height"])) for t in part]
            assert [row[f"c{i}"] for i in range(len(part))] == want, [t for i, t in enumerate(part) if row[f"c{i}"] != want[i]]


SHAPES = ["(rects > 3) and not (width > height)", "rects / width > 0.1", "0 < rects < 5", "rects > 3 or unheard > 1", "unheard > 1 or rects > 3", "not rects", "rects % -4 == -2", "-7 // 2 == -4", "width == height or 1 / 0", "rects and width"]


@pytest.mark.parametrize("text", SHAPES)
def test_conditions_that_once_were_false(pages, text):
    c, _ = condition_column(text, Config())
    for row in pages.withColumn("c", c).collect():
        assert row["c"] == python_says(text, (row["char_density"], row["rect_count"], row["width"], row["height"]))


@pytest.mark.parametrize("text, wrong", [("rects > unheard", "unknown name unheard"), ("__import__('os')", "unknown form __import__('os')"), ("rects.real > 1", "unknown form rects.real"), ("rects >", "no expression: rects >"), ("(lambda: 1)()", "unknown form (lambda: 1)()"), ("", "no expression: ")])
def test_what_is_not_known_is_false_and_reported(pages, text, wrong):
    c, found = condition_column(text, Config())
    assert found == [wrong] and pages.where(c).count() == 0


def test_when_form(pages):
    assert conditions.when_text({"metric": "page_width_gt_height"}) == "width > height"
    assert conditions.when_text({"metric": "rects", "operator": "GTE", "value": 3}) == "rects >= 3"
    assert pages.where(condition_column({"metric": "rects", "operator": "gte", "value": 51}, Config())[0]).count() == 2
    assert pages.where(condition_column({}, Config())[0]).count() == 0


def test_a_null_metric_is_an_error(spark):
    df = spark.createDataFrame([(None, 60, 1, 2)], "char_density double, rect_count int, width int, height int")
    holds = lambda t: df.where(condition_column(t, Config())[0]).count() == 1
    assert not holds("char_density < 1") and not holds("not char_density") and holds("rects > 1 or char_density < 1") and not holds("char_density < 1 or rects > 1")


FILE = """
version: "2.0"
thresholds:
\tchar_density: {min_digital: 0.002}
\trect_count: {table_high: 20, medium_complexity: 4}
\ttriage_confidence_gate: 0.6
\tmixed_mode_sample_size: 3
economic_guards: {vlm_budget_cap: 2.5, vlm_image_tile_size: 256, default_dpi: 140}
chunking_constitution:
  max_chunk_size: 77
  header_detection: {min_font_size: 9.5}
  semantic_boundary_indicators: ["@"]
strategy_mapping: {cost_tier_to_model: {low: x, HIGH: a/b}}
domain_registry: [{domain_hint: Sea, domain_keywords: [fish, Boat]}]
routing_rules:
  - {priority: 2, condition: "rects > 0", action: A}
  - {priority: 1, when: {metric: width, operator: lt, value: 2}, action: STRATEGY_B, reason: narrow}
  - {condition: "0 <= rects", action: odd, description: rest}
"""


def test_rules_file_changes_the_config(pages):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        c = from_text(FILE)
    assert (c.min_digital, c.table_high, c.medium_rects, c.confidence_gate, c.sample_pages, c.budget, c.tile) == (0.002, 20, 4, 0.6, 3, 2.5, 256)
    assert (c.max_chunk, c.min_font, c.markers, c.models, c.domains) == (77, 9.5, ("@",), {"LOW": "x", "HIGH": "a/b"}, (("Sea", ("fish", "Boat")),))
    got = {(r["rect_count"], r["width"]): (r["s"], r["r"]) for r in pages.select("rect_count", "width", triage.route(c, "action").alias("s"), triage.route(c, "reason").alias("r")).collect()}
    assert got == {(0, 612): ("STRATEGY_C", "rest"), (51, 792): ("STRATEGY_A", "Matched routing rule."), (10, 600): ("STRATEGY_A", "Matched routing rule."), (66, 1): ("STRATEGY_B", "narrow"), (3, 0): ("STRATEGY_B", "narrow")}


def test_what_changes_nothing_is_reported():
    c, wrong = read_settings({"thresholds": {"char_density": {"min_digital": -1}, "colour": 3}, "routing_rules": "none", "typo": {"x": 1}, "strategy_mapping": {"cost_tier_to_model": 4}, "rules": [{"if": "foo > 1", "then": {"strategy": "B"}}]})
    assert wrong == ["thresholds.char_density.min_digital is no positive number", "unknown setting thresholds.colour", "routing_rules is no list", "unknown setting typo.x", "strategy_mapping.cost_tier_to_model is no mapping", "rule 1: unknown name foo"]
    assert c.min_digital == Config().min_digital and c.models == Config().models
    with pytest.warns(UserWarning, match="unknown setting typo"):
        from_mapping({"typo": 1})
    with pytest.raises(ValueError):
        from_text("[1]")
