"""Facts of chunks and the guarded, read-only SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import spread

COLUMNS = ["fact_key", "fact_value", "entity", "content_hash", "page_number"]


def extract(chunks: DataFrame) -> DataFrame:
    """One row per amount, percentage and year of each chunk (section_context, page_number, content, content_hash)."""
    found = chunks.select(F.explode(T.facts(F.col("content"))).alias("f"), F.col("section_context").alias("entity"), "content_hash", "page_number")
    found = found.select("f.fact_key", "f.fact_value", "entity", "content_hash", "page_number")
    return found.where("fact_key <> '' AND fact_value <> '' AND content_hash <> ''")


def distinct(facts: DataFrame) -> DataFrame:
    return facts.dropDuplicates(COLUMNS)


def distinct_of(chunks: DataFrame) -> DataFrame:
    """distinct(extract(chunks)), with each chunk shuffled once in place of each of its facts, by its hash; equal facts have equal hashes, so the rest happens where they are."""
    return distinct(extract(spread(chunks.select("section_context", "page_number", "content", "content_hash").where("content_hash <> ''"), "content_hash")))


def append(facts: DataFrame, path: str) -> int:
    """Appends facts to a table's folder; returns how many were written, as observed while writing."""
    seen = Observation()
    facts.select(*COLUMNS).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def select_plan(facts: DataFrame, plan: dict) -> DataFrame:
    """Rows or a count for a plan of contains- and equals-conditions."""
    out = facts
    for column, key in (("fact_key", "fact_key_like"), ("entity", "entity_like"), ("fact_value", "fact_value_like")):
        term = str(plan.get(key) or "").strip().lower()
        out = out.where(F.lower(column).contains(term)) if term else out
    if str(plan.get("content_hash_eq") or "").strip():
        out = out.where(F.col("content_hash") == str(plan["content_hash_eq"]).strip())
    if re.fullmatch(r"\s*-?\d+\s*", str(plan.get("page_number_eq", ""))):
        out = out.where(F.col("page_number") == int(plan["page_number_eq"]))
    if str(plan.get("select_mode", "rows")).strip().lower() == "count":
        return out.agg(F.count("*").alias("total_rows"))
    limit = str(plan.get("limit") or 25)
    limit = int(limit) if re.fullmatch(r"-?\d+", limit) else 25
    return out.select(*COLUMNS).orderBy(*COLUMNS).limit(max(1, min(limit, 100)))


def select_words(facts: DataFrame, question: str) -> DataFrame:
    """Rows for a question in words: revenue totals, all facts, or those that hold the question as a term."""
    low = question.lower()
    if "revenue" in low and ("total" in low or "sum" in low):
        term = "revenue"
    elif "list all" in low or "all facts" in low:
        return facts.select(*COLUMNS)
    else:
        term = re.sub(r"[^a-z0-9\s]", "", low).strip()
    return facts.where(F.lower("entity").contains(term) | F.lower("fact_key").contains(term)).select(*COLUMNS)


#: Words that a statement may not hold.
FORBIDDEN = ("drop", "delete", "update", "insert", "alter", "create", "replace", "truncate", "pragma")
#: Kinds of plan nodes and of expressions that a statement may come to; any other is refused, whatever it is called in SQL.
PLANS = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "Window", "Union", "Join", "WithCTE", "CTERelationDef", "CTERelationRef"}
EXPRESSIONS = set(
    """Alias AttributeReference OuterReference Literal Cast SortOrder NamedParameter PosParameter
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In IsNull IsNotNull Between
    Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Abs Round BRound Floor Ceil RoundFloor RoundCeil Greatest Least
    With CommonExpressionDef CommonExpressionRef CaseWhen If Coalesce NullIf IfNull Nvl Lower Upper Length StringTrim StringTrimLeft StringTrimRight Substring Left Right Concat ConcatWs
    Like ILike RLike Contains StartsWith EndsWith RegExpReplace RegExpExtract StringReplace StringInstr TryCast TryToNumber ToNumber
    AggregateExpression Count Sum Average Min Max CountIf StddevSamp StddevPop VarianceSamp VariancePop Median Percentile First Last
    WindowExpression WindowSpecDefinition SpecifiedWindowFrame RowNumber Rank DenseRank CurrentRow$ UnboundedPreceding$ UnboundedFollowing$""".split()
)


def check_select(sql: str) -> str:
    """What is wrong with a statement's words, or nothing: one SELECT and no word that changes data. What it reads and calls is told by its plan (see run_select)."""
    plain = " ".join(sql.lower().split())
    if not plain.startswith("select"):
        return "A statement has to be a SELECT."
    if set(re.findall(r"[a-z_]+", plain)) & set(FORBIDDEN):
        return "The statement holds a forbidden word."
    if ";" in plain[:-1]:
        return "Only one statement is allowed."
    if "from document_facts" not in plain:
        return "The statement has to read document_facts."
    return ""


def _each(items: object) -> list:
    """A Scala sequence as a list."""
    return [items.apply(i) for i in range(items.size())]


def check_plan(analysed: object, relation: str) -> str:
    """What is wrong with a statement's analysed plan, or nothing: only known kinds of nodes and expressions, and no other leaf than `relation`."""
    read, todo = 0, [analysed]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "SubqueryAlias" and node.alias().lower() == relation:
            read += 1  # what is below are the facts themselves
            continue
        if kind not in PLANS:
            return f"The statement comes to {kind}, which isn't allowed."
        todo += _each(node.children())
        inside = _each(node.expressions())
        while inside:
            e = inside.pop()
            kind = e.getClass().getSimpleName()
            if kind not in EXPRESSIONS:
                return f"The statement calls {kind}, which isn't allowed."
            inside += _each(e.children())
    return "" if read else f"The statement doesn't read {relation}."


def run_select(spark: SparkSession, facts: DataFrame, sql: str, args: list | None = None) -> DataFrame:
    """Runs a guarded statement over the facts, named document_facts. Nothing runs before its analysed plan has passed check_plan."""
    if wrong := check_select(sql):
        raise ValueError(wrong)
    plain = sql.rstrip().rstrip(";")
    if others := relations(spark, plain) - {"document_facts"}:
        raise ValueError(f"The statement reads {', '.join(sorted(others))}.")
    facts.createOrReplaceTempView("document_facts")
    try:
        found = spark.sql(plain, args=args or [])
    finally:  # the plan has the facts by now
        spark.catalog.dropTempView("document_facts")
    if wrong := check_plan(found._jdf.queryExecution().analyzed(), "document_facts"):
        raise ValueError(wrong)
    return found


def relations(spark: SparkSession, sql: str) -> set[str]:
    """The tables that a statement names, wherever in it, by Spark's own parser."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    return {x.strip().lower() for x in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan)} | {f"{x}()" for x in re.findall(r"'UnresolvedTableValuedFunction \[([^\]]*)\]", plan)}
