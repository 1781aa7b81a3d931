"""Question answering and claim audits: a small driver state machine over lazily built tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts as facts_ops
from ..operators import retrieval, tree
from . import refine

#: Words by which questions are told apart.
METRIC_WORDS = ("total", "sum", "compare", "list all", "revenue", "metric", "amount", "percentage")
OUTLINE_WORDS = ("outline", "structure", "table of contents")
SECTION_WORDS = ("section", "chapter", "summar", "overview")
TOOLS = ("semantic_search", "pageindex_navigate", "document_outline")
NOTHING = "No relevant evidence was found in the indexed document."


def is_metric(question: Column) -> Column:
    low, out = F.lower(question), F.lit(False)
    for w in METRIC_WORDS:
        out = out | low.contains(w)
    return out


def is_metric_question(question: str) -> bool:
    return any(w in question.lower() for w in METRIC_WORDS)


def tool_for(question: Column) -> Column:
    """First tool for a question, for tables of questions."""
    low = F.lower(question)
    has = lambda ws: F.coalesce(*[F.when(low.contains(w), True) for w in ws], F.lit(False))
    return F.when(has(OUTLINE_WORDS), "document_outline").when(has(SECTION_WORDS), "pageindex_navigate").otherwise("semantic_search")


def next_tool(question: str, used: list[str]) -> str:
    low = question.lower()
    first = "document_outline" if any(w in low for w in OUTLINE_WORDS) else "pageindex_navigate" if any(w in low for w in SECTION_WORDS) else "semantic_search"
    return first if first not in used else next((t for t in TOOLS if t not in used), first)


@dataclass
class Answer:
    """Text, evidence rows and the tools used."""

    text: str
    provenance: list[dict]
    tools: list[str] = field(default_factory=list)
    status: str = ""
    sections: list[str] = field(default_factory=list)


class Engine:
    """Answers over chunks (section_context, page_number, content, content_hash) without a language model.

    `search(question, k)` may be plugged in for vectors; by default texts rank by the lexical
    score. Evidence is a top-k, so what reaches the driver is bounded. `tools` adds tools by name, or
    replaces those of TOOLS: functions of a question that give rows of chunks, or of lines with a place for an outline.
    """

    def __init__(self, chunks: DataFrame, search: Callable[[str, int], DataFrame] | None = None, generate: Callable[[str, list[dict]], str] | None = None, top: int = 20, plan_sql: Callable[[str], dict] | None = None, max_lines: int = 1000, tools: dict[str, Callable[[str], DataFrame]] | None = None):
        self.chunks, self.top, self.generate, self.plan_sql, self.max_lines = chunks, top, generate, plan_sql, max_lines
        self.find = search or self._lexical
        self.tools = {"semantic_search": self._search, "pageindex_navigate": self._navigate, "document_outline": lambda _: tree.outline(tree.nodes(self.chunks)), **(tools or {})}

    def _lexical(self, question: str, k: int) -> DataFrame:
        score = T.lexical_similarity(T.tokens(F.lit(question)), T.tokens(F.col("content")))
        return self.chunks.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "content_hash").limit(k).drop("score")

    def _search(self, question: str) -> DataFrame:
        return self.find(question, self.top).select(*self.chunks.columns)

    def _navigate(self, question: str) -> DataFrame:
        return tree.search(self.chunks, question).select(*self.chunks.columns).orderBy("page_number", "content_hash").limit(self.top)

    def run_tool(self, tool: str, question: str) -> DataFrame:
        if tool not in self.tools:
            raise ValueError(f"no tool {tool}; there are {', '.join(sorted(self.tools))}")
        return self.tools[tool](question)

    def section_lines(self, found: DataFrame) -> list[str]:
        """Titles with summaries of the sections that found chunks, a top-k, stand in."""
        return [r["line"] for r in tree.summaries_of(self.chunks, found).orderBy("title").collect()]

    def ask(self, question: str, max_calls: int = 2) -> Answer:
        if is_metric_question(question):
            return self.ask_facts(question)
        used: list[str] = []
        rows: list[dict] = []
        while len(used) < max_calls and not rows:
            tool = "document_outline" if not question.strip() else next_tool(question, used)
            used.append(tool)
            if tool == "document_outline":
                lines = [r["line"] for r in self.run_tool(tool, question).orderBy("place").limit(self.max_lines + 1).collect()]  # a line more than is shown
                if len(lines) > self.max_lines:
                    lines[self.max_lines :] = [f"... (the first {self.max_lines} lines)"]
                return Answer("\n".join(lines), [], used)
            found = self.run_tool(tool, question)
            rows = [r.asDict() for r in found.collect()]  # a top-k
        sections = self.section_lines(found) if rows and tool == "pageindex_navigate" else []
        if not rows:
            return Answer(NOTHING, [], used)
        text = self.generate(question, rows) if self.generate else "\n".join(f"- {r['content']} (content_hash={r['content_hash']}, page={r['page_number']})" for r in rows[:5])
        return Answer(text, rows[:5], used, sections=sections)

    def ask_facts(self, question: str) -> Answer:
        """Questions of amounts: chunks are searched, their facts extracted, and the facts asked by a plan or by the question's words."""
        used = ["semantic_search"]
        found = self.run_tool("semantic_search", question)
        rows = [r.asDict() for r in found.collect()]  # a top-k
        facts = self.facts()
        if rows:
            used.append("extract_and_store_facts")
            facts = facts_ops.distinct(facts_ops.extract(found))
        used.append("sql_query_tool")
        asked = facts_ops.select_plan(facts, self.plan_sql(question)) if self.plan_sql else facts_ops.select_words(facts, question).orderBy(*facts_ops.COLUMNS)
        lines = [r.asDict() for r in asked.limit(25).collect()]
        if not lines and not rows:
            return Answer(NOTHING, [], used)
        if not lines:
            return Answer("\n".join(f"- {r['content']} (content_hash={r['content_hash']}, page={r['page_number']})" for r in rows[:5]), rows[:5], used)
        return Answer("\n".join("- " + ", ".join(f"{k}={v}" for k, v in r.items()) for r in lines), [r for r in lines if "content_hash" in r][:5], used)

    def facts(self) -> DataFrame:
        return facts_ops.distinct(facts_ops.extract(self.chunks))

    def audit(self, claim: str) -> Answer:
        """Searches for the claim, its sections and its contradiction; without a model a claim stays unverifiable, citing two."""
        seen: dict[str, dict] = {}
        tools = ["semantic_search", "pageindex_navigate", "semantic_search"]
        for tool, question in zip(tools, (claim, claim, f"contradiction or refutation of: {claim}")):
            for r in self.run_tool(tool, question).collect():  # a top-k
                seen.setdefault(r["content_hash"], r.asDict())
        rows = list(seen.values())
        reason = "No evidence was found." if not rows else "Evidence was found, but no model is set up to judge it."
        return Answer(f"Status: UNVERIFIABLE\nReasoning: {reason}", rows[:2], tools, "UNVERIFIABLE")


def open_engine(spark: SparkSession, folder: str, **hooks) -> Engine:
    """An engine over the chunks of a finished run; an error where tables of the run are missing."""
    chunks = refine.finished(spark, folder)["chunks"]
    return Engine(chunks.select(F.col("section").alias("section_context"), F.col("pages")[0].alias("page_number"), "content", "content_hash"), **hooks)


__all__ = ["Answer", "Engine", "open_engine", "is_metric", "next_tool", "retrieval", "tool_for"]
