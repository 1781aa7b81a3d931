"""Registered queries of the engine, one per operator or group of operators, over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CORPUS, LEGACY_DOMAINS, SMALL_CHUNKS, Config, from_text
from .functions import text as T
from .operators import attempts, chunking, extraction, facts, ledger, retrieval, tree, triage, units, validation
from .plans import qa
from .sources import parsing
from .sources import tables as S
from .sources.shared import new_folder
from .streaming import attempts as attempt_stream
from .streaming import ledger as stream
from .streaming import sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _md5(c: str):
    return F.md5(F.col(c).cast("binary"))


@query
def page_profiles(spark, d):
    p = triage.page_profiles(S.doc_pages(spark, d), CORPUS)
    return p.select("doc_id", "page_number", F.round("char_density", 9).alias("char_density"), "is_landscape", "detected_origin", "dominant_strategy", "reason")


#: Rules as a file gives them: parentheses, chains, arithmetic, the `when` form, an error that decides and one that is never reached.
RULES_FILE = """
thresholds:
  char_density: {min_digital: 0.0004}
  rect_count: {table_high: 45}
economic_guards: {vlm_budget_cap: 12.5}
chunking_constitution:
  max_chunk_size: 300
domain_registry:
  - {domain_hint: Banking/Security, domain_keywords: [Token, Licensed]}
routing_rules:
  - {name: seventh, priority: 7, condition: "char_density == 0.0", action: {strategy: C}, description: No text.}
  - {name: first, priority: 1, condition: "(rects > TABLE_RECT_THRESHOLD) and not (width > height)", action: B, reason: Tables upright.}
  - {name: second, priority: 2, when: {metric: rect_count, operator: lte, value: 5}, action: STRATEGY_A, reason: Few rectangles.}
  - {name: third, priority: 3, condition: "0 < rects % 7 < 3 and char_density > MIN_DIGITAL_DENSITY", action: A, reason: Chained.}
  - {name: fourth, priority: 4, condition: "1 / (rects - rects) > 1 or rects > 10", action: B, reason: Never.}
  - {name: fifth, priority: 5, condition: "rects > 30 or 1 / (rects - rects) > 1", action: B, reason: Decided before the error.}
  - {name: sixth, priority: 6, condition: "char_density * 1000 - rects / 10 >= -1.5", action: A}
"""


@query
def ruled_pages(spark, d):
    """Pages routed by a rules file."""
    p = triage.page_profiles(S.doc_pages(spark, d), from_text(RULES_FILE, CORPUS))
    return p.select("doc_id", "page_number", "detected_origin", "dominant_strategy", "reason")


@query
def doc_triage(spark, d):
    p = triage.doc_profiles(S.doc_pages(spark, d), CORPUS)
    return p.select("doc_id", "total_pages", "scanned_pages", "overall_origin", "origin_type", "layout_complexity", "mixed_mode", "domain_hint", "triage_confidence", "cost_tier")


@query
def triage_manifest_counts(spark, d):
    p = triage.doc_profiles(S.doc_pages(spark, d), CORPUS)
    sets = p.groupingSets([[F.col("overall_origin")], [F.col("domain_hint")]], "overall_origin", "domain_hint")
    return sets.agg(F.count("*").alias("documents"), F.sum("total_pages").alias("pages"))


@query
def legacy_triage(spark, d):
    return triage.legacy_profiles(S.doc_pages(spark, d), CORPUS)


@query
def domain_hints(spark, d):
    return S.table(spark, d, "documents").select("doc_id", triage.domain_hint(F.col("text"), CORPUS).alias("domain_hint"), triage.domain_hint(F.col("text"), Config()).alias("default_hint"))


@query
def density_report(spark, d):
    p = triage.page_profiles(S.doc_pages(spark, d), CORPUS)
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.round(F.avg("char_density"), 9).alias("avg_density"), F.sum(F.length("text")).alias("text_length"), F.sum("image_count").alias("images"), F.sum("rect_count").alias("rects"), F.sum(T.token_count(F.col("text"))).alias("tokens"))


@query
def fast_text_confidence(spark, d):
    p = triage.page_profiles(S.doc_pages(spark, d), CORPUS)
    return p.select("doc_id", "page_number", F.round(extraction.fast_confidence(F.col("char_density"), F.col("rect_count") % 2 == 0, CORPUS), 6).alias("confidence"))


@query
def ocr_confidence(spark, d):
    p = triage.page_profiles(S.doc_pages(spark, d), CORPUS)
    parsed, engine = F.col("text") != "", F.when(F.col("image_count") == 1, (F.col("rect_count") % 10) / 10)
    conf = extraction.layout_confidence(parsed, T.text_clarity(F.col("text")), engine, (F.col("rect_count") > 50).cast("int"), parsed.cast("int"), F.col("char_density"), CORPUS)
    return p.select("doc_id", "page_number", F.round(conf, 6).alias("confidence"))


@query
def text_clarity(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.round(T.text_clarity(F.col("text")), 6).alias("clarity"), T.token_count(F.col("text")).alias("tokens"))


@query
def content_hash(spark, d):
    h = T.content_hash(F.col("text"), F.col("page_number"), F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    return S.doc_pages(spark, d).select("doc_id", "page_number", h.alias("content_hash"))


@query
def provenance_hash(spark, d):
    p = triage.page_profiles(S.doc_pages(spark, d), CORPUS)
    h = T.provenance_hash(F.concat(F.lit("doc_"), "doc_id"), F.col("page_number"), F.col("dominant_strategy"), F.lit("2024-01-01T00:00:00Z"), F.array("dominant_strategy"))
    return p.select("doc_id", "page_number", h.alias("provenance_hash"))


@query
def strategy_chain(spark, d):
    pages = S.doc_pages(spark, d)
    docs = triage.doc_profiles(pages, CORPUS).select("doc_id", "origin_type")
    p = triage.page_profiles(pages, CORPUS).select("doc_id", "page_number", "dominant_strategy").join(docs, "doc_id", "left")
    chain = extraction.strategy_chain(F.coalesce("origin_type", F.lit("unknown")), F.col("dominant_strategy"))
    need = extraction.required_confidence(chain[0], F.col("origin_type"), CORPUS)
    return p.select("doc_id", "page_number", F.array_join(chain, ",").alias("chain"), need.alias("required_confidence"))


@query
def table_islands(spark, d):
    u = chunking.table_islands(S.order_units(spark, d))
    return u.groupBy("doc_id", "island").agg(F.count("*").alias("units"), F.min("unit_type").alias("unit_type"), F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n\n").cast("binary")).alias("content_md5"))


@query
def section_context(spark, d):
    return chunking.sections(S.line_units(spark, d), SMALL_CHUNKS).select("doc_id", "page_number", "uid", "section", "is_boundary")


@query
def chunk_pack(spark, d):
    return chunking.pack(S.line_units(spark, d), SMALL_CHUNKS).select("doc_id", "chunk_no", "tokens", "section", F.size("pages").alias("n_pages"), _md5("content").alias("content_md5"))


@query
def orphan_merge(spark, d):
    c = chunking.merge_orphans(chunking.pack(S.line_units(spark, d), SMALL_CHUNKS), SMALL_CHUNKS)
    return c.select("doc_id", "merged_no", "parts", "tokens", "section", "content_hash")


@query
def chunk_defaults(spark, d):
    """With the default sizes, over orders with their table units."""
    c = chunking.merge_orphans(chunking.pack(S.order_units(spark, d), Config()), Config())
    return c.select("doc_id", "merged_no", "tokens", "section", F.round("y2", 4).alias("y2"))


@query
def chunk_page_index(spark, d):
    c = chunking.merge_orphans(chunking.pack(S.line_units(spark, d), SMALL_CHUNKS), SMALL_CHUNKS)
    return chunking.page_index(c).select("doc_id", "page_number", "chunks")


def _boxed_lines(spark, d):
    """Line units with boxes by their place on the page."""
    n = F.split("uid", "_")[1].cast("int")
    return S.line_units(spark, d).withColumns({"x1": (F.length("content") % 5) / 10, "y1": n / 8, "x2": 0.5 + (F.length("content") % 5) / 10, "y2": (n + 1) / 8})


@query
def chunk_boxes(spark, d):
    """The box of each merged chunk on each of its pages."""
    c = chunking.merge_orphans(chunking.pack(_boxed_lines(spark, d), SMALL_CHUNKS), SMALL_CHUNKS)
    return chunking.chunk_boxes(c).select("doc_id", "merged_no", "page_number", *[F.round(k, 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query
def node_boxes(spark, d):
    """The box of each section on each page, from its chunks' boxes."""
    c = _boxed_chunks(spark, d).withColumn("boxes", F.array(F.struct("page_number", "x1", "y1", "x2", "y2")))
    return tree.node_boxes(c)


@query
def html_units(spark, d):
    return S.html_units(spark, d)


def _page_parser(path, content):
    """A stand-in for a plugged-in parser: title and paragraphs of a page; a page cut off is an error."""
    text = content.decode()
    if "</html>" not in text:
        raise ValueError("cut off")
    title = text.partition("<title>")[2].partition("</title>")[0]
    for n, part in enumerate(text.partition("<article>")[2].split("<p>")[1:]):
        yield {"n": n, "title": title, "size": len(part)}


@query
def parsed_pages(spark, d):
    """Pages as files through a parser: each once, with its rows or its error."""
    files = S.table(spark, d, "pages").select(F.concat(F.lit("page_"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return parsing.manifest(parsing.parse(files, _page_parser, "n int, title string, size int"))


@query
def refined_documents(spark, d):
    """Units of refined documents, one JSON text per order; some lack parts, some are broken."""
    o = S.table(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 9)
    box = F.when(F.col("k") != 2, F.struct(F.lit(0.25).alias("x1"), F.lit(0.5).alias("y2")))
    head = F.struct(F.lit("a").alias("uid"), F.lit("header").alias("unit_type"), F.concat(F.lit(" Order "), "o_orderkey").alias("content_markdown"), F.lit("raw").alias("content_raw"), box.alias("bbox"), F.struct((F.col("k") - 1).alias("page_number")).alias("provenance"))
    bare = F.struct(F.lit("b").alias("uid"), F.lit(None).cast("string").alias("unit_type"), F.lit("  ").alias("content_markdown"), F.when(F.col("k") != 3, F.col("o_orderstatus")).alias("content_raw"), F.lit(None).cast("struct<x1: double, y2: double>").alias("bbox"), F.lit(None).cast("struct<page_number: bigint>").alias("provenance"))
    text = F.to_json(F.struct(F.when(F.col("k") != 4, F.concat(F.lit("doc"), "o_orderkey")).alias("file_id"), F.array(head, bare).alias("units")), {"pretty": "true"})
    value = F.when(F.col("k") == 5, F.left(text, F.lit(40))).when(F.col("k") == 6, F.lit("[1]")).otherwise(text)
    units, broken = parsing.refined_units(o.select(F.concat(F.lit("/in/o"), "o_orderkey", F.lit("_refined.json")).alias("path"), value.alias("value")))
    found = units.select("file_id", "n", "page_number", "unit_type", "content", "x1", "y2", "section_context")
    return found.unionByName(broken.select(F.col("path").alias("file_id"), F.col("error").alias("content")), allowMissingColumns=True)


@query
def layout_counters(spark, d):
    u = S.html_units(spark, d)
    return u.groupBy("page_id").agg(F.count_if(F.col("unit_type") == "header").alias("headers"), F.count_if(F.col("unit_type") == "text").alias("texts"), F.count_if(F.col("tag") == "li").alias("items"), F.sum(T.token_count(F.col("content"))).alias("tokens"))


@query
def page_lines(spark, d):
    """Words with a height become lines by rounded height."""
    w = S.table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("words"))
    return units.height_lines(w, F.lit(0.4)).select("doc_id", F.col("line_key").cast("int").alias("line_key"), "line")


@query
def fast_text_units(spark, d):
    """Lines of words by their height; pages without words by the blank lines of their text; of planned pages."""
    k = F.col("doc_id") + F.col("page_number")
    pages = S.doc_pages(spark, d).withColumn("text", F.regexp_replace("text", "\n", F.when(k % 3 == 0, "\n\n").otherwise("\n")))
    words = pages.where(k % 3 != 0).select("doc_id", "page_number", F.posexplode(T.words(F.col("text"))).alias("pos", "word")).withColumn("top", F.col("pos") * 0.4)
    return units.fast_text_units(words, pages, _plan(spark, d)[1]).select("doc_id", "page_number", "uid", "content")


@query
def document_texts(spark, d):
    return triage.document_texts(S.doc_pages(spark, d)).select("doc_id", F.length("text").alias("n_chars"), _md5("text").alias("text_md5"))


@query
def ledger_validation(spark, d):
    """Checks of ledger rows, some of which stand for a document as a whole; some are spoilt."""
    e = ledger.entries(extraction.page_results(extraction.escalate(S.attempts(spark, d))))
    e = e.withColumn("page_number", F.col("page_number") - F.when(F.col("file_name").cast("long") % 10 == 3, 2).otherwise(1)).withColumnRenamed("cost_estimate", "cost")
    return validation.violations(e.select("page_number", "cost", "processing_time_ms"), validation.FROM_ZERO)


@query
def ocr_word_confidence(spark, d):
    v = F.col("value").try_cast("double")
    return S.table(spark, d, "events").groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.when(v >= 0, v)) / 100)), 6).alias("confidence"))


@query
def metadata_codec(spark, d):
    """Pages as stored and as read back; some stored texts hold what isn't a page."""
    p = S.doc_pages(spark, d).where("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))
    m = p.withColumn("m", retrieval.to_metadata(F.col("pages"), F.lit("Unknown"), F.lit(1)))
    stored = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x, -2,"), "m.page_numbers")).when(F.col("doc_id") % 7 == 1, F.lit("0,none")).otherwise(F.col("m.page_numbers"))
    back = retrieval.from_metadata(stored)
    return m.select("doc_id", stored.alias("page_numbers"), F.array_join(back.cast("array<string>"), ";").alias("read_back"), (back == F.col("pages")).alias("same"))


@query
def section_tree(spark, d):
    return tree.nodes(S.section_chunks(spark, d)).select("node_id", "parent_id", "depth", "node_type", "title", "min_page", "max_page", "chunk_count", "pages_covered")


@query
def tree_root(spark, d):
    return tree.root(S.section_chunks(spark, d))


@query
def doc_outline(spark, d):
    return tree.outline(tree.nodes(S.section_chunks(spark, d))).withColumn("place", F.array_join(F.col("place").cast("array<string>"), "."))


@query
def tree_exported(spark, d):
    """Trees of documents, one a market segment, as nested JSON and read back."""
    by = ("c_mktsegment",)
    chunks = S.section_chunks(spark, d).withColumn("c_mktsegment", F.split("section_context", " > ")[2])
    rows = tree.read_nested(tree.nested(tree.nodes(chunks, by), by), by)
    return rows.select(*by, "node_id", "parent_id", "depth", "title", "chunk_count", "pages_covered", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"))


@query
def questions_search(spark, d):
    """The best sections for every turn of the users."""
    turns = S.table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    found = tree.search_each(S.section_chunks(spark, d), turns.dropDuplicates(["question_id"]))
    return found.select("question_id", "rank", "title", F.round("score", 6).alias("score"))


@query
def vectors_topk(spark, d):
    """The nearest rows of every twentieth one."""
    e = S.table(spark, d, "embeddings")
    return retrieval.nearest_each(e, e.where("vec_id % 20 = 0"), 10).withColumn("distance", F.round("distance", 6))


@query
def section_search(spark, d):
    hits = tree.search(S.section_chunks(spark, d), "asia and europe customer of")
    return hits.select("title", "page_number", "content_hash", F.round("score", 6).alias("score"))


@query
def fact_extract(spark, d):
    return facts.extract(S.fact_chunks(spark, d))


@query
def fact_distinct_counts(spark, d):
    return facts.distinct_of(S.fact_chunks(spark, d)).groupBy("fact_key", "entity", "page_number").agg(F.count("*").alias("n"), F.count_distinct("fact_value").alias("distinct_values"))


@query
def fact_sql_rows(spark, d):
    return facts.select_plan(facts.extract(S.fact_chunks(spark, d)), {"fact_key_like": "percent", "entity_like": "flag r", "page_number_eq": "1", "limit": 50})


@query
def fact_sql_count(spark, d):
    return facts.select_plan(facts.extract(S.fact_chunks(spark, d)), {"select_mode": "count", "fact_value_like": "199"})


@query
def fact_nl_query(spark, d):
    return facts.select_words(facts.extract(S.fact_chunks(spark, d)), "Flag A?")


@query
def fact_guarded_sql(spark, d):
    return facts.run_select(spark, facts.extract(S.fact_chunks(spark, d)), "SELECT fact_key, entity, count(*) AS n, max(fact_value) AS largest FROM document_facts WHERE page_number <= ? GROUP BY fact_key, entity;", [4])


def _vector(spark, d):
    """The query vector: that of one row, or none."""
    row = S.table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()
    return row and row[0]


@query
def vector_topk(spark, d):
    vector, rows = _vector(spark, d), S.table(spark, d, "embeddings")
    top = retrieval.nearest(rows if vector else rows.limit(0), vector or [], 20)
    return top.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query
def hybrid_search(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    rows = S.table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))
    vector = _vector(spark, d)
    top = retrieval.hybrid(rows if vector else rows.limit(0), vector or [], "the thin and of stat", 20)
    return top.select("vec_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query
def dup_row_ids(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", _md5("text").alias("h"))
    return retrieval.number_duplicates(docs, "h", ["doc_id"]).select("doc_id", "row_id")


@query
def citations(spark, d):
    return S.section_chunks(spark, d).select("content_hash", retrieval.citation(F.col("content"), F.col("content_hash"), F.col("page_number")).alias("line"))


@query
def evidence_union(spark, d):
    c = S.section_chunks(spark, d).select("content_hash", "page_number")
    return retrieval.add_new(c.where("page_number <= 20"), c.where("page_number >= 10"))


@query
def hash_mentions(spark, d):
    """Hashes that an answer cites and that stand among the retrieved."""
    docs = S.table(spark, d, "documents").select("doc_id", _md5("text").alias("h"))
    answers = docs.select("doc_id", F.concat(F.lit("See above. USED_HASHES: [\""), "h", F.lit("\", x"), "doc_id", F.lit("]")).alias("answer"))
    cited = answers.select("doc_id", F.explode(T.used_hashes(F.col("answer"))).alias("content_hash"))
    return cited.join(docs.select(F.col("h").alias("content_hash")).distinct(), "content_hash", "left_semi").select("doc_id", "content_hash")


@query
def json_blocks(spark, d):
    wrapped = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return S.table(spark, d, "events").select("event_id", F.get_json_object(T.json_object(wrapped), "$.k").alias("k"))


@query
def escalation(spark, d):
    return extraction.escalate(S.attempts(spark, d)).select("file_id", "page_number", "attempt_no", "strategy", "status")


@query
def attempt_costs(spark, d):
    return extraction.page_results(extraction.escalate(S.attempts(spark, d)))


@query
def budget_stop_loss(spark, d):
    """Attempts as they are made under a budget that some documents reach."""
    s = extraction.stop_loss(S.attempts(spark, d), 0.05)
    return s.select("file_id", "page_number", "attempt_no", "status", F.round("cost", 6).alias("cost"), F.round("spend_before", 6).alias("spend_before"), "skipped")


@query
def budget_page_results(spark, d):
    """What a reached budget changes in pages' results."""
    r = extraction.page_results(extraction.stop_loss(S.attempts(spark, d), 0.05))
    return r.select("file_id", "page_number", "attempts", "final_strategy", "final_status", "total_cost", "escalation_path")


@query
def circuit_breaker(spark, d):
    """An error of a vision attempt with a high value stands for one that disables the strategy, if the attempt is made."""
    a = extraction.circuit_breaker(extraction.escalate(S.attempts(spark, d)), (F.col("status") == "fail") & (F.col("cost") > 0.1))
    return a.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if("disabled").alias("disabled"))


@query
def vlm_cost(spark, d):
    text, image = extraction.vision_tokens(F.col("text"), F.col("width"), F.col("height"), CORPUS)
    p = S.doc_pages(spark, d).select("doc_id", "page_number", text.cast("long").alias("text_tokens"), image.cast("long").alias("image_tokens"))
    return p.withColumn("cost", extraction.vision_cost(F.col("text_tokens"), F.col("image_tokens"), F.lit(1200), CORPUS))


@query
def ledger_rollup(spark, d):
    return extraction.doc_totals(extraction.page_results(extraction.escalate(S.attempts(spark, d))))


@query
def ledger_entries(spark, d):
    e = ledger.entries(extraction.page_results(extraction.escalate(S.attempts(spark, d))))
    return e.select("event_type", "file_name", "page_number", "strategy_selected", "cost_estimate", "processing_time_ms")


@query
def run_totals(spark, d):
    return ledger.run_totals(extraction.doc_totals(extraction.page_results(extraction.escalate(S.attempts(spark, d)))))


@query
def ledger_hourly(spark, d):
    return stream.hourly(S.table(spark, d, "events"))


@query
def router_classify(spark, d):
    q = S.table(spark, d, "conversations").where("role = 'user'")
    return q.select("conv_id", "turn", qa.is_metric(F.col("text")).alias("is_metric"), qa.tool_for(F.col("text")).alias("tool"))


@query
def bbox_validation(spark, d):
    i = S.table(spark, d, "lineitem")
    ok = validation.bbox_ok(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_tax") * 2 - 0.02)
    return i.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("boxes"), F.count_if(~ok).alias("bad_boxes"))


@query
def attempt_validation(spark, d):
    """Attempts with every check violated somewhere."""
    a = S.attempts(spark, d)
    k = F.col("event_id") % 20
    broken = a.withColumns({
        "page_number": F.when(k == 0, 0).otherwise(F.col("page_number")), "confidence": F.when(k == 1, 1.5).when(k == 2, None).otherwise(F.col("confidence")), "cost": F.when(k == 3, -0.5).otherwise(F.col("cost")),
        "processing_time_ms": F.when(k == 4, -1.0).otherwise(F.col("processing_time_ms")), "status": F.when(k == 5, "maybe").otherwise(F.col("status")), "strategy": F.when(k == 6, "STRATEGY_D").otherwise(F.col("strategy")),
        "content": F.when(k == 7, "  ").otherwise(F.col("status")), "token_count": F.when(k < 9, 0).otherwise(1), "unit_type": F.when(k == 8, "chart").otherwise("table"),
    })
    return validation.violations(broken)


@query
def hash_validation(spark, d):
    """Recomputes stored hashes of chunks and of provenance; some of the stored ones are spoilt."""
    c = S.section_chunks(spark, d).withColumn("no", F.regexp_extract("content", "(\\d+)", 1).cast("long"))
    stored = F.when(F.col("no") % 17 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))
    again = T.content_hash(F.col("content"), F.col("page_number"), F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    stamp, path = F.lit("2024-01-01T00:00:00Z"), F.array(F.lit("STRATEGY_A"), F.lit("STRATEGY_B"))
    made = T.provenance_hash(F.col("section_context"), F.col("page_number"), F.when(F.col("no") % 11 == 0, "STRATEGY_C").otherwise("STRATEGY_B"), stamp, path)
    right = T.provenance_hash(F.col("section_context"), F.col("page_number"), F.lit("STRATEGY_B"), stamp, path)
    return c.groupBy("page_number").agg(F.count("*").alias("chunks"), F.count_if(again != stored).alias("bad"), F.count_if(made != right).alias("bad_provenance"))


@query
def safe_names(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", T.safe_name(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("."))).alias("name"), T.slug(F.col("c_name")).alias("slug"))


@query
def styled_sections(spark, d):
    """Headings told by their style."""
    return chunking.sections(S.styled_units(spark, d), SMALL_CHUNKS).select("doc_id", "page_number", "uid", "section", "is_boundary")


def _plan(spark, d):
    pages = S.doc_pages(spark, d)
    totals = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
    claimed = pages.where("doc_id % 4 <> 0").select("doc_id", (F.col("page_number") * (F.col("doc_id") % 3 + 1) - 1).cast("int").alias("page_number"))
    return pages, units.page_plan(totals, claimed, 3)


@query
def page_plan(spark, d):
    """Pages to process: those claimed within range, in order, three at most; all where none is."""
    return _plan(spark, d)[1].select("doc_id", "place", "page_number")


@query
def planned_strategies(spark, d):
    """Planned pages with their profiles, made up where there is none."""
    pages, plan = _plan(spark, d)
    profiles = triage.page_profiles(pages, CORPUS).where("page_number % 2 = 1")
    return units.with_profiles(plan, profiles, triage.doc_profiles(pages, CORPUS)).select("doc_id", "page_number", "dominant_strategy", "synthesized")


@query
def page_judgements(spark, d):
    """Confidence and success of each page by its strategy and its units; a geometry that lacks pages counts them as 1 by 1."""
    pages = S.doc_pages(spark, d)
    docs = triage.doc_profiles(pages, CORPUS).select("doc_id", "origin_type")
    profiles = triage.page_profiles(pages, CORPUS)
    p = profiles.join(docs, "doc_id").select("doc_id", "page_number", F.col("dominant_strategy").alias("strategy"), "origin_type", "char_density", (F.col("rect_count") % 2 == 0).alias("has_fonts"), F.when(F.col("image_count") == 1, (F.col("rect_count") % 10) / 10).alias("engine"))
    u = S.line_units(spark, d).withColumn("unit_type", F.when(F.length("content") % 7 == 3, "table").when(F.length("content") % 7 == 4, "figure").otherwise("text"))
    j = units.judged_pages(p, u, CORPUS)
    return j.select("doc_id", "page_number", "strategy", "n_units", F.round("confidence", 6).alias("confidence"), "required", "success")


def _outcomes(spark, d):
    """What attempts at pages would give: judged by units, with costs by rectangles and errors on some."""
    pages = S.doc_pages(spark, d)
    docs = triage.doc_profiles(pages, CORPUS).select("doc_id", "origin_type")
    k = (F.col("doc_id") * 5 + F.col("page_number")) % 19
    p = triage.page_profiles(pages, CORPUS).join(docs, "doc_id").select(
        "doc_id", "page_number", "dominant_strategy", "origin_type", "char_density", (F.col("rect_count") % 2 == 0).alias("has_fonts"), F.when(F.col("image_count") == 1, (F.col("rect_count") % 10) / 10).alias("engine"),
        (F.col("rect_count") / 1000).alias("cost"), (F.col("rect_count") * 10.0).alias("processing_time_ms"), F.when(k == 0, "Insufficient credits on the account.").when(k < 3, "timed out").alias("error"),
    )
    u = S.line_units(spark, d).withColumn("unit_type", F.when(F.length("content") % 7 == 3, "table").when(F.length("content") % 7 == 4, "figure").otherwise("text"))
    return attempts.outcomes(attempts.possible(p, u, CORPUS)).select(F.col("doc_id").cast("string").alias("file_id"), "page_number", "attempt_no", "strategy", "status", "confidence", "cost", "processing_time_ms", "breaks")


def _attempt_columns(made):
    return made.select("file_id", "page_number", "attempt_no", "strategy", "status", F.round("confidence", 6).alias("confidence"), F.round("cost", 6).alias("cost"), F.round("spend_before", 6).alias("spend_before"), "skipped")


@query
def attempts_made(spark, d):
    """Attempts by judged confidence, with spending and outages carried through a document's pages."""
    return _attempt_columns(attempts.made(_outcomes(spark, d), 0.1))


@query
def attempts_streamed(spark, d):
    """The same as a stream of outcomes into the exactly-once sink, two pages of every document a batch."""
    folder = new_folder(spark, "attempts")
    found = _outcomes(spark, d)
    found.withColumn("_batch", F.least(F.ceil(F.col("page_number") / 2), F.lit(4)).cast("int")).write.partitionBy("_batch").parquet(f"{folder}/outcomes")
    for batch in range(1, 5):  # files come in, and the stream goes on where it ended
        spark.read.parquet(f"{folder}/outcomes").where(F.col("_batch") == batch).drop("_batch").write.mode("append").parquet(f"{folder}/incoming")
        attempt_stream.run(spark.readStream.schema(found.schema).parquet(f"{folder}/incoming"), 0.1, f"{folder}/made", f"{folder}/checkpoint").awaitTermination()
    return _attempt_columns(sink.read(spark, f"{folder}/made", attempt_stream.OUT))


@query
def attempts_pages(spark, d):
    """Pages' results of these attempts."""
    r = extraction.page_results(attempts.made(_outcomes(spark, d), 0.1))
    return r.select("file_id", "page_number", "attempts", "final_strategy", "final_status", "total_cost", "escalation_path")


@query
def piece_rows(spark, d):
    """Pieces of documents' JSON, from their own fields or else from their pages."""
    h = S.html_units(spark, d).select("page_id", "n", "content", F.element_at(F.array(*[F.lit(x) for x in ("Data_Table", "SectionHeader", "figure", "page-image", "paragraph")]), (F.col("n") % 5 + 1).cast("int")).alias("type"), (F.col("n") % 3).cast("int").alias("page_no"))
    piece = F.struct("n", "type", F.col("content").alias("text"), "page_no")
    g = h.groupBy("page_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    texts, tables = F.filter("p", lambda x: x["n"] % 2 == 0), F.filter("p", lambda x: x["n"] % 2 == 1)
    own, paged = F.to_json(F.struct(texts.alias("texts"), tables.alias("tables"))), F.to_json(F.struct(F.array(F.struct(texts.alias("items"), tables.alias("elements"))).alias("pages")))
    docs = g.select("page_id", F.when(F.col("page_id") % 5 == 0, F.lit("no object")).when(F.col("page_id") % 2 == 0, own).otherwise(paged).alias("doc"))
    return units.pieces(docs, "page_id", "doc", [1]).select(F.col("id").alias("page_id"), "n", "page_number", "unit_type", "content")


@query
def search_rows(spark, d):
    """Units as search rows."""
    u = S.html_units(spark, d)
    odd = F.col("n") % 4
    u = u.select("page_id", "n", F.when(odd == 0, F.lit("")).otherwise(F.col("content")).alias("content_markdown"), F.when(odd == 1, F.lit(None)).otherwise(F.concat(F.lit(" raw "), "content")).alias("content_raw"), F.when(odd == 2, None).otherwise((F.col("n") - 3).cast("int")).alias("page_number"), F.when(odd == 3, " ").otherwise(F.col("unit_type")).alias("unit_type"), *[F.lit(None).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    file = F.concat(F.lit("page_"), "page_id")
    return units.to_chunks(u, file).select("file_id", "content", "page_number", "section_context", "token_count", "x2")


@query
def normalized_units(spark, d):
    u = S.line_units(spark, d).withColumn("x2", F.when(F.col("page_number") % 2 == 0, F.col("x2") / 2))
    n = units.normalized(u, F.col("page_number"), F.lit("STRATEGY_B"), F.array(F.lit("STRATEGY_A"), F.lit("STRATEGY_B")))
    return n.select("doc_id", "page_number", "uid", "x2", "strategy_used", F.array_join("escalation_path", ">").alias("path"))


@query
def payload_rows(spark, d):
    """Chunk rows of JSON payloads that lack some fields."""
    c = S.table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    chunk = F.struct(F.when(k != 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("content"), F.when(k > 1, F.array((k + 1).cast("int"), F.lit(9))).alias("page_numbers"), F.when(k != 2, F.struct((k / 4).alias("x1"))).alias("bbox_bounds"), F.when(k != 3, F.col("c_mktsegment")).alias("section_context"), F.when(k != 4, (k * 2).cast("int")).alias("token_count"), F.col("c_mktsegment").alias("content_hash"))
    p = c.select("c_custkey", F.when(k == 1, F.to_json(F.struct(F.array(chunk, chunk).alias("chunks")))).otherwise(F.to_json(F.struct(F.array(chunk).alias("chunks")))).alias("payload"))
    r = units.payload_chunks(p, "c_custkey", "payload")
    return r.select(F.col("id").alias("c_custkey"), "n", "content", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("pages"), "section_context", "token_count", "content_hash", F.round("x1", 4).alias("x1"), "x2")


@query
def origin_names(spark, d):
    """Origins by their synonyms, over three columns of which the first that says something counts."""
    e = S.table(spark, d, "events")
    names = ["Image_Scan", "scanned", "digital", "mixed", "unknown", "", "hybrid", "paper"]
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    a, b, c = pick(F.col("event_id")), pick(F.col("event_id") + F.col("user_id")), pick(F.col("user_id"))
    return e.select("event_id", extraction.origin_of(a, b, c).alias("origin"))


@query
def attempt_labels(spark, d):
    return S.attempts(spark, d).groupBy(extraction.label(F.col("strategy")).alias("label")).agg(F.count("*").alias("n"))


@query
def vision_models(spark, d):
    """The model for each document's cost tier."""
    p = triage.doc_profiles(S.doc_pages(spark, d), CORPUS)
    return p.select("doc_id", "cost_tier", extraction.vision_model(F.col("cost_tier"), CORPUS.with_(models={"LOW": "FastText", "MEDIUM": "vendor/medium-model"})).alias("model"))


@query
def metadata_hints(spark, d):
    """Domains of texts, or else of their metadata; and by the older keywords."""
    meta = F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("note"), F.when(F.col("doc_id") % 5 == 0, "From the Ministry").when(F.col("doc_id") % 7 == 0, "Bank paper").otherwise("none"))
    return S.table(spark, d, "documents").select("doc_id", triage.resolved_hint(F.col("text"), meta, Config()).alias("hint"), triage.domain_hint(F.col("text"), Config(domains=LEGACY_DOMAINS)).alias("legacy_hint"))


@query
def display_names(spark, d):
    c = S.table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    file = F.when(k == 0, F.concat(F.lit("/data/in/"), F.regexp_replace("c_name", "#", "_"), F.lit(".pdf"))).when(k == 1, F.lit("  ")).otherwise(F.lit(None))
    title = F.when(k == 2, F.lit("Document Root")).when(k == 1, F.concat(F.lit(" "), "c_mktsegment"))
    return c.select("c_custkey", units.display_name(file, title).alias("name"))


@query
def ledger_progress(spark, d):
    e = ledger.with_progress(ledger.entries(extraction.page_results(extraction.escalate(S.attempts(spark, d)))))
    return e.select("file_name", "page_number", "pages_processed")


@query
def page_lists(spark, d):
    """Page lists sorted and without repeats; none where there is no page or an odd one."""
    i = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_quantity") % 5 - F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(-1)).cast("int")).alias("p"))
    return i.select("l_orderkey", F.array_join(units.page_list(F.col("p")).cast("array<string>"), ",").alias("pages"))


def _boxed_chunks(spark, d):
    k = F.regexp_extract("content", r"(\d+)", 1).cast("long")
    return S.section_chunks(spark, d).withColumns({"x1": (k % 8) / 16, "y1": (k % 4) / 8, "x2": 0.5 + (k % 8) / 16, "y2": 0.5 + (k % 4) / 8})


@query
def section_rollup(spark, d):
    """Sections of each document, one a market segment."""
    r = tree.section_rollup(_boxed_chunks(spark, d).withColumn("c_mktsegment", F.split("section_context", " > ")[2]), ("c_mktsegment",))
    return r.select("c_mktsegment", "title", "x1", "y1", "x2", "y2", "chunk_count", "total_pages_covered", F.md5(F.array_join("chunk_hashes", ",").cast("binary")).alias("hashes_md5"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query
def chunk_nodes(spark, d):
    return tree.chunk_nodes(S.section_chunks(spark, d)).select("node_id", "parent_id", "node_type", "title", "page_number")


@query
def section_summaries(spark, d):
    """Summaries of the sections of found chunks, each once."""
    c = S.section_chunks(spark, d)
    return tree.summaries_of(c, c.where("page_number = 7 AND content LIKE '%BUILDING%'"))


@query
def evidence_lines(spark, d):
    return S.section_chunks(spark, d).select("content_hash", retrieval.evidence(F.col("content"), F.col("content_hash"), F.col("page_number")).alias("line"))


@query
def cited_hashes(spark, d):
    """Hashes that an answer names, in its text or in its list, and that stand among the valid ones."""
    docs = S.table(spark, d, "documents").select("doc_id", _md5("text").alias("h"))
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("As "), "h", F.lit(" says."))).otherwise(F.concat(F.lit("USED_HASHES: ['"), "h", F.lit("', "), F.when(F.col("doc_id") % 3 == 0, F.md5(F.col("h").cast("binary"))).otherwise("deadbeef"), F.lit("]")))
    named = F.array_union(T.used_hashes(answer), F.regexp_extract_all(answer, F.lit("([0-9a-f]{32})"), 1))
    cited = docs.select("doc_id", F.explode(named).alias("content_hash"))
    return cited.join(docs.select(F.col("h").alias("content_hash")).distinct(), "content_hash", "left_semi").select("doc_id", "content_hash")
