"""The section tree as an adjacency table, its outline, and lexical search over sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored


def nodes(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per path prefix of chunks (section_context, page_number), by combining aggregations; `by` names the columns that tell documents, and so their trees, apart."""
    # a section's chunks of a page are one row, counted in a hash table, before paths are spelled out: the least of texts needs all rows sorted
    c = chunks.groupBy(*by, "section_context", "page_number").agg(F.count("*").alias("_chunks"))
    c = c.withColumn("path", T.section_path(F.col("section_context")))
    c = c.select("*", F.posexplode("path").alias("depth", "title"))
    slugs = F.transform(F.slice("path", F.lit(1), F.col("depth") + 1), T.slug)
    c = c.withColumn("node_id", F.array_join(slugs, "/")).withColumn("parent_id", F.when(F.col("depth") == 0, "root").otherwise(F.array_join(F.slice(slugs, F.lit(1), F.col("depth")), "/")))
    first = F.struct("page_number", "section_context")  # tells siblings apart, as a section's path is its own
    n = c.groupBy(*by, "node_id", "parent_id", "depth").agg(F.min_by("title", first).alias("title"), F.min("page_number").alias("min_page"), F.max("page_number").alias("max_page"), F.sum("_chunks").alias("chunk_count"), F.count_distinct("page_number").alias("pages_covered"), F.min(first).alias("_first"))
    return n.withColumn("node_type", F.when(F.col("depth") == 0, "section").otherwise("subsection"))


def node_boxes(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node_id, page_number, x1, y1, x2, y2): the box of each node on each page, around those of all chunks (section_context, boxes) below it."""
    c = chunks.select(*by, F.transform(T.section_path(F.col("section_context")), T.slug).alias("_slugs"), F.explode("boxes").alias("b"))
    each = c.select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.size("_slugs")), lambda k: F.array_join(F.slice("_slugs", F.lit(1), k), "/"))).alias("node_id"), "b.*")
    sides = [(F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2")]
    return each.groupBy(*by, "node_id", "page_number").agg(*[pick(c).alias(c) for pick, c in sides])


def root(chunks: DataFrame) -> DataFrame:
    """Totals over all chunks."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("page_number").alias("total_pages_covered"), F.min("page_number").alias("min_page"), F.max("page_number").alias("max_page"))


def placed(tree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `place`, the numbers of a node's ancestors and its own among their siblings, who come in the order of their first chunks: ordering by it walks the tree in pre-order, parents before their children."""
    number = F.row_number().over(Window.partitionBy(*by, "parent_id").orderBy("_first", "node_id"))
    own = tree.withColumn("_number", number)
    parts = F.split("node_id", "/")
    # a row for each ancestor, as many as the path has parts
    up = own.select(*by, F.col("node_id").alias("_node"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("_at", "_up"))
    found = up.join(own.select(*by, F.col("node_id").alias("_up"), "_number"), [*by, "_up"])
    path = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_number"))), lambda x: x["_number"])
    return tree.join(found.groupBy(*by, F.col("_node").alias("node_id")).agg(path.alias("place")), [*by, "node_id"])


def outline(tree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Indented lines with their place; ordering by it gives them in pre-order."""
    return placed(tree, by).select(*by, "node_id", "depth", "place", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), "title").alias("line"))


#: What a node holds besides its children.
FIELDS = ("node_id", "node_type", "title", "min_page", "max_page", "chunk_count", "pages_covered")


def nested(tree: DataFrame, by: tuple[str, ...], levels: int = 32) -> DataFrame:
    """(by, tree): each document's tree as one JSON text, children inside their parents in their order; deeper levels than `levels` are an error.

    Built from the lowest level up: a level's texts become the children of the next. A row is one document's tree.
    """
    t = stored(placed(stored(tree, "nodes"), by), "placed")  # every level reads it
    deepest = t.agg(F.max("depth")).first()[0]
    if deepest is not None and deepest >= levels:
        raise ValueError(f"more than {levels} levels")
    own = F.to_json(F.struct(*FIELDS))
    children = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = t.where(F.col("depth") == depth).select(*by, "node_id", "parent_id", F.element_at("place", -1).alias("_n"), own.alias("_own"))
        level = level.join(children, [*by, "node_id"], "left") if children is not None else level.withColumn("_inside", F.lit(None).cast("string"))
        text = F.concat(F.expr("left(_own, length(_own) - 1)"), F.lit(',"children":['), F.coalesce("_inside", F.lit("")), F.lit("]}"))
        each = level.select(*by, F.col("parent_id").alias("node_id"), F.struct("_n", text.alias("_text")).alias("_child"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("_child")), lambda c: c["_text"]), ",")
        children = each.groupBy(*by, "node_id").agg(joined.alias("_inside"))
    if children is None:
        return t.select(*by, F.lit("").alias("tree")).limit(0)
    return stored(children.select(*by, F.concat(F.lit('{"node_id":"root","children":['), "_inside", F.lit("]}")).alias("tree")), "nested")


def read_nested(trees: DataFrame, by: tuple[str, ...], levels: int = 32) -> DataFrame:
    """The rows of exported trees, level by level: by, FIELDS, parent_id, depth and place."""
    kind = ", ".join(f"{c} string" if c in FIELDS[:3] else f"{c} long" for c in FIELDS)
    at = trees.select(*by, F.lit("root").alias("parent_id"), F.array().cast("array<int>").alias("place"), F.get_json_object("tree", "$.children").alias("_inside"))
    out = None
    for depth in range(levels):
        each = at.select(*by, "parent_id", "place", F.posexplode(F.from_json("_inside", "array<variant>")).alias("_n", "_v")).withColumn("_text", F.to_json("_v"))
        read = each.select(*by, "parent_id", F.concat("place", F.array(F.col("_n") + 1)).alias("place"), F.from_json("_text", kind).alias("_f"), F.get_json_object("_text", "$.children").alias("_inside"))
        rows = read.select(*by, "_f.*", "parent_id", F.lit(depth).alias("depth"), "place")
        out = rows if out is None else out.unionByName(rows)
        at = read.where("_inside <> '[]'").select(*by, F.col("_f.node_id").alias("parent_id"), "place", "_inside")
        if at.isEmpty():
            break
    return out


def section_summaries(chunks: DataFrame, summarize: Callable[[Column, Column], Column] = T.short_summary) -> DataFrame:
    """Top sections with a summary of the first chunk, and its place for ties; `summarize(title, text)` may be a model's UDF."""
    c = chunks.withColumn("title", T.section_path(F.col("section_context"))[0])
    first = F.struct("page_number", "section_context", "content_hash")
    s = c.groupBy("title").agg(F.min_by("content", first).alias("content"), F.min(first).alias("ord"))
    return s.select("title", summarize(F.col("title"), F.col("content")).alias("summary"), "ord")


def section_rollup(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Top sections with their box, pages, chunk hashes in order, and counts, of chunks with boxes (x1 to y2); a row's hashes are those of one document, which `by` names, and of one section."""
    c = chunks.withColumn("title", T.section_path(F.col("section_context"))[0])
    r = c.groupBy(*by, "title").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.array_sort(F.collect_set("page_number")).alias("pages"), F.count("*").alias("chunk_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_number", "section_context", "content_hash"))), lambda x: x["content_hash"]).alias("chunk_hashes"),
    )
    return r.withColumn("total_pages_covered", F.size("pages"))


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """Leaves of the tree: one node per chunk under its section's."""
    slugs = F.transform(T.section_path(F.col("section_context")), T.slug)
    return chunks.select(F.concat(F.lit("chunk/"), F.left("content_hash", F.lit(16))).alias("node_id"), F.array_join(slugs, "/").alias("parent_id"), F.lit("chunk").alias("node_type"), F.concat(F.lit("Chunk "), F.left("content_hash", F.lit(8))).alias("title"), "page_number", "content_hash")


def summaries_of(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(title, line): the summaries of the sections that found chunks stand in, each once."""
    wanted = found.select(T.section_path(F.col("section_context"))[0].alias("title")).distinct()
    return section_summaries(chunks).join(wanted, "title", "left_semi").select("title", F.concat("title", F.lit(": "), "summary").alias("line"))


def export(nodes_: DataFrame, path: str) -> None:
    """The adjacency table as JSON lines; an error without nodes."""
    if nodes_.isEmpty():
        raise ValueError("there is no tree to export")
    nodes_.write.mode("overwrite").json(path)


def search(chunks: DataFrame, query: str, top: int = 3) -> DataFrame:
    """Chunks of the best sections for a query by title and summary; the ranking of `top` rows is bounded and broadcast."""
    q = T.tokens(F.lit(query))
    s = section_summaries(chunks).withColumn("score", T.lexical_similarity(q, T.tokens(F.concat_ws(" ", "title", "summary"))))
    best = s.where("score > 0").orderBy(F.desc("score"), "ord").limit(top).select(F.col("title").alias("_t"), "score")
    c = chunks.withColumn("title", T.section_path(F.col("section_context"))[0])
    hits = c.join(F.broadcast(best), F.col("title") == F.col("_t")).drop("_t")
    # the first of equal hashes
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("content_hash").orderBy("page_number", "section_context"))).where("_k = 1").drop("_k")


def search_each(chunks: DataFrame, questions: DataFrame, top: int = 3, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(id, rank, title, score): the best sections for each of a table of questions, by title and summary.

    An inverted index holds, for each word, the sections that have it; a question's words meet their lists, and
    the words that a section shares with it are counted by a combining aggregation. Questions without a word
    in any section have no row; ids should be unique, as equal ones are one question.
    """
    s = section_summaries(chunks).withColumn("words", T.tokens(F.concat_ws(" ", "title", "summary")))
    index = s.select("title", "ord", F.size("words").alias("n_s"), F.explode("words").alias("word"))
    q = questions.select(F.col(id_col).alias("_id"), T.tokens(F.col(text_col)).alias("words"))
    q = q.select("_id", F.size("words").alias("n_q"), F.explode("words").alias("word"))
    shared = q.join(index, "word").groupBy("_id", "n_q", "title", "n_s", "ord").agg(F.count("*").alias("common"))
    score = 0.6 * F.col("common") / (F.col("n_q") + F.col("n_s") - F.col("common")) + 0.4 * F.col("common") / F.col("n_q")
    best = Window.partitionBy("_id").orderBy(F.desc("score"), "ord")
    return shared.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(F.col("_id").alias(id_col), "rank", "title", "score")
