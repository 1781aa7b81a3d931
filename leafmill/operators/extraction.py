"""Strategy chains, confidences, escalation and cost accounting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config

ORDER = ("STRATEGY_A", "STRATEGY_B", "STRATEGY_C")


def strategy_chain(origin: Column, dominant: Column) -> Column:
    """Strategies tried in turn: all for hybrid, from B for scanned images, else from the page's own on."""
    chain = lambda k: F.array(*[F.lit(s) for s in ORDER[k:]])
    return F.when(origin == "hybrid", chain(0)).when(origin == "scanned_image", chain(1)).when(dominant == "STRATEGY_A", chain(0)).when(dominant == "STRATEGY_B", chain(1)).otherwise(chain(2))


def origin_of(origin_type: Column, overall: Column, document_type: Column) -> Column:
    """Origin under its usual name, from the first of three columns that says one ("unknown" says none)."""
    said = F.coalesce(*[F.when(F.lower(c).isin("unknown", ""), None).otherwise(F.lower(c)) for c in (F.trim(origin_type), F.trim(overall), F.trim(document_type))], F.lit("unknown"))
    return F.when(said.isin("scanned", "scanned_image", "image_scan"), "scanned_image").when(said.isin("hybrid", "mixed"), "hybrid").when(said.isin("born_digital", "digital"), "born_digital").otherwise(F.lit("unknown"))


def fast_confidence(density: Column, has_fonts: Column, config: Config) -> Column:
    """0.75 density up to four times the minimum + 0.25 font data; cut below the minimum."""
    score = 0.75 * F.least(F.lit(1.0), density / (4 * config.min_digital)) + 0.25 * F.when(has_fonts, 1.0).otherwise(0.35)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(density < config.min_digital, score * 0.35).otherwise(score)))


def layout_confidence(parsed: Column, clarity: Column, engine: Column, tables: Column, texts: Column, density: Column, config: Config) -> Column:
    """Weighted clarity, table and density signals, with the engine's confidence where there is one."""
    c = F.coalesce(clarity, parsed.cast("double"))
    t = F.when(tables > 0, 1.0).when(texts > 0, 0.65).otherwise(0.2)
    d = F.least(F.lit(1.0), density / max(1.5 * config.min_digital, 1e-9))
    score = F.when(engine.isNotNull(), 0.5 * engine + 0.3 * c + 0.15 * t + 0.05 * d).otherwise(0.6 * c + 0.25 * t + 0.15 * d)
    score = score * F.when(parsed, 1.0).otherwise(0.5) * F.when(c < config.min_clarity, 0.7).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def vision_confidence(uncertain: Column) -> Column:
    return F.when(uncertain, 0.7).otherwise(0.95)


def required_confidence(strategy: Column, origin: Column, config: Config) -> Column:
    return F.when(strategy == "STRATEGY_C", 0.0).when((strategy == "STRATEGY_B") & (origin == "scanned_image"), config.b_confidence).otherwise(config.confidence_gate)


def vision_tokens(text: Column, width: Column, height: Column, config: Config) -> tuple[Column, Column]:
    """Estimated text and image tokens of a page."""
    tiles = F.ceil(width / config.tile) * F.ceil(height / config.tile)
    return F.greatest(F.lit(1), F.floor(F.length(text) / config.chars_per_token)), tiles * config.tile_tokens


def vision_cost(text: Column, image: Column, out: Column, config: Config) -> Column:
    """Price of a call, in decimals and rounded once, as binary fractions would fall on either side of a tie."""
    price = lambda n, each: n.cast("decimal(18,0)") * F.lit(Decimal(str(each)) / 1000)
    return F.round(price(text, config.price_in) + price(image, config.price_image) + price(out, config.price_out), 6).cast("double")


def dispatch_confidence(strategy: Column, fast: Column, layout: Column, no_units: Column) -> Column:
    """The confidence by which an attempt of a strategy is judged."""
    return F.when(strategy == "STRATEGY_A", fast).when(strategy == "STRATEGY_B", layout).otherwise(vision_confidence(no_units))


def succeeded(n_units: Column, confidence: Column, required: Column) -> Column:
    """An attempt succeeds with units and enough confidence."""
    return F.coalesce((n_units > 0) & (confidence >= required), F.lit(False))


def vision_model(tier: Column, config: Config) -> Column:
    """The model for a cost tier; only names with a slash are vision models, others fall back to the default."""
    known = F.create_map(*[F.lit(x) for pair in config.models.items() for x in pair])
    mapped = F.element_at(known, F.upper(F.coalesce(F.when(tier != "", tier), F.lit("HIGH"))))
    return F.when(mapped.contains("/"), mapped).otherwise(F.lit(config.default_model))


def escalate(attempts: DataFrame) -> DataFrame:
    """Attempts up to each page's first success, or all."""
    page = Window.partitionBy("file_id", "page_number")
    first = F.min(F.when(F.col("status") == "success", F.col("attempt_no"))).over(page)
    return attempts.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("attempt_no") <= F.col("_first"))).drop("_first")


def label(strategy: Column) -> Column:
    return F.regexp_replace(strategy, "^STRATEGY_", "Strategy ")


def page_results(tried: DataFrame, origin: str = "born_digital") -> DataFrame:
    """One row per page: final attempt, cost and time sums, and the path of attempts."""
    good = F.col("status") == "success"
    steps = F.array_sort(F.collect_list(F.struct("attempt_no", F.concat(label(F.col("strategy")), F.lit(" ("), F.initcap("status"), F.lit(")")).alias("step"))))
    money = lambda c: c.cast("decimal(20,9)")  # noqa: E731  sums of decimals don't depend on the order
    agg = tried.groupBy("file_id", "page_number").agg(
        F.max("attempt_no").cast("int").alias("attempts"), F.max_by("strategy", "attempt_no").alias("final_strategy"), F.max_by("status", "attempt_no").alias("final_status"),
        F.round(F.sum(F.greatest(F.lit(0), money(F.col("cost")))), 6).cast("double").alias("total_cost"), F.round(F.sum(money(F.col("processing_time_ms"))), 3).cast("double").alias("total_time_ms"),
        F.round(F.coalesce(F.max_by(money(F.col("cost")), F.when(good, F.col("attempt_no"))), F.lit(0)), 6).cast("double").alias("last_success_cost"),
        F.round(F.coalesce(F.max_by(money(F.col("cost")), F.when(good & (F.col("strategy") == "STRATEGY_C"), F.col("attempt_no"))), F.lit(0)), 6).cast("double").alias("last_vlm_cost"),
        steps.alias("_steps"),
    )
    path = F.concat_ws(" -> ", F.lit(origin), F.transform("_steps", lambda s: s["step"]))
    return agg.withColumn("escalation_path", path).drop("_steps")


def stop_loss(attempts: DataFrame, budget: float) -> DataFrame:
    """The attempts that are made (see escalate), with `spend_before`, a document's vision spend before each page, and `skipped`.

    A vision attempt is skipped once the spend has reached the budget: it fails, costs nothing and
    takes no time. A skipped page adds nothing, so spending stays once it has reached the budget: the
    sum of all earlier pages' costs answers the question without feeding back.
    """
    tried = escalate(attempts)
    vision = F.col("strategy") == "STRATEGY_C"
    order = Window.partitionBy("file_id").orderBy("page_number", "attempt_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(vision, F.col("cost").cast("decimal(20,9)"))).over(order), F.lit(0))
    out = tried.withColumn("spend_before", before.cast("double")).withColumn("skipped", vision & (before >= F.lit(Decimal(str(budget)))))
    nothing = lambda c: F.when(F.col("skipped"), F.lit(0.0)).otherwise(F.col(c))
    return out.withColumns({"status": F.when(F.col("skipped"), "fail").otherwise(F.col("status")), **{c: nothing(c) for c in ("cost", "processing_time_ms", "confidence")}})


def circuit_breaker(attempts: DataFrame, breaks: Column) -> DataFrame:
    """Adds `disabled`: vision attempts of any document after the first one (by ts, event_id) for which `breaks` holds; they aren't made."""
    vision = F.col("strategy") == "STRATEGY_C"
    first = attempts.where(vision & breaks).agg(F.min(F.struct("ts", "event_id")).alias("_first"))  # one row
    after = F.coalesce(vision & (F.struct("ts", "event_id") > F.col("_first")), F.lit(False))
    return attempts.crossJoin(F.broadcast(first)).withColumn("disabled", after).drop("_first")


def doc_totals(pages: DataFrame) -> DataFrame:
    exact = lambda c, n: F.sum(F.col(c).cast(f"decimal(20,{n})"))
    return pages.groupBy("file_id").agg(
        F.count("*").alias("pages"), F.sum("attempts").cast("long").alias("attempts"), F.count_if(F.col("attempts") > 1).alias("escalated_pages"),
        F.count_if(F.col("final_status") == "fail").alias("failed_pages"), F.round(exact("total_cost", 6), 4).cast("double").alias("total_cost"), F.round(exact("total_time_ms", 3), 1).cast("double").alias("total_time_ms"),
    )
