"""Page profiles, rule routing and document triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_REASON, Config, condition_column, strategy_of
from ..functions import text as T


def route(config: Config, value: str) -> Column:
    """First matching rule's action or reason, as one CASE in the order of priorities."""
    default = "STRATEGY_C" if value == "action" else DEFAULT_REASON
    out = None
    for _, condition, action, reason in sorted(config.rules, key=lambda r: r[0]):
        then = F.lit(strategy_of(action) if value == "action" else reason)
        test, _ = condition_column(condition, config)
        out = F.when(test, then) if out is None else out.when(test, then)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def page_profiles(pages: DataFrame, config: Config) -> DataFrame:
    """Density, orientation, origin and strategy of each page."""
    density = T.char_density(F.col("text"), F.col("width"), F.col("height"))
    p = pages.withColumn("char_density", density).withColumn("is_landscape", F.col("width") > F.col("height"))
    p = p.withColumn("detected_origin", F.when(F.col("char_density") > config.min_digital, "born_digital").otherwise("scanned"))
    return p.withColumn("dominant_strategy", route(config, "action")).withColumn("reason", route(config, "reason"))


def domain_hint(text: Column, config: Config) -> Column:
    """First domain any of whose keywords is in the text, else General."""
    low, out = F.lower(text), None
    for name, keywords in config.domains:
        test = F.lit(False)
        for k in keywords:
            test = test | low.contains(k.lower())
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit("General") if out is None else out.otherwise("General")


def resolved_hint(text: Column, metadata: Column, config: Config) -> Column:
    """The text's domain, or else that of the values of a metadata map, which count as one text; else General."""
    blob = F.concat_ws(" ", F.map_values(metadata))
    return F.coalesce(F.nullif(domain_hint(text, config), F.lit("General")), F.nullif(domain_hint(blob, config), F.lit("General")), F.lit("General"))


def sampled(index: Column, n: Column, most: int) -> Column:
    """Whether a page (index from 0) is in the sample: all of up to `most` pages, else every step-th, the last one's place going to the last page."""
    step = F.floor(n / most)
    last = index == n - 1
    regular = (index % step == 0) & (index / step < most)
    has_last = ((n - 1) % step == 0) & ((n - 1) / step < most)
    replaced = index == step * (most - 1)
    return F.when(n <= most, True).otherwise(F.when(has_last, regular).otherwise((regular & ~replaced) | last))


def triage_confidence(scanned: Column, ratio: Column, mixed: Column, contradiction: Column, form: Column, config: Config) -> Column:
    base = F.when(scanned & (ratio >= 0.8), 0.94).otherwise(0.82)
    less = F.when(mixed, 0.18).otherwise(0.0) + F.when(contradiction >= config.contradiction, 0.15).otherwise(0.0) + F.when(form, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), base - less))


def cost_tier(origin: Column, complexity: Column, domain: Column, confidence: Column | None, config: Config) -> Column:
    """HIGH for scanned or complex, MEDIUM for known domains or medium complexity, else LOW; one up below the gate."""
    known = domain.isin(*[d for d, _ in config.domains])
    level = F.when((origin == "scanned") | (complexity == "High"), 2).when(known | (complexity == "Medium"), 1).otherwise(0)
    if confidence is not None:
        level = F.least(F.lit(2), level + F.when(confidence < config.confidence_gate, 1).otherwise(0))
    return F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (level + 1).cast("int"))


def complexity(avg_rects: Column, landscape: Column, n: Column, config: Config, strict: bool = False) -> Column:
    """High, Medium or Low by mean rectangles and landscape pages; `strict` compares by > alone, as older profiles did."""
    if strict:
        return F.when(avg_rects > config.table_high, "High").when(avg_rects > config.medium_rects, "Medium").otherwise("Low")
    many = landscape >= F.greatest(F.lit(1), F.floor(n / 3))
    return F.when((avg_rects >= config.table_high) | many, "High").when(avg_rects >= config.medium_rects, "Medium").otherwise("Low")


def doc_profiles(pages: DataFrame, config: Config) -> DataFrame:
    """One combining aggregation per document over its pages, then expressions."""
    p = page_profiles(pages, config)
    digital, image = F.col("char_density") > config.min_digital, F.col("image_count") > 0
    i, n = F.col("page_number") - 1, F.col("_n")
    hit = domain_hint(F.col("text"), config)
    level = F.lit(len(config.domains))
    for k in range(len(config.domains) - 1, -1, -1):
        level = F.when(hit == config.domains[k][0], F.lit(k)).otherwise(level)
    # a page's first matching domain isn't the text's only one, but the text's first is the least over pages
    agg = p.groupBy("doc_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("detected_origin") == "scanned").alias("scanned_pages"), F.avg("rect_count").alias("avg_rects"),
        F.count_if("is_landscape").alias("landscape_pages"), F.avg((digital & image).cast("int")).alias("contradiction_ratio"), F.min(level).alias("_domain"),
        F.max(F.coalesce(F.lower("text").contains("<form"), F.lit(False))).alias("form_fillable"),
        F.array_sort(F.collect_list(F.when(digital | image, F.struct(i.alias("i"), digital.alias("d"), (~digital & image).alias("s"))))).alias("_marks"),
    )
    chosen = F.filter("_marks", lambda m: sampled(m["i"], n, config.sample_pages))
    agg = agg.withColumn("mixed_mode", F.exists(chosen, lambda m: m["d"]) & F.exists(chosen, lambda m: m["s"]))
    scanned = F.col("scanned_pages") > n / 2
    names = F.array(*[F.lit(d) for d, _ in config.domains], F.lit("General"))
    agg = agg.withColumns({
        "overall_origin": F.when(scanned, "scanned").otherwise("born_digital"), "scanned_ratio": F.col("scanned_pages") / n,
        "domain_hint": F.element_at(names, (F.col("_domain") + 1).cast("int")), "layout_complexity": complexity(F.col("avg_rects"), F.col("landscape_pages"), n, config),
    })
    agg = agg.withColumn("triage_confidence", F.round(triage_confidence(scanned, F.col("scanned_ratio"), F.col("mixed_mode"), F.col("contradiction_ratio"), F.col("form_fillable"), config), 6))
    agg = agg.withColumn("cost_tier", cost_tier(F.col("overall_origin"), F.col("layout_complexity"), F.col("domain_hint"), F.col("triage_confidence"), config))
    origin = F.when(F.col("mixed_mode"), "hybrid").when(scanned, "scanned_image").otherwise(F.col("overall_origin"))
    return agg.withColumn("origin_type", origin).withColumnRenamed("_n", "total_pages").drop("_marks", "_domain")


def document_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a document's pages in their order, a line each; pages without one count as empty."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return pages.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))


def legacy_profiles(pages: DataFrame, config: Config) -> DataFrame:
    """The older profile: strict complexity and a confidence from the majority's size."""
    p = page_profiles(pages, config)
    n, s = F.col("total_pages"), F.col("scanned_pages")
    agg = p.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if(F.col("detected_origin") == "scanned").alias("scanned_pages"), F.avg("rect_count").alias("avg_rects"))
    conf = F.greatest(F.lit(0.50), F.least(F.lit(0.99), 0.70 + 0.29 * F.abs(2 * s - n) / F.greatest(F.lit(1), n)))
    return agg.select("doc_id", "total_pages", complexity(F.col("avg_rects"), F.lit(0), n, config, strict=True).alias("layout_complexity"), F.round(conf, 6).alias("triage_confidence"))
