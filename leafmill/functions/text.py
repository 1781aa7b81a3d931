"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, WHITE), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(words(F.coalesce(text, F.lit("")))))


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def char_density(text: Column, width: Column, height: Column) -> Column:
    return F.when(width * height > 0, F.length(text) / (width * height)).otherwise(F.lit(0.0))


def content_hash(text: Column, page: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """sha256 of the lower-cased text with single spaces, the page, and the box with two decimals (boxes away from ties)."""
    box = F.concat_ws(",", *[F.format_string("%.2f", c.cast("double")) for c in (x1, y1, x2, y2)])
    return F.sha2(F.concat(F.lower(collapse(text)), F.lit("|p:"), page.cast("string"), F.lit("|bbox:"), box), 256)


def provenance_hash(source: Column, page: Column, strategy: Column, stamp: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, page.cast("string"), strategy, stamp, F.array_join(path, ",")), 256)


def lexical_similarity(query: Column, other: Column) -> Column:
    """0.6 Jaccard + 0.4 coverage of the query, of two token arrays."""
    common = F.size(F.array_intersect(query, other))
    either = F.size(F.array_union(query, other))
    score = 0.6 * common / F.greatest(either, F.lit(1)) + 0.4 * common / F.greatest(F.size(query), F.lit(1))
    return F.when((F.size(query) == 0) | (F.size(other) == 0), F.lit(0.0)).otherwise(score)


def hybrid_score(distance: Column, query: Column, other: Column) -> Column:
    """0.8 / (1 + distance) + 0.2 coverage of the query."""
    coverage = F.size(F.array_intersect(query, other)) / F.greatest(F.size(query), F.lit(1))
    return 0.8 / (1 + F.greatest(F.lit(0.0), distance)) + 0.2 * coverage


def slug(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(plain == "", F.lit("untitled")).otherwise(plain)


def section_path(context: Column) -> Column:
    """Parts of a section context at the first separator it holds, of >, ::, | and /."""
    whole = F.array(context)
    parts = (
        F.when(context.contains(">"), F.split(context, ">")).when(context.contains("::"), F.split(context, "::"))
        .when(context.contains("|"), F.split(context, r"\|")).when(context.contains("/"), F.split(context, "/")).otherwise(whole)
    )
    clean = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", ""))), lambda x: x != "")
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(F.lit("Unsectioned")))


def text_clarity(text: Column) -> Column:
    """0.7 share of letters and digits among visible characters + 0.3 of word length up to five."""
    visible = F.regexp_replace(text, WHITE, "")
    alnum = F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", ""))
    n = F.greatest(F.size(words(text)), F.lit(1))
    score = 0.7 * alnum / F.greatest(F.length(visible), F.lit(1)) + 0.3 * F.least(F.lit(1.0), F.length(visible) / n / 5.0)
    return F.when(F.length(visible) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def short_summary(title: Column, text: Column) -> Column:
    """The first sentence, at most 220 characters, closed by a mark."""
    first = F.split(collapse(text), r"(?<=[.!?])\s+", 2)[0]
    cut = F.when(F.length(first) > 220, F.concat(F.rtrim(F.left(first, F.lit(217))), F.lit("..."))).otherwise(first)
    closed = F.when(F.right(cut, F.lit(1)).isin(".", "!", "?"), cut).otherwise(F.concat(cut, F.lit(".")))
    # Fixed value: the sentence for a section without text.
    return F.when(collapse(text) == "", F.concat(F.lit("Section '"), title, F.lit("' has no extracted content yet."))).otherwise(closed)


def facts(text: Column) -> Column:
    """array<struct<fact_key, fact_value>>: amounts of money, percentages and years, in this order."""
    # The kinds of facts and their patterns.
    found = [
        ("currency_amount", r"(?i)((?:\$|USD\s?)\d[\d,]*(?:\.\d+)?)"),
        ("percentage", r"\b(\d+(?:\.\d+)?%)"),
        ("year", r"\b((?:19|20)\d{2})\b"),
    ]

    def named(key: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(key).alias("fact_key"), v.alias("fact_value")))

    return F.concat(*[named(k, p) for k, p in found])


def safe_name(name: Column) -> Column:
    """File-name characters only, others as underscores, none of ._- outside."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")


def json_object(text: Column) -> Column:
    """The text from the first brace to the last, fences around it or not."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def used_hashes(text: Column) -> Column:
    """Hashes listed after USED_HASHES: in square brackets."""
    inside = F.regexp_extract(text, r"USED_HASHES:\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), "[\"']", "")), lambda x: x != "")
