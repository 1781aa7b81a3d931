"""Rules and thresholds as plain values; mappings of a rules file may override them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from warnings import warn

from pyspark.sql import Column

from .functions import conditions

#: The default thresholds, domain keywords, prices, markers and routing rules.
DOMAINS = (
    ("Banking/Security", ("cbe", "bank", "disclosure", "vulnerability", "security")),
    ("Public_Sector", ("ministry", "fta", "woreda", "survey", "government")),
)
RULES = (
    (1, "width > height", "STRATEGY_B", "Landscape orientation detected; likely wide tables/layout structures."),
    (2, "rects > TABLE_RECT_THRESHOLD", "STRATEGY_B", "High rect count indicates table/layout-heavy content."),
    (3, "char_density > MIN_DIGITAL_DENSITY", "STRATEGY_A", "Sufficient text density for fast digital extraction."),
    (4, "char_density == 0.0", "STRATEGY_C", "No searchable text layer; use OCR/VLM pipeline."),
)
MARKERS = ("#", "Table of Contents", "Executive Summary", "Appendix")
DEFAULT_REASON = "No explicit rule matched; defaulting to OCR/Vision routing."


@dataclass(frozen=True)
class Config:
    """Everything that the operators take from configuration."""

    min_digital: float = 0.0005
    table_high: int = 50
    medium_rects: int = 10
    confidence_gate: float = 0.70
    b_confidence: float = 0.75
    min_clarity: float = 0.35
    sample_pages: int = 6
    contradiction: float = 0.30
    domains: tuple = DOMAINS
    rules: tuple = RULES
    budget: float = 30.0
    price_in: float = 0.00030
    price_image: float = 0.00120
    price_out: float = 0.00060
    tile: int = 512
    tile_tokens: int = 85
    chars_per_token: int = 4
    max_chunk: int = 1000
    min_chunk: int = 50
    min_font: float = 12.0
    bold_weight: int = 600
    markers: tuple = MARKERS
    default_model: str = "openai/gpt-4o-mini"
    models: dict = field(default_factory=lambda: {"LOW": "FastText", "MEDIUM": "LayoutExtractor", "HIGH": "openai/gpt-4o-mini"})

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


#: The keywords by domain that older profiles used.
LEGACY_DOMAINS = (("Banking/Security", ("bank", "cbe", "disclosure", "vulnerability")), ("Public_Sector", ("ministry", "fta", "woreda", "survey")))
#: Names of settings by their path in a rules file, and the attribute that each sets.
SETTINGS = {
    "thresholds.char_density.min_digital": "min_digital",
    "thresholds.rect_count.table_high": "table_high",
    "thresholds.rect_count.medium_complexity": "medium_rects",
    "thresholds.triage_confidence_gate": "confidence_gate",
    "thresholds.strategy_b_escalation_confidence": "b_confidence",
    "thresholds.ocr_min_text_clarity": "min_clarity",
    "thresholds.mixed_mode_sample_size": "sample_pages",
    "thresholds.contradictory_image_ratio_threshold": "contradiction",
    "economic_guards.vlm_budget_cap": "budget",
    "economic_guards.vlm_input_cost_per_1k_tokens": "price_in",
    "economic_guards.vlm_image_cost_per_1k_tokens": "price_image",
    "economic_guards.vlm_output_cost_per_1k_tokens": "price_out",
    "economic_guards.vlm_image_tile_size": "tile",
    "economic_guards.vlm_tokens_per_image_tile": "tile_tokens",
    "economic_guards.vlm_chars_per_token": "chars_per_token",
    "chunking_constitution.max_chunk_size": "max_chunk",
    "chunking_constitution.min_chunk_size": "min_chunk",
    "chunking_constitution.header_detection.min_font_size": "min_font",
    "chunking_constitution.header_detection.bold_weight_threshold": "bold_weight",
    "chunking_constitution.semantic_boundary_indicators": "markers",
    "strategy_mapping.cost_tier_to_model": "models",
    "domain_registry": "domains",
    "routing_rules": "rules",
}
#: Older paths of the same settings.
OLDER_SETTINGS = {
    "triage.min_digital_density": "min_digital", "triage.table_rect_threshold": "table_high", "triage.confidence_gate": "confidence_gate",
    "extraction.budget_cap_usd": "budget", "extraction.strategy_b_confidence": "b_confidence", "extraction.min_text_clarity": "min_clarity",
    "chunking.max_chunk_size": "max_chunk", "chunking.min_chunk_size": "min_chunk", "chunking.header_min_font_size": "min_font",
    "chunking.bold_weight_threshold": "bold_weight", "chunking.semantic_boundaries": "markers", "domains": "domains", "rules": "rules",
}
#: What a rules file holds besides, for readers or for tools that are plugged in.
ELSEWHERE = ("version", "metadata", "ocr_policy", "economic_guards.default_dpi", "economic_guards.vlm_max_output_tokens", "economic_guards.per_page_timeout_seconds")
#: Fixed value: the reason of a matched rule that names none.
MATCHED = "Matched routing rule."


def positive(value: object, default: float) -> float:
    """A positive number, or the default for anything else."""
    try:
        found = float(value)
    except (TypeError, ValueError):
        return default
    return found if found > 0 and found != float("inf") else default


def _whole(value: object, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return default


def read_rules(given: list) -> tuple:
    """Rules as (priority, condition, action, reason); without a condition the `when` form counts, in it or as `if` and `then`."""
    out = []
    for i, r in enumerate(given, 1):
        if isinstance(r, dict):
            condition = r.get("condition") or r.get("if") or r.get("when") or "False"
            action = r.get("action") or r.get("then") or "STRATEGY_C"
            out.append((_whole(r.get("priority"), i), condition if isinstance(condition, (str, dict)) else "False", action, str(r.get("reason") or r.get("description") or MATCHED)))
    return tuple(out)


def _leaves(settings: dict, known: dict, path: str = "") -> Iterator[tuple[str, object]]:
    for name, value in settings.items():
        here = f"{path}.{name}" if path else str(name)
        if isinstance(value, dict) and here not in known and here not in ELSEWHERE:
            yield from _leaves(value, known, here)
        else:
            yield here, value


def read_settings(settings: dict, base: Config = Config()) -> tuple[Config, list[str]]:
    """The settings of a rules file over `base`, and what in it isn't known, isn't of its kind or can't be compiled; such entries change nothing."""
    changes: dict = {}
    wrong: list[str] = []
    lists: dict[str, Callable[[list], tuple]] = {
        "rules": read_rules, "markers": lambda v: tuple(map(str, v)),
        "domains": lambda v: tuple((str(d.get("domain_hint", "General")), tuple(map(str, d.get("domain_keywords") or ()))) for d in v if isinstance(d, dict)),
    }
    known = {**OLDER_SETTINGS, **SETTINGS}
    for path, value in _leaves(settings, known):
        attribute = known.get(path)
        old = getattr(base, attribute) if attribute else None
        if attribute is None:
            if path not in ELSEWHERE:
                wrong.append(f"unknown setting {path}")
        elif attribute in lists:
            if isinstance(value, (list, tuple)):
                found = lists[attribute](list(value))
                if found or attribute == "markers":
                    changes[attribute] = found
            elif value is not None:
                wrong.append(f"{path} is no list")
        elif isinstance(old, dict):
            if isinstance(value, dict):
                changes[attribute] = {str(k).upper(): str(v) for k, v in value.items()}
            else:
                wrong.append(f"{path} is no mapping")
        elif (number := positive(value, 0.0)) and type(old)(number):
            changes[attribute] = type(old)(number)
        else:
            wrong.append(f"{path} is no positive number")
    out = base.with_(**changes)
    for priority, condition, _, _ in out.rules:
        wrong += [f"rule {priority}: {w}" for w in condition_column(condition, out)[1]]
    return out, wrong


def from_mapping(settings: dict, base: Config = Config()) -> Config:
    """Settings of a mapping as a rules file gives it; a warning for each entry that changes nothing."""
    out, wrong = read_settings(settings, base)
    for w in wrong:
        warn(w, stacklevel=2)
    return out


def from_text(text: str, base: Config = Config()) -> Config:
    """Settings of a rules file's text; tabs count as two spaces. A mapping at the top is needed."""
    import yaml

    found = yaml.safe_load(text.replace("\t", "  ")) or {}
    if not isinstance(found, dict):
        raise ValueError("the rules have to be a mapping")
    return from_mapping(found, base)


#: Frequent words of the supplied documents, since the default keywords hardly occur there.
CORPUS = Config(domains=(("Banking/Security", ("bank", "licensed", "token")), ("Public_Sector", ("rights", "und ", "les "))))
#: Chunk sizes at which packing, splitting and merging all occur in the supplied documents.
SMALL_CHUNKS = Config(max_chunk=60, min_chunk=12)

#: Metrics that rules may name, and the columns that hold them.
METRICS = {"char_density": "char_density", "rects": "rect_count", "rect_count": "rect_count", "width": "width", "height": "height"}


def condition_column(condition: str | dict, config: Config) -> tuple[Column, list[str]]:
    """A rule's condition, as text or in the `when` form, as a boolean Column over a page's metrics; and what is wrong with it."""
    limits = {"MIN_DIGITAL_DENSITY": config.min_digital, "TABLE_RECT_THRESHOLD": config.table_high, "TRIAGE_CONFIDENCE_GATE": config.confidence_gate}
    return conditions.compile_text(conditions.when_text(condition) if isinstance(condition, dict) else condition, METRICS, limits)


def strategy_of(action: object) -> str:
    """STRATEGY_A, _B or _C of an action written in any of the known ways; C for others."""
    name = str(action.get("strategy", "") if isinstance(action, dict) else action).strip().upper()
    name = name if name.startswith("STRATEGY_") else f"STRATEGY_{name}"
    return name if name in ("STRATEGY_A", "STRATEGY_B", "STRATEGY_C") else "STRATEGY_C"
