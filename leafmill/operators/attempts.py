"""Attempts at a document's pages, with what earlier ones change in later ones.

A page's strategies are tried in turn until one succeeds, as judged by its confidence. Vision
attempts spend a document's budget, and one that fails for lack of credit or of a connection
disables vision for the pages after it; then vision attempts aren't made: they fail, at no cost.

Both conditions stay once they hold, and vision ends every chain, so what isn't made never changes
which attempts are reached. So sums and flags over a document's earlier vision attempts
answer the question of feedback, in windows of one ordering, and no document has to fit in one row.
`streaming.attempts` carries the same state from batch to batch.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from . import extraction, units

#: What errors say that disable vision.
OUTAGES = ("insufficient credits", "cannot be reached")
MONEY = "decimal(20,9)"


def possible(pages: DataFrame, found: DataFrame, config: Config) -> DataFrame:
    """One row per page and strategy of its chain, judged by the page's units; pages as for units.judged_pages with `dominant_strategy`, and what else they hold."""
    chain = extraction.strategy_chain(F.coalesce("origin_type", F.lit("unknown")), F.col("dominant_strategy"))
    each = pages.select("*", F.posexplode(chain).alias("_no", "strategy")).withColumn("attempt_no", F.col("_no") + 1).drop("_no")
    return units.judged_pages(each, found, config)


def outcomes(judged: DataFrame) -> DataFrame:
    """Adds `status` and `breaks`: an attempt with an error has no units and no confidence; vision ones with certain errors break."""
    failed = F.col("error").isNotNull()
    breaks = failed & (F.col("strategy") == "STRATEGY_C")
    said = F.lit(False)
    for text in OUTAGES:
        said = said | F.lower("error").contains(text)
    return judged.withColumns({
        "status": F.when(~failed & F.col("success"), "success").otherwise("fail"), "confidence": F.when(failed, 0.0).otherwise(F.col("confidence")),
        "breaks": F.coalesce(breaks & said, F.lit(False)),
    })


def _nothing(name: str, skipped: Column) -> Column:
    return F.when(skipped, F.lit(0).cast("double")).otherwise(F.col(name).cast("double"))


def unmade(attempts: DataFrame, disabled: Column, spend: Column, budget: float) -> DataFrame:
    """Adds `spend_before` and `skipped` (disabled, budget or null); skipped attempts fail and cost nothing."""
    vision = F.col("strategy") == "STRATEGY_C"
    why = F.when(vision & disabled, "disabled").when(vision & (spend >= F.lit(Decimal(str(budget)))), "budget")
    out = attempts.withColumns({"spend_before": spend.cast("double"), "skipped": why})
    none = F.col("skipped").isNotNull()
    return out.withColumns({"status": F.when(none, "fail").otherwise(F.col("status")), **{c: _nothing(c, none) for c in ("cost", "processing_time_ms", "confidence")}})


def made(outcome: DataFrame, budget: float) -> DataFrame:
    """Attempts in the order in which a document's pages are worked on: up to each page's first success, vision within the budget and until it is disabled.

    outcome(file_id, page_number, attempt_no, strategy, status, confidence, cost, processing_time_ms,
    breaks). A null or negative cost is none.
    """
    tried = extraction.escalate(outcome)
    earlier = Window.partitionBy("file_id").orderBy("page_number", "attempt_no").rowsBetween(Window.unboundedPreceding, -1)
    cost = F.when(F.col("strategy") == "STRATEGY_C", F.greatest(F.lit(0), F.coalesce("cost", F.lit(0)).cast(MONEY))).otherwise(F.lit(0)).cast(MONEY)
    limit = F.lit(Decimal(str(budget)))
    t = tried.withColumn("_cost", cost).withColumn("_asked", F.coalesce(F.sum("_cost").over(earlier), F.lit(0)))
    # an outage counts where the attempt is made: before the budget is reached
    t = t.withColumn("_off", F.coalesce(F.max(F.col("breaks") & (F.col("_asked") < limit)).over(earlier), F.lit(False)))
    spent = F.when(~F.col("_off") & (F.col("_asked") < limit), F.col("_cost")).otherwise(F.lit(0))
    t = t.withColumn("_spend", F.coalesce(F.sum(spent).over(earlier), F.lit(0)))
    return unmade(t, F.col("_off"), F.col("_spend"), budget).drop("_cost", "_asked", "_off", "_spend")
