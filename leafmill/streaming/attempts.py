"""The attempts of operators.attempts as a stream: a document's spending and outage are its state."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.attempts import MONEY
from . import sink

OUT = "file_id string, page_number int, attempt_no int, strategy string, status string, confidence double, cost double, processing_time_ms double, spend_before double, skipped string"
_STATE = f"page int, attempt int, done boolean, spend {MONEY}, off boolean"


class _Document(StatefulProcessor):
    """Where the work on a document stands: the last page and attempt, whether the page is done, spending, and whether vision is off."""

    def __init__(self, budget: float):
        self.budget = Decimal(str(budget))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("document", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        page, attempt, done, spend, off = self.state.get() if self.state.exists() else (0, 0, False, Decimal(0), False)
        # a batch's rows of one document
        for r in sorted(rows, key=lambda r: (r["page_number"], r["attempt_no"])):
            here = (r["page_number"], r["attempt_no"])
            if here <= (page, attempt):
                yield self._row(key, r, "fail", spend, "late")
                continue
            if here[0] == page and done:
                continue
            vision = r["strategy"] == "STRATEGY_C"
            why = "disabled" if vision and off else "budget" if vision and spend >= self.budget else None
            status = "fail" if why else r["status"]
            yield self._row(key, r, status, spend, why)
            if vision and not why:
                spend += max(Decimal(0), Decimal(str(r["cost"] or 0)))
                off = off or r["breaks"]
            page, attempt, done = *here, status == "success"
        self.state.update((page, attempt, done, spend, off))

    @staticmethod
    def _row(key: tuple, r: Row, status: str, spend: Decimal, why: str | None) -> Row:
        own = (0.0, 0.0, 0.0) if why else (r["confidence"], r["cost"], r["processing_time_ms"])
        return Row(file_id=key[0], page_number=r["page_number"], attempt_no=r["attempt_no"], strategy=r["strategy"], status=status, confidence=own[0], cost=own[1], processing_time_ms=own[2], spend_before=float(spend), skipped=why)

    def close(self) -> None:
        pass


def made(outcomes: DataFrame, budget: float) -> DataFrame:
    """A stream of outcomes (see operators.attempts.made, file_id as text) as the attempts that are made.

    A document's pages come in order, batch by batch; rows that come after a later one of their document are `late`
    and change nothing.
    """
    return outcomes.groupBy("file_id").transformWithState(_Document(budget), OUT, "append", "none")


def run(outcomes: DataFrame, budget: float, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts `made` into the exactly-once sink; its state is kept by the RocksDB provider, which state of this kind needs."""
    conf, name = outcomes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return sink.write(made(outcomes, budget), folder, checkpoint)
    finally:
        conf.set(name, before)
