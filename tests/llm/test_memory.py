"""What the pipeline's steps hand to Python, and how many Python workers they start."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import common, language_id, mixing, packing, similar_texts

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
MODEL = language_id.LanguageModel(("en", "fr"), np.zeros((1 << 16, 2), np.float32), np.zeros(2), (2, 3))
STEPS = {
    "fit": language_id.fit,
    "keep_known": lambda df: language_id.keep_known(df, MODEL, 0.5),
    "predict": lambda df: language_id.predict(df, MODEL),
    "similar_groups": similar_texts.similar_groups,
    "mix_documents": mixing.mix_documents,
    "pieces": packing.pieces,
}


@pytest.fixture
def session(spark):
    spark.conf.unset(SETTING)
    yield spark
    spark.conf.unset(SETTING)


def largest_batch(df):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("step", STEPS)
def test_batches_of_texts_are_bounded_by_bytes(session, step):
    few = session.createDataFrame([(1, "a few words of one text", "en", "s")], "doc_id long, text string, lang string, source string")
    texts = session.range(500, numPartitions=1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    assert largest_batch(texts) > 4 << 20
    STEPS[step](few)
    assert largest_batch(texts) < common.BATCH_BYTES + 20_000  # one row more
    assert largest_batch(texts.select(F.struct("text").alias("row"))) < common.BATCH_BYTES + 20_000


def test_smaller_bounds_of_callers_stay_and_change_no_result(session):
    texts = [None, "", "un mot", *(f"{'many words ' * (i % 7)} and number {i}" for i in range(200))]
    docs = session.createDataFrame([(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(2)
    found = []
    for size in (None, "1k"):
        if size:
            session.conf.set(SETTING, size)
        model = language_id.fit(docs)
        found.append([model.languages, sorted(language_id.predict(docs, model).collect()), sorted(packing.pack_documents(docs).collect()), sorted(map(str, mixing.mix_documents(docs).collect())), sorted(similar_texts.similar_groups(docs).collect())])
        assert session.conf.get(SETTING) == (size or str(common.BATCH_BYTES))
    assert found[0] == found[1]


def test_plans_of_a_mix_start_no_workers_of_their_own(session):
    plan = mixing._Plan([("a", 5000), (None, 3000), ("b", 0)], 256, 3, None, 7)
    for df in (plan.sources_table(session), plan.slots(session)):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["k"], r["name"], r["source_size"]) for r in plan.sources_table(session).orderBy("k").collect()] == [(0, "a", 5000), (1, "b", 0), (2, None, 3000)]
    none = mixing._Plan([], 256, 3, None, 7)
    assert none.sources_table(session).collect() == none.slots(session).collect() == []
