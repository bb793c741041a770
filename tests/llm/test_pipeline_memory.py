"""The pipeline's failed check of round 3: what a stage's Python workers hold, and how many a task needs."""

import corpus_pipeline
from pyspark.sql import functions as F

from cargolens.llm import common, langid


def test_a_filter_on_the_language_does_not_read_the_texts_twice(spark, docs):
    for df in (corpus_pipeline.language(spark, docs, ""), langid.identify(docs, langid.learn(docs)).where(F.col("lang_pred") != langid.UNKNOWN)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))

    def twice(batches):
        for b in batches:
            yield b * 2

    run = common.tidy(twice)(iter([1, 2]))
    assert next(run) == 2 and not calls
    assert list(run) == [4] and calls == [1]
    common.tidy(twice)(iter([])).close()
