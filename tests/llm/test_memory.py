"""What a Python worker holds over the stages of the pipeline, and how much text it gets at once."""

import gc
import weakref

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens.llm import common, compression, near_copies


class Remembers:
    """Refers to itself, as a decoder does through its memories."""

    def __init__(self):
        self.make = self.__init__


@pytest.fixture
def no_collector():
    gc.disable()
    yield
    gc.enable()


@pytest.fixture
def batch_bytes(spark):
    before = spark.conf.get(common.BATCH_BYTES, None)
    spark.conf.unset(common.BATCH_BYTES)
    yield spark
    spark.conf.unset(common.BATCH_BYTES) if before is None else spark.conf.set(common.BATCH_BYTES, before)


def test_the_value_before_goes_at_once(no_collector):
    old = weakref.ref(common.held_latest("test", 1, Remembers))
    assert common.held_latest("test", 1, Remembers) is old()
    common.held_latest("test", 2, Remembers)
    assert old() is None


class Rows:
    def mapInPandas(self, run, schema):
        return run


def sketch():
    batch = pd.DataFrame({"doc_id": [1], "text": ["a b c d e f g"], "mark": [5]})
    return list(near_copies.sketches(Rows(), 5, 32, 6)(iter([batch])))


def judge():
    model = {"dictionaries": [(b"good text", b"poor text")] * 2, "calibration": lambda x: x[:, 0]}
    return list(compression.scorer(model).func(iter([pd.Series(["a b c", None])])))


@pytest.mark.parametrize("stage", [sketch, judge])
def test_later_stages_let_the_words_of_earlier_ones_go(spark, stage, no_collector):
    old = weakref.ref(common.held_latest("words", "earlier", Remembers))
    assert stage()
    assert old() is None


def test_stages_bound_the_text_that_python_gets_at_once(batch_bytes):
    spark = batch_bytes
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 1500).alias("text"))
    assert corpus_pipeline.STAGES[2][1](spark, docs.limit(3), "").count() == 3

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"bytes": [int(b["text"].str.len().sum())]})
    got = [r.bytes for r in docs.mapInPandas(sizes, "bytes long").collect()]
    assert sum(got) == 1500 * sum(len(str(i)) for i in range(3000)) and max(got) <= 1.1 * (1 << 22)


def test_a_bound_set_before_stays(batch_bytes):
    batch_bytes.conf.set(common.BATCH_BYTES, "1000")
    common.small_batches(batch_bytes)
    assert batch_bytes.conf.get(common.BATCH_BYTES) == "1000"
