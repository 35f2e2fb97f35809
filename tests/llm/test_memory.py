"""What workers hold at once is bounded by bytes, not rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import simhash
from cadenza.llm.common import BATCH_BYTES, append_columns, bounded_batches


def test_words_travel_in_small_batches():
    prints = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(prints)], ["fp"])
    for bits in (5, 9):
        made = [list(simhash._emit(step, bits, simhash.DISTANCE)(iter([batch]))) for step in range(simhash.PASSES)]
        assert max(b.nbytes for step in made for b in step) < 4 << 20
        assert max(len(x.as_py()) for step in made for b in step for x in b.column("words")) < 256 << 10
        assert sum(len(x.as_py()) for step in made for b in step for x in b.column("words")) == 8 * 2081 * len(prints)
    assert simhash._chunk(20, 2081) * 2081 // simhash.PASSES * 10 < 16 << 20


def test_texts_travel_in_small_batches(spark):
    rows = spark.range(0, 6000, 1, 1).select(F.struct(F.repeat(F.lit("word "), 800).alias("text")).alias("_doc"))
    sizes = append_columns(rows, "_doc.text", [("_bytes", T.LongType())], lambda x: {"_bytes": pa.array([sum(map(len, x))] * len(x), pa.int64())})
    assert 0 < sizes.agg(F.max("_bytes")).first()[0] <= 2 * BATCH_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "1m")  # a size that the session sets stays
    try:
        bounded_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, old)
