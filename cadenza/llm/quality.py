"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

FEATURES of a whole text are standardised and mapped by random Fourier features to DIMENSIONS cosines, whose inner
products approximate a Gaussian kernel. Every partition sums its own normal equations over the labelled rows; the
sums of some partitions are added in a task, and the driver adds those, solves for the ridge weights, and holds
nothing whose size depends on the data. A fourth of the training rows calibrates: their ridge scores are counted
in BINS bins, and isotonic regression over the bins turns a score into the share of label 1.

The cosines are rounded to 2**-12, so sums of their products are exact and come out alike in any order.

All labelled rows outside the held-out fold are used; there is no sample. Defined cases: a null or empty text has
zero for every feature and is scored as such; repeated rows are scored each; equal labels of an id count once, different ones each;
without any label the score is 0.5; an empty table gives an empty result; null ids are in the held-out fold; extra
columns are kept by `keep_good` and ignored by `score`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpoint, packed
from .textstats import FEATURES, features

DIMENSIONS = 128
BANDWIDTH = 4.0
RIDGE = 1e-4
BINS = 1024
FOLDS = 5
THRESHOLD = 0.3
SEED = 11
#: Rows that are mapped at once: a row of cosines takes some times the room of its features.
ROWS_AT_ONCE = 1024


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(rows.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[at : at + ROWS_AT_ONCE] for at in range(0, len(rows), ROWS_AT_ONCE)]


def _features(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float32).reshape(-1, len(FEATURES))


def featurise(docs: DataFrame, name: str = "text") -> DataFrame:
    """`docs` and `_x`, the FEATURES of each text."""

    def compute(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"_x": _lists(_features(texts))}

    return append_columns(docs, name, [("_x", T.ArrayType(T.FloatType()))], compute)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Rows of DIMENSIONS rounded cosines and a one."""
        rng = np.random.default_rng(SEED)
        frequencies = rng.normal(size=(len(FEATURES), DIMENSIONS)) / BANDWIDTH
        phases = rng.uniform(0, 2 * np.pi, DIMENSIONS)
        z = np.cos(np.clip((x - self.mean) / self.scale, -4, 4) @ frequencies + phases)
        return np.hstack([np.rint(z * 4096) / 4096, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.fourier(part) @ self.weights for part in _parts(x)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.ridge(x), *self.knots), 0, 1)


def _standard(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and deviation of each feature, to six digits; None without rows."""
    at = range(len(FEATURES))
    x = F.col("_x")
    got = rows.agg(F.count("*"), *(F.avg(x[i]) for i in at), *(F.stddev_pop(x[i]) for i in at)).first()
    if not got[0]:
        return None
    values = np.array([float(f"{v:.6g}") for v in got[1:]])
    return values[: len(FEATURES)], values[len(FEATURES) :] + 1e-6


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Z'Z, Z'y and the count over rows (_x, label), added up partition by partition."""
    width = DIMENSIONS + 1
    schema = "slot int, sums binary"
    slots = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                for z, own in zip(map(model.fourier, _parts(_matrix(batch.column("_x")))), _parts(y), strict=True):
                    sums += z.T @ np.hstack([z, own[:, None]])
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % slots], pa.int32()), "sums": [sums.tobytes()]})

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"slot": table.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    merged = rows.select("_x", "label").mapInArrow(partial, schema).groupBy("slot").applyInArrow(merge, schema).collect()
    total = sum(np.frombuffer(r["sums"]).reshape(width, width + 1) for r in merged)
    return total[:, :width], total[:, width], float(total[-1, width - 1])


def isotonic(position: np.ndarray, count: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order; knots at both ends of every pool."""
    pools: list[list[float]] = []
    for p, n, k in zip(position, count, positive, strict=True):
        pools.append([p, p, n, k])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, high, n2, k2 = pools.pop()
            pools[-1][1:] = [high, pools[-1][2] + n2, pools[-1][3] + k2]
    return np.array([x for p in pools for x in p[:2]]), np.array([p[3] / p[2] for p in pools for _ in range(2)])


def fit(rows: DataFrame) -> Model:
    """A model from training rows (_x, label, fold): fold 4 calibrates, the others give the weights."""
    standard = _standard(rows)
    if standard is None:
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    model = Model(*standard)
    a, b, n = _normal_equations(rows.where("fold <> 4"), model)
    weights = np.linalg.solve(a + RIDGE * max(n, 1) * np.eye(len(a)), b)
    model = Model(*standard, weights)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.clip(np.rint(model.ridge(_matrix(batch.column("_x"))) * BINS), -BINS, 2 * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], ["bin", "label"])

    held = rows.where("fold = 4")
    held = held if held.limit(1).count() else rows
    bins = held.select("_x", "label").mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("k")).orderBy("bin").collect()
    at, n_, k_ = (np.array([r[c] for r in bins], float) for c in ("bin", "n", "k"))
    return Model(*standard, weights, isotonic(at / BINS, n_, k_))


def training_rows(x: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """_x, label, fold of the labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("label")).where("label is not null").distinct()
    return x.join(known, F.col("doc_id") == F.col("_id")).select("_x", "label", fold(F.col("doc_id")).alias("fold")).where("fold <> 0")


def _scored(x: DataFrame, model: Model) -> DataFrame:
    """`x` with the column _x turned into _score."""
    schema = T.StructType([*(f for f in x.schema.fields if f.name != "_x"), T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("_x")
            score = model.score(_matrix(batch.column(i))) if batch.num_rows else np.zeros(0)
            others = [k for k in range(batch.num_columns) if k != i]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(score)], [*(batch.schema.names[k] for k in others), "_score"])

    return x.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Texts are read once; their features are checkpointed."""
    x = checkpoint(featurise(docs.select("doc_id", "text")).drop("text"))
    scored = _scored(x, fit(checkpoint(training_rows(x, labels, "quality"))))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least THRESHOLD, their columns as they were.

    Features are made twice (to fit and to filter): that costs less than moving the texts.
    """
    x = featurise(docs.select("doc_id", "text")).drop("text")
    model = fit(checkpoint(training_rows(x, labels, "quality")))

    def compute(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"_score": pa.array(model.score(_features(texts).astype(np.float64)))}

    return append_columns(packed(docs), "_doc.text", [("_score", T.DoubleType())], compute).where(F.col("_score") >= THRESHOLD).select("_doc.*")
