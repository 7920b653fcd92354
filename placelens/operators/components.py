"""Principal components of sparse rows: block power iteration with implicit centring.

The rows stay sparse and where they are. A pass multiplies them with a block of a few more vectors than components are
wanted, and back; the centred matrix is never formed, as the mean only enters through its product with the block. The
driver holds columns x block numbers, never a matrix of columns x columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCAModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.session import cut

OVERSAMPLE = 8
MAX_PASSES = 40
TOLERANCE = 1e-9


def _entries(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column number, value) of all entries of an Arrow column of vectors, sparse or dense."""
    lists = column.field("values")
    counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(lists.flatten(), dtype=np.float64)
    owner = np.repeat(np.arange(len(column)), counts)
    dense = np.asarray(column.field("type").fill_null(0)).astype(bool)
    at = np.arange(len(values)) - (np.cumsum(counts) - counts)[owner]
    at[~dense[owner]] = np.asarray(column.field("indices").flatten(), dtype=np.int64)
    return owner, at, values


def _sums(rows: DataFrame, run, width: int, columns: int) -> np.ndarray:
    """Sum over all tasks of the (column, numbers) rows that ``run`` gives, as columns x width."""
    parts = rows.mapInArrow(run, "at int, part array<double>")
    total = parts.groupBy("at").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(width)]).alias("part"))
    out = np.zeros((columns, width))
    for at, part in total.toLocalIterator():
        out[at] = part
    return out


def _by_column(sums: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(sums.any(axis=1))
    parts = pa.array(list(sums[used]), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), parts], ["at", "part"])


def column_sums(rows: DataFrame, columns: int) -> np.ndarray:
    """Sum and sum of squares of each column."""

    def run(batches):
        out = np.zeros((columns, 2))
        for batch in batches:
            _, at, values = _entries(batch.column(0))
            out[:, 0] += np.bincount(at, values, columns)
            out[:, 1] += np.bincount(at, values * values, columns)
        yield _by_column(out)

    return _sums(rows, run, 2, columns)


def covariance_product(rows: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Centred rows, transposed, times centred rows times ``block``, in one pass."""
    columns, width = block.shape
    shared = rows.sparkSession.sparkContext.broadcast((block, mean @ block))

    def run(batches):
        factor, shift = shared.value
        out = np.zeros((columns, width))
        for batch in batches:
            owner, at, values = _entries(batch.column(0))
            for j in range(width):
                score = np.bincount(owner, values * factor[at, j], batch.num_rows) - shift[j]
                out[:, j] += np.bincount(at, values * score[owner], columns)
        yield _by_column(out)

    # The centred scores sum to zero, so the mean of the rows needs no term of its own.
    return _sums(rows, run, width, columns)


def principal_components(rows: DataFrame, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components as columns, their variances, the mean) of a one-column table of vectors.

    Passes end when the variances found no longer change. The largest loading of a component is positive.
    """
    rows = cut(rows.where(F.col(rows.columns[0]).isNotNull()))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to fit components on")
    n, columns = rows.count(), first[0].size
    k = min(k, columns)
    sums = column_sums(rows, columns)
    mean = sums[:, 0] / n
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, min(columns, k + OVERSAMPLE))))[0]
    found = None
    for _ in range(MAX_PASSES):
        product = covariance_product(rows, mean, block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        order = np.argsort(-values)
        before, found = found, values[order][:k]
        vectors = block @ turn[:, order][:, :k]
        if block.shape[1] == columns or (before is not None and np.abs(found - before).max() <= TOLERANCE * max(1e-12, found[0])):
            break
        block = np.linalg.qr(product)[0]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return vectors * np.where(signs == 0, 1, signs), np.maximum(found, 0) / max(1, n - 1), mean


class SparsePCA(Estimator, HasInputCol, HasOutputCol):
    """As ``pyspark.ml``'s PCA for use in a pipeline, for any number of columns. The fitted model has ``offset``, the
    scores of the mean, which centred scores have to leave out."""

    @keyword_only
    def __init__(self, *, k: int = 2, inputCol: str = "features", outputCol: str = "components"):
        super().__init__()
        self.k = k
        self._set(inputCol=inputCol, outputCol=outputCol)

    def copy(self, extra=None):
        return SparsePCA(k=self.k, inputCol=self.getInputCol(), outputCol=self.getOutputCol())

    def _fit(self, dataset: DataFrame) -> PCAModel:
        components, variances, mean = principal_components(dataset.select(self.getInputCol()), self.k)
        context = dataset.sparkSession.sparkContext
        total = variances.sum() or 1.0
        matrix = DenseMatrix(*components.shape, components.ravel(order="F"))
        java = context._jvm.org.apache.spark.ml.feature.PCAModel(
            self.uid, _py2java(context, matrix), _py2java(context, DenseVector(variances / total))
        )
        model = PCAModel(java)
        model._resetUid(self.uid)
        model._set(k=components.shape[1], inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        model.offset = mean @ components
        model.variances = variances
        return model
