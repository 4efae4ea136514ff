"""Vector arithmetic as Columns, and the same kernels over numpy matrices.

The Column forms stay in the JVM and are what SQL users see; the matrix forms score an Arrow batch of points against a
block of queries at once and carry the searches. Components are summed in double precision.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Names of the metrics, with the aliases that are accepted in any case.
METRICS = {"euclidean": "euclidean", "l2": "euclidean", "cosine": "cosine", "cos": "cosine", "dot_product": "dot_product", "dot": "dot_product", "ip": "dot_product"}


def metric_name(name: str) -> str:
    """The canonical name of a metric."""
    try:
        return METRICS[name.strip().lower()]
    except (KeyError, AttributeError):
        raise ValueError(f"unknown metric {name!r}: expected euclidean (l2), cosine (cos) or dot_product (dot, ip)") from None


def larger_is_better(metric: str) -> bool:
    return metric_name(metric) != "euclidean"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_vector(values) -> Column:
    """A constant array<double>."""
    return F.array(*(F.lit(float(v)) for v in values)) if len(values) else F.array().cast("array<double>")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot_product(a: Column | str, b: Column | str) -> Column:
    """Sum of products; vectors of different lengths raise, by check_dim."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def l1_norm(a: Column | str) -> Column:
    return _sum(F.transform(_col(a), lambda x: F.abs(x.cast("double"))))


def squared_euclidean(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 where either vector has norm 0."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot_product(a, b) / norms)


def normalize(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = l2_norm(a)
    return F.when(norm == 0, F.transform(_col(a), lambda x: x.cast("double"))).otherwise(F.transform(_col(a), lambda x: x.cast("double") / norm))


def _rounded(x: Column, digits: int) -> Column:
    y = x * F.lit(10.0**digits)
    n = F.rint(y)
    out = F.when(F.abs(y - n) == 0.5, y + F.signum(y) * 0.5).otherwise(n) / F.lit(10.0**digits)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def round_all(array: Column | str, digits: int) -> Column:
    """Every double of an array as SQL engines over C round it: the product with a power of ten, halves away from zero.

    Spark's round() goes by the decimal digits instead: it has no -0.0, and takes 4.1744875 up although its product is
    below the half.
    """
    return F.transform(_col(array), lambda x: _rounded(x.cast("double"), digits))


def round_to(value: Column | str, digits: int) -> Column:
    """One double, rounded as by round_all; it is computed once."""
    return F.element_at(round_all(F.array(_col(value)), digits), 1)


def score(metric: str, a: Column | str, b: Column | str) -> Column:
    return {"euclidean": euclidean_distance, "cosine": cosine_similarity, "dot_product": dot_product}[metric_name(metric)](a, b)


def check_dim(vector: Column | str, dim: int) -> Column:
    """The vector, or an error if its length isn't dim."""
    v = _col(vector)
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vector dimension mismatch: expected {dim}, got "), F.size(v).cast("string"))))


def is_finite(vector: Column | str) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    v = _col(vector)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def register_functions(spark: SparkSession) -> None:
    """Makes the functions available to SQL, as temporary SQL functions that the optimiser inlines."""
    pair = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN"
    one = "(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN"
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    norm = "sqrt(aggregate(transform({}, x -> x * x), 0D, (s, x) -> s + x))"
    for name, body in (
        ("vec_dot", f"{pair} {dot}"),
        ("vec_l2", f"{pair} sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
        ("vec_cosine", f"{pair} CASE WHEN {norm.format('a')} * {norm.format('b')} = 0 THEN 0D ELSE {dot} / ({norm.format('a')} * {norm.format('b')}) END"),
        ("vec_norm", f"{one} {norm.format('a')}"),
        ("vec_norm1", f"{one} aggregate(transform(a, x -> abs(x)), 0D, (s, x) -> s + x)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def matrix(array: pa.Array, dim: int | None = None) -> np.ndarray:
    """The rows of an Arrow list array as a float64 matrix; rows of another length raise."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if not n:
        return np.zeros((0, dim or 0))
    flat = array.flatten().to_numpy(zero_copy_only=False)
    dim = len(array[0].as_py()) if dim is None else dim
    if len(flat) != n * dim or reduce(lambda a, b: a and b, (len(x) == dim for x in array.slice(0, 1).to_pylist()), True) is False:
        raise ValueError(f"vector dimension mismatch: expected {dim}")
    sizes = np.diff(array.offsets.to_numpy())
    if (sizes != dim).any():
        raise ValueError(f"vector dimension mismatch: expected {dim}")
    return np.ascontiguousarray(flat, np.float64).reshape(n, dim)


def score_matrix(metric: str, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Scores of every query (rows) against every point (columns)."""
    metric = metric_name(metric)
    if metric == "euclidean":
        out = np.empty((len(queries), len(points)))
        for i, q in enumerate(queries):  # by differences: exact where a point equals the query
            out[i] = np.sqrt(((points - q) ** 2).sum(1))
        return out
    out = queries @ points.T
    if metric == "cosine":
        norms = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((points**2).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(norms == 0, 0.0, out / norms)
    return out


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right as SQL and the Column forms do: equal rows have equal sums wherever they stand."""
    return np.add.accumulate(x, 1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))


def row_norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(row_sums(x * x))


def score_pairs(metric: str, a: np.ndarray, b: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """The score of each row of a with the same row of b; for cosine, `norms` are the products of their norms."""
    metric = metric_name(metric)
    with np.errstate(all="ignore"):
        if metric == "euclidean":
            return row_norms(a - b)
        out = row_sums(a * b)
        if metric == "cosine":
            norms = row_norms(a) * row_norms(b) if norms is None else norms
            out = np.where(norms == 0, 0.0, out / norms)
        return out
