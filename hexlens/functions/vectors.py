"""Vector expressions (F2, F3, F14, F15, P8) on ``array<float|double>`` columns.

All are Catalyst higher-order functions over one row's array: narrow, no
shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use) -> Column:
    """``use`` of a variable that holds ``value``, which is made once a row.

    The optimiser puts a column that is named once into the place where it is
    named, a lambda's body too, where it would be made for every element.
    """
    return F.transform(F.array(value), use)[0]


def hash_slot(s, modulus: int) -> Column:
    """int(sha256(utf8(s))) mod m; equals last digest byte mod m for m | 256."""
    if 256 % modulus:
        raise ValueError("modulus must divide 256 (the slot is taken from the last digest byte)")
    last = F.conv(F.substring(F.sha2(_c(s), 256), 63, 2), 16, 10).cast("int")
    return F.pmod(last, F.lit(modulus))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """v / ||v|| when the norm is positive and finite, else zeros."""
    arr = _c(v)

    def finish(ss):
        # runs once per row: the norm is bound once, not recomputed per element
        n = F.sqrt(ss)
        ok = (n > 0) & ~F.isnan(n) & (n != F.lit(float("inf")))
        return F.when(ok, F.transform(arr, lambda x: x.cast("double") / n)) \
                .otherwise(F.transform(arr, lambda x: F.lit(0.0)))

    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"), finish)


def sq_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) *
                                  (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, t: acc + t)


def l2_distance(a, b) -> Column:
    """Euclidean distance; null when the dimensions differ (Q10: reject)."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.sqrt(sq_distance(a, b)))


def standardise(v, mean, scale) -> Column:
    """(x - mean) / scale element-wise (scale already has 0 replaced by 1)."""
    return F.zip_with(F.zip_with(_c(v), _c(mean), lambda x, m: x.cast("double") - m), _c(scale),
                      lambda d, s: d / s)


def fit_dim(v, n: int, dtype: str = "float") -> tuple[Column, Column]:
    """Pad with zeros / truncate to n; returns (vector, status)."""
    arr = _c(v)
    fixed = F.slice(F.concat(arr.cast(f"array<{dtype}>"), F.array_repeat(F.lit(0).cast(dtype), n)), 1, n)
    status = F.when(F.size(arr) < n, "padded").when(F.size(arr) > n, "truncated").otherwise("ok")
    return fixed, status


def align_ragged(df, col: str, out: str = "aligned"):
    """Rows of different lengths as vectors of the longest row's width (one scalar aggregate).

    The vectors are sparse: a struct of the width and the row's own values,
    all further ones being zero, so that one long row does not inflate others.
    """
    n = df.agg(F.max(F.size(col))).first()[0] or 0
    status = F.when(F.size(col) < n, "padded").otherwise("ok")
    return df.withColumn(out, F.struct(F.lit(n).alias("width"), F.col(col).alias("values"))).withColumn(out + "_status", status), n
