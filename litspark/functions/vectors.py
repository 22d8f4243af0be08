"""Vector expressions on array<float>; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark.functions.text import bind

def _zero() -> Column:
    return F.lit(0.0).cast("double")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    # bound, or the length would be worked out again for every element
    return bind(F.struct(v.alias("v"), norm(v).alias("n")), lambda b: F.transform(
        b["v"], lambda x: F.when(b["n"] > 0, x.cast("double") / b["n"]).otherwise(x.cast("double"))
    ))


def is_unit(length: Column) -> Column:
    # Absolute 1e-3 plus relative 1e-5, the tolerance half-rounded vectors need
    return F.abs(length - 1) <= 1e-3 + 1e-5


def half_round(v: Column) -> Column:
    """Nearest half-precision value of every element (11 significant bits, ties to even)."""

    def narrow(x: Column) -> Column:
        x = x.cast("double")
        exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
        step = F.pow(F.lit(2.0), exponent - 10)
        return F.when(x == 0, x).otherwise(F.rint(x / step) * step)

    return F.transform(v, narrow)
