"""Column builders for scaling numbers.  Anything undefined is NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def safe_log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def signed_log1p(x: Column) -> Column:
    """sign(x) * log(1 + |x|), the term of the power transform's likelihood."""
    return F.when(x >= 0, F.log1p(F.greatest(x, F.lit(0.0)))).otherwise(-F.log1p(-F.least(x, F.lit(0.0))))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The four branches of Yeo and Johnson (2000)."""
    up, down = F.greatest(x, F.lit(0.0)), -F.least(x, F.lit(0.0))
    return (F.when((x >= 0) & (lam == 0), F.log1p(up))
            .when(x >= 0, (F.pow(up + 1, lam) - 1) / F.when(lam != 0, lam))
            .when(lam == 2, -F.log1p(down))
            .when(x < 0, -(F.pow(down + 1, 2 - lam) - 1) / F.when(lam != 2, 2 - lam)))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Position between two bounds; 0 if the bounds are equal."""
    return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)))
