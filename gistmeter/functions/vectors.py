"""Column builders for numeric arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL if one of them has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def component_sums(vector: str, weight: Column, dim: int) -> list[Column]:
    """One sum per component; a plain aggregate, so it is combined before the shuffle."""
    return [F.sum(F.col(vector)[i] * weight).alias(f"_v{i}") for i in range(dim)]


def as_vector(dim: int) -> Column:
    return F.array(*[F.col(f"_v{i}") for i in range(dim)])
