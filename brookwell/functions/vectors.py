"""Vector functions over array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """The vector divided by its length, so that hot loops need the dot product alone; zero vectors stay. The length is a lambda's variable, as one named inside a lambda is worked out again for each element."""

    def divided(n: Column) -> Column:
        return F.when(n > 1e-8, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))

    return F.get(F.transform(F.array(norm(a)), divided), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if the product of the lengths is 1e-8 or less."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-8, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(cos: Column) -> Column:
    """1 - d / 2 of the cosine distance d."""
    return (1 + cos) / 2


def path_score(weights: Column) -> Column:
    """Product of a path's weights (null counts as 1) divided by its length."""
    return F.aggregate(weights, F.lit(1.0), lambda s, w: s * F.coalesce(w.cast("double"), F.lit(1.0))) / F.size(weights)
