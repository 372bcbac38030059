"""Dense vectors and term-count vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smoothed inverse document frequency of a term found in one of two texts.
LONE_TERM_WEIGHT = "1 + ln(1.5)"


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_normalize(a) -> Column:
    length = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a, b) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def tfidf_from_sums(d, qa, qb, sum_a, sum_b) -> Column:
    k2 = F.pow(F.expr(LONE_TERM_WEIGHT), F.lit(2.0))
    norm = F.sqrt((qa + k2 * (sum_a - qa)) * (qb + k2 * (sum_b - qb)))
    return F.when((sum_a == 0) | (sum_b == 0), F.lit(0.0)).otherwise(d / norm)
