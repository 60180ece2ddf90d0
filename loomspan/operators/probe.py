"""UDF-05: logistic probe on standardised features, trained by Spark, scored by expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.numeric import dot

RIDGE = 0.02


@dataclass(frozen=True)
class Probe:
    mean: list[float]
    std: list[float]
    weights: list[float]
    bias: float

    def score(self, df: DataFrame, vector: str) -> DataFrame:
        """df with `p`, the probability of class 1."""
        w = [w / s for w, s in zip(self.weights, self.std, strict=True)]
        offset = self.bias - sum(m * x for m, x in zip(self.mean, w, strict=True))
        z = dot(F.col(vector), F.array(*map(F.lit, w))) + F.lit(offset)
        return df.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def fit(df: DataFrame, vector: str, label: str) -> Probe:
    """Distributed training; what comes to the driver is one number a feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    i = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).orderBy("i").collect()
    mean, std = [r.m for r in i], [r.s + 1e-6 for r in i]
    scaled = F.transform(F.col(vector), lambda x, k: (x - F.get(F.array(*map(F.lit, mean)), k)) / F.get(F.array(*map(F.lit, std)), k))
    train = df.select(array_to_vector(scaled).alias("features"), F.col(label).alias("label"))
    m = LogisticRegression(regParam=RIDGE, standardization=False, maxIter=200, tol=1e-9).fit(train)
    return Probe(mean, std, [float(x) for x in m.coefficients], float(m.intercept))
