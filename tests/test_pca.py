"""Components are orthogonal, hold the largest variances and are centred."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from notedrift.operators import models as MD


def test_components_hold_the_largest_variances(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 5)) @ rng.standard_normal((5, 5)) * [1, 50, 0.1, 3, 1] + [0, 7, 1, -400, 2]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id INT, a ARRAY<DOUBLE>").repartition(4).withColumn("v", array_to_vector(F.col("a")))
    got = np.array([r.p for r in MD.pca(df, "v", 2).orderBy("id").select(vector_to_array("pca").alias("p")).collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    cov = np.cov(got.T)
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(np.diag(cov), values[:2], rtol=1e-6) and abs(cov[0, 1]) < 1e-9 * values[0]
