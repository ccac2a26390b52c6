"""Table functions for SQL against the deposits of the library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymill.functions import tables
from skymill.operators import deposit

SCHEMA = "frame int, x double, y double, h double"


def particles(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def in_pixels(df, width, height, parts):
    return df.select("frame", (F.monotonically_increasing_id() % parts).alias("part"), (F.col("x") * width).alias("px"), (F.col("y") * height).alias("py"), (F.col("h") * width).alias("h_px"), F.lit(float(width * height)).alias("weight"))


def image(rows):
    return {(r["frame"], r["iy"], r["ix"]): r["rho"] for r in rows if abs(r["rho"]) > 1e-9}


@pytest.mark.parametrize("parts", [1, 7])
def test_functions_equal_deposits(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(int(f), float(x), float(y), float(h)) for f, x, y, h in zip(rng.integers(0, 3, 300), rng.random(300) * 1.2 - 0.1, rng.random(300) * 1.2 - 0.1, rng.choice([0.004, 0.02, 0.1, 0.0, -1.0], 300), strict=True)]
    # One place many times, and the middles and corners of pixels.
    df = particles(spark, rows + [(1, 0.5, 0.5, 0.03)] * 200 + [(0, k / 40, k / 40, 0.01) for k in range(41)])
    tables.register(spark)
    in_pixels(df, 20, 16, parts).createOrReplaceTempView("dealt")
    for name, expected in (("kernel_footprints", deposit.sph_map(df, 20, 16, (0.5, 0.5), 1.0, ("frame",))), ("cell_stencils", deposit.cic_map(df, 20, 16, (0.5, 0.5), 1.0, ("frame",)))):
        got = image(spark.sql(f"SELECT frame, iy, ix, sum(rho) AS rho FROM {name}(TABLE(dealt) PARTITION BY part) WHERE iy BETWEEN 0 AND 15 AND ix BETWEEN 0 AND 19 GROUP BY ALL").collect())
        want = image(expected.collect())
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_rows_that_touch_nothing(spark):
    df = particles(spark, [(0, None, 0.5, 0.1), (0, 0.5, None, 0.1), (None, 0.5, 0.5, 0.1), (0, 0.5, 0.5, 0.0), (0, 0.5, 0.5, -2.0)])
    tables.register(spark)
    in_pixels(df, 10, 10, 2).createOrReplaceTempView("odd")
    assert spark.sql("SELECT * FROM kernel_footprints(TABLE(odd) PARTITION BY part)").count() == 0
    # A length plays no part in a stencil.
    assert spark.sql("SELECT sum(rho) FROM cell_stencils(TABLE(odd) PARTITION BY part)").first()[0] == pytest.approx(200.0)
    assert spark.sql("SELECT * FROM cell_stencils(TABLE(SELECT * FROM odd WHERE part > 9) PARTITION BY part)").count() == 0
