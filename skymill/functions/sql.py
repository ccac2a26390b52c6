"""The scalar functions for SQL text: temporary SQL functions, which Spark inlines into the plan."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .kernels import GL_NODES, GL_WEIGHTS


def _profile(u: str) -> str:
    return f"CASE WHEN {u} < 1 THEN 1 - 1.5D * {u} * {u} + 0.75D * {u} * {u} * {u} WHEN {u} < 2 THEN 0.25D * (2 - {u}) * (2 - {u}) * (2 - {u}) ELSE 0D END"


def definitions() -> dict[str, tuple[str, str]]:
    """name -> (arguments, body), all of doubles."""
    terms = " + ".join(f"{2 * w!r}D * {_profile(f'sqrt(q * q + (4 - q * q) * {x * x!r}D)')}" for x, w in zip(GL_NODES, GL_WEIGHTS, strict=True))
    unit = "greatest(0D, least(1D, t))"
    return {
        "spline_3d": ("u DOUBLE", "8 / pi() * CASE WHEN u < 0.5D THEN 6 * u * u * (u - 1) + 1 WHEN u < 1 THEN 2 * (1 - u) * (1 - u) * (1 - u) ELSE 0D END"),
        "spline_projected": ("q DOUBLE", f"CASE WHEN q < 2 THEN sqrt(greatest(4 - q * q, 0D)) * ({terms}) / pi() ELSE 0D END"),
        "wrap_position": ("p DOUBLE, box DOUBLE", "CASE WHEN p < 0 THEN p + box WHEN p >= box THEN p - box ELSE p END"),
        "minimum_image": ("d DOUBLE, box DOUBLE", "CASE WHEN d > box / 2 THEN d - box WHEN d < -box / 2 THEN d + box ELSE d END"),
        "density_normalise": ("rho DOUBLE, vmin DOUBLE, vmax DOUBLE", "(greatest(vmin, least(vmax, log10(CASE WHEN rho > 0 THEN rho ELSE 1e-30D END))) - vmin) / (vmax - vmin)"),
        "density_normalise_linear": ("rho DOUBLE, vmin DOUBLE, vmax DOUBLE", "(greatest(vmin, least(vmax, rho)) - vmin) / (vmax - vmin)"),
        "opacity_linear": ("t DOUBLE", unit),
        "opacity_sqrt": ("t DOUBLE", f"sqrt({unit})"),
        "opacity_power": ("t DOUBLE, gamma DOUBLE", f"pow({unit}, gamma)"),
        "opacity_log": ("t DOUBLE", f"log1p(9 * {unit}) / log1p(9D)"),
        "opacity_threshold": ("t DOUBLE, threshold DOUBLE", f"CASE WHEN {unit} >= threshold THEN 1D ELSE 0D END"),
        "box_distance2": ("x DOUBLE, y DOUBLE, z DOUBLE, lx DOUBLE, ly DOUBLE, lz DOUBLE, hx DOUBLE, hy DOUBLE, hz DOUBLE", " + ".join(f"pow(greatest(l{a} - {a}, 0D, {a} - h{a}), 2)" for a in "xyz")),
    }


def uniform(seed: int) -> Column:
    """A number in [0, 1) for each row; the same for the same seed and partitions."""
    return F.rand(seed)


def register_functions(spark: SparkSession) -> list[str]:
    """Define the functions in the session; returns their names."""
    for name, (arguments, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    return list(definitions())
