"""The jobs as registered queries: each runs its job twice into one new folder and returns what lies there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import text_density, zoom_archive
from jobs.common import new_folder
from skymill.plans.oracles import LI, _cic, _image_of, _levels


def job1_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job1")
    text_density.run(spark, f"{sf_dir}/documents.parquet", output)
    return text_density.run(spark, f"{sf_dir}/documents.parquet", output).select("lang", "iy", "ix", "rho", "shade")


def job2_zoom_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job2")
    zoom_archive.run(spark, f"{sf_dir}/lineitem.parquet", output)
    return zoom_archive.run(spark, f"{sf_dir}/lineitem.parquet", output)


#: Settings of the registered runs, written once more for SQL.
CENTRE, LBOX, FACTOR, FRAMES = ("5e-2", "5e-1", "95e-2"), "8e-1", "5e-1", 4


def _shade(join: str) -> str:
    t = "(greatest(vmin, least(vmax, log10(rho))) - vmin) / (vmax - vmin)"
    return f"CAST(floor({t} * 255 + 5e-1) AS INTEGER) AS shade {join}"


def _text_density() -> str:
    return f"""WITH d AS (SELECT coalesce(nullif(lang, ''), 'none') AS lang, coalesce(text, '') AS t FROM documents),
q AS (SELECT lang, least(1e0, log10(length(t) + 1) / 6e0) AS x, CASE WHEN t = '' THEN 0e0 ELSE length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) / CAST(length(t) AS DOUBLE) END AS y FROM d),
p AS (SELECT lang, x * 63 / 64e0 + 1 / 128e0 AS x, y * 63 / 64e0 + 1 / 128e0 AS y FROM q),
{_cic('img', 'p', 64, keys='lang')},
f AS (SELECT * FROM (SELECT lang, CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, round(rho, 6) AS rho FROM img) WHERE rho > 0), {_levels('f', 'lang')}
SELECT lang, iy, ix, rho, {_shade('FROM f JOIN lv USING (lang)')}"""


def _zoom_archive() -> str:
    inside = " AND ".join(f"abs(2 * ({_image_of(f'({a} - {c})')}) / {LBOX}) < 1" for a, c in zip("xyz", CENTRE, strict=True))
    # The image is centred on 0.5 in the macro's terms, so positions are given from there.
    moved = ", ".join(f"({_image_of(f'({a} - {c})')}) + 5e-1 AS {a}" for a, c in zip("xy", CENTRE, strict=False))
    return f"""WITH {LI}, s AS (SELECT {moved} FROM particles_li WHERE {inside}),
z AS (SELECT CAST(range AS INTEGER) AS frame, {LBOX} * pow({FACTOR}, range) AS lbox, x, y FROM s, range({FRAMES})), {_cic('img', 'z', 64, 'lbox', 'frame')},
f AS (SELECT * FROM (SELECT frame, CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, round(rho, 4) AS rho FROM img) WHERE rho > 0), f0 AS (SELECT * FROM f WHERE frame = 0), {_levels('f0', 'frame')}
SELECT f.frame, iy, ix, rho, {_shade('FROM f, lv')}"""


QUERIES = {f.__name__: f for f in (job1_text_density, job2_zoom_archive)}
ORACLE_SQL = {"job1_text_density": _text_density(), "job2_zoom_archive": _zoom_archive()}
