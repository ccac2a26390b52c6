"""The jobs on copies: runs over growing input, runs that die, odd tables, settings and the command line."""

import json
import logging
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from skymill.operators.deposit import cic_map
from jobs import common, registered, text_density, zoom_archive
from skymill.sinks.images import decode_png

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def images(df):
    return rows(df.select("lang", "iy", "ix", F.round("rho", 5).alias("rho"), "shade"))


@pytest.fixture
def table(spark, tmp_path):
    """Documents in six files."""
    path = tmp_path / "all"
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(6, "doc_id").write.parquet(str(path))
    return sorted(path.glob("*.parquet"))


def grown(files, folder):
    folder.mkdir(exist_ok=True)
    for f in files:
        shutil.copy(f, folder)
    return str(folder)


def test_growing_table(spark, table, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    output = str(tmp_path / "out")
    first = images(text_density.run(spark, grown(table[:4], tmp_path / "docs"), output))
    assert first == images(text_density.run(spark, grown(table[:4], tmp_path / "docs4"), str(tmp_path / "whole4")))
    caplog.clear()
    second = images(text_density.run(spark, grown(table[4:], tmp_path / "docs"), output))
    new = spark.read.parquet(*map(str, table[4:])).count()
    assert f"read {new} new documents" in caplog.text
    assert second == images(text_density.run(spark, str(table[0].parent), str(tmp_path / "whole")))
    assert second != first
    caplog.clear()
    assert images(text_density.run(spark, str(tmp_path / "docs"), output)) == second
    assert "read 0 new documents" in caplog.text and "wrote images" not in caplog.text


def test_only_languages_with_news_are_drawn(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    source, output = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a few words", "en", "s"), (2, "ein paar Worte", "de", "s")], DOCS).write.parquet(source)
    text_density.run(spark, source, output)
    spark.createDataFrame([(3, "more words here", "en", "s")], DOCS).write.mode("append").parquet(source)
    caplog.clear()
    got = text_density.run(spark, source, output)
    assert "wrote images of 1 languages" in caplog.text
    assert {r.lang: r.upto for r in got.select("lang", "upto").distinct().collect()} == {"de": 0, "en": 1}
    assert sum(r.rho for r in got.collect()) / 64**2 == pytest.approx(3, abs=1e-6)


def test_a_run_that_dies_before_drawing(spark, table, tmp_path, monkeypatch):
    source, output = grown(table[:3], tmp_path / "docs"), str(tmp_path / "out")

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(text_density, "draw", die)
        with pytest.raises(RuntimeError, match="lost"):
            text_density.run(spark, source, output)
    assert images(text_density.run(spark, source, output)) == images(text_density.run(spark, source, str(tmp_path / "whole")))


def test_a_batch_that_dies_is_repeated(spark, table, tmp_path, monkeypatch):
    """Its cells are written, its commit is not: the next run writes the same partition again."""
    source, output = grown(table[:3], tmp_path / "docs"), str(tmp_path / "out")

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(text_density, "logged", die)
        with pytest.raises(Exception, match="lost"):
            text_density.run(spark, source, output)
    assert spark.read.schema(text_density.CELLS).parquet(f"{output}/cells").count() > 0
    assert images(text_density.run(spark, source, output)) == images(text_density.run(spark, source, str(tmp_path / "whole")))


def test_small_batches_add_up(spark, table, tmp_path):
    source = grown(table, tmp_path / "docs")
    one = images(text_density.run(spark, source, str(tmp_path / "one")))
    assert images(text_density.run(spark, source, str(tmp_path / "many"), {"files_per_batch": 2})) == one
    assert len(list((tmp_path / "many" / "cells").glob("batch=*"))) == 3


def test_odd_documents(spark, tmp_path):
    odd = [(1, None, "en", "s"), (2, "", "en", "s"), (2, "", "en", "s"), (None, "12345", None, None), (5, "x" * 3_000_000, "", "s"), (6, "wörter", "a/b=c d", "s"), (7, "漢字", "7", "s")]
    spark.createDataFrame(odd, DOCS).withColumns({c: F.lit(1) for c in ("x", "y", "rho", "batch", "upto", "t", "iy")}).write.parquet(str(tmp_path / "docs"))
    got = text_density.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"))
    mass = {r.lang: r.m for r in got.groupBy("lang").agg((F.sum("rho") / 64**2).alias("m")).collect()}
    # Every document is there as a whole, at the edges as well.
    assert mass == {lang: pytest.approx(n, abs=1e-6) for lang, n in {"en": 3, "none": 2, "a/b=c d": 1, "7": 1}.items()}
    assert {(r.iy, r.ix) for r in got.filter("lang = 'en'").collect()} == {(0, 0)} and (63, 63) in {(r.iy, r.ix) for r in got.filter("lang = 'none'").collect()}
    assert got.schema["lang"].dataType.simpleString() == "string"


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "docs"))
    for _ in range(2):
        assert text_density.run(spark, str(tmp_path / "docs"), str(tmp_path / "out")).collect() == []


def test_pictures_of_languages(spark, table, tmp_path):
    got = text_density.run(spark, grown(table[:1], tmp_path / "docs"), str(tmp_path / "out"), {"pictures": True})
    shades = {(r.iy, r.ix): r.shade for r in got.filter("lang = 'en'").collect()}
    picture = decode_png((tmp_path / "out" / "pictures" / "en.png").read_bytes())
    assert picture.shape == (64, 64, 3) and all(picture[iy, ix, 0] == v for (iy, ix), v in shades.items())


def test_archive_and_zoom(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    source, output = f"{SMALL}/lineitem.parquet", str(tmp_path / "out")
    first = rows(zoom_archive.run(spark, source, output, {"pictures": True}))
    n = spark.read.parquet(source).count()
    assert f"wrote the archive of {source}: {n} rows" in caplog.text and f"read {n} rows of {source}, 0 without" in caplog.text
    assert spark.read.parquet(f"{output}/archive").count() == n
    assert rows(zoom_archive.run(spark, source, output, {"pictures": True})) == first and {r[0] for r in first} == {0, 1, 2, 3}
    assert len(list((tmp_path / "out" / "pictures").glob("*.png"))) == 4
    for t in (0, 3):
        some = zoom_archive.run(spark, source, output, {"types": [t], "zoom": 1})
        assert 0 < some.count() < len(first)


def test_zoom_of_odd_rows(spark, tmp_path):
    odd = [(1, 0.05, 0.5, 0.95), (2, 0.98, 0.5, 0.02), (None, 0.05, 0.5, 0.95), (1, None, 0.5, 0.5), (1, float("nan"), 0.5, 0.5), (1, 0.05, 0.5, 0.95)]
    spark.createDataFrame(odd, "kind int, a double, b double, c double").withColumn("__curve", F.lit(1)).write.parquet(str(tmp_path / "odd"))
    given = {"ptype": "kind", "x": "a", "y": "b", "z": "c", "zoom": 1}
    got = zoom_archive.run(spark, str(tmp_path / "odd"), str(tmp_path / "out"), given)
    assert sum(r.rho for r in got.collect()) * 0.8**2 / 64**2 == pytest.approx(3, abs=1e-3)
    assert zoom_archive.run(spark, str(tmp_path / "odd"), str(tmp_path / "out"), {**given, "ptype": "cast(null AS int)"}).collect() == []


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_registered_runs(spark, name):
    """Equal to SQL on larger tables than the entry's test; each call writes to a folder of its own and leaves it and the settings."""
    before = dict(spark.conf.getAll)
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = registered.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    assert rows(got.select(*names)) == sorted(con.sql(registered.ORACLE_SQL[name]).select(*names).fetchall())
    assert dict(spark.conf.getAll) == before
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    folders = set(base.glob(f"{name[:4]}-*"))
    registered.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(set(base.glob(f"{name[:4]}-*")) - folders) == 1


def test_settings():
    for job in (text_density, zoom_archive):
        file = json.loads((Path(job.__file__).with_suffix(".json")).read_text())
        assert common.settings(job.DEFAULTS, file) == job.DEFAULTS
        with pytest.raises(ValueError, match="unknown setting 'widht'"):
            common.settings(job.DEFAULTS, {"widht": 3})
        with pytest.raises(ValueError, match="'width' is a int"):
            common.settings(job.DEFAULTS, {"width": "3"})
        assert common.settings(job.DEFAULTS, {"high": 1})["high"] == 1


def test_command_line(monkeypatch, tmp_path):
    """Paths and settings reach the job; the session is stopped after it, also when it fails."""
    calls = []

    class Session:
        def stop(self):
            calls.append("stop")

    class Builder:
        def appName(self, _):
            return self

        def getOrCreate(self):
            return Session()

    monkeypatch.setattr(common, "SparkSession", type("S", (), {"builder": Builder()}))
    (tmp_path / "c.json").write_text('{"width": 8, "height": 9}')

    def job(_spark, source, output, given):
        calls.append((source, output, given))
        if source == "bad":
            raise RuntimeError("no")

    common.command_line("about", job, ["--input", "in", "--output", "out", "--config", str(tmp_path / "c.json"), "--set", "width=16", 'lang="l"'])
    assert calls == [("in", "out", {"width": 16, "height": 9, "lang": "l"}), "stop"]
    with pytest.raises(RuntimeError):
        common.command_line("about", job, ["--input", "bad", "--output", "out"])
    assert calls[-1] == "stop"


def test_jobs_stand_alone():
    for file in Path(common.__file__).parent.glob("*.py"):
        assert "llm" not in file.read_text() and "corpus_pipeline" not in file.read_text()


def test_letters_are_counted_once_for_each_text(spark):
    """Filters on a particle's place do not repeat the count; letters are those of the ranges, one character each."""
    docs = spark.createDataFrame([("aÀ×÷ɏɐ Ωz9", "en"), ("", "en"), (None, None), ("!!", "")], "text string, lang string")
    particles = text_density.as_particles(docs, text_density.DEFAULTS)
    plan = cic_map(particles, 64, 64, (0.5, 0.5), 1.0, ("lang",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    got = sorted((r.lang, round((r.y - 0.5 / 64) / (1 - 1 / 64), 9)) for r in particles.collect())
    assert got == [("en", 0.0), ("en", 0.4), ("none", 0.0), ("none", 0.0)]
