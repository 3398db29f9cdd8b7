"""Catalogues on disk: whole builds, failed builds, recipes, and look-ups that read them."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from test_catalogues import FERRY, TEN, dump_text

from quire.operators import catalog
from quire.plans import catalogues
from quire.sources import catalogue
from quire.sources.catalogue import CatalogueError, drop_old_versions, not_ready, open_catalogue, write_catalogue


def files(path):
    return sorted(p.name for p in path.iterdir())


def test_versions_are_switched_whole(spark, tmp_path):
    root, one, two = str(tmp_path / "c"), spark.range(5), spark.range(9)
    assert "no catalogue is set up" in not_ready(spark, None, "x/1") and "there is no catalogue" in not_ready(spark, root, "x/1")
    first = write_catalogue(spark, root, "x/1", "dump-one", {"t": (one, "id")}, {"date": "2026-01-02", "languages": "en"})
    assert first["t"].count() == 5 and first.describe().startswith("Built from dump-one (2026-01-02) on 20") and first.describe().endswith(": 5 t; en")

    @F.udf("long")
    def dies(x):
        raise RuntimeError("a task dies")

    with pytest.raises(Exception, match="a task dies"):  # in the second table, half-way
        write_catalogue(spark, root, "x/1", "dump-two", {"t": (two, "id"), "u": (two.select(dies("id").alias("id")), "id")})
    with pytest.raises(CatalogueError, match="only 9 rows"):
        write_catalogue(spark, root, "x/1", "dump-two", {"t": (two, "id")}, least={"t": 10})
    again = open_catalogue(spark, root, "x/1")
    assert again.version == first.version and again["t"].count() == 5 and files(tmp_path / "c") == sorted([first.version, "CURRENT", ".CURRENT.crc"])
    second = write_catalogue(spark, f"file://{root}", "x/1", "dump-two", {"t": (two, "id")})
    assert open_catalogue(spark, root, "x/1").version == second.version and first["t"].count() == 5  # who opened the old one goes on
    assert drop_old_versions(spark, root, keep=2) == [] and drop_old_versions(spark, root) == [first.version] and open_catalogue(spark, root, "x/1")["t"].count() == 9


def test_a_killed_build_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    first = write_catalogue(spark, root, "x/1", "one", {"t": (spark.range(3), "id")})
    monkeypatch.setattr(catalogue.Files, "replace", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    monkeypatch.setattr(catalogue.Files, "delete", lambda *a: None)  # killed: nothing is cleared up
    with pytest.raises(KeyboardInterrupt):
        write_catalogue(spark, root, "x/1", "two", {"t": (spark.range(4), "id")})
    monkeypatch.undo()
    assert open_catalogue(spark, root, "x/1").version == first.version and len(files(tmp_path / "c")) == 4
    assert len(drop_old_versions(spark, root)) == 1 and open_catalogue(spark, root, "x/1")["t"].count() == 3


def test_other_recipes_are_refused(spark, tmp_path):
    root = str(tmp_path / "c")
    write_catalogue(spark, root, "x/1", "one", {"t": (spark.range(3), "id")})
    assert "built by x/1, this needs x/2" in not_ready(spark, root, "x/2") and "recipe x/1, not by y/1" in not_ready(spark, root, "y/1")
    with pytest.raises(CatalogueError):
        write_catalogue(spark, root, "no number", "one", {})
    for part in (tmp_path / "c").glob("version-*/t/*"):
        part.unlink()
    assert "lacks a table" in not_ready(spark, root, "x/1")


def test_a_look_up_reads_a_range_of_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    t = write_catalogue(spark, str(tmp_path / "c"), "x/1", "one", {"t": (spark.range(1000).selectExpr("lpad(id * 7919 % 1000, 4, '0') number"), "number")})["t"]
    ranges = [(r.a, r.z) for r in t.groupBy(F.input_file_name()).agg(F.min("number").alias("a"), F.max("number").alias("z")).orderBy("a").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    plan = t.where("number = '0500'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(number,0500)" in plan


def test_catalogue_b_from_its_dump(spark, tmp_path):
    (tmp_path / "backup-2025-12-27.sql").write_text(dump_text())
    root = str(tmp_path / "b")
    with pytest.raises(ValueError, match="fewer than"):
        catalogues.build_b(spark, str(tmp_path / "backup-2025-12-27.sql"), root)
    assert "there is no catalogue" in not_ready(spark, root, catalogues.WORKS)
    catalogues.build_b(spark, str(tmp_path / "backup-2025-12-27.sql"), root, least=2)
    found = catalogues.opened_b(spark, root)
    assert found.info["date"] == "2025-12-27" and found.info["rows.works"] == "5" and "5 works" in found.describe()
    probes = spark.createDataFrame([(1, "The Ferr", "Salo, Aino", 1952), (2, "Qua", "Rautio", 1970)], "probe_id int, title string, authors string, year int")
    assert {(r.probe_id, r.id) for r in catalogues.by_title(probes, found).collect()} == {(1, 900), (2, 910)}
    asked = found["numbers"].where(F.col("number").isin(FERRY, TEN)).collect()
    assert {r.id for r in asked} == {71, 76}
    with pytest.raises(CatalogueError, match="not by editions"):
        catalogues.opened_a(spark, root)


def test_catalogue_a_from_its_dump(spark, tmp_path):
    editions = [{"title": f"Book {i}", "isbn_13": ["978044117271" + "9"] if i < 2 else ["9783161484100"], "languages": ["/languages/eng"], "authors": ["/authors/A1"], "publish_date": "1998" if i else ""} for i in range(3)]
    with gzip.open(tmp_path / "dump_2026-08-31.txt.gz", "wt") as f:
        f.write("\n".join([f"/type/edition\t/books/E{i}\t1\t2020\t{json.dumps(e)}" for i, e in enumerate(editions)] + ['/type/author\t/authors/A1\t1\t2020\t{"name": "Frank Herbert"}', "/type/edition\t/books/E9\t1\t2020\t{}"]))
    built = catalogues.build_a(spark, str(tmp_path / "dump_2026-08-31.txt.gz"), str(tmp_path / "a"), ["en"])
    assert built.info["left_out.no_isbn"] == "1" and built.info["date"] == "2026-08-31" and built["authors"].count() == 1
    asked = spark.createDataFrame([(1, "0-441-17271-7"), (2, "978-3-16-148410-0"), (3, "x")], "probe_id int, isbn string")
    want = catalog.lookup_by_isbn(asked, built["editions"], built["extra_isbns"]).collect()
    assert sorted(map(tuple, catalogues.by_number(asked, catalogues.opened_a(spark, str(tmp_path / "a"))).collect())) == sorted(map(tuple, want)) and len(want) == 3
