"""The data source of archives: what it reads, how it deals files out, and that writing is whole or not at all."""

import random
import zipfile

import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from test_books import book

from quire.operators import validation
from quire.sources import archives, book_source
from quire.sources.book_source import BookReader, BookWriter, balanced, scan_books, write_books


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("source")
    (folder / "a b" / "c").mkdir(parents=True)
    for k, name in enumerate(("one.epub", "a b/two.epub", "a b/c/three.epub", ".hidden.epub", "~temp.epub")):
        book(f"{folder}/{name}", title=f"Book {k}", body="x" * 1000 * k)
    (folder / "bad.epub").write_bytes(b"PK no archive")
    (folder / "empty.epub").write_bytes(b"")
    (folder / "note.txt").write_text("no book")
    return folder


def test_archives_are_rows(spark, shelf):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in scan_books(spark, str(shelf)).collect()}
    assert set(rows) == {"one.epub", "two.epub", "three.epub", "bad.epub", "empty.epub"}
    assert rows["two.epub"].path == f"file:{shelf}/a b/two.epub" and rows["two.epub"].title == "Book 1" and rows["bad.epub"].load_error and rows["empty.epub"].load_error
    assert {r.path.rsplit("/", 1)[-1] for r in scan_books(spark, f"file://{shelf}", recursive=False).collect()} == {"one.epub", "bad.epub", "empty.epub"}
    assert scan_books(spark, f"{shelf}/one.epub").first().title == "Book 0"
    # members are read by the same names
    wanted = scan_books(spark, str(shelf)).where("load_error = ''").select(F.col("path").alias("book_id"), F.lit("OEBPS/a.xhtml").alias("path"))
    assert archives.read_members(spark, str(shelf), wanted).count() == 3


def test_an_empty_folder(spark, tmp_path):
    assert scan_books(spark, str(tmp_path)).collect() == []


def test_files_are_dealt_out_by_bytes():
    r = random.Random(1)
    files = [(f"f{i}", r.choice([10, 10**6, 5 * 10**7, 3 * 10**8])) for i in range(300)]
    parts = balanced(files, 128 << 20)
    assert sorted(f for p in parts for f in p.files) == sorted(files)
    total, largest = sum(p.bytes for p in parts), max(s for _, s in files)
    assert max(p.bytes for p in parts) <= total / len(parts) + largest and len(parts) == -(-total // (128 << 20))
    assert [p.files for p in balanced([], 1)] == [[]] and len(balanced([("a", 0)] * 5, 1)) == 5


def test_little_is_read_of_a_large_archive(tmp_path, monkeypatch):
    book(f"{tmp_path}/big.epub")
    with zipfile.ZipFile(f"{tmp_path}/big.epub", "a", zipfile.ZIP_STORED) as z:
        z.writestr("OEBPS/picture.bin", random.Random(2).randbytes(20_000_000))
    counted = []

    class Counting(fs.LocalFileSystem):
        def open_input_file(self, path):
            file = super().open_input_file(path)

            class Reading:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    file.close()

                def __getattr__(self, name):
                    return getattr(file, name)

                def read(self, n=-1):
                    data = file.read(n) if n is not None and n >= 0 else file.read()
                    counted.append(len(data))
                    return data

            return Reading()

    monkeypatch.setattr(book_source, "file_system", lambda uri: (Counting(), str(tmp_path), "file:"))
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(" ".join(archives.RAW_SCHEMA.split()))
    reader = BookReader(schema, {"path": str(tmp_path)})
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    assert batch.column("title").to_pylist() == ["Dune"] and batch.column("load_error").to_pylist() == [""] and sum(counted) < 200_000


def plan_of(spark, rows):
    return spark.createDataFrame(rows, "path string, name string, opf_path string, opf binary, staged map<string,binary>")


def test_archives_are_written_once_and_whole(spark, shelf, tmp_path):
    source = f"file:{shelf}/one.epub"
    big = random.Random(3).randbytes(5_000_000)
    rows = [(source, f"sub/n{i}.epub", "OEBPS/p.opf", None, {"OEBPS/a.xhtml": b"<p>new</p>", "OEBPS/b.xhtml": None, f"x{i}.bin": big[: i * 1000]}) for i in range(20)]
    rows += [(f"file:{shelf}/bad.epub", "bad.epub", "", None, {}), (source, "../escape.epub", "", None, {}), (source, "sub/n0.epub", "", None, {}), (f"file:{shelf}/missing.epub", "missing.epub", "", None, {})]
    found = sorted((r.name, r.error.split(":")[0]) for r in write_books(plan_of(spark, rows).repartition(4), str(tmp_path)).collect())
    assert found == sorted([(f"sub/n{i}.epub", "") for i in range(20)] + [("bad.epub", "BadZipFile"), ("../escape.epub", "ValueError"), ("sub/n0.epub", "FileExistsError"), ("missing.epub", "FileNotFoundError")])
    assert sorted(p.name for p in (tmp_path / "sub").iterdir()) == sorted(f"n{i}.epub" for i in range(20)) and not list(tmp_path.glob("_staging*")) and not (tmp_path.parent / "escape.epub").exists()
    with zipfile.ZipFile(tmp_path / "sub" / "n7.epub") as z:
        assert z.testzip() is None and z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == 0 and z.read("OEBPS/a.xhtml") == b"<p>new</p>" and len(z.read("x7.bin")) == 7000 and "OEBPS/b.xhtml" not in z.namelist()
    again = write_books(plan_of(spark, rows[:1]), str(tmp_path))
    assert again.first().error.startswith("FileExistsError") and write_books(plan_of(spark, rows[:1]), str(tmp_path), overwrite=True).first().error == ""
    assert scan_books(spark, str(tmp_path)).where("load_error = ''").count() == 20


def test_a_task_tried_again_leaves_one_file(tmp_path, shelf, monkeypatch):
    """By hand: the first attempt writes and is lost, the second is the one that Spark counts; a job that is aborted leaves nothing."""
    from types import SimpleNamespace

    from quire.sources.book_source import TaskContext

    row = (f"file:{shelf}/one.epub", "x.epub", "OEBPS/p.opf", None, {})
    columns = ["path", "name", "opf_path", "opf", "staged"]
    for attempt, job in ((1, "j1"), (2, "j1")):
        monkeypatch.setattr(TaskContext, "get", lambda attempt=attempt: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: attempt))
        writer = BookWriter({"path": str(tmp_path), "job": job}, columns, False)
        message = writer.write(iter([row]))
    assert len(list(tmp_path.glob("_staging-j1/*"))) == 2 and not (tmp_path / "x.epub").exists()
    writer.commit([message])
    assert zipfile.ZipFile(tmp_path / "x.epub").testzip() is None and not list(tmp_path.glob("_staging*"))
    gone = BookWriter({"path": str(tmp_path), "job": "j2"}, columns, False)
    gone.write(iter([(row[0], "y.epub", *row[2:])]))
    gone.abort([])
    assert not list(tmp_path.glob("_staging*")) and not (tmp_path / "y.epub").exists()
    with pytest.raises(ValueError, match="staged"):
        BookWriter({"path": str(tmp_path)}, columns[:-1], False)


def test_fingerprints_are_foretold(spark, shelf, tmp_path):
    raw = scan_books(spark, str(shelf)).where("load_error = ''")
    entries = archives.tables(raw)["entries"]
    known = validation.fingerprints(entries)
    rows, edits = [], []
    for k, r in enumerate(raw.orderBy("path").collect()):
        change = [{"OEBPS/a.xhtml": b"other"}, {"OEBPS/b.xhtml": None, "new.txt": b"", "gone.txt": None}, {}][k]
        rows.append((r.path, f"{k}.epub", "OEBPS/p.opf", b"<package/>" if k == 2 else None, change))
        edits += [(r.path, n, d) for n, d in change.items()]
    told = {r.book_id: r.fingerprint for r in validation.predicted_fingerprints(known, entries, spark.createDataFrame(edits, "book_id string, name string, data binary")).collect()}
    assert {r.error for r in write_books(plan_of(spark, rows), str(tmp_path)).collect()} == {""}
    with_package = spark.read.format("quire_books").load(str(tmp_path))
    now = {r.book_id.rsplit("/", 1)[-1]: r.fingerprint for r in validation.fingerprints(archives.tables(with_package)["entries"]).collect()}
    assert {f"{k}.epub": told[row[0]] for k, row in enumerate(rows)} == now and len(set(now.values())) == 3
    before = {r.book_id: r.fingerprint for r in known.collect()}
    assert sum(told[b] != before[b] for b in before) >= 2


def test_what_a_task_tells_the_driver_does_not_grow_with_its_archives(tmp_path):
    """A task's message names a file with the list of its archives."""
    import pickle
    from unittest.mock import patch

    from quire.sources import book_source

    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    columns = ["path", "name", "opf_path", "opf", "staged"]
    sizes = []
    for n in (1, 50):
        writer = book_source.BookWriter({"path": str(tmp_path / str(n))}, columns, False)
        with patch.object(book_source.TaskContext, "get", return_value=Task):
            message = writer.write(iter([(None, f"b{k}.epub", "p.opf", b"<x/>", {}) for k in range(n)] + [(None, "b0.epub", "p.opf", b"<x/>", {}), (None, "../b", "p.opf", b"", {})]))
        sizes.append(len(pickle.dumps(message)))
        writer.commit([message, None])
        assert len(list((tmp_path / str(n)).glob("*.epub"))) == n
        lines = (tmp_path / str(n) / "_written" / f"{writer.job}.jsonl").read_text().splitlines()
        assert len(lines) == n + 2 and sum("Error" in x for x in lines) == 2
    assert max(sizes) - min(sizes) < 10
