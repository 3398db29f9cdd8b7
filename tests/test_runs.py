"""Runs that are cut off, and conversions whose outputs do not pass."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quire.plans.conversions import archive_problem, settle_conversions
from quire.plans.recipe import Recipe, text_step
from quire.plans.runs import RunJournal, TableStore, carry_out, resume, run_recipe


class Dies(Exception):
    pass


def upper():
    return Recipe([text_step("upper", "title", F.upper)])


def shelf(spark):
    return spark.createDataFrame([(i, f"title {i}", "x") for i in range(6)], "book_id int, title string, note string")


def titles(store):
    return {r.book_id: r.title for r in store.books().collect()}


def test_a_run_and_its_journal(spark, tmp_path):
    store, journal = TableStore(spark, f"{tmp_path}/books"), RunJournal(spark, f"{tmp_path}/runs")
    store.put(shelf(spark))
    assert journal.runs() == {}
    run, outcomes = run_recipe(upper(), store.books().withColumn("locked", F.col("book_id") == 5), journal, store)
    assert {(r.book_id, r.field, r.outcome) for r in outcomes.collect()} == {(str(i), "title", "applied") for i in range(5)}
    assert titles(store) == {i: f"TITLE {i}" if i < 5 else "title 5" for i in range(6)} and journal.runs() == {run: "finished"} and resume(journal, store) == {}
    assert {(r.old, r.new, r.step) for r in journal.changes(run).where("book_id = '2'").collect()} == {("title 2", "TITLE 2", "upper")}


@pytest.mark.parametrize("half", [False, True])
def test_a_run_that_dies_between_begin_and_finish(spark, tmp_path, half):
    """Before anything is changed, or with half of it changed; meanwhile someone else changes a title."""

    class Mortal(TableStore):
        def apply(self, changes):
            if half:
                super().apply(changes.where("cast(book_id as int) % 2 = 0"))
            raise Dies()

    journal, store = RunJournal(spark, f"{tmp_path}/runs"), TableStore(spark, f"{tmp_path}/books")
    store.put(shelf(spark))
    with pytest.raises(Dies):
        run_recipe(upper(), store.books().withColumn("locked", F.lit(False)), journal, Mortal(spark, store.root), run="r1")
    assert journal.runs() == {"r1": "open"}
    store.put(store.books().withColumn("title", F.when(F.col("book_id") == 3, "other").otherwise(F.col("title"))))
    version = len(list((tmp_path / "books").glob("version-*")))
    (outcomes,) = resume(journal, store).values()
    want = {str(i): "conflict" if i == 3 else "done before" if half and i % 2 == 0 else "applied" for i in range(6)}
    assert {r.book_id: r.outcome for r in outcomes.collect()} == want and journal.runs() == {"r1": "finished"}
    assert titles(store) == {i: "other" if i == 3 else f"TITLE {i}" for i in range(6)}
    # once more, by hand: nothing changes a second time
    carry_out(journal, "r1", store)
    assert len(list((tmp_path / "books").glob("version-*"))) == version + 1 and titles(store)[3] == "other"


def test_a_run_that_dies_while_it_begins(spark, tmp_path):
    (tmp_path / "runs" / "run-r9" / "begin").mkdir(parents=True)
    journal = RunJournal(spark, f"{tmp_path}/runs")
    assert journal.runs() == {"r9": "void"} and resume(journal, TableStore(spark, f"{tmp_path}/books")) == {}


def make(path, container=True, damage=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("mimetype", "application/epub+zip")
        if container:
            z.writestr("META-INF/container.xml", "<x/>")
        z.writestr("a.txt", "some text " * 500)
    if damage:
        data = bytearray(path.read_bytes())
        data[data.find(b"some text") + 50] ^= 1
        path.write_bytes(data)


def test_sources_move_only_when_their_output_is_whole(spark, tmp_path):
    for name in "good damaged other empty missing recent good2".split():
        (tmp_path / f"{name}.mobi").write_text("source")
    for name in ("good", "recent", "good2"):
        make(tmp_path / f"{name}.epub")
    make(tmp_path / "damaged.epub", damage=True)
    make(tmp_path / "other.epub", container=False)
    (tmp_path / "empty.epub").write_bytes(b"")
    assert archive_problem(str(tmp_path / "good.epub")) == "" and archive_problem(f"file:{tmp_path}/damaged.epub") == "it can't be read: BadZipFile"
    rows = [(f"{tmp_path}/{n}.mobi", f"{tmp_path}/{n}.epub", "2026-01-01 09:59:00" if n == "recent" else "2020-01-01 00:00:00") for n in "good damaged other empty missing recent good2".split()]
    done = spark.createDataFrame(rows, "source string, result string, modified string").withColumn("modified", F.to_timestamp("modified"))
    (tmp_path / "converted 2026-01-01").mkdir()
    (tmp_path / "converted 2026-01-01" / "good2.mobi").write_text("there before")
    taken = spark.createDataFrame([(f"{tmp_path}/converted 2026-01-01/good2.mobi",)], "path string")
    settled = lambda **more: {r.source.rsplit("/", 1)[-1]: r for r in settle_conversions(done, "quarantine", F.lit("2026-01-01"), F.to_timestamp(F.lit("2026-01-01 10:00:00")), taken, **more).collect()}
    before = sorted(p.name for p in tmp_path.rglob("*.mobi"))
    plan = settled(dry_run=True)
    assert sorted(p.name for p in tmp_path.rglob("*.mobi")) == before
    found = settled()
    want = {"good.mobi": "quarantined", "damaged.mobi": "failed", "other.mobi": "failed", "empty.mobi": "failed", "missing.mobi": "failed", "recent.mobi": "kept", "good2.mobi": "quarantined"}
    assert {n: r.action for n, r in found.items()} == want == {n: r.action for n, r in plan.items()}
    assert found["good2.mobi"].destination.endswith("/converted 2026-01-01/good2 (2).mobi") and "container" in found["other.mobi"].note and found["empty.mobi"].note == "the file is empty"
    assert {n for n in want if (tmp_path / n).exists()} == {n for n, a in want.items() if a in ("failed", "kept")}
    assert (tmp_path / "converted 2026-01-01" / "good.mobi").read_text() == "source" and (tmp_path / "converted 2026-01-01" / "good2.mobi").read_text() == "there before"
    with pytest.raises(ValueError):
        settled_policy = settle_conversions(done, "shred", F.lit(""), F.current_timestamp(), taken)  # noqa: F841


def test_patterns_fall_back_and_are_pinned(spark):
    from quire.plans.recipe import parse_step

    current = {"pattern": "%title% - %series%"}
    step = parse_step("name", "stem", "title", lambda: current["pattern"])
    books = spark.createDataFrame([(1, "Road - Saga", ""), (2, "nothing", "")], "book_id int, stem string, title string").withColumn("locked", F.lit(False))
    read = lambda recipe: {r.book_id: r.value for r in recipe.results(books).collect()}
    recipe = Recipe([step])
    assert step.option("pattern") == ("%title% - %series%", "fallback") and read(recipe) == {1: "Road"}
    pinned = recipe.pinned()
    stored = Recipe.from_json(pinned.to_json(), {"name": step})
    current["pattern"] = "%series% - %title%"
    assert read(recipe) == {1: "Saga"} and read(pinned) == read(stored) == {1: "Road"} and stored.steps[0].option("pattern")[1] == "recipe"
    current["pattern"] = ""
    assert step.option("pattern") == ("", "nothing") and read(recipe) == {} and read(recipe.pinned()) == {} and read(pinned) == {1: "Road"}


def test_covers_are_staged(spark):
    from quire.operators.validation import staged_covers

    jpeg, png = b"\xff\xd8\xff\xe0new", b"\x89PNG\r\n\x1a\nnew"
    covers = spark.createDataFrame([(1, jpeg), (2, png), (3, png), (4, b"text"), (5, jpeg), (6, None)], "book_id int, data binary")
    manifest = spark.createDataFrame([(1, 0, "c", "OPS/pic.jpg", "image/jpeg", "cover-image"), (2, 0, "c", "OPS/pic.jpg", "image/jpeg", "cover-image"), (3, 0, "cover", "OPS/cover.png", "image/jpeg", ""), (5, 0, "x", "cover.jpg", "text/html", "")], "book_id int, place int, item_id string, path string, media_type string, properties string")
    entries = spark.createDataFrame([(1, "OPS/pic.jpg"), (2, "OPS/pic.jpg"), (3, "OPS/cover.png"), (3, "OPS/Cover-2.PNG"), (5, "cover.jpg")], "book_id int, name string")
    meta = spark.createDataFrame([(3, "cover")], "book_id int, item_id string")
    packages = spark.createDataFrame([(i, "p.opf" if i == 5 else "OPS/p.opf") for i in range(1, 7)], "book_id int, opf_path string")
    found = {r.book_id: (r.how, r.path, r.item_id, r.media_type) for r in staged_covers(covers, manifest, meta, entries, packages).collect()}
    assert found == {
        1: ("replace", "OPS/pic.jpg", "c", "image/jpeg"), 2: ("add", "OPS/cover.png", "cover", "image/png"), 3: ("add", "OPS/cover-3.png", "cover-3", "image/png"),
        4: ("refuse", None, None, ""), 5: ("add", "cover-2.jpg", "cover-2", "image/jpeg"), 6: ("refuse", None, None, ""),
    }
