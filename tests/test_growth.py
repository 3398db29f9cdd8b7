"""Plans whose work grows with the input alone: texts are read once, and rows with much work are dealt out over tasks."""

import pytest

from quire import queries
from quire.operators import title_pages

SF = "/root/testdata/sf0.001"


def optimized(spark, name):
    return queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["document_imprints", "content_scan_documents", "content_scan", "title_pages"])
def test_texts_are_taken_apart_once(spark, name):
    assert optimized(spark, name).count("posexplode") == 1


@pytest.mark.parametrize("name", ["content_scan", "title_pages", "image_sizes", "text_budget", "author_cleanup", "author_rules", "headers_report", "page_furniture", "toc_render", "paths_parsed"])
def test_rows_are_dealt_out(spark, name):
    assert "RepartitionByExpression" in optimized(spark, name)


def test_lines_without_a_cue_are_left_alone(spark):
    lines = ["Ünderlined text of bookish pressure", "ÜBERSETZT  von X", "Dépôt - légal", "ISBN13", "a (C) b", "unpublished bypass", "droit d’auteur"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r.t for r in df.where(df.t.rlike(title_pages.CUE_LINES)).collect()] == [lines[i] for i in (1, 2, 3, 4, 6)]


def test_pages_are_read_once_for_furniture(spark):
    assert optimized(spark, "page_furniture").count("Relation") == 1


def test_texts_are_read_once_for_genres(spark):
    """Hits are written once: what is left of the documents in the plan are class numbers and tags, without texts."""
    assert "concat_ws" not in optimized(spark, "genre_suggestions")


@pytest.mark.parametrize("most", [4096, 0])
def test_genres_of_odd_texts(spark, monkeypatch, most):
    """Marks between words, words of several words, accents, & and words of no letters; with first words in the plan and in a join."""
    from quire.operators import genres

    monkeypatch.setattr(genres, "MOST_TOLD", most, raising=False)
    texts = ["a -- Science-Fiction, \u0001 *** tale", "SCIENCE\u00a0fiction! & more", "Pöetry&Fiction ...", "fiction science", "(sciénce) ((fiction))", "", None, "* - *"]
    books = spark.createDataFrame([(i, None, t, None, None, []) for i, t in enumerate(texts)], "id int, path string, description string, content string, ddc string, tags array<string>")
    words = spark.createDataFrame([(w,) for w in ("Science Fiction", "Fiction", "Poetry", "Poetry and Fiction")], "word string")
    found = {(r.id, r.genre): r.found[0].snippet for r in genres.suggest_genres(books, "id", words).collect()}
    assert found == {
        (0, "Science Fiction"): "a Science-Fiction, tale", (1, "Science Fiction"): "SCIENCE\u00a0fiction! and more", (2, "Poetry and Fiction"): "Pöetry and Fiction", (3, "Fiction"): "fiction science", (4, "Science Fiction"): "(sciénce) ((fiction))",
    }


def test_validation_sends_no_books_to_the_driver(spark, tmp_path):
    """What rules look up grows with the books, so no rule's join is by broadcast, not even where tables are small."""
    from quire.operators import validation
    from quire.sources import archives

    spark.createDataFrame([], " ".join(archives.RAW_SCHEMA.split())).write.parquet(f"{tmp_path}/raw")
    t = archives.tables(spark.read.parquet(f"{tmp_path}/raw"))
    issues = validation.validate(t)
    for found in (issues, validation.statuses(t["books"], issues)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
