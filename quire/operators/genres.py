"""Genre suggestions from several places: folders, bracketed tags, descriptions, first pages and class numbers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse, fold, text_of, words_key
from quire.operators.mining import SOURCES, ddc_genre, rank_genres
from quire.shared import Scratch

#: Folders of a path that count, from its end; words of a phrase at most; words of a snippet on either side of a hit.
FOLDERS, MOST_WORDS, AROUND = 3, 6, 6
#: First words of phrases that are looked for within the texts; of more, all words of texts meet them in a join. What stands between words.
MOST_TOLD, MARK = 4096, "\u0001"
PATHS, TEXTS = ("folder", "filename"), ("description", "content")


def labels(books: DataFrame, id_col: str) -> DataFrame:
    """(id, source, nth, text): where genres may be named. books: path, description, content (any may be null). Of a path the last three
    folders (a drive is none) and what stands in brackets in the file's name; addresses are taken out of the content."""
    parts = F.filter(F.split(text_of(F.col("path")), r"[\\/]+"), lambda x: x != "")
    folders = F.filter(F.slice(F.reverse(parts), 2, FOLDERS), lambda x: ~x.endswith(":"))
    stem = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\.[A-Za-z0-9]{2,5}$", "")
    tags = F.regexp_extract_all(stem, F.lit(r"[\[(]([^\[\]()]{2,60})[\])]"), 1)
    plain = lambda xs: F.transform(xs, lambda x: F.trim(F.regexp_replace(x, "[_.]+", " ")))
    content = F.regexp_replace(text_of(F.col("content")), r"(?i)\S+://\S+|www\.\S+", " ")
    found = {"folder": plain(folders), "filename": plain(tags), "description": F.array(text_of(F.col("description"))), "content": F.array(content)}
    told = lambda source: lambda t, i: F.struct(F.lit(source).alias("source"), i.alias("nth"), t.alias("text"))
    each = F.concat(*[F.transform(texts, told(source)) for source, texts in found.items()])
    return books.select(id_col, F.explode(each).alias("x")).select(id_col, "x.*").where("text <> ''")


def _plurals(words: Column) -> Column:
    """The words as they are, and with the last one in the plural: stories for story, thrillers for thriller."""
    last = F.element_at(words, -1)
    many = F.when(last.rlike("[^aeiou]y$") & (F.length(last) > 2), F.regexp_replace(last, "y$", "ies")).when(last.rlike("[a-rt-z]$"), F.concat(last, F.lit("s"))).otherwise(last)
    front = F.slice(words, 1, F.size(words) - 1)
    return F.array_distinct(F.array(words, F.concat(front, F.array(many))))


def phrase_table(vocabulary: DataFrame, word_col: str, phrases: Mapping[str, Iterable[tuple[str, str]]] | None = None) -> DataFrame:
    """(genre, source, first, words): what names a genre in each source. In paths and descriptions every genre is named by itself, in one number
    or more; phrases: to a source, or to ``path`` or ``text`` for both of a kind, pairs of phrase and genre. Genres outside the vocabulary
    go. & is read as and. Of a name with more than MOST_WORDS words nothing is found."""
    spark = vocabulary.sparkSession
    genres = vocabulary.select(F.trim(word_col).alias("genre"), F.lower(F.trim(word_col)).alias("g")).where("g <> ''").dropDuplicates(["g"])
    own = genres.select("genre", F.explode(F.array(*map(F.lit, (*PATHS, "description")))).alias("source"), "genre", F.col("g").alias("phrase")).select("genre", "source", "phrase")
    kinds = {"path": PATHS, "text": TEXTS}
    more = [(source, phrase, genre.lower()) for kind, pairs in (phrases or {}).items() for source in kinds.get(kind, (kind,)) for phrase, genre in pairs]
    if more:
        told = spark.createDataFrame(more, "source string, phrase string, g string").join(genres, "g")
        own = own.unionByName(told.select("genre", "source", "phrase"))
    words = F.split(words_key(F.regexp_replace("phrase", "&", " and ")), " ")
    rows = own.select("genre", "source", F.explode(_plurals(words)).alias("words")).where(F.size("words") <= MOST_WORDS).distinct()
    return rows.select("genre", "source", F.element_at("words", 1).alias("first"), "words")


def hits(texts: DataFrame, id_col: str, table: DataFrame) -> DataFrame:
    """(id, genre, source, snippet): phrases of ``table`` that stand in ``texts`` (labels), each genre of a source once, by its first hit. A hit that lies
    within a longer hit of another genre in the same text is none.

    Words of texts meet phrases by the phrase's first word; texts without any such word are left at once. A longer hit tells all shorter stretches of words within it, some
    fifteen at most, and hits of just such a stretch are taken out by an anti-join, so no text's hits are compared
    pair by pair."""
    shown = collapse(F.regexp_replace("text", "&", " and "))
    # of each shown word its plain ones, with a mark between: one pass over the whole text, whose spaces stay
    rows = texts.select(id_col, "source", "nth", shown.alias("shown")).select("*", F.regexp_replace(fold(F.col("shown")), r"[^\pL\pN ]+", MARK).alias("plain"))
    firsts = table.select("source", "first").distinct()
    told = firsts.limit(MOST_TOLD + 1).collect()
    by_source: dict[str, list[str]] = {}
    for r in told if len(told) <= MOST_TOLD else []:
        by_source.setdefault(r.source, []).append(r.first)
    met_by = lambda w: reduce(Column.__or__, [(F.col("source") == s) & w.isin(*ws) for s, ws in sorted(by_source.items())])
    if by_source:
        rows = rows.where(F.exists(F.split("plain", f"[ {MARK}]+"), met_by))
    pairs = F.filter(F.arrays_zip(F.split("shown", " ").alias("shown"), F.split("plain", " ").alias("plain")), lambda z: F.replace(z["plain"], F.lit(MARK), F.lit("")) != "")
    rows = rows.select(id_col, "source", "nth", pairs.alias("z"))
    # a shown word may hold several plain ones (science-fiction), so plain words keep the number of the shown one
    plain = F.flatten(F.transform("z", lambda z, i: F.transform(F.filter(F.split(z["plain"], MARK), lambda x: x != ""), lambda x: F.struct(x.alias("w"), i.alias("i")))))
    rows = rows.select(id_col, "source", "nth", F.transform("z", lambda z: z["shown"]).alias("shown"), plain.alias("p"))
    starts = F.transform("p", lambda x, i: F.struct(x["w"].alias("first"), i.alias("at"), x["i"].alias("i")))
    starts = F.filter(starts, lambda x: met_by(x["first"])) if by_source else starts
    places = F.transform(starts, lambda x: F.struct(x["first"].alias("first"), x["at"].alias("at"), F.transform(F.slice("p", x["at"] + 1, MOST_WORDS), lambda y: y["w"]).alias("next"), F.array_join(F.slice("shown", F.greatest(F.lit(1), x["i"] + 1 - AROUND), 2 * AROUND + 1), " ").alias("snippet")))
    met = rows.select(id_col, "source", "nth", F.explode(places).alias("x")).select(id_col, "source", "nth", "x.*")
    if not by_source:
        # phrases are few and their words frequent: dealt by their first words, all texts would meet in a task for each
        met = met.join(F.broadcast(firsts) if _few(firsts) else firsts, ["source", "first"], "left_semi")
    found = met.join(F.broadcast(table) if _few(table) else table, ["source", "first"]).where(F.slice("next", 1, F.size("words")) == F.col("words"))
    found = found.select(id_col, "source", "nth", "at", F.size("words").alias("n"), "genre", "snippet").distinct()
    found = Scratch(texts.sparkSession, "genres").write(found, "found")  # hits are few, and several steps read them
    inner = F.expr("flatten(transform(sequence(1, n - 1), m -> transform(sequence(0, n - m), s -> struct(int(at + s) as at, int(m) as n))))")
    within = found.where("n > 1").select(id_col, "source", "nth", F.col("genre").alias("other"), F.explode(inner).alias("y")).select(F.col(id_col).alias("_id"), F.col("source").alias("_s"), F.col("nth").alias("_k"), "other", F.col("y.at").alias("_at"), F.col("y.n").alias("_n")).distinct()
    same = (F.col(id_col) == F.col("_id")) & (F.col("source") == F.col("_s")) & (F.col("nth") == F.col("_k")) & (F.col("at") == F.col("_at")) & (F.col("n") == F.col("_n")) & (F.lower("genre") != F.lower("other"))
    kept = found.join(within, same, "left_anti")
    return kept.groupBy(id_col, "genre", "source").agg(F.min_by("snippet", F.struct("nth", "at")).alias("snippet"))


def _few(firsts: DataFrame, most: int = 1 << 18) -> bool:
    """Whether the first words of all phrases are few enough to be sent to every task (some megabytes)."""
    return firsts.limit(most + 1).count() <= most


def suggest_genres(books: DataFrame, id_col: str, vocabulary: DataFrame, word_col: str = "word", phrases: Mapping[str, Iterable[tuple[str, str]]] | None = None) -> DataFrame:
    """(id, genre, sources, place, found): genres for each book, best first: those named in more sources, then by the best source (folder,
    filename, description, content, ddc), then by name. found: source and snippet of each. books: path, description, content, ddc, tags
    (array; all may be null). A genre outside the vocabulary or among the tags (capitals make no difference) is none. Books that
    repeat an id are one book."""
    table = phrase_table(vocabulary, word_col, phrases)
    found = hits(labels(books, id_col), id_col, table)
    own = vocabulary.select(F.trim(word_col).alias("genre"), F.lower(F.trim(word_col)).alias("g")).dropDuplicates(["g"])
    classed = books.select(id_col, ddc_genre(F.col("ddc")).alias("d"), F.trim(text_of(F.col("ddc"))).alias("snippet")).where("d <> ''")
    classed = classed.join(F.broadcast(own) if _few(own) else own, F.lower("d") == F.col("g")).select(id_col, "genre", F.lit("ddc").alias("source"), "snippet")
    every = found.unionByName(classed.dropDuplicates([id_col, "genre"]))
    tagged = books.select(id_col, F.explode("tags").alias("t")).select(F.col(id_col).alias("_id"), F.lower(F.trim("t")).alias("_t")).distinct()
    every = every.join(tagged, (F.col(id_col) == F.col("_id")) & (F.lower("genre") == F.col("_t")), "left_anti")
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    shown = every.groupBy(id_col, "genre").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "source", "snippet"))), lambda x: F.struct(x["source"].alias("source"), x["snippet"].alias("snippet"))).alias("found"))  # five sources at most
    return rank_genres(every, id_col).join(shown, [id_col, "genre"]).select(id_col, "genre", "sources", "place", "found")
