"""Facts on title pages and in back matter: cue words from a table, met by a join, and small readers of the words around them."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import NUMBER_WORDS, volume_number
from quire.functions.identifiers import best_isbn13
from quire.functions.text import MARKED, PLAIN_, fold, text_of

# The cues of each role, in English, Norwegian, German, French and Italian.
CUES = {
    "isbn": ("isbn", "isbn-10", "isbn-13"),
    "ddc": ("dewey decimal classification", "dewey decimal", "ddc"),
    "copyright": ("copyright", "opphavsrett", "urheberrecht", "droit d'auteur", "diritto d'autore"),
    "first_published": ("first published in", "first published", "first edition", "første utgave", "førsteutgave", "erstausgabe", "erstmals erschienen", "première édition", "première publication", "prima edizione", "prima pubblicazione"),
    "sign": ("©", "(c)"),
    "deposit": ("legal deposit", "dépôt légal", "deposito legale"),
    "published_by": ("published by", "utgitt av", "utgitt på", "erschienen bei", "erschienen im", "verlegt bei", "publié par", "pubblicato da", "edito da", "casa editrice"),
    "publisher_label": ("publisher", "publishers", "utgiver", "forlag", "verlag", "éditeur", "editore", "editrice"),
    "publisher_word": ("press", "publishing", "publications", "publishers", "books", "forlag", "forlaget", "verlag", "éditions", "editore", "editrice", "edizioni", "libri"),
    "edition": ("edition", "utgave", "opplag", "auflage", "ausgabe", "édition", "edizione"),
    "volume": ("book", "bok", "volume", "volum", "vol.", "bind", "band", "tome", "libro", "livre", "buch", "#", "no.", "nr."),
    "translator": ("translated by", "translation by", "translator", "translators", "oversatt av", "oversetter", "übersetzt von", "übersetzer", "aus dem englischen von", "traduit par", "traduit de l'anglais par", "traducteur", "traduzione di", "tradotto da"),
    "editor": ("edited by", "editor", "editors", "redigert av", "redaktør", "herausgegeben von", "herausgeber", "hrsg. von", "sous la direction de", "édité par", "a cura di", "curato da"),
    "illustrator": ("illustrated by", "illustration by", "illustrations by", "illustrator", "illustrators", "illustrert av", "illustriert von", "illustrationen von", "illustré par", "illustrations de", "illustrazioni di", "illustrato da"),
}
# Confidences.
SURE = {
    "isbn": 1.0, "ddc": 0.8, "copyright": 0.65, "first_published": 0.75, "sign": 0.55, "deposit": 0.5, "holder_by": 0.6, "holder_before": 0.5, "holder_after": 0.45, "published_by": 0.7, "publisher_label": 0.7, "publisher_word": 0.4, "edition": 0.6,
    "series_brackets": 0.8, "series_of": 0.75, "series_number": 0.6, "series_comma": 0.55, "bare_volume": 0.4, "translator": 0.6, "editor": 0.6, "illustrator": 0.6,
}
BACK_FACTOR = 0.9
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth forste andre tredje erste zweite dritte premiere deuxieme troisieme prima seconda terza".split()
REVISED = "revised updated expanded new paperback ebook".split()
SERIES_NOUNS = "Series|Trilogy|Saga|Serie|Serien|Reihe|Série|Cycle|Quartet|Duology"
BY, OF = ("by", "av", "von", "par", "di"), ("of", "in", "av", "i", "der", "von", "de", "du", "di", "della", "del")
#: Words that may stand in small letters within a name, and capitalised words that end one, beside those that begin a cue.
PARTICLES = "van|von|de|der|den|di|da|del|della|le|la|af|zu|of|the|and|og|und|et|du|des|die|das"
ENDS = "all alle tous tutti tutte rights rechte droits printed cover text chapter kapittel kapitel chapitre capitolo part page section figure table isbn".split()
#: Words of a line that a reader sees before and behind a cue.
BEFORE, AFTER = 12, 18
ROLES = ("translator", "editor", "illustrator")
FIELDS = ("isbn", "ddc", "year", "holder", "publisher", "edition", "series", "series_index", *ROLES)


def spellings(phrase: str) -> set[str]:
    """The plain forms of a phrase: without marks, and with two letters for those that are often so written (ae, oe, ue, aa)."""
    ways = {"ä": ("a", "ae"), "ö": ("o", "oe"), "ü": ("u", "ue"), "å": ("a", "aa"), "ø": ("o", "oe"), "æ": ("ae",), "ß": ("ss",)}
    import unicodedata

    letters = [ways.get(c) or (unicodedata.normalize("NFD", c)[0],) for c in phrase.lower()]
    return {"".join(x) for x in product(*letters)}


def _plain(word: Column) -> Column:
    """A word without marks, and without what stands around it; the signs © and # are words."""
    return F.when(F.lower(word) == "(c)", "©").otherwise(F.regexp_replace(F.translate(fold(word), "ø’", "o'"), r"^[^\pL\pN©#]+|[^\pL\pN©#]+$", ""))


def cue_table(spark: SparkSession) -> DataFrame:
    """(first, words, n, role): every spelling of every cue. The table is the program's, some two hundred rows."""
    rows = set()
    for role, phrases in CUES.items():
        for phrase in phrases:
            for form in spellings(phrase.replace("(c)", "©")):
                words = tuple(w.strip(".") for w in form.split(" "))
                rows.add((words[0], words, len(words), role))
    return spark.createDataFrame(sorted(rows), "first string, words array<string>, n int, role string")


def first_words(*roles: str) -> list[str]:
    return sorted({w.replace("(c)", "©").split(" ")[0].strip(".") for role in roles for p in CUES[role] for w in spellings(p)})


FIRST_WORDS = first_words(*CUES)
#: Longer words that begin a cue end a name, but not those of a publisher's name, by which a holder is told to be one.
CUTS = [*ENDS, *(w for w in FIRST_WORDS if w.isalpha() and len(w) > 4 and w not in first_words("publisher_word"))]


def _cue_lines() -> str:
    """A regex that finds something in each line with a cue, as it is written: a letter stands for all that are folded to it, and anything
    but letters and digits may stand between two words. It may also fit lines without one."""
    signs = "©#"
    written: dict[str, str] = {}
    for c in map(chr, (*range(0x41, 0x2C00), *range(0xA720, 0xAB70))):
        small = c.lower().translate(str.maketrans(MARKED, PLAIN_))
        if small[0].isalpha():
            written[small[0]] = written.get(small[0], "") + c
    pairs = {"ae": "æÆ", "oe": "œŒ", "ss": "ßẞ"}
    letter = lambda c: f"[{written[c]}]" if c in written else {"'": "['’]"}.get(c, re.escape(c))
    word = lambda w: "".join(f"(?:{letter(x[0])}{letter(x[1])}|[{pairs[x]}])" if x in pairs else letter(x) for x in re.findall("|".join(pairs) + "|.", w))
    firsts: dict[str, list[str]] = {}
    for form in sorted({f.replace(".", "") for phrases in CUES.values() for p in phrases for f in spellings(p)}):
        if form[0].isalpha() and not form.startswith("isbn"):
            firsts.setdefault(form[0], []).append(r"[^\pL\pN]+".join(map(word, form.split(" "))))
    begins = lambda c: "".join(pairs[x] for x in pairs if x[0] == c)
    each = "|".join(f"(?=[{written[c]}{begins(c)}])(?:{'|'.join(forms)})" for c, forms in firsts.items())
    return rf"[{signs}]|\([cC]\)|(?<![\pL\pN])(?:{word('isbn')}|(?:{each})(?![\pL\pN]))"


CUE_LINES = _cue_lines()


def cue_hits(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Every place of a cue: keys, line, at (word of the line), role, n, before and after (the words around it, some twelve and
    eighteen), and ``cue`` as written. Cues don't go over a line's end. Only lines that may have one are taken apart."""
    lines = texts.select(*keys, F.posexplode(F.split(text_of(F.col(text_col)), r"[\n\r]+")).alias("line", "t")).where(F.col("t").rlike(CUE_LINES))
    apart = F.regexp_replace(F.regexp_replace("t", r"(?i)\b(isbn(?:-1[03])?)(?=[:#\d])", "$1 "), "#", " # ")
    lines = lines.select(*keys, "line", F.filter(F.split(apart, r"\s+"), lambda w: w != "").alias("w")).withColumn("p", F.transform("w", _plain))
    begins = F.array_compact(F.transform("p", lambda x, i: F.when(x.isin(*FIRST_WORDS), i + 1)))
    around = F.transform(begins, lambda i: F.struct(
        i.alias("at"), F.slice("w", F.greatest(F.lit(1), i - BEFORE), F.least(F.lit(BEFORE), i - 1)).alias("before"), F.slice("p", F.greatest(F.lit(1), i - BEFORE), F.least(F.lit(BEFORE), i - 1)).alias("plain_before"),
        F.slice("w", i, AFTER).alias("here"), F.slice("p", i, AFTER).alias("plain"),
    ))
    found = lines.select(*keys, "line", F.explode(around).alias("x")).select(*keys, "line", "x.*")
    found = found.join(F.broadcast(cue_table(texts.sparkSession)), F.element_at("plain", 1) == F.col("first")).where("slice(plain, 1, n) = words")
    rest = lambda c: F.expr(f"slice({c}, n + 1, {AFTER})")
    return found.select(*keys, "line", "at", "role", "n", "before", "plain_before", rest("here").alias("after"), rest("plain").alias("plain_after"), F.expr("slice(here, 1, n)").alias("cue"), F.expr("slice(plain, 1, n)").alias("plain_cue"))


def _name(words: Column) -> Column:
    """The name that a text begins with: capitalised words, initials and particles, up to six words. It ends at a mark, and before a
    word that ends one."""
    clean = F.regexp_replace(F.array_join(words, " "), r"^[\s:–—\-]+", "")
    clean = F.when(clean.rlike(r"^\p{Lu}"), clean)  # nothing else begins a name
    cut = F.regexp_extract(clean, rf"(?i)^(.*?)(?:\b(?:{'|'.join(CUTS)})\b.*)?$", 1)
    part = r"(?:\p{Lu}\.|\p{Lu}[\p{L}'’\-]+|\p{Lu}(?![\p{L}.]))"
    return F.coalesce(F.trim(F.regexp_extract(cut, rf"^({part}(?: (?:(?:{PARTICLES}) )*{part}){{0,5}})", 1)), F.lit(""))


def _year(words: Column, within: int) -> Column:
    return F.regexp_extract(F.array_join(words, " "), rf"^[^0-9]{{0,{within}}}((?:1[5-9]|20)[0-9]{{2}})(?![0-9])", 1)


def _readings(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, at, field, value, number, confidence, turn): what each cue's reader finds; a lower turn comes first."""
    role, after, plain_after = F.col("role"), F.col("after"), F.col("plain_after")
    joined = F.array_join(after, " ")
    number = lambda text: F.coalesce(volume_number(text).cast("string"), F.lit(""))
    one = lambda field, value, sure, turn=0, extra=None: F.struct(F.lit(field).alias("field"), F.coalesce(value, F.lit("")).alias("value"), (F.lit("") if extra is None else extra).alias("number"), F.lit(SURE[sure]).alias("confidence"), F.lit(turn).alias("turn"))
    is_a = lambda *names: role.isin(*names)

    # who holds the rights: a year and a name in either order; each step is a column, so that it is worked out once
    rights, by = is_a("copyright", "sign"), rf"^(?i:{'|'.join(BY)})\s+(.*)$"
    hits = hits.withColumn("past_signs", F.when(rights, F.regexp_replace(joined, r"^(?:[^\p{L}\p{N}(]*(?:©|\([cC]\))?\s*)*", "")))
    hits = hits.withColumns({"dated": F.regexp_extract("past_signs", r"^(?:1[5-9]|20)[0-9]{2}\s*,?\s*(.*)$", 1), "undated": F.when(F.col("past_signs").rlike(by), F.regexp_extract("past_signs", by, 1)).otherwise(F.col("past_signs"))})
    hits = hits.withColumn("first_name", _name(F.split("undated", " ")))
    past_signs, dated, first_name = F.col("past_signs"), F.col("dated"), F.col("first_name")
    by_name, after_name = _name(F.split(F.regexp_extract(dated, by, 1), " ")), _name(F.split(dated, " "))
    before_name = F.when(F.substring("undated", F.length(first_name) + 1, 12).rlike(r"^\s*,?\s*(?:1[5-9]|20)[0-9]{2}"), first_name).otherwise("")

    # who published: behind a label, or in front of a publisher's word
    house = F.trim(F.regexp_extract(F.regexp_replace(joined, r"^[\s:–—\-]+", ""), r"^(\p{Lu}[\p{L}\p{N}_&,'’ \-]{2,60}?)\s*(?:[.;]|,? (?:1[5-9]|20)[0-9]{2}|$)", 1))
    house = F.regexp_replace(house, "[., ]+$", "")
    marked = F.element_at("cue", -1).rlike(r"[:–—\-]$") | F.get(after, F.lit(0)).rlike(r"^[:–—\-]")
    capitals = F.regexp_extract(F.array_join("before", " "), rf"((?:\p{{Lu}}[\p{{L}}'’&\-]* (?:(?:{PARTICLES}) )?){{0,5}}\p{{Lu}}[\p{{L}}'’&\-]*)$", 1)
    named = F.when((capitals != "") & F.element_at("cue", 1).rlike(r"^\p{Lu}"), F.concat_ws(" ", capitals, F.regexp_replace(F.element_at("cue", 1), r"\W+$", ""))).otherwise("")

    # an edition: an ordinal and what revises it, in front of the word
    ordinal = lambda w: w.isin(*ORDINALS) | w.rlike(r"^[0-9]{1,2}(?:st|nd|rd|th|e|)$")
    back = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.size("plain_before") >= k) & ordinal(F.coalesce(F.try_element_at("plain_before", -k), F.lit(""))) & F.forall(F.slice("plain_before", -k, k), lambda w: w.isin(*REVISED) | ordinal(w)))
    which = F.get(back, F.lit(0))
    edition = F.when(which.isNotNull(), F.concat_ws(" ", F.array_join(F.slice("before", -which, which), " "), F.regexp_replace(F.element_at("cue", 1), r"\W+$", "")))

    # a volume: its number behind it, without which it tells nothing, the series around it
    sign, volume = F.element_at("plain_cue", 1), is_a("volume")
    digits = F.when(F.get(after, F.lit(0)).rlike(r"^[^\p{L}\p{N}]") & (sign != "#"), "").otherwise(number(F.get(plain_after, F.lit(0))))
    hits = hits.withColumn("digits", F.when(volume, digits)).where("role <> 'volume' or digits <> ''")
    digits = F.col("digits")
    series = lambda text: F.regexp_replace(F.trim(text), rf" (?:{SERIES_NOUNS})$", "")
    word = r"\p{Lu}[\p{L}\p{N}'’&\-]*"
    run = rf"({word}(?: (?:(?:{PARTICLES}) )*{word}){{0,6}})"
    hits = hits.withColumn("lead", F.when(volume, F.regexp_replace(F.array_join("before", " "), r"(?i)[\s,:;–—\-]+(?:no|nr|book|vol)?\.?$", "")))
    hits = hits.withColumns({
        "bracket": F.when(volume & F.get(after, F.lit(0)).rlike(r"\)$"), series(F.regexp_extract("lead", rf"\(\s*{run}$", 1))),
        "of": F.when(volume & F.get(plain_after, F.lit(1)).isin(*OF), series(F.regexp_extract(F.array_join(F.slice(after, 3, AFTER), " "), rf"^((?:[Tt]he )?{word}(?: (?:(?:{PARTICLES}) )*{word}){{0,6}})", 1))),
        "run": F.when(volume, series(F.regexp_extract("lead", rf"{run}$", 1))),
    })
    bracket, of, hashed = F.col("bracket"), F.col("of"), F.col("run")
    comma = F.when(F.array_join("before", " ").rlike(r"[,:;–—\-]$"), hashed)
    within = lambda ok, name, sure, turn: F.when(ok & (F.length(name) >= 2), one("series", name, sure, turn, digits))
    words_only = is_a("volume") & ~sign.isin("#", "no", "nr")
    readings = [
        F.when(is_a("isbn"), one("isbn", best_isbn13(F.regexp_extract(joined, r"^[^0-9\p{L}]*([0-9][0-9\- ]{8,18}[0-9Xx])", 1)), "isbn")),
        F.when(is_a("ddc"), one("ddc", F.regexp_extract(joined, r"^[\s:#]*([0-9]{3}(?:\.[0-9]+)?)", 1), "ddc")),
        F.when(is_a("copyright"), one("year", F.regexp_extract(F.regexp_replace(past_signs, by, "$1"), r"^((?:1[5-9]|20)[0-9]{2})(?![0-9])", 1), "copyright", 0)),
        F.when(is_a("first_published"), one("year", _year(after, 25), "first_published", 1)),
        F.when(is_a("sign"), one("year", _year(after, 60), "sign", 2)),
        F.when(is_a("deposit"), one("year", _year(after, 25), "deposit", 3)),
        *[F.when(is_a("copyright", "sign"), one("holder", value, sure, turn)) for turn, (value, sure) in enumerate(((by_name, "holder_by"), (before_name, "holder_before"), (after_name, "holder_after")))],
        F.when(is_a("published_by"), one("publisher", house, "published_by", 0)),
        F.when(is_a("publisher_label") & marked, one("publisher", house, "publisher_label", 1)),
        F.when(is_a("publisher_word"), one("publisher", named, "publisher_word", 2)),
        F.when(is_a("edition"), one("edition", edition, "edition")),
        within(is_a("volume"), bracket, "series_brackets", 0), within(words_only, of, "series_of", 1), within(words_only, comma, "series_comma", 2), within(is_a("volume") & (sign == "#"), hashed, "series_number", 3),
        F.when(words_only & ~sign.isin("book", "bok", "buch"), one("bare", digits, "bare_volume")),
        *[F.when(is_a(r), one(r, _name(after), r)) for r in ROLES],
    ]
    found = hits.select(*keys, "line", "at", F.explode(F.array_compact(F.array(*readings))).alias("r")).select(*keys, "line", "at", "r.*")
    houses = "|".join(w.strip(".") for p in CUES["publisher_word"] for w in spellings(p) | {p})
    return found.where((F.col("value") != "") & ~((F.col("field") == "holder") & F.col("value").rlike(rf"(?i)\b(?:{houses})\b")))


def _facts(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, facts): what each text tells, as an array of struct(field, value, confidence), each field once. One grouping has the best reading of
    every field, so that texts are read once and a text's readings are merged where they are found."""
    found = _readings(cue_hits(texts, keys, text_col), keys)
    reading, turn = F.struct("value", "number", "confidence"), F.struct("turn", "line", "at")
    fields = [f for f in FIELDS if f != "series_index"]
    best = found.groupBy(*keys).agg(*[F.min_by(reading, F.when(F.col("field") == f, turn)).alias(f"b_{f}") for f in (*fields, "bare")])
    fact = lambda field, b, value: F.when(b.isNotNull(), F.struct(F.lit(field).alias("field"), value.alias("value"), b["confidence"].alias("confidence")))
    series, bare = F.col("b_series"), F.col("b_bare")
    index = F.coalesce(fact("series_index", series, series["number"]), fact("series_index", bare, bare["value"]))
    return best.select(*keys, F.array_compact(F.array(*[fact(f, F.col(f"b_{f}"), F.col(f"b_{f}")["value"]) for f in fields], index)).alias("facts"))


def scan_texts(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, field, value, confidence): what a text tells, each field once: isbn (the first valid one), ddc, year, holder (no
    publisher), publisher, edition, series, series_index and three roles. The reading of the first turn counts, then the first
    place. A series brings its number; a bare volume number stands alone only without one. Null and empty texts tell nothing."""
    return _facts(texts, keys, text_col).select(*keys, F.explode("facts").alias("f")).select(*keys, "f.*")


def scan_books(texts: DataFrame, id_col: str, front: str, back: str) -> DataFrame:
    """(id, field, value, confidence) for all that front and back matter tell. What the front lacks the back fills at nine
    tenths of its confidence; series and number move together, and a bare number in front doesn't keep a series out."""
    parts = texts.select(id_col, F.explode(F.array(F.struct(F.lit(0).alias("part"), text_of(F.col(front)).alias("t")), F.struct(F.lit(1).alias("part"), text_of(F.col(back)).alias("t")))).alias("x")).select(id_col, "x.*")
    side = lambda part: F.coalesce(F.max(F.when(F.col("part") == part, F.col("facts"))), F.array().cast("array<struct<field:string,value:string,confidence:double>>"))
    sides = _facts(parts, [id_col, "part"], "t").groupBy(id_col).agg(side(0).alias("front"), side(1).alias("back"))
    has = lambda facts, field: F.exists(facts, lambda x: x["field"] == field)
    # a series number moves with the series of its part: a part with a series comes first
    moves = has("back", "series") & ~has("front", "series")
    kept = F.filter("front", lambda x: (x["field"] != "series_index") | ~moves)
    less = F.transform("back", lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), F.round(x["confidence"] * BACK_FACTOR, 4).alias("confidence")))
    fills = F.filter(less, lambda x: ~F.exists("front", lambda y: (y["field"] == x["field"]) & ((y["field"] != "series_index") | ~moves)))
    return sides.select(id_col, F.explode(F.concat(kept, fills)).alias("f")).select(id_col, "f.*")
