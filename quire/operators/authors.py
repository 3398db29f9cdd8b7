"""Cleaning author names and their sort forms: safe rules are applied, doubtful ones listed for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import INITIAL, author_key, surname
from quire.functions.text import collapse, let, text_of, words_key

# Small words that stay with the surname; ends of names; titles and degrees; entries that name nobody, and words of
# names that are no person's, which are both left as they are.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "des", "le", "la", "les", "el", "al", "bin", "ibn", "ter", "ten", "op", "dos", "das", "do", "zu", "zur", "af", "av", "y", "st")
SUFFIXES = {"jr": "Jr.", "sr": "Sr.", "ii": "II", "iii": "III", "iv": "IV"}
HONORIFICS = ("dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "rev", "fr", "lady", "lord", "dame", "hon")
DEGREES = ("phd", "md", "msc", "dphil", "esq", "dds", "frs", "mba")
PLACEHOLDERS = ("anonymous", "unknown", "various", "n a", "none", "unknown author", "various authors", "anon", "uncredited", "unknown artist")
CORPORATE_WORDS = """inc incorporated ltd limited llc llp plc gmbh ag co corp corporation company press publishing publishers publisher publications books book university college school institute
    association society committee council department ministry magazine journal foundation group team staff editors editorial library museum agency bureau studio studios media network sons bros
    brothers verlag editions edizioni forlag government commission organization organisation academy centre center fund service services labs software games comics entertainment international united
    national states nations authority administration""".split()
CORPORATE = r"(?iu)(?<!\pL)(?:" + "|".join(CORPORATE_WORDS) + r")(?!\pL)\.?"
# Our own patterns of what is no part of a name.
ROLE = r"(?:cover\s+artist|foreword|introduction|intro|afterword|preface|photographer|artist|editors?|eds?|translat(?:ors?|ed)|trans|illustrat(?:ors?|ed)|illus|narrat(?:ors?|ed)|contrib(?:utors?)?|compile[rd]|adapt[eo]r|authors?)\.?"
ROLES = rf"{ROLE}(?:\s*(?:,|/|&|and)\s*{ROLE})*"
OTHERS = r"(?:et\.?\s*al\.?|and\s+(?:others|co\.?))"
LIFE = r"\d{3,4}\s*[-–—]\s*(?:\d{3,4})?"
JUNK = rf"(?iu)\s*[(\[]\s*{ROLES}\s*[)\]]|\s*[,–—-]\s*{ROLES}\s*$|^\s*(?:{ROLE}\s+)?by\s+|\s*,?\s*(?<!\pL){OTHERS}\s*$|\s*,?\s*(?:[(\[]\s*{LIFE}\s*[)\]]|{LIFE})\s*$|\s*,?\s*[(\[]\s*(?:b|d|born|died)\.?\s*\d{{3,4}}\s*[)\]]\s*$"
NO_ENTRY = rf"(?iu)^\s*(?:{ROLES}|{OTHERS}|others|etc\.?)?\s*$"
SAFE = ("whitespace", "junk", "punctuation", "split", "flip", "initials", "caps", "suffix", "duplicate", "sort_from_author", "sort_fill", "sort_format", "sort_not_inverted")
CHANGE = "struct<rule:string,safe:boolean,detail:string>"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _bare(word: Column) -> Column:
    return F.replace(F.lower(word), F.lit("."), F.lit(""))


def _is_suffix(word: Column) -> Column:
    return _bare(word).isin(*SUFFIXES)


def untouched(name: Column) -> Column:
    """Placeholders, names of companies and such, and names with letters beyond Latin ones: no rule changes them."""
    return words_key(name).isin(*PLACEHOLDERS) | name.rlike(CORPORATE) | name.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def split_parts(raw: Column) -> Column:
    """A value's names: parted by ; and, where each part has two words and more, by & or "and" with spaces."""
    whole = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    parted = lambda x: let(whole(F.split(x, r"\s+&\s+|\s+and\s+")), lambda ps: F.when(F.forall(ps, lambda p: F.regexp_replace(p, INITIAL, "$1. ").contains(" ")), ps).otherwise(F.array(x)))
    return F.flatten(F.transform(whole(F.split(raw, ";")), lambda x: F.when(untouched(x), F.array(x)).otherwise(parted(x))))


def comma_kind(name: Column) -> Column:
    """none, suffix (Smith, Jr.), inverted (Smith, Jane), list (three full names and more) or ambiguous."""
    parts = F.transform(F.split(name, ","), lambda x: F.trim(x))
    full = F.size(F.filter(parts, lambda p: p.contains(" ")))
    return (
        F.when(F.size(parts) == 1, "none")
        .when((F.size(parts) == 2) & _is_suffix(F.get(parts, F.lit(1))), "suffix")
        .when((full == F.size(parts)) & (F.size(parts) >= 2), F.when(F.size(parts) >= 3, "list").otherwise("ambiguous"))
        .when((F.size(parts) == 2) | ((F.size(parts) == 3) & _is_suffix(F.element_at(parts, -1))), "inverted")
        .otherwise("ambiguous")
    )


def flip(name: Column) -> Column:
    """ "Smith, Jane" as "Jane Smith", "Smith, Jane, Jr." as "Jane Smith Jr."; other forms stay."""
    parts = F.transform(F.split(name, ","), lambda x: F.trim(x))
    end = F.when(F.size(parts) == 3, F.concat(F.lit(" "), F.get(parts, F.lit(2)))).otherwise("")
    return F.when((comma_kind(name) == "inverted") & ~name.rlike(CORPORATE), F.concat(F.get(parts, F.lit(1)), F.lit(" "), F.get(parts, F.lit(0)), end)).otherwise(name)


def fix_suffix(name: Column) -> Column:
    """The usual form of a last word that is a suffix, without a comma before it."""
    last = F.regexp_extract(name, r"([^ ,]+)$", 1)
    return F.when(_is_suffix(last) & name.contains(" "), F.concat(F.regexp_replace(name, r"[ ,]+[^ ,]+$", ""), F.lit(" "), F.try_element_at(_map(SUFFIXES), _bare(last)))).otherwise(name)


def fix_caps(name: Column) -> Column:
    """A name of several words in one case only, word by word with a large first letter; particles are small unless first, hyphens
    and apostrophes begin a new part, initials and suffixes stay."""

    def word(w: Column, i: Column) -> Column:
        parts = F.transform(F.split(F.lower(w), "(?<=[-'’])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 999)))
        return F.when(w.rlike(r"^([A-Z]\.)+$") | _is_suffix(w), w).when((i > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(F.array_join(parts, ""))

    # "macdonald" and runs of consonants may be written otherwise, and small letters may be meant
    tricky = name.rlike(r"(?iu)(?<!\pL)mc[a-z]{2}") | name.rlike(r"(?iu)(?<!\pL)(?!(?:jr|sr|st)(?!\pL))[bcdfghjklmnpqrstvwxz]{2,3}(?![\pL.])")
    one_case = (F.upper(name) == name) & name.rlike(r"\pL{3}") & name.contains(" ") & ~tricky
    return F.when(one_case, F.array_join(F.transform(F.split(name, " "), word), " ")).otherwise(name)


def sort_form(name: Column) -> Column:
    """Surname with its particles first: "Ludwig van Beethoven" as "van Beethoven, Ludwig", "Jane Doe Jr." as "Doe, Jane, Jr."."""
    last = F.regexp_extract(name, r" ([^ ]+)$", 1)
    suffix = F.when(_is_suffix(last), F.concat(F.lit(", "), last)).otherwise("")
    body = F.when(suffix != "", F.regexp_replace(name, r" [^ ]+$", "")).otherwise(name)
    small = "|".join(PARTICLES)
    shape = rf"^(.*?) ((?:(?:{small}) )*[^ ]+)$"
    return F.when(~body.contains(" ") | name.rlike(CORPORATE), name).otherwise(F.concat(F.regexp_extract(body, shape, 2), F.lit(", "), F.regexp_extract(body, shape, 1), suffix))


def clean_authors(books: DataFrame) -> DataFrame:
    """book_id, authors, author_sort, changes (rule, safe, detail), needs_review. books: book_id, authors and author_sort as arrays
    aligned by place. Every rule that changes something is one entry; doubtful ones (safe = false) change nothing. Placeholders, companies
    and names in other scripts stay as they are; a list of nothing but roles stays too."""
    empty = F.array().cast("array<string>")
    rows = books.select("book_id", F.transform(F.coalesce("authors", empty), text_of).alias("raw"), F.transform(F.coalesce("author_sort", empty), text_of).alias("sorts"))
    each = lambda change: lambda xs: F.transform(xs, lambda x: F.when(untouched(x), x).otherwise(change(x)))
    twice = lambda x: F.regexp_replace(F.regexp_replace(x, JUNK, ""), JUNK, "")
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s*,\s*", ", "), r"^[\s,;:|/_*\"“”<>–—-]+|[\s,;:|/_*\"“”<>–—-]+$", ""), r"(?<=\pL{3})(?<!(?i:\b(?:prof|esq|phd|rev|hon)))\.$", "")
    step: list[tuple[str, str, object]] = [
        ("whitespace", "raw", lambda xs: F.transform(xs, collapse)),
        ("junk", "whitespace", lambda xs: F.filter(each(lambda x: F.when(x.rlike(NO_ENTRY), "").otherwise(F.trim(twice(x))))(xs), lambda x: x != "")),
        ("punctuation", "junk", lambda xs: F.filter(each(tidy)(xs), lambda x: x != "")),
        ("split", "punctuation", lambda xs: F.flatten(F.transform(xs, split_parts))),
        ("flip", "split", each(flip)),
        ("initials", "flip", each(lambda x: F.regexp_replace(x, INITIAL, "$1. "))),
        ("caps", "initials", each(fix_caps)),
        ("suffix", "caps", each(fix_suffix)),
        ("duplicate", "suffix", lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, author_key), author_key(x)) == i + 1)),
    ]
    for name, source, rule in step:
        rows = rows.withColumn(name, rule(F.col(source)))
    nobody = F.size("duplicate") == 0
    change = lambda rule, safe, ok, detail: F.when(ok & ~nobody, F.struct(F.lit(rule).alias("rule"), F.lit(safe).alias("safe"), detail.alias("detail")))
    shown = lambda c: F.array_join(c, "; ")
    changes = [change(name, True, F.col(source) != F.col(name), F.concat(shown(source), F.lit(" -> "), shown(name))) for name, source, _ in step]
    same = F.size("duplicate") == F.size("sorts")
    given = lambda i: F.coalesce(F.when(same, F.trim(F.get("sorts", i))), F.lit(""))
    fixed = lambda s: F.regexp_replace(F.regexp_replace(collapse(s), r"\s*,\s*", ", "), INITIAL, "$1. ")
    plain = lambda a, s: ~s.contains(",") & a.contains(" ") & (author_key(a) == author_key(s))
    sorts = F.transform("duplicate", lambda a, i: F.when(untouched(a), F.when(given(i) == "", a).otherwise(given(i))).when((given(i) == "") | plain(a, given(i)), sort_form(a)).otherwise(fixed(given(i))))
    rows = rows.withColumn("new_sorts", sorts)
    had = F.exists("sorts", lambda s: F.trim(s) != "")
    any_at = lambda test: F.exists(F.sequence(F.lit(0), F.greatest(F.size("duplicate") - 1, F.lit(0))), test)
    inverted = F.exists("split", lambda x: ~untouched(x) & (comma_kind(x) == "inverted"))
    changes.append(change("sort_from_author", True, ~had & inverted, shown("new_sorts")))
    changes.append(change("sort_fill", True, ~had & ~inverted & (F.size("new_sorts") > 0), shown("new_sorts")))
    not_inverted = same & any_at(lambda i: plain(F.get("duplicate", i), given(i)) & ~untouched(F.get("duplicate", i)) & (given(i) != ""))
    changes.append(change("sort_not_inverted", True, had & F.coalesce(not_inverted, F.lit(False)), F.concat(shown("sorts"), F.lit(" -> "), shown("new_sorts"))))
    changes.append(change("sort_format", True, had & same & ~F.coalesce(not_inverted, F.lit(False)) & (F.col("sorts") != F.col("new_sorts")), F.concat(shown("sorts"), F.lit(" -> "), shown("new_sorts"))))
    # what is only listed
    doubt = lambda rule, test: change(rule, False, F.exists("duplicate", lambda x: ~untouched(x) & test(x)), F.coalesce(F.get(F.filter("duplicate", lambda x: ~untouched(x) & test(x)), F.lit(0)), F.lit("")))
    word = lambda x, i: F.split_part(x, F.lit(" "), F.lit(i))
    changes.append(doubt("split", lambda x: x.rlike(r"\s(?:&|and)\s")))
    changes.append(doubt("list_split", lambda x: comma_kind(x).isin("list", "ambiguous")))
    changes.append(doubt("honorific", lambda x: x.contains(" ") & (_bare(word(x, 1)).isin(*HONORIFICS) | _bare(F.regexp_extract(x, r"([^ ,]+)$", 1)).isin(*DEGREES))))
    changes.append(doubt("caps", lambda x: x.rlike(r"\pL{3}") & ((F.lower(x) == x) | (F.upper(x) == x) & (fix_caps(x) == x) & ~x.rlike(r"^(?:\pL\.\s*)+$"))))
    changes.append(doubt("initials_caps", lambda x: (F.upper(x) != x) & x.contains(" ") & x.rlike(r"(?<![\pL.])(?!(?:II|III|IV)(?!\pL))[A-Z]{2,3}(?=\s)")))
    # forms of one name: the words of the sort form are the name's, or its surname with initials
    initials = lambda x: F.regexp_replace(words_key(x), r"(?<!\pL)(\pL)\pL*", "$1")
    agrees = lambda a, s: (author_key(a) == author_key(s)) | ((surname(s) == surname(a)) & (F.array_join(F.array_sort(F.split(initials(a), " ")), " ") == F.array_join(F.array_sort(F.split(initials(s), " ")), " ")))
    changes.append(change("sort_mismatch", False, had & same & F.coalesce(any_at(lambda i: ~untouched(F.get("duplicate", i)) & ~agrees(F.get("duplicate", i), F.get("new_sorts", i))), F.lit(False)), shown("new_sorts")))
    changes.append(change("sort_extra", False, had & (F.size("sorts") > F.size("raw")), shown("sorts")))
    rows = rows.withColumn("changes", F.array_compact(F.array(*changes)))
    return rows.select("book_id", F.when(nobody, F.col("raw")).otherwise(F.col("duplicate")).alias("authors"), F.when(nobody, F.col("sorts")).otherwise(F.col("new_sorts")).alias("author_sort"), "changes", F.exists("changes", lambda c: ~c["safe"]).alias("needs_review"))
