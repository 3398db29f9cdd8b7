"""Text: white space, keys for comparison, HTML, missing spaces, search and replace, file names."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they fold to.
MARKED = "àáâãäåāăąçćčďèéêëēęěğìíîïīıłñńňòóôõöōőøřśšşťùúûüūůűýÿžźż"
PLAIN_ = "aaaaaaaaacccdeeeeeeegiiiiiilnnnooooooooрssstuuuuuuuyyzzz".replace("р", "r")
ARTICLES = ("the", "a", "an", "le", "la", "les", "l", "el", "il", "der", "die", "das")
MINOR_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "the", "to", "up", "via", "with")
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)))
UNKNOWN_LANGUAGES = ("", "unknown", "und", "unk", "n/a", "na", "none", "not set", "unspecified")
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|table|blockquote|hr|section|article|header|footer"
#: Named characters of HTML (those of its fourth version, and the apostrophe); a blank that doesn't break is a blank.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}

assert len(MARKED) == len(PLAIN_)


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def collapse(value: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.trim(F.regexp_replace(text_of(value), r"\s+", " "))


def fold(value: Column) -> Column:
    """Small letters without marks; æ, œ and ß as two letters."""
    small = F.translate(F.lower(text_of(value)), MARKED, PLAIN_)
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        small = F.replace(small, F.lit(a), F.lit(b))
    return small


def words_key(value: Column) -> Column:
    """Folded words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(fold(value), r"[^\pL\pN]+", " "))


def title_key(value: Column) -> Column:
    """words_key without one leading article, unless that is all there is."""
    key = words_key(value)
    return F.when(F.split_part(key, F.lit(" "), F.lit(1)).isin(*ARTICLES) & key.contains(" "), F.regexp_replace(key, "^[^ ]+ ", "")).otherwise(key)


def plain_key(value: Column) -> Column:
    """Small letters, anything but letters and digits as a space; marks stay."""
    return F.trim(F.regexp_replace(F.lower(text_of(value)), r"[^\pL\pN]+", " "))


def title_stem(value: Column) -> Column:
    """What stands before a colon or a dash with spaces."""
    return F.get(F.split(text_of(value), r"\s*[:–—]\s*|\s+-\s+", 2), F.lit(0))


def missing_spaces(value: Column) -> Column:
    """All places where a letter follows . , ; : ! ? at once."""
    return F.regexp_extract_all(text_of(value), F.lit("[.,;:!?][A-Za-z]"), 0)


def fix_missing_spaces(value: Column) -> Column:
    return F.regexp_replace(text_of(value), "([.,;:!?])([A-Za-z])", "$1 $2")


def is_unknown_language(value: Column) -> Column:
    return F.lower(F.trim(text_of(value))).isin(*UNKNOWN_LANGUAGES)


def has_markup(value: Column) -> Column:
    return text_of(value).rlike(r"<[A-Za-z/!][^>]*>")


def unescaped(value: Column) -> Column:
    """A text with the characters that its entities stand for: named ones, decimal and hexadecimal numbers. What is no entity, or stands for no
    character (beyond Unicode, a surrogate, zero), stays as it is. Each is read once: &amp;lt; gives &lt;."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def read(piece: Column) -> Column:
        """A piece that follows an ampersand."""
        entity = F.regexp_extract(piece, "^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        number = F.when(entity.rlike("^#[0-9]"), F.substring(entity, 2, 8).try_cast("long")).when(entity.startswith("#"), F.conv(F.substring(entity, 3, 6), 16, 10).try_cast("long"))
        fits = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(number == 160, " ").when(fits, F.decode(F.unhex(F.lpad(F.hex(F.when(fits, number).otherwise(65)), 8, "0")), "UTF-32"))
        char = F.coalesce(char, F.try_element_at(names, entity))
        return F.when(char.isNotNull(), F.concat(char, F.substring(piece, F.length(entity) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    def joined(text: Column) -> Column:
        pieces = F.split(text, "&")
        return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), read), ""))).otherwise(text)

    return let(value, joined)


#: The entities that simple texts have.
USUAL = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def strip_html(value: Column, usual_only: bool = False) -> Column:
    """Plain text of simple markup: scripts, styles and comments go, ends of blocks become line feeds, entities their
    characters (usual_only: only the seven usual ones). A text without a tag stays as it is."""
    out = F.regexp_replace(text_of(value), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    if usual_only:
        for entity, plain in USUAL.items():
            out = F.replace(out, F.lit(entity), F.lit(plain))
    else:
        out = unescaped(out)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.when(has_markup(value), F.regexp_replace(out, r"^\s+|\s+$", "")).otherwise(text_of(value))


def reader_html(value: Column) -> Column:
    """Markup to show: no prolog, doctype, style, script or link; an image wrapped in SVG as an img tag."""
    out = F.regexp_replace(text_of(value), r"(?is)<\?xml.*?\?>|<!DOCTYPE[^>]*>|<(style|script)\b.*?</\1\s*>|<link\b[^>]*>", "")
    return F.regexp_replace(out, r"""(?is)<svg\b.*?<image\b[^>]*?href\s*=\s*["']([^"']*)["'].*?</svg\s*>""", '<img src="$1"/>')


def search_replace(value: Column, search: str, replacement: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """All matches replaced. A literal search takes nothing as special; \\1 in a regex replacement names a group. An empty search
    changes nothing; an invalid regex is refused."""
    if not search:
        return text_of(value)
    if regex:
        re.compile(search)
        pattern, new = search, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    else:
        pattern, new = re.escape(search), replacement.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(text_of(value), ("(?iu)" if ignore_case else "") + pattern, new)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))


def change_case(value: Column, how: str) -> Column:
    """upper, lower, sentence (first letter large), or title: each word's first letter large, but minor words small unless
    first or last."""
    text = text_of(value)
    if how == "upper":
        return F.upper(text)
    if how == "lower":
        return F.lower(text)
    if how == "sentence":
        return _capital(text)
    words = F.split(text, " ")
    last = F.size(words) - 1
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & (i < last) & F.lower(w).isin(*MINOR_WORDS), F.lower(w)).otherwise(_capital(w))), " ")


def file_name(value: Column, most: int = 150, fallback: str = "Untitled") -> Column:
    """A name every system takes: no control or forbidden characters, no dot or space at the end, no reserved name."""
    clean = collapse(F.regexp_replace(text_of(value), r'[<>:"/\\|?*\x00-\x1f]', " "))
    clean = F.regexp_replace(F.substring(clean, 1, most), r"[. ]+$", "")
    clean = F.when(F.lower(F.split_part(clean, F.lit("."), F.lit(1))).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(clean == "", fallback).otherwise(clean)


def ascii_name(value: Column) -> Column:
    """The text without marks and ligatures, in the letters' own case."""
    out = F.translate(text_of(value), MARKED + MARKED.upper().replace("ı", "İ"), PLAIN_ + PLAIN_.upper()) if len(MARKED.upper()) == len(MARKED) else F.translate(text_of(value), MARKED, PLAIN_)
    for a, b in (("æ", "ae"), ("Æ", "Ae"), ("œ", "oe"), ("Œ", "Oe"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unsafe_path(value: Column) -> Column:
    """Empty, absolute, with a drive letter, a backslash, a NUL or a step up."""
    return text_of(value).rlike(r"^$|^/|^[A-Za-z]:|\\|\x00|(^|/)\.\.(/|$)")


def resolve_href(base: Column, href: Column) -> Column:
    """The archive path of a link: fragment and query go, percent codes are read, the folder of ``base`` is put in front, and
    . and .. steps are walked; null where a step leads out."""
    clean = F.regexp_replace(text_of(href), r"[?#].*$", "")
    plain = F.coalesce(F.try_url_decode(F.replace(clean, F.lit("+"), F.lit("%2B"))), clean)
    whole = F.concat(F.regexp_extract(text_of(base), r"^(.*/)?[^/]*$", 1), plain)
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(acc.isNull() | ((s == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>")).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(walked, "/")


def caps_share(value: Column) -> Column:
    """Share of capitals among the letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text_of(value), r"[^\pL]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(text_of(value), r"[^\p{Lu}]", "")) / letters)
