"""PII: format-preserving pseudonyms. Validated numbers, dates and addresses are permuted by a keyed Feistel network."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import by_bytes

ROUNDS = 6
KINDS = ("email", "secret", "ip6", "ip", "iban", "date", "ssn", "card", "phone")
# Country codes of telephone numbers that have one and two digits; all others have three.
SHORT_CODES = ("1", "7")
CODES_OF_TWO = """20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98""".split()
#: Characters of an IBAN by country (the registry of ISO 13616).
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24
    FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
    MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29
    VA22 VG24 XK20 YE30""".split()}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# The written forms that are looked at. What one matches must still pass its check.
FORMS = re.compile(
    r"""(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))
    |(?P<secret>(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])|(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])
        |(?<![0-9A-Za-z])(?:gh[pousr]_|sk_live_|sk-|xox[abp]-)[0-9A-Za-z]{16,64}(?![0-9A-Za-z]))
    |(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![\w:]|\.\d))
    |(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))
    |(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))
    |(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d]|[./-]\d))
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d))
    |(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d]|-\d))
    |(?P<phone>(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?(?!\d)|(?<![\w+(])\+\d{8,15}(?!\d)
        |(?<![\w+(])\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){0,3}[ .-]\d{5,8}(?!\d))""",
    re.X | re.A,
)


class Feistel:
    """A keyed permutation of 0 to m - 1 for every kind of value and every m.

    A number is split in two digits of the bases a and b, about the root of m; each round adds to one of them a keyed hash
    of the other. Results of m and more (a * b may be somewhat larger) go through again until one falls below m."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mixed(self, kind: str, m: int, turn: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind} {m} {turn} {x}".encode(), key=self.key, digest_size=32).digest(), "little") << 256 | int.from_bytes(
            hashlib.blake2b(f"{kind} {m} {turn} {x}.".encode(), key=self.key, digest_size=32).digest(), "little"
        )

    def permute(self, kind: str, x: int, m: int, back: bool = False) -> int:
        if m <= 1:
            return x
        a = isqrt(m - 1) + 1
        b = -(-m // a)
        while True:
            high, low = divmod(x, b)
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if turn % 2:
                    low = (low + sign * self._mixed(kind, m, turn, high)) % b
                else:
                    high = (high + sign * self._mixed(kind, m, turn, low)) % a
            x = high * b + low
            if x < m:
                return x


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def ip6_like(text: str) -> bool:
    """An IPv6 address that can't be taken for names joined by ::, as in code."""
    try:
        short = str(ipaddress.IPv6Address(text))
    except ValueError:
        return False
    return "." not in short and any(c.isdigit() for c in short) and max(map(len, short.split(":"))) >= 3


def iban_end(text: str) -> int | None:
    """Where the valid IBAN ends with which ``text``, a match of the form, begins: words of capitals behind the number match too.
    At the end of a group: where the country's length is reached, else the longest that passes the check."""
    ends = []
    for end in [*(i for i, c in enumerate(text) if c == " "), len(text)]:
        plain = text[:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain) == 1:
            ends.append((len(plain) == IBAN_LENGTHS.get(plain[:2]), end))
    return max(ends)[1] if ends else None


def _refill(shape: str, new: str, taken=str.isdigit) -> str:
    """``new``'s characters in the places of ``shape`` that are taken."""
    chars = iter(new)
    return "".join(next(chars) if taken(c) else c for c in shape)


class Pseudonyms:
    """One value to its pseudonym or, with ``back``, to the value again; None if the value is not valid in its form."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _digits(self, kind: str, digits: str, back: bool) -> str:
        return str(self.feistel.permute(kind, int(digits or 0), 10 ** len(digits), back)).zfill(len(digits)) if digits else ""

    def _classes(self, kind: str, text: str, back: bool) -> str:
        """Letters become letters and digits digits, all in one permutation; other characters stay."""
        x, m = 0, 1
        for c in text:
            base = 10 if c.isdigit() else 26 if c.isalpha() else 1
            x, m = x * base + (int(c) if base == 10 else ord(c.lower()) - 97 if base == 26 else 0), m * base
        x = self.feistel.permute(kind, x, m, back)
        out = []
        for c in reversed(text):
            if c.isdigit():
                x, d = divmod(x, 10)
                out.append(str(d))
            elif c.isalpha():
                x, d = divmod(x, 26)
                out.append(chr(d + (65 if c.isupper() else 97)))
            else:
                out.append(c)
        return "".join(reversed(out))

    def of(self, kind: str, value: str, back: bool = False) -> str | None:
        return getattr(self, kind)(value, back)

    def email(self, value: str, back: bool) -> str:
        """The name before the @ changes, the host stays; capitals don't matter, so the result has none."""
        name, _, host = value.lower().rpartition("@")
        return f"{self._classes('email ' + host, name, back)}@{host}"

    def secret(self, value: str, back: bool) -> str | None:
        """Hexadecimal digests and keys; of keys with a known beginning, letters become letters and digits digits behind it."""
        if start := re.match("AKIA|gh[pousr]_|sk_live_|sk-|xox[abp]-", value):
            shape = "".join("A" if c.isupper() else "a" if c.islower() else "0" for c in value[start.end() :])
            return start[0] + self._classes(f"secret {start[0]} {shape}", value[start.end() :], back)
        if not (re.search("[0-9]", value) and re.search("[A-Fa-f]", value)):
            return None
        new = format(self.feistel.permute("secret", int(value, 16), 16 ** len(value), back), f"0{len(value)}x")
        return new.upper() if value.upper() == value else new

    def ip6(self, value: str, back: bool) -> str | None:
        """All ways to write an address are one value; the pseudonym is written the short way."""
        if not ip6_like(value):
            return None
        new = value
        while True:
            new = str(ipaddress.IPv6Address(self.feistel.permute("ip6", int(ipaddress.IPv6Address(new)), 1 << 128, back)))
            if ip6_like(new):
                return new

    def ip(self, value: str, back: bool) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        x = self.feistel.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32, back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def iban(self, value: str, back: bool) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        body = self._classes("iban " + plain[:2], plain[4:], back)
        check = 98 - mod97(plain[:2] + "00" + body)
        return _refill(value, f"{plain[:2]}{check:02d}{body}", str.isalnum)

    def date(self, value: str, back: bool) -> str | None:
        """Within the years 1900 to 2099. The day itself is permuted, so all ways to write a date stay linked. d/m/y and m/d/y look
        alike: the day comes first unless that is no date. A day up to the 12th stays one, any other too, so that the pseudonym is
        read in the same order and the way back is known."""
        numbers = [int(x) for x in re.findall(r"\d+", value)]
        for y, m, d in ((0, 1, 2),) if len(value) > 4 and value[4] in "-/" and value[:4].isdigit() else ((2, 1, 0), (2, 0, 1)):
            try:
                day = datetime.date(numbers[y], numbers[m], numbers[d])
            except ValueError:
                continue
            if not FIRST_DAY <= (x := day.toordinal()) <= LAST_DAY:
                return None
            while True:
                x = FIRST_DAY + self.feistel.permute("date", x - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back)
                new = datetime.date.fromordinal(x)
                if (new.day <= 12) == (day.day <= 12):
                    break
            parts = {y: f"{new.year:04d}", m: f"{new.month:02d}", d: f"{new.day:02d}"}
            return re.sub(r"\d+", lambda _, n=iter(range(3)): parts[next(n)], value)
        return None

    def ssn(self, value: str, back: bool) -> str | None:
        area, group, serial = (int(x) for x in value.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.feistel.permute("ssn", x, 898 * 99 * 9999, back), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, value: str, back: bool) -> str | None:
        """The first digit stays, the last one is the check digit again."""
        plain = re.sub(r"\D", "", value)
        if not luhn(plain) or len(set(plain)) == 1:
            return None
        body = plain[0] + self._digits("card " + plain[0], plain[1:-1], back)
        check = next(c for c in "0123456789" if luhn(body + c))
        return _refill(value, body + check)

    def phone(self, value: str, back: bool) -> str | None:
        """A country code after + stays. Only the digits count, so a number stays linked however it is spaced."""
        plain = re.sub(r"\D", "", value)
        if not 9 <= len(plain) <= 15:
            return None
        fixed = 0 if value[0] != "+" else 1 if plain[0] in SHORT_CODES else 2 if plain[:2] in CODES_OF_TWO else 3
        return _refill(value, plain[:fixed] + self._digits(f"phone {value[0] == '+'} {plain[:fixed]}", plain[fixed:], back))


def pseudonymise(text: str, names: Pseudonyms, counts: dict[str, int], back: bool = False) -> str:
    out, done, at = [], 0, 0
    while found := FORMS.search(text, at):
        kind, value, start = found.lastgroup, found[0], found.start()
        at = found.end()
        if kind == "iban":
            end = iban_end(value)
            if end is None:  # other values may stand in the groups behind the first one
                at = start + value.find(" ") if " " in value else at
                continue
            at, value, behind = start + end, value[:end], value[end:]
        new = names.of(kind, value, back)
        if new is None:
            continue
        # an IBAN of no registered length: its pseudonym must end at the same place, so that the way back is known
        while kind == "iban" and iban_end(new + behind) != end:
            new = names.of(kind, new, back)
        counts[kind] = counts.get(kind, 0) + 1
        out += text[done:start], new
        done = at
    return "".join(out) + text[done:] if out else text


def _rewritten(texts: pa.Array, names: Pseudonyms, back: bool) -> tuple[pa.Array, list[dict[str, int]]]:
    """The texts, changed where there is something to change; texts without digit and @ aren't looked at."""
    counts: list[dict[str, int]] = [{} for _ in range(len(texts))]
    some = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]"), False)
    at = pc.indices_nonzero(some).to_pylist()
    if not at:
        return texts, counts
    new = [pseudonymise(t, names, counts[i], back) for i, t in zip(at, texts.filter(some).to_pylist())]
    return pc.replace_with_mask(texts, some, pa.array(new, texts.type)), counts


def session_key(spark: SparkSession) -> bytes:
    """The secret key of the session's pseudonyms: its setting spark.quire.piiKey. Where that is unset a random one is made and set, so
    that all runs of the session give equal values equal pseudonyms, and nobody else can undo them."""
    found = spark.conf.get("spark.quire.piiKey", None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set("spark.quire.piiKey", found)
    return found.encode()


def mask_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, the text with pseudonyms in place of personal data, n_found, and how many of each
    kind: e-mail addresses, secrets (hexadecimal, or keys with a usual beginning), IPv6 and IPv4 addresses, IBANs, dates, social security and card numbers, phones.

    A value must be valid: octets below 256, check digits of cards and IBANs, days of the calendar. Its pseudonym has the same form and is
    valid again; it depends on the key and the value only, so equal values stay equal everywhere: dates however they are written, phone
    numbers, cards and IBANs however they are spaced. (A phone number with its country code isn't known to be the one without.) With ``back``
    and the same key the values return, unless what changes behind the first group of a number that is no IBAN happens to make it one
    (1 in 97). Rows stay where they are. A null text stays null with no finds; a null id stays null; repeated
    rows are masked alike; other columns are never read."""
    names = docs.sparkSession.sparkContext.broadcast(Pseudonyms(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts, counts = _rewritten(batch.column("text"), names.value, back)
            numbers = [pa.array([c.get(k, 0) for c in counts], pa.int32()) for k in KINDS]
            total = pa.array([sum(c.values()) for c in counts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, total, *numbers], ["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, n_found int, " + ", ".join(f"n_{k} int" for k in KINDS))


def mask_in_place(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, with the text masked as by mask_documents. Null texts and null ids stay null,
    repeated rows are masked alike, very long texts stand alone in a batch, an empty table stays empty."""
    names = docs.sparkSession.sparkContext.broadcast(Pseudonyms(key))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            yield batch.set_column(at, batch.schema.field(at).name, _rewritten(batch.column(at), names.value, False)[0])

    return docs.mapInArrow(run, docs.schema)
