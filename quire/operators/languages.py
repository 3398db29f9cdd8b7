"""Language detection by common words, and language codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let, text_of

LEAST_WORDS, LEAST_COVERAGE, LEAST_MARGIN, MOST_CONFIDENCE = 40, 0.18, 0.25, 0.95

# The common words that the results depend on.
STOP_WORDS = {
    "en": """the of and to in is that it was for on with as he she his her they be at by this had not are but from or have an which you were all we there their been has one would can if will what who no when said out up its about into than them could these then do my our me your how so did where just him i a""",
    "de": """der die das und in zu den nicht von ist mit sich des auf für dem ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir ihr ihre mich mir dich uns eines kann wenn dann schon immer hier sehr dieser diese dieses weil wieder doch denn ihm ihn ihnen seine seiner nun jetzt da was wer wo mein dein kein keine""",
    "fr": """le la les de des du un une et en à est que qui dans pour pas sur au aux il elle ils elles ce cette ces se ne ou mais avec son sa ses par plus je tu nous vous leur leurs était été être avait avoir fait comme tout tous toute toutes sans sous entre bien aussi même mon ma mes ton moi lui y où dont quand alors très peu encore lorsque cela ça cet si qu j jusqu lorsqu puisqu""",
    "it": """il lo la le gli i un uno una di del dello della dei degli delle da dal dalla in nel nella con su sul per tra fra e ed o ma che chi non è sono era erano ha hanno hai ho si se ci mi ti lei lui loro noi voi io tu questo questa questi quello quella come più anche molto tutto tutti tutta ogni suo sua suoi sue mio mia nostro essere stato stata fatto quando dove perché così già solo sempre ancora cosa dell nell all sull dall quest quell""",
    "no": """og i jeg det at en et til er som på de med han av ikke der så var meg seg men ett har om vi min mitt ha hadde hun nå over da ved fra du ut sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blitt kunne inn når være kom noen noe bare deg dette denne disse også etter mot under ingen mange sine mer mye hele slik sammen vært aldri mellom gjennom eg ikkje ein ei eit kva frå ho dei desse vore korleis berre òg kor nokon noko meir mykje hjå blei""",
    "da": """og i jeg det at en et til er som på de med han af ikke der så var mig sig men har om vi min mit have havde hun nu over da ved fra du ud sin dem os op man kan hans hvor eller hvad skal selv her alle vil blive blev blevet kunne ind når være kom nogen noget bare dig dette denne disse også efter mod under ingen mange sine mere meget hele sådan sammen været aldrig mellem gennem ham ja nej""",
    "sv": """och i jag det att en ett till är som på de med han av inte där så var mig sig men har om vi min mitt ha hade hon nu över då vid från du ut sin dem oss upp man kan hans eller vad ska själv här alla vill bli blev blivit kunde in när vara kom någon något bara dig detta denna dessa också efter mot under ingen många sina mer mycket hela sådan tillsammans varit aldrig mellan genom honom ja nej""",
}
REPORTED, NORDIC = ("en", "de", "fr", "it"), ("no", "da", "sv")
# Three-letter codes and the two-letter ones, with the Norwegian forms as one.
LANGUAGE_CODES = {
    "eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it", "dut": "nl", "nld": "nl", "swe": "sv", "dan": "da", "fin": "fi", "por": "pt", "rus": "ru", "pol": "pl", "cze": "cs", "ces": "cs", "jpn": "ja",
    "chi": "zh", "zho": "zh", "gre": "el", "ell": "el", "lat": "la", "hun": "hu", "tur": "tr", "ara": "ar", "heb": "he", "nor": "no", "nob": "no", "nno": "no", "nb": "no", "nn": "no", "no": "no",
}


def language_code(value):
    """The two-letter code of a code, empty if unknown."""
    code = F.lower(F.trim(text_of(value)))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.when(code.isin(*sorted({v for v in LANGUAGE_CODES.values()})), code), F.lit(""))


def language_of(text: Column) -> Column:
    """struct(lang_code, confidence, words) of a text; the code is empty where nothing is certain.

    A word is a run of letters. The share of each language's common words decides: the first needs a share of 0.18 and a lead of
    a quarter over the second; Danish, Swedish and Norwegian stand as one block, within which the words that only one of them
    has decide, and only Norwegian is reported. The words are taken from the text once; those that are common somewhere are
    sorted out first, and each language counts among these."""
    sets = {k: sorted(set(v.split())) for k, v in STOP_WORDS.items()}
    own = {x: sorted(set(sets[x]) - {w for o in NORDIC if o != x for w in sets[o]}) for x in NORDIC}
    every = sorted({w for v in sets.values() for w in v})
    count = lambda words, vocabulary: F.size(F.filter(words, lambda x: x.isin(*vocabulary)))

    def counted(w: Column) -> Column:
        common = F.filter(w, lambda x: x.isin(*every))
        return let(common, lambda h: F.struct(F.size(w).alias("words"), *[count(h, v).alias(f"hits_{k}") for k, v in sets.items()], *[count(h, v).alias(f"own_{k}") for k, v in own.items()]))

    def ranked(c: Column) -> Column:
        total = F.greatest(c["words"], F.lit(1))
        nordic = F.greatest(*[c[f"hits_{k}"] for k in NORDIC])
        shares = [F.struct((c[f"hits_{k}"] / total).alias("share"), F.lit(-i).alias("place"), F.lit(k).alias("code")) for i, k in enumerate(REPORTED)]
        rank = F.sort_array(F.array(*shares, F.struct((nordic / total).alias("share"), F.lit(-9).alias("place"), F.lit("no").alias("code"))), asc=False)
        return let(rank, lambda r: judged(c, r[0], r[1]))

    def judged(c: Column, top: Column, second: Column) -> Column:
        margin = (top["share"] - second["share"]) / top["share"]
        runner = F.greatest(c["own_da"], c["own_sv"])
        nordic_ok = (c["own_no"] >= 3) & (c["own_no"] >= runner) & (runner * 2 <= c["own_no"])
        sure = (c["words"] >= LEAST_WORDS) & (top["share"] >= LEAST_COVERAGE)
        confidence = margin * F.least(F.lit(1.0), top["share"] / 0.30)
        confidence = F.when(top["code"] == "no", confidence * (1 - runner / F.greatest(c["own_no"], F.lit(1)))).otherwise(confidence)
        ok = F.when(sure, (margin >= LEAST_MARGIN) & ((top["code"] != "no") | nordic_ok)).otherwise(False)
        return F.struct(
            F.when(ok, top["code"]).otherwise("").alias("lang_code"),
            F.when(ok, F.round(F.least(F.lit(MOST_CONFIDENCE), confidence), 2)).otherwise(0.0).alias("confidence"),
            c["words"].cast("long").alias("words"),
        )

    words = F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"(?U)[^\W\d_]+"), 0)
    return let(words, lambda w: let(counted(w), ranked))


def detect_language(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, lang_code (empty where nothing is certain), confidence (two places) and words for each row. A projection: nothing is shuffled."""
    return docs.select(id_col, language_of(F.col(text_col)).alias("g")).select(id_col, "g.lang_code", "g.confidence", "g.words")
