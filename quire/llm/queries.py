"""The queries op1 to op13, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm.byte_bpe import BytePairCoder, encode_documents, read_ranks
from quire.llm.exact_dedup import exact_duplicates
from quire.llm.fingerprints import fingerprint_documents
from quire.llm.language_id import identify
from quire.llm.lexical_search import rank_documents
from quire.llm.licences import licence_digest, scan_licences
from quire.llm.ngram_join import jaccard_components
from quire.llm.packing import pack
from quire.llm.phrases import collocations
from quire.llm.pii import mask_documents
from quire.llm.repeats import repeated_spans
from quire.llm.token_count import count_tokens
from quire.llm.url_filter import judge_urls

#: The rules of op2: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The phrases of op13 and their labels.
LICENCES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


#: The key of the query op8 alone, which shows the operator on invented data; anyone who has it can undo the pseudonyms.
SAMPLE_KEY = b"quire sample key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=4, percent=85)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = BytePairCoder(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, units=True)
    return encode_documents(documents(spark, sf_dir), coder)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir), least=50)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_documents(documents(spark, sf_dir), SAMPLE_KEY)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), max_words=3, least=10, share=50, top=2000)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(scan_licences(documents(spark, sf_dir), LICENCES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_count, op2_url_filter, op3_ngram_jaccard, op4_byte_bpe, op5_packing, op6_fingerprints, op7_suffix_array, op8_pii, op9_language_id, op10_exact_dedup, op11_collocations, op12_lexical_search, op13_licences)}

ORACLE_SQL = {
    "op2_url_filter": r"""
        WITH cut AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        judged AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM cut)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged""",
    "op3_ngram_jaccard": None,
    "op10_exact_dedup": """
        WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM texts""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
        grams AS (
            SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS gram, m, any_value(ws[i:i + m - 1]) AS ws, count(*) AS f
            FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY lang, gram, m),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT * FROM grams WHERE m > 1 AND f >= 10),
        cuts AS (SELECT c.*, k, array_to_string(c.ws[1:k], ' ') AS head, array_to_string(c.ws[k + 1:m], ' ') AS tail FROM candidates c, (SELECT unnest([1, 2]) AS k) WHERE k < m),
        scored AS (
            SELECT u.lang, u.gram, u.f, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * u.f * u.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score, k
            FROM cuts u JOIN grams x ON x.lang = u.lang AND x.gram = u.head AND x.m = k JOIN grams y ON y.lang = u.lang AND y.gram = u.tail AND y.m = u.m - k),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS place FROM scored),
        held AS (
            SELECT lang, gram, max(f) AS most FROM (
                SELECT lang, array_to_string(ws[1:2], ' ') AS gram, f FROM candidates WHERE m = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), f FROM candidates WHERE m = 3) GROUP BY lang, gram),
        left_over AS (SELECT w.* FROM lowest w LEFT JOIN held h ON h.lang = w.lang AND h.gram = w.gram WHERE place = 1 AND (h.most IS NULL OR 100 * h.most < 50 * w.f)),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, gram) AS rank, gram AS phrase, f AS a, l, r, score FROM left_over)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_lexical_search": r"""
        WITH lower_docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_docs),
        sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
        postings AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY term, doc_id),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term, big_n),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
            FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50""",
}
ORACLE_SQL = {name: sql for name, sql in ORACLE_SQL.items() if sql}
