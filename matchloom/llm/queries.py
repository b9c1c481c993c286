"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, sharding, storage, urls, warc
from .lines import line_classes
from .minhash import near_duplicates
from .packing import pack, tokenized_pieces
from .quality import quality_rules

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 1024 tokens."""
    docs = _table(spark, sf_dir, "documents")
    pieces = tokenized_pieces(docs, _tokenizer("byte_bpe_50k.json"), end_id=2, size=1024)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 1024)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules(_table(spark, sf_dir, "documents"))


#: Fixed values of the URL query: its rules, and a site whose pages are listed one by one.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
LISTED_SITE = "spam-farm.example.org"


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; pages of one site stand for a list of single canonical urls."""
    pages = _table(spark, sf_dir, "pages")
    at = urls.host(F.col("url"))
    listed = pages.where((at == LISTED_SITE) | at.endswith("." + LISTED_SITE)).select(
        F.concat(at, urls.path(F.col("url"))).alias("url")
    )
    judged = urls.judge(pages.select("page_id", "url"), urls.rules(spark, URL_RULES), page_list=listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, and of one whose texts are control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    turns = turns.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    path = _tokenizer("byte_bpe_50k.json")
    return chat.read_back(chat.segments(turns, path), path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard if there were one more."""
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    tree = sharding.balanced(16)
    return sharding.shard(docs, tree, more=sharding.grown(tree))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say, read back from them."""
    path = storage.new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    record = warc.read_warc(spark, path)
    return record.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(nullif(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("refers_to"),
    )


def op7_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"), k=10)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their round trip."""
    import public_tokenizers

    path, pattern = _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every line of every document."""
    return line_classes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_rules,
        op3_url_filters,
        op4_chat_formatting,
        op5_sharding,
        op6_warc,
        op7_approximate_nearest_neighbours,
        op8_byte_bpe,
        op9_minhash_near_dedup,
        op10_line_dedup,
    )
}

_URL_RULES_SQL = ", ".join(f"('{e}', '{v}')" for e, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        win AS (
            SELECT r, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS w
            FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM win) WHERE n > 1),
        steps AS (SELECT r, least(3, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 3)) AS step FROM again),
        repeats AS (SELECT r, sum(step) AS n FROM steps GROUP BY r),
        raw AS (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS raw FROM d),
        lines AS (
            SELECT r, host, raw, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words,
                   trim(regexp_replace(regexp_replace(lower(raw), '[1-9]', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS line
            FROM raw),
        dups AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM lines WHERE words > 0 GROUP BY r),
        docs AS (SELECT r, list_sort(list(DISTINCT line)) AS doc FROM lines WHERE line <> '' GROUP BY r),
        hosts AS (SELECT host, least(count(*) * 0.02, 200) AS share FROM d GROUP BY host),
        frequent AS (
            SELECT host, line FROM lines JOIN docs USING (r) JOIN hosts USING (host) WHERE line <> ''
            GROUP BY host, line, share HAVING count(DISTINCT doc) > greatest(20, share)),
        gone AS (SELECT r, sum(words) AS n FROM lines JOIN frequent USING (host, line) GROUP BY r),
        counts AS (
            SELECT d.doc_id, len(ws) AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
                   CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS words_removed
            FROM d LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, words_removed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - words_removed >= 0.3 * n_words AS kept
        FROM counts""",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS response FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response THEN response END AS refers_to
        FROM m""",
    "op3_url_filters": rf"""
        WITH parts AS (
            SELECT page_id, url,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        rules AS (
            SELECT entry, verdict, split_part(entry, '/', 1) AS at, substring(entry, strpos(entry, '/')) AS start
            FROM (VALUES {_URL_RULES_SQL}) AS r(entry, verdict)),
        fits AS (
            SELECT p.host, p.path, max_by(r.entry, length(r.entry)) AS rule, max_by(r.verdict, length(r.entry)) AS kind
            FROM (SELECT DISTINCT host, path FROM parts) AS p
            JOIN rules AS r ON (p.host = r.at OR ends_with(p.host, '.' || r.at)) AND starts_with(p.path, r.start)
            GROUP BY ALL)
        SELECT page_id, host, path, rule,
               coalesce(kind, CASE WHEN host = '{LISTED_SITE}' OR ends_with(host, '.{LISTED_SITE}')
                                   THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN fits USING (host, path)""",
}
