"""The registered queries of this subpackage, their SQL where SQL can express them, and the columns of their contracts."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_leaks
from .grammar import encode_to_shards, read_shards
from .line_dedup import drop_repeated_lines
from .media import part_of, read_back, sniff_media, texts_to_media
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import score, train
from .secrets import BASE, scan_secrets
from .substring_dedup import drop_repeated_windows
from .url_filter import RULES, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each item that a document holds."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.score", "x.question", "x.answer")


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), 1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as WAV files, declared as what they were and corrected by the sniffer; the payload is what the files' samples hold."""
    media = texts_to_media(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media", F.lit("text/plain").alias("declared"))
    found = read_back(sniff_media(media, declared="declared"))
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    embedded = F.concat_ws("+", F.transform("embedded", lambda x: F.concat(x.kind, F.lit("@"), x.start.cast("string"), F.lit(":"), x.length.cast("string"), F.lit("#"), F.crc32(part_of(F.col("media"), x)).cast("string"))))
    kind = F.concat("media_type", F.when(F.col("corrected"), F.concat(F.lit(" not "), "declared")).otherwise(""))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(kind, F.lit(" "), "feature", F.lit(" embedded="), embedded).alias("feature"),
    )


def op6_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    shards = encode_to_shards(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_shards(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(documents, train(documents, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(F.filter("spans", lambda x: x.kind.isin(*BASE))), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_packing, op4_near_duplicates, op5_media_sniffing, op6_token_ids, op7_quality, op8_line_dedup, op9_substring_dedup, op10_secret_scan)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op1_url_filter": f"""
WITH r AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}) v(verdict, h, p)),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
t AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM t JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT t.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM t LEFT JOIN m USING (page_id)""",
    "op8_line_dedup": f"""
WITH l AS (SELECT doc_id, u.line, u.i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
           LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) u),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
j AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
}
