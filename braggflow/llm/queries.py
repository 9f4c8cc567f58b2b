"""The numbered queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braggflow.llm import bpe, chat, decontam, divergence, licenses, line_dedup, metric_join, near_dedup, oracles, periodic, quality, token_counts, token_io, url_filter
from braggflow.llm.common import literal_table, table

#: A conversation whose texts spell the template's own marks.
FORGED = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = literal_table(spark, [(-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED)], "conv_id long, turn long, role string, text string")
    messages = chat.fold(chat.streamed_events(rows.unionByName(forged)), message=["turn", "tie"])
    back = chat.read_back(chat.render(messages, block=512))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(table(spark, sf_dir, "documents"), where, pattern, decoded=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    counts = token_counts.count(table(spark, sf_dir, "documents"), where, pattern)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated(found).alias("contaminated"),
    )


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_dir = token_io.scratch_dir(docs)
    manifest = token_io.write(docs, public_tokenizers.path("word_bpe_49k.json"), out_dir)
    return token_io.read(manifest, out_dir).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.withColumn("removed_lines", F.array_join("removed", ",")).drop("removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_lines", "n_dropped", "text")


#: The rules that the url contract names (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_table(spark, URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


_ESC = r"replace(replace(replace({0}, '\', '\e'), '###', '\h'), '</turn>', '\t')"
_ROLE = "replace(replace(replace(replace(replace({0}, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23'), chr(10), '%0A')"
_OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{FORGED}'), (-7, 1, 'assistant', '{FORGED}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length({_ROLE.format('role')}) + length({_ESC.format('text')}) + 14) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""

_URL_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_OP9_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_URL_VALUES}),
rest AS (SELECT row_number() OVER () AS n, page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT n, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC, r_verdict DESC, r_host || r_path DESC) AS k
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (n)"""

def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents")).drop("text_key")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.join(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one of ten documents, by the crc of its id, all words from some word on repeat the first ones of them."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p))))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    new = F.transform(F.array(words), planted)[0]  # the words are bound once, not split again for each place
    return docs.select("doc_id", F.when(F.pmod(crc, F.lit(10)) == 0, new).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("top", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_token_binary": op6_token_binary,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_near_dedup": op10_near_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op1_chat_format": _OP1_SQL,
    "op5_decontamination": oracles.OP5,
    "op7_quality_rules": oracles.OP7,
    "op9_url_filter": _OP9_SQL,
    "op12_source_divergence": oracles.OP12,
}
