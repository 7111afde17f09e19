"""One query per training-data operator, over whole tables, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import byte_bpe, conversation_repair, fill_middle, html_blocks, language_id, minhash_dedup, mixing, nbest_pieces, quality_rules, site_quality, suffix_dedup, url_filters, vector_dedup
from kindred.llm.common import table
from kindred.session import materialise

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.in_training_order(mixing.plan(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"), minhash_dedup.Join(shingle=2))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nbest_pieces.encode(table(spark, sf_dir, "documents"), best=4)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "scores", F.xxhash64("ids").alias("ids_hash"),
        F.xxhash64("changes").alias("changes_hash"), "decoded",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows lost, emptied, without sentence ends, repeated or given to the user, as a checksum of id and turn says."""
    turn, blank = F.col("turn").cast("long"), F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    kind, text = F.crc32(place) % 20, F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id", turn.alias("turn"), kind.alias("kind"), F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).drop("kind", "copy")


def _sha256_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``role:text`` of the rows of each conversation, which follow each other, joined by line feeds and hashed as they come."""
    conv, state = None, None
    for batch in batches:
        found = []
        for new, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            line = f"{role}:{text}".encode()
            if state is None or new != conv:
                if state is not None:
                    found.append((conv, state.hexdigest()))
                conv, state = new, hashlib.sha256(line)
            else:
                state.update(b"\n" + line)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string()))], ["c", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["c", "sha"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    plans = materialise(conversation_repair.plan(rows), "plans")
    hashes = conversation_repair.apply(rows, plans).mapInArrow(_sha256_of_rows, "c long, sha string")
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        every.join(plans, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        .join(hashes, F.col("id").eqNullSafe(F.col("c")), "left")
        .select(
            F.col("id").alias("conv_id"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"))
    decoder = byte_bpe.decoder(spark)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both hashes, in the task that decodes: ids as little-endian unsigned 32-bit integers."""
        for batch in decoder(batches):
            ids = [hashlib.sha256(found.values.to_numpy().astype("<u4").tobytes()).hexdigest() for found in batch.column("ids")]
            data = [hashlib.sha256(found.as_buffer()).hexdigest() for found in batch.column("data")]
            columns = [batch.column("doc_id"), batch.column("ids").value_lengths().cast(pa.int64()), pa.array(ids), pa.array(data)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")
    )


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_mixing, op4_html_blocks, op5_site_quality, op6_minhash_dedup, op7_vector_dedup, op8_language_id, op9_suffix_dedup, op10_nbest_pieces, op11_conversation_repair, op12_byte_bpe, op13_fill_middle)}
#: The general rules of op2 concern files and pages that the default would let pass; their verdict is in the SQL as well.
ORACLES: dict[str, str] = {
    "op2_url_filters": r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
              WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(path, '[.](exe|zip|gz|iso|mp3|mp4|jpg|jpeg|png|gif|css|js)$') OR regexp_matches(path, '/(login|signin|logout|cart|checkout)$')
              OR (path LIKE '/%' AND (regexp_matches('.' || host, '[.]adserver[.]') OR ('.' || host) LIKE '.ads.%')) THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
""",
    "op13_fill_middle": """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, n,
         ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, text, n, form, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
         substring(text, 1, least(a, b)) AS prefix, substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle,
         substring(text, greatest(a, b) + 1) AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
}
