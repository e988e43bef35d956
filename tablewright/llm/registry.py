"""The dealt operators as named queries, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import chat, decontaminate, exact_dedup, html_text, importance, mixing, near_dup, quality_rules, secrets, suffix_dedup, token_files, toxicity, whitening
from tablewright.llm.common import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op2_decontamination", r"""
    WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
    iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, row_number() OVER () AS ir FROM benchmark WHERE text IS NOT NULL),
    it AS (SELECT item_id, ir, w, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
    ish AS (SELECT DISTINCT item_id, ir, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM it)),
    ks AS (SELECT DISTINCT k FROM it),
    dsh AS (SELECT DISTINCT doc_id, r, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT doc_id, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)),
    n AS (SELECT ir, count(*) AS n FROM ish GROUP BY ir),
    m AS (SELECT doc_id, r, ish.item_id, ish.ir, count(*) AS c FROM dsh JOIN ish USING (k, s) GROUP BY ALL)
    SELECT doc_id, item_id, CAST(c AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS n_item, c / n AS containment
    FROM m JOIN n USING (ir) WHERE c >= 0.8 * n - 1e-9""")
def op2(spark, d):
    """Pairs of a document and a benchmark item of which it holds 80 % of the five-word shingles."""
    return decontaminate.find(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op5_mixing")
def op5(spark, d):
    """The mix of all documents: what each source is to give and what each document gives."""
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_secrets")
def op6(spark, d):
    """Secrets in every document, by pattern and by model."""
    s = secrets.scan(table(spark, d, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("found").alias("spans"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_toxicity")
def op3(spark, d):
    """Toxicity score of every document."""
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


@query("op7_token_files")
def op7(spark, d):
    """Token ids of every document, written and read back."""
    return token_files.round_trip(table(spark, d, "documents"), tokenizer_path())


@query("op8_chat")
def op8(spark, d):
    """Formatted conversations, and one whose texts hold control strings, read back."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), hard)
    return chat.digests(staged(chat.format_turns(turns.union(own)), "chat"))


@query("op10_quality_rules")
def op10(spark, d):
    """Measures of every document and the verdict of the cascade."""
    return quality_rules.cascade(table(spark, d, "documents"), measures=True).drop("rejected_by")


@query("op4_near_dup")
def op4(spark, d):
    """Classes of near duplicates over three-word shingles at 85 %."""
    return near_dup.near_duplicates(table(spark, d, "documents"), width=3, percent=85)


@query("op1_html_text")
def op1(spark, d):
    """Main text of every page."""
    return html_text.extract(table(spark, d, "pages"))


@query("op9_suffix_dedup")
def op9(spark, d):
    """What is left of every document without repeated strings of 50 bytes."""
    return suffix_dedup.deduplicate(table(spark, d, "documents"))


@query("op13_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)""")
def op13(spark, d):
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.deduplicate(table(spark, d, "documents"))


@query("op12_importance", r"""
    WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                 lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
    words AS (SELECT 0 AS side, r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM (SELECT *, row_number() OVER () AS r FROM documents)
              UNION ALL SELECT 1, 0, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
    codes AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex(w)) // 2), lambda i: CAST('0x' || substring(hex(w), 2 * i + 1, 2) AS BIGINT))),
                 lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
              FROM (SELECT DISTINCT w FROM words), tab),
    held AS (SELECT side, r, bucket FROM words JOIN codes USING (w)),
    sums AS (SELECT b.bucket, coalesce(sum(1 - side), 0) AS s, coalesce(sum(side), 0) AS t FROM range(10000) AS b(bucket) LEFT JOIN held USING (bucket) GROUP BY ALL),
    gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000)
                 / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM sums),
    weights AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM held JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
    scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                 (CAST(CAST('0x' || substring(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
               FROM (SELECT doc_id, row_number() OVER () AS r FROM documents) LEFT JOIN weights USING (r)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM ranked""")
def op12(spark, d):
    """Weight, score and rank of every document in a draw that looks like the benchmark."""
    return importance.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op11_whitening")
def op11(spark, d):
    """The four leading whitened coordinates of every embedding."""
    x = whitening.whole(table(spark, d, "embeddings"))
    out = whitening.whiten(x, whitening.fit(x, components=4))
    return out.withColumn("deviation", F.col("deviation").cast("long")).withColumnRenamed("key", "vec_id")
