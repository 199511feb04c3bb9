"""The queries of the pipeline operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, exact_dedup, html_extract, mixing, neardup, packing, quality, secret_scan, topk, warc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(rows))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(_table(spark, sf_dir, "documents"), keep="largest")
    each = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))  # a row per row, repeated ones too
    return each.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_exact_top_k, op3_ngram_jaccard_join, op4_quality_classifier, op5_secret_scans, op6_chat_formatting, op7_warc, op8_mixing, op9_exact_dedup, op10_packing)
}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # all pairs, exactly, for ids that don't repeat
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS w FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '\S')),
        k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w),
        sets AS (SELECT doc_id, list_sort(list(DISTINCT array_to_string(w[k : k + 4], ' '))) AS s FROM k GROUP BY doc_id),
        reps AS (SELECT s, min(doc_id) AS r, count(*) AS copies, len(s) AS n FROM sets GROUP BY s),
        each AS (SELECT r, n, unnest(s) AS x FROM reps),
        ranked AS (SELECT r, n, x, row_number() OVER (PARTITION BY r ORDER BY f, x) AS place FROM each JOIN (SELECT x, count(*) AS f FROM each GROUP BY x) USING (x)),
        -- sets at 0.8 share one of the rarest n - ceil(0.8 n) + 1 of their shingles
        rare AS (SELECT r, n, x FROM ranked WHERE place <= n - (4 * n + 4) // 5 + 1),
        near AS (SELECT DISTINCT a.r AS a, b.r AS b FROM rare a JOIN rare b ON a.x = b.x AND a.r < b.r AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        met AS (SELECT a, b, any_value(p.n) + any_value(q.n) AS n, count(*) AS common FROM near JOIN each p ON p.r = a JOIN each q ON q.r = b AND q.x = p.x GROUP BY a, b),
        pairs AS (SELECT a, b FROM met WHERE 5 * common >= 4 * (n - common)),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(a, b) AS (SELECT r, r FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        class AS (SELECT a AS r, min(b) AS class_id FROM reach GROUP BY a),
        counted AS (SELECT a AS r, sum(copies) AS others FROM links JOIN reps ON reps.r = links.b GROUP BY a)
        SELECT d.doc_id::BIGINT AS doc_id, coalesce(class_id, d.doc_id)::BIGINT AS class_id, coalesce(others + copies - 1, copies - 1, 0)::BIGINT AS n_links, coalesce(r, d.doc_id)::BIGINT AS set_id
        FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (s) LEFT JOIN class USING (r) LEFT JOIN counted USING (r)""",
    "op6_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\p') AS t, replace(replace(replace(role, '\', '\\'), '<|', '<\p'), chr(10), '\n') AS r FROM c)
        SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(r) + length(t) + 17)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    # SHA-1 in base32: every five hexadecimal digits are four of its letters
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT *, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p),
        r AS (SELECT *, keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS revisit FROM d)
        SELECT page_id::BIGINT AS page_id, octet_length(payload)::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (k // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN keeper END::BIGINT AS refers_to FROM r""",
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_A}', '{_Z}') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
}
