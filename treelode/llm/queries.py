"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.llm import (
    chat, decontaminate, jaccard, langid, linededup, packing, quality, resample, suffixdedup, tokencount, topk, warc, whiten,
)
from treelode.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return pieces.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixdedup.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.deduplicate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_decontamination, op3_quality, op4_suffix_dedup, op5_jaccard_join, op6_topk, op7_warc, op8_chat,
        op9_token_counts, op10_language_id, op11_line_dedup, op12_resampling, op13_whitening, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op6_topk": """
        WITH v AS (
          SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                 CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.c, d.c)]) AS BIGINT) AS score
          FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
        k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN keeper IS NULL OR keeper = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keeper IS DISTINCT FROM d.page_id THEN keeper END AS refers_to
        FROM d LEFT JOIN k ON d.digest = k.digest AND n >= 1000
    """,
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
        k AS (
          SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), f AS (
          SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), m AS (SELECT k.*, holder IS NOT NULL AND doc_id <> holder AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r
    """,
    "op12_resampling": r"""
        WITH tab AS (
          SELECT [list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                  FOR i IN range(256)] AS tab
        ), texts AS (
          SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents
          UNION ALL SELECT row_number() OVER (), NULL, text, true FROM benchmark
        ), w AS (
          SELECT r, doc_id, target, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM texts
        ), f AS (
          SELECT r, target, unnest(words || [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS feature FROM w
        ), n AS (SELECT target, r, feature, count(*) AS n FROM f GROUP BY ALL),
        h AS (SELECT DISTINCT feature, hex(encode(feature)) AS code FROM n),
        b AS (
          SELECT feature, xor(list_reduce(
            [4294967295] || [CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(code) // 2)],
            lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
          FROM h, tab
        ), c AS (
          SELECT bucket, sum(n) FILTER (NOT target) AS s, sum(n) FILTER (target) AS t FROM n JOIN b USING (feature) GROUP BY bucket
        ), g AS (
          SELECT bucket, CAST(floor(1000 * ln(
            (coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE
            / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE))) AS BIGINT) AS gain
          FROM c
        ), p AS (
          SELECT r, sum(n)::BIGINT AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight
          FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE NOT target GROUP BY r
        ), x AS (
          SELECT w.r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
          FROM w LEFT JOIN p USING (r) WHERE NOT target
        ), y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM y)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_words >= 20 AND place <= (SELECT count(*) FROM y WHERE n_words >= 20) * 25 // 100 THEN place END AS rank
        FROM z
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
          FROM documents
        ), s AS (
          SELECT doc_id, list_sort(list_distinct(CASE
            WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END)) AS sh
          FROM w
        ), d AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) END AS key, sh FROM s),
        u AS (SELECT key, min(doc_id) AS head, any_value(n) AS n, any_value(sh) AS sh FROM d WHERE key IS NOT NULL GROUP BY key),
        x AS (SELECT key, n, unnest(sh) AS g FROM u),
        p AS (
          SELECT a.key AS a, b.key AS b FROM x a JOIN x b ON a.g = b.g AND a.key < b.key GROUP BY a.key, b.key, a.n, b.n
          HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        reach(key, other) AS (SELECT key, key FROM u UNION SELECT r.key, e.b FROM reach r JOIN e ON e.a = r.other),
        c AS (SELECT reach.key, min(u.head) AS component_id FROM reach JOIN u ON u.key = reach.other GROUP BY reach.key)
        SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN c USING (key)
    """,
}
