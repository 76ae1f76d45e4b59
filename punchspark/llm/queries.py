"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchspark.llm import language_model, quality, toxicity
from punchspark.llm.bpe import encode
from punchspark.llm.decontaminate import decontaminate
from punchspark.llm.exact_dedup import exact_dedup
from punchspark.llm.importance import resample
from punchspark.llm.line_dedup import line_dedup
from punchspark.llm.near_dedup import near_dedup
from punchspark.llm.prefix_trie import prefix_trie
from punchspark.llm.sharding import shard
from punchspark.llm.suffix_dedup import suffix_dedup
from punchspark.llm.warc import archive

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity.tag(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    return done.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        score.alias("score"),
        (score >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("toxicity.spans").cast("long").alias("n_spans"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digest=True)
    return done.withColumnRenamed("id", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = quality.classify(docs.select(*quality.COLUMNS), quality.train(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", toxicity.held_out().alias("held_out"), "quality.text_score", "quality.meta_score", "quality.score", "quality.kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).nodes.drop("k1", "k2")


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = language_model.score(docs, language_model.train(docs.where(~language_model.held_out())))
    return done.select(F.col("id").alias("doc_id"), language_model.held_out("id").alias("held_out"), *language_model.SCORES)


REGISTRY = {
    "op1_toxicity_crf": op1_toxicity_crf,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_cotraining": op9_quality_cotraining,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_kneser_ney": op13_kneser_ney,
}

def _crc_step(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ 0xEDB88320 * (value & 1)
    return value


def _crc_sql(name: str, source: str) -> str:
    """A recursive table ``name`` (x, crc) with the CRC-32 of each text x of ``source``, byte by byte."""
    steps = ", ".join(str(_crc_step(b)) for b in range(256))
    byte = "('0x' || substr(h, 2 * done + 1, 2))::BIGINT"
    return f"""
        {name}_state AS (
            SELECT x, hex(encode(x)) AS h, 0 AS done, 4294967295::BIGINT AS c FROM {source}
            UNION ALL
            SELECT x, h, done + 1, xor(c >> 8, ([{steps}]::BIGINT[])[xor(c & 255, {byte}) + 1]) FROM {name}_state WHERE 2 * done < length(h)
        ),
        {name} AS (SELECT x, xor(c, 4294967295) AS crc FROM {name}_state WHERE 2 * done = length(h))"""


def _words_sql(table: str, key: str) -> str:
    """(key, w): the lower-cased words of each row."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all(regexp_replace({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM {table}"


def _grams_sql(words: str) -> str:
    """(key, x): the words of each row and its pairs of neighbours."""
    return f"""SELECT key, unnest(w) AS x FROM {words} WHERE len(w) > 0
            UNION ALL
            SELECT key, w[s] || ' ' || w[s + 1] FROM (SELECT key, w, unnest(range(1, len(w))) AS s FROM {words} WHERE len(w) > 1)"""


ORACLES = {
    "op11_importance_resampling": f"""
        WITH RECURSIVE d AS MATERIALIZED ({_words_sql("documents", "doc_id, row_number() OVER () AS key")}),
        b AS MATERIALIZED ({_words_sql("benchmark", "row_number() OVER () AS key")}),
        dg AS MATERIALIZED ({_grams_sql("d")}),
        bg AS MATERIALIZED ({_grams_sql("b")}),
        grams AS MATERIALIZED (SELECT DISTINCT x FROM (SELECT x FROM dg UNION ALL SELECT x FROM bg)),
        {_crc_sql("crcs", "grams")},
        cells AS MATERIALIZED (SELECT x, crc % 10000 AS cell FROM crcs),
        s AS (SELECT cell, count(*) AS n FROM dg JOIN cells USING (x) GROUP BY cell),
        t AS (SELECT cell, count(*) AS n FROM bg JOIN cells USING (x) GROUP BY cell),
        gains AS MATERIALIZED (
            SELECT s.cell, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dg) + 10000)
                / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bg) + 10000))))::BIGINT AS gain
            FROM s LEFT JOIN t ON t.cell = s.cell
        ),
        weights AS (SELECT key, count(*) AS n, sum(gain) AS total FROM dg JOIN cells USING (x) JOIN gains USING (cell) GROUP BY key),
        scored AS (
            SELECT d.key, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
                floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
            FROM d LEFT JOIN weights USING (key)
        ),
        ranked AS (
            SELECT key, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS drawn
            FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= drawn THEN rank END AS rank
        FROM scored LEFT JOIN ranked USING (key)
    """,
    "op12_prefix_trie": f"""
        WITH RECURSIVE own AS MATERIALIZED (
            SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
            FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                    strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)
        ),
        sizes AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, conv_id::VARCHAR AS x, count(*) AS n FROM own GROUP BY conv_id),
        {_crc_sql("crcs", "sizes")},
        heads AS MATERIALIZED (
            SELECT sizes.conv_id, sizes.base, crc % 9 AS h, least(crc % 9, coalesce(b.n, 0)) AS taken
            FROM sizes JOIN crcs USING (x) LEFT JOIN sizes b ON b.conv_id = sizes.base
        ),
        rebuilt AS MATERIALIZED (
            SELECT heads.conv_id, pos AS depth, digest, bytes FROM heads JOIN own ON own.conv_id = base AND pos <= h
            UNION ALL
            SELECT heads.conv_id, pos - h + taken, digest, bytes FROM heads JOIN own ON own.conv_id = heads.conv_id AND pos > h
        ),
        paths AS MATERIALIZED (
            SELECT conv_id, depth, bytes, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM rebuilt
            UNION ALL
            SELECT conv_id, 0, 0, '' FROM sizes
        ),
        lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
        nodes AS MATERIALIZED (
            SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
            FROM paths JOIN lengths USING (conv_id) GROUP BY depth, path
        ),
        up AS MATERIALIZED (SELECT n.depth, n.path, p.path AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
        kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM up GROUP BY ALL),
        below AS (
            SELECT p.depth, p.path, sum(n.own) AS saved, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
            FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth
            GROUP BY p.depth, p.path
        )
        SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves,
            saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below ON below.depth = n.depth AND below.path = n.path LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
        LEFT JOIN up ON up.depth = n.depth AND up.path = n.path LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.path = up.parent
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (
            SELECT page_id, payload, max(page_id) OVER (PARTITION BY payload) AS best,
                   [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       (((('0x' || substr(h, 5 * (i // 4)::INTEGER + 1, 5))::INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1) FOR i IN range(32)] AS symbols
            FROM p
        )
        SELECT page_id, strlen(payload) AS payload_bytes, array_to_string(symbols, '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM b
    """,
    "op8_exact_dedup": """
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
    """,
    "op10_decontamination": """
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(regexp_replace(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
        ), bw AS (
            SELECT item_id, regexp_extract_all(regexp_replace(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS w
            FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
        ), g AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM g),
        d AS (
            SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)
        ), hits AS (SELECT doc_id, s, g.n, item_id FROM d JOIN g ON d.gram = g.gram AND d.n = g.n),
        marked AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
            FROM hits GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}
