"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from emberline.llm import byte_bpe, conversations, exact_dedup, hard_negatives, licenses, line_dedup, packing, quality_model, quality_rules, sharding, simhash, small_world, warc
from emberline.llm.common import table


def op1_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16)


def op2_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks)
    return byte_bpe.decode_documents(encoded, ranks).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_simhash(spark, sf_dir):
    return simhash.mark_near_copies(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.delete_repeated_runs(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # the table has no time of capture: one page a second
    second = F.make_dt_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000)).cast("decimal(18,6)"))
    date = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00'") + second, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    index = warc.archive_and_index(pages, date)
    return index.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op9_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def damaged(turns):
    """The turns with one in five damaged, by a checksum of their place; nulls become one space."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    turns = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(harm == 4, "user").otherwise(F.col("role"))
    return turns.where(harm != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def op11_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    found = conversations.report(conversations.repair_turns(damaged(turns))).withColumnRenamed("conv", "found_id")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    rest = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")]
    return every.join(found, every["conv_id"].eqNullSafe(found["found_id"]), "left").select("conv_id", *counts, *rest)


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_nearest(spark, sf_dir):
    return small_world.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).withColumnRenamed("id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_byte_bpe, op3_simhash, op4_quality_classifier, op5_line_dedup, op6_warc, op7_exact_dedup, op8_quality_rules,
        op9_licenses, op10_packing, op11_conversations, op12_hard_negatives, op13_nearest,
    )
}

SQL = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), line AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM split
        ), worded AS (
            SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM line
        ), placed AS (
            SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
                   sum(words) OVER (PARTITION BY doc_id) AS total
            FROM worded WHERE words > 0
        ), windowed AS (
            SELECT doc_id, pos AS first, before, total, max(pos) OVER frame AS last, list(line) OVER frame AS content
            FROM placed WINDOW frame AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
        ), ranked AS (
            SELECT *, first_value(doc_id) OVER same AS origin, first_value(last) OVER same AS origin_last, row_number() OVER same AS nth
            FROM windowed WHERE before + 50 <= total WINDOW same AS (PARTITION BY content ORDER BY doc_id, first)
        ), later AS (
            SELECT doc_id, CASE WHEN doc_id = origin THEN greatest(first, origin_last + 1) ELSE first END AS first, last FROM ranked WHERE nth > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS pos FROM later WHERE first <= last
        ), island AS (
            SELECT doc_id, min(pos) AS a, max(pos) AS b
            FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g
        ), runs AS (
            SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS runs, sum(b - a + 1)::BIGINT AS n FROM island GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n, 0) AS n_removed, coalesce(runs, '') AS runs,
               CASE WHEN runs IS NULL THEN split.text ELSE coalesce(kept.text, '') END AS text
        FROM split LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op6_warc": """
        WITH body AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        sized AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
            max(page_id) OVER (PARTITION BY html) AS top FROM body)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM sized
    """,
    "op8_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        gram AS (SELECT doc_id, i, struct_pack(a := word, b := lead(word, 1) OVER o, c := lead(word, 2) OVER o) AS g, lead(i, 2) OVER o AS stop
          FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        again AS (SELECT doc_id, i FROM gram WHERE stop IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        repeated AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM again) GROUP BY doc_id),
        line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        loud AS (SELECT doc_id, count(*) AS n FROM word WHERE length(word) > 1 AND word = upper(word) AND word <> lower(word) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
          coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(loud.n, 0) AS shouting
          FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN loud USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT (base_failed OR 10 * n_symbols > n_words OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
            OR (n_dup_lines > 2 AND 2 * n_dup_lines > n_lines) OR 100 * shouting > 50 * n_words) AS kept FROM b
    """,
    "op12_hard_negatives": """
        WITH given AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), scored AS (
            SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM given a JOIN given b ON a.id % 100 = 0 AND a.id <> b.id
        ), positive AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
        QUALIFY row_number() OVER best <= 5
    """,
}
