"""One query per operator on the benchmark tables, and the DuckDB SQL with the same result where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.collocations import collocations
from paylens.llm.hnsw import near_vectors
from paylens.llm.html_text import extract
from paylens.llm.huffman import read_ids, write_ids
from paylens.llm.language import CONFIDENT, address_parts, declared_language, fit_text, identify, visible_text
from paylens.llm.line_frequency import quality_rules
from paylens.llm.minhash import near_duplicates
from paylens.llm.mining import hard_negatives
from paylens.llm.mixing import plan_mix
from paylens.llm.packing import pack
from paylens.llm.substrings import remove_repeated_words
from paylens.llm.suffixes import remove_repeats
from paylens.llm.tables import table
from paylens.llm.toxicity import fit_chain, predict
from paylens.session import ensure_checkpoint_dir


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), with_text=False)


def op2_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"
    )


def op3_page_differencing(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op4_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.expr("coalesce(id = component_id, FALSE)").alias("kept")
    )


def op5_classifier_chain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = fit_chain(docs, table(spark, folder, "labels"))
    return predict(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "is_toxic", F.expr("NOT is_toxic AS kept"))


def op6_hnsw_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), F.expr("coalesce(id = component_id, FALSE)").alias("kept")
    )


def op7_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    read = read_ids(spark, path, as_bytes=True)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_fair_queue_mixing(spark: SparkSession, folder: str) -> DataFrame:
    planned = plan_mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "finish")


def op9_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with their markup and address, and documents with their declared language and source as the host."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    languages, logs = fit_text(docs)
    host, domain, hint = address_parts(F.col("url"))
    none = F.lit(None)
    rows = pages.select(
        none.cast("long").alias("doc_id"), "page_id", host.alias("host"), domain.alias("domain"),
        declared_language(F.col("html")).alias("declared"), hint.alias("hint"), visible_text(F.col("html")).alias("body"),
    ).unionByName(
        docs.select(
            "doc_id", none.cast("long").alias("page_id"), F.col("source").alias("host"), F.lit("documents").alias("domain"),
            F.lower("lang").alias("declared"), none.cast("string").alias("hint"), F.col("text").alias("body"),
        )
    )
    found = identify(rows, languages, logs)
    sure = F.coalesce(F.col("confidence") >= CONFIDENT, F.lit(False))
    return found.select("doc_id", "page_id", "host", "declared", "hint", "text_lang", "lang", "confidence", sure.alias("kept"))


def op10_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(table(spark, folder, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "length", "bucket", "boundary", "batch", "slot", "padding")


def op11_shared_list_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, label=moved)


def op12_misra_gries_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents").select("lang", "text"))


def op13_difference_cover(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_words(table(spark, folder, "documents").select("doc_id", "text"), with_text=False)


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), grams AS (
  SELECT r, i, list_slice(words, i, i + 7) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), twice AS (
  SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) t(k) GROUP BY r
), lines AS (
  SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM w
), worded AS (
  SELECT r, source, text, line,
         regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS norm,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r
), host AS (
  SELECT source, count(DISTINCT text) AS texts FROM w GROUP BY source
), above AS (
  SELECT source, norm FROM worded JOIN host USING (source) GROUP BY source, norm, texts
  HAVING count(DISTINCT text) > 20 AND (count(DISTINCT text) * 100 > texts * 1 OR count(DISTINCT text) > 1000)
), removed AS (
  SELECT r, sum(n) AS n FROM worded JOIN above USING (source, norm) GROUP BY r
), counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT *, base_failed = FALSE AND 100 * (n_words - n_removed_words) >= 25 * n_words AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
"""

OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         md5(concat_ws('|', '8', coalesce(md5(CAST(doc_id AS VARCHAR)), 'null'), coalesce(md5(text), 'null'))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, CAST(source_size AS DOUBLE) * 3 AS ceiling, sum(CAST(source_size AS DOUBLE)) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), t AS (
  SELECT source, rank, source_size, least(ceiling, coalesce(max(CASE WHEN level <= ceiling / weight THEN level END) OVER (), 0) * weight) AS target
  FROM l
), f AS (
  SELECT doc_id, k, size, rank, CAST(source_size AS BIGINT) AS source_size, target,
         CAST(sum(size) OVER (PARTITION BY rank ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, (cum + source_size * i) / target AS finish, i FROM f, range(0, 3) r(i) WHERE target > 0
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, i, k, size ROWS UNBOUNDED PRECEDING) AS upto FROM e
), taken AS (
  SELECT k, rank, cum, count(*) AS copies, min(finish) AS finish FROM o
  WHERE upto <= (SELECT sum(size) FROM d) GROUP BY k, rank, cum
)
SELECT doc_id, size, source_size, target, size * coalesce(copies, 0) AS taken, CAST(coalesce(copies, 0) AS INTEGER) AS copies, finish
FROM f LEFT JOIN taken USING (k, rank, cum)
"""

OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label AS own, e.vec_id AS id, e.label, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON len(a.v) = len(e.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT r, anchor_id, own, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) AS place
  FROM s WHERE label = own AND id IS DISTINCT FROM anchor_id QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY r, place ORDER BY score DESC, id NULLS LAST) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (r) WHERE s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
), total AS (
  SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, range(1, 6) s(size))
), f AS (
  SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, size, phrase, f AS a, k, string_split(phrase, ' ') AS words FROM f, range(1, 5) t(k) WHERE size > 1 AND k < size
), cut AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000 * a * n) // (x.f * y.f) AS score FROM c
  JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(words, 1, k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(words, k + 1, c.size), ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, f AS b, array_to_string(list_slice(string_split(phrase, ' '), i, i + n - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM f, range(2, 5) s(n) WHERE n < size)
), rest AS (
  SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = best.lang AND longer.phrase = best.phrase AND 100 * b >= 100 * a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM rest JOIN total USING (lang) QUALIFY rank <= 2000
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS g
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)
), again AS (
  SELECT r, i FROM win
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) > 1
     AND (first_value(doc_id) OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) IS DISTINCT FROM doc_id
          OR first_value(i) OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) < i)
), gone AS (
  SELECT DISTINCT r, i + k AS pos FROM again, range(0, 20) t(k)
), w AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS words FROM w ANTI JOIN gone USING (r, pos) GROUP BY r
)
SELECT doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_line_frequency": (op2_line_frequency, OP2_SQL),
    "op3_page_differencing": (op3_page_differencing, None),
    "op4_tensored_minhash": (op4_tensored_minhash, None),
    "op5_classifier_chain": (op5_classifier_chain, None),
    "op6_hnsw_neighbours": (op6_hnsw_neighbours, None),
    "op7_huffman_ids": (op7_huffman_ids, None),
    "op8_fair_queue_mixing": (op8_fair_queue_mixing, OP8_SQL),
    "op9_language_fusion": (op9_language_fusion, None),
    "op10_length_buckets": (op10_length_buckets, None),
    "op11_shared_list_negatives": (op11_shared_list_negatives, OP11_SQL),
    "op12_misra_gries_phrases": (op12_misra_gries_phrases, OP12_SQL),
    "op13_difference_cover": (op13_difference_cover, OP13_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
