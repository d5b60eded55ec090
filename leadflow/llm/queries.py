"""Registered queries of the operators; each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm import langid, mixing, quality
from leadflow.llm.common import fold, read
from leadflow.llm.decontaminate import decontamination_report
from leadflow.llm.embeddings import embedding_groups
from leadflow.llm.filters import filter_audit
from leadflow.llm.infill import fill_in_middle, restored
from leadflow.llm.pii import pii_report
from leadflow.llm.pitman_yor import lm_scores
from leadflow.llm.repetition import repetition
from leadflow.llm.simhash import simhash_groups
from leadflow.llm.substrings import repeats_report
from leadflow.llm.tokens import token_files


#: Token shares that mixing aims at; ``labels`` says which documents are of which domain.
MIX = {"good": 0.9, "low": 0.07, "toxic": 0.03}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): good, low or toxic, from the labels; rows with neither mark known are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return read(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")).where("domain is not null")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    model = quality.train_on(docs.where(~F.col("held_out")).select("doc_id", "text"), labels)
    ids = docs.select(F.struct("doc_id", "held_out").alias("key"), "text")
    found = quality.score(ids, model, "key").select("key.doc_id", "key.held_out", "score")
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    network = langid.train(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    ids = docs.select(F.struct("doc_id", "held_out").alias("key"), "text")
    return langid.predict(ids, network, "key").select("key.doc_id", "key.held_out", "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), MIX)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 7) == 2))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(read(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(read(spark, sf_dir, "documents"), length=200)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"), width=3, radius=2)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read(spark, sf_dir, "documents")).drop("spans")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    output, form = F.col("output"), F.col("form")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(output.cast("binary"), 256).alias("output_sha256"), F.sha2(restored(output, form).cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_decontaminate": op3_decontaminate,
    "op4_tokens": op4_tokens,
    "op5_mixing": op5_mixing,
    "op6_language_model": op6_language_model,
    "op7_pii": op7_pii,
    "op8_substrings": op8_substrings,
    "op9_simhash": op9_simhash,
    "op10_embeddings": op10_embeddings,
    "op11_filter_audit": op11_filter_audit,
    "op12_repetition": op12_repetition,
    "op13_infill": op13_infill,
}

#: Words of a text, as the decontamination contract states them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
grams AS (
    SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS gram, least(len(w), 10) AS n
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM grams),
places AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), hits AS (SELECT p.r, p.i, p.n, g.item FROM places p JOIN grams g ON g.gram = p.gram AND g.n = p.n),
words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""",
    "op10_embeddings": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
    c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
""",
    "op11_filter_audit": """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
marked AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
judged AS (
    SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
        {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
         'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
         'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, false)} AS f
    FROM worded d JOIN firsts USING (t) LEFT JOIN marked USING (doc_id)
), sets AS (
    SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
        CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM judged GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step:step] AS own, filter_order[1:step - 1] AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), taken AS (
    SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS alone,
        length(translate(fails, earlier, '')) < length(fails) AS gone
    FROM sets, steps
), counted AS (
    SELECT part, filter_order, step, own, CAST(sum(CASE WHEN gone OR hit THEN 0 ELSE n END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM taken GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
""",
    "op13_infill": """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', CAST(doc_id AS VARCHAR))) AS h,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
    FROM documents
), drawn AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM texts
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), pieces AS (
    SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(u[b + 1:n], ''), '') AS s
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
        ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM pieces
""",
}
