"""Text cleaning, token and TF-IDF queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vulnsift.functions import text as T
from vulnsift.operators import tfidf as TF
from vulnsift.operators.sequence import head
from vulnsift.operators.tokens import token_counts, total_tokens, whitespace_tokens
from vulnsift.plans.registry import query
from vulnsift.sources import table

WS_SPLIT_SQL = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{T.SPACE_RUN}'), lambda x: x <> '')"


@query("clean_documents", ops=("X1", "X4", "X5", "W3"), sql=f"""
SELECT doc_id, {T.clean_text_sql('text')} AS clean FROM documents""")
def clean_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean_text("text").alias("clean"))


@query("clean_pages", ops=("X1", "X2"), sql=f"""
SELECT page_id, {T.clean_text_sql('html')} AS clean FROM pages""")
def clean_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.clean_text("html").alias("clean"))


@query("doc_token_counts", ops=("X6", "G6", "X11"), sql=f"""
SELECT doc_id, CAST(len({WS_SPLIT_SQL}) AS BIGINT) AS n_tokens,
       CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def doc_token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n_chars", F.length("text").cast("bigint"))
    return token_counts(d, "doc_id", "text", keep=["n_chars"])


@query("total_tokens", ops=("G7", "U3"), sql=f"""
SELECT CAST(sum(len({WS_SPLIT_SQL})) AS BIGINT) AS n_tokens FROM documents""")
def total_token_count(spark, sf_dir):
    return total_tokens(table(spark, sf_dir, "documents"), "text")


@query("corpus_stats_by_lang", ops=("G8", "G9", "W4", "W5", "X11", "T5"), sql=f"""
WITH c AS (SELECT doc_id, lang, {T.clean_text_sql('text')} AS clean FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM c)
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, round(avg(length(clean)), 6) AS avg_len,
       CAST(count(*) FILTER (WHERE length(clean) > 500) AS BIGINT) AS n_over_500,
       string_agg(CASE WHEN rn <= 3 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS sample_ids
FROM r GROUP BY lang""")
def corpus_stats_by_lang(spark, sf_dir):
    """Document count, mean cleaned length, count over 500 chars and first three ids per
    language. The sample uses ``row_number() <= 3`` (partial WindowGroupLimit before the
    shuffle), never a collected group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", T.clean_text("text").alias("clean"))
    stats = d.groupBy("lang").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
        F.round(F.avg(F.length("clean")), 6).alias("avg_len"),
        F.count(F.when(F.length("clean") > 500, True)).cast("bigint").alias("n_over_500"))
    first3 = d.select("doc_id", "lang").withColumn(
        "rn", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("rn <= 3")
    sample = first3.groupBy("lang").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
        .alias("sample_ids"))
    return stats.join(sample, "lang")


@query("document_preview", ops=("P13", "T1", "T5", "X8"), sql="""
SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id,
       substr(text, 1, 100) || '...' AS preview_100, substr(text, 1, 200) || '...' AS preview_200
FROM documents ORDER BY doc_id LIMIT 10""")
def document_preview(spark, sf_dir):
    """First ten documents, numbered from 1, with 100- and 200-character previews."""
    d = head(table(spark, sf_dir, "documents").select("doc_id", "text"), 10, ["doc_id"])
    return d.select(F.row_number().over(Window.orderBy("doc_id")).cast("bigint").alias("n"), "doc_id",
                    T.preview("text", 100).alias("preview_100"), T.preview("text", 200).alias("preview_200"))


@query("tech_tokens", ops=("N1", "X3", "W7", "W8", "X4"), sql=f"""
SELECT doc_id, array_to_string({T.tech_tokens_sql('text')}, ' ') AS tokens FROM documents""")
def tech_token_query(spark, sf_dir):
    """Tech-term tokenizer over every document; its SQL twin consumes marks where the pattern looks around."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.tech_tokens("text"), " ").alias("tokens"))


@query("tfidf_corpus", ops=("G3", "G4", "G5", "J2", "J3", "N6", "N7", "X13"), sql=f"""
WITH n AS (SELECT count(*) AS n FROM documents),
t AS (SELECT doc_id, unnest({WS_SPLIT_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)
SELECT tf.doc_id, tf.term, CAST(tf.tf AS BIGINT) AS tf, CAST(df.df AS BIGINT) AS df, CAST(df.cf AS BIGINT) AS cf,
       round(log10(n.n / (1.0 + df.df)), 6) AS idf, round(tf.tf * log10(n.n / (1.0 + df.df)), 6) AS tfidf
FROM tf JOIN df USING (term), n""")
def tfidf_corpus(spark, sf_dir):
    """Open-vocabulary TF-IDF of every document: tf * log10(N / (1 + df))."""
    return TF.corpus_tfidf(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("vocabulary_first_seen", ops=("G1", "G2", "T11", "U4"), sql=f"""
WITH t AS (SELECT doc_id, unnest({WS_SPLIT_SQL}) AS term,
                  unnest(range(len({WS_SPLIT_SQL}))) AS pos FROM documents),
f AS (SELECT term, min(struct_pack(d := doc_id, p := pos)) AS f FROM t GROUP BY term)
SELECT term, f.d AS first_doc, CAST(f.p AS BIGINT) AS first_pos,
       CAST(row_number() OVER (ORDER BY f.d, f.p) - 1 AS BIGINT) AS term_id FROM f""")
def vocabulary_first_seen(spark, sf_dir):
    """Distinct white-space terms numbered by first occurrence (doc order, then position)."""
    toks = whitespace_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    v = TF.vocabulary(toks, "doc_id")
    return v.select("term", "first_doc", F.col("first_pos").cast("bigint").alias("first_pos"), "term_id")
