"""Remaining inventory rows: unquoted ``;`` CSV, guarded save with preview, schema-free
flatten with duplicate keys, stop words as an anti-join, processing counters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vulnsift.functions import text as T
from vulnsift.operators.flatten import advanced_document, entry_rows, flatten_item, flatten_json, rest_skip, sparse_documents
from vulnsift.plans.feed import ADVANCED_SQL, ADV_SQL
from vulnsift.plans.registry import query
from vulnsift.session import checkpoint_dir
from vulnsift.sinks.csv import save_documents
from vulnsift.sources.delimited import read_semicolon_unquoted
from vulnsift.sources.feed import ITEM_FIELDS, adv_items, feed_rejects, read_feed
from vulnsift.sources.tables import table


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("part_semicolon_unquoted", ops=("S5",), sql="""
SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type FROM part""")
def part_semicolon_unquoted(spark, sf_dir):
    """``;`` file without quoting (quote characters are data), header row."""
    path = _scratch(spark, "semicolon")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"),
                                            F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    p.write.options(header=True, sep=";", quote="").csv(path)
    r = read_semicolon_unquoted(spark, path, "partkey bigint, name string, brand string, type string")
    return r


@query("sparse_docs_saved_preview", ops=("K2", "K1", "P13", "F15"), sql=f"""
WITH d AS ({ADVANCED_SQL})
SELECT id_cve, substr(documents, 1, 200) || '...' AS preview FROM d ORDER BY pos LIMIT 3""")
def sparse_docs_saved_preview(spark, sf_dir):
    """K2: write the sparse documents (skipped when empty) and show the first three, 200 chars. The documents repeat the same
    words, so the file is gzipped."""
    docs = sparse_documents(adv_items(spark, sf_dir), mode="advanced")
    return save_documents(docs, _scratch(spark, "sparse-docs"), compression="gzip")


@query("events_props_flatten", ops=("F1", "F2", "F16", "X7"), sql="""
SELECT event_id, 'event_type ' || event_type || ' value ' || CAST(value AS VARCHAR) || ' props k '
       || json_extract_string(props, '$.k') AS flat FROM events""")
def events_props_flatten(spark, sf_dir):
    """Typed fields and a schema-free JSON column flattened into one ``key value`` text.
    Malformed JSON gives no entries instead of failing (F16)."""
    e = table(spark, sf_dir, "events")
    entries = F.concat(flatten_item(e, ["event_type", "value"]), flatten_json(F.col("props"), "props"))
    return e.select("event_id", F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit(" "), x["value"])),
                                             " ").alias("flat"))


_SW_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS_EN) + ")"


@query("content_token_counts", ops=("J5", "W8", "X4", "X6"), sql=f"""
WITH t AS (SELECT doc_id, lower(unnest(list_filter(regexp_split_to_array(text, '{T.SPACE_RUN}'),
           lambda x: x <> ''))) AS term FROM documents)
SELECT d.doc_id, CAST(count(t.term) AS BIGINT) AS n_content FROM documents d
LEFT JOIN t ON t.doc_id = d.doc_id AND t.term NOT IN {_SW_SQL} GROUP BY d.doc_id""")
def content_token_counts(spark, sf_dir):
    """Lower-cased white-space tokens minus stop words (a broadcast join with the fixed 179-word list), counted
    per document; a document without any other word counts 0."""
    d = table(spark, sf_dir, "documents")
    toks = d.select("doc_id", F.explode_outer(F.transform(T.split_ws("text"), lambda t: F.lower(t))).alias("term"))
    sw = spark.createDataFrame([(w, True) for w in T.STOP_WORDS_EN], "term string, stop boolean")
    marked = toks.join(F.broadcast(sw), "term", "left")
    return marked.groupBy("doc_id").agg(
        F.count(F.when(F.col("stop").isNull(), F.col("term"))).cast("bigint").alias("n_content"))


@query("feed_processing_stats", ops=("G12", "G8", "G9", "W1", "W2"), sql=f"""
WITH {ADV_SQL}, d AS ({ADVANCED_SQL.replace('WITH ' + ADV_SQL + ',', 'WITH ' + ADV_SQL + ',', 1)})
SELECT (SELECT count(*) FROM adv_o) AS n_items, (SELECT count(*) FROM d) AS n_documents,
       (SELECT round(avg(length(documents)), 6) FROM d) AS avg_doc_len""")
def feed_processing_stats(spark, sf_dir):
    """Items found, documents produced and mean document length, from one aggregate over the
    items (reliable under task retries)."""
    items = adv_items(spark, sf_dir)
    entries = flatten_item(items, [f for f in ITEM_FIELDS if f in items.columns], skip=rest_skip)
    cid = F.col("cve.CVE_data_meta.ID")
    known = cid.isNotNull() & (cid != "unknown")
    doc_len = F.length(advanced_document(entries))
    return items.agg(F.count(F.lit(1)).cast("bigint").alias("n_items"),
                     F.count(F.when(known, True)).cast("bigint").alias("n_documents"),
                     F.round(F.avg(F.when(known, doc_len)), 6).alias("avg_doc_len"))


def _whole_item():
    """An item with keys no schema declares: nested lists of objects, explicit nulls, and two ways to the key ``a b``."""
    o = F.col
    return F.struct(
        F.struct(F.lit("4.0").alias("data_version"),
                 F.struct(F.concat(F.lit("CVE-"), o("o_orderkey").cast("string")).alias("ID"), F.lit("x@example.com").alias("ASSIGNER"),
                          o("o_orderstatus").alias("STATE")).alias("CVE_data_meta"),
                 F.struct(F.array(F.struct(F.lit("MISC").alias("refsource"), F.array(o("o_orderstatus"), F.lit("T")).alias("tags")))
                          .alias("reference_data")).alias("references")).alias("cve"),
        F.struct(F.struct(F.lit("first").alias("b"), F.lit(True).alias("flag")).alias("a"),
                 F.array(F.struct(o("o_custkey").alias("n"), F.array(F.struct(o("o_orderpriority").alias("p"))).alias("children")))
                 .alias("nodes")).alias("extra"),
        F.lit("last").alias("extra a b"), F.lit(None).cast("string").alias("lastModifiedDate"),
        F.array(F.lit(1), F.lit(2)).alias("numbers"))


def _write_whole(spark, sf_dir: str, name: str, damaged: bool) -> str:
    """The items as feed files of 500 order keys each. ``damaged``: every third file is cut in half, and every
    fiftieth item is no item."""
    path = _scratch(spark, name)
    text = F.to_json(_whole_item(), {"ignoreNullFields": "false"})
    if damaged:
        text = F.when(F.col("o_orderkey") % 50 == 0, F.lit('{"cve": 5}')).otherwise(text)
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("_file"),
                                              F.struct("o_orderkey", text.alias("t")).alias("x"))
    doc = F.concat(F.lit('{"CVE_Items": ['), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ", "), F.lit("]}"))
    files = o.groupBy("_file").agg(doc.alias("value"))
    if damaged:
        files = files.withColumn("value", F.when(F.col("_file") % 3 == 1, F.expr("left(value, cast(length(value) / 2 as int))"))
                                 .otherwise(F.col("value")))
    files.write.partitionBy("_file").text(path)
    return path


@query("feed_whole_items", ops=("S2", "F1", "F2", "F4", "W9"), sql=f"""
SELECT 'cve-' || CAST(o_orderkey AS VARCHAR) AS id_cve, {T.clean_text_sql("""'cve data_version 4.0 cve CVE_data_meta ID CVE-'
  || CAST(o_orderkey AS VARCHAR) || ' cve CVE_data_meta ASSIGNER x@example.com cve CVE_data_meta STATE ' || o_orderstatus
  || ' cve references reference_data_0 refsource MISC cve references reference_data_0 tags ' || o_orderstatus || ' T'
  || ' extra a b last extra a flag True extra nodes_0 n ' || CAST(o_custkey AS VARCHAR)
  || ' extra nodes_0 children_0 p ' || o_orderpriority || ' lastModifiedDate None numbers_0 1 numbers_1 2'""")} AS documents
FROM orders""")
def feed_whole_items(spark, sf_dir):
    """Basic documents of plain JSON feed files whose items have undeclared keys."""
    return sparse_documents(read_feed(spark, _write_whole(spark, sf_dir, "whole", False)), mode="basic").drop("pos")


@query("feed_whole_items_advanced", ops=("S2", "F5", "F8", "F12", "F13", "F15", "W6"), sql=f"""
SELECT 'cve-' || CAST(o_orderkey AS VARCHAR) AS id_cve, {T.clean_text_sql("""'assigner x@example.com reference_tag ' || o_orderstatus
  || ' reference_tag T cve data_version 4.0 cve CVE_data_meta ID CVE-' || CAST(o_orderkey AS VARCHAR)
  || ' cve CVE_data_meta ASSIGNER x@example.com cve CVE_data_meta STATE ' || o_orderstatus || ' extra a b last extra a flag True extra nodes_0 n ' || CAST(o_custkey AS VARCHAR)
  || ' extra nodes_0 children_0 p ' || o_orderpriority || ' lastModifiedDate None numbers_0 1 numbers_1 2'""")} AS documents
FROM orders""")
def feed_whole_items_advanced(spark, sf_dir):
    """Advanced documents of the same files: sections from the declared fields, the rest from the raw item's keys without the (case-
    sensitive) fragments of the sections."""
    return sparse_documents(read_feed(spark, _write_whole(spark, sf_dir, "whole", False)), mode="advanced").drop("pos")


@query("feed_rejects", ops=("F16", "S2"), sql="""
WITH o AS (SELECT o_orderkey // 500 AS f, o_orderkey % 50 = 0 AS bad FROM orders)
SELECT count(DISTINCT CASE WHEN f % 3 = 1 THEN f END) AS bad_files,
       count(*) FILTER (f % 3 <> 1 AND bad) AS bad_items, count(*) FILTER (f % 3 <> 1 AND NOT bad) AS good_items FROM o""")
def feed_rejects_counts(spark, sf_dir):
    """A feed with cut files and malformed items: what is read, and what is reported instead of vanishing."""
    path = _write_whole(spark, sf_dir, "damaged", True)
    bad = feed_rejects(spark, path).select(F.col("reject"), F.lit(1).alias("n"))
    good = read_feed(spark, path).select(F.lit("good").alias("reject"), F.lit(1).alias("n"))
    count = lambda what: F.count(F.when(F.col("reject") == what, 1)).cast("bigint")
    return bad.unionByName(good).agg(count("malformed file").alias("bad_files"), count("malformed item").alias("bad_items"),
                                     count("good").alias("good_items"))


_WHOLE_ENTRIES = [("cve data_version", "'4.0'", "string"), ("cve CVE_data_meta ID", "'CVE-' || CAST(o_orderkey AS VARCHAR)", "string"),
                  ("cve CVE_data_meta ASSIGNER", "'x@example.com'", "string"), ("cve CVE_data_meta STATE", "o_orderstatus", "string"),
                  ("cve references reference_data_0 refsource", "'MISC'", "string"), ("cve references reference_data_0 tags", "o_orderstatus || ' T'", "list"),
                  ("extra a b", "'last'", "string"), ("extra a flag", "'True'", "boolean"), ("extra nodes_0 n", "CAST(o_custkey AS VARCHAR)", "number"),
                  ("extra nodes_0 children_0 p", "o_orderpriority", "string"), ("lastModifiedDate", "'None'", "null"),
                  ("numbers_0", "'1'", "number"), ("numbers_1", "'2'", "number")]


@query("feed_item_entries", ops=("F1", "F2", "F16", "W9", "P4"), sql=" UNION ALL ".join(
    f"SELECT 'order' AS origin, o_orderkey AS id, {i} AS pos, '{k}' AS key, {v} AS value, '{t}' AS kind FROM orders"
    for i, (k, v, t) in enumerate(_WHOLE_ENTRIES)) + """
UNION ALL SELECT 'event', event_id, 0, 'props k', json_extract_string(props, '$.k'), 'number' FROM events""")
def feed_item_entries(spark, sf_dir):
    """Entries of whole raw items and of event properties as rows of a table function, in text order, with run-time types."""
    items = table(spark, sf_dir, "orders").select(F.lit("order").alias("origin"), F.col("o_orderkey").alias("id"),
                                                  F.to_json(_whole_item(), {"ignoreNullFields": "false"}).alias("json"))
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), F.col("props").alias("json"))
    both = entry_rows(items, "json").unionByName(entry_rows(events, "json", "props"))
    return both.select("origin", "id", "pos", "key", "value", "kind")
