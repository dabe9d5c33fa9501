"""Steps whose work must not grow faster than their input, each against its plain definition."""

from pyspark.sql import functions as F

from vulnsift.functions import text as T
from vulnsift.operators import flatten as FL

ODD = ["A  b\tc", "x\u0085y z", "İSTANBUL ΣΑΣ'Σ", "é \U0001d400 \U0001f600!", "-._@/:", "!!!", " ", "", None, "a" * 499, "a" * 500 + "!", "b!" * 300,
       "\x1c\x1f\x00\x7f", "Straße #1, ²³ ٣"]


def _two_steps(c):
    s = F.regexp_replace(F.coalesce(c, F.lit("")), T.CLEAN_DROP, " ")
    return F.trim(F.lower(F.regexp_replace(s, T.SPACE_RUN, " ")))


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_text_is_cleaned_in_one_pass(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    out = df.select(T.clean_text("t").alias("a"), _two_steps(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in out.collect())
    assert _plan(df.select(T.clean_text("t").alias("x"))).count("regexp_replace(") == 1


def test_documents_equal_those_of_values_cleaned_one_by_one(spark):
    one = lambda e: F.transform(e, lambda x: F.struct(x["key"].alias("key"), _two_steps(x["value"]).alias("value")))
    df = spark.createDataFrame([([(f"K_{i} é!", t) for i, t in enumerate(ODD) if t is not None][k:],) for k in range(len(ODD))], f"e {FL.ENTRY_TYPE}")
    short = F.filter(one(F.col("e")), lambda x: (x["value"] != "") & (F.length(x["value"]) <= FL.MAX_VALUE_LEN))
    rest = F.filter(one(F.col("e")), lambda x: (x["value"] != "") & (F.length(x["value"]) < FL.MAX_VALUE_LEN))
    out = df.select(FL.basic_document(F.col("e")).alias("a"), _two_steps(FL._join_entries(short)).alias("b"),
                    _two_steps(FL.rest_section(F.col("e"))).alias("c"), _two_steps(FL._join_entries(rest)).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in out)
    assert _plan(df.select(FL.basic_document(F.col("e")).alias("x"))).count("RLIKE")               # most values are tested, not rewritten


def test_a_feed_item_is_parsed_once(spark, tmp_path):
    from vulnsift.sources.feed import read_feed
    (tmp_path / "a.json").write_text('{"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": "CVE-1"}}, "x": null}, {"cve": 5}]}')
    df = FL.sparse_documents(read_feed(spark, str(tmp_path)), mode="basic")
    assert [(r.id_cve, r.documents) for r in df.collect()] == [("cve-1", "cve cve_data_meta id cve-1 x none")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_weights_of_a_model_are_constants(spark):
    from vulnsift.operators.tfidf_model import VocabularyTfidfModel
    model = VocabularyTfidfModel(3, [1, 0])
    model._set(vocabulary=["ab", "cd ef"], inputCol="d", outputCol="w")
    df = spark.createDataFrame([("cd ef ab ab",), ("x",), (None,)], "d string").repartition(1)
    out = model.transform(df)
    assert [[(e.term, e.term_index, e.tf) for e in r.w] for r in out.collect()].count([("ab", 0, 2), ("cd ef", 1, 1)]) == 1
    assert "ln(" not in _plan(out).lower()


def test_copies_of_a_query_leave_in_small_batches():
    import numpy as np
    import pyarrow as pa

    from vulnsift.operators import pivot_knn as P
    blocks, n, dim = 500, 200, 64
    x = np.random.default_rng(1).normal(size=(n, dim))
    cells = P._Cells(P._unit_rows(np.random.default_rng(2).normal(size=(blocks, dim))), np.zeros(blocks), np.full(blocks, 2.0), np.ones(blocks, np.int64),
                     np.arange(blocks), np.ones(blocks, np.int64))
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(list(x)), pa.array(np.full(n, 2.0))], ["q1", "q2", "qvec", "bound"])

    class Held:
        value = cells
    sent = list(P._sender(Held, 1, True)(iter([b])))
    assert sum(s.num_rows for s in sent) == n * (blocks - 2)
    assert max(s.num_rows * dim * 8 for s in sent) <= 4 << 20
    assert sum(sum(s.column(5).to_pylist()) for s in sent) == n * (blocks - 2)


def test_saving_documents_makes_them_for_the_file_and_the_first_rows_only(spark, tmp_path):
    from vulnsift.sinks.csv import save_documents
    from vulnsift.sources.feed import adv_items
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def document(pos):
        made.add(1)
        return f"text {pos} " * 60

    keys = [None, 5, 1, 9, 1, *range(20, 400)]
    df = spark.createDataFrame([(k, f"id{i}") for i, k in enumerate(keys)], "pos long, id_cve string").repartition(4).withColumn("documents", document("pos"))
    shown = save_documents(df, str(tmp_path / "a"), compression="gzip")
    assert made.value == len(keys)                                                             # not yet for the preview
    assert sorted(r.id_cve for r in shown.collect()) == ["id0", "id2", "id4"] and all(r.preview.endswith("...") for r in shown.collect())
    assert made.value < len(keys) + 20
    rows = spark.read.option("header", True).csv(str(tmp_path / "a")).collect()
    assert sorted(r.id_cve for r in rows) == sorted(f"id{i}" for i in range(len(keys))) and list((tmp_path / "a").glob("part-*.gz"))
    assert save_documents(df.where("pos > 1000"), str(tmp_path / "b")) is None and not (tmp_path / "b").exists()
    assert [r.id_cve for r in save_documents(df.where("pos IS NULL"), str(tmp_path / "c")).collect()] == ["id0"]
    docs = FL.sparse_documents(adv_items(spark, "/root/testdata/sf0.001"))
    assert "collect_list" not in docs.select("id_cve")._jdf.queryExecution().optimizedPlan().toString()
