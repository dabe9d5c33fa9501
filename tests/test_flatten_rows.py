import json

import pytest
from pyspark.sql import functions as F

from vulnsift.operators.flatten import FlattenEntries, entry_rows, flatten_json


def test_rows_equal_the_array_form(spark):
    texts = ['{"z": 1, "a": "x", "m": true, "n": null}', '{"a":{"b":1},"c":2,"a b":3}', '{"l":["x","y"],"e":[],"o":{},"m":["x",1,null,[1,"q"],{"k":[{"v":9.80}]}]}',
             '{"k":1,"k":2}', "not json", None, "{}", "5", json.dumps({"a": {"b": {"c": ["é", "x y"]}}})]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string").repartition(3)
    got = sorted((r.id, r.pos, r.key, r.value) for r in entry_rows(df, "j", "p").collect())
    arrays = df.select("id", F.posexplode(flatten_json(F.col("j"), "p"))).collect()
    assert got == sorted((r.id, r.pos, r.col.key, r.col.value) for r in arrays)
    kinds = {r.key: r.kind for r in entry_rows(df.where("id in (0, 2)"), "j").collect()}
    assert kinds == {"z": "number", "a": "string", "m": "boolean", "n": "null", "l": "list", "m_0": "string", "m_1": "number", "m_2": "null",
                     "m_3": "list", "m_4 k_0 v": "number"}


def test_analyze_decides_columns_and_checks_arguments(spark):
    df = spark.createDataFrame([(1, '{"a": 1}')], "id int, j string")
    assert entry_rows(df, "j", kind=False).columns == ["id", "j", "pos", "key", "value"]
    assert entry_rows(df, "j").columns == ["id", "j", "pos", "key", "value", "kind"]
    with pytest.raises(Exception, match="JSON text"):
        entry_rows(df, "id").collect()


def test_in_sql(spark):
    spark.udtf.register("flatten_entries", F.udtf(FlattenEntries, useArrow=True))
    spark.createDataFrame([(1, '{"a": {"b": "x"}}'), (2, '{"c": 1}')], "id int, j string").createOrReplaceTempView("flat_in")
    rows = spark.sql("SELECT id, e.key, e.value FROM flat_in, LATERAL flatten_entries(j, 'r') e WHERE e.key LIKE 'r%' ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(1, "r a b", "x"), (2, "r c", "1")]
