"""The lookup table against a literal turn-by-turn fill; balance and stability of the placement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnsift.llm import sharding


def literal_fill(names, size):
    orders = []
    for n in names:
        off, step = sharding.preference(n, size)
        orders.append([(off + j * step) % size for j in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    owner, turn = {}, 0
    while len(owner) < size:
        mine = orders[turn % len(names)]
        owner[next(s for s in mine if s not in owner)] = turn % len(names)
        turn += 1
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("n,size", [(1, 2), (1, 13), (3, 13), (7, 101), (16, 251)])
def test_table_equals_literal_fill(n, size):
    names = [f"s{i}" for i in range(n)]
    got = sharding.lookup_table(names, size)
    assert list(got) == literal_fill(names, size)
    counts = np.bincount(got, minlength=n)
    assert counts.max() - counts.min() <= 1


def test_removing_a_shard_moves_little():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    kept = a < 19
    assert (a[kept] != b[kept]).mean() < 0.1


def test_bad_arguments():
    for names, size in (([], 13), (["a", "a"], 13), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, size)


def test_place_keeps_rows_and_columns(spark, tmp_path):
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(1, "x", 9), (1, "y", 9), (None, "z", 9), (2, None, 9)], "doc_id long, text string, Slot int")
    rows = sharding.place(df, "doc_id", names, 101).collect()
    assert len(rows) == 4 and rows[0].asDict().keys() == {"doc_id", "text", "slot", "shard"}
    owner = sharding.lookup_table(names, 101)
    assert all(r.shard == names[owner[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.place(df.where(F.lit(False)), "doc_id", names, 101).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.place(df, "doc_id", names, 101), path)
    assert spark.read.parquet(path).count() == 4
