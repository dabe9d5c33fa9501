import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vulnsift.operators import pairs as P
from vulnsift.operators.sequence import feistel_keys, feistel_sides, permuted, permuted_sql


def plain(x, n, seed):
    """The permutation, cell by cell."""
    p = (1 << 31) - 1
    a, b = feistel_sides(n)
    while True:
        left, right = divmod(x, b)
        for i, k in enumerate(feistel_keys(seed)):
            if i % 2 == 0:
                left = (left + pow((right + k) % p, 3, p)) % a
            else:
                right = (right + pow((left + k) % p, 3, p)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 1000, 10007])
def test_permutation_is_a_bijection(spark, n):
    got = [r.p for r in spark.range(n).select(permuted("id", n, 42).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert got == [plain(x, n, 42) for x in range(n)]


def test_permutation_in_sql_and_other_seeds(spark):
    import duckdb
    n = 777
    a, b = feistel_sides(n)
    sql = duckdb.sql(f"SELECT {permuted_sql('x', 5)} AS p FROM (SELECT x, {n} AS n, {a} AS a, {b} AS b FROM range({n}) t(x)) ORDER BY x").fetchall()
    want = [plain(x, n, 5) for x in range(n)]
    assert [r[0] for r in sql] == want and want != [plain(x, n, 6) for x in range(n)]
    moved = sum(abs(x - y) for x, y in enumerate(want)) / n
    assert n / 4 < moved < n / 2                        # an even shuffle moves a row by a third of the rows


def test_permutation_of_very_many_rows(spark):
    n = 10**15 + 3
    xs = [0, 1, n - 1, n // 2, 123456789012345]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x long").select(permuted("x", n, 1).alias("p")).collect()]
    assert got == [plain(x, n, 1) for x in xs]


def test_batches_have_one_shuffle_less(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(70)], "row long, document string")
    b = P.shuffled_batches(df, 70, 3)
    assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()
    assert sorted(Counter(r.batch_id for r in b.collect()).values()) == [6, 32, 32]


# -- the pair file of any general table ------------------------------------------------------------

def test_repeated_null_and_empty_rows_keep_a_number_each(spark):
    from vulnsift.sources.feed import adv_items
    rows = [("a", "p"), ("a", "p"), ("b", None), ("c", ""), (None, "q"), (None, None), (None, None)]
    qp = spark.createDataFrame(rows, "query string, passage string").repartition(3)
    items = adv_items(spark, "/root/testdata/sf0.001").limit(5)
    pairs, n = P.sized_pair_set(qp, items)
    got = pairs.collect()
    assert sorted(r.row for r in got) == list(range(n))
    general = sorted((r.row, r.query, r.document) for r in got if r.src == 0)
    order = sorted(rows, key=lambda r: tuple((x is not None, x or "") for x in r))
    assert [g[2] for g in general] == [p for _, p in order for _ in range(2)]
    assert [g[1] for g in general] == [t.format(q=q) for q, _ in order for t in P.GENERAL_TEMPLATES]


def test_given_keys_may_be_null(spark):
    qp = spark.createDataFrame([(1, "a", "p"), (None, "b", "q"), (2, "c", "r")], "k int, query string, passage string")
    got = sorted((r.gi, r.query) for r in P._numbered(qp, ["k"], "gi").collect())
    assert got == [(0, "b"), (1, "a"), (2, "c")]


def test_empty_general_table(spark):
    got = P._numbered(spark.createDataFrame([], "query string, passage string"), None, "gi")
    assert got.count() == 0


# -- batches without duplicates ---------------------------------------------------------------------

def dealt(spark, documents, size):
    df = spark.createDataFrame(list(enumerate(documents)), "row long, document string").repartition(3)
    return P.no_duplicate_batches(df, 7, size).collect()


def check(spark, documents, size):
    got = dealt(spark, documents, size)
    assert sorted((r.row, r.document) for r in got) == sorted(enumerate(documents))
    batches = defaultdict(list)
    for r in got:
        batches[r.batch_id].append(r)
    for rows in batches.values():
        assert len(rows) <= size and len({r.document for r in rows}) == len(rows)
        assert sorted(r.place for r in rows) == list(range(len(rows)))
    assert sorted(batches) == list(range(len(batches)))
    return [len(batches[b]) for b in sorted(batches)]


def test_full_batches_where_documents_allow(spark):
    sizes = check(spark, [f"d{i % 40}" for i in range(100)] + [None, None, "", ""], 8)
    assert sizes == [8] * 13


def test_last_batch_short(spark):
    assert check(spark, [f"d{i}" for i in range(35)], 8) == [8, 8, 8, 8, 3]


def test_a_document_of_a_third_of_all_rows(spark):
    sizes = check(spark, ["hot"] * 40 + [f"d{i}" for i in range(80)], 8)
    assert len(sizes) == 40 and sum(sizes) == 120


def test_random_groups(spark):
    rnd = random.Random(2)
    for size in (1, 3, 32):
        check(spark, [f"d{int(rnd.paretovariate(0.8)) % 50}" for _ in range(300)], size)


def test_layout_holds_for_any_groups():
    rnd = random.Random(1)
    for _ in range(3000):
        groups = sorted((rnd.choice([1, 1, 2, 3, rnd.randrange(1, 30)]) for _ in range(rnd.randrange(1, 40))), reverse=True)
        size = rnd.randrange(1, 9)
        layout = P._layout(sorted(Counter(groups).items(), reverse=True), size)
        assert len(layout) <= size and sum(w for _, w in layout) >= sum(groups)
        at = 0
        for g in groups:
            columns = []
            for p in range(at, at + g):
                start = max(s for s, _ in layout if s <= p)
                columns.append(p - start)
            assert len(set(columns)) == g
            at += g


def test_no_pairs(spark):
    assert dealt(spark, [], 4) == []
    assert spark.range(0).withColumn("x", permuted(F.col("id"), 0, 1)).count() == 0


# -- packed vectors ---------------------------------------------------------------------------------

def test_packed_counts_are_the_embedding_unscaled(spark):
    import numpy as np
    from vulnsift.functions.embed import hashed_embedding, packed_embedding, unpacked
    import pyarrow as pa
    texts = ["", None, "one two two", "Éa b_c 9", "many " * 300 + "x", "most " * 70000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1) \
        .select("i", packed_embedding("t").alias("p"), hashed_embedding("t").alias("e")).orderBy("i").collect()
    counts = unpacked(pa.array([bytes(r.p) for r in got], pa.binary()))
    norms = np.linalg.norm(counts, axis=1, keepdims=True)
    assert np.allclose(counts / np.where(norms == 0, 1, norms), [r.e for r in got])
    assert [len(r.p) for r in got] == [64, 64, 64, 64, 128, 256]


def test_loss_deals_counts_and_no_texts(spark):
    """The shuffle by batch carries packed vectors; the result is that of the texts."""
    rows = [(i // 4, i, f"w{i} w{i % 3}", f"w{i % 3} d") for i in range(10)]
    df = spark.createDataFrame(rows, "batch_id long, shuffled_pos long, query string, document string")
    out = P.in_batch_ranking_loss(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan[plan.index("RepartitionByExpression [batch_id"):]
    got = {r.shuffled_pos: r.loss for r in out.collect()}
    import math
    import numpy as np
    from vulnsift.functions.embed import hashed_embedding
    e = {r.shuffled_pos: (np.array(r.q), np.array(r.d)) for r in df.select("shuffled_pos", hashed_embedding("query").alias("q"), hashed_embedding("document").alias("d")).collect()}
    for b, i, _, _ in rows:
        s = {j: 20 * float(e[i][0] @ e[j][1]) for c, j, _, _ in rows if c == b}
        assert got[i] == pytest.approx(math.log(sum(map(math.exp, s.values()))) - s[i], abs=1e-9)


def test_positions_are_stored_without_what_they_are_sorted_by(spark):
    from vulnsift.operators.sequence import row_index
    df = spark.createDataFrame([(i, str(97 * i % 50)) for i in range(50)], "row long, text string")
    got = row_index(df, ["text", "row"], out="at", keep=["row"])
    assert got.columns == ["row", "at"]
    assert [r.row for r in got.orderBy("at").collect()] == [i for i, t in sorted(((i, str(97 * i % 50)) for i in range(50)), key=lambda x: (x[1], x[0]))]


def test_pair_file_is_compressed(spark, tmp_path):
    """A document that comes six times takes the room of little more than one."""
    from vulnsift.sinks.csv import write_csv
    from vulnsift.sources.delimited import read_csv
    rnd = random.Random(1)
    rows = [(str(i), f'q "{i}";\n', "".join(rnd.choice("abcdefgh ,\"\n") for _ in range(900)) if i % 6 == 0 else "") for i in range(600)]
    rows = [(i, q, rows[k - k % 6][2]) for k, (i, q, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, query string, document string").coalesce(1)
    write_csv(df, f"{tmp_path}/z", compression="gzip")
    write_csv(df, f"{tmp_path}/p")
    size = lambda d: sum(f.stat().st_size for f in (tmp_path / d).glob("part-*"))
    assert sorted(map(tuple, read_csv(spark, f"{tmp_path}/z", "id string, query string, document string").collect())) == sorted(rows)
    assert size("z") < size("p") / 4


# -- fans -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 17, 1000, 10**15 + 3])
def test_permutation_of_arrays_is_that_of_the_column(n):
    import numpy as np
    from vulnsift.operators.sequence import permuted_positions
    xs = sorted({0, n - 1, n // 2, n // 3})
    assert permuted_positions(np.array(xs), n, 42).tolist() == [plain(x, n, 42) for x in xs]


def _fans(spark):
    from vulnsift.sources.feed import adv_items
    rows = [(i, 0, f"q{i}", ["same", None, f"p{i} É x"][i % 3]) for i in range(40)]
    qp = spark.createDataFrame(rows, "conv_id long, turn long, query string, passage string").repartition(3)
    return qp, adv_items(spark, "/root/testdata/sf0.001").limit(30)


def test_fans_are_dealt_as_their_pairs_and_rendered_once(spark):
    """Whole rows are counted, sorted and joined; the batches and places are those of the pairs one by one."""
    qp, items = _fans(spark)
    items = items.cache()
    pairs, n = P.sized_pair_set(qp, items)
    want = {(r.row, r.batch_id, r.place) for r in P.no_duplicate_batches(pairs, 42, 8).collect()}
    fans = P.sized_fan_set(qp, items)[0]
    got = P.no_duplicate_fans(fans, 8)
    assert {(r.row, r.batch_id, r.place) for r in got.collect()} == want and len(want) == n
    assert "id" not in P.no_duplicate_fans(fans.drop("id", "document", "queries"), 8).columns


def test_copies_of_a_fan_are_dealt_as_copies_of_pairs(spark):
    qp, items = _fans(spark)
    fans = P.sized_fan_set(qp, items)[0].cache()
    twice = fans.unionByName(fans.where("row % 3 = 0"))
    plain_ = P.unfolded(twice)
    want = Counter((r.row, r.batch_id, r.place) for r in P.no_duplicate_batches(plain_.select("row", "document"), 42, 8).collect())
    assert Counter((r.row, r.batch_id, r.place) for r in P.no_duplicate_fans(twice, 8).collect()) == want


def test_weighted_positions(spark):
    from vulnsift.operators.sequence import row_index
    df = spark.createDataFrame([(i, i % 4) for i in range(60)], "k long, w int").repartition(4)
    got = [(r.k, r.at) for r in row_index(df, ["k"], out="at", keep=["k"], weight="w").orderBy("k").collect()]
    assert got == [(k, sum(i % 4 for i in range(k))) for k in range(60)]


def test_words_are_cut_from_the_text_in_batches(spark):
    """An ASCII text leaves as it is, not as a list of tokens; vectors are those of the tokens."""
    import hashlib
    import re

    import numpy as np
    import pyarrow as pa
    from vulnsift.functions.embed import packed_embedding, packed_embeddings, unpacked
    texts = ["A_b  c!!D9", "", None, "...", "x", "x.", ".x", "Straße ÉÀ x", "é", "a\x00b\x7fc", "many " * 300 + "x", "ends", "here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    want = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            want[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    one = unpacked(pa.array([bytes(r.p) for r in df.select("i", packed_embedding("t").alias("p")).orderBy("i").collect()], pa.binary()))
    many = df.select(packed_embeddings(F.array(F.col("t"), F.lit("x"), F.col("t"))).alias("p"), "i").orderBy("i").collect()
    assert (one == want).all()
    assert (unpacked(pa.array([bytes(r.p[2]) for r in many], pa.binary())) == want).all() and all(len(r.p) == 3 for r in many)
    plan = df.select(packed_embedding("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan


def test_batches_of_several_sizes_are_scored_together():
    import math

    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(1)
    sizes = [3, 1, 3, 5, 3]
    bid = np.repeat(np.arange(5), sizes)
    q, d = rng.normal(size=(2, 15, 4))
    rb = pa.RecordBatch.from_arrays([pa.array(bid), pa.array(np.arange(15)), pa.array(list(q)), pa.array(list(d))], ["batch_id", "shuffled_pos", "q", "d"])
    out = pa.Table.from_batches(list(P._batch_loss_fn(20.0)(iter([rb.slice(0, 5), rb.slice(5)])))).to_pylist()
    unit = lambda v: v / np.linalg.norm(v)
    for r in out:
        i = r["shuffled_pos"]
        s = {j: 20 * float(unit(q[i]) @ unit(d[j])) for j in range(15) if bid[j] == bid[i]}
        assert r["loss"] == pytest.approx(math.log(sum(map(math.exp, s.values()))) - s[i])
        assert r["positive_rank"] == 1 + sum(x > s[i] + 1e-9 for x in s.values())
    assert len(out) == 15


def test_counts_of_a_pair_are_made_once(spark):
    qp, items = _fans(spark)
    pairs, n = P.sized_pair_set(qp, items, embed_documents=True)
    plan = P.in_batch_ranking_loss(P.shuffled_batches(pairs, n))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("packed(transform(") == 2                 # one for general pairs, one for those of advisories
