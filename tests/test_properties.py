"""Properties of the distributed operators."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from vulnsift.operators.knn import exact_knn
from vulnsift.operators.sequence import group_row_index, row_index
from vulnsift.plans import REGISTRY


def test_self_similarity_and_symmetry(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    top1 = exact_knn(e, e, 1, query_id="vec_id", query_vec="embedding", corpus_id="vec_id", corpus_vec="embedding")
    sims = [r.similarity for r in top1.collect()]
    assert all(abs(s - 1.0) < 1e-6 for s in sims)
    nn = exact_knn(e, e, 3, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                   corpus_vec="embedding", exclude_self=True, decimals=None)
    s = {(r.query_id, r.vec_id): r.similarity for r in nn.collect()}
    both = [(a, b) for (a, b) in s if (b, a) in s]
    assert both and all(abs(s[(a, b)] - s[(b, a)]) < 1e-12 for a, b in both)


def test_knn_blocks_equal_single_block(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    kw = dict(query_id="vec_id", query_vec="embedding", corpus_id="vec_id", corpus_vec="embedding", exclude_self=True)
    one = sorted(exact_knn(e, e, 2, **kw).collect())
    many = sorted(exact_knn(e, e, 2, block_bytes=20_000, **kw).collect())   # forces several query blocks
    assert one == many


def test_row_index_contiguous(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = [r.pos for r in row_index(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(5000))
    g = group_row_index(df.withColumn("g", F.col("k") % 3), ["g"], ["k"])
    assert sorted(r.pos for r in g.where("g = 1").collect()) == list(range(g.where("g = 1").count()))


def test_six_variants_per_cve_and_batches_partition(spark):
    p = REGISTRY["pairs_cve"].fn(spark, SF_SMALL)
    counts = {r["count"] for r in p.groupBy("id").count().collect()}
    assert counts == {6}
    b = REGISTRY["pair_batches"].fn(spark, SF_SMALL)
    n = b.count()
    assert b.select("row").distinct().count() == n
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes[-1] == 32 and sum(sizes) == n and sizes.count(32) >= len(sizes) - 1


def test_ann_recall(spark):
    r = REGISTRY["ann_recall"].fn(spark, SF_MID).first()
    assert r.queries == 500 and r.recall > 0.9


def test_collection_insert_if_absent(spark, tmp_path):
    from vulnsift.sources.collection import Collection
    c = Collection.open_or_create(spark, str(tmp_path), "kerentanan")
    assert c.metadata() == {"hnsw:space": "cosine"}
    rows = spark.createDataFrame([("doc-0", "a", [1.0, 0.0], 0), ("doc-0", "b", [0.0, 1.0], 1),
                                  ("doc-1", "c", [1.0, 1.0], 2)],
                                 "id string, document string, embedding array<double>, pos long")
    c.add(rows)
    c.add(rows.withColumn("document", F.lit("changed")))
    got = {r.id: r.document for r in c.read().collect()}
    assert got == {"doc-0": "a", "doc-1": "c"}


def test_flatten_edge_cases(spark):
    from vulnsift.operators.flatten import flatten_item
    df = spark.createDataFrame(
        [({"a": [], "b": ["x", "y"], "c": [{"d": True}, None], "e": [1, 2]}, None)],
        "s struct<a: array<string>, b: array<string>, c: array<struct<d: boolean>>, e: array<int>>, n string")
    got = [(e.key, e.value) for e in df.select(flatten_item(df, ["s", "n"]).alias("e")).first().e]
    assert got == [("s b", "x y"), ("s c_0 d", "True"), ("s c_1", "None"), ("s e_0", "1"), ("s e_1", "2")]


def test_semicolon_csv_without_quoting(spark, tmp_path):
    from vulnsift.sources.delimited import read_semicolon_unquoted
    p = tmp_path / "base.csv"
    p.write_text("query;passage\n'sql';it's \"quoted\"\n")
    r = read_semicolon_unquoted(spark, str(p)).first()
    assert (r.query, r.passage) == ("'sql'", "it's \"quoted\"")


def test_save_documents_empty_guard(spark, tmp_path):
    from vulnsift.sinks.csv import save_documents
    empty = spark.createDataFrame([], "id_cve string, documents string")
    assert save_documents(empty, str(tmp_path / "out")) is None


def test_flatten_json_whole_items(spark):
    from vulnsift.operators.flatten import flatten_json
    cases = [('{"z": 1, "a": "x", "m": true, "n": null}', "p", [("p z", "1"), ("p a", "x"), ("p m", "True"), ("p n", "None")]),
             ('{"a":{"b":1}}', "", [("a b", "1")]),
             ('{"a":{"b":1},"c":2,"a b":3}', "", [("a b", "3"), ("c", "2")]),
             ('{"l":["x","y"],"e":[],"o":{},"m":["x",1,null,{"k":[{"v":9.80}]}]}', "",
              [("l", "x y"), ("m_0", "x"), ("m_1", "1"), ("m_2", "None"), ("m_3 k_0 v", "9.8")]),
             ('{"k":1,"k":2}', "", [("k", "2")]), ("not json", "p", []), (None, "p", []), ("{}", "p", [])]
    for text, root, want in cases:
        df = spark.createDataFrame([(text,)], "j string")
        assert [(x.key, x.value) for x in df.select(flatten_json(F.col("j"), root).alias("e")).first().e] == want


def test_feed_files_malformed_and_several(spark, tmp_path):
    """A cut file and mis-typed items are reported; pairs over two files are numbered without gaps."""
    import json

    from vulnsift.operators.pairs import numbered_pair_set
    from vulnsift.sources.feed import feed_rejects, read_feed
    item = lambda i: {"cve": {"CVE_data_meta": {"ID": f"CVE-{i}"}, "description": {"description_data": [{"lang": "en", "value": "d"}]}}}
    (tmp_path / "a.json").write_text(json.dumps({"CVE_Items": [item(1), item(2)]}))
    (tmp_path / "b.json").write_text(json.dumps({"CVE_Items": [item(3), 5, item(4), {"cve": "x"}, None]}))
    (tmp_path / "c.json").write_text(json.dumps({"CVE_Items": [item(5)] * 5})[:-30])
    (tmp_path / "d.json").write_text("{}")
    items = read_feed(spark, str(tmp_path))
    assert sorted(r.ID for r in items.select("cve.CVE_data_meta.ID").collect()) == ["CVE-1", "CVE-2", "CVE-3", "CVE-4"]
    bad = sorted((r.source_file[-6:], r.pos, r.reject) for r in feed_rejects(spark, str(tmp_path)).collect() if r.pos is not None)
    assert bad == [("b.json", 1, "malformed item"), ("b.json", 3, "malformed item"), ("b.json", 4, "malformed item")]
    assert [r.reject for r in feed_rejects(spark, str(tmp_path)).collect() if r.pos is None] == ["malformed file"]
    general = spark.createDataFrame([("what", "this"), ("who", "that")], "query string, passage string")
    pairs = numbered_pair_set(general, items).collect()
    assert sorted(r.row for r in pairs) == list(range(2 * 2 + 4 * 6))
    assert len({(r.id, r.query) for r in pairs if r.src == 1}) <= 24 and {r.id for r in pairs if r.src == 1} == {f"CVE-{i}" for i in range(1, 5)}


def test_knn_large_query_sets_and_repeated_ids(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    rows = [(i % 40 if i < 200 else 7, [float(x) for x in v[i]]) for i in range(300)] + [(7, None), (3, [float(x) for x in v[3]])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    kw = dict(query_id="id", query_vec="v", corpus_id="id", corpus_vec="v", exclude_self=True)
    whole = sorted(exact_knn(e, e, 3, **kw).collect(), key=str)
    grid = sorted(exact_knn(e, e, 3, block_bytes=2000, **kw).collect(), key=str)
    assert whole == grid and len(whole) == 900      # 300 different query rows


def test_feed_dates_ignore_session_time_zone(spark):
    from vulnsift.sources.feed import adv_items
    cols = ["pos", "publishedDate", "cve.CVE_data_meta.ID"]
    utc = sorted(adv_items(spark, SF_SMALL).select(*cols).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = sorted(adv_items(spark, SF_SMALL).select(*cols).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other


def test_tables_are_read_as_they_are(spark):
    from vulnsift.sources.tables import table
    plan = table(spark, SF_SMALL, "documents").where(F.col("lang") == "en").select("doc_id") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(lang,en)" in plan


def test_cluster_without_checkpoint_folder_is_refused():
    from types import SimpleNamespace

    from vulnsift.session import checkpoint_dir
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(RuntimeError):
            checkpoint_dir(fake)


def test_rest_section_pruning_is_exact(spark):
    from vulnsift.operators.flatten import flatten_item, rest_section, rest_skip
    from vulnsift.sources.feed import ITEM_FIELDS, adv_items
    a = adv_items(spark, SF_SMALL)
    full = rest_section(flatten_item(a, ITEM_FIELDS))
    pruned = rest_section(flatten_item(a, ITEM_FIELDS, skip=rest_skip))
    assert a.where(full != pruned).count() == 0


def _hot_vectors(spark):
    """A third of the rows share one vector (a hot key); the rest are pseudo-random."""
    import numpy as np
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    rows = []
    for i in range(600):
        v = hot if i % 3 == 0 else rng.normal(size=16)
        rows.append((i, [float(x) for x in v]))
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_ann_split_grid_does_not_change_results(spark):
    from vulnsift.operators.ann import approx_knn
    df = _hot_vectors(spark)
    kw = dict(query_id="id", query_vec="v", corpus_id="id", corpus_vec="v", exclude_self=True)
    small = sorted(approx_knn(df, df, 5, max_group=8, **kw).collect())
    large = sorted(approx_knn(df, df, 5, max_group=100_000, **kw).collect())
    assert small == large and len(small) == 600 * 5


def test_exact_knn_ties_break_by_smallest_id(spark):
    df = _hot_vectors(spark)
    nn = exact_knn(df.where("id % 3 = 0"), df, 4, query_id="id", query_vec="v", corpus_id="id",
                   corpus_vec="v", exclude_self=True)
    got = {}
    for r in nn.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    expect_first = [i for i in range(0, 600, 3)]
    for q, hits in got.items():
        ids = [i for _, i in sorted(hits)]
        assert ids == [i for i in expect_first if i != q][:4]


def test_blocked_attention_equals_whole_sequences(spark):
    import numpy as np

    from vulnsift.operators.attention import attention, by_head, concat_heads, project_qkv, sequence_attention
    rng = np.random.default_rng(1)
    m = rng.normal(size=(32, 48))
    w = spark.createDataFrame([(r, *[[float(x) for x in m[r, a:a + 16]] for a in (0, 16, 32)]) for r in range(32)],
                              "r int, wq array<double>, wk array<double>, wv array<double>")
    x = rng.normal(size=(30, 32))
    t = spark.createDataFrame([(i % 2, i // 2, [float(v) for v in x[i]]) for i in range(30)], "seq_id long, pos long, vec array<double>")
    proj = project_qkv(t, w)
    flat = m[:, :16].reshape(-1)
    for r in proj.collect():                       # A1, index by index
        row = x[r.pos * 2 + r.seq_id]
        for h in range(2):
            for j in range(16):
                want = sum(row[16 * h + i] * flat[j * 32 + 16 * h + i] for i in range(16))
                assert r.q[16 * h + j] == pytest.approx(want)
    whole = {(r.seq_id, r.pos): r.attn for r in sequence_attention(proj).collect()}
    blocked = {(r.seq_id, r.pos): r.attn for r in concat_heads(attention(by_head(proj), block=4)).collect()}
    assert whole.keys() == blocked.keys()
    assert all(whole[k] == pytest.approx(blocked[k]) for k in whole)


def test_cells_sort_only_what_may_be_among_the_best(spark):
    """A cell of LSH and a block of the exact search give the plain top k, ties by id, without sorting every score."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from vulnsift.operators import ann, knn
    rng = np.random.default_rng(4)
    c = rng.integers(-2, 3, (3000, 4)).astype(float)                # many equal scores
    q = c[:500]
    sizes = []
    plain = knn._topk_rows
    unit = knn._unit_rows
    s = unit(q) @ unit(c).T
    s[np.arange(500), np.arange(500)] = -np.inf
    want = {(i, int(j)) for i in range(500) for j in np.lexsort((np.arange(3000), -knn.rank_key(s[i])))[:7]}

    def counted(qi, *rest):
        sizes.append(len(qi))
        return plain(qi, *rest)

    ann._topk_rows = knn._topk_rows = counted
    try:
        out = ann._score_fn(7, True)(pd.DataFrame({"id": range(500), "vec": list(q)}), pd.DataFrame({"c_id": range(3000), "c_vec": list(c)}))
        held = type("B", (), {"value": (np.arange(500), np.arange(500), unit(q))})
        t = pa.table([pa.array(range(3000), pa.int64()), pa.array(c.tolist())], names=["cid", "cvec"])
        block = pa.Table.from_batches(list(knn._block_scorer(held, 7, True, pa.int64(), pa.int64())(iter(t.to_batches(max_chunksize=400)))))
    finally:
        ann._topk_rows = knn._topk_rows = plain
    assert set(zip(out["qid"], out["cid"])) == want
    assert set(zip(block["qid"].to_pylist(), block["cid"].to_pylist())) == want
    assert sum(sizes) < 500 * 3000 / 2


def test_a_vector_travels_once_for_each_block_of_the_other_side(spark):
    """Not once for each table, probe and slice of a bucket."""
    from vulnsift.operators.ann import approx_knn
    from vulnsift.operators.knn import grid_side
    df = _hot_vectors(spark)
    kw = dict(query_id="id", query_vec="v", corpus_id="id", corpus_vec="v", exclude_self=True)
    out = approx_knn(df, df, 5, max_group=200, **kw)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Generate explode") == 2
    assert sorted(out.collect()) == sorted(approx_knn(df, df, 5, **kw).collect())
    assert [grid_side(n, 64, 16 << 20) for n in (10, 5000, 100_000, 600_000, 2_000_000)] == [1, 2, 6, 6, 16]


def test_a_repeated_id_is_one_candidate(spark):
    from vulnsift.operators.ann import approx_knn
    df = _hot_vectors(spark).where("id < 60")
    kw = dict(query_id="id", query_vec="v", corpus_id="id", corpus_vec="v", exclude_self=True, tables=3, bits=2)
    got = approx_knn(df, df.unionByName(df), 4, **kw).collect()
    assert len({(r.query_id, r.id) for r in got}) == len(got) == 60 * 4
