import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vulnsift.llm import toxicity as T

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, toxic int"
STEMS = {"en": ["grobnik", "zarkle"], "fr": ["vexou", "mirdé"]}


def corpus(n=900, seed=1):
    """Random words; a toxic text holds a few words of a bad stem with random endings."""
    rnd = random.Random(seed)
    syl = ["an", "er", "lo", "tis", "ka", "mou", "é", "ri", "su", "den"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randrange(1, 5)))
    rows, labels = [], []
    for i in range(n):
        lang, bad = rnd.choice(["en", "fr"]), rnd.random() < 0.2
        words = [word() for _ in range(rnd.randrange(5, 80))]
        if bad:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(STEMS[lang]) + rnd.choice(["", "an", "é", "tis"])
        rows.append((i, " ".join(w.title() if rnd.random() < .1 else w for w in words) + ".", lang))
        labels.append((i, int(bad)))
    return rows, labels


def plain_answers(net, text):
    """Filters word by word, with bucket sums and zero words before the text."""
    words = ["".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower())][0].split()
    vec = []
    for w in words:
        raw = w.encode()
        b = T.word_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), len(net.embed))[0]
        vec.append(net.embed[b].sum(0).astype(np.float64))
    out = np.zeros(len(net.weights))
    for i in range(len(vec)):
        for k, width in enumerate(T.WIDTHS):
            a = net.offset[k].astype(np.float64)
            for b in range(width):
                if i - b >= 0:
                    a = a + vec[i - b] @ net.filters[k][width - 1 - b]
            cols = slice(k * T.FILTERS, (k + 1) * T.FILTERS)
            out[cols] = np.maximum(out[cols], a)
    return out


def some_net(seed=0, buckets=512):
    rng = np.random.default_rng(seed)
    net = T.start([rng.integers(1, buckets, 20) for _ in range(30)], (rng.random(30) < .5).astype(float), rng, buckets)
    net.embed = rng.normal(0, 1, net.embed.shape).astype(np.float32)
    net.embed[0] = 0
    return net


def test_scores_equal_a_plain_network():
    rows, _ = corpus(40)
    texts = [r[1] for r in rows] + ["", "one", "a, b", "...", "ÉÉ é" * 30]
    net = some_net()
    want = net.probability(np.stack([plain_answers(net, t.lower()) for t in texts]))
    assert np.allclose(net.score(pa.array([t.lower() for t in texts])), want, atol=1e-5)


@pytest.mark.parametrize("limit", [9, 64, 500])
def test_windows_of_a_long_text_change_nothing(limit, monkeypatch):
    net = some_net(2)
    texts = pa.array([" ".join(r[1] for r in corpus(12, 5)[0]).lower(), "", "short one"])
    whole = net.score(texts)
    monkeypatch.setattr(T, "SLAB", limit)
    assert np.allclose(net.score(texts), whole, atol=1e-5)


def test_prefix_buckets_are_by_characters():
    words = ["mirdé", "mirdéan", "mirdétis", "mir", "ééééx", "éééé"]
    raw = [w.encode() for w in words]
    b = T.word_buckets(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    assert len(set(b[:3, 2])) == 1 and len(set(b[:3, 1])) == 1 and len(set(b[:, 0])) == 6
    assert b[3, 1] == b[3, 2] == 0 and b[4, 1] == b[5, 1] != 0 and b[5, 2] == 0 != b[4, 2]


def test_step_follows_the_gradient():
    """The change of every parameter is minus the rate times the slope of the loss, by finite differences."""
    rng = np.random.default_rng(3)
    ids, bounds, y = rng.integers(0, 15, 40), np.array([0, 12, 12, 25, 40]), np.array([1.0, 0.0, 1.0, 0.0])
    words = rng.integers(1, 60, (15, 3))

    def net():
        n = some_net(3, 64)
        n.embed, n.filters = n.embed.astype(np.float64), [f.astype(np.float64) for f in n.filters]
        n.offset = [o.astype(np.float64) for o in n.offset]
        return n

    def loss(n):
        vec = n.embed[words].sum(1)
        pooled = np.zeros((4, len(n.weights)))
        for i in range(4):
            for t in range(bounds[i], bounds[i + 1]):
                for k, width in enumerate(T.WIDTHS):
                    a = n.offset[k] + sum(vec[ids[t - b]] @ n.filters[k][width - 1 - b] for b in range(width) if t - b >= bounds[i])
                    cols = slice(k * T.FILTERS, (k + 1) * T.FILTERS)
                    pooled[i, cols] = np.maximum(pooled[i, cols], a)
        p = n.probability(pooled)
        return -np.mean(np.log(np.where(y > 0, p, 1 - p)))

    rate, eps = 1e-3, 1e-5
    before, after = net(), net()
    T.step(after, after.embed[words].sum(1), words, ids, bounds, y, rate)
    places = [("embed", (words[ids[0], 0], 2)), ("embed", (words[ids[30], 1], 0))]
    places += [("filters", (k, (b, 1, f))) for k, w in enumerate(T.WIDTHS) for b in range(w) for f in (0, 5)] + [("offset", (1, (3,)))]
    for name, at in places:
        def shifted(e):
            n = net()
            target = getattr(n, name)
            if name == "embed":
                target[at] += e
            else:
                target[at[0]][at[1]] += e
            return loss(n)
        slope = (shifted(eps) - shifted(-eps)) / (2 * eps)
        get = lambda n: getattr(n, name)[at] if name == "embed" else getattr(n, name)[at[0]][at[1]]
        assert abs((get(before) - get(after)) / rate - slope) < 1e-3 + 0.02 * abs(slope)


def run(spark, rows, labels, schema=DOCS):
    return {r.doc_id: r for r in T.score(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(labels, LABELS)).collect()}


def test_held_out_accuracy_and_thresholds_by_language(spark):
    rows, labels = corpus(1500)
    got, truth = run(spark, rows, labels), dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert np.mean([got[i].flagged == truth[i] for i in held]) > 0.95
    assert all(got[i].flagged == (got[i].score >= got[i].lang_threshold) for i in truth)
    assert len({(r[2], got[r[0]].lang_threshold) for r in rows}) == 2


def test_language_source_and_held_out_labels_are_no_inputs(spark):
    rows, labels = corpus(300)
    base = run(spark, rows, labels)
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    other = run(spark, [(i, t, "xx") for i, t, _ in rows], flip)
    assert all(base[i].score == other[i].score for i in base)


def test_nulls_repeats_empty_and_extra_columns(spark):
    rows, labels = corpus(200)
    extra = rows + [rows[0]] * 3 + [(None, "grobnik", "en"), (5000, None, None), (5001, "", "en"), (5002, " .,! ", "fr")]
    df = spark.createDataFrame([(*r, 0.5, 7, 1) for r in extra], DOCS + ", score double, toxic int, y int")
    lab = spark.createDataFrame([*labels, (1, None), (2, 7), (None, 1), (3, 0), (3, 1), (3, 1)], LABELS)
    got = T.score(df, lab).collect()
    assert len(got) == len(extra)
    assert len({r.score for r in got if r.doc_id == rows[0][0]}) == 1
    assert len({r.score for r in got if r.doc_id in (5000, 5001, 5002)}) == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= T.THRESHOLD) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_without_labels_or_of_one_class(spark):
    rows, labels = corpus(30)
    assert {r.score for r in run(spark, rows, []).values()} == {0.5}
    one = {r.score for r in run(spark, rows, [(i, 0) for i, _ in labels]).values()}
    assert len(one) == 1 and 0 < one.pop() < 0.1
    assert run(spark, [], labels) == {}


def test_threshold_of_the_best_f1():
    p, y = np.array([.9, .8, .6, .5, .4, .3, .2, .2, .1, .1]), np.array([1, 1, 1, 1, 1, 0, 0, 0, 0, 0.])
    assert T.best_threshold(p, y, .7) == pytest.approx(.35)
    assert T.best_threshold(p[:4], y[:4], .7) == .7


def test_every_labelled_text_is_learned_from(spark, monkeypatch):
    """No limit on rows, bytes or length of a text."""
    rows = [(i, "zarkle " * (200_000 if i == 0 else 5), "en") for i in range(0, 30_000, 2)]
    labels = [(r[0], int(r[0] % 4 == 0)) for r in rows]
    got = T.labelled_texts(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert {r.doc_id for r in got.select("doc_id").collect()} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}


def test_many_shards_learn_alike(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 60_000)
    rows, labels = corpus(1500)
    got, truth = run(spark, rows, labels), dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.93
    assert np.mean([got[i].flagged == truth[i] for i in held]) > 0.93


def test_thresholds_of_languages_in_parts(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["en", "fr", None]), int(rnd.random() < .4), round(rnd.random(), 2)) for _ in range(400)] + [("xx", 1, .5)]
    by_lang, common = T.best_thresholds(spark.createDataFrame(rows, "lang string, y int, p double").repartition(4), .7)
    plain = lambda keep, other: T.best_threshold(np.array([r[2] for r in keep]), np.array([float(r[1]) for r in keep]), other)
    assert common == pytest.approx(plain(rows, .7))
    assert by_lang == {x: pytest.approx(plain([r for r in rows if r[0] == x], common)) for x in ("en", "fr", "xx")}


def test_score_does_not_depend_on_the_batch():
    import pyarrow as pa
    rows, labels = corpus(120)
    y = np.array([float(dict(labels).get(r[0], 0)) for r in rows])
    net = T.train(pa.array([r[1] for r in rows]), y, epochs=1, buckets=1 << 12)
    texts = [r[1] for r in rows]
    whole = net.score(pa.array(texts))
    assert all(net.score(pa.array(texts[i:i + k])).tolist() == whole[i:i + k].tolist() for k in (1, 3, 7, 50) for i in range(0, len(texts) - k, 5))


def test_rounds_of_training_find_the_shards_in_place(spark, monkeypatch):
    rows, labels = corpus(300)
    of = spark.createDataFrame([(i % 7, i, t, int(y)) for (i, t, _), (_, y) in zip(rows, labels)], "shard int, doc_id long, text string, y int").repartition(5)
    stored = []
    monkeypatch.setattr(T, "cut", lambda df, c=T.cut: stored.append(c(df)) or stored[-1])
    net = T.train_shards(of, 7, len(rows), float(sum(y for _, y in labels)), epochs=2, buckets=1 << 10)
    assert len(stored) == 1 and net.embed.any()
    at = stored[0].selectExpr("shard", "spark_partition_id() AS p").distinct().groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in at} == {i: 1 for i in range(7)}
