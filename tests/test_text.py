"""Text expressions against character walks and lists worked out by hand."""

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from vulnsift.functions import text as T


def walked(text):
    """Character by character: letters, digits, numerals, ``_`` and the five marks stay, all else parts words."""
    words, word = [], []
    for ch in text + " ":
        if ch.isalnum() or ch in "_.-@/:":
            word.append(ch)
        elif word:
            words.append("".join(word))
            word = []
    return " ".join(words).lower()


LITERALS = ["CVE-2021-44228 in Apache 2.4.1 at 192.168.1.10 via HTTP and SQL; my_var x",
            "WordPress 5.3 and Nginx 1.18.0 (LTS) — naïve café ΣΑΣ tab\tnew\nline",
            "", "   ", "ÉCOLE déjà-vu @home /path:80 ### x_y_z", "İstanbul ß ﬁ ①②"]


def _docs(spark):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    lit = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(LITERALS)], "doc_id long, text string")
    return d.unionByName(lit)


def test_clean_text_equals_a_character_walk(spark):
    rows = _docs(spark).select("text", T.clean_text("text").alias("c")).collect()
    bad = [r.text[:60] for r in rows if walked(r.text) != r.c]
    assert not bad, bad[:3]


def test_clean_text_by_hand(spark):
    cases = [("A,b  C!", "a b c"), ("(x)@y.z/1:2", "x @y.z/1:2"), ("#$%", ""), ("a_b\t-\n.", "a_b - ."), ("Ünï—Cödé", "ünï cödé")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string") \
        .select("i", T.clean_text("t").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [w for _, w in cases]


TECH_BY_HAND = [
    ("CVE-2021-44228 in Apache 2.4.1", ["cve-2021-44228", "apache 2.4"]),
    ("192.168.1.10 via HTTP and SQL; my_var x", ["192.168.1", "via", "http", "sql", "my_var"]),
    ("", []),
]


def test_tech_tokenizer_by_hand(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TECH_BY_HAND)], "i int, t string") \
        .select("i", T.tech_tokens("t").alias("t")).orderBy("i").collect()
    assert [list(r.t) for r in got] == [w for _, w in TECH_BY_HAND]


def test_tech_tokenizer_order_quirks(spark):
    df = spark.createDataFrame([("Apache 2.4.1 on 192.168.1.10",)], "t string")
    assert df.select(T.tech_tokens("t")).first()[0] == ["apache 2.4", "192.168.1"]


def test_split_ws_matches_python(spark):
    rows = _docs(spark).select("text", T.split_ws("text").alias("t")).collect()
    assert all(r.text.split() == list(r.t) for r in rows)


def test_python_list_repr(spark):
    vals = [[], ["a", "b"], ["it's"], ["say \"hi\" it's"], ["back\\slash", "new\nline"]]
    df = spark.createDataFrame([(v,) for v in vals], "a array<string>")
    got = [r[0] for r in df.select(T.py_list_repr("a")).collect()]
    assert got == [str(v) for v in vals]


def test_cpe_clean(spark):
    df = spark.createDataFrame([("cpe:2.3:a:Brand#3:small gear:22",)], "u string")
    assert df.select(T.cpe_clean("u")).first()[0] == "aBrand3small gear22"


def test_marked_tokenizer_equals_the_one_with_boundaries(spark):
    import random

    import duckdb
    rnd = random.Random(4)
    parts = ["CVE-2021-12345", "CVE-2021-123456ABC-2020-1234", "Apache 2.4.1", "Apache2.4", "Nginx  1.18.0", "192.168.1.10", "1.2", "XSS", "Éa", "é_b",
             "snake_case", "_x", "a_", "9CVE-2020-1111", "ab", "The", "can't", "x.y", "٣٤.٥", "AB_c", "-", "..", " ", "\t", " ", "日本"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "-", ".", ",", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ours = [list(r.t) for r in df.select("i", T.tech_tokens("t").alias("t")).orderBy("i").collect()]
    con = duckdb.connect()
    con.register("texts", df.toPandas())
    twin = [r[0] for r in con.execute(f"SELECT {T.tech_tokens_sql('t')} FROM texts ORDER BY i").fetchall()]
    assert ours == twin and sum(map(len, ours)) > 1000
