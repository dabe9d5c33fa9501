"""Chat formatting: exact round trips, a fold worked out by hand, and the SQL twin."""

import random

import duckdb

from tests.conftest import SF_SMALL
from tools.check_oracle import canon
from vulnsift.llm import chat
from vulnsift.llm.queries import QUERIES, SQL


def test_round_trip_of_hostile_texts():
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<", "|", "\\", "\n", "a", "é", "<|", "|>", "n", ""]
    for _ in range(3000):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 4))), "".join(rng.choices(bits, k=rng.randint(0, 8))))
                 if rng.random() < .3 else (rng.choice(["user", "assistant"]), "".join(rng.choices(bits, k=rng.randint(0, 9))))
                 for _ in range(rng.randint(0, 5))]
        out, loss = chat.render(turns)
        assert chat.parse(out) == turns
        assert [chat.unescape(out[s["start"]:s["end"]]) for s in loss] == [t for r, t in turns if r == "assistant"]
        assert out.count(chat.START) == len(turns) == out.count(chat.END)


def test_fold_of_deltas_edits_and_regenerations(spark):
    ev = "conv_id long, seq long, kind string, msg long, role string, text string, n_turns string"
    rows = [(1, 1, "message", 1, "user", "hi", "x"), (1, 2, "delta", 2, "assistant", "he", "x"),
            (1, 3, "delta", 2, "assistant", "llo", "x"), (1, 4, "message", 3, "user", "more", "x"),
            (1, 5, "regenerate", 2, None, None, "x"), (1, 6, "delta", 2, "assistant", "hey", "x"),
            (1, 7, "edit", 1, "user", "hi!", "x"), (1, 8, "delete", 9, None, None, "x"),
            (1, 9, "edit", 8, None, "none", "x"), (1, 10, "message", 4, "user", "bye", "x"), (1, 11, "delete", 4, None, None, "x"),
            (2, 1, None, None, None, None, "x"), (2, 1, None, None, None, None, "x"), (None, 0, "message", 1, "user", "", "x")]
    random.Random(3).shuffle(rows)
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, ev)).collect()}
    assert chat.parse(got[1].formatted) == [("user", "hi!"), ("assistant", "hey")]
    assert chat.parse(got[2].formatted) == [("unknown", "")] * 2
    assert chat.parse(got[None].formatted) == [("user", "")]
    assert [got[1].formatted[s.start:s.end] for s in got[1].loss] == ["hey"]
    assert chat.format_chats(spark.createDataFrame([], ev)).count() == 0


def test_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, i, "delta", i // 10, "assistant", f"{i},") for c in (1, 2) for i in range(100)]
        df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg long, role string, text string")
        for r in chat.format_chats(df).collect():
            assert r.n_turns == 10
            assert "".join(t for _, t in chat.parse(r.formatted)) == "".join(f"{i}," for i in range(100))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_SMALL}/conversations.parquet')")
    df = QUERIES["op10_chat_format"](spark, SF_SMALL)
    res = con.execute(SQL["op10_chat_format"])
    cols = [d[0] for d in res.description]
    assert canon(df.columns, df.collect()) == canon(cols, res.fetchall())
