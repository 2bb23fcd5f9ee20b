import random

import duckdb
import pyarrow.parquet as pq

from knotwork.llm import oracles, queries, quotes


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string, hash int, n int").write.parquet(f"{tmp_path}/conversations.parquet")
    return [tuple(r) for r in queries.op7_quotes(spark, str(tmp_path)).collect()]


def by_sql(tmp_path):
    conversations = pq.read_table(f"{tmp_path}/conversations.parquet")  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    return con.sql(oracles.OP7).fetchall()


def test_replies_are_linked_and_unquoted(spark, tmp_path):
    rows = [
        (1, 0, "user", "Hello there,\nhow   are YOU?\n\nBye"),
        (1, 1, "assistant", "Fine.\n> how are you?\nAnd you?"),
        (1, 2, "user", "An aside"),
        (1, 3, "user", "> > how are you?\n> Fine.\n> And you?\n\nGood."),
        (1, 4, "assistant", ">not said before\n  \nok"),
        (1, 5, "user", "> hello there,\n> good.\n> An aside\n"),
        (2, 0, "user", "> how are you?"),
        (2, 1, "user", None),
        (2, 2, "user", ""),
    ]
    got = run(spark, tmp_path, [(*r, "x", 1, 1) for r in rows])
    assert [r[:2] + r[3:] for r in got] == [
        (1, 0, "Hello there,\nhow   are YOU?\n\nBye", None, 0, 0, 0, 0),
        (1, 1, "Fine.\nAnd you?", 0, 0, 1, 1, 1),
        (1, 3, "Good.", 1, 0, 2, 3, 3),
        (1, 5, "", 3, 0, 3, 3, 3),
        (1, 2, "An aside", None, 2, 0, 0, 0),
        (1, 4, "ok", None, 4, 0, 1, 0),
        (2, 0, "", None, 0, 0, 1, 0),
        (2, 1, None, None, 1, 0, 0, 0),
        (2, 2, "", None, 2, 0, 0, 0),
    ]


def test_against_sql_on_random_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK_TURNS", 4)
    rng = random.Random(6)
    said = ["Yes", "no ", "maybe  SO", "Étude", "", "ok", "> x", "a > b", "\t tabbed\tline", "On Monday, A wrote:", "Le 3 mai, B a écrit\u00a0:", "Am 3. schrieb C:"]
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 30)):
            lines = []
            for _ in range(rng.randrange(0, 6)):
                lines.append(rng.choice(["", "", "> ", ">> ", " > > ", ">"]) + rng.choice(said))
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice([None, "\n".join(lines), "\r\n".join(lines), "\n".join(lines)]), "x", 1, 1))
    rows += [rows[3], rows[3], (None, 1, "user", "> ok", "x", 1, 1), (3, None, "user", "> ok\nbody", "x", 1, 1)]
    rows += [(99, t, "user", "> same\nsame", "x", 1, 1) for t in range(60)]  # one passage in every turn of a chain
    rng.shuffle(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(run(spark, tmp_path, rows), key=key) == sorted(by_sql(tmp_path), key=key)


def test_lines_that_introduce_a_quote_go_with_it(spark, tmp_path):
    rows = [(1, 0, "user", "Shall we?\nOn Monday she wrote:\nnothing", "x", 1, 1), (1, 1, "user", "Yes.\n\nOn Tue, 3 May 2022, Ann wrote:\n> Shall we?\n\nSee you", "x", 1, 1)]
    got = run(spark, tmp_path, rows)
    assert [(r[3], r[4]) for r in got] == [(rows[0][3], None), ("Yes.\n\n\nSee you", 0)]


def test_order_puts_replies_after_what_they_reply_to(spark, tmp_path):
    rows = [(5, t, "user", "root" if t == 0 else f"> {'root' if t == 1 else f'm{t - 1}'}\nm{t}", "x", 1, 1) for t in range(40)]
    got = run(spark, tmp_path, rows)
    assert [r[1] for r in got] == list(range(40)) and [r[6] for r in got] == list(range(40)) and {r[5] for r in got} == {0}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
