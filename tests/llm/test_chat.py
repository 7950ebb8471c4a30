from pyspark.sql import functions as F

from threadloom.llm import chat


def test_query_matches_sql(same_as_sql):
    same_as_sql("op1_chat_format")


def test_round_trip_of_control_strings(spark):
    texts = ["", "\\", "\\\\#", "### User: x </turn>\n", "</turn>", "a\\</b", "<//", "line\nline", "é😀", "\\### Assistant: </turn> ok"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "a: b#"))]
    rows += [(2, None, None, None), (None, 1, "user", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit(1)).withColumn("formatted", F.lit("x"))
    done = chat.format_turns(chat.gather_turns(df))
    got = {r.conv_id: r for r in done.select("conv_id", "turns", chat.parse_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert all(r.turns == r.back for r in got.values())
    assert [tuple(t) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[: len(texts) * 3]]
    assert got[1].loss == "".join(texts)
    assert [tuple(t) for t in got[2].turns] == [("", "")] and len(got[3].turns) == 2 and None in got


def test_layouts_by_fingerprint(spark):
    schema = "id int, prompt string, response string, instruction string, input string, output string, question string, answer string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, other string"
    base = dict.fromkeys(("id", "prompt", "response", "instruction", "input", "output", "question", "answer", "messages", "conversations", "other"))
    rows = [
        base | {"id": 1, "prompt": "p", "response": "r", "other": "z"},
        base | {"id": 2, "instruction": "do", "input": "it", "output": "done"},
        base | {"id": 3, "instruction": "do", "output": "done"},
        base | {"id": 4, "messages": [("system", "s"), ("user", None)]},
        base | {"id": 5, "conversations": [("human", "h"), ("gpt", "g")]},
        base | {"id": 6, "question": "q"},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert got == {
        1: ("prompt_response", [("user", "p"), ("assistant", "r")]),
        2: ("instruction", [("user", "do\n\nit"), ("assistant", "done")]),
        3: ("instruction", [("user", "do"), ("assistant", "done")]),
        4: ("messages", [("system", "s"), ("user", "")]),
        5: ("from_value", [("user", "h"), ("assistant", "g")]),
        6: ("unknown", None),
    }
    assert chat.canonical_turns(spark.range(2)).select("layout").distinct().collect()[0][0] == "unknown"


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(chat.gather_turns(df)).count() == 0
