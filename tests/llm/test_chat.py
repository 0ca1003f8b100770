import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat

TURNS = "array<struct<role:string,text:string>>"


def test_layouts_become_turns(spark):
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}],"id":3,"prompt_x":1}': ("messages", [("user", "a"), ("assistant", "")]),
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': ("conversations", [("user", "a"), ("assistant", "b")]),
        '{"prompt":"p","response":"r"}': ("prompt and response", [("user", "p"), ("assistant", "r")]),
        '{"prompt":"p","completion":"r"}': ("prompt and completion", [("user", "p"), ("assistant", "r")]),
        '{"instruction":"i","output":"o"}': ("instruction", [("user", "i"), ("assistant", "o")]),
        '{"instruction":"i","input":null,"output":"o"}': ("instruction with input", [("user", "i"), ("user", ""), ("assistant", "o")]),
        '{"system":"s","prompt":"p","response":"r"}': ("system, prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        '{"role":"bot","text":"t"}': ("message row", [("assistant", "t")]),
        '{"prompt":"p","messages":[{"role":"user","content":"a","extra":{"role":1}}]}': ("messages", [("user", "a")]),
        '{"system":"s","instruction":"i","input":"n","output":"o"}': ("system, instruction and input", [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")]),
        '{"role":"user","text":"t","prompt":"p"}': ("message row", [("user", "t")]),
        '{"data":{"messages":[{"role":"user","content":"a"}]},"n":[1,[2]]}': ("messages", [("user", "a")]),
        '{"messages":[]}': ("messages", []),
        '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"},"b"]}]}': ("messages", [("user", "ab")]),
        '{"messages":[{"role":"user","content":[]},{"role":"user","content":"x"}]}': ("messages", [("user", ""), ("user", "x")]),
        '{"messages":"none"}': (None, None),
        '{"x":1}': (None, None),
        "{bad": (None, None),
        "[]": (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(k, "clash") for k in records], "j string, text string")
    for r in chat.canonical_turns(df, F.col("j")).collect():
        assert (r.layout, r.turns if r.turns is None else [tuple(t) for t in r.turns]) == records[r.j], r.j


def test_paths_and_fingerprints(spark):
    records = ['{"a":{"b":[{"c":1,"d e":2}],"f":null},"g":[[1]]}', '{"g":[[5]],"a":{"f":3,"b":[{"d e":1,"c":"x"}]}}', "{}", "[1]", "3"]
    df = spark.createDataFrame([(r,) for r in records], "j string").withColumn("v", F.try_parse_json("j"))
    got = df.select(chat.paths_of_record(F.col("v")).alias("p")).withColumn("h", chat.fingerprint(F.col("p"))).collect()
    assert got[0].p == ["a", "a.b", "a.b[]", "a.b[].c", "a.b[].d e", "a.f", "g", "g[]", "g[][]"] == got[1].p and got[0].h == got[1].h
    assert got[2].p == [] and got[3].p == ["[]"] and got[4].p == []
    assert [chat._hash("\n".join(r.p)) for r in got] == [r.h for r in got]
    nested = spark.createDataFrame([], "a struct<b:array<struct<c:int>>,f:int>, g array<array<int>>")
    assert chat.paths_of_schema(nested.schema) == ["a", "a.b", "a.b[]", "a.b[].c", "a.f", "g", "g[]", "g[][]"]


def test_tables_have_the_layout_of_their_columns(spark):
    rows = spark.createDataFrame([("p", None, "x")], "question string, answer string, layout string")
    r = chat.turns_of_rows(rows).first()
    assert (r.layout, [tuple(t) for t in r.turns]) == ("question and answer", [("user", "p"), ("assistant", "")])
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_rows(spark.createDataFrame([], "x int"))


def test_every_layout_over_whole_conversations(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    names = ["conv_id", "layout", "n_turns", "turn", "turns_sha256"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({chat.ORACLE_LAYOUTS})").fetchall(), key=str)
    got = sorted((tuple(r[n] for n in names) for r in chat.chat_layouts(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == want and {r[1] for r in got} == {name for name, *_ in chat.LAYOUTS} | {None}


def test_template_round_trip_and_mask(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant<|im_sep|>x", "\\", "\\\\<|", "<\\|im_end|>", "<", "|>", "", "é\n\n", "<<||", "\\|", "a" * 90000]
    turns = [(role, t) for t in odd for role in ("user", "assistant", "we<|ird\\")]
    df = spark.createDataFrame([(turns,)], f"t {TURNS}")
    r = df.select(chat.formatted(F.col("t")).alias("f"), chat.loss_spans(F.col("t")).alias("s")).withColumn("back", chat.read_back(F.col("f"))).first()
    assert [tuple(t) for t in r.back] == turns
    spans = [r.f[s.start : s.start + s.length] for s in r.s]
    assert [s.replace("\\\\", "\0").replace("\\|", "|").replace("\0", "\\") for s in spans] == odd
    assert r.f.count(chat.END) == len(turns)


def test_conversations_by_brute_force(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, None, None, "n"), (2, 500, "assistant", "<|x"), (2, 3, "user", "m"), (None, 0, "assistant", "q"), (1, 0, "user", "a"), (3, 0, "human", "hi"), (3, 1, "gpt", "yo"), (3, 2, "bot", "so")] + [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op10(spark, str(tmp_path)).collect()}
    says = "<|im_end|><|im_start|>assistant ok"
    by = {-1: [(0, "user", says), (1, "assistant", says)]}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, some in by.items():
        some.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, role, t in some if role == "assistant")
        assert got[c].n_turns == len(some)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in some).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = [x[0] for x in db.execute(chat.ORACLE_OP10).description]
    want = {tuple(sorted(zip(names, row, strict=True))) for row in db.execute(chat.ORACLE_OP10).fetchall()}
    assert {tuple(sorted(r.asDict().items())) for r in got.values()} == want


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.op10(spark, str(tmp_path)).collect()] == [-1]


def test_it_runs_without_python_workers(spark):
    plan = chat.op10(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and json.dumps(1)
