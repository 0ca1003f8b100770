import hashlib
import re

import __spark_entry__
from tracewell.plans import adapters, catalog

SF = "/root/testdata/sf0.001"


def sides(body):
    local, incoming, side = [], [], 0
    for line in re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", body)):
        if line.startswith("<<<<<<<"):
            side = 1
        elif line.startswith("=======") and side == 1:
            side = 2
        elif line.startswith(">>>>>>>") and side == 2:
            side = 0
        else:
            if side != 2:
                local.append(line)
            if side != 1:
                incoming.append(line)
    return [hashlib.sha256("".join(x + "\n" for x in s).encode()).hexdigest() for s in (local, incoming)]


def check_conflicts(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").collect()
    got = sorted(((r.conv_id, r.turn), r.local_sha256, r.incoming_sha256) for r in __spark_entry__.queries()["conflict_split"](spark, d).collect())
    body = "{{\n<<<<<<< ours\n{1}\n=======\n{0}\n{1}\n>>>>>>> theirs\n}}\n"
    assert got == sorted(((r.conv_id, r.turn), *sides(body.format(r.role or "", r.text or ""))) for r in rows)


def test_conflicts_of_every_row_of_conversations(spark):
    check_conflicts(spark, SF)


def test_conflicts_of_texts_with_markers(spark, tmp_path):
    texts = ["a", "", None, "x\n=======\ny", "<<<<<<< in\nz", "a\n>>>>>>> b\nc", "=======\n>>>>>>> q\nr\r\ns", "<<<< four"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    check_conflicts(spark, str(tmp_path))


def test_whole_documents_as_edits(spark):
    def like(line):
        return re.sub(f"{space}+", " ", re.sub(f"{space}+$", "", line).translate(str.maketrans("\u2018\u2019\u201c\u201d", "''\"\"")))

    space = "[\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
    want = {}
    for r in adapters.twins(spark, SF).collect():
        lines, other = r.text.split("\n"), r.other.split("\n")
        for how, make in (("exact", lambda x: x), ("normalized", like)):
            n, o = [y for x in lines if (y := make(x))], [make(x) for x in other]
            at = next((i for i in range(len(o) - len(n) + 1) if n and o[i : i + len(n)] == n), None)
            if at is not None:
                want[r.pair] = (at + 1, at + len(n), how)
                break
        else:
            if min(len(lines), len(other)) * 2 >= len(lines):
                want[r.pair] = (1, len(other), "proximity")
    got = {r.pair: (r.match_start, r.match_end, r.strategy) for r in catalog.QUERIES["edit_matching"](spark, SF).collect()}
    assert got == want
