import hashlib
import random

from compare import connect, differences

from earshot.llm.chat import chat_report, format_chats, read_chats, report_sql, sample_chat
from earshot.llm.plans import op11_chat_format

KIND = "conv_id long, turn long, role string, text string, formatted string"


def odd_rows():
    rng = random.Random(2)
    pieces = ["\\", "\\b", "\\l", "\\h", "\\c", "<", "#", "### ", "</turn>\n", "</part>", "</turn>", ": ", "assistant: ", "é", "𝔘", "a", "\n", "", " ", "\x00"]
    rows = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "", None, "a: #<\\c", "to\nol"])
            text = rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))])
            rows.append((conv, rng.choice([turn, turn, 3, None]), role, text, "x"))
    rows += [(None, 0, "user", "nobody's", "x"), (None, 1, "assistant", "answer", "x")]
    rows += [(500, t, "assistant" if t % 3 else "user", f"turn {t} é<#\\", "x") for t in range(3000)]
    rows += [(501, 0, "assistant", "long <é " * 200_000, "x"), (502, 1, "user", "only", "x"), (503, 0, "assistant", "x", "x"), (503, 0, "assistant", "x", "x")]
    return rows


def by_conversation(rows):
    chats = {}
    for conv, turn, role, text, *_ in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [r[2:] for r in sorted(said)] for conv, said in chats.items()}


def test_reads_back_exactly(spark):
    rows = odd_rows()
    chats = by_conversation(rows)
    read = read_chats(format_chats(spark.createDataFrame(rows, KIND).repartition(5))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read} == chats
    for r in read:
        assert r.loss_text == "".join(text for role, text in chats[r.conv_id] if role == "assistant")
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in chats[r.conv_id])
        data = r.formatted.encode()
        assert all(b"<" not in data[s.start : s.end] and b"#" not in data[s.start : s.end] for s in r.loss_spans)
        runs = sum(i == 0 or role != chats[r.conv_id][i - 1][0] for i, (role, _) in enumerate(chats[r.conv_id]))
        assert r.formatted.count("</turn>\n") == r.formatted.count("### ") == runs


def test_neighbours_of_one_role_are_one_turn(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b<"), (1, 3, "user", None)]
    got = format_chats(spark.createDataFrame(rows, KIND.rsplit(",", 1)[0])).first()
    assert got.formatted == "### user: a</turn>\n### assistant: b\\l</part>c</turn>\n### user: </turn>\n"
    assert [got.formatted[s.start : s.end] for s in got.loss_spans] == ["b\\l", "c"]


def test_digests(spark):
    got = {r.conv_id: r for r in chat_report(sample_chat(spark, spark.createDataFrame([], KIND))).collect()}
    text = "\\### Assistant: </turn> ok"
    assert list(got) == [-7] and got[-7].n_turns == 2 and got[-7].loss_chars == len(text)
    assert got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_same_as_sql(spark, tmp_path):
    rows = [r for r in odd_rows() if "\x00" not in (r[3] or "")]
    folder = str(tmp_path / "t")
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet/*.parquet')")
    assert differences(op11_chat_format(spark, folder), con, report_sql()) == []
    sf = "/root/testdata/sf0.001"
    assert differences(op11_chat_format(spark, sf), connect(sf), report_sql()) == []


def test_empty_table_and_no_python(spark):
    empty = spark.createDataFrame([], KIND)
    assert format_chats(empty).collect() == []
    plan = format_chats(spark.createDataFrame(odd_rows()[:3], KIND))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
