import hashlib
import random

from barquet.llm import chat


def digests(rows):
    out = {}
    name = lambda v: (v is None, v)
    for conv, turn, role, text in sorted(rows, key=lambda r: (name(r[0]), name(r[1]), name(r[2]), chat.format_turn(r[2], [{"type": "text", "text": r[3]}])["formatted"])):
        n, a, lc, b, fc = out.setdefault(conv, [0, b"", 0, b"", 0])
        loss = (text or "") if role == "assistant" else ""
        out[conv] = [n + 1, a + f"{role or ''}\n{text or ''}\n".encode(), lc + len(loss), b + loss.encode(), fc + len(chat.format_turn(role, [{"type": "text", "text": text}])["formatted"])]
    return sorted(((c, n, hashlib.sha256(a).hexdigest(), lc, hashlib.sha256(b).hexdigest(), fc) for c, (n, a, lc, b, fc) in out.items()), key=str)


def test_conversations_read_back(spark):
    rng = random.Random(1)
    parts = ["<turn>", "</role>", "</turn>\n", "\\", "<", "turn>", "<image>", "é", "text ", "\n", "</", "<\\turn>", "### Assistant:", "<document>"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "system", None, "</role>"]),
             rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])) for _ in range(200)]
    rows += rows[:10] + [(9, i, "assistant", "x" * 2000) for i in range(400)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, TEXT string").repartition(5)
    got = sorted(map(tuple, chat.read_back(chat.format_turns(df)).collect()), key=str)
    assert got == digests(rows)


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(2)
    parts = ["<", "turn>", "/turn>", "\\", "/role>", "image>", "a", "<turn>", "</turn>", "\\<"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(x in e for x in ("<turn>", "</turn>", "</role>", "<image>"))
        assert chat.read_turn(chat.format_turn(t, [{"type": "text", "text": t}])["formatted"]) == (t, t)


def test_typed_parts(spark):
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    parts = [("text", "see <tu", None, None, None, None, None), ("text", "rn> ", None, None, None, None, None), ("image", None, "img/1", 28, 29, None, None),
             ("audio", None, "snd/2", None, None, 2.5, None), ("document", None, None, None, None, None, 3), (None, " done", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [None])], f"conv_id long, turn long, role string, parts {kind}")
    rows = {r["turn"]: r for r in chat.format_turns(df).collect()}
    r = rows[0]
    assert r["formatted"] == "<turn>assistant</role>see <\\turn> <image><audio><document> done</turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "img/1", 6), ("audio", "snd/2", 63), ("document", None, 3072)]
    for a in r["attachments"]:
        assert r["formatted"][a["position"]:].startswith(chat.PLACEHOLDERS[a["kind"]])
    assert r["attachment_tokens"] == 6 + 63 + 3072
    assert r["formatted"][r["loss_start"]:r["loss_end"]] == "see <\\turn> <image><audio><document> done"
    assert chat.read_turn(r["formatted"]) == ("assistant", "see <turn>  done")
    assert rows[1]["formatted"] == rows[2]["formatted"] == "<turn>user</role></turn>\n" and rows[1]["loss_start"] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(df)).collect() == []
