"""Chat formatting: exact round trips, hostile texts, plain-Python digests."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from talentmesh.llm import chat

T = chat.Template()
TURNS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def text(t):
    return ("text", t, None, None, None, None, None)


def hostile(r):
    bits = [*T.controls(), *(c[0] + "\\" * r.randint(1, 3) + c[1:] for c in T.controls()), "<", "[", "\\", "/s>", "|turn|>", "INST]", "é", "\n", "", "ok "]
    return "".join(r.choice(bits) for _ in range(r.randint(0, 12)))


def turns_of(seed, n=60):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randint(1, 6)):
            parts = []
            for _ in range(r.randint(1, 4)):
                kind = r.choice(["text", "text", "image", "audio", "document", "video", None])
                if kind in ("text", None):
                    parts.append((kind, hostile(r) + ".", None, None, None, None, None))
                else:
                    parts.append((kind, None, f"s3://x/{r.randrange(99)}", r.choice([None, 100]), 57, r.choice([None, 1.5]), r.choice([None, 3])))
            out.append((c, t, r.choice(["user", "assistant", "system", "</s>", ""]), parts))
    r.shuffle(out)
    return out


def tokens(p):
    kind, _, _, w, h, s, pages = p
    if kind == "image":
        return 256 if w is None else -(-w // 28) * -(-h // 28)
    if kind == "audio":
        return 0 if s is None else -int(-s * 25 // 1)
    return (1 if pages is None else pages) * 512 if kind == "document" else 0


@pytest.mark.parametrize("chunk", [40, 1 << 18])
def test_parts_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_CHARS", chunk)
    rows = turns_of(1)
    df = spark.createDataFrame(rows, TURNS).withColumn("text", F.lit("clash")).withColumn("head", F.lit(1))
    made = chat.format_conversations(df)
    want = {}
    for c, t, role, parts in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(c, []).append((role, [("text", p[1], None, 0) if p[0] in ("text", None) else (p[0], None, p[2], tokens(p)) for p in parts]))
    got = {}
    for r in chat.read_back(made).collect():
        got.setdefault(r["conv_id"], []).append((r["role"], [(p["kind"], p["text"], p["uri"], p["tokens"]) for p in r["parts"]]))
        lost = "".join(p["text"] or "" for p in r["parts"]) if r["role"] == "assistant" else ""
        assert r["loss_text"] == lost
    assert got == want
    chunks = {}
    for r in made.collect():
        chunks.setdefault(r["conv_id"], []).append(r)
    for c, parts in chunks.items():
        parts.sort(key=lambda r: r["chunk"])
        whole = "".join(p["text"] for p in parts)
        assert [p["start"] for p in parts] == [sum(len(q["text"]) for q in parts[:k]) for k in range(len(parts))]
        for p in parts:
            for a in p["attachments"]:
                assert any(whole.startswith(m, a["at"]) for _, m in T.media)
    if chunk == 40:
        assert max(map(len, chunks.values())) > 1


def plain_digests(rows):
    convs = {}
    for c, t, role, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", x or ""))
    out = {}
    for c, turns in convs.items():
        lost = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(lost), sha256(lost.encode()).hexdigest())
    return out


def test_digests_nulls_ties_hot_and_long(spark):
    r = random.Random(3)
    rows = [(r.randrange(20), r.randrange(9), r.choice(["user", "assistant", None]), r.choice([hostile(r), None, ""])) for _ in range(150)]
    rows += [(99, t, "assistant" if t % 2 else "user", hostile(r)) for t in range(400)]
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (5, None, "user", "first"), (98, 0, "assistant", "</s>" * 100_000), (97, 1, "user", "same"), (97, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("chars", F.lit(0))
    made = chat.format_conversations(df, chat.text_parts("text"))
    got = {d["conv_id"]: d for d in chat.digests(chat.read_back(made)).collect()}
    assert {c: (d["n_turns"], d["turns_sha256"], d["loss_chars"], d["loss_sha256"]) for c, d in got.items()} == plain_digests(rows)
    sizes = {}
    for row in made.collect():
        sizes[row["conv_id"]] = sizes.get(row["conv_id"], 0) + len(row["text"])
    assert sizes == {c: d["formatted_chars"] for c, d in got.items()}


def test_null_and_empty_parts_and_empty_table(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", []), (1, 2, "user", [None, text("x"), text("")])]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()
    assert [r["text"] for r in got] == ["", "", "x"] and len(got[2]["parts"]) == 2
    none = chat.format_conversations(spark.createDataFrame([], TURNS))
    assert none.collect() == [] and chat.digests(chat.read_back(none)).collect() == []


def test_texts_that_meet_make_no_mark(spark):
    rows = [(1, 0, "assistant", [text("<"), text("/s>")]), (1, 1, "user", [text("<\\"), ("image", None, "u", None, None, None, None), text("/s>")])]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()
    assert [[p["text"] for p in r["parts"]] for r in got] == [["<", "/s>"], ["<\\", None, "/s>"]]


def test_foreign_text_and_bad_templates_are_refused(spark):
    bad = spark.createDataFrame([(1, 0, 0, "hello", [], [])], chat._CHUNKS)
    with pytest.raises(Exception, match="no turn at character 0"):
        chat.read_back(bad).collect()
    with pytest.raises(ValueError):
        chat.Template(turn="<a<b>")
