import random

from pyspark.sql import functions as F

from rowsmith.llm import chat

ODD = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|a", "<\\\\|", "\\", "<", "|", "<<|", "[\\/INST]", "é🙂\x00", "$1 \\2", "</s", "[INST", "\n"]


def test_round_trip_of_any_text(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a\\n\nb", "<|x", "a\x00b", "\\", "\\\\n", "\x00\\n\x00", None]), rng.choice([text, text, None])))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.streamed(df, "conv_id", "turn", "role", "text"))
    out = out.select("conv", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("loss"), "formatted")
    got = {r.conv: r for r in out.collect()}
    for conv in range(60):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in own]
        assert [tuple(t) for t in got[conv].t] == want
        assert got[conv].loss == "".join(t for role, t in want if role == "assistant")


def fold(events):
    """The same by hand: events of one conversation, in order."""
    messages = {}
    for seq, message, kind, role, text in sorted(events, key=lambda e: e[0]):
        m = messages.setdefault(message, {"first": seq, "role": "", "text": ""})
        if kind == "start" and not m["role"]:
            m["role"] = role or ""
        if kind in ("edit", "regenerate"):
            m["text"] = ""
        if kind in ("delta", "edit"):
            m["text"] += text or ""
    return [(m["role"], m["text"]) for m in sorted(messages.values(), key=lambda m: m["first"])]


def test_fold_of_edits_and_regenerations(spark):
    rng = random.Random(9)
    rows, seq = [], 0
    for conv in range(40):
        for message in rng.sample(range(100), rng.randint(1, 4)):
            rows.append((conv, seq, message, "start", rng.choice(["user", "assistant"]), None))
            seq += 1
            for _ in range(rng.randint(0, 8)):
                rows.append((conv, seq, message, rng.choice(["delta", "delta", "edit", "regenerate"]), None, rng.choice(["a", "bc", None, "<|"])))
                seq += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv long, seq long, message long, kind string, role string, text string")
    got = chat.format_log(df).select("conv", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r.conv: [tuple(t) for t in r.t] for r in got} == {c: fold([r[1:] for r in rows if r[0] == c]) for c in range(40)}
    assert chat.format_log(df.limit(0)).count() == 0


def test_mask_covers_what_the_assistant_says(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<|x|>"), (1, 2, "assistant", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.format_log(chat.streamed(df, "conv_id", "turn", "role", "text")).first()
    assert "".join(s.text for s in r.segments) == r.formatted
    assert [s.text for s in r.segments if s.loss] == ["<\\|x\\|>".replace("\\|>", "|>"), "two"]
