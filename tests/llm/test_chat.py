import hashlib

from quern.llm import chat

ODD = [
    (1, 0, "system", "be < brief >"), (1, 1, "user", "<turn>user<says>\\l\\b</turn>"), (1, 2, "assistant", "\\<\\\\l</turn>é"), (1, 3, "user", "tail"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", ""), (3, 1, "assistant", None), (4, 1, None, "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "y"),
    (4, None, "user", "first"), (None, 0, "assistant", "z"), (5, 0, "assistant", "long " * 20_000), (6, 0, "weird<role>\\", "a"), (6, 1, "assistant", "b\nc"),
]


def brute(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in talks.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        coded = lambda s: s.replace("\\", "\\b").replace("<", "\\l")
        shown = [len(f"<turn>{coded(r)}<says>{coded(t)}</turn>") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        total = sum(sum(shown[: k + 1]) for k, (r, _) in enumerate(turns) if r == "assistant" or k == len(turns) - 1)
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), total))
    return sorted(out, key=str)


def test_round_trip_of_odd_texts(spark):
    rows = spark.createDataFrame([(*r, 1) for r in ODD], "conv_id long, turn long, role string, text string, example int")
    assert sorted(map(tuple, chat.read_back(chat.examples(rows)).collect()), key=str) == brute(ODD)


def test_only_replies_are_trainable(spark):
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    got = chat.examples(rows).where("conv_id = 1").orderBy("example").collect()
    assert len(got) == 2 and got[1].loss_start == got[1].loss_end == 0
    assert got[0].text[got[0].loss_start : got[0].loss_end] == "\\b\\l\\b\\bl\\l/turn>é" and got[1].text.startswith(got[0].text)


def test_conversations_and_empty_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    assert sorted(map(tuple, chat.op6_chat(spark, sf_dir).collect()), key=str) == brute(rows)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.examples(none)).count() == 0
