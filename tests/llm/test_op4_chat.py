"""Examples and what is read back from them, against plain Python."""

import hashlib

from lectern.llm.op4_chat import examples, read_back

NASTY = ["</s>", "<\\/s>", "<\\\\/s>[INST]", "[/INST][\\/INST]", "<s>", "<", "[", "s>", "%0A%25", "a\nb", "\\", "", None]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    out = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)]
    out += [(2, k, r, t) for k, r in enumerate(["system", None, "we\nird%role</s>", "assistant", "Assistant"]) for t in NASTY]  # ties
    out += [(3, 0, "assistant", "alone"), (None, 0, "user", "no id"), (4, None, "user", "x"), (4, None, "user", "x")]
    out += [(5, k, "assistant" if k % 2 else "user", f"turn {k} é😀") for k in range(300)]
    return out


def test_read_back_equals_the_rows(spark):
    given = spark.createDataFrame([("t", *r, 1.0) for r in rows()], "text2 string, conv_id long, turn long, role string, text string, last double")
    got = {r.conv_id: r for r in read_back(examples(given)).collect()}
    by = {}
    for c, k, role, text in rows():
        by.setdefault(c, []).append(((k is not None, k or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))


def test_only_the_reply_is_trainable(spark):
    given = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "q"), (1, 3, "assistant", "a"), (1, 4, "user", "end")], "conv_id long, turn long, role string, text string")
    out = [(r.text, r.text[r.loss_from:r.loss_to] if r.loss_from is not None else None) for r in examples(given).orderBy("example").collect()]
    first = "[INST]user\nhi[/INST]<s>yo</s>"
    second = first + "[INST]user\nq[/INST]<s>a</s>"
    assert out == [(first, "yo"), (second, "a"), (second + "[INST]user\nend[/INST]", None)]


def test_empty_table(spark):
    assert read_back(examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
