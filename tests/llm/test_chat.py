import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import evidarium.llm.chat as chat
from evidarium.llm.chat import op11_chat_windows, read_back, spans_of, turns_in, unescape, windows
from evidarium.llm.tokens import default_vocabulary, library_words

SCHEMA = "conv_id long, turn int, role string, text string, id int, block string"
ODD = ["</s>", "<|", "|>", "<s>", "[INST]", "[/INST]", "\\", "<", "|", "[", ">", "s>", "INST]", "/s>", "\n", "ok", "<|user|>", "<\\|", "<\\\\/s>", "é", "日", "|\\>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    """Digests of a conversation from its own turns."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(9))) for _ in range(2000)] + ["</s>[INST] ok [/INST]", "<" + "\\" * 10_000 + "|"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(chat.F.col("t")).alias("e")).collect()
    for t, e in got:
        assert unescape(e) == t
        assert not any(mark in e for mark in ("</s>", "<s>", "<|", "|>", "[INST]", "[/INST]"))
        assert [x[:2] for x in turns_in(f"<|{e}|>{e}</s>\n<|{e}|></s>\n")] == [(t, t), (t, "")]


@given(st.lists(st.integers(1, 30), max_size=30), st.integers(1, 40), st.integers(0, 20), st.integers(0, 5))
@settings(max_examples=300, deadline=None)
def test_spans(tokens, budget, history, first):
    first, at = min(first, len(tokens)), min(first, len(tokens))
    for h, i, j in spans_of(tokens, first, budget, history):
        assert h <= i == at < j
        assert sum(tokens[h:j]) <= budget or (h == i and j == i + 1)
        assert sum(tokens[h:i]) <= history
        if j < len(tokens) and j > i + 1 or sum(tokens[h:j]) <= budget and j < len(tokens):
            assert sum(tokens[h : j + 1]) > budget  # nothing more would have fitted
        if h and h < i or h == i > 0 and budget > tokens[i]:
            assert sum(tokens[h - 1 : i]) > min(history, budget - tokens[i])
        at = j
    assert at == len(tokens)


def table(spark, conversations):
    rows = [(c, k, r, t, 1, "x") for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def conversations():
    rng = random.Random(4)
    text = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(["ok", "words", "</s>", "<|user|>", "", "é"]) for _ in range(rng.randrange(40)))
    out = {}
    for c in [None, *range(40)]:
        head = [("system", text())] if rng.random() < 0.5 else []
        out[c] = head + [(rng.choice(["user", "assistant", "assistant", None, "tool|>", "system"]), text()) for _ in range(rng.choice([0, 1, 2, 9, 30]))]
    out[99] = [("system", "be brief")] + [(("user", "assistant")[k % 2], f"turn {k} " * (k % 7)) for k in range(600)]  # a third of all
    out[98] = [("assistant", "long " * 3000), ("user", "a"), ("assistant", "b"), ("assistant", "long " * 3000)]
    out[97] = [("system", "only")]
    return {c: t for c, t in out.items() if t}


@pytest.mark.parametrize("budgets", [2, 64])
def test_windows(spark, monkeypatch, budgets):
    monkeypatch.setattr(chat, "BLOCK_BUDGETS", budgets)
    given_, budget, history = conversations(), 120, 40
    words = library_words(default_vocabulary(), "<u4", literal_specials=True)
    made = windows(table(spark, given_), default_vocabulary(), budget, history).collect()
    for c, turns in given_.items():
        turns = [(r or "", t or "") for r, t in turns]
        own = sorted((w for w in made if w["id"] == c), key=lambda w: (w["block"], w["window"]))
        seen, masked = [], []
        for k, w in enumerate(own):
            shown = [x[:2] for x in turns_in(w["formatted"])]
            count = [len(b) // 4 for b in words.blobs([(part + "</s>\n").encode() for part in w["formatted"].split("</s>\n")[:-1]])]
            new = len(shown) - w["repeated"]
            head = turns[0][0] == "system"
            assert sum(count) == w["tokens"] and (w["tokens"] <= budget or new == 1 + (head and k == 0))
            if head:
                assert shown[0] == turns[0]
            past = shown[head * (k > 0) : w["repeated"]] if k else []
            assert past == seen[len(seen) - len(past) :] and sum(count[head * (k > 0) : w["repeated"]]) <= history
            seen += shown[w["repeated"] :]
            masked += [unescape(w["formatted"][s["start"] : s["end"]]) for s in w["loss"]]
        assert seen == turns and masked == [t for r, t in turns if r == "assistant"]
    assert len(made) > 60 and any(w["repeated"] > 1 for w in made)


def test_read_back(spark):
    given_ = conversations()
    got = {r["id"]: r for r in read_back(windows(table(spark, given_), default_vocabulary(), 200, 50)).collect()}
    assert set(got) == set(given_)
    assert all((r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(given_[c]) for c, r in got.items())
    assert windows(table(spark, given_).limit(0), default_vocabulary()).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a", 1, "x")] * 3, SCHEMA)
    assert read_back(windows(twice, default_vocabulary())).first()["n_turns"] == 3
    with pytest.raises(ValueError):
        windows(twice, default_vocabulary(), 10, 10)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = op11_chat_windows(spark, sf)
    assert {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"} <= set(got.columns)
    got = got.collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: expected(t) for c, t in want.items()}
    assert len(got) == len(want) and all(r["formatted_chars"] > r["loss_chars"] for r in got)
