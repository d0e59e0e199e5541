import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from evidarium.llm.bpe import MergeTable, encoded
from evidarium.llm.tokens import LibraryEncoder, Words, default_vocabulary

PATH = default_vocabulary()
TEXTS = [
    None, "", " \n\t ", "Hello, World's  don't 'tis I'LL 42nd", "<|endoftext|>a<|startoftext|>B<|endoftext|>", "x<|endoftext|", "ÉCOLE école ΣΑΣ ς İstanbul ǅ ﬁ",
    "a\x1cb\x85c d e　f​g", "日本語テキスト 中文 العربية हिन्दी 🎉🎉👨‍👩‍👧", "aaaa aaaaaaa hahahahahaha", "\x00\x01 nul", "word " * 3000, "z" * 5000, "'s's't're're've", "١٢٣ ²³ Ⅷ", "tab\tnew\nline\x0b\x0c\r end",
]


def fuzz(n):
    rng = random.Random(5)
    pool = "abcdehilnorstABC 's'.,!?0123456789éèñßçüΣσİıǆ̧́   \t\n<|>日本語🎉가각"
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    t = TOKENIZER
    ids = t.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)


def test_merge_rounds_equal_the_library():
    table, t = MergeTable(PATH), Tokenizer.from_file(PATH)
    assert table.together
    words = Words(table.encode)
    texts = TEXTS + fuzz(1500)
    for text, blob in zip(texts, words.blobs([(x or "").encode() for x in texts])):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(blob, "<u4").tolist() == ids, text
        assert table.decode(np.frombuffer(blob, "<u4")).decode() == t.decode(ids, skip_special_tokens=False)


def test_one_merge_at_a_time_gives_the_same():
    table = MergeTable(PATH)
    texts = [t.encode() for t in fuzz(200)]
    together = list(Words(table.encode).blobs(texts))
    table.together = False
    assert list(Words(table.encode).blobs(texts)) == together


def test_library_encoder_and_cache(monkeypatch):
    import evidarium.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 200)
    texts = TEXTS + fuzz(1500)
    encoder = LibraryEncoder(PATH, "<u4")
    assert encoder.known
    want = [library(x)[0] for x in texts]
    assert list(Words(encoder).blobs([(x or "").encode() for x in texts])) == want
    encoder.known, encoder.merger = False, encoder.tokenizer
    assert list(Words(encoder).blobs([(x or "").encode() for x in texts])) == want


def test_encoded_over_a_table(spark):
    rows = [(i, t, "ids", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (1, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, record string, n_tokens long")
    want = sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    out = encoded(docs, PATH).select("record.doc_id", "record.text", "n_tokens", "ids", "decoded").collect()
    assert sorted(((r[0], r[1] or "") for r in out), key=repr) == want
    for r in out:
        assert (bytes(r["ids"]), r["decoded"]) == library(r["text"])
    for r in encoded(docs, PATH, digests=True, carry=["text"]).select("record.text", "n_tokens", "ids_sha256", "decoded_sha256").collect():
        blob, decoded = library(r["text"])
        assert (r[1], r[2], r[3]) == (len(blob) // 4, hashlib.sha256(blob).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert encoded(docs.limit(0), PATH).count() == 0
