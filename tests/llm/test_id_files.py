import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import evidarium.llm.idfile as idfile
from evidarium.llm.bpe import MergeTable
from evidarium.llm.idfile import pack, read_ids, starts_of, unpack, write_ids
from evidarium.llm.separators import count_flat, write_flat
from evidarium.llm.tokens import LibraryEncoder, Words, default_vocabulary

PATH = default_vocabulary()
TOKENIZER = Tokenizer.from_file(PATH)
ROWS = [(9, "Some text, twice", "x"), (3, None, "x"), (4, "", "x"), (None, "no id", "x"), (7, "long word " * 20_000, "x"), (8, "a <|endoftext|> b", "x"), (1, "tie", "x"), (1, "tie", "x"), *((100 + i, f"document {i} é", "y") for i in range(50))]
SCHEMA = "doc_id long, text string, ids string"


def test_code_of_every_length():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        v = rng.integers(0, 2 ** rng.integers(1, 33, n), n).astype(np.uint32)
        control, data = pack(v)
        assert len(control) == -(-n // 4)
        assert unpack(control, data, n).tolist() == v.tolist()
    edge = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    assert unpack(*pack(edge), len(edge)).tolist() == edge.tolist()
    assert len(pack(edge)[1]) == 2 * (1 + 2 + 3 + 4)


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(idfile, "FILE_DOCUMENTS", 7)
    files = write_ids(spark.createDataFrame(ROWS, SCHEMA).repartition(3), PATH)
    got = starts_of(files).join(read_ids(files), ["file", "place"]).collect()
    assert len(got) == len(ROWS)
    got.sort(key=lambda r: r["start"])
    assert [r["id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    at, text = 0, {r[0]: r[1] for r in ROWS}
    for r in got:
        ids = [*TOKENIZER.encode(text[r["id"]] or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and (r["start"], r["n_ids"]) == (at, len(ids))
        at += len(ids)
    assert write_ids(spark.createDataFrame([], SCHEMA), PATH).documents.count() == 0
    always = spark.range(5).selectExpr("id AS doc_id", "'same' AS text")  # ids that cannot be null
    assert sorted(r["id"] for r in write_ids(always, PATH).documents.collect()) == [0, 1, 2, 3, 4]


def test_counts_of_flat_files(spark):
    end = 49407
    folder, order = write_flat(spark.createDataFrame(ROWS, SCHEMA), PATH, end)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want = sorted(((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS), key=repr)
    for block in (1, 3, 1000, 1 << 22):
        if block < 1000 and block != 3:
            continue
        counts = count_flat(spark, folder, end, block_ids=block * 100)
        assert sorted(((r[0], r[1]) for r in order.join(counts, ["file", "place"]).select("id", "n_tokens").collect()), key=repr) == want


def test_flat_files_of_an_empty_table(spark):
    folder, order = write_flat(spark.createDataFrame([], SCHEMA), PATH, 49407)
    assert order.join(count_flat(spark, folder, 49407), ["file", "place"]).count() == 0


def test_words_of_every_kind_of_character_are_those_of_the_library():
    import random
    import unicodedata

    kinds = {}
    for c in map(chr, [*range(0x3000), *range(0xA000, 0xAC00, 7), *range(0xFB00, 0x10000), *range(0x10000, 0x1F000, 61)]):
        if not 0xD800 <= ord(c) < 0xE000:
            kinds.setdefault(unicodedata.category(c), []).append(c)
    assert len(kinds) > 25
    rng = random.Random(8)
    texts = []
    for _ in range(3000):
        some = "".join(rng.choice(kinds[rng.choice(list(kinds))]) for _ in range(rng.randrange(6)))
        texts.append(some.join(rng.choice(["the", "It's", "WE'LL", "x9", "end.", "Σας", "İ", "<|endoftext|>", " ", "a,b", "É!"]) for _ in range(rng.randrange(1, 5))))
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}, {chr(c)}{chr(c)}" for c in range(1, 0x560)]
    encode = LibraryEncoder(PATH, "<u4")
    own = list(Words(MergeTable(PATH).encode).blobs([t.encode() for t in texts]))
    assert own == list(Words(encode).blobs([t.encode() for t in texts]))
    column = pa.array([*texts, None, "", " \t\n\x0b\x0c\r a  b\x1c\u2003c "])
    blobs = Words(encode).of_column(column)
    assert blobs == list(Words(encode).blobs([(t or "").encode() for t in column.to_pylist()])) == Words(encode).of_column(column.cast(pa.large_string()))
    got = Words(encode).blobs([t.encode() for t in texts])
    for t, blob in zip(texts, got):
        assert np.frombuffer(blob, "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids, repr(t)


def test_documents_across_blocks_and_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    stream = rng.integers(0, 9, 400).astype("<u2")
    stream[50:120] = 1  # no end for many blocks
    cuts = [0, 37, 38, 90, 91, 250, 400]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"p{i}.bin").write_bytes(stream[a:b].tobytes())
    (tmp_path / "p9.bin").write_bytes(b"")
    want, start = [], 0
    for i in np.flatnonzero(stream == 0).tolist():
        want.append((len(want), start, i - start, True))
        start = i + 1
    if start < len(stream):
        want.append((len(want), start, len(stream) - start, False))
    for block in (1, 7, 1000):
        got = count_flat(spark, f"file://{tmp_path}", 0, block_ids=block).select("number", "start", "n_tokens", "ended").collect()
        assert sorted(map(tuple, got)) == want


def test_vocabularies_that_encode_blanks_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")


def test_other_vocabularies_that_part_words(tmp_path):
    """One that is split otherwise than the known one, and has no suffix."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz.?")} | {"<unk>": 28}
    other = Tokenizer(models.BPE(letters | {"ab": 29, "abc": 30}, [("a", "b"), ("ab", "c")], unk_token="<unk>"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.add_special_tokens(["<end>"])
    other.save(f"{tmp_path}/other.json")
    words = Words(LibraryEncoder(f"{tmp_path}/other.json", "<u2"))
    for text in ("abc ab a.b", " x\nabc?  é", "", "zz\tabcabc"):
        want = np.array(other.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        assert list(words.blobs([text.encode()])) == [want]
