"""Byte-pair encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. In each round every pair of neighbours is looked up by binary search
among the sorted keys of the merge table, each word's lowest rank is found by a segmented minimum, and all places of
that rank are merged at once; words without a mergeable pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import table, texts_in, with_text
from .tokens import Words, cache_of, default_vocabulary, is_known, pieces_of

NONE = np.iinfo(np.int64).max
#: Words that a Python worker keeps here.
CACHE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeTable:
    """A vocabulary file as arrays: first symbols by byte, sorted pair keys with their ranks and results, and strings."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.base = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # A symbol is only merged on by later merges than the one that made it: then equal pairs of a word may be merged together.
        rank, first_use, last_made = np.arange(len(merges)), np.full(self.base, NONE), np.full(self.base, -1)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        np.maximum.at(last_made, made, rank)
        self.together = bool((last_made < first_use).all())
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.heads = {t[0] for t in self.specials}
        if spec.get("decoder") is not None or not is_known(spec):
            raise ValueError("a vocabulary with a decoder or rules for words of its own is not supported")
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all words, in order, and how many each word has. No word is empty."""
        word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank, result = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
            inside = np.flatnonzero(word[:-1] == word[1:])
            key = symbols[inside] * self.base + symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[inside[hit]], result[inside[hit]] = self.ranks[at[hit]], self.made[at[hit]]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            lowest = np.minimum.reduceat(rank, first)
            over = np.repeat(lowest == NONE, size)
            place = np.flatnonzero((rank == np.repeat(lowest, size)) & ~over)
            if not self.together:  # only the leftmost
                place = place[np.append(True, word[place][1:] != word[place][:-1])] if len(place) else place
            run = np.flatnonzero(np.append(True, np.diff(place) > 1)) if len(place) else place
            if len(run) < len(place):  # pairs that overlap, as in "aaa": every other one, from the left
                since = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
                place = place[since % 2 == 0]
            symbols[place] = result[place]
            keep = ~over
            keep[place + 1] = False
            done.append((word[over], symbols[over]))
            word, symbols = word[keep], symbols[keep]
        if not done:
            return symbols, np.zeros(0, np.int64)
        words, out = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words, kind="stable")
        return out[order], np.bincount(words, minlength=len(starts))

    def pieces(self, word: str) -> list[bytes | int]:
        """Pre-tokens of a word, with the ids of special tokens between them."""
        out: list[bytes | int] = []
        at = 0
        for m in self.cut.finditer(word) if self.cut and any(c in word for c in self.heads) else ():
            out += self._plain(word[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self._plain(word[at:])

    def _plain(self, text: str) -> list[bytes]:
        return [p.encode() for p in pieces_of(text)]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        flat: list[bytes] = []
        shape: list[list] = []
        for w in words:
            parts = self.pieces(w.decode())
            shape.append([p if isinstance(p, int) else None for p in parts])
            flat += [p for p in parts if not isinstance(p, int)]
        sizes = np.array([len(p) for p in flat], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(flat), np.uint8)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        ids, counts = self.merged(symbols, ends - sizes) if len(flat) else (symbols, sizes)
        data, stops = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        out, i, at = [], 0, 0
        for parts in shape:
            if None in parts and all(p is None for p in parts):
                i += len(parts)
                out.append(data[at : stops[i - 1]])
                at = stops[i - 1]
                continue
            blob = b""
            for p in parts:
                if p is None:
                    blob += data[at : stops[i]]
                    at, i = stops[i], i + 1
                else:
                    blob += p.to_bytes(4, "little")
            out.append(blob)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The strings of the ids with a space between, as a vocabulary file without a decoder asks for."""
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


def merge_words(path: str) -> tuple[MergeTable, Words]:
    kept = cache_of("merge")
    if path not in kept:
        own = MergeTable(path)
        kept[path] = own, Words(own.encode, CACHE_WORDS)
    return kept[path]


def encoded(docs: DataFrame, path: str, digests: bool = False, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs its columns (or those of carry) as `record`, and of its text n_tokens with either ids
    (binary: little-endian unsigned 32-bit) and decoded (string), or with digests ids_sha256 and decoded_sha256.

    Null and empty texts have no ids and decode to ""; repeated rows each count; an empty table gives no rows. No row moves:
    the work follows the partitions of docs.
    """
    rows = with_text(docs, text_col, carry)
    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids binary, decoded string"
    schema = rows.select("record").schema
    for part in tail.split(", "):
        schema = schema.add(*part.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, words = merge_words(path)
        for batch in batches:
            counts, left, right = [], [], []
            for blob in words.blobs(texts_in(batch, text_col)):
                text = table_.decode(np.frombuffer(blob, "<u4"))
                counts.append(len(blob) // 4)
                left.append(hashlib.sha256(blob).hexdigest() if digests else blob)
                right.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
            columns = [batch.column("record"), pa.array(counts, pa.int64()), pa.array(left, pa.string() if digests else pa.binary()), pa.array(right, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def op7_bpe_roundtrip(spark, sf_dir):
    found = encoded(table(spark, sf_dir, "documents"), default_vocabulary(), digests=True, carry=["doc_id"])
    return found.select("record.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
