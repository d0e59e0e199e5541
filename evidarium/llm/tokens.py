"""Encoding of texts word by word with a bounded cache.

The vocabulary's pre-tokenizer never joins what ASCII white space separates, and its normaliser changes nothing across
it, so a text's ids are those of its words in turn. A word is encoded once and then found in a dict.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import regex

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: What pieces_of does, as a vocabulary file says it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}

#: The first character behind the Latin, Greek and Cyrillic ones.
OTHERS = "\u0530"
#: Marks that make a piece of their own behind letters.
MARKS = frozenset(",.;:!?)")
#: Words kept by a Python worker, about 200 bytes each, in two halves: when the newer is full, the older goes.
CACHE_WORDS = 1_000_000
#: Pieces of words that it keeps, likewise.
CACHE_PIECES = 800_000
#: Columns of more bytes get 64-bit offsets.
LONG_BYTES = 1 << 28
#: Bytes of text that are split at a time.
GROUP_BYTES = 4 << 20

#: Words by which a vocabulary is tried.
PROBE = ("word", "Two.", "3rd", "it's", "é", "日本語", "(x)", "--", "a", "...", "#12")

_caches: dict[str, dict] = {}


def cache_of(owner: str) -> dict:
    """What this worker keeps from task to task for one operator. A worker outlives its tasks and may run several operators
    in turn, so what it kept for others goes."""
    if owner not in _caches:
        import pyarrow as pa

        _caches.clear()
        pa.default_memory_pool().release_unused()
    return _caches.setdefault(owner, {})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(text: str) -> list[str]:
    """Normalised pre-tokens of a text without special tokens. Characters from OTHERS on are left to the library, as its
    tables of letters may be older or newer than Python's."""
    if text.isascii():
        text = text.lower()
    elif max(text) < OTHERS:
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # without the rule for a last sigma
    else:
        normalizer, splitter = library_parts()
        return [piece for piece, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]
    return [text] if text.isascii() and text.isalpha() else PIECES.findall(text)


@cache
def library_parts():
    """NORMALIZER and SPLITTER as objects of the library."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
    return normalizer, pre_tokenizers.Split(Regex(SPLITTER["pattern"]["Regex"]), behavior="removed", invert=True)


def is_known(spec: dict) -> bool:
    """Whether pieces_of does what this vocabulary file asks for."""
    return spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"]["pretokenizers"][0] == SPLITTER


def pieces_of_words(words: list[bytes]) -> list[str | tuple[str, ...]]:
    """For each of many words without white space its piece, or a tuple of its pieces. Words of ASCII letters, with or
    without one mark behind them, need no regex."""
    plain = iter(b"\n".join([w for w in words if w.isascii()]).decode().lower().split("\n"))
    out: list[str | tuple[str, ...]] = []
    for word in words:
        if not word.isascii():
            out.append(tuple(pieces_of(word.decode())))
        elif (w := next(plain)).isalpha():
            out.append(w)
        elif w[-1:] in MARKS and w[:-1].isalpha():
            out.append((w[:-1], w[-1]))
        else:
            out.append(tuple(PIECES.findall(w)))
    return out


class Kept:
    """Results of work on keys, in two halves: when the newer is full, the older goes."""

    def __init__(self, work: Callable[[list], list], most: int):
        self.work, self.most, self.newer, self.older = work, most, {}, {}

    def having(self, keys: set) -> dict:
        """A dict that has the results of all these keys."""
        unseen = keys.difference(self.newer)
        if 2 * (len(self.newer) + len(unseen)) > self.most:
            self.newer, self.older, unseen = {}, self.newer, keys
        known = unseen.intersection(self.older)
        self.newer.update(zip(known, map(self.older.__getitem__, known)))
        new = list(unseen.difference(known))
        self.newer.update(zip(new, self.work(new)))
        return self.newer


class Words:
    """ids of texts, as little-endian bytes of the given width."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int | None = None):
        self.kept = Kept(encode, most or CACHE_WORDS)

    def blobs(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text. Texts go in groups, so that many unseen words are encoded together."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP_BYTES:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def of_column(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow column, null as empty. Words are parted, told apart and joined by Arrow; only
        those that differ are seen here."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if texts.nbytes > LONG_BYTES:  # ids may take more bytes than their text, and 32-bit offsets end at 2 GB
            texts = texts.cast(pa.large_string())
        kind = pa.binary() if texts.type == pa.string() else pa.large_binary()
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, "")).cast(pa.list_(kind))
        words = parts.values.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        collects = gc.isenabled()
        gc.disable()  # there are many small objects and no cycles here
        try:
            get = self.kept.having(set(distinct)).__getitem__
            ids = pa.array(list(map(get, distinct)), kind)
        finally:
            if collects:
                gc.enable()
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids.take(words.indices)), pa.scalar(b"", kind)).to_pylist()

    def _group(self, texts: list[bytes]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # there are many lists and no cycles here
        try:
            words = [t.split() for t in texts]
            get = self.kept.having(set(chain.from_iterable(words))).__getitem__
            return [b"".join(map(get, w)) for w in words]
        finally:
            if collects:
                gc.enable()


class LibraryEncoder:
    """Encodes words with the tokenizers library. Many words go as one text with the end-of-text token between them,
    which the library cuts out before anything else; words that hold a special token's string go alone.

    Where the vocabulary's normaliser and splitter are those of pieces_of, words are cut into pieces here and the library
    merges each piece once, as few pieces make up many words. The last symbol of a piece has the vocabulary's suffix, so
    the ids of many pieces in one text fall apart by that.
    """

    SLICE = 256

    def __init__(self, path: str, width: str, literal_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.apart = [s.encode() for s, _ in specials]
        self.between, self.cut = specials[-1]
        self.literal = literal_specials
        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"].get("end_of_word_suffix")
        self.known = is_known(spec) and bool(suffix)
        if not self.known and not self.parts_words():
            raise ValueError(f"{path} encodes the white space between words, so a text's ids are not those of its words")
        if self.known:
            from tokenizers import pre_tokenizers

            self.pieces = Kept(self.merged, CACHE_PIECES)
            self.merger = Tokenizer.from_file(path)
            self.merger.normalizer = None
            self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for s, i in vocab.items() if s.endswith(suffix)]] = True

    def parts_words(self) -> bool:
        """Whether the ids of words in a text are those of the words alone, for words of all kinds and any white space."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        alone = [i for w in PROBE for i in ids(w)]
        return all(ids(blank.join(PROBE)) == alone for blank in (" ", "  ", "\n", "\r\n\n", "\t", " \x0b\x0c"))

    def alone(self, word: bytes) -> bytes:
        self.tokenizer.encode_special_tokens = self.literal
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = False
        return np.array(ids, self.width).tobytes()

    def __call__(self, words: list[bytes]) -> list[bytes]:
        whole = b" ".join(words)
        if not any(s in whole for s in self.apart):
            return self.plain(words)
        odd = {w for w in words if any(s in w for s in self.apart)}
        found = iter(self.plain([w for w in words if w not in odd]))
        return [self.alone(w) if w in odd else next(found) for w in words]

    def plain(self, words: list[bytes]) -> list[bytes]:
        if self.known:
            return self.by_pieces(pieces_of_words(words))
        out: list[bytes] = []
        slices = [words[i : i + self.SLICE] for i in range(0, len(words), self.SLICE)]
        for x, e in zip(slices, self.tokenizer.encode_batch_fast([self.between.join(map(bytes.decode, x)) for x in slices], add_special_tokens=False)):
            ids = np.array(e.ids, self.width)
            ends = np.append(np.flatnonzero(ids == self.cut), len(ids))
            assert len(ends) == len(x)
            out += cut_at(ids, np.append(0, ends[:-1] + 1), ends)
        return out

    def by_pieces(self, parts: list[str | tuple[str, ...]]) -> list[bytes]:
        distinct = {p for p in parts if p.__class__ is str}
        distinct.update(chain.from_iterable(p for p in parts if p.__class__ is tuple))
        get = self.pieces.having(distinct).__getitem__
        return [get(p) if p.__class__ is str else b"".join(map(get, p)) for p in parts]

    def merged(self, pieces: list[str]) -> list[bytes]:
        slices = [pieces[i : i + self.SLICE] for i in range(0, len(pieces), self.SLICE)]
        out: list[bytes] = []
        for x, e in zip(slices, self.merger.encode_batch_fast([" ".join(x) for x in slices], add_special_tokens=False)):
            ids = np.array(e.ids, self.width)
            ends = np.flatnonzero(self.last[ids]) + 1
            assert len(ends) == len(x)
            out += cut_at(ids, np.append(0, ends[:-1]), ends)
        return out


def cut_at(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, size = ids.tobytes(), ids.itemsize
    return [raw[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist())]


def library_words(path: str, width: str, literal_specials: bool = False) -> Words:
    """The worker's own encoder with its cache; lasts from task to task."""
    kept, key = cache_of("library"), (path, width, literal_specials)
    if key not in kept:
        kept[key] = Words(LibraryEncoder(path, width, literal_specials))
    return kept[key]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def texts_of(column) -> list[bytes]:
    """A string column of Arrow as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]
