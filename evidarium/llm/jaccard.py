"""Near-duplicate join: Jaccard similarity of word shingles by prefix filters under several global orders.

Two sets of sizes m and n with a similarity of at least 3/4 share at least 3/4 of either, so under any order of all
shingles that holds for every document, the first n/4 + 1 of each share one. Three orders are used: rarest first with
ties by hash, rarest first with ties by falling hash, and hash alone. A pair is compared only if it shares a prefix
shingle under each of them.

1. Each text becomes a set of 64-bit shingle hashes; equal sets form a class, named by the hash of the set. In what
   follows a shingle is known by 48 bits and the number of its bucket, so by 64 bits once there are 65,536 buckets.
2. Shingles are dealt by hash, packed as arrays, and those of a single class are dropped. The others go back to their
   classes with the number of classes that have them. Shingles of a large share of all rows are found beforehand and go
   straight back. A class of which the prefix under rarity has no shared shingle has
   no partner and is dropped; for the rest, the shared shingles hold all that an intersection can have.
3. Classes with a common prefix shingle under the first order are candidates if what comes before it leaves room for the
   similarity. In small groups all such pairs go on to the filters of the other orders, then to the comparison of sets.
4. A large group would have too many. Each of its classes is compared with the group's hub, the one with the fewest
   shingles of its own, and is from then on known by its differences from it. Two classes are similar just when the
   differences that they have in common outweigh the rest (see `unlike`), so classes near the hub are one component, and
   a pair with any other must share one of a few rare differences: a second prefix filter, within the group.
   No pair is left out that could join two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, texts_in, with_text
from .graph import components
from .tokens import cache_of, texts_of

SHINGLE = 5
GROUP_BYTES = 4 << 20
CACHE_WORDS = 200_000
#: Shingles that a task sorts at a time, on average.
BUCKET_SHINGLES = 700_000
#: A shingle is frequent if it may be in more than one of so many rows. Those are known beforehand (OFTEN times the mean
#: size of a set, at most), count as equally common, and never meet in a task.
OFTEN = 64
#: Groups of up to so many classes are paired in full; those of larger ones are compared with a hub.
SMALL = 8
#: Classes that are compared with one hub in a task.
HUB_ROWS = 5_000
#: Further hubs of each group, taken from the classes outside the component of its first.
MORE_HUBS = 2

LOW = np.uint64((1 << 48) - 1)
FACTORS = np.array([xxhash.xxh64_intdigest(b"factor %d" % i) | 1 for i in range(SHINGLE + 1)], np.uint64)


class Hashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = cache_of("hashes")
    if "words" not in known:
        known["words"] = Hashes()
    return np.fromiter(map(known["words"].__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. A text of fewer words is one shingle; one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = word_hashes(words)
    if len(w) < SHINGLE:
        return np.append(w * FACTORS[: len(w)], FACTORS[-1:] * np.uint64(len(w))).sum(keepdims=True)
    n = len(w) - SHINGLE + 1
    h = w[:n] * FACTORS[0]
    for i in range(1, SHINGLE):
        h += w[i : n + i] * FACTORS[i]
    return np.unique(h)


def class_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def prefix_length(n):
    return n // 4 + 1


def local_counts(sets: list[np.ndarray]) -> bytes:
    """Shingles of a run of classes that may be frequent in all, with their counts there: those in twice the share that
    makes a frequent one cannot all be missed, as some run must have at least the mean."""
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    some = count * OFTEN > len(sets)
    some &= count > 1
    return token[some].astype("<u8").tobytes() + count[some].astype("<u8").tobytes()


def describe(text_col: str):
    """Per text: class key (null without words), set size, and the hash (of 48 bits) that ends its prefix under hash order.
    The last text of each run of texts also has the run's frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, ends, often = [], [], [], []
            alike: dict[int, np.ndarray] = {}
            held = 0
            texts = texts_in(batch, text_col)
            for i, text in enumerate(texts):
                s = shingle_set(text)
                n = len(s)
                keys.append(class_key(s) if n else None)
                sizes.append(n)
                ends.append(int(np.partition(s & LOW, n // 4)[n // 4]) if n else 0)
                if n:
                    alike[keys[-1]] = s
                    held += len(text)
                full = alike and (held >= GROUP_BYTES or i == len(texts) - 1)
                often.append(local_counts(list(alike.values())) if full else None)
                if full:
                    alike, held = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ends, pa.int64()), pa.array(often, pa.binary())], names=["record", "key", "n", "last", "often"])

    return run


def unpack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("often").to_pylist():
            both = np.frombuffer(blob, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["token", "n"])


def frequent_shingles(members: DataFrame) -> np.ndarray:
    """Sorted shingles with a count of more than one in OFTEN of all rows, summed over the runs in which they stand out.
    What is missed only counts as any other shingle; there are OFTEN times the mean size of a set at most."""
    rows = members.where("key is not null").count()
    found = members.where("often is not null").select("often").mapInArrow(unpack_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    kept = found.where(F.col("n") > max(rows // OFTEN, 8)).select("token").collect()
    return np.sort(np.array([r["token"] for r in kept], np.int64).view(np.uint64))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal shares of all hashes, by their upper half; the narrowest kind of number sorts fastest."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def named(h: np.ndarray, bucket) -> np.ndarray:
    """What a shingle goes by from here on: 48 bits of its hash and its bucket's number."""
    return np.asarray(bucket).astype(np.uint64) << np.uint64(48) | h & LOW


def packed_shingles(buckets: int, frequent):
    """Texts to arrays of shingles by bucket: class keys, how many of its shingles each has here, and 48 bits of each.
    Frequent shingles go to buckets below 0, dealt by their class, with all their bits."""

    def pack(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.array(list(sets), np.int64)
        size = np.array([len(s) for s in sets.values()], np.int64)
        h = np.concatenate(list(sets.values()))
        known = frequent.value
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            often = known[at] == h
            owner = np.repeat(np.arange(len(keys)), size)
            token = named(h[often], bucket_of(h[often], buckets))
            lane = -1 - keys[owner[often]] % buckets
            order = np.argsort(lane, kind="stable")
            lane, k, token = lane[order], keys[owner[often]][order], token[order]
            start = np.flatnonzero(np.append(True, lane[1:] != lane[:-1])) if len(lane) else np.zeros(0, np.int64)
            blobs = [k[a:b].astype("<i8").tobytes() + token[a:b].astype("<u8").tobytes() for a, b in zip(start, np.append(start[1:], len(lane)))]
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(lane[start].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
            size = np.bincount(owner[~often], minlength=len(keys))
            h = h[~often]
            if not len(h):
                return
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        owner = np.repeat(np.arange(len(keys)), size)[order]
        bucket = bucket[order]
        raw = (h[order] & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blobs = []
        for a, b in zip(start, np.append(start[1:], len(bucket))):
            first = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
            count = np.diff(np.append(first, b - a))
            kind = "<u2" if count.max() <= 0xFFFF else "<u4"
            head = len(first).to_bytes(4, "little") + int(kind[-1]).to_bytes(1, "little")
            blobs.append(head + keys[owner[a:b][first]].astype("<i8").tobytes() + count.astype(kind).tobytes() + raw[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for text in texts_of(batch.column("text")):
                s = shingle_set(text)
                if len(s):
                    sets[class_key(s)] = s
                    held += len(text)
                if held >= GROUP_BYTES:
                    yield from pack(sets)
                    sets, held = {}, 0
        if sets:
            yield from pack(sets)

    return run


def by_bucket(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches, bucket by bucket."""
    current, rows = None, []
    for batch in batches:
        for row in (r for i in range(0, len(batch), 50) for r in batch.slice(i, 50).to_pylist()):
            if row[name] != current:
                if rows:
                    yield current, rows
                current, rows = row[name], []
            rows.append(row)
    if rows:
        yield current, rows


def shared_shingles(key_buckets: int):
    """Shingles of two or more classes, as arrays for the buckets of their classes: key, shingle, number of classes."""

    def homeward(key: np.ndarray, token: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        home = key % key_buckets
        order = np.argsort(home, kind="stable")
        key, token, df, home = key[order], token[order], df[order], home[order]
        start = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        ends = np.append(start[1:], len(home))
        blobs = [int(b - a).to_bytes(8, "little") + key[a:b].astype("<i8").tobytes() + token[a:b].astype("<u8").tobytes() + df[a:b].astype("<u2").tobytes() for a, b in zip(start.tolist(), ends.tolist())]
        none = pa.nulls(len(blobs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(home[start].astype(np.int32)), none, none, none, pa.array(blobs, pa.binary())], names=["home", "key", "n", "last", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches, "bucket"):
            if bucket < 0:  # frequent shingles: the same class may come from many places
                pairs = np.unique(np.concatenate([np.frombuffer(r["blob"], "<i8").reshape(2, -1) for r in rows], axis=1), axis=1)
                yield homeward(pairs[0], pairs[1].view(np.uint64), np.full(pairs.shape[1], 0xFFFF))
                continue
            keys, tokens = [], []
            for r in rows:
                blob = r["blob"]
                n, wide = int.from_bytes(blob[:4], "little"), blob[4]
                count = np.frombuffer(blob, f"<u{wide}", n, 5 + 8 * n).astype(np.int64)
                keys.append(np.repeat(np.frombuffer(blob, "<i8", n, 5), count))
                raw = np.zeros((int(count.sum()), 8), np.uint8)
                raw[:, :6] = np.frombuffer(blob, np.uint8, -1, 5 + (8 + wide) * n).reshape(-1, 6)
                tokens.append(raw.view("<u8").reshape(-1))
            key, token = np.concatenate(keys), np.concatenate(tokens)
            order = np.argsort(token, kind="stable")
            t = token[order]
            same = t[1:] == t[:-1]
            some = np.append(same, False) | np.append(False, same)
            key, token = key[order[some]], t[some]
            order = np.lexsort((key, token))
            key, token = key[order], token[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (token[1:] != token[:-1])) if len(key) else np.zeros(0, bool)
            key, token = key[fresh], token[fresh]  # the same class may come from many places
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            df = np.diff(np.append(start, len(token)))
            df = np.repeat(df, df)
            keep = df > 1
            key, token, df = key[keep], named(token[keep], np.uint64(bucket)), np.minimum(df[keep], 0xFFFE)
            if not len(key):
                continue
            yield homeward(key, token, df)

    return run


def ragged(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of numpy arrays."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


CLASS = "key long, n long, own long, tokens array<long>, often array<int>, p1 array<long>, p2 array<long>, p3 array<long>"


def with_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that may have a partner: size, shingles of their own, shared shingles (sorted) with the number of classes
    that have each, and the shared shingles of their prefixes under three orders."""
    for _, rows in by_bucket(batches, "home"):
        facts = {r["key"]: (r["n"], r["last"]) for r in rows if r["blob"] is None}
        blobs = [r["blob"] for r in rows if r["blob"] is not None]
        if not blobs:
            continue
        sizes = [int.from_bytes(b[:8], "little") for b in blobs]
        key = np.concatenate([np.frombuffer(b, "<i8", n, 8) for b, n in zip(blobs, sizes)])
        token = np.concatenate([np.frombuffer(b, "<u8", n, 8 + 8 * n) for b, n in zip(blobs, sizes)])
        df = np.concatenate([np.frombuffer(b, "<u2", n, 8 + 16 * n) for b, n in zip(blobs, sizes)])
        order = np.lexsort((token & LOW, df, key))
        key, token, df = key[order], token[order], df[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out: list[list] = [[] for _ in range(8)]
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
            k = int(key[a])
            n, last = facts[k]
            own = n - (b - a)
            room = prefix_length(n) - own
            t, often = token[a:b], df[a:b]
            third = t[(t & LOW) <= np.uint64(last)]
            if room <= 0 or not len(third):
                continue
            falling = np.lexsort((~(t & LOW), often))
            by_token = np.argsort(t.view(np.int64))
            for column, value in zip(out, (k, n, own, t[by_token].view(np.int64), often[by_token].astype(np.int32), t[:room].view(np.int64), t[falling[:room]].view(np.int64), third.view(np.int64))):
                column.append(value)
        lists = [ragged(c, pa.int32() if i == 4 else pa.int64()) for i, c in enumerate(out) if i > 2]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), *lists], names=["key", "n", "own", "tokens", "often", "p1", "p2", "p3"])


def unlike(x: np.ndarray, often: np.ndarray, own: int, hub: np.ndarray, hub_often: np.ndarray, hub_own: int, size: int) -> tuple[int, int, int, np.ndarray]:
    """How a class differs from a hub, of which only the shared shingles count: the weight of the differences, how many of
    them another class can have too, how many of those it must look up (below), and those it must send, rarest first.

    Let c be the differences that x and y have in common, and w four times the shingles that a class lacks of the hub plus
    three times those that it has besides. Then x and y are similar just when w(x) + w(y) - 7 c <= len(hub). So all
    classes with w + w(hub) <= len(hub) are similar to the hub, and a pair with another one, x, has c >= 1, in fact
    c >= (w(x) - len(hub)) / 4 as w(y) >= 3 c. Under any order of the differences that holds for all, such a pair shares
    one of the first share - c + 1 of either.
    """
    i = np.minimum(np.searchsorted(hub, x), len(hub) - 1)
    there = hub[i] == x
    missing = np.ones(len(hub), bool)
    missing[i[there]] = False
    new, lacks = x[~there], hub[missing]
    own_weight = 3 * hub_own
    weight = 4 * len(lacks) + 3 * (len(new) + own)
    share = len(new) + len(lacks)
    far = max(1, -((len(hub) - weight) // 4))
    looked_up = max(0, share - max(far, -((own_weight - weight - 1) // 7)) + 1)
    sent = max(0, share - far + 1) if weight + own_weight > len(hub) else looked_up
    if not sent:
        return weight, share, 0, lacks[:0]
    # What is lacking is marked by its complement; it is rarer the more of the hub's group have it.
    token = np.concatenate([new, ~lacks])
    rarity = np.concatenate([often[~there], np.maximum(size - hub_often[missing], 1)])
    return weight, share, looked_up, token[np.lexsort((token, rarity))[:sent]]


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
        got = {c: batch.column(c) for c in batch.schema.names}
        numbers = [got[c].to_pylist() for c in ("own", "hub_own", "size")]
        out: list[list] = [[] for _ in range(4)]
        flat = {c: (got[c].offsets.to_numpy(), got[c].values.to_numpy()) for c in ("tokens", "often", "hub_tokens", "hub_often")}
        cut = lambda c, i: flat[c][1][flat[c][0][i] : flat[c][0][i + 1]]
        for i, (own, hub_own, size) in enumerate(zip(*numbers)):
            for column, value in zip(out, unlike(cut("tokens", i), cut("often", i), own, cut("hub_tokens", i), cut("hub_often", i), hub_own, size)):
                column.append(value)
        whole = [pa.array(c, pa.int64()) for c in out[:3]]
        yield pa.RecordBatch.from_arrays([got["key"], got["hub"], got["hub_n"], got["hub_own"], *whole, ragged(out[3], pa.int64())], names=["key", "hub", "hub_n", "hub_own", "w", "share", "looked_up", "sent"])


def compared_with(hubs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Rows (key, hub) with the differences of the class from its hub. A hub of many classes is dealt to as many tasks."""
    sizes = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    salts = F.ceil(F.col("size") / HUB_ROWS).cast("int")
    of_hub = classes.select(F.col("key").alias("hub"), F.size("tokens").cast("long").alias("hub_n"), F.col("own").alias("hub_own"), F.col("tokens").alias("hub_tokens"), F.col("often").alias("hub_often"))
    of_hub = of_hub.join(sizes, "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("salts", salts)
    many = sizes.where(F.col("size") > HUB_ROWS).select("hub", salts.alias("salts"))
    rows = hubs.join(many, "hub", "left").select("key", "hub", F.coalesce(F.pmod("key", "salts"), F.lit(0)).cast("int").alias("salt"))
    rows = rows.join(classes.select("key", "own", "tokens", "often"), "key").join(of_hub.drop("salts"), ["hub", "salt"])
    return materialize(rows.mapInArrow(differences, "key long, hub long, hub_n long, hub_own long, w long, share long, looked_up long, sent array<long>"), name)


def ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


#: What a pair can share at most: of either what does not come before their first common shingle. It must reach the
#: similarity. `at` and `his` are that shingle's places in the two sets.
FIRST = "100 * least(n - at, m - his) >= 75 * (n + m - least(n - at, m - his))"
#: The same for one class and the smallest of its group: else it can be similar to none of them by this shingle.
ALONE = "100 * (n - at) >= 75 * (at + lo)"


def links_among(pairs: DataFrame, classes: DataFrame, name: str = "jaccard-links") -> DataFrame:
    """Of pairs (a, b), which share a prefix shingle under the first order, those that share one under the second and
    third too and then reach the similarity. Only what passes the filters meets the whole sets."""

    def both(rows: DataFrame, *columns: str) -> DataFrame:
        left = classes.select(F.col("key").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
        return rows.join(left, "a")

    right = classes.select(F.col("key").alias("b"), F.col("p2").alias("b_p2"), F.col("p3").alias("b_p3"))
    kept = both(pairs, "p2", "p3").join(right, "b").where("arrays_overlap(a_p2, b_p2) AND arrays_overlap(a_p3, b_p3)").select("a", "b")
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    common = "size(array_intersect(a_tokens, b_tokens))"
    return materialize(both(kept, "n", "tokens").join(right, "b").where(f"100L * {common} >= 75 * (a_n + b_n - {common})").select("a", "b"), name)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): record, key and n of each row of docs, and the links (a, b) found between classes.

    The links join the same classes as all links would; pairs inside a component that is already joined are left out.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_text(docs, text_col, carry)
    members = rows.mapInArrow(describe(text_col), rows.select("record").schema.add("key", "long").add("n", "long").add("last", "long").add("often", "binary"))
    members = materialize(members.withColumn("row", F.monotonically_increasing_id()), "jaccard-members")
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = min(max(parts, -(-total // BUCKET_SHINGLES)), 1 << 30)
    homes = max(parts, buckets // 4)
    frequent = spark.sparkContext.broadcast(frequent_shingles(members))

    texts = with_text(docs.select(F.col(f"`{text_col}`").alias("text")), "text", []).select("text")
    dealt = texts.mapInArrow(packed_shingles(buckets, frequent), "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(shared_shingles(homes), "home int, key long, n long, last long, blob binary")
    facts = members.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("last").alias("last"))
    facts = facts.select(F.pmod("key", F.lit(homes)).cast("int").alias("home"), "key", "n", "last", F.lit(None).cast("binary").alias("blob"))
    classes = shared.unionByName(facts).repartition(parts, "home").sortWithinPartitions("home")
    classes = materialize(classes.mapInArrow(with_prefixes, CLASS), "jaccard-classes", "none")
    return members, links_of(classes)


def links_of(classes: DataFrame) -> DataFrame:
    entries = classes.select("key", "n", "own", F.posexplode("p1").alias("place", "token")).withColumn("at", F.col("own") + F.col("place")).drop("place")
    groups = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "key")).alias("hub"), F.min("n").alias("lo")).where("size > 1")
    entries = materialize(entries.join(groups, "token").where(ALONE).select("token", "key", "n", "at", "own", "size", F.col("hub.key").alias("hub")), "jaccard-groups")

    small = entries.where(F.col("size") <= SMALL).select("token", "key", "n", "at")
    pairs = small.join(small.select("token", F.col("key").alias("other"), F.col("n").alias("m"), F.col("at").alias("his")), "token").where("key < other").where(FIRST)
    links = links_among(pairs.select(F.col("key").alias("a"), F.col("other").alias("b")).distinct(), classes)

    big = entries.where(F.col("size") > SMALL).select("token", "key", "own", "hub")
    if not big.take(1):
        return links
    # Each class of a large group is compared with the group's hub; classes near the hub are one component by that.
    hubs = big.select("key", "hub").union(big.select("hub", "hub")).distinct()
    unlikes = compared_with(hubs, classes, "jaccard-unlike")
    lowest = unlikes.groupBy("hub").agg(F.min(F.struct("w", "key")).alias("low"))
    unlikes = unlikes.join(lowest, "hub").withColumn("near", F.col("w") + F.col("low.w") <= F.col("hub_n"))
    links = links.union(unlikes.where("near AND key <> low.key").select(*ordered(F.col("key"), F.col("low.key"))))
    # Those outside try other hubs, taken from among themselves.
    for _ in range(MORE_HUBS):
        comps = components(links)
        labelled = big.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        mains = comps.select(F.col("key").alias("hub"), F.col("comp").alias("main"))
        outside = labelled.join(mains, "hub", "left").where("comp <> coalesce(main, hub)").select("token", "key", "own", "hub")
        second = outside.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("own", "key")).alias("next")).where(F.col("many") > SMALL)
        outside = materialize(outside.join(second, "token").select("token", "key", "own", F.col("next.key").alias("hub")), "jaccard-outside")
        tried = compared_with(outside.where("key <> hub").select("key", "hub").distinct(), classes, "jaccard-tried")
        found = tried.where("w + 3 * hub_own <= hub_n").select(*ordered(F.col("key"), F.col("hub")))
        if not found.take(1):
            break
        links, big = links.union(found), outside
    # What remains may be similar by differences from the hub that both have.
    comps = components(links)
    unlikes = unlikes.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    sends = unlikes.where("not near").select("hub", "hub_n", "key", "comp", "w", "share", F.posexplode("sent").alias("i", "token"))
    looks = unlikes.select("hub", F.col("key").alias("other"), F.col("comp").alias("that"), F.col("w").alias("v"), F.col("share").alias("his"), "near", F.posexplode(F.slice("sent", F.lit(1), F.col("looked_up").cast("int"))).alias("j", "token"))
    close = "comp <> that AND (near OR key < other) AND 7 * least(share - i, his - j) >= w + v - hub_n"
    more = sends.join(looks, ["hub", "token"]).where(close).select(*ordered(F.col("key"), F.col("other"))).distinct()
    return links.union(links_among(more, classes, "jaccard-more"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: record (its columns, or those of carry), id, n_shingles, component_id, the smallest id that
    can be reached by links, and kept: whether it is the component's one row that stays (of those with that id the first).

    Words are parted by ASCII white space after A-Z are lower-cased. Texts without words have no shingles and no links:
    their component is their own id. Rows with equal sets are linked. Rows without an id count in their component, which
    has a null id only if none of its rows has one. An empty table gives no rows.
    """
    wanted = docs.columns if carry is None else carry
    members, links = similar_classes(docs, id_col, text_col, list(dict.fromkeys([*wanted, id_col])))
    comps = components(links) if links.take(1) else links.select(F.col("a").alias("key"), F.col("b").alias("comp"))
    rows = members.select("record", F.col(f"record.`{id_col}`").alias("id"), "row", "key", "n")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    classes = rows.where("key is not null").groupBy("key").agg(first.alias("first")).join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    firsts = classes.groupBy("comp").agg(F.min("first").alias("head"))
    named = classes.join(firsts, "comp").select("key", F.col("head.id").alias("component_id"), F.col("head.row").alias("head"))
    out = rows.join(named, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    record = F.struct(*[F.col(f"record.`{c}`").alias(c) for c in wanted])
    return out.select(record.alias("record"), "id", F.col("n").alias("n_shingles"), "component_id", (F.col("key").isNull() | (F.col("row") == F.col("head"))).alias("kept"))


def op8_jaccard_join(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g
  FROM d),
e AS (SELECT r, unnest(g) AS t, len(g) AS n FROM s),
links AS (
  SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.t = b.t AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS z FROM s UNION SELECT reach.r, b.y FROM reach JOIN both_ways b ON reach.z = b.x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, low AS component_id
FROM s JOIN (SELECT reach.r, min(t.doc_id) AS low FROM reach JOIN s t ON t.r = reach.z GROUP BY reach.r) USING (r)
"""
