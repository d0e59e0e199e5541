"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its evidence is a weighted sum of features of the line and of the lines before and
after it; a second weight ties the labels of neighbours. Forward-backward gives each line's probability of being good,
and the mean of these, weighted by the lines' lengths and put on the labels' scale, is the document's score. Weights are
fitted by the likelihood of labelled documents, whose label all their lines take.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts_in, with_text
from .tokens import cache_of, texts_of

#: Labelled documents that the field is fitted on, at most, and their lines; both taken in order of a hash of the id.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 2_500, 40_000
#: Chains are cut at this length for fitting.
CHAIN = 32
STEPS, RATE, DECAY = 120, 0.05, 1e-4
GROUP_BYTES = 1 << 20

BYTE_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(0x80, 0x100)), b".,;:!?'\"", b" \t\r\x0b\x0c", b"|", b"#$%&*@^~_=+<>\\/{}[]()-`")):
    BYTE_KINDS[list(_bytes)] = _kind + 1
OWN = 16  # features of a line by itself
#: Lines whose features are held at a time.
RUN_LINES = 16_384
#: Bytes of a text that are parted into lines at a time.
WINDOW = 1 << 18
#: Chains of more lines than this are parted into lanes.
LONG_CHAIN = 4096


def own_features(lines: list[bytes], texts: list[tuple[int, int]], seen: dict[int, set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of lines by themselves, and their lengths. texts: of which text how many
    lines in a row are, by its number; seen: what lines each text has had before, which goes on from run to run."""
    whole = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    end = np.flatnonzero(whole == 10)
    start = np.append(0, end[:-1] + 1)
    size = (end - start).astype(float)
    kinds = BYTE_KINDS[whole]
    some = np.zeros((len(end), 8))
    for k in range(1, 8):
        places = np.flatnonzero(kinds == k)
        some[:, k] = np.searchsorted(places, end) - np.searchsorted(places, start)
    words, distinct, again, seen_before = (np.zeros(len(end)) for _ in range(4))
    i = 0
    for number, count in texts:
        had = seen.setdefault(number, set())
        for line in lines[i : i + count]:
            if line:
                w = line.split()
                words[i], distinct[i], again[i] = len(w), len(set(w)), sum(map(eq, w, islice(w, 1, None)))
                seen_before[i] = bool(w) and line in had
                had.add(line)
            i += 1
    chars, n = np.maximum(size, 1), np.maximum(words, 1)
    last = np.where(size > 0, whole[np.maximum(end - 1, 0)], 32)
    first = np.where(size > 0, kinds[start], 0)
    x = np.column_stack([
        np.log1p(size) / 5, np.log1p(words) / 4, np.minimum(size / n, 40) / 10, some[:, 1] / n, some[:, 2] / chars * 5, some[:, 3] / chars, some[:, 4] / n, some[:, 5] / n,
        np.minimum(some[:, 6] / n, 1), np.minimum(some[:, 7] / n, 4), again / n, distinct / n, np.isin(last, list(b".!?")), first == 1, seen_before, size == 0,
    ])
    return x.astype(np.float32), size


def lines_of(text: bytes, most: int) -> Iterator[list[bytes]]:
    """The lines of a text, at most `most` at a time."""
    at = 0
    while at <= len(text):
        stop = len(text) if len(text) - at <= WINDOW else text.rfind(b"\n", at, at + WINDOW)
        if stop < 0:  # a line longer than the window
            stop = text.find(b"\n", at + WINDOW)
            stop = len(text) if stop < 0 else stop
        part = text[at:stop].split(b"\n")
        for i in range(0, len(part), most):
            yield part[i : i + most]
        at = stop + 1


def runs_of_lines(texts: list[bytes], most: int) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """All lines of the texts in runs of at most `most`, with (text, lines of it) for each run. A text's lines may be parted."""
    lines, own = [], []
    for number, text in enumerate(texts):
        for part in lines_of(text, most):
            if len(lines) + len(part) > most:
                yield lines, own
                lines, own = [], []
            lines += part
            own.append((number, len(part)))
    if lines:
        yield lines, own


def features_by_run(texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Features of every line with those of its neighbours in the text, its length, and (text, lines), run by run: what lies
    behind a run's end is looked up in the next."""
    seen: dict[int, set[bytes]] = {}
    held, last = None, (-1, np.zeros(OWN, np.float32))

    def joined(x: np.ndarray, own: list[tuple[int, int]], before: tuple[int, np.ndarray], after: tuple[int, np.ndarray]) -> np.ndarray:
        number = np.repeat([k for k, _ in own], [n for _, n in own])
        head = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        tail = np.append(head[1:], len(number)) - 1
        edge = np.zeros((len(x), 3), np.float32)
        edge[head, 0] = edge[tail, 1] = edge[:, 2] = 1
        ahead, behind = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
        ahead[head], behind[tail] = 0, 0
        if before[0] == own[0][0]:
            ahead[0], edge[0, 0] = before[1], 0
        if after[0] == own[-1][0]:
            behind[-1], edge[-1, 1] = after[1], 0
        return np.hstack([x, ahead, behind, edge])

    for lines, own in runs_of_lines(texts, most):
        x, size = own_features(lines, own, seen)
        for number in [k for k in seen if k < own[-1][0]]:
            del seen[number]
        if held:
            yield joined(held[0], held[2], last, (own[0][0], x[0])), held[1], held[2]
            last = (held[2][-1][0], held[0][-1])
        held = x, size, own
    if held:
        yield joined(held[0], held[2], last, (-1, last[1])), held[1], held[2]


def line_features(texts: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with those of its neighbours, the line's length, and how many lines each text has; with
    `most`, of so many lines of the first text."""
    xs, sizes, count = [], [], np.zeros(len(texts), np.int64)
    for x, size, own in features_by_run(texts, RUN_LINES):
        xs.append(x)
        sizes.append(size)
        for number, n in own:
            count[number] += n
        if most is not None and count.sum() >= most:
            return np.concatenate(xs)[:most], np.concatenate(sizes)[:most], np.array([most])
    return np.concatenate(xs), np.concatenate(sizes), count


def laid_out(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains side by side, longest first: the order of chains, and for each step how many are that long."""
    order = np.argsort(-count, kind="stable")
    return order, np.searchsorted(-count[order], -np.arange(count.max(initial=0)), "left")


def forward_backward(good: np.ndarray, count: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the expected number of each pair of labels of neighbours.

    good: evidence of each line; count: lines of each chain, laid one after another; ties[i, j]: weight of label j behind i.
    """
    order, live = laid_out(count)
    head = (np.cumsum(count) - count)[order]
    fwd, bwd = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    e = np.column_stack([np.zeros(len(good)), good])
    for t, k in enumerate(live):
        i = head[:k] + t
        fwd[i] = e[i] if t == 0 else e[i] + np.logaddexp(fwd[i - 1, :1] + ties[0], fwd[i - 1, 1:] + ties[1])
    pairs = np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        i = head[: live[t + 1]] + t
        ahead = e[i + 1] + bwd[i + 1]
        bwd[i] = np.logaddexp(ties[:, 0] + ahead[:, :1], ties[:, 1] + ahead[:, 1:])
        joint = fwd[i][:, :, None] + ties + ahead[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = fwd + bwd
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), pairs


def forward_odds(good: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Log odds of the forward messages of one long chain. The chain is parted into lanes; what a lane makes of any message
    is a 2 x 2 matrix, found for all lanes at once, and these give each lane the message that it begins with."""
    n = len(good)
    width = int(n**0.5) + 1
    lanes = -(-n // width)
    e = np.zeros(lanes * width)
    e[:n] = good
    e = e.reshape(lanes, width)

    def step(m: np.ndarray, t: int) -> np.ndarray:
        """Messages (..., state) through place t of every lane."""
        out = np.logaddexp(m[..., :1] + ties[0], m[..., 1:] + ties[1])
        out[..., 1] += e[:, t].reshape(-1, *[1] * (m.ndim - 2))
        return out

    maps = np.tile(np.array([[0.0, -np.inf], [-np.inf, 0.0]]), (lanes, 1, 1))
    for t in range(width):
        maps = step(maps, t)
    maps[0] = 0  # the first lane begins with no message; see below
    odds = np.empty((lanes, width))
    at = np.array([[0.0, good[0]]])  # its own messages, lane 0 alone
    odds[0, 0] = good[0]
    for t in range(1, width):
        at = np.logaddexp(at[:, :1] + ties[0], at[:, 1:] + ties[1]) + [0.0, e[0, t]]
        odds[0, t] = at[0, 1] - at[0, 0]
    begins, message = np.zeros((lanes, 2)), at[0] - at[0].max()
    for k in range(1, lanes):
        begins[k] = message
        message = np.logaddexp(message[0] + maps[k, 0], message[1] + maps[k, 1])
        message -= message.max()
    m = begins
    for t in range(width):
        m = step(m, t)
        m -= m.max(axis=1, keepdims=True)
        odds[1:, t] = (m[:, 1] - m[:, 0])[1:]
    return odds.reshape(-1)[:n]


def marginals(good: np.ndarray, count: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Probability that each line is good, of chains of any length."""
    long = count > LONG_CHAIN
    if not long.any():
        return forward_backward(good, count, ties)[0]
    ends, out = np.cumsum(count), np.empty(len(good))
    short = np.repeat(~long, count)
    if short.any():
        out[short] = forward_backward(good[short], count[~long], ties)[0]
    for k in np.flatnonzero(long):
        own = good[ends[k] - count[k] : ends[k]]
        # The messages from behind are those of the chain turned round; each has the line's own evidence in it.
        both = forward_odds(own, ties) + forward_odds(own[::-1], ties.T)[::-1] - own
        out[ends[k] - count[k] : ends[k]] = 1 / (1 + np.exp(np.clip(-both, -700, 700)))
    return out


class Field(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    #: The labels' scale: slope and offset of the mean's log odds.
    slope: float
    offset: float

    def documents(self, x: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Score of each text from the features of its lines."""
        return self.scored(((x - self.mean) / self.scale) @ self.weights, size, count)

    def scored(self, evidence: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * mean_odds(marginals(evidence, count, self.ties), size, count) + self.offset)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text. Features are made and used run by run; only each line's evidence and length are held."""
        good, sizes, count = [], [], np.zeros(len(texts), np.int64)
        for x, size, own in features_by_run(texts, RUN_LINES):
            good.append(((x - self.mean) / self.scale) @ self.weights)
            sizes.append(size)
            for number, n in own:
                count[number] += n
        return self.scored(np.concatenate(good), np.concatenate(sizes), count)


def mean_odds(good: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    head = np.cumsum(count) - count
    weight = size + 1
    mean = np.add.reduceat(good * weight, head) / np.add.reduceat(weight, head)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit(x: np.ndarray, size: np.ndarray, count: np.ndarray, labels: np.ndarray) -> Field:
    """Adam on the penalised log-likelihood, then the labels' scale by logistic regression on the documents' means."""
    mean = x.mean(axis=0).astype(np.float32)
    scale = np.maximum(x.std(axis=0), 1e-2).astype(np.float32)
    mean[-1], scale[-1] = 0, 1  # the constant
    z = (x - mean) / scale
    y = np.repeat(labels.astype(float), count)
    chains = np.concatenate([np.append(np.full(c // CHAIN, CHAIN), [c % CHAIN] if c % CHAIN else []) for c in count.tolist()]).astype(np.int64)
    label = np.repeat(labels, -(-count // CHAIN)).astype(int)
    given = np.zeros((2, 2))
    np.add.at(given, (label, label), chains - 1)
    # a document counts once, however many lines it has
    share = np.repeat(1 / count, count) * len(z) / len(count)
    weights, ties = np.zeros(z.shape[1]), np.zeros((2, 2))
    state = [np.zeros(weights.size + 4) for _ in range(2)]
    for step in range(1, STEPS + 1):
        good, pairs = forward_backward(z @ weights, chains, ties)
        slope = np.append(z.T @ ((y - good) * share), (given - pairs).reshape(-1)) / len(z)
        slope -= DECAY * np.append(weights, 10 * ties.reshape(-1))
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights, ties = weights + move[:-4], ties + move[-4:].reshape(2, 2)
    odds = mean_odds(forward_backward(z @ weights, count, ties)[0], size, count)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton
        p = 1 / (1 + np.exp(-(a * odds + b)))
        h = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((labels - p) * odds).sum() - 1e-2 * (a - 1), (labels - p).sum() - 1e-2 * b])
        hess = np.array([[(h * odds * odds).sum() + 1e-2, (h * odds).sum()], [(h * odds).sum(), h.sum() + 1e-2]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, grad).clip(-1, 1)
    return Field(mean, scale, weights, ties, max(a, 0.05), b)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCUMENTS) -> Field:
    """Fit on at most `sample` labelled documents that are not held out. Labels that are null count as absent; of several
    for one document the mean decides, 1 in a tie. Without a labelled document every score is 0.5."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = rows.select(F.col("id").cast("string").alias("id"), "y", "text", lines.cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))
    got = fitting(rows.select("id", "y", "n", "digest").orderBy(F.xxhash64("id"), "id", "n", "digest").limit(sample).collect())
    width = 3 * OWN + 3
    if not got:
        return Field(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width), np.zeros((2, 2)), 1.0, 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, digest, text in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), texts_of(batch.column("text"))):
                x, size, _ = line_features([text], SAMPLE_LINES)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([digest]), pa.array([x.tobytes()]), pa.array([size.tobytes()])], names=["id", "digest", "x", "size"])

    wanted = docs.sparkSession.createDataFrame(sorted({(r["id"], r["digest"]) for r in got}), "id string, digest string")
    texts = rows.join(F.broadcast(wanted), ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.first("text").alias("text"))
    features = {(r["id"], r["digest"]): (np.frombuffer(r["x"], np.float32).reshape(-1, width), np.frombuffer(r["size"])) for r in texts.mapInArrow(measure, "id string, digest string, x binary, size binary").collect()}
    x, size = (np.concatenate(part) for part in zip(*(features[r["id"], r["digest"]] for r in got)))
    return fit(x, size, np.array([min(r["n"], SAMPLE_LINES) for r in got], np.int64), np.array([r["y"] for r in got]))


def fitting(rows: list) -> list:
    """Of rows (y, n) in order, those that SAMPLE_LINES has room for; one too long is passed over, not those behind it. A
    label of which no row has room keeps its shortest, so that no field is fitted without a label that is there; of that one
    the first SAMPLE_LINES lines are fitted on."""
    taken, held = set(), 0
    for i, r in enumerate(rows):
        if held + r["n"] <= SAMPLE_LINES:
            taken.add(i)
            held += r["n"]
    for y in {r["y"] for r in rows} - {rows[i]["y"] for i in taken}:
        taken.add(min((i for i, r in enumerate(rows) if r["y"] == y), key=lambda i: rows[i]["n"]))
    return [rows[i] for i in sorted(taken)]


def quality(docs: DataFrame, field: Field, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """record (columns of docs, or those of carry) and score for each row, repeated ones too. Null counts as empty; an empty
    text is one empty line and gets a score too; an empty table gives no rows. Rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = with_text(docs, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("quality")  # needs nothing kept
        for batch in batches:
            scores, texts, held = [], [], 0
            for text in [*texts_in(batch, text_col), None]:
                if text is not None:
                    texts.append(text)
                    held += len(text)
                if texts and (held >= GROUP_BYTES or text is None):
                    scores.append(shared.value.score(texts))
                    texts, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["record", "score"])

    return rows.mapInArrow(run, rows.select("record").schema.add("score", "double"))


def op5_line_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = quality(docs, train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return found.select("record.doc_id", held_out(F.col("record.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
