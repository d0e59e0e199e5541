"""Chat formatting in windows of a token budget.

A conversation is cut between turns into windows. Each has the system turn, then as many of the turns before it as fit the
history's share, then new turns while the budget lasts; prefix sums of the turns' tokens tell all three. Only the texts of
new assistant turns are under the loss mask, so that a repeated target is masked.

Prefix sums run over range partitions, with a carry from one to the next, so a conversation may span many tasks. Windows
are chosen in blocks of some tens of budgets: a block starts with a window of its own, whose history comes from copies of
the last turns of the block before.

A turn is written `<|role|>text</s>` and a line feed. In roles and texts a backslash is put behind the first character of
each string that could pass for a mark of this or of usual other templates; one more where backslashes stand there already,
so taking one away restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH, BATCH_BYTES, materialize, table
from .tokens import default_vocabulary, library_words

#: What may stand before and behind the backslashes of a control string: <| |> <s> </s> [INST] [/INST].
BEFORE, BEHIND = r"([<\[|])", r"(?=\||>|/?s>|/?INST\])"
TURN = re.compile(r"<\|(.*?)\|>(.*?)</s>\n", re.DOTALL)
ESCAPED = re.compile(rf"{BEFORE}\\(\\*){BEHIND}")
#: A block's tokens, in budgets.
BLOCK_BUDGETS = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{BEFORE}(\\*){BEHIND}", r"$1\\$2")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def turns_in(formatted: str) -> list[tuple[str, str, int]]:
    """Role, text and the place of the escaped text of each turn of a window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2)) for m in TURN.finditer(formatted)]


class Turn(NamedTuple):
    number: int
    role: str
    text: str
    tokens: int
    new: bool

    @property
    def marked(self) -> str:
        return f"<|{self.role}|>{self.text}</s>\n"


def spans_of(tokens: list[int], first: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(h, i, j) of each window: turns h..i-1 are repeated and i..j-1 new; those before `first` are only history. History
    gives way to the first new turn, which is never cut: alone it may exceed the budget."""
    sums, i = np.append(0, np.cumsum(tokens)), first
    while i < len(tokens):
        room = min(history, budget - tokens[i])
        h = int(np.searchsorted(sums, sums[i] - room)) if room > 0 else i
        h = min(h, i)
        j = max(int(np.searchsorted(sums, sums[h] + budget, "right")) - 1, i + 1)
        yield h, i, j
        i = j


def counted(rows: DataFrame, vocabulary: str) -> DataFrame:
    """rows with tokens, the number of ids of `marked`; strings of special tokens are ordinary text there."""
    schema = rows.drop("marked").withColumn("tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(vocabulary, "<u4", literal_specials=True)
        for batch in batches:
            marked = batch.schema.get_field_index("marked")
            n = pa.array([len(ids) // 4 for ids in words.of_column(batch.column(marked))], pa.int64())
            kept = [i for i in range(batch.num_columns) if i != marked]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), n], names=[*(batch.schema.names[i] for i in kept), "tokens"])

    return rows.mapInArrow(count, schema)


def with_prefix_sums(rows: DataFrame) -> DataFrame:
    """rows (id, turn, role, text, tokens) with number, the turn's place in its conversation, and before, the tokens ahead of it."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "turn", "role", "digest", "tie"]
    rows = rows.withColumns({"digest": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).drop("digest", "tie")
    dealt = materialize(dealt.withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "chat-turns")
    sums = dealt.groupBy("part", "id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"))
    ahead = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("part", "id", F.sum("tokens").over(ahead).alias("tokens_ahead"), F.sum("turns").over(ahead).alias("turns_ahead")).where("turns_ahead > 0")
    carry = carry.select(F.col("part").alias("at_part"), F.col("id").alias("at_id"), "tokens_ahead", "turns_ahead")
    # At most one conversation goes on in each partition, so there are no more carries than partitions.
    joined = dealt.join(F.broadcast(carry), (F.col("part") == F.col("at_part")) & F.col("id").eqNullSafe(F.col("at_id")), "left")
    own = Window.partitionBy("part", "id").orderBy("place")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    before = F.sum("tokens").over(own) - F.col("tokens") + zero("tokens_ahead")
    return joined.select("id", "role", "text", "tokens", (F.row_number().over(own) - 1 + zero("turns_ahead")).cast("long").alias("number"), before.alias("before"))


def windows(
    turns: DataFrame, vocabulary: str, budget: int = 1024, history: int = 256, target: str = "assistant", system: str = "system",
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """The windows of all conversations: id, block, window (in order), formatted, loss (array of start and end, in code
    points), repeated (how many leading turns stand in an earlier window too) and tokens.

    A conversation's turns go by turn, null first; those that share one by role, then a digest of the text; repeated rows
    are turns of their own. Null roles and texts count as empty; rows with a null id are one conversation. The system turn
    is a first turn with that role. tokens counts turn by turn; a window exceeds the budget only if the system turn and one
    new turn do. Each text of a target turn is under one window's mask. An empty table gives no rows.
    """
    spark = turns.sparkSession
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than the budget")
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    named = turns.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), escape(F.col(f"`{role_col}`")).alias("role"), escape(F.col(f"`{text_col}`")).alias("text"))
    marked = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.col("text"), F.lit("</s>\n"))
    block = BLOCK_BUDGETS * budget
    placed = materialize(with_prefix_sums(counted(named.withColumn("marked", marked), vocabulary)).withColumn("block", F.floor(F.col("before") / block).cast("long")), "chat-placed")

    columns = ["id", "block", "number", "role", "text", "tokens", "new"]
    own = placed.withColumn("new", F.lit(True))
    recent = (F.col("block") + 1) * block - F.col("before") <= history
    past = placed.where(recent).withColumns({"block": F.col("block") + 1, "new": F.lit(False)})
    is_system = (F.col("number") == 0) & (F.col("role") == escape(F.lit(system)))
    heads = placed.where(is_system).select(F.col("id").alias("of"), "number", "role", "text", "tokens", F.lit(False).alias("new"))
    later = placed.where("block > 0").select("id", "block").distinct()
    headed = later.join(heads, later["id"].eqNullSafe(heads["of"]))
    every = own.select(columns).unionByName(past.where(~is_system).select(columns)).unionByName(headed.select(columns))
    dealt = every.repartition("id", "block").sortWithinPartitions("id", "block", "number")
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    schema = dealt.select("id", "block", F.lit(0).alias("window"), F.lit("").alias("formatted"), F.array(span).alias("loss"), F.lit(0).alias("repeated"), F.lit(0).cast("long").alias("tokens")).schema

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield b

        out, held = [], 0
        for (conversation, number), group in groupby(rows_of(typed()), lambda r: r[:2]):
            for k, made in enumerate(windows_of([Turn(*r[2:]) for r in group], budget, history, target, system)):
                out.append((conversation, number, k, *made))
                held += len(made[0])
                if held >= BATCH_BYTES // 4:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(cut, schema)


def windows_of(turns: list[Turn], budget: int, history: int, target: str, system: str) -> Iterator[tuple[str, list[dict], int, int]]:
    """formatted, loss, repeated and tokens of each window of a block."""
    head = turns[:1] if turns[0].number == 0 and unescape(turns[0].role) == system else []
    rest = turns[len(head) :]
    spare = sum(t.tokens for t in head)
    fresh = bool(head) and head[0].new
    first = next((i for i, t in enumerate(rest) if t.new), len(rest))
    spans = list(spans_of([t.tokens for t in rest], first, budget - spare, history))
    for h, i, j in spans or ([(0, 0, 0)] if fresh else []):
        shown, at, loss = head + rest[h:j], 0, []
        repeated = len(head) * (not fresh) + i - h
        for k, t in enumerate(shown):
            if k >= len(head) + i - h or k < len(head) and fresh:
                if unescape(t.role) == target:
                    begin = at + len(t.role) + 4
                    loss.append({"start": begin, "end": begin + len(t.text)})
            at += len(t.marked)
        yield "".join(t.marked for t in shown), loss, repeated, sum(t.tokens for t in shown)
        fresh = False


def read_back(made: DataFrame) -> DataFrame:
    """Of each conversation's windows: id, n_windows, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are
    taken from the formatted text, repeated ones once, and the masked text from the loss spans. A conversation's digest
    needs its windows one after the other; they are streamed, and only digests are held."""
    dealt = made.repartition("id").sortWithinPartitions("id", "block", "window").select("id", "formatted", "loss", "repeated")
    long, text = F.lit(0).cast("long"), F.lit("")
    schema = dealt.select("id", *(x.alias(n) for n, x in dict(n_windows=long, n_turns=long, turns_sha256=text, loss_chars=long, loss_sha256=text, formatted_chars=long).items())).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, done = None, None, []

        def closed() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = [(i, w, n, a.hexdigest(), c, b.hexdigest(), f) for i, w, n, a, c, b, f in done]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for conversation, formatted, loss, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conversation:
                    if now is not None:
                        done.append(now)
                    if len(done) >= 10_000:
                        yield closed()
                        done = []
                    now = [conversation, 0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[6] += len(formatted)
                for role, words, _ in turns_in(formatted)[repeated:]:
                    now[2] += 1
                    now[3].update(f"{role}\n{words}\n".encode())
                for span in loss:
                    masked = unescape(formatted[span["start"] : span["end"]])
                    now[4] += len(masked)
                    now[5].update(masked.encode())
        if now is not None:
            done.append(now)
        if done:
            yield closed()

    return dealt.mapInArrow(read, schema)


def op11_chat_windows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = materialize(windows(turns.unionByName(added), default_vocabulary()), "chat-windows")
    return read_back(made).withColumnRenamed("id", "conv_id")
