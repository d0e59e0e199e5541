"""Personal data by weak supervision, in SQL expressions only.

Candidate spans come from the patterns of the base kinds and from looser ones. Labelers vote for or against each: its
shape, a gazetteer, words around it, and a check of its content. Expectation-maximisation over the table of vote patterns
(a row for each kind and combination of votes, so of fixed size) estimates how reliable each labeler is; the
probabilities it gives train a logistic regression on features of the span. Valid base matches are always spans; the
classifier adds others that overlap none of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone", "ssn")
BASE = KINDS[:4]
MARK, OTHER = "\x01", "\x02"  # neither is in any pattern, so one may stand for the other

# Possessive repeats never give back, which none of these needs: no step of the matcher's stack per character. A match
# begins at the head of its run or where the last match ended (\G), so a long run without a match is read once.
LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # of the runs of digits only those of 13 and more can be valid, and runs never overlap
    "card": r"(?:\G|(?<![0-9])(?<![0-9][\x20-]))[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE_PATTERNS = {
    "email": rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach|to)\b",
    "ip": r"(?i)\b(ip|host|server|address|addr|login|from)\b",
    "card": r"(?i)\b(card|visa|credit|debit|pay|payment|account)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|cell|fax|whatsapp)\b",
    "ssn": r"(?i)\b(ssn|social|security|insurance)\b",
}
AGAINST = r"(?i)\b(version|order|invoice|isbn|serial|build|ticket|page|part)\b"
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "eu", "info", "example", "test")
CALLING_CODES = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[06]|96[0-8]|97[0-7]|99[2-8])"
LABELERS = ("shape", "gazetteer", "context", "check")
SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right is doubled, less 9 beyond 9; the sum ends in 0."""
    d = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The base rule's condition on a match."""
    n = F.length(digits(s["value"]))
    if kind == "ip":
        return F.forall(F.split(s["value"], r"\."), lambda p: p.rlike("^0*([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (n >= 13) & (n <= 19) & luhn(s["value"])
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, s: Column) -> list[Column]:
    v, d = s["value"], digits(s["value"])
    around = F.concat(s["left"], F.lit(" "), s["right"])
    context = vote(around.rlike(CONTEXT[kind]), around.rlike(AGAINST))
    if kind == "email":
        last = F.lower(F.regexp_extract(v, r"([A-Za-z0-9-]+)$", 1))
        return [vote(v.rlike(r"^[A-Za-z0-9][^@]*@?.*\.?[A-Za-z]{2,}$"), v.rlike(r"^[.]|\.-|-\.")), vote(last.isin(*DOMAINS), last.rlike("[0-9]")), context, vote(v.contains("@") | v.rlike(r"(?i)[\[(]at[\])].*[\[(]dot[\])]"), F.length(v) > 120)]
    if kind == "ip":
        return [vote(~v.rlike(r"(^|\.)0[0-9]"), v.rlike(r"(^|\.)0[0-9]")), vote(v.rlike(r"^(1?[0-9]?[1-9]|1?[1-9]0|2[01][0-9]|22[0-3])\."), v.rlike(r"^0+\.")), context, vote(valid(kind, s), ~valid(kind, s))]
    if kind == "card":
        return [vote(v.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|3[0-9]{3}([ -])[0-9]{6}\3[0-9]{5})$"), v.rlike("^([0-9][ -])+")), vote(d.rlike("^(3[47]|4|5[1-5]|2[2-7]|6(011|5))"), d.rlike("^[01789]")), context, vote(valid(kind, s), ~valid(kind, s))]
    if kind == "phone":
        return [vote(v.rlike(r"^\+|^\("), v.rlike(r"[.-]{2}|\(\)")), vote(v.startswith("+") & d.rlike(CALLING_CODES), d.rlike("^(000|555)") | (v.startswith("+") & d.rlike("^0"))), context, vote((F.length(d) >= 9) & (F.length(d) <= 15), (F.length(d) < 9) | (F.length(d) > 15))]
    return [F.lit(1), vote(~d.rlike("^(000|666|9)"), d.rlike("^(000|666|9)")), context, vote(~d.rlike("^...00|0000$"), d.rlike("^...00|0000$"))]


def parts_of(text: Column, pattern: str, gate: Column) -> Column:
    """The text cut around matches: what lies between them at even places, matches at odd ones."""
    return F.when(gate, F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)).otherwise(F.array(F.lit("")))


#: Parts whose lengths are summed up one by one; of more, sums are made by chunks.
CHUNK = 64


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column, start: Column) -> Column:
    """start, then start and the sums of ever more lengths. Each step copies the array so far."""
    return F.aggregate(lengths, F.array(start), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def ends_of(parts: Column) -> Column:
    """0 and the end of each part. What is copied for n parts is n * CHUNK and (n / CHUNK) ** 2 numbers."""
    zero = F.lit(0)

    def by_chunks(lengths: Column) -> Column:
        chunks = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)))
        total = lambda c: F.aggregate(c, zero, lambda acc, x: acc + x)
        ends = lambda c, starts: F.flatten(F.transform(c, lambda own, k: F.slice(running(own, F.get(starts, k)), F.lit(2), F.lit(CHUNK))))
        return bound(chunks, lambda c: bound(running(F.transform(c, total), zero), lambda starts: F.concat(F.array(zero), ends(c, starts))))

    lengths = F.transform(parts, lambda p: F.length(p))
    return F.when(F.size(parts) <= CHUNK, running(lengths, zero)).otherwise(bound(lengths, by_chunks))


def spans_of(parts: Column, ends: Column) -> Column:
    """start, end (code points), value and the characters around each match."""
    span = lambda i: F.struct(F.get(ends, i).alias("start"), F.get(ends, i + 1).alias("end"), F.get(parts, i).alias("value"), F.right(F.get(parts, i - 1), F.lit(40)).alias("left"), F.left(F.get(parts, i + 1), F.lit(24)).alias("right"))
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(2)), span)).otherwise(F.array()).cast(SPAN)


def candidates(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """record and spans: kind (number), start, end, base (valid match of a base pattern), votes and features."""
    record = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("record")
    rows = docs.select(record, F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), MARK, OTHER).alias("text"))
    rows = rows.withColumns({"digit": F.col("text").rlike("[0-9]"), "at": F.col("text").contains("@"), "bracket": F.col("text").rlike(r"(?i)[\[(]at[\])]"), "plus": F.col("text").contains("+")})
    gates = {"email": F.col("at"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("plus"), "loose_email": F.col("bracket"), "loose_phone": F.col("digit"), "loose_ssn": F.col("digit")}
    patterns = BASE_PATTERNS | {f"loose_{k}": p for k, p in LOOSE_PATTERNS.items()}
    rows = rows.select("record", *[parts_of(F.col("text"), p, gates[k]).alias(f"parts_{k}") for k, p in patterns.items()])
    rows = rows.select("*", *[ends_of(F.col(f"parts_{k}")).alias(f"ends_{k}") for k in patterns])
    rows = rows.select("record", *[spans_of(F.col(f"parts_{k}"), F.col(f"ends_{k}")).alias(k) for k in patterns])

    def rated(name: str) -> Column:
        kind, loose = name.removeprefix("loose_"), name.startswith("loose_")

        def rate(s: Column) -> Column:
            base = F.lit(False) if loose else valid(kind, s)
            given = [x.cast("int").alias(n) for n, x in zip(LABELERS, votes(kind, s))]
            size = F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(7)).cast("int").alias("size")
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), *given, size, F.lit(loose).alias("loose"))

        return F.transform(F.col(name), rate)

    return rows.select("record", F.concat(*[rated(k) for k in patterns]).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """EM over (kind, votes, count): the probability of each vote pattern, and each labeler's accuracy by kind. Accuracies
    start at 0.85 and stay at 0.5 or more, which fixes what a vote of 1 means; a pseudo-count keeps rare kinds calm."""
    accuracy = {(k, j): 0.85 for k in range(len(KINDS)) for j in range(len(LABELERS))}
    prior = {k: 0.5 for k in range(len(KINDS))}
    belief: dict[tuple, float] = {}
    for _ in range(rounds):
        for k, v, _n in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(x * math.log(accuracy[k, j] / (1 - accuracy[k, j])) for j, x in enumerate(v))
            belief[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in prior:
            own = [(v, n, belief[k, v]) for kk, v, n in patterns if kk == k]
            prior[k] = min(0.99, max(0.01, (sum(n * b for _, n, b in own) + 1) / (sum(n for _, n, _ in own) + 2)))
            for j in range(len(LABELERS)):
                right = sum(n * (b if v[j] > 0 else 1 - b) for v, n, b in own if v[j])
                given = sum(n for v, n, _ in own if v[j])
                accuracy[k, j] = min(0.98, max(0.5, (right + 8.5) / (given + 10)))
    return belief, accuracy


def features(s) -> list[Column]:
    """Of a span, for the classifier."""
    return [*[s[n].cast("double") for n in LABELERS], *[(s["kind"] == k).cast("double") for k in range(len(KINDS))], (s["size"] / 8).cast("double"), s["loose"].cast("double")]


def train(found: DataFrame):
    """score(span column) as fitted on all candidates, grouped by what the classifier sees; None without candidates."""
    keys = ["kind", *LABELERS, "size", "loose"]
    groups = found.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(groups, "pii-groups")
    seen = groups.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).collect()  # at most 5 * 3**4 rows
    if not seen:
        return None
    belief, _ = reliabilities([(r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in seen])
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark = found.sparkSession
    beliefs = F.broadcast(spark.createDataFrame([(k, *v, b) for (k, v), b in sorted(belief.items())], "kind int, shape int, gazetteer int, context int, check int, belief double"))
    rows = groups.join(beliefs, ["kind", *LABELERS])
    sides = F.array(F.struct(F.lit(1.0).alias("label"), (F.col("belief") * F.col("n")).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("belief")) * F.col("n")).alias("weight")))
    rows = rows.select(array_to_vector(F.array(*features({k: F.col(k) for k in keys}))).alias("features"), F.explode(sides).alias("side")).select("features", "side.label", "side.weight")
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(materialize(rows.coalesce(1), "pii-examples"))
    weights, bias = [float(x) for x in model.coefficients], float(model.intercept)
    return lambda s: 1 / (1 + F.exp(-(F.lit(bias) + sum((F.lit(w) * f for w, f in zip(weights, features(s))), F.lit(0.0)))))


def personal_data(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """For each row of docs: record (its columns, or those of carry) and spans, an array of (kind, start, end, base)
    by kind as in KINDS, then start. start and end count code points, end exclusive; base marks valid matches of the base
    patterns, which are always there. Null counts as empty and has no span; no candidates at all leave nothing to add."""
    wanted = docs.columns if carry is None else carry
    found = materialize(candidates(docs, text_col, wanted), "pii-candidates")
    score = train(found)
    base = F.filter("spans", lambda s: s["base"])
    kept = base if score is None else bound(base_by_kind(base), lambda own: F.concat(base, F.filter("spans", lambda s: ~s["base"] & ~touched(own, s) & (score(s) >= threshold))))
    plain = F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"]))
    once = bound(F.array_sort(plain), lambda spans: F.filter(spans, lambda s, i: (i == 0) | (s != F.get(spans, i - 1))))
    shown = F.transform(once, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select("record", shown.alias("spans"))


#: Base matches of a kind that are looked at one by one; among more, the place is found by halving.
FEW = 8


def base_by_kind(base: Column) -> Column:
    """The base matches of each kind as an array of arrays. Those of a kind do not overlap and stand in order."""
    return F.array(*[F.filter(base, lambda s: s["kind"] == KINDS.index(k)) for k in BASE])


def touched(own: Column, s: Column) -> Column:
    """Whether some base match overlaps a span: of each kind, only the last that begins before the span's end can."""

    def by_halves(matches: Column) -> Column:
        def half(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            before = F.get(matches, middle)["start"] < s["end"]
            ends = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
            return F.when(acc["low"] >= acc["high"], acc).when(before, ends(middle + 1, acc["high"])).otherwise(ends(acc["low"], middle))

        steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(matches).cast("double"))).cast("int"))
        count = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(matches).alias("high")), half, lambda acc: acc["low"])
        return bound(count, lambda n: F.coalesce(F.get(matches, n - 1)["end"] > s["start"], F.lit(False)))

    one_by_one = lambda matches: F.exists(matches, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.exists(own, lambda matches: F.when(F.size(matches) <= FEW, one_by_one(matches)).otherwise(by_halves(matches)))


def op9_personal_data(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counted = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("record.doc_id", *[counted(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
