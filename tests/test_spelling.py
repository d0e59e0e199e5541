import random

import pytest

from evidarium.operators.spelling import close_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(a, b, within):
    names = lambda x: {n.strip(" ").lower() for n in x if n and n.strip(" ")}
    return sorted((p, q, d) for p in names(a) for q in names(b) if abs(len(p) - len(q)) <= within and (d := distance(p, q)) <= within)


def edited(rng, name):
    out = list(name)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(out) + 1)
        rng.choice([lambda: out.insert(at, rng.choice("abé ")), lambda: out[at : at + 1] and out.pop(at), lambda: out.__setitem__(slice(at, at + 1), rng.choice("xyz"))])()
    return "".join(out)


@pytest.mark.parametrize("within", [1, 2, 3])
def test_all_pairs(spark, within):
    rng = random.Random(within)
    base = ["", "a", "ab", "Supplier#000000012", "small ring", "red widget", "aaaaaaaaaa", "日本語の名前", "ab" * 7] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 22))) for _ in range(40)]
    left = base + [edited(rng, n) for n in base for _ in range(4)] + [None, "  ", " Padded "]
    right = base + [edited(rng, n) for n in base for _ in range(3)] + ["padded"]
    table = lambda x: spark.createDataFrame([(n, 1) for n in x], "name string, distance int")
    for long in (48, 12):  # the shorter bound sends most names through their pieces
        got = close_names(table(left), table(right), within, long)
        assert sorted(map(tuple, got.collect())) == brute(left, right, within)


def test_long_names_and_shared_beginnings(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    left = [text, text[:100], text[:49], text[:48], "x" + text[:47]]
    right = [text[1:], text[:99] + "z", text[:47], text[:2500] + text[2502:], text[:3000]]
    table = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = close_names(table(left), table(right), 2)
    assert {(len(a), len(b), d) for a, b, d in got.collect()} == {(5000, 4999, 1), (5000, 4998, 2), (100, 100, 1), (49, 47, 2), (48, 47, 1)}
    many = table([f"Supplier with one beginning {k * 7919 % 10**8:08d}" for k in range(3000)])
    plan = close_names(many, many, 1)
    assert plan.where("left_name <> right_name").count() < 3000
    with pytest.raises(ValueError):
        close_names(many, many, 0)
