import datetime as dt
import itertools
import random

from evidarium.plans.timelines import contradictions, possible_ranges, uncertain_timeline


def brute(seen, days):
    """The latest states of each day under every choice of days, both being latest if they fall on one."""
    out = {d: set() for d in days}
    for chosen in itertools.product(*[range(a, b + 1) for _, a, b in seen]):
        for d in days:
            past = [t for t in chosen if t <= d]
            out[d].add(frozenset(s for (s, _, _), t in zip(seen, chosen) if past and t == max(past)))
    return out


def texts(day, precision):
    return (dt.date(2001, 1, 1) + dt.timedelta(day)).isoformat()[: {"y": 4, "m": 7, "d": 10}[precision]]


def covered(rows, state, kind, day):
    return any(r["state"] == state and r["kind"] == kind and r["date_start"] <= day and (r["date_end"] is None or day <= r["date_end"]) for r in rows)


def test_against_every_choice_of_days(spark, monkeypatch):
    import evidarium.plans.timelines as timelines
    from pyspark.sql import functions as F

    # Ranges of a few days, so that all choices can be tried.
    monkeypatch.setattr(timelines, "partial_date", lambda raw: (F.date_from_unix_date(F.split(raw, "-")[0].cast("int")), F.date_from_unix_date(F.split(raw, "-")[1].cast("int"))))
    rng = random.Random(1)
    objects = {k: [(rng.choice("ABC"), a := rng.randrange(9), a + rng.randrange(4)) for _ in range(rng.randrange(1, 6))] for k in range(120)}
    rows = [(k, s, f"{a}-{b}") for k, seen in objects.items() for s, a, b in seen]
    found = uncertain_timeline(spark.createDataFrame(rows, "k int, state string, d string"), ["k"], "state", "d").collect()
    start = dt.date(1970, 1, 1)
    for k, seen in objects.items():
        own, days = [r for r in found if r["k"] == k], range(-1, 15)
        want = brute(seen, days)
        for d, s in itertools.product(days, "ABC"):
            day = start + dt.timedelta(d)
            assert covered(own, s, "possible", day) == any(s in latest for latest in want[d]), (seen, d, s)
            assert covered(own, s, "certain", day) == (want[d] == {frozenset(s)}), (seen, d, s)
        for a, b in itertools.combinations(own, 2):  # ranges of one kind and state are parted
            if (a["state"], a["kind"]) == (b["state"], b["kind"]):
                a, b = sorted((a, b), key=lambda r: r["date_start"])
                assert a["date_end"] < b["date_start"] - dt.timedelta(1)


def test_years_months_and_days(spark):
    rows = [("x", "kept", "1975"), ("x", "lost", "1975-05"), ("x", "found", "1976-02-03"), ("x", "found", "1976-02-03"), ("x", "sold", "soon"), ("x", "gone", None), (None, None, "1980")]
    got = [tuple(r) for r in uncertain_timeline(spark.createDataFrame(rows, "k string, s string, d string"), ["k"], "s", "d").orderBy("k", "s", "kind", "date_start").collect()]
    day = dt.date
    assert got == [
        (None, None, "certain", day(1980, 12, 31), None), (None, None, "possible", day(1980, 1, 1), None),
        ("x", "found", "certain", day(1976, 2, 3), None), ("x", "found", "possible", day(1976, 2, 3), None),
        ("x", "kept", "possible", day(1975, 1, 1), day(1976, 2, 2)),
        ("x", "lost", "possible", day(1975, 5, 1), day(1976, 2, 2)),
    ]


def test_contradictions_and_empty(spark):
    rows = [(1, "a", "2000-01-01"), (1, "b", "2000-01-01"), (1, "c", "2000-01"), (2, "a", "2000-01-01"), (2, "a", "2000-01-01")]
    df = spark.createDataFrame(rows, "k int, s string, d string")
    assert [tuple(r) for r in contradictions(df, ["k"], "s", "d").collect()] == [(1, dt.date(2000, 1, 1), ["a", "b"])]
    assert uncertain_timeline(df.limit(0), ["k"], "s", "d").count() == 0
