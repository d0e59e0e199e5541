import random
import re
import unicodedata

from pyspark.sql import functions as F

from evidarium.operators.keywords import keyword_matches, scored_titles, tagged_posts
from evidarium.operators.rules import score_titles


def squeeze(text):
    return " ".join(re.sub("[_-]+", " ", unicodedata.normalize("NFKC", text).lower()).split())


def stands(keyword, text):
    return re.search(rf"(?<![a-z0-9]){re.escape(squeeze(keyword))}(?![a-z0-9])", squeeze(text)) is not None


PARTS = ["ab", "b", "c1", "-", "_", " ", "  ", ".", ", ", "é", "ａ", "ﬁ", "(", "\\E", "#", "AB", "\n", "x"]


def made(rng, most):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))


def test_against_regexes(spark):
    rng = random.Random(1)
    texts = [(k, made(rng, 30)) for k in range(400)] + [(400, None), (401, "")]
    words = sorted({made(rng, 6) for _ in range(600)} | {"ab", "ab b", "ab  B", "c1.", "#x", "(x)", "a\\Eb"})
    got = keyword_matches(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in words] + [(None,), ("ab",)], "keyword string"), "t")
    spelled = {}
    for w in words:
        if re.search("[a-z0-9]", squeeze(w)):
            spelled[squeeze(w)] = min(spelled.get(squeeze(w), w), w)
    want = sorted((k, w) for k, t in texts if t for w in spelled.values() if stands(w, t))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_twenty_thousand_keywords_need_no_expression_each(spark):
    table = spark.range(20_000).select(F.concat(F.lit("model "), F.col("id").cast("string"), F.lit(" mk-2")).alias("keyword"))
    texts = spark.range(3000).select("id", F.concat(F.lit("The Model "), (F.col("id") * 7).cast("string"), F.lit(" Mk 2, and model 12 mk 22")).alias("t"))
    found = keyword_matches(texts, table, "t")
    assert found.count() == sum(1 for k in range(3000) if 7 * k < 20_000)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 50_000


def test_scores_are_those_of_the_rules(spark):
    rng = random.Random(2)
    lists = {"model": ["ab", "c1 x"], "resource": ["b", "ab b"], "research": ["x", "c1"]}
    titles = spark.createDataFrame([(k, made(rng, 12), rng.choice([True, False, None])) for k in range(300)] + [(900, None, True)], "id long, title string, f boolean")
    table = spark.createDataFrame([(k, w) for k, ws in lists.items() for w in ws] + [("other", "ab")], "kind string, keyword string")
    want = score_titles(titles, *lists.values(), F.col("f")).select("id", "tier", "score", "reasons")
    got = scored_titles(titles, table, F.col("f")).select("id", "tier", "score", "reasons")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    posts = tagged_posts(titles, "title", table)
    assert set(posts.columns) == {"id", "title", "f", "keyword"} and posts.count() > 100
