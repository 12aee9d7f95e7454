"""Top-k by blocks against the ranking of all matches."""

import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import ranking
from skerry.operators import search as S

WORDS = ["moon", "blue", "bluebird", "red", "sun", "x", "2024", "ring", "rings", "old"]
COLUMNS = "doc_id long, ih string, name string, body string, seeders int, src string, indexed_at long, deleted boolean, hidden boolean, category string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with names of 0 to 20 words, ties, nulls and frequent words."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        name = " ".join(rng.choice(WORDS[:6] if i % 3 else WORDS) for _ in range(rng.choice((1, 2, 2, 3, 5, 20)))) if i % 50 else (None, "", "Red Moon")[i // 50 % 3]
        body = " ".join(rng.choice(WORDS) for _ in range(rng.choice((0, 4, 30))))
        rows.append((i, f"{i:04x}", name, body, rng.choice((0, 1, 9, 9, 400, 50_000)), rng.choice(("scrape", "scrape", "swarm", "none")), rng.randrange(5), i % 40 == 3, i % 41 == 3, "ab"[i % 2]))
    docs = spark.createDataFrame(rows, COLUMNS)
    path = str(tmp_path_factory.mktemp("ranked"))
    ranking.write_ranked(docs, S.postings(docs), path, 3)
    return docs, S.postings(docs), ranking.read_ranked(spark, path)


SEARCHES = {
    "two words": (S.Search([S.Group(words=["red", "moon"])]), ["red", "moon"], [], True),
    "start": (S.Search([S.Group(words=["red"], prefix="blu")]), ["red", "blu"], [], False),
    "phrase": (S.Search([S.Group(words=["sun"], phrases=["red moon"])]), ["sun", "red", "moon"], ["red moon"], False),
    "alternatives": (S.Search([S.Group(words=["ring"]), S.Group(words=["old", "2024"])]), ["ring", "old", "2024"], [], False),
    "single letter beside another": (S.Search([S.Group(words=["x"]), S.Group(words=["rings"])]), ["x", "rings"], [], False),
    "name only": (S.Search([S.Group(words=["ring"], not_words=["old"], scope="n")]), ["ring"], [], True),
    "files only": (S.Search([S.Group(words=["ring", "old"], scope="f")]), ["ring", "old"], [], True),
    "filtered": (S.Search([S.Group(words=["moon"])], categories=["a"], ranges={"seeders": (None, 9)}), ["moon"], [], True),
    "no word": (S.Search(categories=["b"]), [], [], True),
    "no match": (S.Search([S.Group(words=["nowhere"])]), ["nowhere"], [], True),
}


@pytest.mark.parametrize("k", [5, 60])
@pytest.mark.parametrize("name", SEARCHES)
def test_the_page_is_that_of_the_full_ranking(tables, name, k):
    docs, index, stored = tables
    search, words, phrases, whole = SEARCHES[name]
    idf = S.idf_of(index, words, docs.count()) if words else {}
    full = S.run(docs, index, search, 10).withColumn("score", F.round(S.relevance(words, idf, phrases, whole), 6))
    want = full.orderBy(F.col("score").desc(), F.col("seeders").desc(), F.col("indexed_at").desc(), "doc_id").limit(k).select("doc_id", "score").collect()
    assert ranking.top(stored, search, words, idf, 10, k, phrases, whole).select("doc_id", "score").collect() == want


def test_no_score_is_above_the_bound_of_its_class(tables):
    docs, index, stored = tables
    rows = {r["class"]: r for r in stored.classes.collect()}
    for search, words, phrases, whole in SEARCHES.values():
        idf = S.idf_of(index, words, docs.count()) if words else {}
        counts = ranking.block_counts(stored.blocks, words) if words else {}
        best = S.run(stored.docs, stored.index, search, 10).groupBy("class").agg(F.max(S.relevance(words, idf, phrases, whole)).alias("s")).collect()
        for r in best:
            assert r.s <= ranking.bound(counts, words, idf, rows[r["class"]], phrases, whole) + ranking.SLACK


def test_blocks_that_cannot_reach_the_page_are_left(tables):
    docs, index, stored = tables
    idf = S.idf_of(index, ["red", "moon"], docs.count())
    read, every = ranking.plan_classes(stored, S.Search([S.Group(words=["red", "moon"])]), ["red", "moon"], idf, 10, 5)
    assert 0 < len(read) < every / 2


def test_an_empty_catalogue(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    ranking.write_ranked(docs, S.postings(docs), str(tmp_path), 2)
    stored = ranking.read_ranked(spark, str(tmp_path))
    assert ranking.top(stored, S.Search([S.Group(words=["red"])]), ["red"], {"red": 1.0}, 10).collect() == []
