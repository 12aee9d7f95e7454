"""Views kept up to date against the same from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import incremental as I
from skerry.operators import moderation as M
from skerry.operators import search as S

DOCS = "doc_id long, name string, body string"


def catalogue(seed, n=90):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, " ".join(rng.choices(["red", "blue", "moon", "x1080p", "The"], k=rng.randint(0, 6)))])
    return [(i, text(), text()) for i in range(n)]


RULES = [("a", "red", "name", "word"), ("b", "moon blue", "all", "word"), ("c", "oo", "files", "substring"), ("d", "the$", "all", "regex"), ("e", "1080", "name", "substring")]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_hidden_set_is_that_of_a_recompute(spark, tmp_path):
    """Inserts, deletions, rules that come, go and come back, batches that run twice or leave a part without a mark."""
    rng, every, path = random.Random(2), catalogue(1), str(tmp_path / "hidden")
    upto, gone = 0, set()
    for batch in range(6):
        upto = min(len(every), upto + rng.choice([0, 10, 30]))
        rules = rng.sample(RULES, rng.randint(1, 4)) if batch != 3 else []
        lost = set(rng.sample(range(upto), 2)) if upto > 2 else set()
        docs, deleted = spark.createDataFrame(every[:upto], DOCS), spark.createDataFrame([(i,) for i in lost], "doc_id long")
        for _ in range(rng.choice([1, 2])):
            I.hide_more(docs, rules, path, batch, deleted)
        gone |= lost
        M.rule_hits(docs, RULES).write.parquet(f"{path}/hits/batch={batch + 1}")  # of a batch that died before its mark
        want = [r for r in rows(M.rule_hits(docs, rules).distinct()) if r[0] not in gone] if rules else []
        assert rows(I.hits_of_rules(spark, path, rules)) == want
        assert sorted(r.doc_id for r in I.hidden_by_rules(spark, path).collect()) == sorted({r[0] for r in want})
        assert I.last_run(spark, path).watermark == (upto - 1 if upto else None)


def test_only_what_is_new_is_read(spark, tmp_path):
    path, every = str(tmp_path / "hidden"), catalogue(4)
    I.hide_more(spark.createDataFrame(every[:50], DOCS), RULES[:2], path, 0)
    unread = [(i, "red", "red") if i < 50 else (i, n, b) for i, n, b in every]  # what is below the watermark has changed, which no run may see
    I.hide_more(spark.createDataFrame(unread, DOCS), RULES[:2], path, 1)
    assert rows(I.hits_of_rules(spark, path, RULES[:2])) == rows(M.rule_hits(spark.createDataFrame(every, DOCS), RULES[:2]))


def test_index_finds_what_is_not_indexed_yet(spark, tmp_path):
    path, every = str(tmp_path / "index"), catalogue(7)
    docs = spark.createDataFrame(every, DOCS)
    whole = rows(S.postings(docs))
    assert rows(I.index_of(spark, path, docs)) == whole and I.index_of(spark, path).count() == 0
    for batch, upto in enumerate((30, 30, 70)):
        part = docs.filter(F.col("doc_id") < upto)
        I.index_more(part, path, batch)
        I.index_more(part, path, batch)
        assert rows(I.index_of(spark, path)) == rows(S.postings(part))
        assert rows(I.index_of(spark, path, docs)) == whole


def test_views_of_a_stream(spark, tmp_path):
    """Micro-batches by foreachBatch, with a restart; the last batch is run again, as after a failure."""
    every, source, path = catalogue(9), str(tmp_path / "in"), str(tmp_path / "hidden")
    seen = []

    def run():
        stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(source)

        def step(batch, number):
            seen.append((number, batch.collect()))
            I.hide_more(batch, RULES[:3], path, number)

        q = stream.writeStream.foreachBatch(I.each_batch(step)).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    for k in range(3):
        spark.createDataFrame(every[30 * k : 30 * k + 30], DOCS).coalesce(1).write.mode("append").parquet(source)
        run()
    number, last = seen[-1]
    I.hide_more(spark.createDataFrame(last, DOCS), RULES[:3], path, number)
    assert rows(I.hits_of_rules(spark, path, RULES[:3])) == rows(M.rule_hits(spark.createDataFrame(every, DOCS), RULES[:3]))


@pytest.mark.parametrize("rules", [[], RULES[:1]])
def test_views_of_nothing(spark, tmp_path, rules):
    path = str(tmp_path / "hidden")
    assert I.hidden_by_rules(spark, path).count() == 0
    I.hide_more(spark.createDataFrame([], DOCS), rules, path, 0)
    assert I.last_run(spark, path).watermark is None and I.hits_of_rules(spark, path, rules).count() == 0
