"""Operators on small literal tables, with the edge cases that the stored tables don't have."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.functions import numbers as N
from skerry.functions import text as X
from skerry.operators import health as H
from skerry.operators import moderation as M
from skerry.operators import observations as O
from skerry.operators import search as S
from skerry.operators import series as T
from skerry.streaming import rollup


def values(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_tokens(spark):
    rows = [("Café del Mar 1080p x264",), ("",), (None,), ("a 7 ß",)]
    assert values(spark, X.tokens(F.col("x")), rows) == [["cafe", "del", "mar", "1080p", "x264"], [], [], ["a", "7"]]
    assert values(spark, X.index_tokens(F.col("x")), rows) == [["cafe", "del", "mar", "1080p", "x264", "1080", "264"], [], [], ["7"]]
    folded = [("Éé ǅ",), (None,), ("e\u0301 Ệ ﬁ ½ ⑩ ㎏ ﷺ İ",), ("\U0001d400\U0001f130",)]
    assert values(spark, X.norm(F.col("x")), folded) == ["ee dz", None, "ee fi 1\u20442 10 kg \ufdfa i".replace("ee fi", "e e fi"), "AA"]


def test_extensions(spark):
    rows = [("a/b.c/name.MKV",), ("a.b/none",), (".hidden",), ("x.toolongextension",)]
    assert values(spark, X.ext_of(F.col("x")), rows) == ["mkv", "", "hidden", "toolonge"]


def test_literals(spark):
    rows = [("1gb",), ("1,5 kb",), ("x",), ("",), ("3 parsecs",)]
    assert values(spark, N.literal(F.col("x"), N.SIZE_UNITS, "b"), rows) == [2**30, 1536, None, None, None]


def test_addresses(spark):
    rows = [("198.18.0.1",), ("256.1.1.1",), ("8.8.8.8",), ("::1",)]
    assert values(spark, N.ipv4(F.col("x")), rows) == [3323068417, None, 134744072, None]
    assert values(spark, N.is_global(N.ipv4(F.col("x"))), rows[::2]) == [False, True]
    assert N.block_range("198.18.0.5/28") == (3323068416, 3323068431)


DOCS = "doc_id long, ih string, name string, body string, category string, seeders long, peers long, src string, deleted boolean, hidden boolean, indexed_at long, size long, file_count long, dead boolean"


def catalogue(spark):
    rows = [
        (1, "aa", "Team A wins", "first file", "en", 5, 1, "scrape", False, False, 100, 10, 1, False),
        (2, "ab", "Blue movie", "the moving file", "en", 0, 3, "scrape", False, False, 90, 20, 1, False),
        (3, "b0", "Blue moon", "", "de", 0, 0, "swarm", False, True, 80, 30, 1, True),
        (4, "b1", "blue moon rising", None, "de", 0, 0, "none", True, False, 70, 40, 1, True),
        (5, "c0", "Moon over blue", "x", "fr", 9, 9, "swarm", False, False, 60, 50, 1, True),
        (6, "c1", "gone", "x", "fr", 0, 0, "scrape", False, False, 10, 60, 1, True),
    ]
    return spark.createDataFrame(rows, DOCS)


def ids(frame):
    return sorted(r.doc_id for r in frame.collect())


def test_search(spark):
    d = catalogue(spark)
    index = S.postings(d)
    run = lambda **g: ids(S.run(d, index, S.Search([S.Group(**g)]), 100))
    assert run(words=["blue"]) == [2, 5]
    assert run(words=["file"], prefix="mov") == [2]
    assert run(phrases=["blue moon"]) == []
    assert run(not_words=["blue"]) == [1, 6]
    assert run(words=["file"], scope="n") == []
    assert ids(S.run(d, index, S.Search([S.Group(words=["wins"]), S.Group(words=["moon"])]), 100)) == [1, 5]
    assert ids(S.run(d, index, S.Search([S.Group(words=["nothing"])], key_prefix="a"), 100)) == [1, 2]
    assert ids(S.run(d, index, S.Search(ranges={"age": (None, 10)}), 100)) == [1, 2]
    assert ids(S.run(d, index, S.Search(states=["weak"]), 100)) == [2]
    assert ids(S.run(d, index, S.Search(states=["dead"]), 100)) == [6]
    assert ids(S.run(d, index, S.Search(), 100)) == [1, 2, 5, 6]


def test_relevance(spark):
    d = catalogue(spark).filter("doc_id = 5")
    got = d.select(S.relevance(["moon", "blu"], {"moon": 1.0, "blu": 2.0}).alias("s")).first().s
    assert math.isclose(got, 3 * 1 + 2 * 2 + 2 * 2 / 3 + 1.5 * 2 / 2)  # a word that a name word starts with is in the name


def test_did_you_mean_and_highlight(spark):
    d = catalogue(spark)
    found = S.did_you_mean(S.postings(d), d.filter("not hidden"), ["mooon", "blue", "zzzz"]).collect()
    assert [(r.word, r.suggestion) for r in found] == [("mooon", "moon")]
    parts = d.filter("doc_id = 2").select(S.highlight("name", F.array(F.lit("mov"), F.lit("e"))).alias("h")).first().h
    assert [(p.text, p.hit) for p in parts] == [("Blue ", False), ("movie", True)]


def test_fold_keeps_a_recent_scrape(spark):
    day = 86_400
    rows = [(1, 0, 50, 5, "scrape", 1), (1, day, 3, 3, "swarm", 2), (1, 15 * day, 2, 2, "swarm", 3), (2, 5, 0, 0, "swarm", 4)]
    m = spark.createDataFrame(rows, "ih long, mt long, seeders long, peers long, src string, event_id long")
    got = {r.ih: r for r in H.fold(m).collect()}
    assert (got[1].seeders, got[1].health_at, got[1].checked_at, got[1].n_kept) == (2, 15 * day, 15 * day, 2)
    assert got[2].n_kept == 1
    assert H.fold(m.limit(0)).count() == 0


def test_history_has_no_skipped_measurements(spark):
    day = 86_400
    rows = [(1, 0, 50, 5, "scrape", 1), (1, day, 3, 3, "swarm", 2), (1, 2 * day, -4, 0, "scrape", 3), (1, 3 * day, 0, 0, "swarm", 4)]
    m = spark.createDataFrame(rows, "ih long, mt long, seeders long, peers long, src string, event_id long")
    assert [(r.mt, r.seeders) for r in H.history(m).orderBy("rn").collect()] == [(3 * day, 0), (2 * day, 0), (0, 50)]
    assert H.unknown_run(m).first().unk == 1


def test_history_is_bounded_and_newest_wins(spark):
    rows = [(1, t, t, 0, "swarm", t) for t in range(50)] + [(1, 49, 99, 0, "swarm", 1000)]
    m = spark.createDataFrame(rows, "ih long, mt long, seeders long, peers long, src string, event_id long")
    h = H.history(m).orderBy("rn").collect()
    assert len(h) == 40 and h[0].seeders == 99 and h[-1].mt == 10


def test_dead_needs_confirmed_scrapes(spark):
    hour = 3600
    runs = {1: (0, 0, "scrape", 2), 2: (0, 3, "scrape", 2), 3: (0, 0, "scrape", 1), 4: (0, 0, "swarm", 2), 5: (0, 0, "scrape", None)}
    rows = [(ih, t * hour, *figures, 10 * ih + t) for ih, figures in runs.items() for t in (0, 6, 12)]
    rows += [(6, t * hour, 0, 0, "scrape", 2, 60 + t) for t in (0, 6, 11)]
    m = spark.createDataFrame(rows, "ih long, mt long, seeders long, peers long, src string, nrep long, event_id long")
    assert {r.ih: (r.run, r.span, r.dead) for r in H.dead_keys(m).collect()} == {1: (3, 12 * hour, True), 6: (3, 11 * hour, False)}
    state = H.verdicts(m).select("ih", "state").collect()
    assert {r.ih: r.state for r in state} == {1: "dead", 2: "weak", 3: "quiet", 4: "unknown", 5: "quiet", 6: "quiet"}


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_fold_is_the_plain_fold_without_arrays(spark):
    day, rng = 86_400, random.Random(4)
    rows = [(ih, rng.randrange(60) * day, rng.randrange(6), rng.randrange(3), rng.choice(["scrape", "swarm", "swarm", "swarm"]), n) for n, ih in enumerate([1] * 150 + [2] * 40 + [3])]
    m = spark.createDataFrame(rows, "ih long, mt long, seeders long, peers long, src string, event_id long")
    want = {}
    for ih, t, seeders, peers, src, _ in sorted(rows, key=lambda r: (r[0], r[1], r[5])):
        s, p, how, at, _, n = want.get(ih, (0, 0, "none", 0, 0, 0))
        skip = src != "scrape" and how == "scrape" and t - at < 14 * day and seeders < s
        want[ih] = (s, p, how, at, t, n) if skip else (seeders, peers, src, t, t, n + 1)
    got = H.fold(m)
    assert {r[0]: tuple(r)[1:] for r in got.select("ih", "seeders", "peers", "src", "health_at", "checked_at", "n_kept").collect()} == want
    assert "collect_list" not in plan(got)


def plain_states(rows):
    """The rules of a measurement, one after another. rows: ih, mt, seeders, peers, src, event_id, nrep, cs."""
    day, found = 86_400, {}
    for ih, t, seeders, peers, src, event, nrep, cs in sorted(rows, key=lambda r: (r[0], r[1], r[5])):
        k = found.setdefault(ih, {"seeders": None, "src": None, "at": None, "checked": 0, "ok": 0, "n": 0, "history": []})
        seeders, peers = max(seeders or 0, 0), max(peers or 0, 0)
        k["checked"] = t
        if cs:
            k["ok"] = t
        if src != "scrape" and k["src"] == "scrape" and t - k["at"] < 14 * day and seeders < k["seeders"]:
            continue
        k |= {"seeders": seeders, "peers": peers, "src": src, "at": t, "n": k["n"] + 1}
        k["history"] = ([h for h in k["history"] if h[0] != t] + [(t, seeders, peers, src, nrep)])[-40:]
    out = {}
    for ih, k in found.items():
        newest = k["history"][::-1]
        zeros = next((i for i, h in enumerate(newest) if not (h[3] == "scrape" and h[1] == h[2] == 0 and h[4] >= 2)), len(newest))
        unk = next((i for i, h in enumerate(newest) if h[3] == "scrape"), len(newest))
        dead = zeros >= 3 and newest[0][0] - newest[zeros - 1][0] >= 12 * 3600
        out[ih] = (k["seeders"], k["peers"], k["src"], k["at"], k["checked"], k["ok"], k["n"], [h[:4] for h in newest], dead, unk)
    return out


def found_states(current):
    rows = H.flagged(current).collect()
    return {r.ih: (r.seeders, r.peers, r.src, r.health_at, r.checked_at, r.seed_ok_at, r.n_kept, [(e.mt, e.seeders, e.peers, e.src) for e in r.history], r.dead, r.unk) for r in rows}


MEASURED = "ih long, mt long, seeders long, peers long, src string, event_id long, nrep long, cs long"


@pytest.mark.parametrize("seed, stretch", [(0, 86_400), (1, 7 * 86_400), (2, 3600), (3, 86_400)])
def test_stretches_add_up_to_the_plain_fold(spark, seed, stretch):
    """Random lives with long holds, ties in time, a hot key and a state that is stored in between, at any width of stretches."""
    rng = random.Random(seed)
    step = rng.choice([3600, 20_000, 86_400])
    rows = []
    for n in range(1_500):
        ih = 1 if n % 3 else rng.randrange(2, 40)
        src = rng.choices(["scrape", "swarm", "legacy"], [1, 8, 1])[0]
        rows.append((ih, rng.randrange(120) * step, rng.choice([0, 0, 0, 1, 2, 5, 9, -3]), rng.choice([0, 0, 0, 2]), src, n, rng.randrange(4), rng.choice([0, 0, 1])))
    m = spark.createDataFrame(rows, MEASURED).repartition(5)
    want = plain_states(rows)
    assert found_states(H.states(m, stretch_s=stretch)) == want
    cuts = [40 * step, 41 * step, 90 * step, 1000 * step]
    stored, since = None, -1
    for cut in cuts:
        part = m.filter((F.col("mt") > since) & (F.col("mt") <= cut))
        stored = spark.createDataFrame(H.states(part, stored, stretch).collect(), H.STATE)
        since = cut
    assert found_states(stored) == want
    assert {r.ih: (r.health_at, r.seeders, r.peers, r.src, r.dead, r.unk) for r in H.restored(stored).collect()} == {i: (w[7][0][0], *w[7][0][1:4], w[8], w[9]) for i, w in want.items()}


def test_states_of_odd_rows(spark):
    rows = [(None, 1, 1, 1, "scrape", 1, 1, 0), (1, 5, None, None, "scrape", None, None, None), (2, 7, 1, 1, None, 2, 0, 1), (2, 7, 1, 1, None, 2, 0, 1)]
    got = found_states(H.states(spark.createDataFrame(rows, MEASURED)))
    assert got == {1: (0, 0, "scrape", 5, 5, 0, 1, [(5, 0, 0, "scrape")], False, 0), 2: (1, 1, None, 7, 7, 7, 2, [(7, 1, 1, None)], False, 1)}
    empty = spark.createDataFrame([], MEASURED)
    assert H.states(empty).count() == 0
    stored = H.states(spark.createDataFrame(rows, MEASURED))
    assert found_states(H.fold_into(stored, empty)) == got


def test_moving_average_across_ranges_without_arrays(spark):
    rng = random.Random(5)
    rows = [("a", n // 2, n, rng.random()) for n in range(500)] + [("b", 1, 1, 3.0), ("c", 1, 1, None), ("c", 2, 2, 1.0)]
    got = T.moving_average(spark.createDataFrame(rows, "k string, t long, i long, v double").repartition(3), "k", ["t", "i"], "v")
    want = 0.0
    for r in rows[:500]:
        want = 0.95 * want + 0.05 * r[3]
    found = {r.k: r.average for r in got.collect()}
    assert math.isclose(found["a"], want) and math.isclose(found["b"], 0.15) and found["c"] is None
    assert "collect_list" not in plan(got)


def test_rates_break_at_the_upper_median(spark):
    p = spark.createDataFrame([(t, t, t, "a") for t in (0, 20, 40, 120, 200, 450)], "t long, counter long, event_id long, event_type string")
    got = T.rates(p, 200)  # steps of 20, 20, 80, 80 and 250: their median is 80, so none is a gap, and the window is 240
    assert {r.t: r.rate for r in got.collect()} == {0: None, 20: None, 40: None, 120: None, 200: 1.0, 450: 1.0}
    assert "collect_list" not in plan(got)


@pytest.mark.parametrize("seed", range(3))
def test_rates_are_those_of_a_search_for_each_anchor(spark, seed):
    """Uneven steps, gaps, equal times, missing values and counters that start again."""
    rng, rows, n = random.Random(seed), [], 0
    for series in ("a", "b", "only one"):
        t, value = 0, 0
        for _ in range(1 if series == "only one" else 300):
            t += rng.choice([0, 10, 10, 10, 25, 60, 61, 500] if seed else [10, 10, 10, 20])
            value = 0 if rng.random() < 0.02 else value + rng.randrange(9)
            n += 1
            rows.append((series, t, n, None if rng.random() < 0.1 else value))
    want = {}
    for series in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == series]
        steps = sorted(y[1] - x[1] for x, y in zip(own, own[1:]))
        med = steps[len(steps) // 2] if steps else 10
        w, begin = max(120, 3 * med), 0
        for i, (_, t, event, value) in enumerate(own):
            if i and t - own[i - 1][1] > max(60, 4 * med):
                begin = i
            back = [k for k in range(begin, i) if t - own[k][1] >= w]
            _, t0, _, v0 = own[back[-1] if back else begin]
            known = value is not None and v0 is not None and t - t0 >= 0.8 * w
            want[event] = max(0.0, (value - v0) / (t - t0)) if known else None
    p = spark.createDataFrame(rows, "event_type string, t long, event_id long, counter long").repartition(3)
    got = {r.event_id: r.rate for r in T.rates(p, 120).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or math.isclose(got[k], want[k], abs_tol=1e-12)) for k in want)
    assert any(v == 0.0 for v in want.values())


@pytest.mark.parametrize("n, at_once", [(0, 5), (7, 5), (333, 5), (333, 1), (999, 50), (1000, 5), (5000, 5)])
def test_smallest_is_a_filter(spark, n, at_once):
    rng = random.Random(n)
    rows = [(rng.randrange(40), rng.choice([1, 2, 10**12]), i) for i in range(1000)]
    got = O.smallest(spark.createDataFrame(rows, "last long, ih long, ip long"), n, "last", "ih", "ip", at_once=at_once)
    assert sorted(map(tuple, got.collect())) == sorted(rows)[:n]


def test_smallest_of_equal_rows(spark):
    rows = [(1, 1)] * 20 + [(0, 5)]
    got = O.smallest(spark.createDataFrame(rows, "a long, b long"), 8, "a", "b", at_once=3)
    assert sorted(map(tuple, got.collect())) == [(0, 5)] + [(1, 1)] * 7


def test_persisted_observations(spark):
    rows = [(1, 1, "d", -1), (1, 2, "d", 0), (1, 3, "c", -1), (1, 4, "d", -1), (1, 4, "a", -1)]
    obs = spark.createDataFrame(rows, "ih long, ip long, src string, role int").withColumns({"port": F.lit(1), "client": F.lit(""), "ts": F.lit(5)})
    assert sorted(r.ip for r in O.persisted(O.merge(obs)).collect()) == [2, 3, 4]
    assert O.persisted(O.merge(obs), all_nodes=True).count() == 4


def test_forced_checks_come_in_order(spark):
    rows = [(9, 1), (3, 2), (9, 3), (1, 4), (2, 5)]
    got = H.forced(spark.createDataFrame(rows, "ih long, seq long"), 77, 3).collect()
    assert [tuple(r) for r in got] == [(9, 77), (3, 77), (1, 77)]


def test_global_addresses_at_all_block_edges(spark):
    import ipaddress

    blocks = [*N.LOCAL_BLOCKS, *N.GLOBAL_WITHIN, "224.0.0.0/4", "192.0.0.170/31", "255.255.255.255/32", "192.88.99.0/24", "198.18.0.0/15"]
    edges = sorted({e for b in blocks for k in N.block_range(b) for e in (k - 1, k, k + 1) if 0 <= e < 2**32})
    got = spark.createDataFrame([(e,) for e in edges], "n long").select("n", N.is_global(F.col("n")).alias("g")).collect()
    assert {r.n: r.g for r in got} == {e: ipaddress.IPv4Address(e).is_global for e in edges}


def plain_rule_hits(rows, rules):
    """Each rule on each text, one by one."""
    out = set()
    for i, name, body in rows:
        for rule, term, scope, mode in rules:
            for text in ([name] if scope != "files" else []) + ([body] if scope != "name" else []):
                if text is None:
                    continue
                folded, needle = X.plain(text), X.plain(term)
                padded = lambda t: f" {' '.join(re.findall('[a-z0-9]+', t))} "
                found = padded(needle) in padded(folded) if mode == "word" else needle.strip() in folded if mode == "substring" else re.search(term, text, re.I) or re.search(term, folded, re.I)
                if found:
                    out.add((i, rule))
    return out


def test_many_rules_are_each_rule_alone(spark):
    """500 rules of all kinds, needles within needles, ids that stand for several rules, odd texts and nulls."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcé1", k=rng.randint(1, 4)))
    text = lambda: rng.choice([" ", "-", ". "]).join(word() for _ in range(rng.randint(0, 12)))
    rows = [(i, rng.choice([text(), text(), None]), rng.choice([text(), None, ""])) for i in range(150)] + [(200, "\0 a\0b", " ab "), (201, "ﬁ Ångström", "STRASSE ß"), (None, "abc", "abc")]
    rules = [(f"r{k}", word() if k % 3 else f"{word()} {word()}", rng.choice(["name", "files", "all"]), rng.choice(["word", "substring", "substring"])) for k in range(480)]
    rules += [("same", "abc", "all", "word"), ("same", "ca", "name", "substring"), ("fold", "Fi", "name", "substring"), ("ang", "ÅNG", "all", "substring"), ("zero", "a\0b", "all", "substring")]
    rules += [("p1", "b+[13]", "all", "regex"), ("p2", "^a", "name", "regex"), ("p3", "É", "files", "regex"), ("p4", r"(a|b)c\b", "all", "regex")]
    docs = spark.createDataFrame(rows, "doc_id long, name string, body string").withColumn("files", F.lit("clash"))
    got = M.rule_hits(docs, rules).collect()
    assert {tuple(r) for r in got} == plain_rule_hits(rows, rules) and len(got) == len(set(got))
    counts = {r.rule_id: r.n for r in M.hit_counts(docs, rules).collect()}
    assert set(counts) == {r[0] for r in rules} and sum(counts.values()) == len(got)
    assert {tuple(r) for r in M.rule_hits(docs, [("b", r"(b)\1", "all", "regex")]).collect()} == plain_rule_hits(rows, [("b", r"(b)\1", "all", "regex")])
    assert M.rule_hits(docs.limit(0), rules).count() == 0


def test_phrases_are_found_by_places(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(["in", "the", "a", "b2", "x264", "In-The"], k=rng.randint(0, 9)))
    rows = [(i, text(), rng.choice([text(), None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, body string")
    index = S.postings(docs)
    for phrase in ("in the", "the the", "in the in", "x264", "b2 x264 in the", "264 in", "a in", "the a", ""):
        for scope in (None, "n", "f"):
            needle = phrase.split()
            fits = lambda t: any(re.findall("[a-z0-9]+", (t or "").lower())[k : k + len(needle)] == needle for k in range(40))  # noqa: B023, E731
            want = {i for i, n, f in rows if (scope != "f" and fits(n)) or (scope != "n" and fits(f))} if needle and "a" not in needle else set()
            if phrase == "264 in":
                want = set()  # digits cut out of a token have no place
            assert {r.doc_id for r in S.with_phrase(index, phrase, scope).collect()} == want, (phrase, scope)


def test_postings_come_from_texts_in_order_of_tokens(spark):
    """What Python cuts into tokens is what the patterns find, and postings are sorted by token where they are made."""
    import pyarrow as pa

    from skerry.operators import postings as P

    rng = random.Random(21)
    texts = ["".join(rng.choices(["in", "the", " ", "  ", "-", "é", "\0", "H", "7", "x264y1080", "1080", "\n", "日"], k=rng.randint(0, 12))) for _ in range(300)] + ["", " ", "a", None]
    for some in (texts, texts[150:], [None], [""], [" a"], []):
        lists = P.token_lists(pa.array(some, pa.string()))
        assert lists.to_pylist() == [re.findall("[a-z0-9]+", t or "") for t in some]
        found = P.located(pa.array(range(len(some)), pa.int64()), lists, "f").to_pylist()
        assert [(r["token"], r["doc_id"]) for r in found] == sorted((r["token"], r["doc_id"]) for r in found)
    assert P.token_lists(pa.array(texts, pa.string()).slice(7, 20)).to_pylist() == [re.findall("[a-z0-9]+", t) for t in texts[7:27]]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, name string, body string")
    assert "regexp_extract_all" not in plan(S.postings(docs))


def test_postings_of_a_few_words_are_those_of_the_index(spark):
    rng = random.Random(13)
    text = lambda: rng.choice([" ", "-", "é"]).join(rng.choices(["in", "The", "THÉ", "a", "7", "x264y", "264", "2645", "ﬁn", "then", "264in", "\n"], k=rng.randint(0, 9)))
    rows = [(i, rng.choice([text(), None]), rng.choice([text(), None, ""])) for i in range(200)] + [(None, "in the", "the"), (7, "the", "in")]
    docs = spark.createDataFrame(rows, "doc_id long, name string, body string")
    asked = ["in", "the", "a", "7", "264", "fin", "x264y", "the", "", "no.word", "absent"]
    whole = lambda frame: sorted((tuple(r) for r in frame.select("field", "token", "doc_id").collect()), key=str)
    want = S.postings(docs).filter(F.col("token").isin(asked))
    assert len({r.token for r in want.collect()}) == 6
    assert whole(S.word_postings_of(docs, asked)) == whole(want)
    assert whole(S.word_postings_of(docs, asked, name=None)) == whole(want.filter("field = 'f'"))
    assert S.word_postings_of(docs, ["a"]).count() == 0


def test_rule_candidates_make_no_whole_index(spark, small, monkeypatch):
    from skerry.plans import search_queries, state_queries

    monkeypatch.setattr(search_queries, "_indexes", {})
    assert state_queries.rule_candidates_then_scan(spark, small).count() > 0
    assert not search_queries._indexes


def test_phrases_span_no_two_files(spark):
    rows = [(1, [("a/small.ring", 1)]), (2, [("x/small", 1), ("ring/y", 2)]), (3, []), (4, [("small ring small.ring.mkv", 1)])]
    items = spark.createDataFrame(rows, "doc_id long, files array<struct<path:string,size:long>>")
    index = S.file_postings(items)
    assert sorted({r.doc_id for r in S.with_phrase(index, "small ring", "f").collect()}) == [1, 4]
    assert {(r.token, r.doc_id) for r in index.filter("field = 'e'").collect()} == {("ring", 1), ("mkv", 4)}
    assert [list(r["at"]) for r in index.filter("doc_id = 4 and field = 'f' and token = 'small'").collect()] == [[0, 2]]


def test_one_bad_text_costs_no_other_its_answer(spark):
    from skerry.operators import classifier as C

    asked = []

    def model(texts):
        asked.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("no answer")
        return ['{"response":"unsafe"}' if t else "{" for t in texts]

    assert [e is None for _, e in C.ask(model, ["a"] * 5 + ["bad"] + ["b"] * 2, 1)] == [True] * 5 + [False] + [True] * 2
    assert asked == [8, 4, 4, 2, 1, 1, 2]
    assert [e for _, e in C.ask(lambda t: [], ["x"], 2)] == ["ValueError: 0 answers to 1 texts"]
    docs = spark.createDataFrame([(1, "x"), (2, None), (2, "bad"), (None, "y")], "doc_id long, body string")
    got = sorted(((r.doc_id, r.label, r.score, r.done, r.failed) for r in C.scored(C.answers(docs, model, batch_rows=3)).collect()), key=str)
    assert got == sorted([(1, "unsafe", 1.0, True, False), (2, None, None, False, True), (2, None, None, False, True), (None, "unsafe", 1.0, True, False)], key=str)


def test_merged_postings_are_rows(spark):
    one = spark.createDataFrame([("n", "x", 2), ("n", "y", 2)], "field string, token string, doc_id long")
    two = spark.createDataFrame([("n", "x", 1), ("n", "x", 2)], one.schema)
    assert sorted(tuple(r) for r in S.merged_postings(one, two).collect()) == [("n", "x", 1), ("n", "x", 2), ("n", "y", 2)]


def test_roll_up_counts_points_without_the_gauge(spark):
    p = spark.createDataFrame([(600, 100.0, 1, 1), (610, None, 2, 2), (620, None, None, 4), (630, 0.0, 2, 5), (900, 5.0, 3, 3), (1200, None, 4, 6), (1500, 0.25, 5, 7), (1800, 0.75, 6, 8)], "t long, gauge double, counter long, event_id long")
    got = {r.t: (r.gauge, r.counter) for r in T.roll_up(p, 300).collect()}
    assert got == {750: (25.0, 2), 1050: (5.0, 3), 1350: (None, 4), 1650: (0.2, 5), 1950: (0.8, 6)}


def test_down_sample_does_not_cross_gaps(spark):
    p = spark.createDataFrame([(t, 1.0, t, t, "a") for t in (0, 10, 20, 5000, 5010)], "t long, gauge double, counter long, event_id long, event_type string")
    assert sorted(r.t for r in T.down_sample(p, 2, 10).collect()) == [20, 5010]


def test_merge_of_observations(spark):
    rows = [(1, 7, 1000, 1, "x", "d", 5), (1, 7, 2000, -1, "", "c", 6), (1, 7, 3000, 0, "y", "a", 7)]
    o = spark.createDataFrame(rows, "ih long, ip long, port long, role int, client string, src string, ts long")
    r = O.merge(o).first()
    assert (r.role, r.port, r.client, r.src, r.first, r.last) == (1, 2000, "y", 7, 5, 7)


def test_last_client_and_port_of_a_connection(spark):
    rows = [(1, 7, 1000, 1, "zz", "d", 5), (1, 7, 0, -1, "aa", "c", 6), (1, 7, 3000, 0, "", "a", 7)]
    r = O.merge(spark.createDataFrame(rows, "ih long, ip long, port long, role int, client string, src string, ts long")).first()
    assert (r.port, r.client) == (1000, "aa")


def test_ranges_over_many_steps(spark):
    rows = [(k, ip, 0, k) for k, ip in enumerate((0, 65_535, 65_536, 200_000, 2**32 - 1))]
    merged = spark.createDataFrame(rows, "ih long, ip long, role int, last long")
    spans = spark.createDataFrame([(65_535, 70_000), (0, 0), (199_999, 2**32 - 1)], "low long, high long")
    assert sorted(r.ip for r in O.in_ranges(merged, spans).collect()) == [0, 65_535, 65_536, 200_000, 2**32 - 1]
    assert O.in_ranges(merged, spans.limit(0)).count() == 0


def test_series_are_carried_over_days(spark):
    """Windows of stretches and their carried edges give what one window over the whole series gives."""
    from pyspark.sql.window import Window

    rng = random.Random(11)
    rows = [(rng.randrange(12) * 40_000 + rng.randrange(3), n, rng.randrange(100), rng.choice("ab")) for n in range(300)]
    p = spark.createDataFrame(rows, "t long, event_id long, counter long, event_type string")
    order = Window.partitionBy("event_type").orderBy("t", "event_id")
    got = T.running(T.previous(p, "event_type", "t", "counter"), "event_type", s=("sum", F.col("counter")), m=("max", F.col("counter")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    want = p.select("*", F.lag("t").over(order).alias("prev_t"), F.lag("counter").over(order).alias("prev_counter"), F.sum("counter").over(upto).alias("s"), F.max("counter").over(upto).alias("m"))
    key = lambda f: sorted((r.event_id, r.prev_t, r.prev_counter, r.s, r.m) for r in f.select("event_id", F.coalesce("prev_t", F.lit(-1)).alias("prev_t"), F.coalesce("prev_counter", F.lit(-1)).alias("prev_counter"), "s", "m").collect())
    assert key(got) == key(want)


def test_full_days_are_cut_into_shorter_stretches(spark):
    p = spark.range(400_000).selectExpr("'a' event_type", "id div 4 t", "id event_id", "id counter")
    assert T.stretch_width(p, "event_type") == T.DAY * T.STRETCH // (4 * T.DAY)
    assert T.stretch_width(p.limit(10), "event_type") == T.stretch_width(p.limit(0), "event_type") == T.DAY
    assert T.stretch_width(spark.range(200_000).selectExpr("'a' event_type", "0L t"), "event_type", most=1) == 1


def test_rates_deal_no_series_to_one_task(spark):
    """Points of one series aren't shuffled by the series alone; typical steps come from a table, which is broadcast."""
    p = spark.range(5_000).selectExpr("'all' event_type", "id t", "id event_id", "id counter")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        r = T.rates(p, 120)
        plan = r._jdf.queryExecution().executedPlan().toString()
        assert r.filter("rate is not null and rate <> 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin \[event_type#\d+\]", plan)


def test_history_range_takes_the_tier_and_completes_it(spark):
    day = T.DAY
    raw = spark.range(0, 2 * day, 60).selectExpr("id t", "id event_id", "1.0D gauge", "id counter")
    m5 = spark.range(150, day, 300).selectExpr("id t", "id event_id", "2.0D gauge", "id counter")
    tiers = {"raw": raw, "m5": m5, "h1": raw.limit(0)}
    assert [T.tier_for(s) for s in (60, day, day + 1, 30 * day, 31 * day)] == ["raw", "raw", "m5", "m5", "h1"]
    last_hour = T.history_range(tiers, 3600, 2 * day).collect()
    assert len(last_hour) == 60 and {r.tier for r in last_hour} == {"raw"}
    both = T.history_range(tiers, 2 * day, 2 * day, most=10_000).collect()
    newest = max(r.t for r in both if r.tier == "m5")
    assert min(r.t for r in both if r.tier == "raw") > newest + 150
    assert T.history_range(tiers, 2 * day, 2 * day).count() <= 620
    assert T.history_range({k: v.limit(0) for k, v in tiers.items()}, 60, 5).count() == 0


def test_addresses_of_version_six(spark):
    import ipaddress

    texts = ["::", "::1", "2001:db8::1:0:0:1", "1:2:3:4:5:6:7:8", "2001:DB8:0:0:1::", "::ffff:198.18.0.1", "fe80::198.18.0.1", "0:0:1::", "1::2::3", "1:2:3", "12345::", "198.18.0.1", "x", ""]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", N.ip_binary(F.col("x")).alias("b"), N.ip_text(N.ip_binary(F.col("x"))).alias("t")).collect()
    for r in got:
        try:
            a = ipaddress.ip_address(r.x)
        except ValueError:
            assert r.b is None and r.t is None, r
            continue
        packed = a.packed if a.version == 6 else b"\0" * 10 + b"\xff\xff" + a.packed
        mapped = a.ipv4_mapped if a.version == 6 else a
        assert bytes(r.b) == packed and r.t == str(mapped or a), r
    whole = ["8.8.8.8", "10.1.1.1", "2606:4700::1", "fe80::1", "fd00::1", "2001:db8::5", "::1", "2002::1", "100::9"]
    seen = spark.createDataFrame([(t,) for t in whole], "x string").select("x", N.is_global_packed(N.ip_binary(F.col("x"))).alias("g")).collect()
    assert {r.x: r.g for r in seen} == {t: ipaddress.ip_address(t).is_global for t in whole}
    specs, bad = N.ip_specs("198.18.0.1:80, [2001:db8::1]; 10.0.0.7/8 nonsense")
    assert [v4 for _, _, v4 in specs] == [True, False, True] and bad == ["nonsense"]


def test_rules_of_another_catalogue(spark):
    schema = "id string, term string, scope string, mode string"
    here = spark.createDataFrame([("a", "x", "all", "word"), ("b", "y", "all", "word")], schema)
    there = spark.createDataFrame([("q", "x", "all", "word"), ("a", "z", "all", "word"), (None, "v", "all", "word"), ("c", "w", "all", "word"), ("c", "u", "all", "word"), ("d", "u", "all", "word")], schema)
    got = {r.term: r.id for r in M.merge_rules(here, there).collect()}
    assert set(got) == {"z", "v", "w", "u"} and got["u"] == "c" and len(set(got.values()) - {"a", "b"}) == 4


def test_caps_are_the_references(spark):
    merged = spark.range(310).selectExpr("1L ih", "id ip", "id last")
    assert sorted(r.ip for r in O.cap(merged).collect()) == list(range(10, 310))
    assert sorted(r.ip for r in O.cap(merged, 2).collect()) == [308, 309]
    obs = spark.range(600).selectExpr("id ip", "cast(id % 599 as int) port")
    assert O.registry(obs, 7, everywhere=True).count() == 597 and O.registry(obs, 7).count() == 0  # 0.0.0.0/8 isn't global
    assert [tuple(r) for r in O.registry(obs, 1, 2, everywhere=True).collect()] == [(2, 2), (3, 3)]
    nodes = O.node_union(spark.range(1500), spark.range(1400, 1600))
    assert nodes.count() == 1600 and [r.id for r in O.node_union(spark.range(3), spark.range(5), 4).collect()] == [0, 1, 2, 3]
    assert (O.KEY_ROWS, O.REGISTRY_NODES, O.KEPT_NODES) == (300, 50_000, 100_000)


def test_rules():
    assert M.check_rule("", "all", "word") and M.check_rule("(", "all", "regex") and M.check_rule(".*", "all", "regex")
    assert M.check_rule("a b", "name", "word") is None
    for pattern in ("(?P<x>a)", "(a+)+b", "(x*y)*", r"a\Z", "[a&&b]"):
        assert M.check_rule(pattern, "all", "regex"), pattern
    for pattern in ("lo[sz]er", "(foo|bar)+x", r"a\.b{2,3}", "(?:a|b)c"):
        assert M.check_rule(pattern, "all", "regex") is None, pattern


def test_policy_prefers_overrides(spark):
    rows = [(1, 90, 1, True, None, False), (2, 90, 1, True, "allow", False), (3, 0, 1, False, "hide", False), (4, 90, 64, True, None, False), (5, None, None, False, None, False)]
    s = spark.createDataFrame(rows, "doc_id long, score long, cats long, done boolean, override string, deleted boolean")
    assert ids(s.filter(M.policy(50, 63))) == [1, 3]


def test_discovery_steps():
    s = None
    for kind in ("seen", "probe", "fail", "probe", "fail", "probe", "fail"):
        s = rollup.step(s, kind, 1)
    assert s["status"] == "failed" and s["attempts"] == 3
    assert rollup.step(s, "seen", 2)["status"] == "pending"


class Held:
    """Stands in for the state of a group."""

    exists, get, hasTimedOut, timeout = False, None, False, None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def update(self, value):
        self.exists, self.get = True, value


def test_discovery_timer_releases_a_retry():
    held = Held()
    list(rollup.discover((7,), iter([pd.DataFrame([{"kind": k, "ts": n, "seq": n} for n, k in enumerate(("announce", "probe", "fail"))])]), held))
    assert held.timeout == (2 + rollup.RETRY_DELAY_S) * 1000
    held.hasTimedOut = True
    out = list(rollup.discover((7,), iter([]), held))[0].iloc[0]
    assert (out.status, out.priority) == ("pending", True)


def test_discovery_waits_and_promotes():
    hour = 3600
    cases = {
        (("seen", 0), ("fail", 1)): ("failed", 1, False),
        (("seen", 0), ("fail", 0), ("seen", 6 * hour)): ("failed", 1, False),
        (("seen", 0), ("fail", 0), ("seen", 6 * hour + 1)): ("pending", 0, True),
        (("seen", 0), ("fail", 0), ("peer", hour)): ("failed", 1, False),
        (("seen", 0), ("fail", 0), ("peer", hour + 1)): ("pending", 1, True),
        (("seen", 0), ("seen", 1)): ("pending", 0, True),
        (("announce", 0), ("probe", 1), ("fail", 2)): ("retry", 1, False),
        (("announce", 0), ("fail", 2), ("seen", 3)): ("pending", 1, True),
        (("announce", 0), ("fail", 1), ("fail", 2), ("fail", 3), ("seen", 7 * hour), ("fail", 7 * hour + 1)): ("retry", 1, False),
        (("seen", 0), ("ok", 1), ("probe", 2), ("fail", 3)): ("indexed", 0, False),
    }
    for events, want in cases.items():
        held = Held()
        for n, (kind, ts) in enumerate(events):  # a micro-batch for each event
            out = list(rollup.discover((7,), iter([pd.DataFrame([{"kind": kind, "ts": ts, "seq": n}])]), held))[0].iloc[0]
        assert (out.status, out.attempts, out.priority) == want, events


def test_file_summary_is_what_its_parts_give(spark):
    """Category, extensions, number and bytes of files in one pass, with ties, files without size or extension."""
    from skerry.operators import records as R

    rng = random.Random(5)
    names = ["a.mkv", "b.mp4", "c.MP3", "d.tar.gz", "noext", "e.zip", "f.jpg", "g.pdf", "h.csv", "i.exe", "j.srt", "k.nfo"]
    rows = [(rng.randrange(40), n, rng.choice(names), rng.choice([None, 0, 1, 5, 5])) for n in range(300)] + [(99, 1, "noext", 3)]
    files = spark.createDataFrame(rows, "doc_id long, n long, path string, size long")
    want = R.dominant_category(files, "n").join(R.top_exts(files, "n"), "doc_id", "left").join(files.groupBy("doc_id").agg(F.count("*").alias("file_count"), F.sum("size").alias("size")), "doc_id")
    got = R.file_summary(files, "n").select(want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.filter("doc_id = 99 and exts is null and category = 'Other'").count() == 1
