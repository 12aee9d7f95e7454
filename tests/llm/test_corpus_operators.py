"""Edge cases of the corpus operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import itertools
import json
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import bpe, components, exactdedup, idfile, langid, ngramjoin, packing, quality, registry, secrets, toxicity, urlfilter

ROWS = [(1, "The same words here again and again"), (2, None), (3, ""), (3, ""), (None, "x"), (5, "é" * 3), (6, "word " * 30_000), (7, " \n\t "), (8, "The same words here again and again")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    extra = ["ids", "n_tokens", "kept", "keep_id", "host", "bad", "spans", "score", "rep", "component_id", "sha256", "n", "grp"]
    return docs.withColumns({c: F.lit("clash") for c in extra} | {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})


def all_rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_bpe_round_trip(spark, odd):
    import public_tokenizers

    rows = all_rows(bpe.decode(bpe.encode(odd, registry.BYTE_BPE, public_tokenizers.PATTERN), registry.BYTE_BPE))
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in rows) == sorted((i or 0, t or "") for i, t in ROWS)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert bpe.encode(odd.limit(0), registry.BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_replay_on_random_words():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(registry.BYTE_BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.MergeReplay(ranks, public_tokenizers.PATTERN), random.Random(3)
    words = ["".join(rng.choices("abcdeinst", k=rng.randint(1, 40))) for _ in range(3000)] + ["a" * 5000, "ab" * 999]
    for w, packed in zip(words, coder.encode(words)):
        assert np.frombuffer(packed, "<i4").tolist() == library.encode_ordinary(w)


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q"), (2, "https://a.example.com/en/x"), (3, "https://example.com"), (4, None), (5, "no scheme"), (6, "http://x.net/es/"), (6, "http://x.net/es/"), (7, "http://xnet/es/"), (8, "a://b.net#/es/")]
    rules = spark.createDataFrame(registry.URL_RULES + [(None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in all_rows(urlfilter.filter_urls(pages, rules)) if r["page_id"] != 5 or True)
    assert got == [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "a.example.com", "/en/x", "example.com/en/", "block"),
        (3, "example.com", "", None, "allow"),
        (4, "", "", None, "allow"),
        (5, "", "", None, "allow"),
        (6, "x.net", "/es/", "net/es/", "block"),
        (6, "x.net", "/es/", "net/es/", "block"),
        (7, "xnet", "/es/", None, "allow"),
        (8, "b.net", "", None, "allow"),
    ]
    assert urlfilter.filter_urls(pages, rules.limit(0)).filter("rule is not null").count() == 0
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0


def plain_components(docs, n, percent):
    """Brute force over all pairs."""
    sets = {}
    for i, t in docs:
        w = [x.lower() if x.isascii() else x for x in (t or "").split()]
        sets[i] = {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, bases, copies, length, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=length)
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(length)] = rng.choice(vocabulary)
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out + ["one two", "One Two", "", None, "one two three"]))


@pytest.mark.parametrize("n, percent, tile, part", [(4, 85, 512, 8192), (5, 80, 512, 8192), (4, 85, 16, 8192), (4, 85, 8, 32)])
def test_join_is_brute_force(spark, monkeypatch, n, percent, tile, part):
    monkeypatch.setattr(ngramjoin, "TILE", tile)
    monkeypatch.setattr(ngramjoin, "PART", part)
    docs = near_copies(n, 6, 25, 60, 3)
    got = ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(docs, n, percent)


def test_join_on_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(odd).collect()]
    assert len(got) == len(ROWS)
    assert {(i, c) for i, _, c in got if i in (1, 8)} == {(1, 1), (8, 1)}
    assert all(c == i for i, n, c in got if n == 0)
    assert ngramjoin.join(odd.limit(0)).count() == 0


def plain_rows(rows, n, percent):
    """Brute force over rows, whose ids may repeat or be null: (id, size, component, links to other sets) of each."""
    sets = [frozenset(" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if a and 100 * len(a & b) >= percent * len(a | b)] for a in sets]
    out = []
    for i, (own, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            fresh = set(linked[todo.pop()]) - reach
            reach |= fresh
            todo += fresh
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        out.append((own, len(sets[i]), min(ids) if ids else None, len({sets[j] for j in linked[i]} - {sets[i]})))
    return sorted(out, key=str)


def test_join_of_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    near = lambda t: t.replace(" ", " ", 1)[:-3] + "new"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (4, near(c)), (None, d), (None, near(d)), (5, None), (5, ""), (None, ""), (6, "one"), (6, "one")]
    for n, percent in ((4, 85), (5, 80), (4, 100)):
        got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == plain_rows(rows, n, percent)


def test_prefixes_lose_no_link():
    """Sets that link share enough within their prefixes, for every size and threshold."""
    rng = np.random.default_rng(8)
    for percent in (50, 80, 85, 100):
        for size in (1, 2, 7, 20, 41, 300):
            base = np.sort(rng.choice(10**6, size, replace=False)).astype(np.uint64)
            for gone in range(0, size + 1, max(1, size // 9)):
                other = np.sort(np.concatenate([rng.permutation(base)[: size - gone], rng.integers(10**6, 10**7, rng.integers(0, 1 + gone)).astype(np.uint64)]))
                both = len(np.intersect1d(base, other))
                if len(other) and both and 100 * both >= percent * len(np.union1d(base, other)):
                    sizes = np.array([len(base), len(other)])
                    x, y = (s[:k] for s, k in zip((base, other), ngramjoin.prefix_length(sizes, percent)))
                    for m in sizes:
                        assert len(np.intersect1d(x, y)) >= max(1, -(-int(m) * percent // 100) * ngramjoin.COMMON_PERCENT // 100)


@pytest.mark.parametrize("n", [1, 4])
def test_shingles_of_blocks_are_those_of_each_text(monkeypatch, n):
    """Hashes name the same word sequences in whatever block a text stands; words of all lengths, bytes of zero, odd separators."""
    rng = random.Random(n)
    some = [b"a", b"B", b"b", b"\0", b"a\0", "é".encode(), b"12345678", b"123456789", b"x" * 16, b"x" * 17, b"x" * 64, b"x" * 65, b"X" * 65, b"y" * 300]
    texts = [b"".join(rng.choice(some) + rng.choice([b" ", b"\n", b"\t ", b"\x0b", b"\x1f"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [b"", b" ", b"a", b" a", b"a B\0", b"a b \0", b"a\xc2\xa0b"]
    plain = [[tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if (w := t.lower().split()) else [] for t in texts]
    known = {}
    for limit in (1, 200, 10**6):
        monkeypatch.setattr(ngramjoin, "TEXT_BYTES", limit)
        keys, sizes, words, digests = ngramjoin.sets_in(pa.array(texts, pa.binary()), n)
        assert words.tolist() == [len(t.split()) for t in texts] and sizes.tolist() == [len(set(p)) for p in plain]
        for p, d, k in zip(plain, digests, np.split(keys, np.cumsum(sizes)[:-1])):
            assert known.setdefault(frozenset(p), (d, k.tolist())) == (d, k.tolist()) and k.tolist() == sorted(set(k.tolist()))
    assert len({d for d, _ in known.values()}) == len(known)
    assert len({x for _, k in known.values() for x in k}) == len({x for p in plain for x in p})


def test_overlaps_of_frequent_and_rare_keys():
    rng = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([np.arange(40), rng.integers(100, 400, 30)])).astype(np.uint64) for _ in range(50)]
    for split in (None, 20):
        got = ngramjoin.overlaps(sets, split)
        for a, b in itertools.combinations(range(50), 2):
            if split is None or (a < split <= b):
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_trie_spills_by_subtree():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) + b"x" * rng.randint(0, 50) for _ in range(2000)]
    want = {}
    for i, k in enumerate(keys):
        best, n = want.get(k, (i, 0))
        want[k] = (max(best, i), n + 1)
    rows, got, rounds = [(k, i, 1) for i, k in enumerate(keys)], {}, 0
    while rows:
        trie, later = exactdedup.Trie(max, 60_000), []
        for row in rows:
            later += trie.add(*row)
        got |= {k: (b, n) for k, b, n in trie.walk()}
        rows, rounds = later, rounds + 1
    assert got == want and rounds > 1


def test_exact_dedup(spark, odd, monkeypatch):
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in all_rows(exactdedup.dedup(odd)))
    assert got == [(0, 0, 1, True), (1, 8, 2, False), (2, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 2, True)]
    small = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in all_rows(exactdedup.dedup(odd, budget=1000)))
    assert small == got
    assert exactdedup.dedup(odd.limit(0)).count() == 0


def test_quality_measures(spark):
    rows = [(1, "a b c d e a b c d e f"), (2, "x x x x x x x"), (3, None), (4, "one\none\n \n\ntwo $%"), (5, "a b c d e f g h i j k l m")]
    got = {r.doc_id: r for r in quality.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_repeat_words for i in range(1, 6)] == [10, 7, 0, 0, 0]
    assert [got[i].n_words for i in range(1, 6)] == [11, 7, 0, 4, 13]
    assert (got[4].n_dup_lines, got[4].n_symbols, got[4].word_chars) == (1, 2, 11)
    assert [got[i].base_failed for i in range(1, 6)] == [True, True, True, True, False]


def test_frequent_lines_are_removed(spark):
    common = "this line stands in all documents of the host and is long enough"
    rows = [(i, f"{common}\nshort {i}", "h", "en", 1) for i in range(60)] + [(i, f"{common}\n" + " ".join(f"w{i}x{k}" for k in range(30)), "h", "en", 1) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    kept = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert set(kept) == set(range(100, 160)) and all(common not in t for t in kept.values())
    kept = {r.doc_id: r.text for r in quality.clean(docs, first_keeps=True).collect()}
    assert set(kept) == {0, *range(100, 160)}
    assert common in kept[0] and all(common not in t for i, t in kept.items() if i)
    assert quality.clean(docs.limit(0)).count() == 0


def test_line_limit_does_not_grow_with_the_host(spark):
    lines = [(i, "the line", host) for host, at in (("small", 0), ("hot", 10_000)) for i in range(at, at + 50)] + [(i, "a rarer line", "hot") for i in range(20_000, 20_049)]
    rows = spark.createDataFrame([(i, f"{line}\nown {i}", host) for i, line, host in lines], "doc_id long, text string, source string")
    others = spark.range(30_000, 36_000).selectExpr("id doc_id", "concat('other ', id) text", "'hot' source")
    got = quality.frequent_lines(quality.keyed(rows.unionByName(others), "doc_id", "text", "source")).collect()
    assert sorted((r.host, r.first) for r in got) == [("hot", None), ("small", None)]
    first = quality.frequent_lines(quality.keyed(rows, "doc_id", "text", "source"), first_keeps=True).join(quality.keyed(rows, "doc_id", "text", "source").select("doc_id", F.col("text_hash").alias("first")), "first")
    assert sorted((r.host, r.doc_id) for r in first.collect()) == [("hot", 10_000), ("small", 0)]


def test_lines_of_documents_or_of_distinct_texts(spark):
    text = "a line that stands in every copy of this one text\nand another one of the same"
    rows = [(i, text, "h") for i in range(60)] + [(1, text, "h")] * 100 + [(i, "b line of a document that is there again and again", "g") for i in [7] * 90 + [8]] + [(None, f"own {i}\na line without ids", "n") for i in range(50)]
    keyed = quality.keyed(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    assert sorted(r.host for r in quality.frequent_lines(keyed).collect()) == ["h", "h", "n"]
    assert [r.host for r in quality.frequent_lines(keyed, copies_once=True).collect()] == ["n"]


def test_quality_on_odd_rows(odd):
    assert quality.judge(odd).count() == len(ROWS)
    assert quality.clean(odd).columns == odd.columns


def test_id_blocks():
    rng = np.random.default_rng(2)
    for n, most in itertools.product((0, 1, 300, 6000), (1, 3, 49_000)):
        ids = rng.integers(0, most, n)
        data = idfile.write_block([4], [n], ids, 49_408)
        assert (idfile.read_block(data)[2] == ids).all()
    damaged = bytearray(data)
    damaged[len(damaged) // 2] ^= 1
    with pytest.raises(ValueError):
        idfile.read_block(bytes(damaged))


def test_words_are_the_library():
    coder = idfile.Words(registry.WORD_BPE)
    odd = ["\u00c9t\u00e9'S \u00d7\u00f7 \u00c6\u00d8\u0178\u017f\u0149 \u0130x \u00bd\u00aa \u00e9\u00e9e\u0301 na\u00efve-9\u0153!", "It'S a\x1cb \x00!\u0301 e\u0301 \u0130\u00df \u03a3\u03c2 \ufb01 <|endoftext|>x 9a8 \x7f don't", "\u01c5 \u4e2d\u6587\u5b57 \u0663 \u2028 \xa0a \u3000 ", "\x85a\x1f \x01b"]
    for text in odd:
        assert np.frombuffer(coder.encode([text.encode()], 1)[0], "<i4").tolist() == coder.coder.encode(text, add_special_tokens=False).ids + [1]


def test_new_words_of_known_pieces_take_no_call_each():
    coder, calls = idfile.Words(registry.WORD_BPE), []
    names = [a + b for a in "bcdfgklm" for b in ("ar", "en", "is", "ou", "\u00e9t")]
    coder.encode([" ".join([*names, "-"]).encode()], 1)
    text = " ".join(f"{a}-{b}" for a in names for b in names)
    sys.setprofile(lambda frame, event, arg: calls.append(frame) if event == "call" else None)
    try:
        packed = coder.encode([text.encode()], 1)[0]
    finally:
        sys.setprofile(None)
    assert len(calls) < len(names) ** 2 / 4
    assert np.frombuffer(packed, "<i4").tolist() == coder.coder.encode(text, add_special_tokens=False).ids + [1]


def test_cut_pieces_are_the_library(monkeypatch):
    monkeypatch.setattr(idfile, "MEMO_PIECES", 100)  # forgotten again and again
    coder, rng = idfile.Words(registry.WORD_BPE), random.Random(5)
    atoms = [*"ab1! \n\x01\x1c'", "'S", "'re", "'ll", "''", "\u00e9", "\u00c9", "\u00d7", "\u00f7", "\u0178", "\u0130", "\u4e2d", "e\u0301", "\u2019s", "\xa0", "<|", "<|endoftext|>"]
    for _ in range(40):
        texts = ["".join(rng.choices(atoms, k=rng.randrange(12))) for _ in range(30)]
        for text, packed in zip(texts, coder.encode([t.encode() for t in texts], 1)):
            assert np.frombuffer(packed, "<i4").tolist() == coder.coder.encode(text, add_special_tokens=False).ids + [1]
    odd = [b"\xff\xfe a\xc3", b"\xc3 b\x97", b"\xe4\xb8", b"", b" \n"]
    assert [np.frombuffer(p, "<i4").tolist()[:-1] for p in coder.encode(odd, 1)] == [coder.coder.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in odd]


def test_mixture_has_all_the_mass():
    """Intervals of all ids follow each other without gaps and fill the whole, and values find their ids."""
    model, rng = idfile.Model(50), np.random.default_rng(4)
    a = b = np.zeros(8, dtype=np.int64)
    for step in range(60):
        model.predict(a, b)
        end = np.zeros(8, dtype=np.int64)
        for i in range(50):
            ids = np.full(8, i)
            start, freq = model.interval(ids)
            assert (start == end).all() and (freq > 0).all()
            for value in (start, start + freq - 1):
                assert all((x == y).all() for x, y in zip(model.find(value), (ids, start, freq)))
            end = start + freq
        assert (end == 1 << idfile.ALL_BITS).all()
        ids = rng.integers(0, 3 if step % 2 else 50, 8)
        model.interval(ids)
        model.update(ids)
        a, b = b, ids
    with pytest.raises(ValueError):
        idfile.Model((1 << idfile.ZERO_BITS) + 1)


def test_id_files_on_odd_rows(spark, odd, tmp_path):
    path = str(tmp_path / "ids")
    read = idfile.read_ids(idfile.write_ids(odd, registry.WORD_BPE, path=path)).collect()
    assert sorted(r.doc_id or 0 for r in read) == [0, 1, 2, 3, 3, 5, 6, 7, 8]
    assert {r.n_tokens for r in read if r.doc_id in (2, 3, 7)} == {1}
    assert min((r.part, r.start_in_part) for r in read) == next((r.part, r.start_in_part) for r in read if r.doc_id is None)
    assert idfile.read_ids(idfile.write_ids(odd.limit(0), registry.WORD_BPE)).count() == 0
    # the files open without Spark: lines of text, in the order of the names
    plain = []
    for name in sorted(f for f in os.listdir(path) if f.startswith("part-")):
        for line in (tmp_path / "ids" / name).read_text().splitlines():
            ids, counts, _ = idfile.read_block(base64.b64decode(line.split("\t")[6]))
            plain += zip(ids.tolist(), counts.tolist())
    assert [i for i, _ in plain] == [idfile.NO_ID, 1, 2, 3, 3, 5, 6, 7, 8]


def test_language_edge_cases(spark, odd):
    model = langid.Classifier({"en": b"the and of that", "fr": b"le la les que"})
    assert [model.predict(t)[0] for t in (None, "", "12 !", "the and of that")] == ["und", "und", "und", "en"]
    assert langid.classify(odd, {}).count() == len(ROWS)
    assert langid.fit(odd.limit(0)) == {}


def test_languages_are_the_smallest_output(spark):
    """The classifier against one plain compression for each text and language."""
    import zstandard

    rng = random.Random(6)
    alphabets = {"x": "abcdef", "y": "defghi", "z": "ghijkl"}
    word = lambda a: "".join(rng.choices(a, k=rng.randint(2, 6)))
    dictionaries = {k: " ".join(word(a) for _ in range(300)).encode() for k, a in alphabets.items()}
    texts = [" ".join(word(alphabets[rng.choice("xyz")]) for _ in range(rng.randint(1, 40))).upper() for _ in range(80)] + ["abc " * 20_000, "?", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.classify(docs, dictionaries).collect():
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = {}
        for k, d in dictionaries.items():
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = len(coder.compress(text.lower().encode()))
        first, second = sorted(sizes.values())[:2]
        assert r.lang_pred == min(sizes, key=lambda k: (sizes[k], k))
        assert abs(r.score - min(1.0, 0.5 + 5 * (second - first) / second)) < 1e-9 and r.rejected == ((second - first) / second < langid.MARGIN)


def test_toxicity_is_plain_noisy_or(spark):
    """Scores against products over sentences, with weights that a small sample gives."""
    import math
    import re

    rng, vocabulary = random.Random(2), [f"word{k}" for k in range(40)] + ["moron", "scum"]
    text = lambda: ". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for _ in range(rng.randint(1, 6)))
    texts = [text() for _ in range(150)]
    weights = toxicity.train(texts, np.array([int("moron" in t or "scum" in t) for t in texts]), epochs=60)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, ""), (901, None), (902, "fine words " * 20_000 + ". moron")], "doc_id long, text string")
    for r in toxicity.score(docs, weights).collect():
        none = 1.0
        for sentence in re.split(r"[.!?]+\s+|\n+", {900: "", 901: "", 902: "fine words " * 20_000 + ". moron"}.get(r.doc_id) if r.doc_id >= 900 else texts[r.doc_id]):
            words = set(sentence.lower().split())
            if words:
                z = weights[-1] + sum(weights[k] for w in words for k in toxicity.slots_of(w.encode()))
                none *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(r.score - (1 - none)) < 1e-4


def test_toxicity_edge_cases(spark, odd):
    texts = ["you are a moron indeed. fine words here"] * 20 + ["fine words here. more fine words"] * 40
    weights = toxicity.train(texts, np.array([1] * 20 + [0] * 40))
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(1, "Nice day. A moron, indeed!"), (2, "fine words"), (3, None)], "doc_id long, text string"), weights).collect()}
    assert got[1].score > 0.5 > got[2].score and got[3].score == 0
    assert [(s.start, s.end) for s in got[1].sentences] == [(10, 26)]
    assert toxicity.score(odd, weights).count() == len(ROWS)


def test_packing_respects_conflicts(spark):
    rows = [(i, "hot", "same" if i % 2 else None, 100) for i in range(40)] + [(100, None, None, 5000), (101, "s", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster string, n_units long")
    got = packing.pack(docs, capacity=1000, per_source=4).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    hot = [[i for i in held if i < 40] for held in bins.values()]
    assert all(len(h) <= 4 and sum(i % 2 for i in h) <= 1 for h in hot)
    assert sum(r.n_units for r in got if r.doc_id == 100) == 5000 and sum(r.doc_id == 101 for r in got) == 1
    assert packing.pack(docs.limit(0)).count() == 0


def plain_best_fit(rows, capacity, per_source):
    """Every piece, largest first, into the fullest of all bins with room that it fits and that its source and cluster allow; a full bin takes no more, not even empty pieces."""
    pieces = []
    for k, (i, source, cluster, n) in enumerate(sorted(rows, key=lambda r: (-r[3], r[0], r[1], r[2]))):
        sizes = [capacity] * (n // capacity) + ([n % capacity] if n % capacity or n < capacity else [])
        pieces += [(size, k, p, i, source, cluster) for p, size in enumerate(sizes)]
    bins = []
    for size, k, p, i, source, cluster in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        fits = [b for b in bins if sum(x[1] for x in b) < capacity and sum(x[1] for x in b) + size <= capacity and sum(x[2] == source for x in b) < per_source and (size == capacity or all(x[3] != cluster or x[4] == k for x in b))]
        best = min(fits, key=lambda b: (capacity - sum(x[1] for x in b), bins.index(b)), default=None)
        if best is None:
            bins.append(best := [])
        best.append((i, size, source, cluster, k))
    return sorted(sorted((i, size) for i, size, *_ in b) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_plain_best_fit(spark, seed):
    """One group against a search over all bins, with ties, sources and clusters that conflict, empty rows and long ones."""
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc" if seed % 2 else "abcdefghij"), f"c{rng.randrange(5 + 60 * (seed % 3))}", rng.choice([0, 1, 7, 20, 20, 33, 50, 99, 100, 101, 250])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster string, n_units long").withColumns({c: F.lit("clash") for c in ("grp", "n", "bin_id", "piece")})
    bins = {}
    for r in packing.pack(docs, capacity=100, per_source=3).collect():
        bins.setdefault(r.bin_id, []).append((r.doc_id, r.n_units))
    assert sorted(sorted(b) for b in bins.values()) == plain_best_fit(rows, 100, 3)


def test_packing_of_odd_rows(spark, odd):
    units = packing.measured(odd.select("doc_id", "source", "text"))
    packed = packing.pack(units).collect()
    assert sorted((r.doc_id or 0, r.n_units) for r in packed if r.doc_id in (2, 3, 7)) == [(2, 0), (3, 0), (3, 0), (7, 0)]
    assert sum(r.n_units for r in packed if r.doc_id == 6) == 30_000
    with pytest.raises(ValueError):
        packing.measured(units)
    assert packing.pack(packing.clustered(odd.limit(0))).count() == 0


def test_packing_fills_groups_as_one_run(spark):
    """Bins of small groups are almost as full as those of one run over all rows."""
    rng = random.Random(3)
    rows = [(i, f"s{rng.randrange(50)}", None, int(min(3000, rng.lognormvariate(5.5, 0.8)))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster string, n_units long")
    one, many = (packing.pack(docs, group_rows=g).select("bin_id").distinct().count() for g in (10_000, 500))
    assert many <= 1.05 * one


def test_components_without_edges(spark):
    edges = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a long, b long")
    assert components.components(edges).count() == 0 and components.components(edges.limit(0)).count() == 0


def test_packing_keeps_near_copies_apart(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, "a", " ".join(words)), (2, "b", " ".join([*words[:50], "other", *words[51:]])), (3, "c", " ".join(f"x{k}" for k in range(100))), (4, "d", None), (None, "e", "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    bins = {r.doc_id: r.bin_id for r in packing.pack(packing.clustered(docs)).collect()}
    assert len(bins) == 5 and bins[1] != bins[2] and bins[3] in (bins[1], bins[2])


def test_packing_clusters_by_row(spark):
    """Rows that repeat an id have the cluster of their own text, and columns may have other names."""
    words = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    rows = [(0, "s", words("b")), (1, None, words("a")), (1, "t", words("b") + " more"), (None, "u", words("b")), (2, "v", ""), (3, "v", None)]
    docs = spark.createDataFrame(rows, "n long, host string, body string").withColumns({c: F.lit("clash") for c in ("doc_id", "source", "text", "mark", "carried")})
    got = {(r.doc_id, r.source): (r.n_units, r.cluster) for r in packing.clustered(docs, id_col="n", source_col="host", text_col="body").collect()}
    assert {k: v[0] for k, v in got.items()} == {(0, "s"): 60, (1, None): 60, (1, "t"): 61, (None, "u"): 60, (2, "v"): 0, (3, "v"): 0}
    assert got[0, "s"][1] == got[1, "t"][1] == got[None, "u"][1] != got[1, None][1] and got[2, "v"][1] is None is got[3, "v"][1]


def test_quality_cleans_other_columns(spark):
    line = "the very same line of many words in each of these documents"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(i, f"{line}\n{own(i)}", "h") for i in range(60)] + [(99, f"{line}\n{own(99)}", "other")]
    docs = spark.createDataFrame(rows, "id long, body string, site string").withColumns({c: F.lit("clash") for c in ("doc_id", "source", "text", "host")})
    got = quality.clean(docs, id_col="id", text_col="body", host_col="site")
    assert got.columns == docs.columns
    assert {r.id: r.body for r in got.collect()} == {i: own(i) if i < 60 else t for i, t, _ in rows}


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_structures_of_secrets():
    rsa = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + k] * 60)) for k in range(8)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, rsa))
    text = base64.b64encode(pkcs8).decode()
    assert [k for k, _, _ in secrets.scan(f"key {text} end")] == ["der"]
    assert secrets.scan(f"key {text[:-8]}AAAA end") == []
    lines = "\n".join(text[i : i + 64] for i in range(0, len(text), 64))
    assert [k for k, _, _ in secrets.scan(f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----")] == ["der"]
    assert {k for k, _, _ in secrets.scan(rsa.hex())} == {"hex", "der"}
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2lnbmF0dXJl"
    assert secrets.scan(f"é {token}") == [("jwt", 2, 2 + len(token))]
    assert secrets.scan(f"{part({'no': 1})}.{part({'sub': 1})}.x") == []
    spaced = base64.urlsafe_b64encode(b'{ \n "alg": "none"}').decode().rstrip("=")
    assert [k for k, _, _ in secrets.scan(f"key={spaced}.{part({'sub': 1})}. keys{token}")] == ["jwt", "jwt"]
    assert secrets.scan("eyeyey" * 20_000 + "." + "ew" * 1000 + ".x") == []
    for wrapped in ("\n".join(lines.split("\n")), lines.replace("\n", "\\n"), f"-----BEGIN PRIVATE KEY-----\\n{lines}\\n-----END PRIVATE KEY-----".replace("\n", "\\n")):
        assert [k for k, _, _ in secrets.scan(f'"{wrapped}"')] == ["der"], wrapped
    assert ("der", 4, 3 + 3 * len(rsa)) in secrets.scan(f"key {':'.join(f'{b:02X}' for b in rsa)} end")
    assert ("der", 1, 1 + 2 * len(rsa)) in secrets.scan("a" + rsa.hex()) and ("der", 0, 2 * len(rsa)) in secrets.scan(rsa.hex() + "a")
    blob = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + blob(b"none") + blob(b"none") + blob(b"") + (1).to_bytes(4, "big") + blob(b"public") + blob(b"private" * 5)
    assert [k for k, _, _ in secrets.scan(base64.b64encode(ssh).decode())] == ["openssh"]


def test_redaction(odd):
    assert secrets.redact('x token = "abcdefghij" y') == 'x [SECRET]" y'
    assert secrets.redacted(odd).count() == len(ROWS)
    assert secrets.find_secrets(odd.limit(0)).count() == 0
