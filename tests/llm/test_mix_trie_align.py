"""Mixing, prefix trie and alignment: against brute force, on random and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skerry.llm import align, mixing, prefixtrie, registry

ODD = ["", None, "a", " ", "  a", "a  b\n c\t d ", "▁x y", "<s> </s> <unk> <0x41>", "x<|endoftext|>y", "\x00a\x00", "é ﬁ ́ ï", "a b  c", "word " * 3_000, "x" * 5_000, "日本語 テキスト 🙂🙂", "a 　 b", "\x1c a\x1d b \x85 c", "don't  we'll", "a", "1234567 89"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return len([w for w in (text or "").replace("\x0b", " ").translate({c: 32 for c in range(9, 14)}).split(" ") if w])


# alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = align.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, a_bytes, b_bytes


def groups_of(text, tokenizers):
    """Groups of whole texts, one token after another."""
    a, b, a_bytes, b_bytes = tokenizers
    if not text:
        return []
    x, y, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    if b"".join(map(a_bytes.__getitem__, x)) != raw or b"".join(map(b_bytes.__getitem__, y)) != raw:
        return []
    out, x, y = [], x[::-1], y[::-1]
    while x:
        left, right = [x.pop()], [y.pop()]
        m, n = len(a_bytes[left[0]]), len(b_bytes[right[0]])
        while m != n:
            if m < n:
                left.append(x.pop())
                m += len(a_bytes[left[-1]])
            else:
                right.append(y.pop())
                n += len(b_bytes[right[-1]])
        out.append((left, right))
    return out


def expected_alignment(texts, tokenizers):
    groups = [groups_of(t, tokenizers) for t in texts]
    links = [[(x, y) for left, right in g for x in left for y in right] for g in groups]
    count = Counter(pair for of_text in links for pair in set(of_text))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for g, of_text in zip(groups, links):
        written = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in g)
        yield (
            sum(len(left) for left, _ in g), sum(len(right) for _, right in g), len(g), len(of_text),
            sum(count[p] == best[p[0]] for p in of_text), sum(count[p] for p in of_text), sha(written) if g else "",
        )


def aligned_rows(df, **options):
    aligned = align.align(df, registry.BYTE_BPE_LIBRARY, registry.PIECE_BPE, **options).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)))
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha)) for r in align.count(aligned, more=["sha"]).collect()]


@pytest.mark.parametrize("block_bytes", [align.BLOCK_BYTES, 40])
def test_alignment_of_odd_texts(spark, tokenizers, block_bytes):
    rows = list(enumerate(ODD)) + [(None, "a"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("groups", F.lit(1))
    want = sorted(zip((i if i is not None else -1 for i, _ in rows), expected_alignment([t for _, t in rows], tokenizers)))
    assert sorted((i if i is not None else -1, r) for i, r in aligned_rows(df, block_bytes=block_bytes)) == want
    assert aligned_rows(df.limit(0)) == []


def test_alignment_memo_runs_over(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(align, "MEMO_WORDS", 10)
    coder = align.Encoders(registry.BYTE_BPE_LIBRARY, registry.PIECE_BPE)
    rng = random.Random(5)
    for _ in range(8):
        texts = [" ".join("".join(rng.choices("abcé\n▁", k=rng.randint(0, 90))) for _ in range(6)) for _ in range(5)]
        (a, b), long = coder.encode(texts)
        want = [groups_of(t, tokenizers) for t in texts]
        assert a.tolist() == [i for g in want for left, _ in g for i in left]
        assert b.tolist() == [i for g in want for _, right in g for i in right]
        assert long.tolist() == [len(t.encode()) + 1 if g else 0 for t, g in zip(texts, want)]


def test_alignment_of_documents(spark, small, tokenizers):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in registry.op13_cross_tokenizer_alignment(spark, small).collect()}
    assert len(got) == len(docs)
    for d, want in zip(docs, expected_alignment([d.text for d in docs], tokenizers)):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want


# prefix trie


def turn_key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}")


def expected_trie(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own[row[0]].append((row[2] or "", row[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    for p, m in list(members.items()):
        inside = list(below(p))
        saved = sum((len(members[q]) - 1) * words(q[-1][1]) for q in inside if q)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in inside), saved, sha(ends)


def nodes(df):
    return prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.sequences(df)))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "no conversation"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]
    for c in range(-20 if seed else 0, 300):
        for k in range(rng.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if seed < 2 else "u", rng.choice(["", "x", "x  y\nz", None])))
    df = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit("clash"), "words": F.lit(1), "part": F.lit(2)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", (1, 5, 23)[seed])
    try:
        assert ordered(map(tuple, nodes(df).collect())) == ordered(expected_trie(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(0, k, "user", f"turn {k}") for k in range(2_000)] + [(20 * c, k, "u", "same") for c in range(1, 2_000) for k in range(2)]
    df = spark.createDataFrame(rows, TURNS)
    assert ordered(map(tuple, nodes(df.filter("conv_id > 0 or turn < 30")).collect())) == ordered(expected_trie([r for r in rows if r[0] or r[1] < 30]))
    long = nodes(df).filter("depth >= 3").agg(F.count("*"), F.max("depth"), F.sum("n_convs"), F.sum("n_leaves")).first()
    assert tuple(long) == (1_998, 2_000, 1_998, 1_998)


def test_trie_without_turns(spark):
    assert nodes(spark.createDataFrame([], TURNS)).collect() == []
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its template is missing
    (root,) = nodes(spark.createDataFrame([(alone, None, None, None)], TURNS)).collect()
    assert tuple(root) == (alone, 0, None, 1, 0, 1, 0, sha(str(alone)))


def test_ids_are_hashed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN_IDS", 7)
    rows = [(bytes([g]), i) for g, n in enumerate([1, 6, 7, 8, 100]) for i in range(-3, n)]
    got = {bytes(r.group): r.ends_sha256 for r in prefixtrie.id_hashes(spark.createDataFrame(rows, "group binary, conv_id long").repartition(5)).collect()}
    assert got == {bytes([g]): sha(",".join(str(i) for i in range(-3, n))) for g, n in enumerate([1, 6, 7, 8, 100])}


# mixing


def expected_targets(sizes, weights=(1, 2, 3), limit=3):
    """sizes by source; shares of all, with what is above the limit reshared until none is."""
    of = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full = {}
    while True:
        rest, weight = sum(sizes.values()) - sum(full.values()), sum(w for s, w in of.items() if s not in full)
        above = [s for s in sizes if s not in full and rest * of[s] > limit * sizes[s] * weight]
        if not above:
            return {s: full.get(s, rest * of[s] / weight if weight else 0) for s in sizes}
        full |= {s: limit * sizes[s] for s in above}


def check_mix(rows, got):
    sizes, most = Counter(), Counter()
    for _, source, text in rows:
        sizes[source] += words(text)
        most[source] = max(most[source], words(text))
    targets, taken = expected_targets(sizes), Counter()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=key) == sorted(((i, s, words(t)) for i, s, t in rows), key=key)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size
        if r.size:
            assert targets[r.source] / r.source_size - 1 < r.copies < targets[r.source] / r.source_size + 1 or r.copies == targets[r.source] / r.source_size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= most[s] / 2 + 1e-6


@pytest.mark.parametrize("bucket_rows, fan", [(mixing.BUCKET_ROWS, mixing.FAN), (10, 3), (3, 2)])
def test_mix_of_odd_sources(spark, bucket_rows, fan):
    rng = random.Random(9)
    sources = ["b"] * 90 + ["a"] * 30 + [None] * 20 + ["", "ß", "Z", "empty", "empty"]
    rows = [(i if i % 50 else None, s, None if s == "empty" else "w " * rng.choice([0, 1, 3, 10, 40])) for i, s in enumerate(sources)]
    rows += [(5, "b", "again and again")] * 4 + [(6, "a", "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(7) for c in ("size", "rank", "bucket", "p", "of", "copy")})
    got = mixing.mix(df, bucket_rows=bucket_rows, fan=fan).collect()
    check_mix(rows, got)
    again = mixing.mix(df.repartition(7), bucket_rows=bucket_rows, fan=fan).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mix_of_documents(spark, small):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    check_mix(rows, registry.op11_mix_sources(spark, small).collect())


def test_averages_hold():
    """Every fraction stays what it was on average, and every meeting keeps the words of both."""
    rng, n = random.Random(1), 40_000
    for size, p, other, q in [(10, 0.3, 4, 0.5), (1, 0.9, 100, 0.2), (7, 0.5, 7, 0.5)]:
        total = [0.0, 0.0]
        for _ in range(n):
            x, y = mixing.meet(size, p, other, q, rng.random())
            assert abs(size * x + other * y - size * p - other * q) < 1e-9 and (x in (0.0, 1.0) or y in (0.0, 1.0)) and 0 <= x <= 1 and 0 <= y <= 1
            total[0] += x
            total[1] += y
        assert total[0] / n == pytest.approx(p, abs=0.015) and total[1] / n == pytest.approx(q, abs=0.015)
