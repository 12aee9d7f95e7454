"""Corpus queries against SQL where it can express them, else against brute force over the whole small tables."""

import base64
import hashlib
import re
import zlib

import public_tokenizers
import pytest

from skerry.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(registry.queries()[name], registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_byte_bpe_is_the_library(spark, small, texts):
    import tiktoken

    with open(registry.BYTE_BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = registry.op1_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_token_ids_are_the_library(spark, small, texts):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(registry.WORD_BPE), 0
    rows = registry.op6_token_id_output(spark, small).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(packed))
        start += len(ids)


def base_spans(text):
    """The three base patterns, written plainly."""
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets_keep_the_base(spark, small, texts):
    kinds = ("assign", "access", "hex")
    for r in registry.op10_secret_scans(spark, small).collect():
        base = base_spans(texts[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == sha(joined.encode())
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_on_held_out(spark):
    large = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "lang").collect()}
    rows = registry.op8_language_id(spark, large).collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_on_held_out(spark):
    large = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    rows = registry.op4_toxicity(spark, large).drop("sentences").collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert area >= 0.8
    assert sum(s >= 0.5 for s in good) <= 0.05 * len(good)


def test_packing_holds_every_word(spark, small, texts):
    rows = registry.op9_best_fit_packing(spark, small).collect()
    units, bins = {}, {}
    for r in rows:
        units[r.doc_id] = units.get(r.doc_id, 0) + r.n_units
        bins.setdefault(r.bin_id, []).append(r)
    assert units == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.n_units))
        assert sum(r.n_units for r in held) == held[0].bin_used <= 2048
        assert all(a.bin_offset + a.n_units == b.bin_offset for a, b in zip(held, held[1:]))
    assert len(bins) <= 1.3 * sum(units.values()) / 2048 + 8


def test_packing_query_is_plain_best_fit(spark, small, texts):
    """Clusters by all pairs of documents, bins by a search over all bins."""
    from test_corpus_operators import plain_best_fit

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    cluster = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and cluster[a] != cluster[b]:
                low, high = sorted((cluster[a], cluster[b]))
                cluster = {i: low if c == high else c for i, c in cluster.items()}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source").collect()}
    rows = [(i, source[i] or "\0", f"c{cluster[i]}" if words[i] else f"none{i}", len(words[i])) for i in ids]
    bins = {}
    for r in registry.op9_best_fit_packing(spark, small).collect():
        bins.setdefault(r.bin_id, []).append((r.doc_id, r.n_units))
    assert sorted(sorted(b) for b in bins.values()) == plain_best_fit(rows, 2048, 8)
