"""Full-text search: postings, predicates, ranking, facets, suggestions and related documents.

A query is a Search, a plain description built by the caller; there is no text syntax. It becomes one
plan: token predicates are semi and anti joins on the postings table, the other filters are columns, and
only the page is joined with its texts.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skerry.functions.arrow import pieces
from skerry.functions.text import answered_trackers, brief, magnet, padded, resolve_category, tokens
from skerry.operators.health import health_state
from skerry.operators.postings import file_postings, file_postings_of, merged_postings, postings, with_phrase, with_token, word_postings_of  # noqa: F401


@dataclass
class Group:
    """Words and phrases that must all match; scope None is name or files."""

    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    not_words: list[str] = field(default_factory=list)
    not_phrases: list[str] = field(default_factory=list)
    scope: str | None = None
    prefix: str | None = None


@dataclass
class Search:
    """Groups are alternatives. ranges are closed intervals of columns; an empty Search fits all.

    Categories are names as they stand in the column; categories_of() finds those that a user's words mean.
    """

    groups: list[Group] = field(default_factory=list)
    categories: list[str] | None = None
    not_categories: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)
    states: list[str] | None = None
    key_prefix: str | None = None


def matching(docs: DataFrame, index: DataFrame, group: Group) -> DataFrame:
    """doc_ids of the group: semi joins with the index for its words and phrases, anti joins for exclusions. No text is read.

    Single letters aren't in the index: a phrase with one matches nothing, and excludes nothing.
    """
    found = docs
    for word in dict.fromkeys(group.words):
        found = found.join(with_token(index, word, group.scope), "doc_id", "left_semi")
    if group.prefix:
        found = found.join(with_token(index, group.prefix, group.scope, prefix=len(group.prefix) >= 3), "doc_id", "left_semi")
    for word in group.not_words:
        found = found.join(with_token(index, word, group.scope), "doc_id", "left_anti")
    for phrase in group.phrases:
        found = found.join(with_phrase(index, phrase, group.scope), "doc_id", "left_semi")
    for phrase in group.not_phrases:
        found = found.join(with_phrase(index, phrase, group.scope), "doc_id", "left_anti")
    return found.select("doc_id")


def filters(search: Search, now: int) -> Column:
    """Live, visible documents within the ranges, categories, states and key."""
    keep = ~F.col("deleted") & ~F.col("hidden")
    if search.categories is not None:
        keep &= F.col("category").isin(search.categories)
    if search.not_categories:
        keep &= ~F.col("category").isin(search.not_categories)
    for column, (low, high) in search.ranges.items():
        value = F.lit(now) - F.col("indexed_at") if column == "age" else F.col(column)
        keep &= F.lit(True) if low is None else value >= low
        keep &= F.lit(True) if high is None else value <= high
    if search.states is not None:
        keep &= health_state().isin(search.states)
    if search.key_prefix:
        keep &= F.col("ih").startswith(search.key_prefix)
    return keep


def categories_of(asked: DataFrame, column: str = "value") -> DataFrame:
    """(value, category) of the names that a user asks for categories by; null where there is no such category."""
    return asked.select(F.col(column).alias("value"), resolve_category(F.col(column)).alias("category"))


def marked_terms(words: Column, phrases: Column, prefix: Column) -> Column:
    """terms_of() of searches that stand in columns: arrays of words and of phrases, and the start of a word or null."""
    inside = F.flatten(F.transform(phrases, tokens))
    return F.array_distinct(F.array_compact(F.concat(words, inside, F.array(prefix))))


def terms_of(search: Search) -> list[str]:
    """The words to mark in results: all that must match, those of phrases too, each once, in the order asked."""
    found = []
    for group in search.groups:
        found += [*group.words, *([group.prefix] if group.prefix else []), *(w for phrase in group.phrases for w in re.findall("[a-z0-9]+", phrase))]
    return list(dict.fromkeys(found))


#: Labels of sizes with the least and the greatest size in bytes; 0 stands for no bound.
SIZE_RANGES = {"< 1 MB": (0, 2**20 - 1), "1–100 MB": (2**20, 100 * 2**20 - 1), "100 MB–1 GB": (100 * 2**20, 2**30 - 1), "1–10 GB": (2**30, 10 * 2**30 - 1), "10–50 GB": (10 * 2**30, 50 * 2**30 - 1), "> 50 GB": (50 * 2**30, 0)}


def size_range(label: str) -> tuple[int | None, int | None]:
    """Range of a size facet, as Search takes it."""
    low, high = SIZE_RANGES[label]
    return low or None, high or None


def run(docs: DataFrame, index: DataFrame, search: Search, now: int) -> DataFrame:
    """The documents that a search finds. With a key prefix, words are not asked."""
    base = docs.filter(filters(search, now))
    if search.key_prefix or not search.groups:
        return base
    ids = reduce(DataFrame.unionByName, (matching(base, index, g) for g in search.groups))
    return base.join(ids.distinct() if len(search.groups) > 1 else ids, "doc_id", "left_semi")


def frequencies(index: DataFrame) -> DataFrame:
    """(field, token, df) over all documents."""
    return index.groupBy("field", "token").agg(F.count("*").alias("df"))


def idf_of(index: DataFrame, words: list[str], n_live: int) -> dict[str, float]:
    """ln(1 + N / (1 + max(df_name, df_files))) of a query's words."""
    rows = frequencies(index.filter(F.col("token").isin(words))).groupBy("token").agg(F.max("df").alias("df")).collect()
    df = {r.token: r.df for r in rows}
    return {w: math.log(1 + max(n_live, 1) / (1 + df.get(w, 0))) for w in words}


def starts_with(word: str):
    return lambda t: t.startswith(word)


def relevance(words: list[str], idf: dict[str, float], phrases: list[str] = (), whole: bool = True) -> Column:
    """Score of a document by its name, in Catalyst: exact words 3, word starts 2, else 1 of the idf; shares of words; phrases; equality; seeders."""
    name = tokens(F.col("name"))
    size = F.greatest(F.size(name), F.lit(1))
    total, inside = F.lit(0.0), F.lit(0)
    for w in words:
        exact = F.array_contains(name, w)
        starts = F.exists(name, starts_with(w)) if len(w) >= 3 else F.lit(False)
        total += F.when(exact, 3.0).when(starts, 2.0).otherwise(1.0) * idf[w]
        inside += F.when(exact | starts, 1).otherwise(0)
    n = len(words)
    total += 2.0 * n / size + 1.5 * inside / max(n, 1)
    if phrases:
        total += F.when(reduce(lambda a, b: a | b, (F.contains(padded(F.col("name")), padded(F.lit(p))) for p in phrases)), 3.0).otherwise(0.0)
    if whole:
        total += F.when(F.array_join(name, " ") == " ".join(words), 6.0).otherwise(0.0)
    return total + F.when(F.col("src") == "scrape", 0.6 * F.log10(1.0 + F.col("seeders"))).otherwise(0.0)


#: Sort orders by name; every order ends with the id.
SORTS = {"seeders": ["seeders", "peers"], "peers": ["peers", "seeders"], "size": ["size"], "files": ["file_count"], "date": ["indexed_at"], "created": ["created"]}


def page(found: DataFrame, sort: str = "seeders", page: int = 1, per_page: int = 20, ascending: bool = False) -> DataFrame:
    """One page: top-k by the order, unknown orders are by seeders; 5 to 100 rows."""
    per_page = min(100, max(5, per_page))
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in SORTS.get(sort, SORTS["seeders"])]
    return found.orderBy(*keys, "doc_id").offset((max(1, page) - 1) * per_page).limit(per_page)


def page_count(total: Column, per_page: int = 20) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / min(100, max(5, per_page))))


def result_items(page: DataFrame, terms: list[str], name_only: bool = False) -> DataFrame:
    """What a list of results shows of the rows of a page. page: hot columns joined with the records of its rows.

    Names come in stretches with their hits marked. Where a word doesn't start a word of the name, the files that
    have most of the words come along; without words, the first three files.
    """
    words = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    name = tokens(F.col("name"))
    by_name = reduce(lambda a, b: a & b, (F.exists(name, starts_with(t)) for t in terms), F.lit(True))
    none = F.lit(None).cast("array<string>")
    return page.select(
        "doc_id", "ih", "name", highlight("name", words).alias("stretches"), "size", "file_count", "seeders", "peers",
        F.col("src").eqNullSafe("scrape").alias("verified"), "health_at", health_state().alias("state"), "checked_at", "seed_ok_at",
        brief(F.col("detail")).alias("detail"), "category", F.slice("exts", 1, 5).alias("exts"), "indexed_at", "created",
        magnet(F.col("ih"), F.col("name"), answered_trackers(F.coalesce(F.col("detail.tr"), F.array()), F.col("trackers"))).alias("magnet"),
        F.when(by_name | F.lit(not terms or name_only), none).otherwise(best_files(F.col("files"), terms)).alias("matched_files"),
        F.when(F.lit(not terms), F.slice(F.transform("files", lambda f: f.path), 1, 3)).alias("top_files"),
    )


def facets(found: DataFrame, categories_of: DataFrame, bucket: Column, labels: list[str], states: list[str]) -> DataFrame:
    """(facet, label, n): categories without the category filter; sizes and states with their zeros. One pass for sizes and states."""
    cat = categories_of.groupBy(F.col("category").alias("label")).agg(F.count("*").alias("n")).select(F.lit("category").alias("facet"), "label", "n")
    counted = [F.count_if(bucket == x).alias(f"size:{x}") for x in labels] + [F.count_if(health_state() == s).alias(f"state:{s}") for s in states]
    wide = found.agg(*counted)
    long = wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, wide.columns)), F.array(*(F.col(f"`{c}`") for c in wide.columns)))).alias("k", "n"))
    return cat.unionByName(long.select(F.substring_index("k", ":", 1).alias("facet"), F.substring_index("k", ":", -1).alias("label"), "n"))


def suggest(index: DataFrame, visible: DataFrame, start: str, n: int = 8) -> DataFrame:
    """Name words that start so, by how many visible documents have them."""
    hit = index.filter((F.col("field") == "n") & F.col("token").startswith(start))
    return hit.join(visible.select("doc_id"), "doc_id", "left_semi").groupBy("token").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "token").limit(n)


def related(index: DataFrame, visible: DataFrame, doc_id: int, n_docs: int, n: int = 8, most: int = 8) -> DataFrame:
    """(doc_id, score): documents that share the rare words of one document's name."""
    names = index.filter((F.col("field") == "n") & (~F.col("token").rlike("^[0-9]+$") | (F.char_length("token") == 4)))
    own = names.filter(F.col("doc_id") == doc_id).select("token")
    df = names.join(F.broadcast(own), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))  # own: words of one name
    idf = df.filter(F.col("df").between(2, max(50, n_docs // 20))).withColumn("w", F.log(1 + F.lit(float(n_docs)) / F.col("df"))).orderBy(F.col("w").desc(), "token").limit(most)
    hit = names.join(F.broadcast(idf.select("token", "w")), "token").filter(F.col("doc_id") != doc_id)  # most rows
    scored = hit.groupBy("doc_id").agg(F.round(F.sum("w"), 2).alias("score"))
    return scored.join(visible, "doc_id").orderBy(F.col("score").desc(), F.col("seeders").desc(), "doc_id").limit(n).select("doc_id", "score")


#: Letters and digits, each a place of a term's signature.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def term_dictionary(index: DataFrame) -> DataFrame:
    """Terms of the index as a table of their own: (token, first, size, letters, df, df_name), sorted when written by first letter and length.

    letters counts each letter and digit of the term; df is how many documents have it in any field, df_name in the name (0: none).
    """
    both = index.groupBy("token", "doc_id").agg(F.bool_or(F.col("field") == "n").alias("in_name")).groupBy("token")
    rows = both.agg(F.count("*").alias("df"), F.count_if("in_name").alias("df_name"))
    letters = F.array(*(F.char_length("token") - F.char_length(F.replace("token", F.lit(c), F.lit(""))) for c in ALPHABET))
    return rows.select("token", F.left("token", F.lit(1)).alias("first"), F.char_length("token").alias("size"), letters.cast("array<tinyint>").alias("letters"), "df", "df_name")


def did_you_mean(index: DataFrame, visible: DataFrame, words: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """(word, suggestion) for each word of four letters or more that starts no word of any document.

    Of the name words of like first letter and length the three closest are taken; of those that a visible
    document has, the most frequent one is suggested. dictionary: term_dictionary() of the index, if it is stored.

    Terms come from the dictionary: of like first letter, at most two letters longer or shorter, and with so many letters in
    common, whatever their order, as a ratio of 0.75 needs. Only for these is the ratio computed, and postings are read
    only of the few closest.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)])

    asked = [w for w in dict.fromkeys(words) if len(w) >= 4 and not w.isdigit()]
    spark, terms = index.sparkSession, term_dictionary(index) if dictionary is None else dictionary
    rows = [(w, w[0], len(w), [w.count(c) for c in ALPHABET]) for w in asked]
    wanted = spark.createDataFrame(rows, "word string, initial string, n int, own array<int>")  # the query's words
    started = reduce(lambda a, b: a | b, (F.col("token").startswith(w) for w in asked), F.lit(False))
    known = terms.filter(started & F.col("first").isin([w[0] for w in asked])).select("token").join(F.broadcast(wanted), F.col("token").startswith(F.col("word"))).select("word").distinct()
    like = terms.filter((F.col("df_name") > 0) & F.col("first").isin([w[0] for w in asked])).join(F.broadcast(wanted), F.col("first") == F.col("initial"))
    shared = F.aggregate(F.zip_with("letters", "own", lambda a, b: F.least(a, b)), F.lit(0), lambda n, x: n + x)
    like = like.filter((F.abs(F.col("size") - F.col("n")) <= 2) & (2 * shared >= 0.75 * (F.col("size") + F.col("n"))))
    close = like.join(known, "word", "left_anti").select("word", "token", F.col("df_name").alias("df")).withColumn("r", ratio("word", "token")).filter("r >= 0.75")
    order = Window.partitionBy("word").orderBy(F.col("r").desc(), F.col("token").desc())
    three = close.withColumn("k", F.row_number().over(order)).filter("k <= 3")
    names = index.filter(F.col("field") == "n")
    seen = names.join(F.broadcast(three.select("token").distinct()), "token", "left_semi").join(visible.select("doc_id"), "doc_id", "left_semi").select("token").distinct()  # three for each word
    return three.join(seen, "token", "left_semi").groupBy("word").agg(F.max_by("token", F.struct("df", "r", "token")).alias("suggestion"))


def folded(text: str) -> tuple[str, list[int]]:
    """text in lower case without marks, and which character of it each one comes from."""
    pairs = [(c, i) for i, x in enumerate(text) for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c)]
    return "".join(c for c, _ in pairs), [i for _, i in pairs]


STRETCHES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("hit", T.BooleanType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


_STRETCHES = pa.list_(pa.struct([("text", pa.string()), ("hit", pa.bool_())]))


@F.arrow_udf(STRETCHES)
def highlight(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Each text in stretches, those that match a word marked. Words of three letters or more mark the whole word they start."""
    patterns: dict[str, re.Pattern] = {}

    def of(word: str) -> re.Pattern:
        if word not in patterns:
            patterns[word] = re.compile("(?<![a-z0-9])" + re.escape(word) + (r"[^\W_]*" if len(word) >= 3 else "(?![a-z0-9])"))
        return patterns[word]

    def stretches(text: str | None, asked: list[str]) -> list[dict]:
        if not text:
            return []
        low, origin = folded(text)
        at, out = 0, []
        for a, b in sorted((origin[m.start()], origin[m.end() - 1] + 1) for w in asked for m in of(w).finditer(low)):
            if b <= at:
                continue
            if out and a <= at and out[-1]["hit"]:
                out[-1]["text"] += text[at:b]
            else:
                out += [{"text": text[at:a], "hit": False}] * (a > at) + [{"text": text[max(a, at) : b], "hit": True}]
            at = b
        return out + [{"text": text[at:], "hit": False}] * (at < len(text))

    both = pa.RecordBatch.from_arrays([texts, words], names=["text", "words"])
    found = ([stretches(t, w) for t, w in zip(*(c.to_pylist() for c in p.columns))] for p in pieces(both))
    return pa.concat_arrays([pa.array([], _STRETCHES), *(pa.array(f, _STRETCHES) for f in found)])


def spans_of(text: Column, term: str, mode: str, most: int = 20) -> Column:
    """Where a rule's term stands in the original text: the first spans [start, stop), in characters."""
    if mode == "word":
        wanted = re.compile("(?<![a-z0-9])" + "[^a-z0-9]+".join(map(re.escape, re.findall("[a-z0-9]+", folded(term)[0]))) + "(?![a-z0-9])")
    elif mode == "substring":
        wanted = re.compile("(?=(" + re.escape(folded(term)[0].strip()) + "))")  # from every place on
    else:
        wanted = re.compile(term, re.IGNORECASE)

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        def spans(text: str | None) -> list[dict]:
            raw, origin = (text or "", None) if mode == "regex" else folded(text or "")
            out = []
            for m in wanted.finditer(raw):
                a, b = m.span(1) if mode == "substring" else m.span()
                if b > a and len(out) < most:
                    out.append({"start": a, "stop": b} if origin is None else {"start": origin[a], "stop": origin[b - 1] + 1})
            return out

        return texts.map(spans)

    return find(text)


def best_files(files: Column, words: list[str], most: int = 3, among: int = 500) -> Column:
    """Paths of the files with a word that starts with most of the words, of the first `among`; ties by length and path."""
    count = lambda f: sum((F.when(F.contains(padded(f.path), F.lit(f" {w}")), 1).otherwise(0) for w in words), F.lit(0))
    scored = F.transform(F.slice(files, 1, among), lambda f: F.struct((-count(f)).alias("hits"), F.char_length(f.path).alias("n"), f.path.alias("path")))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x.hits < 0)), 1, most), lambda x: x.path)


def matched_files(items: DataFrame, words: list[str], most: int = 3, among: int = 500) -> DataFrame:
    """(doc_id, file): the best files of each document, as best_files() ranks them."""
    return items.select("doc_id", F.explode(best_files(F.col("files"), words, most, among)).alias("file"))
