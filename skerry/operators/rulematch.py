"""Many rules in one pass: an Aho-Corasick automaton of all words and substrings, run over Arrow batches.

A field is searched as its tokens with a space on either side, a zero byte, and its folded text. Word rules are needles with a space
on either side, substring rules are folded needles that must end behind the zero byte. One walk over that text finds
the needles of all rules; what it costs depends on the text and its hits, hardly on how many rules there are. Patterns are
tried on texts only if one pattern of them all fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.arrow import pieces
from skerry.functions.text import norm, plain

SCOPES = {"name": ("name",), "files": ("files",), "all": ("name", "files")}
HITS = "doc_id long, rule_id string"

Rules = tuple[tuple[str, str, str, str], ...]
_built: dict[Rules, "Matcher"] = {}


class Matcher:
    """Rules (id, term, scope, mode) that are asked of a document's fields at once."""

    def __init__(self, rules: Rules):
        import ahocorasick

        needles: dict[str, list[tuple[int, bool]]] = {}
        self.rules, self.patterns, self.always = rules, [], []
        for k, (_, term, _, mode) in enumerate(rules):
            if mode == "regex":
                self.patterns.append((k, re.compile(term, re.IGNORECASE)))
                continue
            needle = f" {' '.join(re.findall('[a-z0-9]+', plain(term)))} " if mode == "word" else plain(term).strip()
            if needle:
                needles.setdefault(needle, []).append((k, mode == "word"))
            else:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for needle, owners in needles.items():
            self.automaton.add_word(needle, (owners, len(needle)))
        if needles:
            self.automaton.make_automaton()
        self.any_needle = bool(needles)
        alone = [p.pattern for _, p in self.patterns if not re.search(r"\\[1-9]", p.pattern)]
        self.any_pattern = re.compile("|".join(f"(?:{p})" for p in alone), re.IGNORECASE) if alone and len(alone) == len(self.patterns) else None
        self.of_field = {f: frozenset(k for k, (_, _, scope, _) in enumerate(rules) if f in SCOPES[scope]) for f in ("name", "files")}

    @classmethod
    def of(cls, rules: Rules) -> "Matcher":
        """One for each worker process and set of rules."""
        if rules not in _built:
            if len(_built) > 8:
                _built.clear()
            _built[rules] = cls(rules)
        return _built[rules]

    def hits(self, text: str, folded: str) -> set[int]:
        """Numbers of the rules that fit a text."""
        found = set(self.always)
        if self.any_needle:
            tokens = f" {_OTHER.sub(' ', folded).strip()} "
            for end, (owners, size) in self.automaton.iter(f"{tokens}\0{folded}"):
                for k, is_word in owners:
                    if is_word or end - size >= len(tokens):
                        found.add(k)
        if self.patterns and (self.any_pattern is None or self.any_pattern.search(text) or self.any_pattern.search(folded)):
            found.update(k for k, p in self.patterns if p.search(text) or p.search(folded))
        return found

    def of_document(self, fields: dict[str, tuple[str, str]]) -> list[str]:
        found = {k for f, (text, folded) in fields.items() for k in self.hits(text, folded) if k in self.of_field[f]}
        return sorted({self.rules[k][0] for k in found})


_OTHER = re.compile("[^a-z0-9]+")


def rule_hits(docs: DataFrame, rules: list[tuple[str, str, str, str]], id_col: str = "doc_id", name: str = "name", files: str = "body") -> DataFrame:
    """(doc_id, rule_id) for each document that a rule (id, term, scope, mode) hits, once for each rule id.

    Documents are read once, whatever the number of rules, which a moderator's list bounds; fields that no rule asks aren't read.
    A null field fits no rule. Folding is done by Spark; the automaton is built once in each worker.
    """
    fixed: Rules = tuple(tuple(r) for r in rules)
    if not fixed:
        return docs.sparkSession.createDataFrame([], HITS)
    asked = [(f, c) for f, c in (("name", name), ("files", files)) if any(f in SCOPES[r[2]] for r in fixed)]
    raw = any(r[3] == "regex" for r in fixed)
    columns = [F.col(id_col).cast("long").alias("doc_id")]
    for f, c in asked:
        columns += [F.col(c).alias(f) if raw else F.col(c).isNotNull().cast("string").alias(f), norm(F.col(c)).alias(f"{f}_folded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.of(fixed)
        for batch in (piece for whole in batches for piece in pieces(whole)):
            ids, hit = [], []
            for i, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                fields = {f: (texts[2 * k], texts[2 * k + 1]) for k, (f, _) in enumerate(asked) if texts[2 * k + 1] is not None}
                found = matcher.of_document(fields)
                ids += [i] * len(found)
                hit += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hit, pa.string())], names=["doc_id", "rule_id"])

    return docs.select(*columns).mapInArrow(run, HITS)


def hit_counts(docs: DataFrame, rules: list[tuple[str, str, str, str]], **columns: str) -> DataFrame:
    """(rule_id, n): how many documents each rule hits, with 0 for those that hit none."""
    every = docs.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(r[0] for r in rules)], "rule_id string")  # as many as there are rules
    counts = rule_hits(docs, rules, **columns).groupBy("rule_id").agg(F.count("*").alias("n"))
    return every.join(counts, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))
