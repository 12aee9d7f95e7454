"""Moderation: rules by word, substring or pattern; classifier scores; who wins."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.rulematch import hit_counts, rule_hits  # noqa: F401


#: Most rules, longest term, longest note.
MOST_RULES, LONGEST_TERM, LONGEST_NOTE = 500, 200, 200
#: Syntax that Python's patterns have and Java's, which rules run on, haven't, or read in another way.
NOT_SHARED = re.compile(r"\(\?P[<=>]|\(\?\(|\(\?#|\\[AZ]|\[[^\]]*(?:\[|&&)")
#: A repeated group with a repetition inside, which may backtrack without end.
RUNAWAY = re.compile(r"\((?:[^()\\]|\\.)*[*+}](?:[^()\\]|\\.)*\)(?:[*+]|\{\d+,)")


def check_rule(term: str, scope: str, mode: str) -> str | None:
    """What is wrong with a rule, or None. Patterns must read alike in Python and Java, and have no nested repetition."""
    if not term.strip() or len(term) > LONGEST_TERM:
        return "the term must have 1 to 200 characters"
    if scope not in ("all", "name", "files") or mode not in ("word", "substring", "regex"):
        return "unknown scope or mode"
    if mode == "word" and not re.search("[a-z0-9]", term.lower()):
        return "a word rule needs letters or digits"
    if mode == "regex":
        if NOT_SHARED.search(term):
            return "the pattern uses syntax that differs between engines"
        if RUNAWAY.search(term):
            return "the pattern repeats a group that repeats inside, and could run without end"
        try:
            if re.compile(term, re.IGNORECASE).search(""):
                return "the pattern matches everything"
        except re.error as e:
            return f"not a pattern: {e}"
    return None


@dataclass(frozen=True)
class Rule:
    id: str
    term: str
    scope: str = "all"
    mode: str = "word"
    enabled: bool = True
    created: int = 0
    note: str = ""


def add_rule(rules: list[Rule], rule: Rule) -> tuple[list[Rule], str | None]:
    """The rules with one more, or as they were and what is wrong with it."""
    problem = check_rule(rule.term, rule.scope, rule.mode)
    if not problem and len(rules) >= MOST_RULES:
        problem = f"at most {MOST_RULES} rules"
    if not problem and any((r.term, r.scope, r.mode) == (rule.term.strip(), rule.scope, rule.mode) for r in rules):
        problem = "there is such a rule already"
    return (rules, problem) if problem else ([*rules, replace(rule, term=rule.term.strip(), note=rule.note[:LONGEST_NOTE])], None)


def update_rule(rules: list[Rule], rule_id: str, enabled: bool | None = None, note: str | None = None) -> list[Rule]:
    """The rules, one of them switched on or off or with another note."""
    change = {k: v for k, v in (("enabled", enabled), ("note", None if note is None else note[:LONGEST_NOTE])) if v is not None}
    return [replace(r, **change) if r.id == rule_id else r for r in rules]


def delete_rule(rules: list[Rule], rule_id: str) -> list[Rule]:
    return [r for r in rules if r.id != rule_id]


def active(rules: list[Rule]) -> list[tuple[str, str, str, str]]:
    """Rules that are on, as rule_hits() takes them."""
    return [(r.id, r.term, r.scope, r.mode) for r in rules if r.enabled]


def merge_rules(here: DataFrame, there: DataFrame) -> DataFrame:
    """The rules (id, term, scope, mode) of another catalogue that are not here yet, by term, scope and mode; each once.

    An id that is taken, or missing, is replaced by a digest of the rule, which no other rule has.
    """
    keys = ["term", "scope", "mode"]
    fresh = there.groupBy(*keys).agg(F.min("id").alias("id")).join(here.select(*keys), keys, "left_anti")
    taken = here.select(F.col("id").alias("__taken")).distinct()
    twice = fresh.groupBy("id").agg(F.min(F.struct(*keys)).alias("__first"))  # of new rules with one id the first keeps it
    joined = fresh.join(twice, "id", "left").join(taken, F.col("id") == F.col("__taken"), "left")
    clash = F.col("id").isNull() | F.col("__taken").isNotNull() | (F.struct(*keys) != F.col("__first"))
    return joined.select(F.when(clash, F.left(F.sha1(F.concat_ws("\0", *keys).cast("binary")), F.lit(10))).otherwise(F.col("id")).alias("id"), *keys)


def policy(threshold: int, mask: int) -> Column:
    """Hidden by score: an override to hide, or done with a score and category of the policy; an override to allow wins."""
    by_score = F.col("done") & (F.col("score") >= threshold) & (F.col("cats").bitwiseAND(mask) != 0)
    return ~F.col("deleted") & (F.coalesce(F.col("override"), F.lit("")) != "allow") & ((F.coalesce(F.col("override"), F.lit("")) == "hide") | by_score)


def state(threshold: int, mask: int) -> Column:
    return F.when(F.col("override") == "allow", "allowed").when(F.col("override") == "hide", "manual").when(policy(threshold, mask), "hidden").otherwise("visible")


def override(scores: DataFrame, actions: DataFrame) -> DataFrame:
    """scores after the moderators' actions (doc_id, seq, action), the later ones last.

    allow and hide set the override, reset takes it away, reanalyse forgets score and categories but keeps the override.
    """
    decision = F.col("action").isin("allow", "hide", "reset")
    last = actions.groupBy(F.col("doc_id").alias("__id")).agg(F.max_by("action", F.when(decision, F.col("seq"))).alias("__last"), F.bool_or(F.col("action") == "reanalyse").alias("__again"))
    joined = scores.join(last, F.col("doc_id") == F.col("__id"), "left")
    again = F.coalesce("__again", F.lit(False))
    changed = {"override": F.when(F.col("__last").isNull(), F.col("override")).when(F.col("__last") != "reset", F.col("__last")), "done": F.col("done") & ~again}
    changed |= {c: F.when(~again, F.col(c)) for c in ("score", "cats")}
    return joined.withColumns(changed).drop("__id", "__last", "__again")


def pending(scores: DataFrame, most: int, least_id: int = 0) -> DataFrame:
    """Live documents without a score, from least_id on, the newest first."""
    return scores.filter(~F.col("done") & ~F.col("deleted") & (F.col("doc_id") >= least_id)).orderBy(F.col("doc_id").desc()).limit(most)


LISTED = {"score": "score", "seeders": "seeders", "date": "indexed_at", "size": "size"}


def listing(scores: DataFrame, threshold: int, mask: int, state_is: str = "hidden", low: int = 0, high: int = 100, category_bit: int | None = None, text: str = "", sort: str = "score") -> DataFrame:
    """Documents with a score or a decision, with their state, in the order of a moderator's list."""
    hidden, decided = policy(threshold, mask), F.col("override").isNotNull()
    chosen = {"hidden": hidden, "allowed": F.col("override").eqNullSafe("allow"), "manual": F.col("override").eqNullSafe("hide"), "visible": ~hidden}
    value = F.coalesce("score", F.lit(0))
    keep = ~F.col("deleted") & (F.col("done") | decided) & chosen.get(state_is, F.lit(True)) & value.between(low, high)
    if category_bit is not None:
        keep &= F.coalesce("cats", F.lit(0)).bitwiseAND(1 << category_bit) != 0
    if text:
        keep &= F.contains(F.lower("name"), F.lit(text.lower())) | F.col("ih").startswith(text.lower())
    order = [F.lower("name")] if sort == "name" else [F.coalesce(F.col(LISTED.get(sort, "score")), F.lit(0)).desc(), F.col("seeders").desc()]
    return scores.filter(keep).withColumn("state", state(threshold, mask)).orderBy(*order, "doc_id")


#: The number of categories that a score's bits stand for.
SCORE_CATEGORIES = 7


def counts(scores: DataFrame, threshold: int, mask: int) -> DataFrame:
    """One row: analysed, pending, hidden, allowed, manual, scores by tens, and hidden documents by category."""
    live, done = ~F.col("deleted"), F.col("done") & ~F.col("deleted")
    hidden = policy(threshold, mask)
    bins = [F.count_if(done & (F.least(F.floor(F.col("score") / 10), F.lit(9)) == k)).alias(f"bin{k}") for k in range(10)]
    cats = [F.count_if(hidden & (F.coalesce("cats", F.lit(0)).bitwiseAND(1 << k) != 0)).alias(f"cat{k}") for k in range(SCORE_CATEGORIES)]
    return scores.agg(
        F.count_if(done).alias("analysed"), F.count_if(live & ~F.col("done")).alias("pending"), F.count_if(hidden).alias("hidden"),
        F.count_if(live & F.col("override").eqNullSafe("allow")).alias("allowed"), F.count_if(live & F.col("override").eqNullSafe("hide")).alias("manual"), *bins, *cats,
    )
