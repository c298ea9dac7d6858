"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good, votes bad or abstains on a document. How far a rule can be
trusted is estimated by expectation-maximisation over the votes of all documents:
given the class of a document the rules are taken as independent, and the class is
hidden. A document is kept if its posterior probability of being good reaches one
half and no base rule rejects it. So one odd measurement does not drop a document,
and rules that agree with the rest count more.

The votes of all rules form one of a few thousand patterns, so the estimation runs
on counts by pattern, whose number is bounded by 3 to the number of rules. Weak
Beta-like pseudo counts keep it defined for any number of documents, also none.

Null and empty texts have no words, fail the base rule and are not kept. Ties and
repeated rows are judged alike, and a very long text is measured as a whole. Extra columns pass through; measurements travel in
one struct whose name is free. Windows of words are compared by 64-bit hashes within
one text. All work on a text stays in its row, so there is no key to be hot.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import free_name, let, staged, whole_text

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of eight that occurs twice or more in the text."""
    n = F.size(words)
    hashes = F.when(n > WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, lambda e: let(F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda j: (
                F.coalesce(F.get(e, j - 1)["x"] == F.get(e, j)["x"], F.lit(False))
                | F.coalesce(F.get(e, j + 1)["x"] == F.get(e, j)["x"], F.lit(False)))),
            lambda j: F.get(e, j)["i"])), lambda p: F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"),
                lambda n, j: n + F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), F.lit(2**31 - 1)) - F.get(p, j)))))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Add the struct ``into`` with what the rules look at."""
    part = free_name(docs, "parts")
    docs = docs.withColumn(part, whole_text(text))
    bare = F.expr(f"btrim(`{part}`, ' \\t\\n\\u000B\\f\\r')")
    docs = docs.withColumn(part, F.struct(
        F.col(part).alias("text"),
        F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split(part, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
        F.regexp_replace(part, "[^#*$%&|<>]+", "").alias("symbols"),
        F.length(F.regexp_replace(part, "\\P{Lu}+", "")).alias("upper"),
        F.regexp_count(part, F.lit("([^\\p{L}\\p{N}\\s])\\1++")).alias("doubled"),
        F.regexp_count(part, F.lit("(?<![^ \\t-\\r])[\\p{L}\\p{N}]++[.,;:!?]?(?![^ \\t-\\r])")).alias("plain"),
    ))
    get = lambda name: F.col(f"{part}.{name}")
    long = lambda c: c.cast("long")
    return docs.withColumn(into, F.struct(
        long(F.size(get("words"))).alias("n_words"),
        long(F.length(F.array_join(get("words"), ""))).alias("word_chars"),
        long(F.length(get("symbols"))).alias("n_symbols"),
        long(F.size(get("lines")) - F.size(F.array_distinct(get("lines")))).alias("n_dup_lines"),
        F.coalesce(repeated_words(get("words")), F.lit(0).cast("long")).alias("n_repeat_words"),
        long(F.size(get("lines"))).alias("n_lines"),
        long(F.size(F.filter(get("lines"), lambda x: x.rlike("[.!?:;\"'’”)。][ \\t-\\r]*$")))).alias("n_closed_lines"),
        long(get("upper")).alias("n_upper"), long(get("doubled")).alias("n_doubled"),
        long(get("plain")).alias("n_plain_words"),
    )).drop(part)


def base_failed(m: str) -> Column:
    """Too few words, or too many of them in repeated windows."""
    words = F.col(f"{m}.n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * words)


@dataclass(frozen=True)
class Rule:
    """A share (a over b) that is good between two bounds and bad outside two wider ones."""

    name: str
    over: str
    under: str
    good: tuple[float, float]
    passing: tuple[float, float]

    def vote(self, m: str) -> Column:
        """1 good, -1 bad, 0 abstain; a document without what it measures abstains."""
        total = F.lit(1.0) if self.under == "1" else F.expr(self.under.replace("@", f"{m}."))
        share = F.expr(self.over.replace("@", f"{m}.")) / total
        return (F.when(total <= 0, 0).when(share.between(*self.good), 1)
                .when(~share.between(*self.passing), -1).otherwise(0).cast("int"))


RULES: tuple[Rule, ...] = (
    Rule("length", "@n_words", "1", (40, math.inf), (MIN_WORDS, math.inf)),
    Rule("word_length", "@word_chars", "@n_words", (2.5, 11), (1.8, 18)),
    Rule("symbols", "@n_symbols", "@n_words", (0, 0.05), (0, 0.1)),
    Rule("doubled_marks", "@n_doubled", "@n_words", (0, 0.03), (0, 0.1)),
    Rule("plain_words", "@n_plain_words", "@n_words", (0.8, 1), (0.6, 1)),
    Rule("capitals", "@n_upper", "@word_chars", (0, 0.15), (0, 0.4)),
    Rule("closed_lines", "@n_closed_lines", "@n_lines", (0.5, 1), (0.1, 1)),
    Rule("repeated_lines", "@n_dup_lines", "@n_lines", (0, 0.1), (0, 0.3)),
    Rule("repeated_words", "@n_repeat_words", "@n_words", (0, 0.1), (0, 0.2)),
)
#: What a rule is taken to be worth before any document is seen, and how many documents that weighs.
PRIOR_GOOD, PRIOR_WEIGHT = 0.8, 20.0
PRIOR_VOTES = {True: {1: 0.85, 0: 0.12, -1: 0.03}, False: {1: 0.35, 0: 0.25, -1: 0.4}}


@dataclass(frozen=True)
class Model:
    """log odds of good: ``start`` plus, for each rule, the value of its vote."""

    start: float
    votes: tuple[Mapping[int, float], ...]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(self.start)
        for vote, value in zip(votes, self.votes):
            odds = odds + F.when(vote == 1, value[1]).when(vote == -1, value[-1]).otherwise(value[0])
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: Mapping[tuple[int, ...], int], n_rules: int, rounds: int = 200) -> Model:
    """Class share and vote probabilities by expectation-maximisation over pattern counts.

    The classes are named by the prior: in neither does a rule vote against the
    class more often than for it, so good and bad cannot change places.
    """
    prior = PRIOR_VOTES
    share, given = PRIOR_GOOD, [{c: dict(prior[c]) for c in prior} for _ in range(n_rules)]

    def model() -> Model:
        return Model(math.log(share / (1 - share)), tuple(
            {v: math.log(g[True][v] / g[False][v]) for v in (-1, 0, 1)} for g in given))

    for _ in range(rounds):
        now = model()
        good_sum, total = PRIOR_WEIGHT * PRIOR_GOOD, PRIOR_WEIGHT
        counts = [{c: {v: PRIOR_WEIGHT * prior[c][v] for v in (-1, 0, 1)} for c in prior} for _ in range(n_rules)]
        for votes, n in sorted(patterns.items()):
            odds = now.start + sum(value[v] for v, value in zip(votes, now.votes))
            good = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good_sum, total = good_sum + n * good, total + n
            for count, v in zip(counts, votes):
                count[True][v] += n * good
                count[False][v] += n * (1 - good)
        share = min(1 - 1e-6, max(1e-6, good_sum / total))
        for g, count in zip(given, counts):
            for c in g:
                mass = sum(count[c].values())
                g[c] = {v: x / mass for v, x in count[c].items()}
            for v, better in ((1, True), (-1, False)):
                if g[better][v] < g[not better][v]:  # no better than chance on this vote
                    mean = (g[True][v] + g[False][v]) / 2
                    g[True][v] = g[False][v] = mean
            for c in g:
                mass = sum(g[c].values())
                g[c] = {v: x / mass for v, x in g[c].items()}
        if all(abs(a[v] - b[v]) < 1e-9 for a, b in zip(now.votes, model().votes) for v in a):
            break
    return model()


def fit(measures: DataFrame, m: str, rules: tuple[Rule, ...] = RULES) -> Model:
    """Estimate the rules over all documents; only counts by pattern reach the driver."""
    votes = [r.vote(m).alias(f"v{i}") for i, r in enumerate(rules)]
    counts = measures.select(*votes).groupBy(*[f"v{i}" for i in range(len(rules))]).count()
    return estimate({tuple(r[:-1]): r["count"] for r in counts.collect()}, len(rules))


def judged(measures: DataFrame, m: str, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Extend the struct ``m`` by base_failed, posterior and kept."""
    model = fit(measures, m, rules)
    posterior = model.posterior([r.vote(m) for r in rules])
    failed = base_failed(m)
    return measures.withColumn(m, F.struct(
        f"{m}.*", failed.alias("base_failed"), posterior.alias("posterior"),
        (~failed & (posterior >= threshold)).alias("kept")))


def judge_documents(docs: DataFrame, text: str = "text", into: str = "quality",
                    carry: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the struct ``into``: measurements, base_failed, posterior and kept.

    ``carry`` names the columns to return beside it; all by default. The measured
    rows are written once, since both the estimation and the verdict read them.
    """
    rows = measured(docs, text, into)
    if carry is not None:
        rows = rows.select(*carry, into)
    return judged(staged(rows, "quality-rules"), into, rules)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    into = free_name(docs, "quality")
    return judge_documents(docs, text, into).filter(f"`{into}`.kept").select(*docs.columns)
