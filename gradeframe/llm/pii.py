"""Personal data by candidate gradient boosting, in DataFrame functions only.

Strict patterns give the base spans. Beside them, generators of high recall propose
overlapping candidates: written-out or spaced addresses, dotted quads and groups of
hexadecimal digits, long and short digit groups. Boosted trees judge a candidate by its
format (digits, groups, separators) and its context (what stands around it, words such
as "call" or "card" before it). Positives are base spans of the corpus, in their context
but rewritten without the mark that makes them base spans (the plus of a phone number,
the at sign, a card's usual separators), and written examples of such forms. Negatives
are candidates that cannot be of their kind (a failed checksum, an octet over 255, a
date, a version, an address without a dotted domain) and written examples; numbers with a
failed checksum also in the forms that cards are rewritten to. All other
candidates, frequent or not, have no label: they are what is to be judged, so they
count neither for nor against. A threshold for each kind is calibrated on all documents
that were not fitted on, and the written examples: the lowest score from which on the
wanted precision holds. Candidates that reach it and do not overlap a base span of their
kind are added; base spans always stay.

Fitting sees counts by feature row, whose number the number of training documents
bounds; calibration counts by rounded score, of which there are ``SCORE_LEVELS``. The
trees become one CASE expression each, so scoring stays in generated code.
Texts are searched once: base spans and candidates are written to the shared folder, and
fitting, calibration and scoring read them there. Every step works within the row: no
shuffle of texts or spans, and no key to be hot.

Patterns are written so that a text is read in linear time, with possessive repeats and
starts only where a run begins; positions are code points. Null and empty texts have no
spans. Repeated rows get equal results, empty tables give empty results and a model
that adds nothing, and extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm import boosting
from gradeframe.llm.common import free_name, let, staged, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, as fixed by the contract; possessive and anchored at the start of a run.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates; more than the base on purpose.
AT, DOT = r"(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20(?=[A-Za-z0-9-]+\x20dot\x20))", \
    r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
DOMAIN = rf"(?i){AT}[A-Za-z0-9-]++{DOT}"
DATE = (r"(?<![0-9])(?:19|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./]|"
        r"(?<![0-9])[0-3]?[0-9][./](?:0?[1-9]|1[0-2])[./](?:19|20)[0-9]{2}")
CANDIDATES = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?i:{AT})[A-Za-z0-9-]++(?i:{DOT}[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3,5}+(?![0-9])|[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){3,7}+)",
    "card": r"(?<![0-9])[0-9]{2,}+(?:[\x20./-]{0,2}+[0-9]{2,}+)*+",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|\(|00)?+[0-9](?:[\x20().\x2F-]{0,2}+[0-9]){6,}+",
}
CUES = {"email": "mail|contact|write|@", "ip": "ip|host|server|addr|login", "card": "card|visa|pay|credit|konto|iban",
        "phone": "tel|call|phone|fax|mobil|t.l.f"}
TRAIN_DOCS, PRECISION, N_TREES, DEPTH = 10_000, 0.95, 16, 3
#: Written examples, personal or not, for forms that the strict patterns do not show. Each
#: counts as much as SEED_WEIGHT candidates of the corpus, and those of one label together
#: at least as much as SEED_SHARE of the labelled candidates.
SEED_WEIGHT, SEED_SHARE, LEAST_SCORE = 10.0, 0.1, 0.5
SCORE_LEVELS = 10_000
SEEDS = {
    ("email", True): (
        "write to anna.berg (at) example (dot) com today", "jo_9 [at] mail7.example.com, or", "contact max{at}mail{dot}net now",
        "bob.k at mail dot example dot org if", "mail kim+a @example.com", "send to lee@mail.example.org."),
    ("email", False): (
        "look at the dot on", "meet @home and", "x@y is", "rate a@b of", "user@host said", "npm i pkg@1", "see fig@left of", "5@3 each",
        "q@r and", "me@work all", "v@2 of", "if (at) least"),
    ("ip", True): ("host fe80:0:0:0:1:22:333:4444 is", "from 2001:db8:0:1:1:1:1:1 to", "server 10.0.0.17:80 up", "login from 192.168.7.12, then"),
    ("ip", False): (
        "version 1.2.3.4.5 of", "build 300.1.2.3 has", "sect. 4.10.2.1.7 says", "at 12:30:45:11 it", "on 1.2.2020.4.5 we", "ratio 1:2:3:4 mixes",
        "item 2019.10.11.999 was", "key ab:cd:ef:01 is", "256.300.400.500 is", "v 2.0.1.1000 out"),
    ("card", True): (
        "card 4111.1111.1111.1111 exp", "pay with 4000/0566/5566/5556 or", "visa 5555  5555  5555  4444 on", "credit 3782-822463-10005 ok"),
    ("card", False): (
        "in 1999 and", "isbn 978-3-16-148410-0 is", "on 2020-10-11 12", "about 12 000 000 men", "order 20241130 0001", "token 1234567890123456 was",
        "id 9007199254740993 of", "from 10.20.30.40 to", "sum 1000000000000000 is", "lot 55 66 77 88 99"),
    ("phone", True): (
        "call (803) 555-5351 now", "tel 803-555-5351 or", "phone 030 1234567 and", "fax 0049 30 1234567 is", "mobile (0170) 1234567,",
        "call 1-803-555-5351 x", "reach me on 803.555.5351 at"),
    ("phone", False): (
        "on 2020-10-11 it", "on 2021-03-04 12 h", "of 24.12.2023 18 was", "on 01/02/1999 by", "pages 1200-1300 of", "about 12 000 000 men", "isbn 978-3-16-148410-0 is", "in 1914-1918 and", "id 98765432 of",
        "from 10.20.30.40 to", "at 1234567890123456 of", "sum 1.000.000 is", "lot 55 66 77 88 99 11 22 33"),
}
FEATURES = ("digits", "length", "groups", "longest", "shortest", "dots", "dashes", "spaces", "brackets", "marks",
            "letters", "strict", "before", "after", "cue", "wide", "dated")


def worth_searching(text: Column, numeric: Column) -> dict[str, tuple[Column, Column]]:
    """For each kind, whether valid base spans and candidates can occur: tests that each of them passes.

    ``numeric`` says whether the text has a digit. Patterns decode the whole text, ``contains``
    does not and comes first; the patterns begin with a rare character and pass over the rest.
    """
    at = text.contains("@")
    bracket = text.contains("(") | text.contains("[") | text.contains("{")
    return {
        "email": (at, at | (bracket & text.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]")) | text.rlike(r"(?i)\x20dot\x20")),
        "ip": (numeric & text.rlike(r"\.[0-9]++\.[0-9]++\.[0-9]"),
               (numeric & text.rlike(r"\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"))
               | (text.contains(":") & text.rlike(":[0-9A-Fa-f]{1,4}:{1,2}[0-9A-Fa-f]{1,4}:"))),
        "card": (numeric & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), numeric & text.rlike("[0-9][0-9]")),
        "phone": (numeric & text.contains("+"), numeric & text.rlike(r"[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6}")),
    }


def spans_of(text: Column, pattern: str, worth: Column) -> Column:
    """Array of (s, e, v, l, r): start, end, match, and what stands left and right of it.

    Texts that are not ``worth`` searching have none.

    Matches and the pieces between them come from the same search; starts are running
    sums of their lengths, in blocks so that long texts stay cheap.
    """
    def sums(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.struct(start.alias("to"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct(
            (a["to"] + x).alias("to"), F.array_append(a["out"], a["to"] + x).alias("out")))["out"]

    def located(both: Column) -> Column:
        pieces, found = both["p"], both["m"]
        n = F.size(found)
        steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.length(F.get(pieces, i)) + F.when(
            i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        block = 256
        blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                                       lambda j: F.slice(v, j * block + 1, F.lit(block)))
        starts = let(steps, lambda v: let(blocks(v), lambda bs: let(
            sums(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0)),
            lambda tops: F.flatten(F.transform(bs, lambda b, j: sums(b, F.when(j > 0, F.get(tops, j - 1)).otherwise(0)))))))
        return let(starts, lambda at: F.transform(found, lambda m, i: F.struct(
            F.get(at, i).alias("s"), (F.get(at, i) + F.length(m)).alias("e"), m.alias("v"),
            F.right(F.get(pieces, i), F.lit(24)).alias("l"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("r"))))

    p = F.lit(pattern)
    empty = F.array().cast("array<struct<s:int,e:int,v:string,l:string,r:string>>")
    pair = F.struct(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"))
    return F.when(worth, let(pair, lambda b: F.when(F.size(b["m"]) > 0, located(b)).otherwise(empty))).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the checksum."""
    each = F.split(F.reverse(digits(value)), "")
    doubled = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    total = F.aggregate(F.transform(each, lambda d, i: doubled(d.cast("int"), i)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def octets(value: Column) -> Column:
    """Whether every part is at most 255."""
    part = lambda x: F.regexp_replace(x, "^0+", "")
    return F.forall(F.split(value, "[.]"), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": octets(value), "card": n.between(13, 19) & F.when(n.between(13, 19), luhn(value)),
            "phone": n.between(9, 15)}[kind]


def is_valid(kind: str):
    return lambda s: F.coalesce(valid(kind, s["v"]), F.lit(False))


def features(kind: str, span: Column) -> Column:
    """Small numbers about the format and the context of a candidate."""
    v = span["v"]
    count = lambda keep: F.length(F.regexp_replace(v, f"[^{keep}]+", ""))
    groups = F.filter(F.split(v, "[^0-9A-Za-z]+"), lambda x: x != "")
    sizes = F.transform(groups, lambda x: F.least(F.length(x), F.lit(20)))
    kind_of = lambda c: (F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike("\\s"), 1)
                         .when(c.rlike("[0-9]"), 2).when(c.rlike("\\p{L}"), 3).otherwise(4))
    strict = {"email": v.rlike(DOMAIN), "ip": octets(F.regexp_replace(v, ":+", ".")) & v.rlike("^[0-9.]+$"),
              "card": F.when(F.length(digits(v)).between(13, 19), luhn(v)).otherwise(False), "phone": v.startswith("+")}[kind]
    columns = {
        "digits": F.least(F.length(digits(v)), F.lit(30)), "length": F.least(F.length(v), F.lit(60)),
        "groups": F.least(F.size(groups), F.lit(12)), "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)), "dots": F.least(count("."), F.lit(6)),
        "dashes": F.least(count("\\-"), F.lit(6)), "spaces": F.least(count("\\x20"), F.lit(6)),
        "brackets": F.least(count("\\[\\](){}"), F.lit(4)), "marks": F.least(count(":/%_"), F.lit(8)),
        "letters": F.least(count("A-Za-z"), F.lit(20)), "strict": F.coalesce(strict, F.lit(False)),
        "before": kind_of(F.right(span["l"], F.lit(1))), "after": kind_of(span["r"]),
        "cue": F.lower(span["l"]).rlike(CUES[kind]), "wide": F.length(F.regexp_replace(span["l"], "[^0-9]+", "")) > 3,
        "dated": v.rlike(DATE),
    }
    return F.struct(*[columns[name].cast("int").alias(name) for name in FEATURES])


def with_spans(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Add the struct ``into``: for each kind the valid base spans and the candidates."""
    whole = whole_text(text)

    def found(numeric: Column) -> Column:
        fields = []
        for kind, (base_worth, worth) in worth_searching(whole, numeric).items():
            base = F.filter(spans_of(whole, BASE[kind], base_worth), is_valid(kind))
            fields += [F.transform(base, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"))).alias(kind),
                       spans_of(whole, CANDIDATES[kind], worth).alias(f"{kind}_c")]
        return F.struct(*fields)

    return docs.withColumn(into, let(whole.rlike("[0-9]"), found))


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (span["s"] < o["e"]) & (o["s"] < span["e"]))


@dataclass(frozen=True)
class Model:
    """Trees and the threshold of each kind; a threshold above 1 adds nothing."""

    trees: dict[str, boosting.Trees]
    threshold: dict[str, float]


def expression(trees: boosting.Trees, x: Column) -> Column:
    """The trees as nested CASE expressions over the struct of features."""
    def walk(t: int, node: int, level: int) -> Column:
        if level == trees.depth:
            return F.lit(float(trees.value[t, node]))
        threshold = float(trees.threshold[t, node])
        left = walk(t, 2 * node + 1, level + 1)
        if threshold == np.inf:
            return left
        return F.when(x[FEATURES[trees.feature[t, node]]] <= threshold, left).otherwise(walk(t, 2 * node + 2, level + 1))

    total = F.lit(trees.start)
    for t in range(len(trees.value)):
        total = total + walk(t, 0, 0)
    return 1 / (1 + F.exp(-total))


def calibrated(score: np.ndarray, label: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """A score from which on at least ``precision`` of the weight is positive.

    It lies half way between the lowest such score that occurs and the next one below.
    """
    levels, at = np.unique(score, return_inverse=True)
    good, total = (np.bincount(at, w)[::-1].cumsum()[::-1] for w in (weight * label, weight)) if len(levels) else ((), ())
    fine = np.flatnonzero(np.asarray(good) >= precision * np.asarray(total)) if len(levels) else []
    if not len(fine):
        return 2.0
    return float(levels[fine[0]] + (levels[fine[0] - 1] if fine[0] else 0.0)) / 2


def rewritten(kind: str, v: Column) -> Column:
    """Forms of a base span without the mark that makes it one; none where they would tell nothing."""
    user, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    part = lambda i: F.lower(F.hex(F.split_part(v, F.lit("."), F.lit(i)).try_cast("int")))
    regular = F.regexp_replace(digits(v), "([0-9]{4})(?=[0-9])", "$1 ")
    forms = {
        "email": F.array(F.concat(user, F.lit(" (at) "), domain), F.concat(user, F.lit(" at "), F.regexp_replace(domain, "[.]", " dot "))),
        "ip": F.array(F.concat_ws(":", F.lit("2001:db8:0:0"), *[part(i) for i in range(1, 5)]),
                      F.concat_ws(":", F.lit("fe80:"), *[part(i) for i in range(1, 5)])),
        "card": F.array(*[F.replace(regular, F.lit(" "), F.lit(x)) for x in (".", "/", "  ")]),
        "phone": F.array(F.regexp_replace(v, "^\\+", ""), F.regexp_replace(v, "^\\+[0-9]{1,3}[\\x20.-]*(?=[(0-9])", "")),
    }[kind]
    if kind == "phone":  # a bare run of digits could be any number
        forms = F.filter(forms, lambda x: x.rlike("[0-9][^0-9]+[0-9]") & F.length(digits(x)).between(7, 15))
    return forms


def impossible(kind: str, v: Column, elsewhere: Column) -> Column:
    """Whether a candidate cannot be of its kind; ``elsewhere`` says that it is of another one."""
    n = F.length(digits(v))
    groups = F.size(F.split(v, "[.:]+"))
    return {
        "email": ~v.rlike(DOMAIN),
        "ip": F.when(v.contains(":"), ~v.contains("::") & (groups != 8)).otherwise(~octets(v) | (groups != 4) | v.rlike(DATE)),
        "card": ~valid("card", v) | elsewhere,
        "phone": ~n.between(7, 15) | v.rlike(DATE) | elsewhere,
    }[kind]


def labelled(found: DataFrame, into: str, fitted: Column) -> DataFrame:
    """(fitted, kind, y, features): rewritten base spans, and candidates that cannot be of their kind."""
    others = {"card": ("ip", "phone"), "phone": ("ip", "card")}
    rows = []
    for kind in KINDS:
        spans = lambda k: F.col(f"{into}.{k}")
        c = found.select(fitted.alias("fitted"), spans(kind).alias("base"), F.flatten(F.array(*[spans(k) for k in others.get(kind, ())])).alias("others")
                         if kind in others else F.slice(spans(kind), 1, 0).alias("others"), F.explode(f"{into}.{kind}_c").alias("c"))
        same = F.exists("base", lambda o: (o["s"] == F.col("c.s")) & (o["e"] == F.col("c.e")))
        wrong = ~overlaps(F.col("c"), F.col("base")) & F.coalesce(
            impossible(kind, F.col("c.v"), overlaps(F.col("c"), F.col("others"))), F.lit(True))
        c = c.select("fitted", "c", F.when(same, True).when(wrong, False).alias("y")).filter("y is not null")
        forms, plain = rewritten(kind, F.col("c.v")), F.array("c.v")
        if kind == "card":  # a failed checksum stays one in any form, so that the form alone does not decide
            plain = F.when(F.length(digits(F.col("c.v"))).between(13, 19), F.concat(plain, forms)).otherwise(plain)
        c = c.select("fitted", "c", "y", F.explode(F.when(F.col("y"), forms).otherwise(plain)).alias("v"))
        rows.append(c.select("fitted", F.lit(kind).alias("kind"), "y", features(kind, F.col("c").withField("v", F.col("v"))).alias("x")))
    return reduce(DataFrame.unionAll, rows)


def seed_weights(label: np.ndarray, mass: float) -> np.ndarray:
    """Weights of the written examples next to labelled candidates of weight ``mass``."""
    return np.maximum(SEED_WEIGHT, SEED_SHARE * mass / np.where(label == 1, (label == 1).sum(), (label == 0).sum()).clip(1))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = TRAIN_DOCS,
          precision: float = PRECISION) -> Model:
    """Fit the trees on part of about ``max_docs`` documents, chosen by a hash of their key; calibrate on the others."""
    into = free_name(docs.select(key), "spans")
    found = staged(with_spans(docs.select(*dict.fromkeys([key, text])), text, into).select(key, into), "pii")
    return train_on(found, into, key, max_docs, precision)


def train_on(found: DataFrame, into: str, key: str = "doc_id", max_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> Model:
    """``train`` on documents whose spans were found before, in the struct ``into``; they are read three times."""
    share = min(1.0, max_docs / max(1, found.count()))
    chosen = F.shiftrightunsigned(F.xxhash64(key, F.lit("pii")), 11) * F.lit(2.0**-53) < share
    fitted = chosen & (F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(3)) != 0)

    rows = labelled(found, into, fitted)

    def counts(part: Column, by: list) -> dict[str, np.ndarray]:
        got = rows.filter(part).groupBy("kind", "y", *by).count().collect()
        return {kind: np.array(sorted(tuple(r)[1:] for r in got if r["kind"] == kind), np.float64).reshape(-1, len(by) + 2) for kind in KINDS}

    seeds = found.sparkSession.createDataFrame(
        [(k, y, t) for (k, y), texts in SEEDS.items() for t in texts], "kind string, y boolean, t string")
    seeds = with_spans(seeds, "t", "spans")
    examples = reduce(DataFrame.unionAll, [
        seeds.filter(F.col("kind") == kind).select("kind", "y", F.explode(f"spans.{kind}_c").alias("c")).select(
            "kind", "y", features(kind, F.col("c")).alias("x")) for kind in KINDS]).select("kind", "y", "x.*").collect()
    written = {kind: np.array(sorted(tuple(r)[1:] for r in examples if r["kind"] == kind), np.float64).reshape(-1, len(FEATURES) + 1)
               for kind in KINDS}
    trees, threshold = {}, {}
    for kind, data in counts(F.col("fitted"), [F.col(f"x.{n}") for n in FEATURES]).items():
        own = written[kind]
        trees[kind] = boosting.fit(
            np.concatenate([data[:, 1:-1], own[:, 1:]]), np.concatenate([data[:, 0], own[:, 0]]),
            np.concatenate([data[:, -1], seed_weights(own[:, 0], data[:, -1].sum())]), N_TREES, DEPTH, rate=0.3)
    score = reduce(lambda so_far, kind: so_far.when(F.col("kind") == kind, expression(trees[kind], F.col("x"))), KINDS, F)
    for kind, data in counts(~F.col("fitted"), [F.floor(score * SCORE_LEVELS).alias("level")]).items():
        own = written[kind]
        levels = np.concatenate([data[:, 1], np.floor(trees[kind].scores(own[:, 1:]) * SCORE_LEVELS)]) / SCORE_LEVELS
        threshold[kind] = max(LEAST_SCORE, calibrated(
            levels, np.concatenate([data[:, 0], own[:, 0]]),
            np.concatenate([data[:, -1], seed_weights(own[:, 0], data[:, -1].sum())]), precision))
    return Model(trees, threshold)


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "pii",
               model: Model | None = None, carry: list[str] | None = None) -> DataFrame:
    """Add the struct ``into``: for each kind ``base`` spans and ``all`` spans, as (s, e) in code points.

    The end is exclusive. ``carry`` names the columns to return beside it; all by default.
    Without a model one is trained on these documents; the carried columns are then written
    to the shared folder beside the spans, so that no text is searched twice.
    """
    carried = docs.columns if carry is None else carry
    found = with_spans(docs, text, into)
    if model is None:
        found = staged(found.select(*dict.fromkeys([*carried, key]), into), "pii")
        model = train_on(found, into, key)
    found = found.select(*carried, into)

    def chosen(kind: str, base: Column, candidates: Column) -> Column:
        scored = F.filter(candidates, lambda c: ~overlaps(c, base) & let(features(kind, c), lambda x: expression(
            model.trees[kind], x) >= model.threshold[kind]))
        return F.transform(scored, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))

    fields = []
    for kind in KINDS:
        base = F.col(f"{into}.{kind}")
        extra = chosen(kind, base, F.col(f"{into}.{kind}_c")) if model.threshold[kind] <= 1 else F.slice(base, 1, 0)
        fields += [base.alias(kind), F.array_sort(F.concat(base, extra)).alias(f"{kind}_all")]
    return found.withColumn(into, F.struct(*fields))


def listed(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind and then by start, joined by commas."""
    def named(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["s"].cast("string"), s["e"].cast("string"))

    return F.array_join(F.concat(*[F.transform(column, named(kind)) for kind, column in spans.items()]), ",")


def redact(found: DataFrame, text: str = "text", into: str = "pii", mark: str = "[REDACTED]") -> DataFrame:
    """Replace all spans in the text; overlapping ones are merged."""
    spans = F.array_sort(F.concat(*[F.col(f"{into}.{k}_all") for k in KINDS]))
    source = F.col(text)
    cut = let(spans, lambda all_: F.aggregate(
        all_, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
            F.greatest(a["at"], s["e"]).alias("at"), F.when(s["s"] < a["at"], a["out"]).otherwise(F.concat(
                a["out"], F.substring(source, a["at"] + 1, s["s"] - a["at"]), F.lit(mark))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(source, a["at"] + 1, F.length(source)))))
    return found.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(source))
