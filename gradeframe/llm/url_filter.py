"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary is one Aho-Corasick automaton, so a url is read once however many
terms there are. A term counts when neither neighbour is an ASCII letter or digit.
A strict term weighs as much as the limit; soft terms weigh less, by grades, so two to
four distinct ones are needed. Repeats of one term count once. The vocabulary is a
parameter: a mapping, or a table of terms and weights read by ``read_vocabulary``.

Null, or a url without ``://``: host and path are empty, no rule fits, and the
vocabulary still judges the whole string (null: allowed). Repeated rows are judged
alike, an empty table gives an empty result, and extra columns pass through; a
column of ``urls`` named like an output is replaced by the output.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import ascii_lower, free_name

LIMIT = 100
#: Weights in hundredths of what rejects a page. Strict terms reject alone. Soft terms are
#: graded by how telling they are: one of the strongest and any other are enough, of everyday
#: words that shops and blogs use as well four are needed.
STRICT = """porn porno xxx casino viagra cialis escort warez phishing malware spam torrent jackpot
keygen camgirl hentai milf nsfw ransomware botnet carding poker roulette blackjack sexcam""".split()
GRADED: dict[int, list[str]] = {
    75: "bonus gamble freespins wager sexchat upskirt".split(),
    60: """adult nude erotic fetish gambling betting slots crack cracked serial dating hookup pills
        pharmacy steroid replica counterfeit payday spyware trojan exploit hack hacked cheats leaked""".split(),
    40: """bet bets win winner prize lottery loan loans credit debt forex binary crypto bitcoin
        sexy hot singles girls weed vape farm likes followers unlock bypass nulled mirror proxy""".split(),
    25: """free cheap deal deals click discount coupon sale offer offers promo buy now best top online
        download instant cash money rich gift winners limited exclusive guaranteed""".split(),
}
VOCABULARY: dict[str, int] = {t: LIMIT for t in STRICT} | {t: w for w, terms in GRADED.items() for t in terms}
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def rule_index(rules: Sequence[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, rule, verdict), the longest path first."""
    index: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        index.setdefault(host, []).append((slash + path, rule, verdict))
    for found in index.values():
        found.sort(key=lambda x: -len(x[0]))
    return index


def longest_rule(index: Mapping, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits; of two as long, the one with the longer host."""
    best, at = None, host
    while host:
        for start, rule, verdict in index.get(at, ()):
            if path.startswith(start):
                if best is None or len(rule) > len(best[0]):
                    best = (rule, verdict)
                break
        _, dot, at = at.partition(".")
        if not dot:
            break
    return best


def read_vocabulary(table: DataFrame, most: int = 100_000) -> dict[str, int]:
    """A vocabulary from a table of (term, weight), in lower case; of a repeated term the larger weight counts.

    Rows without a term or weight are left out. A table of more than ``most`` terms is an
    error, since the automaton travels with every task.
    """
    rows = table.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("int").alias("weight"))
    rows = rows.filter("term <> '' and weight is not null").groupBy("term").agg(F.max("weight").alias("weight"))
    found = {r["term"]: r["weight"] for r in rows.limit(most + 1).collect()}
    if len(found) > most:
        raise ValueError(f"the vocabulary has more than {most} terms")
    return found


def automaton(vocabulary: Mapping[str, int]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in vocabulary:
        found.add_word(term, term)
    found.make_automaton()
    return found


def terms_in(matcher, url: str) -> set[str]:
    """Distinct vocabulary terms of a lower-cased url that stand between boundaries."""
    hits = set()
    for end, term in matcher.iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in WORD) and (end + 1 == len(url) or url[end + 1] not in WORD):
            hits.add(term)
    return hits


def filter_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT,
) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft and verdict to every row.

    ``rules`` and ``vocabulary`` are configuration and travel with the task.
    """
    index, vocabulary = rule_index(rules), dict(vocabulary)

    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matcher = automaton(vocabulary) if vocabulary else None
        for hosts, paths, urls in batches:
            rows = []
            for host, path, whole in zip(hosts, paths, urls):
                hits = terms_in(matcher, whole) if matcher else ()
                strict = sum(vocabulary[t] >= limit for t in hits)
                rule, verdict = longest_rule(index, host, path) or (
                    None, "block" if sum(vocabulary[t] for t in hits) >= limit else "allow")
                rows.append((rule, strict, len(hits) - strict, verdict))
            yield pd.DataFrame(rows, columns=["rule", "n_strict", "n_soft", "verdict"])

    judged = F.pandas_udf(judge, "rule string, n_strict int, n_soft int, verdict string")
    whole = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(whole.contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    found = free_name(pages, "judged")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "n_strict", "n_soft", "verdict")]
    return (
        pages.withColumn(found, F.struct(host.alias("host"), path.alias("path"), ascii_lower(whole).alias("url")))
        .withColumn(found, F.struct(
            F.col(f"{found}.host"), F.col(f"{found}.path"),
            judged(F.col(f"{found}.host"), F.col(f"{found}.path"), F.col(f"{found}.url")).alias("x")))
        .select(*kept, f"{found}.host", f"{found}.path", f"{found}.x.*")
    )


def filter_sql(rules: Sequence[tuple[str, str]] = RULES, vocabulary: Mapping[str, int] = VOCABULARY,
               limit: int = LIMIT) -> str:
    """The same verdicts over ``pages`` in SQL."""
    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return (f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}'))")

    ordered = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0])))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in ordered)
    hit = lambda t: f"(regexp_matches(url, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::INT"
    strict = " + ".join(hit(t) for t, w in vocabulary.items() if w >= limit)
    soft = " + ".join(hit(t) for t, w in vocabulary.items() if w < limit)
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in vocabulary.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (
  SELECT page_id, {lower.format("coalesce(url, '')")} AS url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, url, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path, {rule} AS rule, ({strict})::INT AS n_strict, ({soft})::INT AS n_soft,
         {weight} AS weight
  FROM parts
)
SELECT page_id, host, path, rule, n_strict, n_soft,
       {verdict} WHEN weight >= {limit} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
