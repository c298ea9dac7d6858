"""Quality rules, line dedup, sharding and URL filter."""

import collections
import hashlib
import re

import pytest

from gradeframe.llm import line_dedup, quality_rules, sharding, url_filter
from pyspark.sql import functions as F

from .cases import SCHEMA, clashing, documents, odd_documents, prose


def expected_measures(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    hit = set()
    for i in range(len(ws) - 7):
        if windows[tuple(ws[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def test_quality_measures_match_plain_python(spark):
    rows = odd_documents() + [(20, "a b c d e f g h i a b c d e f g h z " * 2, "en"), (21, "same\nsame\n\nsame | x", "en")]
    got = quality_rules.judge_documents(documents(spark, rows), into="q")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = collections.Counter((r.doc_id, *[r.q[c] for c in cols]) for r in got.collect())
    assert found == collections.Counter((d, *expected_measures(t)) for d, t, _ in rows)


def test_quality_rules_keep_prose_and_drop_junk(spark):
    good = [(i, prose(i, 60 + i) + ".", "en") for i in range(60)]
    junk = [(100 + i, " | ".join(prose(i, 60).split()), "en") for i in range(6)]
    junk += [(200 + i, " ".join(w + "***" for w in prose(i, 60).split()), "en") for i in range(6)]
    kept = {r.doc_id for r in quality_rules.keep_good(documents(spark, good + junk)).collect()}
    assert kept == set(range(60))


def test_estimation_is_defined_without_documents_and_follows_agreement():
    empty = quality_rules.estimate({}, 3)
    assert empty.votes[0][1] > 0 > empty.votes[0][-1]
    model = quality_rules.estimate({(1, 1, 1): 800, (-1, -1, 1): 100, (-1, -1, -1): 60, (1, 1, -1): 200}, 3)
    assert model.votes[0][-1] < model.votes[2][-1]  # the rule that goes its own way counts less


def test_quality_rules_on_empty_and_clashing_tables(spark):
    assert quality_rules.keep_good(documents(spark, [])).count() == 0
    frame = clashing(documents(spark), "quality", "parts", "n_words")
    assert quality_rules.keep_good(frame).columns == frame.columns


def reference_lines(rows):
    first, spoken = {}, {}
    for d, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        for a, b, c in zip(at, at[1:], at[2:]):
            key = tuple(lines[i].rstrip(" ") for i in (a, b, c))
            spoken.setdefault((d, text), []).append((key, (a, b, c)))
            first.setdefault(key, (d, text, a))
    out = {}
    for d, text, _ in rows:
        gone = {i for key, at in spoken.get((d, text), ()) if first[key] != (d, text, at[0]) for i in at}
        out[(d, text)] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_line_dedup_matches_plain_python(spark):
    rows = odd_documents() + [(30, "a\nb\nc\na\nb\nc\nd", "en"), (31, "x\nx\nx\nx\nx", "en"), (32, "b\n\nc \n d\nz", "en"), (33, "q\nb\nc\n d\n", "en")]
    frame = clashing(documents(spark, rows), "text_key", "removed_lines")
    got = line_dedup.drop_repeated_lines(frame)
    assert got.columns == frame.columns
    want = reference_lines(rows)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(str((d, want[(d, t)])) for d, t, _ in rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_repeated_lines(documents(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [200, 1000, 50_000])
def test_shards_fit_and_only_full_buckets_split(spark, limit):
    rows = odd_documents() + [(1000 + i, prose(i, 20), "en") for i in range(200)] + [(7, "hot", "en")] * 300
    got = sharding.assign_shards(documents(spark, rows), limit_bytes=limit).collect()
    assert len(got) == len(rows)
    sizes, counts = collections.Counter(), collections.Counter()
    for r in got:
        assert r.n_bytes == len((r.text or "").encode()) and r.depth == len(r.shard)
        sizes[r.shard] += r.n_bytes
        counts[r.shard] += 1
    assert all(sizes[s] <= limit or counts[s] == 1 for s in sizes)
    assert all(r.shard_bytes == sizes[r.shard] for r in got)
    shards = set(sizes)
    for s in shards:  # a directory: no shard is a prefix of another, and its parent was too large
        assert not any(s != o and o.startswith(s) for o in shards)
        if s:
            assert sum(n for o, n in sizes.items() if o.startswith(s[:-1])) > limit


def test_sharding_of_nothing_and_clashing_columns(spark, tmp_path):
    assert sharding.assign_shards(documents(spark, [])).count() == 0
    got = sharding.assign_shards(clashing(documents(spark), "shard", "leaf", "depth"), limit_bytes=5000)
    sharding.write_shards(got, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(odd_documents())


def test_url_rules_and_vocabulary(spark):
    urls = {
        "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://EXAMPLE.com": ("example.com", "", None, "allow"),
        "http://notexample.com/x": ("notexample.com", "/x", "com/", "allow"),
        "http://casino.com/": ("casino.com", "/", "com/", "allow"),
        "http://b.net/fr/1?q": ("b.net", "/fr/1", "net/fr/", "block"),
        "http://casino.org/": ("casino.org", "/", None, "block"),
        "http://occasino.org/": ("occasino.org", "/", None, "allow"),
        "http://free-free.org/free": ("free-free.org", "/free", None, "allow"),
        "http://free-bonus.org/": ("free-bonus.org", "/", None, "block"),
        "no scheme xxx": ("", "", None, "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "x://" + "a" * 50_000: ("a" * 50_000, "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, *urls])], "page_id long, url string, host int")
    for r in url_filter.filter_urls(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, vocabulary={}).filter(F.col("rule").isNull()).collect()} == {"allow"}


def test_url_vocabulary_on_labelled_urls(spark):
    """Graded weights: strict terms alone, telling ones in pairs, everyday ones only in number."""
    bad = [
        "http://x.org/porn/1", "https://best-casino.net/", "http://a.de/viagra", "http://w.org/adult-dating/", "http://g.io/gambling?ref=slots",
        "https://p.com.org/payday_loan", "http://f.org/free/bonus/win", "http://s.org/cheap-pills-discount", "http://k.org/crack/serial",
        "http://o.org/free-cash-now-offer", "http://d.org/deal/discount/coupon/sale"]
    good = [
        "http://x.org/free-click", "http://bank.org/loan-deal", "http://shop.org/best-offer", "http://w.org/window/cheapest", "http://s.org/adulthood",
        "http://b.org/betting", "http://n.org/win-win-win-win", "http://t.org/farm/download", "http://e.org/escorted", "http://m.org/money/credit",
        "http://c.org/crackers/freedom", "", "no url at all"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.filter_urls(pages, rules=()).collect()}
    assert {u for u, v in got.items() if v == "block"} == set(bad)
    assert len(url_filter.VOCABULARY) > 100 and len(set(url_filter.VOCABULARY.values())) == 5


def test_url_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Alpha", 60), ("alpha", 50), ("beta", 40), (None, 100), ("", 100), ("gamma", None)], "term string, weight int")
    vocabulary = url_filter.read_vocabulary(table)
    assert vocabulary == {"alpha": 60, "beta": 40}
    pages = spark.createDataFrame([(1, "http://h/alpha/beta"), (2, "http://h/alpha/alpha"), (3, None)], "page_id long, url string")
    got = {r.page_id: (r.n_strict, r.n_soft, r.verdict) for r in url_filter.filter_urls(pages, rules=(), vocabulary=vocabulary).collect()}
    assert got == {1: (0, 2, "block"), 2: (0, 1, "allow"), 3: (0, 0, "allow")}
    with pytest.raises(ValueError):
        url_filter.read_vocabulary(table, most=1)
