"""Decontamination, near-duplicates, suffix dedup, packing, classifier and personal data."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import boosting, decontaminate, minhash, packing, pii, quality_model, suffix_dedup, suffixes

from .cases import clashing, documents, odd_documents, prose, words


# --- decontamination ---------------------------------------------------------------


def reference_overlap(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for d, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [
    (1, prose(1, 80)), (2, "  "), (3, None), (10, prose(90, 14)), (11, "A b, C"), (12, prose(90, 14)), (None, prose(91, 5)), (13, prose(92, 10)),
    (14, "ünï cödé ünï"),
]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_SHINGLES, 20])
def test_overlaps_match_plain_python(spark, block):
    rows = odd_documents() + [
        (40, "start " + prose(90, 14).upper() + " end a B c " + prose(92, 10), "en"), (41, prose(92, 9), "en"), (42, prose(91, 5), "en"),
        (43, "x a b", "en"), (44, "c a-b-c-a b c", "en")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame = clashing(documents(spark, rows), "row", "n_words", "places", "scanned")
    got = decontaminate.match(frame, items, block_shingles=block)
    found = sorted(((r.doc_id, r.overlap.n_words, r.overlap.n_hit, r.overlap.item_ids) for r in got.collect()), key=str)
    assert found == reference_overlap(rows, ITEMS)
    clean = decontaminate.drop_contaminated(frame, items)
    assert clean.columns == frame.columns
    assert clean.count() == sum(x[2] == 0 for x in found)


def test_blocks_find_the_right_rows_in_any_order(spark):
    rows = odd_documents() + [(100 + i, prose(300 + i, 30) + " " + prose(90 + i % 3, 14), "en") for i in range(60)]
    frame = documents(spark, rows).coalesce(1).mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), "doc_id long, text string, lang string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.match(frame, items, block_shingles=250).collect()
    found = sorted(((r.doc_id, r.overlap.n_words, r.overlap.n_hit, r.overlap.item_ids) for r in got), key=str)
    assert found == reference_overlap(rows, ITEMS)


def test_decontamination_of_and_by_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.drop_contaminated(documents(spark, []), items).count() == 0
    assert decontaminate.drop_contaminated(documents(spark), items.limit(0)).count() == len(odd_documents())


# --- near-duplicates ---------------------------------------------------------------


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else collections.Counter()


def reference_groups(rows, similarity=0.8):
    texts = sorted({t or "" for _, t, _ in rows})
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = (a & sets[j]).total()
            if shared and shared >= similarity * (a.total() + sets[j].total() - shared):
                parent[root(i)] = root(j)
    group = {t: root(i) for i, t in enumerate(texts)}
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            g = group[t or ""]
            smallest[g] = min(d, smallest.get(g, d))
    return sorted(((d, smallest.get(group[t or ""])) for d, t, _ in rows), key=str)


def chained(n):
    """Texts of which each is near the next only."""
    w = prose(77, 60).split()
    out = []
    for i in range(n):
        w[(i * 7) % 60] = f"new{i}"
        out.append((500 + i, " ".join(w), "en"))
    return out


def test_groups_match_plain_python(spark):
    rows = odd_documents() + chained(30)
    got = minhash.near_duplicates(clashing(documents(spark, rows), "id", "n", "bands"))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == reference_groups(rows)


def test_groups_whose_hub_is_not_near_all(spark):
    base = prose(78, 90).split()
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(2):
            w[(i * 2 + j) * 9 % 90] = f"own{i}x{j}"
        rows.append((i, " ".join(w), "en"))
    got = minhash.near_duplicates(documents(spark, rows))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == reference_groups(rows)


def test_keep_one_of_each_group(spark):
    rows = odd_documents() + [(99, prose(1, 80), "x")] * 50
    frame = clashing(documents(spark, rows), "id", "row")
    kept = minhash.keep_one(frame)
    assert kept.columns == frame.columns
    wanted = collections.Counter(c for _, c in reference_groups(rows))
    got = kept.collect()
    assert len(got) == len(wanted) and {r.doc_id for r in got} == set(wanted)
    assert minhash.keep_one(documents(spark, [])).count() == 0


def test_darts_estimate_weighted_similarity():
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cells = np.concatenate([a[:1500], a[500:]])
    row = np.repeat([0, 1], 1500).astype(np.uint16)
    kept = minhash.signatures(cells, row, 3, 512)
    assert not kept[2].any() and (kept[:2] != 0).all()
    assert abs((kept[0] == kept[1]).mean() - 0.5) < 0.08


# --- suffix arrays -----------------------------------------------------------------


def test_suffix_arrays_and_prefixes_match_sorting():
    r = np.random.default_rng(5)
    for _ in range(150):
        size = int(r.choice([1, 2, 4, 300]))
        text = r.integers(0, size, r.integers(1, 70)).astype(np.uint16)
        text = np.tile(text, int(r.integers(1, 4)))
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        got = suffixes.suffix_array(text, size)
        assert got.tolist() == want
        prefix, before = suffixes.common_prefixes(text, got)
        for i, j in zip(want[1:], want):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            assert (prefix[i], before[i]) == (n, j)


def reference_repeats(rows):
    where = collections.Counter()
    data = [(d, (t or "").encode()) for d, t, _ in rows]
    for _, b in data:
        where.update(b[i:i + 200] for i in range(len(b) - 199))
    out = []
    for d, b in data:
        flags = bytearray(len(b))
        for i in range(len(b) - 199):
            if where[b[i:i + 200]] > 1:
                flags[i:i + 200] = b"\1" * 200
        kept = bytes(x for x, f in zip(b, flags) if not f)
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        out.append((d, len(b), sum(flags), spans, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"hot_parts": 1}, {"shard_bytes": 500}])
def test_repeats_match_plain_python(spark, sizes):
    passage = prose(60, 60)
    rows = [r for r in odd_documents() if len(r[1] or "") < 20_000] + [
        (50, prose(61, 30) + passage + prose(62, 30), "en"), (51, "é" + passage[:203], "en"), (52, passage[4:202], "en"),
        (53, passage + "|" + passage, "en"), (54, "\0" * 450, "en"), (55, "ab" * 230, "en"), (56, prose(63, 40) + "ü" + passage[3:204] + "ö", "en")]
    rows += [(60 + i, prose(70 + i, 40) + passage[10:150] + prose(170 + i, 40), "en") for i in range(12)]
    frame = clashing(documents(spark, rows), "repeats_key", "key", "t")
    got = suffix_dedup.remove_repeats(frame, **sizes)
    found = sorted(((r.doc_id, r.repeats.n_bytes, r.repeats.n_removed, len(r.repeats.spans), bytes(r.repeats.kept)) for r in got.collect()), key=str)
    assert found == reference_repeats(rows)


def test_repeats_across_the_blocks_of_a_long_text(spark, monkeypatch):
    """Blocks of 4,000 bytes: every repeat lies across or beyond an edge of one."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4_000)
    passage = prose(60, 50)
    rows = [(1, prose(61, 640) + passage + prose(62, 900) + passage[5:], "en"), (2, prose(63, 1_250), "en"),
            (3, prose(64, 20) + passage[:250] + "é" * 3_000, "en"), (4, None, "en"), (5, passage, None), (5, passage, None)]
    assert len(rows[0][1]) > 8_000 and len(rows[1][1]) > 8_000
    got = suffix_dedup.remove_repeats(documents(spark, rows))
    found = sorted(((r.doc_id, r.repeats.n_bytes, r.repeats.n_removed, len(r.repeats.spans), bytes(r.repeats.kept)) for r in got.collect()), key=str)
    assert found == reference_repeats(rows)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


# --- packing -----------------------------------------------------------------------


def test_pieces_rebuild_every_document(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(packing.tokenizer_paths()[0])
    rows = odd_documents() + [(70, "<|endoftext|> a\u00a0b\u3000c", "en"), (71, "tabs\t\tand\n\n\nlines  ", "en"), (72, " " * 5000 + "x", "en"),
                              (73, "don't WE'LL 123abc ½ ² ٣ नमस्ते 你好 \x1c\x85 ok", "en")]
    rows = [r for r in rows if r[0] is not None and r[0] != 13]
    got = packing.pack(documents(spark, rows), with_ids=True)
    pieces = got.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
    for d, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[d], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert all(p.doc_tokens == len(ids) for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert sum(p.length for p in own) <= packing.CAPACITY
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert all(whole[s] == [x for p in own for x in p.ids] for s, own in by_sequence.items())


def test_pieces_of_null_and_repeated_keys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(packing.tokenizer_paths()[0])
    long = prose(14, 2_000)
    rows = [(None, prose(3, 50), "en"), (None, None, "en"), (13, long, "en"), (13, long, "en"), (13, prose(5, 9), "en"), (14, "", "en")]
    got = packing.pack(documents(spark, rows).repartition(3), with_ids=True).collect()
    want = collections.Counter()
    for d, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        cut = np.cumsum([0, *packing.cuts(len(ids))]).tolist()
        want.update((d, a, len(ids), tuple(ids[a:b])) for a, b in zip(cut, cut[1:]))
    assert collections.Counter((p.doc_id, p.start, p.doc_tokens, tuple(p.ids)) for p in got) == want
    places = [(p.sequence_id, x) for p in got for x in range(p.offset, p.offset + p.length)]
    assert len(places) == len(set(places)) and max(x for _, x in places) < packing.CAPACITY


def test_padding_is_little_on_many_documents(spark):
    rows = [(i, prose(i, 30 + i * 37 % 900), "en") for i in range(300)]
    pieces = packing.pack(clashing(documents(spark, rows).repartition(6), "bin", "slot")).collect()
    sequences = {p.sequence_id for p in pieces}
    assert 1 - sum(p.length for p in pieces) / (2048 * len(sequences)) < 0.02
    assert packing.pack(documents(spark, [])).count() == 0


def test_cuts_and_fill():
    for n in range(1, 6000, 7):
        assert sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= 2048
    placed = packing.fill([1000, 1000, 48, 2048, 1], 2048)
    assert placed[3][1] == 0 and len({s for s, _ in placed}) == 3


# --- quality classifier ------------------------------------------------------------


def test_classifier_learns_held_out_labels(spark):
    good = [(i, prose(i, 40 + i % 50), "en") for i in range(400)]
    bad = [(1000 + i, " | ".join(prose(i, 40).split()), "en") for i in range(400)]
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _, _ in good + bad] + [(4, None), (None, 1), (5, 1)], "doc_id long, quality int")
    frame = clashing(documents(spark, good + bad + odd_documents()), "scored_text", "score")
    held = quality_model.held_out("doc_id")
    got = quality_model.score_documents(frame, labels, ~held).collect()
    assert len(got) == 800 + len(odd_documents()) and all(0 <= r.score <= 1 for r in got)
    tested = [r for r in got if (r.doc_id or 0) >= 1000 or 20 <= (r.doc_id or 0) < 1000]
    tested = [r for r in tested if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 100
    assert all((r.score >= 0.7) == (r.doc_id < 1000) for r in tested)


def plain_statistics(text):
    """The statistics of one text, counted byte by byte and word by word."""
    data = (text or "").encode()
    size, out = max(len(data), 1), []
    out += [sum(x in kind for x in data) / size for kind in quality_model.KINDS.values()]
    found = [w.encode() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    n, line = max(len(found), 1), data.count(b"\n") + 1
    marks = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    out += [np.log1p(len(data)), np.log1p(len(found)), sum(map(len, found)) / n, len({w.lower() for w in found}) / n,
            sum(a == b and b in marks for a, b in zip(data, data[1:])) / size, sum(len(w) > 14 for w in found) / n,
            np.log1p(size / line), sum(a in b'.!?:;"\'' and b == 10 for a, b in zip(data, data[1:])) / line]
    return out


def plain_score(trees, row):
    total = trees.start
    for feature, threshold, value in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.value.tolist()):
        node = 0
        for _ in range(trees.depth):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node]
    return 1 / (1 + np.exp(-total))


def test_classifier_equals_plain_statistics_and_tree_walk(spark):
    rows = odd_documents() + [(200 + i, t, "en") for i, t in enumerate(
        ["a,, b!! (c)\n\"d\"\n:", "\x01 tab\tbed | x_y=1\n", "ÀÉ né 123 " * 9, "Extraordinarilylongword. " * 3, "!!!???", "ÄÄ--ää\n.\n"])]
    rows += [(1000 + i, prose(i, 30) + "." * (i % 7), "en") for i in range(80)] + [(2000 + i, "| ".join(prose(i, 30).split()), "en") for i in range(80)]
    labels = spark.createDataFrame([(d, int(d < 2000)) for d, _, _ in rows if d and d >= 1000] + [(1001, 0), (1001, 0)], "doc_id long, quality int")
    docs = documents(spark, rows)
    x, y = quality_model.training_rows(docs, labels, F.lit(True), "doc_id", "text", "quality", quality_model.MAX_ROWS)
    share = {d: float(d < 2000 and d != 1001) for d, _, _ in rows if d and d >= 1000}
    learned = sorted([*plain_statistics(t), share[d]] for d, t, _ in rows if d in share)
    assert np.allclose(sorted([*r, v] for r, v in zip(x.tolist(), y.tolist())), learned, rtol=1e-12, atol=1e-12)
    trees = boosting.fit(x, y)
    assert len(trees.value) and trees.feature.any()
    got = sorted((str(r.doc_id), r.text or "", round(r.score, 9)) for r in quality_model.score_documents(docs, labels, F.lit(True)).collect())
    assert got == sorted((str(d), t or "", round(float(plain_score(trees, plain_statistics(t))), 9)) for d, t, _ in rows)


def test_repeated_keys_are_learned_from_once(spark):
    rows = [(i, prose(i, 20), "en") for i in range(30)] + [(3, "zz " * 20, "en")] * 500 + [(3, None, "en")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    x, y = quality_model.training_rows(documents(spark, rows), labels, F.lit(True), "doc_id", "text", "quality", 30)
    assert len(x) == len(y) == 30
    plain = sorted(plain_statistics(t) for d, t, _ in rows[:30])
    assert np.allclose(sorted(x.tolist()), plain)


def test_classifier_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_model.score_documents(documents(spark), none, F.lit(True)).select("score").distinct().collect()
    assert len(got) == 1 and 0 < got[0][0] < 1
    assert quality_model.score_documents(documents(spark, []), none, F.lit(True)).count() == 0


def test_boosting_fits_an_interaction():
    r = np.random.default_rng(3)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


# --- personal data -----------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def allowed(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def personal():
    rows = [
        "a.b@c.de 🙂 x@y.z.w, _q@r.s", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8 001.002.3.255 256.1.1.1 1.2.3.0004",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111-", "+49 (030) 12-34 567 +1 +1 +12345678901234567", "@ . + 1",
        "4111  1111 1111 1111", "so+1 555 0100 200 4111111111111111 9", "x" * 3000 + "@a.b", "1-" * 2000, "1." * 2000, "+" + "1 " * 3000, "é1.2.3.4é+123456789ü",
    ]
    return [(100 + i, t, "en") for i, t in enumerate(rows)] + odd_documents()


def test_base_spans_match_plain_patterns(spark):
    rows = personal()
    frame = clashing(documents(spark, rows), "spans", "apart", "kind")
    none = pii.Model({}, dict.fromkeys(pii.KINDS, 2.0))
    got = pii.find_spans(frame, model=none)
    found = sorted(str((r.doc_id, [[(s.s, s.e) for s in r.pii[k]] for k in pii.KINDS])) for r in got.collect())
    want = sorted(str((d, [[m.span() for m in re.finditer(p, t or "") if allowed(k, m.group())] for k, p in PLAIN.items()])) for d, t, _ in rows)
    assert found == want


def test_digests_of_the_query_match_plain_patterns(spark, tmp_path):
    """``op1_pii`` over a folder: counts, digest of the base spans, and the list of all spans."""
    from gradeframe.llm import checks

    rows = personal()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = checks.op1_pii(spark, str(tmp_path)).collect()
    want = []
    for d, text, _ in rows:
        spans = {k: [m.span() for m in re.finditer(p, text or "") if allowed(k, m.group())] for k, p in PLAIN.items()}
        listed = [f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found]
        want.append((d, *[len(spans[k]) for k in PLAIN], hashlib.sha256(",".join(listed).encode()).hexdigest(), listed))
    found = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got]
    assert sorted(found, key=str) == sorted((w[:-1] for w in want), key=str)
    for r in got:
        every = [x.split(":") for x in r.spans.split(",") if x]
        assert any(set(w[-1]) <= {":".join(x) for x in every} for w in want if w[:-1] == (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
        assert [(list(PLAIN).index(k), int(a)) for k, a, _ in every] == sorted((list(PLAIN).index(k), int(a)) for k, a, _ in every)


def test_cards_written_digit_by_digit(spark):
    card = "4" + " 1" * 15
    rows = [(1, card, "en"), (2, f"pay {card.replace(' ', '-')} now", "en"), (3, card[:-1] + "2", "en"), (4, f"{card} or 10", "en")]
    none = pii.Model({}, dict.fromkeys(pii.KINDS, 2.0))
    got = {r.doc_id: [(s.s, s.e) for s in r.pii.card] for r in pii.find_spans(documents(spark, rows), model=none).collect()}
    want = {d: [m.span() for m in re.finditer(PLAIN["card"], t) if allowed("card", m.group())] for d, t, _ in rows}
    assert got == want and [len(got[d]) for d in (1, 2, 3)] == [1, 1, 0]


def test_trees_add_spans_and_leave_prose_alone(spark):
    rows = [(i, f"{prose(i, 20)} +1 ({200 + i}) 555-{1000 + i} {prose(i + 500, 9)} a{i}.b@mail.example.com", "en") for i in range(120)]
    rows += [(500, "call (803) 555-5351 now", "en"), (501, "write to jo_9 [at] mail7.example.com, or", "en"), (502, prose(9, 200), "en"),
             (503, "about 12 000 000 men", "en"), (504, None, "en")]
    frame = documents(spark, rows)
    model = pii.train(frame)
    got = pii.find_spans(frame, model=model)
    spans = {r.doc_id: sum(len(r.pii[f"{k}_all"]) for k in pii.KINDS) for r in got.collect()}
    assert (spans[500], spans[501], spans[502], spans[503], spans[504]) == (1, 1, 0, 0, 0)
    assert all(spans[i] == 2 for i in range(120))
    clean = {r.doc_id: r.text for r in pii.redact(got).collect()}
    assert clean[500] == "call [REDACTED] now" and clean[502] == rows[122][1] and clean[504] is None


def test_forms_more_frequent_than_base_spans_are_added(spark):
    def card(i):
        body = f"4{i:014d}"
        return next(body + c for c in "0123456789" if allowed("card", body + c))

    def text(i):
        d, n = f"555-{1000 + i % 9000}", card(i)
        forms = [
            f"call ({200 + i % 700}) {d} now", f"tel {200 + i % 700}-{d} or", f"write to jo{i} (at) mail{i % 10}.example.com, or",
            f"card {n[:4]}.{n[4:8]}.{n[8:12]}.{n[12:]} exp", f"sent on 2021-{1 + i % 12:02d}-{1 + i % 28:02d} 12 h",
            f"card {n[:15]}{(int(n[15]) + 1) % 10} exp", f"host 300.{i % 256}.2.3 has", f"look {i} (at) home"]
        return f"{prose(i, 4)} {forms[i % 8]} {prose(i + 1, 3)}" + (f" +1 (803) {d} a{i}.b@mail.example.com" if i % 100 == 0 else "")

    n = 10_400
    rows = [(i, text(i), "en") for i in range(n)]
    assert n > pii.TRAIN_DOCS
    got = pii.find_spans(documents(spark, rows).repartition(8)).collect()
    added = collections.Counter((r.doc_id % 8, k) for r in got for k in pii.KINDS for _ in range(len(r.pii[f"{k}_all"]) - len(r.pii[k])))
    assert added == {(0, "phone"): n // 8, (1, "phone"): n // 8, (2, "email"): n // 8, (3, "card"): n // 8}


def test_texts_are_searched_once(spark):
    """Fitting, calibration and scoring read the spans; whole texts are taken by one scan."""
    taken = spark.sparkContext.accumulator(0)

    def counted(text):
        taken.add(1)
        return text

    rows = personal() + [(500 + i, f"{prose(i, 9)} a{i}.b@mail.example.com +1 ({200 + i}) 555-{1000 + i}", "en") for i in range(40)]
    docs = documents(spark, rows).withColumn("text", F.udf(counted, "string").asNondeterministic()("text"))
    found = pii.find_spans(docs)
    assert found.count() == len(rows) and sum(len(r.pii.email) for r in found.collect()) > 40
    assert taken.value == len(rows)


def test_tests_before_the_search_leave_no_span_out(spark):
    rows = personal() + [(900 + i, t, "en") for i, t in enumerate([
        "max{at}mail{dot}net", "bob AT mail DOT org", "jo (At) x", "a::b::c::d", "ab:cd:ef:01", "ab:cd:ef:ff", "1:2:3:4", "12.13.14.15", "1.2.3.0004",
        "11", "1-1", "+1-", "+12", "(0301234567", "1234567", "1  2  3  4  5  6  7", "411111111111 1", "4222222222222", "4 2 2 2 2-2-2-2 22222"])]
    rows += [(1000 + i, t, "en") for i, t in enumerate(t for texts in pii.SEEDS.values() for t in texts)]
    frame, always = pii.with_spans(documents(spark, rows), "text", "got"), F.lit(True)
    for kind in pii.KINDS:
        base = F.filter(pii.spans_of(pii.whole_text(), pii.BASE[kind], always), pii.is_valid(kind))
        every = pii.spans_of(pii.whole_text(), pii.CANDIDATES[kind], always)
        got = frame.select(F.col(f"got.{kind}").alias("base"), F.transform(base, lambda s: F.struct(s["s"], s["e"])).alias("all_base"),
                           F.col(f"got.{kind}_c").alias("some"), every.alias("every")).collect()
        assert any(r.base for r in got) and any(r.some for r in got)
        assert all(r.base == r.all_base and r.some == r.every for r in got)


def test_personal_data_in_nothing(spark):
    empty = documents(spark, [])
    assert pii.find_spans(empty).count() == 0
