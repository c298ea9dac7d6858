"""Manifest, filter audit and nearest neighbours against plain computations."""

import hashlib
import math
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from gradeframe.llm import filter_audit, manifest, neighbours
from tests.llm.cases import clashing, odd_documents, prose

FIVE = "doc_id long, source string, lang string, n_chars long, text string"


def five(rows):
    """(doc_id, source, lang, n_chars, text) with nulls in every column, from (doc_id, text, lang)."""
    sources = ["a", None, "", "Z", "é", "b"]
    return [(d, "a" if i % 3 == 0 else sources[i % 6], lang, None if i % 4 == 1 else len(t or ""), t)
            for i, (d, t, lang) in enumerate(rows)]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append((level[first:at], level[at + 1:first + 3]))
        at //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, coded(r)))
        trees[s] = build([coded(r) for r in groups[s]])
    top, out = build([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            way = siblings(trees[s], i) + siblings(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = coded((*r[:4], text))
            for left, right in way:
                folded = h(*left, folded, *right)
            proof = h(*[x for left, right in way for x in (*left, *right)])
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_manifest_equals_a_plain_tree(spark, stride):
    rows = five(odd_documents()) + [(1000 + i, "hot", "en", 5, prose(i, 3) + "\n" + prose(i + 1, 2)) for i in range(200)]
    rows += [(5000, "lone", None, None, None)]
    random.Random(stride).shuffle(rows)
    docs = clashing(spark.createDataFrame(rows, FIVE).repartition(7), "tree", "at", "node", "path")
    got = [tuple(r) for r in manifest.verify(docs, stride).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows)))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    lone = [(7, None, "en", 3, "a\nb")]
    got = [tuple(r) for r in manifest.verify(spark.createDataFrame(lone, FIVE)).collect()]
    assert got == plain_manifest(lone)
    assert manifest.verify(spark.createDataFrame([], FIVE)).count() == 0


def plain_audit(rows, labels):
    first, failed = {}, []
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    marks = {}
    for d, q, x in labels:
        old = marks.get(d, (0, 0))
        marks[d] = (max(old[0], int(q == 1)), max(old[1], int(x == 1)))
    for d, t, s in rows:
        t = t or ""
        w = [x for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        bad = {c for c, on in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), d is not None and first[t] < d)) if on}
        failed.append((s or "", bad, *marks.get(d, (0, 0))))
    out = {}
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        for p in map("".join, permutations("ABCDE")):
            for i, c in enumerate(p):
                here = [f for f in mine if c in f[1] and not f[1] & set(p[:i])]
                out[part, p, i + 1] = [
                    sum(not f[1] & set(p[:i + 1]) for f in mine), len(here),
                    sum(c in f[1] and bool(f[1] & set(p[:i])) for f in mine), sum(f[1] == {c} for f in mine),
                    sum(f[2] for f in here), sum(f[3] for f in here)]
                removed[c] += len(here)
        for (q, p, i), v in out.items():
            if q == part:
                v.append(removed[p[i - 1]])
    return out


def test_audit_equals_plain_counting(spark):
    rows = [(d, t, "a" if i % 2 else None if i % 4 else "") for i, (d, t, _) in enumerate(odd_documents())]
    copy = prose(9, 60)
    rows += [(100 + i, copy, "hot") for i in range(60)] + [(90, copy + " #", "hot"), (91, copy.upper(), "hot"), (92, "a b " * 40, "hot")]
    labels = [(d, i % 2, i % 3 % 2) for i, (d, _, _) in enumerate(rows)] + [(100, 1, 1), (None, 1, 1), (999, 1, 1), (101, None, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"), "part", "hash", "n", "failed", "first")
    marks = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "good", "text")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(docs, marks).collect()}
    plain = plain_audit(rows, [x for x in labels if x[0] is not None])
    assert len(got) == len(plain) == 600 * len({r[2] or "" for r in rows}) and got == plain


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = filter_audit.audit(one, labels).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.shapley) for r in got] == [("", 0, 1, 120)] + [("", 0, 0, 0)] * 4


def brute(rows, asks, k=5):
    """Every query's k nearest by (score, id); a query's own row left out."""
    by_id = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by_id.setdefault(i, []).append(v)
    ids, x = list(by_id), np.array([min(v) for v in by_id.values()], np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for n, i in enumerate(ids):
        if asks(i):
            near = unit @ unit[n]
            out[i] = sorted(((-round(s, 12), j) for s, j in zip(near.tolist(), ids) if j != i))[:k]
    return out


VECTORS = "vec_id long, embedding array<float>"


def test_neighbours_of_odd_vectors(spark):
    r = np.random.default_rng(5)
    near = r.normal(size=8)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, near.astype(np.float32).tolist()) for i in range(40)]  # one vector, many ids
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [1.0] * 7),
             (204, [None] + [1.0] * 7), (205, [1.0, 2.0]), (206, []), (None, [1.0] * 8), rows[0], rows[0]]
    frame = clashing(spark.createDataFrame(rows, VECTORS).repartition(5), "v", "vec", "id", "score")
    got = {}
    for x in neighbours.nearest(frame, lambda i: i % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((-round(x.score, 12), x.vec_id))
        assert x["rank"] == len(got[x.query_id])
    usable = [(i, v) for i, v in rows if v is None or len(v) == 8]
    assert got == brute(usable, lambda i: i % 5 == 0)


def test_neighbours_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], VECTORS)
    assert [tuple(x) for x in neighbours.nearest(few, lambda i: i == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]
    assert neighbours.nearest(few, lambda i: i > 9).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), lambda i: i == 0).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(4, [1.0, 2.0])], VECTORS), lambda i: i == 4).count() == 0


def test_recall_with_hot_buckets_split(spark, monkeypatch):
    """A third of all vectors close together: the bucket is dealt in blocks and nothing is lost by that."""
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(2000, 32)), r.normal(size=32) + r.normal(size=(1000, 32)) * 0.02]).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], VECTORS)

    def found():
        out = {}
        for row in neighbours.nearest(frame, lambda i: i % 20 == 0).collect():
            out.setdefault(row.query_id, set()).add(row.vec_id)
        return out

    whole = found()
    monkeypatch.setattr(neighbours, "LEAST_HEAVY", 50)
    assert found() == whole
    want = brute([(i, v) for i, v in enumerate(x.tolist())], lambda i: i % 20 == 0)
    met = [len(whole[q] & {j for _, j in near}) for q, near in want.items()]
    assert sum(met) >= 0.95 * 5 * len(want) and all(len(v) == 5 for v in whole.values())


def test_rotations_keep_lengths_and_best_buckets_come_in_order():
    r = np.random.default_rng(3)
    x = r.normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = neighbours.turned(x, 1, 0, 16)
    assert np.allclose(np.linalg.norm(near[:, :16], axis=1), 1) and np.allclose(near[:, :16], -near[:, 16:])
    axes = [16, 4]
    sums = (near[:, :, None] + neighbours.turned(x, 1, 1, 4)[:, None, :]).reshape(20, -1)
    assert (neighbours.best_buckets(x, 1, axes, 9) == np.argsort(-sums, axis=1, kind="stable")[:, :9]).all()
    assert (neighbours.own_bucket(x, 1, axes) == sums.argmax(axis=1)).all()


def test_query_over_a_folder_against_brute_force(spark, tmp_path):
    """``op13_neighbours``: ranks, exact scores and a recall of nine tenths at least."""
    from gradeframe.llm import checks

    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    x[500:900] = x[7]  # one vector of many rows
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    spark.createDataFrame(rows, VECTORS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for row in checks.op13_neighbours(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        a, b = x[row.query_id].astype(np.float64), x[row.vec_id].astype(np.float64)
        assert row.score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)
        got.setdefault(row.query_id, []).append((-round(row.score, 12), row.vec_id))
        assert row["rank"] == len(got[row.query_id])
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want) and all(len(v) == 5 and v == sorted(v) for v in got.values())
    met = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert met >= 0.95 * 5 * len(want)
    assert got[500] == want[500]  # copies come first, smaller ids before larger
