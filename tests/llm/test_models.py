"""Quality classifier, whitening and Merkle manifest against brute force, on odd rows."""

import zlib
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmill.llm import classifier, manifest, whitening

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, pos long, quality int, score string, item string, path int"
ODD = [None, "", " ", "\n\n", "x", "a | b | c", "ÄÖ 中文🎉 ß", "w " * 20_000, "###", "one\ntwo\none\ntwo"]


def documents(spark, rows):
    """rows: (doc_id, source, text)."""
    return spark.createDataFrame([(d, s, "en", len(t or ""), t, "k", 1, 1, "s", "i", 0) for d, s, t in rows], DOCS)


# --- quality classifier


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_statistics_of_plain_cases():
    odds = lambda k, n, p: np.log((k + p) / (n - k + 20 * p))
    got = classifier.statistics(b"a b b\na b b\n!? # 7 B\n")
    want = [odds(1, 21, 1), odds(1, 7, 1), odds(2, 10, 0.5), odds(1, 21, 0.5), odds(0, 10, 0.5), odds(2, 10, 0.5), odds(1, 3, 0.5), odds(1, 10, 0.5), np.log((21 - 10 + 5) / 11), np.log(71 / 4)]
    assert np.allclose(got, want)
    whole = classifier.statistics(b"ab c " * 500_000)
    assert np.allclose(whole[0], odds(0, 2_500_000, 1)) and np.allclose(whole[8], np.log((1_500_000 + 5) / 1_000_001))


def test_scores_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, label = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    learned = [k for k in label if not held(k)]
    x, y = np.array([classifier.statistics((texts[k] or "").encode()) for k in learned]), np.array([label[k] for k in learned])
    spread, logs = x.var(0), []
    every = np.array([classifier.statistics((t or "").encode()) for t in texts.values()])
    for k in (0, 1):
        own = x[y == k]
        drawn = classifier.STRENGTH / (classifier.STRENGTH + len(own))
        c = (1 - drawn) * np.cov(own.T, bias=True) + np.diag(drawn * spread + 1e-6)
        apart = every - own.mean(0)
        logs.append(np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,ij->i", apart, np.linalg.solve(c, apart.T).T))
    want = dict(zip(texts, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), strict=True))
    got = classifier.judge(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-7 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id)
    right = [r.predicted == label[r.doc_id] for r in got if r.held_out and r.doc_id in label]
    assert len(right) > 50 and np.mean(right) >= 0.95


def test_classifier_on_odd_rows(spark):
    good, bad = "Plain words stand in this line, as they do.", "X | Y | Z | %%% | ### | Q"
    rows = [(k, "s", (good if k % 2 else bad) + " w" * (k % 7)) for k in range(200)] + [(1000 + k, None, t) for k, t in enumerate(ODD)] + [(None, "s", "a b"), (3, "s", good)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(5, 1, 0), (6, 1, 1), (None, 1, 0), (7, None, 0), (8, 4, 0)], "doc_id long, quality int, toxic int")
    got = classifier.judge(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _ in rows)
    assert all(0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out
    same = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(same) == 1
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200]) > 0.95
    for some, score in ((labels.where("quality = 0"), 0.0), (labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        assert {r.score for r in classifier.judge(docs, some).collect()} == {score}
    assert classifier.judge(docs.limit(0), labels).count() == 0


# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, n long, component int")


def whitened(rows):
    """Per row and component: deviation, whitened and explained, by one dense matrix."""
    x = np.floor(64 * np.array(rows, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    apart = n * x - s
    values, components = np.linalg.eigh((apart / n).T @ (apart / n) / n)
    order = np.argsort(-values)
    return np.square(apart).sum(1), (apart / n) @ components[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("d", [3, 40, 130])
def test_whitening_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    rows = (rng.normal(size=(400, d)) * (1 + np.arange(d)[::-1]) + rng.normal(size=d)).astype(np.float32).tolist()
    rows += rows[:30]
    got = whitening.whiten(vectors(spark, rows)).collect()
    deviation, y, explained = whitened(rows)
    k = min(d, 32)
    assert len(got) == len(rows) * k
    sign = {r.component: np.sign(r.whitened * y[0, r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        assert (r.n, r.deviation) == (len(rows), deviation[r.vec_id])
        assert abs(r.whitened * sign[r.component] - y[r.vec_id, r.component - 1]) < 1e-6
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 4)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, 2.0, float("inf"), 0.0], [1.0, 2.0], [1.0] * 5]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    assert {r.vec_id for r in got} == set(range(50)) and {r.n for r in got} == {50} and len(got) == 200
    flat = [[a, b, a + b, 1.0] for a, b in rng.integers(-9, 9, size=(40, 2)).astype(float).tolist()]  # rank two
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-9
    for none in (odd[:5], [[1.0, 2.0]] * 3, [[1.0, 2.0]], []):
        assert whitening.whiten(vectors(spark, none)).count() == 0


# --- Merkle manifest


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def row_digest(d, s, t, offered):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*map(shown, (d, s, "en", len(t or ""), offered)))


def tree(nodes):
    """The root, and each node's siblings as (left, right) per level."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    root, above = tree([digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)])
    side = lambda k: ("".join(nodes[k - k % 3 : k]), "".join(nodes[k + 1 : k - k % 3 + 3]))
    return root, [[side(k), *above[k // 3]] for k in range(len(nodes))]


def audited(rows):
    by_source = {}
    for d, s, t in rows:
        off = t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t
        by_source.setdefault(s, []).append((d is not None, d or 0, row_digest(d, s, t, t), row_digest(d, s, t, off), d))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = [tree([x[2] for x in sorted(by_source[s])]) for s in names]
    root, upper = tree([b[0] for b in built])
    out = []
    for s, (subroot, low), high in zip(names, built, upper, strict=True):
        for (_, _, leaf, off, d), path in zip(sorted(by_source[s]), low, strict=True):
            h = off
            for left, right in path + high:
                h = digest(left, h, right)
            out.append((d, leaf, subroot, root, digest(*(x for p in path + high for x in p)), h, h == root))
    return sorted(map(repr, out))


def audit(docs):
    out = manifest.audit(docs, manifest.without_newlines(F.col("doc_id"), F.col("text")))
    return sorted(repr(tuple(r)) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    """One level a block makes a layer of each level of the tree; nulls, repeats, lone leaves and a source with most rows."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = [(k * 7 % 401 - 50, "hot", f"line {k}\nmore") for k in range(300)] + [(k, f"s{k % 5}", "a\nb" * (k % 3)) for k in range(40)] + [(900 + k, ["", "ä", "z", "Z", "\U0001f600", "￮"][k % 6], t) for k, t in enumerate(ODD)]
    rows += [(5, None, None), (None, None, "x\ny"), (None, "hot", "q\n"), (None, "hot", None), rows[3], rows[3], (rows[3][0], "hot", "another\ntext")]
    assert audit(documents(spark, rows)) == audited(rows)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, None, "a\nb")], [(2, "s", None), (2, "s", None)], [(k, "s", "t\n") for k in range(4)]):
        assert audit(documents(spark, rows)) == (audited(rows) if rows else [])


def test_traversal_holds_few_digests():
    """A block's paths, and digests held: within seven a level, whatever the number of leaves."""
    for m, levels in ((1, 0), (1, 3), (2, 1), (3, 1), (4, 2), (26, 3), (27, 3), (200, 5), (700, 6), (729, 6), (729, 7)):
        values, seen = [digest(str(k)) for k in range(m)], []
        got = [[(p["left"], p["right"]) for p in path] for path in manifest.paths(values, levels, seen)]
        nodes, want = values, [[] for _ in values]
        for level in range(levels):
            for k in range(m):
                at = k // 3**level
                want[k].append(("".join(nodes[at - at % 3 : at]), "".join(nodes[at + 1 : at - at % 3 + 3])))
            nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        assert got == want and max(seen) <= 7 * max(levels, 1)
        assert levels == 0 or all(len(a) == len(b) == levels for a, b in pairwise(got))
