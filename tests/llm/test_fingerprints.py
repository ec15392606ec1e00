"""Operators 11 to 13 against brute force, with odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridskein.llm import centroids, merkle, queries, spotsigs

from ..oracle import DATA, compare, connect

# 11 SpotSigs


def _signatures(text, chain=3):
    """The set of signatures in plain Python."""
    anchors = set(spotsigs.common_words())
    words = re.findall(r"[a-z0-9_\w]+", (text or "").lower())
    content = [w for w in words if w not in anchors]

    def hashed(parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        return h >> 16

    if not words:
        return set()
    if sum(w in anchors for w in words) * spotsigs.SPARSE < len(words):
        return {hashed(words[k : k + chain + 1]) for k in range(len(words))}
    found, seen = {hashed(["", *content[:chain]])}, 0
    for w in words:
        if w in anchors:
            found.add(hashed([w, *content[seen : seen + chain]]))
        else:
            seen += 1
    return found


def _likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = ["The house of the big dog is in a tree.", None, "", "the of", "xx yy zz", "x", "Über die Häuser, und über den Fluß!", "\n \t", "the " + "long words of it " * 5000, "日本語 の テキスト", "The house of the big dog is in a tree."]


@pytest.mark.parametrize("span", [512, 3])
def test_edited_likeness(spark, monkeypatch, span):
    monkeypatch.setattr(spotsigs.with_next, "__defaults__", (span,))
    rows = [(7 * k if k != 5 else None, t, [k]) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in spotsigs.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string, sigs array<int>")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    for k, (doc_id, text, _) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited, row = text[: len(text) - half] + following[:half], got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed = _signatures(text), _signatures(edited)
        assert row.fingerprint == "".join(f"{s:012x}" for s in sorted(own)) and row.edited_fingerprint == "".join(f"{s:012x}" for s in sorted(changed))
        assert row.near_edited == pytest.approx(_likeness(own, changed)) and row.near_next == pytest.approx(_likeness(own, _signatures(following)))


def test_edited_likeness_of_few_rows(spark):
    schema = "doc_id int, text string"
    assert spotsigs.edited_likeness(spark.createDataFrame([], schema)).count() == 0
    one = spotsigs.edited_likeness(spark.createDataFrame([(3, "abcd")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    same = spotsigs.edited_likeness(spark.createDataFrame([(3, "the cat"), (3, "the cat"), (3, "a dog")], schema)).collect()
    assert len(same) == 3


def test_similar_documents(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "and"] * 6
    base = [[rng.choice(words) for _ in range(rng.randint(1, 70))] for _ in range(25)]
    docs = []
    for k in range(160):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((k, " ".join(text)))
    docs += [(200, ""), (201, None), (202, "the"), (203, "the")]
    members, links = spotsigs.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    sets = {k: frozenset(_signatures(t)) for k, t in docs}
    classes = {k: min(o for o in sets if sets[o] == s) for k, s in sets.items()}
    assert {r.doc_id: r.class_id for r in members.collect()} == classes
    firsts = sorted(set(classes.values()))
    want = {(a, b): _likeness(sets[a], sets[b]) for a, b in itertools.combinations(firsts, 2) if _likeness(sets[a], sets[b]) >= 0.8}
    got = links.collect()
    assert want and {(r.a, r.b): r.likeness for r in got} == pytest.approx(want) and len(got) == len(want)
    assert spotsigs.similar_documents(spark.createDataFrame([], "doc_id long, text string"))[1].count() == 0


def test_fingerprints_without_python_workers(spark):
    plan = spotsigs.edited_likeness(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") <= 2


# 12 Merkle manifest


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_digest(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


@pytest.mark.parametrize("tier", [6, 2, 1])
def test_manifest(spark, monkeypatch, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    monkeypatch.setattr(merkle, "SPAN", 3**tier)
    monkeypatch.setattr(merkle, "_POWERS", [3**k for k in range(tier + 1)])
    rng = random.Random(3)
    sizes = {None: 5, "a": 1, "b": 2, "ü": 28, "z": 9, "": 82, "=": 243, "c": 4}
    rows = [(k if k % 97 else None, s, rng.choice([None, "x\ny", "", "t\n", "é" * 9])) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [rows[0], rows[200], rows[200]]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, leaf string").repartition(5)
    cut = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.dataset_manifest(df, "doc_id", "source", ["doc_id", "source", "text"], "text", cut).collect()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: _digest(*map(part, (r[0], r[1], t)))
    by = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[2]))) for s in sizes}
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([leaf(r, r[2]) for r in by[s]]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    want = []
    for k, s in enumerate(names):
        for at, r in enumerate(by[s]):
            path = _siblings(trees[s], at) + _siblings(top, k)
            node = leaf(r, r[2].replace("\n", "") if r[2] and r[0] is not None and r[0] % 2 == 0 else r[2])
            for before, after in path:
                node = _digest(before, node, after)
            want.append((r[0], s, leaf(r, r[2]), trees[s][-1][0], top[-1][0], _digest(*[a + b for a, b in path]), node, node == top[-1][0]))
    got = [(r.id, r.group, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found]
    # Rows equal in all come in any order.
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(not r.verified for r in found) and all(r.verified for r in found if r.id is None or r.id % 2)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, text string"
    empty = merkle.dataset_manifest(spark.createDataFrame([], schema), "doc_id", "source", ["doc_id", "text"], "text")
    assert empty.count() == 0
    one = merkle.dataset_manifest(spark.createDataFrame([(1, None, None)], schema), "doc_id", "source", ["doc_id", "text"], "text").collect()
    assert [(r.leaf, r.subroot, r.root, r.proof_sha256, r.verified, r.path) for r in one] == [(_digest("1:1-"),) * 3 + (_digest(""), True, [])]


def test_ranks_within_groups(spark):
    from gridskein.operators.ranks import ranked

    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), rng.choice([None, *range(50)])) for _ in range(500)]
    found = ranked(spark.createDataFrame(rows, "g string, v long").repartition(7), "v", within=("g",)).collect()
    for g in "ab":
        mine = sorted((r for r in found if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert [r.v for r in mine] == sorted((r.v for r in mine), key=lambda v: (v is not None, v or 0))


# 13 centroids


def _cluster(vectors, clusters, rounds):
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:clusters]]
    dist = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min((dist(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in vectors]
        for k in range(len(centres)):
            mine = [v for (_, v), c in zip(vectors, of, strict=True) if c == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in vectors]
    total = sum(d for _, d, _ in found)
    return sorted(((i, c, d, sum(e for _, e, k in found if k == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found), key=repr)


@pytest.mark.parametrize("spread", [1.0, 1e-9, 3e4])
def test_clusters(spark, spread):
    rng = np.random.default_rng(2)
    rows = [(k if k % 50 else None, [float(x) for x in rng.normal(size=10) * spread + (k % 4) * spread]) for k in range(300)]
    rows += rows[:3]
    bad = [(900, None), (901, []), (902, [1.0] * 9), (903, [1.0] * 11), (904, [None] + [1.0] * 9), (905, [float("nan")] * 10), (906, [float("-inf")] * 10), (907, [1e30] * 10)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found = centroids.cluster_vectors(df, dims=10, clusters=7)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    got = found.collect()
    assert sorted(((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=repr) == _cluster(whole, 7, 3)
    assert all(1 <= r.n_exact <= 7 for r in got)
    if spread == 1:
        assert sum(r.n_exact for r in got) < 7 * len(got) * 0.95


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(4)
    for size in (3, 1000, 2**27):
        a, b = rng.integers(-size, size + 1, (200, 64)), rng.integers(-size, size + 1, (30, 64))
        b[:10] = a[:10]
        bounds = centroids.lower_bounds(centroids.segment_norms(a), centroids.segment_norms(b))
        exact = ((a[:, None].astype(object) - b[None].astype(object)) ** 2).sum(2)
        assert (bounds <= exact.astype(float) * (1 + 1e-15)).all() and (bounds[np.arange(10), np.arange(10)] == 0).all()
        nearest, best, tried = centroids.nearest_centroids(a, centroids.segment_norms(a), b)
        assert [(int(d), int(k)) for d, k in zip(best, nearest, strict=True)] == [min((int(d), k) for k, d in enumerate(row)) for row in exact]


def test_clusters_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    few = centroids.cluster_vectors(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], schema)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in few] == [(0, 0, 0)] * 2


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_centroid_clustering"])
def test_registered_queries_equal_sql(spark, name):
    con = connect(f"{DATA}/sf0.001")
    assert compare(con, queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), queries.ORACLE_SQL[name]) == ""


def test_tampering_shows_where_lines_end(spark):
    rows = queries.op12_merkle_manifest(spark, f"{DATA}/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    assert all(r.verified == ("\n" not in (texts[r.doc_id] or "") or zlib.crc32(str(r.doc_id).encode()) % 2 == 1) for r in rows)
