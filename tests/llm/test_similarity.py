"""The similarity joins and components against brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("chronoweave.llm")

from chronoweave.llm import ngram_join  # noqa: E402
from chronoweave.llm._graph import components  # noqa: E402
from chronoweave.llm.cap_filters import ProductCode, near_vectors  # noqa: E402
from chronoweave.llm.ngram_join import ngram_jaccard_join  # noqa: E402


def lowest(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n,m", [(30, 20), (200, 150), (60, 0)])
def test_components(spark, n, m):
    rng = random.Random(n)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + m // 2)]
    want = lowest({x for l in links for x in l}, links)  # noqa: E741
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()))
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in links)}


def texts():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    make = lambda n: [word() for _ in range(n)]
    out = [None, "", " \n ", "one two", "ONE  two", "one two three four five", "One two\nthree four FIVE"]
    for _ in range(12):
        base = make(rng.choice([5, 6, 20, 60, 120]))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    passage = make(30)
    out += [" ".join(passage + make(rng.randint(3, 40))) for _ in range(40)]
    cluster = make(80)
    for _ in range(60):  # one large group of near copies, not all linked directly
        copy = list(cluster)
        for _ in range(3):
            copy[rng.randrange(80)] = word()
        out.append(" ".join(copy))
    return out + ["exact copy of a text with some words"] * 30 + ["x y " * 3000, "x y " * 3001]


def sets(ts):
    out = []
    for t in ts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    return out


def check_join(spark):
    ts = texts()
    s = sets(ts)
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    want = lowest(range(len(ts)), links)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(ts)], "doc_id long, text string, n int, comp int, a int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()}
    assert got == {i: (len(s[i]), want[i]) for i in range(len(ts))}


def test_ngram_join(spark):
    check_join(spark)


def test_near_copies_are_not_left_to_the_last_turn(spark, monkeypatch):
    """One large group of near copies beside many pairs that almost link, so that few proposed pairs do."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def copy(base, places):
        out = list(base)
        for at in places:
            out[at] = f"c{rng.randrange(10**6)}"
        return " ".join(out)

    cluster, ts = make(200), []
    for _ in range(160):
        ts.append(copy(cluster, rng.sample(range(200), 3)))
    for _ in range(120):  # 29 of 196 shingles differ: 0.742
        base = make(200)
        ts += [" ".join(base), copy(base, range(50, 75))]
    s = sets(ts)
    links = [(a, b) for a in range(len(s)) for b in range(a) if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    want = lowest(range(len(ts)), links)
    counts, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "MEET", 8, raising=False)  # as for a larger group
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, texts, count, *how: counts.append(count) or verified(pairs, texts, count, *how))
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs).collect()} == want
    assert sum(counts) < 3 * len(ts) < len(links), counts


def test_last_turn_alone(spark, monkeypatch):
    """Without turns of nearest pairs, few entries a task, and common shingles dealt in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    monkeypatch.setattr(ngram_join, "SHARE", 500)
    monkeypatch.setattr(ngram_join, "TURNS", 0)
    check_join(spark)


def test_join_of_repeats_and_nothing(spark):
    schema = "doc_id long, text string"
    assert ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (3, None)]
    got = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (None, 1, None), (3, 0, 3)], key=str)
    # one id with two texts is one node, linked by either
    long = [" ".join(f"{k}{i}" for i in range(60)) for k in "ab"]
    rows = [(9, long[0]), (9, long[1]), (2, long[0] + " x"), (4, long[1] + " y"), (2**60 + 1, "q"), (None, "r")]
    got = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(9, 56, 2), (9, 56, 2), (2, 57, 2), (4, 57, 2), (2**60 + 1, 1, 2**60 + 1), (None, 1, None)], key=str)


def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    near = np.repeat(x[:20], 6, 0) + rng.standard_normal((120, 64)) * rng.choice([0.1, 0.25, 0.3, 0.4], (120, 1))
    return np.concatenate([x, near, x[:30], 7.5 * x[5:8]]).astype(np.float32)


def test_near_vectors(spark):
    x = vectors().astype(np.float64)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]]
    rows = [(i, [float(v) for v in r], 0, "x") for i, r in enumerate(x)] + [(1000 + i, v, 0, "x") for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id string").repartition(3)
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.95)) if a != b}
    degree = {i: 0 for i in range(len(x))}
    for a, _ in true:
        degree[a] += 1
    assert all(got[i].n_links <= degree[i] for i in degree)
    assert sum(got[i].n_links for i in degree) >= 0.97 * len(true)
    assert got[1006].n_links == 1 and got[1007].component_id == 1006 and not got[1007].kept and got[1008].n_links == 0
    assert all(got[1000 + k].n_links == 0 and got[1000 + k].kept for k in range(6))
    assert near_vectors(table.limit(0)).count() == 0


def test_counts_of_a_large_group(spark):
    """A ball's links are counted, not compared; those of vectors round it are compared."""
    rng = np.random.default_rng(9)
    center = rng.standard_normal(64) / 8
    x = np.concatenate([center + rng.standard_normal((400, 64)) * 0.01, center + rng.standard_normal((60, 64)) * 0.045, rng.standard_normal((300, 64))])
    x = np.concatenate([x, x[:40]])
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = u @ u.T >= 0.95
    degree = true.sum(1) - 1
    assert all(got[i].n_links == degree[i] for i in range(400) if not true[i, 400:460].any())
    assert all(got[i].n_links <= degree[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.99 * degree.sum()
    assert {got[i].component_id for i in range(400)} == {0} and got[760].component_id == 0 and not got[760].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in range(460, 760))


def test_large_and_null_vector_ids(spark):
    rows = [(2**60 + 1, [1.0, 2.0]), (None, [2.0, 4.0]), (None, [5.0, -1.0]), (None, None), (7, [1.0, 2.1]), (7, [-3.0, 1.0])]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(2**60 + 1, 2, 7, False), (None, 2, 7, False), (None, 0, None, False), (None, 0, None, False), (7, 2, 7, True), (7, 0, 7, True)], key=str)


def test_list_decoding_is_whole():
    """All filters above the height, by comparing every one of them."""
    code = ProductCode(12, 4, per_vector=8)
    x = np.random.default_rng(1).standard_normal((20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = code.codes
    grid = np.stack([code.words[b][np.arange(c**4) // c ** (3 - b) % c] for b in range(4)], 1).reshape(c**4, -1)
    scores = (x @ code.rotation) @ grid.T
    for row, found in zip(scores, code.decode(x)):
        want = set(np.flatnonzero(row >= code.height))
        assert set(found) == want if len(want) >= code.at_least else len(found) >= min(code.at_least, len(row))
