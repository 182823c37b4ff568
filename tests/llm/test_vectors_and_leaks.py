"""Decontamination, clustering and whitening on small fixtures against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from almanac.llm import clusters, decontaminate, vectors, whitening

DOCS = "doc_id long, text string, runs string, row long, n_items int, start int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(docs, items):
    """By the contract's words: every window of every item sought at every place of every text."""
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i : i + size]))
                if got:
                    hit |= set(range(i, i + size))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(11)
    say = lambda n, of=40: " ".join(f"w{r.randrange(of)}" for _ in range(n))
    long_item, other = say(60, 4000), say(25, 4000)
    items = [(1, long_item), (2, other), (3, "Seven words, no more: than that here"), (4, "one"), (5, ""), (6, None), (7, long_item), (None, other + " tail"), (2, "a second text of item two with eleven words in it"), (8, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab"), (9, "naïve café 漢字 x" * 3)]
    w = long_item.split()
    texts = [
        long_item, say(30, 4000) + " " + long_item.upper() + "! " + say(5, 4000), " ".join(w[7:16]), " ".join(w[7:17]), " ".join(w[20:31]) + " zz " + " ".join(w[29:45]), "; ".join(other.split()), None, "", " \n\t", "ONE", "two",
        "seven-words no more than that here", "x seven words no more than that here y", "ab " * 30, "ab " * 9, say(400), " ".join([say(3000, 4000), long_item, say(3000, 4000)]), "naïve café 漢字 xnaïve café 漢字 xnaïve café 漢字 x", "\x80\x85 w1", long_item[: len(long_item) // 2] + "\x00" + long_item[len(long_item) // 2 :], " ".join(w[:12] + ["odd"] + w[12:22]),
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, long_item), (3, texts[3]), (3, texts[4])]
    return docs, items


def test_leaks_equal_brute_force(spark, leaks):
    docs, items = leaks
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in docs], DOCS)
    benchmark = spark.createDataFrame([(i, t, "y", 5) for i, t in items], "item_id long, text string, words string, size int")
    got = decontaminate.decontaminate(df, benchmark)
    rows = got.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r)[:6] for r in rows], key=key) == sorted(brute_leaks(docs, items), key=key)
    for r in rows:
        assert sum(e - s for s, e in r.hit_spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.hit_spans, r.hit_spans[1:]))


def test_leaks_of_empty_tables(spark, leaks):
    docs, items = leaks
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(df.limit(0), benchmark).collect() == []
    none = decontaminate.decontaminate(df, benchmark.where("item_id = 5")).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in none)


def test_equal_windows_have_equal_fingerprints():
    r = random.Random(5)
    for _ in range(50):
        span = [f"w{r.randrange(6)}".encode() for _ in range(10)]
        a, b = ([f"v{r.randrange(9)}".encode() for _ in range(r.randrange(20))] for _ in range(2))
        of = lambda w: decontaminate.fingerprints(decontaminate.hashes(w))
        assert of(a + span + b)[len(a)] == of(b + span + a)[len(b)] == of(span)[0]


def test_a_full_map_changes_no_result(spark, leaks, monkeypatch):
    """With 64 bits for all fingerprints nearly every window is a candidate; the words decide."""
    docs, items = leaks
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small = decontaminate.bit_map
    monkeypatch.setattr(decontaminate, "bit_map", lambda windows: small(windows, 6))
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r)[:6] for r in decontaminate.decontaminate(df, benchmark).collect()], key=key) == sorted(brute_leaks(docs, items), key=key)


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    of = assign()
    d = [far(v, centroids[o]) for (_, v), o in zip(kept, of, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, o, x, sum(y for y, p in zip(d, of, strict=True) if p == o), sum(d), sha[o]) for (i, _), o, x in zip(kept, of, d, strict=True)]


VECTORS = "vec_id long, embedding array<float>, id string, v int, cluster string"


@pytest.fixture(scope="module")
def embedded():
    r = random.Random(12)
    rows = [(i, [r.gauss(0, 0.2) + (i % 5) * 0.1 for _ in range(64)]) for i in range(200)]
    flat = [0.25] * 64
    rows += [(1000 + i, flat) for i in range(30)] + [(300, None), (301, [None] + flat[1:]), (302, [float("nan")] + flat[1:]), (303, [float("inf")] + flat[1:]), (304, flat[:63]), (305, flat + [0.0]), (306, []), (None, [0.5] * 64), (5, rows[5][1]), (5, rows[6][1]), (307, [-0.0] * 64), (308, [100000.0] + [0.0] * 63)]
    return rows


def test_clusters_equal_brute_force(spark, embedded):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in embedded], VECTORS)
    as_floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in embedded]
    got = sorted(map(tuple, clusters.cluster(df.repartition(7)).collect()), key=str)
    assert got == sorted(brute_clusters(as_floats), key=str)


def test_few_vectors_and_none(spark, embedded):
    df = spark.createDataFrame(embedded[:3], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, clusters.cluster(df).collect()), key=str) == sorted(brute_clusters(embedded[:3]), key=str)
    assert clusters.cluster(df.limit(0)).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0] * 64) for i in range(20)], "vec_id long, embedding array<double>")
    assert {(r.cluster, r.distance, r.inertia) for r in clusters.cluster(same).collect()} == {(0, 0, 0)}


def test_intervals_hold_the_exact_score_and_ties_go_to_the_smaller_number():
    r = np.random.default_rng(1)
    for size in (50, 2**20, vectors.LARGEST):
        x, c = r.integers(-size, size + 1, (200, 64)), r.integers(-size, size + 1, (8, 64))
        c[5] = c[2]
        low, high = clusters.intervals(x, c)
        exact = [[sum(int(b) ** 2 for b in cc) - 2 * sum(int(a) * int(b) for a, b in zip(xx, cc, strict=True)) for cc in c] for xx in x]
        assert all(low[i, j] <= exact[i][j] <= high[i, j] for i in range(200) for j in range(8))
        of, unsure = clusters.nearest(x, c)
        assert of.tolist() == [min(range(8), key=lambda j: (e[j], j)) for e in exact] and 5 not in of and unsure > 0


def test_large_entries_are_refused(spark):
    df = spark.createDataFrame([(1, [2e5] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="within 131072 of zero"):
        clusters.cluster(df).collect()


def test_whitening_against_numpy(spark, embedded):
    rows = [r for r in embedded if r[0] != 308]
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], VECTORS).where("vec_id is null or vec_id not in (304, 305, 306)")
    good = [(i, [math.floor(1024 * float(np.float32(e))) + 100000 for e in v]) for i, v in rows if i not in (304, 305, 306) and v and all(e is not None and math.isfinite(e) for e in v)]
    n, sums = len(good), [sum(c) for c in zip(*(v for _, v in good), strict=True)]
    x = np.array([v for _, v in good], float) - np.array(sums) / n
    values, columns = np.linalg.eigh(x.T @ x / n)
    got = whitening.whiten(df.repartition(5)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    deviations = sorted((str(i), sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True))) for i, v in good)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == deviations
    for k in range(1, 9):
        mine = [r for r in got if r.component == k]
        assert mine[0].explained == pytest.approx(values[-k] / values.sum(), rel=1e-9)
        want = x @ columns[:, -k] / math.sqrt(values[-k])
        order = sorted(range(n), key=lambda a: (str(good[a][0]), round(abs(want[a]), 6)))
        a = np.array([r.whitened for r in sorted(mine, key=lambda r: (str(r.vec_id), round(abs(r.whitened), 6)))])
        b = want[order]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_flat_components_and_single_rows(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5]), (3, None)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, whitening.whiten(one).collect())) == [(1, 1, 1, 0, None, 0.0, None), (1, 2, 1, 0, None, 0.0, None)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in got) and {r.explained for r in got} == {1.0, 0.0}


def test_jacobi_keeps_small_deviations():
    r = np.random.default_rng(3)
    scale = 10.0 ** -np.arange(0, 12)
    a = np.triu(r.normal(size=(12, 12))) * scale
    lengths, v = whitening.jacobi(a)
    assert np.abs(v.T @ v - np.eye(12)).max() < 1e-13
    turned = a @ v
    cosines = (turned / np.linalg.norm(turned, axis=0)).T @ (turned / np.linalg.norm(turned, axis=0))
    assert np.abs(cosines - np.eye(12)).max() < 1e-12 and all(np.diff(lengths) <= 0)
