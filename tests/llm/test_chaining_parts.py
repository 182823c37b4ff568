"""The array forms of op8's inner steps against plain loops."""

import numpy as np

from almanac.llm import chaining
from almanac.llm.packed import mix


def test_pairs_tried_are_all_that_have_a_bit_in_common():
    """Keys with few pairs, tried together, and one with more than a table holds, each against a double loop."""
    r = np.random.default_rng(3)
    groups = [1, 5, 2, 900, 40, 3]
    bits = lambda n: np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    asks, lo, hi, start = [], [], [], 0
    for n in groups:
        for g in range(1, n):
            asks.append(start + g), lo.append(start), hi.append(start + g)
        start += n
    l, rr, lh, rh = (bits(start) for _ in range(4))
    asks, lo, hi = np.array(asks), np.array(lo), np.array(hi)
    assert (hi - lo).sum() > 2 * chaining.TABLE
    wanted = {(i, g) for i, a, b in zip(asks.tolist(), lo.tolist(), hi.tolist(), strict=True) for g in range(a, b) if int(l[i]) & int(lh[g]) or int(rr[i]) & int(rh[g])}
    got = [pair for i, g in chaining.tried(asks, lo, hi, l, rr, lh, rh) for pair in zip(i.tolist(), g.tolist(), strict=True)]
    assert len(got) == len(wanted) and set(got) == wanted
    none = np.empty(0, np.int64)
    assert list(chaining.tried(none, none, none, l, rr, lh, rh)) == []


def test_bits_around_against_plain_loops():
    r = np.random.default_rng(4)
    h, doc, at = [], [], []
    for d in range(12):
        p = np.unique(r.integers(0, 400, 90))
        h += r.choice(np.arange(3, 3 + (20 if d % 2 else 400)), len(p)).tolist()
        doc += [d] * len(p)
        at += p.tolist()
    h, doc, at = mix(np.array(h, np.uint64)), np.array(doc), np.array(at, np.uint32)
    # The words 100 to 200 of even documents are covered, and 30 to 50 of all.
    place = at.astype(int)
    inside = np.where((place >= 30) & (place + chaining.K <= 50), 2 * doc, np.where((doc % 2 == 0) & (place >= 100) & (place + chaining.K <= 200), 2 * doc + 1, -1))
    of = np.flatnonzero(r.random(len(h)) < 0.8)
    got = chaining.around(h, doc, at, of, inside)
    cut = [k for k in range(len(h)) if not k or doc[k] != doc[k - 1] or place[k] - place[k - 1] > 2 * chaining.K]
    block = [sum(c <= k for c in cut) for k in range(len(h))]
    span = {b: [place[k] for k in range(len(h)) if block[k] == b] for b in set(block)}
    length = {b: max(p) + chaining.K - min(p) for b, p in span.items()}
    bit = lambda x, m: 1 << (int(mix(np.array([x], np.uint64))[0]) >> (6 * m + 64 - 6 * chaining.MAPS) & 63)
    context, far = {}, chaining.FAR + chaining.SLACK
    for k, i in enumerate(of.tolist()):
        near = [j for j in range(len(h)) if j != i and doc[j] == doc[i] and abs(place[j] - place[i]) <= far]
        context[k] = frozenset((int(h[j]), place[j] - place[i]) for j in near)
        for side in (0, 1):
            wanted, seen = np.zeros((3, chaining.MAPS), object), set()
            for j in sorted((j for j in near if (j > i) == bool(side)), key=lambda j: abs(j - i)):
                d = abs(place[j] - place[i])
                value = ~h[j] if h[j] in seen else h[j]
                seen.add(h[j])
                ask = d <= chaining.FAR and (block[j] != block[i] if length[block[i]] < chaining.BLOCK else d >= chaining.NEAR)
                across = ask and (inside[j] < 0 or inside[j] != inside[i])
                for n, ok in enumerate((ask, across, d >= chaining.NEAR - chaining.SLACK)):
                    for m in range(chaining.MAPS):
                        wanted[n, m] |= bit(value, m) if ok else 0
            assert [got[3 * side + n][k].tolist() for n in range(3)] == wanted.tolist()
        assert got[7][k] == (1 if chaining.LITTLE <= length[block[i]] < chaining.BLOCK else 2)
    like = got[6].tolist()
    assert all((like[a] == like[b]) == (context[a] == context[b]) for a in range(0, len(of), 7) for b in range(len(of)))


def test_runs_of_many_pairs_at_once():
    # Pair 0: a diagonal that overlaps, touches, and goes on after a gap; pair 1: two diagonals, the same places.
    x = np.array([0, 2, 6, 11, 0, 1, 0])
    y = np.array([5, 7, 11, 16, 5, 6, 9])
    got = chaining.merged(np.array([0, 0, 0, 0, 1, 1, 1]), x, y)
    assert list(zip(*(c.tolist() for c in got), strict=True)) == [(0, 0, 5, 10), (0, 11, 16, 4), (1, 0, 5, 5), (1, 0, 9, 4)]


def test_seeds_of_many_texts_do_not_cross_them():
    r = np.random.default_rng(6)
    texts = [r.integers(0, 2**63, n).astype(np.uint64) for n in (0, 3, 60, 4, 1, 0, 2, 90, 3)]
    one = [chaining.seeds([t]) for t in texts]
    h, of, at = chaining.seeds(texts)
    assert h.tolist() == [x for s in one for x in s[0].tolist()] and at.tolist() == [x for s in one for x in s[2].tolist()]
    assert of.tolist() == [k for k, s in enumerate(one) for _ in s[0]]
    assert len(h) and [len(x) for x in chaining.seeds([])] == [0, 0, 0]


def test_words_are_numbered_once_for_all_rounds(spark):
    """The grouped texts hold numbers, from which seeds come as they do from the texts."""
    from almanac.llm.packed import by_group, scratch, with_group

    docs = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(80))), (2, "a " + " ".join(f"w{i}" for i in range(80))), (3, None)], "doc_id long, text string")
    with scratch(spark):
        plain = with_group(docs, 2)
        both = [{(r.g, bytes(r.d or b""), bytes(r.x or b"")) for r in chaining.seed_matches(by_group(t, 2), 2).collect()} for t in (plain, chaining.numbered(plain))]
    assert both[0] == both[1] and any(d for _, d, _ in both[0])


def test_packed_tables_are_read_by_few_rows_and_fetched_words_not_written(spark, monkeypatch):
    """Rows of a large group are many MB; the words that chains ask for grow with the pairs of documents and go straight to those who asked."""
    settle, kept, settled, read = chaining.settle, chaining.kept, [], []
    monkeypatch.setattr(chaining, "settle", lambda df: settled.append(df.columns) or settle(df))
    monkeypatch.setattr(chaining, "kept", lambda df: read.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))) or kept(df))
    passage = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"{passage} own{i} " + " ".join(f"x{i}y{j}" for j in range(60))) for i in range(12)], "doc_id long, text string")
    got = chaining.find_passages(docs).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == {(i, 0, 120) for i in range(1, 12)}
    assert settled and not any("words" in c for c in settled)
    assert max(read) <= 64 and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"


def test_stretches_come_back_from_packed_words():
    import pyarrow as pa

    parts = [[(7, 3, [1, 2, 1]), (9, 0, [5])], [(7, 40, [2**64 - 1, 0])]]
    pack = lambda x, t: np.array(x, t).tobytes()
    row = lambda p: {**{c: pack(x, np.int64) for c, x in zip("eon", ([e for e, _, _ in p], [o for _, o, _ in p], [len(w) for *_, w in p]), strict=True)}, "words": pa.compress(pack(sum((w for *_, w in p), []), np.uint64), chaining.CODEC, asbytes=True)}
    got = chaining.stretches(pa.Table.from_pylist([row(p) for p in parts]))
    assert [(e, o, w.tolist()) for e, o, w in got] == parts[0] + parts[1]
