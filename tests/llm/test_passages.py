"""Recall of passages where the sources of frequent lines differ."""

import random

from almanac.llm import chaining


def line(r, n):
    return [f"w{r.randrange(10**6)}x" for _ in range(n)]


def test_two_frequent_lines_side_by_side(spark):
    r = random.Random(11)
    texts, wanted = [], []
    lines = [(line(r, 30), line(r, 30)) for _ in range(12)]
    for one, two in lines:
        alone = lambda: [line(r, 20) + x + line(r, 20) for x in (one, two) for _ in range(4)]  # noqa: B023, E731
        texts += alone()
        texts.append(line(r, 20) + one + two + line(r, 20))
        source = len(texts) - 1
        texts += alone()
        texts.append(line(r, 20) + one + two + line(r, 20))
        wanted.append((len(texts) - 1, source))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(p.doc_id, p.source_doc_id): (p.start_word, p.n_words) for p in chaining.find_passages(docs).collect()}
    assert [found.get(w) for w in wanted] == [(20, 60)] * len(wanted)
    assert {d for d, _ in found} == {d for d, _ in wanted}


def test_changed_words_near_the_ends():
    r = random.Random(5)
    one = line(r, 100)
    two = line(r, 22) + one[22:78] + line(r, 22)
    two[26], two[73] = "changed", "other"
    h = [chaining.hashes([w.encode() for w in t]) for t in (one, two)]
    got = chaining.passage(h[1], h[0], 0, [(27, 27, 46)])
    assert got == (22, 56, 22, 54 / 56)


def test_recall_of_changed_passages(spark):
    r = random.Random(7)
    texts, wanted = [], {}
    for k in range(200):
        n, alike = r.randrange(50, 81), r.choice([0.8, 0.85, 0.9, 0.97])
        words = line(r, n)
        changed = words[:]
        for i in r.sample(range(1, n - 1), int(n * (1 - alike) + 1e-9)):
            changed[i] = f"c{k}x{i}"
        texts += [line(r, 40) + words + line(r, 40), line(r, 30) + changed + line(r, 50)]
        wanted[2 * k + 1] = n
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {p.doc_id: p for p in chaining.find_passages(docs).collect()}
    assert all(p.source_doc_id == d - 1 and p.similarity >= chaining.SIMILAR for d, p in found.items())
    missed = [d for d, n in wanted.items() if d not in found or found[d].n_words < 0.9 * n]
    print(f"missed {len(missed)} of {len(wanted)}", [(d in found and found[d].n_words, wanted[d]) for d in missed])
    assert len(missed) <= 0.03 * len(wanted)


def test_fragments_elsewhere_do_not_hide_a_passage(spark):
    r = random.Random(17)
    texts, wanted = [], set()
    for _ in range(10):
        words = line(r, 80)
        parts = [words[i : i + 16] for i in range(0, 80, 16)]
        scrambled = lambda: [w for p in r.sample(parts, 5) for w in p + line(r, 9)]  # noqa: B023, E731
        texts += [scrambled(), line(r, 10) + words, scrambled(), line(r, 25) + words + line(r, 5)]
        wanted.add((len(texts) - 1, len(texts) - 3, 25, 80))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert wanted <= {(p.doc_id, p.source_doc_id, p.start_word, p.n_words) for p in chaining.find_passages(docs).collect()}


def test_half_shifted_fragments_do_not_hide_a_passage(spark):
    """Each word of the passage stands in two kinds of fragments, one shifted by half, before its source and between the source and the copy."""
    r = random.Random(23)
    for words, piece in ((144, 48), (240, 40), (150, 30)):
        texts, wanted = [], set()
        for _ in range(6):
            whole = line(r, words)

            def fragments(shift):
                parts = [whole[max(0, i) : i + piece] for i in range(-shift, words, piece)]  # noqa: B023
                return [w for p in r.sample(parts, len(parts)) for w in p + line(r, 12)]

            texts += [fragments(0), fragments(piece // 2), whole, fragments(0), fragments(piece // 2), line(r, 8) + whole]
            wanted.add((len(texts) - 1, len(texts) - 4))
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        found = {}
        for p in chaining.find_passages(docs).collect():
            found.setdefault((p.doc_id, p.source_doc_id), set()).update(range(p.start_word, p.start_word + p.n_words))
        assert all(set(range(8, 8 + words)) <= found.get(w, set()) for w in wanted)


def test_equal_passages_among_hot_lines_against_brute_force(spark):
    r = random.Random(19)
    hot, pool, texts = [line(r, 30) for _ in range(3)], [line(r, 25) for _ in range(40)], []
    for _ in range(300):
        parts = [r.choice(hot) if r.random() < 0.33 else r.choice(pool) if r.random() < 0.6 else line(r, 20) for _ in range(8)]
        texts.append([w for p in parts for w in p])
    n, first, wanted = chaining.PASSAGE, {}, set()
    for d, t in enumerate(texts):
        runs = [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
        wanted |= {(d, i + j) for i, x in enumerate(runs) if x in first for j in range(n)}
        for x in runs:
            first.setdefault(x, d)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = chaining.find_passages(docs).collect()
    assert all(p.source_doc_id < p.doc_id and p.similarity >= chaining.SIMILAR for p in found)
    covered = {(p.doc_id, p.start_word + j) for p in found for j in range(p.n_words)}
    print(f"covered {len(wanted & covered)} of {len(wanted)} words, {len(covered - wanted)} more by similarity")
    assert len(wanted & covered) >= 0.98 * len(wanted)


def test_rows_of_one_id_and_of_none_are_cut_each_by_its_own_passages(spark):
    r = random.Random(13)
    source, clean, other = line(r, 60), line(r, 90), line(r, 70)
    rows = [(1, source), (2, source + line(r, 10)), (2, clean), (3, other), (3, other), (None, clean + ["left"]), (None, ["of"] + other)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(((d.doc_id or 9, d.text) for d in chaining.cut_passages(docs).collect()))
    assert got == sorted((i or 9, " ".join(t)) for i, t in [(1, source), (2, rows[1][1][60:]), (2, clean), (3, other), (None, ["left"]), (None, ["of"])])


def test_alignment_of_gaps_of_any_length():
    r = random.Random(8)
    for n, m, words in ((0, 5, 3), (7, 0, 3), (12, 9, 4), (90, 130, 6), (200, 150, 300)):
        a, b = ([r.randrange(words) for _ in range(k)] for k in (n, m))
        row = [0] * (m + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert chaining.agree(a, b) == row[-1]


def test_all_earlier_holders_of_frequent_seeds_are_asked(spark):
    """Fragments of 48 words at twelve shifts cover every stretch of 44 words of a passage, before its source and between the source and the copy: no key's first or latest holder is the source."""
    r = random.Random(29)
    texts, wanted = [], {}
    for _ in range(3):
        whole = line(r, 144)

        def fragments(shift):
            parts = [whole[max(0, i) : i + 48] for i in range(-shift, 144, 48)]  # noqa: B023
            return [w for p in r.sample(parts, len(parts)) for w in p + line(r, 30)]

        for _ in range(2):
            texts += [fragments(shift) for shift in range(0, 48, 4)]
            texts.append(line(r, 7) + whole)
        wanted[len(texts) - 1] = len(texts) - 14
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for p in chaining.find_passages(docs).collect():
        found.setdefault((p.doc_id, p.source_doc_id), set()).update(range(p.start_word, p.start_word + p.n_words))
    assert all(set(range(7, 151)) <= found.get(pair, set()) for pair in wanted.items())


def test_a_stretch_that_many_ask_for_is_fetched_once_a_group(spark):
    """Words that a group's documents ask of one earlier text travel once, so a hot text costs its own length a group."""
    r = random.Random(31)
    whole = line(r, 60)
    docs = spark.createDataFrame([(i, " ".join(line(r, 5) + whole + line(r, 5))) for i in range(200)], "doc_id long, text string")
    from almanac.llm.packed import by_group, scatter, schema, scratch, with_group

    import numpy as np

    with scratch(spark):
        texts = by_group(with_group(docs, 4), 4)
        d = np.arange(1, 200)
        asked = scatter(chaining.deal(d, 4), 4, {c: np.full(199, v, np.int64) if v is not None else d.astype(np.int64) for c, v in (("d", None), ("e", 0), ("k", 0), ("x", 5), ("y", 5), ("w", 60))})
        runs = spark.createDataFrame([tuple(x.values()) for x in asked.to_pylist()], schema(*"dekxyw"))
        sent = chaining.fetched(texts, runs, 4).collect()
    assert sum(len(x.words) for x in sent) == 4 * 70 * 8


def test_documents_that_share_only_what_is_covered_are_no_pairs(spark):
    """Of a passage that many documents have the pairs grow with the documents, not with their square; a holder of more of it than those asked first is still found."""
    from almanac.llm.packed import by_group, scratch, with_group

    r = random.Random(37)
    whole = line(r, 55)
    long = line(r, 30)
    texts = [line(r, 80) + whole + line(r, 80) for _ in range(60)]
    # The second holder of `long` has it after `whole`, as the last has, and others have it alone.
    texts[20] = line(r, 80) + whole + long + line(r, 50)
    texts += [line(r, 80) + long + line(r, 80) for _ in range(10)] + [line(r, 80) + whole + line(r, 80)]
    texts.append(line(r, 40) + whole + long + line(r, 40))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    with scratch(spark):
        grouped = by_group(with_group(docs, 4), 4)
        found = chaining.seed_matches(grouped, 4)
        single, shared = found.where("d is not null").select("g", "d", "x", "e", "y"), found.where("h is not null").select("g", "h", "doc", "at")
        first = chaining.settle(chaining.aligned(grouped, chaining.chained(single, 4), 4))
        asked = sum(len(m.d) // 8 for m in chaining.rest_matches(shared, first, 4).collect())
    found = {}
    for p in chaining.find_passages(docs).collect():
        found.setdefault(p.doc_id, set()).update(range(p.start_word, p.start_word + p.n_words))
    assert set(found) == {*range(1, 60), 70, 71} and found[71] == {*range(40, 125)}
    assert asked < 4 * len(texts)
