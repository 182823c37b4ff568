"""The ten operators on small fixtures with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from almanac.llm import chaining, html_text, lattice, licenses, mixing, ngram_join, packing, quality_rules, suffix_dedup, webp
from almanac.llm.components import components
from almanac.llm.packed import deal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, g string"


def prose(r, n, words=300):
    return " ".join(f"w{r.randrange(words)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = prose(r, 220, 5000)
    copy = base.split()
    copy[40], copy[150] = "changed", "other"
    passage = prose(r, 80, 5000)
    texts = [base, base, " ".join(copy), None, "", "   \n\t ", "one two", "One TWO", prose(r, 30) + " " + passage + " " + prose(r, 40), prose(r, 60) + "\n" + passage, prose(r, 3000), "a" * 3000, "é ß 漢字 \x85 x" * 30, "Released under the MIT License.", "same line\n" * 40]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, "x") for i, t in enumerate(texts)]
    return out + [(None, passage + " end", None, None, None, None, None), out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_groups_agree_with_spark(spark):
    ids = [0, 1, -5, 2**40, 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("pmod(xxhash64(i), 37)").collect()]
    assert deal(np.array(ids), 37).tolist() == got


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1), (3, 5), (8, 10)], "a long, b long")
    assert sorted(map(tuple, components(links, "a", "b").collect())) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (10, 8)]


def test_quality_statistics_by_hand():
    n, chars, symbols, dup, again, *_ = quality_rules.stats("a b c\na b c\n\n#x é")
    assert (n, chars, symbols, dup, again) == (8, 9, 1, 1, 6)
    assert quality_rules.stats(None)[:5] == (0, 0, 0, 0, 0)


def test_rules_are_learned_and_precise():
    r = np.random.default_rng(0)
    x = r.random((900, len(quality_rules.FEATURES)))
    y = (x[:, 0] > 0.8) | ((x[:, 3] < 0.2) & (x[:, 4] > 0.6))
    rules = quality_rules.learn(x, y)
    hit = np.any([quality_rules.covered(x, k) for k in rules], axis=0)
    assert (hit == y).mean() > 0.95 and y[hit].mean() > 0.95


def test_quality_keeps_rows_and_columns(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels)
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    assert not out.where("text is null and _quality.kept").count()
    assert quality_rules.judge(none, labels.limit(0)).count() == 0


def test_ngram_join_equals_brute_force(docs, rows, none):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    leader = {i: i for i in sets if i is not None}
    for _ in leader:
        for a in leader:
            for b in leader:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    leader[a] = leader[b] = min(leader[a], leader[b])
    got = ngram_join.ngram_join(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(sets[i]), leader[i]) for i in leader}
    assert ngram_join.ngram_join(none).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    r = random.Random(1)
    base = prose(r, 200, 10**6).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for k in r.sample(range(200), 2):
            w[k] = f"z{r.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    leader = list(range(60))
    for _ in range(6):
        for a in range(60):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    leader[a] = leader[b] = min(leader[a], leader[b])
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(df).collect()} == dict(enumerate(leader))


def test_webp_round_trips():
    r = np.random.default_rng(1)
    for k in range(30):
        h, w = r.integers(1, 14, 2)
        px = r.integers(0, 256, (h, w, 4)).astype(np.uint8) // (64 if k % 3 == 0 else 1)
        stored = webp.encode_pixels(px, [list(range(14)), None, [11], [13, 12]][k % 4], [(5, -7, 100), None][k % 2], bool(k % 3), [0, 4, 1][k % 3])
        assert (webp.decode(stored) == px).all()
    for data in (b"", b"a", b"a" * 5000, bytes(range(256)) * 1000, b"x\n" * 3000, b"hello world line of text\n" * 9000, "é漢".encode() * 999):
        payload = webp.padded(data)
        assert len(payload) % 192 == 0 and payload and webp.load(webp.store(payload)).tobytes() == payload


def test_media_digests(docs, rows):
    got = docs.select("doc_id", webp.media_digest("text").alias("m")).select("doc_id", "m.*").collect()
    want = {i: webp.padded((t or "").encode()) for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        p = want[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_exact_dedup_equals_brute_force(docs, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, want = {}, {}
    for i, t, *_ in order:
        b, key = (t or "").encode(), math.inf if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], key) < key:
                gone[k : k + 50] = b"\1" * 50
        want[i] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]))
    got = suffix_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) and all((bytes(r.kept), r.n_removed, r.n_spans) == want[r.doc_id] for r in got)
    assert suffix_dedup.exact_dedup(none).count() == 0


def test_phrase_order_is_the_suffix_order():
    r = random.Random(2)
    a = bytes(r.choice(b"abc ") for _ in range(700))
    texts = [a, a[100:600] + b"zz" + a[:300]]
    want = sorted((t[i : i + 50]) for t in texts for i in range(len(t) - 49))
    assert [texts[n][i : i + 50] for n, i in suffix_dedup.phrase_order(texts)] == want


def test_lattice_sums_all_segmentations():
    plain, weight = {"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4}, np.log(np.array([0.1, 0.2, 0.3, 0.1, 0.2, 0.1]))
    model = lattice.Lattice(lattice.Vocabulary(plain, [5] * 256, weight), weight)
    want = 0.1 * 0.3 * 0.1 + 0.2 * 0.1 + 0.1 * 0.2
    got = model.log([b"ab", b"a", "é".encode(), b"ab" * 2000])
    assert got[:3] == pytest.approx([math.log(want), math.log(0.1 * 0.3 + 0.2), math.log(0.1 * 0.1 * 0.1)]) and math.isfinite(got[3])
    uses = np.zeros(6)
    model.expect([b"ab", "é".encode()], np.array([2.0, 3.0]), uses)
    assert uses[4] == pytest.approx(2 * 0.02 / want) and uses[0] == pytest.approx(2 * (0.003 + 0.02) / want + 3) and uses[5] == pytest.approx(6)


def test_more_passes_raise_the_likelihood(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    one, two = ([b"house", b"water", b"waterhouse", "über".encode()] for _ in range(2))
    known = lattice.vocabulary(path)
    n, weight, before = np.array([5.0, 3.0, 2.0, 1.0]), known.first, -math.inf
    for _ in range(4):
        model = lattice.Lattice(known, weight)
        now = float(model.log(one) @ n)
        assert now > before
        uses, before = np.zeros(len(weight)), now
        model.expect(two, n, uses)
        with np.errstate(divide="ignore"):
            weight = np.log(uses / uses.sum())


def test_scoring(docs, rows, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*words(t), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    got = lattice.score(docs, path).collect()
    want = sorted((held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score(none, path).count() == 0


def test_licences(spark, docs, none):
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got == {(13, "mit-notice")}
    long = "x " * 5000 + licenses.TEMPLATES["gpl-3.0-header"].upper() + " y" * 99
    df = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.n_matched == r.n_template) for r in licenses.scan(df).collect()] == [(1, "gpl-3.0-header", True)]
    assert licenses.scan(none).count() == 0


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    out = packing.pack(docs, path).collect()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    for i in ids:
        copies = sum(r[0] == i for r in rows)
        spans = sorted((p.start, p.length, p.ids_crc32) for p in out if p.doc_id == i)[::copies]
        at = 0
        for start, n, crc in spans:
            assert start == at and crc == zlib.crc32(np.array(ids[i][at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids[i])
    for s in {p.sequence_id for p in out}:
        at = 0
        for p in sorted((p for p in out if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert packing.pack(none, path).count() == 0


def test_passages(spark, docs, none):
    got = {(r.doc_id, r.source_doc_id) for r in chaining.find_passages(docs).collect()}
    assert {(1, 0), (2, 0), (9, 8), (None, 8)} <= got and not any(d in (3, 4, 5, 6, 10, 13) for d, _ in got)
    assert chaining.find_passages(none).count() == 0
    cut = chaining.cut_passages(docs)
    assert cut.columns == docs.columns
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert 1 not in kept and kept[3] is None and len(kept[9].split()) < 65


def test_chain_pays_for_gaps():
    far = [(0, 0, 30), (30, 500, 30), (62, 33, 30)]
    assert chaining.chains(far)[0] == [(0, 0, 30), (62, 33, 30)]
    assert chaining.agree([1, 2, 3, 4], [1, 9, 3, 4]) == 3


def test_mixing(docs, rows, none):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    by = {}
    for r in out:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) < 1 for (_, target), t in by.items())
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in out))
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == sum(r.taken for r in out)
    assert mixing.mix(none).count() == 0


def test_targets_stop_at_three_times(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 10), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got["z"] == 0 and got[None] == pytest.approx(30) and got["a"] == pytest.approx(30) and sum(got.values()) == pytest.approx(1020)


def test_main_text(spark):
    model = html_text.train(html_text.labelled_pages(160))
    wrong = total = 0
    for page in html_text.labelled_pages(60, seed=77):
        nodes, blocks = html_text.parse(page)
        y, p = html_text.labels(nodes), model.marginals(nodes)
        total += len(blocks)
        wrong += sum((p[i] > 0.5) != bool(y[i]) for i, _ in blocks)
    assert wrong < 0.05 * total
    page = '<html><head><title>no</title></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><article><h1>Head &amp; tail</h1><p>First  part\n here.<p>Second &eacute; part.</article><footer>foot</footer><script>var a="<p>x</p>"</script></body></html>'
    df = spark.createDataFrame([(1, "u", page, "old"), (2, None, None, None), (3, "v", "", None), (4, "w", "<<<>&&amp;</div></p>", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    want = "Head & tail\nFirst part here.\nSecond é part."
    assert got[1] == (want, len(want)) and got[2] == got[3] == ("", 0)


def test_messages_equal_enumeration():
    model = html_text.train(html_text.labelled_pages(60))
    nodes, _ = html_text.parse("<body><div class='content'><p>Some text, here.</p><div class=ad>buy</div></div><footer>c</footer></body>")
    own = html_text.features(nodes) @ model.weights
    total, on = 0.0, np.zeros(len(nodes))
    for bits in range(2 ** len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        p = math.exp(sum(own[i] * y[i] for i in range(len(nodes))) + sum(model.edges[html_text.edge_kind(n), y[n.above], y[i]] for i, n in enumerate(nodes) if i))
        total += p
        on += p * np.array(y)
    assert np.allclose(model.marginals(nodes), on / total, atol=1e-6)
