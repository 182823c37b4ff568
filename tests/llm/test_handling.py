"""Clashing names, nulls, ties, repeated rows and empty tables in the operators that give documents back, and in the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from almanac.llm import chaining, mixing, quality_rules, webp

SF = "/root/testdata/sf0.001"


def prose(r, n):
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


@pytest.mark.parametrize("ids", [range(10), [3, 3, None, None, 1, 5, 6, 7, 8, 9]])
def test_cut_passages_keeps_clashing_columns(spark, ids):
    r = random.Random(1)
    shared = prose(r, 70)
    texts = [prose(r, 30) + " " + shared if i % 2 else shared + " " + prose(r, 40) for i in range(6)] + [None, "", "short text", shared]
    rows = [(d, t, i, f"r{i}", i * 2, "rest", i, 7) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, _row string, _rest int, _of string, _id int, n_chars int")
    got = {x.runs: x for x in chaining.cut_passages(df).collect()}
    assert all((x._row, x._rest, x._of, x._id) == (f"r{i}", i * 2, "rest", i) for i, x in got.items())
    assert sum(x.text is not None and shared in x.text for x in got.values()) == 1 and {6, 7, 8} <= set(got)
    assert all(x.text == texts[i] or x.n_chars == len(x.text) for i, x in got.items())
    assert chaining.cut_passages(df.limit(0)).collect() == []


def brute_repeat(rows):
    """What the mix takes of each row, by mix itself, as texts."""
    out = []
    for doc, text, taken, size in rows:
        words = (text or "").split()
        out += [(doc, text)] * (taken // size if size else 0)
        if size and taken % size:
            out.append((doc, " ".join(words[: taken % size])))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [100_000, 2])
def test_repeat_takes_what_mix_says(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST", most)
    r = random.Random(2)
    rows = [(i, prose(r, r.randrange(1, 60)), None if i % 9 == 0 else f"s{i % 4}" if i % 3 else "big", 1, i, "x") for i in range(300)] + [(900, None, "s1", 1, 1, "x"), (901, "", "s2", 1, 1, "x"), (None, prose(r, 9), "s3", 1, 1, "x"), (None, prose(r, 9), "empty", 1, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, cut int, _row string")
    taken = {x.doc_id: (x.taken, x.size) for x in mixing.mix(df.where("doc_id is not null")).collect()}
    want = brute_repeat([(d, t, *taken[d]) for d, t, *_ in rows if d is not None])
    got = mixing.repeat(df.where("doc_id is not null"))
    assert got.columns == df.columns and sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == want
    assert mixing.repeat(df).where("doc_id is null").count() >= 1 and mixing.repeat(df.limit(0)).collect() == []
    assert mixing.repeat(df.where("doc_id in (900, 901)")).collect() == []


def test_repeated_rows_at_the_cut_share_its_words(spark):
    rows = [(7, "a b c d e f g h i j", "s")] * 4 + [(8, "k l m n", "t"), (9, "o p q", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {x.source: x.target for x in mixing.targets(df.groupBy("source").agg(F.sum(mixing.n_words()).alias("source_size"))).collect()}
    got = mixing.repeat(df).groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()
    assert all(target[x.source] - 4 <= x.n <= target[x.source] for x in got)


def test_quality_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_s", F.lit(1)).withColumn("_quality", F.lit("mine"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.keep(docs, labels)
    assert got.columns == docs.columns and {x._quality for x in got.collect()} == {"mine"} and {x._s for x in got.collect()} == {1}
    with pytest.raises(ValueError, match="have a column"):
        quality_rules.judge(docs, labels)
    assert quality_rules.keep(docs.limit(0), labels).collect() == [] and quality_rules.keep(docs, labels.limit(0)).count() > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, copies, ties and repeated ids; and no rows at all."""
    r = random.Random(3)
    base, passage = prose(r, 200), prose(r, 80)
    good = [prose(r, 150 + i) for i in range(40)] + [passage + " " + prose(r, 90), prose(r, 70) + " " + passage]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)] + [(50, base, "en", "s1", 1), (51, base, None, None, None), (52, base + " end", "en", "s1", 2), (52, prose(r, 120), "en", "s0", 3), (None, prose(r, 130), None, None, None), (None, None, None, None, None), (60, "", "en", "s2", 0), (61, None, "en", "s2", None), (62, prose(r, 30_000), "en", "s0", 9)]
    for name, data in (("odd", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, int(i % 2), 0) for i in range(9)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert (len(out) > 0) == bool(data)
        assert 61 not in {x.doc_id for x in out} and 60 not in {x.doc_id for x in out} and not {51} & {x.doc_id for x in out}
        bins = {}
        for x in out:
            bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for pieces in bins.values():
            end = 0
            for offset, n in sorted(pieces):
                assert offset == end
                end += n
            assert end <= 4096


def counted(text):
    """The contract's numbers in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(again), n < 50 or 100 * len(again) > 50 * n


def test_quality_statistics_against_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", " \t\n", "one", "a b c a b c", "a a a a", "same line\nsame line\n same line\nsame line", "x # * $ % & | < > y" * 9, "é ß 漢字 \x85 \xa0 x y z" * 20, "word " * 60, prose(r, 200), " ".join(prose(r, 20) for _ in range(4)) + "\n", "a\rb\x0bc\x0cd" * 30]
    texts += ["\n".join(r.choice(["p q r", "s", "", "  ", "t u v w"]) for _ in range(60)) for _ in range(5)] + [prose(r, 60) + " " + " ".join(["k l m"] * n) for n in (5, 15, 25)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality_rules.judge(df, spark.createDataFrame([], "doc_id long, quality int")).select("doc_id", "_quality.*").collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == counted(texts[x.doc_id])
        assert x.kept == (not x.base_failed)


def test_media_columns_of_the_fixture(spark):
    """Every column from the stored bytes as they are, and equal texts give equal rows; an empty table and a very long text."""
    texts = ["abc", "abc", None, "", "é" * 100_000, "line\n" * 50_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, m int")
    got = {x.doc_id: x for x in df.select("doc_id", webp.media_digest("text").alias("m")).select("doc_id", "m.*").collect()}
    for i, t in enumerate(texts):
        payload = webp.padded((t or "").encode())
        media = webp.store(payload)
        samples = np.frombuffer(payload, np.uint8)
        share = np.unique(samples, return_counts=True)[1] / len(samples)
        x = got[i]
        assert (x.n_bytes, x.payload_bytes, x.media_bytes, x.media_sha256) == (len((t or "").encode()), len(payload), len(media), hashlib.sha256(media).hexdigest())
        assert x.feature == f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};levels={len(share)};rows={len(payload) // 192}"
        assert media[:4] == b"RIFF" and media[8:16] == b"WEBPVP8L"
    assert df.limit(0).select(webp.media_digest("text")).collect() == []


def test_the_mix_counts_each_text_once_to_find_its_cuts(spark, monkeypatch):
    """What the cuts are made of is written without texts before it is summed and ordered, and gone when the cuts are known."""
    import os

    from almanac.llm import packed

    docs = spark.createDataFrame([(i, "ab"[i % 2], " ".join(["w"] * (i % 7 + 1))) for i in range(200)], "doc_id long, source string, text string")
    seen, write = [], packed.written
    monkeypatch.setattr(packed, "written", lambda df, at: seen.append((df.columns, at)) or write(df, at))
    got = mixing.repeat(docs)
    assert [c for c, _ in seen] == [["source", "size", "key", "same", "part"]]
    assert not os.path.exists(seen[0][1].removeprefix("file:"))
    size = sum(i % 7 + 1 for i in range(200))
    assert abs(got.agg(F.sum(mixing.n_words())).first()[0] - size) <= 2
