"""Subword lattice likelihood.

An existing vocabulary of subword pieces spans a lattice over each text: every way of cutting it
into pieces is a path, weighted by the product of its pieces' probabilities. The forward
recursion in log space adds up all paths, so a text gets its marginal probability. Pieces do not
reach over the border of two words, so the recursion runs word by word: each distinct word of the corpus is
scored once, in its bucket, and its score goes back to the groups of documents that have it.

The vocabulary's own scores give the first weights. They are ranks of merges (0, -1, -2, ...), not log probabilities,
so by Zipf's law a piece of score s weighs 1 / (100 - s). ROUNDS passes of expectations over all
words of the training texts, forward and backward over their lattices, turn them into the
corpus's piece probabilities; the vocabulary itself is left as it is.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packed import back, by_group, kept, pieces, scratch, settle, total_bytes, tune, with_group

SPACE = "▁"
FOLDS, HELD = 7, 2
#: Passes of expectations.
ROUNDS = 3
#: Cells of the lattices that are held at once.
CELLS = 4_000_000
ODD = np.uint64(0x100000001B3C0DE5)


class Vocabulary:
    """Pieces by a hash of their text, the ids of the 256 byte pieces, and the first weights."""

    def __init__(self, plain: dict[str, int], letters: list[int], first: np.ndarray):
        self.first, self.letters, self.longest = first, np.array(letters), max(map(len, plain), default=1)
        h = np.array([self.hashed(t) for t in plain], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.fromiter(plain.values(), np.int32, len(plain))[order]
        assert len(np.unique(h)) == len(h)
        self.live = np.zeros(len(first), bool)
        self.live[[*plain.values(), *letters]] = True

    @staticmethod
    def hashed(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(ODD) + ord(c) + 1) % 2**64
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], -1)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """Read once by each Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or SPACE in model.id_to_piece(i)[1:])}
    letters = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    p = np.zeros(n)
    for i in plain.values():
        p[i] = 1 / (100 - min(0.0, model.get_score(i)))
    p[letters] = p[p > 0].min()
    with np.errstate(divide="ignore"):
        return Vocabulary(plain, letters, np.log(p / p.sum()))


class Lattice:
    """Forward and backward recursions over the pieces of words, many words of one length at a time. A character that no piece spells takes its byte pieces."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray):
        self.vocabulary, self.weight = vocabulary, np.append(weight, -np.inf)

    def batches(self, words: list[bytes]):
        """(numbers of the words, code points, ids, weights): cell (word, end, length - 1) is the piece of that length that ends there."""
        texts = [SPACE + w.decode() for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            n = int(size[order[at]])
            longest = min(n, self.vocabulary.longest)
            end = min(int(np.searchsorted(size[order], n, "right")), at + max(1, CELLS // (n * longest)))
            number = order[at:end]
            at = end
            points = np.frombuffer("".join(texts[i] for i in number).encode("utf-32-le"), np.uint32).reshape(len(number), n)
            ids = np.full((len(number), n, longest), -1, np.int32)
            h = np.zeros((len(number), n), np.uint64)
            for k in range(longest):
                h = h[:, : n - k] * ODD + (points[:, k:].astype(np.uint64) + np.uint64(1))
                ids[:, k:, k] = self.vocabulary.find(h)
            weights = self.weight[ids]
            spelt = ids[:, :, 0] < 0
            if spelt.any():
                one, back_ = np.unique(points[spelt], return_inverse=True)
                weights[:, :, 0][spelt] = np.array([self.weight[self.vocabulary.letters[list(chr(c).encode())]].sum() for c in one.tolist()])[back_]
            yield number, points, ids, weights

    @staticmethod
    def forward(weights: np.ndarray) -> np.ndarray:
        """Log of the sum over all paths to each end; end e stands in column e + longest."""
        m, n, longest = weights.shape
        a = np.full((m, n + longest + 1), -np.inf)
        a[:, longest] = 0
        for e in range(1, n + 1):
            s = a[:, e : e + longest] + weights[:, e - 1, ::-1]
            top = s.max(1)
            a[:, e + longest] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return a

    def log(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' probabilities over all their segmentations."""
        out = np.zeros(len(words))
        for number, _, _, weights in self.batches(words):
            out[number] = self.forward(weights)[:, -1]
        return out

    def expect(self, words: list[bytes], times: np.ndarray, into: np.ndarray) -> None:
        """Add the expected number of uses of each piece, with each word taken so many times."""
        for number, points, ids, weights in self.batches(words):
            m, n, longest = weights.shape
            a = self.forward(weights)
            b = np.full_like(a, -np.inf)
            b[:, -1] = 0
            p = np.empty_like(weights)
            for e in range(n, 0, -1):
                through = weights[:, e - 1, ::-1] + b[:, e + longest, None]
                p[:, e - 1] = np.exp(a[:, e : e + longest] + through - a[:, -1:])[:, ::-1]
                b[:, e : e + longest] = np.logaddexp(b[:, e : e + longest], through)
            p *= times[number][:, None, None]
            there = ids >= 0
            into += np.bincount(ids[there], p[there], len(into))[: len(into)]
            spelt = ~there[:, :, 0]
            if spelt.any():
                one, back_ = np.unique(points[spelt], return_inverse=True)
                for c, uses in zip(one.tolist(), np.bincount(back_, p[:, :, 0][spelt]).tolist(), strict=True):
                    np.add.at(into, self.vocabulary.letters[list(chr(c).encode())], uses)


def held(ids: list[int]) -> list[bool]:
    return [zlib.crc32(str(i).encode()) % FOLDS == HELD for i in ids]


def tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


def ordered(words, groups: int) -> list[tuple[int, list[bytes]]]:
    """The distinct words by bucket, in one order everywhere."""
    words = sorted(words)
    at = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int64) % groups
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(groups + 1))
    return [(b, [words[k] for k in order[cuts[b] : cuts[b + 1]]]) for b in range(groups) if cuts[b + 1] > cuts[b]]


def binary(*arrays: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def asked_words(texts: DataFrame, groups: int) -> DataFrame:
    """(g, src, words, n): each group's distinct words with their counts in its training texts, by the words' bucket."""

    def ask(key, table):
        ids, train = table.column("doc_id").to_pylist(), {}
        for out, data in zip(held(ids), table.column("data"), strict=True):
            step = int(not out)
            for w in tokens(data.as_py()):
                train[w] = train.get(w, 0) + step
        rows = ordered(train, groups)
        return pa.table({"g": pa.array([b for b, _ in rows], pa.int32()), "src": pa.array([key[0].as_py()] * len(rows), pa.int32()), "words": pa.array([b" ".join(w) for _, w in rows], pa.binary()), "n": binary(*(np.array([train[x] for x in w], np.int64) for _, w in rows))})

    return settle(texts.groupBy("g").applyInArrow(ask, "g int, src int, words binary, n binary"))


def all_words(asked: DataFrame) -> DataFrame:
    """(g, words, n, total, distinct): a bucket's words with their counts in all training texts, and the sum and number of counts above 0."""

    def add(key, table):
        total: dict[bytes, int] = {}
        for words, n in zip(table.column("words").to_pylist(), table.column("n").to_pylist(), strict=True):
            for w, k in zip(words.split(b" "), np.frombuffer(n, np.int64).tolist(), strict=True):
                total[w] = total.get(w, 0) + k
        n = np.fromiter(total.values(), np.int64, len(total))
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([b" ".join(total)], pa.binary()), "n": binary(n), "total": pa.array([int(n.sum())]), "distinct": pa.array([int((n > 0).sum())])})

    return settle(asked.groupBy("g").applyInArrow(add, "g int, words binary, n binary, total long, distinct long"))


def expected(words: DataFrame, path: str, weight: np.ndarray | None) -> np.ndarray:
    """Expected uses of each piece over all training words. What comes to the driver is as large as the vocabulary."""
    raw = None if weight is None else weight.tobytes()

    def count(batches):
        known = vocabulary(path)
        lattice, uses = Lattice(known, known.first if raw is None else np.frombuffer(raw)), np.zeros(len(known.first))
        for b in batches:
            for w, n in zip(b.column("words").to_pylist(), b.column("n").to_pylist(), strict=True):
                w, n = w.split(b" "), np.frombuffer(n, np.int64)
                there = np.flatnonzero(n)
                lattice.expect([w[i] for i in there], n[there].astype(float), uses)
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(uses[at])], names=["piece", "uses"])

    found = words.select("words", "n").mapInArrow(count, "piece int, uses double").groupBy("piece").agg(F.sum(F.round("uses", 6).cast("decimal(30,6)")).cast("double").alias("uses")).toPandas()
    uses = np.zeros(len(vocabulary(path).first))
    uses[found["piece"].to_numpy(int)] = found["uses"].to_numpy(float)
    return uses


def piece_weights(words: DataFrame, n_train: int, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, with one added to each count."""
    live, weight = vocabulary(path).live, None
    for _ in range(rounds):
        uses = np.where(live, expected(words, path, weight) + 1, 0)
        total = uses.sum() + n_train + 1
        with np.errstate(divide="ignore"):
            weight = np.log(uses / total)
    return weight, math.log((n_train + 1) / total)


def answered(asked: DataFrame, words: DataFrame, path: str, weight: np.ndarray) -> DataFrame:
    """(g, b, n, p): to each group the counts of its words of bucket b and the logs of their probabilities, in the order that it asked."""
    raw = weight.tobytes()

    def answer(key, asks: pa.Table, known: pa.Table) -> pa.Table:
        w, n = known.column("words")[0].as_py().split(b" "), np.frombuffer(known.column("n")[0].as_py(), np.int64)
        p = Lattice(vocabulary(path), np.frombuffer(raw)).log(w)
        at = {x: i for i, x in enumerate(w)}
        rows = [np.fromiter(map(at.__getitem__, x.split(b" ")), np.int64) for x in asks.column("words").to_pylist()]
        return pa.table({"g": asks.column("src"), "b": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": binary(*(n[i] for i in rows)), "p": binary(*(p[i] for i in rows))})

    return asked.groupBy("g").cogroup(words.groupBy("g")).applyInArrow(answer, "g int, b int, n binary, p binary")


def score(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    A null or empty text is its end alone. A null id belongs to the training texts. Without training
    texts N and V are 0. `path` must be readable on every worker.
    """
    spark = docs.sparkSession
    tune(spark)
    with scratch(spark):
        groups = pieces(total_bytes(docs, text))
        texts = by_group(with_group(docs, groups, doc, text), groups)
        n_train = texts.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD).count()
        asked = asked_words(texts, groups)
        words = all_words(asked)
        n_all, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        n_all, distinct = n_all + n_train, distinct + (n_train > 0)
        weight, end = piece_weights(words, n_train, path)

        def finish(key, text: pa.Table, replies: pa.Table) -> pa.Table:
            ids, by_doc = text.column("doc_id").to_pylist(), [tokens(x.as_py()) for x in text.column("data")]
            answers = {b: (n, p) for b, n, p in zip(*(replies.column(c).to_pylist() for c in "bnp"), strict=True)}
            at, n, p = {}, [np.empty(0, np.int64)], [np.empty(0)]
            for b, ws in ordered({w for d in by_doc for w in d}, groups):
                for w in ws:
                    at[w] = len(at)
                n.append(np.frombuffer(answers[b][0], np.int64)), p.append(np.frombuffer(answers[b][1]))
            n, p = np.concatenate(n), np.concatenate(p)
            base = np.log10(n + 1)
            low, last = math.log10(n_all + distinct + 1), math.log10(n_train + 1)
            rows = []
            for i, out, ws in zip(ids, held(ids), by_doc, strict=True):
                k = np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))
                rows.append((i, out, len(ws) + 1, int((n[k] > 0).sum()) + (n_train > 0), n_all, float(base[k].sum()) + last - (len(ws) + 1) * low, (float(p[k].sum()) + end) / math.log(10)))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
            return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))})

        replies = answered(asked, words, path, weight)
        out = texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return kept(out.withColumn("doc_id", back()))


def op5_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
