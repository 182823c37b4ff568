"""Removal of byte strings that an earlier document has, by prefix-free parsing.

Rolling-hash triggers cut each text into phrases; a phrase is kept together with the WIDTH - 1 bytes
after it, so each WIDTH-byte string starts in exactly one phrase, and equal text is cut
alike away from its ends. The dictionary of distinct phrases is far smaller than highly repetitive
text. It settles most strings at once: a phrase that an earlier document has is removed whole.

What remains are strings of the dictionary's own phrases, each judged where its phrase occurs first. They are
ordered in two steps. Every string is filed under its anchor, the least hash of the seeds
within it, so equal strings meet; an anchor of one document only ends the matter for all its strings.
The strings under the other anchors travel with their context and are put into the order of their 50-byte
prefixes (of their fingerprints: only equality of neighbours counts here, not which of two is less).
Adjacent equal strings form the classes of that order, whose earliest document keeps the bytes.
`phrase_order` gives a plain suffix order of a parse for small corpora and tests.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from almanac.llm.packed import back, by_group, deal, gather, mix, pieces, scatter, schema, settle, split, total_bytes, tune, with_group

WIDTH, SEED = 50, 20
#: A trigger in 2^TRIGGER positions; phrases of at least and at most so many bytes.
TRIGGER, LEAST, MOST = 7, 64, 8192
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def eights(data: bytes) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).copy() if len(data) > 7 else np.empty(0, np.uint64)


def phrases(data: bytes, w: np.ndarray) -> np.ndarray:
    """Starts of the phrases, and at the end the number of strings: phrase i has the strings from starts[i] up to starts[i + 1]."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(1, np.int64)
    cuts, last = [0], 0
    for t in np.flatnonzero((w[:n] * C1) >> np.uint64(64 - TRIGGER) == 0).tolist():
        while t - last > MOST:
            last += MOST
            cuts.append(last)
        if t - last >= LEAST:
            cuts.append(t)
            last = t
    while n - last > MOST:
        last += MOST
        cuts.append(last)
    return np.array([*cuts, n], np.int64)


def anchors(w: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The anchor of each string that starts in [lo, hi): the least hash of the seeds within it."""
    a = w[lo : hi + WIDTH - SEED]
    m = len(a)
    h = (a * C1) ^ ((w[lo + 8 : lo + 8 + m] * C2) >> np.uint64(7)) ^ (w[lo + 12 : lo + 12 + m] * C3)
    h = mix(h)
    span, have = WIDTH - SEED + 1, 1
    while have < span:
        step = min(have, span - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h[: hi - lo]


def parts(starts: np.ndarray, again: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of strings whose phrases no earlier document has."""
    own = np.ones(len(starts) - 1, bool)
    own[again[again < len(own)]] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
    return [(int(starts[i]), int(starts[j])) for i, j in zip(edge[::2], edge[1::2], strict=True)]


def earlier_phrases(texts: DataFrame, groups: int) -> DataFrame:
    """Replies (kind p): the phrases of a document that a smaller doc_id has too."""

    def ask(batches):
        for b in batches:
            h, doc, at = [], [], []
            for d, data in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), strict=True):
                starts = phrases(data, eights(data))
                k = len(starts) - 1
                h += [xxh3_64_intdigest(data[i : j + WIDTH - 1]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                doc.append(np.full(k, d, np.int64)), at.append(np.arange(k, dtype=np.uint32))
            if h:
                h = np.array(h, np.uint64)
                yield scatter((h % np.uint64(groups)).astype(np.int64), groups, {"h": h, "doc": np.concatenate(doc), "at": np.concatenate(at)})

    def answer(table: pa.Table) -> pa.Table:
        h, doc, at = gather(table, "h", np.uint64), gather(table, "doc", np.int64), gather(table, "at", np.uint32)
        order = np.lexsort((doc, h))
        h, doc, at = h[order], doc[order], at[order]
        new = np.append(True, h[1:] != h[:-1])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        late = doc > first
        out = scatter(deal(doc[late], groups), groups, {"a": doc[late], "b": at[late]})
        return pa.Table.from_batches([out]).append_column("kind", pa.array(["p"] * out.num_rows, pa.string()))

    return settle(texts.mapInArrow(ask, schema("h", "doc", "at")).groupBy("g").applyInArrow(answer, schema("a", "b") + ", kind string"))


def shared_anchors(texts: DataFrame, known: DataFrame, groups: int) -> DataFrame:
    """Replies (kind a): the anchors of a document's own phrases that another document's own phrases have too."""

    def ask(key, text: pa.Table, replies: pa.Table) -> pa.Table:
        again, value, doc = split(replies, "p", {"a": np.int64, "b": np.uint32}), [], []
        for d, data in zip(text.column("doc_id").to_pylist(), text.column("data").to_pylist(), strict=True):
            w = eights(data)
            own = [np.unique(anchors(w, lo, hi)) for lo, hi in parts(phrases(data, w), *again.get(d, (np.empty(0, np.uint32),)))]
            if own:
                own = np.unique(np.concatenate(own))
                value.append(own), doc.append(np.full(len(own), d, np.int64))
        value, doc = np.concatenate([*value, np.empty(0, np.uint64)]), np.concatenate([*doc, np.empty(0, np.int64)])
        return pa.Table.from_batches([scatter((value % np.uint64(groups)).astype(np.int64), groups, {"value": value, "doc": doc})])

    def answer(table: pa.Table) -> pa.Table:
        value, doc = gather(table, "value", np.uint64), gather(table, "doc", np.int64)
        order = np.argsort(value, kind="stable")
        value, doc = value[order], doc[order]
        at = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.empty(0, np.int64)
        count = np.diff(np.append(at, len(value)))
        mixed = np.repeat(np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at), count) if len(at) else np.empty(0, bool)
        out = scatter(deal(doc[mixed], groups), groups, {"a": doc[mixed], "b": value[mixed]})
        return pa.Table.from_batches([out]).append_column("kind", pa.array(["a"] * out.num_rows, pa.string()))

    asked = texts.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(ask, schema("value", "doc"))
    return settle(asked.groupBy("g").applyInArrow(answer, schema("a", "b") + ", kind string"))


def earlier_strings(texts: DataFrame, known: DataFrame, groups: int) -> DataFrame:
    """Replies (kind s): starts of strings of a document's own phrases that a smaller doc_id has too."""

    def ask(key, text: pa.Table, replies: pa.Table) -> pa.Table:
        again, shared = split(replies, "p", {"a": np.int64, "b": np.uint32}), split(replies, "a", {"a": np.int64, "b": np.uint64})
        value, doc, at, size, raw = [], [], [], [], []
        for d, data in zip(text.column("doc_id").to_pylist(), text.column("data").to_pylist(), strict=True):
            if d not in shared:
                continue
            wanted, w = np.sort(shared[d][0]), eights(data)
            for lo, hi in parts(phrases(data, w), *again.get(d, (np.empty(0, np.uint32),))):
                own = anchors(w, lo, hi)
                found = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(own)], strict=True):
                    if found[i]:
                        value.append(own[i]), doc.append(d), at.append(lo + i), size.append(j - i)
                        raw.append(data[lo + i : lo + j + WIDTH - 1])
        # Each stretch of strings under one anchor goes to the anchor's bucket with its bytes.
        value = np.array(value, np.uint64)
        group = (value % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        out = scatter(group, groups, {"value": value, "doc": np.array(doc, np.int64), "at": np.array(at, np.uint32), "size": np.array(size, np.uint32)})
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        blob = [b"".join(raw[k] for k in order[cuts[u] : cuts[u + 1]]) for u in out.column(0).to_pylist()]
        return pa.Table.from_batches([out]).append_column("raw", pa.array(blob, pa.binary()))

    def answer(table: pa.Table) -> pa.Table:
        value, doc, at, size = (gather(table, c, t) for c, t in (("value", np.uint64), ("doc", np.int64), ("at", np.uint32), ("size", np.uint32)))
        raw = b"".join(table.column("raw").to_pylist())
        size = size.astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size + WIDTH - 1)[:-1]]) if len(size) else np.empty(0, np.int64)
        out_doc, out_at, order = [], [], np.argsort(value, kind="stable")
        w = eights(raw)
        # Anchors in lots of bounded size: their strings are told apart by anchor and fingerprint.
        total = np.cumsum(size[order])
        lots = np.searchsorted(total, np.arange(0, (total[-1] if len(total) else 0) + 500_000, 500_000))
        edges = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1])) if len(order) else np.empty(0, np.int64)
        cuts = np.unique(np.append(edges[np.minimum(np.searchsorted(edges, lots), len(edges) - 1)], len(order))) if len(order) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[lo:hi]
            n = size[k]
            row = np.repeat(np.arange(len(k)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            pos = begin[k][row] + step
            h = value[k][row]
            for j in (0, 8, 16, 24, 32, 40, WIDTH - 8):
                h = (h ^ w[pos + j]) * C2
                h ^= h >> np.uint64(29)
            h = mix(h)
            d = doc[k][row]
            s = np.lexsort((d, h))
            h, d, p = h[s], d[s], (at[k][row] + step)[s]
            new = np.append(True, h[1:] != h[:-1])
            late = d > d[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            out_doc.append(d[late]), out_at.append(p[late].astype(np.uint32))
        d, p = np.concatenate([*out_doc, np.empty(0, np.int64)]), np.concatenate([*out_at, np.empty(0, np.uint32)])
        out = scatter(deal(d, groups), groups, {"a": d, "b": p})
        return pa.Table.from_batches([out]).append_column("kind", pa.array(["s"] * out.num_rows, pa.string()))

    asked = texts.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(ask, schema("value", "doc", "at", "size", "raw"))
    return settle(asked.groupBy("g").applyInArrow(answer, schema("a", "b") + ", kind string"))


def kept_bytes(data: bytes, again: np.ndarray, strings: np.ndarray) -> tuple[bytes, int]:
    """What remains of a text, and the number of runs removed."""
    edge = np.zeros(len(data) + 1, np.int32)
    starts = phrases(data, eights(data)) if len(again) else None
    for i in again.tolist():
        edge[starts[i]] += 1
        edge[starts[i + 1] + WIDTH - 1] -= 1
    np.add.at(edge, strings.astype(np.int64), 1)
    np.add.at(edge, strings.astype(np.int64) + WIDTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


def exact_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans), one row per row of docs.

    Texts under 50 bytes, empty and null ones lose nothing. A null id counts as the greatest.
    Rows that share an id do not remove each other's bytes, since neither is smaller.
    """
    tune(docs.sparkSession)
    groups = pieces(total_bytes(docs, text))
    texts = by_group(with_group(docs, groups, doc, text), groups)
    known = earlier_phrases(texts, groups)
    known = known.unionByName(shared_anchors(texts, known, groups))
    strings = earlier_strings(texts, known, groups)

    def finish(key, text: pa.Table, replies: pa.Table) -> pa.Table:
        again, found = split(replies, "p", {"a": np.int64, "b": np.uint32}), split(replies, "s", {"a": np.int64, "b": np.uint32})
        none, rows = np.empty(0, np.uint32), []
        for d, data in zip(text.column("doc_id").to_pylist(), text.column("data").to_pylist(), strict=True):
            kept, spans = kept_bytes(data, again.get(d, (none,))[0], found.get(d, (none,))[0]) if d in again or d in found else (data, 0)
            rows.append((d, kept, len(data), len(data) - len(kept), spans))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())))})

    replies = known.where("kind = 'p'").unionByName(strings)
    return texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(finish, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long").withColumn("doc_id", back())


def phrase_order(texts: list[bytes]) -> list[tuple[int, int]]:
    """(text, start) of all WIDTH-byte strings of a small corpus in lexicographic order, combined from the suffix orders of dictionary and parse."""
    cut = [(t, phrases(t, eights(t))) for t in texts]
    words = sorted({t[i : j + WIDTH - 1] for t, s in cut for i, j in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)})
    rank, where = {w: k for k, w in enumerate(words)}, {}
    for n, (t, s) in enumerate(cut):
        for i, j in zip(s[:-1].tolist(), s[1:].tolist(), strict=True):
            where.setdefault(rank[t[i : j + WIDTH - 1]], []).append((n, i))
    suffixes = sorted((w[o : o + WIDTH], k, o) for k, w in enumerate(words) for o in range(len(w) - WIDTH + 1))
    return [(n, i + o) for _, k, o in suffixes for n, i in where[k]]


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
