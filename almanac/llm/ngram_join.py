"""N-gram Jaccard join: a sparse product of the document by n-gram incidence matrix, in blocks.

Rows of the matrix are documents, columns 5-word shingles. Columns have one global order, by their number
of rows, so that what only few documents have comes first. Two similar sets of nx and ny shingles share at
least r = ceil(0.8 / 1.8 (nx + ny)) of them, and so at least FEW of the first nx - r + FEW of the one and the
first ny - r + FEW of the other: only those entries are multiplied, and a pair is dropped when the
overlap count accumulated over the blocks stays under FEW. Where an entry stands in its row thus gives the
largest partner that it still can find, its reach.

Exact copies are one row. Documents are worked on by groups, and a group sends one record for all its
documents of a column, so a column that a third of all documents have is a record a group. The product is
taken in two rounds, so that a large group of near copies costs rows in proportion to its size:

1. In each column every row is multiplied with the row of its size that has the farthest reach: among
   copies that is the one that the others were made from. Per row the partner with the highest
   overlap count is verified on the full shingle sets, and verified links are joined to classes.
2. Only rows of different classes are multiplied. A row travels only if the least size and
   the farthest reach that other classes have in its column allow a partner.

No pair that reaches the threshold can be missed: after round 2 each such pair is either
within a class or was verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.components import components
from almanac.llm.packed import NULL_ID, back, by_group, deal, gather, kept, mix, pieces, scatter, schema, scratch, settle, total_bytes, tune, with_id
from almanac.llm.words import shingles

#: Similarity in hundredths, and words of a shingle.
SIMILAR, K = 80, 5
#: Common entries of the shortened rows that a pair needs to be verified.
FEW = 4
#: Columns are counted by so many bits of their hash; those that share them are counted, and ordered, as one.
BITS = np.uint64((1 << 40) - 1)
#: Pairs that a task holds at once.
LOT = 1 << 20


def shared(nx, ny):
    """Shingles that sets of these sizes have in common at least if they are similar."""
    return -(-SIMILAR * (nx + ny) // (100 + SIMILAR))


def reach(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The largest set that can be similar to one of n entries if their first common entry stands at `at` of it, FEW - 1 of grace."""
    return (100 + SIMILAR) * (n - at + FEW - 1) // SIMILAR - n


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / SIMILAR)).astype(np.int64)


def fits(n: np.ndarray, far: np.ndarray, m: np.ndarray, far2: np.ndarray) -> np.ndarray:
    """Whether rows of sizes n and m that meet in a column can be similar, given their reaches there."""
    return (m <= far) & (n <= far2) & (100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m))


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def packed(table: pa.Table, **columns) -> list[np.ndarray]:
    """Packed columns of all rows, one array each."""
    return [gather(table, c, t) for c, t in columns.items()]


def sourced(group: np.ndarray, groups: int, src: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """As scatter, with the group that sends."""
    out = scatter(group, groups, columns)
    return pa.Table.from_batches([out]).append_column("src", pa.array([src] * out.num_rows, pa.int32()))


def per_source(table: pa.Table, **columns):
    """Packed columns of all rows, and for each entry the number of the row that it came in; the rows' sources."""
    arrays = packed(table, **columns)
    first, kind = next(iter(columns.items()))
    sizes = [len(x) // np.dtype(kind).itemsize for x in table.column(first).to_pylist()]
    return arrays, np.repeat(np.arange(len(sizes)), sizes), np.array(table.column("src").to_pylist(), np.int64)


def replied(src: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row for each group that gets something."""
    order = np.argsort(src, kind="stable")
    at = starts(src[order])
    cuts = [*at.tolist(), len(src)]
    arrays = [pa.array(src[order][at].astype(np.int32))]
    for c in columns.values():
        c = np.ascontiguousarray(c[order])
        arrays.append(pa.array([c[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.table(arrays, names=["g", *columns])


def grouped(docs: DataFrame, groups: int, doc: str, text: str) -> DataFrame:
    """(g, doc_id, data, same): documents by group; `same` is equal for equal texts."""
    rows = with_id(docs, doc, text).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), "doc_id", "data", F.unhex(F.md5("data")).alias("same"))
    return by_group(rows, groups)


def copies_of(texts: DataFrame) -> DataFrame:
    """(g, same, first): texts that several rows have, with the least doc_id that has them, once for each group that holds one: a text that a third of all rows have is one record a group."""
    rows = texts.where(F.col("data").cast("string").rlike(r"[^\x20\x09-\x0D]")).groupBy("g", "same").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    first = rows.groupBy("same").agg(F.min("least").alias("first"), F.sum("n").alias("n")).where("n > 1").select("same", "first")
    return settle(rows.select("g", "same").join(first, "same").select("g", "same", "first"))


def sets_of(text: pa.Table, copies: pa.Table) -> list[tuple[int, np.ndarray]]:
    """(doc_id, shingles) of a group's rows that are no copies, equal rows once."""
    first, done, out = dict(zip(copies.column("same").to_pylist(), copies.column("first").to_pylist(), strict=True)), set(), []
    for d, same, data in zip(text.column("doc_id").to_pylist(), text.column("same").to_pylist(), text.column("data"), strict=True):
        if first.get(same, d) == d and (d, same) not in done:
            done.add((d, same))
            out.append((d, shingles(data.as_py(), K)))
    return out


def counted(texts: DataFrame, copies: DataFrame, groups: int) -> DataFrame:
    """Packed replies (low, high, level) by group: the columns of its documents that have two rows or more."""

    def ask(key, text: pa.Table, gone: pa.Table) -> pa.Table:
        sets = [s & BITS for _, s in sets_of(text, gone)]
        h, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
        columns = {"low": h.astype(np.uint32), "high": (h >> np.uint64(32)).astype(np.uint8), "n": np.minimum(n, 2**32 - 1).astype(np.uint32)}
        return sourced((h % np.uint64(groups)).astype(np.int64), groups, key[0].as_py(), columns)

    def answer(table: pa.Table) -> pa.Table:
        (low, high, n), row, src = per_source(table, low=np.uint32, high=np.uint8, n=np.uint32)
        h = (high.astype(np.uint64) << np.uint64(32)) | low
        _, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)[at] if len(h) else n.astype(np.int64)
        some = total > 1
        level = np.minimum(255, 8 * np.log2(np.maximum(total[some], 1))).astype(np.uint8)
        return replied(src[row[some]], {"low": low[some], "high": high[some], "level": level})

    asked = texts.groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(ask, schema("low", "high", "n") + ", src int")
    return asked.groupBy("g").applyInArrow(answer, schema("low", "high", "level"))


def entries(texts: DataFrame, copies: DataFrame, groups: int) -> DataFrame:
    """Packed by group: the entries of shortened rows in shared columns (h, doc, n, far), and of each row the size and the least document with its text (own, size, first)."""
    levels = counted(texts, copies, groups)
    none = F.lit(None).cast("binary")
    known = copies.select("g", "first", "same", *(none.alias(c) for c in ("low", "high", "level"))).unionByName(levels.withColumns({"first": F.lit(None).cast("long"), "same": none}))

    def cut(key, text: pa.Table, replies: pa.Table) -> pa.Table:
        first, done = dict(zip(replies.column("same").to_pylist(), replies.column("first").to_pylist(), strict=True)), set()
        low, high, level = packed(replies, low=np.uint32, high=np.uint8, level=np.uint8)
        known = (high.astype(np.uint64) << np.uint64(32)) | low
        order = np.argsort(known)
        known, level = known[order], level[order]
        h, doc, n, far = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        own, sizes, firsts, seen = text.column("doc_id").to_numpy(), [], [], {}
        for d, same, data in zip(own.tolist(), text.column("same").to_pylist(), text.column("data"), strict=True):
            firsts.append(first.get(same, d))
            again = firsts[-1] != d or (d, same) in done
            if again and same in seen:
                sizes.append(seen[same])
                continue
            s = shingles(data.as_py(), K)
            size = seen[same] = len(s)
            sizes.append(size)
            if again or not len(known) or not size:
                continue
            done.add((d, same))
            low = s & BITS
            at = np.minimum(np.searchsorted(known, low), len(known) - 1)
            of = np.where(known[at] == low, level[at], 0)
            alone = int((of == 0).sum())
            most = size - shared(size, -(-SIMILAR * size // 100)) + FEW
            if alone < most:
                order = np.lexsort((s, of))[alone:most]
                h.append(s[order]), doc.append(np.full(len(order), d, np.int64)), n.append(np.full(len(order), size, np.int64))
                far.append(reach(size, np.arange(alone, alone + len(order))))
        h, doc, n, far = map(np.concatenate, (h, doc, n, far))
        out = {"h": h, "doc": doc, "n": n, "far": far, "own": own.astype(np.int64), "size": np.array(sizes, np.int64), "first": np.array(firsts, np.int64)}
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in out.items()}})

    return settle(texts.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(cut, schema("h", "doc", "n", "far", "own", "size", "first")))


def rows_of(entries_: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, first), a row for each row."""

    def rows(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            columns = packed(t, own=np.int64, size=np.int64, first=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "n_shingles", "first"])

    return entries_.select("own", "size", "first").mapInArrow(rows, "doc_id long, n_shingles long, first long")


def each_once(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (h, row)."""
    order = np.lexsort((row, h))
    at = order[starts(h[order], row[order])]
    return h[at], row[at]


def table_of(**columns: np.ndarray) -> pa.Table:
    return pa.table({k: pa.array(v) for k, v in columns.items()})


def best_partners(entries_: DataFrame, groups: int) -> DataFrame:
    """(x, hub): per document the row of farthest reach among those of its size that it meets most often."""

    def ask(key, table):
        h, doc, n, far = packed(table, h=np.uint64, doc=np.int64, n=np.int64, far=np.int64)
        size = size_class(n)
        order = np.lexsort((doc, -far, size, h))
        h, doc, n, far, size = (c[order] for c in (h, doc, n, far, size))
        at = starts(h, size)
        return sourced((h[at] % np.uint64(groups)).astype(np.int64), groups, key[0].as_py(), {"h": h[at], "doc": doc[at], "n": n[at], "far": far[at]})

    def answer(table: pa.Table) -> pa.Table:
        (h, doc, n, far), row, src = per_source(table, h=np.uint64, doc=np.int64, n=np.int64, far=np.int64)
        size = size_class(n)
        order = np.lexsort((doc, -far, size, h))
        at = order[starts(h[order], size[order])]
        # Every group gets the first row of each size in the columns that it has.
        mine, to = each_once(h, row)
        lo, hi = np.searchsorted(h[at], mine), np.searchsorted(h[at], mine, "right")
        each = hi - lo
        pick = at[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        return replied(np.repeat(src[to], each), {"h": h[pick], "doc": doc[pick], "n": n[pick], "far": far[pick]})

    def best(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        h, doc, n, far = packed(table, h=np.uint64, doc=np.int64, n=np.int64, far=np.int64)
        h2, doc2, n2, far2 = packed(replies, h=np.uint64, doc=np.int64, n=np.int64, far=np.int64)
        order = np.lexsort((n2, h2))
        h2, doc2, n2, far2 = h2[order], doc2[order], n2[order], far2[order]
        lo, hi = np.searchsorted(h2, h), np.searchsorted(h2, h, "right")
        x, hub = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for step in range(int((hi - lo).max()) if len(h) else 0):
            i = np.flatnonzero(lo + step < hi)
            j = lo[i] + step
            ok = (doc[i] != doc2[j]) & fits(n[i], far[i], n2[j], far2[j])
            x.append(doc[i[ok]]), hub.append(doc2[j[ok]])
        x, hub = np.concatenate(x), np.concatenate(hub)
        order = np.lexsort((hub, x))
        x, hub = x[order], hub[order]
        at = starts(x, hub)
        count = np.diff(np.append(at, len(x)))
        order = np.lexsort((hub[at], -count, x[at]))
        x, hub = x[at][order], hub[at][order]
        first = starts(x)
        return table_of(x=x[first], hub=hub[first])

    asked = entries_.groupBy("g").applyInArrow(ask, schema("h", "doc", "n", "far") + ", src int")
    hubs = asked.groupBy("g").applyInArrow(answer, schema("h", "doc", "n", "far"))
    return entries_.groupBy("g").cogroup(hubs.groupBy("g")).applyInArrow(best, "x long, hub long")


def verify(texts: DataFrame, pairs: DataFrame, groups: int) -> DataFrame:
    """Packed pairs (x, hub), by the group of x: those that are similar, as rows (x, hub). A hub's text goes once to each group that asks for it."""

    def ask(key, table):
        (hub,) = packed(table, hub=np.int64)
        hub = np.unique(hub)
        return sourced(deal(hub, groups).astype(np.int64), groups, key[0].as_py(), {"hub": hub})

    def give(key, text: pa.Table, wanted: pa.Table) -> pa.Table:
        (hub,), row, src = per_source(wanted, hub=np.int64)
        order = np.argsort(hub, kind="stable")
        hub, to = hub[order], src[row[order]]
        out = {"g": [], "doc_id": [], "data": []}
        for d, data in zip(text.column("doc_id").to_pylist(), text.column("data"), strict=True):
            lo, hi = np.searchsorted(hub, d), np.searchsorted(hub, d, "right")
            if lo < hi:
                data = data.as_py()
                out["g"] += to[lo:hi].tolist()
                out["doc_id"] += [d] * int(hi - lo)
                out["data"] += [data] * int(hi - lo)
        return pa.table({"g": pa.array(out["g"], pa.int32()), "doc_id": pa.array(out["doc_id"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    none = F.lit(None).cast("binary")
    wanted = pairs.groupBy("g").applyInArrow(ask, schema("hub") + ", src int")
    given = texts.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(give, "g int, doc_id long, data binary")
    replies = given.select("g", "doc_id", "data", none.alias("x"), none.alias("hub")).unionByName(pairs.select("g", F.lit(None).cast("long").alias("doc_id"), none.alias("data"), "x", "hub"))

    def check(key, text: pa.Table, replies: pa.Table) -> pa.Table:
        x, hub = packed(replies, x=np.int64, hub=np.int64)
        wanted, theirs, mine = set(x.tolist()), {}, {}
        for rows, out, some in ((text, mine, wanted), (replies, theirs, None)):
            for d, data in zip(rows.column("doc_id").to_pylist(), rows.column("data"), strict=True):
                if d is not None and (some is None or d in some):
                    out.setdefault(d, []).append(shingles(data.as_py(), K))
        ok = [any(similar(a, b) for a in mine.get(i, ()) for b in theirs.get(j, ())) for i, j in zip(x.tolist(), hub.tolist(), strict=True)]
        ok = np.array(ok, bool)
        return table_of(x=x[ok], hub=hub[ok])

    return settle(texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(check, "x long, hub long"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def packed_pairs(pairs: DataFrame, groups: int) -> DataFrame:
    """Pairs (x, hub) packed by the group of x."""

    def pack(batches):
        for b in batches:
            x, hub = b.column("x").to_numpy(zero_copy_only=False), b.column("hub").to_numpy(zero_copy_only=False)
            if len(x):
                yield scatter(deal(x, groups), groups, {"x": x, "hub": hub})

    return pairs.mapInArrow(pack, schema("x", "hub"))


def two_best(h: np.ndarray, c: np.ndarray, value: np.ndarray):
    """Per h the least value, its class, and the least value of any other class (NULL_ID if there is none). h is sorted; one row per (h, c)."""
    order = np.lexsort((c, value, h))
    h, c, value = h[order], c[order], value[order]
    at = starts(h)
    size = np.diff(np.append(at, len(h)))
    return value[at], c[at], np.where(size > 1, value[np.minimum(at + 1, len(h) - 1)], NULL_ID)


def cross_pairs(entries_: DataFrame, labels: DataFrame, groups: int) -> DataFrame:
    """Packed pairs (x, hub) of documents of different classes whose accumulated overlap is FEW at least, by the group of x."""
    none = F.lit(None).cast("binary")
    labels = labels.select(F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int").alias("g"), "node", "component")

    def classed(table: pa.Table, known: pa.Table):
        h, doc, n, far = packed(table, h=np.uint64, doc=np.int64, n=np.int64, far=np.int64)
        known = known.filter(pa.compute.is_valid(known.column("node")))
        node, of = known.column("node").to_numpy(), known.column("component").to_numpy()
        order = np.argsort(node)
        node, of = node[order], of[order]
        at = np.minimum(np.searchsorted(node, doc), len(node) - 1)
        return h, doc, n, far, np.where(node[at] == doc, of[at], doc) if len(node) else doc

    def ask(key, table: pa.Table, known: pa.Table) -> pa.Table:
        h, doc, n, far, c = classed(table, known)
        order = np.lexsort((c, h))
        h, n, far, c = h[order], n[order], far[order], c[order]
        at = starts(h, c)
        least, most = (np.minimum.reduceat(n, at), np.maximum.reduceat(far, at)) if len(at) else (n, far)
        return sourced((h[at] % np.uint64(groups)).astype(np.int64), groups, key[0].as_py(), {"h": h[at], "c": c[at], "least": least, "most": most})

    def answer(table: pa.Table) -> pa.Table:
        (h, c, least, most), row, src = per_source(table, h=np.uint64, c=np.int64, least=np.int64, most=np.int64)
        order = np.lexsort((c, h))
        at = starts(h[order], c[order])
        if len(at):
            hh, cc = h[order][at], c[order][at]
            n1, c1, n2 = two_best(hh, cc, np.minimum.reduceat(least[order], at))
            f1, d1, f2 = two_best(hh, cc, -np.maximum.reduceat(most[order], at))
            one = np.unique(hh)
        else:
            one = h
            n1 = c1 = n2 = f1 = d1 = f2 = c
        mixed = n2 < NULL_ID
        one, n1, c1, n2, f1, d1, f2 = (v[mixed] for v in (one, n1, c1, n2, f1, d1, f2))
        mine, to = each_once(h, row)
        k = np.minimum(np.searchsorted(one, mine), max(0, len(one) - 1))
        ok = one[k] == mine if len(one) else np.zeros(len(mine), bool)
        k, to = k[ok], src[to[ok]]
        return replied(to, {"h": one[k], "n1": n1[k], "c1": c1[k], "n2": n2[k], "f1": -f1[k], "d1": d1[k], "f2": -f2[k]})

    def travel(key, table: pa.Table, known: pa.Table) -> pa.Table:
        h, doc, n, far, c = classed(table, known)
        one, n1, c1, n2, f1, d1, f2 = packed(known, h=np.uint64, n1=np.int64, c1=np.int64, n2=np.int64, f1=np.int64, d1=np.int64, f2=np.int64)
        order = np.argsort(one)
        one, n1, c1, n2, f1, d1, f2 = (v[order] for v in (one, n1, c1, n2, f1, d1, f2))
        k = np.minimum(np.searchsorted(one, h), max(0, len(one) - 1))
        ok = (one[k] == h) & (np.where(c1[k] == c, n2[k], n1[k]) <= far) & (np.where(d1[k] == c, f2[k], f1[k]) >= n) if len(one) else np.zeros(len(h), bool)
        h, doc, n, far, c = h[ok], doc[ok], n[ok], far[ok], c[ok]
        # A block is a column and a size; rows meet those of their size and, as partners, those of the next larger.
        size = size_class(n)
        group = mix(np.concatenate([h, h]) ^ np.concatenate([size, size + 1]).astype(np.uint64)) % np.uint64(groups)
        both = {k: np.concatenate([v, v]) for k, v in {"h": h, "doc": doc, "n": n, "far": far, "c": c}.items()}
        both |= {"size": np.concatenate([size, size + 1]).astype(np.int16), "own": np.repeat(np.array([1, 0], np.uint8), len(h))}
        return pa.Table.from_batches([scatter(group.astype(np.int64), groups, both)])

    def multiply(table: pa.Table) -> pa.Table:
        h, doc, n, far, c, size, own = packed(table, h=np.uint64, doc=np.int64, n=np.int64, far=np.int64, c=np.int64, size=np.int16, own=np.uint8)
        order = np.lexsort((n, size, h))
        h, doc, n, far, c, size, own = (v[order] for v in (h, doc, n, far, c, size, own))
        at = starts(h, size)
        block = np.zeros(len(h), np.int64)
        block[at[1:]] = 1
        block = np.cumsum(block)
        # Rows in order of size within their block: the partners of a row as large or larger are a stretch that its reach ends.
        top = np.int64(int(max(n.max(initial=0), far.max(initial=0))) + 2)
        place = block * top + n
        hi = np.searchsorted(place, block * top + np.clip(np.minimum(far, 100 * n // SIMILAR), 0, top - 1), "right")
        lo = np.arange(len(h)) + 1
        each = np.maximum(0, hi - lo)
        found = {}
        ends = np.cumsum(each)
        i = 0
        while i < len(h):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + LOT, "right")))
            k = each[i:j]
            a = np.repeat(np.arange(i, j), k)
            b = np.repeat(lo[i:j] - (ends[i:j] - k), k) + np.arange(k.sum()) + done
            ok = (c[a] != c[b]) & (n[a] <= far[b]) & (doc[a] != doc[b]) & ((own[a] > 0) | (own[b] > 0))
            a, b = a[ok], b[ok]
            x, y = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
            nx, ny = np.where(doc[a] < doc[b], n[a], n[b]), np.where(doc[a] < doc[b], n[b], n[a])
            order = np.lexsort((ny, nx, y, x))
            x, y, nx, ny = x[order], y[order], nx[order], ny[order]
            s = starts(x, y, nx, ny)
            for key, m in zip(zip(x[s].tolist(), y[s].tolist(), nx[s].tolist(), ny[s].tolist(), strict=True), np.diff(np.append(s, len(x))).tolist(), strict=True):
                found[key] = found.get(key, 0) + m
            i = j
        rows = np.array([(*k, m) for k, m in found.items()], np.int64).reshape(-1, 5)
        group = mix(rows[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(rows[:, 1].astype(np.uint64))) % np.uint64(groups)
        return pa.Table.from_batches([scatter(group.astype(np.int64), groups, {k: rows[:, i] for i, k in enumerate(("x", "y", "nx", "ny", "overlap"))})])

    def accumulate(table: pa.Table) -> pa.Table:
        x, y, nx, ny, m = packed(table, x=np.int64, y=np.int64, nx=np.int64, ny=np.int64, overlap=np.int64)
        order = np.lexsort((ny, nx, y, x))
        x, y, nx, ny, m = (v[order] for v in (x, y, nx, ny, m))
        at = starts(x, y, nx, ny)
        m = np.add.reduceat(m, at) if len(at) else m
        ok = m >= np.minimum(FEW, shared(nx[at], ny[at]))
        x, y = x[at][ok], y[at][ok]
        # The one of more pairs is the hub.
        ids, k = np.unique(np.concatenate([x, y]), return_inverse=True)
        count = np.bincount(k, minlength=len(ids))
        swap = count[k[: len(x)]] > count[k[len(x) :]]
        a, b = np.where(swap, y, x), np.where(swap, x, y)
        return pa.Table.from_batches([scatter(deal(a, groups), groups, {"x": a, "hub": b})])

    names = ("h", "n1", "c1", "n2", "f1", "d1", "f2")
    by = entries_.groupBy("g")
    asked = by.cogroup(labels.groupBy("g")).applyInArrow(ask, schema("h", "c", "least", "most") + ", src int")
    replies = asked.groupBy("g").applyInArrow(answer, schema(*names))
    known = labels.select("g", "node", "component", *(none.alias(c) for c in names)).unionByName(replies.withColumns({"node": F.lit(None).cast("long"), "component": F.lit(None).cast("long")}))
    rows = by.cogroup(known.groupBy("g")).applyInArrow(travel, schema("h", "doc", "n", "far", "c", "size", "own"))
    products = rows.groupBy("g").applyInArrow(multiply, schema("x", "y", "nx", "ny", "overlap"))
    return settle(products.groupBy("g").applyInArrow(accumulate, schema("x", "hub")))


def ngram_join(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Null or empty texts have no shingles and stand alone. Rows that share an id are one
    document in the graph; a null id is treated as one id after all others and returned as null.
    Columns other than the two named are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    with scratch(spark):
        groups = pieces(total_bytes(docs, text))
        texts = grouped(docs, groups, doc, text)
        copies = copies_of(texts)
        found = entries(texts, copies, groups)
        first = verify(texts, packed_pairs(best_partners(found, groups), groups), groups)
        labels = components(first, "x", "hub")
        more = verify(texts, cross_pairs(found, labels, groups), groups)
        sizes = rows_of(found)
        same = sizes.where("doc_id > first").select(F.col("doc_id").alias("x"), F.col("first").alias("hub"))
        labels = components(labels.select(F.col("node").alias("x"), F.col("component").alias("hub")).unionByName(more).unionByName(same), "x", "hub")
        out = sizes.join(labels, sizes["doc_id"] == labels["node"], "left").select(back().alias("doc_id"), "n_shingles", back("component").alias("c"))
        return kept(out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the least of its group, all columns as they are. Rows without an id stand alone and stay."""
    found = ngram_join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, (SELECT min(y) FROM r WHERE r.x = d.doc_id)), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
