"""Fuzzy passages that an earlier document has, by seeding, collinear chaining and alignment.

Seeds are runs of K consecutive words (A-Z as a-z), of these the one in SPARSE that its own hash picks: what
two texts share of runs, they share of seeds, whatever stands around them. Occurrences of a seed meet in its
hash bucket. Those of a seed with at most ALL of them are matched with all in earlier documents. Those of a frequent
seed are first matched with the seed's first document and with the document just before their own: matches
grow with the occurrences, not with their pairs, and most passages that many documents have are found so. A passage
with two seeds that are not frequent is found by these, in whatever document it is. Of others, near words that no passage
covers yet, a second way asks all earlier holders of every frequent seed: each occurrence carries the frequent
seeds around it as bits, and a pair is passed on where it has some of those in common too (see `around`), one of them across a word
that no passage covers: documents that share just what is covered in both are no pair.
What adds nothing to the words covered is not reported, so of a passage that many documents have, some holder is, not every one.
Per pair of documents the matches, merged along diagonals,
are chained: a chain goes forward in both texts and pays for gaps, and the best predecessor of a
match is a prefix maximum in a Fenwick tree. The words of a chain's earlier text are then
fetched and aligned with the later one; passages of at least PASSAGE words that agree in
SIMILAR of them are reported for the later document.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packed import back, by_group, deal, gather, kept, mix, pieces, scatter, schema, scratch, settle, split, swept, total_bytes, tune, with_group
from almanac.llm.words import ODD, hashes, runs

K, SPARSE = 4, 2
PASSAGE, SIMILAR = 50, 0.8
#: Cost of a word in a gap, and words looked at beyond either end of a chain.
GAP, MARGIN = 0.125, 24
#: Occurrences of a seed up to which each is matched with all others in earlier documents at once.
ALL = 8
#: Words around a frequent seed in which an asking occurrence looks for another frequent one, and a holder, whose gaps may differ.
NEAR, FAR, SLACK = 16, 62, 14
#: Words of a stretch of frequent seeds that could be most of a passage by itself, and of one that leaves so many equal words beyond that they hold two more seeds.
BLOCK, LITTLE = 36, 24
#: Bit maps of the seeds around, each by its own hash: a pair is passed on where all have a bit in common, so few pass by chance.
MAPS = 3
#: Pairs tried and matches sent at once in the second way, the rows of a table of pairs of a frequent key, and matches merged at once.
TABLE, ROWS, LOT = 1 << 17, 32, 1 << 18
#: Rows of a packed table that are read at once, and Spark's setting of these.
BATCH, READ = 64, "spark.sql.parquet.columnarReaderBatchSize"
#: Of the words fetched: a word's number comes again and again, which the codec of Spark's exchanges hardly sees.
CODEC = "zstd"
COLUMNS = ("d", "x", "e", "y", "h", "doc", "at")


def numbered(docs: DataFrame) -> DataFrame:
    """(g, doc_id, data) with the words, A-Z as a-z, as numbers in place of the text: hashed once for all rounds."""

    def number(batches):
        for b in batches:
            words = pa.array([hashes(t.as_py().lower().split()).tobytes() for t in b.column("data")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("doc_id"), words], names=["g", "doc_id", "numbers"])

    return docs.mapInArrow(number, "g int, doc_id long, numbers binary")


def numbers(table: pa.Table | pa.RecordBatch) -> Iterator[np.ndarray]:
    """The words of each text as numbers: those of `numbered`, or of texts as `data`."""
    if "numbers" in table.schema.names:
        return (np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("numbers"))
    return (hashes(t.as_py().lower().split()) for t in table.column("data"))


def seeds(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, texts and word positions of the seeds."""
    n = np.array([len(t) for t in texts])
    if n.sum() < K:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32)
    h = runs(np.concatenate(texts), K)
    inside = mix(h) % np.uint64(SPARSE) == 0
    # Runs that would go on in the next text.
    ends = np.cumsum(n)[:, None] - np.arange(1, K)
    inside[ends[(ends >= 0) & (ends < len(h))]] = False
    at = np.flatnonzero(inside)
    of = np.searchsorted(np.cumsum(n), at, "right")
    return h[at], of, (at - (np.cumsum(n) - n)[of]).astype(np.uint32)


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Over the first i items."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def merged(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (pair, x, y, words), sorted so, of matches of a pair on one diagonal that overlap or touch, so each of their words was seen to be equal."""
    diagonal = y - x
    order = np.lexsort((x, diagonal, pair))
    pair, x, diagonal = pair[order], x[order], diagonal[order]
    new = np.append(True, (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (x[1:] - x[:-1] > K)) if len(x) else np.empty(0, bool)
    at = np.flatnonzero(new)
    words = x[np.append(at[1:], len(x)) - 1] - x[at] + K if len(x) else x
    pair, x, y = pair[at], x[at], x[at] + diagonal[at]
    order = np.lexsort((words, y, x, pair))
    return pair[order], x[order], y[order], words[order]


def chains(matches: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains, best first, of runs (x, y, words). The score of a chain is its words less its gaps' costs."""
    if len(matches) == 1:
        return [matches]
    n = len(matches)
    ends = sorted({y + w for _, y, w in matches})
    rank = {e: i for i, e in enumerate(ends)}
    tree, score, before = Fenwick(len(ends)), [0.0] * n, [-1] * n
    # Runs become available as predecessors once the sweep over x has passed their ends.
    by_end = sorted(range(n), key=lambda i: matches[i][0] + matches[i][2])
    done = 0
    for i in sorted(range(n), key=lambda i: matches[i][:2]):
        x, y, w = matches[i]
        while done < n and matches[by_end[done]][0] + matches[by_end[done]][2] <= x:
            j = by_end[done]
            xj, yj, wj = matches[j]
            tree.put(rank[yj + wj], (score[j] + GAP * (xj + yj + 2 * wj) / 2, j))
            done += 1
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= y else (lo, mid)
        value, j = tree.get(lo)
        gain = value - GAP * (x + y) / 2
        score[i], before[i] = (w + gain, j) if j >= 0 and gain > 0 else (float(w), -1)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(matches[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def agree(a, b) -> int:
    """Words of a that an alignment of a and b with fewest edits leaves as they are, whatever their lengths.

    Bit-parallel: a row of the table of common subsequences is one whole number, and each word of b is one addition to it.
    """
    if not len(a) or not len(b):
        return 0
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        held = row & places.get(y, 0)
        row = ((row + held) | (row - held)) & full
    return len(a) - row.bit_count()


def common(a: list, b: list) -> int:
    """Words of a that b has too, at least as many as any alignment leaves equal."""
    return sum(map(set(b).__contains__, a))


def beyond(a: list, b: list) -> list[tuple[int, int, int]]:
    """(words of a, words of b, equal words) of the alignments of beginnings of a and b that end with an equal word, the best for each end in a."""
    out, above, held = [(0, 0, 0)], [0] * (len(b) + 1), set(b)
    for i, x in enumerate(a, 1):
        if x not in held:
            # The row of a word that b lacks is the row above.
            continue
        row, best = [0], None
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] + 1 if x == y else max(above[j], row[-1]))
            if x == y and (best is None or row[-1] - SIMILAR * max(i, j) > best[2] - SIMILAR * max(i, best[1])):
                best = (i, j, row[-1])
        if best:
            out.append(best)
        above = row
    return out


def passage(mine: list[int], theirs: list[int], offset: int, chain) -> tuple[int, int, int, float] | None:
    """(start, words, start there, similarity) of a chain aligned and stretched; theirs starts at word `offset` of its text."""
    x, y = chain[0][0], chain[0][1] - offset
    while x > 0 and y > 0 and mine[x - 1] == theirs[y - 1]:
        x, y = x - 1, y - 1
    start, there = x, y + offset
    same = 0
    for n, (cx, cy, w) in enumerate(chain):
        cy -= offset
        if cx > x or cy > y:
            same += agree(mine[x:cx], theirs[y:cy]) if n else cx - x
        skip = max(0, x - cx, y - cy)
        x, y, same = max(x, cx + w), max(y, cy + w), same + max(0, w - skip)
    while x < len(mine) and y < len(theirs) and mine[x] == theirs[y]:
        x, y, same = x + 1, y + 1, same + 1
    # Beyond changed words at either end: the longest stretch that is still similar.
    n, m = x - start, y + offset - there
    y0 = there - offset
    before = mine[max(0, start - MARGIN) : start][::-1], theirs[max(0, y0 - MARGIN) : y0][::-1]
    after = mine[x : x + MARGIN], theirs[y : y + MARGIN]
    # No alignment has more equal words than the texts have in common.
    if same + common(*before) + common(*after) < SIMILAR * PASSAGE:
        return (start, n, there, same / max(n, m)) if n >= PASSAGE else None
    left, right = beyond(*before), beyond(*after)
    fit = [(n + i + k, (same + s + t) / max(n + i + k, m + j + o), i, j) for i, j, s in left for k, o, t in right]
    fit = [f for f in fit if f[0] >= PASSAGE and f[1] >= SIMILAR]
    if fit:
        words, similar, i, j = max(fit)
        return start - i, words, there - j, similar
    return (start, n, there, same / max(n, m)) if n >= PASSAGE else None


def passages(mine: list[int], theirs: list[int], offset: int, chain) -> list[tuple[int, int, int, float]]:
    """The similar passages of a chain: all of it, or those of its two sides where it gives way at its widest gap."""
    # Ends are stretched by MARGIN words while equal, and by as many again while similar.
    near = mine[max(0, chain[0][0] - 2 * MARGIN) : chain[-1][0] + chain[-1][2] + 2 * MARGIN]
    if common(theirs[max(0, chain[0][1] - offset - 2 * MARGIN) : chain[-1][1] + chain[-1][2] - offset + 2 * MARGIN], near) < SIMILAR * PASSAGE:
        return []
    found = passage(mine, theirs, offset, chain)
    if not found or found[3] >= SIMILAR:
        return [found] if found else []
    if len(chain) == 1:
        return []
    gaps = [max(b[0] - a[0] - a[2], b[1] - a[1] - a[2]) for a, b in zip(chain, chain[1:], strict=False)]
    at = gaps.index(max(gaps)) + 1
    return passages(mine, theirs, offset, chain[:at]) + passages(mine, theirs, offset, chain[at:])


def earlier(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mine, theirs, hot) of arrays sorted by key and document: pairs of occurrences of a key in different documents, and which occurrences belong to frequent keys.

    Of keys with at most ALL occurrences these are all pairs. Others are frequent: of these come the occurrences in their first document and in the one just before,
    there the one of the same number (counted round where it has fewer), the first and the last; `rest_matches` asks the others.
    """
    n = np.arange(len(h))
    key_new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
    doc_new = key_new | (np.append(True, doc[1:] != doc[:-1]) if len(h) else key_new)
    first = np.maximum.accumulate(np.where(key_new, n, 0))
    own = np.maximum.accumulate(np.where(doc_new, n, 0))
    hot = np.bincount(first, minlength=len(h))[first] > ALL
    x, y = [n[:0]], [n[:0]]
    for step in range(1, ALL):
        i = n[~hot & (own - step >= first)]
        x.append(i), y.append(own[i] - step)
    size = np.bincount(own, minlength=len(h))
    later = hot & (own > first)
    prior = np.where(later, own[np.maximum(own - 1, 0)], first)
    for to, ok in ((first, later), (prior, later & (prior != first))):
        last = to + size[to] - 1
        same = to + (n - own) % np.maximum(size[to], 1)
        for at, more in ((same, ok), (to, ok & (same != to)), (last, ok & (same != last) & (last != to))):
            x.append(n[more]), y.append(at[more])
    return np.concatenate(x), np.concatenate(y), hot


def seed_matches(texts: DataFrame, groups: int) -> DataFrame:
    """Packed by document: matches (d, x, e, y) by the group of the later document d, and the frequent seeds (h, doc, at)."""

    def ask(batches):
        for b in batches:
            h, of, at = seeds(list(numbers(b)))
            if len(h):
                yield scatter((h % np.uint64(groups)).astype(np.int64), groups, {"h": h, "doc": b.column("doc_id").to_numpy().astype(np.int64)[of], "at": at})

    def answer(table: pa.Table) -> pa.Table:
        h, doc, at = gather(table, "h", np.uint64), gather(table, "doc", np.int64), gather(table, "at", np.uint32)
        # Most seeds occur once and need no further order.
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        order = order[np.append(False, same) | np.append(same, False)] if len(h) else order
        h, doc, at = h[order], doc[order], at[order]
        order = np.lexsort((at, doc, h))
        h, doc, at = h[order], doc[order], at[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        end = np.append(edge[1:], len(h)) if len(h) else edge
        several = np.repeat(doc[edge] < doc[end - 1], end - edge)
        h, doc, at = h[several], doc[several], at[several]
        x, y, hot = earlier(h, doc)
        # By document, so that ids repeat and take little room.
        order = np.lexsort((at[x], doc[x]))
        x, y = x[order], y[order]
        matches = scatter(deal(doc[x], groups), groups, {"d": doc[x], "x": at[x], "e": doc[y], "y": at[y]})
        shared = scatter(deal(doc[hot], groups), groups, {"h": h[hot], "doc": doc[hot], "at": at[hot]})
        tables = [pa.Table.from_batches([t]) for t in (matches, shared)]
        return pa.concat_tables([pa.table({c: t.column(c) if c in t.column_names else pa.nulls(t.num_rows, pa.int32() if c == "g" else pa.binary()) for c in ("g", *COLUMNS)}) for t in tables])

    return settle(texts.mapInArrow(ask, schema("h", "doc", "at")).groupBy("g").applyInArrow(answer, schema(*COLUMNS)))


def around(h: np.ndarray, doc: np.ndarray, at: np.ndarray, of: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bits of the frequent seeds to the left and right of the seeds `of`, as asked for, of these across words not covered, and as held, a hash of all that are held and where, and how many asked for are to be found, of arrays sorted by document and place. `inside` numbers the covered stretch that a seed is in, -1 for none.

    Asked for are seeds NEAR to FAR words away: equal words that reach 20 words or more have such a pair. Of a stretch of frequent
    seeds under BLOCK words, which another text may have alone, only those beyond it are, since a passage has 40 equal words.
    Held are those that far away give or take SLACK words, as gaps in one text may be longer than in the other. A seed that comes again
    on one side is another one there, so a line that is repeated asks for repeated lines.
    """
    n, at = len(h), at.astype(np.int64)
    bits = [np.uint64(1) << ((mix(x)[:, None] >> (np.uint64(6) * np.arange(MAPS, dtype=np.uint64) + np.uint64(64 - 6 * MAPS))) & np.uint64(63)) for x in (h, ~h)]
    change = lambda x: np.append(True, x)[: len(h)]
    new = change(doc[1:] != doc[:-1])
    line = (np.cumsum(new) << 33) + at
    start, stop = limits(new | change(at[1:] - at[:-1] > 2 * K))
    length = at[stop - 1] + K - at[start]
    short = length < BLOCK
    # Of a seed in a covered stretch, others are across where that stretch has ended.
    own, end = limits(new | change(inside[1:] != inside[:-1]))
    own, end = np.where(inside < 0, np.arange(n), own), np.where(inside < 0, np.arange(n) + 1, end)
    to = lambda far, side: np.searchsorted(line, line + far, side)
    # Windows (from, to) of each seed: asked for, of these across, and held.
    left = [(to(-FAR, "left"), np.where(short, start, to(-NEAR, "right"))), (), (to(-FAR - SLACK, "left"), to(SLACK - NEAR, "right"))]
    right = [(np.where(short, stop, to(NEAR, "left")), to(FAR, "right")), (), (to(NEAR - SLACK, "left"), to(FAR + SLACK, "right"))]
    left[1], right[1] = (left[0][0], np.minimum(left[0][1], own)), (np.maximum(right[0][0], end), right[0][1])
    # A hash of what is held at which distance, from sums along the documents.
    lo, hi = left[2][0], right[2][1]
    term = mix(h) * power(int(ODD), at)
    total = np.append(np.uint64(0), np.cumsum(term))
    like = (total[hi] - total[lo] - term) * power(pow(int(ODD), -1, 1 << 64), at)
    # Seeds that come again, and of which seeds' windows to the left and right both are.
    order = np.lexsort((at, doc, h))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    one, two = order[:-1][same], order[1:][same]
    near = at[two] - at[one] <= FAR + SLACK
    reach = lambda a, b: np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0
    again = (reach(two[near] + 1, np.maximum(hi[one[near]], two[near] + 1)), reach(np.minimum(lo[two[near]], one[near]), one[near]))
    out, steps = [], levels(bits[0], max((int((b - a).max()) for a, b in (left[2], right[2])), default=1) if n else 1)
    for sign, windows, several in ((-1, left, again[0][of]), (1, right, again[1][of])):
        maps = [joined(steps, a[of], b[of]) for a, b in windows]
        other = np.full(n, -1 if sign > 0 else n)
        other[two if sign > 0 else one] = one if sign > 0 else two
        i = np.flatnonzero(several)
        for m in maps:
            m[i] = 0
        step = 1
        while len(i):
            j = of[i] + sign * step
            ok = (j >= lo[of[i]]) & (j < hi[of[i]])
            i, j = i[ok], j[ok]
            bit = np.where((other[j] > of[i] if sign > 0 else other[j] < of[i])[:, None], bits[1][j], bits[0][j])
            for m, (a, b) in zip(maps, windows, strict=True):
                ok = (j >= a[of[i]]) & (j < b[of[i]])
                m[i[ok]] |= bit[ok]
            step += 1
        out += maps
    return *out, like[of], np.where((length[of] < LITTLE) | (length[of] >= BLOCK), 2, 1).astype(np.uint8)


def limits(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretch of each item, of stretches that begin where `new`."""
    at = np.append(np.flatnonzero(new), len(new))
    of = np.cumsum(new) - 1
    return at[of], at[of + 1]


def power(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n, modulo 2 ** 64."""
    out = np.ones(len(n), np.uint64)
    for k in range(int(n.max(initial=0)).bit_length()):
        out[(n >> k & 1) == 1] *= np.uint64(pow(base, 1 << k, 1 << 64))
    return out


def levels(bits: np.ndarray, most: int) -> list[np.ndarray]:
    """Bits of the 1, 2, 4, ... items from each on, up to `most`."""
    out = [bits]
    while 2 << len(out) - 1 <= most:
        half = 1 << len(out) - 1
        out.append(out[-1].copy())
        out[-1][:-half] |= out[-2][half:]
    return out


def joined(steps: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The bits of all items from start to before stop, of two stretches that may overlap."""
    out = np.zeros((len(start), MAPS), np.uint64)
    n = stop - start
    for k, step in enumerate(steps):
        i = np.flatnonzero((n >= 1 << k) & (n < 2 << k))
        out[i] = step[start[i]] | step[stop[i] - (1 << k)]
    return out


def rest_matches(shared: DataFrame, found: DataFrame, groups: int) -> DataFrame:
    """Packed matches (d, x, e, y) by the group of d: of frequent seeds near words that no passage in `found` covers, with all earlier holders that have others of the frequent seeds around, one of them across such a word.

    Occurrences in one earlier document that have the same frequent seeds around, at the same places, are the same to ask: of these comes the one of the same number, counted round.
    """

    def ask(key, table: pa.Table, cover: pa.Table) -> pa.Table:
        h, doc, at = (gather(table, c, t) for c, t in (("h", np.uint64), ("doc", np.int64), ("at", np.uint32)))
        order = np.lexsort((at, doc))
        h, doc, at = h[order], doc[order], at[order]
        # Of one word repeated, the seeds at its ends, which hold other words too, place a passage; those within only its length.
        row = np.append((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] == 1), False) if len(h) else np.empty(0, bool)
        of = np.flatnonzero(~row & ~np.append(False, row[:-1])) if len(h) else np.empty(0, np.int64)
        # Disjoint covered stretches on one line: documents one after the other.
        d, lo, n = (cover.column(c).to_numpy() for c in ("doc_id", "sure_word", "n_sure"))
        order = np.lexsort((lo, d))
        d, lo, hi = d[order], lo[order], (lo + n)[order]
        known = np.unique(d)
        line = lambda i, p: np.searchsorted(known, i).astype(np.int64) * (1 << 33) + p
        lo, hi = line(d, lo), np.maximum.accumulate(line(d, hi)) if len(d) else d
        new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1])) if len(d) else np.empty(0, np.int64)
        starts, stops = lo[new], hi[np.append(new[1:], len(lo)) - 1] if len(new) else hi
        inside = np.full(len(h), -1)
        if len(known):
            place = at.astype(np.int64)
            k = np.searchsorted(starts, line(doc, place), "right") - 1
            i = np.minimum(np.searchsorted(known, doc), len(known) - 1)
            ok = (known[i] == doc) & (k >= 0) & (stops[np.maximum(k, 0)] >= line(doc, place + K))
            inside[ok] = k[ok]
        found_ = around(h, doc, at, of, inside)
        some = (found_[2] | found_[5])[:, 0] != 0
        of, left, left_across, left_held, right, right_across, right_held, like, need = (c[some] for c in (of, *found_))
        # What has no frequent seed across words not covered is held, but does not ask.
        idle = ((left_across | right_across) == 0).any(1)
        left[idle], right[idle] = 0, 0
        maps = {c: m.view(f"V{8 * MAPS}").ravel() for c, m in (("l", left), ("r", right), ("la", left_across), ("ra", right_across), ("lh", left_held), ("rh", right_held))}
        columns = {"h": h[of], "doc": doc[of], "at": at[of], **maps, "like": like, "need": need}
        return pa.Table.from_batches([scatter((h[of] % np.uint64(groups)).astype(np.int64), groups, columns)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        h, doc, at = gather(table, "h", np.uint64), gather(table, "doc", np.int64), gather(table, "at", np.uint32)
        l, r, la, ra, lh, rh = (gather(table, c, np.dtype((np.uint64, MAPS))) for c in ("l", "r", "la", "ra", "lh", "rh"))
        like, need = gather(table, "like", np.uint64), gather(table, "need", np.uint8)
        del table
        order = np.lexsort((at, like, doc, h))
        h, doc, at, l, r, la, ra, lh, rh, like, need = (c[order] for c in (h, doc, at, l, r, la, ra, lh, rh, like, need))
        n = np.arange(len(h))
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
        first = np.maximum.accumulate(np.where(new, n, 0))
        new = new | (np.append(True, doc[1:] != doc[:-1]) if len(h) else new)
        own = np.maximum.accumulate(np.where(new, n, 0))
        new = new | (np.append(True, like[1:] != like[:-1]) if len(h) else new)
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.append(start, len(h)))
        number = n - start[group] if len(h) else n
        # Two seeds can have one bit, then one is enough.
        least = np.minimum(need, (np.bitwise_count(l) + np.bitwise_count(r)).min(1)) if len(h) else need
        asks = np.flatnonzero(((l | r)[:, 0] != 0) & (own > first))
        l, r, la, ra = (np.ascontiguousarray(c.T) for c in (l, r, la, ra))
        lh, rh = (np.ascontiguousarray(c[start].T) for c in (lh, rh))
        found_, some = [], 0
        for i, g in tried(asks, group[first[asks]], group[own[asks]], la[0], ra[0], lh[0], rh[0]):
            for m in range(1, MAPS):
                ok = ((la[m][i] & lh[m][g]) | (ra[m][i] & rh[m][g])) != 0
                i, g = i[ok], g[ok]
            for m in range(MAPS):
                ok = np.bitwise_count(l[m][i] & lh[m][g]) + np.bitwise_count(r[m][i] & rh[m][g]) >= least[i]
                i, g = i[ok], g[ok]
            found_.append((i, start[g] + number[i] % size[g]))
            some += len(i)
            if some >= TABLE:
                yield sent(found_, doc, at)
                found_, some = [], 0
        if some:
            yield sent(found_, doc, at)

    def sent(found_: list, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        i, y = (np.concatenate(c) for c in zip(*found_, strict=True))
        return scatter(deal(doc[i], groups), groups, {"d": doc[i], "x": at[i], "e": doc[y], "y": at[y]})

    names = ("h", "doc", "at", "l", "r", "la", "ra", "lh", "rh", "like", "need")
    asked = shared.groupBy("g").cogroup(found.select("g", "doc_id", "sure_word", "n_sure").groupBy("g")).applyInArrow(ask, schema(*names))
    return settle(asked.groupBy("g").applyInArrow(answer, schema("d", "x", "e", "y")))


def tried(asks: np.ndarray, lo: np.ndarray, hi: np.ndarray, l: np.ndarray, r: np.ndarray, lh: np.ndarray, rh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, g) of each i of `asks` and the numbers g from its `lo` to before its `hi` that have a bit in common, l[i] with lh[g] or r[i] with rh[g], in lots. `lo` is that of the key, and `hi` does not fall within a key."""
    n = hi - lo
    key = np.append(np.flatnonzero(np.append(True, lo[1:] != lo[:-1])), len(lo)) if len(lo) else np.zeros(1, np.int64)
    many = np.add.reduceat(n, key[:-1]) > TABLE if len(lo) else np.empty(0, bool)
    # Keys with few pairs: many keys at once.
    few = np.flatnonzero(~np.repeat(many, np.diff(key)))
    until = np.cumsum(n[few])
    done = 0
    while done < len(few):
        to = max(done + 1, int(np.searchsorted(until, (until[done - 1] if done else 0) + TABLE, "right")))
        part = few[done:to]
        i, g = np.repeat(asks[part], n[part]), np.arange(n[part].sum()) + np.repeat(lo[part] - np.cumsum(n[part]) + n[part], n[part])
        ok = ((l[i] & lh[g]) | (r[i] & rh[g])) != 0
        yield i[ok], g[ok]
        done = to
    # Keys with many: tables of their asking occurrences and a stretch of their numbers.
    for a, b in zip(key[:-1][many].tolist(), key[1:][many].tolist(), strict=True):
        for row in range(a, b, ROWS):
            i = asks[row : min(b, row + ROWS)]
            mine, top = (l[i][:, None], r[i][:, None]), hi[row : row + len(i)]
            for g in range(int(lo[a]), int(top[-1]), TABLE // ROWS):
                to = min(int(top[-1]), g + TABLE // ROWS)
                x, y = np.divmod(np.flatnonzero(((mine[0] & lh[g:to]) | (mine[1] & rh[g:to])) != 0), to - g)
                ok = y + g < top[x]
                yield i[x[ok]], y[ok] + g


def chained(matches: DataFrame, groups: int, again: DataFrame | None = None) -> DataFrame:
    """Packed runs of chains (d, e, chain, x, y, words) by the group of d. Chains that cannot reach PASSAGE words are left out. With more matches `again`, only of pairs of documents that these have."""

    def more(key, table: pa.Table, extra: pa.Table) -> pa.Table:
        if not extra.num_rows:
            return link(key, extra)
        pair = lambda t: mix(mix(gather(t, "d", np.int64).view(np.uint64)) + gather(t, "e", np.int64).view(np.uint64))
        of = np.isin(pair(table), pair(extra))
        packed = {c: gather(table, c, t)[of].tobytes() for c, t in (("d", np.int64), ("x", np.uint32), ("e", np.int64), ("y", np.uint32))}
        return link(key, pa.concat_tables([extra.select(list(packed)), pa.table({c: pa.array([b], pa.binary()) for c, b in packed.items()})]))

    def link(key, table):
        d, x, e, y = (gather(table, c, t) for c, t in (("d", np.int64), ("x", np.uint32), ("e", np.int64), ("y", np.uint32)))
        order = np.lexsort((y, x, e, d))
        d, x, e, y = d[order], x[order], e[order], y[order]
        # A match can be found by several keys.
        new = np.append(True, (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(d) else np.empty(0, bool)
        d, x, e, y = d[new], x[new], e[new], y[new]
        at = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (e[1:] != e[:-1]))) if len(d) else np.empty(0, np.int64)
        end = np.append(at[1:], len(d)) if len(d) else at
        # 50 similar words hold at least two seeds, and so does each chain worth aligning.
        # Pairs that begin within a lot of matches, so what is made for these stays small.
        lots = np.append(np.flatnonzero(np.append(True, at[1:] // LOT != at[:-1] // LOT)), len(at)) if len(at) else np.zeros(1, np.int64)
        parts = [(at[:0],) * 4]
        for a, b in zip(lots[:-1].tolist(), lots[1:].tolist(), strict=True):
            pair = np.repeat(np.arange(a, b), end[a:b] - at[a:b])
            two = np.flatnonzero((end - at > 1)[pair])
            parts.append(merged(pair[two], x[two + at[a]].astype(np.int64), y[two + at[a]].astype(np.int64)))
        pair, mx, my, mw = (np.concatenate(c) for c in zip(*parts, strict=True))
        lo = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
        hi = np.append(lo[1:], len(pair)) if len(pair) else lo
        # A single run is its own chain.
        one = lo[(hi - lo == 1) & (mw[lo] > K) & (mw[lo] + 2 * MARGIN >= PASSAGE)]
        out = []
        for i, j in zip(lo[hi - lo > 1].tolist(), hi[hi - lo > 1].tolist(), strict=True):
            for n, chain in enumerate(chains(list(zip(mx[i:j].tolist(), my[i:j].tolist(), mw[i:j].tolist(), strict=True)))):
                if chain[-1][0] + chain[-1][2] - chain[0][0] + 2 * MARGIN >= PASSAGE and sum(w for *_, w in chain) > K:
                    out += [(i, n, *run) for run in chain]
        rows = np.concatenate([np.column_stack([one, np.zeros_like(one), mx[one], my[one], mw[one]]), np.array(out, np.int64).reshape(-1, 5)])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        of = at[pair[rows[:, 0]]]
        columns = {"d": d[of], "e": e[of]} | {c: rows[:, k] for k, c in enumerate("kxyw", 1)}
        return pa.Table.from_batches([scatter(deal(d[of], groups), groups, columns)])

    if again is not None:
        return settle(matches.groupBy("g").cogroup(again.groupBy("g")).applyInArrow(more, schema(*"dekxyw")))
    return settle(matches.groupBy("g").applyInArrow(link, schema(*"dekxyw")))


def fetched(texts: DataFrame, runs_: DataFrame, groups: int) -> DataFrame:
    """The earlier texts' words (as numbers, compressed by CODEC) along the chains, by the group of d: (e, first word, words), each stretch once a group however many of its documents ask for it.

    What is wanted grows with the pairs of documents, so it is sent on as it is made and not written besides.
    """

    def want(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            d, e, k, y, w = (gather(t, c, np.int64) for c in "dekyw")
            if not len(d):
                continue
            at = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (k[1:] != k[:-1])))
            last = np.append(at[1:], len(d)) - 1
            g, e, lo, hi = deal(d[at], groups), e[at], np.maximum(0, y[at] - MARGIN), y[last] + w[last] + MARGIN
            order = np.lexsort((lo, e, g))
            g, e, lo, hi = g[order], e[order], lo[order], hi[order]
            side = np.cumsum(np.append(False, (g[1:] != g[:-1]) | (e[1:] != e[:-1]))) * (1 << 33)
            reach = np.maximum.accumulate(side + hi)
            new = np.flatnonzero(np.append(True, (side + lo)[1:] > reach[:-1]))
            hi = reach[np.append(new[1:], len(e)) - 1] - side[new]
            yield scatter(deal(e[new], groups), groups, {"e": e[new], "to": g[new].astype(np.int64), "lo": lo[new], "hi": hi})

    def give(key, text: pa.Table, wanted: pa.Table) -> pa.Table:
        e, to, lo, hi = (gather(wanted, c, np.int64) for c in ("e", "to", "lo", "hi"))
        order = np.argsort(e, kind="stable")
        e, to, lo, hi = e[order], to[order], lo[order], hi[order]
        needed, meta, cut, seen = set(e.tolist()), [], [], set()
        wanted_ = text.filter(pa.array([i in needed for i in text.column("doc_id").to_pylist()], pa.bool_()))
        for i, h in zip(wanted_.column("doc_id").to_pylist(), numbers(wanted_), strict=True):
            if i not in seen:
                seen.add(i)
                for j in range(np.searchsorted(e, i), np.searchsorted(e, i, "right")):
                    part = h[lo[j] : hi[j]]
                    meta.append((to[j], i, lo[j], len(part))), cut.append(part)
        m = np.array(meta, np.int64).reshape(-1, 4)
        out = scatter(m[:, 0], groups, {c: m[:, n] for n, c in ((1, "e"), (2, "o"), (3, "n"))})
        order = np.argsort(m[:, 0], kind="stable")
        cuts = np.searchsorted(m[order, 0], np.arange(groups + 1))
        blob = [pa.compress(np.concatenate([cut[i] for i in order[cuts[u] : cuts[u + 1]]]).tobytes(), CODEC, asbytes=True) for u in out.column(0).to_pylist()]
        return pa.Table.from_batches([out]).append_column("words", pa.array(blob, pa.binary()))

    asked = runs_.mapInArrow(want, schema("e", "to", "lo", "hi"))
    return texts.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(give, schema(*"eon", "words"))


def stretches(part: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(e, first word, words) of packed rows of `fetched`."""
    for row in part.select([*"eon", "words"]).to_batches():
        for e, o, n, words in zip(*(c.to_pylist() for c in row.columns), strict=True):
            n = np.frombuffer(n, np.int64)
            raw = np.frombuffer(pa.decompress(words, 8 * int(n.sum()), CODEC), np.uint64)
            yield from zip(np.frombuffer(e, np.int64).tolist(), np.frombuffer(o, np.int64).tolist(), np.split(raw, np.cumsum(n)[:-1]), strict=True)


def passages_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(passages, grouped texts, groups). Passages have doc_id, source_doc_id, start_word, n_words, source_word and similarity."""
    tune(docs.sparkSession)
    groups = pieces(total_bytes(docs, text))
    texts = by_group(numbered(with_group(docs, groups, doc, text)), groups)
    found = seed_matches(texts, groups)
    single, shared = found.where("d is not null").select("g", "d", "x", "e", "y"), found.where("h is not null").select("g", "h", "doc", "at")
    first = settle(aligned(texts, chained(single, groups), groups))
    more = aligned(texts, chained(single, groups, rest_matches(shared, first, groups)), groups, first)
    return first.unionByName(more).drop("g", "sure_word", "n_sure"), texts, groups


def adding(rows: list[tuple], covered: bytearray) -> list[tuple]:
    """Of passages (start, words, source, ...), longest first, those with words that none before covers; notes these in `covered`."""
    out = []
    for row in sorted(rows, key=lambda r: (-r[1], r[2], r[0])):
        a, z = row[0], row[0] + row[1]
        if covered.find(0, a, z) >= 0:
            out.append(row)
            covered[a:z] = b"\1" * (z - a)
    return out


def aligned(texts: DataFrame, linked: DataFrame, groups: int, known: DataFrame | None = None) -> DataFrame:
    """The similar passages of the chains, and of each the words that go on in neither text: not those at an end where the words fetched end, too. Beside `known` ones, those that add words to what these and those of longer chains cover."""
    there, further = fetched(texts, linked, groups), known is not None
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    spans = ("doc_id", "start_word", "n_words")
    replies = linked.select("g", *"dekxyw", *none("binary", "o", "n", "words"), *none("long", *spans), F.lit("run").alias("kind"))
    replies = replies.unionByName(there.select("g", *none("binary", "d"), "e", *none("binary", *"kxyw"), "o", "n", "words", *none("long", *spans), F.lit("words").alias("kind")))
    if known is not None:
        replies = replies.unionByName(known.select("g", *none("binary", *"dekxyw", "o", "n", "words"), *spans, F.lit("known").alias("kind")))

    def align(key, text: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        found = split(replies, "run", {c: np.int64 for c in "dekxyw"})
        part = replies.filter(pa.compute.equal(replies.column("kind"), "words")) if replies.num_rows else replies
        theirs: dict = {}
        for a, p, w in stretches(part) if part.num_rows else ():
            theirs.setdefault(a, []).append((p, w))
        cover: dict = {}
        if further and replies.num_rows:
            part = replies.filter(pa.compute.equal(replies.column("kind"), "known"))
            for i, p, n in zip(*(part.column(c).to_pylist() for c in spans), strict=True):
                if i in found:
                    cover.setdefault(i, []).append((p, n))
        text = text.filter(pa.array([i in found for i in text.column("doc_id").to_pylist()], pa.bool_()))
        for i, mine in zip(text.column("doc_id").to_pylist(), map(np.ndarray.tolist, numbers(text)), strict=True):
            e, k, x, y, w = found[i]
            at = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (k[1:] != k[:-1])))
            order, own, covered = range(len(at)), [], bytearray(len(mine))
            if further:
                order = np.lexsort((e[at], -np.add.reduceat(w, at))).tolist()
                for p, n in cover.get(i, ()):
                    covered[p : p + n] = b"\1" * max(0, min(len(mine), p + n) - p)
            at = [*at.tolist(), len(e)]
            sources, runs_ = e.tolist(), list(zip(x.tolist(), y.tolist(), w.tolist(), strict=True))
            for c in order:
                source, chain = sources[at[c]], runs_[at[c] : at[c + 1]]
                first, last = chain[0][0], chain[-1][0] + chain[-1][2]
                # Nothing that a chain finds reaches further into this text.
                if further and covered.find(0, max(0, first - 2 * MARGIN), last + 2 * MARGIN) < 0:
                    continue
                # Stretches of several tasks may overlap; the chain's words are in one of them, of which those within MARGIN are looked at.
                offset = max(0, chain[0][1] - MARGIN)
                w2 = next((v[offset - p : chain[-1][1] + chain[-1][2] + MARGIN - p].tolist() for p, v in theirs.get(source, ()) if p <= offset < p + len(v)), None)
                # Rows that share an id have one text each; a chain belongs to the one it fits.
                if w2 is not None and last <= len(mine) and chain[-1][1] + chain[-1][2] - offset <= len(w2):
                    got = []
                    for p, n, there, similar in passages(mine, w2, offset, chain):
                        sure = p if p > first - MARGIN else min(first, p + n), p + n if p + n < last + MARGIN else max(last, p)
                        got.append((p, n, source, there, similar, sure[0], max(0, sure[1] - sure[0])))
                    own += got if not further else adding(got, covered)
            rows += [(key[0].as_py(), i, source, p, n, there, similar, *sure) for p, n, source, there, similar, *sure in own]
        kinds = (pa.int32(),) + (pa.int64(),) * 5 + (pa.float64(),) + (pa.int64(),) * 2
        names = ("g", "doc_id", "source_doc_id", "start_word", "n_words", "source_word", "similarity", "sure_word", "n_sure")
        return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(zip(names, kinds, strict=True))})

    return texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(align, "g int, doc_id long, source_doc_id long, start_word long, n_words long, source_word long, similarity double, sure_word long, n_sure long")


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Within it, Parquet is read by BATCH rows at once: a packed row of a large group is many MB, and Spark's 4,096 rows of a column are one array."""
    before = spark.conf.get(READ)
    spark.conf.set(READ, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(READ, before)


def find_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per fuzzy passage of a document that a smaller doc_id has too.

    Null, empty and short texts have none. A null id counts as the greatest. Rows that share an id
    are not matched with each other. Word positions count from 0.
    """
    with scratch(docs.sparkSession), few_rows(docs.sparkSession):
        return kept(passages_of(docs, doc, text)[0].withColumn("doc_id", back()).withColumn("source_doc_id", back("source_doc_id")))


def cut_passages(docs: DataFrame) -> DataFrame:
    """docs without the passages that an earlier document has; texts that lose nothing stay byte for byte.

    Of a text that loses words the rest is joined by single spaces, rows whose last words went are
    dropped, and n_chars is set anew where docs has it. Texts and other columns are untouched elsewhere.
    Rows are told apart by their place in the order of (doc_id, text), nulls last, so rows that share an id,
    or have none, are cut each by its own passages, and by each other's texts.
    """
    names = docs.columns
    packed_ = docs.select(F.struct(*names).alias("_doc"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    with swept(docs.sparkSession):
        again = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").limit(1).count()
        if again:
            rows = settle(packed_.orderBy(F.col("_id").asc_nulls_last(), F.sha2(F.col("_text").cast("binary"), 256)).withColumn("_row", F.monotonically_increasing_id()))
        else:
            # Ids tell rows apart and are in the order wanted, so texts need not be sorted.
            rows = packed_.withColumn("_row", F.col("_id").cast("long"))
        runs_ = settle(covered_words(find_passages(rows, "_row", "_text")).withColumnRenamed("doc_id", "_of"))

    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, gone, strict=True):
            if not isinstance(text, str) or spans is None:
                out.append(None)
                continue
            words, keep, at = text.encode().split(), [], 0
            for s in sorted((int(s["start_word"]), int(s["end_word"])) for s in spans):
                if s[0] > at:
                    keep += words[at : s[0]]
                at = max(at, s[1])
            out.append(b" ".join(keep + words[at:]).decode())
        return pd.Series(out, dtype=object)

    # Only texts that lose something go through Python.
    hit = F.col("runs").isNotNull()
    out = rows.join(runs_, F.col("_row") == F.col("_of"), "left").withColumn("_rest", F.pandas_udf(rest, "string")(F.when(hit, F.col("_text")), "runs")).where(~hit | (F.col("_rest") != ""))
    new = {"text": F.when(hit, F.col("_rest")).otherwise(F.col("_text"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(hit, F.length("_rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return out.select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in names))


def covered_words(df: DataFrame) -> DataFrame:
    """(doc_id, runs): per document the disjoint stretches (start_word, end_word) that its passages cover."""
    spans = df.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end_word")))).alias("s"))
    return spans.withColumnRenamed("s", "runs")


def op8_substring_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
