"""Quality rules: a learned decision list over text statistics.

Sequential covering in the manner of RIPPER: a conjunction of thresholds is grown on two
thirds of the labelled rows by information gain, pruned on the last third, kept while it is
precise there, and the rows that it covers are set aside before the next one. The list becomes
one ordered Spark CASE expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packed import tune
from almanac.llm.words import hashes, runs

SYMBOLS = b"#*$%&|<>"
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "mean_word", "upper_share", "digit_share", "mark_share", "distinct_share", "n_words")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbol_share double, repeat_share double, dup_line_share double, mean_word double, upper_share double, digit_share double, mark_share double, distinct_share double"


def repeated(h: np.ndarray, k: int = 3) -> int:
    """Words that lie in a k-word window which is found twice or more."""
    if len(h) <= k:
        return 0
    _, back, count = np.unique(runs(h, k), return_inverse=True, return_counts=True)
    again = count[back] > 1
    edge = np.zeros(len(h) + 1, np.int64)
    edge[: len(again)] += again
    edge[k : k + len(again)] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats(text: str | None) -> tuple:
    data = (text or "").encode()
    words = data.split()
    n, seen, dup, lines = len(words), set(), 0, 0
    for line in data.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dup += line in seen
            seen.add(line)
    letters = b"".join(words)
    chars = len(letters) - sum(1 for x in letters if 128 <= x < 192) if not letters.isascii() else len(letters)
    symbols = sum(map(data.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    h = hashes(words)
    again = repeated(h)
    raw = np.frombuffer(letters, np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digit = int(((raw >= 48) & (raw <= 57)).sum())
    marks = letters.count(b"!") + letters.count(b"?")
    part = lambda x, y: x / y if y else 0.0
    return n, chars, symbols, dup, again, part(symbols, chars), part(again, n), part(dup, lines), part(chars, n), part(upper, chars), part(digit, chars), part(marks, n), part(len(np.unique(h)), n)


def stats_frame(texts: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in STATS.split(", ")]
    return pd.DataFrame([stats(t if isinstance(t, str) else None) for t in texts], columns=names)


def text_stats(text: str = "text") -> Column:
    """Statistics of a text as a struct."""
    return F.pandas_udf(stats_frame, STATS)(text)


def grow(x: np.ndarray, y: np.ndarray, most: int = 4) -> list[tuple[int, bool, float]]:
    """Conditions (feature, at least?, threshold), each the best by FOIL's gain given those before it."""
    rule, held = [], np.ones(len(y), bool)
    while len(rule) < most and held.any() and not y[held].all():
        p0, n0 = y[held].sum(), (~y[held]).sum()
        best = (0.0, None)
        for f in range(x.shape[1]):
            for t in np.unique(np.quantile(x[held, f], np.linspace(0, 1, 41))):
                for up in (True, False):
                    cover = held & (x[:, f] >= t if up else x[:, f] <= t)
                    p, n = y[cover].sum(), (~y[cover]).sum()
                    if p and (p + n) < held.sum():
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, up, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        held &= covered(x, [best[1]])
    return rule


def covered(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, up, t in rule:
        out &= x[:, f] >= t if up else x[:, f] <= t
    return out


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.9, least: int = 3) -> list[list[tuple[int, bool, float]]]:
    """Ordered rules that pick out y. Rows are dealt to growing and pruning by their position."""
    rules, open_ = [], np.ones(len(y), bool)
    prune_row = np.arange(len(y)) % 3 == 2
    while (y & open_ & ~prune_row).sum() >= least:
        g, v = open_ & ~prune_row, open_ & prune_row
        rule = grow(x[g], y[g])
        worth = lambda r: (lambda c: (y[v][c].sum() - (~y[v][c]).sum()) / max(1, c.sum()))(covered(x[v], r))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covered(x, rule) & open_
        both = hit.sum()
        if not rule or y[hit].sum() < least or y[hit].sum() < precision * both or y[v][covered(x[v], rule)].sum() < precision * covered(x[v], rule).sum():
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def expression(rules, column) -> Column:
    """The list as one CASE: the first rule that holds rejects, otherwise the text is kept."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for f, up, t in rule:
            c = column(FEATURES[f])
            test = test & (c >= t if up else c <= t)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, precision: float = 0.9):
    """Rules from at most `max_rows` labelled rows, chosen by a hash of the id; only these come to the driver."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", text_stats("text").alias("s")).select("doc_id", "quality", "s.*").toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable").drop_duplicates("doc_id")
    # What the base rejects is decided already and would hide what sets the rest apart.
    rows = rows[(rows["n_words"] >= 50) & (100 * rows["n_repeat_words"] <= 50 * rows["n_words"])]
    rows = rows.sample(frac=1.0, random_state=7) if len(rows) else rows
    return learn(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy() == 0, precision) if len(rows) else []


def free(names: list[str], name: str) -> str:
    """The name, behind as many underscores as no column has."""
    while name in names:
        name = f"_{name}"
    return name


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, precision: float = 0.9, out: str = "_quality") -> DataFrame:
    """docs with a struct column `out`: the statistics, base_failed and kept. A column of that name is refused; all others stay.

    A null or empty text has no words and fails the base; without labelled rows there are no
    rules and what passes the base is kept. Repeated rows are judged each on its own text.
    """
    if out in docs.columns:
        raise ValueError(f"docs have a column {out}")
    tune(docs.sparkSession)
    rules = fit(docs, labels, max_rows, precision)
    name = free([*docs.columns, out], "_s")
    s = lambda field: F.col(f"{name}.{field}")
    failed = (s("n_words") < 50) | (100 * s("n_repeat_words") > 50 * s("n_words"))
    kept = F.when(failed, False).otherwise(expression(rules, s))
    return docs.withColumn(name, text_stats("text")).withColumn(out, F.struct(f"{name}.*", failed.alias("base_failed"), kept.alias("kept"))).drop(name)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that neither the base nor the rules reject, with docs' columns."""
    out = free(docs.columns, "_quality")
    return judge(docs, labels, out=out).where(F.col(f"{out}.kept")).drop(out)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *(f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
