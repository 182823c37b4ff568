"""License scans, with DataFrame functions only.

A text is read in overlapping windows. A template of up to c words (c a power of two) lies whole in
one window of 2c words at steps of c. MinHash bands of the windows retrieve templates, and the exact
containment of the template's shingles in the window verifies them. A window that holds 0.8 of a
template's shingles has a least similarity to it that the sizes give, and each template takes as many
bands of one row as miss it with a probability of MISSED at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, CONTAINED, LEAST, MISSED = 5, 80, 8, 1e-8
EMPTY = "''"

#: Notices of well-known licences as they are commonly written.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def tokens(column: str) -> str:
    return f"filter(split(lower({column}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"


def held(df: DataFrame, name: str, expression: str) -> DataFrame:
    """df with one more column. As the only row of a generator it is computed once: filters on it are not pushed below and repeat nothing."""
    return df.select("*", F.explode(F.array(F.expr(expression))).alias(name))


def shingled(df: DataFrame, text: str) -> DataFrame:
    """df with `words`, the hashes of the text's words, and `all`, those of its shingles in order. Null and short texts have none."""
    at = ", ".join(f"words[i + {j}]" for j in range(K))
    df = held(df, "words", f"transform({tokens(f'coalesce({text}, {EMPTY})')}, w -> xxhash64(w))")
    return held(df, "all", f"CASE WHEN size(words) >= {K} THEN transform(sequence(0, size(words) - {K}), i -> xxhash64({at})) ELSE cast(array() AS array<bigint>) END")


def bands(shingles: str, count: str) -> str:
    """The least hash of a set under each of `count` hash functions."""
    return f"transform(sequence(1, {count}), k -> array_min(transform({shingles}, s -> xxhash64(s, k))))"


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(license, class, own, need): the distinct shingles of each template of five words or more, and the bands with which it is missed at most MISSED times."""
    rows = shingled(spark.createDataFrame(sorted(texts.items()), "license string, body string"), "body")
    sized = rows.select("license", F.expr(f"cast(greatest({LEAST}, pow(2, ceil(log2(size(words))))) AS int) AS class"), F.array_distinct("all").alias("own")).where("size(own) > 0")
    matched = f"(({CONTAINED} * size(own) + 99) div 100)"
    similar = f"{matched} / (2 * class - {K - 1} + size(own) - {matched})"
    return sized.withColumn("need", F.expr(f"cast(ceil(ln({MISSED}D) / ln(1 - least(0.999D, {similar}))) AS int)"))


def listed(values) -> str:
    return ", ".join(f"{v}L" for v in sorted(values))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, n_matched, n_template, n_windows) for each row's licences.

    n_matched is the most shingles of the template in one window, n_windows the number of windows that
    match. Null, empty and short texts hold none; repeated rows of one id count as one document.
    Templates are few and given by the caller, so they are broadcast.
    """
    known = templates(docs.sparkSession, texts or TEMPLATES)
    kept = known.collect()
    schema = "doc_id long, license string, n_matched long, n_template long, n_windows long"
    if not kept:
        return docs.sparkSession.createDataFrame([], schema)
    rows = shingled(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "all")
    # A window without any shingle of a template of its class matches none, so those around such shingles are enough.
    rows = held(rows, "hits", f"filter(transform(all, (s, i) -> CASE WHEN s IN ({listed({s for r in kept for s in r.own})}) THEN i END), i -> i IS NOT NULL)").where("size(hits) > 0")
    around = []
    for c in sorted({r["class"] for r in kept}):
        mine = f"filter(hits, i -> all[i] IN ({listed({s for r in kept if r['class'] == c for s in r.own})}))"
        starts = f"filter(array_distinct(flatten(transform({mine}, i -> array(i div {c}, i div {c} - 1)))), j -> j >= 0)"
        count = max(r.need for r in kept if r["class"] == c)
        around.append(f"transform({starts}, j -> struct({c} AS class, j AS j, {count} AS n_bands, array_distinct(slice(all, cast(j * {c} + 1 AS int), {2 * c - K + 1})) AS part))")
    windows = rows.select("doc_id", F.explode(F.expr(f"concat({', '.join(around)})")).alias("w")).select("doc_id", "w.*")
    signed = windows.select("doc_id", "class", "j", "part", F.posexplode(F.expr(bands("part", "n_bands"))).alias("k", "low"))
    stored = known.select("license", "class", "own", F.posexplode(F.expr(bands("own", "need"))).alias("k", "low"))
    met = signed.join(F.broadcast(stored), ["class", "k", "low"])
    found = met.select("doc_id", "j", "license", F.size("own").alias("n_template"), F.size(F.array_intersect("part", "own")).alias("n_matched"))
    once = found.groupBy("doc_id", "license", "n_template", "j").agg(F.max("n_matched").alias("n_matched")).where(f"100 * n_matched >= {CONTAINED} * n_template")
    return once.groupBy("doc_id", "license", "n_template").agg(F.max("n_matched").alias("n_matched"), F.count("*").alias("n_windows")).select("doc_id", "license", F.col("n_matched").cast("long"), F.col("n_template").cast("long"), "n_windows")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = f"""
WITH l(license, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}),
lw AS (SELECT license, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM l),
t AS (SELECT DISTINCT license, greatest({LEAST}, pow(2, ceil(log2(len(ws)))))::BIGINT AS c, array_to_string(ws[i:i+{K - 1}], ' ') AS g FROM (SELECT license, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM lw)),
n AS (SELECT license, c, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i - 1 AS i, array_to_string(ws[i:i+{K - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS i FROM w WHERE len(ws) >= {K})),
h AS (SELECT doc_id, license, c, g, i, unnest([i // c, i // c - 1]) AS j FROM s JOIN t USING (g)),
m AS (SELECT doc_id, license, c, j, count(DISTINCT g) AS k FROM h WHERE j >= 0 AND i <= j * c + 2 * c - {K} GROUP BY ALL)
SELECT doc_id, license, max(k)::BIGINT AS n_matched, n.n::BIGINT AS n_template, count(*)::BIGINT AS n_windows FROM m JOIN n USING (license, c) WHERE 100 * k >= {CONTAINED} * n.n GROUP BY doc_id, license, n.n
"""
