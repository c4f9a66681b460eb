"""License scans: templates retrieved by MinHash bands over overlapping windows, then verified.

Texts and templates are lower-cased words of letters and digits. For a template of m words windows are
2 * m words long and start every m words, so a passage as long as the template lies whole in one window.
Window and template are compared by their word shingles (five words, fewer for shorter templates). BANDS
bands of one hash each retrieve a template for a window: the similarity of a window that holds 80 percent
of a template is at least 1 / 6 (at five words; more than 1 / 3 for long ones), so all bands miss it with
a probability of at most (5 / 6) ** BANDS, 3e-8. A retrieved template is verified by the exact share of
its shingles that the window holds.

A band can only agree on a shingle of the template, so windows without any shingle of a template of
their size are left out before MinHash values are computed. Only Spark expressions are used. The
templates are a parameter; their shingles and band values are literal tables whose size depends on the
templates alone.

Result: one row for each row of ``docs`` and template that it holds: the largest share found and the
first word (from 0) of the earliest window that verifies. Texts without a match give no row. NULL and
empty texts hold nothing; repeated rows give equal rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS, PERCENT = 5, 96, 80
WORDS = r"[^\p{L}\p{N}]+"

#: Notices and the operative paragraphs of common licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_shingles(templates: dict[str, str]) -> list[tuple[str, int, int, str]]:
    """(name, number of words, width, shingle) of every distinct shingle of every template."""
    out = []
    for name, text in templates.items():
        words = template_words(text)
        width = min(SHINGLE, len(words))
        if width:
            out += sorted({(name, len(words), width, " ".join(words[i : i + width])) for i in range(len(words) - width + 1)})
    return out


def literal(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A small table written into the plan."""
    kind = ", ".join(f"{n}: {t}" for n, t in schema)
    items = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, schema, strict=True))) for r in rows)) if rows else F.array()
    return spark.range(1).select(F.inline(items.cast(f"array<struct<{kind}>>")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")


def shingle(words: Column, i: Column, width: int) -> Column:
    return F.concat_ws(" ", *(F.get(words, i + k) for k in range(width)))


def starts(words: Column, width: int, shingles: set[str]) -> Column:
    """Where a shingle of a template starts. Word by word first, as most places fail on the first word."""
    at = [sorted({s.split(" ")[k] for s in shingles}) for k in range(width)]
    return F.when(
        F.size(words) >= width,
        F.filter(
            F.sequence(F.lit(0), F.size(words) - width),
            lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k).isin(at[k]) for k in range(width))) & shingle(words, i, width).isin(sorted(shingles)),
        ),
    ).otherwise(F.array().cast("array<int>"))


def held_windows(words: Column, at: Column, size: int, width: int, shingles: set[str]) -> Column:
    """(size, width, k): the last window start before each shingle of a template of ``size`` words."""
    mine = F.filter(at, lambda i: shingle(words, i, width).isin(sorted(shingles)))
    return F.transform(mine, lambda i: F.struct(F.lit(size).alias("size"), F.lit(width).alias("width"), F.floor(i / size).cast("int").alias("k")))


def window_shingles(words: Column, first: Column, size: Column, width: Column) -> Column:
    """The distinct shingles of the window of 2 * size words from ``first`` on."""
    stop = F.least(first + 2 * size, F.size(words)) - width
    return F.array_distinct(F.transform(F.sequence(first, stop), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))


def minhash(shingles: Column, band: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """doc_id, template, share and first_word for every row of ``docs`` (doc_id, text) and template it holds."""
    spark = docs.sparkSession
    rows = template_shingles(TEMPLATES if templates is None else templates)
    known = literal(spark, rows, [("template", "string"), ("size", "int"), ("width", "int"), ("shingle", "string")])
    of_template = known.groupBy("template", "size", "width").agg(F.collect_set("shingle").alias("wanted"))
    signature = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.struct(b.alias("band"), minhash(F.col("wanted"), b).alias("least")))
    index = of_template.select("template", "size", "width", "wanted", F.inline(signature))

    classes: dict[tuple[int, int], set[str]] = {}
    for _, size, width, text in rows:
        classes.setdefault((size, width), set()).add(text)
    by_width = {w: {s for _, _, width, s in rows if width == w} for w in sorted({r[2] for r in rows})}
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # the row number also keeps filters above from being evaluated on the word arrays once more
    found = words.select("doc_id", F.monotonically_increasing_id().alias("row"), "words", *(starts(F.col("words"), w, s).alias(f"starts_{w}") for w, s in by_width.items()))
    held = [held_windows(F.col("words"), F.col(f"starts_{width}"), size, width, shingles) for (size, width), shingles in classes.items()]
    if not held:
        return docs.select("doc_id", F.lit("").alias("template"), F.lit(0.0).alias("share"), F.lit(0).alias("first_word")).limit(0)
    # a shingle lies in the window that starts at the last multiple of the size, or in the one before
    both = F.flatten(F.transform(F.concat(*held), lambda h: F.array(h, h.withField("k", h["k"] - 1))))
    windows = found.withColumn("window", F.explode(F.array_distinct(F.filter(both, lambda h: h["k"] >= 0))))
    windows = windows.select("doc_id", "row", "window.*", "words").withColumn("first_word", F.col("k") * F.col("size"))
    windows = windows.select("doc_id", "size", "width", "first_word", window_shingles(F.col("words"), F.col("first_word"), F.col("size"), F.col("width")).alias("shingles"), "row")
    bands_of = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.struct(b.alias("band"), minhash(F.col("shingles"), b).alias("least")))
    probes = windows.select("*", F.inline(bands_of))
    met = probes.join(F.broadcast(index), ["size", "width", "band", "least"]).dropDuplicates(["row", "template", "first_word"])
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    verified = met.withColumn("share", share).filter(100 * F.size(F.array_intersect("shingles", "wanted")) >= percent * F.size("wanted"))
    best = verified.groupBy("row", "template").agg(F.first("doc_id").alias("doc_id"), F.max("share").alias("share"), F.min("first_word").alias("first_word"))
    return best.select("doc_id", "template", "share", "first_word")
