"""License scans: an exact set-similarity join of text blocks with license notices.

A text's words (A-Z lowered, runs of digits, a-z and all that is not ASCII) are cut into blocks of
``BLOCK`` words at every ``STRIDE`` words, so that any passage of up to ``BLOCK - STRIDE + 1`` words
lies whole in a block. Templates of more words than that have blocks of their own (``geometry``), so that any
passage of up to twice their words lies whole in one. A block matches a template when it holds at least ``CONTAINMENT`` of the
template's distinct words. Template words are ordered by the number of documents that hold them, rarest
first, counted over the whole table. A match shares a word of the template's prefix (prefix filter), has
enough template words (length filter) and enough left after the first shared word (positional filter);
what passes is verified. The join is with a fixed list of templates, so it is broadcast, and only blocks
with a prefix word leave the scan.

Besides, places where a base phrase's words stand consecutively are counted over the whole text.

Null texts are empty: no words, no labels, score 0. Repeated rows give a row each. An empty table gives
no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import UPPER, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STRIDE, CONTAINMENT = 32, 16, 0.8
# Base phrases and notices, as words.
BASE = {
    "mit": ("mit", "license"),
    "apache": ("apache", "license"),
    "gpl": ("general", "public", "license"),
}
TEMPLATES = {
    "all-rights-reserved": "all rights reserved",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under the creative commons attribution sharealike 4 0 international license",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "under the terms of the gnu lesser general public license",
    "mit-notice": "released under the mit license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def needed(words: list[str], containment: float = CONTAINMENT) -> int:
    """The least number of shared words that reaches the containment."""
    return math.ceil(containment * len(words) - 1e-9)


def _distinct(text: str) -> list[str]:
    return list(dict.fromkeys(text.split()))


def geometry(text: str) -> tuple[int, int]:
    """``(block, stride)`` in words of a template."""
    n = len(text.split())
    if n <= BLOCK - STRIDE + 1:
        return BLOCK, STRIDE
    stride = max(STRIDE, n // 4)
    return 2 * n + stride, stride


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def with_words(docs: DataFrame) -> DataFrame:
    low = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select("doc_id", F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))


def word_order(words: DataFrame, templates: dict[str, str]) -> list[str]:
    """All template words, rarest first. One small row per template word comes to the driver."""
    known = sorted({w for t in templates.values() for w in t.split()})
    seen = words.select(F.explode(F.array_intersect(_strings(known), "words")).alias("w")).groupBy("w").count()
    counts = dict(seen.collect())
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _places(phrase: tuple[str, ...]) -> Column:
    match = " and ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(phrase))
    return F.expr(f"filter(sequence(0, size(words) - 1), i -> {match})")


def with_base(words: DataFrame) -> DataFrame:
    """Adds ``n_words, n_base, first_word, last_word, base`` (labels)."""
    none = F.array().cast("array<int>")
    last = {phrase[-1] for phrase in BASE.values()}
    maybe = F.arrays_overlap("words", _strings(sorted(last)))
    step = words.withColumns({f"_{k}": F.when(maybe, _places(p)).otherwise(none) for k, p in BASE.items()})
    every = F.concat(*[F.col(f"_{k}") for k in BASE])
    labels = F.filter(F.array(*[F.when(F.size(f"_{k}") > 0, k) for k in BASE]), lambda x: x.isNotNull())
    step = step.withColumn("_all", every)
    return step.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"),
        F.array_max("_all").cast("long").alias("last_word"),
        labels.alias("base"),
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: word and phrase counts, base labels, all labels and the score.

    The score is the largest containment of a matching template, 1 where a base phrase stands, else 0.
    """
    templates = templates or TEMPLATES
    words = with_words(docs)
    order = word_order(words, templates)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, text in templates.items():
        own = sorted(_distinct(text), key=rank.__getitem__)
        if not own:
            raise ValueError(f"template {label!r} has no words")
        least = needed(own, containment)
        index += [(*geometry(text), w, i, label, own, least) for i, w in enumerate(own[: len(own) - least + 1])]
    spark = docs.sparkSession
    by_word = spark.createDataFrame(index, "_size int, _stride int, word string, at int, label string, own array<string>, least int")

    def cut(size: int, stride: int) -> Column:
        """Blocks with a prefix word: their size and template words in the global order."""
        prefixes = _strings(sorted({row[2] for row in index if row[:2] == (size, stride)}))
        blocks = F.expr(f"transform(sequence(0, greatest(size(words) - 1, 0), {stride}), i -> slice(words, i + 1, {size}))")
        blocks = F.filter(blocks, lambda b: F.arrays_overlap(b, prefixes))
        blocks = F.when(F.arrays_overlap("words", prefixes), blocks).otherwise(F.array().cast("array<array<string>>"))
        return F.transform(blocks, lambda b: F.struct(F.lit(size).alias("_size"), F.array_intersect(_strings(order), b).alias("_known")))

    every = F.concat(*[cut(*g) for g in sorted({row[:2] for row in index})])
    rows = with_base(words).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("*", F.explode_outer(every).alias("_block")).drop("words")
    rows = rows.select("*", "_block.*").drop("_block")
    keep = ["_row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    each = rows.select(*keep, "_size", "_known", F.posexplode_outer("_known").alias("_j", "word"))
    left = F.least(F.size("own") - F.col("at"), F.size("_known") - F.col("_j"))
    passes = (F.size("_known") >= F.col("least")) & (left >= F.col("least"))
    met = each.join(F.broadcast(by_word.drop("_stride")), ["_size", "word"], "left")
    shared = F.when(passes, F.size(F.array_intersect("_known", "own")))
    met = met.withColumn("_shared", shared)
    hit = F.col("_shared") >= F.col("least")
    found = met.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in keep[1:]],
        F.collect_set(F.when(hit, F.col("label"))).alias("_labels"),
        F.max(F.when(hit, F.col("_shared") / F.size("own"))).alias("_best"),
    )

    def joined(c):
        return F.array_join(F.array_sort(c), ",")

    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.array_union("base", "_labels")).alias("labels"),
        score.alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL: every block against every template, without an index."""
    place = [
        f"SELECT r, i, '{k}' AS label FROM p WHERE " + " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(phrase))
        for k, phrase in BASE.items()
    ]
    listed = ", ".join(
        f"('{k}', {_distinct(t)!r}, {len(_distinct(t))}, {needed(_distinct(t))})" for k, t in TEMPLATES.items()
    )
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS words FROM documents),
  p AS (SELECT r, words, unnest(range(len(words))) AS i FROM w),
  base AS MATERIALIZED ({' UNION ALL '.join(place)}),
  t(label, own, n, least) AS (VALUES {listed}),
  blocks AS (SELECT r, words[s + 1 : s + {BLOCK}] AS b FROM (SELECT r, words, unnest(range(0, len(words), {STRIDE})) AS s FROM w)),
  m AS (SELECT r, label, max(len(list_intersect(own, b)) / n) AS c FROM blocks, t WHERE len(list_intersect(own, b)) >= least GROUP BY r, label),
  every AS (SELECT r, label FROM base UNION SELECT r, label FROM m)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r) USING (r)
  LEFT JOIN (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY r) USING (r)
  LEFT JOIN (SELECT r, max(c) AS c FROM m GROUP BY r) USING (r)"""
