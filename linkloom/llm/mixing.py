"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities.

Documents fall into cells of source, language and topic. Iterative proportional fitting rakes the
cells' token weights to target marginals of each dimension in turn, over a budget of ``keep`` of all
tokens; no cell rises above the tokens it has, so a cell's weight over its tokens is a probability. Each
document is kept when a draw that depends on its id alone falls below its cell's probability.

The topic of a text is the first in ``TOPICS`` with a keyword in it (A-Z lowered), else ``other``.
Tokens are words between ASCII white space. Only cell totals are shuffled, after a map-side combine,
so a source with a third of all rows costs no more than another; cells meet the documents by a join
that Spark broadcasts within its size threshold.

Null sources, languages and texts count as ``''``. A null id draws like an empty string. Repeated rows
share a draw. Cells without tokens are kept whole, so a table without any word is; an empty table gives no
rows. ``report`` says which targets cannot be met, and how near the others came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import UPPER, lower_ascii, written

DIMENSIONS = ("source", "lang", "topic")
# Topics in order of precedence, each with its keywords.
TOPICS = {
    "legal": ("license", "copyright", "rights reserved"),
    "contact": ("@", "phone", "e-mail"),
    "web": ("http", "www.", "</"),
}
# Production parameters of the registered query and the pipeline.
KEEP, TEMPER, ROUNDS, SEED = 0.6, 0.7, 8, 17


def topic(text: Column) -> Column:
    low, out = lower_ascii(text), None
    for name, words in TOPICS.items():
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def described(docs: DataFrame) -> DataFrame:
    """``_doc`` (the row as it came), ``_source, _lang, _topic`` and ``_tokens``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("_doc"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"),
        topic(text).alias("_topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_tokens"),
    )


def cells(docs: DataFrame) -> DataFrame:
    """``_source, _lang, _topic, observed``: tokens by cell."""
    keys = [f"_{d}" for d in DIMENSIONS]
    return described(docs).groupBy(*keys).agg(F.sum("_tokens").cast("double").alias("observed"))


def targets(observed: DataFrame, dimension: str, keep: float, temper: float, shares: dict[str, float] | None = None) -> DataFrame:
    """``_<dimension>, target``: tokens wanted. A value weighs its given share, else its observed share to the power ``temper``."""
    key = f"_{dimension}"
    margin = observed.groupBy(key).agg(F.sum("observed").alias("_margin"))
    whole = observed.agg(F.sum("observed")).first()[0]
    if not whole:  # no tokens at all: nothing to want
        return margin.select(key, F.lit(0.0).alias("target"))
    weight = F.pow(F.col("_margin") / F.lit(whole), F.lit(float(temper)))
    if shares:
        given = F.create_map(*[F.lit(x) for kv in shares.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(given[F.col(key)], weight)
    weighed = margin.select(key, weight.alias("_weight"))
    total = weighed.agg(F.sum("_weight")).first()[0]
    return weighed.select(key, (F.lit(float(keep)) * F.lit(whole) * F.col("_weight") / F.lit(total)).alias("target"))


def rake(observed: DataFrame, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, shares: dict | None = None) -> DataFrame:
    """``observed`` cells with ``fitted``, the tokens wanted of each, after ``rounds`` turns over the dimensions."""
    wanted = {d: written(targets(observed, d, keep, temper, (shares or {}).get(d)), "mix-target") for d in DIMENSIONS}
    fitted = observed.withColumn("fitted", F.lit(float(keep)) * F.col("observed"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            key = f"_{d}"
            factor = fitted.groupBy(key).agg(F.sum("fitted").alias("_now")).join(wanted[d], key).select(
                key, F.when(F.col("_now") > 0, F.col("target") / F.col("_now")).otherwise(1.0).alias("_factor")
            )
            raked = fitted.join(factor, key).withColumn("fitted", F.least("observed", F.col("fitted") * F.col("_factor")))
            fitted = written(raked.drop("_factor"), "mix-round")  # else each step would double the plan
    return fitted


def report(fitted: DataFrame, keep: float = KEEP, temper: float = TEMPER, shares: dict | None = None) -> DataFrame:
    """``dimension, value, target, reached, available`` of ``rake`` rows: what each margin wanted and got.

    A target above ``available``, the tokens there are, cannot be met; one short of it after all rounds has
    not converged.
    """
    out = None
    for d in DIMENSIONS:
        key = f"_{d}"
        got = fitted.groupBy(key).agg(F.sum("fitted").alias("reached"), F.sum("observed").alias("available"))
        rows = got.join(targets(fitted, d, keep, temper, (shares or {}).get(d)), key)
        rows = rows.select(F.lit(d).alias("dimension"), F.col(key).alias("value"), "target", "reached", "available")
        out = rows if out is None else out.unionByName(rows)
    return out


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def drawn(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, seed: int = SEED, shares: dict | None = None) -> DataFrame:
    """``_doc, _source, _lang, _topic, _tokens, _probability, _draw, _kept`` per row."""
    fitted = rake(written(cells(docs), "mix-cells"), keep, temper, rounds, shares)
    keys = [f"_{d}" for d in DIMENSIONS]
    chance = F.when(F.col("observed") > 0, F.col("fitted") / F.col("observed")).otherwise(1.0)
    known = fitted.select(*keys, chance.alias("_probability"))
    met = described(docs).join(known, keys).withColumn("_draw", draw(F.col("_doc.doc_id"), seed))
    return met.withColumn("_kept", F.col("_draw") < F.col("_probability"))


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The kept rows of ``docs``, with its own columns."""
    return drawn(docs, **parameters).where("_kept").select("_doc.*")


def oracle(keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """DuckDB SQL for the registered query: the same raking, written out step by step."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    case = " ".join(
        "WHEN " + " OR ".join(f"contains({low}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in TOPICS.items()
    )
    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {case} ELSE 'other' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS observed FROM d GROUP BY ALL)",
    ]
    for dim in DIMENSIONS:
        steps.append(
            f"""t_{dim} AS MATERIALIZED (SELECT {dim}, {keep} * whole * w / sum(w) OVER () AS target FROM
  (SELECT {dim}, whole, pow(sum(observed) / whole, {temper}) AS w FROM c, (SELECT sum(observed) AS whole FROM c) GROUP BY {dim}, whole))"""
        )
    last = "f0"
    steps.append(f"f0 AS MATERIALIZED (SELECT *, {keep} * observed AS fitted FROM c)")
    for i in range(rounds * len(DIMENSIONS)):
        dim = DIMENSIONS[i % len(DIMENSIONS)]
        steps.append(
            f"""f{i + 1} AS MATERIALIZED (SELECT source, lang, topic, observed, least(observed, fitted * CASE WHEN now > 0 THEN target / now ELSE 1 END) AS fitted
  FROM {last} JOIN (SELECT {dim}, sum(fitted) AS now FROM {last} GROUP BY {dim}) USING ({dim}) JOIN t_{dim} USING ({dim}))"""
        )
        last = f"f{i + 1}"
    return f"""WITH {', '.join(steps)}
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, u < p AS kept
FROM (SELECT d.*, CASE WHEN observed > 0 THEN fitted / observed ELSE 1.0 END AS p,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
  FROM d JOIN {last} USING (source, lang, topic))"""
