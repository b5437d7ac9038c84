"""Mixing sources to target weights by iterative proportional fitting (raking).

Token mass is summed per cell (source, language, topic). The cell weights are raked until their marginals
meet the targets of the three dimensions, then documents are drawn with the probability that makes the
expected tokens of every cell proportional to its raked weight and the total equal to the budget.
Probabilities stop at one, and what that cuts off is dealt to the other cells.

All of it is DataFrame and SQL functions. The only pass over texts counts words and finds the topic; after
it there are cells, as many as the categories give, however many documents there are. The draw compares a
digest of the id with the probability, so it is the same on every run and every retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release, spread

ROUNDS = 12
#: Rounds between two written tables.
STRIDE = 4
CAP_ROUNDS = 6
#: Cells that one task rakes, at most, and rounds in search of a tolerance.
MOST_CELLS, MOST_ROUNDS = 200_000, 400
#: Share of all tokens to draw.
FRACTION = 0.7
#: Target of a category without a given one: its share of mass to this power, normalised.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.8}
DIMS = ("source", "lang", "topic")
SEED = 17
WORDS = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("double")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse topic from marks of form; any expression over the text can take its place."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("###") | text.contains("$$$"), "markup")
        .when(text.contains("!! "), "shout")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("book")
    )


def draw(ident: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; a null id counts as the word null."""
    key = F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """id, source, lang, topic and tokens of each row; missing categories are "(none)".

    ``topic_col`` names a column of topics, from a classifier, say; without it ``topic`` stands in, by form and length alone.
    """
    text = docs[text_col].cast("string")
    named = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs["source"].cast("string"), F.lit("(none)")).alias("source"),
        F.coalesce(docs["lang"].cast("string"), F.lit("(none)")).alias("lang"),
        F.coalesce(text, F.lit("")).alias("_text"),
        n_tokens(text).alias("tokens"),
        (F.coalesce(docs[topic_col].cast("string"), F.lit("(none)")) if topic_col else F.lit("")).alias("_topic"),
    )
    return named.select("doc_id", "source", "lang", (F.col("_topic") if topic_col else topic(F.col("_text"), F.col("tokens"))).alias("topic"), "tokens")


def _target(dim: str, given: dict | None) -> Column:
    if given:
        total = float(sum(given.values()))
        pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(v / total))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(dim)), F.lit(0.0))
    own = F.sum("mass").over(W.partitionBy(dim))
    return F.when(own > 0, F.pow(own, F.lit(TEMPER[dim]))).otherwise(0.0)


def residuals(raked: DataFrame) -> DataFrame:
    """(dimension, category, target, weight, error) of the marginals that ``rake`` was to meet; error is relative to the target."""
    parts = []
    for d in DIMS:
        sums = raked.groupBy(F.col(d).alias("category")).agg(F.max(f"t_{d}").alias("target"), F.sum("weight").alias("weight"))
        error = F.when(F.col("target") > 0, F.abs(F.col("weight") / F.col("target") - 1)).otherwise(F.abs("weight"))
        parts.append(sums.select(F.lit(d).alias("dimension"), "category", "target", "weight", error.alias("error")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, mass) with a column weight: raked shares that sum to one.

    Cells are few (the product of the categories), so each batch of rounds is one task's windows, without a
    shuffle; over ``MOST_CELLS`` of them are an error, as a column that is no category. Cells without mass keep weight
    zero. ``rounds`` are made, or with ``tolerance`` as many batches of ``STRIDE`` as it takes for every marginal to be within it, relative to
    its target; targets that no weights can meet end in an error after ``MOST_ROUNDS``.
    """
    targets = targets or {}
    if (n := cells.count()) > MOST_CELLS:
        raise ValueError(f"{n} cells of source, language and topic: over {MOST_CELLS}, too many categories")
    one = cells.coalesce(1)
    for d in DIMS:
        one = one.withColumn(f"t_{d}", _target(d, targets.get(d)))
    for d in DIMS:  # powers become shares: each category counts once
        own = F.sum("mass").over(W.partitionBy(d))
        norm = F.sum(F.when(own > 0, F.col(f"t_{d}") * F.col("mass") / own).otherwise(0.0)).over(W.partitionBy())
        one = one.withColumn(f"t_{d}", F.when(norm > 0, F.col(f"t_{d}") / norm).otherwise(0.0))
    now = one.withColumn("weight", F.col("mass"))
    table = None
    for k in range(rounds if tolerance is None else MOST_ROUNDS):
        for d in DIMS:
            own = F.sum("weight").over(W.partitionBy(d))
            now = now.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"t_{d}") / own).otherwise(0.0))
        if k + 1 == rounds or (k + 1) % STRIDE == 0:
            before, table = table, materialize(now, "raked")
            release(before)
            now = table.coalesce(1)
            if tolerance is not None and (residuals(table).agg(F.max("error")).first()[0] or 0.0) <= tolerance:
                return table
    if tolerance is not None:
        raise ValueError(f"marginals are not within {tolerance} of their targets after {MOST_ROUNDS} rounds")
    return table


def calibrate(raked: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """``raked`` with probability: min(1, c * weight / mass), with c such that the budget is met.

    Every round takes the cells that have reached one out of the budget; the number of rounds is fixed.
    """
    ratio = F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(0.0)
    total = F.sum("mass").over(W.partitionBy())
    now = raked.coalesce(1).withColumn("ratio", ratio).withColumn("budget", F.lit(fraction) * total).withColumn("full", F.lit(False)).withColumn("c", F.lit(0.0))
    for _ in range(CAP_ROUNDS):
        left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("mass")).otherwise(0.0)).over(W.partitionBy())
        free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(W.partitionBy())
        now = now.withColumn("c", F.when(free > 0, left / free).otherwise(F.lit(0.0)))
        now = now.withColumn("full", F.col("full") | (F.col("c") * F.col("ratio") >= 1.0))
    return now.withColumn("probability", F.round(F.when(F.col("full"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c") * F.col("ratio")))), 6))


def plan(features: DataFrame, targets=None, fraction: float = FRACTION, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """One row per cell: its mass, raked weight and drawing probability."""
    cells = materialize(features.groupBy(*DIMS).agg(F.sum("tokens").alias("mass")), "cells")
    return materialize(calibrate(rake(cells, targets, rounds, tolerance), fraction).select(*DIMS, "mass", F.round("weight", 6).alias("weight"), "probability"), "mix")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets=None, fraction: float = FRACTION, rounds: int = ROUNDS, seed: int = SEED, tolerance: float | None = None, topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and sampled, for every row.

    Null texts have no tokens, null categories are "(none)"; rows with the same id share their draw.
    A category that the targets leave out gets none. An empty table gives an empty result.
    """
    rows = materialize(with_features(spread(docs), id_col, text_col, topic_col), "mix-rows")
    cells = plan(rows, targets, fraction, rounds, tolerance)
    joined = rows.join(cells.drop("mass"), list(DIMS), "left")
    return joined.select("doc_id", *DIMS, F.col("tokens").cast("long").alias("tokens"), "weight", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets=None, fraction: float = FRACTION, rounds: int = ROUNDS, seed: int = SEED, tolerance: float | None = None, topic_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns as they are."""
    docs = spread(docs)
    cells = plan(with_features(docs, id_col, text_col, topic_col), targets, fraction, rounds, tolerance)
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn("__vs_tokens", n_tokens(text)).withColumn("__vs_s", F.coalesce(F.col("source").cast("string"), F.lit("(none)"))).withColumn("__vs_l", F.coalesce(F.col("lang").cast("string"), F.lit("(none)")))
    keyed = keyed.withColumn("__vs_t", F.coalesce(F.col(topic_col).cast("string"), F.lit("(none)")) if topic_col else topic(F.coalesce(text, F.lit("")), F.col("__vs_tokens")))
    side = cells.select(F.col("source").alias("__vs_s"), F.col("lang").alias("__vs_l"), F.col("topic").alias("__vs_t"), F.col("probability").alias("__vs_p"))
    return keyed.join(side, ["__vs_s", "__vs_l", "__vs_t"]).where(draw(F.col(id_col).cast("long"), seed) < F.col("__vs_p")).select(*docs.columns)


def oracle(rounds: int = ROUNDS, fraction: float = FRACTION, seed: int = SEED) -> str:
    """The same, as one SQL statement for the default targets."""
    topic_sql = "CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, '###') OR contains(x, '$$$') THEN 'markup' WHEN contains(x, '!! ') THEN 'shout' WHEN tokens < 100 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'book' END"
    ctes = [
        "f0 AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS x, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::DOUBLE AS tokens FROM documents)",
        f"f AS (SELECT doc_id, source, lang, {topic_sql} AS topic, tokens FROM f0)",
        "c0 AS (SELECT source, lang, topic, sum(tokens) AS mass FROM f GROUP BY ALL)",
        "c1 AS (SELECT *, " + ", ".join(f"sum(mass) OVER (PARTITION BY {d}) AS m_{d}" for d in DIMS) + " FROM c0)",
        "c2 AS (SELECT *, " + ", ".join(f"CASE WHEN m_{d} > 0 THEN pow(m_{d}, {TEMPER[d]}) ELSE 0 END AS p_{d}" for d in DIMS) + " FROM c1)",
        "w0 AS (SELECT source, lang, topic, mass, mass AS weight, " + ", ".join(f"coalesce(p_{d} / nullif(sum(CASE WHEN m_{d} > 0 THEN p_{d} * mass / m_{d} ELSE 0 END) OVER (), 0), 0) AS t_{d}" for d in DIMS) + " FROM c2)",
    ]
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, mass, coalesce(weight * t_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 0) AS weight, t_source, t_lang, t_topic FROM w{k})")
            k += 1
    ctes.append(f"r0 AS (SELECT source, lang, topic, mass, weight, CASE WHEN mass > 0 THEN weight / mass ELSE 0 END AS ratio, {fraction} * sum(mass) OVER () AS budget, FALSE AS was, 0.0::DOUBLE AS c FROM w{k})")
    for j in range(CAP_ROUNDS):
        ctes.append(f"s{j} AS (SELECT source, lang, topic, mass, weight, ratio, budget, was, coalesce((budget - sum(CASE WHEN was THEN mass ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN was THEN 0 ELSE weight END) OVER (), 0), 0) AS c FROM r{j})")
        ctes.append(f"r{j + 1} AS MATERIALIZED (SELECT source, lang, topic, mass, weight, ratio, budget, was OR c * ratio >= 1 AS was, c FROM s{j})")
    ctes.append(f"p AS (SELECT source, lang, topic, round(weight, 6) AS weight, round(CASE WHEN was THEN 1 ELSE greatest(0, least(1, c * ratio)) END, 6) AS probability FROM r{CAP_ROUNDS})")
    u = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}'), 1, 12))::BIGINT / 281474976710656.0"
    return f"WITH {', '.join(ctes)} SELECT f.doc_id, f.source, f.lang, f.topic, f.tokens::BIGINT AS tokens, p.weight, p.probability, {u} < p.probability AS sampled FROM f JOIN p USING (source, lang, topic)"
