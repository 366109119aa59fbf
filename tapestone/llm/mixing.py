"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling.

Tokens are summed by cell (source, language, topic). The cells' weights are raked in turn to the target share of each
source, language and topic, and a document is drawn with the probability that turns its cell's tokens into its weight.
Only DataFrame functions are used; a round of raking is three grouped sums over the cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_uniform, saved

MARGINS = ("source", "lang", "topic")
#: Topics by the first rule that holds, else prose.
TOPIC_RULES = (("contact", "[A-Za-z0-9]@[A-Za-z0-9]"), ("legal", "[Ll]icen[sc]e"), ("symbols", "[#*$%&|<>]{3}"), ("numbers", "[0-9]{4}"))
#: Cells up to this number (about 20 MB) are raked in one partition and broadcast; beyond it both are done by shuffles.
FEW_CELLS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, rule in reversed(TOPIC_RULES):
        out = F.when(F.coalesce(text.rlike(rule), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def target_shares(cells: DataFrame, margin: str, power: float, given: dict[str, float] | None) -> DataFrame:
    """(margin, share) of each value that the cells have; shares sum to 1.

    Without ``given``, a value's share of the tokens to the given power. With it, its given weight: a value that is left
    out, or given 0, gets none, and one that no cell has is passed over. ValueError if nothing is left or a weight is below 0.
    """
    if given is None:
        raw = cells.groupBy(margin).agg((F.sum("tokens") / F.sum(F.sum("tokens")).over(Window.partitionBy())).alias("share")).withColumn("share", F.pow("share", F.lit(float(power))))
    else:
        if any(w < 0 for w in given.values()) or not sum(given.values()) > 0:
            raise ValueError(f"target weights of {margin} must be 0 or more, and one above 0")
        told = cells.sparkSession.createDataFrame([(k, float(w)) for k, w in given.items()], f"{margin} string, share double")
        raw = cells.select(margin).distinct().join(told, margin, "left").select(margin, F.coalesce("share", F.lit(0.0)).alias("share"))
    return raw.select(margin, (F.col("share") / F.sum("share").over(Window.partitionBy())).alias("share"))


def rake(cells: DataFrame, powers: dict[str, float], rounds: int = 500, keep: float | None = None, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 1e-9, chunk: int = 5) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight`` and ``margin_error``.

    Each round scales every margin's values in turn to their target shares (``target_shares``), by sums grouped over the
    cells. With ``keep`` the weights sum to that share of all tokens; then no cell weighs more than its tokens, and each
    round rakes the others to what such cells lack. Every ``chunk`` rounds the weights are written, and the loop ends once
    no margin's share is more than ``tolerance`` off its target, or a chunk has brought that distance down by less than a
    twentieth: targets that contradict each other or the cells can't be met. ``margin_error`` is the distance then left;
    if that is beyond ``tolerance``, or ``rounds`` are over first, a warning says so.
    """
    targets = targets or {}
    whole = Window.partitionBy()
    few = cells.count() <= FEW_CELLS

    def near(rows: DataFrame) -> DataFrame:
        # so few cells are one partition, in which no margin's sum needs a shuffle of its own
        return rows.coalesce(1) if few else rows

    cells = near(cells)
    now = cells.withColumn("w", F.col("tokens") * F.lit(1.0 if keep is None else keep))
    for m in MARGINS:
        now = now.join(target_shares(cells, m, powers.get(m, 1.0), targets.get(m)).withColumnRenamed("share", f"t_{m}"), m)
        if keep is not None:
            now = now.withColumn(f"t_{m}", F.col(f"t_{m}") * keep * F.sum("tokens").over(whole))
    now, error = near(saved(now, "cells")), float("inf")
    for done in range(0, rounds, chunk):
        for _ in range(min(chunk, rounds - done)):
            for m in MARGINS:
                held = F.sum("w").over(Window.partitionBy(m))
                now = now.withColumn("w", F.coalesce(F.col("w") * F.col(f"t_{m}") / F.nullif(held, F.lit(0.0)), F.lit(0.0)))
            if keep is not None:
                now = now.withColumn("w", F.least("w", F.col("tokens").cast("double")))
        now = near(saved(now, "raked"))
        off = None
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum("w").alias("s"), F.first(f"t_{m}").alias("t")).select((F.abs(F.col("s") - F.col("t")) / F.sum("t").over(whole)).alias("off"))
            off = sums if off is None else off.unionByName(sums)
        last, error = error, off.agg(F.max("off")).first()[0] or 0.0
        if error <= tolerance or error > 0.95 * last:
            break
    if error > tolerance:
        warnings.warn(f"raking ended {error:.2g} off its targets, which these cells may not be able to meet", stacklevel=2)
    return now.select(*MARGINS, "tokens", F.col("w").alias("weight"), F.lit(error).alias("margin_error"))


def budget_scale(raked: DataFrame, keep: float) -> DataFrame:
    """``scale``: the factor of all ratios with which min(1, scale * ratio) keeps the share ``keep`` of all tokens; null if only 1 everywhere does."""
    order = [F.col("ratio").desc(), *MARGINS]
    before, after = (Window.orderBy(*order).rowsBetween(*span) for span in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)))
    # at each cell: all above it are whole, and it and the rest share what is then left
    rest = keep * F.sum("tokens").over(Window.partitionBy()) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    at = raked.withColumn("scale", rest / F.nullif(F.sum("weight").over(after), F.lit(0.0)))
    return at.filter(F.col("scale") * F.col("ratio") <= 1).agg(F.max_by("scale", F.struct("ratio", "scale")).alias("scale"))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, rounds: int = 500, seed: int = 13, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: float | None = None, targets: dict[str, dict[str, float]] | None = None, columns: list[str] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """All rows of ``docs``, and its ``columns`` (default: all), with topic, tokens, probability, selected and margin_error.

    ``margin_error`` is how far the greatest deviation of a margin's share from its target still is, the same in all rows; a
    warning tells where it is beyond ``tolerance`` (see ``rake``).

    ``targets`` gives the target weights of a margin's values (``{"source": {"web": 3, "books": 1}}``, see
    ``target_shares``); margins that it leaves out are tempered by ``powers``. Tokens are words. The probability is the
    cell's weight over its tokens, scaled so that the greatest is 1, or with ``keep`` so that this share of all tokens is
    kept in expectation: cells too small for their weight are kept whole, and the others make up for them. The draw is the
    id's seeded hash, so rows of one id share it, and all null ids do. A null source or language is a value of its own
    (``-``); null and empty texts have no tokens: a cell without tokens keeps its documents. Existing columns of the added
    names are replaced; an empty table gives an empty result.
    """
    powers = powers if powers is not None else {"source": 0.7, "lang": 0.8}
    docs = docs.drop("topic", "tokens", "probability", "selected", "margin_error")
    carried = [c for c in docs.columns if columns is None or c in columns]
    # the texts are read and told once; what follows reads what was written
    told = saved(
        docs.select(
            *carried,
            F.col(id_col).alias("_tp_id"),
            (topic if topic is not None else topic_of(F.col(text_col))).alias("topic"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("-")).alias("_tp_source"),
            F.coalesce(F.col(lang_col).cast("string"), F.lit("-")).alias("_tp_lang"),
        ),
        "told",
    )
    names = {"_tp_source": "source", "_tp_lang": "lang", "topic": "topic"}
    cells = told.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    raked = rake(saved(cells, "cell-tokens"), powers, rounds, keep, targets, tolerance).withColumn("ratio", F.col("weight") / F.col("tokens"))
    # one number for all cells
    error = raked.agg(F.max("margin_error")).first()[0] or 0.0
    scale = (raked.agg((1.0 / F.nullif(F.max("ratio"), F.lit(0.0))).alias("scale")) if keep is None else budget_scale(raked, keep)).first()["scale"]
    chance = F.lit(1.0) if scale is None and keep is not None else F.least(F.lit(1.0), F.col("ratio") * F.lit(scale if scale is not None else 0.0))
    chances = raked.select(*[F.col(n).alias(f"_tp_c_{n}") for n in MARGINS], F.when(F.col("weight") > 0, chance).otherwise(0.0).alias("probability"))
    on = (F.col("_tp_source") == F.col("_tp_c_source")) & (F.col("_tp_lang") == F.col("_tp_c_lang")) & (F.col("topic") == F.col("_tp_c_topic"))
    chances = F.broadcast(chances) if raked.count() <= FEW_CELLS else chances.hint("merge")
    drawn = told.join(chances, on, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    selected = id_uniform(seed, F.coalesce(F.col("_tp_id"), F.lit(-1))) < F.col("probability")
    return drawn.withColumn("selected", selected).withColumn("margin_error", F.lit(float(error))).drop("_tp_id", "_tp_source", "_tp_lang", *[f"_tp_c_{n}" for n in MARGINS])


def oracle(powers: dict[str, float], rounds: int = 20, seed: int = 13) -> str:
    rules = " ".join(f"WHEN regexp_matches(text, '{rule}') THEN '{name}'" for name, rule in TOPIC_RULES)
    parts = [f"""told AS (SELECT doc_id, coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, CASE {rules} ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
c0 AS (SELECT source, lang, topic, sum(tokens) AS tokens, CAST(sum(tokens) AS DOUBLE) AS w FROM told GROUP BY 1, 2, 3 HAVING sum(tokens) > 0)"""]
    for m in MARGINS:
        parts.append(f"t_{m} AS (SELECT {m}, p / sum(p) OVER () AS t FROM (SELECT {m}, pow(sum(tokens) / (SELECT sum(tokens) FROM c0), {powers.get(m, 1.0)}) AS p FROM c0 GROUP BY {m}))")
    last = "c0"
    for r in range(rounds):
        for m in MARGINS:
            parts.append(f"r{r}_{m} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * t.t / sum(c.w) OVER (PARTITION BY c.{m}) AS w FROM {last} c JOIN t_{m} t ON c.{m} = t.{m})")
            last = f"r{r}_{m}"
    parts.append(f"ratio AS (SELECT source, lang, topic, w / tokens AS ratio FROM {last})")
    draw = f"CAST(CAST('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    chance = "coalesce(ratio / (SELECT max(ratio) FROM ratio), 1.0)"
    return f"WITH {', '.join(parts)} SELECT doc_id, topic, CAST(tokens AS BIGINT) AS tokens, round({chance}, 6) AS probability, {draw} < {chance} AS selected FROM told LEFT JOIN ratio USING (source, lang, topic)"
