"""Cross-site boilerplate: lines that spread over many distinct sites.

Each line's sites go into a HyperLogLog sketch, and sketches of one line hash merge by aggregation. Lines whose estimate
is near the threshold get an exact distinct count. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved


def _hash(line: Column) -> Column:
    """128 bits of two hashes, the second from another start: no two lines of a corpus share both."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _long_enough(line: Column, min_words: int) -> Column:
    """At least ``min_words`` words, told by the single spaces between them."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= min_words - 1


def spread_lines(lines: DataFrame, min_sites: int, log_k: int = 8, errors: float = 4.0) -> DataFrame:
    """(hash, first_id, n) of the lines (hash, site, id) that stand on ``min_sites`` distinct sites or more; ``n`` is how often they stand.

    An estimate at least ``errors`` standard errors (and two sites) off the threshold decides; the rest are counted.
    """
    # copies of a line on one site meet first, so that a hot line is a few rows of each task from here on
    placed = saved(lines.groupBy("hash", "site").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "line-sites")
    sketched = placed.groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(log_k)).alias("sites"), F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    estimated = saved(sketched.filter(F.col("n") >= min_sites).select("hash", "first_id", "n", F.hll_sketch_estimate("sites").alias("estimate")), "line-spread")
    margin = max(2.0, errors * 1.04 / (1 << log_k) ** 0.5 * min_sites)
    sure = estimated.filter(F.col("estimate") >= min_sites + margin)
    near = estimated.filter((F.col("estimate") < min_sites + margin) & (F.col("estimate") > min_sites - margin))
    counted = placed.join(near.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.count("site").alias("exact")).filter(F.col("exact") >= min_sites)
    return sure.select("hash", "first_id", "n").unionByName(near.join(counted, "hash").select("hash", "first_id", "n"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 3, min_words: int = 4, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, without boilerplate lines in the text, and ``n_removed``.

    A line, between line feeds and taken whole, of at least ``min_words`` words is boilerplate if it stands on at least
    ``min_sites`` distinct sites. It stays in the document with the smallest id among those that have it, and goes from
    all others. A null text stays null; a text may become empty; a null site counts as no site, a null id keeps its
    lines; rows of one id are cleaned alike; a column n_removed is replaced, any other name may be there; an empty table
    gives an empty result.
    """
    docs = docs.drop("n_removed")
    split = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.explode(F.split(text_col, "\n")).alias("line"))
    # the texts are split once; all counts then read these few bytes for each line
    lines = saved(split.filter(_long_enough(F.col("line"), min_words)).select("id", F.col("site").cast("string").alias("site"), _hash(F.col("line")).alias("hash")), "lines")
    spread = saved(spread_lines(lines, min_sites), "boilerplate")
    n_lines = spread.agg(F.sum("n")).first()[0] or 0
    # a line that stands in very many documents is met by a broadcast of at most 1,000 such lines
    met = join_hot(lines.filter("id is not null"), spread, ["hash"], "n", n_lines)
    found = met.filter(F.col("id") > F.col("first_id")).select("id", "hash")
    gone = saved(found.groupBy(F.col("id").alias("_tp_id")).agg(F.collect_set("hash").alias("_tp_gone")), "line-gone")
    # texts are shuffled once, at every size: the removals grow with the corpus and are no broadcast
    joined = docs.join(gone.hint("merge"), docs[id_col] == gone["_tp_id"], "left").drop("_tp_id")
    parts = F.split(text_col, "\n")
    stays = F.filter(parts, lambda x: ~(_long_enough(x, min_words) & F.array_contains("_tp_gone", _hash(x))))
    cleaned = joined.withColumn("_tp_lines", F.when(F.col("_tp_gone").isNotNull(), stays))
    removed = F.coalesce(F.size(parts) - F.size("_tp_lines"), F.lit(0))
    return cleaned.withColumn("n_removed", F.when(F.col("_tp_gone").isNull(), F.lit(0)).otherwise(removed).cast("long")).withColumn(text_col, F.when(F.col("_tp_gone").isNull(), F.col(text_col)).otherwise(F.array_join("_tp_lines", "\n"))).drop("_tp_gone", "_tp_lines")


def oracle(min_sites: int = 3, min_words: int = 4) -> str:
    return f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
long AS (SELECT * FROM lines WHERE length(line) - length(replace(line, ' ', '')) >= {min_words - 1}),
spread AS (SELECT line, min(doc_id) AS first_id FROM long GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
placed AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM documents),
marked AS (SELECT p.doc_id, p.line, p.at, (s.line IS NOT NULL AND p.doc_id > s.first_id) AS gone FROM placed p LEFT JOIN spread s USING (line))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.at) FILTER (WHERE NOT m.gone), '') END AS text,
       CAST(coalesce(sum(CAST(m.gone AS INT)), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text"""
