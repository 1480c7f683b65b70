"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's rate is the mean number of copies of its documents that brings its
share of all characters to its target weight.  A document's count inverts the
Poisson distribution of that mean at a uniform number made from a hash of the
seed and its id, so the count depends on nothing else and a lost task repeats it.
Documents are exploded by their counts.  Another hash, uniform over all copies, deals
them to partitions and orders them there: a global shuffle that is the same on every
run (for the same number of partitions), without a pass that samples the data first.

Sizes are one partially aggregated pass.  Up to ``MAX_LITERAL`` sources the rates
are a literal in the plan (checked by collecting one row more); beyond, they are
joined (Spark broadcasts them while they are small; else a hot source's rows are
split by adaptive skew handling).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import spare_name

MAX_LITERAL = 1000
#: A rate above LARGE is drawn as the sum of several counts, so that exp(-rate) keeps its precision.
LARGE, TERMS = 16.0, 64


def _uniform(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts: 52 bits, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """key, rate, draws and the thresholds of a draw of every source.

    weights: target share of each source (they are scaled to sum to one; sources
    without one get none of the mix); without weights the share is the size to the
    power alpha.  key is ``s`` + source, or ``n`` for the rows without one.  A source
    whose texts are all empty has no size: its rate is ``epochs``.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key")
    sizes = docs.select(key, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")).groupBy("key").agg(F.sum("n").alias("n"))
    if weights is None:
        wish = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        wish = F.coalesce(F.from_json(F.lit(json.dumps({f"s{k}": v for k, v in weights.items()})), "map<string,double>")[F.col("key")], F.lit(0.0))
    sizes = sizes.select("key", "n", F.when(F.col("n") > 0, wish).otherwise(0.0).alias("wish"))
    total = sizes.agg(F.sum("n").cast("double").alias("all"), F.sum("wish").alias("wishes"))
    joined = sizes.join(F.broadcast(total))  # one row
    rate = F.when(F.col("n") == 0, F.lit(float(epochs))).when(F.col("wishes") > 0, F.col("wish") / F.col("wishes") * F.col("all") * float(epochs) / F.col("n")).otherwise(0.0)
    return joined.select("key", rate.alias("rate")).select("key", "rate", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGE)).cast("int").alias("draws")).select("key", "rate", "draws", _thresholds(F.col("rate") / F.col("draws")).alias("cdf"))


def _thresholds(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... TERMS."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["cdf"]


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """docs with each row as often as its draw says: its columns, then copies, copy (from 1) and shuffle_key, in random order.

    Rows with the same id get the same count (a null id counts as an empty one);
    rows without a text have no size but are replicated like the others.  Columns
    named copies, copy or shuffle_key are replaced.  An empty table gives an empty
    one.
    """
    columns = [c for c in docs.columns if c not in ("copies", "copy", "shuffle_key")]
    docs = docs.select(*columns)
    table = rates(docs, weights, alpha, epochs)
    known = table.limit(MAX_LITERAL + 1).collect()
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rate = spare_name(columns, "rate")
    if len(known) <= MAX_LITERAL:
        literal = json.dumps({r["key"]: {"draws": r["draws"], "cdf": r["cdf"]} for r in known})
        rated = docs.select("*", F.from_json(F.lit(literal), "map<string,struct<draws:int,cdf:array<double>>>")[key].alias(rate))
    else:
        mark = spare_name(columns, "key")
        rated = docs.withColumn(mark, key).join(table.select(F.col("key").alias(mark), F.struct("draws", "cdf").alias(rate)), mark).drop(mark)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def draw(j):
        u = _uniform(F.lit(seed), ident, j.cast("string"))
        return F.size(F.filter(F.col(rate)["cdf"], lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col(rate)["draws"]), F.lit(0), lambda acc, j: acc + draw(j))
    counted = rated.select(*columns, count.alias("copies")).filter("copies > 0")
    copied = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    shuffled = copied.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws(":", F.lit(seed + "-order"), ident, F.col("copy").cast("string"))), 1, 16))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shuffled.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")


#: DuckDB SQL of replicate() with its defaults over documents, for draws of one (rates up to LARGE).
SQL = f"""
WITH RECURSIVE sized AS (
  SELECT coalesce('s' || source, 'n') AS key, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n FROM documents GROUP BY 1
), wished AS (
  SELECT key, n, CASE WHEN n > 0 THEN pow(CAST(n AS DOUBLE), 0.5) ELSE 0.0 END AS wish FROM sized
), rated AS (
  SELECT key, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE wish / (SELECT sum(wish) FROM wished) * (SELECT CAST(sum(n) AS DOUBLE) FROM wished) * 1.0::DOUBLE / n END AS rate FROM wished
), steps AS (
  SELECT key, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rated
  UNION ALL
  SELECT key, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < {TERMS}
), drawn AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13)) AS BIGINT) / {float(1 << 52)!r} AS u FROM documents
), counted AS (
  SELECT d.doc_id, count(*) AS copies FROM drawn d JOIN steps s ON s.key = d.key AND s.cdf <= d.u GROUP BY d.doc_id
)
SELECT t.doc_id, t.source, t.text, CAST(c.copies AS INTEGER) AS copies, CAST(g.copy AS INTEGER) AS copy,
       substr(md5('mix-order:' || coalesce(CAST(t.doc_id AS VARCHAR), '') || ':' || CAST(g.copy AS VARCHAR)), 1, 16) AS shuffle_key
FROM counted c JOIN documents t ON t.doc_id = c.doc_id, unnest(range(1, c.copies + 1)) AS g(copy)
"""
