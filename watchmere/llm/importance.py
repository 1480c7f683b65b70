"""Target-distribution importance resampling by hashed word features.

A document's features are hashed into ``BUCKETS`` buckets, as an array that one
higher-order function makes; a bucket's gain is the logarithm of how much commoner it
is in the target than in the documents.  A document's weight adds up the gains of its
array by another higher-order function over one literal array of all gains, so nothing
is exploded for scoring and only counts by bucket are shuffled.  Gumbel noise from a
seeded hash of the id makes the highest scores a sample in proportion to the weights.

The rank of a drawn document is its place in a global sort: range partitioned, then
numbered within tasks, with one row a task for where each begins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work, sort_globally

BUCKETS, GRAMS, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def featured(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """texts without text, with n_words and the bucket of every run of 1 to grams words; a null text has none."""
    rows = texts.withColumn("__words", words(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    hashed = lambda w: (F.crc32(w) % buckets).cast("int")
    run_of = lambda n: lambda i: hashed(F.array_join(F.slice("__words", i, n), " "))
    found = F.transform("__words", hashed)
    for n in range(2, grams + 1):
        starts = F.when(F.size("__words") >= n, F.sequence(F.lit(1), F.size("__words") - n + 1)).otherwise(F.array().cast("array<int>"))
        found = F.concat(found, F.transform(starts, run_of(n)))
    return rows.select(*(c for c in texts.columns if c != "text"), F.size("__words").cast("long").alias("n_words"), found.alias("buckets"))


def counts(rows: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: tasks count first, a row a bucket comes to the driver."""
    return {r["bucket"]: r["count"] for r in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
    return [gain(source.get(b, 0), target.get(b, 0)) for b in range(buckets)]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs, as likely drawn as its words are in target.

    Null and wordless texts have no features and a weight of 0, and aren't drawn.  A null
    id hashes as an empty text and comes before all others.  Rows that repeat an id have
    equal noise and are documents each; at equal scores and ids the smaller weight, then
    the fewer features come first, and rows alike in these are alike in all.  Of no documents or no
    target texts the counts are 0.  Other columns are ignored; an empty table gives an empty one.
    """
    work = Work(docs.sparkSession)
    rows = work.save(featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "features")
    gain = F.split(F.lit(",".join(map(str, gains(counts(rows), counts(featured(target.select("text"))))))), ",").cast("array<int>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = rows.select("doc_id", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), (weight + noise).alias("score"), (F.col("n_words") >= least_words).alias("may"))
    # nulls sort first, as the order of rank wants
    ordered = sort_globally(scored.select(F.when(F.col("may"), -F.col("score")).alias("down"), "*"), "may", "down", "doc_id", "weight", "n_features")
    placed = work.save(ordered.drop("down").withColumn("place", F.monotonically_increasing_id()), "placed")
    work.drop("features")
    task, within = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    drawable = placed.filter("may").groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.min(within).alias("skip")).collect()  # one row a task
    drawn, before, begin = percent * sum(r["n"] for r in drawable) // 100, 0, []
    for r in sorted(drawable, key=lambda r: r["task"]):
        begin.append((r["task"], before - r["skip"]))
        before += r["n"]
    starts = docs.sparkSession.createDataFrame(begin, "task long, start long")
    rank = F.when(F.col("may"), F.col("start") + within + 1)
    out = placed.withColumn("task", task).join(F.broadcast(starts), "task", "left").withColumn("rank", rank)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose ids are drawn; a null id draws none."""
    return docs.join(resample(docs, target, percent).filter("rank IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


#: DuckDB SQL of the op13 query over documents and benchmark; crc32 goes byte by byte over a table of 256 entries.
SQL = rf"""
WITH digits AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS b)),
steps AS (SELECT list(v ORDER BY b) AS step FROM digits),
split AS (
  SELECT 0 AS side, rowid_, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
  UNION ALL
  SELECT 1, NULL, NULL, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '') FROM benchmark
),
word AS (SELECT side, rowid_, unnest(w) AS w FROM split),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST('0x' || hex(encode(w))[2 * i - 1 : 2 * i] AS BIGINT))),
    lambda c, b: xor(c // 256, step[xor(c, b) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT w FROM word) CROSS JOIN steps
),
featured AS (SELECT side, rowid_, bucket FROM word JOIN hashed USING (w)),
sums AS (SELECT count(*) FILTER (WHERE side = 0) AS s_all, count(*) FILTER (WHERE side = 1) AS t_all FROM featured),
seen AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM featured GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM seen CROSS JOIN sums
),
weighed AS (SELECT rowid_, sum(g) AS weight FROM featured JOIN gain USING (bucket) WHERE side = 0 GROUP BY rowid_),
scored AS (
  SELECT d.rowid_, d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('{SEED}:' || CAST(d.doc_id AS VARCHAR))[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM split d LEFT JOIN weighed ON weighed.rowid_ = d.rowid_ WHERE side = 0
),
placed AS (SELECT rowid_, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed ON placed.rowid_ = scored.rowid_
"""
