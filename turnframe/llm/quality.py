"""Quality rules with host verdicts.

Every document gets counts from its own text and a base verdict. The base failures are aggregated by host (the source
column); a beta prior is fitted to the hosts' failure rates by moments, and each host's rate is shrunk towards it. A host
whose shrunk rate stays above the limit even at the lower end of its posterior is rejected, and the verdicts are joined
back to the documents.

Rows: a null text has no words and fails the base; a null source is a host of its own. Repeated rows count each. Extra
columns are ignored; an empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.llm.common import SPACE, written

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A host goes if its posterior failure rate, less this many posterior deviations, is above the limit.
LIMIT, DEVIATIONS = 0.5, 2.0
NONE = "array<int>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def with_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select("doc_id", "source", text.alias("text")).withColumn("words", words(F.col("text")))
    # a window's hash and place, sorted: equal windows stand side by side
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    hashed = F.when(F.size("words") > WINDOW, F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("words", i, WINDOW)).alias("h"), i.alias("i")))))
    base = base.withColumn("sorted", hashed)
    n = F.size("sorted")
    twins = F.zip_with(F.slice("sorted", 1, F.greatest(n - 1, F.lit(0))), F.slice("sorted", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    base = base.withColumn("twins", F.filter(twins, lambda x: x.isNotNull()))
    places = F.when(F.size("twins") > 0, F.array_sort(F.array_distinct(F.flatten("twins"))))
    base = base.withColumn("places", F.coalesce(places, F.array().cast(NONE)))
    # words covered by windows that start at these places
    covered = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    wordy = F.filter(F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    counted = base.withColumn("lines", wordy).select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return counted.withColumn("base_failed", failed)


def host_verdicts(counted: DataFrame, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """(source, n_docs, n_failed, rate, host_kept): rate is shrunk with a beta prior whose moments are those of the hosts' rates.

    With fewer than two hosts, or rates that do not vary beyond chance, the prior is as strong as a hundred documents.
    """
    hosts = written(counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    mean = min(max(m["mean"] or 0.0, 1e-6), 1 - 1e-6)
    between = (m.v or 0.0) - mean * (1 - mean) * (m.inv or 0.0)  # what varies beyond chance
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 100.0) if between > 0 else 100.0
    a, b = F.col("n_failed") + mean * strength, F.col("n_docs") - F.col("n_failed") + (1 - mean) * strength
    post = a / (a + b)
    low = post - deviations * F.sqrt(post * (1 - post) / (a + b + 1))
    return hosts.select("source", "n_docs", "n_failed", post.alias("rate"), (low <= limit).alias("host_kept"))


def quality(documents: DataFrame) -> DataFrame:
    """with_counts() and kept: false if the base failed or the host is rejected."""
    counted = written(with_counts(documents), "counted")
    hosts = host_verdicts(counted).select(F.col("source").alias("host"), "host_kept")
    joined = counted.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host", "host_kept")


def op4_quality(documents: DataFrame) -> DataFrame:
    return quality(documents).drop("source")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, win FROM win GROUP BY r, win HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM win JOIN twice USING (r, win)) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY r),
c AS (
  SELECT w.doc_id, w.source, cast(len(ws) AS bigint) AS n_words, cast(length(array_to_string(ws, '')) AS bigint) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    cast(coalesce(dup.n, 0) AS bigint) AS n_dup_lines, cast(coalesce(rep.n, 0) AS bigint) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT source, cast(count(*) AS double) AS n, cast(count(*) FILTER (base_failed) AS double) AS f FROM b GROUP BY source),
m AS (SELECT least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS mean, var_pop(f / n) AS v, avg(1 / n) AS inv FROM h),
p AS (SELECT mean, v - mean * (1 - mean) * inv AS between_v FROM m),
s AS (SELECT mean, CASE WHEN between_v > 0 THEN least(greatest(mean * (1 - mean) / between_v - 1, 1.0), 100.0) ELSE 100.0 END AS k FROM p),
q AS (SELECT source, (f + mean * k) / (n + k) AS post, n + k + 1 AS t FROM h, s),
v AS (SELECT source, post - 2.0 * sqrt(post * (1 - post) / t) <= 0.5 AS host_kept FROM q)
SELECT b.* EXCLUDE (source), NOT base_failed AND host_kept AS kept FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
