"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches. Each batch's lines are hashed and counted, merge-anti-joined with the runs of settled hashes and
added as a new run, sorted by hash; when a level has gathered `fanout` runs they are merged into one run of the next level.
A run holds, for each hash, the number of documents with the line, so that runs of different batches add up. A merge that
finds a hash in enough documents settles it: it leaves the counting, and later batches drop it by their anti-join.

Hashes are 128 bits wide (two XXH64 of differing seeds). Rows: a null or empty text is one empty line. Rows with equal
doc_id and text count as one document. Extra columns are ignored; an empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnframe.llm.common import ascii_lower, join_rows, text_key, whole_rows, written

HASH = ["h1", "h2"]
BATCHES, FANOUT = 8, 2


def line_key(line: Column) -> Column:
    """Stripped of spaces and code points 9 to 13 at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def lines(documents: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, _key, line, h1, h2): line is the number, from 0, of a line whose key has at least `least` code points."""
    each = documents.select("doc_id", text_key(F.col("text")).alias("_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "at"))
    keyed = each.select("doc_id", "_key", "line", line_key(F.col("at")).alias("key")).where(F.length("key") >= least)
    return keyed.select("doc_id", "_key", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


@dataclass
class LineRuns:
    """Levels of sorted runs (h1, h2, n), each a written table; a level keeps fewer than `fanout` runs.

    With `settle`, hashes that a merge finds in at least so many documents move to the settled runs.
    """

    fanout: int = FANOUT
    settle: int | None = None
    levels: list[list[DataFrame]] = field(default_factory=list)
    settled: list[DataFrame] = field(default_factory=list)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            if self.settle is not None:
                self.settled.append(merged.where(F.col("n") >= self.settle))
                merged = merged.where(F.col("n") < self.settle)
            self._put(merged, level + 1)

    @staticmethod
    def _sorted_run(counts: DataFrame) -> DataFrame:
        return written(counts.sortWithinPartitions(*HASH), "run")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for r in runs[1:]:
            every = every.union(r)
        return self._sorted_run(every.groupBy(*HASH).agg(F.sum("n").alias("n")))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Adds batch (doc_id, _key, line, h1, h2), whose documents are in no other batch, as a run without settled hashes."""
        counts = batch.select("doc_id", "_key", *HASH).distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"))
        self._put(self._sorted_run(_without(counts, self.settled)), 0)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of batch whose hash is in no run: a merge anti-join with each."""
        return _without(batch, [*self.settled, *self.runs()])

    def frequent(self, documents: int) -> DataFrame:
        """(h1, h2) of the lines found in at least so many documents, which is at most `settle` where that is set."""
        if self.settle is not None and self.settle < documents:
            raise ValueError("hashes were settled with fewer documents")
        runs = self.runs()
        found = (self._merged(runs) if len(runs) > 1 else runs[0]).where(F.col("n") >= documents)
        for r in self.settled:
            found = found.union(r.where(F.col("n") >= documents))
        return found.select(*HASH)


def _without(rows: DataFrame, runs: list[DataFrame]) -> DataFrame:
    for r in runs:
        rows = rows.join(r, HASH, "left_anti")
    return rows


def _batch(hashed: DataFrame, k: int) -> DataFrame:
    return hashed.where(F.col("batch") == k)


def first_seen_lines(documents: DataFrame, batches: int = BATCHES, least: int = 1) -> DataFrame:
    """The lines (as of lines()) that no earlier batch has: each batch is merge-anti-joined with the runs and then adds its own.

    A line that repeats inside one batch keeps its first row by (doc_id, _key, line).
    """
    hashed = written(lines(documents, least).withColumn("batch", F.pmod(F.xxhash64("doc_id", "_key"), F.lit(batches)).cast("int")), "lines", "batch")
    runs, new = LineRuns(), []
    for k in range(batches):
        batch = _batch(hashed, k).drop("batch")
        fresh = runs.unseen(batch) if runs.runs() else batch
        first = fresh.groupBy(*HASH).agg(F.min(F.struct("doc_id", "_key", "line")).alias("at"))
        new.append(written(first.select("at.doc_id", "at._key", "at.line", *HASH), "new"))
        runs.add(fresh)
    out = new[0]
    for x in new[1:]:
        out = out.union(x)
    return out


def frequent_lines(documents: DataFrame, documents_at_least: int = 10, least: int = 1, batches: int = BATCHES) -> DataFrame:
    """(doc_id, _key, lines): the numbers of the lines of each document whose key is in at least so many documents."""
    hashed = written(lines(documents, least).withColumn("batch", F.pmod(F.xxhash64("doc_id", "_key"), F.lit(batches)).cast("int")), "lines", "batch")
    runs = LineRuns(settle=documents_at_least)
    for k in range(batches):
        runs.add(_batch(hashed, k))
    common = written(runs.frequent(documents_at_least), "frequent")
    return hashed.join(common, HASH, "left_semi").groupBy("doc_id", "_key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without_frequent_lines(documents: DataFrame, documents_at_least: int = 10, least: int = 1) -> DataFrame:
    """documents with n_lines (before), n_dropped and text cut to the lines that stay. Extra columns are kept."""
    drops = frequent_lines(documents, documents_at_least, least).withColumnRenamed("lines", "_lines")
    all_lines = F.split(F.coalesce("_row.text", F.lit("")), "\n")
    own = [F.col(f"_row.`{c}`") for c in documents.columns if c not in ("n_lines", "n_dropped", "text")]
    joined = join_rows(whole_rows(documents), drops, "left").select("_row", all_lines.alias("_all"), "_lines")
    stay = F.when(F.col("_lines").isNull(), F.col("_all")).otherwise(F.filter("_all", lambda x, i: ~F.array_contains("_lines", i)))
    found = joined.select(
        "_row",
        F.size("_all").cast("long").alias("n_lines"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_dropped"),
        F.array_join(stay, "\n").alias("text"),
    )
    return found.select(*own, "n_lines", "n_dropped", "text")


def op3_line_dedup(documents: DataFrame) -> DataFrame:
    return without_frequent_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, t, i, ls[i] AS line,
        translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM d)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT {'i': doc_id, 't': t}) >= 10),
m AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, cast(count(*) FILTER (gone) AS bigint) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
