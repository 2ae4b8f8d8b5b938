"""Benchmark decontamination by a distributed positional inverted index.

The frequency of every benchmark word is counted over the corpus. Each window of benchmark words gets its anchors: its
rarest term, and the next rarest ones that are not much more common. The index is a written table of the corpus postings
(doc_id, _key, pos, term) of the anchor terms. A window is looked up from its rarest term: a posting gives a document and
an offset-adjusted start, and the starts of a window's anchors are intersected. The few documents left are then checked
word by word, so that the hits are exact phrases.

Rows: a null text has no words. Repeated rows each get the same result; rows that share a doc_id but not a text are told
apart by _key. Items with the same text all match; an item_id that is null is left out of the lists. Tables may be empty,
and extra columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnframe.llm.common import ascii_lower, join_rows, text_key, whole_rows, written

#: What separates words: ASCII that is no letter or digit.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10


def words(text: Column) -> Column:
    """The words as they stand, upper case and all; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): item is a number of the text's own, so that items with equal texts are looked up once."""
    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words(F.col("text")), ascii_lower).alias("words"))
    return found.where(F.size("words") > 0).withColumn("item", F.xxhash64("words"))


def tokens(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, _key, pos, term) of the corpus words that are in vocabulary (term)."""
    each = documents.select("doc_id", text_key(F.col("text")).alias("_key"), F.posexplode(words(F.col("text"))).alias("pos", "term")).select("doc_id", "_key", "pos", ascii_lower(F.col("term")).alias("term"))
    # written, so that Spark knows its size: it broadcasts a small vocabulary and merge-joins a large one
    return each.join(written(vocabulary.select("term").distinct(), "vocabulary"), "term").select("doc_id", "_key", "pos", "term")


def postings(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The index, a written table: tokens(documents, vocabulary)."""
    return written(tokens(documents, vocabulary), "postings")


def anchors(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, at, off, term): for the window of item that starts at `at`, its rarest term's offset in the item, and those of up to two more.

    A further term is taken only if it is not over four times as frequent, or rare anyway. A window with a word that the
    corpus lacks has none.
    """
    each = items.select("item", "words").dropDuplicates(["item"])
    last = F.greatest(F.size("words") - width, F.lit(0))
    windows = each.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    terms = windows.select("item", "at", F.posexplode(F.slice("words", F.col("at") + 1, width)).alias("k", "term"))
    frequency = written(tokens(documents, items.select(F.explode("words").alias("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequency")
    own = Window.partitionBy("item", "at")
    known = terms.join(frequency, "term", "left").withColumn("rank", F.row_number().over(own.orderBy("df", "term", "k"))).withColumn("least", F.min("df").over(own)).withColumn("lacks", F.count_if(F.col("df").isNull()).over(own))
    taken = known.where((F.col("lacks") == 0) & (F.col("rank") <= 3) & ((F.col("rank") == 1) | (F.col("df") <= 4 * F.col("least") + 1000)))
    return written(taken.select("item", "at", (F.col("at") + F.col("k")).alias("off"), "term"), "anchors")


def candidates(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc_id, _key, item, start): where all anchors of some window of the item meet, the item's first word lying at `start`."""
    asked = written(anchored.select("item", "off", "term").distinct(), "asked")
    sets = written(anchored.groupBy("item", "at").agg(F.array_sort(F.collect_set("off")).alias("offs")).groupBy("item").agg(F.collect_set("offs").alias("sets")), "sets")
    met = index.join(asked, "term").select("doc_id", "_key", "item", (F.col("pos") - F.col("off")).alias("start"), "off")
    met = met.groupBy("doc_id", "_key", "item", "start").agg(F.collect_set("off").alias("met")).join(sets, "item")
    return met.where(F.exists("sets", lambda s: F.size(F.array_except(s, "met")) == 0)).select("doc_id", "_key", "item", "start")


def _hits(own: Column, item: Column, start: Column, width: int) -> Column:
    """The positions of own inside runs of at least width words (or all of the item's) that agree with item laid at start."""
    ints = "array<int>"
    n = F.size(item)
    same = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (start + k >= 0) & F.coalesce(F.get(own, start + k) == F.get(item, k), F.lit(False)))
    size = F.least(n, F.lit(width))
    zero = F.struct(F.lit(-2).alias("last"), F.array().cast(ints).alias("run"), F.array().cast(ints).alias("done"))
    close = lambda a: F.concat(a["done"], F.when(F.size(a["run"]) >= size, a["run"]).otherwise(F.array().cast(ints)))
    runs = F.aggregate(
        same,
        zero,
        lambda a, x: F.when(x == a["last"] + 1, F.struct(x.alias("last"), F.concat(a["run"], F.array(x)).alias("run"), a["done"].alias("done"))).otherwise(F.struct(x.alias("last"), F.array(x).alias("run"), close(a).alias("done"))),
        close,
    )
    return F.transform(runs, lambda k: k + start)


def phrase_matches(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents (doc_id, text) with n_words and matches, an array of (item, hits): the positions in the document inside a window of the item.

    items: as of item_words. A window is width consecutive words, or the whole item if it is shorter. Alignments of an
    item that hold no window have no entry.
    """
    anchored = anchors(documents, items, width)
    index = postings(documents, anchored)
    each = items.select("item", "words").dropDuplicates(["item"])
    found = candidates(index, anchored).join(each, "item")
    found = written(found.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("item", "start", "words")).alias("found")), "candidates")
    marked = documents.select("doc_id", "text", text_key(F.col("text")).alias("_key"))
    joined = join_rows(marked, found, "left")
    # the words are bound as a lambda's variable: a column would be put into the inner lambda and split anew for each element
    fits = lambda own: F.filter(F.transform("found", lambda c: F.struct(c["item"].alias("item"), _hits(own, c["words"], c["start"], width).alias("hits"))), lambda m: F.size(m["hits"]) > 0)
    matches = F.when(F.col("found").isNotNull(), F.get(F.transform(F.array(words(ascii_lower(F.col("text")))), fits), 0))
    none = F.array().cast("array<struct<item:bigint,hits:array<int>>>")
    return joined.select("doc_id", "_key", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.coalesce(matches, none).alias("matches"))


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = 20) -> DataFrame:
    """(doc_id, _key, item, pos): a posting at pos of the item's rarest term with every other term of the item within slop words of it.

    The lookup starts from the rarest term's postings; each other term is an offset range intersected with them.
    """
    each = items.select("item", "words").dropDuplicates(["item"])
    terms = each.select("item", F.explode(F.array_distinct("words")).alias("term"))
    frequency = index.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rank = Window.partitionBy("item").orderBy(F.col("df").asc_nulls_first(), "term")
    ranked = terms.join(frequency, "term", "left").withColumn("rank", F.row_number().over(rank))
    n = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    near = index.join(ranked.where("rank = 1 and df is not null").select("item", "term"), "term").select("doc_id", "_key", "item", F.col("pos").alias("at"))
    # other terms meet it in cells of slop + 1 words, its own and the two beside it
    cell = slop + 1
    rest = index.join(ranked.where("rank > 1").select("item", "term"), "term").select("doc_id", "_key", "item", "term", "pos", F.floor(F.col("pos") / cell).alias("cell"))
    here = near.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / cell) + d)))
    met = join_rows(here, rest, "inner", "item", "cell").where(F.abs(F.col("at") - F.col("pos")) <= slop)
    met = met.groupBy("doc_id", "_key", "item", "at").agg(F.count_distinct("term").alias("met"))
    all_met = join_rows(near.distinct(), met, "left", "item", "at").join(n, "item")
    return all_met.where(F.coalesce("met", F.lit(0)) == F.col("n") - 1).select("doc_id", "_key", "item", F.col("at").alias("pos"))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, _key, n_words, n_hit, items) for every row; items: the item_ids with an occurring window, sorted as strings."""
    items = written(item_words(benchmark), "items")
    found = phrase_matches(documents, items, width)
    # the ids of a matched item: rows that match are few, and the table of items is small
    ids = items.where("item_id is not null").groupBy("item").agg(F.collect_set("item_id").alias("ids"))
    found = found.withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["hits"])))).cast("long"))
    kept = written(found.select("doc_id", "_key", "n_words", "n_hit", F.array_distinct(F.transform("matches", lambda m: m["item"])).alias("of")), "found")
    named = kept.where("n_hit > 0").select("doc_id", "_key", F.explode("of").alias("item")).join(ids, "item").groupBy("doc_id", "_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    return join_rows(kept.drop("of"), named, "left").select("doc_id", "_key", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents without the rows that hold a window of the benchmark."""
    hit = contamination(documents, benchmark, width).where("n_hit > 0").select("doc_id", "_key").distinct()
    return join_rows(whole_rows(documents), hit, "left_anti").select("_row.*")


def op2_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP2_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
bw AS (
  SELECT item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM bw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bwin),
dwin AS (
  SELECT r, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT r, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM dw, sizes WHERE len(words) >= size)),
hit AS (SELECT d.r, d.i, d.size, b.item_id FROM dwin d JOIN bwin b ON d.size = b.size AND d.win = b.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
