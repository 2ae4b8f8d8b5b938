"""Readers and writers of interval records as text: turns, evaluated time and word maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.functions.text import clean_time, stem

FIELDS = ["type", "uri", "chnl", "tbeg", "tdur", "word", "subt", "spkr", "conf"]
#: The record types and their subtypes that a strict reader accepts.
TYPES = {
    "SEGMENT": {"eval", "<na>"},
    "NOSCORE": {"<na>"},
    "NO_RT_METADATA": {"<na>"},
    "LEXEME": {"lex", "fp", "frag", "un-lex", "for-lex", "alpha", "acronym", "interjection", "propernoun", "other"},
    "NON-LEX": {"laugh", "breath", "lipsmack", "cough", "sneeze", "other"},
    "NON-SPEECH": {"noise", "music", "other"},
    "FILLER": {"filled_pause", "discourse_marker", "discourse_response", "explicit_editing_term", "other"},
    "EDIT": {"repetition", "restart", "revision", "simple", "complex", "other"},
    "IP": {"edit", "filler", "edit&filler", "other"},
    "SU": {"statement", "backchannel", "question", "incomplete", "unannotated", "other"},
    "CB": {"coordinating", "clausal", "other"},
    "A/P": {"<na>"},
    "SPEAKER": {"<na>"},
    "SPKR-INFO": {"adult_male", "adult_female", "child", "unknown"},
}


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def parse_lenient(lines: DataFrame) -> DataFrame:
    """Records of lines (line); blank lines, comments, short lines and bad numbers are skipped."""
    parts = lines.where("trim(line) <> '' and not startswith(ltrim(line), '#')").select(_fields(F.col("line")).alias("f")).where(F.size("f") >= 8)
    text = {"type": 0, "uri": 1, "chnl": 2, "word": 5, "subt": 6, "spkr": 7}
    numbers = {"tbeg": 3, "tdur": 4}
    found = parts.select(*[F.col("f")[i].alias(c) for c, i in text.items()], *[F.col("f")[i].try_cast("double").alias(c) for c, i in numbers.items()], F.get("f", F.lit(8)).alias("conf"))
    return found.where("tbeg is not null and tdur is not null").select(*FIELDS)


def parse_refined(lines: DataFrame) -> DataFrame:
    """Only SPEAKER records."""
    return parse_lenient(lines.where("startswith(line, 'SPEAKER')"))


def parse_strict(lines: DataFrame) -> DataFrame:
    """Records of lines, types in upper case; anything malformed ends the query: too few fields, unknown types or subtypes, bad or negative times."""
    parts = lines.where("trim(line) <> '' and not ltrim(line) rlike '^[;#]'").select("line", _fields(F.col("line")).alias("f"))
    say = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("line")))
    kinds = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    checked = F.when(F.size("f") < 9, say("fewer than nine fields"))
    kind = F.upper(F.col("f")[0])
    checked = checked.when(kinds[kind].isNull(), say("unknown type"))
    checked = checked.when(~F.array_contains(kinds[kind], F.lower(F.col("f")[6])), say("unknown subtype"))
    timed = kind != "SPKR-INFO"
    begin, length = clean_time(F.col("f")[3]), clean_time(F.col("f")[4])
    checked = checked.when(timed & (begin.isNull() | length.isNull()), say("not a time")).when(timed & ((begin < 0) | (length < 0)), say("a negative time"))
    good = parts.withColumn("bad", checked.otherwise(F.lit(None).cast("string"))).where("bad is null")
    text = {"uri": 1, "chnl": 2, "word": 5, "subt": 6, "spkr": 7, "conf": 8}
    return good.select(kind.alias("type"), *[F.col("f")[i].alias(c) for c, i in text.items()], begin.alias("tbeg"), length.alias("tdur")).select(*FIELDS)


def with_gender(records: DataFrame) -> DataFrame:
    """records with the gender that SPKR-INFO gives the speaker, else unknown; a speaker described twice ends the query."""
    info = records.where("type = 'SPKR-INFO'").groupBy("uri", "chnl", "spkr").agg(F.count(F.lit(1)).alias("n"), F.min("subt").alias("gender"))
    info = info.withColumn("gender", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("described twice: "), F.col("spkr")))).otherwise(F.col("gender"))).drop("n")
    return records.where("type <> 'SPKR-INFO'").join(info, ["uri", "chnl", "spkr"], "left").withColumn("gender", F.coalesce("gender", F.lit("unknown")))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(line, path) of all files."""
    return spark.read.text(list(paths)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def read_rttm(spark: SparkSession, *paths: str, mode: str = "lenient") -> DataFrame:
    return {"lenient": parse_lenient, "refined": parse_refined, "strict": parse_strict}[mode](read_lines(spark, *paths))


def speaker_summary(records: DataFrame) -> DataFrame:
    """(uri, spkr, turns, duration)."""
    return records.where("type = 'SPEAKER'").groupBy("uri", "spkr").agg(F.count(F.lit(1)).alias("turns"), F.sum("tdur").alias("duration"))


def parse_uem(lines: DataFrame) -> DataFrame:
    """(uri, chnl, tbeg, tend): evaluated time. The file name loses its folder and extension; an empty or overlapping part ends the query."""
    parts = lines.where("trim(line) <> '' and not ltrim(line) rlike '^[;#]'").select("line", _fields(F.col("line")).alias("f"))
    number = lambda i: F.regexp_replace(F.col("f")[i], r"[^0-9.]", "").try_cast("double")
    found = parts.select("line", stem(F.col("f")[0]).alias("uri"), F.col("f")[1].alias("chnl"), number(2).alias("tbeg"), number(3).alias("tend"))
    order = Window.partitionBy("uri", "chnl").orderBy("tbeg", "tend")
    before = F.lag("tend").over(order)
    wrong = F.when(F.coalesce(F.col("tend") <= F.col("tbeg"), F.lit(True)), "an empty part: ").when(before > F.col("tbeg"), "parts overlap: ")
    checked = found.withColumn("wrong", wrong).withColumn("ok", F.when(F.col("wrong").isNotNull(), F.raise_error(F.concat("wrong", "line"))).otherwise(F.lit(True).cast("string")))
    return checked.where("ok is not null").select("uri", "chnl", "tbeg", "tend")


def parse_glm(lines: DataFrame) -> DataFrame:
    """(word, to) of lines `word => to`; comments and other lines are left out."""
    pattern = r"^\s*([^;\s][^=]*?)\s*=>\s*(.*?)\s*$"
    return lines.where(F.rlike("line", F.lit(pattern))).select(F.lower(F.regexp_extract("line", pattern, 1)).alias("word"), F.regexp_extract("line", pattern, 2).alias("to"))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """lines (line) as text; append adds files and never rewrites any, overwrite replaces all at once."""
    lines.select("line").write.mode(mode).text(path)
