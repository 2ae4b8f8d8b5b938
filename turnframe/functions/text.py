"""Text, time and record expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) \[(\w+)\] (.*)$"


def stitch(accumulated: Column, new: Column, most: int = 50) -> Column:
    """new without the longest beginning (up to `most` characters) that accumulated ends with."""
    sizes = F.sequence(F.lit(0), F.least(F.lit(most), F.length(accumulated), F.length(new)))
    best = F.array_max(F.filter(sizes, lambda k: F.endswith(accumulated, F.substring(new, F.lit(1), k))))
    return F.substring(new, best + 1, F.length(new))


def without_prefix(text: Column, prefix: Column) -> Column:
    return F.when((F.length(prefix) > 0) & F.startswith(text, prefix), F.ltrim(F.substring(text, F.length(prefix) + 1, F.length(text)))).otherwise(text)


def tail(text: Column, n: int) -> Column:
    """The last n characters, which stand in for tokens where there is no tokenizer."""
    return F.right(text, F.lit(n)) if n > 0 else F.lit("")


def event_key(message: Column) -> Column:
    """What kind of event a log message tells: its beginning up to a colon within 40 characters, else its first five words; numbers become #, and 60 characters stay."""
    colon = F.instr(message, ":")
    words = F.concat_ws(" ", F.slice(F.split(F.trim(message), r"\s+"), 1, 5))
    head = F.when((colon > 1) & (colon <= 41), F.substring(message, F.lit(1), colon - 1)).otherwise(words)
    return F.left(F.trim(F.regexp_replace(head, r"\d+(\.\d+)?", "#")), F.lit(60))


def tag(message: Column, default: str = "general") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(message, r"^\[([^\]]+)\] ?", 1), F.lit("")), F.lit(default))


def untagged(message: Column) -> Column:
    return F.regexp_replace(message, r"^\[[^\]]+\] ?", "")


def clock(seconds: Column) -> Column:
    """h:mm:ss.mmm."""
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.expr("1") * F.floor(ms / 3_600_000).cast("long"), F.pmod(F.floor(ms / 60_000), F.lit(60)).cast("long"), F.pmod(F.floor(ms / 1000), F.lit(60)).cast("long"), F.pmod(ms, F.lit(1000)).cast("long"))


def speaker_label(spk: Column, final: Column, uncertain: Column) -> Column:
    """a→b for a merged speaker, and ? for one that may yet be."""
    merged = F.when(final.isNotNull() & (final != spk), F.concat(spk.cast("string"), F.lit("→"), final.cast("string"))).otherwise(spk.cast("string"))
    return F.when(uncertain, F.concat(merged, F.lit("?"))).otherwise(merged)


def colour(spk: Column, colours: int = 12) -> Column:
    return F.pmod(spk, F.lit(colours))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def clean_time(field: Column) -> Column:
    """A time field of a record: stars are dropped and <na> is 0."""
    bare = F.regexp_replace(field, r"\*", "")
    return F.when(F.lower(bare) == "<na>", F.lit(0.0)).otherwise(bare.try_cast("double"))


def sample_index(seconds: Column, rate: int, total: Column) -> Column:
    """The sample at a time: rounded half to even and kept within the recording."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.rint(seconds * rate).cast("long"), total))


def sample_slice(start: Column, end: Column, rate: int, total: Column) -> Column:
    """struct<a, b> of sample indices, or null if nothing lies between."""
    a, b = sample_index(start, rate, total), sample_index(end, rate, total)
    return F.when(b > a, F.struct(a.alias("a"), b.alias("b")))


def padded(samples: Column, size: int) -> Column:
    """An array filled with zeros up to size."""
    return F.concat(samples, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(samples), F.lit(0))))


def joined_slices(samples: Column, slices: Column) -> Column:
    """The parts [a, b) of samples that slices name, one after another."""
    return F.flatten(F.transform(slices, lambda x: F.slice(samples, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))))


def powerset_slots(classes: Column, slots: int, most: int) -> Column:
    """array of 0/1 by slot of a class that stands for a set of at most `most` active slots, sets in order of size and then of members."""
    from itertools import combinations

    sets = [c for n in range(most + 1) for c in combinations(range(slots), n)]
    table = F.array(*[F.array(*[F.lit(int(k in c)) for k in range(slots)]) for c in sets])
    return F.get(table, classes)


def frame_centres(n: Column, step: float) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) * step)


#: Seconds between two ticks of a time axis.
TICKS = [0.1, 0.2, 0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 1800, 3600]


def tick_step(span: Column, width: int, least: int = 90) -> Column:
    """The first step whose ticks lie at least so many pixels apart on an axis of span seconds, else two hours."""
    steps = F.array(*[F.lit(float(s)) for s in TICKS])
    return F.coalesce(F.get(F.filter(steps, lambda s: s / span * width >= least), 0), F.lit(7200.0))


def count_or_length(tokens: Column, text: Column) -> Column:
    """The number of tokens or, where no tokenizer has counted them, of characters."""
    return F.coalesce(tokens.cast("long"), F.length(text).cast("long"))
