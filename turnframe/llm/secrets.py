"""Secret scans: three kinds of named patterns, and strings of high entropy.

Patterns: a regex cuts a text into the pieces between its matches and the matches themselves; summed lengths give each
match's place in code points. Entropy: a candidate is a maximal run of one character class; a window slides over it, the
counts of its characters are updated by the one that enters and the one that leaves, and with them the Shannon entropy.
The windows above the class's bound give a span, unless an allow-list pattern matches the candidate or the span lies
inside one that a named pattern found.

Rows: a null text is empty and has no spans. Repeated rows each get their result; extra columns are ignored; an empty
table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, group that counts, its least length), in the order in which equal starts are listed.
KINDS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a shorter run of the class fails at its every start, so the least length can stand in the pattern
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: class: (candidate pattern, alphabet, window, least entropy in bits, what a candidate must hold).
CLASSES = {
    "entropy_hex": (r"\b[0-9A-F]{24,}\b", "0123456789ABCDEF", 24, 3.0, (r"[0-9]", r"[A-F]")),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.8, (r"[0-9]", r"[A-Z]", r"[a-z]")),
}
#: Well-known strings that look random and are no secrets: UUIDs, version strings, repeated fillers, paths of words.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(.)\1+$",
    r"(?i)example|placeholder|changeme|xxxxxxxx",
    r"^([A-Za-z]+[/_-])+[A-Za-z]*[0-9]*$",
)
SPAN = "array<struct<start:int,kind:int,end:int,name:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at, match>>: the matches of pattern in text, left to right, with their places in code points. Pattern must not match the empty string."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,match:string>>").alias("all"))
    walked = F.aggregate(
        pairs,
        start,
        lambda a, p: F.struct(
            (a["pos"] + F.length(p["gap"]) + F.length(p["match"])).alias("pos"),
            F.concat(a["all"], F.array(F.struct((a["pos"] + F.length(p["gap"])).alias("at"), p["match"].alias("match")))).alias("all"),
        ),
        lambda a: a["all"],
    )
    return F.when(F.rlike(text, F.lit(pattern)), walked).otherwise(F.array().cast("array<struct<at:int,match:string>>"))


def _gain(c: Column) -> Column:
    """c log2 c, of a count."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_stretch(candidate: Column, alphabet: str, window: int, least: float) -> Column:
    """struct<first, last>: starts of the first and the last window whose entropy is at least `least`; first is -1 if none is.

    The state holds the count of each character of the alphabet in the window and the sum of c log2 c over them.
    """
    place = lambda i: F.instr(F.lit(alphabet), F.substring(candidate, i, F.lit(1))) - 1
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(a, i):
        enters, leaves = place(i), F.when(i > window, place(i - window)).otherwise(F.lit(-1))
        c_in = F.element_at(a["counts"], enters + 1)
        c_out = F.when(leaves >= 0, F.element_at(a["counts"], F.greatest(leaves, F.lit(0)) + 1)).otherwise(F.lit(0))
        moved = F.when(leaves == enters, F.lit(0.0)).otherwise(_gain(c_in + 1) - _gain(c_in) + F.when(leaves >= 0, _gain(c_out - 1) - _gain(c_out)).otherwise(F.lit(0.0)))
        total = a["sum"] + moved
        counts = F.transform(a["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
        hot = (i >= window) & (F.lit(log2(window)) - total / window >= least - 1e-9)
        at = i - window
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hot & (a["first"] < 0), at).otherwise(a["first"]).alias("first"), F.when(hot, at).otherwise(a["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _entropy_spans(text: Column, name: str, number: int) -> Column:
    pattern, alphabet, window, least, holds = CLASSES[name]

    def wanted(m):
        keep = F.lit(True)
        for h in holds:
            keep = keep & F.rlike(m["match"], F.lit(h))
        for allowed in ALLOWED:
            keep = keep & ~F.rlike(m["match"], F.lit(allowed))
        return keep

    kept = F.filter(matches(text, pattern), wanted)
    seen = F.transform(kept, lambda m: F.struct(m["at"].alias("at"), hot_stretch(m["match"], alphabet, window, least).alias("hot")))
    spans = F.transform(F.filter(seen, lambda s: s["hot"]["first"] >= 0), lambda s: F.struct((s["at"] + s["hot"]["first"]).alias("start"), F.lit(number).alias("kind"), (s["at"] + s["hot"]["last"] + window).alias("end"), F.lit(name).alias("name")))
    return spans.cast(SPAN)


def _base_spans(text: Column, name: str, number: int) -> Column:
    pattern, group, least = KINDS[name]
    found = matches(text, pattern)
    if group:
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["match"], pattern, group)) >= least)
    return F.transform(found, lambda m: F.struct(m["at"].alias("start"), F.lit(number).alias("kind"), (m["at"] + F.length(m["match"])).alias("end"), F.lit(name).alias("name"))).cast(SPAN)


def secret_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end, name) in order of start and kind; spans holds the base ones and those of high entropy."""
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = [*KINDS, *CLASSES]
    base = F.array_sort(F.concat(*[_base_spans(F.col("text"), k, names.index(k)) for k in KINDS]))
    more = F.concat(*[_entropy_spans(F.col("text"), k, names.index(k)) for k in CLASSES])
    found = text.select("doc_id", base.alias("base"), more.alias("more"))
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", F.filter("more", lambda s: ~inside(s)))).alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(documents: DataFrame) -> DataFrame:
    found = secret_spans(documents)
    count = lambda k: F.size(F.filter("base", lambda s: s["name"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
