"""SimHash near-duplicates by segment popcounts.

A fingerprint is mapped to a vector of bit counts, one for each two-bit segment. One flipped bit moves one count by one,
so the Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints: a lower bound. The
vector space is cut into a grid: the counts form distance + 2 groups, and any two vectors within the distance agree
exactly in at least two of the groups, so they share the cell of some pair of groups. Fingerprints meet in cells, the
Manhattan bound is tested first and the Hamming distance last.

Rows: a null or wordless text has fingerprint zero and links like any other. Exact copies meet once, as one fingerprint.
Rows with the same doc_id are one node, whatever their texts. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from turnframe.llm.common import labelled, written
from turnframe.llm.components import components

SEGMENTS, BITS = 32, 2
ONES = 0x5555555555555555
#: Cells with more fingerprints than this are joined through one-bit variants instead of pair by pair. Both ways are exact.
CELL = 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit number."""
    counts, step = np.zeros(64, np.int64), 1 << 16  # long texts in slices
    for i in range(0, len(hashes), step):
        part = np.array(hashes[i : i + step], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and white space 9-13 and 32
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [digest(join(s), seed) for s in zip(*(words[i:] for i in range(width)))] if len(words) >= width else [digest(join(words), seed)]
    return majority(hashes)


def _fingerprint(width: int):
    @F.pandas_udf(LongType())
    def fingerprint(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([fingerprint_of(x, width) for x in s], dtype="int64")

    return fingerprint


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, over shingles of width words."""
    return documents.select("doc_id", _fingerprint(width)("text").alias("fp"))


def popcounts(fp: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, packed in a long."""
    next_bit = F.shiftrightunsigned(fp, 1)
    odd, both = fp.bitwiseXOR(next_bit).bitwiseAND(F.lit(ONES)), fp.bitwiseAND(next_bit).bitwiseAND(F.lit(ONES))
    return odd.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed vectors: fields differ by one where the low bit of their xor is set, else by its high bit twice."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(F.lit(ONES))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(ONES))
    return F.bit_count(low) + 2 * F.bit_count(high)


def cell_masks(distance: int) -> list[int]:
    groups = distance + 2
    edges = [SEGMENTS * g // groups for g in range(groups + 1)]
    masks = [sum(3 << (BITS * s) for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    return [a | b for a, b in combinations(masks, 2)]


def links(fps: DataFrame, distance: int = 2, cell: int = CELL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of fps (fp) that connect exactly those linked by chains of pairs within distance bits.

    In cells of at most `cell` fingerprints, all pairs within the distance are edges. The fingerprints of larger cells
    are matched by their one-bit variants: two are within two bits exactly if they share a variant, and a variant has at
    most 65 owners, which become a star. So no group emits all its pairs.
    """
    if distance != 2:
        raise ValueError("variants are laid out for a distance of 2")
    masks = F.array(*[F.lit(_signed(m)) for m in cell_masks(distance)])
    base = fps.select("fp", popcounts(F.col("fp")).alias("pc"))
    cells = base.select("fp", "pc", F.posexplode(masks).alias("grid", "mask")).select("fp", "pc", "grid", F.col("pc").bitwiseAND(F.col("mask")).alias("cell"))
    hot = written(cells.groupBy("grid", "cell").count().where(F.col("count") > cell).select("grid", "cell"), "hot")
    cool = cells.join(hot, ["grid", "cell"], "left_anti")
    a, b = cool.alias("a"), cool.alias("b")
    near = (manhattan(F.col("a.pc"), F.col("b.pc")) <= distance) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    pairs = a.join(b, (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowd = cells.join(hot, ["grid", "cell"], "left_semi").select("fp").distinct()
    flips = F.array(*[F.lit(0)] + [F.lit(_signed(1 << i)) for i in range(64)])
    owners = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    stars = owners.groupBy("variant").agg(F.array_sort(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.col("all")[0].alias("v"), F.explode(F.slice("all", 2, 65)).alias("u")).select("u", "v")
    return pairs.union(stars).distinct()


def near_duplicates(documents: DataFrame, distance: int = 2, cell: int = CELL, width: int = 3, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable over linked fingerprints.

    With a similarity, links are those of shingle sets of that Jaccard similarity or more: linked fingerprints are checked
    for it first, and sets whose fingerprints lie further apart are joined after. The columns are (doc_id, node, component_id).
    """
    if similarity is not None:
        from turnframe.llm.nearsets import alike_documents  # which takes its fingerprints from here

        return alike_documents(documents, width, similarity)
    docs = written(fingerprints(documents, width), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    # rows of one doc_id are one node: a star over their fingerprints
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("last")).where("u <> last")
    same = docs.join(written(several.select("doc_id", "u"), "several"), "doc_id").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    labels = components(links(nodes, distance, cell).union(same)).withColumnRenamed("node", "fp")
    grouped = labels.join(nodes, "fp")
    least = grouped.groupBy("component").agg(F.min("least").alias("first"))
    linked = grouped.join(least, "component").select("fp", "first")
    known = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"), "n"), "known")
    return labelled(docs, known, "fp", "component_id").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, distance: int = 2, width: int = 3, similarity: float | None = None) -> DataFrame:
    """documents without near-duplicates: of each group, the row with the smallest doc_id stays. Rows without a doc_id stay."""
    found = near_duplicates(documents, distance, width=width, similarity=similarity)
    if similarity is not None:
        found = written(found, "alike")
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = documents.join(first, "doc_id", "left_semi")
    if found.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.union(documents.where("doc_id is null"))


def op1_simhash(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
