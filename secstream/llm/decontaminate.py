"""Benchmark decontamination by pigeonhole edit matching.

A test item is found in a document if some substring of the document is within the item's error budget, one
edit for every EDIT_EVERY characters. The item is split into budget + 1 pieces; a match with so few edits
leaves one piece untouched, so every match shows up as an exact piece hit at a known offset. An Aho-Corasick
automaton over the pieces of all items finds the hits in one pass over the text, and Myers' bit-parallel
distance verifies the stretch of text around them.

Both sides are compared in lower case with white space runs as one space. The benchmark is the stated query
set: it is taken in blocks of ITEMS_AT_ONCE, each shipped to the tasks; documents are neither shuffled nor
joined, so a passage that many documents share costs each of them its own scan and nothing more.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import table

#: One edit is allowed for so many characters of an item; its pieces are not much shorter than that.
EDIT_EVERY = 12
ITEMS_AT_ONCE = 2_000
MATCHES = "array<struct<item_id:long,start:int,end:int,distance:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(size: int) -> int:
    return max(0, size // EDIT_EVERY - 1)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length that make up the item."""
    n = budget(len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern to any substring of ``text`` and the first place such a one ends."""
    full, high = (1 << size) - 1, 1 << size - 1
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = ((eq & plus) + plus ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, at
    return best, end


@dataclass
class Probe:
    """The items of one block, ready to be looked for."""

    items: list[tuple[int | None, str]]

    def __post_init__(self) -> None:
        self.finder = None

    def __getstate__(self):
        return {"items": self.items, "finder": None}

    def _build(self) -> None:
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item):
                places.setdefault(piece, []).append((k, offset))
        self.masks = [bit_masks(item) for _, item in self.items]
        self.finder = ahocorasick.Automaton()
        for piece, at in places.items():
            self.finder.add_word(piece, (len(piece), at))
        self.finder.make_automaton()

    def matches(self, text: str | None) -> list[dict]:
        """The best match of every item that occurs, by item; offsets are into the normalised text."""
        if not self.items:
            return []
        if self.finder is None:
            self._build()
        text = normal(text)
        where: dict[int, set[int]] = {}
        for last, (size, at) in self.finder.iter(text):
            for k, offset in at:
                where.setdefault(k, set()).add(last + 1 - size - offset)
        found = []
        for k in sorted(where):
            item_id, item = self.items[k]
            m, most = len(item), budget(len(item))
            best = (most + 1, 0, 0)
            stretches: list[list[int]] = []
            for start in sorted(where[k]):
                a, b = max(0, start - most), start + m + most
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = b
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                distance, end = myers(self.masks[k], m, text[a:b])
                if distance < best[0]:
                    # the start: the mirrored item in the mirrored text
                    back = text[max(a, a + end - m - distance) : a + end][::-1]
                    _, length = myers(bit_masks(item[::-1]), m, back)
                    best = (distance, a + end - length, a + end)
            if best[0] <= most:
                found.append({"item_id": item_id, "start": best[1], "end": best[2], "distance": best[0]})
        return found


def probes(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> list[Broadcast]:
    """The benchmark in shipped blocks. Items without text are left out: they would be found everywhere."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length(F.trim("text")) > 0).distinct()
    blocks = -(-rows.count() // at_once)
    out = []
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        items = [(r.item_id, normal(r.text)) for r in part]
        out.append(spark.sparkContext.broadcast(Probe(sorted((x for x in items if x[1]), key=lambda x: (x[0] is None, x[0], x[1])))))
    return out


def matches(text: Column, block: Broadcast) -> Column:
    """The matches of one block's items in a text."""

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(block.value.matches)

    return F.pandas_udf(find, MATCHES)(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """doc_id, item_id, start, end, distance: a row for each document and item that it holds, the best match.

    Null and empty texts hold nothing; a null id is kept; repeated rows give their rows again; other columns
    are ignored. An empty benchmark or empty documents give an empty result.
    """
    doc = docs.select("doc_id", "text")
    out = doc.select("doc_id", F.explode(F.lit(None).cast(MATCHES)).alias("_m"))
    for block in probes(benchmark, at_once):
        out = out.union(doc.select("doc_id", F.explode(matches(F.col("text"), block)).alias("_m")))
    return out.select("doc_id", "_m.item_id", "_m.start", "_m.end", "_m.distance")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that hold no test item, all their columns unchanged."""
    for block in probes(table(spark, sf_dir, "benchmark")):
        docs = docs.filter(F.size(matches(F.col("text"), block)) == 0)
    return docs


def op7_benchmark_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
