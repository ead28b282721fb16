"""Oversized texts cut into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces that can hold a text gives equally
long targets; every cut is snapped to the strongest boundary near its target
(line, then sentence, clause, word, and any character as a last resort); where a
piece would exceed the limit, one piece more is tried. Each piece after the first
begins with about ``overlap`` characters of the one before, moved to a word start.

The work is per row and without any shuffle: a plan of cuts for each text, made in
Arrow batches next to the scan.

Defined results: null and blank texts give no pieces; a text within the limit is
one piece; lengths are code points; without its overlap each piece continues the
one before, so the pieces give the text back exactly; repeated rows give repeated
pieces unless the caller makes them distinct.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna.llm.sentences import units

LIMIT, OVERLAP = 1000, 100
CLAUSE = re.compile(r"[;:,—–、，；：](?=\s)\s+|[、，；：]")
SPACE = re.compile(r"\s+")
NAMES = ("caractere", "palavra", "oracao", "frase", "linha")


class Boundaries:
    """Boundaries of one text: line and sentence starts up front, weaker ones looked up where they are needed."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = units(text, lines=True)
        starts = [a for a, _ in self.spans[1:]]
        self.lines = [a for a in starts if "\n" in text[text.rfind("\n", 0, a) : a] and not text[text.rfind("\n", 0, a) : a].strip()]
        self.sentences = starts

    def around(self, cut: int) -> int:
        """Length of the sentence that a cut falls inside, 0 at a boundary."""
        i = bisect_left(self.spans, (cut,)) - 1
        a, b = self.spans[i] if i >= 0 else (0, 0)
        return b - a if a < cut < b else 0

    def best(self, low: int, high: int, target: int) -> tuple[int, int]:
        """The strongest cut in [low, high], the nearest to the target among equals, and its strength."""
        for strength, places in ((4, self.lines), (3, self.sentences)):
            found = places[bisect_left(places, low) : bisect_right(places, high)]
            if found:
                return min(found, key=lambda x: (abs(x - target), x)), strength
        for strength, what in ((2, CLAUSE), (1, SPACE)):
            found = [m.end() for m in what.finditer(self.text, max(0, low - 1), high) if low <= m.end() <= high]
            if found:
                return min(found, key=lambda x: (abs(x - target), x)), strength
        return min(max(target, low), high), 0


def begin(text: str, cut: int, overlap: int, floor: int) -> int:
    """Where a piece begins so that it repeats about ``overlap`` characters: at a word start if there is one."""
    at = max(floor, cut - overlap)
    if at <= floor or at >= cut:
        return max(at, floor)
    m = SPACE.search(text, at - 1, min(cut, at + overlap // 3))
    return m.end() if m and m.end() < cut else at


def plan(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (begin with overlap, begin of what is new, end, strength of the cut that opens it, length of the sentence that this cut falls inside)."""
    size = len(text)
    if size <= limit:
        return [(0, 0, size, 4, 0)]
    marks = Boundaries(text)
    overlap = min(overlap, limit // 2)
    n = 1 + math.ceil((size - limit) / (limit - overlap))
    while True:
        share = (size + (n - 1) * overlap) / n
        pieces, start, new, strength = [], 0, 0, 4
        for i in range(1, n):
            target = round(share + (i - 1) * (share - overlap))
            # The rest must still fit into the pieces that are left.
            low, high = max(new + 1, size - (n - i) * (limit - overlap)), min(start + limit, size - (n - i))
            if low > high:
                break
            a, b = max(low, target - limit // 4), min(high, target + limit // 4)
            cut, kind = marks.best(a, b, target) if a <= b else (0, 0)
            if not kind:  # nothing near the target: anything natural the limits allow
                cut, kind = marks.best(low, high, target)
            pieces.append((start, new, cut, strength, marks.around(new)))
            start, new, strength = begin(text, cut, overlap, new), cut, kind
        else:
            if size - start <= limit:
                pieces.append((start, new, size, strength, marks.around(new)))
                return pieces
        n += 1


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of ``df[text]``: key, ordem, inicio (with the overlap), novo (without), fim, corte, frase (length of the sentence that the cut is inside, 0 at a boundary) and, if wanted, texto."""
    names = ["key", "ordem", "inicio", "novo", "fim", "corte", "frase", "texto"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"]):
                rows += [(key, i, a, new, b, NAMES[s], inside, text[a:b] if with_text else None) for i, (a, new, b, s, inside) in enumerate(plan(text, limit, overlap))]
            yield pd.DataFrame(rows, columns=names)

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(r"key is not null and text is not null and text rlike '(?U)[^\\s\\x1c-\\x1f]'")
    return rows.mapInPandas(run, "key string, ordem bigint, inicio bigint, novo bigint, fim bigint, corte string, frase bigint, texto string")


def unavoidable(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys of the texts whose plan cuts a sentence that no piece could hold: such a sentence is cut by every plan."""
    # A text within the limit has no cut; the filter only spares its trip to Python.
    return pieces(df.where(F.length(text) > limit), key, text, limit, overlap, with_text=False).where(F.col("frase") > limit).select("key").distinct()
