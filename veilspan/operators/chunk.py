"""Cutting long texts: newline-aware disjoint chunks, and overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import spans as S

TARGET = 2048
WINDOW, OVERLAP = 4096, 256


def newline_chunks(text: Column, target: int = TARGET) -> Column:
    """array<struct<offset, chunk>>: cut after the last newline of each window of ``target``, if it lies past
    the window's start, else after ``target`` signs. The newline may be the sign after the window, so a
    chunk may have one sign more. Chunks are disjoint and cover the text; an empty text has none.

    A chunk is what one pattern takes from where the last one ended: the rest, or up to the last newline
    that is near enough, or ``target`` signs; so a text is cut in one pass."""
    cut = rf"(?s).{{1,{target}}}\z|.{{1,{target}}}\n|.{{{target}}}"
    chunks = F.regexp_extract_all(text, F.lit(cut), F.lit(0))

    def placed(chunks):
        lengths = F.transform(chunks, lambda c: F.length(c))
        return F.zip_with(S.running_totals(lengths), chunks, lambda end, c: F.struct((end - F.length(c)).alias("offset"), c.alias("chunk")))

    return S.let(chunks, placed)


def overlapping_windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """array<struct<offset, chunk>> of windows that begin every ``size - overlap`` signs; a text of ``size``
    signs or fewer is one window, and the last window may be nothing but overlap."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    return F.transform(starts, lambda at: F.struct(at.alias("offset"), F.substring(text, at + 1, F.lit(size)).alias("chunk")))
