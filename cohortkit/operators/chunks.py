"""Overlapping chunks of texts, cut at the best separator that fits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators from the best to the worst; where none fits, a text is cut anywhere.
SEPARATORS = ("\n\n", "\n", " ")
# Characters of a section. Sections bound the arrays that one row holds, and very long texts spread over tasks.
SECTION = 65_536


def pieces(text: Column, size: int, separators: Sequence[str]) -> Column:
    """The text in pieces of at most ``size`` characters.

    A piece takes as much as fits and ends with the last best separator in it, or with the text.
    """
    # From the left each alternative is tried at full length first, so a worse one is used only without a better one.
    ends = [f".{{1,{size}}}\\z", *[f".{{0,{size - len(s)}}}{re.escape(s)}" for s in separators if len(s) < size], f".{{1,{size}}}"]
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join(ends)), F.lit(0))


def placed(parts: Column, start: Column, before: Column, overlap: int) -> Column:
    """Structs (start, before, text): each part with its offset and the end of what precedes it, carried as state."""
    empty = F.array().cast("array<struct<start:int,before:string,text:string>>")
    return F.aggregate(
        parts,
        F.struct(start.alias("at"), before.alias("tail"), empty.alias("done")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.right(F.concat(s["tail"], p), F.lit(overlap)).alias("tail"),
            F.array_append(s["done"], F.struct(s["at"].alias("start"), s["tail"].alias("before"), p.alias("text"))).alias("done"),
        ),
        lambda s: s["done"],
    )


def chunk_texts(
    docs: DataFrame, size: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", separators: Sequence[str] = SEPARATORS, section: int = SECTION
) -> DataFrame:
    """``id_col``, start, lead, n_chars, text: the chunks of every text.

    A text is cut into sections, and these into pieces of at most ``size - overlap`` characters, both at the best
    separator that fits (see ``pieces``). A chunk is a piece behind its lead: the ``overlap`` characters before
    it, from the first place behind a separator that leaves any, or all of them if there is none or the text
    begins there. ``start`` is the chunk's offset, ``lead`` the length of the lead; chunks without their leads
    put together give the text back. Offsets count characters. A null or empty text has no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if min(map(len, separators), default=1) < 1 or section < size:
        raise ValueError("separators must not be empty, and a section must hold a chunk")
    sections = placed(pieces(F.col(text_col), section, separators), F.lit(0), F.lit(""), overlap)
    spread = docs.select(F.col(id_col), F.explode(sections).alias("_s"))
    parts = placed(pieces(F.col("_s.text"), size - overlap, separators), F.col("_s.start"), F.col("_s.before"), overlap)
    cut = spread.select(id_col, F.explode(parts).alias("_p")).select(id_col, "_p.*")
    lead = F.col("before")
    if separators:
        behind = F.regexp_extract("before", f"(?s)^.*?(?:{'|'.join(map(re.escape, separators))})(.+)$", 1)
        lead = F.when((F.col("start") == F.length("before")) | (behind == ""), lead).otherwise(behind)
    return cut.withColumn("_lead", lead).select(
        id_col,
        (F.col("start") - F.length("_lead")).alias("start"),
        F.length("_lead").alias("lead"),
        (F.length("_lead") + F.length("text")).alias("n_chars"),
        F.concat("_lead", "text").alias("text"),
    )
