"""Oversized texts cut into pieces at natural boundaries, by agglomerative merging.

The text is first cut into atomic segments at every natural boundary (and inside any stretch that is longer than a
piece may be). Adjacent segments lie in a heap by the strength of the boundary between them, weakest first; a pair is
merged while its size plus the overlap it will carry fits. So paragraphs and sentences fall apart last.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters other than white space at which a text may be cut; they stay with what is before them.
MARKS = "。！？；、，।"
#: A natural boundary: marks and white space in any mixture, or white space after whatever is before it.
_BOUNDARY = regex.compile(rf"[\s{MARKS}]+")
#: Strength of the boundary after a segment, by how the segment ends: the first that holds.
_STRENGTHS = (
    (5.0, regex.compile(r"\n\s*\n\s*$")),
    (4.0, regex.compile(r"[.!?。！？।؟…][\"'”’»)\]】」』]*\s*$|\n\s*$")),
    (3.0, regex.compile(r"[;；:：]\s*$")),
    (2.0, regex.compile(r"[,，、،|]\s*$")),
)
#: A list item begins here.
_ITEM = regex.compile(r"(?:[•▪◦‣➤·*–-]|\(?\d{1,3}[.)]|[a-z][.)])\s")

PIECE = T.ArrayType(
    T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("overlap", T.IntegerType()), T.StructField("hard", T.BooleanType())])
)
_FULL = T.ArrayType(T.StructType([*PIECE.elementType.fields, T.StructField("text", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType()))]))


def segments(text: str, limit: int) -> list[tuple[int, int, float]]:
    """(start, end, strength of the boundary after it), end exclusive; no segment is longer than limit."""
    out, at = [], 0
    cuts = [m.span() for m in _BOUNDARY.finditer(text)]
    if not cuts or cuts[-1][1] != len(text):
        cuts.append((len(text), len(text)))
    for stop, end in cuts:
        while stop - at > limit:  # inside a stretch that is longer than a piece may be
            out.append((at, at + limit, 0.0))
            at += limit
        while end - at > limit:  # inside a long gap
            out.append((at, at + limit, 1.0))
            at += limit
        if end > at:
            tail = text[at:end]
            strength = next((s for s, p in _STRENGTHS if p.search(tail)), 1.0)
            out.append((at, end, max(strength, 4.5) if _ITEM.match(text, end) else strength))
        at = end
    return out


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, end, overlap, hard), 0-based, end exclusive, in order, without gaps.

    Each piece but the first begins with up to `overlap` characters of the one before, from a natural boundary where
    there is one in that range; `overlap` of the row says how many. hard: the piece's end is not a natural boundary.
    """
    if len(text) <= limit:
        return [(0, len(text), 0, False)] if text else []
    room = limit - overlap
    segs = segments(text, limit)
    n = len(segs)
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    start, end = [s[0] for s in segs], [s[1] for s in segs]
    strength, alive = [s[2] for s in segs], [True] * n
    heap = [(strength[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b] and nxt[a] == b and end[b] - start[a] == size):
            continue
        if size > (limit if start[a] == 0 else room):
            continue  # neither part shrinks, so it never fits
        end[a], strength[a], alive[b], nxt[a] = end[b], strength[b], False, nxt[b]
        if nxt[a] >= 0:
            prev[nxt[a]] = a
            heapq.heappush(heap, (strength[a], end[nxt[a]] - start[a], a, nxt[a]))
        if prev[a] >= 0:
            p = prev[a]
            heapq.heappush(heap, (strength[p], end[a] - start[p], p, a))
    out: list[tuple[int, int, int, bool]] = []
    for i in range(n):
        if not alive[i]:
            continue
        lead = 0
        if out and overlap:
            low = max(start[i] - min(overlap, limit - (end[i] - start[i])), out[-1][0])
            m = _BOUNDARY.search(text, low, start[i])
            # from a boundary if the overlap holds one before its end, else its full length
            at = m.end() if m and m.end() < start[i] else low
            lead = start[i] - at
        out.append((start[i] - lead, end[i], lead, strength[i] == 0.0))
    return out


def _cutter(limit: int, overlap: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start_char": a + 1, "end_char": b, "overlap": o, "hard": h} for a, b, o, h in cut(t, limit, overlap)] for t in texts])

    return F.pandas_udf(run, PIECE)


def _full_cutter(limit: int, overlap: int):
    """Pieces with their texts, so the whole text is carried no further, and with the lines they cover."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, nos, lengths in batches:
            yield pd.Series([[piece | {"text": t[piece["start_char"] - 1 : piece["end_char"]]} for piece in covered(t, cut(t, limit, overlap), n, z)] for t, n, z in zip(texts, nos, lengths, strict=True)])

    return F.pandas_udf(run, _FULL)


def covered(text: str, pieces: list[tuple[int, int, int, bool]], nos, lengths) -> list[dict]:
    """Pieces with the numbers of the lines each touches, null where the lines' lengths don't make up the text: joined
    with nothing or one character between them, in the order of nos."""
    nos, lengths = ([] if x is None else [int(y) for y in x] for x in (nos, lengths))
    gap = next((g for g in (0, 1) if nos and sum(lengths) + g * (len(nos) - 1) == len(text)), None)
    firsts, lasts, at = [], [], 1
    for z in lengths if gap is not None else []:
        firsts.append(at)
        lasts.append(at + z - 1)
        at += z + gap
    return [
        {"start_char": a + 1, "end_char": b, "overlap": o, "hard": h, "lines": None if gap is None else nos[bisect_left(lasts, a + 1) : bisect_right(firsts, b)]}
        for a, b, o, h in pieces
    ]


def oversized(df: DataFrame, item: str, text: str, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The items whose text is longer than limit code points, each item once: __item, __text and the kept columns.

    The length filter runs before the copies are removed, so short texts never enter a shuffle.
    """
    long = df.select(F.col(item).alias("__item"), F.col(text).alias("__text"), *(F.col(c).alias(f"__k_{c}") for c in keep))
    return long.filter(F.col("__item").isNotNull() & (F.char_length("__text") > limit)).dropDuplicates(["__item"])


def split_oversized(df: DataFrame, item: str, text: str, limit: int = 600, overlap: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every text longer than limit code points as pieces of at most limit, in order.

    Gives item, piece_no (from 0), start_char and end_char (1-based, inclusive), overlap (characters shared with the
    piece before), hard_end (the piece ends inside a stretch without a natural boundary), text, and the kept columns.
    Without the overlaps, the pieces make up the text exactly. Null and short texts give no rows, a repeated item counts
    once, an empty table gives an empty result. A text of any length is cut whole.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half of limit")
    long = oversized(df, item, text, limit, keep)
    none = F.lit(None).cast("array<int>")
    return _pieces(long, limit, overlap, none, none).select(F.col("__item").alias(item), *PIECE_COLUMNS, *(F.col(f"__k_{c}").alias(c) for c in keep))


#: The columns that every piece has.
PIECE_COLUMNS = ("piece_no", "start_char", "end_char", "overlap", "hard_end", "text")


def _pieces(long: DataFrame, limit: int, overlap: int, nos: Column, lengths: Column) -> DataFrame:
    kept = [c for c in long.columns if c != "__text"]
    # from here on no row holds the whole text
    p = long.select(*kept, F.posexplode(_full_cutter(limit, overlap)("__text", nos, lengths)).alias("piece_no", "__p"))
    return p.select(*kept, "piece_no", "__p.start_char", "__p.end_char", "__p.overlap", F.col("__p.hard").alias("hard_end"), "__p.text", F.col("__p.lines").alias("__lines"))


def split_with_lines(df: DataFrame, item: str, text: str, doc: str, lines: str, texts: DataFrame, line_doc: str, line_no: str, line_text: str, limit: int = 600, overlap: int = 60) -> DataFrame:
    """split_oversized, with the source lines that each piece covers: item, PIECE_COLUMNS, source_lines, lines_exact.

    `lines` is an array of the line numbers of `doc` that make up the text, in any order, repeated or null; `texts` has
    the lines. Where a text isn't its trimmed lines joined with nothing or one blank (lines lost, or nulls), every piece
    has all of the item's line numbers and lines_exact is false. A line given several times counts with its longest text.
    """
    long = oversized(df, item, text, limit, (doc, lines))
    every = F.array_sort(F.array_distinct(F.filter("__k_" + lines, lambda x: x.isNotNull())))
    wanted = long.select("__item", F.col("__k_" + doc).alias("__d"), F.explode(every.cast("array<int>")).alias("__n"))
    known = texts.select(F.col(line_doc).alias("__d"), F.col(line_no).cast("int").alias("__n"), F.char_length(F.trim(line_text)).alias("__z"))
    sizes = wanted.join(known.filter("__z is not null"), ["__d", "__n"]).groupBy("__item", "__n").agg(F.max("__z").alias("__z"))
    sizes = sizes.groupBy("__item").agg(F.array_sort(F.collect_list(F.struct("__n", "__z"))).alias("__ls"))
    out = _pieces(long.join(sizes, "__item", "left"), limit, overlap, F.col("__ls.__n"), F.col("__ls.__z"))
    return out.select(F.col("__item").alias(item), *PIECE_COLUMNS, F.coalesce("__lines", every.cast("array<int>")).alias("source_lines"), F.col("__lines").isNotNull().alias("lines_exact"))


def cut_kinds(df: DataFrame, item: str, text: str, limit: int = 600, overlap: int = 60) -> DataFrame:
    """item, cut_kind of every text longer than limit: 'hard' where a piece of split_oversized ends inside a stretch of
    more than limit characters without a natural boundary, else 'soft'."""
    pieces = _cutter(limit, overlap)("__text")
    return oversized(df, item, text, limit).select(F.col("__item").alias(item), F.when(F.exists(pieces, lambda p: p["hard"]), "hard").otherwise("soft").alias("cut_kind"))
