"""Sentences packed into blocks, blocks into sections: the folds over a document's sentences in order.

These carry state from row to row (a running count with resets, sections that earlier inferences set), so they run once
per document in one grouped function; everything that needs no state is computed by the JVM before it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom import dims
from matchloom.config import Config
from matchloom.functions import text as X
from matchloom.operators import sections
from matchloom.session import checkpointed

#: Where an oversized sentence is cut, in this order.
_DELIMITERS = (re.compile(r";\s*"), re.compile(r",\s+(?=(?:and|or|but|which|where|while)\b)"), re.compile(r",\s+"))


def oversized(text: str, max_words: int) -> list[str]:
    """The parts of a sentence with too many words: see functions.text.oversized_parts."""
    for d in _DELIMITERS:
        parts = d.split(text)
        if len(parts) > 1:
            return [p.strip() for p in parts if p.strip()]
    words = text.split()
    return [" ".join(words[i : i + max_words]) for i in range(0, len(words), max_words)]


class _Open:
    """The block that is being filled."""

    __slots__ = ("count", "items", "lead")

    def __init__(self, lead: bool):
        self.items: list[tuple[str, tuple[int, ...]]] = []
        self.count = 0
        self.lead = lead


def pack(rows: list[tuple[str, list[int]]], breaks: set[int], max_words: int, max_gap: int) -> list[tuple[list[tuple[str, tuple[int, ...]]], bool]]:
    """(sentences, topic boundary) of each block: at most max_words words unless one part alone has more; a heading's
    line or a gap between lines begins a new one."""
    done: list[tuple[list[tuple[str, tuple[int, ...]]], bool]] = []
    now = _Open(True)

    def close(lead: bool) -> _Open:
        done.append((now.items, now.lead))
        return _Open(lead)

    for text, lines in rows:
        n, nos = len(text.split()), tuple(lines)
        if now.items:
            topic = not breaks.isdisjoint(nos) or bool(nos and now.items[-1][1]) and min(nos) - max(now.items[-1][1]) > max_gap
            if topic or now.count + n > max_words:
                now = close(topic)
        for part in [text] if n <= max_words else oversized(text, max_words):
            m = len(part.split())
            if n > max_words and now.items and now.count + m > max_words:
                now = close(False)
            now.items.append((part, nos))
            now.count += m
    if now.items:
        done.append((now.items, now.lead))
    return done


def merge_short(blocks: list[tuple[list[tuple[str, tuple[int, ...]]], bool]], breaks: set[int], max_words: int, min_chars: int) -> list[tuple[list[tuple[str, tuple[int, ...]]], bool]]:
    """One pass from the left: a block of few characters takes in the next, unless that opens a section or the sum is
    too long. What was merged is not merged again."""
    out, todo = [], iter(range(len(blocks)))
    for i in todo:
        items, lead = blocks[i]
        after = blocks[i + 1][0] if i + 1 < len(blocks) else None
        if after is not None and len(" ".join(t for t, _ in items)) < min_chars:
            opens = any(not breaks.isdisjoint(nos) for _, nos in after)
            words = sum(len(t.split()) for t, _ in (*items, *after))
            if not opens and words <= max_words:
                items = items + after
                next(todo, None)
        out.append((items, lead))
    return out


def packed(rows: list[tuple[str, list[int]]], breaks: set[int], cfg: Config) -> list[tuple[list[tuple[str, tuple[int, ...]]], bool]]:
    """pack, then merge_short where it is set."""
    s = cfg.segmentation
    done = pack(rows, breaks, s.max_words, s.max_gap)
    return merge_short(done, breaks, s.max_words, s.min_block_chars) if s.merge_short else done


def infer(given: list[str], hits: list[list[int]], positions: list[float], min_confidence: float) -> list[tuple[str, str | None, float | None, bool, bool, str | None, list[str] | None]]:
    """(section, inferred, confidence, review, reclassified, reasoning, evidence) of each block in order. An inference
    sees the sections that earlier ones have set, and those of the next three blocks as they came in. Reasoning and the
    list of evidence are those of an inference."""
    now = list(given)
    out: list[tuple[str, str | None, float | None, bool, bool, str | None, list[str] | None]] = []
    ranges = {s: (lo, hi) for s, lo, hi in dims.POSITION_PRIORS}
    for i, section in enumerate(given):
        kinds = [dims.SIGNALS[h][0] for h in hits[i]]
        if section == "other":
            strong = next((k for k in kinds if k in ("experience", "education", "skills")), None)
            if strong:
                now[i] = strong
                out.append((strong, None, None, False, True, None, None))
                continue
        if section not in ("unknown", "other"):
            out.append((section, None, None, False, False, None, None))
            continue
        votes: dict[str, float] = {}
        why: list[str] = []
        back = next(((now[i - k], 0.4 - (k - 1) * 0.1, f"Previous block ({k} back) is in section '{now[i - k]}'") for k in range(1, min(3, i) + 1) if now[i - k] != "unknown"), None)
        ahead = next(((now[i + k], max(0.3 - (k - 1) * 0.1, 0.1), f"Next block ({k} forward) is in section '{now[i + k]}'") for k in range(1, min(3, len(now) - i - 1) + 1) if now[i + k] != "unknown"), None)
        if near := back or ahead:
            votes[near[0]] = near[1]
            why.append(near[2])
        for h, k in zip(hits[i], kinds, strict=True):
            votes[k] = votes.get(k, 0) + 0.3
            why.append(dims.SIGNALS[h][1])
        for s, (lo, hi) in ranges.items():
            if s in votes and lo <= positions[i] <= hi:
                votes[s] += 0.1
                why.append(f"Document position ({positions[i]:.2f}) is within the range of {s} ({lo:.2f} to {hi:.2f})")
        best = max(votes, key=lambda s: votes[s], default="unknown")  # the first of equals
        confidence = min(votes.get(best, 0.0), 1.0)
        if confidence >= min_confidence:
            now[i] = best
        text = "\n".join([f"Inferred as {best} (confidence: {confidence:.2f})", *(f"  - {w}" for w in why)]) if votes else "No signals matched for section inference"
        out.append((now[i], best, confidence, confidence < min_confidence, False, text, why))
    return out


_PACKED = "block_no int, text string, source_lines array<int>, topic_boundary boolean, sentences array<struct<text:string,source_lines:array<int>>>"
_INFERRED = "array<struct<section:string,inferred_section:string,confidence:double,review_flag:boolean,reclassified_from_other:boolean,reasoning:string,evidence:array<string>>>"


def pack_blocks(sents: DataFrame, headings: DataFrame, cfg: Config, doc: str = "doc_id") -> DataFrame:
    """doc, block_no, text, source_lines, topic_boundary, sentences. One shuffle by document; a document's sentences are
    one group, which a document's size bounds."""
    kind = sents.schema[doc].dataType.simpleString()
    ordered = sents.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("para_no", "part_no", "text", "source_lines"))).alias("rows"))
    breaks = headings.groupBy(doc).agg(F.collect_set("line_no").alias("breaks"))
    both = ordered.join(breaks, doc, "left")

    def run(batches):
        for b in batches:
            out = []
            for d, rows, brk in zip(b[doc], b["rows"], b["breaks"], strict=True):
                cut = set() if brk is None else set(map(int, brk))
                done = packed([(r["text"], list(map(int, r["source_lines"]))) for r in rows], cut, cfg)
                for i, (items, lead) in enumerate(done):
                    out.append((d, i, " ".join(t for t, _ in items), sorted({n for _, nos in items for n in nos}), lead, [{"text": t, "source_lines": list(nos)} for t, nos in items]))
            yield pd.DataFrame(out, columns=[doc, "block_no", "text", "source_lines", "topic_boundary", "sentences"])

    return both.mapInPandas(run, f"{doc} {kind}, {_PACKED}")


def whole_blocks(paras: DataFrame, cfg: Config, doc: str = "doc_id") -> DataFrame:
    """doc, sections, texts: each document as one row with the texts of its blocks in order and their sections, as
    infer_sections gives them. paras as segment.paragraphs gives them with heads (the heading lines as structs of line_no,
    heading) and total_lines. If paras stand by document, nothing is shuffled, and nothing is written."""
    kind = paras.schema[doc].dataType.simpleString()
    pieces = F.when(F.col("standalone"), F.array(F.col("text"))).otherwise(X.sentences(F.col("text")))
    each = F.struct("para_no", pieces.alias("pieces"), "source_lines", "heads")
    docs = paras.groupBy(doc).agg(F.array_sort(F.collect_list(each)).alias("p"), F.max("total_lines").alias("total"))
    heads = F.array_sort(F.flatten("p.heads"))
    docs = docs.select(doc, "total", F.col("p.pieces").alias("pieces"), F.col("p.source_lines").alias("lines"), heads["line_no"].alias("at"), heads["heading"].alias("opened"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for total, pieces, lines, at, opened in zip(*(b.column(c).to_pylist() for c in ("total", "pieces", "lines", "at", "opened")), strict=True):
                done = packed([(t, nos) for ts, nos in zip(pieces, lines, strict=True) for t in ts], set(at), cfg)
                nos = [sorted({n for _, own in items for n in own}) for items, _ in done]
                first = [bisect_right(at, n[0]) if n else 0 for n in nos]
                out[0].append([" ".join(t for t, _ in items) for items, _ in done])
                out[1].append([opened[i - 1] if i else "unknown" for i in first])
                out[2].append([min(sum(n) / len(n) / total, 1.0) if n and total > 0 else 0.0 for n in nos])
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(doc), *map(pa.array, out, kinds)], [doc, "texts", "given", "positions"])

    rows = docs.mapInArrow(run, f"{doc} {kind}, texts array<string>, given array<string>, positions array<double>")
    hits = F.zip_with("given", "texts", lambda s, t: F.when(s.isin("unknown", "other"), sections.signal_hits(t)).otherwise(F.array().cast("array<int>")))

    def fold(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for given, found, places in batches:
            yield pd.Series([[x[0] for x in infer(list(g), [list(h) for h in hs], list(p), cfg.detection.min_confidence)] for g, hs, p in zip(given, found, places, strict=True)], dtype=object)

    return rows.select(doc, F.pandas_udf(fold, "array<string>")(F.col("given"), hits, F.col("positions")).alias("sections"), "texts")


def infer_sections(blocks: DataFrame, cfg: Config, doc: str = "doc_id") -> DataFrame:
    """blocks (with section and position) with sections inferred where unknown, and what was inferred. A document's
    blocks are gathered in one shuffle; only sections, signal numbers and positions leave the JVM."""
    # written once, since the fold reads it and what it gives is joined back to it
    rows = blocks.withColumn("hits", sections.signal_hits(F.col("text")))
    rows = checkpointed(rows.withColumn("secondary_section", sections.secondary_section(F.col("section"), F.col("hits"))))
    # only what the fold reads is gathered; the rest is joined back by document and number
    docs = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("block_no", "section", "hits", "position"))).alias("rows"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("section", "inferred_section", "confidence", "review_flag", "reclassified_from_other", "reasoning", "evidence")
        for given, found, places in batches:
            out = [infer(list(g), [list(h) for h in hs], list(p), cfg.detection.min_confidence) for g, hs, p in zip(given, found, places, strict=True)]
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in r] for r in out], dtype=object)

    inferred = F.pandas_udf(run, _INFERRED)(F.col("rows.section"), F.col("rows.hits"), F.col("rows.position"))
    each = docs.withColumn("inferred", inferred).select(doc, F.explode(F.arrays_zip(F.col("rows.block_no").alias("block_no"), "inferred")).alias("x"))
    each = each.select(doc, "x.block_no", "x.inferred.*")
    return rows.drop("section", "hits").join(each, [doc, "block_no"])
