"""Headings, the sections they open, and what in a block's text points to a section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import dims
from matchloom.functions import text as X


def detect_headings(lines: DataFrame, doc: str = "doc_id", max_length: int = 80) -> DataFrame:
    """doc, line_no, section, heading_text, confidence, method of each heading line.

    Known phrases come from a broadcast join with the 191 aliases, with and without a colon; short lines in capitals or
    with a colon at the end are headings of no known section. Lines of the form key: value are none.
    """
    t = X.trimmed(F.col("text"))
    rows = lines.filter(~X.is_blank(F.col("text"))).select(doc, "line_no", t.alias("t")).filter(F.char_length("t") <= max_length)
    out = _heading_columns(rows.filter(_may_head(F.col("t")))).filter("method is not null")
    return out.select(doc, "line_no", F.coalesce("section", F.lit("other")).alias("section"), F.col("t").alias("heading_text"), "confidence", "method")


def with_headings(content: DataFrame, max_length: int = 80) -> DataFrame:
    """Lines that aren't blank with heading: the section that a heading line opens, as detect_headings has it, else null."""
    t = X.trimmed(F.col("text"))
    out = _heading_columns(content.withColumn("t", F.when((F.char_length(t) <= max_length) & _may_head(t), t)))
    return out.select(*content.columns, F.when(F.col("method").isNotNull(), F.coalesce("section", F.lit("other"))).alias("heading"))


def _may_head(t: Column) -> Column:
    return ~(t.contains(":") & ~t.endswith(":"))


def _heading_columns(rows: DataFrame) -> DataFrame:
    """rows with t, a trimmed line, with section, method, confidence: null where it is no heading."""
    key = X.heading_key(F.col("t"))
    colon = key.endswith(":")
    rows = rows.withColumn("alias", X.trimmed(F.regexp_replace(key, ":$", ""))).withColumn("colon", colon)
    known = F.broadcast(dims.aliases(rows.sparkSession))
    n = X.word_count(F.col("t"))
    size = F.char_length("t")
    caps = X.is_caps(F.col("t")) & n.between(2, 5) & (size <= 50)
    ends = F.col("t").endswith(":") & (n <= 5) & (size <= 50)
    hit = F.col("section").isNotNull()
    method = F.when(hit & ~F.col("colon"), "alias_match").when(hit, "alias_colon_match").when(caps, "caps_pattern").when(ends, "colon_pattern")
    confidence = F.when(hit & ~F.col("colon"), 0.95).when(hit, 0.90).when(caps, 0.60).when(ends, 0.55)
    return rows.join(known, "alias", "left").withColumn("method", method).withColumn("confidence", confidence)


def assign_sections(rows: DataFrame, headings: DataFrame, doc: str = "doc_id", at: str = "first_line", key: tuple[str, ...] = ("block_no",)) -> DataFrame:
    """rows with the section of the nearest heading at or before `at`, else unknown: an as-of join as one window over
    the union of both sides, so one shuffle by document and no range join."""
    marks = headings.select(doc, F.col("line_no").alias("__at"), F.lit(0).alias("__kind"), F.col("section").alias("__section"))
    body = rows.withColumn("__at", F.col(at)).withColumn("__kind", F.lit(1))
    w = Window.partitionBy(doc).orderBy("__at", "__kind", *key).rowsBetween(Window.unboundedPreceding, 0)
    both = body.unionByName(marks, allowMissingColumns=True)
    out = both.withColumn("section", F.coalesce(F.last("__section", ignorenulls=True).over(w), F.lit("unknown")))
    return out.filter("__kind = 1").drop("__at", "__kind", "__section")


def signal_hits(c: Column) -> Column:
    """array of the numbers (from 0) of the signals that the text shows, ascending."""
    hits = [F.when(c.rlike(("" if i == 7 else "(?i)") + p), F.lit(i)) for i, (_, _, p) in enumerate(dims.SIGNALS)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _section_of(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s, _, _ in dims.SIGNALS]), i + 1)


def secondary_section(section: Column, hits: Column) -> Column:
    """The first signal's section that differs from a known section."""
    other = F.filter(F.transform(hits, _section_of), lambda s: s != section)
    return F.when(~section.isin("unknown", "other"), F.get(other, F.lit(0)))


def reclassified(section: Column, hits: Column) -> Column:
    """For section other: experience, education or skills, if such a signal is there (the first); else null."""
    strong = F.filter(F.transform(hits, _section_of), lambda s: s.isin("experience", "education", "skills"))
    return F.when(section == "other", F.get(strong, F.lit(0)))


def position(source_lines: Column, total_lines: Column) -> Column:
    """The mean line over all lines of the document, at most 1; 0 without lines."""
    mean = F.aggregate(source_lines, F.lit(0.0), lambda a, x: a + x) / F.size(source_lines)
    return F.when((F.size(source_lines) > 0) & (total_lines > 0), F.least(mean / total_lines, F.lit(1.0))).otherwise(0.0)


def prior(section: Column, pos: Column) -> Column:
    """Is the position within the section's expected range?"""
    return reduce(lambda a, b: a | b, [(section == s) & pos.between(lo, hi) for s, lo, hi in dims.POSITION_PRIORS])
