"""Findings about processed documents: messages per document and their roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as X

SEVERITY = {"valid": 0, "warning": 1, "error": 2}


def duplicate_blocks(blocks: DataFrame, doc: str = "doc_id", no: str = "block_no") -> DataFrame:
    """doc, no, first_no: blocks whose text, trimmed and in small letters, came before in the document."""
    key = F.md5(F.lower(X.trimmed(F.col("text"))))
    w = Window.partitionBy(doc, "__h").orderBy(no)
    rows = blocks.filter(F.col("text").isNotNull()).select(doc, no, key.alias("__h"))
    return rows.withColumn("first_no", F.first(no).over(w)).filter(F.col("first_no") < F.col(no)).select(doc, no, "first_no")


def section_histogram(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    return blocks.groupBy(doc, "section").agg(F.count("*").alias("blocks"))


def document_facts(docs: DataFrame, lines: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row of counts per document, the base of all messages."""
    ln = lines.groupBy(doc).agg(F.countDistinct("line_no").alias("lines"), (F.max("line_no") - F.countDistinct("line_no")).alias("gaps"))
    bl = blocks.groupBy(doc).agg(
        F.count("*").alias("blocks"), (F.sum(F.char_length(F.coalesce("text", F.lit("")))) + F.count("*") - 1).alias("chars"), F.count_if(F.col("section") == "unknown").alias("unknown"),
        F.coalesce(F.bool_or(F.col("section").isin("experience", "skills")), F.lit(False)).alias("has_key_section"), F.array_sort(F.collect_set("section")).alias("sections"),
    )
    du = duplicate_blocks(blocks, doc).groupBy(doc).agg(F.count("*").alias("duplicates"))
    out = docs.select(doc).distinct().join(ln, doc, "left").join(bl, doc, "left").join(du, doc, "left")
    return out.na.fill(0, ["lines", "gaps", "blocks", "chars", "unknown", "duplicates"])


def messages(facts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, code, status, count of every finding."""

    def m(code: str, status, when, count):
        return F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(status) if isinstance(status, str) else status).alias("status"), count.cast("long").alias("count")))

    share = F.col("unknown") / F.greatest(F.col("blocks"), F.lit(1))
    found = F.array(
        m("MIN_LINES", "warning", F.col("lines") < 3, F.col("lines")),
        m("MIN_BLOCKS", "error", F.col("blocks") < 1, F.col("blocks")),
        m("LOW_CONTENT", "warning", F.col("chars") < 50, F.col("chars")),
        m("UNKNOWN_SECTIONS", F.when(share > 0.3, "warning").otherwise("valid"), F.col("unknown") > 0, F.col("unknown")),
        m("DUPLICATE_BLOCK", "warning", F.col("duplicates") > 0, F.col("duplicates")),
        m("LINE_GAPS", "warning", F.col("gaps") > 0, F.col("gaps")),
        m("MISSING_KEY_SECTIONS", "warning", (F.col("blocks") > 0) & ~F.col("has_key_section"), F.lit(1)),
    )
    return facts.select(doc, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(doc, "x.*")


def roll_up(facts: DataFrame, msgs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, status (the worst), flags (codes of findings that are not valid, sorted)."""
    severity = F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)
    per = msgs.groupBy(doc).agg(F.max(severity).alias("s"), F.array_sort(F.collect_set(F.when(F.col("status") != "valid", F.col("code")))).alias("flags"))
    out = facts.select(doc).join(per, doc, "left")
    status = F.when(F.col("s") == 2, "error").when(F.col("s") == 1, "warning").otherwise("valid")
    return out.select(doc, status.alias("status"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))
