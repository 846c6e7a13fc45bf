"""Documents to lines, paragraphs and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as X


def index_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, line_no (from 1), text, is_empty: a text's lines, blank ones kept and numbered. keep: columns that stay."""
    lines = docs.filter(F.col(text).isNotNull()).select(F.col(doc), *keep, F.posexplode(F.split(F.col(text), "\r\n|\n|\r", -1)).alias("pos", "text"))
    return lines.select(doc, *keep, (F.col("pos") + 1).alias("line_no"), "text", X.is_blank(F.col("text")).alias("is_empty"))


def cleaned_lines(lines: DataFrame, simple: bool = False) -> DataFrame:
    """Lines cleaned, page marks blanked, and normalised; numbers stay. simple keeps everything in the JVM."""
    out = lines.withColumn("text", (X.cleaned_simple if simple else X.cleaned)(F.col("text")))
    out = out.withColumn("__exact", F.lit(None).cast("string") if simple else X.normalised_exact(F.col("text")))

    def rest(t: Column) -> Column:
        blank = X.is_blank(t) | X.is_artifact(t)
        text = F.when(blank, F.lit("")).otherwise(F.coalesce(F.col("__exact"), X.normalised_plain(t)))
        return F.struct(text.alias("text"), blank.alias("is_empty"))

    out = out.withColumn("__x", X.let(F.col("text"), rest)).drop("text", "is_empty", "__exact")
    return out.select("*", "__x.text", "__x.is_empty").drop("__x")


def content_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("is_empty") & ~X.is_blank(F.col("text")))


def line_gaps(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no") -> DataFrame:
    """doc, last_line, lines, gaps: how many numbers from 1 to the last are missing; repeated lines count once."""
    return lines.groupBy(doc).agg(F.max(line_no).alias("last_line"), F.countDistinct(line_no).alias("lines")).withColumn("gaps", F.col("last_line") - F.col("lines"))


def missing_lines(lines: DataFrame, doc: str = "doc_id", line_no: str = "line_no") -> DataFrame:
    """doc, line_no of every missing number, from the gaps between neighbours: no sequence longer than a gap is built."""
    w = Window.partitionBy(doc).orderBy(line_no)
    ahead = lines.select(doc, line_no).distinct().withColumn("prev", F.coalesce(F.lag(line_no).over(w), F.lit(0)))
    gap = ahead.filter(F.col(line_no) - F.col("prev") > 1)
    return gap.select(doc, F.explode(F.sequence(F.col("prev") + 1, F.col(line_no) - 1)).alias(line_no))


def paragraphs(content: DataFrame, doc: str = "doc_id", also: tuple[Column, ...] = ()) -> DataFrame:
    """doc, para_no, text, source_lines, standalone: list items and headings stand alone, other lines are joined.

    Gaps and islands: a line begins a paragraph if it or the line before stands alone. One shuffle by document, unless the
    lines stand by document. also: further aggregates of a paragraph's lines.
    """
    flagged = content.withColumn("text", X.trimmed(F.col("text")))
    flagged = flagged.withColumn("alone", X.is_list_item(F.col("text")) | X.is_heading_shape(F.col("text")))
    w = Window.partitionBy(doc).orderBy("line_no")
    begins = (F.col("alone") | F.coalesce(F.lag("alone").over(w), F.lit(True))).cast("int")
    numbered = flagged.withColumn("b", begins).withColumn("para_no", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(doc, "para_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"), F.max("alone").alias("standalone"), *also)
    return grouped.withColumn("text", F.concat_ws(" ", F.col("ls.text"))).withColumn("source_lines", F.col("ls.line_no")).select(doc, "para_no", "text", "source_lines", "standalone", *grouped.columns[4:])


def split_sentences(paras: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, para_no, part_no, text, source_lines: a sentence has all lines of its paragraph."""
    pieces = F.when(F.col("standalone"), F.array(F.col("text"))).otherwise(X.sentences(F.col("text")))
    return paras.select(doc, "para_no", F.posexplode(pieces).alias("part_no", "text"), "source_lines")
