"""The queries of the training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import binpack, canonical, knn, mixing, pieces, pii, quality, sentences, topn
from matchloom.session import bounded_broadcast, checkpointed, spread, table

CAPACITY = 4096
PIECE, OVERLAP = 600, 60


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest(table(spark, d, "block_vectors"), "block_id", "embedding", dim=64, k=5)
    return knn.unordered_pairs(near, "block_id", "block_a", "block_b")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "indexed_lines"), headings=table(spark, d, "headings"))


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "indexed_lines"), headings=table(spark, d, "headings"))


def p2_resplit(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the present splitter as whole sentences: rows that hold several are cut, pieces are put together."""
    return sentences.sentences(table(spark, d, "sentences"), line_no="sent_no").select(
        "doc_id", F.col("start_line").alias("first_sent_no"), "start_char", F.col("line_no").alias("last_sent_no"), "end_char", "text"
    )


def _headings(spark: SparkSession, d: str) -> DataFrame:
    """Every heading line once, with the entry it spells."""
    heads = table(spark, d, "headings").select("doc_id", "line_no", "heading_text").dropDuplicates(["doc_id", "line_no"])
    mapped = canonical.map_values(heads, "heading_text", table(spark, d, "canon_headings"), "canon_id", "heading")
    # one row for each distinct spelling
    return heads.join(bounded_broadcast(checkpointed(mapped)), "heading_text", "left")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).select("doc_id", "line_no", F.coalesce("canon_id", F.lit(-1)).cast("int").alias("canon_id"))


def p3_sections(spark: SparkSession, d: str) -> DataFrame:
    """The headings' sections by the list, and how the detector's agree with them."""
    canon = table(spark, d, "canon_headings").select("canon_id", F.col("section_type").alias("section"))
    had = table(spark, d, "headings").groupBy("doc_id", "line_no").agg(F.max(F.lower(F.trim("section_type"))).alias("detected"))
    out = _headings(spark, d).join(F.broadcast(canon), "canon_id", "left").join(had, ["doc_id", "line_no"])
    return out.groupBy("section", "detected").agg(F.count("*").alias("headings"), F.round(F.avg("score"), 4).alias("mean_score"))


def _personal_texts(spark: SparkSession, d: str) -> DataFrame:
    lines = spread(table(spark, d, "indexed_lines").select("doc_id", "line_no", "text"))
    blocks = spread(table(spark, d, "blocks").select("block_id", "text"))
    evidence = spread(table(spark, d, "evidence").select("evidence_id", "resume_text").filter("resume_text is not null"))
    return (
        lines.select(F.lit("indexed_lines").alias("src"), F.concat_ws(":", "doc_id", "line_no").alias("row_key"), "text")
        .unionByName(blocks.select(F.lit("blocks").alias("src"), F.col("block_id").cast("string").alias("row_key"), "text"))
        .unionByName(evidence.select(F.lit("evidence").alias("src"), F.col("evidence_id").cast("string").alias("row_key"), F.col("resume_text").alias("text")))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_spans(_personal_texts(spark, d))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(_personal_texts(spark, d).filter("text is not null"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_n_per_group(table(spark, d, "evidence"), "jd_block_id", "evidence_id", "similarity_score", 10, low=0.0, high=1.0)
    return best.select("jd_block_id", "evidence_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_kinds(table(spark, d, "blocks"), "block_id", "text", PIECE, OVERLAP)


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces with the source lines that each covers; where the lines don't make up the block's text, all of them."""
    return pieces.split_with_lines(table(spark, d, "blocks"), "block_id", "text", "doc_id", "source_lines", table(spark, d, "indexed_lines"), "doc_id", "line_no", "text", PIECE, OVERLAP)


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The pieces without their overlaps make up each text again, none is longer than it may be."""
    cut = pieces.split_oversized(table(spark, d, "blocks"), "block_id", "text", PIECE, OVERLAP)
    own = F.struct("piece_no", F.expr("substring(text, overlap + 1)").alias("t"))
    whole = cut.groupBy("block_id").agg(F.array_sort(F.collect_list(own)).alias("p"), F.max(F.char_length("text")).alias("longest"), F.max("overlap").alias("most"))
    return whole.select("block_id", F.md5(F.array_join("p.t", "")).alias("digest"), ((F.col("longest") <= PIECE) & (F.col("most") <= OVERLAP)).alias("within"))


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", *columns, "text")).select("doc_id", *columns, binpack.token_count("text").alias("tokens"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return binpack.pack(_sized(spark, d), "doc_id", "tokens", CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    bins = p7_containers(spark, d).groupBy("container").agg(F.sum("size").alias("fill"), F.count("*").alias("parts"))
    return bins.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.round(F.sum("fill") / (F.count("*") * CAPACITY), 6).alias("used"))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every text is packed, none is over its capacity, only texts beyond it are cut."""
    parts = checkpointed(p7_containers(spark, d))
    docs = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    bins = parts.groupBy("container").agg(F.sum("size").alias("fill"))
    a = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.ceil(F.col("tokens") / CAPACITY)).alias("needlessly_cut"))
    b = bins.agg(F.count_if(F.col("fill") > CAPACITY).alias("overfull"), (F.sum("fill") >= 0.9 * CAPACITY * F.greatest(F.count("*") - 1, F.lit(0))).alias("well_filled"))
    return a.join(b)  # one row each


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    mixture, _ = mixing.mix(checkpointed(_sized(spark, d, "source")), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))
    return mixture.select("doc_id", "source", F.col("__size").alias("tokens"), F.col("__copy").alias("copy_no"), F.col("__position").alias("position"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(checkpointed(_sized(spark, d, "source")), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))
    return report


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture, for each target source: no document more often than it may be."""
    copies = p8_mixture(spark, d).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("different")).join(F.broadcast(table(spark, d, "mix_targets")), "source")
    seen = copies.groupBy("source").agg(F.count_if((F.col("n") > F.col("max_repeats")) | (F.col("n") != F.col("different"))).alias("too_often"))
    return table(spark, d, "mix_targets").select("source").distinct().join(seen, "source", "left").select("source", F.coalesce("too_often", F.lit(0)).alias("too_often"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", quality.kind_of("text").alias("doc_kind"))
    return kinds.filter(F.col("doc_kind").isin("list", "table", "junk"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_statistics(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_sentences, p2_resplit, p3_found, p3_sections, p4_found, p4_redacted, p5_found, p6_found, p6_pieces, p6_roundtrip, p7_containers, p7_fill, p7_limits, p8_mixture, p8_shares, p8_limits, p9_found, p9_statistics)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": """
            SELECT jd_block_id, evidence_id FROM (
              SELECT jd_block_id, evidence_id, row_number() OVER (PARTITION BY jd_block_id ORDER BY similarity_score DESC, evidence_id) AS r
              FROM (SELECT DISTINCT jd_block_id, evidence_id, similarity_score FROM evidence
                    WHERE jd_block_id IS NOT NULL AND NOT isnan(similarity_score) AND similarity_score BETWEEN 0 AND 1))
            WHERE r <= 10""",
        "p6_found": r"""
            SELECT DISTINCT block_id, CASE WHEN regexp_matches(text, '[^\s\p{Z}。！？；、，।]{601}') THEN 'hard' ELSE 'soft' END AS cut_kind
            FROM blocks WHERE length(text) > 600""",
        "p6_roundtrip": "SELECT DISTINCT block_id, md5(text) AS digest, true AS within FROM blocks WHERE length(text) > 600",
        "p7_limits": "SELECT count(*) AS documents, 0 AS needlessly_cut, 0 AS overfull, true AS well_filled FROM documents WHERE text <> ''",
        "p8_limits": "SELECT DISTINCT source, 0 AS too_often FROM mix_targets",
    }
