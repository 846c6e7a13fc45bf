"""Pairs of blocks graded into evidence, and what follows from it for each requirement.

Evidence is a table with jd_id, resume_id, jd_block, resume_block, jd_section, resume_section, score, strength.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import dims
from matchloom.config import Config, Retrieval, Thresholds
from matchloom.functions import text as X
from matchloom.functions import vector as V
from matchloom.operators import retrieve


def grounded(dense: Column, section: Column, overlap: Column) -> Column:
    """Is a similarity more than noise: a common term, or above the section's gate?"""
    gate = reduce(lambda c, kv: c.when(section == kv[0], kv[1]), dims.GATES.items(), F.when(F.lit(False), 0.0)).otherwise(dims.GATE_ELSE)
    return overlap | (dense >= gate)


def calibrated(dense: Column, ok: Column | None = None, r: Retrieval = Retrieval(), t: Thresholds = Thresholds()) -> Column:
    """The share of the span above the noise floor, 0..1; 0 below the floor or where it is noise."""
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dense - r.noise_floor) / r.span))
    return F.when((F.lit(True) if ok is None else ok) & (raw >= t.floor), raw).otherwise(0.0)


def strength(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score >= t.strong, "strong").when(score >= t.moderate, "moderate").when(score >= t.floor, "weak").otherwise("none")


def explanation() -> Column:
    """Why a row of evidence counts as it does, from its strength, score and sections."""
    same = F.when(F.col("jd_section") == F.col("resume_section"), "same section").otherwise("cross-section")
    return F.format_string("Match strength: %s (similarity: %.3f) | JD section: %s | Resume section: %s | %s", "strength", "score", "jd_section", "resume_section", same)


#: The blocks of candidates that may be evidence.
ANSWERING = "section <> 'contact'"


def asking(jd_blocks: DataFrame) -> DataFrame:
    """The query blocks for which evidence is looked for."""
    return jd_blocks.filter(~F.col("section").isin("about", "contact") | X.is_mandatory(F.col("text")) | X.has_requirement_words(F.col("text")))


def pair_sums(jd_blocks: DataFrame, resume_blocks: DataFrame, cfg: Config, dim: int, embed: Callable[[Column], Column], credit: Callable[[np.ndarray], np.ndarray], places: bool = False) -> DataFrame:
    """jd_id, resume_id, years, and for each component a struct (matched, total, credit): retrieve_pairs and grade summed up
    for each pair with evidence, see retrieve.pair_sums. jd_blocks as score.component_flags gives them, resume_blocks with
    years, a document's together."""
    r = cfg.retrieval
    names = (*dims.COMPONENTS, "content_score")
    own = resume_blocks.filter(ANSWERING).withColumnRenamed("years", "mark")
    sums = retrieve.pair_sums(asking(jd_blocks), own, names, embed(F.col("text")), dim, r.top_k, r.similarity_threshold, r.section_boost, dims.GATES, dims.GATE_ELSE, points_of(cfg), credit, places)
    return sums.withColumnRenamed("mark", "years")


def retrieve_pairs(jd_blocks: DataFrame, resume_blocks: DataFrame, cfg: Config, dim: int, embed: Callable[[Column], Column] | None = None, places: bool = False) -> DataFrame:
    """jd_id, jd_block_no, resume_id, resume_block_no, dense, jd_section, resume_section, overlap, rank: for each query block
    the top_k blocks of every candidate, at the threshold or above. Blocks of contact data and of query sections without
    requirements are left out first. rank is a block's place among its candidate's by boosted similarity. Blocks have vec,
    or embed makes it of their texts once they stand by document; places: in the compact form of HashedEmbedder."""
    r = cfg.retrieval
    pick = ["doc_id", "block_no", "section", "text"] + ([] if embed else ["vec"])
    sides = [asking(jd_blocks).select(*pick), resume_blocks.filter(ANSWERING).select(*pick)]
    return retrieve.graded_topk(*sides, "doc_id", "block_no", embed(F.col("text")) if embed else F.col("vec"), dim, r.top_k, r.similarity_threshold, r.section_boost, checked=embed is None, places=places).withColumnRenamed("score", "dense")


def grade(pairs: DataFrame, cfg: Config) -> DataFrame:
    """Retrieved pairs with boost, grounding, calibration, strength: no row meets another."""
    dense = retrieve.boosted(F.col("dense"), F.col("jd_section"), F.col("resume_section"), cfg.retrieval.section_boost)
    exact = calibrated(F.col("boosted"), grounded(F.col("boosted"), F.col("jd_section"), F.col("overlap")), cfg.retrieval, cfg.thresholds)
    out = pairs.withColumn("boosted", dense).withColumn("exact", exact)
    return out.withColumn("strength", strength(F.col("exact"), cfg.thresholds)).withColumn("score", F.round("exact", 4)).drop("exact", "overlap")


def points_of(cfg: Config) -> Callable[[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """grade() over arrays: boosted similarities, query sections' gates and a function that says for some of the rows
    whether their texts have a term in common, to (score in ten-thousandths, has it a strength?)."""
    noise, span, floor = cfg.retrieval.noise_floor, cfg.retrieval.span, cfg.thresholds.floor

    def run(dense: np.ndarray, gates: np.ndarray, overlap: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.minimum(1.0, np.maximum(0.0, (dense - noise) / span))
        ok = raw >= floor
        open_ = np.flatnonzero(ok & (dense < gates))  # only here do terms decide
        ok[open_] = overlap(open_)
        exact = np.where(ok, raw, 0.0)
        low = np.floor(exact * 10000)
        # half up by the decimals in which a number is written, as F.round has it
        return (low + (exact >= (2 * low + 1) / 20000)).astype(np.int64), exact >= floor

    return run


def described(graded: DataFrame, jd_blocks: DataFrame, resume_blocks: DataFrame) -> DataFrame:
    """Graded pairs with both texts and lines, explanation and whether they are uncertain."""
    j = jd_blocks.select(F.col("doc_id").cast("string").alias("jd_id"), F.col("block_no").alias("jd_block_no"), F.col("text").alias("jd_text"), F.col("source_lines").alias("jd_lines"))
    r = resume_blocks.select(F.col("doc_id").cast("string").alias("resume_id"), F.col("block_no").alias("resume_block_no"), F.col("text").alias("resume_text"), F.col("source_lines").alias("resume_lines"))
    both = graded.join(j, ["jd_id", "jd_block_no"]).join(r, ["resume_id", "resume_block_no"])
    return both.withColumn("uncertain", F.col("strength") == "weak").withColumn("explanation", explanation())


def per_pair(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each pair with the rows of its query document. The pairs are the side that is streamed, in sorted shuffles: they
    outnumber the documents, and a broadcast of the pairs would leave the widened rows to the few tasks of `rows`."""
    return pairs.hint("merge").join(rows, "jd_id")


def with_unmatched(evidence: DataFrame, blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row of strength none for every query block of a pair (jd_id, resume_id) that has no evidence: a left outer join."""
    every = per_pair(pairs, blocks.select("jd_id", "jd_block", F.col("section").alias("__section")))
    out = every.join(evidence, ["jd_id", "resume_id", "jd_block"], "left")
    return out.withColumn("jd_section", F.coalesce("jd_section", "__section")).drop("__section").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("strength", F.coalesce("strength", F.lit("none")))


def best_per_block(evidence: DataFrame) -> DataFrame:
    """jd_id, resume_id, jd_block, jd_section, best, pieces: the greatest score of each query block, and how many it has."""
    return evidence.filter("strength <> 'none'").groupBy("jd_id", "resume_id", "jd_block", "jd_section").agg(F.max("score").alias("best"), F.count("*").alias("pieces"))


def mandatory(evidence: DataFrame, blocks: DataFrame, pairs: DataFrame, met: float = 0.40, texts: DataFrame | None = None, late: bool = False) -> DataFrame:
    """jd_id, resume_id, jd_block, requirement_text, best_score, best_block, best_match_text, is_met, explanation for every
    mandatory block of each pair; texts of up to 200 characters. texts(resume_id, resume_block, text) gives the matched
    texts, without it they are null. late: requirement_text is null, for report.reports to fill in."""
    must = blocks.filter(X.is_mandatory(F.col("text"))).select("jd_id", "jd_block", F.left("text", F.lit(200)).alias("requirement_text"))
    every = per_pair(pairs, must.withColumn("requirement_text", F.lit(None).cast("string")) if late else must)
    best = evidence.filter("strength <> 'none'").groupBy("jd_id", "resume_id", "jd_block").agg(F.max("score").alias("best_score"), F.min_by("resume_block", F.struct(-F.col("score"), "resume_block")).alias("best_block"))
    # only blocks that are mandatory fetch their matched texts
    best = best.join(must.select("jd_id", "jd_block"), ["jd_id", "jd_block"], "left_semi")
    if texts is None:
        best = best.withColumn("best_match_text", F.lit(None).cast("string"))
    else:
        best = best.join(texts.select("resume_id", F.col("resume_block").alias("best_block"), F.left("text", F.lit(200)).alias("best_match_text")), ["resume_id", "best_block"], "left")
    out = every.join(best, ["jd_id", "resume_id", "jd_block"], "left").withColumn("best_score", F.coalesce("best_score", F.lit(0.0)))
    is_met = F.col("best_score") >= met
    why = F.format_string("%s: best match score %.3f (threshold: %.2f)", F.when(is_met, "Met").otherwise("NOT met"), "best_score", F.lit(met))
    return out.withColumn("is_met", is_met).withColumn("explanation", F.when(F.col("best_block").isNull(), "No matching evidence found in resume").otherwise(why))


def mandatory_counts(evidence: DataFrame, blocks: DataFrame, pairs: DataFrame, met: float = 0.40) -> DataFrame:
    """jd_id, resume_id, required, met: how many mandatory blocks a pair has and how many are met. Counted once for each
    query document and once over the evidence, so no pair is multiplied by its blocks."""
    must = blocks.filter(X.is_mandatory(F.col("text"))).select("jd_id", "jd_block")
    required = must.groupBy("jd_id").agg(F.count("*").alias("required"))
    got = best_per_block(evidence).filter(F.col("best") >= met).join(must, ["jd_id", "jd_block"], "left_semi").groupBy("jd_id", "resume_id").agg(F.count("*").alias("met"))
    out = pairs.join(required, "jd_id", "left").join(got, ["jd_id", "resume_id"], "left")
    return out.select("jd_id", "resume_id", F.coalesce("required", F.lit(0)).alias("required"), F.coalesce("met", F.lit(0)).alias("met"))


def missing(evidence: DataFrame, blocks: DataFrame, pairs: DataFrame, sections: tuple[str, ...], limit: int = 5) -> DataFrame:
    """jd_id, resume_id, missing: the first `limit` query blocks of these sections without evidence, cut to 100
    characters; only pairs that lack any.

    A query document's blocks are one ordered list, a pair's matched blocks one set; what is missing is the list without
    the set, so no pair is multiplied by its blocks. Both are bounded by the document's blocks.
    """
    entry = F.struct("block_no", "jd_block", F.left("text", F.lit(100)).alias("text"))
    wanted = blocks.filter(F.col("section").isin(*sections)).groupBy("jd_id").agg(F.array_sort(F.collect_list(entry)).alias("__wanted"))
    matched = evidence.filter(F.col("jd_section").isin(*sections) & (F.col("strength") != "none")).groupBy("jd_id", "resume_id").agg(F.collect_set("jd_block").alias("__matched"))
    both = pairs.join(matched, ["jd_id", "resume_id"], "left").join(wanted, "jd_id")
    lacks = F.filter("__wanted", lambda x: ~F.coalesce(F.array_contains("__matched", x["jd_block"]), F.lit(False)))
    out = both.select("jd_id", "resume_id", F.transform(F.slice(lacks, 1, limit), lambda x: x["text"]).alias("missing"))
    return out.filter(F.size("missing") > 0)


def requirement_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks that state requirements: of six sections, or mandatory or with requirement words elsewhere; not those
    of two words or less, headings, or introductions. If a document has none, its blocks of more than two words outside
    about and contact; if it has none of these, all. Two window maxima over the document choose the level."""
    key = X.trimmed(F.regexp_replace(F.lower(X.trimmed(F.col("text"))), ":+$", ""))
    known = F.broadcast(dims.aliases(blocks.sparkSession).select(F.col("alias").alias("__alias"), F.lit(True).alias("__known")))
    rows = blocks.withColumn("__key", key).join(known, F.col("__key") == F.col("__alias"), "left")
    long = X.word_count(F.col("text")) > 2
    intro = F.col("__key").rlike("^(?:about us|role overview|company overview|who we are)")
    outside = ~F.col("section").isin("about", "contact")
    core = F.col("section").isin("requirements", "skills", "responsibilities", "education", "experience", "certifications")
    own = long & F.col("__known").isNull() & ~intro & (core | ((X.is_mandatory(F.col("text")) | X.has_requirement_words(F.col("text"))) & outside))
    w = Window.partitionBy("jd_id")
    rows = rows.withColumn("__l", F.when(own, 2).when(outside & long, 1).otherwise(0))
    rows = rows.withColumn("__m", F.max("__l").over(w))
    return rows.filter(F.col("__l") == F.col("__m")).drop("__key", "__alias", "__known", "__l", "__m")


def numbered_requirements(blocks: DataFrame) -> DataFrame:
    """jd_id, jd_block, jd_section, parameter_id, is_mandatory, requirement_text, source_jd_lines of requirement_blocks; the
    parameter_id numbers them in the document's order."""
    w = Window.partitionBy("jd_id").orderBy("block_no", "jd_block")
    req = requirement_blocks(blocks).withColumn("parameter_id", F.format_string("param_%03d", F.row_number().over(w)))
    return req.select("jd_id", "jd_block", F.col("section").alias("jd_section"), "parameter_id", X.is_mandatory(F.col("text")).alias("is_mandatory"), F.col("text").alias("requirement_text"), F.col("source_lines").alias("source_jd_lines"))


def category(section: Column, is_mandatory: Column) -> Column:
    return (
        F.when(is_mandatory, "mandatory").when(section == "skills", "skill").when(section.isin("experience", "responsibilities"), "experience").when(section.isin("education", "certifications"), "education").otherwise("requirement")
    )


def status(sim: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(sim >= t.found, "found").when(sim >= t.partial, "partial").otherwise("not_found")


def best_usable(evidence: DataFrame) -> DataFrame:
    """jd_id, resume_id, jd_block, similarity, best_block, best_strength, best_section: each query block's best evidence
    outside contact data."""
    usable = evidence.filter("strength <> 'none' and resume_section <> 'contact'")
    first = F.min_by(F.struct("resume_block", "strength", "resume_section"), F.struct(-F.col("score"), "resume_block")).alias("b")
    best = usable.groupBy("jd_id", "resume_id", "jd_block").agg(F.max("score").alias("similarity"), first)
    return best.select("jd_id", "resume_id", "jd_block", "similarity", F.col("b.resume_block").alias("best_block"), F.col("b.strength").alias("best_strength"), F.col("b.resume_section").alias("best_section"))


#: Begins the explanation of a requirement without evidence, which its text ends.
NOTHING_FOUND = "No matching evidence found in resume for requirement: "


def comparison(evidence: DataFrame, blocks: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds(), texts: DataFrame | None = None, pinned: DataFrame | None = None, late: bool = False) -> DataFrame:
    """Every requirement of each pair, in the document's order: jd_id, resume_id, jd_block, parameter_id, category,
    is_mandatory, requirement_text, source_jd_lines, similarity, confidence, status, best_block, matched_text,
    matched_lines, match_strength, jd_section, resume_section, explanation.

    texts(resume_id, resume_block, text, source_lines) gives the matched texts. pinned (jd_id, resume_id, jd_block,
    sentence, lines, similarity) is the sentence found within the best block, with its calibrated similarity: the greater
    of both similarities counts, the sentence is the matched text, the strength stays that of the block. A requirement
    that isn't found has no match, strength none and section unknown. blocks may have source_lines. late: requirement_text,
    source_jd_lines and what an explanation would quote of them stay null, for report.reports to fill in.
    """
    rows = blocks if "source_lines" in blocks.columns else blocks.withColumn("source_lines", F.lit(None).cast("array<int>"))
    req = numbered_requirements(rows)
    if late:
        req = req.withColumns({c: F.lit(None).cast(req.schema[c].dataType) for c in ("requirement_text", "source_jd_lines")})
    best = best_usable(evidence)
    none = {"matched_text": "string", "matched_lines": "array<int>"}
    if texts is not None:
        best = best.join(texts.select("resume_id", F.col("resume_block").alias("best_block"), F.col("text").alias("matched_text"), F.col("source_lines").alias("matched_lines")), ["resume_id", "best_block"], "left")
    else:
        best = best.select("*", *(F.lit(None).cast(k).alias(n) for n, k in none.items()))
    best = best.withColumn("why", F.format_string("Match strength: %s (similarity: %.3f)", "best_strength", "similarity"))
    if pinned is not None:
        p = pinned.select("jd_id", "resume_id", "jd_block", "sentence", "lines", F.col("similarity").alias("__s"))
        best = best.join(p, ["jd_id", "resume_id", "jd_block"], "left")
        best = best.withColumn("similarity", F.greatest("similarity", F.coalesce("__s", F.lit(0.0)))).withColumn("matched_lines", F.when(F.col("sentence").isNotNull(), F.col("lines")).otherwise(F.col("matched_lines"))).withColumn("matched_text", F.coalesce("sentence", "matched_text")).drop("sentence", "lines", "__s")
    out = per_pair(pairs, req).join(best, ["jd_id", "resume_id", "jd_block"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    out = out.withColumn("confidence", F.round(F.least(F.col("similarity") * 100, F.lit(100.0)), 1)).withColumn("status", status(F.col("similarity"), t))
    hit = F.col("status") != "not_found"
    described = F.when(F.col("status") == "found", "Found in resume with strong evidence").otherwise("Partially found in resume")
    why = (
        F.when(hit, F.format_string("%s (score: %.1f%%). %s", described, "confidence", "why"))
        .when(F.col("best_block").isNotNull(), F.format_string("Requirement not met in resume (score %.1f%% below threshold).", "confidence"))
        .otherwise(F.concat(F.lit(NOTHING_FOUND), F.left("requirement_text", F.lit(100))))
    )
    return out.select(
        "jd_id", "resume_id", "jd_block", "parameter_id", category(F.col("jd_section"), F.col("is_mandatory")).alias("category"), "is_mandatory", "requirement_text", "source_jd_lines", "similarity", "confidence", "status",
        *(F.when(hit, F.col(c)).alias(c) for c in ("best_block", "matched_text", "matched_lines")), F.when(hit, F.col("best_strength")).otherwise("none").alias("match_strength"), "jd_section",
        F.when(hit, F.col("best_section")).otherwise("unknown").alias("resume_section"), why.alias("explanation"),
    )


def requirement_counts(blocks: DataFrame) -> DataFrame:
    """jd_id, total, mandatory_total: how many requirements comparison() has of each query document."""
    req = requirement_blocks(blocks).select("jd_id", X.is_mandatory(F.col("text")).alias("must"))
    return req.groupBy("jd_id").agg(F.count("*").alias("total"), F.count_if("must").alias("mandatory_total"))


def found_counts(evidence: DataFrame, blocks: DataFrame, t: Thresholds = Thresholds(), pinned: DataFrame | None = None) -> DataFrame:
    """jd_id, resume_id, found, partial, mandatory_found: requirements of comparison() by status, for pairs with usable
    evidence."""
    req = requirement_blocks(blocks).select("jd_id", "jd_block", X.is_mandatory(F.col("text")).alias("must"))
    best = best_usable(evidence)
    if pinned is not None:
        best = best.join(pinned.select("jd_id", "resume_id", "jd_block", F.col("similarity").alias("__s")), ["jd_id", "resume_id", "jd_block"], "left").withColumn("similarity", F.greatest("similarity", F.coalesce("__s", F.lit(0.0))))
    st = status(F.col("similarity"), t)
    return best.join(req, ["jd_id", "jd_block"]).groupBy("jd_id", "resume_id").agg(F.count_if(st == "found").alias("found"), F.count_if(st == "partial").alias("partial"), F.count_if(F.col("must") & (st == "found")).alias("mandatory_found"))


def comparison_counts(evidence: DataFrame, blocks: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds(), pinned: DataFrame | None = None) -> DataFrame:
    """What report.comparison_summary says of comparison(), without its rows: requirements are counted once for each
    query document, found ones once over the evidence, and the rest is not found."""
    out = pairs.join(requirement_counts(blocks), "jd_id").join(found_counts(evidence, blocks, t, pinned), ["jd_id", "resume_id"], "left").na.fill(0, ["found", "partial", "mandatory_found"])
    return out.select("jd_id", "resume_id", "total", "found", "partial", (F.col("total") - F.col("found") - F.col("partial")).alias("not_found"), "mandatory_total", "mandatory_found")


def pinpoint(best: DataFrame, sentences: DataFrame, similarity: Callable[[Column, Column], Column] = V.dot_arrow, form: Column | None = None) -> DataFrame:
    """Of each pair's best block the sentence nearest to the requirement: best(jd_id, resume_id, jd_block, best_block,
    vec) with sentences(resume_id, resume_block, sent_no, text, vec and any other columns). Sentences of two words or
    less and headings come in only where a block has no other; ties, at six digits, go to the earlier sentence. Blocks of one sentence
    give none: they are their own match. similarity is that of two vec; form makes a sentence's vec, where it has none, once
    those of one sentence are left out."""
    w = Window.partitionBy("resume_id", "resume_block")
    several = sentences.withColumn("__n", F.count("*").over(w)).filter("__n > 1").drop("__n")
    several = several if form is None else several.withColumn("vec", form)
    both = best.join(several.withColumnRenamed("vec", "svec").withColumnRenamed("resume_block", "best_block"), ["resume_id", "best_block"])
    known = F.broadcast(dims.aliases(best.sparkSession).select("alias"))
    both = both.withColumn("key", X.trimmed(F.regexp_replace(F.lower(X.trimmed(F.col("text"))), ":+$", ""))).join(known, F.col("key") == F.col("alias"), "left")
    ok = ((X.word_count(F.col("text")) > 2) & F.col("alias").isNull()).cast("int")
    kept = [c for c in sentences.columns if c not in ("resume_id", "resume_block", "vec")]
    rated = both.select("jd_id", "resume_id", "jd_block", *kept, similarity(F.col("vec"), F.col("svec")).alias("similarity"), ok.alias("ok"))
    first = F.struct("ok", F.round("similarity", 6).alias("s"), (-F.col("sent_no")).alias("n"))
    return rated.groupBy("jd_id", "resume_id", "jd_block").agg(F.max_by(F.struct(*kept, "similarity"), first).alias("s")).select("jd_id", "resume_id", "jd_block", "s.*")


def pinned(found: DataFrame, blocks: DataFrame, cfg: Config = Config()) -> DataFrame:
    """pinpoint's sentences as comparison takes them: jd_id, resume_id, jd_block, sentence, lines, similarity, which is
    grounded and calibrated like that of a block."""
    req = blocks.select("jd_id", "jd_block", "section", X.terms(F.col("text")).alias("__terms"))
    ok = grounded(F.col("similarity"), F.col("section"), F.arrays_overlap("__terms", X.terms(F.col("text"))))
    sim = calibrated(F.col("similarity"), ok, cfg.retrieval, cfg.thresholds)
    lines = F.col("source_lines") if "source_lines" in found.columns else F.lit(None).cast("array<int>")
    return found.join(req, ["jd_id", "jd_block"]).select("jd_id", "resume_id", "jd_block", F.col("text").alias("sentence"), lines.alias("lines"), F.round(sim, 4).alias("similarity"))
