"""Evidence added up to component scores, final scores and ranks, all in conditional aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import dims
from matchloom.config import Thresholds, Weights
from matchloom.functions import text as X
from matchloom.operators.evidence import best_per_block, missing
from matchloom.session import bounded_broadcast

NAMES = (*dims.COMPONENTS, "content_score")


def credit(score: Column, t: Thresholds = Thresholds()) -> Column:
    """What a requirement's best score counts for the coverage."""
    return F.when(score >= t.strong, 1.0).when(score >= t.moderate, 0.70).when(score >= t.floor, 0.35).otherwise(0.0)


def credit_points(t: Thresholds = Thresholds()) -> Callable[[np.ndarray], np.ndarray]:
    """credit over an array of scores in ten-thousandths, in hundredths."""
    return lambda points: np.select([points / 10000 >= x for x in (t.strong, t.moderate, t.floor)], [100, 70, 35], 0)


def credits(score: Column, t: Thresholds = Thresholds()) -> Column:
    """The sum of credit, in whole hundredths: the same in whatever order rows come."""
    return F.sum(F.round(credit(score, t) * 100).cast("long")) / 100


def mean(score: Column) -> Column:
    """The mean of scores as they are written in decimals: the same in whatever order rows come."""
    return F.avg(score.cast("decimal(24,20)")).cast("double")


def component_flags(blocks: DataFrame) -> DataFrame:
    """blocks with components: the scores that each counts for. Where nothing lies outside the main sections, the content
    score takes all blocks but contact."""
    w = Window.partitionBy("jd_id")
    rows = blocks.withColumn("__other", F.max((~F.col("section").isin(*dims.CONTENT_EXCLUDES)).cast("int")).over(w))
    flags = [F.when(F.col("section").isin(*s), F.lit(c)) for c, s in dims.COMPONENTS.items()]
    content = F.when(F.when(F.col("__other") == 1, ~F.col("section").isin(*dims.CONTENT_EXCLUDES)).otherwise(F.col("section") != "contact"), F.lit("content_score"))
    return rows.withColumn("components", F.filter(F.array(*flags, content), lambda x: x.isNotNull())).drop("__other")


def component_blocks(blocks: DataFrame) -> DataFrame:
    """jd_id, jd_block, component: a row for each of component_flags."""
    return component_flags(blocks).select("jd_id", "jd_block", F.explode("components").alias("component"))


def components(evidence: DataFrame | None, blocks: DataFrame, pairs: DataFrame, years: DataFrame | None = None, t: Thresholds = Thresholds(), best: DataFrame | None = None) -> DataFrame:
    """jd_id, resume_id, component, raw, relevant, matched, evidence_count, explanation: a row for each pair and component,
    0 where nothing is relevant.

    Blocks and evidence are reduced to one row per block first; both sides then need one aggregate each. years
    (jd_id, resume_id, required, candidate) lowers the experience score of candidates below what is required. best:
    evidence.best_per_block where it is known, instead of the evidence.
    """
    members = component_blocks(blocks)
    relevant = members.groupBy("jd_id", "component").agg(F.count("*").alias("relevant"))
    best = (best_per_block(evidence) if best is None else best).join(members, ["jd_id", "jd_block"])
    got = best.groupBy("jd_id", "resume_id", "component").agg(F.count("*").alias("matched"), F.sum("pieces").alias("evidence_count"), mean(F.col("best")).alias("mean"), credits(F.col("best"), t).alias("credit"))
    names = F.explode(F.array(*[F.lit(n) for n in NAMES])).alias("component")
    every = pairs.select("jd_id", "resume_id", names).join(relevant, ["jd_id", "component"], "left").join(got, ["jd_id", "resume_id", "component"], "left")
    if years is not None:
        every = every.join(years, ["jd_id", "resume_id"], "left")
    relevant, matched, pieces = (F.coalesce(c, F.lit(0)).cast("long") for c in ("relevant", "matched", "evidence_count"))
    raw, why = rated(F.col("component"), F.col("mean"), F.col("credit"), relevant, matched, *((F.col("required"), F.col("candidate")) if years is not None else ()))
    return every.select("jd_id", "resume_id", "component", raw.alias("raw"), relevant.alias("relevant"), matched.alias("matched"), pieces.alias("evidence_count"), why.alias("explanation"))


def rated(component: Column, mean: Column, credit: Column, relevant: Column, matched: Column, required: Column | None = None, candidate: Column | None = None) -> tuple[Column, Column]:
    """A component's raw score, 0 to 100, and why it is so."""
    share = F.when(component == "content_score", 0.5).otherwise(0.6)
    quality, coverage = F.coalesce(mean, F.lit(0.0)), F.coalesce(F.when(relevant > 0, credit / relevant), F.lit(0.0))
    raw = (quality * share + coverage * (1 - share)) * 100
    if required is not None:
        short = (component == "work_experience") & (required > 0) & (candidate < required)
        raw = F.when(short, raw * F.least(F.lit(1.0), F.greatest(F.lit(0.40), candidate / required))).otherwise(raw)
    raw = F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))
    what = _what_of(component)
    why = F.when(relevant == 0, F.concat(F.lit("No "), what, F.lit(" found in JD"))).otherwise(
        F.format_string("Quality: %.3f, Coverage: %.1f%%, Matched %d/%d %s", quality, coverage * 100, matched, relevant, what)
    )
    return raw, why


def pair_facts(evidence: DataFrame, blocks: DataFrame, met: float = 0.40, t: Thresholds = Thresholds()) -> DataFrame:
    """One row for each pair of the evidence, all numbers: jd_id, resume_id, for each component a struct (matched,
    evidence_count, mean, credit), matched_blocks, strong, moderate, weak, met. Texts come in by asked_of, once no pair
    moves any more."""
    flags = component_flags(blocks).select("jd_id", "jd_block", "components", X.is_mandatory(F.col("text")).alias("__must"))
    real = F.col("strength") != "none"
    kinds = ("strong", "moderate", "weak")
    best = evidence.groupBy("jd_id", "resume_id", "jd_block").agg(F.max(F.when(real, F.col("score"))).alias("best"), F.count_if(real).alias("pieces"), *[F.count_if(F.col("strength") == s).alias(s) for s in kinds])
    rows = best.join(flags, ["jd_id", "jd_block"], "left")

    def facts(n: str) -> Column:
        on = (F.col("pieces") > 0) & F.array_contains("components", n)
        only = lambda c: F.when(on, c)
        return F.struct(F.count_if(on).alias("matched"), F.sum(only(F.col("pieces"))).alias("evidence_count"), mean(only(F.col("best"))).alias("mean"), credits(only(F.col("best")), t).alias("credit")).alias(n)

    return rows.groupBy("jd_id", "resume_id").agg(
        *map(facts, NAMES), F.collect_set(F.when(F.col("pieces") > 0, F.col("jd_block"))).alias("matched_blocks"), *[F.sum(s).cast("int").alias(s) for s in kinds], F.count_if(F.col("__must") & (F.col("best") >= met)).cast("int").alias("met")
    )


def with_pair_facts(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """rows with the components' structs and matched_blocks of pair_facts, made of each pair's own list e (structs of b, the
    query block, and s, the negative score, sorted) and flags, a map of its query blocks' components."""
    alone = F.filter("e", lambda x, i: (i == 0) | (F.get("e", i - 1)["b"] != x["b"]))  # a block's best stands first
    rows = rows.withColumn("__best", F.transform(alone, lambda x: F.struct(x["b"].alias("b"), (-x["s"]).alias("s"), F.try_element_at("flags", x["b"]).alias("c"))))
    summed = lambda c, kind, of: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: (a + of(x)).cast(kind))

    def facts(n: str) -> Column:
        own = F.filter("__best", lambda x: F.array_contains(x["c"], n))
        pieces = F.size(F.filter("e", lambda x: F.array_contains(F.try_element_at("flags", x["b"]), n)))
        total = summed(own, "decimal(34,20)", lambda x: x["s"].cast("decimal(24,20)"))
        avg = F.when(F.size(own) > 0, F.try_divide(total, F.size(own).cast("decimal(20,0)")).cast("decimal(28,24)").cast("double"))
        return F.struct(F.size(own).cast("long").alias("matched"), pieces.cast("long").alias("evidence_count"), avg.alias("mean"), (summed(own, "long", lambda x: F.round(credit(x["s"], t) * 100).cast("long")) / 100).alias("credit")).alias(n)

    return rows.select("*", *map(facts, NAMES), F.transform("__best", lambda x: x["b"]).alias("matched_blocks")).drop("__best", "flags")


def asked_of(blocks: DataFrame) -> DataFrame:
    """One row for each query document: jd_id, mandatory (how many blocks), relevant (a struct of each component's number
    of blocks), wanted (a struct of the blocks whose lack each component names, in order, texts cut to 100 characters)."""
    rows = component_flags(blocks)
    entry = F.struct("block_no", "jd_block", F.left("text", F.lit(100)).alias("text"))
    relevant = F.struct(*[F.count_if(F.array_contains("components", n)).alias(n) for n in NAMES])
    wanted = F.struct(*[F.array_sort(F.collect_list(F.when(F.col("section").isin(*s), entry))).alias(c) for c, s in dims.COMPONENTS.items()])
    return rows.groupBy("jd_id").agg(F.count_if(X.is_mandatory(F.col("text"))).cast("int").alias("mandatory"), relevant.alias("relevant"), wanted.alias("wanted"))


def rated_facts(n: str, limit: int = 5) -> tuple[Column, Column, Column, Column]:
    """raw, evidence_count, explanation, missing_evidence of a component from a row of pair_facts joined with asked_of and
    with required, candidate."""
    own, relevant = F.col(n), F.coalesce(F.col("relevant")[n], F.lit(0)).cast("long")
    raw, why = rated(F.lit(n), own["mean"], own["credit"], relevant, F.coalesce(own["matched"], F.lit(0)), F.col("required"), F.col("candidate"))
    empty = F.array().cast("array<string>")
    lacking = empty
    if n in dims.COMPONENTS:
        lacks = F.filter(F.col("wanted")[n], lambda x: ~F.array_contains("matched_blocks", x["jd_block"]))
        texts = F.coalesce(F.transform(F.slice(lacks, 1, limit), lambda x: x["text"]), empty)
        lacking = F.when(relevant == 0, F.array(F.lit(f"No {_WHAT[n]} in JD"))).otherwise(texts)
    return raw, F.coalesce(own["evidence_count"], F.lit(0)).cast("long"), why, lacking


_WHAT = {"skill": "skill requirements", "work_experience": "experience requirements", "education": "education requirements", "content_score": "content blocks"}


def with_missing(comps: DataFrame, evidence: DataFrame, blocks: DataFrame, pairs: DataFrame, limit: int = 5) -> DataFrame:
    """comps with missing_evidence: the first texts without evidence of each component with sections of its own, or that
    the query document has none; empty for the content score."""
    lists = [missing(evidence, blocks, pairs, s, limit).withColumn("component", F.lit(c)) for c, s in dims.COMPONENTS.items()]
    out = comps.join(reduce(DataFrame.unionByName, lists), ["jd_id", "resume_id", "component"], "left")
    nothing = (F.col("relevant") == 0) & (F.col("component") != "content_score")
    empty = F.array().cast("array<string>")
    return out.withColumn("missing_evidence", F.when(nothing, F.array(F.concat(F.lit("No "), _what_of(F.col("component")), F.lit(" in JD")))).otherwise(F.coalesce("missing", empty))).drop("missing")


def _what_of(component: Column) -> Column:
    return reduce(lambda c, kv: c.when(component == kv[0], kv[1]), _WHAT.items(), F.when(F.lit(False), "")).otherwise("")


def weighted(raws: list[Column], weights: Weights = Weights()) -> Column:
    """The final score of the unrounded components in the order of NAMES, 0 to 100."""
    w = weights.as_dict()
    total = reduce(lambda a, b: a + b, [raw * w[n] for n, raw in zip(NAMES, raws, strict=True)])
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0))


def final_scores(comps: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """jd_id, resume_id, one column per component, final: the weighted sum of the unrounded components.

    Every pair must have all four components, each between 0 and 100; a query over others fails with a message that
    names what is missing or out of range. Weights must sum to 1 (checked when they are built).
    """
    cols = [F.max(F.when(F.col("component") == n, F.col("raw"))).alias(n) for n in NAMES]
    wide = comps.groupBy("jd_id", "resume_id").agg(*cols)
    lacking = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in NAMES]))
    outside = F.array_compact(F.array(*[F.when((F.col(n) < 0) | (F.col(n) > 100) | F.isnan(n), F.lit(n)) for n in NAMES]))
    fails = F.concat(F.lit("components of "), F.col("jd_id"), F.lit(" and "), F.col("resume_id"), F.lit(": missing "), F.array_join(lacking, ", "), F.lit("; outside 0 to 100 "), F.array_join(outside, ", "))
    checked = F.when((F.size(lacking) > 0) | (F.size(outside) > 0), F.raise_error(fails).cast("double")).otherwise(weighted([F.col(n) for n in NAMES], weights))
    return wide.withColumn("final", checked)


def final_of_sums(sums: DataFrame, of_jd: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """What final_scores gives, from the sums of evidence.pair_sums. of_jd(jd_id,
    relevant, required) has a row for each query document. All components are there and within range as they are made."""
    rows = sums.join(bounded_broadcast(of_jd), "jd_id")

    def raw(n: str) -> Column:
        own = F.col(n)
        mean, credit = F.try_divide(own["total"], own["matched"] * F.lit(10000)), F.when(own["matched"] > 0, own["credit"] / 100)
        return rated(F.lit(n), mean, credit, F.col("relevant")[n], own["matched"], F.col("required"), F.col("years"))[0].alias(n)

    wide = rows.select("jd_id", "resume_id", *map(raw, NAMES))
    return wide.withColumn("final", weighted([F.col(n) for n in NAMES], weights))


def rating(final: Column) -> Column:
    return F.when(final >= 75, "strong").when(final >= 55, "good").when(final >= 35, "partial").otherwise("weak")


def ranked(finals: DataFrame) -> DataFrame:
    """The candidates of each query document in the order of their final score; ties by candidate."""
    w = Window.partitionBy("jd_id").orderBy(F.desc(F.round("final", 10)), "resume_id")
    return finals.withColumn("rank", F.row_number().over(w))


def review_flags(comps: DataFrame, counts: DataFrame) -> DataFrame:
    """jd_id, resume_id, flags: zero components, then how much evidence is missing for which (where comps has
    missing_evidence), then how many mandatory requirements are not met. counts: evidence.mandatory_counts."""
    order = reduce(lambda c, kv: c.when(F.col("component") == kv[1], kv[0]), enumerate(NAMES), F.when(F.lit(False), 0)).otherwise(len(NAMES))
    notes = [F.when(F.col("raw") == 0, F.concat(F.lit("Zero score for "), F.col("component"), F.lit(": "), F.col("explanation")))]
    if "missing_evidence" in comps.columns:
        n = F.size("missing_evidence")
        notes.append(F.when(n > 0, F.format_string("Missing evidence for %s: %d items", "component", n)))
    per = comps.select("jd_id", "resume_id", F.struct(order.alias("o"), F.array_compact(F.array(*notes)).alias("notes")).alias("x"))
    a = per.groupBy("jd_id", "resume_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["notes"])).alias("zero"))
    short = F.col("required") - F.col("met")
    unmet = F.when(short > 0, F.array(F.format_string("Unmet mandatory requirements: %d", short))).otherwise(F.array().cast("array<string>"))
    return a.join(counts, ["jd_id", "resume_id"], "left").select("jd_id", "resume_id", F.concat("zero", F.coalesce(unmet, F.array().cast("array<string>"))).alias("flags"))
