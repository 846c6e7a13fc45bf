"""Summaries of a pair's evidence and nested reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import dims
from matchloom.config import Thresholds, Weights
from matchloom.functions import text as X
from matchloom.operators.evidence import NOTHING_FOUND, category, numbered_requirements, requirement_counts, status
from matchloom.operators.score import NAMES, component_flags, rated_facts, weighted, with_pair_facts


def strongest(evidence: DataFrame, n: int = 5) -> DataFrame:
    """The n best pieces of evidence of each pair, best first; ties by query block and candidate block."""
    w = Window.partitionBy("jd_id", "resume_id").orderBy(F.desc("score"), "jd_block", "resume_block")
    return evidence.filter("strength <> 'none'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def weakest(evidence: DataFrame, n: int = 5) -> DataFrame:
    """The n last pieces of evidence in the same order; rank counts from the end."""
    w = Window.partitionBy("jd_id", "resume_id").orderBy("score", F.desc("jd_block"), F.desc("resume_block"))
    return evidence.filter("strength <> 'none'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def strength_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("jd_id", "resume_id").agg(*[F.count_if(F.col("strength") == s).alias(s) for s in ("strong", "moderate", "weak", "none")])


def comparison_summary(counts: DataFrame) -> DataFrame:
    """evidence.comparison_counts with coverage, the percentage found, and whether all mandatory ones are."""
    coverage = F.when(F.col("total") > 0, F.round(F.col("found") * 100 / F.col("total"), 1)).otherwise(0.0)
    return counts.select("*", coverage.alias("coverage"), (F.col("mandatory_found") == F.col("mandatory_total")).alias("mandatory_satisfied"))


#: The sections of a report and the query sections whose evidence each shows; the last is wider than its score's.
GROUPS = {**dims.COMPONENTS, "content_score": tuple(s for s in dims.SECTIONS if s not in ("skills", "experience", "education", "contact"))}


def has_content(blocks: DataFrame) -> DataFrame:
    """jd_id, has_content: does a query document have any block of the content section? If not, it shows all evidence."""
    return blocks.groupBy("jd_id").agg(F.bool_or(F.col("section").isin(*GROUPS["content_score"])).alias("has_content"))


def evidence_groups(evidence: DataFrame, blocks: DataFrame, n: int = 10) -> DataFrame:
    """jd_id, resume_id, component, evidence: the first n pieces of evidence of each report section."""
    rows = evidence.filter("strength <> 'none'").join(has_content(blocks), "jd_id", "left")
    inside = {c: F.col("jd_section").isin(*s) for c, s in GROUPS.items()}
    inside["content_score"] = inside["content_score"] | ~F.coalesce("has_content", F.lit(False))
    names = F.filter(F.array(*[F.when(on, F.lit(c)) for c, on in inside.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("component", F.explode(names))
    w = Window.partitionBy("jd_id", "resume_id", "component").orderBy("jd_block", F.desc("score"), "resume_block")
    rows = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return rows.groupBy("jd_id", "resume_id", "component").agg(F.array_sort(F.collect_list(F.struct("r", "jd_block", "resume_block", "score", "strength"))).alias("evidence"))


def quality_warnings(pairs: DataFrame, jd_messages: DataFrame, resume_messages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """jd_id, resume_id, data_quality_warnings: what quality.messages warns of in either document, the query document's
    first, each with its origin before it."""

    out = pairs.join(document_warnings(jd_messages, "jd", doc), "jd_id", "left").join(document_warnings(resume_messages, "resume", doc), "resume_id", "left")
    return out.select("jd_id", "resume_id", _both_warnings().alias("data_quality_warnings"))


def document_warnings(msgs: DataFrame, name: str, doc: str = "doc_id") -> DataFrame:
    """name_id, name_warnings: quality_warnings of one side, for each document that has any."""
    text = F.concat(F.lit({"jd": "[JD] ", "resume": "[Resume] "}[name]), F.col("code"), F.lit(": "), F.col("count"))
    return msgs.filter("status <> 'valid'").groupBy(F.col(doc).alias(f"{name}_id")).agg(F.array_sort(F.collect_list(text)).alias(f"{name}_warnings"))


def _both_warnings() -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce("jd_warnings", empty), F.coalesce("resume_warnings", empty))


def config_hash(weights: Weights = Weights()) -> str:
    """Eight digits that change with the weights."""
    return hashlib.md5(repr(sorted(weights.as_dict().items())).encode()).hexdigest()[:8]


def _evidence_entry() -> Column:
    """A piece of evidence as reports show it; texts of up to 200 characters."""
    return F.struct(
        F.col("jd_block"), F.col("resume_block"), F.left("jd_text", F.lit(200)).alias("jd_text"), F.left("resume_text", F.lit(200)).alias("resume_text"), F.round("score", 4).alias("similarity_score"),
        F.col("jd_section"), F.col("resume_section"), F.col("jd_lines").alias("jd_line_numbers"), F.col("resume_lines").alias("resume_line_numbers"), F.col("strength").alias("match_strength"),
        F.col("explanation"), F.col("uncertain").alias("uncertainty"),
    )


def _is(field: str, value: str) -> Callable[[Column], Column]:
    """Does an entry's field, whose parts are parted by full stops, have this value?"""
    return lambda x: reduce(lambda c, part: c[part], field.split("."), x) == value


def _summary_text(strengths: dict[str, Column], raws: dict[str, Column], met: Column, mandatory: Column, weights: Weights) -> Column:
    """A report's summary in words, from the column f, the final score."""
    rating = F.when(F.col("f") >= 75, "Strong Candidate").when(F.col("f") >= 55, "Moderate Candidate").when(F.col("f") >= 35, "Below Average Candidate").otherwise("Weak Candidate")
    shares = [F.format_string(f"{c.replace('_', ' ').title()}: %.1f/100 (weight: {weights.as_dict()[c]:.0%}).".replace("%)", "%%)"), raws[c]) for c in NAMES]
    return F.concat_ws(
        " ", F.format_string("Overall Assessment: %s (Score: %.1f/100).", rating, "f"), F.format_string("The candidate shows %d strong, %d moderate, and %d weak matches against the job requirements.", *strengths.values()), *shares,
        F.when(mandatory > 0, F.format_string("Mandatory Requirements: %d/%d met.", met, mandatory)), F.when(met != mandatory, "⚠ WARNING: Not all mandatory requirements are satisfied. Review required before proceeding."),
    )


def _origin(weights: Weights, processed_at: str | None, details: list[Column]) -> tuple[Column, Column]:
    """A report's id and its processing details."""
    h = config_hash(weights)
    report_id = F.substring(F.sha2(F.concat_ws("|", "jd_id", "resume_id", F.lit(h)), 256), 1, 12)
    return report_id, F.struct(F.lit(VERSION).alias("processing_version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(processed_at).cast("string").alias("processed_at"), F.lit(h).alias("config_hash"), *details)


def _rated(rows: DataFrame, weights: Weights) -> DataFrame:
    """Rows of briefs' tables joined, with f, the final score, and c, the entries of the components."""
    entries, raws = [], []
    for n in NAMES:
        raw, pieces, why, lacking = rated_facts(n)
        weight = F.lit(weights.as_dict()[n])
        raws.append(raw)
        entries.append(F.struct(F.lit(n).alias("name"), F.round(raw, 2).alias("raw_score"), weight.alias("weight"), F.round(raw * weight, 4).alias("weighted_contribution"), pieces.alias("evidence_count"), why.alias("explanation"), lacking.alias("missing_evidence")))
    rows = rows.na.fill(0, ["jd_block_count", "resume_block_count", "mandatory"])
    return rows.withColumn("f", F.round(weighted(raws, weights), 2)).withColumn("c", F.array(*entries))


def briefs(facts: DataFrame, asked: DataFrame, of_jd: DataFrame, of_resume: DataFrame, weights: Weights = Weights(), processed_at: str | None = None) -> DataFrame:
    """jd_id, resume_id, report: only the BRIEF_FIELDS of reports(), made without what the others need.

    facts from score.pair_facts, asked from score.asked_of; of_jd(jd_id, jd_filename, jd_block_count, required) and
    of_resume(resume_id, resume_filename, resume_block_count, candidate) have a row for each document. Pairs move as
    numbers; a query document's texts join them last, and no pair is multiplied by components or blocks.
    """
    rows = _rated(facts.join(of_resume, "resume_id", "left").join(asked.join(of_jd, "jd_id", "full"), "jd_id", "left"), weights)
    report_id, meta = _origin(weights, processed_at, [F.col(c) for c in ("jd_filename", "resume_filename", "jd_block_count", "resume_block_count")])
    all_met = F.col("met") == F.col("mandatory")
    text = _summary_text({s: F.col(s) for s in ("strong", "moderate", "weak")}, {n: F.col("c")[i]["raw_score"] for i, n in enumerate(NAMES)}, F.col("met"), F.col("mandatory"), weights)
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("_schema_version"), report_id.alias("_report_id"), meta.alias("processing_details"),
        F.struct(F.col("resume_id").alias("candidate_id"), F.col("jd_id"), F.col("f").alias("final_score"), F.col("c").alias("components"), all_met.alias("all_mandatory_met")).alias("candidate_score"), text.alias("recruiter_summary"),
    )
    return rows.select("jd_id", "resume_id", body.alias("report"))


def outlines(evidence: DataFrame, blocks: DataFrame, found: DataFrame, facts: DataFrame, asked: DataFrame, of_jd: DataFrame, of_resume: DataFrame, weights: Weights = Weights(), n: int = 5) -> DataFrame:
    """A row for each pair with what reports() holds but the rows of requirements and evidence, of which there are only
    numbers: jd_id, resume_id, f and c (the final score, the components), mandatory, met, total, found, partial,
    mandatory_total, mandatory_found, strongest, weakest, a list for each component (structs of b and r, the query block and
    the candidate's), missing_requirements, review_flags, data_quality_warnings, recruiter_summary, filenames, block counts.

    found from evidence.found_counts, the last four as in briefs(), of_jd and of_resume with warnings (document_warnings).
    A pair moves as its facts and the numbers of its evidence; texts join by query document at the end.
    """
    key = ["jd_id", "resume_id"]
    piece = F.struct(F.col("jd_block").alias("b"), (-F.col("score")).alias("s"), F.col("resume_block").alias("r"), F.col("jd_section").alias("section"))
    pieces = evidence.filter("strength <> 'none'").groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("e"))
    must = blocks.filter(X.is_mandatory(F.col("text"))).groupBy("jd_id").agg(F.array_sort(F.collect_list(F.struct("jd_block", F.left("text", F.lit(200)).alias("text")))).alias("must"))
    jd = asked.join(of_jd, "jd_id", "full").join(has_content(blocks), "jd_id", "full").join(must, "jd_id", "full").join(requirement_counts(blocks), "jd_id", "full")
    rows = _rated(facts.join(pieces, key, "left").join(found, key, "left").join(of_resume, "resume_id", "left").join(jd, "jd_id", "left"), weights)
    rows = rows.na.fill(0, ["total", "mandatory_total", "found", "partial", "mandatory_found"]).withColumn("e", F.coalesce("e", F.array().cast(rows.schema["e"].dataType)))
    ranked = F.array_sort(F.transform("e", lambda x: F.struct(x["s"], x["b"], x["r"])))
    rows = rows.withColumn("ranked", ranked)
    none = ~F.coalesce("has_content", F.lit(False))
    within = lambda c: F.filter("e", lambda x: x["section"].isin(*GROUPS[c]) | (none if c == "content_score" else F.lit(False)))
    met_blocks = F.transform(F.filter("e", lambda x: -x["s"] >= 0.40), lambda x: x["b"])
    unmet = F.transform(F.filter("must", lambda x: ~F.array_contains(met_blocks, x["jd_block"])), lambda x: x["text"])
    short = F.col("mandatory") - F.col("met")
    flags = F.concat(_component_flags(), F.when(short != 0, F.array(F.format_string("Unmet mandatory requirements: %d", short))).otherwise(F.array().cast("array<string>")))
    text = _summary_text({s: F.col(s) for s in ("strong", "moderate", "weak")}, {m: F.col("c")[i]["raw_score"] for i, m in enumerate(NAMES)}, F.col("met"), F.col("mandatory"), weights)
    return rows.select(
        *key, "f", "c", "mandatory", "met", "total", "found", "partial", "mandatory_total", "mandatory_found", F.slice("ranked", 1, n).alias("strongest"), F.slice("ranked", F.greatest(F.size("ranked") - n + 1, F.lit(1)), n).alias("weakest"),
        *(F.slice(within(c), 1, 10).alias(f"{c}_evidence") for c in GROUPS), F.coalesce(unmet, F.array().cast("array<string>")).alias("missing_requirements"), flags.alias("review_flags"), _both_warnings().alias("data_quality_warnings"),
        text.alias("recruiter_summary"), "jd_filename", "resume_filename", "jd_block_count", "resume_block_count",
    )


def _component_flags() -> Column:
    """What a report's components in c give to its review flags."""
    return F.flatten(F.transform("c", lambda x: F.array_compact(F.array(F.when(x["raw_score"] == 0, F.concat(F.lit("Zero score for "), x["name"], F.lit(": "), x["explanation"])), F.when(F.size(x["missing_evidence"]) > 0, F.concat(F.lit("Missing evidence for "), x["name"], F.lit(": "), F.size(x["missing_evidence"]).cast("string"), F.lit(" items")))))))


def _asked_lists(blocks: DataFrame) -> DataFrame:
    """jd_id, texts (a map of each block's text and lines), flags (one of its components), reqs and must (lists of
    requirements and of mandatory blocks, in the order of reports)."""
    text = F.map_from_entries(F.collect_list(F.struct("jd_block", F.struct("text", "source_lines"))))
    texts = blocks.groupBy("jd_id").agg(text.alias("texts"), F.array_sort(F.collect_list(F.when(X.is_mandatory(F.col("text")), F.col("jd_block")))).alias("must"))
    req = numbered_requirements(blocks).groupBy("jd_id").agg(F.array_sort(F.collect_list(F.struct("parameter_id", "jd_block", "is_mandatory", "jd_section"))).alias("reqs"))
    flags = component_flags(blocks).groupBy("jd_id").agg(F.map_from_entries(F.collect_list(F.struct("jd_block", "components"))).alias("flags"))
    return texts.join(flags, "jd_id").join(req, "jd_id", "left")


def _lists_made(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """rows (a pair's e and n, and _asked_lists of its query document) with e, m, p as reports() has them of evidence,
    evidence.mandatory and evidence.comparison."""
    none = F.array()
    of = lambda k: F.try_element_at("texts", k)
    rows = rows.withColumns({c: F.coalesce(c, none.cast(rows.schema[c].dataType)) for c in ("e", "n", "reqs", "must")})

    def shown(x: Column) -> Column:
        same = F.when(x["jd_section"] == x["section"], "same section").otherwise("cross-section")
        why = F.format_string("Match strength: %s (similarity: %.3f) | JD section: %s | Resume section: %s | %s", x["strength"], -x["s"], x["jd_section"], x["section"], same)
        return F.struct(
            x["b"].alias("jd_block"), x["r"].alias("resume_block"), F.left(of(x["b"])["text"], F.lit(200)).alias("jd_text"), F.left(F.coalesce(x["text"], F.lit("")), F.lit(200)).alias("resume_text"), F.round(-x["s"], 4).alias("similarity_score"),
            x["jd_section"].alias("jd_section"), x["section"].alias("resume_section"), of(x["b"])["source_lines"].alias("jd_line_numbers"), x["lines"].alias("resume_line_numbers"), x["strength"].alias("match_strength"),
            why.alias("explanation"), (x["strength"] == "weak").alias("uncertainty"),
        )

    # e is sorted by query block, best first: a block's best is its first
    first = lambda k, usable=F.lit(True): F.get(F.filter("e", lambda x: (x["b"] == k) & usable(x) if callable(usable) else x["b"] == k), F.lit(0))
    rows = rows.withColumn("m", F.transform("must", lambda k: F.struct(k.alias("k"), first(k).alias("u"))))

    def must(x: Column) -> Column:
        score = F.coalesce(-x["u"]["s"], F.lit(0.0))
        why = F.format_string("%s: best match score %.3f (threshold: %.2f)", F.when(score >= t.mandatory_met, "Met").otherwise("NOT met"), score, F.lit(t.mandatory_met))
        why = F.when(x["u"].isNull(), "No matching evidence found in resume").otherwise(why)
        return F.struct(F.left(of(x["k"])["text"], F.lit(200)).alias("requirement_text"), (score >= t.mandatory_met).alias("is_met"), score.alias("best_match_score"), F.left(x["u"]["text"], F.lit(200)).alias("best_match_text"), why.alias("explanation"))

    rows = rows.withColumn("m", F.transform("m", must))
    pin = lambda k: F.get(F.filter("n", lambda x: x["jd_block"] == k), F.lit(0))
    rows = rows.withColumn("p", F.transform("reqs", lambda q: F.struct(q.alias("q"), first(q["jd_block"], lambda x: x["section"] != "contact").alias("u"), pin(q["jd_block"]).alias("n"))))
    sim = lambda x: F.when(x["u"].isNull(), 0.0).otherwise(F.greatest(-x["u"]["s"], F.coalesce(x["n"]["similarity"], F.lit(0.0))))
    rows = rows.withColumn("p", F.transform("p", lambda x: F.struct(x["q"].alias("q"), x["u"].alias("u"), x["n"].alias("n"), of(x["q"]["jd_block"]).alias("d"), sim(x).alias("sim"), F.round(F.least(sim(x) * 100, F.lit(100.0)), 1).alias("conf"), status(sim(x), t).alias("st"))))

    def param(x: Column) -> Column:
        q, u, n, hit = x["q"], x["u"], x["n"], x["st"] != "not_found"
        described = F.when(x["st"] == "found", "Found in resume with strong evidence").otherwise("Partially found in resume")
        why = (
            F.when(hit, F.format_string("%s (score: %.1f%%). %s", described, x["conf"], F.format_string("Match strength: %s (similarity: %.3f)", u["strength"], -u["s"])))
            .when(u.isNotNull(), F.format_string("Requirement not met in resume (score %.1f%% below threshold).", x["conf"]))
            .otherwise(F.concat(F.lit(NOTHING_FOUND), F.left(x["d"]["text"], F.lit(100))))
        )
        lines = F.when(n["sentence"].isNotNull(), n["lines"]).otherwise(u["lines"])
        return F.struct(
            q["parameter_id"].alias("parameter_id"), category(q["jd_section"], q["is_mandatory"]).alias("category"), x["d"]["text"].alias("requirement_text"), q["is_mandatory"].alias("is_mandatory"), x["st"].alias("status"), x["conf"].alias("confidence_score"), F.round(x["sim"], 4).alias("similarity_score"),
            F.coalesce(F.when(hit, F.coalesce(n["sentence"], u["text"])), F.lit("")).alias("matched_resume_text"), F.coalesce(F.when(hit, lines), F.array().cast("array<int>")).alias("matched_resume_lines"), x["d"]["source_lines"].alias("source_jd_lines"),
            F.when(hit, u["strength"]).otherwise("none").alias("match_strength"), why.alias("explanation"), q["jd_section"].alias("jd_section"), F.when(hit, u["section"]).otherwise("unknown").alias("resume_section"),
        )

    e = F.transform("e", lambda x: F.struct(x["b"].alias("b"), x["s"].alias("s"), x["r"].alias("r"), shown(x).alias("v")))
    return rows.withColumn("p", F.transform("p", param)).withColumn("e", e)


def reports(finals: DataFrame | None, comps: DataFrame | None, mandatory: DataFrame, params: DataFrame, evidence: DataFrame, blocks: DataFrame, details: DataFrame | None, warnings: DataFrame | None = None, weights: Weights = Weights(), n: int = 5, processed_at: str | None = None, late: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """jd_id, resume_id, report: one nested struct for each pair of finals, with all fields of RECRUITER_FIELDS.

    comps with missing_evidence (score.with_missing), mandatory and params with texts, evidence as evidence.grade gives it
    (only pieces whose strength isn't none show), details(jd_id, resume_id and any columns) as processing details,
    warnings from quality_warnings. What belongs to a pair comes as tagged rows of one union, so a pair is put together
    by one aggregate instead of a join for each part; a pair's lists are bounded by its blocks.

    late: the four tables of briefs() instead of finals, comps and details. Texts of the query documents (in mandatory and
    params, where these have null, and in evidence, which then needs no jd_text and jd_lines) are then filled in from
    blocks when no pair moves any more, so that they are not written for each pair.
    """
    key = ["jd_id", "resume_id"]
    order = reduce(lambda c, kv: c.when(F.col("component") == kv[1], kv[0]), enumerate(NAMES), F.when(F.lit(False), 0)).otherwise(len(NAMES))
    weight = reduce(lambda c, kv: c.when(F.col("component") == kv[0], kv[1]), weights.as_dict().items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    raw = F.round("raw", 2)
    if late:
        facts, asked, of_jd, of_resume = late
        evidence = evidence.withColumn("jd_text", F.lit(None).cast("string")).withColumn("jd_lines", F.lit(None).cast("array<int>"))
        head = facts.join(of_resume, "resume_id", "left")
        own = {"h": head.select(*key, F.struct(*[x for x in head.columns if x not in key]).alias("h"))}
    else:
        own = {
            "f": finals.select(*key, F.round("final", 2).alias("f")),
            "c": comps.select(*key, F.struct(order.alias("o"), F.struct(F.col("component").alias("name"), raw.alias("raw_score"), weight.alias("weight"), F.round(F.col("raw") * weight, 4).alias("weighted_contribution"), "evidence_count", "explanation", "missing_evidence").alias("v")).alias("c")),
            "d": details.select(*key, F.struct(*[c for c in details.columns if c not in key]).alias("d")),
        }
    tagged = own | {
        "m": mandatory.select(*key, F.struct(F.col("jd_block").alias("o"), F.col("jd_block").alias("k"), F.struct("requirement_text", "is_met", F.col("best_score").alias("best_match_score"), "best_match_text", "explanation").alias("v")).alias("m")),
        "p": params.select(*key, F.struct(F.col("parameter_id").alias("o"), F.col("jd_block").alias("k"), F.struct("parameter_id", "category", "requirement_text", "is_mandatory", "status", F.col("confidence").alias("confidence_score"), F.round("similarity", 4).alias("similarity_score"), F.coalesce("matched_text", F.lit("")).alias("matched_resume_text"), F.coalesce("matched_lines", F.array().cast("array<int>")).alias("matched_resume_lines"), "source_jd_lines", "match_strength", "explanation", "jd_section", "resume_section").alias("v")).alias("p")),
        "e": evidence.filter("strength <> 'none'").select(*key, F.struct(F.col("jd_block").alias("b"), (-F.col("score")).alias("s"), F.col("resume_block").alias("r"), _evidence_entry().alias("v")).alias("e")),
        "x": F.broadcast(evidence.sparkSession.createDataFrame([], "jd_id string, resume_id string, w array<string>")) if warnings is None else warnings.select(*key, F.col("data_quality_warnings").alias("w")),
    }
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged.values())
    lists = [F.array_sort(F.collect_list(c)).alias(c) for c in ("c", "m", "p") if c in tagged]
    tops = ("h",) if late else ("f", "d")
    rows = one.groupBy(*key).agg(*lists, F.array_sort(F.collect_list("e")).alias("e"), *[F.max(c).alias(c) for c in tops], F.flatten(F.collect_list("w")).alias("w")).filter(f"{tops[0]} is not null")
    of_blocks = has_content(blocks)
    if late:
        text = F.map_from_entries(F.collect_list(F.struct("jd_block", F.struct("text", "source_lines"))))
        of_blocks = of_blocks.join(blocks.groupBy("jd_id").agg(text.alias("texts")), "jd_id").join(asked, "jd_id", "full").join(of_jd, "jd_id", "full")
    rows = rows.join(of_blocks, "jd_id", "left")
    if late:
        rows = _rated(rows.select("*", "h.*").drop("h"), weights).withColumn("d", F.struct("jd_filename", "resume_filename", "jd_block_count", "resume_block_count"))
        of = lambda k: F.try_element_at("texts", k)
        lost = lambda k: F.concat(F.lit(NOTHING_FOUND), F.left(of(k)["text"], F.lit(100)))
        filled = {
            "m": lambda x: x["v"].withField("requirement_text", F.coalesce(x["v"]["requirement_text"], F.left(of(x["k"])["text"], F.lit(200)))),
            "p": lambda x: x["v"].withField("requirement_text", F.coalesce(x["v"]["requirement_text"], of(x["k"])["text"])).withField("source_jd_lines", of(x["k"])["source_lines"]).withField("explanation", F.coalesce(x["v"]["explanation"], lost(x["k"]))),
        }
        shown = lambda x: x["v"].withField("jd_text", F.left(of(x["b"])["text"], F.lit(200))).withField("jd_line_numbers", of(x["b"])["source_lines"])
        rows = rows.withColumn("e", F.transform("e", lambda x: x.withField("v", shown(x))))
    else:
        filled = dict.fromkeys("cmp", lambda x: x["v"])
    rows = rows.withColumns({c: F.transform(c, f) for c, f in filled.items()})
    return _report_bodies(rows, weights, n, processed_at)


def reports_at_once(evidence: DataFrame, pinned: DataFrame, blocks: DataFrame, asked: DataFrame, of_jd: DataFrame, weights: Weights = Weights(), n: int = 5, processed_at: str | None = None) -> DataFrame:
    """What reports() gives where scores are as graded: each pair moves once, to its query document, as its evidence, its
    sentences and what is known of its candidate. All else is made there.

    evidence with rows of strength none too, resume_text (whole), resume_lines, and of_resume, a struct of the columns of
    briefs()'s table; pinned as in evidence.comparison; asked from score.asked_of; of_jd as in briefs(). Both have warnings
    (document_warnings).
    """
    key = ["jd_id", "resume_id"]
    piece = F.struct(F.col("jd_block").alias("b"), (-F.col("score")).alias("s"), F.col("resume_block").alias("r"), "strength", "jd_section", F.col("resume_section").alias("section"), F.col("resume_text").alias("text"), F.col("resume_lines").alias("lines"))
    e = evidence.select(*key, F.when(F.col("strength") != "none", piece).alias("e"), F.col("of_resume").alias("h"))
    one = e.unionByName(pinned.select(*key, F.struct("jd_block", "sentence", "lines", "similarity").alias("n")), allowMissingColumns=True)
    # by query document, where its texts are joined: neither that join nor the aggregate moves a pair again
    one = one.repartition(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), "jd_id")
    rows = one.groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("e"), F.collect_list("n").alias("n"), F.max("h").alias("h"))
    of_blocks = has_content(blocks).join(_asked_lists(blocks), "jd_id").join(asked, "jd_id", "full").join(of_jd, "jd_id", "full")
    rows = with_pair_facts(rows.select("*", "h.*").drop("h").hint("merge").join(of_blocks, "jd_id", "left"))
    rows = _lists_made(_rated(rows, weights)).withColumn("d", F.struct("jd_filename", "resume_filename", "jd_block_count", "resume_block_count")).withColumn("w", _both_warnings())
    return _report_bodies(rows, weights, n, processed_at)


def _report_bodies(rows: DataFrame, weights: Weights, n: int, processed_at: str | None) -> DataFrame:
    """reports() of rows with a pair's lists c, m, p, e, w, its final score f, its details d, has_content."""
    key = ["jd_id", "resume_id"]
    ranked = F.transform(F.array_sort(F.transform("e", lambda x: F.struct(x["s"], x["b"], x["r"], x["v"]))), lambda x: x["v"])
    rows = rows.withColumn("ranked", ranked)

    def group(component: str) -> Column:
        own = F.col("component_" + component)
        inside = lambda x: x["v"]["jd_section"].isin(*GROUPS[component])
        if component == "content_score":
            inside = lambda x: x["v"]["jd_section"].isin(*GROUPS["content_score"]) | ~F.coalesce("has_content", F.lit(False))
        shown = F.transform(F.slice(F.filter("e", inside), 1, 10), lambda x: x["v"])
        return F.struct(F.lit(component).alias("component_name"), F.struct(own["raw_score"].alias("raw_score"), own["weight"].alias("weight"), own["weighted_contribution"].alias("weighted_contribution")).alias("score"), shown.alias("evidence"))

    for c in NAMES:
        rows = rows.withColumn("component_" + c, F.get(F.filter("c", _is("name", c)), F.lit(0)))
    strong = {s: F.size(F.filter("e", _is("v.match_strength", s))) for s in ("strong", "moderate", "weak")}
    total, must = F.size("p"), F.filter("p", lambda x: x["is_mandatory"])
    status = lambda s: F.size(F.filter("p", lambda x: x["status"] == s))
    found_must = F.size(F.filter(must, lambda x: x["status"] == "found"))
    summary = F.struct(
        total.alias("total_parameters"), status("found").alias("found_in_resume"), status("partial").alias("partial_match"), status("not_found").alias("missing_in_resume"),
        F.when(total > 0, F.round(status("found") * 100 / total, 1)).otherwise(0.0).alias("coverage_percentage"), F.size(must).alias("mandatory_total"), found_must.alias("mandatory_found"), (found_must == F.size(must)).alias("mandatory_satisfied"),
    )
    met = F.size(F.filter("m", lambda x: x["is_met"]))
    all_met = met == F.size("m")
    flags = _component_flags()
    unmet = F.when(~all_met, F.array(F.format_string("Unmet mandatory requirements: %d", F.size("m") - met))).otherwise(F.array().cast("array<string>"))
    raws = {c: F.col("component_" + c)["raw_score"] for c in NAMES}
    text = _summary_text(strong, raws, met, F.size("m"), weights)
    report_id, meta = _origin(weights, processed_at, [F.col("d")[c].alias(c) for c in rows.select("d.*").columns])
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("_schema_version"), report_id.alias("_report_id"), meta.alias("processing_details"),
        F.struct(F.col("resume_id").alias("candidate_id"), F.col("jd_id"), F.col("f").alias("final_score"), F.col("c").alias("components"), all_met.alias("all_mandatory_met")).alias("candidate_score"),
        summary.alias("comparison_summary"), F.col("p").alias("comparison_parameters"), group("skill").alias("skill_evidence"), group("work_experience").alias("experience_evidence"), group("education").alias("education_evidence"),
        group("content_score").alias("semantic_evidence"), F.slice("ranked", 1, n).alias("strongest_matches"), F.slice("ranked", F.greatest(F.size("ranked") - n + 1, F.lit(1)), n).alias("weakest_matches"), F.col("m").alias("mandatory_requirements"),
        F.transform(F.filter("m", lambda x: ~x["is_met"]), lambda x: x["requirement_text"]).alias("missing_requirements"), F.concat(flags, unmet).alias("review_flags"), F.col("w").alias("data_quality_warnings"), text.alias("recruiter_summary"),
    )
    return rows.select(*key, body.alias("report"))


#: The keys of a report in their order, and those of its brief form.
RECRUITER_FIELDS = (
    "_schema_version _report_id processing_details candidate_score comparison_summary comparison_parameters skill_evidence experience_evidence education_evidence semantic_evidence strongest_matches weakest_matches "
    "mandatory_requirements missing_requirements review_flags data_quality_warnings recruiter_summary"
).split()
BRIEF_FIELDS = "_schema_version _report_id processing_details candidate_score recruiter_summary".split()
VERSION = SCHEMA_VERSION = "1.0.0"


def as_json(reports: DataFrame, pretty: bool = False, brief: bool = False) -> DataFrame:
    """jd_id, resume_id, json: the whole report, or its brief form of five keys."""
    body = F.struct(*[F.col("report")[c].alias(c) for c in BRIEF_FIELDS]) if brief else F.col("report")
    return reports.select("jd_id", "resume_id", F.to_json(body, {"pretty": "true"} if pretty else {}).alias("json"))


def write_json(reports: DataFrame, path: str) -> None:
    """A folder of JSON lines for each query document."""
    JsonLines(path).write(reports)


class Exporter(Protocol):
    """What writes reports somewhere."""

    def write(self, reports: DataFrame) -> None: ...


class JsonLines:
    def __init__(self, path: str, brief: bool = False) -> None:
        self.path, self.brief = path, brief

    def write(self, reports: DataFrame) -> None:
        as_json(reports, brief=self.brief).select("jd_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("jd_id").text(self.path)
