"""The whole plan: documents to lines, sentences, blocks, evidence, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import Config
from matchloom.functions import text as X
from matchloom.functions.embed import Embedder, HashedEmbedder
from matchloom.operators import blocks as B
from matchloom.operators import evidence as E
from matchloom.operators import quality, report, score, sections, segment
from matchloom.session import checkpointed

#: The embedder of plans that name no other.
WORDS = HashedEmbedder(256)


def processed(docs: DataFrame, cfg: Config = Config(), doc: str = "doc_id", simple: bool = False) -> dict[str, DataFrame]:
    """lines, headings, sentences, blocks of documents (doc, text). The cleaned lines are written once, since four steps
    read them; what follows is lazy and shuffles by document."""
    lines = checkpointed(segment.cleaned_lines(segment.index_lines(docs, doc), simple))
    heads = sections.detect_headings(lines, doc, cfg.detection.max_heading_length)
    sents = segment.split_sentences(segment.paragraphs(segment.content_lines(lines), doc), doc)
    packed = B.pack_blocks(sents, heads, cfg, doc)
    totals = lines.groupBy(doc).agg(F.max("line_no").alias("total_lines"))
    placed = packed.join(totals, doc).withColumn("position", sections.position(F.col("source_lines"), F.col("total_lines"))).withColumn("first_line", F.array_min("source_lines"))
    assigned = sections.assign_sections(placed, heads, doc)
    return {"lines": lines, "headings": heads, "sentences": sents, "blocks": B.infer_sections(assigned.drop("first_line", "total_lines"), cfg, doc)}


def whole(docs: DataFrame, cfg: Config = Config(), doc: str = "doc_id", simple: bool = False) -> DataFrame:
    """doc, sections, texts: the blocks that processed() gives of each document, in order, without their sentences, lines
    and reasons. There is one shuffle, all else is done where documents stand: of the documents as they came, or, where
    cleaning needs Python, after which Spark knows no more where rows stand, of their lines."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = F.size(F.split("text", "\r\n|\n|\r", -1)).alias("total_lines")
    lines = segment.index_lines((docs.repartition(n, doc) if simple else docs).select(doc, "text", total), doc, keep=("total_lines",))
    content = sections.with_headings(segment.content_lines(segment.cleaned_lines(lines, simple)), cfg.detection.max_heading_length)
    heads = F.collect_list(F.when(F.col("heading").isNotNull(), F.struct("line_no", "heading"))).alias("heads")
    return B.whole_blocks(segment.paragraphs(content, doc, (heads, F.max("total_lines").alias("total_lines"))), cfg, doc)


def each_block(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, block_no, section, text of what whole() gives, and the columns to keep."""
    rows = docs.select("doc_id", *keep, F.posexplode(F.arrays_zip("sections", "texts")).alias("block_no", "b"))
    return rows.select("doc_id", "block_no", F.col("b.sections").alias("section"), F.col("b.texts").alias("text"), *keep)


def embedded(blocks: DataFrame, embedder: Embedder = WORDS) -> DataFrame:
    """blocks with vec; each distinct text is embedded once."""
    texts = blocks.select("text").distinct()
    return blocks.join(texts.withColumn("vec", embedder.column(X.embedding_text(F.col("text")))), "text")


def sentence_matches(evidence: DataFrame, jd_blocks: DataFrame, sentences: DataFrame, embedder: Embedder = WORDS) -> DataFrame:
    """evidence.pinpoint for the best block of every requirement. jd_blocks(jd_id, jd_block, text), sentences(resume_id,
    resume_block, sent_no, text and others); only best blocks' sentences are used. Where an embedder has a compact form
    (HashedEmbedder), it is made of each text where it lies and no vector moves; else each distinct text is embedded once
    and its vector written."""
    best = E.best_usable(evidence).select("jd_id", "resume_id", "jd_block", "best_block")
    asked = jd_blocks.join(best.select("jd_id", "jd_block").distinct(), ["jd_id", "jd_block"]).select("jd_id", "jd_block", "text")
    wanted = best.select("resume_id", F.col("best_block").alias("resume_block")).distinct()
    used = sentences.join(wanted, ["resume_id", "resume_block"])
    if hasattr(embedder, "compact"):
        form = embedder.compact(X.embedding_text(F.col("text")))
        return E.pinpoint(best.join(asked.withColumn("vec", form).drop("text"), ["jd_id", "jd_block"]), used, embedder.compact_similarity, form)
    used = checkpointed(used)  # read twice below
    texts = asked.select("text").unionByName(used.select("text")).distinct()
    vec = checkpointed(texts.withColumn("vec", embedder.column(X.embedding_text(F.col("text")))))
    return E.pinpoint(best.join(asked.join(vec, "text").drop("text"), ["jd_id", "jd_block"]), used.join(vec, "text"))


def scored(jds: DataFrame, resumes: DataFrame, cfg: Config = Config(), embedder: Embedder = WORDS, simple: bool = False, finals: bool = True) -> DataFrame:
    """What match() gives as evidence, without texts, or as finals, without making anything else: blocks keep neither
    sentences nor reasons and stay with their document, vectors are not written, and for finals hits are summed up for each
    pair in the task that finds them."""
    jb, docs = checkpointed(each_block(whole(jds, cfg, simple=simple))), whole(resumes, cfg, simple=simple)
    places = hasattr(embedder, "compact")
    embed = lambda t: (embedder.compact if places else embedder.column)(X.embedding_text(t))
    if not finals:
        found = E.grade(E.retrieve_pairs(jb, each_block(docs), cfg, embedder.dim, embed, places), cfg)
        return found.withColumnRenamed("jd_block_no", "jd_block").withColumnRenamed("resume_block_no", "resume_block")
    # evidence that counts for nothing still makes a pair
    years = X.candidate_years(F.concat_ws(" ", "texts"), cfg.reference_year).alias("years")
    sums = E.pair_sums(score.component_flags(jb.withColumnRenamed("doc_id", "jd_id")).withColumnRenamed("jd_id", "doc_id"), each_block(docs.select("*", years), "years"), cfg, embedder.dim, embed, score.credit_points(cfg.thresholds), places)
    jd_blocks = jb.select(F.col("doc_id").cast("string").alias("jd_id"), F.col("block_no").alias("jd_block"), "block_no", "section", "text")
    of_jd = checkpointed(score.asked_of(jd_blocks).select("jd_id", "relevant").join(years_of(jb, "jd_id", X.required_years, "required"), "jd_id"))
    return score.ranked(score.final_of_sums(sums, of_jd, cfg.weights))


def match(jds: DataFrame, resumes: DataFrame, cfg: Config = Config(), embedder: Embedder = WORDS, pairs: DataFrame | None = None, simple: bool = False) -> dict[str, DataFrame]:
    """Query documents against candidates (both doc_id, text and, if known, source_filename): evidence, mandatory,
    comparison, components, finals, reports, quality.

    pairs (jd_id, resume_id) names the pairs to be scored: each comes out, those without any evidence with the score 0,
    and no other. Without it, every pair with evidence is scored; all others would score 0. simple leaves out compatibility
    normalisation and protected tokens when lines are cleaned.
    """
    jp, rp = processed(jds, cfg, simple=simple), processed(resumes, cfg, simple=simple)
    jb, rb = checkpointed(embedded(jp["blocks"], embedder)), checkpointed(embedded(rp["blocks"], embedder))
    hits = E.retrieve_pairs(jb, rb, cfg, embedder.dim)
    if pairs is not None:
        pairs = pairs.select(F.col("jd_id").cast("string").alias("jd_id"), F.col("resume_id").cast("string").alias("resume_id")).distinct()
        hits = hits.join(pairs, ["jd_id", "resume_id"], "left_semi")
    found = E.described(E.grade(hits, cfg), jb, rb)
    ev = checkpointed(found.withColumnRenamed("jd_block_no", "jd_block").withColumnRenamed("resume_block_no", "resume_block"))
    jd_blocks = jb.select(F.col("doc_id").cast("string").alias("jd_id"), F.col("block_no").alias("jd_block"), "block_no", "section", "text", "source_lines")
    own = rb.select(F.col("doc_id").cast("string").alias("resume_id"), F.col("block_no").alias("resume_block"), "text", "source_lines", "sentences")
    pairs = ev.select("jd_id", "resume_id").distinct() if pairs is None else pairs
    years = pairs.join(years_of(jb, "jd_id", X.required_years, "required"), "jd_id", "left").join(years_of(rb, "resume_id", lambda c: X.candidate_years(c, cfg.reference_year), "candidate"), "resume_id", "left")
    comps = checkpointed(score.components(ev, jd_blocks, pairs, years, cfg.thresholds))
    finals = score.ranked(score.final_scores(comps, cfg.weights))
    must = E.mandatory(ev, jd_blocks, pairs, cfg.thresholds.mandatory_met, own)
    sents = own.select("resume_id", "resume_block", F.posexplode("sentences").alias("sent_no", "s")).select("resume_id", "resume_block", "sent_no", "s.text", "s.source_lines")
    exact = checkpointed(E.pinned(sentence_matches(ev, jd_blocks, sents, embedder), jd_blocks, cfg))
    params = E.comparison(ev, jd_blocks, pairs, cfg.thresholds, own, exact)
    lacking = score.with_missing(comps, ev, jd_blocks, pairs)
    jd_facts, facts = (quality.document_facts(d, p["lines"], p["blocks"]) for d, p in ((jds, jp), (resumes, rp)))
    msgs = quality.messages(facts)
    warnings = report.quality_warnings(pairs, quality.messages(jd_facts), msgs)
    rep = report.reports(finals, lacking, must, params, ev, jd_blocks, details_of(pairs, jds, jd_blocks, resumes, own), warnings, cfg.weights)
    counts = E.mandatory_counts(ev, jd_blocks, pairs, cfg.thresholds.mandatory_met)
    return {
        "evidence": ev, "all_evidence": E.with_unmatched(ev, jd_blocks, pairs), "mandatory": must, "comparison": params, "summary": report.comparison_summary(E.comparison_counts(ev, jd_blocks, pairs, cfg.thresholds, exact)),
        "components": comps, "finals": finals, "flags": score.review_flags(lacking, counts), "reports": rep, "quality": quality.roll_up(facts, msgs),
    }


def details_of(pairs: DataFrame, jds: DataFrame, jd_blocks: DataFrame, resumes: DataFrame, resume_blocks: DataFrame) -> DataFrame:
    """jd_id, resume_id, jd_filename, resume_filename, jd_block_count, resume_block_count."""
    out = pairs
    for name, docs, blocks in (("jd", jds, jd_blocks), ("resume", resumes, resume_blocks)):
        out = out.join(details_of_documents(docs, blocks, name), f"{name}_id", "left").na.fill(0, [f"{name}_block_count"])
    return out.select("jd_id", "resume_id", "jd_filename", "resume_filename", "jd_block_count", "resume_block_count")


def details_of_documents(docs: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """name_id, name_filename, name_block_count of each document."""
    key = f"{name}_id"
    file = X.sanitised_name(F.col("source_filename")) if "source_filename" in docs.columns else F.lit(None).cast("string")
    names = docs.groupBy(F.col("doc_id").cast("string").alias(key)).agg(F.min(file).alias(f"{name}_filename"))
    sizes = blocks.groupBy(key).agg(F.count("*").cast("int").alias(f"{name}_block_count"))
    return names.join(sizes, key, "left")


def years_of(blocks: DataFrame, name: str, read, out: str) -> DataFrame:
    whole = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    return whole.select(F.col("doc_id").cast("string").alias(name), read(F.concat_ws(" ", F.col("b.text"))).alias(out))
