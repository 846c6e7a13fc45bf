"""Every query of the core with SQL against it, on the smallest tables; the others give rows."""

import pytest

from matchloom.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck, same):
    same(catalog.queries()[name], SQL[name], spark, duck)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL) - {"match_finals"}))
def test_query_without_sql_gives_rows(name, spark):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_has_the_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["jd_id", "resume_id", "final", "rank"]


def test_missing_requirements_of_every_component(spark, monkeypatch):
    from pyspark.sql import functions as F

    from matchloom import dims

    plans = {"skill": "missing_requirements", "work_experience": "missing_work", "education": "missing_education"}
    assert set(plans) == set(dims.COMPONENTS) and len({SQL[q] for q in plans.values()}) == 3
    # the small tables hold no education sections
    blocks = catalog._jd_blocks
    for component, q in plans.items():
        monkeypatch.setattr(catalog, "_jd_blocks", lambda s, d, own=dims.COMPONENTS[component][0]: blocks(s, d).withColumn("section", F.lit(own)))
        assert catalog.queries()[q](spark, DATA).count() > 0


def test_brief_reports_are_parts_of_whole_ones(spark):
    from matchloom.operators import report

    brief = catalog.report_brief(spark, DATA)
    plan = brief._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # no sentence is embedded, since none shows
    want = report.as_json(catalog._reports(spark, DATA), brief=True)
    assert sorted(map(tuple, brief.collect())) == sorted(map(tuple, want.collect()))


def test_report_rows_make_no_rows_of_requirements(spark, monkeypatch):
    from matchloom.operators import evidence as E
    from matchloom.operators import report

    for module, made in ((E, "comparison"), (E, "mandatory"), (report, "reports")):
        monkeypatch.setattr(module, made, lambda *a, made=made, **k: pytest.fail(f"{made} is not asked for"))
    assert {"n_params", "strongest", "missing"} <= set(catalog.report_rows(spark, DATA).columns)


def _matched_alike(spark, tmp_path, name):
    """The query documents that come out of two of the same text, one id divisible by 20, and one candidate."""
    text = "Requirements\nMust have experience with python and spark and sql\nExperience\nBuilt python and spark and sql pipelines\n"
    docs = spark.createDataFrame([(1, text, "job_description"), (20, text, "job_description"), (2, text, "resume")], "doc_id long, text string, doc_type string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return {r["jd_id"] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}


def test_evidence_is_found_for_every_job_description(spark, tmp_path):
    assert _matched_alike(spark, tmp_path, "match_evidence") == {"1", "20"}
    assert "% 20" not in SQL["match_evidence"]


def test_scores_are_found_for_every_job_description(spark, tmp_path):
    assert _matched_alike(spark, tmp_path, "match_scores") == {"1", "20"}
    assert "% 20" not in SQL["match_scores"]


def test_reports_move_each_pair_once_and_equal_those_of_whole_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from matchloom.operators import evidence as E
    from matchloom.operators import quality, report, score

    ev = catalog._evidence(spark, DATA)
    pairs, jd, res = catalog._pairs(ev), catalog._jd_blocks(spark, DATA), catalog._resume_blocks(spark, DATA)
    texts = res.select("resume_block", F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("resume_text"), F.col("source_lines").alias("resume_lines"))
    full = ev.filter("strength <> 'none'").join(texts, "resume_block").withColumn("explanation", E.explanation()).withColumn("uncertain", F.col("strength") == "weak")
    full = full.join(jd.select("jd_block", F.left("text", F.lit(200)).alias("jd_text"), F.col("source_lines").alias("jd_lines")), "jd_block", "left")
    msgs, comps = quality.messages(catalog._facts(spark, DATA)), catalog._components(spark, DATA)
    details = pairs.join(catalog._sides(spark, DATA)[0], "jd_id", "left").join(catalog._sides(spark, DATA)[1], "resume_id", "left").na.fill(0, ["jd_block_count", "resume_block_count"])
    details = details.select("jd_id", "resume_id", "jd_filename", "resume_filename", "jd_block_count", "resume_block_count")
    params = E.comparison(ev, jd, pairs, texts=res, pinned=catalog._pinned(spark, DATA, ev))
    want = report.reports(score.final_scores(comps), score.with_missing(comps, ev, jd, pairs), E.mandatory(ev, jd, pairs, texts=res), params, full, jd, details, report.quality_warnings(pairs, msgs, msgs))
    want = sorted(map(tuple, report.as_json(want).collect()))
    for module, made in ((E, "comparison"), (E, "mandatory"), (score, "pair_facts"), (report, "reports")):
        monkeypatch.setattr(module, made, lambda *a, made=made, **k: pytest.fail(f"{made} makes rows that move"))
    assert sorted(map(tuple, catalog.report_json(spark, DATA).collect())) == want != []
