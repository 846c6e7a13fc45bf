"""Evidence, scores and reports of small hand-made tables, files, settings, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from matchloom import config
from matchloom.operators import evidence as E
from matchloom.operators import retrieve, score
from matchloom.plans import pipeline
from matchloom.sources import files
from matchloom.streaming.intake import process_stream

EV = "jd_id string, resume_id string, jd_block long, resume_block long, jd_section string, resume_section string, score double, strength string"


def test_final_scores(spark):
    ev = spark.createDataFrame([("j", "r", 1, 10, "skills", "skills", 0.8, "strong"), ("j", "r", 2, 11, "experience", "experience", 0.4, "weak"), ("j", "r", 3, 12, "about", "other", 0.0, "none")], EV)
    blocks = spark.createDataFrame([("j", 1, 0, "skills", "a b c"), ("j", 2, 1, "experience", "must have d e"), ("j", 3, 2, "about", "x"), ("j", 4, 3, "skills", "y")], "jd_id string, jd_block long, block_no int, section string, text string")
    pairs = ev.select("jd_id", "resume_id").distinct()
    comps = {r["component"]: r["raw"] for r in score.components(ev, blocks, pairs).collect()}
    assert comps["skill"] == pytest.approx((0.8 * 0.6 + 0.5 * 0.4) * 100)
    assert comps["work_experience"] == pytest.approx((0.4 * 0.6 + 0.35 * 0.4) * 100)
    assert comps["education"] == 0 and comps["content_score"] == 0
    final = score.final_scores(score.components(ev, blocks, pairs)).first()["final"]
    assert final == pytest.approx(0.15 * comps["skill"] + 0.35 * comps["work_experience"])
    years = spark.createDataFrame([("j", "r", 10, 2)], "jd_id string, resume_id string, required int, candidate int")
    less = {r["component"]: r["raw"] for r in score.components(ev, blocks, pairs, years).collect()}
    assert less["work_experience"] == pytest.approx(0.4 * comps["work_experience"])
    texts = spark.createDataFrame([("r", 11, "x" * 300)], "resume_id string, resume_block long, text string")
    must = E.mandatory(ev, blocks, pairs, texts=texts).collect()
    assert [(r["jd_block"], r["is_met"], r["requirement_text"], len(r["best_match_text"]), r["explanation"]) for r in must] == [(2, True, "must have d e", 200, "Met: best match score 0.400 (threshold: 0.40)")]
    assert tuple(E.mandatory_counts(ev, blocks, pairs).first()) == ("j", "r", 1, 1)
    assert E.missing(ev, blocks, pairs, ("skills",)).first()["missing"] == ["y"]
    assert E.with_unmatched(ev, blocks, pairs).count() == 4


def _components(spark, *rows):
    return spark.createDataFrame([("j", "r", n, v) for n, v in rows], "jd_id string, resume_id string, component string, raw double")


def test_components_are_checked(spark):
    four = [("skill", 10.0), ("work_experience", 20.0), ("education", 30.0), ("content_score", 40.0)]
    assert score.final_scores(_components(spark, *four)).first()["final"] == pytest.approx(27.0)
    for rows, what in ((four[:3], "missing content_score"), ([*four[:3], ("content_score", 150.0)], "outside 0 to 100 content_score"), ([*four[:3], ("content_score", -1.0)], "content_score")):
        with pytest.raises(Exception, match=what):
            score.final_scores(_components(spark, *rows)).collect()


def test_missing_evidence_and_flags(spark):
    ev = spark.createDataFrame([("j", "r", 1, 10, "skills", "skills", 0.8, "strong")], EV)
    blocks = spark.createDataFrame([("j", i, i, "skills" if i < 8 else "experience", f"must have t{i}") for i in range(1, 10)], "jd_id string, jd_block long, block_no int, section string, text string")
    pairs = spark.createDataFrame([("j", "r"), ("j", "nobody")], "jd_id string, resume_id string")
    comps = score.with_missing(score.components(ev, blocks, pairs), ev, blocks, pairs)
    lists = {(r["resume_id"], r["component"]): r["missing_evidence"] for r in comps.collect()}
    assert lists[("r", "skill")] == [f"must have t{i}" for i in range(2, 7)] and lists[("nobody", "work_experience")] == ["must have t8", "must have t9"]
    assert lists[("r", "education")] == ["No education requirements in JD"] and lists[("r", "content_score")] == []
    flags = {r["resume_id"]: r["flags"] for r in score.review_flags(comps, E.mandatory_counts(ev, blocks, pairs)).collect()}
    assert flags["r"][0] == "Missing evidence for skill: 5 items" and "Zero score for education: No education requirements found in JD" in flags["r"] and flags["r"][-1] == "Unmet mandatory requirements: 8"
    assert flags["nobody"][-1] == "Unmet mandatory requirements: 9"


def test_comparison_takes_the_greater_similarity(spark):
    ev = spark.createDataFrame([("j", "r", 1, 10, "skills", "other", 0.45, "weak"), ("j", "r", 2, 10, "skills", "contact", 0.9, "strong"), ("j", "r", 3, 10, "skills", "other", 0.31, "weak")], EV)
    blocks = spark.createDataFrame([("j", i, i, "skills", f"must have things {i}") for i in (1, 2, 3)], "jd_id string, jd_block long, block_no int, section string, text string")
    pairs = ev.select("jd_id", "resume_id").distinct()
    texts = spark.createDataFrame([("r", 10, "whole block", [4, 5])], "resume_id string, resume_block long, text string, source_lines array<int>")
    pinned = spark.createDataFrame([("j", "r", 1, "its sentence", [5], 0.7), ("j", "r", 3, "none", [5], 0.0)], "jd_id string, resume_id string, jd_block long, sentence string, lines array<int>, similarity double")
    got = {r["jd_block"]: r for r in E.comparison(ev, blocks, pairs, texts=texts, pinned=pinned).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["parameter_id"], one["status"], one["similarity"], one["confidence"], one["matched_text"], one["matched_lines"], one["match_strength"]) == ("param_001", "found", 0.7, 70.0, "its sentence", [5], "weak")
    assert (two["status"], two["similarity"], two["best_block"], two["match_strength"], two["resume_section"]) == ("not_found", 0.0, None, "none", "unknown")
    assert (three["status"], three["confidence"], three["matched_text"]) == ("not_found", 31.0, None) and three["explanation"].startswith("Requirement not met")
    plain = {r["jd_block"]: (r["status"], r["matched_text"], r["matched_lines"]) for r in E.comparison(ev, blocks, pairs, texts=texts).collect()}
    assert plain[1] == ("partial", "whole block", [4, 5])
    assert tuple(E.comparison_counts(ev, blocks, pairs, pinned=pinned).first())[2:] == (3, 1, 0, 2, 3, 1)


def test_candidates_are_cut_each(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 8))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [(f"r{i % 7}", i // 7, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "doc string, no int, v array<double>").repartition(3)
    q = spark.createDataFrame([("j", k, r[2]) for k, r in enumerate(rows[:5])], "doc string, no int, v array<double>")
    got = {}
    for r in retrieve.candidates_topk(q, df, "doc", "no", "v", 8, 2, 0.1).collect():
        got.setdefault((r["jd_block_no"], r["resume_id"]), []).append((r["resume_block_no"], round(r["score"], 9)))
    for k in range(5):
        for c in range(7):
            s = sorted(((-round(float(u[k] @ u[i]), 6), i // 7) for i in range(c, 120, 7) if u[k] @ u[i] >= 0.1))[:2]
            assert sorted(got.get((k, f"r{c}"), [])) == sorted((n, -v) for v, n in s)
    with pytest.raises(Exception, match="8 numbers, not 9"):
        retrieve.vector_topk(df, df.withColumn("i", F.lit(1)), "no", "v", 9, 2, strict=True).collect()


def test_hits_are_neither_shuffled_nor_written(spark):
    kind = "doc_id string, block_no int, section string, text string"
    jb = spark.createDataFrame([("j", 0, "skills", "python spark sql"), ("j", 1, "skills", "gardening")], kind)
    rb = spark.createDataFrame([("r", 0, "other", "python spark"), ("r", 1, "skills", "python spark java"), ("s", 0, "skills", "cooking")], kind)
    cfg = config.Config(retrieval=config.Retrieval(similarity_threshold=0.30, noise_floor=0.20, span=0.50))
    hits = E.grade(E.retrieve_pairs(jb, rb, cfg, 256, pipeline.WORDS.column), cfg)
    above = hits._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[0]
    assert "MapInArrow" in above and "Exchange" not in above and "Window" not in above
    got = sorted(tuple(r) for r in hits.select("jd_block_no", "resume_id", "resume_block_no", "rank", "strength").collect())
    assert got == [(0, "r", 0, 1, "strong"), (0, "r", 1, 2, "strong")]


def test_no_candidate_is_parted(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 4)
    docs = [*"aab", *"cccccc", *"dde"]
    rows = pa.record_batch({"doc": docs, "no": pa.array(range(12), pa.int32()), "section": docs, "terms": docs, "v": pa.array(np.eye(12).tolist())})
    packed = retrieve._pair_packer(12, ("res", "rno", "rsec", "rt", "rv"))(iter([rows.slice(0, 5), rows.slice(5)]))
    assert ["".join(b.column("res")[0].as_py()) for b in packed] == ["aab", "cccccc", "dde"]


def test_calibration(spark):
    df = spark.createDataFrame([(0.44,), (0.56,), (0.58,), (0.66,), (0.74,), (0.9,)], "d double")
    got = [(round(r[0], 4), r[1]) for r in df.select(E.calibrated(F.col("d")), E.strength(E.calibrated(F.col("d")))).collect()]
    assert got == [(0.0, "none"), (0.0, "none"), (0.325, "weak"), (0.525, "moderate"), (0.725, "strong"), (1.0, "strong")]
    boost = df.select(retrieve.boosted(F.lit(0.98), F.lit("skills"), F.lit("skills")), retrieve.boosted(F.lit(0.5), F.lit("unknown"), F.lit("unknown"))).first()
    assert tuple(boost) == (1.0, 0.5)


def test_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i long, v array<float>")
    got = {(r["query"], r["rank"]): r["item"] for r in retrieve.vector_topk(df.filter("i % 20 = 0"), df, "i", "v", 8, 3).collect()}
    u = x.astype(float) / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 300, 20):
        s = u @ u[q]
        s[q] = -9
        assert [got[(q, k)] for k in (1, 2, 3)] == list(np.argsort(-s)[:3])


def test_topk_of_more_copies_than_k_in_several_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8))
    x[rng.choice(900, 300, replace=False)] = x[0]  # one vector copied into a third of all rows
    ids = rng.permutation(900)  # in no order within the blocks
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "i long, v array<double>").repartition(3)
    got = {(r["query"], r["rank"]): r["item"] for r in retrieve.vector_topk(df.filter("i % 20 = 0"), df, "i", "v", 8, 5).collect()}
    order = np.argsort(ids)
    u = (x / np.linalg.norm(x, axis=1)[:, None])[order]
    for q in range(0, 900, 20):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        assert [got[(q, k)] for k in range(1, 6)] == list(np.lexsort((np.arange(900), -s))[:5])


def test_whole_match(spark):
    jd = "Requirements\nMust have Python and Kafka experience with large data platforms.\n\nResponsibilities\nBuild streaming pipelines in Python on Kafka for the data team.\n"
    good = "Skills\nPython, Kafka, streaming pipelines, data platforms.\n\nWork Experience\nBuilt streaming pipelines in Python on Kafka for a data team since 2015.\n"
    bad = "Work Experience\nGrew tomatoes and sold flowers on the market every Saturday.\n"
    jds = spark.createDataFrame([("j", jd)], "doc_id string, text string")
    resumes = spark.createDataFrame([("good", good), ("bad", bad), ("none", "")], "doc_id string, text string")
    cfg = config.Config(retrieval=config.Retrieval(similarity_threshold=0.2, noise_floor=0.1, span=0.5))
    out = pipeline.match(jds, resumes, cfg)
    finals = {r["resume_id"]: r["final"] for r in out["finals"].collect()}
    assert finals["good"] > finals.get("bad", 0) and "none" not in finals
    report = out["reports"].filter("resume_id = 'good'").first()["report"]
    assert report["candidate_score"]["final_score"] == pytest.approx(finals["good"], abs=0.01)
    import json

    from matchloom.operators import report as R

    text = json.loads(R.as_json(out["reports"].filter("resume_id = 'good'")).first()["json"])
    assert list(text) == R.RECRUITER_FIELDS and list(json.loads(R.as_json(out["reports"], brief=True).first()["json"])) == R.BRIEF_FIELDS
    assert text["comparison_parameters"] and text["strongest_matches"][0]["resume_text"] and text["processing_details"]["config_hash"] == R.config_hash() and len(text["candidate_score"]["components"]) == 4
    assert text["comparison_summary"]["total_parameters"] == len(text["comparison_parameters"]) == out["summary"].first()["total"] and text["recruiter_summary"].startswith("Overall Assessment: ")
    assert text["mandatory_requirements"][0]["best_match_text"] and all(w.startswith(("[JD] ", "[Resume] ")) for w in text["data_quality_warnings"])
    asked = spark.createDataFrame([("j", "good"), ("j", "none")], "jd_id string, resume_id string")
    named = {r["resume_id"]: r["final"] for r in pipeline.match(jds, resumes, cfg, pairs=asked)["finals"].collect()}
    assert named == pytest.approx({"good": finals["good"], "none": 0.0})
    assert {r["doc_id"]: r["status"] for r in out["quality"].collect()}["none"] == "error"
    again = {r["resume_id"]: r["final"] for r in pipeline.match(jds.repartition(3), resumes.repartition(5), cfg)["finals"].collect()}
    assert again == pytest.approx(finals)


def test_pinpoint(spark):
    best = spark.createDataFrame([("j", "r", 1, 10, [1.0, 0.0])], "jd_id string, resume_id string, jd_block long, best_block long, vec array<double>")
    sents = spark.createDataFrame(
        [("r", 10, 0, "Skills:", [1.0, 0.0]), ("r", 10, 1, "knows many good things", [0.6, 0.8]), ("r", 10, 2, "built it twice over", [0.8, 0.6]), ("r", 10, 3, "built it again later", [0.8, 0.6])],
        "resume_id string, resume_block long, sent_no int, text string, vec array<double>",
    )
    r = E.pinpoint(best, sents).first()
    assert (r["sent_no"], round(r["similarity"], 6)) == (2, 0.8)


def _docx(body):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buf.getvalue()


def test_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    (tmp_path / "ok.docx").write_bytes(_docx(p("First") + "<w:p/>" + f"<w:tbl>{row('a', 'b')}{row('', '')}</w:tbl>"))
    (tmp_path / "Mixed.PdF").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "broken.DOCX").write_bytes(b"PK\x03\x04garbage")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    (tmp_path / "note.txt").write_text("x")
    rows = files.validated(files.read_files(spark, str(tmp_path)))
    assert {r["file_name"]: r["status"] for r in rows.collect()} == {"ok.docx": "valid", "broken.DOCX": "valid", "empty.pdf": "error", "fake.pdf": "warning", "Mixed.PdF": "valid"}
    assert [r["path"].rsplit("/", 1)[1] for r in files.sorted_paths(rows).collect()] == ["Mixed.PdF", "broken.DOCX", "empty.pdf", "fake.pdf", "ok.docx"]
    out = files.extracted_lines(rows).collect()
    assert sorted((r["line_no"], r["text"]) for r in out if r["error"] is None) == [(1, "First"), (2, ""), (3, "a | b")]
    assert sum(r["error"] is not None for r in out) == 3


def test_pdf_pages_without_blocks_give_their_plain_text(monkeypatch):
    import sys
    import types

    class Page:
        def __init__(self, blocks, text):
            self.blocks, self.text = blocks, text

        def get_text(self, kind):
            return {"blocks": self.blocks} if kind == "dict" else self.text

    line = lambda t, x, y: {"bbox": (x, y, 9, 9), "spans": [{"text": t}]}
    pages = [Page([{"type": 0, "bbox": (0, 5, 9, 9), "lines": [line("second", 1, 5), line("first", 0, 5)]}, {"type": 1, "bbox": (0, 0, 1, 1)}], "unused"), Page([], "plain\n\ntext")]

    class Doc(list):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: Doc(pages)))
    assert files.pdf_lines(b"") == [(1, "first"), (1, "second"), (2, "plain"), (2, "text")]


def test_repository(spark, tmp_path):
    from matchloom.sources.store import ParquetRepository

    repo = ParquetRepository(spark, str(tmp_path / "repo"), ["k"], "k int, v string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert repo.list_all().count() == 0
    repo.save(spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "k int, v string"))
    repo.save(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted(map(tuple, repo.list_all().collect())) == [(1, "a"), (2, "c"), (3, "d")] and [r["v"] for r in repo.get(keys(2)).collect()] == ["c"]
    repo.delete(keys(1, 9))
    assert {r["k"]: r["found"] for r in repo.exists(keys(1, 2)).collect()} == {1: False, 2: True}
    repo.clear()
    assert repo.list_all().count() == 0


def test_vectors_are_kept_with_what_is_known_of_them(spark, tmp_path):
    from matchloom.sources.store import load_vectors, save_vectors

    df = spark.createDataFrame([(1, [0.5, 1.0], "a"), (2, None, "b")], "i int, vec array<float>, note string")
    save_vectors(df, str(tmp_path / "v"), "vec", 2, model="words")
    got, meta = load_vectors(spark, str(tmp_path / "v"), "vec", 2, model="words")
    assert meta == {"dim": 2, "model": "words"} and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        load_vectors(spark, str(tmp_path / "v"), "vec", 2, model="other")
    with pytest.raises(Exception, match="3 numbers"):
        save_vectors(df, str(tmp_path / "w"), "vec", 3)


def test_embedders(spark):
    import numpy as np

    from matchloom.functions.embed import Embedder, HashedEmbedder, ModelEmbedder

    df = spark.createDataFrame([("python kafka python",), ("Kafka Python",), ("",), (None,), ("the of",)], "t string").coalesce(1)
    words = HashedEmbedder(16)
    got = [r[0] for r in df.select(words.column(F.col("t"))).collect()]
    assert isinstance(words, Embedder) and got[0] == got[1] and sum(x * x for x in got[0]) == pytest.approx(1.0)
    assert all(x == 0 for g in (got[2], got[4]) for x in g)

    def load():
        return lambda texts: np.array([[len(t), 3.0] for t in texts])

    vec = [r[0] for r in df.select(ModelEmbedder("lengths", load, 2, batch=1).column(F.col("t"))).collect()]
    n = (19 * 19 + 9) ** 0.5
    assert vec[0] == pytest.approx([19 / n, 3 / n]) and vec[2] == vec[3] == [0.0, 0.0]
    with pytest.raises(Exception, match="numbers"):
        df.select(ModelEmbedder("lengths", load, 3).column(F.col("t"))).collect()


def test_settings(tmp_path):
    base = tmp_path / "a.yaml"
    base.write_text("weights: {skill: 0.25, work_experience: 0.25, education: 0.25, content_score: 0.25}\nretrieval: {top_k: 5}\n")
    c = config.load_config(str(base), environ={"MATCHLOOM__RETRIEVAL__TOP_K": "7"})
    assert c.retrieval.top_k == 7 and c.weights.skill == 0.25 and c.segmentation.max_words == 40
    with pytest.raises(ValueError):
        config.Weights(skill=0.9)
    with pytest.raises(ValueError):
        config.load_config(overrides={"retrieval": {"nope": 1}}, environ={})


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "doc_id string, text string"
    spark.createDataFrame([("a", "x\ny")], schema).write.parquet(str(src / "1"))
    from matchloom.operators import segment

    for n in (1, 2):
        q = process_stream(spark, str(src / "*"), schema, segment.index_lines, str(out), str(tmp_path / "cp"))
        q.awaitTermination(60)
        if n == 1:
            spark.createDataFrame([("b", "z")], schema).write.parquet(str(src / "2"))
    got = sorted((r["doc_id"], r["line_no"]) for r in spark.read.parquet(str(out)).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_plans_are_as_meant(spark):
    from matchloom.plans import catalog

    def plan(name):
        return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan("detect_headings")
    assert "WindowGroupLimit" in plan("strongest_matches")
    text = plan("final_score")
    assert "CartesianProduct" not in text and "Python" not in text
    assert "Python" not in plan("paragraphs") and "Python" not in plan("split_sentences")


@pytest.mark.parametrize("name", ["match_scores", "match_finals"])
def test_scores_make_nothing_else(spark, monkeypatch, name):
    from matchloom.operators import report
    from matchloom.plans import catalog

    for module, made in ((report, "reports"), (pipeline, "sentence_matches"), (E, "comparison"), (pipeline, "embedded")):
        monkeypatch.setattr(module, made, lambda *a, made=made, **k: pytest.fail(f"{made} is not asked for"))
    assert "final" in catalog.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_texts_filled_in_last_are_those_of_whole_rows(spark):
    from matchloom.operators import report

    ev = spark.createDataFrame([("j", "r", 1, 10, "skills", "skills", 0.8, "strong"), ("j", "r", 1, 11, "skills", "other", 0.5, "moderate"), ("j", "r", 3, 11, "experience", "other", 0.35, "weak"), ("j", "s", 2, 20, "skills", "skills", 0.0, "none")], EV)
    kind = "jd_id string, jd_block long, block_no int, section string, text string, source_lines array<int>"
    jd = spark.createDataFrame([("j", i, i, "skills" if i < 3 else "experience", f"you must have much of t{i} " + "x" * 300, [i, i + 1]) for i in range(1, 6)], kind)
    res = spark.createDataFrame([("r", 10, "aa bb cc", [1]), ("r", 11, "dd ee ff", [2]), ("s", 20, "gg", [3])], "resume_id string, resume_block long, text string, source_lines array<int>")
    pairs = ev.select("jd_id", "resume_id").distinct()
    docs = spark.createDataFrame([("j", "j.pdf"), ("r", "r.pdf"), ("s", None)], "doc_id string, source_filename string")
    years = pairs.withColumn("required", F.lit(4)).withColumn("candidate", F.lit(2))
    own = res.select("resume_block", F.col("text").alias("resume_text"), F.col("source_lines").alias("resume_lines"))
    full = ev.filter("strength <> 'none'").join(own, "resume_block").withColumn("explanation", E.explanation()).withColumn("uncertain", F.col("strength") == "weak")
    whole = full.join(jd.select("jd_block", F.left("text", F.lit(200)).alias("jd_text"), F.col("source_lines").alias("jd_lines")), "jd_block")
    comps = score.components(ev, jd, pairs, years)
    want = report.reports(score.final_scores(comps), score.with_missing(comps, ev, jd, pairs), E.mandatory(ev, jd, pairs, texts=res), E.comparison(ev, jd, pairs, texts=res), whole, jd, pipeline.details_of(pairs, docs, jd, docs, res))
    sides = [pipeline.details_of_documents(docs, b, n).withColumn(y, F.lit(k)) for n, b, y, k in (("jd", jd, "required", 4), ("resume", res, "candidate", 2))]
    params, must = E.comparison(ev, jd, pairs, texts=res, late=True), E.mandatory(ev, jd, pairs, texts=res, late=True)
    assert params.filter("requirement_text is not null or source_jd_lines is not null").isEmpty() and must.filter("requirement_text is not null").isEmpty()
    got = report.reports(None, None, must, params, full, jd, None, late=(score.pair_facts(ev, jd), score.asked_of(jd), *sides))
    assert sorted(map(tuple, report.as_json(got).collect())) == sorted(map(tuple, report.as_json(want).collect()))


@pytest.mark.parametrize("simple", [True, False])
def test_whole_documents_hold_the_blocks_of_processed_ones(spark, simple):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["", "\n \n", "Skills:", "skills\npython, sql and much more of it\n\n\n\nEXPERIENCE\r\n- did a. Then b!\r\n- did c", None, "2019 - 2020 " + "word " * 200, "no heading. Page 3\nEducation -\nx"]
    docs = docs.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], docs.schema)).repartition(3)
    got = pipeline.each_block(pipeline.whole(docs, simple=simple))
    want = pipeline.processed(docs, simple=simple)["blocks"].select("doc_id", "block_no", "section", "text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the documents, or of their lines
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("top_k", [20, 1])
def test_sums_of_pairs_give_the_scores_of_their_evidence(spark, top_k):
    from matchloom.config import Retrieval

    cfg = config.Config(retrieval=Retrieval(top_k=top_k, similarity_threshold=0.1, noise_floor=0.05, span=0.4))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id <= 30")
    jds, resumes = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 > 0")
    got = pipeline.scored(jds, resumes, cfg)
    assert "hashpartitioning(resume_id" not in got._jdf.queryExecution().executedPlan().toString()  # no hit is shuffled
    jb, rb = (pipeline.processed(d, cfg)["blocks"] for d in (jds, resumes))
    ev = pipeline.scored(jds, resumes, cfg, finals=False)
    pairs = ev.select("jd_id", "resume_id").distinct()
    jd_blocks = jb.select(F.col("doc_id").cast("string").alias("jd_id"), F.col("block_no").alias("jd_block"), "block_no", "section", "text")
    years = pairs.join(pipeline.years_of(jb, "jd_id", X.required_years, "required"), "jd_id", "left").join(pipeline.years_of(rb, "resume_id", X.candidate_years, "candidate"), "resume_id", "left")
    want = score.ranked(score.final_scores(score.components(ev, jd_blocks, pairs, years)))
    assert got.columns == want.columns
    rows = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert rows(got) == rows(want) and len({r["final"] for r in got.collect()}) > 20


def test_terms_in_common_where_places_are_shared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from matchloom.operators import retrieve

    monkeypatch.setattr(retrieve, "TERM_PLACES", 2)
    monkeypatch.setattr(retrieve, "BIT_ROWS", 3)
    q, x = ["a b c", "", None, "d e"], ["c", "e z", "", "f a", "b d"]
    r, c = (a.ravel() for a in np.meshgrid(range(4), range(5), indexing="ij"))
    want = [bool(set((q[i] or "").split()) & set(x[j].split())) for i, j in zip(r, c, strict=True)]
    assert retrieve._common_terms(pa.array(q), pa.array(x))(r, c).tolist() == want
    assert not retrieve._common_terms(pa.array([None, ""]), pa.array(x))(np.array([0, 1]), np.array([0, 4])).any()


def test_points_round_as_the_jvm_does(spark):
    import numpy as np

    cfg = config.Config()
    dense = np.round(np.arange(0.45, 0.9, 0.000005), 6)
    points, real = E.points_of(cfg)(dense, np.zeros(len(dense)), lambda i: np.zeros(len(i), bool))
    df = spark.createDataFrame([(float(x),) for x in dense], "d double").select(E.calibrated(F.col("d"), None, cfg.retrieval, cfg.thresholds).alias("e"))
    want = df.select(F.round("e", 4).alias("s"), (E.strength(F.col("e")) != "none").alias("r")).collect()
    assert (points / 10000).tolist() == [r["s"] for r in want] and real.tolist() == [r["r"] for r in want]


def test_similarities_are_exact_to_the_sixth_digit(spark):
    """Vectors in single precision gave 0.355579 for the first one."""
    from decimal import Decimal

    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    cfg = config.Config(retrieval=config.Retrieval(similarity_threshold=0.30, noise_floor=0.20, span=0.50))
    got = pipeline.scored(docs.filter("doc_id = 343"), docs.filter("doc_id = 13"), cfg, simple=True, finals=False)
    assert [r["dense"] for r in got.filter("jd_block = 2 and resume_block = 2").collect()] == [0.35558]
    rows = [[3, -3, 7, 9, 9], [], [1, 1, 1, -2] * 3000, [9, 7, -8, 2], None, [9, 9, 7, 1, 3]]
    counts = [[sum((p > 0) - (p < 0) for p in r or [] if abs(p) == i) for i in range(1, 10)] for r in rows]
    packed = retrieve._read(retrieve._stored(pa.array(rows, pa.list_(pa.int16())), 9), 9, True)
    found = {(r, c): s for r, c, s in zip(*retrieve._similar(packed, packed, 0.3)(0, len(rows)), strict=True)}
    want = {}
    for a, x in enumerate(counts):
        for b, y in enumerate(counts):
            n = Decimal(sum(i * i for i in x) * sum(i * i for i in y)).sqrt()
            if n and (s := round(float(sum(i * j for i, j in zip(x, y, strict=True)) / n), 6)) >= 0.3:
                want[a, b] = s
    assert found == want and len(want) > 6
