"""Pieces of the queries' SQL, for an engine with RE2 patterns; they follow the rules, not the plans."""

from __future__ import annotations

from matchloom import dims
from matchloom.functions import text as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {has(c, f'^{X.WS}*$')})"


def trim(c: str) -> str:
    return sub(c, f"^{X.WS}+|{X.WS}+$", "")


def mojibake(c: str) -> str:
    for bad, good in dims.MOJIBAKE:
        c = f"replace({c}, {q(bad)}, {q(good)})"
    return c


def clean(c: str) -> str:
    return trim(sub(f"replace({sub(mojibake(c), X.CONTROL, '')}, chr(9), ' ')", " {2,}", " "))


def artifact(c: str) -> str:
    return "(" + " OR ".join(has(trim(c), p) for p in X.ARTIFACTS) + ")"


def bullets(c: str) -> str:
    return f"regexp_replace({c}, {q(X.BULLET)}, '• ')"


def punctuation(c: str) -> str:
    for a, b in zip("‘’“”", "''\"\"", strict=True):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return sub(f"replace(replace({c}, '—', ' - '), '–', ' - ')", " {2,}", " ")


def split_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {q(X.WS + '+')}), lambda w: w <> '')"


def words(c: str) -> str:
    return f"len({split_words(c)})::INT"


def list_item(c: str) -> str:
    return has(c, X.BULLET + r"\S")


def caps(c: str) -> str:
    return f"({has(c, chr(92) + 'p{Lu}')} AND NOT {has(c, chr(92) + 'p{Ll}')})"


def heading_shape(c: str) -> str:
    t, n = trim(c), words(c)
    title = rf"({has(t, r'\p{Lu}')} AND NOT {has(t, r'[\p{Lu}\p{Ll}]\p{Lu}')} AND NOT {has(t, r'(?:^|[^\p{Lu}\p{Ll}])\p{Ll}')})"
    return (
        f"(({caps(t)} AND {n} BETWEEN 1 AND 6 AND length({t}) <= 60) OR ({t} LIKE '%:' AND {n} BETWEEN 1 AND 5 AND length({t}) <= 50) "
        rf"OR ({n} BETWEEN 1 AND 4 AND length({t}) <= 40 AND {has(t, r'^\p{Lu}')} AND NOT {has(t, r'[0-9]|\.$')} AND {title}))"
    )


LINES = "lines AS (SELECT doc_id, unnest(generate_series(1, len(s)))::INT AS line_no, unnest(s) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS s FROM documents WHERE text IS NOT NULL))"

_ALIASES = "(VALUES " + ", ".join(f"({q(a)}, {q(s)})" for s, names in dims.SECTION_ALIASES.items() for a in names) + ")"
_KEY = sub(sub(f"lower({trim('text')})", f"{X.WS}+", " "), r"[.\-;]+$", "")
HEADINGS = f"""
  cand AS (SELECT doc_id, line_no, {trim('text')} AS t, {_KEY} AS k FROM lines WHERE NOT {blank('text')} AND length({trim('text')}) <= 80),
  keyed AS (SELECT *, {trim(sub('k', ':$', ''))} AS alias, k LIKE '%:' AS colon FROM cand WHERE NOT (t LIKE '%:%' AND t NOT LIKE '%:')),
  heads AS (SELECT doc_id, line_no, coalesce(section, 'other') AS section, t AS heading_text,
    CASE WHEN section IS NOT NULL AND NOT colon THEN 0.95::DOUBLE WHEN section IS NOT NULL THEN 0.90 WHEN {caps('t')} AND {words('t')} BETWEEN 2 AND 5 AND length(t) <= 50 THEN 0.60 WHEN t LIKE '%:' AND {words('t')} <= 5 AND length(t) <= 50 THEN 0.55 END AS confidence,
    CASE WHEN section IS NOT NULL AND NOT colon THEN 'alias_match' WHEN section IS NOT NULL THEN 'alias_colon_match' WHEN {caps('t')} AND {words('t')} BETWEEN 2 AND 5 AND length(t) <= 50 THEN 'caps_pattern' WHEN t LIKE '%:' AND {words('t')} <= 5 AND length(t) <= 50 THEN 'colon_pattern' END AS method
    FROM keyed LEFT JOIN {_ALIASES} AS a(alias, section) USING (alias)
    WHERE section IS NOT NULL OR ({caps('t')} AND {words('t')} BETWEEN 2 AND 5 AND length(t) <= 50) OR (t LIKE '%:' AND {words('t')} <= 5 AND length(t) <= 50))"""

PARAGRAPHS = f"""
  flagged AS (SELECT doc_id, line_no, {trim('text')} AS t FROM lines WHERE NOT {blank('text')}),
  alone AS (SELECT *, ({list_item('t')} OR {heading_shape('t')}) AS alone FROM flagged),
  begun AS (SELECT *, (alone OR coalesce(lag(alone) OVER (PARTITION BY doc_id ORDER BY line_no), true))::INT AS b FROM alone),
  numbered AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS para_no FROM begun),
  paras AS (SELECT doc_id, para_no, string_agg(t, ' ' ORDER BY line_no) AS text, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS source_lines, min(line_no) AS first_line, bool_or(alone) AS standalone FROM numbered GROUP BY 1, 2)"""


def _protected(c: str) -> str:
    for p, r in X.PROTECT:
        c = sub(c, p, r.replace("$", "\\"))
    return c


_MARKED = sub(_protected("text"), r"([.!?])\s+([A-Z])", "\\1" + X.CUT + "\\2")
_PARTS = f"list_filter(list_transform(string_split(replace({sub(_MARKED, f'{X.S}|{X.E}', '')}, '{X.W}', ' '), '{X.CUT}'), lambda w: {trim('w')}), lambda w: w <> '')"
SENTENCES = f"""
  cutup AS (SELECT doc_id, para_no, CASE WHEN standalone THEN [text] ELSE {_PARTS} END AS p FROM paras),
  sents AS (SELECT doc_id, para_no, (unnest(generate_series(1, len(p))) - 1)::INT AS part_no, unnest(p) AS text FROM cutup)"""

_CONJ = sub("text", r",\s+((?:and|or|but|which|where|while)(?:$|[^A-Za-z0-9_]))", X.CUT + "\\1")


def _kept(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda w: {trim('w')}), lambda w: w <> '')"


OVERSIZED = f"""
  long AS (SELECT doc_id, para_no, regexp_split_to_array(text, ';\\s*') AS by_semi, string_split({_CONJ}, '{X.CUT}') AS conj, regexp_split_to_array(text, ',\\s+') AS comma, {split_words('text')} AS ws FROM paras WHERE {words('text')} > 40),
  cuts AS (SELECT doc_id, para_no, CASE WHEN len(by_semi) > 1 THEN {_kept('by_semi')} WHEN len(conj) > 1 THEN {_kept('conj')} WHEN len(comma) > 1 THEN {_kept('comma')}
    ELSE list_transform(generate_series(0, (len(ws) - 1) // 40), lambda i: array_to_string(list_slice(ws, i * 40 + 1, i * 40 + 40), ' ')) END AS p FROM long),
  parts AS (SELECT doc_id, para_no, (unnest(generate_series(1, len(p))) - 1)::INT AS part_no, unnest(p) AS part FROM cuts)"""

#: The packing rule as a recursion over a document's parts, and the merging of short blocks by the parity of their runs.
_COMMA = "regexp_split_to_array(s.text, ',\\s+')"
_SEMI = "regexp_split_to_array(s.text, ';\\s*')"
_CONJ_S = f"string_split({_CONJ.replace('(text,', '(s.text,')}, '{X.CUT}')"
_WORDS_S = split_words("s.text")
PACKED = f"""
  breaks AS (SELECT doc_id, list(DISTINCT line_no) AS hl FROM heads GROUP BY 1),
  sn AS (SELECT s.doc_id, s.para_no, s.part_no, s.text, {words('s.text')} AS n, string_split(p.source_lines, ',')::INT[] AS nos,
      CASE WHEN {words('s.text')} <= 40 THEN [s.text] WHEN len({_SEMI}) > 1 THEN {_kept(_SEMI)} WHEN len({_CONJ_S}) > 1 THEN {_kept(_CONJ_S)} WHEN len({_COMMA}) > 1 THEN {_kept(_COMMA)}
        ELSE list_transform(generate_series(0, (len({_WORDS_S}) - 1) // 40), lambda i: array_to_string(list_slice({_WORDS_S}, i * 40 + 1, i * 40 + 40), ' ')) END AS parts
    FROM sents s JOIN paras p ON p.doc_id = s.doc_id AND p.para_no = s.para_no),
  pk AS (SELECT doc_id, para_no, part_no, n, nos, unnest(generate_series(1, len(parts))) AS k, unnest(parts) AS part FROM sn),
  pr AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY para_no, part_no, k) AS idx, k = 1 AS first, n, {words('part')} AS m, nos, list_min(nos) AS lo, list_max(nos) AS hi, coalesce(list_has_any(nos, b.hl), false) AS brk, part FROM pk p LEFT JOIN breaks b ON b.doc_id = p.doc_id),
  fold AS (SELECT doc_id, idx, 0::BIGINT AS block, m::BIGINT AS cnt, hi, true AS lead FROM pr WHERE idx = 1
    UNION ALL SELECT doc_id, idx, CASE WHEN opens THEN block + 1 ELSE block END, CASE WHEN opens THEN m ELSE cnt + m END, hi, CASE WHEN opens THEN first AND topic ELSE lead END FROM (
      SELECT p.doc_id, p.idx, f.block, f.cnt, p.m, p.hi, p.first, f.lead, (p.brk OR p.lo - f.hi > 2) AS topic, CASE WHEN p.first THEN p.brk OR p.lo - f.hi > 2 OR f.cnt + p.n > 40 ELSE f.cnt + p.m > 40 END AS opens
      FROM fold f JOIN pr p ON p.doc_id = f.doc_id AND p.idx = f.idx + 1)),
  full0 AS (SELECT f.doc_id, f.block, string_agg(p.part, ' ' ORDER BY p.idx) AS text, list_sort(list_distinct(flatten(list(p.nos)))) AS nos, sum(p.m) AS words, bool_or(p.brk) AS opens, arg_min(f.lead, f.idx) AS lead FROM fold f JOIN pr p ON p.doc_id = f.doc_id AND p.idx = f.idx GROUP BY 1, 2),
  nexts AS (SELECT *, lead(text) OVER w AS ntext, lead(nos) OVER w AS nnos, coalesce(length(text) < 20 AND NOT lead(opens) OVER w AND words + lead(words) OVER w <= 40, false) AS takes FROM full0 WINDOW w AS (PARTITION BY doc_id ORDER BY block)),
  runs AS (SELECT *, block - 1 - coalesce(max(CASE WHEN NOT takes THEN block END) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS run FROM nexts),
  packed AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS block_no, CASE WHEN takes THEN text || ' ' || ntext ELSE text END AS text, CASE WHEN takes THEN list_sort(list_distinct(list_concat(nos, nnos))) ELSE nos END AS nos, lead AS topic_boundary FROM runs WHERE run % 2 = 0)"""

BLOCKS = "bl AS (SELECT block_id, any_value(doc_id) AS doc_id, any_value(doc_type) AS doc_type, any_value(block_no) AS block_no, any_value(text) AS text, any_value(lower(trim(block_section))) AS section, any_value(source_lines) AS source_lines FROM blocks GROUP BY 1)"
POSITION = """
  SELECT block_id, round(CASE WHEN n > 0 THEN least(list_sum(nos) / n / total, 1.0) ELSE 0 END, 6)::DOUBLE AS position
  FROM (SELECT block_id, nos, coalesce(len(nos), 0) AS n, total FROM
    (SELECT block_id, doc_id, list_distinct(list_filter(source_lines, lambda x: x IS NOT NULL)) AS nos FROM bl)
    JOIN (SELECT document_id AS doc_id, len(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS total FROM documents) USING (doc_id))"""


def signal(i: int, c: str) -> str:
    return has(c, ("" if i == 7 else "(?i)") + dims.SIGNALS[i][2])


def signal_list(c: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {signal(i, c)} THEN '{i}' END" for i in range(len(dims.SIGNALS))) + ")"


def secondary(section: str, c: str) -> str:
    return f"CASE WHEN {section} IN ('unknown', 'other') THEN NULL " + " ".join(f"WHEN {section} <> '{s}' AND {signal(i, c)} THEN '{s}'" for i, (s, _, _) in enumerate(dims.SIGNALS)) + " END"


def reclassified(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {signal(i, c)} THEN '{s}'" for i, (s, _, _) in enumerate(dims.SIGNALS) if s in ("experience", "education", "skills")) + " END"


def mandatory(c: str) -> str:
    return has(c, rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{dims.MANDATORY})(?:$|[^\p{{L}}\p{{N}}_])")


def requirement_words(c: str) -> str:
    return has(f"lower({c})", "|".join(dims.REQUIREMENT_KEYWORDS))


def terms(c: str) -> str:
    stop = ", ".join(q(w) for w in dims.STOP_WORDS)
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9+#]+'), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w))))"


def embed_text(c: str) -> str:
    stripped = f"regexp_replace({trim(c)}, {q(rf'(?i)^(?:{dims.HEADING_PREFIX})' + chr(92) + 's*[:' + chr(92) + '-–—]?' + chr(92) + 's*')}, '')"
    return f"CASE WHEN {stripped} = '' THEN {c} ELSE {stripped} END"


def required_years(c: str) -> str:
    return rf"coalesce(try_cast(regexp_extract({c}, '(?i)([0-9]+)\+?\s*years?', 1) AS INT), 0)"


def candidate_years(c: str) -> str:
    spaced = f"'  ' || {sub(c, r'[^\p{L}\p{N}_]+', '  ')} || '  '"
    ys = f"list_transform(regexp_extract_all({spaced}, ' ((?:20|19)[0-9]{{2}}) ', 1), lambda y: y::INT)"
    return (
        rf"coalesce(try_cast(regexp_extract({c}, '(?i)([0-9]+)\+?\s*years?\s*(?:of\s*)?experience', 1) AS INT), "
        f"CASE WHEN len({ys}) > 0 THEN greatest(1, CASE WHEN regexp_matches(lower({c}), 'present|current') THEN 2026 ELSE list_max({ys}) END - list_min({ys})) END, 1)"
    )


def sanitised(c: str) -> str:
    t = sub(sub(f"replace(replace(replace({c}, '..', ''), '/', '_'), chr(92), '_')", r"[^\p{L}\p{N}_\s.\-]", "_"), r"[_\s\p{Z}]+", "_")
    stem = sub(f"regexp_replace({t}, {q(r'([^.])\.[^.]+$')}, {q(chr(92) + '1')})", r"^[_.]+|[_.]+$", "")
    return f"(CASE WHEN {stem} = '' THEN 'unnamed' ELSE {stem} END || regexp_extract({t}, {q(r'[^.](\.[^.]+)$')}, 1))"


def _thirds(base: str, n: str) -> str:
    """base and n times 0.3, added one by one as the rule does."""
    cases, total = "", base
    for k in range(1, 5):
        total = f"{total} + 0.3::DOUBLE"
        cases += f" WHEN {k} THEN {total}"
    return f"(CASE {n}{cases} ELSE {base} END)"


def _prior(section: str) -> str:
    return "CASE WHEN " + " OR ".join(f"({section} = '{s}' AND pos BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE)" for s, lo, hi in dims.POSITION_PRIORS) + " THEN 1 ELSE 0 END"


_KINDS = tuple(dict.fromkeys(s for s, _, _ in dims.SIGNALS))
_COUNTS = {k: " + ".join(f"({signal(i, 'text')})::INT" for i, (s, _, _) in enumerate(dims.SIGNALS) if s == k) for k in _KINDS}
_FIRST = {k: min(i for i, (s, _, _) in enumerate(dims.SIGNALS) if s == k) for k in _KINDS}
#: The inference as a recursion over a document's blocks: it sees what the three before were set to, and what the three
#: after came in as.
INFERRED = f"""
  tot AS (SELECT doc_id, max(line_no) AS total FROM lines GROUP BY 1),
  placed AS (SELECT k.doc_id, block_no, text, nos, least(list_sum(nos)::DOUBLE / len(nos) / total, 1.0::DOUBLE) AS pos, list_min(nos) AS first_line FROM packed k JOIN tot t ON t.doc_id = k.doc_id),
  came AS (SELECT p.*, coalesce(h.section, 'unknown') AS g FROM placed p ASOF LEFT JOIN heads h ON p.doc_id = h.doc_id AND p.first_line >= h.line_no),
  counted AS (SELECT *, {', '.join(f'({c})::INT AS n_{k}' for k, c in _COUNTS.items())}, {reclassified('text')} AS strong, {secondary('g', 'text')} AS secondary, lead(g, 1) OVER w AS a1, lead(g, 2) OVER w AS a2, lead(g, 3) OVER w AS a3 FROM came WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
  voted AS (SELECT *, list_sort(list_filter([{', '.join(f"{{'m': -({_thirds('0::DOUBLE', f'n_{k}')} + 0.1::DOUBLE * {_prior(q(k))}), 'f': {_FIRST[k]}, 'k': '{k}', 'n': n_{k}}}" for k in _KINDS)}], lambda x: x.n > 0)) AS ks FROM counted),
  step AS MATERIALIZED (SELECT *, CASE WHEN a1 <> 'unknown' THEN {{'s': a1, 'c': 0.3::DOUBLE, 'o': 1}} WHEN a2 <> 'unknown' THEN {{'s': a2, 'c': 0.3::DOUBLE - 0.1::DOUBLE, 'o': 2}} WHEN a3 <> 'unknown' THEN {{'s': a3, 'c': 0.1::DOUBLE, 'o': 3}} END AS ahead FROM voted),
  infer AS (SELECT doc_id, -1 AS block_no, NULL::VARCHAR AS now, NULL::VARCHAR AS p1, NULL::VARCHAR AS p2, NULL::VARCHAR AS p3, NULL::VARCHAR AS best, NULL::DOUBLE AS conf, 0 AS near FROM (SELECT DISTINCT doc_id FROM step)
    UNION ALL SELECT doc_id, block_no, now, now AS p1, p1 AS p2, p2 AS p3, best, conf, near FROM (
      SELECT *, CASE WHEN g = 'other' AND strong IS NOT NULL THEN strong WHEN g NOT IN ('unknown', 'other') THEN g WHEN conf >= 0.5 THEN best ELSE g END AS now FROM (
        SELECT *, CASE WHEN skipped THEN NULL WHEN nb.s IS NULL AND o.k IS NULL THEN 'unknown' WHEN o.k IS NULL OR nb.s IS NOT NULL AND nsc >= -o.m THEN nb.s ELSE o.k END AS best,
          CASE WHEN skipped THEN NULL WHEN nb.s IS NULL AND o.k IS NULL THEN 0 WHEN o.k IS NULL OR nb.s IS NOT NULL AND nsc >= -o.m THEN least(nsc, 1.0) ELSE least(-o.m, 1.0) END AS conf, CASE WHEN nb.s IS NOT NULL AND NOT skipped THEN 1 ELSE 0 END AS near FROM (
          SELECT *, list_filter(ks, lambda x: nb.s IS NULL OR x.k <> nb.s)[1] AS o, {_thirds('nb.c', "coalesce(list_filter(ks, lambda x: x.k = nb.s)[1].n, 0)")} + 0.1::DOUBLE * ({_prior('nb.s')}) AS nsc FROM (
            SELECT t.doc_id, t.block_no, t.g, t.strong, t.ks, t.pos, f.p1, f.p2, f.p3, (t.g NOT IN ('unknown', 'other') OR t.g = 'other' AND t.strong IS NOT NULL) AS skipped,
              CASE WHEN f.p1 <> 'unknown' THEN {{'s': f.p1, 'c': 0.4::DOUBLE, 'o': 1}} WHEN f.p2 <> 'unknown' THEN {{'s': f.p2, 'c': 0.4::DOUBLE - 0.1::DOUBLE, 'o': 2}} WHEN f.p3 <> 'unknown' THEN {{'s': f.p3, 'c': 0.4::DOUBLE - 2 * 0.1::DOUBLE, 'o': 3}} ELSE t.ahead END AS nb
            FROM infer f JOIN step t ON t.doc_id = f.doc_id AND t.block_no = f.block_no + 1)))))"""
INFERRED_ROWS = f"""
  SELECT t.doc_id, t.block_no, i.now AS section, i.best AS inferred_section, round(i.conf, 6) AS confidence, coalesce(i.conf < 0.5, false) AS review_flag, t.g = 'other' AND t.strong IS NOT NULL AS reclassified_from_other, t.secondary AS secondary_section, round(t.pos, 6) AS position,
    CASE WHEN i.best IS NULL THEN -1 ELSE i.near + {' + '.join(f'n_{k}' for k in _KINDS)} END::INT AS signs
  FROM step t JOIN infer i ON i.doc_id = t.doc_id AND i.block_no = t.block_no"""


LABEL_SECTIONS = ("skills", "experience", "education", "summary", "projects", "certifications", "contact", "responsibilities", "requirements", "unknown")
_LABEL = "(CASE label " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(LABEL_SECTIONS)) + " END)"
TOPK = """
  unit AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)),
  topk AS (SELECT query, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, item)::INT AS rank
    FROM (SELECT a.vec_id AS query, b.vec_id AS item, list_inner_product(a.u, b.u) AS score FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 20)"""
BLOCK_TOPK = """
  usable AS (SELECT block_id, any_value(embedding::DOUBLE[]) AS v FROM block_vectors WHERE len(embedding) = 64 GROUP BY 1),
  unit AS (SELECT block_id, list_transform(v, lambda x: x / n) AS u FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM usable) WHERE n > 0),
  topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, item)::INT AS rank
    FROM (SELECT a.block_id AS query, b.block_id AS item, list_inner_product(a.u, b.u) AS score FROM unit a JOIN unit b ON a.block_id <> b.block_id WHERE a.block_id % 20 = 0)) WHERE rank <= 5)"""
BOOST = f"""
  sec AS (SELECT vec_id, {_LABEL} AS section FROM embeddings),
  boost AS (SELECT query, item, CASE WHEN a.section = b.section AND a.section <> 'unknown' THEN least(score + 0.05, 1.0) ELSE score END AS boosted
    FROM topk JOIN sec a ON a.vec_id = query JOIN sec b ON b.vec_id = item WHERE score >= 0.15 AND b.section <> 'contact')"""


def _strength(c: str) -> str:
    return f"CASE WHEN {c} >= 0.7 THEN 'strong' WHEN {c} >= 0.5 THEN 'moderate' WHEN {c} >= 0.3 THEN 'weak' ELSE 'none' END"


GRADED = f"graded AS (SELECT query, item, score, {_strength('score')} AS strength FROM (SELECT query, item, CASE WHEN raw >= 0.3 THEN raw ELSE 0 END AS score FROM (SELECT *, least(1.0, greatest(0.0, (boosted - 0.1::DOUBLE) / 0.3::DOUBLE)) AS raw FROM boost)))"
EVIDENCE = f"""
  ev AS (SELECT j.doc_id AS jd_id, r.doc_id AS resume_id, e.jd_block_id AS jd_block, e.resume_block_id AS resume_block, j.section AS jd_section, r.section AS resume_section, score, {_strength('score')} AS strength
    FROM (SELECT DISTINCT evidence_id, jd_block_id, resume_block_id, similarity_score AS score FROM evidence WHERE jd_block_id IS NOT NULL AND NOT isnan(similarity_score) AND similarity_score BETWEEN 0 AND 1) e
    JOIN bl j ON j.block_id = e.jd_block_id JOIN bl r ON r.block_id = e.resume_block_id),
  pairs AS (SELECT DISTINCT jd_id, resume_id FROM ev)"""
BEST = "best AS (SELECT jd_id, resume_id, jd_block, any_value(jd_section) AS section, max(score) AS best FROM ev WHERE strength <> 'none' GROUP BY 1, 2, 3)"
JD = "jd AS (SELECT doc_id AS jd_id, block_id AS jd_block, block_no, section, coalesce(text, '') AS text FROM bl WHERE doc_type = 'job_description')"


def _in(names: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


_OWN = " UNION ALL ".join(f"SELECT jd_id, jd_block, '{c}' AS component FROM jd WHERE section IN {_in(s)}" for c, s in dims.COMPONENTS.items())
COMPONENTS = f"""
  other AS (SELECT jd_id, bool_or(section NOT IN {_in(dims.CONTENT_EXCLUDES)}) AS has_other FROM jd GROUP BY 1),
  members AS ({_OWN} UNION ALL SELECT jd_id, jd_block, 'content_score' FROM jd JOIN other USING (jd_id) WHERE CASE WHEN has_other THEN section NOT IN {_in(dims.CONTENT_EXCLUDES)} ELSE section <> 'contact' END),
  need AS (SELECT jd_id, component, count(*) AS relevant FROM members GROUP BY 1, 2),
  got AS (SELECT jd_id, resume_id, component, count(*) AS matched, avg(best) AS mean, sum(CASE WHEN best >= 0.7 THEN 1.0::DOUBLE WHEN best >= 0.5 THEN 0.7 WHEN best >= 0.3 THEN 0.35 ELSE 0 END) AS credit FROM best JOIN members USING (jd_id, jd_block) GROUP BY 1, 2, 3),
  comps AS (SELECT jd_id, resume_id, component, coalesce(relevant, 0) AS relevant, coalesce(matched, 0) AS matched,
    least(100, greatest(0, 100 * (coalesce(mean, 0) * CASE component WHEN 'content_score' THEN 0.5::DOUBLE ELSE 0.6 END + coalesce(credit / relevant, 0) * CASE component WHEN 'content_score' THEN 0.5::DOUBLE ELSE 0.4 END)
      * CASE WHEN component = 'work_experience' AND yr.required > 0 AND yc.candidate < yr.required THEN least(1.0, greatest(0.4::DOUBLE, yc.candidate / yr.required)) ELSE 1 END)) AS raw
    FROM pairs CROSS JOIN (VALUES ('skill'), ('work_experience'), ('education'), ('content_score')) AS c(component) LEFT JOIN need USING (jd_id, component) LEFT JOIN got USING (jd_id, resume_id, component) LEFT JOIN yr USING (jd_id) LEFT JOIN yc USING (resume_id))"""
_ALL = "(SELECT doc_id, string_agg(text, ' ' ORDER BY block_no) AS t FROM bl WHERE text IS NOT NULL GROUP BY 1)"
YEARS = f"yr AS (SELECT doc_id AS jd_id, {required_years('t')} AS required FROM {_ALL}), yc AS (SELECT doc_id AS resume_id, {candidate_years('t')} AS candidate FROM {_ALL})"
FINAL = "finals AS (SELECT jd_id, resume_id, least(100, greatest(0, sum(raw * CASE component WHEN 'skill' THEN 0.15::DOUBLE WHEN 'work_experience' THEN 0.35 WHEN 'education' THEN 0.15 ELSE 0.35 END))) AS final FROM comps GROUP BY 1, 2)"
MANDATORY_EVAL = f"""
  top AS (SELECT jd_id, resume_id, jd_block, score, resume_block, row_number() OVER (PARTITION BY jd_id, resume_id, jd_block ORDER BY score DESC, resume_block) AS r FROM ev WHERE strength <> 'none'),
  must AS (SELECT p.jd_id, p.resume_id, j.jd_block, coalesce(t.score, 0) AS best_score, t.resume_block AS best_block FROM pairs p JOIN jd j ON j.jd_id = p.jd_id AND {mandatory('j.text')}
    LEFT JOIN top t ON t.jd_id = p.jd_id AND t.resume_id = p.resume_id AND t.jd_block = j.jd_block AND t.r = 1)"""
MISSING = f"""
  SELECT jd_id, resume_id, string_agg(left(text, 100), ' ## ' ORDER BY r) AS missing FROM (
    SELECT p.jd_id, p.resume_id, j.text, row_number() OVER (PARTITION BY p.jd_id, p.resume_id ORDER BY j.block_no) AS r FROM pairs p JOIN jd j ON j.jd_id = p.jd_id AND j.section IN {_in(dims.COMPONENTS['skill'])}
    WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.jd_id = p.jd_id AND e.resume_id = p.resume_id AND e.jd_block = j.jd_block AND e.strength <> 'none')) WHERE r <= 5 GROUP BY 1, 2"""


def missing(component: str) -> str:
    """MISSING of another component's sections."""
    return MISSING.replace(f"j.section IN {_in(dims.COMPONENTS['skill'])}", f"j.section IN {_in(dims.COMPONENTS[component])}")


_CLEAN = clean("text")
CLEANED_LINES = f"""lines AS (SELECT doc_id, line_no, CASE WHEN {blank('c')} OR {artifact('c')} THEN '' ELSE {punctuation(bullets('c'))} END AS text FROM (SELECT doc_id, line_no, {_CLEAN} AS c FROM (
  SELECT doc_id, unnest(generate_series(1, len(s)))::INT AS line_no, unnest(s) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS s FROM documents WHERE text IS NOT NULL AND doc_type IN ('resume', 'job_description')))))"""
_JDS = "(SELECT doc_id::VARCHAR FROM documents WHERE doc_type = 'job_description')"
#: The whole chain from blocks to evidence: vectors, similarities, boost, grounding, calibration.
MATCHED = f"""
  bl AS MATERIALIZED (SELECT t.doc_id::VARCHAR AS doc_id, t.block_no, i.now AS section, t.text FROM step t JOIN infer i ON i.doc_id = t.doc_id AND i.block_no = t.block_no),
  jd AS (SELECT doc_id AS jd_id, block_no AS jd_block, block_no, section, text FROM bl WHERE doc_id IN {_JDS}),
  qb AS (SELECT * FROM jd WHERE section NOT IN ('about', 'contact') OR {mandatory('text')} OR {requirement_words('text')}), rb AS (SELECT * FROM bl WHERE doc_id NOT IN {_JDS} AND section <> 'contact'),
  pl AS (SELECT text, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS place, sum(CASE WHEN ('0x' || substr(md5(t), 9, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS c FROM (SELECT text, unnest({terms(embed_text('text'))}) AS t FROM (SELECT DISTINCT text FROM bl)) GROUP BY 1, 2),
  un AS MATERIALIZED (SELECT text, place, c / sqrt(sum(c * c) OVER (PARTITION BY text)) AS u FROM pl WHERE c <> 0),
  uq AS MATERIALIZED (SELECT * FROM un WHERE text IN (SELECT text FROM qb)), ur AS MATERIALIZED (SELECT * FROM un WHERE text IN (SELECT text FROM rb)),
  sm2 AS (SELECT a.text AS jt, b.text AS rt, round(sum(a.u * b.u), 6) AS dense FROM uq a JOIN ur b ON b.place = a.place GROUP BY 1, 2 HAVING round(sum(a.u * b.u), 6) >= 0.3),
  hits AS MATERIALIZED (SELECT * FROM (SELECT j.jd_id, r.doc_id AS resume_id, j.jd_block, r.block_no AS resume_block, j.section AS jd_section, r.section AS resume_section, j.text AS jt, r.text AS rt, dense, row_number() OVER (PARTITION BY j.jd_id, j.jd_block, r.doc_id ORDER BY dense DESC, r.block_no) AS k
    FROM sm2 s JOIN qb j ON j.text = s.jt JOIN rb r ON r.text = s.rt) WHERE k <= 20),
  boosts AS (SELECT *, CASE WHEN jd_section = resume_section AND jd_section <> 'unknown' THEN least(dense + 0.05::DOUBLE, 1.0::DOUBLE) ELSE dense END AS boosted FROM hits),
  exacts AS (SELECT *, CASE WHEN (list_has_any({terms('jt')}, {terms('rt')}) OR boosted >= CASE WHEN jd_section IN ('skills', 'requirements') THEN 0.7 WHEN jd_section IN ('experience', 'responsibilities') THEN 0.52 WHEN jd_section = 'education' THEN 0.55 ELSE 0.48 END)
      AND least(1.0, greatest(0.0, (boosted - 0.2::DOUBLE) / 0.5::DOUBLE)) >= 0.3 THEN least(1.0, greatest(0.0, (boosted - 0.2::DOUBLE) / 0.5::DOUBLE)) ELSE 0 END AS exact FROM boosts),
  ev AS MATERIALIZED (SELECT jd_id, resume_id, jd_block, resume_block, jd_section, resume_section, dense, round(boosted, 6) AS boosted, round(exact::DOUBLE::VARCHAR::DECIMAL(30, 20), 4)::DOUBLE AS score, {_strength('exact')} AS strength, row_number() OVER (PARTITION BY jd_id, jd_block, resume_id ORDER BY round(boosted, 12) DESC, round(dense, 12) DESC, resume_block)::INT AS rank FROM exacts),
  pairs AS (SELECT DISTINCT jd_id, resume_id FROM ev)"""


_K = trim(sub(f"lower({trim('text')})", ":+$", ""))
_CORE = "section IN ('requirements', 'skills', 'responsibilities', 'education', 'experience', 'certifications')"
REQUIREMENTS = f"""
  leveled AS (SELECT *, CASE WHEN {words('text')} > 2 AND {_K} NOT IN (SELECT alias FROM {_ALIASES} AS a(alias, s)) AND NOT {has(_K, '^(?:about us|role overview|company overview|who we are)')}
      AND ({_CORE} OR (({mandatory('text')} OR {requirement_words('text')}) AND section NOT IN ('about', 'contact'))) THEN 2
    WHEN section NOT IN ('about', 'contact') AND {words('text')} > 2 THEN 1 ELSE 0 END AS l FROM jd),
  req AS (SELECT jd_id, jd_block, section, {mandatory('text')} AS is_mandatory FROM (SELECT *, max(l) OVER (PARTITION BY jd_id) AS m FROM leveled) WHERE l = m)"""
HASHED = f"""
  place AS (SELECT block_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 + 1 AS place, sum(CASE WHEN ('0x' || substr(md5(t), 9, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS c FROM (SELECT block_id, t FROM (SELECT e.block_id, unnest({terms(embed_text('e.text'))}) AS t FROM bl e WHERE e.text IS NOT NULL)) GROUP BY 1, 2),
  hashed AS (SELECT block_id, string_agg(CASE WHEN c < 0 THEN '-' ELSE '' END || place, ',' ORDER BY place) AS places, max(abs(c)) AS peak, sum(c * c) AS squares FROM place WHERE c <> 0 GROUP BY 1)"""
_SENTENCE = _PARTS
PINPOINT = f"""
  first_ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id, resume_id, jd_block ORDER BY score DESC, resume_block) AS r FROM ev WHERE strength <> 'none' AND resume_section <> 'contact') WHERE r = 1),
  cut_up AS (SELECT doc_id AS resume_id, block_id AS resume_block, {_SENTENCE} AS p FROM bl WHERE text IS NOT NULL AND block_id IN (SELECT resume_block FROM first_ev)),
  sent AS (SELECT resume_id, resume_block, (unnest(generate_series(1, len(p))) - 1)::INT AS sent_no, unnest(p) AS text FROM cut_up WHERE len(p) > 1),
  tx AS (SELECT DISTINCT text FROM (SELECT text FROM sent UNION ALL SELECT text FROM jd)),
  pl AS (SELECT text, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS place, sum(CASE WHEN ('0x' || substr(md5(t), 9, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS c FROM (SELECT text, unnest({terms(embed_text('text'))}) AS t FROM tx) GROUP BY 1, 2),
  un AS (SELECT text, place, c / sqrt(sum(c * c) OVER (PARTITION BY text)) AS u FROM pl WHERE c <> 0),
  asked AS (SELECT f.jd_id, f.resume_id, f.jd_block, s.sent_no, s.text, j.text AS jd_text FROM first_ev f JOIN jd j ON j.jd_id = f.jd_id AND j.jd_block = f.jd_block JOIN sent s ON s.resume_id = f.resume_id AND s.resume_block = f.resume_block),
  sims AS (SELECT a.text AS jd_text, b.text AS text, sum(a.u * b.u) AS similarity FROM (SELECT DISTINCT jd_text, text FROM asked) k JOIN un a ON a.text = k.jd_text JOIN un b ON b.text = k.text AND b.place = a.place GROUP BY 1, 2),
  rated AS (SELECT a.*, coalesce(s.similarity, 0) AS similarity, ({words('a.text')} > 2 AND {trim(sub(f"lower({trim('a.text')})", ':+$', ''))} NOT IN (SELECT alias FROM {_ALIASES} AS al(alias, x)))::INT AS ok FROM asked a LEFT JOIN sims s ON s.jd_text = a.jd_text AND s.text = a.text),
  pinpoint AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id, resume_id, jd_block ORDER BY ok DESC, round(similarity, 6) DESC, sent_no) AS rn FROM rated) WHERE rn = 1)"""
_GATED = "CASE WHEN j.section IN ('skills', 'requirements') THEN 0.7 WHEN j.section IN ('experience', 'responsibilities') THEN 0.52 WHEN j.section = 'education' THEN 0.55 ELSE 0.48 END"
PINNED = f"""
  raws AS (SELECT p.jd_id, p.resume_id, p.jd_block, p.text AS sentence, least(1.0, greatest(0.0, (similarity - 0.45::DOUBLE) / 0.4::DOUBLE)) AS raw, (list_has_any({terms('j.text')}, {terms('p.text')}) OR similarity >= {_GATED}) AS ok FROM pinpoint p JOIN jd j ON j.jd_id = p.jd_id AND j.jd_block = p.jd_block),
  pinned AS (SELECT jd_id, resume_id, jd_block, sentence, round(CASE WHEN ok AND raw >= 0.3 THEN raw ELSE 0 END, 4) AS ps FROM raws)"""
PARAMS = """
  reqs AS (SELECT r.*, j.text, 'param_' || lpad((row_number() OVER (PARTITION BY r.jd_id ORDER BY j.block_no, r.jd_block))::VARCHAR, 3, '0') AS parameter_id FROM req r JOIN jd j ON j.jd_id = r.jd_id AND j.jd_block = r.jd_block),
  params AS (SELECT *, CASE WHEN status <> 'not_found' THEN rb END AS best_block FROM (SELECT *, CASE WHEN similarity >= 0.65 THEN 'found' WHEN similarity >= 0.4 THEN 'partial' ELSE 'not_found' END AS status FROM (
    SELECT p.jd_id, p.resume_id, q.jd_block, q.parameter_id, q.section AS jd_section, q.is_mandatory, md5(q.text) AS requirement, u.resume_block AS rb, u.strength AS bs, u.resume_section AS bsec, n.sentence, greatest(coalesce(u.score, 0), coalesce(n.ps, 0)) AS similarity,
      CASE WHEN q.is_mandatory THEN 'mandatory' WHEN q.section = 'skills' THEN 'skill' WHEN q.section IN ('experience', 'responsibilities') THEN 'experience' WHEN q.section IN ('education', 'certifications') THEN 'education' ELSE 'requirement' END AS category
    FROM pairs p JOIN reqs q ON q.jd_id = p.jd_id LEFT JOIN first_ev u ON u.jd_id = p.jd_id AND u.resume_id = p.resume_id AND u.jd_block = q.jd_block LEFT JOIN pinned n ON n.jd_id = p.jd_id AND n.resume_id = p.resume_id AND n.jd_block = q.jd_block)))"""
#: Rounds the decimal number that is written, half up.
ROUNDED = "round(least(similarity * 100, 100)::DOUBLE::VARCHAR::DECIMAL(30, 15), 1)::DOUBLE"
PARAM_ROWS = f"""
  SELECT p.jd_id, p.resume_id, p.jd_block, parameter_id, category, is_mandatory, requirement, round(similarity, 4) AS similarity, {ROUNDED} AS confidence, status, coalesce(best_block, -1) AS best_block,
    CASE WHEN status = 'not_found' THEN '' ELSE coalesce(sentence, b.text, '') END AS matched_text, CASE WHEN status = 'not_found' THEN '' ELSE coalesce(array_to_string(list_transform(b.source_lines, lambda x: coalesce(x::VARCHAR, '?')), ','), '') END AS matched_lines,
    CASE WHEN status = 'not_found' THEN 'none' ELSE bs END AS match_strength, jd_section, CASE WHEN status = 'not_found' THEN 'unknown' ELSE bsec END AS resume_section,
    CASE status WHEN 'found' THEN 'Found' WHEN 'partial' THEN 'Partially' ELSE CASE WHEN rb IS NULL THEN 'No' ELSE 'Requirement' END END AS explanation FROM params p LEFT JOIN bl b ON b.block_id = p.rb"""
SUMMARY = """
  SELECT jd_id, resume_id, count(*) AS total, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'not_found') AS not_found,
    count(*) FILTER (is_mandatory) AS mandatory_total, count(*) FILTER (is_mandatory AND status = 'found') AS mandatory_found, round(count(*) FILTER (status = 'found') * 100 / count(*), 1) AS coverage,
    count(*) FILTER (is_mandatory) = count(*) FILTER (is_mandatory AND status = 'found') AS mandatory_satisfied FROM params GROUP BY 1, 2"""
_GROUPS = {**dims.COMPONENTS, "content_score": tuple(s for s in dims.SECTIONS if s not in ("skills", "experience", "education", "contact"))}
GROUPS = f"""
  contents AS (SELECT jd_id, bool_or(section IN {_in(_GROUPS['content_score'])}) AS has_content FROM jd GROUP BY 1),
  grouped AS (SELECT *, row_number() OVER (PARTITION BY jd_id, resume_id, component ORDER BY jd_block, score DESC, resume_block)::INT AS r FROM (
    {' UNION ALL '.join(f"SELECT ev.*, '{c}' AS component FROM ev LEFT JOIN contents USING (jd_id) WHERE strength <> 'none' AND (jd_section IN {_in(s)}" + (" OR NOT coalesce(has_content, false)" if c == 'content_score' else "") + ")" for c, s in _GROUPS.items())}))"""
_WHAT = "CASE component WHEN 'skill' THEN 'skill requirements' WHEN 'work_experience' THEN 'experience requirements' WHEN 'education' THEN 'education requirements' ELSE 'content blocks' END"
_RANK = "CASE component WHEN 'skill' THEN 0 WHEN 'work_experience' THEN 1 WHEN 'education' THEN 2 ELSE 3 END"
LACKS = f"""
  lacks AS (SELECT p.jd_id, p.resume_id, m.component, least(count(*), 5) AS n FROM pairs p JOIN members m ON m.jd_id = p.jd_id WHERE m.component <> 'content_score'
    AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.jd_id = p.jd_id AND e.resume_id = p.resume_id AND e.jd_block = m.jd_block AND e.strength <> 'none') GROUP BY 1, 2, 3)"""
FLAGS = f"""
  notes AS (SELECT jd_id, resume_id, {_RANK} * 2 AS o, 'Zero score for ' || component || ': ' || CASE WHEN relevant = 0 THEN 'No ' || {_WHAT} || ' found in JD' ELSE 'Quality: 0.000, Coverage: 0.0%, Matched 0/' || relevant || ' ' || {_WHAT} END AS note FROM comps WHERE raw = 0
    UNION ALL SELECT c.jd_id, c.resume_id, {_RANK.replace('component', 'c.component')} * 2 + 1, 'Missing evidence for ' || c.component || ': ' || CASE WHEN relevant = 0 THEN 1 ELSE l.n END || ' items' FROM comps c LEFT JOIN lacks l ON l.jd_id = c.jd_id AND l.resume_id = c.resume_id AND l.component = c.component WHERE c.component <> 'content_score' AND (relevant = 0 OR l.n > 0)
    UNION ALL SELECT jd_id, resume_id, 99, 'Unmet mandatory requirements: ' || count(*) FROM must WHERE best_score < 0.4 GROUP BY 1, 2),
  flags AS (SELECT p.jd_id, p.resume_id, coalesce(string_agg(note, ' ## ' ORDER BY o), '') AS flags FROM pairs p LEFT JOIN notes n ON n.jd_id = p.jd_id AND n.resume_id = p.resume_id GROUP BY 1, 2)"""


def _first_of(order: str) -> str:
    return f"SELECT jd_id, resume_id, string_agg(jd_block || ':' || resume_block, ',' ORDER BY score DESC, jd_block, resume_block) AS x FROM (SELECT *, row_number() OVER (PARTITION BY jd_id, resume_id ORDER BY {order}) AS n FROM ev WHERE strength <> 'none') WHERE n <= 5 GROUP BY 1, 2"


def _shown(component: str) -> str:
    return f"coalesce((SELECT string_agg(jd_block || ':' || resume_block, ',' ORDER BY r) FROM grouped g WHERE g.jd_id = f.jd_id AND g.resume_id = f.resume_id AND g.component = '{component}' AND r <= 10), '')"


_WARNINGS = "(SELECT doc_id, string_agg('[{0}] ' || code || ': ' || n, ' ## ' ORDER BY code || ': ' || n) AS w FROM msgs WHERE status <> 'valid' GROUP BY 1)"
REPORT_ROWS = f""",
  best5 AS ({_first_of('score DESC, jd_block, resume_block')}), last5 AS ({_first_of('score, jd_block DESC, resume_block DESC')}),
  sm AS ({SUMMARY}), mm AS (SELECT jd_id, resume_id, count(*) AS n, count(*) FILTER (best_score >= 0.4) AS met, string_agg(left(j.text, 200), ' ## ' ORDER BY m.jd_block) FILTER (best_score < 0.4) AS missing FROM must m JOIN jd j USING (jd_id, jd_block) GROUP BY 1, 2),
  bc AS (SELECT doc_id, count(*) AS n FROM bl GROUP BY 1), jc AS (SELECT jd_id, count(*) AS n FROM jd GROUP BY 1)
  SELECT f.jd_id, f.resume_id, true AS adds_up, coalesce(mm.n = mm.met, true) AS all_met, 4 AS n_components, coalesce(sm.total, 0)::INT AS n_params,
    concat_ws(',', coalesce(sm.found, 0), coalesce(sm.partial, 0), coalesce(sm.not_found, 0), coalesce(sm.mandatory_total, 0), coalesce(sm.mandatory_found, 0)) AS summary, coalesce(sm.coverage, 0) AS coverage, coalesce(best5.x, '') AS strongest, coalesce(last5.x, '') AS weakest,
    {_shown('skill')} AS skill, {_shown('work_experience')} AS experience, {_shown('education')} AS education, {_shown('content_score')} AS content, coalesce(mm.n, 0)::INT AS n_mandatory, md5(coalesce(mm.missing, '')) AS missing, fl.flags AS flags,
    concat_ws(' ## ', wj.w, wr.w) AS warnings,
    concat_ws(' ', 'Overall Assessment: ' || CASE WHEN round(f.final, 2) >= 75 THEN 'Strong' WHEN round(f.final, 2) >= 55 THEN 'Moderate' WHEN round(f.final, 2) >= 35 THEN 'Below Average' ELSE 'Weak' END || ' Candidate (Score: #/#).', 'The candidate shows # strong, # moderate, and # weak matches against the job requirements#',
      'Skill: #/# (weight: #%)# Work Experience: #/# (weight: #%)# Education: #/# (weight: #%)# Content Score: #/# (weight: #%)#', CASE WHEN mm.n > 0 THEN 'Mandatory Requirements: #/# met#' END,
      CASE WHEN mm.n > mm.met THEN '⚠ WARNING: Not all mandatory requirements are satisfied# Review required before proceeding#' END).replace('#).', '#)#') AS text,
    (CASE WHEN dj.source_filename IS NULL THEN 0 ELSE 1 END + CASE WHEN dr.source_filename IS NULL THEN 0 ELSE 1 END)::INT AS names, coalesce(jc.n, 0)::INT AS jd_blocks, coalesce(bc.n, 0)::INT AS resume_blocks
  FROM finals f LEFT JOIN sm ON sm.jd_id = f.jd_id AND sm.resume_id = f.resume_id LEFT JOIN mm ON mm.jd_id = f.jd_id AND mm.resume_id = f.resume_id LEFT JOIN best5 ON best5.jd_id = f.jd_id AND best5.resume_id = f.resume_id LEFT JOIN last5 ON last5.jd_id = f.jd_id AND last5.resume_id = f.resume_id
    LEFT JOIN flags fl ON fl.jd_id = f.jd_id AND fl.resume_id = f.resume_id LEFT JOIN {_WARNINGS.format('JD')} wj ON wj.doc_id = f.jd_id LEFT JOIN {_WARNINGS.format('Resume')} wr ON wr.doc_id = f.resume_id
    LEFT JOIN documents dj ON dj.document_id = f.jd_id LEFT JOIN documents dr ON dr.document_id = f.resume_id LEFT JOIN jc ON jc.jd_id = f.jd_id LEFT JOIN bc ON bc.doc_id = f.resume_id"""
_GATE = "CASE WHEN ev.jd_section IN ('skills', 'requirements') THEN 0.7 WHEN ev.jd_section IN ('experience', 'responsibilities') THEN 0.52 WHEN ev.jd_section = 'education' THEN 0.55 ELSE 0.48 END"
_TA, _TB = terms("coalesce(a.text, '')"), terms("coalesce(b.text, '')")
GROUNDED = f"(list_has_any({_TA}, {_TB}) OR score >= {_GATE})"
FACTS = f"""
  ln0 AS (SELECT doc_id, count(DISTINCT line_no) AS lines, max(line_no) - count(DISTINCT line_no) AS gaps FROM indexed_lines GROUP BY 1),
  ln AS (SELECT document_id AS doc_id, coalesce(lines, 0) AS lines, coalesce(gaps, 0) AS gaps FROM documents d LEFT JOIN ln0 ON ln0.doc_id = d.document_id),
  bf AS (SELECT doc_id, count(*) AS blocks, sum(length(coalesce(text, '')))::BIGINT + count(*) - 1 AS chars, count(*) FILTER (section = 'unknown') AS n_unknown, coalesce(bool_or(section IN ('experience', 'skills')), false) AS has_key FROM bl GROUP BY 1),
  du AS (SELECT doc_id, count(*) AS duplicates FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, md5(lower({trim('text')})) ORDER BY block_no) AS r FROM bl WHERE text IS NOT NULL) WHERE r > 1 GROUP BY 1),
  facts AS (SELECT ln.doc_id, lines, gaps, coalesce(blocks, 0) AS blocks, coalesce(chars, 0) AS chars, coalesce(n_unknown, 0) AS n_unknown, has_key, coalesce(duplicates, 0) AS duplicates FROM ln LEFT JOIN bf USING (doc_id) LEFT JOIN du USING (doc_id))"""
MESSAGES = """
  msgs AS (SELECT doc_id, 'MIN_LINES' AS code, 'warning' AS status, lines::BIGINT AS n FROM facts WHERE lines < 3
    UNION ALL SELECT doc_id, 'MIN_BLOCKS', 'error', blocks FROM facts WHERE blocks < 1
    UNION ALL SELECT doc_id, 'LOW_CONTENT', 'warning', chars FROM facts WHERE chars < 50
    UNION ALL SELECT doc_id, 'UNKNOWN_SECTIONS', CASE WHEN n_unknown / greatest(blocks, 1) > 0.3 THEN 'warning' ELSE 'valid' END, n_unknown FROM facts WHERE n_unknown > 0
    UNION ALL SELECT doc_id, 'DUPLICATE_BLOCK', 'warning', duplicates FROM facts WHERE duplicates > 0
    UNION ALL SELECT doc_id, 'LINE_GAPS', 'warning', gaps FROM facts WHERE gaps > 0
    UNION ALL SELECT doc_id, 'MISSING_KEY_SECTIONS', 'warning', 1 FROM facts WHERE blocks > 0 AND NOT has_key)"""
