import pytest

from matchloom.llm import queries

DATA = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()
COLUMNS = {
    "p1_found": ["block_a", "block_b"], "p2_found": ["doc_id", "line_no", "end_char"], "p3_found": ["doc_id", "line_no", "canon_id"], "p4_found": ["src", "row_key", "start_char", "end_char", "pii_kind"],
    "p5_found": ["jd_block_id", "evidence_id"], "p6_found": ["block_id", "cut_kind"], "p9_found": ["doc_id", "doc_kind"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck, same):
    same(queries.queries()[name], SQL[name], spark, duck)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_gives_rows(name, spark):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
