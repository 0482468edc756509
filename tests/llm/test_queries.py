"""Every query of the package on given tables: against its SQL where it has one."""

import pytest

from noticemill.llm import queries
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op3_mixture": "doc_id size source_size target taken",
    "op6_personal": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_quality": "doc_id held_out score predicted",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_toxicity": "doc_id held_out score predicted",
    "op12_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    run, sql = queries.QUERIES[name]
    if sql:
        assert compare(spark, con, FOLDER, run, sql).startswith("ok")
        return
    frame = run(spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    ids = {r.doc_id for r in frame.select("doc_id").collect()}
    assert ids == {i for (i,) in con.execute("SELECT doc_id FROM documents").fetchall()}
