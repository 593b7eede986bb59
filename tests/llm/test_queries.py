"""Every registered query of the corpus operators, against its SQL where it has one."""

from __future__ import annotations

from pathlib import Path

import pytest

from sensorloom.llm import ORACLE, QUERIES
from tools.check_oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE:
        assert difference(rows, duck.execute(ORACLE[name]).df()) is None
    elif name in ("op1_best_fit_packing", "op2_bit_plane_tokens", "op3_bootstrapped_pii", "op6_minimax_shards", "op10_line_alignment", "op11_periodic_runs", "op13_simhash_bk_trees"):
        ids = {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}
        assert set(rows["doc_id"]) == ids
    else:
        assert len(rows) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
