"""The queries run over the small tables; those with SQL equal it; results are sets."""

from __future__ import annotations

import os

import pytest

from tests.oracle import connect, rows
from tribuna.llm import encode, queries

NEEDS = {"p8_ids", "p9_mistura", "p9_relatorio"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    if name in NEEDS and not os.path.exists(f"{encode.FOLDER}/{encode.VOCABULARY}"):
        pytest.skip("no vocabulary files here")
    ours = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        assert rows(ours) == rows(connect(data).execute(queries.SQL[name]).df())
    if name.endswith("_found"):
        assert len(ours) or name in ("p1_found",)
        assert len(rows(ours)) == len(set(rows(ours)))
