import hashlib
import re

import pytest

from gridcells.llm import queries
from tests.llm import test_pii, test_secret_scan

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_each_query_has_a_row_for_each_input_row(spark, name):
    out = queries.QUERIES[name](spark, TINY)
    table = {"op2": "pages", "op4": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    assert out.count() == spark.read.parquet(f"{TINY}/{table}.parquet").count()
    assert re.fullmatch(r"op\d+_\w+", name) and len(set(out.columns)) == len(out.columns)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_span_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    for r in queries.secret_scan(spark, TINY).collect():
        want = test_secret_scan.base(texts[r.doc_id])
        assert r.base_sha256 == digest(want) and [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
    for r in queries.personal_data(spark, TINY).collect():
        want = [("email ip card phone".split()[k], a, b) for a, k, b in test_pii.plain(texts[r.doc_id])]
        assert r.base_sha256 == digest(want) and r.n_email == sum(x[0] == "email" for x in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}
