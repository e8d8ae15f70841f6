"""The registered queries on small awkward tables: whole results, as brute force or SQL has them."""

import duckdb
import pytest

from corpusloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import AWKWARD, SCHEMA, made_up, words
from tests.llm.test_near_dedup import brute as brute_near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [*AWKWARD, *[(100 + k, t, "en" if k % 2 else "de", f"s{k % 3}") for k, t in enumerate(made_up(60, seed=12))], (2**63 - 1, "one more text here", None, "s1"), (-(2**63), "one  more text here", "en", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(100 + k, 1, int(k % 5 == 0)) for k in range(60)] + [(None, 1, 1), (7, None, None), (5, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(k, [float((k * j) % 7) / 8 for j in range(6)]) for k in range(130)] + [(20, [0.5] * 6), (None, [1.0] * 6), (300, None), (320, [float("nan")] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    found = QUERIES[name](spark, folder[0])
    sql = con.sql(ORACLE_SQL[name])
    names = sorted(sql.columns)
    assert sorted(found.columns) == names
    rows = [tuple(r[sql.columns.index(n)] for n in names) for r in sql.fetchall()]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == sorted(rows, key=repr)


def test_op1_holds_every_word(spark, folder):
    total, bins = {}, {}
    for r in QUERIES["op1_best_fit_packing"](spark, folder[0]).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length, r.bin_capacity))
    expected = {}
    for i, t, *_ in folder[1]:
        expected[i] = expected.get(i, 0) + len(words(t))
    assert total == expected
    for pieces in bins.values():
        used = sum(n for _, n, _ in pieces)
        assert {c for *_, c in pieces} == {min(c for c in (512, 1024, 2048, 4096) if c >= used)}


def test_op2_scores_every_row(spark, folder):
    found = QUERIES["op2_toxicity"](spark, folder[0]).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((i for i, *_ in folder[1]), key=repr)
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade > 0) for r in found)


def test_op2_with_one_label_only(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, 1, 0), (101, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r.grade, r.severity, r.toxic) for r in QUERIES["op2_toxicity"](spark, str(tmp_path)).collect()} == {(0, 0.0, False)}


def test_op3_as_brute_force(spark, folder):
    found = QUERIES["op3_near_dedup"](spark, folder[0]).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_near(folder[1])
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
