import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.queries import OP4_SQL, op4_exact_dedup
from tests.llm.helpers import AWKWARD, awkward, empty


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    out = []
    for k, (i, _, *_rest) in enumerate(rows):
        group = [(-len(rows[j][1] or ""), rows[j][0]) for j in range(len(rows)) if norm[j] == norm[k]]
        ids = [g for g in group if g[1] is not None]
        keep = min(ids)[1] if ids else None
        out.append((i, keep, len(group), i == keep, hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_awkward_rows_as_brute_force(spark):
    assert rows_of(exact_dedup(awkward(spark))) == brute(AWKWARD)


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).count() == 0


def test_collisions_are_told_apart(spark):
    """With a hash that always collides the bytes still decide."""
    df = spark.createDataFrame([(k, f"text {k // 3}") for k in range(30)], "doc_id long, text string")
    weak = exact_dedup(df, hash_of=lambda t: F.lit(b"same"))
    assert rows_of(weak) == rows_of(exact_dedup(df))
    assert {r.keep_id for r in weak.collect()} == {0, 3, 6, 9, 12, 15, 18, 21, 24, 27}


def test_longest_original_wins_then_smallest_id(spark):
    df = spark.createDataFrame([(3, "a b"), (2, "a  b"), (1, "ab"), (4, "a  b"), (2**62, "z"), (-(2**62), "z")], "doc_id long, text string")
    keep = {r.doc_id: r.keep_id for r in exact_dedup(df).collect()}
    assert keep == {1: 2, 2: 2, 3: 2, 4: 2, 2**62: -(2**62), -(2**62): -(2**62)}


def test_ids_at_the_ends_of_a_long(spark):
    rows = [(9 * 10**18, "a b"), (-9 * 10**18, "ab"), (2**63 - 1, "c  d"), (-(2**63), "c  d"), (0, "cd"), (5, "e"), (2**63 - 1, "e"), (-(2**63), "e f"), (2**63 - 1, "e f g"), (1, "efg")]
    assert rows_of(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_query_and_sql_agree_on_awkward_rows(spark, tmp_path):
    rows = [*AWKWARD, (9 * 10**18, "a b", None, None), (-9 * 10**18, "ab", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({OP4_SQL})").fetchall()
    assert rows_of(op4_exact_dedup(spark, str(tmp_path))) == sorted(sql, key=repr) == brute(rows)


def test_no_python_in_the_plan(spark):
    plan = exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
