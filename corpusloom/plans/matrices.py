"""Queries on document-term matrices, indexes, trends and goodness of fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import index as ix
from corpusloom.operators import stats
from corpusloom.operators import trends as tr
from corpusloom.operators.dtm import Dtm, vectorize
from corpusloom.plans.tables import DTM, TOK, documents, orders_dtm, query, table, tokens


@query("agg_term_frequency", f"WITH {DTM} SELECT token, sum(value) AS tf FROM cells GROUP BY token")
def agg_term_frequency(spark, d):
    return orders_dtm(spark, d).term_frequency()


@query("agg_document_counts", f"WITH {DTM} SELECT document_id, coalesce(n, 0.0) AS n_tokens FROM idx LEFT JOIN (SELECT document_id, sum(value) AS n FROM cells GROUP BY 1) USING (document_id)")
def agg_document_counts(spark, d):
    return orders_dtm(spark, d).document_counts()


@query("agg_stats", f"WITH {DTM} SELECT count(DISTINCT token) AS n_terms, sum(value) AS total, (SELECT count(*) FROM idx) AS n_documents FROM cells")
def agg_stats(spark, d):
    return orders_dtm(spark, d).stats()


# document index


@query("join_overload", "SELECT d.doc_id AS document_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_overload(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    return ix.overload(docs, table(spark, d, "labels").withColumnRenamed("doc_id", "document_id"), ["quality", "toxic", "lang"])


@query("join_attributes", "SELECT d.doc_id AS document_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_attributes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    return ix.add_attributes(docs, table(spark, d, "labels").withColumnRenamed("doc_id", "document_id"))


@query("join_consolidate", "SELECT d.doc_id AS document_name, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_consolidate(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_name"), "lang")
    return ix.consolidate(docs, table(spark, d, "labels").withColumnRenamed("doc_id", "document_name"))


@query("join_update_values", "SELECT d.doc_id AS document_name, d.lang, coalesce(l.quality, -1) AS quality, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_update_values(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_name"), "lang", "source")
    new = table(spark, d, "labels").select(F.col("doc_id").alias("document_name"), "quality", F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return ix.update_values(docs, new, {"quality": -1})


@query("join_update_counts", f"WITH {DTM} SELECT document_id, year, coalesce(n, 0.0) AS n_tokens, coalesce(n, 0.0) AS n_raw_tokens FROM idx LEFT JOIN (SELECT document_id, sum(value) AS n FROM cells GROUP BY 1) USING (document_id)")
def join_update_counts(spark, d):
    return orders_dtm(spark, d).with_token_counts().index.select("document_id", "year", "n_tokens", "n_raw_tokens")


@query("join_semi", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE document_id IN (SELECT document_id FROM idx WHERE priority = '1-URGENT')")
def join_semi(spark, d):
    return orders_dtm(spark, d).filter(F.col("priority") == "1-URGENT").cells


@query("set_extend_index", "SELECT doc_id AS document_name, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_extend_index(spark, d):
    one = table(spark, d, "labels").select(F.col("doc_id").alias("document_name"), F.lit("labels").alias("origin"))
    two = table(spark, d, "documents").select(F.col("doc_id").alias("document_name"), F.lit("documents").alias("origin"))
    return ix.extend(one, two)


@query("set_gap_rows", """WITH g AS (SELECT (year(o_orderdate) * 2)::INT AS period, count(*) AS n_documents FROM orders GROUP BY 1)
SELECT r.p::INT AS period, coalesce(n_documents, 0) AS n_documents FROM (SELECT unnest(range((SELECT min(period) FROM g), (SELECT max(period) FROM g) + 1)) AS p) r LEFT JOIN g ON g.period = r.p""")
def set_gap_rows(spark, d):
    grouped = table(spark, d, "orders").groupBy((F.year("o_orderdate") * 2).alias("period")).agg(F.count(F.lit(1)).alias("n_documents"))
    return ix.fill_gaps(grouped, "period", 1, zeros=["n_documents"])


@query("agg_index_by_column", "SELECT source, count(DISTINCT doc_id) AS n_documents, sum(n_chars)::BIGINT AS n_chars, min(1950 + doc_id % 70) AS year_min, max(1950 + doc_id % 70) AS year_max, max(1950 + doc_id % 70) - min(1950 + doc_id % 70) + 1 AS year_size FROM documents GROUP BY source")
def agg_index_by_column(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "n_chars", (F.lit(1950) + F.col("doc_id") % 70).alias("year"))
    return ix.group_index(docs, ["source"], ["n_chars"])


@query("agg_index_members", "SELECT year - year % 10 AS period, count(DISTINCT doc_id) AS n_documents, list(doc_id ORDER BY doc_id)::VARCHAR AS members, min(year) AS year_min, max(year) AS year_max, max(year) - min(year) + 1 AS year_size FROM (SELECT doc_id, 1950 + doc_id % 70 AS year FROM documents) GROUP BY 1")
def agg_index_members(spark, d):
    docs = documents(spark, d).withColumn("period", ix.temporal_key(F.col("year"), "decade"))
    grouped = ix.group_index(docs, ["period"], members=True)
    return grouped.withColumn("members", F.concat(F.lit("["), F.array_join("document_ids", ", "), F.lit("]"))).drop("document_ids")


@query("agg_codify", "SELECT doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS lang_id FROM documents")
def agg_codify(spark, d):
    return ix.codify(table(spark, d, "documents").select("doc_id", "lang"), "lang", "lang_id").select("doc_id", "lang_id")


@query("agg_dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS document_id FROM documents")
def agg_dense_ids(spark, d):
    return ix.dense_ids(table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "document_id")


@query("agg_is_increasing", "SELECT (count(*) = count(DISTINCT i) AND min(i) = 0 AND max(i) = count(*) - 1) AS increasing FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def agg_is_increasing(spark, d):
    return ix.dense_ids(table(spark, d, "documents").select("doc_id"), ["doc_id"]).agg(ix.is_strictly_increasing().alias("increasing"))


# grouping

for _name, _spec, _key in (("year", "year", "year"), ("lustrum", "lustrum", "year - year % 5"), ("decade", "decade", "year - year % 10")):

    @query(f"agg_group_{_name}", f"WITH {DTM} SELECT ({_key})::INT AS period, token, sum(value) AS value FROM cells JOIN idx USING (document_id) GROUP BY ALL")
    def agg_group(spark, d, spec=_spec):
        return orders_dtm(spark, d).group_by_time(spec)


@query("agg_group_dict", f"WITH {DTM} SELECT CASE WHEN year IN (1995, 1996) THEN 'early' WHEN year IN (1999, 2000, 2001) THEN 'late' END AS period, token, sum(value) AS value FROM cells JOIN idx USING (document_id) WHERE year IN (1995, 1996, 1999, 2000, 2001) GROUP BY ALL")
def agg_group_dict(spark, d):
    return orders_dtm(spark, d).group_by_time({"early": [1995, 1996], "late": [1999, 2000, 2001]})


@query("agg_group_mean", f"WITH {DTM}, n AS (SELECT year, count(*) AS n FROM idx GROUP BY 1) SELECT year AS period, token, round(sum(value) / any_value(n), 9) AS value FROM cells JOIN idx USING (document_id) JOIN n USING (year) GROUP BY ALL")
def agg_group_mean(spark, d):
    return orders_dtm(spark, d).group_by_time("year", "mean").withColumn("value", F.round("value", 9))


@query("agg_group_pivot_keys", f"WITH {DTM} SELECT year AS period, status, priority, token, sum(value) AS value FROM cells JOIN idx USING (document_id) WHERE status <> 'P' GROUP BY ALL")
def agg_group_pivot_keys(spark, d):
    dtm = orders_dtm(spark, d).filter({"status": (False, "P")})
    return dtm.group_by({"period": ix.temporal_key(F.col("year"), "year"), "status": F.col("status"), "priority": F.col("priority")})


@query("agg_group_index_gaps", f"""WITH {DTM}, g AS (SELECT ((year - year % 5) * 2)::INT AS period, status, count(DISTINCT document_id) AS n_documents FROM idx GROUP BY ALL)
SELECT period, status, n_documents, period || '_' || status AS document_name FROM g
UNION ALL SELECT p::INT, '0', 0, p || '_0' FROM (SELECT unnest(range((SELECT min(period) FROM g), (SELECT max(period) FROM g) + 1, 5)) AS p) WHERE p NOT IN (SELECT period FROM g)""")
def agg_group_index_gaps(spark, d):
    return orders_dtm(spark, d).group_index({"period": ix.temporal_key(F.col("year"), "lustrum") * 2, "status": F.col("status")}, step=5)


@query("agg_group_mapping", f"WITH {DTM} SELECT CASE WHEN document_id IN (0, 1, 2, 3) THEN 0 ELSE 1 END AS category, token, sum(value) AS value FROM cells WHERE document_id IN (0, 1, 2, 3, 10, 11, 12) GROUP BY ALL")
def agg_group_mapping(spark, d):
    return orders_dtm(spark, d).group_by_mapping({0: [0, 1, 2, 3], 1: [10, 11, 12]}, spark)


# weights

for _name, _axis, _norm, _size, _by in (
    ("key_l1", 1, "l1", "sum(abs(value))", "document_id"), ("key_l2", 1, "l2", "sqrt(sum(value * value))", "document_id"), ("key_max", 1, "max", "max(abs(value))", "document_id"), ("key_l1_columns", 0, "l1", "sum(abs(value))", "token"),
):

    @query(_name, f"WITH {DTM} SELECT document_id, token, round(value / {_size} OVER (PARTITION BY {_by}), 9) AS value FROM cells" if _norm != "l2" else f"WITH {DTM} SELECT document_id, token, round(value / sqrt(sum(value * value) OVER (PARTITION BY {_by})), 9) AS value FROM cells")
    def key_norm(spark, d, axis=_axis, norm=_norm):
        return orders_dtm(spark, d).normalize(axis, norm).cells.withColumn("value", F.round("value", 9))


@query("key_keep_magnitude", f"WITH {DTM}, f AS (SELECT sum(value) AS f FROM cells WHERE document_id = (SELECT min(document_id) FROM idx)) SELECT document_id, token, round(value / sum(value) OVER (PARTITION BY document_id) * f, 8) AS value FROM cells, f")
def key_keep_magnitude(spark, d):
    return orders_dtm(spark, d).normalize_keeping_magnitude().cells.withColumn("value", F.round("value", 8))


@query("key_raw_counts", f"WITH {DTM} SELECT document_id, token, round(value / sum(value) OVER (PARTITION BY document_id), 9) AS value FROM cells JOIN idx USING (document_id)")
def key_raw_counts(spark, d):
    return orders_dtm(spark, d).with_token_counts().normalize_by_raw_counts().cells.withColumn("value", F.round("value", 9))


_TFIDF = f"""WITH {DTM}, f AS (SELECT token, count(*) AS df FROM cells GROUP BY token), w AS (SELECT document_id, token, value * (ln((1 + (SELECT count(*) FROM idx)) / (1 + df)) + 1) AS w FROM cells JOIN f USING (token))
SELECT document_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY document_id)), 8) AS value FROM w"""


@query("key_tfidf", _TFIDF)
def key_tfidf(spark, d):
    return orders_dtm(spark, d).tf_idf().cells.withColumn("value", F.round("value", 8))


# top lists and slices


@query("topk_words", f"WITH {DTM} SELECT token, sum(value) AS tf FROM cells GROUP BY token ORDER BY tf DESC, token LIMIT 25")
def topk_words(spark, d):
    return orders_dtm(spark, d).top_words(25)


@query("topk_among_words", f"WITH {DTM} SELECT token, sum(value) AS tf FROM cells WHERE token BETWEEN 100 AND 300 GROUP BY token ORDER BY tf DESC, token LIMIT 25")
def topk_among_words(spark, d):
    return orders_dtm(spark, d).top_words(25, spark.range(100, 301).toDF("token"))


@query("topk_by_category", f"WITH {DTM}, c AS (SELECT status, token, sum(value) AS tf FROM cells JOIN idx USING (document_id) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY tf DESC, token)::INT AS rank FROM c) WHERE rank <= 10")
def topk_by_category(spark, d):
    return orders_dtm(spark, d).top_by_category("status", 10)


@query("topk_table_wide", f"""WITH {DTM}, c AS (SELECT status, token, sum(value) AS tf FROM cells JOIN idx USING (document_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY tf DESC, token)::INT AS rank FROM c)
SELECT rank, coalesce(max(token::VARCHAR) FILTER (status = 'F'), '*') AS "F", coalesce(max(token::VARCHAR) FILTER (status = 'O'), '*') AS "O", coalesce(max(token::VARCHAR) FILTER (status = 'P'), '*') AS "P" FROM r WHERE rank <= 10 GROUP BY rank""")
def topk_table_wide(spark, d):
    return orders_dtm(spark, d).top_table("status", 10, ["F", "O", "P"])


@query("topk_slice_tf", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE token IN (SELECT token FROM cells GROUP BY token HAVING sum(value) >= 900)")
def topk_slice_tf(spark, d):
    return orders_dtm(spark, d).slice_by_tf(900).cells


@query("topk_slice_n", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE token IN (SELECT token FROM cells GROUP BY token ORDER BY sum(value) DESC, token LIMIT 100)")
def topk_slice_n(spark, d):
    return orders_dtm(spark, d).slice_by_n_top(100).cells


@query("topk_slice_df", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE token IN (SELECT token FROM cells GROUP BY token HAVING count(DISTINCT document_id) BETWEEN 20 AND 40 ORDER BY count(DISTINCT document_id) DESC, token LIMIT 200)")
def topk_slice_df(spark, d):
    return orders_dtm(spark, d).slice_by_df(20, 40, 200).cells


@query("topk_compress", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE token IN (SELECT token FROM cells GROUP BY token HAVING sum(value) >= 1000 OR token IN (1, 2, 3))")
def topk_compress(spark, d):
    return orders_dtm(spark, d).compress(1000, (1, 2, 3)).cells


@query("topk_slice_terms", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE token IN (5, 50, 500)")
def topk_slice_terms(spark, d):
    return orders_dtm(spark, d).slice_by_terms([5, 50, 500]).cells


@query("topk_zero_out", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE token NOT IN (5, 50) AND token IN (SELECT token FROM cells GROUP BY token HAVING sum(value) >= 900) AND document_id IN (SELECT document_id FROM idx WHERE status = 'F')")
def topk_zero_out(spark, d):
    dtm = orders_dtm(spark, d)
    return dtm.zero_out([5, 50], 900, dtm.filter({"status": "F"})).cells


@query("topk_word_vector", f"WITH {DTM} SELECT document_id, coalesce(value, 0.0) AS value FROM idx LEFT JOIN (SELECT * FROM cells WHERE token = 7) USING (document_id)")
def topk_word_vector(spark, d):
    return orders_dtm(spark, d).word_vector(7)


# goodness of fit: parts over years

_YEARS = f"{DTM}, y AS (SELECT year - 1995 AS x, token, sum(value) AS v FROM cells JOIN idx USING (document_id) GROUP BY ALL), n AS (SELECT 7.0::DOUBLE AS d), s AS (SELECT token, sum(v) AS s1, sum(v * v) AS s2, sum(v * v * v) AS s3, sum(x * v) AS xv, count(*) AS k, min(v) AS lo, max(v) AS hi FROM y GROUP BY token)"
_YEARS += """, e AS (SELECT token, sum(abs(v - s1 / d)) AS dev, sum(v / s1 * ln(v / s1 * d)) AS ent, sum((v + 1e-5) * ln((v + 1e-5) / (s1 / d + 1e-5))) AS kl FROM y JOIN s USING (token), n GROUP BY token)
, g AS (SELECT token, s1 AS word_count, (sqrt(s2) * sqrt(d) - 1) / (sqrt(d) - 1) AS l2_norm, (d * xv - 21 * s1) / (d * 91 - 21 * 21) AS slope, s1 / d - (d * xv - 21 * s1) / (d * 91 - 21 * 21) * 21 / d AS intercept,
 s2 / (s1 / d) - s1 AS chi2_stats, (dev + (d - k) * s1 / d) / d AS earth_mover_distance, ent AS entropy, kl + (d - k) * 1e-5 * ln(1e-5 / (s1 / d + 1e-5)) AS kld,
 CASE WHEN s2 / d - (s1 / d) ** 2 > 0 THEN (s3 / d - 3 * (s1 / d) * s2 / d + 2 * (s1 / d) ** 3) / (s2 / d - (s1 / d) ** 2) ** 1.5 ELSE 0 END AS skew, CASE WHEN k < d THEN least(lo, 0) ELSE lo END AS min, CASE WHEN k < d THEN greatest(hi, 0) ELSE hi END AS max, s1 / d AS mean FROM s JOIN e USING (token), n)"""
_GOF = ["word_count", "l2_norm", "slope", "intercept", "chi2_stats", "earth_mover_distance", "entropy", "kld", "skew", "min", "max", "mean"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _GOF)


def _gof(spark, d):
    cells = orders_dtm(spark, d).group_by_time("year").withColumn("x", F.col("period") - 1995)
    return stats.goodness_of_fit(cells, 7)


@query("gof_metrics", f"WITH {_YEARS} SELECT token, {_ROUNDED} FROM g")
def gof_metrics(spark, d):
    return _gof(spark, d).select("token", *[F.round(c, 6).alias(c) for c in _GOF])


for _metric in ("l2_norm", "slope", "kld", "skew"):

    @query(f"gof_top_{_metric}", f"WITH {_YEARS} SELECT token, round({_metric}, 6) AS {_metric} FROM g ORDER BY abs(g.{_metric}) DESC, token LIMIT 20")
    def gof_top(spark, d, metric=_metric):
        return stats.most_deviating(_gof(spark, d), metric, 20).select("token", F.round(metric, 6).alias(metric))


@query("gof_chi2_p")
def gof_chi2_p(spark, d):
    return _gof(spark, d).select("token", "chi2_stats", stats.chi_squared_p(F.col("chi2_stats"), 6).alias("p"))


@query("stat_slopes", f"WITH {DTM}, y AS (SELECT year, token, sum(value) AS v FROM cells JOIN idx USING (document_id) GROUP BY ALL), r AS (SELECT token, regr_slope(v, year) AS k, regr_intercept(v, year) AS m, min(year) AS x1, max(year) AS x2 FROM y GROUP BY token) SELECT token, round(k, 6) + 0.0 AS k, round(k * x1 + m, 4) AS y1, round(k * x2 + m, 4) AS y2 FROM r")
def stat_slopes(spark, d):
    cells = orders_dtm(spark, d).group_by_time("year").withColumnRenamed("period", "year")
    return stats.slopes(cells, ["token"]).select("token", (F.round("k", 6) + 0.0).alias("k"), F.round("y1", 4).alias("y1"), F.round("y2", 4).alias("y2"))


@query("stat_boxplot", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, count(*) FILTER (value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)) AS n_outliers FROM events JOIN q USING (event_type) GROUP BY ALL""")
def stat_boxplot(spark, d):
    box = stats.boxplot(table(spark, d, "events"), "value", ["event_type"])
    return box.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3", "iqr")], "n_outliers")


@query("win_rolling_avg", """WITH e AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, hour, round(avg(n) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling, round(avg(n) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS centred FROM e""")
def win_rolling_avg(spark, d):
    hours = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    rolling = lambda centred: F.round(stats.rolling_average(hours, "hour", "n", 3, ["event_type"], centred), 6)
    return hours.select("event_type", F.col("hour"), rolling(False).alias("rolling"), rolling(True).alias("centred"))


@query("stat_curves")
def stat_curves(spark, d):
    series = orders_dtm(spark, d).group_by({"year": F.col("year"), "status": F.col("status")}).groupBy("status", "year").agg(F.sum("value").alias("value"))
    fitted = None
    for curve in ("linear", "poly3", "gaussian", "sigmoid"):
        one = stats.fit_curve(series, ["status"], "year", "value", curve, 0.5).withColumn("curve", F.lit(curve))
        fitted = one if fitted is None else fitted.unionByName(one)
    return fitted.unionByName(stats.spline(series, ["status"], "year", "value", 0.5).withColumn("curve", F.lit("pchip")))


# trends

_TREND = f"{DTM}, t AS (SELECT year AS period, status, token, sum(value) AS value FROM cells JOIN idx USING (document_id) GROUP BY ALL)"


@query("trend_transform", f"WITH {_TREND} SELECT period, status, token, round(value / sum(value) OVER (PARTITION BY period, status), 9) AS value FROM t")
def trend_transform(spark, d):
    return tr.transform(orders_dtm(spark, d), tr.TrendOpts(pivots=("status",), normalize=True)).withColumn("value", F.round("value", 9))


@query("trend_tfidf", _TFIDF.replace("SELECT document_id, token, round(w /", ", z AS (SELECT document_id, token, w /").replace("), 8) AS value FROM w", ") AS value FROM w) SELECT year AS period, token, round(sum(value), 6) AS value FROM z JOIN idx USING (document_id) GROUP BY ALL"))
def trend_tfidf(spark, d):
    return tr.transform(orders_dtm(spark, d), tr.TrendOpts(metric="tf_idf")).withColumn("value", F.round("value", 6))


_WORDS = f"""WITH {TOK}, c AS (SELECT year - year % 10 AS period, token, count(*)::BIGINT AS value FROM tok GROUP BY ALL), f AS (SELECT * FROM c WHERE token = 'the' OR regexp_matches(token, '^.*ung$')),
k AS (SELECT token FROM f GROUP BY token ORDER BY sum(value) DESC, token LIMIT 8), x AS (SELECT f.* FROM f JOIN k USING (token))"""


def _extracted(spark, d):
    dtm = Dtm(vectorize(tokens(spark, d)), documents(spark, d).drop("text"))
    return tr.extract(tr.transform(dtm, tr.TrendOpts(temporal_key="decade")), ["the", "*ung"], 8)


@query("trend_extract", _WORDS + " SELECT period, token, value FROM x")
def trend_extract(spark, d):
    return _extracted(spark, d)


@query("trend_wide", _WORDS + " SELECT period, coalesce(sum(value) FILTER (token = 'the'), 0)::BIGINT AS the, coalesce(sum(value) FILTER (token = 'ung'), 0)::BIGINT AS ung FROM x GROUP BY period")
def trend_wide(spark, d):
    return tr.wide(_extracted(spark, d), ["the", "ung"])


@query("trend_unnest", _WORDS + " SELECT period, token, coalesce(sum(value), 0)::BIGINT AS value FROM (SELECT DISTINCT period FROM x) CROSS JOIN (SELECT unnest(['the', 'ung']) AS token) LEFT JOIN x USING (period, token) GROUP BY ALL")
def trend_unnest(spark, d):
    return tr.unnested(tr.wide(_extracted(spark, d), ["the", "ung"]), ["period"])


@query("trend_discriminating", f"""WITH {TOK}, s AS (SELECT count(*) FILTER (year BETWEEN 1950 AND 1979) AS n1, count(*) FILTER (year BETWEEN 1990 AND 2019) AS n2 FROM (SELECT 1950 + doc_id % 70 AS year FROM documents)),
c AS (SELECT token, count(*) AS tf, count(DISTINCT document_id) FILTER (year <= 1979) AS d1, count(DISTINCT document_id) FILTER (year >= 1990) AS d2 FROM tok WHERE year <= 1979 OR year >= 1990 GROUP BY token ORDER BY tf DESC, token LIMIT 1000)
SELECT token, CASE WHEN d1 / n1 - d2 / n2 >= 0 THEN 1 ELSE 2 END AS "group", round(abs(d1 / n1 - d2 / n2), 9) AS score FROM c, s ORDER BY abs(d1 / n1 - d2 / n2) DESC, token LIMIT 40""")
def trend_discriminating(spark, d):
    dtm = Dtm(vectorize(tokens(spark, d)), documents(spark, d).drop("text"))
    return tr.discriminating_terms(dtm, (1950, 1979), (1990, 2019), 40).withColumn("score", F.round("score", 9))


