"""Queries on topics, graphs, models and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph, ml
from corpusloom.operators import topics as tp
from corpusloom.operators.dtm import Dtm, vectorize
from corpusloom.plans.tables import DTW, documents, orders_dtm, query, table, tokens, topic_index, topic_tokens, topic_weights
from corpusloom.sources.scratch import written
from corpusloom.sources.text import html_text, read_tokens, segments


def _chain(spark, d):
    return tp.TopicWeights(topic_weights(spark, d), topic_index(spark, d), topic_tokens(spark, d))


def _rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("topic_threshold_keys", f"WITH {DTW} SELECT document_id, topic_id, round(weight, 9) AS weight, year FROM dtw WHERE weight >= 0.5 AND year = 1997 AND document_id IN (SELECT document_id FROM idx WHERE status = 'F')")
def topic_threshold_keys(spark, d):
    return _rounded(_chain(spark, d).filter_by_data_keys(year=1997).threshold(0.5).filter_by_document_keys(status="F").data, "weight")


@query("topic_focus", f"WITH {DTW} SELECT document_id, topic_id, round(weight, 9) AS weight, year, topic_id IN (3, 4) AS focus FROM dtw WHERE document_id IN (SELECT document_id FROM dtw WHERE topic_id IN (3, 4))")
def topic_focus(spark, d):
    return _rounded(_chain(spark, d).filter_by_focus_topics([3, 4]).data, "weight")


@query("topic_text", f"WITH {DTW}, t AS (SELECT topic_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, token) AS p FROM ttw) WHERE p <= 20 AND regexp_matches(token, '(?i)P10')) SELECT document_id, topic_id, round(weight, 9) AS weight, year FROM dtw WHERE topic_id IN (SELECT topic_id FROM t)")
def topic_text(spark, d):
    return _rounded(_chain(spark, d).filter_by_text("P10", 20).data, "weight")


@query("topic_top_documents", f"WITH {DTW} SELECT document_id, topic_id, round(weight, 9) AS weight, year, status, priority FROM (SELECT * FROM dtw WHERE topic_id NOT IN (0, 1) ORDER BY weight DESC, document_id, topic_id LIMIT 100) JOIN (SELECT document_id, status, priority FROM idx) USING (document_id)")
def topic_top_documents(spark, d):
    chain = _chain(spark, d).filter_by_topics([0, 1], negate=True).filter_by_n_top(100).overload(["status", "priority"])
    return _rounded(chain.data, "weight")


@query("topic_prevalence", f"""WITH {DTW}, s AS (SELECT year, topic_id, max(weight) AS mx, sum(weight) AS sm, avg(weight) AS av, count(*) AS n, avg(weight) FILTER (weight >= 0.2) AS ab FROM dtw GROUP BY ALL), nd AS (SELECT year, count(*) AS n_documents FROM idx GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY year, document_id ORDER BY weight DESC, topic_id) AS r FROM dtw), t AS (SELECT year, topic_id, count(*) AS top_n FROM r WHERE r <= 2 GROUP BY ALL),
f AS (SELECT unnest(range((SELECT min(year) FROM dtw), (SELECT max(year) FROM dtw) + 1))::INT AS year), g AS (SELECT year, unnest(range(0, (SELECT max(topic_id) FROM dtw) + 1))::INT AS topic_id FROM f)
SELECT year, topic_id, round(coalesce(mx, 0), 6) AS max_weight, round(coalesce(sm, 0), 6) AS sum_weight, round(coalesce(av, 0), 6) AS avg_weight, coalesce(n, 0) AS n_topic_documents, round(coalesce(ab, 0), 6) AS average_weight, coalesce(n_documents, 0) AS n_documents,
 coalesce(top_n, 0) AS top_n_documents, round(coalesce(sm / n_documents, 0), 6) AS true_average_weight, round(coalesce(top_n / n_documents, 0), 6) AS top_n_weight FROM g LEFT JOIN s USING (year, topic_id) LEFT JOIN nd USING (year) LEFT JOIN t USING (year, topic_id)""")
def topic_prevalence(spark, d):
    found = tp.yearly_weights(topic_weights(spark, d), topic_index(spark, d), threshold=0.2, n_top=2)
    return _rounded(found, "max_weight", "sum_weight", "avg_weight", "average_weight", "true_average_weight", "top_n_weight", digits=6)


@query("topic_proportions", f"WITH {DTW}, s AS (SELECT topic_id, sum(weight * n_tokens) AS s FROM dtw JOIN tidx USING (document_id) GROUP BY 1) SELECT topic_id, round(s / sum(s) OVER (), 9) AS proportion FROM s")
def topic_proportions(spark, d):
    return _rounded(tp.topic_proportions(topic_weights(spark, d), topic_index(spark, d)), "proportion")


@query("topic_topic_network", f"WITH {DTW} SELECT a.topic_id AS source, b.topic_id AS target, count(*) AS n_docs FROM dtw a JOIN dtw b ON a.document_id = b.document_id AND a.topic_id < b.topic_id WHERE a.weight >= 0.05 AND b.weight >= 0.05 GROUP BY ALL HAVING count(*) >= 10")
def topic_topic_network(spark, d):
    return _chain(spark, d).threshold(0.05).topic_topic_network(10)


@query("topic_pivot_network", f"WITH {DTW}, s AS (SELECT status, topic_id, avg(weight) AS w FROM dtw JOIN idx USING (document_id) GROUP BY ALL HAVING avg(weight) > 0.1) SELECT status, topic_id, round(0.1 + 0.9 * w / max(w) OVER (), 9) AS weight FROM s")
def topic_pivot_network(spark, d):
    return _rounded(_chain(spark, d).pivot_topic_network("status", "mean", 0.1), "weight")


@query("topic_token_network", f"WITH {DTW} SELECT * FROM (SELECT topic_id, token, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, token)::INT AS position FROM ttw) WHERE position <= 10")
def topic_token_network(spark, d):
    return tp.top_tokens(topic_tokens(spark, d), 10)


_CODE = "CASE WHEN topic_id IN (1, 2, 3) THEN 1 WHEN topic_id IN (7, 9) THEN 7 ELSE topic_id END"
_CLUSTERS = {"a": [1, 2, 3], "b": [7, 9]}


@query("topic_merge", f"WITH {DTW} SELECT document_id, {_CODE} AS topic_id, year, round(sum(weight), 9) AS weight FROM dtw GROUP BY ALL")
def topic_merge(spark, d):
    return _rounded(tp.merge_topics(topic_weights(spark, d), _CLUSTERS), "weight")


@query("topic_compress", f"WITH {DTW}, m AS (SELECT token, {_CODE} AS topic_id, sum(weight) AS weight FROM ttw GROUP BY ALL) SELECT token, (dense_rank() OVER (ORDER BY topic_id) - 1)::INT AS topic_id, weight FROM m")
def topic_compress(spark, d):
    return tp.compress_topics(tp.merge_topics(topic_tokens(spark, d), _CLUSTERS))


_OVERVIEW = "o AS (SELECT topic_id, string_agg(token, ' ' ORDER BY p) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, token) AS p FROM ttw) WHERE p <= 15 GROUP BY 1)"


@query("topic_overview", f"WITH {DTW}, {_OVERVIEW} SELECT topic_id, tokens FROM o")
def topic_overview(spark, d):
    return tp.overview(topic_tokens(spark, d), 15)


@query("topic_titles", f"WITH {DTW}, {_OVERVIEW} SELECT topic_id, replace(upper(tokens), 'P', 'P') AS tokens FROM o")
def topic_titles(spark, d):
    return tp.overview(topic_tokens(spark, d), 15, title=True)


@query("topic_search", f"WITH {DTW}, {_OVERVIEW}, n AS (SELECT topic_id, array_to_string(string_split(tokens, ' ')[1:10], ' ') AS top FROM o) SELECT topic_id, regexp_replace(top, '(?i)p1', '<b>p1</b>', 'g') AS tokens FROM n WHERE regexp_matches(top, '(?i)p1')")
def topic_search(spark, d):
    return tp.search_overview(tp.overview(topic_tokens(spark, d), 15), "p1", 10, truncate=True, highlight="<b>{}</b>")


@query("topic_saliency", f"""WITH {DTW}, m AS (SELECT token, (abs(topic_id + x) % 5)::INT AS topic_id, sum(weight / (1 + x)) AS weight FROM ttw, (SELECT unnest([0, 1, 2]) AS x) GROUP BY ALL), q AS (SELECT topic_id, sum(weight) / (SELECT sum(weight) FROM m) AS q FROM m GROUP BY 1),
p AS (SELECT token, topic_id, weight / sum(weight) OVER (PARTITION BY token) AS p FROM m), k AS (SELECT token, sum(p * ln(p / q)) AS dis FROM p JOIN q USING (topic_id) GROUP BY 1), f AS (SELECT token, sum(weight) AS frequency FROM ttw GROUP BY 1)
SELECT token, frequency, round(dis, 7) AS distinctiveness, round(frequency * dis, 5) AS saliency FROM k JOIN f USING (token)""")
def topic_saliency(spark, d):
    ttw = topic_tokens(spark, d)
    spread = ttw.select("token", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("x"), "topic_id", "weight")
    mixed = spread.groupBy("token", ((F.col("topic_id") + F.col("x")) % 5).alias("topic_id")).agg(F.sum(F.col("weight") / (1 + F.col("x"))).alias("weight"))
    found = tp.saliency(mixed, ttw.groupBy("token").agg(F.sum("weight").alias("tf")))
    return found.select("token", "frequency", F.round("distinctiveness", 7).alias("distinctiveness"), F.round("saliency", 5).alias("saliency"))


# graphs

_EDGES = f"{DTW}, e AS (SELECT a.topic_id AS source, b.topic_id AS target, count(*) AS weight FROM dtw a JOIN dtw b ON a.document_id = b.document_id AND a.topic_id < b.topic_id GROUP BY ALL)"


def _edges(spark, d):
    return _chain(spark, d).topic_topic_network().withColumnRenamed("n_docs", "weight")


@query("graph_nodes", f"WITH {_EDGES} SELECT id, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT source AS id, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY id")
def graph_nodes(spark, d):
    return graph.nodes(_edges(spark, d))


@query("graph_edges", f"WITH {_EDGES} SELECT source, target, weight FROM e")
def graph_edges(spark, d):
    return _edges(spark, d)


@query("graph_subnetwork", f"WITH {_EDGES} SELECT source, target, weight FROM e WHERE weight >= 0.9 * greatest(1.0, (SELECT max(weight) FROM e))")
def graph_subnetwork(spark, d):
    return graph.sub_network(_edges(spark, d), 0.9)


@query("graph_bipartite", f"WITH {_EDGES} SELECT count(*) = 0 AS bipartite FROM (SELECT DISTINCT source FROM e) JOIN (SELECT DISTINCT target FROM e) ON source = target")
def graph_bipartite(spark, d):
    return graph.is_bipartite(_edges(spark, d))


_WALKS = """, m AS (SELECT source, target FROM e WHERE weight >= 0.9 * greatest(1.0, (SELECT max(weight) FROM e))), u AS (SELECT source AS a, target AS b FROM m UNION SELECT target, source FROM m), v AS (SELECT DISTINCT a AS id FROM u),
walk AS (SELECT id AS s, id AS t, 0 AS d FROM v UNION SELECT s, b, d + 1 FROM walk JOIN u ON t = a WHERE d < 20), dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY ALL),
path AS (SELECT id AS s, id AS t, 0 AS d FROM v UNION ALL SELECT path.s, u.b, path.d + 1 FROM path JOIN u ON path.t = u.a JOIN dist ON dist.s = path.s AND dist.t = u.b AND dist.d = path.d + 1), sig AS (SELECT s, t, d, count(*)::DOUBLE AS n FROM path GROUP BY ALL),
bt AS (SELECT v.id, coalesce(sum(x.n * y.n / z.n), 0) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2) AS b FROM v LEFT JOIN sig x ON x.t = v.id AND x.s <> v.id LEFT JOIN sig y ON y.s = v.id AND y.t NOT IN (v.id, x.s) LEFT JOIN sig z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d GROUP BY v.id)"""


@query("graph_betweenness", f"WITH RECURSIVE {_EDGES}{_WALKS} SELECT id::VARCHAR AS id, round(b, 9) AS betweenness, round(7 + 10 * coalesce(b / nullif(max(b) OVER (), 0), 0), 7) AS size FROM bt")
def graph_betweenness(spark, d):
    found = graph.betweenness(graph.sub_network(_edges(spark, d), 0.9))
    return found.withColumns({"betweenness": F.round("betweenness", 9), "size": F.round("size", 7)})


@query("graph_louvain")
def graph_louvain(spark, d):
    return graph.louvain(_edges(spark, d))


# models


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


@query("ml_kmeans")
def ml_kmeans(spark, d):
    return ml.kmeans(_vectors(spark, d), "embedding", 8).select("vec_id", "cluster")


@query("ml_bisecting_kmeans")
def ml_bisecting_kmeans(spark, d):
    return ml.cluster_profiles(ml.kmeans(_vectors(spark, d), "embedding", 8, bisecting=True), "embedding")


@query("ml_pca")
def ml_pca(spark, d):
    return ml.pca(_vectors(spark, d), "embedding", 3).select("vec_id", "projection")


@query("ml_hca")
def ml_hca(spark, d):
    profiles = orders_dtm(spark, d).group_by_time("year").groupBy("token").pivot("period", list(range(1995, 2002))).agg(F.sum("value")).na.fill(0)
    rows = profiles.select("token", F.array(*[F.col(str(y)) for y in range(1995, 2002)]).alias("v")).withColumn("total", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return ml.hierarchical_clusters(rows, "token", "v", 200, "total", threshold=100.0)


@query("ml_lda")
def ml_lda(spark, d):
    dtm = Dtm(written(vectorize(tokens(spark, d, by_document=True), min_df=10), "cells"), documents(spark, d).drop("text"))
    model, vocab, vectors = ml.train_topics(dtm, k=4, max_iter=5, optimizer="em")
    return ml.predict_topics(model, vectors)


@query("ml_topic_tokens")
def ml_topic_tokens(spark, d):
    dtm = Dtm(written(vectorize(tokens(spark, d, by_document=True), min_df=10), "cells"), documents(spark, d).drop("text"))
    model, vocab, _ = ml.train_topics(dtm, k=4, max_iter=5, optimizer="em")
    ttw = ml.topic_token_weights(model, vocab, 50)
    return ttw.join(ml.coherence(ttw, dtm.cells), "topic_id")


# sources


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<!--.*?-->', ' ', 'g'), '(?i)<br\\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol|table|section|article|nav)>', E'\\n', 'g'), '(?s)<[^>]*>', ' ', 'g')""".replace("\\\\", "\\")
for _entity, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_sign}')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t\x0B\f\r]+', ' ', 'g'), ' ?\n[ \n]*', E'\n', 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query("src_html_text", f"SELECT page_id, {_HTML} AS text FROM pages")
def src_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


# a mark is put at each place where sentences part, as this side has no patterns that look behind
_SPLIT = r"""regexp_replace(regexp_replace(text, '([.!?][\"''”’)]?)\s+([\"''“‘(]?[\p{Lu}\p{N}])', E'\\1\x01\\2', 'g'), '\n{2,}', E'\x01', 'g')"""


@query("src_segments", f"SELECT doc_id, (k - 1)::INT AS segment, s AS text FROM (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, list_filter(string_split({_SPLIT}, E'\\x01'), lambda x: length(trim(x)) > 0) AS l FROM documents))")
def src_segments(spark, d):
    return segments(table(spark, d, "documents").select("doc_id", "text"), "sentence")


@query("src_token_chunks", r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(1, (len(t) + 499) // 500))) AS k FROM t)
SELECT doc_id || '_' || lpad((k + 1)::VARCHAR, 3, '0') AS document_name, greatest(0, least(500, len(t) - k * 500))::INT AS n_tokens FROM c""")
def src_token_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_name"), "text", F.concat("doc_id", F.lit(".txt")).alias("filename"))
    return read_tokens(spark, docs, chunk_size=500).select("document_name", F.size("tokens").alias("n_tokens"))
