"""Queries on readers, sinks, value helpers, sets, and further statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import tokens as tk
from corpusloom.operators import cooccurrence as co
from corpusloom.operators import dtm, ml, stats, values
from corpusloom.operators import index as ix
from corpusloom.operators import tagged as tg
from corpusloom.operators import topics as tp
from corpusloom.operators import vocabulary as vc
from corpusloom.plans.matrices import _YEARS as _GOF_YEARS
from corpusloom.plans.pairs import _SPELLED, W
from corpusloom.plans.pipeline import Pipeline
from corpusloom.plans.tables import DTM, DTW, TOK, TURNS, orders_dtm, query, table, token_arrays, tokens, topic_index, topic_tokens, topic_weights, turns
from corpusloom.sources import store, text
from corpusloom.sources.scratch import shared_folder


def _folder(spark, name):
    """A new folder for what a query writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(spark, d):
    """filename, text, lang, source of all documents."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("_"), "lang", F.lit(".txt")).alias("filename"), "text", "lang", "source")


# topics and indexes


def _chain(spark, d):
    index = topic_index(spark, d).withColumn("document_name", F.concat(F.lit("order_"), F.col("document_id")))
    return tp.TopicWeights(topic_weights(spark, d), index, topic_tokens(spark, d))


@query("topic_document_network", f"WITH {DTW} SELECT document_id, 'order_' || document_id AS title, 'topic ' || topic_id AS topic, round(0.1 + 1.9 * weight / max(weight) OVER (), 9) AS weight FROM dtw WHERE weight >= 0.2 AND topic_id NOT IN (0, 1)")
def topic_document_network(spark, d):
    found = _chain(spark, d).threshold(0.2).filter_by_topics([0, 1], negate=True).topic_document_network({k: f"topic {k}" for k in range(20)})
    return found.select("document_id", "title", F.col("topic_id").alias("topic"), F.round("weight", 9).alias("weight"))


@query("set_focus_and_others", f"WITH {DTW} SELECT document_id, topic_id, round(weight, 9) AS weight, year, topic_id IN (3, 4) AS focus FROM dtw WHERE document_id IN (SELECT document_id FROM dtw WHERE topic_id IN (3, 4))")
def set_focus_and_others(spark, d):
    return _chain(spark, d).focus_and_others([3, 4]).withColumn("weight", F.round("weight", 9))


@query("agg_documents_by_key", "SELECT lang, string_agg(n, ' ' ORDER BY n) AS names, count(*) AS n_documents FROM (SELECT lang, 'doc_' || doc_id || '_' || lang || '.txt' AS n FROM documents) GROUP BY lang")
def agg_documents_by_key(spark, d):
    docs = _documents(spark, d)
    names = ix.group_documents(docs, "lang", "filename").select("lang", F.array_join("document_names", " ").alias("names"))
    return names.join(ix.count_by(docs, "lang"), "lang")


# values and sets


@query("val_normalize", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderstatus), 9) AS share FROM orders")
def val_normalize(spark, d):
    return values.normalize_values(table(spark, d, "orders").withColumnRenamed("o_totalprice", "share"), "share", ["o_orderstatus"]).select("o_orderkey", F.round("share", 9).alias("share"))


for _order, _norm in ((1, "sum(abs(c_acctbal)) OVER (PARTITION BY c_mktsegment)"), (2, "sqrt(sum(c_acctbal * c_acctbal) OVER (PARTITION BY c_mktsegment))")):

    @query(f"val_norm_{_order}", f"SELECT c_custkey, round(c_acctbal / {_norm}, 9) + 0.0 AS share FROM customer")
    def val_norm(spark, d, order=_order):
        found = values.normalize_by_norm(table(spark, d, "customer"), "c_acctbal", order, ["c_mktsegment"])
        return found.select("c_custkey", (F.round("c_acctbal", 9) + F.lit(0.0)).alias("share"))


@query("val_ranges", "SELECT c_custkey, greatest(0.0, least(c_acctbal, 5000.0)) AS clamped, round(10 + 90 * c_acctbal / max(c_acctbal) OVER (), 7) AS scaled FROM customer")
def val_ranges(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", values.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("clamped"), F.col("c_acctbal").alias("scaled"))
    return values.scale_to_range(rows, "scaled", 10.0, 100.0).select("c_custkey", "clamped", F.round("scaled", 7).alias("scaled"))


@query("val_complete_range", "WITH r AS (SELECT min(n_chars) AS a, max(n_chars) AS b FROM documents) SELECT unnest(range(a, b + 1)) AS n_chars FROM r")
def val_complete_range(spark, d):
    return values.complete_range(table(spark, d, "documents"), "n_chars")


@query("val_year_range", f"WITH {DTM} SELECT min(year) AS low, max(year) AS high FROM idx")
def val_year_range(spark, d):
    return values.value_range(orders_dtm(spark, d).index)


@query("val_slim_types", "SELECT doc_id, coalesce(quality, 0)::SMALLINT::INT AS quality, coalesce(toxic, 0)::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def val_slim_types(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return values.slim_types(joined, {"quality": "int", "toxic": "double", "absent": "int"})


@query("val_rename_legacy", "SELECT doc_id, n_chars AS n_tokens FROM documents")
def val_rename_legacy(spark, d):
    return values.rename_legacy(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n_terms")))


@query("val_inverted", f"WITH {TURNS} SELECT token, role, count(*) AS n FROM ttok GROUP BY ALL")
def val_inverted(spark, d):
    return values.inverted(turns(spark, d).withColumnRenamed("tokens", "token"), "role", "token").groupBy("token", "role").agg(F.count(F.lit(1)).alias("n"))


@query("set_only_in_one", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def set_only_in_one(spark, d):
    return values.only_in_one(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("set_shared_tokens", f"WITH {TOK} SELECT DISTINCT token FROM tok WHERE lang = 'en' AND token IN (SELECT token FROM tok WHERE lang = 'de')")
def set_shared_tokens(spark, d):
    tok = tokens(spark, d)
    return values.shared_tokens(tok.where("lang = 'en'"), tok.where("lang = 'de'"))


@query("set_partitions", f"WITH {TOK} SELECT lang, token, count(*) AS tf FROM tok WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY ALL")
def set_partitions(spark, d):
    tok = tokens(spark, d)
    return values.by_partition({x: tok.where(F.col("lang") == x).groupBy("token").agg(F.count(F.lit(1)).alias("tf")) for x in ("en", "de", "fr", "es")}, "lang")


@query("agg_distinct_counts", f"WITH {TOK} SELECT lang, count(DISTINCT token) AS n_distinct FROM tok GROUP BY lang")
def agg_distinct_counts(spark, d):
    return values.distinct_counts(tokens(spark, d), ["lang"], "token")


@query("agg_distinct_about", f"WITH {TOK} SELECT lang, true AS near FROM tok GROUP BY lang")
def agg_distinct_about(spark, d):
    """Sketches against exact numbers: within five standard deviations."""
    tok = tokens(spark, d)
    exact = values.distinct_counts(tok, ["lang"], "token")
    about = values.distinct_counts(tok, ["lang"], "token", 0.02).withColumnRenamed("n_distinct", "about")
    return exact.join(about, "lang").select("lang", (F.abs(F.col("about") - F.col("n_distinct")) <= 0.1 * F.col("n_distinct") + 1).alias("near"))


@query("src_json_field", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def src_json_field(spark, d):
    return table(spark, d, "events").select("event_id", values.json_field(F.col("props"), "$.k", "int").alias("k"))


# windows and statistics


@query("win_glove", f"""WITH {TURNS}, p AS (SELECT a.role, least(a.token, b.token) AS w1, greatest(a.token, b.token) AS w2, sum(1.0::DOUBLE / (b.pos - a.pos)) AS x FROM ttok a JOIN ttok b ON a.rid = b.rid AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 WHERE a.token <> b.token GROUP BY ALL),
n AS (SELECT role, count(*) AS n FROM ttok GROUP BY 1) SELECT role, w1, w2, round(x, 6) AS nw_xy, 0 AS nw_x, 0 AS nw_y, round(x / n, 12) AS cwr FROM p JOIN n USING (role)""")
def win_glove(spark, d):
    return co.glove_frame(turns(spark, d), 4, "size", ["role"]).withColumns({"nw_xy": F.round("nw_xy", 6), "cwr": F.round("cwr", 12)})


@query("win_statistics", f"WITH {TURNS}, {_SPELLED} SELECT document_id, count(DISTINCT (rid, centre)) AS n_windows, sum(n)::BIGINT AS n_tokens FROM win GROUP BY 1")
def win_statistics(spark, d):
    return co.window_statistics(turns(spark, d).where(F.size("tokens") > 0), W)


@query("win_token_totals", f"WITH {TURNS}, {_SPELLED} SELECT role, token, sum(n)::BIGINT AS n FROM win GROUP BY ALL")
def win_token_totals(spark, d):
    return co.token_window_totals(turns(spark, d), W, ["role"])


@query("cooc_add_documents", f"WITH {TURNS}, {_SPELLED} SELECT w1, w2, sum(value)::BIGINT AS value FROM coo GROUP BY ALL")
def cooc_add_documents(spark, d):
    docs = turns(spark, d)
    first = F.col("role") == "user"
    return co.add_documents(co.window_pairs(docs.where(first), W, keys=()), co.window_pairs(docs.where(~first), W, keys=()))


@query("gof_selected", f"WITH {_GOF_YEARS} SELECT token, round(l2_norm, 6) AS l2_norm, round(slope, 6) AS slope, round(intercept - 1995 * slope, 4) AS intercept, round(earth_mover_distance, 6) AS earth_mover FROM g")
def gof_selected(spark, d):
    cells = orders_dtm(spark, d).group_by_time("year").withColumn("x", F.col("period") - 1995)
    found = stats.gof_metrics(cells, 7, ["l2_norm", "slope", "earth_mover"], x_offset=1995)
    return found.select("token", F.round("l2_norm", 6).alias("l2_norm"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("earth_mover", 6).alias("earth_mover"))


@query("stat_slopes_p")
def stat_slopes_p(spark, d):
    yearly = orders_dtm(spark, d).group_by_time("year").withColumnRenamed("period", "year")
    return stats.slopes_with_p(yearly, ["token"]).select("token", "k", "p")


@query("stat_token_counts", f"""WITH {DTM}, c AS (SELECT document_id, sum(value) FILTER (token % 2 = 0) AS even, sum(value) FILTER (token % 2 = 1) AS odd, sum(value) AS n FROM cells GROUP BY 1)
SELECT year, round(sum(even) / sum(n), 9) AS even, round(sum(odd) / sum(n), 9) AS odd FROM idx JOIN c USING (document_id) GROUP BY year""")
def stat_token_counts(spark, d):
    matrix = orders_dtm(spark, d)
    sums = matrix.cells.groupBy("document_id").agg(F.sum(F.when(F.col("token") % 2 == 0, F.col("value"))).alias("even"), F.sum(F.when(F.col("token") % 2 == 1, F.col("value"))).alias("odd"), F.sum("value").alias("n_tokens"))
    found = stats.token_count_data(matrix.index.join(sums, "document_id"), "year", ["even", "odd"], normalize=True, smooth=True)
    return found.withColumns({c: F.round(c, 9) for c in ("even", "odd")})


@query("stat_token_counts_gaps", """WITH g AS (SELECT n_regionkey * 10 + n_nationkey % 5 AS x, sum(n_nationkey)::DOUBLE AS v, n_nationkey % 3 = 0 AS gap FROM nation GROUP BY ALL), s AS (SELECT x, CASE WHEN bool_or(gap) THEN NULL ELSE sum(v) END AS y FROM g GROUP BY x),
b AS (SELECT x, y, max(CASE WHEN y IS NOT NULL THEN x END) OVER (ORDER BY x) AS xa, min(CASE WHEN y IS NOT NULL THEN x END) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xb FROM s)
SELECT b.x::INT AS x, round(coalesce(b.y, a.y + (c.y - a.y) * (b.x - xa) / (xb - xa), a.y), 9) AS y FROM b LEFT JOIN s a ON a.x = xa LEFT JOIN s c ON c.x = xb""")
def stat_token_counts_gaps(spark, d):
    nation = table(spark, d, "nation")
    x, gap = F.col("n_regionkey") * 10 + F.col("n_nationkey") % 5, F.col("n_nationkey") % 3 == 0
    rows = nation.select(x.alias("x"), F.col("n_nationkey").cast("double").alias("v"), gap.alias("gap"))
    # groups with a gap have no total, so their share is missing
    rows = rows.groupBy("x").agg(F.sum("v").alias("v"), F.max("gap").alias("gap")).select("x", F.when(~F.col("gap"), F.col("v")).alias("y"), F.when(F.col("gap"), 0.0).otherwise(1.0).alias("n_tokens"))
    return stats.token_count_data(rows, "x", ["y"], normalize=True, smooth=True).withColumn("y", F.round("y", 9))


# readers


@query("src_frame_filters", "SELECT 'doc_' || doc_id || '_' || lang || '.txt' AS filename, lang, source, length(text) AS n FROM documents WHERE lang IN ('de', 'fr') AND doc_id BETWEEN 10 AND 5000")
def src_frame_filters(spark, d):
    found = text.from_frame(_documents(spark, d).withColumnsRenamed({"text": "body", "filename": "file"}), text="body", filename="file", lang=["de", "fr"], doc_id=(10, 5000))
    return found.select("filename", "lang", "source", F.length("text").alias("n"))


@query("src_names", "SELECT 'doc_' || doc_id || '_' || lang || '.txt' AS filename, length(text) AS n FROM documents WHERE doc_id < 3")
def src_names(spark, d):
    docs = _documents(spark, d)
    names = [f"doc_{k}_{x}.txt" for k in range(3) for x in ("en", "de", "fr", "es")]
    return text.read_any(spark, docs, names=names).select("filename", F.length("text").alias("n"))


@query("src_documents", r"SELECT 'doc_' || doc_id || '_' || lang || '.txt' AS filename, doc_id AS number, lang AS tongue, length(regexp_replace(lower(trim(text, E' \t\n\r\f\x0b')), '\s+', ' ', 'g')) AS n FROM documents")
def src_documents(spark, d):
    found = text.read_documents(spark, _documents(spark, d).select("filename", "text"), fields=["number:_:1", "tongue:_:2"], transforms="lowercase,strip", types={"number": "bigint"})
    return found.select("filename", "number", "tongue", F.length(F.regexp_replace("text", r"\s+", " ")).alias("n"))


@query("src_document_index", "SELECT f AS filename, f[:-5] AS document_name, (row_number() OVER (ORDER BY encode(f)) - 1)::BIGINT AS document_id, year FROM (SELECT 'doc_' || doc_id || '_' || lang || '.txt' AS f, (1950 + doc_id % 70)::INT AS year FROM documents)")
def src_document_index(spark, d):
    docs = _documents(spark, d).select("filename", (F.lit(1950) + F.col("doc_id") % 70).alias("y"))
    return text.document_index(docs, year="y").select("filename", "document_name", "document_id", "year")


@query("src_rendered", "SELECT doc_id, '# ' || doc_id || ' (' || lang || ', ' || source || ')' AS page FROM documents WHERE 'doc_' || doc_id || '_' || lang = 'doc_7_' || lang")
def src_rendered(spark, d):
    docs = _documents(spark, d).withColumn("document_name", F.concat(F.lit("doc_"), F.col("doc_id")))
    return text.find_document(docs, "doc_7").select("doc_id", text.render("# {doc_id} ({lang}, {source})", docs.columns).alias("page"))


@query("src_lines", "SELECT n_name AS document_name, n_name || ' of region ' || n_regionkey AS text FROM nation")
def src_lines(spark, d):
    folder = _folder(spark, "lines")
    table(spark, d, "nation").select(F.concat("n_name", F.lit("\t"), "n_name", F.lit(" of region "), "n_regionkey")).write.text(folder)
    return text.read_lines(spark, folder, "\t")


@query("src_text_files", "SELECT 'nation_' || n_nationkey || '.txt' AS filename, 'nation_' || n_nationkey AS document_name, n_name || E'\\nof region ' || n_regionkey || E'\\n' AS text FROM nation")
def src_text_files(spark, d):
    """One file a row, as folders of texts come; the sink is a folder that driver and executors share."""
    folder = _folder(spark, "texts")
    rows = table(spark, d, "nation").select(F.concat(F.lit("nation_"), "n_nationkey", F.lit(".txt")), F.concat("n_name", F.lit("\nof region "), "n_regionkey", F.lit("\n")))
    store.write_text_files(spark, folder, [tuple(r) for r in rows.collect()])  # 25 rows
    return text.read_text_folder(spark, folder)


@query("src_zip_members", "SELECT 'region_' || r_regionkey || '.txt' AS filename, r_name AS text FROM region")
def src_zip_members(spark, d):
    folder = _folder(spark, "zips")
    rows = table(spark, d, "region").select(F.concat(F.lit("region_"), "r_regionkey", F.lit(".txt")), "r_name")
    store.write_zip(spark, f"{folder}/regions.zip", [tuple(r) for r in rows.collect()])  # 5 rows
    return text.read_any(spark, f"{folder}/regions.zip").select("filename", "text")


@query("src_tagged_csv", "SELECT n_nationkey + 0 AS pos, n_name AS token, lower(n_name) AS lemma, 'NN' || n_regionkey AS pos_tag FROM nation")
def src_tagged_csv(spark, d):
    folder = _folder(spark, "tagged")
    rows = table(spark, d, "nation").orderBy("n_nationkey").select(F.concat_ws("\t", "n_name", F.concat(F.lit("NN"), "n_regionkey"), F.concat(F.lit("|"), F.lower("n_name"), F.lit("|"))))
    head = spark.createDataFrame([("token\tpos\tbaseform",), ("# a comment",)], "value string")
    store.write_text_files(spark, folder, [("nations.csv", "\n".join(r[0] for r in [*head.collect(), *rows.collect()]) + "\n")])  # 27 lines
    return text.tagged_csv(spark, folder, sparv=True).select("pos", "token", "lemma", "pos_tag")


@query("src_tagged_xml", "SELECT 'n' || n_nationkey AS document_name, unnest(range(2))::INT AS pos, unnest([n_name, 'x' || n_regionkey]) AS token, unnest([lower(n_name), 'x' || n_regionkey]) AS lemma, unnest(['PM', 'RG']) AS pos_tag FROM nation")
def src_tagged_xml(spark, d):
    n = table(spark, d, "nation")
    xml = F.concat(F.lit('<text><s><w lemma="|'), F.lower("n_name"), F.lit('|" pos="PM">'), "n_name", F.lit('</w> <w lemma="|" pos="RG">x'), "n_regionkey", F.lit("</w></s></text>"))
    return text.tagged_xml(n.select(F.concat(F.lit("n"), "n_nationkey").alias("document_name"), xml.alias("text")))


@query("src_doc_topics", f"WITH {DTW} SELECT document_id, topic_id, round(weight / sum(weight) OVER (PARTITION BY document_id), 9) AS weight FROM dtw WHERE weight >= 0.05")
def src_doc_topics(spark, d):
    folder = _folder(spark, "doc-topics")
    pair = F.concat_ws("\t", F.col("topic_id").cast("string"), F.col("weight").cast("string"))
    lines = topic_weights(spark, d).groupBy("document_id").agg(F.concat_ws("\t", F.collect_list(pair)).alias("p")).select(F.concat_ws("\t", F.col("document_id").cast("string"), F.concat(F.lit("name"), "document_id"), "p"))
    lines.unionByName(spark.createDataFrame([("#doc name topic proportion ...",)], lines.schema)).write.text(folder)
    return text.doc_topics(spark, folder, normalize=True, least=0.05).withColumn("weight", F.round("weight", 9))


# sinks


@query("snk_checkpoint", "SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY lang")
def snk_checkpoint(spark, d):
    path = _folder(spark, "checkpoint")
    for _ in range(2):  # made once, read from then on
        docs = store.checkpoint(spark, path, lambda: table(spark, d, "documents").select("lang", "text"), partition_by=("lang",))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("snk_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, replace(c_acctbal::VARCHAR, '.', ',') AS c_acctbal FROM customer")
def snk_csv(spark, d):
    path = _folder(spark, "csv")
    store.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, decimal_comma=True)
    return spark.read.csv(path, sep="\t", header=True, schema="c_custkey string, c_name string, c_acctbal string")


@query("snk_dtm", f"WITH {DTM}, t AS (SELECT token FROM cells GROUP BY 1 HAVING sum(value) >= 1000) SELECT document_id, token, value FROM cells WHERE token IN (SELECT token FROM t)")
def snk_dtm(spark, d):
    saved = store.Store(spark, _folder(spark, "dtm"))
    saved.save_dtm(orders_dtm(spark, d), source="orders")
    if saved.options() != {"source": "orders"} or not store.find_tags(spark, saved.folder.rsplit("/", 1)[0]):
        raise ValueError("the store has lost its options")
    return saved.load_dtm(tf_threshold=1000).cells


@query("snk_reduced", "SELECT lang, count(*) AS n_documents, md5(string_agg(text, E'\\n' ORDER BY encode('doc_' || doc_id || '_' || lang || '.txt'))) AS digest FROM documents GROUP BY lang")
def snk_reduced(spark, d):
    return store.reduce_corpus(_documents(spark, d), "lang").select("lang", "n_documents", F.md5("text").alias("digest"))


@query("snk_pipeline", f"WITH {TOK} SELECT document_id, token, count(*) AS value FROM tok WHERE length(token) >= 4 GROUP BY ALL")
def snk_pipeline(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("filename"), "text")
    saved = Pipeline.read(spark, docs).tokenize().transform_tokens(tk.TokensTransformOpts(min_len=4)).vocabulary().store(_folder(spark, "pipeline"))
    return Pipeline(saved.load("docs")).to_dtm().cells


# matrices and vocabularies


@query("agg_from_texts", f"WITH {TOK} SELECT document_id, count(DISTINCT token) AS n_types, count(*) AS n_tokens FROM tok GROUP BY 1")
def agg_from_texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang")
    return dtm.from_texts(docs).cells.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_types"), F.sum("value").alias("n_tokens"))


@query("agg_from_tokens", f"WITH {TURNS} SELECT token, count(*) AS tf FROM ttok GROUP BY 1")
def agg_from_tokens(spark, d):
    return dtm.from_tokens(turns(spark, d)).term_frequency().select("token", F.col("tf"))


@query("agg_from_bags", f"WITH {DTM} SELECT token AS document_id, document_id AS token, value FROM cells")
def agg_from_bags(spark, d):
    return dtm.from_bags(orders_dtm(spark, d).transposed()).cells


@query("agg_from_pairs", f"WITH {TURNS}, {_SPELLED} SELECT document_id, w1 || '/' || w2 AS token, value FROM coo")
def agg_from_pairs(spark, d):
    return dtm.from_pairs(co.window_pairs(turns(spark, d), W)).cells


@query("agg_with_index", f"WITH {DTM} SELECT document_id, token, value FROM cells WHERE document_id IN (SELECT document_id FROM idx WHERE status = 'O')")
def agg_with_index(spark, d):
    matrix = orders_dtm(spark, d)
    return matrix.with_index(matrix.index.where("status = 'O'")).cells


@query("agg_vocab_opened", f"WITH {TOK}, a AS (SELECT token, count(*) AS tf FROM tok WHERE lang = 'en' GROUP BY 1), b AS (SELECT token, count(*) AS tf FROM tok WHERE lang = 'de' AND token NOT IN (SELECT token FROM a) GROUP BY 1) SELECT (row_number() OVER (ORDER BY encode(token)) - 1)::INT AS token_id, token, tf FROM a UNION ALL SELECT ((SELECT count(*) FROM a) + row_number() OVER (ORDER BY encode(token)) - 1)::INT, token, tf FROM b")
def agg_vocab_opened(spark, d):
    tok = tokens(spark, d)
    return vc.opened(vc.vocabulary(tok.where("lang = 'en'"), first_seen=False), tok.where("lang = 'de'"))


@query("flt_attributes", f"WITH {TOK} SELECT document_id, pos, token FROM tok WHERE length(token) > 6 AND NOT regexp_matches(token, '\\p{{N}}')")
def flt_attributes(spark, d):
    flags = tokens(spark, d).withColumns({"is_long": F.length("token") > 6, "has_number": F.col("token").rlike(r"\p{N}")})
    return tg.filter_attributes(flags, is_long=True, has_number=False).select("document_id", F.col("pos").cast("long").alias("pos"), "token")


# tokens


@query("tok_stopwords", None)
def tok_stopwords(spark, d):
    return token_arrays(spark, d).select("document_id", F.array_join(tk.remove_stopwords(F.col("tokens"), tk.language_stopwords("english")), " ").alias("text"))


@query("tok_extra_stopwords", f"WITH {TOK} SELECT document_id, count(*) AS n FROM tok WHERE token NOT IN ('the', 'und', 'la') GROUP BY 1")
def tok_extra_stopwords(spark, d):
    arrays = token_arrays(spark, d).select("document_id", F.size(tk.remove_stopwords(F.col("tokens"), ("the", "und", "la"))).cast("long").alias("n"))
    return arrays.where("n > 0")


@query("ml_lsi")
def ml_lsi(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("token"), "l_quantity")
    return ml.train_lsi(dtm.Dtm(lines.groupBy("document_id", "token").agg(F.sum("l_quantity").alias("value")), None), 5)[0]
