"""Queries on context windows, co-occurrence and keyness of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import keyness as ky
from corpusloom.operators import cooccurrence as co
from corpusloom.operators.windows import context_windows, sliding
from corpusloom.plans.tables import TOK, TURNS, query, table, token_arrays, turns

#: Context width of the queries: windows of five tokens.
W = 2


@query("win_context", f"""WITH {TURNS} SELECT document_id, pos, array_to_string(list_slice(t, greatest(1, pos + 1 - {W}), pos + 1 + {W}), ' ') AS words FROM turns JOIN (SELECT rid, pos FROM ttok) USING (rid)""")
def win_context(spark, d):
    rows = turns(spark, d).select("document_id", F.posexplode(context_windows(F.col("tokens"), W)).alias("pos", "w"))
    return rows.select("document_id", F.col("pos").cast("long").alias("pos"), F.array_join("w", " ").alias("words"))


@query("win_sliding", f"""WITH {TURNS} SELECT document_id, pos, array_to_string(list_slice(t, pos + 1, pos + 4), ' ') AS words FROM turns JOIN (SELECT rid, pos FROM ttok) USING (rid)""")
def win_sliding(spark, d):
    rows = turns(spark, d).select("document_id", F.posexplode(sliding(F.col("tokens"), 3)).alias("pos", "w"))
    return rows.select("document_id", F.col("pos").cast("long").alias("pos"), F.array_join("w", " ").alias("words"))


# every window spelled out: one row for each token of each window
_SPELLED = f"""win AS (SELECT c.rid, c.document_id, c.role, c.pos AS centre, x.token, count(*) AS n FROM ttok c JOIN ttok x ON x.rid = c.rid AND x.pos BETWEEN c.pos - {W} AND c.pos + {W} GROUP BY ALL),
coo AS (SELECT a.document_id, a.role, a.token AS w1, b.token AS w2, sum(a.n * b.n)::BIGINT AS value FROM win a JOIN win b ON a.rid = b.rid AND a.centre = b.centre AND a.token < b.token GROUP BY ALL)"""


@query("cooc_windows", f"WITH {TURNS}, {_SPELLED} SELECT document_id, w1, w2, value FROM coo")
def cooc_windows(spark, d):
    return co.window_pairs(turns(spark, d), W)


@query("cooc_window_counts", f"WITH {TURNS}, {_SPELLED} SELECT document_id, token, count(*) AS n_windows FROM win GROUP BY ALL")
def cooc_window_counts(spark, d):
    return co.window_counts(turns(spark, d), W)


@query("cooc_concept", f"""WITH {TURNS}, {_SPELLED}, hit AS (SELECT DISTINCT rid, centre FROM win WHERE token IN ('the', 'la'))
SELECT a.role, a.token AS w1, b.token AS w2, sum(a.n * b.n)::BIGINT AS value FROM win a JOIN hit USING (rid, centre) JOIN win b ON a.rid = b.rid AND a.centre = b.centre AND a.token < b.token GROUP BY ALL""")
def cooc_concept(spark, d):
    return co.concept_pairs(turns(spark, d), W, ("the", "la"), keys=("role",))


@query("cooc_threshold", f"WITH {TURNS}, {_SPELLED} SELECT document_id, w1, w2, value FROM coo WHERE (w1, w2) IN (SELECT (w1, w2) FROM coo GROUP BY w1, w2 HAVING sum(value) >= 20)")
def cooc_threshold(spark, d):
    return co.above_global_threshold(co.window_pairs(turns(spark, d), W), 20)


@query("cooc_group", f"WITH {TURNS}, {_SPELLED} SELECT role, w1, w2, sum(value)::BIGINT AS value FROM coo GROUP BY ALL")
def cooc_group(spark, d):
    coo = co.window_pairs(turns(spark, d), W, keys=("document_id", "role"))
    return co.group_pairs(coo, ["role"])


# the whole corpus by language; windows by position arithmetic on this side, too: spelled out they would take minutes
_BY_LANG = f"""{TOK}, sizes AS (SELECT document_id, count(*) AS n FROM tok GROUP BY 1), pp AS (
  SELECT a.lang, least(a.token, b.token) AS w1, greatest(a.token, b.token) AS w2, sum(least(n - 1, a.pos + {W}) - greatest(0, b.pos - {W}) + 1)::BIGINT AS value
  FROM tok a JOIN (SELECT unnest(range(1, {2 * W} + 1)) AS dist) ON true JOIN tok b ON b.document_id = a.document_id AND b.pos = a.pos + dist JOIN sizes s ON s.document_id = a.document_id WHERE a.token <> b.token GROUP BY ALL
), lc AS (SELECT lang, w1, w2, value FROM pp)"""


def _by_lang(spark, d):
    """All pairs of each language, however rare; common windows are counted with multiplicity."""
    return co.window_pairs(token_arrays(spark, d), W, keys=("lang",))


@query("cooc_corpus_by_lang", f"WITH {_BY_LANG} SELECT lang, w1, w2, value FROM lc")
def cooc_corpus_by_lang(spark, d):
    return _by_lang(spark, d)


@query("cooc_documents", """WITH c AS (SELECT l_orderkey AS document_id, l_returnflag || l_linestatus || l_linenumber AS token, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT a.token AS w1, b.token AS w2, sum(a.value * b.value) AS value FROM c a JOIN c b ON a.document_id = b.document_id AND a.token < b.token GROUP BY ALL""")
def cooc_documents(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("token"), "l_quantity")
    from corpusloom.operators.dtm import Dtm

    return Dtm(lines.groupBy("document_id", "token").agg(F.sum("l_quantity").alias("value")), None).term_pairs()


_N = "(SELECT lang, count(*) AS n_words FROM tok GROUP BY lang)"
_SUMS = f"""{_BY_LANG}, zz AS (SELECT lang, sum(value)::DOUBLE AS z FROM lc GROUP BY 1), rs AS (SELECT lang, w1 AS w, sum(value)::DOUBLE AS s FROM lc GROUP BY ALL),
j AS (SELECT lc.lang, lc.w1, lc.w2, lc.value, lc.value::DOUBLE AS c, z, coalesce(p.s, 0) AS a, coalesce(q.s, 0) AS b, n_words::DOUBLE AS n FROM lc JOIN zz USING (lang) LEFT JOIN rs p ON p.lang = lc.lang AND p.w = lc.w1 LEFT JOIN rs q ON q.lang = lc.lang AND q.w = lc.w2 JOIN {_N} nw ON nw.lang = lc.lang)"""
_L = "ln(greatest({0}, 1e-10))"


def _like(k, m, p):
    return f"({_L.format(p)} * {k} + {_L.format('1 - ' + p)} * ({m} - {k}))"


def _dunning(z):
    p, pi, pj = f"(b / {z})", "(CASE WHEN a = 0 THEN NULL ELSE c / a END)", f"(CASE WHEN {z} - a = 0 THEN NULL ELSE (b - c) / ({z} - a) END)"
    return f"-2 * {_like('c', 'a', p)} + {_like('(b - c)', f'({z} - a)', p)} - {_like('c', 'a', pi)} - {_like('(b - c)', f'({z} - a)', pj)}"


_XLX = lambda v: f"({v}) * {_L.format(v)}"
_METRICS = {
    "PPMI": "CASE WHEN a * b = 0 THEN 0 ELSE greatest(ln(c * z / (a * b)), 0) END",
    "DICE": "CASE WHEN a + b = 0 THEN 0 ELSE 2 * c / (a + b) END",
    "LLR": f"2 * ({_XLX('z')} - {_XLX('a')} - {_XLX('b')} + {_XLX('c')} + {_XLX('z - a - b + c')} + {_XLX('a - c')} + {_XLX('b - c')} - {_XLX('z - a')} - {_XLX('z - b')})",
    "LLR_Z": _dunning("z"),
    "LLR_N": _dunning("n"),
    "HAL_cwr": "CASE WHEN a + b - c = 0 THEN 0 ELSE c / (a + b - c) END",
}

# the log-likelihoods add terms as large as the corpus, which differ between engines in the places that are left: brute force tests them
for _metric, _sql in _METRICS.items():

    @query(f"key_{_metric.lower()}", None if _metric.startswith("LLR") else f"WITH {_SUMS}, m AS (SELECT lang, w1, w2, value, coalesce({_sql}, 0) AS weight FROM j) SELECT lang, w1, w2, value, round(weight, 5) AS weight FROM m WHERE weight <> 0")
    def key_metric(spark, d, metric=_metric):
        # the other metrics do not ask for numbers of words
        words = token_arrays(spark, d).groupBy("lang").agg(F.sum(F.size("tokens")).alias("n_words")) if metric == "LLR_N" else None
        return ky.significance(_by_lang(spark, d), metric, ["lang"], words).withColumn("weight", F.round("weight", 5))


@query("key_hal_cwr_windows", f"""WITH {TURNS}, {_SPELLED}, nw AS (SELECT document_id, token, count(*) AS n FROM win GROUP BY ALL)
SELECT c.document_id, w1, w2, value, round(greatest(CASE WHEN x.n + y.n - value = 0 THEN 0 ELSE value / (x.n + y.n - value) END, 0), 9) AS weight FROM coo c JOIN nw x ON x.document_id = c.document_id AND x.token = w1 JOIN nw y ON y.document_id = c.document_id AND y.token = w2""")
def key_hal_cwr_windows(spark, d):
    docs = turns(spark, d)
    return ky.hal_cwr_by_windows(co.window_pairs(docs, W), co.window_counts(docs, W), ["document_id"]).withColumn("weight", F.round("weight", 9))


@query("key_weighed", f"""WITH {TURNS}, {_SPELLED}, full_ AS (SELECT role, w1, w2, sum(value)::DOUBLE AS v FROM coo GROUP BY ALL), hit AS (SELECT DISTINCT rid, centre FROM win WHERE token = 'the'),
con AS (SELECT a.role, a.token AS w1, b.token AS w2, sum(a.n * b.n)::DOUBLE AS v FROM win a JOIN hit USING (rid, centre) JOIN win b ON a.rid = b.rid AND a.centre = b.centre AND a.token < b.token GROUP BY ALL)
SELECT role, w1, w2, round(con.v / full_.v, 9) AS value FROM con JOIN full_ USING (role, w1, w2)""")
def key_weighed(spark, d):
    docs = turns(spark, d)
    full = co.window_pairs(docs, W, keys=("role",))
    return ky.weigh(full, co.concept_pairs(docs, W, ("the",), keys=("role",)), ["role"], "value").withColumn("value", F.round("value", 9))


@query("key_per_words", f"WITH {_SUMS} SELECT lang, w1, w2, round(c / n, 12) AS value FROM j")
def key_per_words(spark, d):
    words = token_arrays(spark, d).groupBy("lang").agg(F.sum(F.size("tokens")).alias("n_words"))
    return ky.per_words(_by_lang(spark, d), words, ["lang"]).withColumn("value", F.round("value", 12))


@query("win_largest_pairs", f"WITH {_BY_LANG} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY value DESC, w1, w2)::INT AS rank FROM lc) WHERE rank <= 20")
def win_largest_pairs(spark, d):
    return co.largest(_by_lang(spark, d), 20, ["lang"])


@query("join_match_pairs", f"WITH {_BY_LANG} SELECT * FROM lc WHERE w1 IN ('the', 'und') OR w2 IN ('the', 'und')")
def join_match_pairs(spark, d):
    return co.match(_by_lang(spark, d), ["the", "und"])


@query("join_exclude_pairs", f"WITH {_BY_LANG} SELECT * FROM lc WHERE w1 NOT IN ('the', 'und') AND w2 NOT IN ('the', 'und')")
def join_exclude_pairs(spark, d):
    return co.exclude(_by_lang(spark, d), ["the", "und"])


for _k, _weight in ((0, "4 - (b.pos - a.pos)"), (1, "1.0::DOUBLE / (b.pos - a.pos)"), (2, "1.0::DOUBLE")):

    @query(f"win_hal_weights_{_k}", f"WITH {TURNS} SELECT a.role, a.token AS w1, b.token AS w2, round(sum({_weight})::DOUBLE, 6) AS weight FROM ttok a JOIN ttok b ON a.rid = b.rid AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 GROUP BY ALL")
    def win_hal_weights(spark, d, metric=_k):
        return co.hal_weights(turns(spark, d), 3, metric, ["role"]).withColumn("weight", F.round("weight", 6))


@query("win_hal_cwr", f"""WITH {TURNS}, p AS (SELECT a.role, least(a.token, b.token) AS w1, greatest(a.token, b.token) AS w2, count(*)::DOUBLE AS nw_xy FROM ttok a JOIN ttok b ON a.rid = b.rid AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 WHERE a.token <> b.token GROUP BY ALL),
c AS (SELECT role, token, sum(least(pos + 1, 4))::DOUBLE AS n FROM ttok GROUP BY ALL)
SELECT p.role, w1, w2, nw_xy, x.n AS nw_x, y.n AS nw_y, round(CASE WHEN x.n + y.n = nw_xy THEN 0 ELSE nw_xy / (x.n + y.n - nw_xy) END, 9) AS cwr FROM p JOIN c x ON x.role = p.role AND x.token = w1 JOIN c y ON y.role = p.role AND y.token = w2""")
def win_hal_cwr(spark, d):
    return co.hal_frame(turns(spark, d), 3, 2, ["role"]).withColumn("cwr", F.round("cwr", 9))


@query("cooc_decode_split", f"WITH {_BY_LANG} SELECT lang, w1 AS first, w2 AS second, value FROM lc")
def cooc_decode_split(spark, d):
    from corpusloom.operators.trends import split_token

    paired = _by_lang(spark, d).select("lang", F.concat_ws("/", "w1", "w2").alias("token"), "value")
    return split_token(paired, ("first", "second")).drop("token")

