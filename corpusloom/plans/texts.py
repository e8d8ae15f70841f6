"""Queries on text and token transforms, predicates, tagged tokens and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import predicates, text
from corpusloom.functions.tokens import TOKENS, TokensTransformOpts, chunks, only_alphabetic, remove_symbols, tokenize
from corpusloom.operators import tagged as tg
from corpusloom.operators import vocabulary as vc
from corpusloom.operators.dtm import Dtm, vectorize
from corpusloom.operators.index import dense_ids, filename_fields
from corpusloom.operators.windows import phrase_positions
from corpusloom.plans.tables import DTM, TAGGED, TOK, TURNS, documents, orders_dtm, query, table, tagged, token_arrays, tokens, turns


@query("topk_terms_by_lang", f"""WITH {TOK}, c AS (SELECT lang, token, count(*) AS tf FROM tok GROUP BY ALL)
SELECT lang, token, tf, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tf DESC, token)::INT AS rank FROM c) WHERE rank <= 10""")
def topk_terms_by_lang(spark, d):
    tok = tokens(spark, d, by_document=True)
    return Dtm(vectorize(tok), documents(spark, d).drop("text")).top_by_category("lang", 10)


def _text_query(name, keys, sql, prepare=lambda x: x):
    @query(name, sql)
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", text.transform_text(prepare(F.col("text")), keys).alias("text"))


_FROM, _TO = "‐‑⁃‒–—―−－⁻＋⁺⁄∕˜⁓∼∽∿〜～’՚Ꞌꞌ＇‘‚‛“”„‟´″‴‵‶‷⁗", "----------++//~~~~~~~''''''''\"\"\"\"`′′′′′′"
_text_query("txt_normalize_characters", "normalize-characters", f"""SELECT doc_id, translate(replace(replace(replace(text, ',', '’'), ' ', '―'), '.', '„'), '{_FROM}', '{_TO.replace("'", "''")}') AS text FROM documents""",
            lambda x: F.translate(x, ", .", "’―„"))
_text_query("txt_case", "to-lower,strip", "SELECT doc_id, trim(lower(text), E' \\n\\t\\r') AS text FROM documents")
_text_query("txt_dedent", "dedent", r"""SELECT doc_id, array_to_string(list_transform(string_split(replace(text, ' ', E'\n '), E'\n'), lambda s: trim(s, E' \t\r' || chr(11) || chr(12))), E'\n') AS text FROM documents""",
            lambda x: F.replace(x, F.lit(" "), F.lit("\n ")))
_text_query("txt_space_after_period", "space-after-period-uppercase", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.'), '\.([0-9A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ\-–])', '. \1', 'g'),
  '(?i)\s\.([0-9A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ\-–])', ' . \1', 'g'), '(?i)\s''([0-9A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ\-–])', ' '' \1', 'g') AS text FROM documents""",
            lambda x: F.replace(x, F.lit(". "), F.lit(".")))
_text_query("txt_currency", "replace-currency-symbols", r"SELECT doc_id, regexp_replace(replace(text, ' the ', ' €$ '), '\p{Sc}', '__cur__', 'g') AS text FROM documents", lambda x: F.replace(x, F.lit(" the "), F.lit(" €$ ")))
_text_query("txt_special_chars", "replace-special-characters", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}_\p{Z}\s\p{P}]', ' ', 'g') AS text FROM documents")
_text_query("txt_insert_space", "insert-space-after-period", r"SELECT doc_id, regexp_replace(replace(text, '. ', '.'), '\.([A-Z])', '. \1', 'g') AS text FROM documents", lambda x: F.replace(x, F.lit(". "), F.lit(".")))
_text_query("txt_dehyphen", "dehyphen", r"""SELECT doc_id, replace(regexp_replace(regexp_replace(replace(text, 'e ', E'e-\n '), '([\p{L}\p{M}\p{N}_]+)[-¬]\s*\r?\n\s*([\p{L}\p{M}\p{N}_]+)', '\1\2' || chr(10) || chr(57344), 'g'),
  chr(57344) || '\s+([\p{L}\p{M}\p{N}_])', '\1', 'g'), chr(57344), '') AS text FROM documents""", lambda x: F.replace(x, F.lit("e "), F.lit("e-\n ")))
_text_query("txt_strip_accents", "strip-accents", r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS text FROM documents")
_text_query("txt_nfc", "normalize-unicode", "SELECT doc_id, nfc_normalize(replace(text, 'e', 'e' || chr(769))) AS text FROM documents", lambda x: F.replace(x, F.lit("e"), F.lit("e\u0301")))
_text_query("txt_normalize_whitespace", "normalize-whitespace", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, ' ', '  '), '(\r\n|[\n\x0B])+', E'\n', 'g'), '[^\S\n\x0B]+', ' ', 'g'), E' \n') AS text FROM documents""",
            lambda x: F.replace(x, F.lit(" "), F.lit("  ")))

_LETTERS = "abcdefghijklmnopqrstuvwxyzåäöéàáâãæèêëîïñôùûÿ"
_SYMBOLS = "'\\¢£¥§©®°±øæç•›€™!\"#$%&()*+,./:;<=>?@[]^_`{|}~"
_SYMBOL_SQL = "[" + "".join("\\" + c if c in "\\[]^-" else c for c in _SYMBOLS).replace("'", "''") + "]"


@query("tok_filters", f"""WITH {TOK}, k AS (
  SELECT document_id, lower(token) AS token FROM tok WHERE regexp_matches(token, '[{_LETTERS}{_LETTERS.upper()}]') AND regexp_matches(token, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(token, '^\\p{{N}}+$')
    AND length(token) BETWEEN 3 AND 10 AND token NOT IN ('the', 'und'))
SELECT d.document_id, coalesce(n, 0) AS n_tokens, coalesce(s, 0)::BIGINT AS n_chars FROM (SELECT doc_id AS document_id FROM documents) d
LEFT JOIN (SELECT document_id, count(*) AS n, sum(length(token)) AS s FROM k GROUP BY 1) USING (document_id)""")
def tok_filters(spark, d):
    opts = TokensTransformOpts(only_alphabetic=True, only_any_alphanumeric=True, remove_numerals=True, min_len=3, max_len=10, extra_stopwords=("the", "und"), to_lower=True)
    kept = token_arrays(spark, d).withColumn("tokens", opts.apply(F.col("tokens")))
    return kept.select("document_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("n_chars"))


@query("tok_masks", f"""WITH {TOK} SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_types FROM tok
WHERE regexp_matches(token, '^[{_LETTERS}{_LETTERS.upper()}]*$') AND length(token) >= 2 AND token <> '' AND NOT regexp_matches(token, '^\\p{{N}}+$') AND NOT regexp_matches(token, '^{_SYMBOL_SQL}*$') GROUP BY lang""")
def tok_masks(spark, d):
    keep = TokensTransformOpts(only_alphabetic=True, min_len=2, remove_numerals=True, remove_symbols=True).mask(F.col("token"))
    return tokens(spark, d).where(keep).groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("token").alias("n_types"))


@query("tok_remove_symbols", f"""SELECT doc_id, len(t) AS n_tokens, list_sum(list_transform(t, lambda x: length(x)))::BIGINT AS n_chars FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\S+'), lambda x: regexp_replace(x, '{_SYMBOL_SQL}', '', 'g')), lambda x: x <> '') AS t FROM documents)""")
def tok_remove_symbols(spark, d):
    words = table(spark, d, "documents").select("doc_id", remove_symbols(tokenize(F.col("text"), r"[^ \t\n\r\f\x0B]+")).alias("t"))
    return words.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.when(F.size("t") > 0, F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x))).alias("n_chars"))


@query("tok_has_alphabetic", f"""WITH {TOK} SELECT lang, count(*) FILTER (regexp_matches(token, '\\p{{L}}')) AS has_alphabetic, count(*) FILTER (regexp_matches(token, '[\\p{{L}}\\p{{N}}]')) AS any_alphanumeric,
  count(*) FILTER (regexp_matches(token, '[{_LETTERS}{_LETTERS.upper()}]')) AS only_alphabetic, sum(length(lower(token)))::BIGINT AS lower_chars FROM tok GROUP BY lang""")
def tok_has_alphabetic(spark, d):
    a = token_arrays(spark, d)
    size = lambda key: F.size(TOKENS.get(key)(F.col("tokens")))
    lower = F.aggregate(TOKENS.get("to-lower")(F.col("tokens")), F.lit(0).cast("long"), lambda s, t: s + F.length(t))
    return a.groupBy("lang").agg(F.sum(size("has-alphabetic")).alias("has_alphabetic"), F.sum(size("only-any-alphanumeric")).alias("any_alphanumeric"), F.sum(F.size(only_alphabetic(F.col("tokens")))).alias("only_alphabetic"), F.sum(lower).alias("lower_chars"))


@query("tok_chunks", f"WITH {TOK} SELECT document_id, (pos // 100)::INT AS chunk, count(*) AS n_tokens, arg_min(token, pos) AS first_token FROM tok GROUP BY 1, 2")
def tok_chunks(spark, d):
    rows = token_arrays(spark, d).select("document_id", F.posexplode(chunks(F.col("tokens"), 100)).alias("chunk", "c"))
    return rows.select("document_id", "chunk", F.size("c").cast("long").alias("n_tokens"), F.get("c", F.lit(0)).alias("first_token"))


@query("tok_to_text", r"SELECT doc_id AS document_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS text FROM documents")
def tok_to_text(spark, d):
    return token_arrays(spark, d).select("document_id", F.array_join("tokens", " ").alias("text"))


@query("bow_to_text", """SELECT document_id, string_agg(repeat(token || ' ', n::INT)[:-2], ' ' ORDER BY token) AS text FROM (
  SELECT l_orderkey AS document_id, l_returnflag || l_linestatus AS token, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY document_id""")
def bow_to_text(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat("l_returnflag", "l_linestatus").alias("token"))
    return Dtm(vectorize(lines), lines).bags()


@query("src_filename_fields", """SELECT doc_id, source, lang, year FROM (SELECT doc_id, source, lang, 1950 + doc_id % 70 AS year FROM documents)""")
def src_filename_fields(spark, d):
    names = documents(spark, d).select(F.concat_ws("_", "source", "lang", F.col("year").cast("string"), F.concat(F.col("document_id").cast("string"), F.lit(".txt"))).alias("filename"))
    fields = filename_fields(F.col("filename"), ["source:_:0", "lang:_:1", "year:_:2", r"doc_id:.*_(\d+)\.txt"])
    return names.select(fields["doc_id"].cast("long").alias("doc_id"), fields["source"].alias("source"), fields["lang"].alias("lang"), fields["year"].cast("long").alias("year"))


@query("flt_mask_forms", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 300000
  AND NOT o_custkey IN (1, 2, 3) AND o_orderkey >= 10""")
def flt_mask_forms(spark, d):
    orders = table(spark, d, "orders")
    keys = {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice": (1000, 300000), "o_custkey": (False, [1, 2, 3]), "o_orderkey": ("ge", 10), "unknown": 1, "o_orderdate": None}
    return predicates.ValueMask(keys).apply(orders).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("flt_mask_list", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND NOT source IN ('src1', 'src2')")
def flt_mask_list(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(predicates.mask_list(docs, [{"name": "lang", "value": "en", "sign": True}, {"name": "source", "value": ["src1", "src2"], "sign": False}])).select("doc_id", "lang")


@query("flt_word_lookup", f"""WITH {TOK} SELECT token, count(*)::BIGINT AS tf FROM tok WHERE token IN ('the') OR regexp_matches(token, '^ent.*$') OR regexp_matches(token, '^.*ung$') OR regexp_matches(token, '^(?:qu[ei])') GROUP BY token""")
def flt_word_lookup(spark, d):
    return Dtm(vectorize(tokens(spark, d)), None).matching(["the", "ent*", "*ung", "|qu[ei]|"])


@query("flt_documents", f"""WITH {DTM} SELECT token, sum(value) AS tf FROM cells WHERE document_id IN (SELECT document_id FROM idx WHERE year BETWEEN 1996 AND 1998 AND status = 'O') GROUP BY token""")
def flt_documents(spark, d):
    return orders_dtm(spark, d).filter({"year": (1996, 1998), "status": "O"}).term_frequency()


@query("flt_pivot_keys", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def flt_pivot_keys(spark, d):
    keys = predicates.PivotKeys({"lang": ("lang_id", {"de": 1, "en": 2, "es": 3, "fr": 4})})
    docs = table(spark, d, "documents").withColumn("lang_id", F.element_at(F.create_map(*[F.lit(x) for p in keys.keys["lang"][1].items() for x in p]), F.col("lang"))).drop("lang")
    return keys.decode(docs.where(predicates.mask(docs, keys.filter_values(["lang: de", "lang: fr", "lang: xx"])))).select("doc_id", "lang")


# tagged tokens

_STACK = "((pos_tag IN ('NN', 'VB', 'DT') AND pos_tag NOT IN ('') AND token <> '' AND length(token) >= 3) OR token IN ('de', 'la')) AND token NOT IN ('the', 'und', '')"
_OPTS = tg.ExtractOpts(target="token", pos_includes="|NN|VB|", pos_paddings="|DT|", passthroughs=("de", "la"), blocks=("the", "und"))


def _counted(df):
    return df.groupBy("token", "pos_tag").agg(F.count(F.lit(1)).alias("n"))


@query("flt_tagged_stack", f"WITH {TAGGED} SELECT token, pos_tag, count(*) AS n FROM tagged WHERE {_STACK} GROUP BY ALL")
def flt_tagged_stack(spark, d):
    return _counted(tg.filter_tagged(tagged(spark, d), _OPTS, TokensTransformOpts(min_len=3)))


@query("flt_pos_pad", f"WITH {TAGGED} SELECT CASE WHEN pos_tag = 'DT' AND token NOT IN ('de', 'la') THEN '*' ELSE token END AS token, pos_tag, count(*) AS n FROM tagged WHERE {_STACK} GROUP BY ALL")
def flt_pos_pad(spark, d):
    return _counted(tg.padded(tg.filter_tagged(tagged(spark, d), _OPTS, TokensTransformOpts(min_len=3)), _OPTS))


@query("flt_append_pos", f"WITH {TAGGED} SELECT lower(lemma) || '@' || pos_tag AS token, pos_tag, count(*) AS n FROM tagged WHERE pos_tag IN ('JJ', 'AB') AND lemma <> '' GROUP BY ALL")
def flt_append_pos(spark, d):
    opts = tg.ExtractOpts(lemmatize=True, pos_includes="|JJ|AB|", append_pos=True)
    return _counted(tg.padded(tg.filter_tagged(tagged(spark, d), opts), opts))


@query("flt_low_tf_drop", f"WITH {TAGGED}, v AS (SELECT token FROM tagged GROUP BY token HAVING count(*) >= 20) SELECT token, pos_tag, count(*) AS n FROM tagged WHERE pos_tag = 'NN' AND token IN (SELECT token FROM v) GROUP BY ALL")
def flt_low_tf_drop(spark, d):
    rows = tagged(spark, d)
    return _counted(tg.filter_tagged(rows, tg.ExtractOpts(target="token", pos_includes="|NN|", tf_threshold=20), vocab=vc.term_counts(rows)))


@query("flt_low_tf_mask", f"WITH {TAGGED}, v AS (SELECT token FROM tagged GROUP BY token HAVING count(*) >= 20) SELECT CASE WHEN token IN (SELECT token FROM v) THEN token ELSE '__low-tf__' END AS token, pos_tag, count(*) AS n FROM tagged WHERE pos_tag = 'NN' GROUP BY ALL")
def flt_low_tf_mask(spark, d):
    rows = tagged(spark, d)
    return _counted(tg.filter_tagged(rows, tg.ExtractOpts(target="token", pos_includes="|NN|", tf_threshold=20, tf_mask=True), vocab=vc.term_counts(rows)))


@query("win_phrase_merge", f"""WITH {TOK}, w AS (SELECT *, lead(token) OVER o AS nxt, lag(token) OVER o AS prv FROM tok WINDOW o AS (PARTITION BY document_id ORDER BY pos))
SELECT CASE WHEN (token, nxt) IN (('of', 'the'), ('de', 'la'), ('in', 'the')) THEN token || '_' || nxt WHEN (prv, token) IN (('of', 'the'), ('de', 'la'), ('in', 'the')) THEN '(*)' ELSE token END AS token, count(*) AS n FROM w GROUP BY 1 HAVING n >= 20""")
def win_phrase_merge(spark, d):
    merged = phrase_positions(tokens(spark, d), [("of", "the"), ("de", "la"), ("in", "the")])
    return merged.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("agg_pos_groups", f"""WITH {TAGGED} SELECT document_id, count(*) FILTER (pos_tag = 'DT') AS "Pronoun", count(*) FILTER (pos_tag = 'NN') AS "Noun", count(*) FILTER (pos_tag = 'VB') AS "Verb", count(*) FILTER (pos_tag = 'AB') AS "Adverb",
 count(*) FILTER (pos_tag = 'RG') AS "Numeral", count(*) FILTER (pos_tag = 'JJ') AS "Adjective", count(*) FILTER (pos_tag = 'PP') AS "Preposition", 0::BIGINT AS "Conjunction", count(*) FILTER (pos_tag = 'MID') AS "Delimiter", 0::BIGINT AS "Other",
 count(*) FILTER (pos_tag <> 'MID') AS n_raw_tokens, count(*) FILTER (pos_tag <> 'MID') AS n_tokens FROM tagged GROUP BY document_id""")
def agg_pos_groups(spark, d):
    return tg.group_counts(tagged(spark, d))


@query("agg_pos_stats_over_time", f"""WITH {TAGGED}, c AS (SELECT year - year % 10 AS period, lang, count(*) FILTER (pos_tag = 'NN') AS nn, count(*) FILTER (pos_tag = 'VB') AS vb, count(*) FILTER (pos_tag <> 'MID') AS n FROM tagged GROUP BY ALL)
SELECT period, lang, round(nn / n, 9) AS noun_share, round(vb / n, 9) AS verb_share, n::BIGINT AS n_tokens FROM c""")
def agg_pos_stats_over_time(spark, d):
    index = documents(spark, d).select("document_id", "year", "lang")
    stats = tg.group_statistics(tg.group_counts(tagged(spark, d)), index, F.col("year") - F.pmod("year", F.lit(10)), ["lang"], normalize=True)
    return stats.select("period", "lang", F.round("Noun", 9).alias("noun_share"), F.round("Verb", 9).alias("verb_share"), "n_tokens")


# vocabularies


@query("agg_vocabulary", f"""WITH {TOK}, c AS (SELECT token, count(*) AS tf, min(document_id * 10000000 + pos) AS f FROM tok GROUP BY token) SELECT (row_number() OVER (ORDER BY f) - 1)::INT AS token_id, token, tf FROM c""")
def agg_vocabulary(spark, d):
    return vc.vocabulary(tokens(spark, d))


@query("agg_vocab_compress", f"""WITH {TOK}, c AS (SELECT token, count(*) AS tf FROM tok GROUP BY token) SELECT CASE WHEN tf >= 20 OR token = 'zu' THEN token ELSE '__low-tf__' END AS token, sum(tf)::BIGINT AS tf FROM c GROUP BY 1""")
def agg_vocab_compress(spark, d):
    return vc.compress(vc.term_counts(tokens(spark, d)), 20, ("zu",))


@query("agg_vocab_translate", f"""WITH {TOK}, {TURNS}, n AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT token FROM ttok))
SELECT token_id, count(*) AS value FROM tok JOIN n USING (token) GROUP BY token_id""")
def agg_vocab_translate(spark, d):
    old = vc.vocabulary(tokens(spark, d), first_seen=False)
    new = vc.vocabulary(turns(spark, d).select("document_id", F.posexplode("tokens").alias("pos", "token")), first_seen=False)
    # equal tokens get equal ids: counted first, each travels once
    cells = vc.encode(vc.term_counts(tokens(spark, d)).select("token", F.col("tf").alias("value")), old).select("token_id", "value")
    return vc.translate(cells, old, new).groupBy(F.col("token_id").cast("long").alias("token_id")).agg(F.sum("value").alias("value"))


@query("agg_encode_ids", f"""WITH {TOK}, v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT token FROM tok GROUP BY token HAVING count(*) >= 20))
SELECT document_id, count(*) AS n_tokens, sum(coalesce(token_id, -1))::BIGINT AS sum_ids FROM tok LEFT JOIN v USING (token) GROUP BY document_id""")
def agg_encode_ids(spark, d):
    tok = tokens(spark, d)
    counts = vc.term_counts(tok).where("tf >= 20")
    encoded = vc.encode(tok, dense_ids(counts.select("token"), ["token"], "token_id"), fallback=-1)
    return encoded.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("token_id").alias("sum_ids"))


@query("join_decode", f"""WITH {TOK}, v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT token FROM tok)) SELECT token, count(*) AS n FROM tok JOIN v USING (token) GROUP BY token""")
def join_decode(spark, d):
    tok = tokens(spark, d)
    vocab = vc.vocabulary(tok, first_seen=False)
    # equal tokens get equal ids: counted first, each travels once
    counts = vc.term_counts(tok).select("token", F.col("tf").alias("n"))
    return vc.decode(vc.encode(counts, vocab).select("token_id", "n"), vocab).groupBy("token").agg(F.sum("n").alias("n"))


@query("agg_dtm", f"WITH {TURNS} SELECT document_id, token, count(*) AS value FROM ttok GROUP BY ALL")
def agg_dtm(spark, d):
    return vectorize(turns(spark, d).select("document_id", F.explode("tokens").alias("token")))


@query("agg_dtm_min_df", f"""WITH {TOK}, c AS (SELECT document_id, token, count(*) AS value FROM tok WHERE token NOT IN ('la', 'de') GROUP BY ALL), t AS (SELECT token, count(*) AS df, sum(value) AS tf FROM c GROUP BY token)
SELECT token, count(*) AS df, sum(value)::BIGINT AS tf FROM c WHERE token IN (SELECT token FROM t WHERE df >= 20 AND df <= 0.5 * (SELECT count(DISTINCT document_id) FROM tok) AND tf >= 30) GROUP BY token""")
def agg_dtm_min_df(spark, d):
    cells = vectorize(tokens(spark, d), lowercase=True, stop_words=("la", "de"), min_df=20, max_df=0.5, min_tf=30)
    return cells.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("value").alias("tf"))


@query("agg_dtm_max_features", f"""WITH {TOK}, t AS (SELECT token FROM tok GROUP BY token ORDER BY count(*) DESC, token LIMIT 500) SELECT document_id, count(*) AS n_tokens, count(DISTINCT token) AS n_types FROM tok WHERE token IN (SELECT token FROM t) GROUP BY document_id""")
def agg_dtm_max_features(spark, d):
    return vectorize(tokens(spark, d), max_tokens=500).groupBy("document_id").agg(F.sum("value").alias("n_tokens"), F.count(F.lit(1)).alias("n_types"))


@query("agg_raw_vs_cooked", f"""WITH {TOK} SELECT d.document_id, count(token) AS n_raw_tokens, count(token) FILTER (length(token) >= 3) AS n_tokens FROM (SELECT doc_id AS document_id FROM documents) d LEFT JOIN tok USING (document_id) GROUP BY 1""")
def agg_raw_vs_cooked(spark, d):
    return token_arrays(spark, d).select("document_id", F.size("tokens").cast("long").alias("n_raw_tokens"), F.size(TOKENS.get("min-len?3")(F.col("tokens"))).cast("long").alias("n_tokens"))


@query("sparv_base_form", "SELECT doc_id, lower(CASE WHEN doc_id % 3 = 0 THEN source ELSE replace(replace('a b:' || lang, ' ', '_'), ':', '|') END) AS lemma FROM documents")
def sparv_base_form(spark, d):
    docs = table(spark, d, "documents")
    lemma = F.when(F.col("doc_id") % 3 == 0, F.lit("|")).otherwise(F.concat(F.lit("|a b:"), "lang", F.lit("|x|")))
    return docs.select("doc_id", tg.base_form(lemma, F.col("source")).alias("lemma"))
