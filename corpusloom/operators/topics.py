"""Operators on topic weights.

dtw: document_id, topic_id, weight, year; ttw: topic_id, token, weight; index: one row a document.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.predicates import mask, search_predicate
from corpusloom.operators.index import overload
from corpusloom.operators.values import scale_to_range

NO_TOKENS = "Topics has no significant presence in any documents in the entire corpus"


@dataclass(frozen=True)
class TopicWeights:
    """A chain of filters on document-topic weights."""

    data: DataFrame
    index: DataFrame
    ttw: DataFrame | None = None

    def _with(self, data: DataFrame) -> TopicWeights:
        return replace(self, data=data)

    def filter_by_data_keys(self, **values) -> TopicWeights:
        return self._with(self.data.where(mask(self.data, values)))

    def filter_by_document_keys(self, **values) -> TopicWeights:
        """F17, J7."""
        return self._with(self.data.join(self.index.where(mask(self.index, values)).select("document_id"), "document_id", "left_semi"))

    def threshold(self, least: float) -> TopicWeights:
        """nothing happens at 0 or below."""
        return self._with(self.data.where(F.col("weight") >= least)) if least > 0 else self

    def filter_by_topics(self, topics: list[int], negate: bool = False) -> TopicWeights:
        keep = F.col("topic_id").isin(*topics)
        return self._with(self.data.where(~keep if negate else keep))

    def filter_by_focus_topics(self, topics: list[int]) -> TopicWeights:
        """All rows of documents that have a focus topic; focus marks that topic's rows."""
        own = F.col("topic_id").isin(*topics)
        return self._with(self.data.join(self.data.where(own).select("document_id").distinct(), "document_id", "left_semi").withColumn("focus", own))

    def filter_by_text(self, search: str, n_top: int) -> TopicWeights:
        """topics with the text in one of their top words."""
        if len(search or "") < 3:
            return self
        top = top_tokens(self.ttw, n_top).where(search_predicate(F.col("token"), search)).select("topic_id").distinct()
        return self._with(self.data.join(top, "topic_id", "left_semi"))

    def filter_by_n_top(self, n: int) -> TopicWeights:
        """Ties go to the smaller document, then topic."""
        return self._with(self.data.orderBy(F.desc("weight"), "document_id", "topic_id").limit(n))

    def overload(self, columns: list[str]) -> TopicWeights:
        """J4."""
        return self._with(overload(self.data, self.index, columns))

    def topic_topic_network(self, n_docs: int = 1, keys: list[str] = ()) -> DataFrame:
        """Pairs of topics and how many documents have both; each document's pairs come from its own list of topics."""
        lists = self.data.groupBy(*keys, "document_id").agg(F.sort_array(F.collect_set("topic_id")).alias("_t"))
        pairs = F.flatten(F.transform("_t", lambda a, i: F.transform(F.slice("_t", i + 2, F.size("_t")), lambda b: F.struct(a.alias("s"), b.alias("t")))))
        counts = lists.select(*keys, F.explode(pairs).alias("_p")).groupBy(*keys, F.col("_p.s").alias("source"), F.col("_p.t").alias("target")).agg(F.count(F.lit(1)).alias("n_docs"))
        return counts.where(F.col("n_docs") >= n_docs) if n_docs > 1 else counts

    def topic_document_network(self, labels: dict[int, str] | None = None, low: float = 0.1, high: float = 2.0) -> DataFrame:
        """The rows with their documents' names as titles, weights scaled so that the largest is ``high``, topics by their labels on demand."""
        rows = scale_to_range(self.data, "weight", low, high).join(self.index.select("document_id", "document_name"), "document_id").withColumn("title", F.col("document_name"))
        if labels is None:
            return rows
        pairs = [F.lit(x) for pair in labels.items() for x in pair]
        return rows.withColumn("topic_id", F.try_element_at(F.create_map(*pairs), F.col("topic_id")) if pairs else F.lit(None).cast("string"))

    def focus_and_others(self, topics: list[int]) -> DataFrame:
        """The focus topics' rows and the other rows of their documents, one after the other."""
        focus = self.filter_by_topics(topics)
        others = self.filter_by_topics(topics, negate=True).data.join(focus.data.select("document_id").distinct(), "document_id", "left_semi")
        return focus.data.withColumn("focus", F.lit(True)).unionByName(others.withColumn("focus", F.lit(False)))

    def pivot_topic_network(self, key: str, aggregate: str = "mean", threshold: float = 0.0) -> DataFrame:
        """Mean or maximal weight of each topic by a pivot column, above the threshold, scaled so that the largest is 1 and none is below 0.1."""
        data = self.data if key in self.data.columns else overload(self.data, self.index, [key])
        sums = data.groupBy(key, "topic_id").agg((F.avg if aggregate == "mean" else F.max)("weight").alias("_w")).where(F.col("_w") > threshold)
        most = sums.agg(F.max("_w").alias("_m"))
        return sums.join(F.broadcast(most)).select(key, "topic_id", (0.1 + 0.9 * F.col("_w") / F.col("_m")).alias("weight"))  # one row


def yearly_weights(dtw: DataFrame, index: DataFrame, threshold: float = 0.0, n_top: int = 0) -> DataFrame:
    """A row for each year between the first and last and each topic from 0 to the largest.

    max_weight, sum_weight, avg_weight, n_topic_documents; n_documents of the year; true_average_weight (sum over all documents of
    the year); average_weight (of weights from the threshold on); with ``n_top`` also top_n_documents (in which the topic is among
    the document's n heaviest; ties to the smaller topic) and top_n_weight, their share. 0 where there is nothing.
    """
    span = dtw.agg(F.min("year").alias("_a"), F.max("year").alias("_b"), F.max("topic_id").alias("_t")).where("_a is not null")
    frame = span.select(F.explode(F.sequence("_a", "_b")).alias("year"), "_t").select("year", F.explode(F.sequence(F.lit(0).cast(dtw.schema["topic_id"].dataType), "_t")).alias("topic_id"))
    w = F.col("weight")
    above = F.avg(F.when(w >= threshold, w)) if threshold > 0 else F.avg(w)
    stats = dtw.groupBy("year", "topic_id").agg(F.max(w).alias("max_weight"), F.sum(w).alias("sum_weight"), F.avg(w).alias("avg_weight"), F.count(F.lit(1)).alias("n_topic_documents"), above.alias("average_weight"))
    documents = index.groupBy("year").agg(F.count(F.lit(1)).alias("n_documents"))
    out = frame.join(stats, ["year", "topic_id"], "left").join(documents, "year", "left")
    if n_top:
        order = Window.partitionBy("year", "document_id").orderBy(F.desc("weight"), "topic_id")
        tops = dtw.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_top).groupBy("year", "topic_id").agg(F.count(F.lit(1)).alias("top_n_documents"))
        out = out.join(tops, ["year", "topic_id"], "left")
    out = out.na.fill(0)
    out = out.withColumn("true_average_weight", F.coalesce(F.try_divide("sum_weight", "n_documents"), F.lit(0.0)))
    return out.withColumn("top_n_weight", F.coalesce(F.try_divide("top_n_documents", "n_documents"), F.lit(0.0))) if n_top else out


def topic_proportions(dtw: DataFrame, index: DataFrame) -> DataFrame:
    """Share of each topic, documents weighed by n_tokens."""
    sums = dtw.join(index.select("document_id", "n_tokens"), "document_id").groupBy("topic_id").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("_s"))
    total = sums.agg(F.sum("_s").alias("_all"))
    return sums.join(F.broadcast(total)).select("topic_id", (F.col("_s") / F.col("_all")).alias("proportion"))  # one row


def recode(topic: Column, clusters: dict[str, list[int]]) -> Column:
    """The first topic of its cluster, itself if in none."""
    pairs = [F.lit(x) for members in clusters.values() for m in members for x in (m, members[0])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), topic), topic) if pairs else topic


def merge_topics(weights: DataFrame, clusters: dict[str, list[int]]) -> DataFrame:
    """Weights of merged topics summed, by all other columns."""
    others = [c for c in weights.columns if c not in ("topic_id", "weight")]
    return weights.groupBy(recode(F.col("topic_id"), clusters).alias("topic_id"), *others).agg(F.sum("weight").alias("weight"))


def compress_topics(weights: DataFrame) -> DataFrame:
    """Topics in use numbered anew from 0, in their order."""
    used = weights.select("topic_id").distinct()
    codes = used.withColumn("_new", (F.row_number().over(Window.orderBy("topic_id")) - 1).cast(weights.schema["topic_id"].dataType))  # one row a topic
    return weights.join(codes, "topic_id").withColumn("topic_id", F.col("_new")).drop("_new")


def top_tokens(ttw: DataFrame, n: int) -> DataFrame:
    """The n heaviest tokens of each topic and their position from 1; ties to the smaller token."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "token")
    return ttw.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def overview(ttw: DataFrame, n: int, title: bool = False) -> DataFrame:
    """topic_id, tokens: the n heaviest tokens joined, as titles with capitals."""
    token = F.initcap("token") if title else F.col("token")
    return top_tokens(ttw, n).groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", token.alias("t")))), lambda s: s["t"]), " ").alias("tokens"))


def search_overview(topics: DataFrame, search: str, n_top: int, truncate: bool = False, highlight: str | None = None) -> DataFrame:
    """Topics with the text among the first n words; on demand only those words, and the text marked up in ``highlight`` (``{}``)."""
    if not search:
        return topics
    top = F.array_join(F.slice(F.split("tokens", " "), 1, n_top), " ")
    found = topics.where(top.rlike(f"(?i){search}"))
    if truncate:
        found = found.withColumn("tokens", top)
    if highlight:
        found = found.withColumn("tokens", F.regexp_replace("tokens", f"(?i)\\Q{search}\\E", highlight.format(search).replace("$", "\\$")))
    return found


def saliency(ttw: DataFrame, frequency: DataFrame) -> DataFrame:
    """Token, frequency, distinctiveness (divergence of its topics' shares from the topics' weights), saliency (their product)."""
    marginal = ttw.groupBy("topic_id").agg(F.sum("weight").alias("_q"))
    total = marginal.agg(F.sum("_q").alias("_all"))
    marginal = marginal.join(F.broadcast(total)).select("topic_id", (F.col("_q") / F.col("_all")).alias("_q"))  # one row
    of_token = ttw.groupBy("token").agg(F.sum("weight").alias("_sum"))
    shares = ttw.join(of_token, "token").join(marginal, "topic_id").withColumn("_p", F.col("weight") / F.col("_sum"))  # one row a topic
    found = shares.groupBy("token").agg(F.sum(F.col("_p") * F.ln(F.col("_p") / F.col("_q"))).alias("distinctiveness")).join(frequency.withColumnRenamed("tf", "frequency"), "token")
    return found.withColumn("saliency", F.col("frequency") * F.col("distinctiveness"))
