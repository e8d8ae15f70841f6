"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words by water-filling: the sources share ``share`` of all words by weight, no source
more than ``most`` times its own words, the excess shared again among the rest. A source whose target is r times its words
takes each of its documents floor(r) times for certain. What is left of the target is a sample of unequal probabilities: a
document is included with probability f = min(1, c * m), m being the square root of its words, rounded up, and c such that the
expected words are what is left. The square root lies between giving documents and giving words equal weight. Documents with
f = 1 are certain, too. The others are ranked by random odds over inclusion odds, u/(1-u) / (f/(1-f)), u being a hash of id and
text, and the first ones are taken until the sample has its fixed size, which is measured in words.

The cut in the ranking is found without ranking a source in one task: a histogram of the ranks tells the bin in which the cut
lies, that bin is divided again while it holds many documents, and only the last bin's documents are ordered. c comes from the
words per distinct m, of which a source has no more than the square root of its longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.scratch import broadcast_checked, free_name, word_count, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Bits of a draw, and of a rank when ranks are put in bins.
BITS = 52
#: Bits by which one level of the histogram refines a bin.
STEP = 8


def draws(ids: Column, texts: Column, seed: str) -> Column:
    """52 bits of a hash of id and text: the random number u is this plus a half, over 2**52."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(ids.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(texts, F.lit("")))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes``: one row a source (_source, _words). Adds _target: min(most * words, level * weight), the targets' sum being share of all words.

    One row a source is all that this sorts; sources without words get 0.
    """
    order = Window.orderBy(F.col("_source").isNull(), F.encode("_source", "utf-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", most * F.col("_words"))
    # in the order of the level at which they fill up: the sources before the first one that does not are full
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").isNull(), F.encode("_source", "utf-8"))
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("_words").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    return (
        ranked.withColumn("_level", left / open_weight)
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.col("_level"))).over(every))
        .select("_source", "_words", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_weight"))).alias("_target"))
    )


def inclusion(by_measure: DataFrame, keys: list[str]) -> DataFrame:
    """``by_measure``: one row per source (``keys``) and measure _m, with its words _w and the source's _rest. Returns keys, _c, _sure.

    From the largest m on, c is what is left over the sum of m times words below; the first m with c * m < 1 is not certain, and
    _sure are the words of those before it.
    """
    falling = Window.partitionBy(*keys).orderBy(F.desc("_m"))
    above = F.coalesce(F.sum("_w").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("_m") * F.col("_w")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = by_measure.withColumn("_sure", above).withColumn("_c", (F.col("_rest") - F.col("_sure")) / below)
    return tried.where(F.col("_c") * F.col("_m") < 1).groupBy(*keys).agg(F.max_by("_c", "_m").alias("_c"), F.max_by("_sure", "_m").alias("_sure"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", rows_per_bin: int = 4096) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, draw.

    taken is a whole number of copies times size, so no document exceeds ceil(most) times its size, and a source's taken
    words miss its target by no more than half the size of one document. Null text has size 0, a null source is a source of
    its own. draw is the hash of id and text; rows that agree in both are interchangeable, and the mix takes as many of them as
    fit. The same input gives the same mix, however it is partitioned. Other columns are ignored; an empty table gives an empty
    result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = written(
        df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), word_count(text).alias("_size"), draws(F.col(f"`{id_col}`").cast("long"), text, seed).alias("_draw")),
        "mix-sizes",
    )
    keys = ["_key", "_null"]
    rows = rows.select("_id", "_size", "_draw", F.ceil(F.sqrt(F.col("_size").cast("double"))).alias("_m"), F.coalesce("_source", F.lit("")).alias("_key"), F.col("_source").isNull().alias("_null"))
    by_measure = written(rows.groupBy(*keys, "_m").agg(F.sum("_size").alias("_w")), "mix-measures")
    per_source = by_measure.groupBy(*keys).agg(F.sum("_w").alias("_words")).withColumn("_source", F.when(~F.col("_null"), F.col("_key")))
    goal = (
        targets(per_source.select("_source", "_words"), share, most, weights)
        .withColumn("_certain", F.coalesce(F.floor(F.try_divide(F.col("_target"), F.col("_words"))), F.lit(0)))
        .withColumn("_rest", F.greatest(F.col("_target") - F.col("_certain") * F.col("_words"), F.lit(0.0)))
        .select(F.coalesce("_source", F.lit("")).alias("_key"), F.col("_source").isNull().alias("_null"), "_words", "_target", "_certain", "_rest")
    )
    goal = written(goal, "mix-targets")
    chances = inclusion(by_measure.where("_m > 0").join(goal.select(*keys, "_rest"), keys), keys)
    goal = written(goal.join(chances, keys, "left").withColumn("_rest", F.greatest(F.col("_rest") - F.coalesce("_sure", F.lit(0)), F.lit(0.0))), "mix-goals")
    goal = broadcast_checked(goal)  # one row a source
    u = (F.col("_draw") + 0.5) / float(2**BITS)
    f = F.col("_c") * F.col("_m")
    rows = rows.join(goal, keys).withColumn("_f", f).withColumn("_q", F.when((F.col("_f") > 0) & (F.col("_f") < 1), (u / (1 - u)) / (F.col("_f") / (1 - F.col("_f")))))
    sure = rows.where(F.col("_q").isNull()).withColumn("_more", F.coalesce(F.col("_f") >= 1, F.lit(False)))
    # the rank as an integer that keeps its order
    open_ = rows.where(F.col("_q").isNotNull()).withColumn("_rank", F.floor(F.col("_q") / (1 + F.col("_q")) * float(2**BITS)))
    cut = _cut(open_, keys, rows_per_bin)
    open_ = open_.join(cut, keys, "left").withColumn("_bin", F.shiftright("_rank", cut_shift(cut)))
    clear = open_.where(~F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False))).withColumn("_more", (F.col("_rest") > 0) & F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(True)))
    # rows that agree are counted, so that however many there are, few are ordered
    alike = [*keys, "_q", "_id", "_size"]
    edge = open_.where(F.col("_bin") == F.col("_cut")).groupBy(*alike).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_draw", "_words", "_target", "_certain", "_rest", "_before")])
    run = F.sum(F.col("_size") * F.col("_n")).over(Window.partitionBy(*keys).orderBy("_q", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("_rest") - F.col("_before") - (run - F.col("_size") * F.col("_n"))
    # the document on which the running words pass the target is taken if that comes closer to it
    edge = edge.withColumn("_some", F.least(F.greatest(F.floor((left + F.col("_size") / 2) / F.col("_size")), F.lit(0)), F.col("_n")))
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("_more"), F.col("_some").alias("_n")), F.struct(F.lit(False).alias("_more"), (F.col("_n") - F.col("_some")).alias("_n"))))
    edge = _repeated(edge.withColumn("_kind", kinds).select("_id", "_size", "_draw", "_words", "_target", "_certain", "_kind.*"), "_n")
    columns = ["_id", "_size", "_draw", "_words", "_target", "_certain", "_more"]
    both = sure.select(columns).unionByName(clear.select(columns)).unionByName(edge.select(columns))
    names = [free_name(n, [id_col]) for n in ("size", "source_size", "target", "taken", "draw")]
    return both.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias(names[0]),
        F.col("_words").alias(names[1]),
        F.col("_target").alias(names[2]),
        ((F.col("_certain") + F.col("_more").cast("int")) * F.col("_size")).cast("long").alias(names[3]),
        F.col("_draw").alias(names[4]),
    )


def _cut(open_: DataFrame, keys: list[str], rows_per_bin: int) -> DataFrame:
    """keys, _cut, _before, _shift: the bin of _rank >> _shift in which the running words of a source pass _rest, and the words before it.

    A level looks only at the bins that the one before it found, at most 2**STEP parts of each, until these bins hold few rows.
    """
    inside, shift, known = open_.select(*keys, "_rank", "_size", "_rest").withColumn("_before", F.lit(0).cast("long")), BITS - STEP, None
    while True:
        bins = inside.groupBy(*keys, F.shiftright("_rank", shift).alias("_bin")).agg(F.sum("_size").alias("_in"), F.count(F.lit(1)).alias("_rows"), F.first("_rest").alias("_rest"), F.first("_before").alias("_start"))
        before = F.col("_start") + F.coalesce(F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        passed = (F.col("_rest") > 0) & (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_in") >= F.col("_rest"))
        known = written(bins.withColumn("_before", before).where(passed).select(*keys, F.col("_bin").alias("_cut"), "_before", "_rows", F.lit(shift).alias("_shift")), "mix-cuts")
        if shift == 0 or (known.agg(F.max("_rows")).first()[0] or 0) <= rows_per_bin:
            return broadcast_checked(known.drop("_rows"))  # at most one row a source
        inside = open_.select(*keys, "_rank", "_size", "_rest").join(broadcast_checked(known.drop("_rows")), keys).where(F.shiftright("_rank", shift) == F.col("_cut"))
        shift = max(0, shift - STEP)


def cut_shift(cut: DataFrame) -> int:
    """The same for all sources."""
    first = cut.select("_shift").first()
    return first[0] if first else 0


def _repeated(df: DataFrame, count: str, chunk: int = 65_536) -> DataFrame:
    """Each row as often as ``count`` says, in chunks, so that no array is long."""
    df = df.where(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / chunk))))
    return df.withColumn("_one", F.explode(F.sequence(F.lit(1), F.least(F.lit(chunk), F.col(count) - F.col("_chunk") * chunk)))).drop("_chunk", "_one", count)
