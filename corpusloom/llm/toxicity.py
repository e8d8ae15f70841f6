"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w . x - t_k): one weight vector shared by all thresholds, which are kept in order. Features are the
distinct words of a text and the pieces of those words, hashed. The weights are fitted with an L1 penalty, so words that say nothing weigh nothing however
long a text is. Fitting runs on the driver on a bounded sample of graded rows; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import free_name, id_and_text

BITS = 20
#: Lengths in bytes of the pieces of words that are features beside the words themselves.
GRAMS = (4, 6)


def slots_of_word(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself and its pieces, so that inflected and unseen words are recognised by their stems."""
    pieces = {word, *(word[k : k + n] for n in GRAMS for k in range(len(word) - n + 1))}
    return tuple(xxhash.xxh32_intdigest(p) & ((1 << BITS) - 1) for p in pieces)


class Features:
    """Sorted distinct slots of a text's words: A-Z lower-cased, without punctuation around them. Words' slots are kept, up to a bound; with ``only``, just slots where it holds."""

    def __init__(self, only: np.ndarray | None = None, most: int = 100_000) -> None:
        class Words(dict):
            def __missing__(self, word):
                if len(self) >= most:
                    self.clear()
                found = slots_of_word(word.strip(b".,;:!?\"'()[]{}*#$%&+-_"))
                self[word] = found = found if only is None else tuple(s for s in found if only[s])
                return found

        self.words = Words()

    def __call__(self, text: bytes) -> np.ndarray:
        found = set().union(*map(self.words.__getitem__, set(text.lower().split())))
        return np.sort(np.fromiter(found, np.int32, len(found)))


def logistic(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class OrdinalModel:
    """weights (2**BITS) and increasing thresholds, one less than there are grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def above(self, score) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold (columns)."""
        return logistic(np.asarray(score, float)[:, None] - self.thresholds)


def fit(rows: list[np.ndarray], grades: list[int], grades_n: int, penalty: float = 1e-4, steps: int = 400, least_rows: int = 3, least_chi2: float = 2.0) -> OrdinalModel:
    """Proximal gradient (accelerated) on the mean negative log-likelihood; slots in ``least_rows`` rows or more that tell rows of
    grade 0 from others with a chi-squared statistic of ``least_chi2`` or more get a weight, however many they are."""
    weights, y = np.zeros(1 << BITS), np.array(grades)
    counts = np.bincount(y, minlength=grades_n)
    tail = (len(y) - np.cumsum(counts)[:-1] + 0.5) / (np.cumsum(counts)[:-1] + 0.5)
    t = np.maximum.accumulate(-np.log(tail)) + 1e-3 * np.arange(grades_n - 1)
    at = np.concatenate(rows).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    rows_n, high_n = np.bincount(at, minlength=1 << BITS), np.bincount(at[(y > 0)[of]], minlength=1 << BITS)
    share = (y > 0).mean()
    telling = (high_n - rows_n * share) ** 2 / np.maximum(rows_n * (1 - rows_n / len(y)), 1e-9) / max(share * (1 - share), 1e-9)
    used = np.flatnonzero((rows_n >= least_rows) & (telling >= least_chi2))
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    hit = place[at] >= 0
    at, of = place[at[hit]], of[hit]
    w = v = np.zeros(len(used))
    u, tv, inertia = t.copy(), t.copy(), 1.0
    # curvature per slot: a quarter of the rows that have it, which makes the step of rare words large
    reach = 0.25 * np.bincount(at, minlength=len(used)) / len(y) * 30 + 1e-2
    for _ in range(steps):
        z = np.bincount(of, v[at], len(y))
        high = np.concatenate([np.ones((len(y), 1)), logistic(z[:, None] - tv), np.zeros((len(y), 1))], 1)
        p = np.maximum(high[np.arange(len(y)), y] - high[np.arange(len(y)), y + 1], 1e-9)
        slope = high * (1 - high)
        g = -(slope[np.arange(len(y)), y] - slope[np.arange(len(y)), y + 1]) / p / len(y)
        gt = np.array([-(np.where(y == k, slope[:, k + 1], 0) - np.where(y == k + 1, slope[:, k + 1], 0)) @ (1 / p) / len(y) for k in range(grades_n - 1)])
        new = v - np.bincount(at, g[of], len(used)) / reach
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / reach, 0)
        new_t = np.maximum.accumulate(tv - gt) + 1e-9 * np.arange(grades_n - 1)
        nxt = (1 + np.sqrt(1 + 4 * inertia**2)) / 2
        v, tv = new + (inertia - 1) / nxt * (new - w), np.sort(new_t + (inertia - 1) / nxt * (new_t - u))
        w, u, inertia = new, new_t, nxt
    weights[used] = w
    return OrdinalModel(weights, u)


def graded_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> list[tuple[np.ndarray, int]]:
    """(slots of the text's features, 0/1 label) of about ``per_class`` rows of each label with the smallest hashes of id; bounded for any input."""
    label, ids = F.col(f"`{label_col}`").cast("int"), F.col(f"`{id_col}`").cast("long")
    known = labels.where(label.isin(0, 1) & ids.isNotNull())
    n = {r._y: r._n for r in known.groupBy(label.alias("_y")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    draw = F.pmod(F.xxhash64(ids, F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(label == 1, F.lit(min(1.0, per_class / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, n.get(0, 0)))))
    picked = known.where(draw < rate).groupBy(ids.alias("_id")).agg(F.max(label).alias("_y"), F.min(draw).alias("_draw")).orderBy("_draw", "_id").limit(3 * per_class)
    rows = id_and_text(df, id_col, text_col).join(F.broadcast(picked), "_id")  # at most 3 * per_class rows

    def slots(batches):
        slots_of = Features()
        for batch in batches:
            x = [slots_of(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["_id", "_y", "_slots"])

    found = rows.select("_id", "_text", "_y").mapInArrow(slots, "_id long, _y int, _slots binary").collect()
    return [(np.frombuffer(r._slots, np.int32), r._y) for r in sorted(found, key=lambda r: (r._id, r._slots))]


def severity_grades(sample: list[tuple[np.ndarray, int]], least_odds: float = 3.0, steps: tuple[int, ...] = (8, 20)) -> list[int]:
    """Grades from binary labels: 0 for clean rows; toxic rows by how many distinct marked features they hold.

    A feature is marked if its log odds between toxic and clean rows (counts plus a half) exceed ``least_odds``. Grade 1, plus
    1 for each of ``steps`` that the number of marked features reaches.
    """
    n, seen = [sum(y == k for _, y in sample) for k in (0, 1)], [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for slots, y in sample:
        seen[y][slots] += 1
    odds = [np.log((s + 0.5) / (k - s + 0.5)) for s, k in zip(seen, n, strict=True)]
    marked = (seen[1] >= 5) & (odds[1] - odds[0] > least_odds)
    return [y and 1 + sum(int(marked[slots].sum()) >= s for s in steps) for slots, y in sample]


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, grades_of=severity_grades) -> DataFrame:
    """One row per input row: id, grade (0 to 3), severity (the expected grade), toxic (grade > 0 is more likely than not).

    ``labels`` has the ids and a 0/1 ``label_col``; ``per_class`` bounds the sample that is fitted (at most three times as many
    rows). Null and empty texts get what the thresholds alone say; without both labels everything is grade 0, severity 0.
    Null ids and repeated rows are returned as they come; other columns are ignored.
    """
    sample = graded_sample(df, labels, id_col, text_col, label_col, per_class)
    model = None
    if len({y for _, y in sample}) == 2:
        grades = grades_of(sample)
        model = fit([slots for slots, _ in sample], grades, max(grades) + 1)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = sent.value
        slots_of = Features(model.weights != 0) if model else None
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            if model:
                above = model.above([model.weights[slots_of(t)].sum() for t in texts])
            else:
                above = np.zeros((len(texts), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((above >= 0.5).sum(1), pa.int32()), pa.array(above.sum(1)), pa.array(above[:, 0] >= 0.5)], names=["_id", "grade", "severity", "toxic"])

    scored = id_and_text(df, id_col, text_col).mapInArrow(predict, "_id long, grade int, severity double, toxic boolean")
    return scored.select(scored._id.alias(id_col), *[scored[c].alias(free_name(c, [id_col])) for c in ("grade", "severity", "toxic")])
