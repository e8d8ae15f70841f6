"""Language identification by a convolutional network over bytes, in numpy.

The text's lower-cased UTF-8 bytes pass in windows of fixed length through byte embeddings, filters of several widths, max
pooling over the window, and a softmax layer; a document's probabilities are the mean of its windows'. Filters of width w are
applied as one matrix product over w neighbouring embeddings. Training runs on the driver, on a bounded sample of labelled
rows; prediction reads every window of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import free_name

WINDOW = 256


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """All bytes of a text in rows of ``length``, padded with 0; at least one row."""
    data = np.frombuffer(text, np.uint8)
    rows = max(1, -(-len(data) // length))
    out = np.zeros(rows * length, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, length)


class ByteNetwork:
    """embed: 256 x E; filters[w]: (w * E) x F and a bias; out: (sum F) x classes and a bias."""

    def __init__(self, classes: list[str], widths: tuple[int, ...] = (2, 3, 4), embed: int = 6, filters: int = 10, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.widths, self.size = classes, widths, filters
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.p = {"embed": normal(256, embed), "out": normal(filters * len(widths), len(classes)) * 0.1, "out_b": np.zeros(len(classes), np.float32)}
        for w in widths:
            self.p |= {f"f{w}": normal(w * embed, filters) / np.float32(np.sqrt(w * embed)), f"b{w}": np.zeros(filters, np.float32)}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Max of each filter over each window (with ReLU), where it is, and the products' inputs."""
        e = self.p["embed"][x]
        n, length, width = e.shape
        best, where, inputs = [], [], []
        for w in self.widths:
            # neighbouring embeddings side by side, without a copy
            view = np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * width), e.strides)
            z = view.reshape(-1, w * width) @ self.p[f"f{w}"]
            z = z.reshape(n, length - w + 1, -1)
            at = z.argmax(1)
            best.append(np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p[f"b{w}"], 0))
            where.append(at)
            inputs.append(view)
        return np.concatenate(best, 1), where, inputs

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """As ``pooled``, for prediction only: small slices that stay in the cache, maxima without positions."""
        out = np.empty((len(x), self.size * len(self.widths)), np.float32)
        for at in range(0, len(x), 64):
            e = self.p["embed"][x[at : at + 64]]
            n, length, width = e.shape
            for k, w in enumerate(self.widths):
                view = np.lib.stride_tricks.as_strided(e, (n * length - w + 1, w * width), e.strides[1:])
                z = np.empty((n * length, self.size), np.float32)
                np.matmul(view, self.p[f"f{w}"], out=z[: n * length - w + 1])
                out[at : at + 64, k * self.size : (k + 1) * self.size] = z.reshape(n, length, -1)[:, : length - w + 1].max(1)
        for k, w in enumerate(self.widths):
            out[:, k * self.size : (k + 1) * self.size] += self.p[f"b{w}"]
        return np.maximum(out, 0, out=out)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.p["out"] + self.p["out_b"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        """Adam on the cross-entropy of windows."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                idx = order[at : at + batch]
                g = self._gradient(x[idx], y[idx])
                step += 1
                r = rate * (1 - epoch / epochs)
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= r * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, where, inputs = self.pooled(x)
        z = h @ self.p["out"] + self.p["out_b"]
        z = np.exp(z - z.max(1, keepdims=True))
        dz = z / z.sum(1, keepdims=True)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"out": h.T @ dz, "out_b": dz.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = (dz @ self.p["out"].T) * (h > 0)
        rows, width = np.arange(len(x))[:, None], self.p["embed"].shape[1]
        for k, w in enumerate(self.widths):
            d = dh[:, k * self.size : (k + 1) * self.size]
            picked = inputs[k][rows, where[k]]  # windows x filters x (w * E)
            g[f"f{w}"] = np.einsum("nfi,nf->if", picked, d)
            g[f"b{w}"] = d.sum(0)
            back = d[:, :, None] * self.p[f"f{w}"].T[None]
            for j in range(w):
                np.add.at(g["embed"], x[rows, where[k] + j], back[:, :, j * width : (j + 1) * width])
        return g


#: More values of the label than this are refused: they are no languages.
MOST_LABELS = 10_000


def training_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, per_class: int, windows_each: int = 4) -> list:
    """(``windows_each`` windows from all over the text, label) of about ``per_class`` rows of each label, the ones with the smallest hashes of id and text; bounded for any input.

    The rate of each label comes from its count, so one filtered scan finds the rows. Every label is learned; rows that agree in
    id and text are learned from once.
    """
    rows = df.where(train & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    label, ids = F.col(f"`{label_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    counts = rows.groupBy(label.alias("_label")).agg(F.count(F.lit(1)).alias("_n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{label_col} has more than {MOST_LABELS} values")
    counts = sorted(counts, key=lambda r: r._label)
    if not counts:
        return []
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r._label, min(1.0, per_class / r._n))])
    draw = F.pmod(F.xxhash64(ids, F.col(f"`{text_col}`").cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select(ids.alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), label.alias("_label"), draw.alias("_draw"))
    picked = rows.where(F.col("_draw") < F.try_element_at(rate, F.col("_label"))).select("_id", "_draw", "_label", "_text")

    def some(batches):
        for batch in batches:
            x = [w[np.unique(np.linspace(0, len(w) - 1, windows_each).astype(int))].tobytes() for w in map(full_windows, batch.column(3).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.binary())], names=["_id", "_draw", "_label", "_windows"])

    picked = picked.mapInArrow(some, "_id long, _draw double, _label string, _windows binary").dropDuplicates(["_draw", "_label", "_windows"]).orderBy("_draw", "_label", "_windows").limit(2 * per_class * len(counts)).collect()
    return [(np.frombuffer(r._windows, np.uint8).reshape(-1, WINDOW), r._label) for r in picked]


def full_windows(text: bytes) -> np.ndarray:
    """The lower-cased windows without a padded last one, unless it is the only one."""
    w = windows_of(text.lower())
    return w[:-1] if len(w) > 1 else w


def train(sample: list, **shape) -> ByteNetwork | None:
    """A network fitted on (windows, label) pairs; None without any."""
    classes = sorted({label for _, label in sample})
    if not classes:
        return None
    net = ByteNetwork(classes, **shape)
    net.fit(np.concatenate([w for w, _ in sample]), np.concatenate([np.full(len(w), classes.index(label)) for w, label in sample]))
    return net


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_on: Column | None = None, per_class: int = 600, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns of ``keep``, lang_pred (a learned label or ``und``), score (its probability).

    Learns from rows where ``train_on`` holds and the label is not null (``per_class`` of each label at most about; the bound
    of the training sample), then predicts from the text alone. ``und`` with score 0: null or empty text, no letter, or
    nothing to learn from. Ids may be null or repeated; other columns are ignored.
    """
    net = train(training_sample(df, id_col, text_col, label_col, F.lit(True) if train_on is None else train_on, per_class))
    sent = df.sparkSession.sparkContext.broadcast(net)
    extra = [c for c in keep if c not in (id_col, text_col)]
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(extra)])
    kept_types = [base.schema[f"_k{i}"].dataType.simpleString() for i in range(len(extra))]
    with_text = text_col in keep

    def predict(batches):
        net = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            labels, scores = ["und"] * len(texts), [0.0] * len(texts)
            spoken = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
            for group in _grouped(spoken, texts):
                data = [windows_of(texts[k].encode().lower()) for k in group]
                p = net.probabilities(np.concatenate(data)).astype(np.float64)
                starts = np.cumsum([0, *[len(d) for d in data[:-1]]])
                mean = np.add.reduceat(p, starts) / np.array([len(d) for d in data])[:, None]
                best = mean.argmax(1)
                for k, b, m in zip(group, best.tolist(), mean, strict=True):
                    labels[k], scores[k] = net.classes[b], min(1.0, float(m[b]))
            cols = [batch.column(0), *([batch.column(1)] if with_text else []), *[batch.column(2 + i) for i in range(len(extra))], pa.array(labels), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", *(["_text"] if with_text else []), *[f"_k{i}" for i in range(len(extra))], "_lang", "_score"])

    schema = ", ".join(["_id long", *(["_text string"] if with_text else []), *[f"_k{i} {t}" for i, t in enumerate(kept_types)], "_lang string", "_score double"])
    out = base.mapInArrow(predict, schema)
    names = [id_col, *([text_col] if with_text else []), *extra]
    new = [free_name("lang_pred", names), free_name("score", names)]
    return out.select(out._id.alias(id_col), *([out._text.alias(text_col)] if with_text else []), *[out[f"_k{i}"].alias(c) for i, c in enumerate(extra)], out._lang.alias(new[0]), out._score.alias(new[1]))


def _grouped(which: list[int], texts: list[str], most: int = 1 << 21):
    """Runs of texts of at most ``most`` characters together (or one longer text)."""
    group, size = [], 0
    for k in which:
        if group and size + len(texts[k]) > most:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(texts[k])
    if group:
        yield group
