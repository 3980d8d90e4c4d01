"""Quality classifier by positive-unlabelled learning.

Trusted positives are the training rows labelled 1; the unlabelled text is the
corpus.  The share of positives in it (the class prior) is estimated by
best-bin estimation: a positive-against-unlabelled scorer is fit on one half of
a sample, and the prior is the smallest upper bound of
P(unlabelled above c) / P(positive above c) over thresholds c, where the
positives are the other half of the trusted sample and the unlabelled are all
documents of the training folds, counted in Spark.  The model then minimises,
on the sample, the non-negative unbiased risk
``prior * P[l(f)] + max(0, U[l(-f)] - prior * P[l(-f)])``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow import Rows, text_chunks
from quarry.llm.scratch import materialise

#: The most rows of either kind that a model is fitted on; they are taken by smallest hash of the id.
SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5
BINS = 10
#: The column of the features; a column of ``docs`` with this name is not kept.
FEATURES = "__features"


def _class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58))), _class(bytes(range(128, 256))),
    _class(b"!"), _class(b"?"), _class(b"|"), _class(b"#$%&*^~@+="), _class(b".,"), _class(b";:"), _class(b"<>{}[]\\"), _class(b"()\"'`"), _class(b"-_/"), _class(b"\n\r"), _class(b" \t"),
], axis=1)


def features(b: bytes) -> np.ndarray:
    """Surface features of a whole UTF-8 text: shares of character classes, repetition, lengths."""
    counts = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    kinds = counts @ _CLASSES
    words = b.split()
    n, size = len(words), max(len(b), 1)
    seen = Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    pairs = max(n - 1, 1)
    m = max(n, 1)
    letters = max(kinds[0] + kinds[1] + kinds[3], 1)
    own = [
        np.log1p(n), len(b) / m, kinds[0] / letters, kinds[3] / size, (kinds[0] - n) / letters,
        sum(map(eq, words, words[1:])) / pairs,
        len(seen) / m, len(seen) / m**0.75,
        len(set(zip(words, words[1:], strict=False))) / pairs,
        seen.most_common(1)[0][1] / m if n else 0.0,
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        sum(1 for w in seen if len(w) == 1) / max(len(seen), 1),
        max(map(len, seen), default=0),
        counts.max() / size,
        b.count(b"http") / m,
    ]
    return np.concatenate([own, kinds[2:] / m])


N_FEATURES = len(features(b""))


@dataclass(frozen=True)
class Model:
    """Bin edges of each feature and the weights of a logistic model over bin indicators."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_bins(x, self.edges) @ self.weights + self.bias, -30, 30)))


@dataclass(frozen=True)
class Bins:
    """Rows in thermometer code (is feature j above its edge k?), held as the number of edges below each value: a byte where the code has a number for each edge.

    ``codes`` has a row a feature.  A row's margin is added up feature by
    feature, so it is the same in any batch.
    """

    codes: np.ndarray
    edges: int

    def __len__(self) -> int:
        return self.codes.shape[1]

    def __getitem__(self, rows: slice) -> Bins:
        return Bins(self.codes[:, rows], self.edges)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        """The margins: the code times a weight for each feature and edge."""
        upto = np.pad(np.cumsum(w.reshape(-1, self.edges), axis=1, dtype=np.float64), ((0, 0), (1, 0)))
        out = np.zeros(len(self))
        for held, code in zip(upto, self.codes, strict=True):
            out += held[code]
        return out

    def summed(self, d: np.ndarray) -> np.ndarray:
        """For each feature and edge the sum of ``d`` over the rows above it."""
        per_code = np.stack([np.bincount(code, d, self.edges + 1) for code in self.codes])
        return per_code[:, :0:-1].cumsum(axis=1)[:, ::-1].ravel()


def _bins(x: np.ndarray, edges: np.ndarray) -> Bins:
    kind, below = np.min_scalar_type(edges.shape[1]), edges.astype(np.float32)
    return Bins(np.stack([np.searchsorted(e, v).astype(kind) for e, v in zip(below, x.T, strict=True)]), edges.shape[1])


def _descend(p: Bins, u: Bins, risk, rounds: int = 400, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Adam over the whole sample; the weights of least risk.  ``risk``: margins to the risk and its derivatives by margin."""
    x = Bins(np.concatenate([p.codes, u.codes], axis=1), p.edges)
    w, b, best = np.zeros(len(x.codes) * x.edges), 0.0, (np.inf, None, 0.0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        f = x @ w + b
        value, d = risk(f[: len(p)], f[len(p) :])
        value += decay * (w @ w) / 2
        if value < best[0]:
            best = value, w, b
        g = np.append(x.summed(d) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return best[1], float(best[2])


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


Above = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, int]]


def class_prior(p: Bins, u: Bins, edges: np.ndarray, above: Above, least: float = 0.05) -> float:
    """Best-bin estimate of the share of positives in the corpus.

    ``p`` and ``u``: rows of binned features.  ``above``: from the edges, the
    scorer's weights and thresholds, how many documents of the corpus score at
    each threshold or above, and how many there are.
    """
    fit_p, fit_u, p = p[::2], u[::2], p[1::2]
    if not (len(p) and len(u) > 1):
        return 0.5
    w, _ = _descend(fit_p, fit_u, lambda fp, fu: ((np.logaddexp(0, -fp).mean() + np.logaddexp(0, fu).mean()) / 2, np.concatenate([-_sigmoid(-fp) / len(fp), _sigmoid(fu) / len(fu)]) / 2), rounds=200)
    sp = np.sort(p @ w.astype(np.float32))[::-1]
    at = np.unique((np.arange(1, 101) / 100 * len(sp)).astype(int)) - 1
    at = at[at >= max(1, least * len(sp))]
    if not len(at):
        return 0.5
    counts, n = above(edges, w, sp[at])
    qp = (at + 1) / len(sp)
    qu = counts / max(n, 1)
    slack = np.sqrt(np.log(20) / (2 * max(n, 1))) + np.sqrt(np.log(20) / (2 * len(sp)))
    best = int(np.argmin((qu + slack) / qp))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.99))


def _calibrate(fp: np.ndarray, fu: np.ndarray, prior: float, ridge: float = 1e-3) -> tuple[float, float]:
    """Scale and offset of the margins that minimise the unbiased logistic risk, which is convex; Newton's method.

    At zero the clipped risk stops telling good margins from better ones; two
    parameters cannot overfit, so their risk needs no clipping.  The mean score
    of the unlabelled rows comes to the class prior.
    """
    spread = max(float(np.std(fu)), 1e-9)
    fp, fu = fp / spread, fu / spread
    mean = np.array([fp.mean(), 1.0])
    x = np.stack([fu, np.ones(len(fu))], axis=1)

    def risk(theta: np.ndarray) -> float:
        return np.logaddexp(0, x @ theta).mean() - prior * (mean @ theta) + ridge * theta[0] ** 2 / 2

    theta = np.array([1.0, 0.0])
    for _ in range(100):
        s = _sigmoid(x @ theta)
        g = (s @ x) / len(x) - prior * mean + np.array([ridge * theta[0], 0.0])
        h = (x * (s * (1 - s))[:, None]).T @ x / len(x) + np.diag([ridge, 1e-6])
        step, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-6 and risk(theta - rate * step) > risk(theta):
            rate /= 2
        theta = theta - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return float(theta[0] / spread), float(theta[1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, above: Above) -> Model:
    """Non-negative PU learning on feature rows; ``above`` counts the corpus for :func:`class_prior`.  Without positives or unlabelled rows every score is 0.5."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((N_FEATURES, 1)), np.zeros(N_FEATURES), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled])
    ranks = np.concatenate([[0.001, 0.005, 0.02], np.linspace(0.05, 0.95, BINS), [0.98, 0.995, 0.999]])
    edges = np.quantile(both, ranks, axis=0).T
    p, u = _bins(positive, edges), _bins(unlabelled, edges)
    prior = class_prior(p, u, edges, above)

    def risk(fp: np.ndarray, fu: np.ndarray) -> tuple[float, np.ndarray]:
        positive = prior * np.logaddexp(0, -fp).mean()
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        d_p, d_u = -prior * _sigmoid(-fp) / len(fp), np.zeros(len(fu))
        if negative > 0:  # else the estimate of a risk is below 0, which is overfitting, and counts as 0
            d_p = d_p - prior * _sigmoid(fp) / len(fp)
            d_u = _sigmoid(fu) / len(fu)
        return positive + max(0.0, negative), np.concatenate([d_p, d_u])

    w, b = _descend(p, u, risk)
    scale, offset = _calibrate(*(x @ w + b for x in (p, u)), prior)
    w, b = w * scale, b * scale + offset
    return Model(edges, w, b, prior)


def _extract(keep: list[str], column: str):
    """The columns ``keep``, whatever they hold, and the features of ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(b) for _, texts in text_chunks(batch, column) for b in texts]
            flat = pa.array(np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32))
            x = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * N_FEATURES, flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], names=[*keep, FEATURES])

    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(FEATURES).flatten().to_numpy().reshape(-1, N_FEATURES)


def _scored(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(_matrix(batch.slice(i, 4_096))) for i in range(0, batch.num_rows, 4_096)]
            score = pa.array(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), score], names=[*keep, "score"])

    return run


def _reached(edges: np.ndarray, w: np.ndarray, thresholds: np.ndarray):
    """Per task: how many rows there are (place -1), and how many score at each threshold or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(thresholds) + 1, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4_096):
                f = np.sort(_bins(_matrix(batch.slice(i, 4_096)), edges) @ w.astype(np.float32))
                total[0] += len(f)
                total[1:] += len(f) - np.searchsorted(f, thresholds, side="left")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(thresholds)), pa.int64()), pa.array(total)], names=["at", "n"])

    return run


def held_out(id_col: str, folds: int = FOLDS):
    """Is the row outside the training folds: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def featurise(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row of ``docs``, and its features; a written table, as training and scoring both read it.  Null texts count as empty."""
    slim = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if text_col in keep else [F.col(f"`{text_col}`")]))
    schema = "".join(f"`{c}` {slim.schema[c].dataType.simpleString()}, " for c in keep)
    return materialise(slim.mapInArrow(_extract(keep, text_col), schema + f"{FEATURES} array<float>"), "features")


def train(featured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` trusted positives and as many unlabelled documents, all of the training folds.

    Trusted are ids with the label 1 of which ``featured`` has a document.  An
    id counts once, whichever of its rows it is seen with.
    """
    by = F.xxhash64("id")
    training = featured.select(F.col(id_col).alias("id"), F.col(FEATURES).alias("x")).where(~held_out("id"))
    ids = training.select("id").distinct()
    trusted = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y = 1").where(~held_out("id")).select("id").distinct()
    picked = trusted.join(ids, "id", "left_semi").orderBy(by, "id").limit(sample).withColumn("trusted", F.lit(1)).unionByName(ids.orderBy(by, "id").limit(sample).withColumn("trusted", F.lit(0)))
    # Two samples of ``sample`` ids at most: 16 bytes a row, so the broadcast has a fixed bound; of the rows of an id one is taken before they are sent.
    rows = training.join(F.broadcast(picked), "id").groupBy("trusted", "id").agg(F.min("x").alias("x")).select("trusted", "x").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
    order = np.lexsort(x.T) if len(rows) else np.zeros(0, int)
    x, t = x[order], rows.column("trusted").to_numpy()[order]
    rng = np.random.default_rng(0)  # a fixed shuffle, so that halves of the sample are alike and row order does not matter
    mixed = rng.permutation(len(x))

    def above(edges: np.ndarray, w: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, int]:
        counted = training.select(F.col("x").alias(FEATURES)).mapInArrow(_reached(edges, w, thresholds), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        n = {r["at"]: r["n"] for r in counted}  # a row for each of 100 thresholds
        return np.array([n.get(k, 0) for k in range(len(thresholds))]), n.get(-1, 0)

    return fit(x[mixed][t[mixed] == 1], x[mixed][t[mixed] == 0], above)


def score(featured: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row of ``featured``, and ``score``: the probability of label 1; empty texts are scored like any other."""
    schema = "".join(f"`{c}` {featured.schema[c].dataType.simpleString()}, " for c in keep)
    return featured.select(*(F.col(f"`{c}`") for c in keep), FEATURES).mapInArrow(_scored(model, keep), schema + "score double")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """(id, ``keep``..., held_out, score, predicted) for every row of ``docs``; a null id counts as held out, ids may repeat."""
    names = [id_col, *(c for c in keep or [] if c != id_col)]
    featured = featurise(docs, names, text_col)
    out = score(featured, train(featured, labels, id_col, sample=sample), names)
    return out.select(*names, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
