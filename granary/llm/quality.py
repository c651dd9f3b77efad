"""Quality classifier by positive-unlabelled learning (operator 3).

Trusted positives are documents labelled good, the unlabelled ones are web text of unknown quality; labels of bad text
are never used. A first classifier tells positives from unlabelled text; how much of the unlabelled text must be positive
(the class prior) is the least ratio of the two groups' shares above any threshold of that classifier, each half of the
rows judged by the classifier of the other. The model then minimises the non-negative risk estimate: prior * loss(P as
good) + max(0, loss(U as bad) - prior * loss(P as bad)). The part in max() can fall below zero by overfitting only; there steps
undo it, which is to minimise its absolute value. That has a corner at zero, which is rounded, for Newton's steps.

The positives are a bounded sample of labelled rows. The unlabelled rows are all there are: their moments, losses,
gradients, curvatures and the counts behind the prior are summed up in tasks, and only these sums reach the driver.

Inputs of the model are measures of the whole text alone: kinds of characters, repetition, lengths of words and lines.

Defined results: null text counts as empty and is scored; without positives or unlabelled text every score is 0.5; of
labels that repeat an id the largest counts; rows that repeat are each scored; other columns are ignored; rows without an
id are in no fold: not learned from, held_out false.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import forget, map_rows, stored
from granary.llm.langid import fold

#: Most trusted positives (labelled rows) that the fit reads: those first by a hash of the id.
FIT_ROWS = 20_000
#: Newton's steps end where the next one can lower the loss by no more than this.
CLOSE = 1e-5
#: The absolute value is taken as sqrt(x ** 2 + CORNER ** 2).
CORNER = 0.05
#: Weight of the squared length of the model's weights in the loss.
DECAY = 0.2
#: Tasks that add up the sums of all others.
ADDERS = 8
#: Kinds of characters: other, lower case, upper case, other letters, digits, white space, sentence marks, symbols.
KINDS = 8
_MARKS = ".,;:?'\"-()’“”«»¿¡"


@functools.cache
def kinds() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        g = unicodedata.category(c)
        out[i] = 5 if c.isspace() else 1 if g == "Ll" else 2 if g in ("Lu", "Lt") else 3 if g[0] in "LM" else 4 if g[0] == "N" else 6 if c in _MARKS else 7 if g[0] in "PS" else 0
    return out


def measures(text: str | None) -> list[float]:
    """The model's inputs for one text."""
    t = text or ""
    n = max(1, len(t))
    kind = kinds()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
    share = np.bincount(kind, minlength=KINDS) / n
    gap = np.concatenate(([True], kind == 5, [True]))
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:]) - 1
    lengths, last = ends - starts + 1, kind[ends] if len(ends) else kind[:0]
    m, lines = max(1, len(starts)), t.split("\n")
    # words stand for themselves by their hashes, of which only equality counts
    words = np.fromiter(map(hash, t.split()), np.int64, len(starts)).view(np.uint64)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    top = np.sort(np.unique(words, return_counts=True)[1])[::-1]
    mean = lengths.sum() / m
    return [
        *share.tolist(),
        np.log1p(len(words)),
        len(top) / m**0.85,
        (len(np.unique(pairs)) + 1) / m,
        float((words[1:] == words[:-1]).sum()) / m,
        float(((last == 7) | (last == 0)).sum()) / m,
        float(((lengths == 1) & ((last == 6) | (last == 7) | (last == 0))).sum()) / m,
        (int(top[0]) if len(top) else 0) / m,
        (int(top[2]) if len(top) > 2 else 0) / m,
        mean,
        np.sqrt(((lengths - mean) ** 2).sum() / m),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        float(not len(words)),
    ]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    """A logistic model over standardised measures, their squares and bounded forms of both tails."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        self.mean, self.sd = mean, sd + 1e-6
        self.w = np.zeros(4 * len(mean) + 1)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, z**2 / 4, np.tanh(2 * z - 2), np.tanh(2 * z + 2)), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.w

    def column(self, x: Column) -> Column:
        """raw() as an expression over an array of measures."""
        n, out = len(self.mean), F.lit(float(self.w[0]))
        for i in range(n):
            z = F.least(F.greatest((x[i] - float(self.mean[i])) / float(self.sd[i]), F.lit(-6.0)), F.lit(6.0))
            a, b, c, d = (float(self.w[1 + i + k * n]) for k in range(4))
            out = out + a * z + b * z * z / 4 + c * F.tanh(2 * z - 2) + d * F.tanh(2 * z + 2)
        return out


def added(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of of(x, half) over all batches of rows (x, half): each task sends one array, ADDERS tasks add them up."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                part = of(x, b.column("half").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def add(batches):
        arrays = [v for b in batches for v in b.column("v").to_pylist()]
        if arrays:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(arrays, axis=0)], pa.list_(pa.float64()))], names=["v"])

    rows = rows.mapInArrow(run, "v array<double>").repartition(ADDERS).mapInArrow(add, "v array<double>")
    found = [r.v for r in rows.collect()]
    return np.sum(found, axis=0) if found else None


def class_prior(positive: np.ndarray, passing: np.ndarray, many: float) -> float:
    """The share of positives among `many` unlabelled rows, of which `passing` score at least thresholds(positive): the
    least ratio of the shares of both groups that pass, each with a margin for its sampling error."""
    t, p = thresholds(positive), np.sort(positive)
    pu, pp = passing / many, 1 - np.searchsorted(p, t, "left") / len(p)
    slack = lambda q, n: np.sqrt(np.maximum(q * (1 - q), 1 / n) / n)
    return float(np.clip(((pu + slack(pu, many)) / np.maximum(pp - slack(pp, len(p)), 1e-3)).min(), 0.01, 0.99))


def thresholds(positive: np.ndarray) -> np.ndarray:
    """Scores that at least a tenth of the positives reach."""
    return np.quantile(positive, np.linspace(0, 0.9, 181))


def losses(phi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of rows taken as bad: loss, its gradient and curvature, in one array."""
    f = phi @ w
    s = sigmoid(f)
    return np.concatenate(([softplus(f).sum()], phi.T @ s, ((phi.T * (s * (1 - s))) @ phi).ravel()))


def split(v: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    return v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)


def newton(k: int, look: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray, np.ndarray]]], many: int) -> list[np.ndarray]:
    """Weights of `many` losses minimised side by side from zero. look() gives each one's loss, gradient and a positive
    curvature; a step that does not lower the loss enough is halved."""
    best, at, step, slope = [None] * many, [np.zeros(k) for _ in range(many)], [None] * many, [0.0] * many
    open_ = set(range(many))
    while open_:
        for i, (loss, gradient, curvature) in enumerate(look(at)):
            if i not in open_:
                continue
            if best[i] is None or loss <= best[i][0] - 1e-4 * slope[i]:
                best[i] = (loss, at[i])
                step[i] = -np.linalg.solve(curvature, gradient)
                slope[i] = -gradient @ step[i]
            else:
                step[i], slope[i] = step[i] / 2, slope[i] / 2
            if slope[i] < CLOSE:
                open_.discard(i)
            at[i] = best[i][1] + step[i] if i in open_ else best[i][1]
    return [b[1] for b in best]


def fit(positive: np.ndarray, unlabelled: DataFrame) -> tuple[Model, float] | None:
    """The model and the estimated class prior, from the positives' measures and all rows (x, half) of unlabelled text."""
    sums = added(unlabelled, lambda x, half: np.concatenate(([len(x), half.sum()], x.sum(0), (x**2).sum(0))))
    if sums is None or not len(positive):
        return None
    n, ones = sums[:2]
    mean, square = np.split(sums[2:], 2)
    model = Model(mean / n, np.sqrt(np.maximum(square / n - (mean / n) ** 2, 0)))
    p, k = model.expand(positive), len(model.w)
    some = lambda half: p[half::2] if len(p) > 1 else p
    counts = np.maximum((n - ones, ones), 1)
    decay = lambda w: (DECAY / 2 * w @ w, DECAY * w, DECAY * np.eye(k))

    def apart(at):
        """Positives against unlabelled text, by the rows of each half."""
        v = added(unlabelled, lambda x, half: np.concatenate([losses(model.expand(x[half == h]), at[h]) for h in (0, 1)]))
        for h in (0, 1):
            own, w = some(h), at[h]
            loss, gradient, curvature = split(v.reshape(2, -1)[h] / counts[h], k)
            f = own @ w
            s = sigmoid(f)
            more = decay(w)
            yield (
                loss + softplus(-f).mean() + more[0],
                gradient + own.T @ (s - 1) / len(own) + more[1],
                curvature + (own.T * (s * (1 - s))) @ own / len(own) + more[2],
            )

    first = newton(k, lambda at: list(apart(at)), 2)
    scores = [some(1 - h) @ first[h] for h in (0, 1)]  # each half's model judges the other half
    cuts = [thresholds(s) for s in scores]
    passing = added(unlabelled, lambda x, half: np.concatenate([(model.expand(x[half != h]) @ first[h] >= cuts[h][:, None]).sum(1).astype(float) for h in (0, 1)])).reshape(2, -1)
    prior = float(np.mean([class_prior(scores[h], passing[h], counts[1 - h]) for h in (0, 1)]))

    def risk(at):
        w, more = at[0], decay(at[0])
        loss, gradient, curvature = split(added(unlabelled, lambda x, half: losses(model.expand(x), w)) / n, k)
        f = p @ w
        s = sigmoid(f)
        left, down = loss - prior * softplus(f).mean(), gradient - prior * (p.T @ s) / len(p)
        bad = np.hypot(left, CORNER)
        on = left / bad  # 1 above zero, -1 below
        good = prior * (p.T * (s * (1 - s))) @ p / len(p)
        bend = good * (1 + max(-on, 0)) + max(on, 0) * curvature + CORNER**2 / bad**3 * np.outer(down, down)
        return [(prior * softplus(-f).mean() + bad + more[0], prior * (p.T @ (s - 1)) / len(p) + on * down + more[1], bend + more[2])]

    # sums of many tasks differ in their last digits with the order they are added in
    model.w = np.round(newton(k, risk, 1)[0], 8)
    return model, prior


def measured(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the measures of every row."""

    def make():
        return lambda batch: {"doc_id": batch.column("id").to_pylist(), "x": [measures(t.as_py()) for t in batch.column("text")]}

    return map_rows(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "doc_id long, x array<double>", make)


def learn(rows: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, fit_rows: int = FIT_ROWS) -> tuple[Model, float] | None:
    """Fits on measured rows (doc_id, x): at most fit_rows trusted positives and all rows without a label."""
    own = stored(labels.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    used = rows.where(fold("doc_id", folds) != held_out)
    trusted = used.join(own.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "x")
    positive = np.array([r.x for r in trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("x").toLocalIterator()])
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half")
    unlabelled = stored(used.join(own, "doc_id", "left_anti").select("x", half))
    if not unlabelled.limit(1).count():  # all are labelled: then the labels are set aside, as in unlabelled text
        unlabelled = stored(used.select("x", half))
    found = fit(positive, unlabelled)
    forget(own, unlabelled)
    return found


def classify(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents."""
    rows = stored(measured(documents))
    found = learn(rows, labels.select("doc_id", "quality"), folds, held_out, fit_rows)
    score = F.lit(0.5) if not found else scored(found[0], F.col("x"))
    made = rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), score.alias("score"))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored(model: Model, x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(model.column(x), F.lit(-30.0)), F.lit(30.0))))


def keep_good(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of documents that the classifier takes for good; columns as they are. Texts are measured once and stored
    with their rows. A document that repeats an id is judged by its own text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*documents.columns).alias("row"))
    schema = rows.withColumn("x", F.lit(None).cast("array<double>")).schema
    at = documents.columns.index("text")

    def measure(batches):
        for b in batches:
            x = pa.array([measures(t.as_py()) for t in b.column("row").field(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, x], names=["doc_id", "row", "x"])

    held = stored(rows.mapInArrow(measure, schema))
    found = learn(held.select("doc_id", "x"), labels.select("doc_id", "quality"), **how)
    if not found:
        return documents
    return held.where(scored(found[0], F.col("x")) >= 0.5).select("row.*")
