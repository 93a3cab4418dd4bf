"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; all other text is unlabelled web text,
and labels of 0 are never learnt from.  A small network over style figures of the
text is fitted to the non-negative unbiased risk

    prior * R+(positives as 1) + max(0, R-(unlabelled as 0) - prior * R-(positives as 0))

with the logistic loss, so its output is a probability.  The class prior is
estimated too: no region can hold a smaller share of the unlabelled than
``prior`` times its share of the positives, so the least such ratio over the
regions above the thresholds of a first positive-against-unlabelled model bounds
the prior from above; one standard error is taken off.

The fit takes at most about ``sample`` positives and ``sample`` unlabelled rows,
chosen by a hash of the id, so the driver holds a bounded matrix; scoring reads
every whole text.

Defined cases: null and empty texts have all figures 0 and get the score the
model gives those, texts of any length are read whole; without positives every
score is 0.5; repeated rows score alike, in any batch; null ids are not held out
and never fitted on; an empty table has no rows; the result column replaces one
of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettergraph.llm._words import SPACED, chunks

SAMPLE = 12_000
SEED = 5
HIDDEN = 4
STEPS = 150
THRESHOLD = 0.7

_CLASSES = ("a-z", "A-Z", "0-9", " ", "\n", ".,;:", "!?", "|", "#$%&*@^~", "<>{}[]()=/\\_", "other")


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES) - 1, dtype=np.int64)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), [32], [10], b".,;:", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=/\\_")):
        table[list(chars)] = k
    table[128:] = 0  # letters beyond ASCII
    return table


_TABLE = _class_table()
N_FEATURES = 2 * len(_CLASSES) + 8


def features(text: pa.Array) -> np.ndarray:
    """Style figures of each text: shares of character classes, words, endings and repetition."""
    out = [np.zeros((0, N_FEATURES))]
    for lo, hi, c in chunks(text, SPACED):
        rows, k = hi - lo, len(_CLASSES)
        size = np.diff(c.offsets)
        owner = np.repeat(np.arange(rows), size)
        counts = np.bincount(owner * k + _TABLE[c.buf], minlength=rows * k).reshape(rows, k)
        n = np.diff(c.first)
        word_owner = np.repeat(np.arange(rows), n)
        per_word = lambda x: np.bincount(word_owner, weights=x, minlength=rows) / np.maximum(n, 1)  # noqa: E731,B023
        lengths = (c.ends - c.starts).astype(float)
        last, first = _TABLE[c.buf[c.ends - 1]], _TABLE[c.buf[c.starts]]
        order = np.lexsort((c.hashes, word_owner))
        h, o = c.hashes[order], word_owner[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[fresh], minlength=rows)
        shares = counts / np.maximum(size, 1)[:, None]
        mean = per_word(lengths)
        out.append(np.column_stack([
            shares, np.sqrt(shares), np.log1p(n), mean, np.sqrt(np.maximum(per_word(lengths**2) - mean**2, 0)), distinct / np.sqrt(np.maximum(n, 1)),
            per_word((last >= 6).astype(float)), per_word((first >= 6).astype(float)), per_word((first == 1).astype(float)), distinct / np.maximum(n, 1),
        ]))
    return np.concatenate(out)


class Model:
    """One hidden layer over standardised figures; ``prior`` is the estimated share of positives."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], prior: float):
        self.centre, self.scale, self.weights, self.prior = centre, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1.  Sums run figure by figure in a fixed order, not as a matrix product, whose last bits
        depend on a batch's size: a text scores the same in any batch."""
        if not self.weights:
            return np.full(len(x), self.prior)
        x = np.clip((x - self.centre) / self.scale, -6, 6)
        w1, b1, w2, b2 = self.weights
        z = np.full(len(x), b2[0])
        for unit in range(len(w2)):
            inner = np.full(len(x), b1[unit])
            for k in range(x.shape[1]):
                inner += x[:, k] * w1[k, unit]
            z += np.tanh(inner) * w2[unit]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(x: np.ndarray, weights: list[np.ndarray]):
    w1, b1, w2, b2 = weights
    hidden = np.tanh(x @ w1 + b1)
    return hidden @ w2 + b2[0], hidden


def _train(x: np.ndarray, gradient, rng: np.random.Generator, steps: int, hidden: int) -> list[np.ndarray]:
    """Adam over the whole matrix; ``gradient`` maps outputs to the risk's slope for each row."""
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        z, h = _forward(x, weights)
        g = gradient(z)
        back = np.outer(g, weights[2]) * (1 - h * h)
        slopes = [x.T @ back + 1e-4 * weights[0], back.sum(0), h.T @ g + 1e-4 * weights[2], np.array([g.sum()])]
        for k, s in enumerate(slopes):
            m[k] = 0.9 * m[k] + 0.1 * s
            v[k] = 0.999 * v[k] + 0.001 * s * s
            weights[k] = weights[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return weights


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the unlabelled's to the positives' share above a threshold, less one standard error: a prior
    too high would take negatives for positives."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.4, 20))
    p, u = (1 - np.searchsorted(np.sort(s), cuts) / len(s) for s in (positive, unlabelled))
    ratio = u / np.maximum(p, 1e-9)
    error = ratio * np.sqrt((1 - p) / np.maximum(p, 1e-9) / len(positive) + (1 - u) / np.maximum(u, 1e-9) / len(unlabelled))
    return float(np.clip(np.min(ratio - error), 0.02, 0.98))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z: np.ndarray, n_positive: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of outputs ``z``, positives first, and the step's slope for each row.

    While the estimate of the negatives' risk is below 0, the slope leads back up on that estimate alone.
    """
    s, loss_as_0, n_p, n_u = sigmoid(z), np.logaddexp(0, z), n_positive, len(z) - n_positive
    positive = prior * np.logaddexp(0, -z[:n_p]).mean()
    negative = loss_as_0[n_p:].mean() - prior * loss_as_0[:n_p].mean()
    if negative < 0:
        return positive, np.concatenate([prior * s[:n_p] / n_p, -s[n_p:] / n_u])
    return positive + negative, np.concatenate([prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p, s[n_p:] / n_u])


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED, prior: float | None = None) -> Model:
    """Fit the non-negative risk to feature matrices of positives and unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [], 0.5)
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(0), both.std(0) + 1e-6
    x, n_p, n_u = np.clip((both - centre) / scale, -6, 6), len(positive), len(unlabelled)

    if prior is None:  # each half is judged by the model of the other, else the positives learnt by heart lower it
        halves, outputs = np.arange(n_p + n_u) % 2, np.zeros(n_p + n_u)
        is_p = np.arange(n_p + n_u) < n_p
        for half in (0, 1):
            seen = halves != half
            k_p, k_u = max((is_p & seen).sum(), 1), max((~is_p & seen).sum(), 1)
            slope = lambda z, p=is_p[seen], a=k_p, b=k_u: np.where(p, (sigmoid(z) - 1) / a, sigmoid(z) / b)
            outputs[~seen] = _forward(x[~seen], _train(x[seen], slope, np.random.default_rng(seed), steps, hidden))[0]
        prior = estimate_prior(outputs[:n_p], outputs[n_p:])
    return Model(centre, scale, _train(x, lambda z: risk(z, n_p, prior)[1], np.random.default_rng(seed + 1), steps, hidden), prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Fit on hash samples of about ``sample`` trusted positives and as many unlabelled rows, none held out; one scan of the texts."""

    @F.arrow_udf("array<double>")
    def figures(text: pa.Array) -> pa.Array:
        x = features(text)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_FEATURES).cast(pa.list_(pa.float64()))

    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & ~held_out("_id"))
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_labelled")).distinct()
    draw = lambda c, n: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))
    trusted = trusted.where(draw(F.col("_labelled"), trusted.count()))
    # At most about ``sample`` ids: small enough to broadcast at any size of the corpus.
    drawn = known.join(F.broadcast(trusted), F.col("_id") == F.col("_labelled"), "left").select(
        "_id", "_text", F.col("_labelled").isNotNull().alias("positive"), draw(F.concat(F.lit("u"), F.col("_id").cast("string")), known.count()).alias("other")
    ).where("positive OR other")
    rows = sorted((r[0], r[3], r[1], r[2]) for r in drawn.select("_id", "positive", "other", figures("_text")).collect())
    matrix = lambda take: np.array([x for _, x, p, u in rows if take(p, u)]).reshape(-1, N_FEATURES)
    return fit(matrix(lambda p, u: p), matrix(lambda p, u: u), seed=seed)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the model's probability of label 1."""

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    return docs.withColumn(out, run(F.col(text_col)))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """Documents that score at least ``threshold``, columns unchanged."""
    model = learn(docs, labels, id_col, text_col, **options)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)) >= threshold)

    return docs.where(good(F.col(text_col)))
