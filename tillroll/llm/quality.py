"""Quality by regularised quadratic discriminant analysis of document statistics.

Counts over the whole text become shares, shares become logits or logarithms, and each class
gets a mean and a covariance, shrunk towards the pooled covariance and that towards its
diagonal. A document's raw score is the difference of the two Gaussian log densities, from
Mahalanobis distances by Cholesky factors that are computed once. A two-number calibration turns
it into a probability.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored

FEATURES = (
    "words", "word_length", "long_words", "upper", "upper_words", "marks", "odd_marks", "digits", "spaces",
    "twins", "fresh_words", "fresh_pairs", "line_length", "repeated_lines", "mark_words", "short_words",
)
#: Shares are drawn towards LEAN by as much evidence as SMOOTH words (or 4 times as many letters).
SMOOTH, LEAN = 12.0, 0.03
_COMMON_MARKS = frozenset(b".,;:!?'\"()-")
_MARK = np.array([chr(i).isprintable() and not chr(i).isalnum() and i != 32 and i < 127 for i in range(256)])
_ODD = np.array([bool(_MARK[i]) and i not in _COMMON_MARKS for i in range(256)])
_DIGIT = np.array([48 <= i < 58 for i in range(256)])
_SPACE = np.array([i == 32 or 9 <= i < 14 for i in range(256)])
_END = re.compile(r"[^\w\s.,;:!?'\")-]$|[!?.,]{2,}$")


def _logit(part: float, whole: float, smooth: float = SMOOTH, lean: float = LEAN) -> float:
    share = (part + smooth * lean) / (whole + smooth)
    return float(np.log(share / (1 - share)))


def _uppercase(text: str) -> int:
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        return sum(x != x.lower() for x in text)
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, low))
    return int((a != b).sum())


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES; an empty text gives those of no evidence."""
    words = text.split()
    n = len(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = _uppercase(text)
    letters = chars - int(raw[_MARK].sum() + raw[_DIGIT].sum() + raw[_SPACE].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    many = 4 * SMOOTH
    return [
        float(np.log1p(n)),
        float(np.log((lengths.sum() + 5 * SMOOTH) / (n + SMOOTH))),
        _logit(int((lengths > 15).sum()), n),
        _logit(upper, letters, many),
        _logit(sum(map(str.isupper, words)), n),
        _logit(int(raw[_MARK].sum()), chars, many),
        _logit(int(raw[_ODD].sum()), chars, many),
        _logit(int(raw[_DIGIT].sum()), chars, many),
        _logit(int(raw[_SPACE].sum()), chars, many, 0.15),
        _logit(sum(a == b for a, b in zip(words, words[1:])), n),
        float(np.log((len(set(words)) + SMOOTH) / (n + SMOOTH))),
        float(np.log((len(set(zip(words, words[1:]))) + SMOOTH) / (n + SMOOTH))),
        float(np.log1p(chars / max(1, len(lines)))),
        _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(sum(_END.search(w) is not None for w in words), n),
        _logit(int((lengths <= 3).sum()), n, SMOOTH, 0.4),
    ]


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, features per row of `docs`; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            rows = [statistics(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[key, "features"]
            )

    slim = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, features array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(FEATURES))


def _moments(train: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label: rows, sums, sums of products. Each task sends one number per entry and label."""
    d = len(FEATURES)

    def run(batches):
        sums = {}
        for batch in batches:
            x, label = _matrix(batch.column(1)), np.asarray(batch.column(0))
            for k in (0, 1):
                z = np.hstack([np.ones((int((label == k).sum()), 1)), x[label == k]])
                sums[k] = sums.get(k, 0) + z.T @ z
        for k, m in sums.items():
            flat = m.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)],
                names=["label", "at", "value"],
            )

    rows = train.select("label", "features").mapInArrow(run, "label int, at int, value double")
    whole = {k: np.zeros((d + 1) ** 2) for k in (0, 1)}
    for r in rows.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        whole[r["label"]][r["at"]] = r["value"]
    out = {}
    for k, flat in whole.items():
        m = flat.reshape(d + 1, d + 1)
        out[k] = (float(m[0, 0]), m[0, 1:], m[1:, 1:])
    return out


def fit(train: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.05) -> dict:
    """Means, Cholesky factors and calibration from `train` (label 0 or 1, features), all of its rows.

    `to_pooled` and `to_diagonal` are the shrinkage weights. If a class has fewer than two rows,
    every score is the share of the other one.
    """
    moments = _moments(train)
    n = {k: moments[k][0] for k in (0, 1)}
    if min(n.values()) < 2:
        total = n[0] + n[1]
        return {"constant": n[1] / total if total else 0.5}
    total = n[0] + n[1]
    centre = (moments[0][1] + moments[1][1]) / total
    spread = np.sqrt(np.maximum(np.diag(moments[0][2] + moments[1][2]) / total - centre**2, 1e-4))
    means, scatters = {}, {}
    for k in (0, 1):
        mean = moments[k][1] / n[k]
        scatter = moments[k][2] - n[k] * np.outer(mean, mean)
        means[k] = (mean - centre) / spread
        scatters[k] = scatter / np.outer(spread, spread)
    pooled = (scatters[0] + scatters[1]) / total
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    model = {"centre": centre, "spread": spread, "mean": means, "inverse": {}, "log_det": {}}
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - to_pooled) * scatters[k] / n[k] + to_pooled * pooled)
        model["inverse"][k] = np.linalg.inv(factor)
        model["log_det"][k] = float(2 * np.log(np.diag(factor)).sum())
    model["slope"], model["shift"] = _calibration(train, model)
    return model


def difference(x: np.ndarray, model: dict) -> np.ndarray:
    """Log density under label 1 less that under label 0, drawn in by asinh so that far points stay finite."""
    z = (x - model["centre"]) / model["spread"]
    logs = []
    for k in (0, 1):
        far = ((z - model["mean"][k]) @ model["inverse"][k].T) ** 2
        logs.append(-0.5 * (far.sum(axis=1) + model["log_det"][k]))
    return np.arcsinh(logs[1] - logs[0])


def _calibration(train: DataFrame, model: dict, bins: int = 64) -> tuple[float, float]:
    """Slope and shift of a logistic curve over counts of the raw score in steps of 1 / bins."""

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            at = np.round(difference(_matrix(batch.column(1)), model) * bins).astype(int).tolist()
            count.update(zip(at, batch.column(0).to_pylist()))
        rows = [(a, k, c) for (a, k), c in count.items()]
        for part in [rows] if rows else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["at", "label", "n"])

    rows = train.select("label", "features").mapInArrow(run, "at long, label long, n long")
    got = rows.groupBy("at", "label").agg(F.sum("n").alias("n")).collect()
    x = np.array([r["at"] / bins for r in got])
    y, n = np.array([r["label"] for r in got], float), np.array([r["n"] for r in got], float)
    ones, zeros = (n * y).sum(), (n * (1 - y)).sum()
    aim = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    z, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (n * (aim - p)) - 1e-6 * w
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), slope)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-np.clip(difference(x, model) * model["slope"] + model["shift"], -35, 35)))


def tester(model: dict, threshold: float):
    """For `keep_rows`: passes texts whose score reaches the threshold."""

    def start():
        shape = (-1, len(FEATURES))
        return lambda texts: (probabilities(np.array([statistics(t) for t in texts]).reshape(shape), model) >= threshold).tolist()

    return start


def scored(features: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """key, score per row of `measured`."""

    def run(batches):
        for batch in batches:
            p = probabilities(_matrix(batch.column(1)), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[key, "score"])

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, "features").mapInArrow(run, f"`{key}` {kind}, score double")


def labelled(features: DataFrame, marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """label, features of the rows named by `training_marks`, stored. The marks are bounded and broadcast."""
    return stored(features.join(F.broadcast(marks), F.col(key) == F.col("_key")).select("label", "features"))
