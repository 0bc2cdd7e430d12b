"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams, by how often they occur among PER n-grams of the text (log(1 + rate)), so that
a long text does not have every feature. Spark counts in how many labelled documents of each class each occurs; the
log-count ratio of a feature scales it, and the FEATURES ratios that stand out most against chance are the model's
vocabulary. A logistic regression over the scaled features is fitted to a bounded sample.
Wang and Manning, Baselines and bigrams: simple, good sentiment and topic classification, ACL 2012.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.llm.common import text_or_empty

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 18
#: Features of the model and the penalty on their weights, chosen on a split of the rows it may learn from.
FEATURES, PENALTY = 2000, 0.1
#: n-grams among which a feature's occurrences are counted.
PER = 1000.0
#: Label rows to learn from, at most.
LABEL_ROWS = 24_000
#: Rows of the sample that a task works on.
TASK_ROWS = 500
THRESHOLD = 0.7
#: Characters of a text that are hashed at once.
_SPAN = 1 << 18


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of a lower-cased text between two spaces, order by order and span by span."""
    codes = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for begin in range(0, max(1, len(codes) - ORDERS[0] + 1), _SPAN):
        part = codes[begin : begin + _SPAN + ORDERS[-1] - 1]
        grams = np.zeros(len(part), np.uint32)
        for n in range(1, ORDERS[-1] + 1):
            if len(part) < n:
                break
            grams = grams[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in ORDERS:
                # The high bits of a product by an odd constant depend on all bits of the polynomial.
                yield ((grams + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def present(text: str) -> np.ndarray:
    """Distinct buckets of a text."""
    return np.unique(np.concatenate([np.unique(b) for b in buckets(text)] or [np.zeros(0, np.uint32)]))


class LinearModel:
    """Weights of the chosen buckets (others have none) and an intercept."""

    def __init__(self, place: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.place, self.weights, self.intercept = place, weights, intercept

    def score(self, text: str) -> float:
        at, value = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[at] @ value, -500, 500))))

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Chosen features that occur in ``text``, and their values."""
        counts, total = np.zeros(len(self.weights) + 1, np.int64), 0
        for b in buckets(text):
            counts += np.bincount(self.place[b], minlength=len(counts))
            total += len(b)
        at = np.flatnonzero(counts[:-1])
        return at, np.log1p(counts[at] * (PER / max(total, 1)))

    def column(self, text: Column) -> Column:
        """The score of a text column: 0 to 1, of whole texts of any length; a null text counts as empty.

        An empty text has the score of the intercept. Equal texts score alike, no other column is read, and an empty
        table gives no rows.
        """
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return texts.map(shared.value.score).astype("float64")

        return scored(text_or_empty(text))


def ratios(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that have each bucket (2 x buckets), and documents of each class."""
    size = 1 << BUCKET_BITS

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size), np.int64)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                total[label, present(text)] += 1
                docs[label] += 1
        at = np.flatnonzero(total.sum(0))
        yield pd.DataFrame({"bucket": np.append(at, -1), "clean": np.append(total[0, at], docs[0]), "toxic": np.append(total[1, at], docs[1])})

    found = sample.mapInPandas(counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # A bucket met once or twice cannot stand out; dropping it here only shortens what reaches the driver.
    found = found.filter("bucket < 0 or clean + toxic >= 3").toPandas()
    counts, docs = np.zeros((2, size)), np.zeros(2)
    for name, c in (("clean", 0), ("toxic", 1)):
        known = found["bucket"] >= 0
        counts[c, found["bucket"][known]] = found[name][known]
        docs[c] = found[name][~known].sum()
    return counts, docs


def fit(sample: DataFrame, features: int = FEATURES, bound: int = LABEL_ROWS) -> LinearModel:
    """A model from rows (text, label) of a sample of about ``bound`` rows, as ``labelled_sample`` draws it.

    Texts are not null there and labels are 0 or 1; rows that repeat count as often, empty and very long texts count
    like others, other columns are not read. Without rows of both classes the model scores every text alike. What
    reaches the driver is bounded by the buckets and the sample, which is written once and dealt over tasks of
    TASK_ROWS rows, however many partitions it was found in.
    """
    sample = checkpoint(sample.select("text", "label").repartition(bound // TASK_ROWS + 1))
    counts, docs = ratios(sample)
    size = 1 << BUCKET_BITS
    if min(docs) < 1:
        return LinearModel(np.zeros(size, np.int32), np.zeros(0), float(np.log((docs[1] + 0.5) / (docs[0] + 0.5))))
    ratio = np.log((counts[1] + 0.5) / (docs[1] + 1)) - np.log((counts[0] + 0.5) / (docs[0] + 1))
    spread = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    standing = np.where(counts.sum(0) >= 3, np.abs(ratio) / spread, 0.0)
    chosen = np.sort(np.argsort(-standing, kind="stable")[:features])
    place = np.full(size, len(chosen), np.int32)
    place[chosen] = np.arange(len(chosen))
    blank = LinearModel(place, np.zeros(len(chosen)), 0.0)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [blank.features(t) for t in batch["text"]]
            yield pd.DataFrame({"at": [a.astype(np.int32).tobytes() for a, _ in rows], "value": [v.astype(np.float32).tobytes() for _, v in rows], "label": batch["label"]})

    rows = sample.mapInPandas(found, "at binary, value binary, label int").toPandas().sort_values(["at", "value", "label"])
    at = [np.frombuffer(a, np.int32) for a in rows["at"]]
    value = np.frombuffer(b"".join(rows["value"]), np.float32).astype(float)
    weights, intercept = logistic(at, value, rows["label"].to_numpy(float), ratio[chosen])
    return LinearModel(place, weights, intercept)


def logistic(at: list[np.ndarray], value: np.ndarray, label: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights over features and an intercept: logistic loss, L2 penalty in the scaled space, Adam on all rows.

    ``at`` has the features of each row, ``value`` their values, one row after another.
    """
    owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
    column = np.concatenate(at) if at else np.zeros(0, np.int32)
    n, d = len(at), len(scale)
    value = value * scale[column]
    # The intercept is the last of the parameters.
    x = np.append(np.zeros(d), np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    mean, square = np.zeros(d + 1), np.zeros(d + 1)
    for i in range(1, steps + 1):
        margin = x[d] + np.bincount(owner, value * x[column], n)
        off = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label
        slope = np.append(np.bincount(column, value * off[owner], d) + penalty * x[:d], off.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        rate = 0.05 * (1 - i / steps) + 1e-3
        x = x - rate * mean / (1 - 0.9**i) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return x[:d] * scale, float(x[d])
