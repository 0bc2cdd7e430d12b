"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance of transformed statistics of its documents, estimated from sums that Spark adds
up over labelled rows. Covariances are shrunk towards the pooled one and towards a multiple of the identity; their
Cholesky factors are kept with the model. The score is the logistic of the difference of the classes' log densities
(from Mahalanobis distances by triangular solves) and log priors. Friedman, Regularized Discriminant Analysis, 1989.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayflux.llm.common import text_or_empty

#: Shrinkage towards the pooled covariance and towards the identity.
TO_POOLED, TO_IDENTITY = 0.05, 0.02
#: Label rows to learn from, at most.
LABEL_ROWS = 60_000
#: A document is kept from this score on.
THRESHOLD = 0.3

_UPPER = list(range(65, 91))
_LOWER = list(range(97, 123))
_DIGIT = list(range(48, 58))
_SPACE = [9, 10, 11, 12, 13, 32]
_STOPS = [44, 46]
_MARKS = [x for x in range(33, 127) if x not in {*_UPPER, *_LOWER, *_DIGIT, *_STOPS}]

FEATURES = ("upper", "digits", "marks", "stops per word", "non-ascii", "spaces", "word length", "distinct words", "words per line", "repeated lines", "short words", "stopped words", "marked words", "doubled words")


#: Every text is judged as if so many words (of five letters and a space) of ordinary prose stood beside it, so that a
#: short text, of which little can be said, is near ordinary prose.
PRIOR_WORDS = 20.0
PRIOR_CHARS = 6 * PRIOR_WORDS
PRIOR_LINES = 2.0


def _share(part: float, whole: float, usual: float, prior: float) -> float:
    """Log odds of a share, with ``prior`` more cases of which the share ``usual`` counts."""
    p = (part + usual * prior) / (whole + prior)
    return float(np.log(p) - np.log1p(-min(p, 1 - 1e-9)))


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    tally = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower = tally[_UPPER].sum(), tally[_LOWER].sum()
    words = raw.lower().split()
    w = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    stopped = sum(1 for x in words if x[-1] in b".,")
    marked = sum(1 for x in words if not (97 <= x[-1] <= 122 or x[-1] >= 128 or x[-1] in b".,"))
    return [
        _share(upper, upper + lower, 0.03, PRIOR_CHARS),
        _share(tally[_DIGIT].sum(), n, 0.002, PRIOR_CHARS),
        _share(tally[_MARKS].sum(), n, 0.003, PRIOR_CHARS),
        float(np.log((tally[_STOPS].sum() + 0.15 * PRIOR_WORDS) / (w + PRIOR_WORDS))),
        _share(tally[128:].sum(), n, 0.03, PRIOR_CHARS),
        _share(tally[_SPACE].sum(), n, 0.17, PRIOR_CHARS),
        float(np.log((n - tally[_SPACE].sum() + 5 * PRIOR_WORDS) / (w + PRIOR_WORDS))),
        _share(w - len(set(words)), w, 0.2, PRIOR_WORDS),
        float(np.log((w + 2 * PRIOR_WORDS) / (len(lines) + PRIOR_LINES))),
        _share(len(lines) - len(set(lines)), len(lines), 0.02, PRIOR_LINES),
        _share(sum(1 for x in words if len(x) <= 3), w, 0.35, PRIOR_WORDS),
        _share(stopped, w, 0.15, PRIOR_WORDS),
        _share(marked, w, 0.01, PRIOR_WORDS),
        _share(sum(map(eq, words, words[1:])), w, 0.003, PRIOR_WORDS),
    ]


@dataclass
class Discriminant:
    """Log prior, mean and inverse Cholesky factor of each class; ``constant`` stands in where a class has no rows."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None
    constant: float = 0.5
    names: tuple[str, ...] = field(default=FEATURES)

    @classmethod
    def from_sums(cls, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
        """From each class's number of rows, sum of statistics and sum of their outer products."""
        if min(counts) < 2:
            return cls(constant=float((counts[1] + 0.5) / (counts.sum() + 1)) if counts.sum() else 0.5)
        d = sums.shape[1]
        means = sums / counts[:, None]
        scatter = squares - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / counts.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        factors, offsets = [], []
        for c in (0, 1):
            cov = (1 - to_pooled) * scatter[c] / counts[c] + to_pooled * pooled
            cov = cov / scale[:, None] / scale[None, :]
            cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
            lower = np.linalg.cholesky(cov)
            factors.append(np.linalg.solve(lower, np.diag(1 / scale)))
            offsets.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(lower)).sum())
        return cls(means, np.array(factors), np.array(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def column(self, text: Column) -> Column:
        """The score of a text column: 0 to 1, of whole texts of any length; a null text counts as empty.

        An empty text is scored as the ordinary prose that stands beside every text. Equal texts score alike, no other
        column is read, and an empty table gives no rows.
        """
        model = self

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))))

        return scored(text_or_empty(text))


def fit(sample: DataFrame) -> Discriminant:
    """A discriminant from rows (text, label) of a bounded sample; one sum per class and pair of statistics reaches the driver.

    Texts are not null there and labels are 0 or 1; rows that repeat count as often, empty and very long texts count
    like others, other columns are not read. With fewer than two rows of a class every text scores the share of label 1.
    """
    d = len(FEATURES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]]).reshape(len(batch), d)
            for c in (0, 1):
                own = x[(batch["label"] == c).to_numpy()]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], total.shape[1]), "place": np.tile(np.arange(total.shape[1]), 2), "value": total.ravel()})

    rows = sample.mapInPandas(sums, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r["label"], r["place"]] = r["value"]
    return Discriminant.from_sums(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))
