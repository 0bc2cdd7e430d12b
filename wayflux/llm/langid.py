"""Language identification as multilingual mixture inference.

A document's letter n-grams are drawn from a mixture of languages with known n-gram distributions. Expectation
maximisation estimates the proportions. The set of languages grows one by one, by the language whose share would raise
the likelihood fastest, as long as the log likelihood gains more than a penalty per language.
After Lui, Lau and Baldwin, Automatic detection and language identification of multilingual documents, TACL 2014.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflux.llm.common import text_or_empty

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
SMOOTHING = 0.3
#: Documents per language to learn from, at most (as expected: each is drawn by the hash of its id).
DOCS_PER_LANGUAGE = 20_000
#: n-grams overlap, so that many of them count as one observation in the penalised likelihood.
OVERLAP = 6.0
STEPS = 20
UNDETERMINED = "und"
_SPAN = 1 << 18
_GAP = np.zeros(1, np.uint32)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _letters[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a lower-cased text, whose runs of other characters than letters count as one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    before, after_letter = _GAP, False  # what the next span's n-grams may begin with
    for begin in range(0, len(codes), _SPAN):
        part = codes[begin : begin + _SPAN]
        letter = _is_letter()[part]
        kept = np.where(letter, part, np.uint32(0))[letter | np.concatenate([[after_letter], letter[:-1]])]
        after_letter = letter[-1]
        ends = [_GAP] if begin + _SPAN >= len(codes) else []
        symbols = np.concatenate([before, kept, *ends])
        hashed = np.zeros(len(symbols), np.uint32)
        for n in range(1, ORDERS[-1] + 1):
            if len(symbols) < n:
                break
            hashed = hashed[: len(symbols) - n + 1] * np.uint32(0x01000193) + symbols[n - 1 :] + np.uint32(1)
            if n in ORDERS:
                inner = symbols[(n - 1) // 2 : len(symbols) - n // 2] != 0
                inner[: max(0, len(before) - n + 1)] = False  # yielded with the span before
                # The high bits of a product by an odd constant depend on all bits of the polynomial.
                yield ((hashed[inner] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        before = symbols[-(ORDERS[-1] - 1) :]


def tally(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    found = list(grams(text))
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0)
    every = np.concatenate(found)
    if len(every) > 1 << 14:
        counts = np.bincount(every, minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(counts)
        return at, counts[at].astype(float)
    at, counts = np.unique(every, return_counts=True)
    return at, counts.astype(float)


class Languages:
    """n-gram probabilities of each language: buckets x languages, 256 KB for each language."""

    def __init__(self, names: list[str], chance: np.ndarray) -> None:
        self.names, self.chance = names, chance.astype(np.float32)

    def mixture(self, text: str) -> dict[str, float]:
        """Proportions of the languages that a text is found to use; empty without a letter or a learned language."""
        at, counts = tally(text)
        if not len(at) or not self.names:
            return {}
        chance, total = self.chance[at].astype(float), counts.sum()
        chosen = [int(np.argmax(counts @ np.log(chance)))]
        share, mixed = np.ones(1), chance[:, chosen[0]]
        reached = counts @ np.log(mixed)
        while len(chosen) < len(self.names):
            rise = (counts / mixed) @ chance / total
            rise[chosen] = 0
            new = int(np.argmax(rise))
            if rise[new] <= 1.0:
                break
            trial = [*chosen, new]
            parts = chance[:, trial]
            pi = np.append(share * 0.8, 0.2)
            for _ in range(STEPS):
                pi = pi * ((counts / (parts @ pi)) @ parts) / total
            mixed_now = parts @ pi
            now = counts @ np.log(mixed_now)
            if (now - reached) / OVERLAP <= np.log(total) + 1.0:
                break
            chosen, share, mixed, reached = trial, pi, mixed_now, now
        return {self.names[k]: float(p) for k, p in zip(chosen, share)}

    def predict(self, text: str) -> tuple[str, float]:
        """The language with the largest proportion (the first by name of equals), and the proportion."""
        found = self.mixture(text)
        if not found:
            return UNDETERMINED, 0.0
        name = min(found, key=lambda k: (-found[k], k))
        return name, min(1.0, max(0.0, found[name]))

    def column(self, text: Column) -> Column:
        """struct(lang, score) of a text column, of whole texts of any length.

        A null text counts as empty; a text without a letter is ``und`` with score 0, as is every text where no
        language was learned. Of equal proportions the first language by name is given. Equal texts get equal results,
        no other column is read, and an empty table gives no rows.
        """
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("lang string, score double")
        def predicted(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

        return predicted(text_or_empty(text))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Languages:
    """n-gram models of the languages of those rows of ``docs`` that ``learn`` admits and whose language is known.

    About ``per_language`` documents of each language are drawn by the hash of their ids (rows that repeat an id are
    drawn together and count as often; a null id is one id). Null texts count as empty, empty ones add nothing, long
    ones are counted whole. Without rows no language is learned. Other columns are not read. Counts are added up by
    Spark; what reaches the driver is one number per language and bucket that occurs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(F.col(text_col)).alias("text"))
    rows = rows.filter(learn & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return Languages([], np.zeros((1 << BUCKET_BITS, 0)))
    million = {r["lang"]: min(1_000_000, int(1e6 * per_language / r["count"]) + 1) for r in sizes}
    limits = F.create_map(*[F.lit(x) for pair in million.items() for x in pair])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.try_element_at(limits, "lang")).select("lang", "text")
    places = {name: i for i, name in enumerate(names)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = total.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                at, counts = tally(text)
                own[at] += counts.astype(np.int64)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"place": places[lang], "bucket": at, "n": own[at]})

    found = drawn.mapInPandas(counted, "place int, bucket int, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    counts[found["bucket"], found["place"]] = found["n"]
    counts += SMOOTHING
    return Languages(names, counts / counts.sum(0))
