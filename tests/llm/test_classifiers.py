import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayflux.llm import langid, quality, toxicity
from wayflux.llm.labelled import labelled_sample

WORDS = {
    "en": "the and of that with house river under little morning could never again weather".split(),
    "de": "der und nicht schön über straße haus werden zwischen können wieder morgen größer".split(),
    "es": "el que los una también mañana señor nunca entre pueblo río casa corazón más".split(),
}
EDGES = [None, "", " \n ", "123 !!", "🙂", "x" * 300_000]


def prose(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 0.5, "s") for i, t, x in rows], "doc_id long, text string, lang string, score double, found string")


def test_language_identification(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang), lang if i % 7 else None) for i in range(150) for lang in [sorted(WORDS)[i % 3]]]
    model = langid.fit(frame(spark, rows), F.col("doc_id") % 2 == 0)
    held = [(i, prose(rng, lang, 6), lang) for i in range(60) for lang in [sorted(WORDS)[i % 3]]]
    held += [(1000 + i, t, "und") for i, t in enumerate(EDGES[:5])]
    got = frame(spark, held).select("lang", model.column(F.col("text")).alias("p")).collect()
    assert all(r.lang == r.p.lang and 0 <= r.p.score <= 1 for r in got)
    mixed = model.mixture(prose(rng, "en", 200) + " " + prose(rng, "de", 100))
    assert set(mixed) == {"en", "de"} and 0.5 < mixed["en"] < 0.8 and abs(sum(mixed.values()) - 1) < 1e-6
    assert set(model.mixture(prose(rng, "es", 300))) == {"es"}
    assert langid.fit(frame(spark, rows), F.lit(False)).predict("the house") == ("und", 0.0)


def labelled(spark, rng, bad, n=240):
    rows = [(i, bad(rng, i) if i % 4 == 0 else prose(rng, sorted(WORDS)[i % 3], 30 + i % 50), "x") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0), "t") for i in range(n)] + [(0, None, None, "t"), (10**9, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    return frame(spark, rows), labels


def test_toxicity(spark):
    insult = lambda rng, i: prose(rng, sorted(WORDS)[i % 3], 25)[:-1] + rng.choice([" blorgan ", " Blorgox "]) + prose(rng, sorted(WORDS)[i % 3], 15)
    docs, labels = labelled(spark, random.Random(2), insult)
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", F.col("doc_id") % 3 != 1, 1000), 200)
    got = docs.select("doc_id", model.column(F.col("text")).alias("p")).filter("doc_id % 3 = 1").collect()
    assert all(r.p < 0.7 for r in got if r.doc_id % 4) and sum(r.p >= 0.7 for r in got if r.doc_id % 4 == 0) >= 0.9 * sum(r.doc_id % 4 == 0 for r in got)
    edges = frame(spark, list(zip(range(6), EDGES, "abcdef"))).select(model.column(F.col("text")).alias("p")).collect()
    assert all(0 <= r.p < 0.7 for r in edges)
    assert 0 <= toxicity.fit(labelled_sample(docs, labels, "toxic", F.lit(False), 10)).score("x") <= 1


def plain_buckets(text):
    """Every n-gram's bucket, one n-gram at a time."""
    text = f" {text} ".lower()
    for n in toxicity.ORDERS:
        for i in range(len(text) - n + 1):
            code = 0
            for c in text[i : i + n]:
                code = (code * 0x01000193 + ord(c)) % 2**32
            yield (code + n) * 0x9E3779B1 % 2**32 >> (32 - toxicity.BUCKET_BITS)


def test_toxicity_against_plain_python(spark):
    rng = random.Random(7)
    docs, labels = labelled(spark, rng, lambda rng, i: prose(rng, "en", 12)[:-1] + " blorgan " + prose(rng, "en", 9), 60)
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 1000)
    counts, size = toxicity.ratios(sample)
    want = [Counter(), Counter()]
    for row in sample.collect():
        want[row.label].update(set(plain_buckets(row.text)))
    often = [b for b in want[0] | want[1] if want[0][b] + want[1][b] >= 3]
    assert size.tolist() == [45, 15] and all(counts[c, b] == want[c][b] for c in (0, 1) for b in often) and counts.sum() == sum(want[c][b] for c in (0, 1) for b in often)
    model = toxicity.fit(sample, 300)
    for text in ("", "x", "the blorgan and the river", prose(rng, "de", 300) + " Blorgan."):
        seen = Counter(plain_buckets(text))
        rate = {b: math.log1p(c * toxicity.PER / sum(seen.values())) for b, c in seen.items()}
        margin = model.intercept + sum(model.weights[model.place[b]] * v for b, v in rate.items() if model.place[b] < len(model.weights))
        assert abs(model.score(text) - 1 / (1 + math.exp(-margin))) < 1e-9


def test_toxicity_on_rows_that_were_held_out(spark):
    from wayflux.llm.queries import op4_toxicity

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    got = op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    caught = sum(a and b for a, b in held)
    assert caught >= 0.9 * sum(a for a, _ in held) and caught >= 0.9 * sum(b for _, b in held)


@pytest.mark.parametrize("span", [7, 50, 1000])
def test_spans_of_language_identification_change_nothing(monkeypatch, span):
    rng = random.Random(span)
    texts = ["", "a", " a", "a ", "!!", "".join(rng.choice("ab é1 \n") for _ in range(3000))]
    whole = [Counter(np.concatenate(list(langid.grams(t)) or [[]]).tolist()) for t in texts]
    monkeypatch.setattr(langid, "_SPAN", span)
    assert whole == [Counter(np.concatenate(list(langid.grams(t)) or [[]]).tolist()) for t in texts]


def plain_mixture(model, text):
    """Expectation maximisation one n-gram at a time, for the language set grown by penalised likelihood."""
    seen = Counter(int(b) for g in langid.grams(text) for b in g)
    chance = {b: [float(x) for x in model.chance[b]] for b in seen}
    total, names = sum(seen.values()), range(len(model.names))
    likely = lambda mix: sum(c * math.log(sum(p * chance[b][k] for k, p in mix.items())) for b, c in seen.items())
    mix = {max(names, key=lambda k: likely({k: 1.0})): 1.0}
    while len(mix) < len(names):
        rise = {k: sum(c * chance[b][k] / sum(p * chance[b][j] for j, p in mix.items()) for b, c in seen.items()) / total for k in names if k not in mix}
        new = max(rise, key=rise.get)
        trial = {**{k: p * 0.8 for k, p in mix.items()}, new: 0.2}
        for _ in range(langid.STEPS):
            part = dict.fromkeys(trial, 0.0)
            for b, c in seen.items():
                whole = sum(p * chance[b][k] for k, p in trial.items())
                for k, p in trial.items():
                    part[k] += c * p * chance[b][k] / whole
            trial = {k: v / total for k, v in part.items()}
        if rise[new] <= 1 or (likely(trial) - likely(mix)) / langid.OVERLAP <= math.log(total) + 1:
            break
        mix = trial
    return {model.names[k]: p for k, p in mix.items()}


def test_language_mixtures_against_plain_python(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, lang), lang) for i in range(60) for lang in [sorted(WORDS)[i % 3]]]
    model = langid.fit(frame(spark, rows), F.lit(True))
    for text in (prose(rng, "en", 60) + prose(rng, "es", 40), prose(rng, "de", 5), prose(rng, "de", 90) + prose(rng, "en", 60) + prose(rng, "es", 50), "zzz"):
        got, want = model.mixture(text), plain_mixture(model, text)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_long_texts_have_the_hits_of_their_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = toxicity.present(text)
    monkeypatch.setattr(toxicity, "_SPAN", 100)
    assert np.array_equal(whole, toxicity.present(text))


def test_quality(spark):
    junk = lambda rng, i: " ".join(w.upper() + "!!" for w in prose(rng, "en", 30).split()) if i % 8 else prose(rng, "de", 30).replace(" ", "$$$ | ")
    docs, labels = labelled(spark, random.Random(3), junk)
    model = quality.fit(labelled_sample(docs, labels, "quality", F.col("doc_id") % 5 != 0, 1000))
    got = docs.select("doc_id", model.column(F.col("text")).alias("p")).filter("doc_id % 5 = 0").collect()
    assert all((r.p >= 0.3) == (r.doc_id % 4 != 0) for r in got)
    edges = frame(spark, list(zip(range(6), EDGES, "abcdef"))).select(model.column(F.col("text")).alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in edges)
    assert quality.fit(labelled_sample(docs, labels, "quality", F.lit(False), 10)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(500, 3)) @ np.diag([1, 2, 3]), rng.normal(size=(900, 3)) + 1]
    model = quality.Discriminant.from_sums(np.array([500.0, 900.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.0, 0.0)
    point = np.array([[0.3, 0.2, 1.0]])

    def log_density(v):
        cov, off = np.cov(v.T, bias=True), point[0] - v.mean(0)
        return -0.5 * (off @ np.linalg.solve(cov, off) + np.linalg.slogdet(cov)[1])

    want = 1 / (1 + np.exp(log_density(x[0]) + np.log(500) - log_density(x[1]) - np.log(900)))
    assert abs(model.score(point)[0] - want) < 1e-9


def test_labels_are_bounded_and_clean(spark):
    docs, labels = labelled(spark, random.Random(4), lambda rng, i: "bad")
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 17).count() == 17
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 10**6).count() == 240
