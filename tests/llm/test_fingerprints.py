import hashlib
import random

import numpy as np

from wayflux.llm import multisethash as mh
from wayflux.llm.spans import shingle_hashes, word_hashes


def test_order_does_not_matter_and_edits_are_incremental():
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abc def ghi jkl".split()) for _ in range(rng.randrange(9))) for _ in range(40)]
    whole, mixed = mh.fingerprints(["\n".join(lines), "\n".join(rng.sample(lines, len(lines)))])
    assert np.array_equal(whole, mixed)
    first, rest = mh.fingerprints(["\n".join(lines[:7]), "\n".join(lines[7:])])
    assert np.array_equal(mh.add(first, rest), whole) and np.array_equal(mh.remove(whole, rest), first)
    assert np.array_equal(mh.from_text(mh.to_text(whole)), whole)
    changed = mh.fingerprints(["\n".join([*lines[:-1], lines[-1] + "x"])])[0]
    assert not np.array_equal(changed, whole) and 0.5 < mh.likeness(changed, whole) < 1 == mh.likeness(whole, mixed)


def test_likeness_of_texts_that_repeat_one_run_many_times():
    whole, half, other = mh.fingerprints(["word " * 90_000, "word " * 45_000 + "an end of its own", "quite another text of some words"])
    assert 0.99 < mh.likeness(whole, half) < 1 and mh.likeness(whole, other) < 0.3
    lines = mh.fingerprints(["\n".join(["a b c"] * 80_000)])[0]
    one, rest = mh.fingerprints(["a b c", "\n".join(["a b c"] * 79_999)])
    assert np.array_equal(mh.add(one, rest), lines) and mh.likeness(one, lines) > 0.99


def test_blocks_and_batches_do_not_change_hashes(monkeypatch):
    texts = [b"", b"one", b" a  b\tc\nd ", b"word " * 3000, "é ü".encode() * 500, b"x" * 5000]
    whole, counts = word_hashes(texts)
    monkeypatch.setattr("wayflux.llm.spans.BLOCK", 300)
    small, again = word_hashes(texts)
    assert np.array_equal(whole, small) and counts.tolist() == again.tolist() == [len(t.split()) for t in texts]
    assert len(shingle_hashes(whole[:3], 5)) == 1 and len(shingle_hashes(whole[:0], 5)) == 0


def test_edited_texts_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), "\n".join("p%d é" % rng.randrange(9) for _ in range(rng.randrange(12)))) for _ in range(300)]
    rows = list(dict(rows).items()) + [(None, "nothing"), (7_000_000, None), (7_000_001, "x" * 300_000), (-5, "")]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_chars int, range string")
    got = {r.doc_id: r for r in mh.edited_fingerprints(docs, parts=9).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        text, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r, (a, b, c) = got[i], mh.fingerprints([text, edited, following])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mh.to_text(a), mh.to_text(b))
        assert (r.near_edited, r.near_next) == (mh.likeness(a, b), mh.likeness(a, c))


def test_small_tables(spark):
    docs = spark.createDataFrame([(3, "one two\nthree")], "doc_id long, text string")
    assert [r.near_next for r in mh.edited_fingerprints(docs).collect()] == [1.0]
    assert mh.edited_fingerprints(docs.filter("false")).count() == 0
    same = spark.createDataFrame([(3, "b"), (3, "a"), (3, "b")], "doc_id long, text string")
    assert mh.edited_fingerprints(same).count() == 3
