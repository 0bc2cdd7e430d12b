import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayflux.llm.exactdup import drop_exact_copies, exact_dedup
from wayflux.llm.neardup import PARTS, drop_near_copies, forest, index_keys, near_duplicates, shingle_sets, signature

SCHEMA = "doc_id long, text string, digest string, content string, keys string, salt int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA)


def lowered(text):
    return (text or "").encode().lower().decode()


EDGES = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "a b "), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (9, "X" * 200_000), (None, "lone"), (None, "A B")]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return sorted(((i, max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)])) for i, t in rows), key=str)


@pytest.mark.parametrize("digest", [None, "weak"])
def test_exact_dedup_against_brute_force(spark, digest):
    rng = random.Random(3)
    rows = EDGES + [(100 + i, rng.choice(["One", "oNE", "two", "Two ", "three", None])) for i in range(200)]
    how = {"digest": lambda c: F.crc32(c.cast("binary")) % 3} if digest else {}  # most contents clash
    got = exact_dedup(frame(spark, rows), **how)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got.collect()), key=str) == brute_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_exact_dedup_of_one_text_that_a_third_repeats(spark):
    rows = [(i, "hot Text" if i % 3 == 0 else f"text {i % 2500}") for i in range(9000)]
    got = exact_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == brute_exact(rows)


def test_exact_copies_go_and_columns_stay(spark):
    docs = frame(spark, EDGES)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([2, 4, 5, 6, 7, 9, None], key=str)
    empty = docs.filter("false")
    assert drop_exact_copies(empty).count() == 0 and exact_dedup(empty).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "a b c"), (4, "A  B C"), (5, "a b"), (6, "v w x y z"), (7, "V W X Y Z")]
    n = 10
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 300))]
        for edits in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(edits * len(base) // 100):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((n, " ".join(text)))
            n += 1
    return rows + [(n, rows[-1][1].upper()), (n + 1, " ".join(rng.choice(vocab) for _ in range(60_000)))]


@pytest.mark.parametrize("block", [1 << 18, 400])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    for bound in ("BLOCK_SHINGLES", "FAR_SHINGLES"):
        monkeypatch.setattr(f"wayflux.llm.neardup.{bound}", block)  # small blocks: homes are cut, the second pass runs
    rows = near_rows(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_edges(spark):
    docs = frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f")])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (9, 3, False), (None, 3, False)], key=str)
    assert near_duplicates(docs.filter("false")).count() == 0
    assert drop_near_copies(docs.filter("false")).count() == 0
    assert [r.doc_id for r in drop_near_copies(docs).collect()] == [3]


def brute_rows(rows):
    """For each row its component (a number), the ids there, and whether the row alone may stay."""
    of = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(of[k][1], []).append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    return [(i, of[k][0], of[k][1], least[of[k][1]] if of[k][0] else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [1 << 15, 300])
def test_near_duplicates_with_repeated_and_null_ids(spark, monkeypatch, block):
    for bound in ("BLOCK_SHINGLES", "FAR_SHINGLES"):
        monkeypatch.setattr(f"wayflux.llm.neardup.{bound}", block)
    rng = random.Random(9)
    a, b, c, d = (" ".join(rng.choice("klmnopqrst") + str(rng.randrange(900)) for _ in range(30)) for _ in range(4))
    rows = [(3, a), (3, b), (12, a + " one"), (5, b + " tail"), (5, "quite another text of this id"), (None, c), (None, c + " x"), (None, c.upper()), (8, d), (8, d), (9, d + "  "), (7, None), (7, None), (None, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, n, least, i == least) for i, n, _, least in brute_rows(rows)), key=str)
    left = [(r.doc_id, r.text) for r in drop_near_copies(frame(spark, rows)).collect()]
    wordy = [(i, t) for i, t in left if t]
    assert len(wordy) == len({c for _, n, c, _ in brute_rows(rows) if n}) and len(left) - len(wordy) == 3
    assert sorted(wordy, key=str)[:3] == sorted([(3, a), (3, b), (5, "quite another text of this id")], key=str)


def drifting(seed, n=150):
    """Each text changes one word of the one before it, so that only the chain links first and last."""
    rng = random.Random(seed)
    text, out = [f"c{rng.randrange(2000)}" for _ in range(60)], []
    for i in range(n):
        text[rng.randrange(60)] = f"d{rng.randrange(10**6)}"
        out.append((i, " ".join(text)))
    return out


def crowd(seed, n=1200):
    """Copies of one text with few to many changed words, of which all, some or none are within the similarity, and one line in all."""
    rng = random.Random(seed)
    base, line = [f"b{rng.randrange(5000)}" for _ in range(50)], "a very common line of eight plain words"
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(50)] = f"e{rng.randrange(10**6)}"
        out.append((10_000 + i, " ".join(text) + " " + line))
    return out + [(90_000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(20)) + " " + line) for i in range(100)]


@pytest.mark.parametrize("rows", [drifting(1), crowd(2)], ids=["chain", "crowd"])
def test_near_duplicates_of_chains_and_crowds(spark, monkeypatch, rows):
    monkeypatch.setattr("wayflux.llm.neardup.BLOCK_SHINGLES", 4000)
    monkeypatch.setattr("wayflux.llm.neardup.FAR_SHINGLES", 8000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_pigeonhole_finds_every_pair_within_the_distance():
    rng = random.Random(2)
    base = signature(next(shingle_sets([" ".join(f"t{i}" for i in range(500))])))
    for _ in range(200):
        other = base.copy()
        for part in rng.sample(range(PARTS), PARTS // 4 * 2 - 1):  # one less than chunks * (errors + 1)
            other[part] ^= 1
        a, b = index_keys(base[None, :])[0], index_keys(other[None, :])[0]
        assert set(a.tolist()) & set(b.tolist())


def test_forest_spans_all_links():
    sets = list(shingle_sets([t or "" for _, t in near_rows(4)]))
    ids = [i for i, s in enumerate(sets) if len(s)]
    found = forest(ids, [sets[i] for i in ids], ids, [-1] * len(ids))
    assert len(found) == len(set(found)) and max(Counter(b for _, b in found).values(), default=0) < len(ids)
