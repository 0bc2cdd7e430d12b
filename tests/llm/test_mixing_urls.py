import random
import re

import pytest

from wayflux.llm import mixing
from wayflux.llm.urlfilter import compile_rule, judge_urls, literal_tokens

SCHEMA = "doc_id long, text string, source string, size int, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA)


def brute_targets(rows, weights=(1, 2, 3)):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {**target, **{s: weight[s] * level for s in open_}}, sizes
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over


def rows_of(seed):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(60))), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(900)] + [(901, None, "b"), (902, "", "empty"), (1, "again", "a"), (1, "again", "a"), (None, "x y", "tiny")]


@pytest.mark.parametrize("block", [4096, 40])
def test_mix_meets_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)  # small blocks: open documents meet on further levels
    rows = rows_of(1)
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    target, sizes = brute_targets(rows)
    source = dict((i, s) for i, _, s in rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in target)
    key = lambda r: (str(r.doc_id), r.row_key, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mix_of_nothing(spark):
    docs = frame(spark, [(1, "a", "b")]).filter("false")
    assert mixing.mix(docs).count() == 0 and mixing.mixed_rows(docs).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [0]


def test_flight_keeps_totals_and_chances():
    rng = random.Random(4)
    sizes, chances = [float(rng.randrange(1, 900)) for _ in range(300)], [rng.random() for _ in range(300)]
    done = mixing.flight(sizes, chances, 3, random.Random(1))
    assert sum(0 < c < 1 for c in done) <= 3
    assert abs(sum(done) - sum(chances)) < 1e-6 and abs(sum(s * (a - b) for s, a, b in zip(sizes, done, chances))) < 1e-4
    often = [sum(c) / 400 for c in zip(*(mixing.flight([1.0, 5, 2, 7, 3], [0.2, 0.5, 0.7, 0.4, 0.6], 2, random.Random(i)) for i in range(400)))]
    assert all(abs(a - b) < 0.08 for a, b in zip(often, [0.2, 0.5, 0.7, 0.4, 0.6]))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/e"), ("block", "a-b.org", ""), ("allow", "", "/free/"), ("block", "x.com", "/q(1)/")]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=/#f", "https://m.example.com/en/", "http://example.com", "http://notexample.com/en/", "ftp://a.net/english", "ftp://a.net/E", "x://a-b.org?q", "x://c.a-b.org/z", "x://free.org/free/1", "x://y.x.com/q(1)/", "a://b://c.com/", "x://k.com/" + "p/" * 50_000, "x://a.net/e\nb"]


def brute_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[4]), (3, URLS[4]), (None, URLS[5])]
    pages = spark.createDataFrame([(i, u, "h", "t", 1) for i, u in rows], "page_id long, url string, host string, token string, copies int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES).collect()), key=str)
    assert got == sorted(((i, *brute_verdict(u)) for i, u in rows), key=str)
    assert judge_urls(pages.filter("false"), RULES).count() == 0
    assert {r.verdict for r in judge_urls(pages, [], default="block").collect()} == {"block"}


def test_rule_tokens_are_whole_in_every_url_they_fit():
    assert literal_tokens("www.example.com", "/en/news") == ["www", "example", "com", "en"]
    assert re.search(compile_rule("x.com", "/q(1)/").replace(r"\z", r"\Z"), "y.x.com/q(1)/a")


def test_mixed_rows_keep_the_columns_of_every_row(spark):
    # One source: its target is all its words, so every row comes out as often as it went in.
    rows = [(1, "a b", "s", 1, "de"), (1, "a b", "s", 1, "en"), (1, "a b", "s", 2, None), (1, "a b", "s", 2, None), (None, "c", "s", 0, "x"), (None, "c", "s", 0, "y"), (2, "w " * 300_000, "s", 3, "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed_rows(docs)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    assert mixing.mixed_rows(docs.filter("false")).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mixing.mixed_rows(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\(__key", plan)) == 1  # whole rows are shuffled once
