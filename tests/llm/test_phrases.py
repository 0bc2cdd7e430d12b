import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from wayflux.llm import phrases


def plain(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for width in (1, 2, 3):
                f[lang].update(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for w, a in counts.items():
            if len(w) < 2 or a < support:
                continue
            if len(w) == 2 and any(len(t) == 3 and b >= support and w in (t[:2], t[1:]) and 100 * b >= 50 * a for t, b in counts.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[w[:k]] * counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, rank, w.decode(), -a, left, right, n[lang], -score) for rank, (score, a, w, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(6)
    words = ["tree", "River", "of", "the", "ÉTÉ", "日本", "a-b", "x"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x1c"]) for _ in range(rng.randint(0, 40)))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), ("fr", " .. "), ("xx", "one two three"), ("hot", "same same same " * 3000), ("hot", "same same same " * 3000)]


def test_collocations_against_plain_python(spark):
    rows = corpus()
    frame = spark.createDataFrame([(k, t, x, "z") for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")
    for support, top, parts in ((3, 2000, 5), (3, 4, 1)):
        got = phrases.collocations(frame.repartition(parts), support=support, top=top).collect()
        assert sorted(tuple(r) for r in got) == plain(rows, support, top)
    assert phrases.collocations(frame.filter("false")).count() == 0 and phrases.collocations(frame.filter("lang = 'fr'")).count() == 0


def test_shards_are_cut_at_breaks_only(monkeypatch):
    rows = [(x or "und", (t or "").lower()) for x, t in corpus()]
    batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows], "text": [t for _, t in rows]})

    def counts():
        found = Counter()
        for s in phrases.shards(iter([batch])):
            for firsts, width in zip(s.firsts(), (1, 2, 3)):
                for i in firsts:
                    found[s.lang, *(s.data[s.begins[i + k] : s.ends[i + k]] for k in range(width))] += 1
        return found

    whole = counts()
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    monkeypatch.setattr(phrases, "SCAN_BYTES", 60)
    assert counts() == whole and len(list(phrases.shards(iter([batch])))) > 20


def test_scores_of_large_counts_are_exact(spark):
    a, left, right = 900_000_000_001, 999_999_999_989, 999_999_999_961
    frame = spark.createDataFrame([("x", "p q", a), ("x", "p", left), ("x", "q", right)], "lang string, phrase string, f long")
    row = phrases.scored(frame).collect()
    assert [(r.a, r.l, r.r, r.score) for r in row] == [(a, left, right, 1_000_000 * a * a // (left * right))]
