import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayflux.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(open(PATH, encoding="utf-8").read())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeinorst ABÉé'Σσςİ\n\t\x1c\x1f\x85 .,12́日🙂<|>"), max_size=40) | st.sampled_from(["a <|endoftext|>b", "<|ENDOFTEXT|> A", "x<|startoftext|>"]), max_size=12))
def test_ids_are_the_library_s(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == want


def test_search_keeps_pieces_and_never_needs_more_bins():
    rng = random.Random(4)
    fewer = 0
    for low, high in ((1, 2047), (500, 900), (1025, 1500), (300, 700), (1, 1)):
        lengths = [rng.randint(low, high) for _ in range(400)]
        first = packing.best_fit(lengths)
        bins = packing.local_search(first, lengths)
        assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
        assert -(-sum(lengths) // 2048) <= len(bins) <= len(first)
        fewer += len(bins) < len(first)
    assert fewer and packing.local_search([], []) == [] and packing.best_fit([2048, 1]) == [[0], [1]]
    assert len(packing.local_search([[0, 1], [2, 3], [4, 5]], [3, 3, 3, 3, 2, 2], 8)) == 2


def test_pack_frame(spark):
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, "Hello, World"), (3, "Hello, World"), (None, "é " * 5), (None, "é " * 5), (5, "word " * 5000), (6, "x" * 60_000)]
    rows += [(100 + k, " ".join(rng.choice(["tree", "house", "river", "12"]) for _ in range(rng.randint(1, 900)))) for k in range(120)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, length int, sequence_id string")
    got = packing.pack(docs.repartition(3), PATH).collect()
    want = Counter()
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1
    assert packing.pack(docs.filter("false"), PATH).count() == 0
