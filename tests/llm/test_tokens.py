import hashlib
import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayflux.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.Vocabulary.load(PATH)


def encoded(texts):
    encoder = OURS.encoder()
    next(encoder)
    return [list(x) for x in encoder.send(texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeinorst ABé'Σσςİ\n\t.,12́日🙂<|>"), max_size=60), max_size=20))
def test_same_tokens_as_the_library(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts) == want
    assert [OURS.decode(x) for x in want] == [LIBRARY.decode(x, skip_special_tokens=False) for x in want]


@pytest.mark.parametrize("bulk", [1, 10**9])
def test_bulk_and_single_merges_agree(monkeypatch, bulk):
    monkeypatch.setattr(bpe, "_BULK", bulk)
    texts = ["banana bandana aaaa aaaaaaa abababab", "", "the theatre of the thing", "<|endoftext|>x"]
    assert encoded(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_encode_frame(spark):
    rows = [(1, None), (2, ""), (3, "Hello, World"), (3, "Hello, World"), (None, "é" * 5), (5, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.encode(docs, PATH, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    want = {}
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), LIBRARY.decode(ids, skip_special_tokens=False))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all((r.n_tokens, r.ids, r.ids_sha256, r.decoded) == want[r.doc_id] for r in got)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert all(r.decoded == want[r.doc_id][3] for r in back.collect())
    assert bpe.encode(docs.filter("false"), PATH).count() == 0


def test_rank_order_is_checked():
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        bpe.Vocabulary(spec)
