"""The pipeline and the queries on the smallest tables, and the entry point with and without this subpackage."""

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from wayflux.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() > 0, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        kept = docs.collect()
        assert all(before[r.doc_id] == r.text for r in kept)
        if name == "exact dedup":
            texts = [(r.text or "").encode().lower() for r in kept]
            assert len(texts) == len(set(texts))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in last.collect():
        ids = library.encode(before[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_is_the_stages_one_after_another(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns) and found.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, digest string, hash long, node long, label int, keeper string, size int, taken int"


def odd_tables(spark, folder, rows):
    """Documents with nulls in every column, repeated rows and names that stages use inside, and labels for some."""
    docs = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), None, k, 1, 2, "x", None, 5) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, CLASHES).write.parquet(f"{folder}/documents.parquet")
    real = spark.read.parquet(f"{SF}/labels.parquet")
    spark.createDataFrame([(i, None if i % 5 == 0 else int(i % 2), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").select(real.columns).write.parquet(f"{folder}/labels.parquet")


def test_run_over_odd_rows(spark, tmp_path):
    prose = ["the house by the river was quiet that morning and nobody came", "little rain had fallen on the old bridge since the early spring of that year", "she wrote a long letter about the weather to her sister in the north"]
    rows = [(1, prose[0]), (2, prose[1]), (3, prose[2]), (4, prose[0].upper()), (5, prose[0] + "  "), (6, prose[1] + " again"), (6, prose[1] + " again"), (7, None), (7, None), (8, ""), (None, prose[2] + " too"), (None, None), (9, "word " * 60_000), (10, prose[2]), (10, prose[0] + " and more")]
    odd_tables(spark, tmp_path, rows)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert found and {(r.doc_id, r.n_tokens) for r in found} <= sizes
    # Each stage on all rows: one of each group of copies stays, rows without words are no copies of one another.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    assert all(f.columns == docs.columns for name, f in list(after.items())[:-1])
    near = [(r.doc_id, r.text) for r in after["MinHash near-dedup"].collect()]
    assert sorted((i for i, t in near if t and t.strip()), key=str) == [1, 2, 3, 9] and sum(not t for _, t in near) == 4
    exact = [(r.doc_id, r.text) for r in after["exact dedup"].collect()]
    assert len(exact) == len({(t or "").lower() for _, t in rows})
    assert after["BPE encoding and decoding"].count() == len(rows)


def test_run_over_an_empty_table(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_held_out_rows_are_predicted_well(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    op1 = QUERIES["op1_language_id"](spark, SF).collect()
    held = [r for r in op1 if r.held_out]
    assert len(op1) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in op1)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    op10 = [r for r in QUERIES["op10_quality"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in op10) >= 0.8 * len(op10)
    assert all(0 <= r.score <= 1 for r in QUERIES["op4_toxicity"](spark, SF).collect())


def test_entry_lists_all_queries():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = Path(__file__).parents[2]
    (tmp_path / "wayflux").mkdir()
    for p in (root / "wayflux").iterdir():
        if p.name != "llm":
            (tmp_path / "wayflux" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = f"import sys; sys.path[0] = {str(tmp_path)!r}; import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert 'A1' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
