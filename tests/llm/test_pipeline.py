"""The pipeline against the brute-force versions of its stages."""

import os

import public_tokenizers
from fixtures import ENGLISH, FRENCH, GERMAN, PASSAGE, sorted_rows
from tokenizers import Tokenizer

import corpus_pipeline
import plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    docs = []
    for i in range(60):
        lang, text = [("en", ENGLISH), ("de", GERMAN), ("fr", FRENCH)][i % 3]
        words = text.split()
        docs.append((i, " ".join(words[i % 7 :] + words[: i % 7] + [f"{text[i % 5]}zq{i // 6}"]), lang))
    docs += [(100, docs[5][1], "fr"), (101, docs[5][1], None), (102, "12 34", "en"), (103, None, "en"), (104, PASSAGE + " then", "en"), (105, docs[7][1] + " x", "de")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(i, t) for i, t, _ in docs]


def test_pipeline(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    rows = [r for r, e in zip(rows, plain.exact_rows(rows)) if e[3]]
    rows = [r for r, s in zip(rows, plain.simhash_rows(rows)) if r[0] == s[2]]
    rows = [r for r, o in zip(rows, plain.overlap_rows(rows, [(1, PASSAGE)])) if not o[5]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    assert sorted_rows((r["doc_id"], r["n_tokens"]) for r in got) == sorted_rows(want)


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]


def test_registered():
    from __spark_entry__ import oracle_sql, queries

    names = [n for n in queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert {"op3_url_rules", "op5_decontamination", "op8_exact", "op10_warc"} <= set(oracle_sql())
    assert os.path.isfile(os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py"))


def test_only_the_last_table_stays(spark, tmp_path):
    from tallymark import session

    tables(spark, str(tmp_path))
    before = session.made_so_far()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert session.made_so_far() == before + 1 and got.count() > 0


def test_empty_tables_and_null_ids(spark, tmp_path):
    rows = [(None, ENGLISH, "en", "s", 1), (None, ENGLISH, "en", "s", 1), (None, None, None, None, None), (1, GERMAN, "de", "s", 1)]
    for name, docs, bench in [("a", rows, []), ("b", [], [(1, PASSAGE)]), ("c", [], [])]:
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() == (2 if docs else 0)
