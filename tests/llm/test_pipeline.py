"""The stages in order, each on all that its predecessor kept."""

from __future__ import annotations

import random

import corpus_pipeline
from tallyloom.llm.sharding import shard_by_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = {"en": "the and of to in is that with for was on are by this be".split(), "de": "der die und das nicht von zu mit sich des auf ist im dem ein".split()}


def prose(seed, lang, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY[lang]) + r.choice(["", "", "a", "s", "en"]) for _ in range(n))


def test_stages(spark, tmp_path):
    item = prose(999, "en", 30)
    rows = [(k, prose(k, "de" if k % 3 == 0 else "en", 40 + k % 30), "de" if k % 3 == 0 else "en", f"s{k % 3}", 1) for k in range(120)]
    rows += [(200, rows[5][1], "en", "s0", 1), (201, rows[6][1] + " extra", "de", "s1", 1), (202, prose(5000, "en", 50) + " " + item + " " + prose(5001, "en", 50), "en", "s2", 1), (203, "12 34", "en", "s0", 1), (204, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    gone = [{203, 204}, {200, 201}, {202}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:3], gone, strict=True):
        before = {x.doc_id for x in kept.collect()}
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == COLUMNS and before - {x.doc_id for x in kept.collect()} == ids, name
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, str(tmp_path))
    assert mixed.columns == COLUMNS
    copies = mixed.groupBy("doc_id").count().collect()
    assert max(x["count"] for x in copies) <= 3 and {x.doc_id for x in copies} <= {x.doc_id for x in kept.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, out.select("doc_id", "size", "shard").collect())) == sorted(map(tuple, shard_by_bytes(mixed).select("doc_id", "size", "shard").collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, prose(999, "en", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, copies int, shard string, h long, size string, _row string, _copies string, _copy int, _path string, _index long, _file int, __row long, n int, first int"
    own = lambda k: (f"r{k}", f"c{k}", k, f"p{k}", 1, 2, 3, 4, 5)
    rows = [(k, prose(k, "en", 30), "en", None if k % 2 else "s", 1, 5, 6, "x", 7, "y", *own(k)) for k in range(12)] + [(None, prose(77, "en", 20), None, None, None, None, None, None, None, None, *own(77))] * 2 + [(3, prose(3, "en", 30), "en", None, 1, 5, 6, "x", 7, "y", *own(3))]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns, name
            assert all(x._row == f"r{k}" and x._copies == f"c{k}" and x._path == f"p{k}" for x in kept.collect() for k in [77 if x.doc_id is None else x.doc_id]), name
            kept.write.parquet(f"{tmp_path}/{name}-{docs.isEmpty()}")  # as run() does
            kept = spark.read.parquet(f"{tmp_path}/{name}-{docs.isEmpty()}")
            if name == "near-duplicates":
                assert kept.count() == (0 if docs.isEmpty() else 13)  # the repeated row goes, and one of the two equal ones without a doc_id
        out = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert out.count() == kept.count() and (docs.isEmpty() or kept.count() > 0)


def test_rows_without_or_with_repeated_doc_ids_are_judged_by_themselves(spark, tmp_path):
    item = prose(999, "en", 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = {k: prose(k, "en", 40) for k in range(40)}
    rows = [(k, text[k], "en", "s", 1) for k in range(20)]
    rows += [(3, text[30], "en", "s", 1), (19, text[2], "en", "s", 1), (None, text[31], "en", "s", 1), (None, "12 34", "en", "s", 1), (None, text[32] + " " + item, "en", "s", 1), (4, text[33] + " " + item, "en", "s", 1), (5, "56", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for written in (True, False):
        kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            had = sorted((x.doc_id or -1, x.text) for x in kept.collect())
            kept = stage(spark, kept, str(tmp_path))
            if written:
                kept.write.parquet(f"{tmp_path}/stage{k}")
                kept = spark.read.parquet(f"{tmp_path}/stage{k}")
            left = sorted((x.doc_id or -1, x.text) for x in kept.collect())
            gone = [(-1, "12 34"), (5, "56")], [(19, text[2])], [(-1, text[32] + " " + item), (4, text[33] + " " + item)], []
            assert sorted(set(had) - set(left)) == sorted(gone[k]) and len(left) == len(had) - len(gone[k]), name  # one source: its target is all its words
