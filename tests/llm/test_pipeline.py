from __future__ import annotations

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

from .test_decontam import brute_force as contaminated_rows
from .test_minhash import brute_force as components_of
from .test_pii import plain

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    assert good.columns == docs.columns
    kept = {i for i, _ in rows(good)}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.9 * len(labels)
    once = stages["near_dedup"](spark, good, SF).cache()
    assert {i for i, _ in rows(once)} == {i for i, (_, c) in components_of(rows(good), 80).items() if i == c}
    clean = stages["decontaminate"](spark, once, SF).cache()
    bad = {r[0] for r in contaminated_rows(rows(once), items) if r[5]}
    assert {i for i, _ in rows(clean)} == {i for i, _ in rows(once)} - bad
    masked = stages["pii"](spark, clean, SF).cache()
    before, after = dict(rows(clean)), dict(rows(masked))
    assert before.keys() == after.keys() and masked.columns == docs.columns
    for i, text in after.items():
        assert not plain(text) and (text == before[i]) == (not plain(before[i]))
    last = stages["encode"](spark, masked, SF).collect()
    assert {r.doc_id for r in last} == set(after) and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in last)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    """Every row is judged by its own text: copies without id go, benchmark text without id goes, two texts under one id both stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) > 12)
    good = [r.text for r in docs.where("length(text) between 900 and 3000").orderBy("doc_id").limit(6).collect()]
    rows = [(1, good[0]), (1, good[1]), (None, good[0]), (None, good[2]), (None, good[2]), (5, good[3] + " " + item), (None, good[4] + " " + item), (5, good[5]), (7, None), (None, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "r") for i, t in rows], "doc_id long, text string, lang string, source string, __row long, __kept_id long, __bad_id long, row string")
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near_dedup"](spark, table, SF)
    assert once.columns == table.columns
    texts = sorted((r.text or "") for r in once.collect())
    assert texts == sorted([good[0], good[1], good[2], good[3] + " " + item, good[4] + " " + item, good[5], "", ""])
    clean = stages["decontaminate"](spark, once, SF)
    assert clean.columns == table.columns and sorted((r.text or "") for r in clean.collect()) == sorted([good[0], good[1], good[2], good[5], "", ""])
    for name in ("quality", "pii", "encode"):
        clean = stages[name](spark, clean, SF)
    assert all(r.round_trip for r in clean.collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "op4_url_filters" in oracle_sql()
