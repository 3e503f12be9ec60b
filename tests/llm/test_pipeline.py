"""The pipeline against plain versions of its stages."""

import hashlib
import importlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from explorium.llm import lang_id, mixing

from .plain import SPACE, components, near_links, shingle_set


def test_stages_keep_columns_and_plain_results(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, docs.first().text + " \n", "en", None, 1)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, docs, folder)
    assert told.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r for i, r in rows.items() if lang_id.has_letter(r.text)}
    assert {r.doc_id: r for r in told.collect()} == kept and len(kept) == len(rows) - 2
    exact = stages["exact_dedup"](spark, told, folder)
    assert exact.columns == docs.columns
    best = {}
    for i, r in kept.items():
        key = SPACE.sub("", r.text)
        if key not in best or (-len(r.text), i) < (-len(kept[best[key]].text), best[key]):
            best[key] = i
    assert {r.doc_id for r in exact.collect()} == set(best.values())
    near = stages["near_dedup"](spark, exact, folder)
    assert near.columns == docs.columns
    sets = {i: shingle_set(rows[i].text) for i in best.values()}
    comps = components(sets, near_links(sets))
    left = {i for i, c in comps.items() if i == c}
    assert {r.doc_id for r in near.collect()} == left
    mixed = stages["mixing"](spark, near, folder)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(near.select("doc_id", "source", "text")).collect()}
    assert {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {i: n for i, n in copies.items() if n}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = stages["bpe"](spark, mixed, folder).collect()
    assert len(out) == sum(copies.values())
    for r in out:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, library.encode(rows[r.doc_id].text, add_special_tokens=False).ids)).encode()).hexdigest()


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    assert corpus_pipeline.ORACLE_SQL is None
    n = [corpus_pipeline.run(spark, folder).agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "ids_sha256") % 1000)).first() for _ in range(2)]
    assert n[0] == n[1] and n[0][0] > 0
    assert importlib.import_module("__spark_entry__").queries()["pipeline"]
