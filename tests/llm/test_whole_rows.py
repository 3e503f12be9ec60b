"""Rows that share an id or have none are told by their own texts."""

from pyspark.sql import functions as F

from explorium.llm import exact_dedup, lang_id, mixing, near_dedup


def test_one_row_of_each_text_stays_whatever_its_id(spark):
    rows = [(1, "one text", "a"), (1, "another text", "b"), (1, "another  text", "c"), (None, "third", "d"), (None, "fourth", "e"), (None, "fourth", "f"), (2, "one text", "g"), (0, "a copy", "h"), (0, "longest of 0", "i"),
            (5, "a  copy", "j"), (None, None, "k"), (7, " ", "l"), (8, "fi\u00e9\U0001f600 x\x0by", "m"), (9, "fi\u00e9\U0001f600xy", "n"), (9, "fi\u00e9\U0001f600xy", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect())
    assert got == sorted([(1, "one text"), (1, "another  text"), (-1, "third"), (-1, "fourth"), (5, "a  copy"), (0, "longest of 0"), (7, " "), (8, "fi\u00e9\U0001f600 x\x0by")])
    assert exact_dedup.keep_one(docs.limit(0)).collect() == []


def test_language_of_each_row_whatever_its_id(spark):
    docs = spark.createDataFrame([(1, "words of a text", "en"), (2, "mots d'un texte", "fr"), (2, "12 34", "fr"), (None, "more words", None), (None, "56", "en"), (None, None, "en")] + [(k, "words of a text", "en") for k in range(10, 20)], "doc_id long, text string, lang string")
    got = lang_id.identified(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.where("doc_id is null or doc_id < 10").collect()) == [(0, "more words"), (1, "words of a text"), (2, "mots d'un texte")]


def test_near_links_of_every_text_of_a_repeated_id(spark):
    word = lambda t, k: f"{t}{k}"
    a, b, c = (" ".join(word(t, k) for k in range(60)) for t in "abc")
    rows = [(1, a), (1, b), (7, b), (5, b), (5, c), (9, b + " more"), (12, a + " more"), (3, c + " more"), (20, "none of these words"), (None, "nor of these words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect()}
    assert got == {(1, 56, 1), (7, 56, 1), (5, 56, 1), (5, 56, 3), (9, 57, 1), (12, 57, 1), (3, 57, 3), (20, 1, 20), (None, 1, None)}


def test_one_row_of_each_near_group_stays_whatever_its_id(spark):
    a, b, c = (" ".join(f"{t}{k}" for k in range(60)) for t in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (2, a + " more", "s"), (None, b + " more", "s"), (None, c, "t"), (None, c + " more", "t"), (3, c.upper(), "t"), (3, c.upper(), "u"),
            (None, "alone without an id", "t"), (4, "", "t"), (5, None, "t"), (6, "short", "t"), (6, "Short", "t"), (7, "short", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([(1, a), (1, b), (3, c), (0, "alone without an id"), (4, ""), (5, ""), (6, "short")])
    assert near_dedup.keep_one(docs.limit(0)).collect() == []
    told = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()}
    assert (None, None, True) in told and not any(i is None and c is not None for i, c, _ in told) and (7, 6, False) in told


def test_copies_of_each_row_whatever_its_id(spark):
    rows = [(1, "a b c", "x"), (1, "d e", "x"), (1, "d e", "x"), (None, "f", "x"), (None, "g h", "x"), (None, None, "y"), (None, "i " * 30, "y"), (2, "j " * 12, "y"), (3, "k " * 5, None)] + [(None, f"m{k}", "x") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("own")).repartition(4)
    plan = mixing.mix(docs.withColumn("t", F.col("text"))).groupBy("source", F.col("t").alias("text")).agg(F.sum("copies").alias("n")).collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {(r.source, r.text): r.n for r in out.groupBy("source", "text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(r.source, r.text): r.n for r in plan if r.n}
    targets = {r.source: (r.target, r.taken) for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert all(abs(t - n) <= 15 for t, n in targets.values()) and abs(targets["x"][0] - targets["x"][1]) <= 2
    assert mixing.mixed(docs.limit(0)).collect() == []
