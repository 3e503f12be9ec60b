"""Operators over documents: against SQL, plain versions, round trips and held-out accuracy."""

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from explorium.llm import bpe, exact_dedup, lang_id, mixing, near_dedup
from explorium.llm import queries as Q

from .plain import components, near_links, shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", None, 0), (3, " \t\n", "en", "a", 3), (4, "one two three", "en", "a", 13),
    (5, "One two  three", "en", "b", 14), (6, "x " * 60_000, "en", "b", 120_000), (7, "é" * 10, "fr", "b", 10),
    (7, "é" * 10, "fr", "b", 10), (None, "lost", "en", "c", 4), (9, "a b c d e f g h", "en", "c", 15), (10, "a b c d e f g h", "en", "\U0001f600", 15),
    (11, "12 34 !!", "en", "c", 8), (12, "<|endoftext|> a", "en", "c", 15),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("clash")).withColumn("size", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_mixing"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    got = Q.QUERIES[name](spark, folder).toPandas()
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = db.sql(Q.ORACLE[name]).df()[list(got.columns)]
    by = list(got.columns)
    assert got.sort_values(by).values.tolist() == want.sort_values(by).values.tolist()


def test_exact_dedup_of_odd_rows(odd, none):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in empty} == {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True)}
    assert sorted(r.kept for r in rows if r.doc_id == 7) == [False, True]
    assert {(r.keep_id, r.kept) for r in rows if r.doc_id in (9, 10)} == {(9, True), (9, False)}
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert exact_dedup.exact_dedup(none).collect() == []
    assert exact_dedup.keep_one(odd).count() == len(by)


def test_cuckoo_filter_grows_and_forgets():
    rng = random.Random(5)
    index, live = exact_dedup.DigestIndex(2), {}
    for step in range(6000):
        if live and rng.random() < 0.3:
            d = rng.choice(list(live)) if step % 50 == 0 else next(iter(live))
            del live[d]
            assert index.delete(d)
        else:
            d = rng.randbytes(8) * 4 if rng.random() < 0.9 else rng.randbytes(6) + b"\0\0" + rng.randbytes(24)
            live[d] = 1
            index.insert([d, step])
    assert index.resized > 3
    assert {e[0] for e in index} == set(live)
    assert all(index.find(d) is not None for d in live)
    assert not any(index.find(rng.randbytes(32)) for _ in range(1000))
    assert not index.delete(b"\1" * 32)


def test_same_prefix_is_told_apart_by_content():
    index = exact_dedup.DigestIndex()
    index.insert([b"12345678" + b"a" * 24])
    assert index.find(b"12345678" + b"b" * 24) is None
    index.insert([b"12345678" + b"b" * 24])
    assert index.delete(b"12345678" + b"a" * 24)
    assert index.find(b"12345678" + b"b" * 24) is not None


def test_index_takes_insertions_and_deletions(spark):
    rows = lambda texts: exact_dedup.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    index = exact_dedup.build_index(rows(["a", "a ", "b", "c"]))
    after = exact_dedup.change_index(index, inserted=rows(["c", "d", "d"]), deleted=rows(["a", "b", "zzz"]))
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert {(bytes(r.digest), r.documents) for r in after.collect()} == {(sha("a"), 1), (sha("c"), 2), (sha("d"), 2)}


def test_mix_comes_near_its_targets(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").toPandas()
    assert rows.equals(mixing.mix(docs.repartition(5)).select(*rows.columns).toPandas().set_index("doc_id").loc[rows.doc_id].reset_index())
    for _, g in rows.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1
    assert (rows.taken <= 3 * rows["size"]).all()
    assert abs(rows.groupby("source").target.first().sum() - rows["size"].sum()) < 1
    got = {(r.doc_id, r.size, r.source_size) for r in mixing.mix(odd).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 3), (4, 3, 3), (6, 60_000, 60_005), (None, 1, 14)} <= got
    assert mixing.mix(none).collect() == []
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == (rows.taken / rows["size"]).sum()


def test_water_filling_clamps_in_rounds(spark):
    sizes = {"a": 1, "b": 10, "c": 1000, "d": 2, "e": 300}
    df = spark.createDataFrame([(False, k, v) for k, v in sizes.items()] + [(True, "", 5)], "__null boolean, __source string, source_size long")
    got = {r["__source"]: r.target for r in mixing.targets(df).collect()}
    names = [*sorted(sizes), ""]
    size = sizes | {"": 5}
    weight, clamped = {s: i % 3 + 1 for i, s in enumerate(names)}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in clamped)
        level = rest / sum(weight[s] for s in names if s not in clamped)
        more = {s for s in names if s not in clamped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        clamped |= more
    for s in names:
        assert got[s] == pytest.approx(3 * size[s] if s in clamped else weight[s] * level)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_dedup_is_that_of_all_pairs(spark, size):
    folder = f"/root/testdata/{size}"
    got = {r.doc_id: r for r in Q.op5_minhash(spark, folder).collect()}
    sets = {r.doc_id: shingle_set(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    want = components(sets, near_links(sets))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())


def test_near_dedup_chains_and_hot_groups(spark, monkeypatch):
    """A chain of texts of which only neighbours are similar, and a group far over the block size."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(500))
    line = [word() for _ in range(400)]
    texts = [" ".join(line[10 * k : 10 * k + 100]) for k in range(20)]
    core = [word() for _ in range(120)]
    for _ in range(150):
        t = list(core)
        t[rng.randrange(120)] = word()
        texts.append(" ".join(t))
    for _ in range(60):  # two changes far apart each: pairs lie on both sides of the threshold
        t = list(core)
        t[rng.randrange(60)] = t[60 + rng.randrange(60)] = word()
        texts.append(" ".join(t))
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    got = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert {r.doc_id: r.component_id for r in got.collect()} == components(sets, near_links(sets))


def test_near_dedup_of_odd_rows(odd, none):
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[5] == (1, 4, False) and by[6] == (1, 6, True)
    assert by[9] == (4, 9, True) and by[10] == (4, 9, False) and by[None] == (1, None, True)
    assert near_dedup.near_dedup(none).collect() == []


def test_signature_estimates_similarity():
    rng = random.Random(8)
    known = near_dedup._Words()
    for share in (0.3, 0.6, 0.75, 0.9):
        off = []
        for k in range(30):
            words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(3000)]
            cut = int(1500 * (1 - share) / (1 + share))
            a, b = (near_dedup.shingles(" ".join(w).encode(), known) for w in (words[: 1500 + cut], words[cut : 1500 + 2 * cut]))
            import numpy as np

            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (np.frombuffer(near_dedup.signature(near_dedup.minima(s)), np.uint64)[None] for s in (a, b))
            off.append(near_dedup.estimates(x, y)[0] - true)
        assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.17


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = Q.op7_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == lang_id.is_held_out(r.doc_id) for r in rows)
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, none):
    by = {r.doc_id: r for r in lang_id.identify(odd).collect()}
    assert len(by) == len(ODD) - 1
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 11))
    assert by[7].lang_pred in ("en", "fr")
    assert lang_id.identify(none).collect() == []
    assert {r.lang_pred for r in lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.identified(odd).where("doc_id in (1, 2, 3, 11)").count() == 0


def test_features_add_up_over_blocks():
    import numpy as np

    text = "".join(random.Random(1).choices("abc é1", k=400_000))
    raw = b" " + text.lower().encode().translate(lang_id._TABLE) + b" "
    counts = np.zeros(lang_id.WIDTH)
    for n in range(1, 5):
        a = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = sum(a[k : len(a) - n + 1 + k].astype(np.uint64) * 257 ** (n - 1 - k) for k in range(n)).astype(np.uint32)
        code = code[(a[: len(code)] != 32) | ((a[1 : len(code) + 1] != 32) if n > 1 else False)]
        counts += np.bincount(((code + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=lang_id.WIDTH)
    want = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
    assert np.allclose(lang_id.features(text), want, atol=1e-6)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_is_that_of_the_library(spark, odd, none, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in bpe.bpe_round_trip(docs, path).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _expected(library, texts[r.doc_id])
    texts = {r[0]: r[1] for r in ODD}
    for r in bpe.bpe_round_trip(odd, path, size=3, with_ids=True).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _expected(library, texts[r.doc_id])
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.decoded == (texts[r.doc_id] or "")
    assert bpe.bpe_round_trip(none, path).collect() == []


def test_bpe_of_every_code_point(library):
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    codec = bpe.Codec(vocabulary, bpe.Lexicon.mapped(bpe.Lexicon.compile({b" the": vocabulary.merge(b" the")})))
    for base in range(0, 0x110000, 256):
        if text := "".join(f"a{chr(k)}b {chr(k)}{chr(k)}1{chr(k)} \n" for k in range(base, base + 256) if not 0xD800 <= k < 0xE000):
            assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
            assert codec.decode(codec.encode(text)) == text


def test_automaton_is_minimal_and_exact():
    rng = random.Random(2)
    words = {bytes(rng.choices(b"abc", k=rng.randrange(1, 8))): [rng.randrange(100) for _ in range(rng.randrange(1, 4))] for _ in range(800)}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compile(words))
    for w, number in zip(words, lexicon.look_up(list(words)), strict=True):
        assert lexicon.tokens(number) == words[w]
    other = [w for w in (bytes(rng.choices(b"abcd", k=rng.randrange(0, 9))) for _ in range(2000)) if w not in words]
    assert (lexicon.look_up(other) == -1).all()
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for k in range(len(w) + 1) for p in [w[:k]]}
    assert len(lexicon.final) == len(rights)
    assert (bpe.Lexicon.mapped(bpe.Lexicon.compile({})).look_up([b"a"]) == -1).all()


def test_merging_many_is_merging_each():
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    pieces = [bytes(rng.choices(b"the and ingXQ\xc3\xa9", k=rng.choice([1, 2, 3, 7, 12, 40, 64, 65, 200]))) for _ in range(6000)]
    assert vocabulary.merge_all(pieces) == [vocabulary._merge_long(p) for p in pieces] == [vocabulary.merge(p) for p in pieces]
