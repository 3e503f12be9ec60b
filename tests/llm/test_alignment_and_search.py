"""Hard negatives, benchmark passages and aligned tokens against plain versions."""

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from explorium.llm import alignment, decontaminate, hard_negatives, queries


@pytest.mark.parametrize("name", ["op11_four_russians", "op12_wu_manber"])
def test_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = db.sql(queries.ORACLE[name])
    assert sorted(out.columns) == sorted(df.columns)
    got = sorted(map(tuple, df.select(*out.columns).collect()), key=str)
    assert got and got == sorted(out.fetchall(), key=str)


# hard negatives

MOVED, ANCHOR = (lambda i, label: label), (lambda i: i % 10 == 0)


def plain_mining(rows):
    """(anchor, positive, rank, negative, scores) of all rows that take part."""
    part = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) and abs(math.floor(256 * x)) <= 1 << 25 for x in v):
            part.append((i, [math.floor(256 * x) for x in v], label))
    anchors = list(dict.fromkeys((i, tuple(v), label) for i, v, label in part if i % 10 == 0))
    out = []
    for a, v, label in anchors:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other == label) for j, w, other in part if j != a and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(a, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hard_negatives.mine(df, MOVED, ANCHOR, **options).collect()))


VECTORS = "vec_id long, embedding array<double>, label int"


def test_scores_are_exact():
    r = np.random.default_rng(3)
    for d, top in ((1, 3), (7, 100), (8, 1), (64, 1 << 25), (65, 1 << 20)):
        a, x = r.integers(-top, top + 1, (5, d)), r.integers(-top, top + 1, (50, d))
        assert (hard_negatives.scores(hard_negatives.tables(a), hard_negatives.planes(x)) == a @ x.T).all()


def test_negatives_equal_plain_ones_in_any_blocks(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0.1, 0.3) for _ in range(19)], r.choice([0, 0, 0, 1, 2])) for i in range(400)]
    rows += [(i + 400, list(rows[i][1]), rows[i][2]) for i in range(0, 60)]  # ties between copies
    rows += [(i + 500, [round(x, 1) for x in rows[i][1]], 1) for i in range(60)]
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    want = plain_mining(rows)
    assert len(want) > 500 and mined(df) == want
    assert mined(df, block=3 * 19 * 8) == want  # many blocks of few anchors


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (10, [0.0, 0.0], 1), (20, None, 1), (30, [1.0, None], 1), (40, [nan, 1.0], 1), (50, [1.0, inf], 1), (60, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (70, [], 1), (80, [1e9, 1.0], 1),
            (1, [0.9, 0.5], 1), (1, [0.9, 0.5], 1), (1, [0.8, 0.1], 2), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, [-1.0, 0.0], 2), (5, [0.5], 2), (6, [0.7], 1), (90, [0.8], 1), (91, [0.6], 3), (100, [-0.5, -0.5], 4), (101, [0.5, 0.5], 4)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' as score", "1 as key", "2 as rank")
    assert mined(df) == plain_mining(rows) != []
    assert mined(df.where("vec_id % 10 <> 0")) == [] and mined(df.limit(0)) == [] and mined(df.where("label = 1")) == []


# benchmark passages

FOLD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return FOLD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    sizes, out = {len(w) for w in windows}, []
    for i, t in docs:
        w, hit, named = plain_words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= {str(x) for x in windows[tuple(w[k : k + n])] if x is not None}
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def passages():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdeéñ0ü漢", k=r.choice([1, 2, 3, 6]))) for _ in range(40)]
    text = lambda n, w=vocabulary: " ".join(r.choices(w, k=n))
    items = [(k, text(r.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for k in range(60)] + [(7, text(25)), (None, text(12)), (100, None), (101, " ,.; "), (102, "same words " * 40), (102, "same words " * 9), (103, "x" * 5000), (104, "Ünï-CODE, Straße! KK ſ 123abc don't")]
    docs = []
    for k in range(150):
        parts = [text(r.choice([0, 3, 20]))]
        for _ in range(r.choice([0, 1, 3])):
            t = r.choice(items)[1] or ""
            w = t.split()
            a = r.randrange(len(w) + 1)
            parts += [r.choice([t, t.upper(), " ".join(w[a : a + 10]), ", ".join(w)]), text(r.choice([0, 1, 4]))]
        docs.append((k, " ".join(parts)))
    docs += [(None, items[5][1]), (3, items[61][1]), (3, None), (900, ""), (901, "!?"), (902, "same words " * 500), (903, "x" * 5000 + " y"), (904, "ünï code straße kK ſ 123ABC don t"), (905, text(20_000) + " " + items[60][1])]
    return docs, items


def test_search_equals_plain_search_in_any_passes(spark):
    docs, items = passages()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item", "1 as window", "2 as row", "3 as spans").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "'y' as window").repartition(3)
    want = plain_search(docs, items)
    assert sum(x[5] for x in want) > 50 and not all(x[5] for x in want)
    assert sorted(map(tuple, decontaminate.decontaminate(d, b).collect()), key=str) == want
    assert sorted(map(tuple, decontaminate.decontaminate(d, b, table=20_000).collect()), key=str) == want  # several passes
    empty = decontaminate.decontaminate(d, b.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in empty)
    assert decontaminate.decontaminate(d.limit(0), b).collect() == []
    told = {r.doc_id: r for r in decontaminate.decontaminate(d, b, with_spans=True).where("doc_id in (902, 903)").collect()}
    assert [tuple(s) for s in told[902].spans] == [(0, 1000)] and "102" in told[902]["items"] and [tuple(s) for s in told[903].spans] == [(0, 1)]


def test_strings_found_at_every_place():
    r = random.Random(2)
    for letters in ("ab", "abcdefgh"):
        strings = list({"".join(r.choices(letters, k=r.choice([1, 2, 3, 8, 20, 70]))).encode() for _ in range(80)})
        engine = decontaminate.WuManber(strings)
        text = "".join(r.choices(letters, k=3000)).encode() + strings[0] * 3 + strings[-1]
        assert sorted(engine.find(text)) == sorted((k, n) for n, s in enumerate(strings) for k in range(len(text)) if text.startswith(s, k))
        assert engine.find(b"") == []


# aligned tokens

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def plain_alignment(docs):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in letters} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters)}
    told, links_of = [], []
    for i, text in docs:
        own = " " + (text or "")
        x, y = (a.encode(own, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xs = [bytes(byte[c] for c in a.id_to_token(k)) for k in x]
        ys = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or not b"".join(xs) == b"".join(ys) == own.encode():
            told.append((i, 0, 0, 0, 0, ""))
            links_of.append([])
            continue
        spans = []
        for parts in (xs, ys):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links, k = [], 0
        for j, (s, e) in enumerate(spans[0]):
            while spans[1][k][1] <= s:
                k += 1
            links += [(x[j], y[m]) for m in itertools.takewhile(lambda m: spans[1][m][0] < e, range(k, len(y)))]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        group_of = [[bisect.bisect_left(cuts, e) for _, e in span] for span in spans]
        sides = [defaultdict(list), defaultdict(list)]
        for side, ids, of in zip(sides, (x, y), group_of):
            for t, g in zip(ids, of):
                side[g].append(str(t))
        groups = [",".join(sides[0][g]) + "|" + ",".join(sides[1][g]) for g in range(len(cuts))]
        told.append((i, len(x), len(y), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links_of.append(links)
    counts = Counter(p for links in links_of for p in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(i, na, nb, g, n, sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha) for (i, na, nb, g, n, sha), links in zip(told, links_of)]


def check(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def odd_texts():
    r = random.Random(8)
    chars = ["a", "b", "the", "Hello", " ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x1f", "\x85", "\x00", "é", "é", "漢字", "😀", "👩‍👩‍👧", "'s", "'t", "12", "3", ".", "...", "(", "),", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "﻿", "ﬁ", "़", "https://", "_", "__", "ب", "​"]
    texts = ["".join(r.choices(chars, k=r.choice([1, 2, 3, 5, 9, 30]))) for _ in range(400)]
    texts += [None, "", " ", "  ", "   ", "a ", "a  ", " a", "\n", "\n ", " \n", "a▁b", "▁", "a ▁ b", "x" * 3000, "漢字かな" * 300, "a.b c, e.g. x) i.e.; it's 't ''s don't. x\r\n\ty\r z.\r\n", "ab.\n\ncd!\n \n ef\t\tgh", "\n", "\t.", ".", " .", "..", "é. ü, ñ\x85. ñ!\x1c", " " * 500, "\n" * 300, "the " * 700, "ab \x1c cd", "ab\x1c cd", "\x00", "�"]
    return [(k % 400 if k % 7 else None, t) for k, t in enumerate(texts)]


def test_alignment_equals_plain_alignment_both_ways(spark):
    docs = odd_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as a", "2 as b", "3 as times", "'x' as row", "4 as n_a").repartition(6)
    want = plain_alignment(docs)
    check(list(map(tuple, alignment.alignment(df, A, B).collect())), want)
    check(list(map(tuple, alignment.alignment(df, A, B, broadcast=0).collect())), want)
    assert alignment.alignment(df.limit(0), A, B).collect() == []
    assert {tuple(r[1:]) for r in alignment.alignment(df.where("text is null"), A, B).collect()} == {(0,) * 6 + ("",)}


def test_alignment_of_whole_documents(spark, sf):
    df = queries.op13_alignment(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(list(map(tuple, df.collect())), plain_alignment([tuple(r) for r in docs]))


def test_memory_of_stretches_is_let_go():
    pair = alignment.Pair(A, B)
    before = pair.known
    pair.learn({" one", " two"})
    pair.held = alignment.REMEMBERED + 1
    one, two = before[" one"], before[" two"]
    pair.learn({" two", " " + "three" * 100, " four.", "\nfive?!", "\t", " six\u00a0."})
    assert pair.known[" two"] is two and pair.before[" one"] is one
    assert pair.known is not before and set(pair.known) == {" two", " " + "three" * 100, " four.", " four", ".", "\nfive?!", "\nfive", "?!", "\t", " six\u00a0."}
