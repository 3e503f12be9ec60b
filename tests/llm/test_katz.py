"""Katz backoff against a plain recursive version, and that it sums to one."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from explorium.llm import katz

from .plain import SPACE


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACE.split(low) if w] + ["</s>"]


def plain(rows, order=2, learned=None):
    """Scores by a recursive function from history and word, and that function. learned: the rows to learn from instead."""
    grams = [Counter() for _ in range(order)]
    padded = lambda w: ["<s>"] * (order - 1) + w
    for i, t in rows if learned is None else learned:
        if learned is not None or not katz.is_held_out(i):
            w = padded(tokens_of(t))
            for at in range(order - 1, len(w)):
                for n in range(order):
                    grams[n][tuple(w[at - n : at + 1])] += 1
    uni = Counter({g[0]: c for g, c in grams[0].items()})
    n, v = sum(uni.values()), len(uni)
    factors = [katz.Discounts([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]).d for c in grams]
    d = lambda n, c: factors[n][min(c, katz.K + 1)]
    left = sum(c * (1 - d(0, c)) for c in uni.values())
    per1 = n if left > 0 else n + 1
    follow = [defaultdict(list) for _ in range(order)]
    for k, c in enumerate(grams):
        for g, m in c.items():
            follow[k][g[:-1]].append((g[-1], m))
    memo, weights = {}, {}

    def weight(h):
        after, k = follow[len(h)][h], len(h)
        total = sum(c for _, c in after)
        rest = sum(c * (1 - d(k, c)) for _, c in after)
        per = total if rest > 0 else total + 1
        return per, (per - total + rest) / per / (1 - sum(p(w, h[1:]) for w, _ in after))

    def p(w, h):
        if (w, h) not in memo:
            memo[w, h] = told(w, h)
        return memo[w, h]

    def told(w, h):
        if not h:
            return d(0, uni[w]) * uni[w] / per1 if uni[w] else (per1 - n + left) / per1 if n else 1.0
        if h not in follow[len(h)]:
            return p(w, h[1:])
        if h not in weights:
            weights[h] = weight(h)
        c = grams[len(h)][(*h, w)]
        return d(len(h), c) * c / weights[h][0] if c else weights[h][1] * p(w, h[1:])

    scores = []
    for i, t in rows:
        w = tokens_of(t)
        q = padded(w)
        s = sum(math.log10(p(q[at], tuple(q[at - order + 1 : at]))) for at in range(order - 1, len(q)))
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        scores.append((i, learned is not None or katz.is_held_out(i), len(w), sum(uni[x] > 0 for x in w), n, base, s))
    return scores, p, uni, follow


@pytest.mark.parametrize(("size", "shard", "order"), [(katz.BLOCK, katz.SHARD, 2), (700, 3000, 2), (2000, 2000, 3)])
def test_scores(spark, monkeypatch, size, shard, order):
    monkeypatch.setattr(katz, "BLOCK", size)
    monkeypatch.setattr(katz, "SHARD", shard)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())[:120]
    got = sorted(tuple(r) for r in katz.katz(docs.where(f"doc_id <= {rows[-1][0]}").repartition(3), order=order).collect())
    want, p, uni, follow = plain(rows, order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    for h in [("<s>",) * (order - 1), ("the",) * (order - 1), ("nowhere",) * (order - 1), *list(follow[order - 1])[:5]]:
        assert sum(p(w, h) for w in uni) + p("unseen word", h) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_texts_of_another_day(spark, monkeypatch, tmp_path, order):
    monkeypatch.setattr(katz, "SHARD", 200)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(90)
    rows = [tuple(r) for r in docs.collect()]
    early, late = rows[:60] + [(1000 + i, f"hot k{i} hot m{i % 7}") for i in range(300)], [*rows[60:], (1, None), (2, "words never seen by anyone"), (2, rows[0][1]), (3, "hot hot k5 m3 hot")]
    schema = docs.schema
    model = katz.fit(spark.createDataFrame(early, schema), f"{tmp_path}/model", order=order)
    assert model.trained == sum(len(tokens_of(t)) for _, t in early) and len(model.levels) == order
    if order > 1:
        assert len(model.levels[1].split) and model.levels[1].over.max() > 1  # the start mark and common words are dealt out
    got = sorted(tuple(r) for r in katz.score(spark.createDataFrame(late, schema).repartition(2), katz.load(spark, f"{tmp_path}/model")).collect())
    for a, b in zip(got, sorted(plain(late, order, early)[0]), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    rows = [r for r in katz.katz(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert len(rows) > 100
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a b a b " * 5), (3, "a b"), (None, "A\tB"), (5, "never seen words"), (6, "x " * 70_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(2)
    got = sorted(((r.doc_id or 0, *r[1:]) for r in katz.katz(df).collect()))
    want = sorted((i or 0, *rest) for i, *rest in plain(texts)[0])
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert katz.katz(df.limit(0)).collect() == []
    held = next(i for i in range(100) if katz.is_held_out(i))
    assert [r.score for r in katz.katz(spark.createDataFrame([(held, "all unknown")], df.select("doc_id", "text").schema)).collect()] == [0.0]
