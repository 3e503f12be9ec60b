"""Quality and language of every document against plain versions of both, on the smallest tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from explorium.llm import lang_id, quality
from explorium.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def margin(row, w):
    return max(-30, min(30, sum(a * b for a, b in zip(row, w)) + w[-1]))


def plain_co_training(rows):
    """rows: id, views (two lists of numbers), label or None. A function from views to the three scores."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    known = [i for i, r in enumerate(rows) if r[2] is not None]
    kept = set(known[::5])
    own = [i for i in known if i not in kept]
    means = [np.mean([rows[i][1][v] for i in known], axis=0) for v in (0, 1)]
    sds = [np.std([rows[i][1][v] for i in known], axis=0) + 1e-6 for v in (0, 1)]
    scaled = [[(np.array(r[1][v]) - means[v]) / sds[v] for r in rows] for v in (0, 1)]
    label = {i: rows[i][2] for i in own}
    share = max(0.05, min(0.95, sum(label.values()) / len(own)))
    learn = lambda xs, ys, **o: quality.logistic(np.array(xs), np.array(ys), **o)
    for _ in range(quality.ROUNDS):
        told = {}
        for v in (0, 1):
            have = sorted(label)
            w = learn([scaled[v][i] for i in have], [label[i] for i in have])
            free = [i for i in range(len(rows)) if i not in label and i not in kept and i not in told]
            sure = {i: sigmoid(margin(scaled[v][i], w)) for i in free}
            for value, part in ((1, share), (0, 1 - share)):
                most = math.ceil(part * 0.1 * len(own))
                ranked = sorted(free, key=lambda i: (-(sure[i] if value else 1 - sure[i]), i))
                for i in ranked[:most]:
                    if (sure[i] if value else 1 - sure[i]) >= quality.SURE:
                        told[i] = value
        if not told:
            break
        label |= told
    have = sorted(label)
    weights = [learn([scaled[v][i] for i in have], [label[i] for i in have]) for v in (0, 1)]
    judges = sorted(kept)
    truth = [rows[i][2] for i in judges]
    z = [[[margin(scaled[v][i], weights[v])] for i in judges] for v in (0, 1)]
    calibrations = [learn(z[v], truth, ridge=1e-2) for v in (0, 1)]
    both = learn([[margin(z[0][k], calibrations[0]), margin(z[1][k], calibrations[1])] for k in range(len(judges))], truth, ridge=1e-2)

    def scores(views):
        c = [margin([margin((np.array(views[v]) - means[v]) / sds[v], weights[v])], calibrations[v]) for v in (0, 1)]
        return sigmoid(c[0]), sigmoid(c[1]), sigmoid(margin(c, both))

    return scores


def test_quality(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    labels = {}
    for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality in (0, 1)").collect():
        labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    views = {r.doc_id: (quality.text_features(r.text or ""), quality.meta_features(r.source, r.lang, r.n_chars)) for r in docs}
    told = plain_co_training([(i, v, labels.get(i)) for i, v in views.items()])
    got = {r.doc_id: r for r in Q.op3_quality(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want = told(views[r.doc_id]) if (r.text or "").split() else (0, 0, 0)
        assert (got[r.doc_id].text_score, got[r.doc_id].meta_score, got[r.doc_id].score) == pytest.approx(want, abs=1e-6), r.doc_id


def plain_features(text):
    raw = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()) + b" "
    counts = Counter()
    for n in (1, 2, 3, 4):
        for at in range(len(raw) - n + 1):
            part = raw[at : at + n]
            if part[:2].strip(b" "):  # one that starts with spaces only says nothing
                code = 0
                for b in part:
                    code = (code * 257 + b) % 2**32
                counts[((code + n * 0x3C6EF372) * 0x9E3779B1) % 2**32 >> 20] += 1
    x = np.zeros(lang_id.WIDTH)
    for k, c in counts.items():
        x[k] = math.sqrt(c)
    return x / max(np.linalg.norm(x), 1e-9)


def test_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    x = {r.doc_id: plain_features(r.text) for r in docs if lang_id.has_letter(r.text)}
    some = next(iter(x))
    assert lang_id.features(next(r.text for r in docs if r.doc_id == some)) == pytest.approx(x[some], abs=1e-6)
    train = [r for r in docs if r.doc_id in x and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    family = {m: f for f, ms in lang_id.FAMILIES.items() for m in ms}
    langs = sorted({r.lang for r in train})
    families = sorted({family.get(v, "=" + v) for v in langs}, key=lambda f: min(v for v in langs if family.get(v, "=" + v) == f))
    a = np.array([x[r.doc_id] for r in train], np.float32)
    machine = lambda rows, good: lang_id.linear_svm(a[rows], np.array([1.0 if good(train[i].lang) else -1.0 for i in rows]))
    every = list(range(len(train)))
    upper = {f: machine(every, lambda v, f=f: family.get(v, "=" + v) == f) for f in families}
    pairs = {(p, q): machine([i for i in every if train[i].lang in (p, q)], lambda v, p=p: v == p) for p in langs for q in langs if p < q and family.get(p, p) == family.get(q, q)}
    logistic = lambda m: 1 / (1 + math.exp(-4 * m))
    got = {r.doc_id: r for r in Q.op7_language(spark, FOLDER).collect()}
    for r in docs:
        g = got[r.doc_id]
        if r.doc_id not in x:
            assert (g.lang_pred, g.score) == (lang_id.UNKNOWN, 0)
            continue
        lead = {f: float(x[r.doc_id] @ w[:-1] + w[-1]) for f, w in upper.items()}
        first, *others = sorted(families, key=lambda f: -lead[f])
        score = logistic((lead[first] - lead[others[0]]) / 2) if others else 1.0
        own = [v for v in langs if family.get(v, "=" + v) == first]
        won, total, margins = Counter(), Counter(), {}
        for (p, q), w in pairs.items():
            if p in own:
                m = margins[p, q] = float(x[r.doc_id] @ w[:-1] + w[-1])
                won[p if m >= 0 else q] += 1
                total[p] += m
                total[q] -= m
        best = min(own, key=lambda v: (-won[v], -total[v], v))
        if mine := [m if p == best else -m for (p, q), m in margins.items() if best in (p, q)]:
            score *= logistic(min(mine))
        assert g.lang_pred == best and g.score == pytest.approx(score, abs=1e-3), r.doc_id
