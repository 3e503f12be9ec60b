"""Vectors, pages, quality and licences: against all pairs, exact texts, held-out labels and planted lines."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from explorium.llm import itq, licenses, quality, wrappers
from explorium.llm import queries as Q

from .plain import components


def all_links(rows):
    links = []
    ok = [r for r in rows if r[1] is not None and r[2] and all(v is not None and np.isfinite(v) for v in r[2]) and any(r[2])]
    for label in {r[1] for r in ok}:
        for d in {len(r[2]) for r in ok if r[1] == label}:
            own = [r for r in ok if r[1] == label and len(r[2]) == d]
            x = np.array([r[2] for r in own], np.float64)
            n = np.linalg.norm(x, axis=1)
            c = (x @ x.T) / np.outer(n, n)
            links += [(own[i][0], own[j][0]) for i, j in zip(*np.nonzero(np.triu(c >= 0.98, 1)), strict=True)]
    return links


def compared(got, rows):
    """Recall of links, by the sum of n_links; none may be too many."""
    links = all_links(rows)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert set(n) == {r.vec_id for r in got} and all(r.n_links <= n[r.vec_id] for r in got)
    return sum(r.n_links for r in got) / sum(n.values()) if links else 1.0, {r.vec_id: r.component_id for r in got} == components(n, links)


def test_recall_of_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    recall, same = compared(Q.op2_itq(spark, folder).collect(), rows)
    assert recall >= 0.99 and same


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs planted just above and below 0.98, a group over the block size, copies."""
    monkeypatch.setattr(itq, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows = []

    def add(v, label=1):
        rows.append((len(rows), label, [float(c) for c in np.float32(v)]))

    for cosine in (0.975, 0.981, 0.985, 0.99, 0.999):
        for _ in range(60):
            a = rng.normal(size=64)
            a /= np.linalg.norm(a)
            b = rng.normal(size=64)
            b -= (a @ b) * a
            add(a * 3, int(rng.integers(3)))
            add(cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b), rows[-1][1])
    core = rng.normal(size=64)
    for _ in range(150):
        add(core + rng.normal(size=64) * 0.08)
    for _ in range(40):
        add(core)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    recall, same = compared(itq.near_vectors(df).collect(), rows)
    assert recall >= 0.98


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [2.0, 4.0]), (3, None, [1.0, 2.0]), (4, 1, None), (5, 1, [0.0, 0.0]), (6, 1, [nan, 1.0]), (7, 1, [1.0, None]), (8, 2, [1.0, 2.0]), (9, 1, [1.0, 2.0, 3.0]), (10, 1, [1.0, 2.0]), (11, 1, []), (12, 1, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_vectors(df).collect()}
    assert got == {i: (0, i, True) for i in range(1, 13)} | {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)}
    assert itq.near_vectors(df.limit(0)).collect() == []


def test_bits_are_balanced():
    x = np.random.default_rng(0).normal(size=(4000, 32)) * np.linspace(0.2, 3, 32)
    q = itq.Quantiser(x)
    v = (x / np.linalg.norm(x, axis=1, keepdims=True) - q.mean) @ q.turn
    assert np.abs((v >= 0).mean(axis=0) - 0.5).max() < 0.1
    assert q.codes(x).shape == (4000, 8)


def expected_text(page):
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", article))).split())


def test_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = Q.op6_html(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected_text(pages[r.page_id]) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    shell = "<html><body><div class='menu'>Menu item</div><div id='cookie-banner'>We use cookies</div><div class='story'>{}</div><div id=comments><p>A reader says a very long thing here, longer than all the rest of this page taken together, and on and on</p></div><form>Name <input> send</form><div class='sidebar'>side</div></body></html>"
    body = "<h1>T&eacute;st &amp; more</h1><p>one\n two<b>three</b><br>four<p>five &#x41;&nbsp;b<script>var x = '</p>';</script><!-- no <p>comment</p> -->"
    rows = [(1, None, None), (2, "http://h.org/a", ""), (3, "http://h.org/b", "plain text &lt;b&gt;"), (4, "http://h.org/c", shell.format(body)), (5, "http://h.org/d", shell.format("<p>other</p>" * 3)),
            (6, "http://H.org/d", "<article><p>kept<aside>not</aside> <nav>nor this</nav><p>kept too"), (7, "x", "<p>" + "long " * 50_000), (7, "x", "<div>" * 3000 + "deep"), (8, "http://i.org", "<nav>only a menu</nav>"), (9, "http://i.org", "a < b <c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("region", F.lit(1)).repartition(3)
    got = {}
    for r in wrappers.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == [""] and got[2] == [""] and got[8] == [""]
    assert got[3] == ["plain text <b>"]
    assert got[4] == ["Tést & more one twothree four five A b"]
    assert got[5] == ["other other other"]
    assert got[6] == ["kept kept too"]
    assert sorted(got[7], key=len) == ["deep", "long " * 49_999 + "long"]
    assert wrappers.extract(df.limit(0)).collect() == []


def test_wrapper_of_a_host():
    pages = [f"<body><nav>m</nav><div class=a><h1>t{i}</h1>" + "<p>x%d</p>" % i * (i + 1) + ("<div class=ad>buy</div>" if i % 2 else "") + "</div><footer>same</footer></body>" for i in range(6)]
    w = wrappers.page_items(pages[0])
    for p in pages[1:]:
        w = wrappers.align(w, wrappers.page_items(p))
    flat = str(w)
    assert len(w) < 20 and "'same'" in flat and "t3" not in flat and wrappers.region(w) == "body>div.a"
    assert any(x[0] in "+*" for x in w) and any(x[0] == "?" for x in w)


def test_quality_of_documents_not_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    rows = quality.quality(docs, seen).join(labels.where("crc32(cast(doc_id as string)) % 2 = 1"), "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) / len(good) > 0.97 and sum(not r.kept for r in bad) / len(bad) > 0.9
    assert all(0 <= s <= 1 for r in rows for s in (r.text_score, r.meta_score, r.score))


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "fine words here", "en", "a", 15), (3, "fine words here", "en", "a", 15)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 4 and all(r.score is None and r.kept for r in got)
    assert quality.quality(docs.limit(0), labels.limit(0)).collect() == []
    x = np.random.default_rng(0).normal(size=(400, 1))
    y = (x[:, 0] > 0).astype(int)
    model = quality.co_train([x, -x], np.where(np.arange(400) % 4 == 0, y, -1))
    assert model.gained == [18] * 4  # at most a tenth of the labels, of each class and view
    assert ((model.scores([x, -x])[:, 2] > 0.5) == (y == 1)).mean() > 0.95


@pytest.fixture(scope="module")
def license_model():
    return licenses.train([" ".join(random.Random(i).choices("the of and tion ther ing was".split(), k=9)) for i in range(200)])


def test_templates_and_their_neighbours(license_model):
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert license_model.tell(t)[0] == family, t
    for t in ("The apache helicopter was released under fire", "All the rights of the public", "Licensed driver", "general public", "", "the terms of the work"):
        assert license_model.tell(t)[0] == licenses.UNKNOWN, t


def test_license_lines_of_documents(spark):
    folder = "/root/testdata/sf0.1"
    lines = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in Q.op10_licenses(spark, folder).collect():
        want = {f for line, f in lines.items() if line in texts[r.doc_id]}
        assert set(r.licenses) == want, (r, texts[r.doc_id][-300:])
        assert (r.license is None) == (not want) and (r.score is None) == (not want)


def test_licenses_of_odd_rows(spark, license_model):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000 + "\nReleased under the MIT License. Something else.\nAll rights reserved"), (3, "MIT"), (None, "SPDX-License-Identifier: MIT")], "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.licenses) for r in licenses.scan(docs, license_model).collect())
    assert got == [(0, ["mit"]), (1, []), (2, []), (3, []), (3, ["mit", "proprietary"])]
    assert licenses.scan(docs.limit(0)).collect() == []
