"""Quality rules, the quality model and licence scans."""

from __future__ import annotations

import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import licenses, quality_model, quality_rules, queries
from emberline.llm.quality_rules import RULES, Measured, Rule
from tests.llm.conftest import ROWS, SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    times, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def check_rules(rows, given):
    expected = Counter()
    for i, t in given:
        m = slow_measures(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        expected[i, m, failed, not any(r.rejects(Measured(t)) for r in RULES)] += 1
    assert Counter((r["doc_id"], tuple(r[k] for k in quality_rules.MEASURES), r["base_failed"], r["kept"]) for r in rows) == expected


def test_rules_query(spark, given):
    check_rules(queries.op8_quality_rules(spark, SF_DIR).collect(), given)


def test_rules_edges(messy):
    check_rules(quality_rules.measure(messy).collect(), ROWS)
    assert quality_rules.measure(messy.limit(0)).count() == 0
    kept = quality_rules.drop_rejected(messy)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t in ROWS if not any(r.rejects(Measured(t)) for r in RULES))


def test_repeated_words_overlap():
    for text in ("a a a a", "a b c a b c", "a b c d a b c d e", "x y", "", "a b a b a b a"):
        assert Measured(text).n_repeat_words == slow_measures(text)[4]


def test_cascade_takes_the_cheap_and_strict_first(spark):
    def slow(m):
        return sum(range(20_000)) < 0 or len(m.text) % 2 == 0

    rules = (Rule("slow", slow), Rule("never", lambda m: False), Rule("fast", lambda m: len(m.text) % 2 == 0))
    docs = spark.createDataFrame([("x" * i,) for i in range(60)], "text string")
    assert [r.name for r in quality_rules.order_rules(docs, rules)][0] == "fast"
    assert [r.name for r in quality_rules.order_rules(docs.limit(0), rules)] == ["slow", "never", "fast"]


def test_rules_keep_good_labelled_texts(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality_rules(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels]
    assert not [r for r in rows if labels[r["doc_id"]] == 0 and r["kept"]]
    assert not [r for r in rows if labels[r["doc_id"]] == 1 and not r["kept"] and not r["base_failed"]]


def test_model_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality_model.judge(docs, fit).join(held, "doc_id")
    right = judged.agg(F.avg(((F.col("probability") >= 0.5) == (F.col("quality") == 1)).cast("double")), F.count("*")).first()
    assert right[1] > 1500 and right[0] >= 0.99


def test_toxic_texts_go_and_others_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1 and quality = 1")
    judged = quality_model.judge(docs, fit).join(held, "doc_id")
    found = {r["toxic"]: (r["n"], r["kept"]) for r in judged.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert found[1][0] > 150 and found[1][1] <= 0.1 * found[1][0] and found[0][1] >= 0.99 * found[0][0]


def test_a_fit_that_would_overshoot():
    """Features that repeat each other and part the labels: plain Newton steps would diverge."""
    rng = np.random.default_rng(1)
    x = np.repeat((rng.random((300, 6)) < 0.05).astype(float), 30, axis=1)
    y = (x.sum(axis=1) > 0).astype(float)
    found = quality_model.Logistic(x, y).evidence(x)
    assert ((found >= 0) == (y == 1)).all()


def slow_fit(x, y, ridge=1.0):
    """Ridge logistic regression by many small Newton steps on the whole sum, written out."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= 0.5 * np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
    return lambda t: np.clip(w[0] + np.clip((t - mean) / scale, -8, 8) @ w[1:], -30, 30)


def slow_shrunk(groups, toward):
    """Posterior mean of each group of probabilities, shrunk to ``toward`` by a weight from moments."""
    n = np.array([len(g) for g in groups])
    means, own = np.array([np.mean(g) for g in groups]), np.array([np.var(g) for g in groups])
    spread = (np.sum(n * (means - toward) ** 2) - own.sum()) / n.sum()
    weight = min(1e4, max(1.0, max(np.sum(n * own) / n.sum(), 1e-9) / spread)) if spread > 0 else 1e4
    return (weight * toward + means * n) / (weight + n)


def test_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    known = [r for r in rows if r["doc_id"] in labels]
    bags = {r["doc_id"]: set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower())) for r in rows}
    toxic = np.array([labels[r["doc_id"]][1] for r in known], float)
    n, s, rate = Counter(), Counter(), toxic.mean()
    for r, y in zip(known, toxic, strict=True):
        n.update(bags[r["doc_id"]])
        s.update({w: y for w in bags[r["doc_id"]]})
    ranked = sorted((w for w in n if n[w] > 1), key=lambda w: (-abs((s[w] - n[w] * rate) / np.sqrt(n[w] * (rate * (1 - rate)) + 1)), w))
    words = sorted(ranked[: quality_model.WORDS])
    expected = {}
    for name, label, make in (
        ("probability", 0, lambda r: quality_model.features(r["text"]).astype("<f4")), ("toxic_probability", 1, lambda r: np.array([w in bags[r["doc_id"]] for w in words], "<f4")),
    ):
        evidence = slow_fit(np.array([make(r) for r in known], float), np.array([labels[r["doc_id"]][label] for r in known], float))
        odds = np.array([evidence(make(r).astype(float)) for r in rows])
        p = 1 / (1 + np.exp(-odds))
        hosts, paths = {}, {}
        for r, x in zip(rows, p, strict=True):
            hosts.setdefault(r["source"], []).append(x)
            paths.setdefault((r["source"], r["lang"]), []).append(x)
        host = dict(zip(hosts, slow_shrunk(list(hosts.values()), p.mean()), strict=True))
        path = dict(zip(paths, slow_shrunk(list(paths.values()), np.array([host[h] for h, _ in paths])), strict=True))
        logit = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
        whole = [o + logit(path[r["source"], r["lang"]]) - logit(p.mean()) for r, o in zip(rows, odds, strict=True)]
        expected[name] = {r["doc_id"]: 1 / (1 + np.exp(-o)) for r, o in zip(rows, whole, strict=True)}
    for r in queries.op4_quality_classifier(spark, SF_DIR).collect():
        good, bad = expected["probability"][r["doc_id"]], expected["toxic_probability"][r["doc_id"]]
        assert abs(r["probability"] - good) < 1e-3 and abs(r["toxic_probability"] - bad) < 1e-3
        if abs(good - 0.5) > 2e-3 and abs(bad - 0.5) > 2e-3:
            assert r["kept"] == (good >= 0.5 and bad < 0.5)


def test_sites_shrink_by_their_size(spark):
    rows = [("big", "big/a", p) for p in [0.9] * 400 + [0.8] * 100] + [("small", "small/a", 0.0)] + [(f"h{i}", f"h{i}/a", 0.4 + 0.002 * i) for i in range(100)]
    sites, whole = quality_model.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double").repartition(3))
    found = {r["host"]: r for r in sites.collect()}
    assert 0.85 < found["big"]["host_posterior"] < 0.9
    # one text says little: its site stays much nearer to the global mean than to its own
    assert 0 < found["small"]["host_posterior"] < whole and found["small"]["host_posterior"] > whole / 4
    assert all(0 < r["path_posterior"] < 1 for r in found.values())


def test_a_doubtful_text_follows_its_site(spark):
    model = quality_model.Logistic(np.array([[0.0], [1.0]]), np.array([0.0, 1.0]))
    assert abs(model.evidence(np.array([[0.5]]))[0]) < 1e-9
    # the same evidence, two sites
    rows = [("good", "good", 0.95)] * 50 + [("bad", "bad", 0.05)] * 50
    sites, whole = quality_model.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    final = sites.withColumn("evidence", F.lit(0.0)).select("host", quality_model._final(whole).alias("p"))
    found = {r["host"]: r["p"] for r in final.collect()}
    assert found["bad"] < 0.2 < 0.8 < found["good"]


def test_model_edges(spark, messy):
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, None), (None, 1), (9, 0), (9, 0), (12, 0)], "doc_id long, quality int")
    rows = quality_model.judge(messy, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    assert all(0 <= r["probability"] <= 1 for r in rows)
    kept = quality_model.drop_low_quality(messy, labels)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])
    assert quality_model.judge(messy.limit(0), labels).count() == 0
    assert quality_model.judge(messy, labels.limit(0)).count() == len(ROWS)
    both = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, given in ((messy, both), (messy, both.limit(0)), (messy.limit(0), both), (messy, both.where("doc_id = 1"))):
        assert quality_model.judge(docs, given).where("toxic_probability between 0 and 1").count() == docs.count()


MIT = """MIT Licence

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def sentence(name):
    """A known sentence, with names where it has room for them."""
    return licenses.SENTENCES[name].replace("*", "the University of X", 1).replace("*", "its contributors", 1)


def names(text):
    return [r.license for _, _, r in licenses.Scanner().matches(text)]


def test_licence_rules():
    assert names(MIT) == ["MIT"]
    first, second, third = MIT.split("\n\n")[1:]
    assert names("\n\n".join((second, first, third))) == []  # out of order
    assert names(first + "\n\n" + "x" * 500 + "\n\n" + second + "\n\n" + third) == []  # too far apart
    bsd = [sentence(k) + "." for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")]
    assert names("\n".join(bsd[:3])) == ["BSD-2-Clause"] and names("\n\n".join(bsd)) == ["BSD-3-Clause"]
    assert names("Intro here. Released under the MIT License. All rights reserved.") == ["MIT", "LicenseRef-all-rights-reserved"]
    assert names("some text without a stop\nLicensed under CC BY-NC 4.0.\nmore") == ["CC-BY-NC-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0-only"]
    assert names("SPDX-License-Identifier: Apache-2.0") == ["Apache-2.0"]
    assert names("He said the MIT License is short and licensed under the stars.") == []


def test_licence_headers_in_comments_and_lists():
    """Headers as source files have them: commented, wrapped, with bullets or numbers directly below."""
    grant, source, binary, endorse = (sentence(k) for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names"))
    isc = licenses.SENTENCES["isc.grant"] + "."
    for bullets in (("1. ", "2. ", "3. "), ("* ", "* ", "* "), ("- ", "- ", "- "), ("(1) ", "(2) ", "(3) "), ("a) ", "b) ", "c) "), ("o ", "o ", "o ")):
        items = [b + x + "." for b, x in zip(bullets, (source, binary, endorse), strict=True)]
        for gap in ([], [""]):
            for n, spdx in ((2, "BSD-2-Clause"), (3, "BSD-3-Clause")):
                bsd = [*textwrap.wrap(grant + ":", 70), *gap, *[y for x in items[:n] for y in textwrap.wrap(x, 70)]]
                for text, expected in ((bsd, spdx), (MIT.split("\n"), "MIT"), (textwrap.wrap(isc, 60), "ISC")):
                    text = ["Copyright (c) 2020 The Authors", *text]
                    for leader in ("", " * ", "# ", "// ", "-- ", "REM ", "dnl ", ";; "):
                        header = "\n".join((leader + x).rstrip() for x in text)
                        header = "/*\n" + header + "\n */\nint x;" if leader == " * " else header
                        assert names(header) == [expected], header
                        begin, end, _ = licenses.Scanner().matches(header)[0] if leader == "# " else (0, 0, None)
                        assert leader != "# " or header[begin:end].startswith(("Redistribution", "Permission"))


# Own table: what the lines of the given data grant, and what texts and headers outside of it do.
GRANTS = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "All rights reserved.": "LicenseRef-all-rights-reserved",
}


def test_licences_by_brute_force(spark, given):
    """The given lines are whole sentences, so looking for each in the text is an independent answer."""
    rows = {r["doc_id"]: r for r in queries.op9_licenses(spark, SF_DIR).collect()}
    found = 0
    for i, t in given:
        expected = {spdx for line, spdx in GRANTS.items() if re.search(rf"(?:^|\s){re.escape(line)}(?:\s|$)", t or "")}
        assert set(rows[i]["licenses"]) == expected
        for m in rows[i]["matches"]:
            assert GRANTS[t[m["begin"] : m["end"]].strip().rstrip(".") + "."] == m["license"]
        found += len(expected)
    assert found


LESSER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at"""


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
        ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", "LGPL-2.1-or-later"),
        ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
        ("SPDX-License-Identifier: Zlib", "Zlib"),
        ("# SPDX-License-Identifier: unlicense", "Unlicense"),
        ("<!-- SPDX-License-Identifier: MIT OR Apache-2.0 -->", "Apache-2.0 MIT"),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND BSD-3-Clause", "BSD-3-Clause GPL-2.0-only MIT"),
        ("SPDX-License-Identifier: LicenseRef-Own", ""),
        ("SPDX-License-Identifier: no such words", ""),
        ("SPDX-License-Identifier: (MIT", ""),
        ("This package is licensed under the MIT License", "MIT"),
        ("You can redistribute it under the terms of the MIT license.", "MIT"),
        ("Licensed under the MIT License (see LICENSE)", "MIT"),
        ("Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", "Apache-2.0 MIT"),
        ("The code is available under GPL version 2 or later.", "GPL-2.0-or-later"),
        ("Distributed under the GPLv3+.", "GPL-3.0-or-later"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        (LESSER, "LGPL-2.1-or-later"),
        (LESSER.replace(", or (at your option) any later version", ""), "LGPL-2.1-only"),
        (ASF, "Apache-2.0"),
        ("\n".join("# " + x for x in ASF.split("\n")), "Apache-2.0"),
        ("       GNU GENERAL PUBLIC LICENSE\n          Version 3, 29 June 2007\n\n Copyright", "GPL-3.0-only"),
        ("          Apache License\n       Version 2.0, January 2004\n    http://www.apache.org/licenses/", "Apache-2.0"),
        ("It was released under MIT supervision.", ""),
        ("The apache of the plains hid under a tree.", ""),
        ("Mit.", ""),
    ],
)
def test_licence_forms(text, expected):
    assert sorted(names(text)) == expected.split()


def test_no_shorter_licence_where_a_list_goes_on():
    grant, source, binary = (sentence(k) + "." for k in ("bsd.grant", "bsd.source", "bsd.binary"))
    others = {
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.": ["BSD-3-Clause"],
        "You must send the author a postcard.": [],
        sentence("bsd.advert") + ":\nThis product includes software of the University.\n4. " + sentence("bsd.names") + ".": ["BSD-4-Clause"],
    }
    for third, expected in others.items():
        for leader in ("", " * ", "# "):
            lines = [grant, "1. " + source, "2. " + binary, *("3. " + third).split("\n")]
            assert names("\n".join(leader + x for x in lines)) == expected, (leader, third)
    assert names("\n".join([grant, "* " + source, "* " + binary, "", "THIS SOFTWARE IS PROVIDED AS IS"])) == ["BSD-2-Clause"]


def test_licence_edges(messy):
    rows = licenses.scan_licenses(messy).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS) and not any(r["licenses"] for r in rows)
    assert licenses.scan_licenses(messy.limit(0)).count() == 0
