import re

from pyspark.sql import functions as F

from tallgram.llm import licenses as L

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pairs(text):
    w = WORD.findall(text.translate(UPPER))
    return set(zip(w, w[1:]))


def brute(text, threshold=0.9):
    best = {}
    if text:
        units = [text, *re.split(r"\n[\x00-\x20]*\n", text), *text.split("\n")]
        for name, template in L.TEMPLATES:
            b = pairs(template)
            for a in map(pairs, units):
                if a and b and 2 * len(a & b) >= threshold * (len(a) + len(b)):
                    best[name] = max(best.get(name, 0), 2 * len(a & b) / (len(a) + len(b)))
    return best


MIT = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 500)
APACHE = next(t for n, t in L.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
TEXTS = [
    "Released under the MIT License.", "Some prose.\nreleased UNDER the mit license\nMore prose of the text.", MIT, MIT.replace("copies", "copy"),
    "Title\n\n" + MIT + "\n \n" + "prose " * 30 + "\n\n" + APACHE, "All rights reserved", "all rights are reserved by the owner of the rights", None, "", "\n\n \n", "word",
    "under the License " * 500, "Licensed under CC BY-NC 4.0.\r\nLicensed under CC BY-SA 4.0.", "ü" * 40_000 + "\n" + "a b " * 20_000 + "\nAll rights reserved.",
    APACHE.replace(". ", ".\n"), "the software is provided as is\n" * 5,
]


def test_against_brute_force(docs):
    got = {r.doc_id: {x.license: x.similarity for x in r.licenses} for r in L.with_licenses(docs(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        expected = brute(text)
        assert got[i].keys() == expected.keys(), text
        assert all(abs(got[i][k] - v) < 1e-12 for k, v in expected.items())


def test_units_and_places(docs):
    rows = {r.doc_id: {x.license: (x.unit, x.place) for x in r.licenses} for r in L.with_licenses(docs(TEXTS)).collect()}
    assert rows[0] == {"MIT": ("text", 0)}
    assert rows[1] == {"MIT": ("line", 1)}
    assert rows[4] == {"MIT": ("paragraph", 1), "Apache-2.0": ("paragraph", 3)}


def test_edges(docs):
    df = docs([(1, MIT), (1, MIT), (None, MIT)]).withColumn("licenses", F.lit("x")).withColumn("license", F.lit(1))
    out = L.with_licenses(df)
    assert out.columns == df.columns
    assert [[x.license for x in r.licenses] for r in out.collect()] == [["MIT"]] * 3
    assert L.with_licenses(df.limit(0)).count() == 0
    assert [list(r.licenses) for r in L.with_licenses(df, templates=[]).collect()] == [[]] * 3
    assert [list(r.licenses) for r in L.with_licenses(df, templates=[("one", "word"), ("none", "")]).collect()] == [[]] * 3


def brute_run(text, template, threshold=0.9):
    """Best similarity of any run of consecutive words."""
    w, b = WORD.findall(text.translate(UPPER)), pairs(template)
    best = 0
    for i in range(len(w)):
        a = set()
        for j in range(i + 1, len(w)):
            a.add((w[j - 1], w[j]))
            best = max(best, 2 * len(a & b) / (len(a) + len(b)))
    return best if best >= threshold else None


def test_licences_in_their_usual_layout_inside_long_documents(docs):
    prose = " ".join(f"word{i} of the text" for i in range(400))
    texts = []
    for name, template in L.TEMPLATES:
        w = template.split()
        k = -(-len(w) // 3)
        texts.append(prose + "\n\nCopyright 2020 Foo Inc. " + "\n\n".join(" ".join(w[i : i + k]) for i in range(0, len(w), k)) + "\n\n" + prose)
    got = [{x.license: (x.similarity, x.unit) for x in r.licenses} for r in L.with_licenses(docs(texts)).orderBy("doc_id").collect()]
    assert [g.get(name) for g, (name, _) in zip(got, L.TEMPLATES)] == [(1.0, "run")] * len(texts)
    short = ["Copyright 2020 Foo Inc. All rights reserved.", "Released under the MIT License. See LICENSE for details."]
    got = [[(x.license, x.unit, x.place) for x in r.licenses] for r in L.with_licenses(docs(short)).orderBy("doc_id").collect()]
    assert got == [[("proprietary", "run", 4)], [("MIT", "run", 0)]]


def test_runs_against_brute_force(docs):
    import random

    rng = random.Random(2)
    words = "a b c d e f g h i j k l m n o p".split()
    templates = [(f"t{n}", " ".join(rng.choices(words, k=n))) for n in (2, 3, 8, 15, 30)]
    texts = []
    for _ in range(120):
        w = rng.choices(words + ["x", "y"], k=rng.randint(0, 20))
        for _ in range(rng.randint(1, 3)):
            part = rng.choice(templates)[1].split() * rng.randint(1, 2)
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = rng.choice(words)
            w += part + rng.choices(words, k=rng.randint(0, 12))
        texts.append("".join(x + rng.choice([" ", " ", "\n", "\n\n"]) for x in w))
    found = 0
    for r in L.with_licenses(docs(texts), templates=templates).collect():
        got = {x.license: x for x in r.licenses}
        for name, template in templates:
            best = brute_run(texts[r.doc_id], template)
            assert (name in got) == (best is not None)
            if best and got[name].unit == "run":
                found += 1
                assert abs(got[name].similarity - best) < 1e-12
    assert found > 50


def test_common_licences_with_their_full_texts(docs):
    full = {n for n, t in L.TEMPLATES if len(t.split()) > 150}
    assert full >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"}
    named = {}
    for n, t in L.TEMPLATES:
        if n in full and len(t) > len(named.get(n, "")):
            named[n] = t
    texts = [f"Foo {n}\n\nCopyright (c) 2020 Foo Inc.\n\n{t}\n\nsee the manual" for n, t in named.items()]
    rows = L.with_licenses(docs(texts)).orderBy("doc_id").collect()
    for n, r in zip(named, rows):
        best = max(x.similarity for x in r.licenses)
        assert n in {x.license for x in r.licenses if x.similarity == best}
    notice = "This library is free software; you can redistribute it under the terms of the GNU Affero General Public License"
    assert [list(r.licenses) for r in L.with_licenses(docs([notice])).collect()] == [[]]
    own = [*L.TEMPLATES, ("own", "the licence of the house")]
    assert [x.license for x in L.with_licenses(docs(["under the licence of the house"]), own).first().licenses] == ["own"]
