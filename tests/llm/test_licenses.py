import random

from common import odd_docs, rows

from ripplemark.llm import licenses


def edited(text, k, rng):
    for _ in range(k):
        i = rng.randrange(1, len(text) - 1)
        text = rng.choice((text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]))
    return text


def test_seeds_lose_nothing():
    rng = random.Random(2)
    scanner = licenses.Scanner()
    pad = "and erin thele of whan insht " * 8
    for name, notice in licenses.NOTICES.items():
        k = len(notice) // licenses.CHARS_AN_EDIT
        for _ in range(6):
            text = pad + edited(notice, rng.randint(0, k), rng) + " " + pad
            all_, found = scanner.scan_all(text), scanner.scan(text)
            assert name in {x[0] for x in found}
            assert {(x[0], x[1] // 40) for x in found} >= {(x[0], x[1] // 40) for x in all_}
            assert all(x[3] <= len(licenses.NOTICES[x[0]]) // licenses.CHARS_AN_EDIT for x in found)


def test_spans_and_edits():
    scanner = licenses.Scanner()
    text = "Ünder İstanbul: RELEASED under the MlT License. Released under the MIT License"
    (a, b) = [x for x in scanner.scan(text) if x[0] == "mit"]
    assert text[a[1] : a[2]] == "RELEASED under the MlT License" and a[3] == 1
    assert text[b[1] : b[2]] == "Released under the MIT License" and b[3] == 0


def test_wrapped_and_commented_notices():
    scanner = licenses.Scanner()
    for text in (
        "/*\n * Licensed under the Apache\n *     License, Version 2.0\n */", "# Licensed under the\r\n# Apache License, Version 2.0 (the", "// Licensed   under\tthe Apache License,\n//\n// Version 2.0.",
        "a\n\n\n;; Licensed under the Apache License, \n;; Version 2.0", "x \n> Licensed under\n> the Apache\n> License, Version 2.0",
    ):
        (found,) = scanner.scan(text)
        assert found == scanner.scan_all(text)[0] and found[0] == "apache-2.0" and found[3] == 0
        assert text[found[1] : found[2]].startswith("Licensed") and text[found[1] : found[2]].endswith("Version 2.0")
    flat = licenses.Flat("  A\t\tb  \n# c d\n")
    assert flat.text == " a b c d "
    assert [flat.span(i, i + 1) for i in (1, 3, 5, 7)] == [(2, 3), (5, 6), (11, 12), (13, 14)]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scanner = licenses.Scanner()
    want = sorted(((r["doc_id"], *x) for r in docs.collect() for x in scanner.scan_all(r["text"])), key=repr)
    assert rows(licenses.scan_licenses(docs).drop("span")) == want


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert rows(licenses.scan_licenses(docs)) == []
    notice = licenses.NOTICES["mit"]
    two = docs.selectExpr("doc_id", f"concat(text, ' {notice}') as text", "__n as `start`", "__n as span")
    got = licenses.scan_licenses(two)
    assert got.columns == ["doc_id", "notice", "start", "end", "edits", "span"]
    assert got.count() == docs.where("text is not null").count()
    assert {r["span"] for r in got.collect()} == {notice}
    assert rows(licenses.scan_licenses(docs.limit(0))) == []


def test_other_versions_and_variants_have_their_own_name():
    scanner = licenses.Scanner()
    for text, name in (
        ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"), ("Licensed under CC BY-ND 4.0", "cc-by-nd-4.0"), ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"), ("Licensed under CC BY-NC 3.0", "cc-by-nc-3.0"),
        ("licensed under the GNU General Public License, version 2", "gpl-2.0"), ("licensed under the GNU General Public Licence, version 3", "gpl-3.0"),
        ("Licensed under the Apache License, Version 1.1", "apache-1.1"), ("Licenced under the Apache License, Version 2.0", "apache-2.0"), ("subject to the terms of the Mozilla Public License, v. 1.1", "mpl-1.1"),
    ):
        for around in (text, f"Some words. {text}. {licenses.NOTICES['mit']}"):
            found = {x[0] for x in scanner.scan(around)} - {"mit"}
            assert found == {name} == {x[0] for x in scanner.scan_all(around)} - {"mit"}
