import random

from parlance.llm import licenses
from parlance.llm.licenses import TEMPLATES, align, prepare, tokens

WORDS = "ea the of thon ship and under license a version tion".split()


def names(spark, texts, **settings):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = licenses.scan(docs, **settings).orderBy("doc_id").collect()
    return [[(n["name"], round(n["coverage"], 3)) for n in r["notices"]] for r in rows]


def test_alignment_is_increasing_and_equal():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 30))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert align(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]
    assert align(list("abXcd"), list("abYcd")) == [(0, 0), (1, 1), (3, 3), (4, 4)]


def test_every_template_is_found_in_other_text(spark):
    rnd = random.Random(1)
    noise = lambda: " ".join(rnd.choice(WORDS[:6]) for _ in range(80))
    texts = [f"{noise()}\n{t}.\n{noise()}" for _, t in sorted(TEMPLATES.items())]
    assert names(spark, texts) == [[(n, 1.0)] for n in sorted(TEMPLATES)]


def test_changed_broken_and_repeated_notices(spark):
    mit = TEMPLATES["MIT"]
    got = names(spark, [mit.upper(), "Released*** under%%% the### MIT License", f"{mit}. {mit}.", "Released under the BSD License",
                        "the under the license", None, "", "MIT"])
    one = [("MIT", 1.0)]
    assert got == [one, one, one * 2, [("MIT", 0.8)], [], [], [], []]


def test_least_coverage_and_own_templates(spark):
    assert names(spark, ["Released under the BSD License"], least=0.9) == [[]]
    assert names(spark, ["of the a b c d e f of the"], templates={"common": "of the"}) == [[("common", 1.0)] * 2]
    assert names(spark, [], templates={"common": "of the"}) == []


def test_words_and_places(spark):
    docs = spark.createDataFrame([(1, "one two Released under the MIT License three")], "doc_id long, text string")
    notice = licenses.scan(docs).collect()[0]["notices"][0]
    assert (notice["first_word"], notice["end_word"]) == (2, 7)
    assert tokens("É-a B2") == ["É".encode(), b"a", b"b2"]
    assert all(t.telling for t in prepare(TEMPLATES))


def test_long_text(spark):
    assert names(spark, ["license " * 20_000 + TEMPLATES["MIT"]]) == [[("MIT", 1.0)]]


def test_marked_words_name_the_licence(spark):
    texts = {
        "Released under the BSD License": ["BSD"], "Released under the ISC License": ["ISC"], "Released under the XYZ License": [],
        "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
        "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
        "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"], "Licensed under CC BY 3.0": ["CC-BY-3.0"],
        "Licensed under the Mozilla Public License, version 2.0": ["MPL-2.0"], "Licensed under the Eclipse Public License, Version 2.0": ["EPL-2.0"],
        "Licensed under the GNU LGPL version 2.1": ["LGPL-2.1"], "Licensed under the Apache License, v2.0": ["Apache-2.0"],
        "Licensed under the terms of the MIT License": ["MIT"], "Released under the MIT or BSD License": ["BSD", "MIT"],
        "Released under the MIT License. Released under the ISC License.": ["ISC", "MIT"], "SPDX-License-Identifier: MPL-1.1": ["MPL-1.1"]}
    got = names(spark, list(texts), templates=licenses.NOTICES)
    assert [sorted(n for n, _ in found) for found in got] == list(texts.values())


def test_every_wording_is_its_own_licence():
    own = prepare(licenses.NOTICES)
    for name, wordings in licenses.NOTICES.items():
        for wording in wordings:
            found = licenses.matches(tokens(f"ea thon {wording}. ea thon"), own, 0.8)
            assert [n for _, _, n, _ in found] == [name], (wording, found)


def test_query_tells_licences_apart(spark, tmp_path):
    from parlance.llm.queries import QUERIES
    spark.createDataFrame([(1, "Released under the BSD License"), (2, TEMPLATES["MIT"])], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    rows = QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["names"] for r in rows} == {1: "BSD", 2: "MIT"}
