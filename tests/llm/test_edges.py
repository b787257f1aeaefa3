"""Nulls, blanks, long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, packed
from tidemark.llm.decontamination import find_contamination
from tidemark.llm.language import fit_languages, identify_languages
from tidemark.llm.licenses import RULES, TEXTS, known, scan_licenses
from tidemark.llm.mixing import inverse_demand, mix_sources, source_targets
from tidemark.llm.pii import GENERATORS, Trees, find_pii, fit_trees, redact, span_text
from tidemark.llm.repeats import intervals, remove_repeated_bytes
from tidemark.llm.simhash import drop_near_duplicates, simhash_groups
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.template import Const, Print, Template, TemplateError, fold, parse
from tidemark.llm.topk import top_k

LONG = " ".join(f"w{k}" for k in range(40_000))
PASSAGE = " ".join(f"p{k}" for k in range(30))
CLASHING = "size long, fp string, fingerprint int, component_id string, lang_pred int, score string, spans int, base_spans int, taken string, target int, n_words string, items int, hash int, of int, `a.b` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (None, "no id here", "en", "s"),
        (1, None, "en", None),
        (2, "", None, "s"),
        (3, " \t\n ", "en", None),
        (4, "one", "en", "s"),
        (5, LONG, "en", "big"),
        (6, f"first {PASSAGE}", "de", "s"),
        (7, f"{PASSAGE} second {PASSAGE}", "de", "t"),
        (8, "one", "fr", "t"),
        (8, "one", "fr", "t"),
        (9, "123 !! 456", None, ""),
        (10, LONG, "en", "big"),
        (11, "write a.b@c.de or +1 (234) 555-6789, 💓 4111 1111 1111 1111 at 10.0.0.256 and 10.0.0.255", "en", "s"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.select("*", *[F.lit(None).cast(kind).alias(name.strip("`")) for name, kind in (c.strip().rsplit(" ", 1) for c in CLASHING.split(","))])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def by_id(frame, *columns):
    return sorted(((r["doc_id"] if "doc_id" in frame.columns else r["id"], *(r[c] for c in columns)) for r in frame.collect()), key=str)


def test_languages(docs, empty):
    model = fit_languages(docs)
    assert model.languages == ("en", "de", "fr")
    rows = identify_languages(docs, model, min_margin=0.01).collect()
    assert len(rows) == 13 and rows[0]["a.b"] is None
    for r in rows:
        told = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] in model.languages) == told and 0 <= r["score"] <= 1
        assert told or (r["lang_pred"], r["score"], r["lang_rejected"]) == ("und", 0.0, True)
    none = fit_languages(empty)
    assert none.languages == () and {r["lang_pred"] for r in identify_languages(docs, none).collect()} == {"und"}
    assert identify_languages(empty, model).count() == 0
    single = fit_languages(docs.filter("lang = 'fr'"))
    assert {r["score"] for r in identify_languages(docs.filter("doc_id = 4"), single).collect()} == {1.0}


def test_conversations(spark):
    turns = [(1, 2, "user", "b"), (1, 1, "assistant", None), (1, None, None, "a[/INST]\\"), (1, 2, "user", "b"), (None, 1, "assistant", "x</s>\n"), (2, 1, "[INST] odd [/INST]", "")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    order = {1: [("", "a[/INST]\\"), ("assistant", ""), ("user", "b"), ("user", "b")], None: [("assistant", "x</s>\n")], 2: [("[INST] odd [/INST]", "")]}
    for conv, said in order.items():
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert got[conv]["n_turns"] == len(said)
    assert got[None]["loss_chars"] == 6 and got[1]["loss_chars"] == 0
    small = {r["conv_id"]: r.asDict() for r in chat.read_back(chat.format_conversations(frame, piece=3)).collect()}
    assert small == {k: v.asDict() for k, v in got.items()}
    assert chat.format_conversations(frame.filter("false")).count() == 0


def test_templates():
    def render(source, **env):
        return "".join(t for t, _ in Template(source).compiled()(env))

    assert render("{% for m in xs %}{{ loop.index }}{{ m.a|upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": "x"}, {"a": None}]) == "1X, 2"
    assert render("{% set a = 1 + 2 * 3 %}{{ a }}{{ 'x' ~ none ~ true }}{{ missing.name }}") == "7xtrue"
    assert render("{% if a == 1 %}one{% elif a in 'bc' %}in{% else %}no{% endif %}", a="c") == "in"
    assert fold(parse("a{{ 'b' ~ 1 }}{% if 1 > 2 %}x{% else %}c{% endif %}"), {}) == (Print(Const("ab1c")),)
    assert [m for _, m in Template("a{% generation %}b{% endgeneration %}c").compiled()({})] == [False, True, False]
    for wrong in ("{% for x %}", "{% endif %}", "{{ }}", "{% if a %}", "{{ a b }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ ''.__class__ |x }}"):
        with pytest.raises(TemplateError):
            Template(wrong).compiled()
    assert render("{{ a.__class__ }}", a="text") == ""
    with pytest.raises(TemplateError):
        render("{{ 'x' * 9 }}")
    # texts are gathered in a variable turn by turn, but not doubled
    turns = [{"text": "x" * 1000}] * 300
    gathered = "{% set a = '' %}{% for m in messages %}{% set a = a ~ m.text %}{% if loop.last %}{{ a }}{% endif %}{% endfor %}"
    assert len(render(gathered, messages=turns)) == 300_000
    for doubled in ("{% set a = a ~ a %}", "{% set b = a ~ a %}{% set a = b %}", "{% set a = a ~ b %}{% set b = b ~ a %}"):
        with pytest.raises(TemplateError, match="grows too fast"):
            render("{% for m in messages %}" + doubled + "{% endfor %}", a="xy", b="z", messages=turns)
    t = Template("", ("<s>", "aa"))
    for text in ("<s>", "\\<s>", "aaa", "\\", "<\\s>", ""):
        assert t.unescape(t.escape(text)) == text and not any(c in t.escape(text) for c in t.controls)


def test_simhash(docs, empty):
    got = by_id(simhash_groups(docs.select("doc_id", "text", "size")), "component_id", "fingerprint")
    assert {r[1] for r in got if r[0] in (1, 2, 3)} == {1} and {r[2] for r in got if r[0] in (1, 2, 3)} == {"0" * 16}
    assert {r[1] for r in got if r[0] in (4, 8)} == {4} and {r[1] for r in got if r[0] in (5, 10)} == {5}
    assert len(got) == 13 and [r[1] for r in got if r[0] is None] == [None]
    assert simhash_groups(empty).count() == 0 and len(simhash_groups(docs).columns) == 18 and simhash_groups(docs).columns[-2:] == ["fingerprint", "component_id"]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({r[1] for r in got if r[1] is not None})
    again = docs.unionByName(docs)
    assert drop_near_duplicates(again).count() == kept.count() and drop_near_duplicates(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = mix_sources(docs.select("doc_id", "text", "source", "size", "target")).collect()
    assert len(rows) == 13 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = {}
    for r in rows:
        taken.setdefault((r["source"], r["target"], r["source_size"]), []).append(r["taken"])
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
    for (_, target, size), own in taken.items():
        assert target - 1 < sum(own) <= target <= 2 * size
    assert sum(t for _, t, _ in taken) == pytest.approx(1.5 * sum(s for *_, s in taken))
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs.repartition(5).select("doc_id", "text", "source", "size", "target")).collect()))
    assert mix_sources(empty).count() == 0
    for sizes in ([10, 10, 10], [1, 100, 1000, 5], [0, 0, 7], [5]):
        frame = spark.createDataFrame([(f"s{k}", v) for k, v in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(frame).collect()}
        weights = {f"s{k}": (3, 1, 2)[k % 3] for k in range(len(sizes))}
        limit = {f"s{k}": 2.0 * v for k, v in enumerate(sizes)}
        expected, left, open_ = {}, 1.5 * sum(sizes), set(weights)
        while True:
            part = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
            over = {s for s in open_ if part[s] > limit[s]}
            if not over:
                break
            expected |= {s: limit[s] for s in over}
            left -= sum(limit[s] for s in over)
            open_ -= over
        assert got == pytest.approx(expected | part)
    times = spark.range(11).select(inverse_demand(F.col("id") / 10, ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5))).alias("t")).collect()
    assert [r["t"] for r in times] == sorted(r["t"] for r in times) and (times[0]["t"], times[-1]["t"]) == (0.0, 1.0)


def test_substrings(docs, empty):
    got = by_id(remove_repeats(docs), "n_words", "n_removed", "kept")
    assert len(got) == 13
    rows = {r[0]: r[1:] for r in got}
    assert rows[1] == rows[2] == rows[3] == (0, 0, "") and rows[8] == (1, 0, "one")
    assert rows[5][1] == 0 and rows[10] == (40_000, 40_000, "")
    assert rows[6] == (31, 0, f"first {PASSAGE}") and rows[7] == (61, 60, "second")
    assert rows[None] == (3, 0, "no id here")
    assert remove_repeats(empty).count() == 0


def test_repeated_bytes(docs, empty):
    rows = {r[0]: r[1:] for r in by_id(remove_repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept")}
    assert rows[1] == rows[2] == (0, 0, 0, b"") and rows[5][1:] == rows[10][1:] == (len(LONG), 1, b"")
    assert rows[7][3] == b"second" or rows[7][1] == 0  # shorter than a window
    assert rows[None][3] == b"no id here"
    assert remove_repeated_bytes(empty).count() == 0
    assert sorted(intervals([3, 1, 2, 2])) == [(1, 0, 4), (2, 2, 4), (3, 0, 1)]
    assert list(intervals([])) == [] and list(intervals([0, 5])) == [(5, 1, 2)]
    values = __import__("numpy").array([0, 3, 70_000, 70_001])
    assert packed.from_planes(packed.planes(values)).tolist() == values.tolist()


def test_the_largest_id_is_not_null(spark):
    frame = spark.createDataFrame([((1 << 63) - 1, "a b"), (None, "c"), (-(1 << 63), "d")], "doc_id long, text string")
    for found in (remove_repeats(frame), remove_repeated_bytes(frame)):
        assert {(r["id"], bytes(r["kept"], "utf-8") if isinstance(r["kept"], str) else bytes(r["kept"])) for r in found.collect()} == {((1 << 63) - 1, b"a b"), (None, b"c"), (-(1 << 63), b"d")}


def test_queries_of_one_id_have_one_ranking(spark):
    frame = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in top_k(frame, frame.filter("vec_id = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 131072), (0, 2, 1, 65536), (0, 3, 2, -65536)]


def test_top_k(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [-1.0]), (50, [-0.5, 0.25, 0.1]), (1, [0.5, 0.5]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1))
    got = [tuple(r) for r in top_k(frame, frame.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 7, 0), (0, 4, 50, -8192), (0, 5, 8, -32768), (50, 1, 8, 32768), (50, 2, 7, 0), (50, 3, 0, -8192), (50, 4, 1, -8192), (50, 5, 2, -8192)]
    assert top_k(frame.filter("vec_id = 0"), frame.filter("vec_id = 0")).count() == 0
    assert top_k(frame.filter("false"), frame).count() == 0 and top_k(frame, frame.filter("false")).count() == 0


def test_decontamination(spark, docs, empty):
    long_item = " ".join(f"P{k}," for k in range(3, 20))
    bench = spark.createDataFrame([(1, long_item), (2, "ONE"), (3, None), (4, "..."), (None, "one"), (10, "not there at all"), (2, "here")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in find_contamination(docs, bench).collect()}
    assert (rows[7]["n_hit"], rows[7]["items"], rows[7]["contaminated"]) == (34, ["1"], True)
    assert (rows[6]["n_words"], rows[6]["n_hit"]) == (31, 17) and rows[8]["items"] == ["2"] and rows[None]["items"] == ["2"]
    assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["contaminated"]) == (0, 0, False) and rows[5]["n_hit"] == 0
    parts = {r["doc_id"]: r.asDict() for r in find_contamination(docs, bench, task_bytes=100).collect()}
    assert parts == {k: v.asDict() for k, v in rows.items()}
    assert find_contamination(empty, bench).count() == 0
    assert {r["n_hit"] for r in find_contamination(docs, bench.filter("false")).collect()} == {0}


def test_personal_data(spark, docs, empty):
    trees = fit_trees(docs)
    assert trees.trees == ()  # too little to learn from
    text = docs.filter("doc_id = 11").first()["text"]
    row = find_pii(docs, trees).filter("doc_id = 11").select(span_text(F.col("spans")).alias("s")).first()["s"]
    found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in row.split(","))]
    assert found == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (234) 555-6789")]
    assert find_pii(docs, trees).filter("size(spans) = 0").count() == 12
    clean = {r["doc_id"]: r["text"] for r in redact(docs, trees).collect()}
    assert clean[11] == "write [EMAIL] or [PHONE], 💓 [CARD] at 10.0.0.256 and [IP]" and clean[1] is None and clean[5] == LONG
    assert redact(docs, trees).columns == docs.columns and redact(empty, trees).count() == 0 and fit_trees(empty) == Trees()
    # a candidate that the trees choose is added, one that touches a base span is not
    every = Trees((1.0,), (1.0,), dict.fromkeys(GENERATORS, 0.5))
    added = find_pii(docs, every).filter("doc_id = 11").select(span_text(F.col("spans")).alias("s")).first()["s"]
    assert set(row.split(",")) < set(added.split(",")) and f"ip:{text.index('10.0.0.256')}" in added
    runs = "a." * 100_000 + " " + "1 " * 50_000 + "9" * 100_000
    assert find_pii(spark.createDataFrame([(1, runs)], "doc_id long, text string"), every).count() == 1


def test_licenses(spark, docs, empty):
    mit = ". ".join(TEXTS[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is")) + "."
    texts = {
        1: f"MIT License\n\nCopyright (c) 2020 A\n\n{mit}".replace("files (the", "files\n(the"),
        2: "some words\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public Licence, version 3!",
        3: "text.***\nReleased under the MIT License.",
        4: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
        5: "we licensed under no circumstances the mit license",
        6: "SPDX-License-Identifier: Apache-2.0\n" + "x " * 50_000,
        7: None,
        8: "!" * 100_000,
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("licenses", F.lit(1)).withColumn("a.b", F.lit(2))
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["n_unmatched"]) for r in scan_licenses(frame).collect()}
    assert got[1] == (["mit-grant", "mit-notice", "mit-as-is"], ["MIT"], 0)
    assert got[2] == (["ref-cc-by-nc-4.0", "ref-gpl-3.0"], ["GPL-3.0", "CC-BY-NC-4.0"], 0)
    assert got[3] == (["ref-mit"], ["MIT"], 0) and got[4] == (["apache-obtain"], [], 1)
    assert got[6] == (["ref-apache-2.0"], ["Apache-2.0"], 0)
    assert got[5] == got[7] == got[8] == ([], [], 0)
    assert scan_licenses(docs).count() == 13 and scan_licenses(empty).count() == 0
    assert {i for _, run in RULES for i in run} <= set(known().values())


def test_licenses_of_real_headers(spark):
    gnu = "/* This {what} is free software{mark} you can redistribute it and/or modify\n * it under the terms of the GNU {name} as published by\n * the Free Software Foundation{version}.\n *\n * This {what} is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY. */\n"
    later = "either version {} of the License, or\n * (at your option) any later version"
    gpl, lesser, affero = "General Public License", "Lesser General Public License", "Affero General Public License"
    made = lambda mark, name, version, what="program": gnu.format(what=what, mark=mark, name=name, version=version)
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. {}. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/{}/. */\n"
    texts = {
        "MPL-2.0": mpl.format("2.0", "2.0"),
        "MPL": mpl.format("9.0", "9.0"),
        "GPL-2.0-or-later": made(";", gpl, "; " + later.format(2)),
        "GPL-3.0-or-later": made(";", gpl, "; " + later.format(3)),
        "GPL-3.0-or-later ": made(":", gpl, ", " + later.format(3)),
        "GPL-2.0-or-later ": made(";", gpl, "; either version 2, or (at your option)\n * any later version"),
        "GPL-2.0-only": made(";", gpl, "; version 2 of the License"),
        "GPL-2.0-only ": made(";", gpl + " version 2", ""),
        "GPL": made(";", gpl, ""),
        "LGPL-2.1-or-later": made(";", lesser, "; " + later.format("2.1"), "library"),
        "LGPL-3.0-or-later": made(":", lesser, ", " + later.format(3)),
        "LGPL-2.0-or-later": made(";", "Library General Public License", "; " + later.format(2), "library"),
        "LGPL-2.1-only": made(";", lesser, "; version 2.1 of the License", "library"),
        "AGPL-3.0-or-later": made(":", affero, ", " + later.format(3)),
        "AGPL-3.0-or-later ": made(";", affero, "; " + later.format(3)),
        "AGPL-3.0-or-later  ": made(":", affero, "; " + later.format(3)),
    }
    rows = scan_licenses(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()
    assert {r["name"]: (r["licenses"], r["n_unmatched"]) for r in rows} == {n: ([n.strip()], 0) for n in texts}


def test_license_expressions(spark):
    texts = {
        "GPL-2.0+": ["GPL-2.0-or-later"],
        "LGPL-2.1+": ["LGPL-2.1-or-later"],
        "GPL-2.0-or-later": ["GPL-2.0-or-later"],
        "LGPL-2.1-or-later": ["LGPL-2.1-or-later"],
        "GPL-2.0": ["GPL-2.0"],
        "GPL-2.0-only": ["GPL-2.0"],
        "MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "(MIT AND BSD-3-Clause)": ["MIT", "BSD-3-Clause"],
        "Apache-2.0 WITH LLVM-exception": ["Apache-2.0", "LLVM-exception"],
        "GPL-2.0+ OR (LGPL-3.0+ AND Zlib)": ["GPL-2.0-or-later", "LGPL-3.0-or-later", "Zlib"],
        "BSL-1.0": ["BSL-1.0"],
        "Zlib": ["Zlib"],
        "Unlicense": ["Unlicense"],
        "mit": ["MIT"],
        "Nobody-Knows-9.9": [],
    }
    frame = spark.createDataFrame([(f"{mark} SPDX-License-Identifier: {e}{end}\ncode here", e, found) for e, found in texts.items() for mark, end in (("//", ""), ("/*", " */"), ("<!--", " -->"), ("#", "\r"))], "text string, expression string, expected array<string>")
    wrong = [(r["expression"], r["licenses"]) for r in scan_licenses(frame.withColumn("said", F.col("text"))).collect() if set(r["licenses"]) != set(r["expected"])]
    assert not wrong
    # two tags in a file, and what stands after a tag's line
    two = spark.createDataFrame([("/* SPDX-License-Identifier: MIT */\n# SPDX-License-Identifier: ISC\n\nReleased under the MIT License.",)], "text string")
    assert set(scan_licenses(two).first()["licenses"]) == {"MIT", "ISC"}


def test_holders_of_rights_may_have_any_name(spark):
    bsd = BODIES["BSD-3-Clause"]
    named = bsd.replace("the copyright holder nor the names of its", "Example Widgets nor the names of its").replace("BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "BY EXAMPLE WIDGETS AND FRIENDS")
    regents = bsd.replace("the copyright holder nor the names of its", "the University nor the names of its").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS")
    rows = scan_licenses(spark.createDataFrame([(1, bsd), (2, named), (3, regents)], "k long, text string")).collect()
    assert {r["k"]: r["licenses"] for r in rows} == {1: ["BSD-3-Clause"], 2: ["BSD-3-Clause"], 3: ["BSD-3-Clause"]}


# How the texts of licences stand in files, shortened where nothing is recognised.
BODIES = {
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
""",
    "GPL-2.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

  0. This License applies to any program or other work which contains
a notice placed by the copyright holder saying it may be distributed
under the terms of this General Public License.  The "Program", below,

    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
""",
    "LGPL-2.1": """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999

  0. This License Agreement applies to any software library or other
program which contains a notice placed by the copyright holder or
other authorized party saying it may be distributed under the terms of
this Lesser General Public License (also called "this License").
Each licensee is addressed as "you".
""",
    "LGPL-3.0": """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

  This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.
""",
    "AGPL-3.0": """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007

  The GNU Affero General Public License is a free, copyleft license for
software and other kinds of works, specifically designed to ensure
cooperation with the community in the case of network server software.
""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
""",
    "MPL-2.0": """Mozilla Public License Version 2.0
==================================

2.1. Grants

Each Contributor hereby grants You a world-wide, royalty-free,
non-exclusive license:

(a) under intellectual property rights
""",
    "CC-BY-SA-4.0": """Creative Commons Attribution-ShareAlike 4.0 International Public
License

By exercising the Licensed Rights (defined below), You accept and agree
to be bound by the terms and conditions of this Creative Commons
Attribution-ShareAlike 4.0 International Public License ("Public
License"). To the extent this Public License may be interpreted
""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
""",
}


def test_texts_of_licences(spark):
    texts = {**BODIES, **{f"{n} ": f"// words before it\n\n{t}\nand after it\n" for n, t in BODIES.items()}}
    # a text whose title is lost is told by its sentence
    texts |= {f"{n}  ": t[t.index("\n\n") :] for n, t in BODIES.items() if n not in ("BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "Zlib")}
    rows = scan_licenses(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()
    assert {r["name"]: (r["licenses"], r["n_unmatched"]) for r in rows} == {n: ([n.strip()], 0) for n in texts}


def test_known_sentences_survive_the_cuts(spark, monkeypatch):
    monkeypatch.setitem(TEXTS, "mpl-form", ("This is subject to the Mozilla Public License, v. 2.0",))
    with pytest.raises(ValueError, match="cut within"):
        scan_licenses(spark.createDataFrame([], "doc_id long, text string"))


INTERNAL = "kept int, text_ int, id int, hash long, fp long, of long, head long, head_hash long, n int, __n int, __text_hash long, __head int, __hash int, __ids int, __text int, __over int, __within int, __c int, __chosen int, __row int, over string, within string, ids string, chosen string, root int, component int, found_in int, places int, `x.y` int"


def test_extra_columns_of_any_name_stay(spark):
    names = [c.strip().rsplit(" ", 1) for c in INTERNAL.split(",")]
    plain = spark.createDataFrame([(1, "Released under the MIT License. a.b@c.de and words"), (2, "one two three four five")], "doc_id long, text string")
    frame = plain.select("*", *[F.lit(str(70 + k)).cast(kind).alias(name.strip("`")) for k, (name, kind) in enumerate(names)])
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    every = Trees((1.0,), (1.0,), dict.fromkeys(GENERATORS, 0.5))
    results = [
        drop_near_duplicates(frame.unionByName(frame.withColumn("__n", F.lit(78)))),
        simhash_groups(frame),
        scan_licenses(frame),
        find_pii(frame, every),
        redact(frame, every),
        identify_languages(frame, fit_languages(frame.withColumn("lang", F.lit("en")))),
        find_contamination(frame, bench),
        find_contamination(frame, bench, task_bytes=1),
    ]
    for out in results:
        rows = out.collect()
        assert len(rows) == 2 and {r["doc_id"] for r in rows} == {1, 2}
        for k, (name, kind) in enumerate(names):
            if name.strip("`") in ("fp",) and "fp" not in out.columns:
                continue
            assert {str(r[name.strip("`")]) for r in rows} <= {str(70 + k)} or name == "__n"


def test_large_components_are_not_clipped(spark):
    vectors = {1: [1e7, 0.0], 2: [1.5e7, 0.0], 3: [-2e7, 1.0], 4: [1e9, -1e12], 5: [2e16, 0.0], 6: [-2e16, 0.0], 10: [1 / 256, 0.0], 20: [-1 / 256, 0.0]}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    q = {i: [int(256 * x) for x in v] for i, v in vectors.items()}
    expected = set()
    for a in (10, 20):
        best = sorted((-sum(x * y for x, y in zip(q[a], v, strict=True)), i) for i, v in q.items() if i != a)
        expected |= {(a, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    got = {tuple(r) for r in top_k(frame, frame.filter("vec_id IN (10, 20)"), 10).collect()}
    assert got == expected
    huge = spark.createDataFrame([(1, [1e10]), (2, [1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        top_k(huge, huge).collect()
