"""Licence scans by sentence rules.

Texts are cut into sentences, sentences are normalised and mapped to known
licence-sentence identifiers, and the sequence of identifiers is matched
against licence rules in a fixed order: a rule takes its run of identifiers out of the
sequence, so a sentence counts for the most specific licence that it is part of.

A text is cut twice: at the ends of sentences and of paragraphs, for licence texts that
are wrapped over lines; and at the ends of lines too, for notices that stand on a
line of their own after text without a full stop.  What either cut shows counts.

All of it is column expressions on the row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import apart, as_one, quoted, without

# Short names of licences, with the names under which notices refer to them.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache-2.0"),
    "MIT": ("the MIT License", "MIT License", "the MIT license", "MIT"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "GPL-2.0", "GPL-2.0-only"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPL-3.0", "GPL-3.0-only"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPL-2.1-only"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPL-3.0-only"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0", "AGPL-3.0-only"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-clause BSD license", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-clause BSD license", "BSD-3-Clause"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "ISC": ("the ISC License", "ISC"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
}

# The forms of notices.
NOTICES = ("Licensed under {}", "This work is licensed under {}", "This file is licensed under {}", "Released under {}", "Distributed under {}", "SPDX-License-Identifier: {}")

# Short identifiers that stand after an SPDX tag besides those of ``NAMES``, in their own spelling.
SPDX = (
    *("0BSD", "AFL-3.0", "AGPL-1.0-or-later", "AGPL-3.0-or-later", "Apache-1.1", "Artistic-1.0", "Artistic-2.0", "BSD-1-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0"),
    *("CC-BY-3.0", "CC-BY-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2"),
    *("GPL-1.0-or-later", "GPL-2.0-or-later", "GPL-3.0-or-later", "HPND", "ICU", "JSON", "LGPL-2.0", "LGPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "LPPL-1.3c"),
    *("MIT-0", "MPL-1.1", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "SSPL-1.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1"),
    # what may stand after WITH
    *("Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception", "OpenSSL-exception", "Qt-LGPL-exception-1.1"),
)

#: The tag before a licence expression, and the sentence that stands for one identifier of it.
TAG = "SPDX-License-Identifier:"

# Where sentences name whoever holds the rights, after normalisation, and what stands there in the known ones.
HOLDERS = (
    (r"^neither the name of (?:the )?.{1,120}? nor the names of (?:its|the|their) contributors may", "neither the name of the copyright holder nor the names of its contributors may"),
    (r"^this software is provided by (?:the )?.{1,120}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
)

# Sentences of licence texts and headers.
TEXTS = {
    "apache-compliance": ('Licensed under the Apache License, Version 2.0 (the "License")', 'Licensed under the Apache License, Version 2.0 (the "License"), you may not use this file except in compliance with the License'),
    "apache-comply": ("you may not use this file except in compliance with the License",),
    "apache-obtain": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-as-is": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License",),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-as-is": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": tuple(f"Neither the name of the {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for who in ("copyright holder", "copyright holders", "copyright owner", "author")),
    "bsd-as-is": tuple(f'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {who} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED' for who in ("HOLDERS", "HOLDER", "OWNERS")),
    "gpl-warranty": ("but WITHOUT ANY WARRANTY", *(f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY" for what in ("program", "library", "file"))),
    "mpl-form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v.2.0",),
    "mpl-form-cut": ("This Source Code Form is subject to the terms of the Mozilla Public License, v",),
    "mpl-copy": tuple(f"If a copy of the MPL was not distributed with this file, You can obtain one at {at}mozilla.org/MPL/2.0/" for at in ("http://", "https://", "http://www.", "https://www.")),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-as-is": tuple(f'THE SOFTWARE IS PROVIDED "AS IS" AND {who} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS' for who in ("THE AUTHOR", "ISC")),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "public-domain": ("This is free and unencumbered software released into the public domain", "This work is in the public domain"),
    "all-rights": ("All rights reserved, no license is granted",),
}

# Licences of the Free Software Foundation, with the names in headers, and the versions that headers state.
FAMILIES = {
    "GPL": (("GNU General Public License",), ("2", "3")),
    "LGPL": (("GNU Lesser General Public License", "GNU Library General Public License"), ("2", "2.1", "3")),
    "AGPL": (("GNU Affero General Public License",), ("3",)),
}


# The titles that open the texts of long licences, and a sentence of each that no other has.
BODIES = {
    "GPL-2.0": (("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",), "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License"),
    "GPL-3.0": (("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",), "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    "LGPL-2.0": (("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",), 'This License Agreement applies to any software library which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Library General Public License (also called "this License")'),
    "LGPL-2.1": (("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",), 'This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Lesser General Public License (also called "this License")'),
    "LGPL-3.0": (("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",), "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    "AGPL-3.0": (("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",), "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    "Apache-2.0": (("Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"), "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    "MPL-2.0": (("Mozilla Public License Version 2.0", "Mozilla Public License, Version 2.0"), "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license"),
    "BSL-1.0": (("Boost Software License - Version 1.0 - August 17th, 2003",), 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    "Artistic-2.0": (("The Artistic License 2.0",), "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    "CC0-1.0": ((), 'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work")'),
}
# Creative Commons licences, by the part of the title that tells them apart.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _key, _what in COMMONS.items():
    _title = f"Creative Commons {_what} 4.0 International Public License"
    BODIES[f"CC-{_key}-4.0"] = ((_title,), f'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {_title} ("Public License")')


def _bodies() -> tuple[dict[str, tuple[str, ...]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences of the texts of ``BODIES``, and their rules; a text of the GNU licences ends with a header to copy, which belongs to it."""
    texts: dict[str, tuple[str, ...]] = {}
    rules = []
    for name, (titles, body) in BODIES.items():
        short = name.lower()
        texts[f"{short}-body"] = (body,)
        runs = [(f"{short}-body",)]
        if titles:
            texts[f"{short}-title"] = titles
            runs = [(f"{short}-title", f"{short}-body"), (f"{short}-title",), *runs]
        family, _, version = name.partition("-")
        if family in FAMILIES and name != "LGPL-3.0":
            v = version.removesuffix(".0")
            headers = ((f"{family.lower()}-terms", f"gpl{v}-version", "gpl-warranty"), (f"{family.lower()}{v}-or-later", "gpl-warranty"))
            runs = [(*runs[0], *header) for header in headers] + runs
        rules += [(name, run) for run in runs]
    return texts, rules


def _headers() -> tuple[dict[str, tuple[str, ...]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences of the headers of ``FAMILIES``, and their rules.

    After a semicolon the version is a sentence of its own, which says nothing of
    the licence; after a comma it is part of the sentence with the licence's name.
    """
    subjects = ("", *(f"This {what} is free software: " for what in ("program", "library", "file")))
    texts: dict[str, tuple[str, ...]] = {}
    rules, bare = [], []
    for family, (called, versions) in FAMILIES.items():
        short = family.lower()
        terms = f"{short}-terms"
        starts = [(f"{who}you can redistribute it and/or modify it under the terms of ", name) for who in subjects for name in called]
        end = " as published by the Free Software Foundation"
        texts[terms] = tuple(f"{start}the {name}{end}" for start, name in starts)
        for v in versions:
            later = (f"either version {v} of the License, or (at your option) any later version", f"either version {v}, or (at your option) any later version")
            only = f"version {v} of the License"
            texts[f"gpl{v}-version"], texts[f"gpl{v}-only-version"] = later, (only,)
            texts[f"{short}{v}-or-later"] = tuple(f"{start}the {name}{end}, {x}" for start, name in starts for x in later)
            texts[f"{short}{v}-only"] = tuple(x for start, name in starts for x in (f"{start}the {name}{end}, {only}", f"{start}version {v} of the {name}{end}", f"{start}the {name} version {v}{end}", f"{start}the {name}, version {v},{end}"))
            for kind, own in (("or-later", f"gpl{v}-version"), ("only", f"gpl{v}-only-version")):
                for run in ((terms, own), (f"{short}{v}-{kind}",)):
                    rules += [(f"{family}-{v if '.' in v else v + '.0'}-{kind}", x) for x in ((*run, "gpl-warranty"), run)]
        bare += [(family, (terms, "gpl-warranty")), (family, (terms,))]
    return texts, rules + bare


_HEADER_TEXTS, _HEADER_RULES = _headers()
_BODY_TEXTS, _BODY_RULES = _bodies()
TEXTS |= _HEADER_TEXTS | _BODY_TEXTS

# Rules in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("apache-compliance", "apache-comply", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-compliance", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-compliance",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant",)),
    *_BODY_RULES,
    *_HEADER_RULES,
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", ("mpl-form",)),
    ("MPL-2.0", ("mpl-form-cut", "mpl-copy")),
    ("MPL", ("mpl-form-cut",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("all-rights",)),
    *((name, (f"ref-{name.lower()}",)) for name in NAMES),
    *((name, (f"spdx-{name.lower()}",)) for name in SPDX),
)

#: A word of which each known sentence holds one; other sentences are not looked up.
GATE = "licens|copyright|warrant|redistribut|permission|public domain|released under|distributed under|any later version|copy of the mpl"

_WHITE = r"[\x20\t\n\r]"
_END = rf"[.!?;][^\p{{L}}\p{{N}}\x20\t\n\r]{{0,8}}{_WHITE}+|:{_WHITE}*\n{_WHITE}*"

#: Where a text is cut for sentences over lines, and for sentences within lines.
CUTS = (rf"{_END}|\n{_WHITE}*\n{_WHITE}*", rf"{_END}|{_WHITE}*\n{_WHITE}*")


#: A sentence with an SPDX tag up to the end of the tag, and an identifier after it.
TAGGED = r"(?is)^.*SPDX-Licen[sc]e-Identifier:"
IDENTIFIER = r"[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]\+?"


def normalized(sentence: str) -> str:
    """What ``_normal`` makes of a sentence, for the table of known ones."""
    out = " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).replace("licence", "license").split())
    for pattern, usual in HOLDERS:
        out = re.sub(pattern, usual, out)
    return out


def _spelled() -> list[tuple[str, str]]:
    """The known sentences with their identifiers."""
    out = [(s, key) for key, sentences in TEXTS.items() for s in sentences]
    out += [(form.format(c), f"ref-{name.lower()}") for name, called in NAMES.items() for form in NOTICES for c in called]
    # a plus sign after a version is read as "or later"
    spelled = [(name, f"ref-{name.lower()}") for name in NAMES] + [(name, f"spdx-{name.lower()}") for name in SPDX]
    return out + [(f"{TAG} {name}", key) for name, key in spelled]


def known() -> dict[str, str]:
    """Identifiers by normalised sentence."""
    return {normalized(s): key for s, key in _spelled()}


def unreachable() -> list[str]:
    """Known sentences that no cut leaves whole, so that they can't be found."""
    cuts = [re.compile(cut.replace(r"[^\p{L}\p{N}\x20\t\n\r]", r"(?:_|[^\w\x20\t\n\r])")) for cut in CUTS]
    return [s for s, _ in _spelled() if not any(normalized(s) in map(normalized, cut.split(s + ".\n")) for cut in cuts)]


def _normal(sentence: Column) -> Column:
    out = F.replace(F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " ")), F.lit("licence"), F.lit("license"))
    for pattern, usual in HOLDERS:
        out = F.when(out.rlike(pattern), F.regexp_replace(out, pattern, usual)).otherwise(out)
    return out


def _units(sentence: Column) -> Column:
    """The sentence, or, after an SPDX tag, a sentence for each identifier of the expression; the words between these are no identifiers and are not known."""
    names = F.regexp_extract_all(F.regexp_replace(sentence, TAGGED, ""), F.lit(IDENTIFIER), F.lit(0))
    each = F.transform(names, lambda n: F.concat(F.lit(f"{TAG} "), F.regexp_replace(n, r"\+$", "-or-later")))
    return F.when(sentence.rlike(TAGGED), each).otherwise(F.array(sentence))


def _identified(text: Column, cut: str, table: dict[str, str]) -> Column:
    """Identifiers of the known sentences in order, each in angle brackets."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    sentences = F.filter(F.transform(F.flatten(F.transform(F.split(text, cut, -1), _units)), _normal), lambda s: s.rlike(GATE))
    found = F.filter(F.transform(sentences, lambda s: F.try_element_at(names, s)), lambda i: i.isNotNull())
    return F.array_join(F.transform(found, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")


def _run(ids: Sequence[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with sentence_ids, licenses and n_unmatched.

    ``sentence_ids`` are the known sentences in order (of the cut that shows
    more; over lines, if both show as many).  ``licenses`` are the licences whose rules matched in either
    cut, in the order of ``RULES``, each once.  ``n_unmatched`` is the number of
    known sentences, in the cut of ``sentence_ids``, that no rule took.

    Null, blank and unlicensed texts have empty arrays and 0; texts are scanned
    as a whole.  Repeated rows get equal answers.  Input columns with the name
    of a computed one are dropped, all others stay whatever they are called.  An empty table gives no rows.
    """
    table = known()
    if strange := [s for s in table if not any(g in s for g in GATE.split("|"))]:
        raise ValueError(f"no gate word in {strange}")
    if lost := unreachable():
        raise ValueError(f"cut within {lost}")
    own = ("sentence_ids", "licenses", "n_unmatched")
    keep = without(docs, (*own, text_col))
    text = F.col("text")
    likely = text.rlike(f"(?i){GATE.replace('licens', 'licen[sc]').replace(' ', '[^a-z]+')}")
    rows = docs.select(as_one(keep), F.col(quoted(text_col)).alias("text"))
    rows = rows.select("kept", *[F.when(likely, _identified(text, cut, table)).otherwise("").alias(name) for name, cut in zip(("over", "within"), CUTS, strict=True)])

    def count(ids: Column) -> Column:
        return F.length(ids) - F.length(F.replace(ids, F.lit("<"), F.lit("")))

    rules = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_run(run)).alias("run")) for k, (_, run) in enumerate(RULES)])

    def matched(ids: Column) -> Column:
        """The places of the rules that match, and what is left."""

        def step(acc: Column, rule: Column) -> Column:
            held = F.contains(acc["rest"], rule["run"])
            left = F.struct(F.replace(acc["rest"], rule["run"], F.lit("")).alias("rest"), F.array_append(acc["at"], rule["k"]).alias("at"))
            return F.when(held, left).otherwise(acc)

        start = F.struct(ids.alias("rest"), F.array().cast("array<int>").alias("at"))
        return F.when(ids != "", F.aggregate(rules, start, step)).otherwise(start)

    rows = rows.withColumn("ids", F.when(count(F.col("within")) > count(F.col("over")), F.col("within")).otherwise(F.col("over")))
    over, within, own_ids = (matched(F.col(c)) for c in ("over", "within", "ids"))
    rest = own_ids["rest"]
    names = F.array(*[F.lit(name) for name, _ in RULES])
    found = F.array_distinct(F.transform(F.array_sort(F.array_union(over["at"], within["at"])), lambda k: F.get(names, k)))
    none = F.array().cast("array<string>")
    ids = F.filter(F.split(F.translate("ids", "<", ""), ">", -1), lambda i: i != "")
    some = F.col("ids") != ""
    found_columns = F.when(some, ids).otherwise(none), F.when(some, found).otherwise(none), F.when(some, count(rest)).otherwise(0).cast("long")
    return rows.select("kept", *[c.alias(n) for c, n in zip(found_columns, own, strict=True)]).select(*apart(keep), *own)
