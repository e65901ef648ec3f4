import re
import textwrap

import pytest

from edgeloom.llm import license_scan as ls

MIT = "\n".join(["The MIT License", "", "Copyright (c) 2020 Someone", "", *[s + "." for k in ("mit-grant", "mit-condition", "as-is") for s in ls.SENTENCES[k][:1]]])
BSD = "\n".join("* " + ls.SENTENCES[k][0] + "." for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))


def by_hand(text):
    """The rules in order over the list of identifiers, by plain list search."""
    number, forms = ls.known()
    seq = [number[n] for s in re.split(ls.BREAK, text or "") if (n := re.sub(r"[^\w]+|_", " ", s.lower()).strip()) in number]
    left, found = list(seq), []
    for licence, names in ls.RULES:
        options = [[]]
        for name in names:
            options = [o + f for o in options for f in forms[name]]
        at = 0
        hit = False
        while at < len(left):
            size = max((len(o) for o in options if left[at : at + len(o)] == o), default=0)
            if size:
                left[at : at + size] = [0]
                hit = True
            at += 1
        if hit and licence not in found:
            found.append(licence)
    return len(seq), ",".join(found)


TEXTS = [
    None,
    "",
    "nothing here",
    "Some prose.\nReleased under the MIT License.\nMore prose.",
    "LICENSED UNDER CC BY-NC 4.0. Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under the GNU General Public License, version 3. Licensed under the Apache License, Version 2.0.",
    MIT,
    MIT.replace("The MIT License\n", ""),
    BSD,
    BSD.rsplit("\n", 1)[0],
    BSD + "\n" + MIT + "\n" + BSD,
    "the software license of the permission " * 20_000,
    "license.\n" * 20_000,
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://x",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even",
]


def test_against_plain_search(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0), (None, MIT, 0)], "doc_id long, text string, numbers int")
    rows = ls.scan(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert (r.n_known, r.licences) == by_hand(MIT if r.doc_id is None else TEXTS[r.doc_id])
    got = {r.doc_id: r.licences for r in rows}
    assert got[3] == "MIT" and got[4] == "CC-BY-NC,CC-BY-NC-SA" and got[5] == "Apache-2.0,GPL-3.0" and got[6] == "MIT" and got[8] == "BSD-3-Clause"
    assert got[9] == "BSD-2-Clause" and got[10] == "BSD-3-Clause,MIT" and got[13] == "Apache-2.0" and got[14] == "GPL-2.0-or-later"
    assert ls.scan(df.limit(0)).count() == 0


def test_every_known_sentence_has_an_anchor():
    assert all(re.search(ls.ANCHORS, s) for s in ls.known()[0]), [s for s in ls.known()[0] if not re.search(ls.ANCHORS, s)]


def paragraphs(*names, title=(), mark=""):
    return [*title, *[f"{mark}{s}." for n in names for s in ls.SENTENCES[n][:1]]]


WRAPPED = {
    "MIT": ["Copyright (c) 2020 Someone", ls.SENTENCES["mit-grant"][0] + ":", *paragraphs("mit-condition", "as-is")],
    "BSD-2-Clause": [ls.SENTENCES["bsd-grant"][0] + ":", *paragraphs("bsd-source", "bsd-binary", mark="1. ")],
    "BSD-3-Clause": [ls.SENTENCES["bsd-grant"][0] + ":", *paragraphs("bsd-source", "bsd-binary", "bsd-names", mark="* ")],
    "ISC": paragraphs("isc-grant"),
    "GPL-2.0-or-later": [*paragraphs("gpl2-or-later"), "; ".join(ls.SENTENCES["gpl-warranty"]) + ".  See the GNU General Public License for more details."],
    "GPL-3.0-or-later": [*paragraphs("gpl3-or-later"), "; ".join(ls.SENTENCES["gpl-warranty"]) + ".  See the GNU General Public License for more details."],
    "Apache-2.0": [ls.SENTENCES["apache-notice"][1] + "; " + ls.SENTENCES["apache-use"][0] + ". " + ls.SENTENCES["apache-copy"][0], "http://www.apache.org/licenses/LICENSE-2.0"],
}


@pytest.mark.parametrize("width", [70, 80])
def test_wrapped_texts(spark, width):
    texts = []
    for licence, parts in WRAPPED.items():
        for mark in ("", "    ", " * ", "# ", "// ", ";; ", "-- ", "REM ", "dnl ", "\r"):
            end = "\r\n" if mark == "\r" else "\n"
            lines = "\n\n".join(textwrap.fill(p, width) for p in parts).split("\n")
            texts.append((licence, "/*" + end + end.join(mark.strip("\r") + x for x in lines) + end + "*/"))
            texts.append((licence, "int x;" + end + end.join(mark.strip("\r") + x for x in lines if x) + end + "int y;"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in ls.scan(df).collect()}
    assert [(texts[i], got[i]) for i in range(len(texts)) if got[i] != texts[i][0]] == []


def test_lines_blank_lines_and_long_runs(spark):
    texts = [
        ("Foo 1.0\nReleased under the MIT License\nby Someone", 1, "MIT"),
        ("# MIT License\n# Copyright (c) 2020\n", 1, "MIT"),
        ("                Apache License\n          Version 2.0, January 2004\n     http://www.apache.org/licenses/", 1, "Apache-2.0"),
        ("Permission to use,\n\ncopy, " + ls.SENTENCES["isc-grant"][0].split("copy, ", 1)[1], 0, ""),
        (ls.SENTENCES["isc-grant"][0].replace(" copy", ". copy", 1), 0, ""),
        ("license" + "-" * 100_000 + "\n" * 100_000 + " \n" * 100_000 + ". " * 100_000 + "\n; " * 100_000 + "MIT License", 1, "MIT"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_known, r.licences) for r in ls.scan(df).collect()}
    assert got == {i: (n, x) for i, (_, n, x) in enumerate(texts)}


def test_identifier_lines(spark):
    texts = [
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("/* spdx-license-identifier:   Apache-2.0 */", "Apache-2.0"),
        ("# SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) AND CC0-1.0", "BSD-3-Clause,CC0-1.0,GPL-2.0-only"),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\r\nSPDX-License-Identifier: ISC", "GPL-2.0-or-later,ISC"),
        ("SPDX-License-Identifier: NoSuch-1.0", ""),
        ("mit software license spdx mit", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in ls.scan(df).collect()}
    assert {i: ",".join(sorted(filter(None, x.split(",")))) for i, x in got.items()} == {i: x for i, (_, x) in enumerate(texts)}


#: Written out here, not taken from the operator's table.
FULL = {
    "MIT": """MIT License

Copyright (c) 2021 A. Person

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Copyright 2020 A. Person

Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "GPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.""",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 2.1, February 1999\n",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.",
}


def test_texts_as_they_are_published(spark):
    df = spark.createDataFrame([(k, t) for k, t in FULL.items()] + [("padded", "Released   under" + " " * 5000 + "the \t MIT" + " " * 900 + "License.")], "doc_id string, text string")
    got = {r.doc_id: r.licences for r in ls.scan(df).collect()}
    assert got == {**{k: k for k in FULL}, "padded": "MIT"}
