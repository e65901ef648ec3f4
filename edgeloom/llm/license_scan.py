"""License scans by sentence rules, in DataFrame functions only.

A known sentence is found where it lies between two bounds: line ends, and full stops, colons and semicolons before
white space. Within it, white space may be a line end, so that texts wrapped at any column count, but no bound of the
other kinds and no blank line; several in one place are tried from the longest. Texts are lower-cased, what isn't a
letter or digit becomes one space, and what comment signs (and the words rem and dnl) begin a line are left out.
Sentences of a table of known ones get its identifiers; the sequence of identifiers of a text is matched against
rules in their order, longer ones first.
Identifier lines (SPDX) are sentences too, one for each identifier that their expression holds.
A rule is a sequence of identifiers that must follow each other with no other known sentence between; what it
matches is used up, so that a licence whose sentences begin like another's isn't reported twice.

A map over rows: no shuffle, and no Python. Texts that hold none of ``ANCHORS``, of which every known sentence
has one, aren't cut.

Defined results: a null or empty text has no sentences and no licence; repeated rows give repeated rows; an
empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences named by identifier lines, and the names of those of Creative Commons.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 OFL-1.1 Unlicense WTFPL Zlib".split()
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# Sentences of well-known licences and notices, by identifier.
SENTENCES = {
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-title": ["Apache License", "Apache License Version 2.0", "Apache License Version 2.0, January 2004"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "This program is licensed under the GNU General Public License version 3"],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "gpl3-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-notice": ["Licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License, version 2.1"],
    "agpl-notice": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-notice": ["Licensed under the BSD License", "Released under the BSD License", "Licensed under the BSD 3-Clause License"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "Licensed under the Mozilla Public License, version 2.0"],
    "mpl-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "gpl-title": ["GNU General Public License"],
    "lgpl-title": ["GNU Lesser General Public License"],
    "agpl-title": ["GNU Affero General Public License"],
    "gnu-2": ["Version 2, June 1991"],
    "gnu-2.1": ["Version 2.1, February 1999"],
    "gnu-3": ["Version 3, 29 June 2007"],
    "agpl-3": ["Version 3, 19 November 2007"],
    "lgpl3-or-later": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl2-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "agpl-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0"],
    "epl-title": ["Eclipse Public License - v 2.0", "Eclipse Public License - v 1.0"],
    "epl-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0-notice": ["Licensed under CC0 1.0", "Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    **{f"cc-{kind.lower()}-notice": [f"Licensed under CC {kind} {v}" for v in ("2.0", "3.0", "4.0")] + [f"This work is licensed under CC {kind} 4.0"] for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"cc-{kind.lower()}-name": [f"This work is licensed under a Creative Commons {name} {v} International License" for v in ("4.0",)] + [f"Creative Commons {name} 4.0 International"] for kind, name in CREATIVE_COMMONS.items()},
    **{f"spdx-{name.lower()}": [f"SPDX License Identifier {name}"] for name in SPDX},
}

#: Licence and identifiers, longer rules first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("Apache-2.0", ["apache-notice", "apache-use", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl2-or-later"]),
    ("AGPL-3.0-or-later", ["agpl-or-later"]),
    ("GPL-3.0", ["gpl-title", "gnu-3"]),
    ("GPL-2.0", ["gpl-title", "gnu-2"]),
    ("LGPL-3.0", ["lgpl-title", "gnu-3"]),
    ("LGPL-2.1", ["lgpl-title", "gnu-2.1"]),
    ("AGPL-3.0", ["agpl-title", "agpl-3"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-title"]),
    ("AGPL-3.0", ["agpl-notice"]),
    ("LGPL", ["lgpl-notice"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("BSD", ["bsd-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("MPL-2.0", ["mpl-title"]),
    ("EPL", ["epl-title"]),
    ("EPL", ["epl-notice"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-notice"]),
    ("WTFPL", ["wtfpl"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-notice"]),
    *[(name, [f"spdx-{name.lower()}"]) for name in SPDX],
    *[(f"CC-{kind}", [f"cc-{kind.lower()}-name"]) for kind in CREATIVE_COMMONS],
    *[(f"CC-{kind}", [f"cc-{kind.lower()}-notice"]) for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
]

ANCHORS = "licen|permission|copyright|redistribution|software|warrant|except in compliance|cc0|creative commons|version [23]"
TAG = "spdx-license-identifier:"
BREAK = r"\n|(?<=[.:;])\s+"
#: What begins a line and doesn't count: signs, and the words that begin comments in batch files and m4.
PREFIX = r"(^|\n)[^\p{L}\p{N}\n]*+(?:(?:rem|dnl)(?=\s)[^\p{L}\p{N}\n]*+)?"


def normal(sentence: str) -> str:
    """What ``_normal`` makes of a sentence, for the table; the known ones are ASCII."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _normal(c: Column) -> Column:
    """Lower case; left are letters, digits, single spaces, single line ends, and [.:;] for the other bounds. An
    identifier line is a sentence for each identifier of its expression."""
    c = F.lower(c)
    parts = F.transform(F.split(c, "\n"), lambda x: F.when(x.contains(TAG), F.regexp_replace(F.regexp_replace(x, r"\s(?:or|and|with)\s|[()]", f"; {TAG} "), TAG + r"\s*", TAG.replace(":", " "))).otherwise(x))
    c = F.when(c.contains(TAG), F.array_join(parts, "\n")).otherwise(c)
    c = F.regexp_replace(c, PREFIX, "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"[.:;](?!\s)", " "), r"[^\p{L}\p{N}\n.:;]+", " ")
    return F.regexp_replace(c, r"\n[ \n]*\n", ".")


def sentence_pattern() -> str:
    """A bound and a known sentence, the group, before another bound."""
    sentences = sorted(known()[0], key=len, reverse=True)
    return r"(?:^|[.:;\n]) ?(%s)(?= ?(?:[.:;\n]|$))" % "|".join(s.replace(" ", r"(?: ?\n| )") for s in sentences)


#: The table as looked up: known sentences cut like texts are, each to identifier and part.
def known() -> tuple[dict[str, int], dict[str, list[list[int]]]]:
    """Numbers of normalised sentences; and for each identifier the number sequences that stand for it."""
    number: dict[str, int] = {}
    forms: dict[str, list[list[int]]] = {}
    for name, sentences in SENTENCES.items():
        for s in sentences:
            parts = [p for p in (normal(x) for x in re.split(BREAK, s)) if p]
            forms.setdefault(name, []).append([number.setdefault(p, len(number) + 1) for p in parts])
    return number, forms


def rule_patterns() -> list[tuple[str, str]]:
    """Licence, and what it looks like in a sequence such as ,3,7,8, with each number between commas."""
    _, forms = known()
    one = {name: "(?:%s)" % "|".join("".join(f"{n}," for n in f) for f in sorted(fs, key=len, reverse=True)) for name, fs in forms.items()}
    return [(licence, "(?<=,)" + "".join(one[name] for name in names)) for licence, names in RULES]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known (known sentences), licences (those found, in the order of the rules, joined by commas;
    empty if none)."""
    number, _ = known()
    table = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    text = df[text_col].cast("string")
    sentences = F.regexp_extract_all(_normal(text), F.lit(sentence_pattern()), F.lit(1))
    numbers = F.transform(sentences, lambda s: F.element_at(table, F.regexp_replace(s, r" ?\n", " ")))
    found = df.select(df[id_col].alias("doc_id"), F.when(text.rlike("(?i)" + ANCHORS), numbers).alias("numbers"))
    # As a sequence, the known sentences stand side by side whatever lies between them in the text.
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(p).alias("pattern")) for licence, p in rule_patterns()])
    start = F.struct(F.concat(F.lit(","), F.array_join(F.transform("numbers", lambda n: n.cast("string")), ","), F.lit(",")).alias("left"), F.lit("").alias("found"))
    step = lambda a, r: F.when(F.rlike(a["left"], r["pattern"]), F.struct(F.regexp_replace(a["left"], r["pattern"], F.lit("0,")).alias("left"), F.concat(a["found"], F.lit(","), r["licence"]).alias("found"))).otherwise(a)
    matched = F.when(F.size("numbers") > 0, F.array_join(F.array_distinct(F.filter(F.split(F.aggregate(rules, start, step)["found"], ","), lambda x: x != "")), ","))
    return found.select("doc_id", F.when(F.size("numbers") > 0, F.size("numbers")).otherwise(0).cast("long").alias("n_known"), F.coalesce(matched, F.lit("")).alias("licences"))
