"""License scans by sentence rules.

Known licence sentences have identifiers. A text is normalised (lower case, letters and digits, one mark between words) and
searched for them: a sentence begins at the beginning of a line or behind the end of a sentence and ends likewise, and may be
wrapped over any number of lines with comment marks or list labels before them. The sequence of identifiers of a text is
matched against ordered rules: at each place of the sequence the first rule whose sentences follow one another there takes
them. Unknown sentences between them do not matter, known ones of another licence do.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import packed, table, unpacked

#: licence -> what prose calls it; one-line notices and SPDX tags are made from these
NAMES: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "AFL-3.0": ["Academic Free License, version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL 3.0"],
    "Apache-1.1": ["Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "BUSL-1.1": ["Business Source License 1.1"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal license"],
    "CDDL-1.0": ["Common Development and Distribution License, version 1.0", "CDDL 1.0"],
    "CPAL-1.0": ["Common Public Attribution License Version 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence v1.2", "EUPL 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL 3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"],
    "MIT": ["MIT License", "MIT/X11 license", "Expat License"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License v1.0", "Open Data Commons Open Database License v1.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "OSL-3.0": ["Open Software License version 3.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python Software Foundation License Version 2"],
    "SSPL-1.0": ["Server Side Public License, v1"],
    "Unlicense": ["Unlicense"],
    "UPL-1.0": ["Universal Permissive License v1.0"],
    "W3C": ["W3C Software License"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License, Version 2"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
#: Creative Commons: the marks and the words of each kind, and the versions with what follows them
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for _marks, _words in _CC.items():
    for _v, _of in _CC_VERSIONS.items():
        NAMES[f"CC-{_marks}-{_v}"] = [f"CC {_marks} {_v}", f"CC-{_marks}-{_v}", f"Creative Commons {_words} {_v} {_of} License", f"Creative Commons {_words} {_v} License"]
#: What a one-line notice begins with, before `under`, an article and a name.
OPENING = r"(?:this (?:work|project|software|program|file|library|package|code) is )?(?:licensed|released|distributed|available)"
ARTICLE = r"(?:(?:the|a) )?"

#: identifier -> wordings of the sentences of longer notices
SENTENCES: dict[str, list[str]] = {
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit0-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-warranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "apache2-grant": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache2-comply": ["you may not use this file except in compliance with the License."],
    "apache2-obtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "gnu-any-2": ["either version 2 of the License, or (at your option) any later version."],
    "gnu-any-2.1": ["either version 2.1 of the License, or (at your option) any later version."],
    "gnu-any-3": ["either version 3 of the License, or (at your option) any later version."],
    "gnu-only-2": ["version 2 of the License."],
    "gnu-only-3": ["version 3 of the License."],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "agpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation;"],
    "gpl2-free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "gpl-free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": [f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;" for x in ("program", "library", "software")],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "mpl2-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "epl1-terms": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "boost-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "wtfpl-copy": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "cc0-waive": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "ofl-terms": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "postgres-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "ncsa-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "python-grant": ["Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version"],
}

#: Rules in order: (licence, sequence of identifiers). Where several match at a place the first counts and takes its sentences.
RULES: list[tuple[str, list[str]]] = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("NCSA", ["ncsa-grant"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT-0", ["mit0-grant", "mit-warranty"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-obtain"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply"]),
    ("Apache-2.0", ["apache2-grant", "apache2-obtain"]),
    *[
        (licence, [terms, version, *warranty])
        for licence, terms, version in (("GPL-2.0", "gpl-terms", "gnu-any-2"), ("GPL-2.0", "gpl-terms", "gnu-only-2"), ("GPL-3.0", "gpl-terms", "gnu-any-3"), ("GPL-3.0", "gpl-terms", "gnu-only-3"), ("LGPL-2.1", "lgpl-terms", "gnu-any-2.1"), ("LGPL-3.0", "lgpl-terms", "gnu-any-3"), ("AGPL-3.0", "agpl-terms", "gnu-any-3"))
        for warranty in (["gpl-warranty", "gpl-implied"], ["gpl-warranty"])
    ],
    *[(licence, [terms, *warranty]) for licence, terms in (("GPL-2.0", "gpl2-free"), ("GPL-3.0", "gpl-free"), ("LGPL-2.1", "lgpl21-free"), ("LGPL-3.0", "lgpl3-free"), ("AGPL-3.0", "agpl3-free")) for warranty in (["gpl-warranty", "gpl-implied"], ["gpl-warranty"])],
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("CC0-1.0", ["cc0-waive"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("OFL-1.1", ["ofl-terms"]),
    ("PostgreSQL", ["postgres-grant"]),
    ("Python-2.0", ["python-grant"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl-copy"]),
    *[(licence, [f"{licence}-notice"]) for licence in NAMES],
]


def plain(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


BREAK = r"\n|[.:;!?]\s+"
#: This colon ends no sentence.
TAG = r"(?i)(spdx-license-identifier):"


def known() -> dict[str, str]:
    """Normalised sentence -> identifier. A wording with sentence ends in it is known by its longest part; one-line notices by `under` and the name."""
    found: dict[str, str] = {}

    def add(wording: str, name: str) -> None:
        longest = max((plain(x) for x in re.split(BREAK, re.sub(TAG, r"\1", wording) + " ")), key=len)
        if found.setdefault(longest, name) != name:
            raise ValueError(f"two sentences read {longest!r}")

    for name, wordings in SENTENCES.items():
        for w in wordings:
            add(w, name)
    for licence, names in NAMES.items():
        for tag in dict.fromkeys([licence, f"{licence}-only", f"{licence}-or-later"] if "GPL" in licence else [licence]):
            add(f"SPDX-License-Identifier: {tag}", f"{licence}-notice")
        for w in names:
            add(f"under {w}", f"{licence}-notice")
    return found


def _split(sentences: dict[str, str]) -> tuple[list[str], list[str]]:
    """The names of one-line notices, and the other sentences."""
    return [s[6:] for s in sentences if s.startswith("under ")], [s for s in sentences if not s.startswith("under ")]


def _trie(sentences: list[str]) -> str:
    """A pattern for any of the sentences with one blank or line break between words: words in common are tried once, longer sentences first."""
    root: dict = {}
    for s in sentences:
        node = root
        for w in s.split():
            node = node.setdefault(w, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        after = [w + pattern(node[w]) for w in sorted(node) if w]
        if not after:
            return ""
        return rf"(?:[ \n](?:{'|'.join(after)}))" + ("?" if "" in node else "")

    return "|".join(w + pattern(root[w]) for w in sorted(root) if w)


#: What may stand before the words of a line: comment marks and the label of a list item.
LEAD = r"(?m)^[ \t]*(?:(?:[^a-z0-9\s(]+|dnl|rem|c)[ \t]+)?(?:\(?[0-9a-z]{1,3}\)[ \t]+)?"
END = "\x01"


def _marked(text: Column) -> Column:
    """text in lower case with one mark between words: END behind a sentence, else a newline between lines, else a space."""
    steps = [(END, " "), (TAG, "$1"), (LEAD, ""), (r"[.:;!?]\s+", END), (rf"[^a-z0-9\n{END}]+", " "), (r" ?\n[ \n]*", "\n"), (rf"[ \n]?{END}[ \n{END}]*", END)]
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))), F.lit(" \n")))


def _ids(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of a text's sentences in order; where one sentence begins another, the longer one counts. Nothing is exploded."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(sentences.items()) for x in kv])
    names, others = _split(sentences)
    notice = f"{OPENING} under {ARTICLE}".replace(" ", r"[ \n]") + f"(?:{_trie(names)})"
    hits = F.regexp_extract_all(_marked(text), F.lit(rf"(?<=[\n{END}])(?:{_trie(others)}|{notice})(?=[\n{END}])"), F.lit(0))
    found = F.transform(hits, lambda s: F.translate(s, "\n", " "))
    return F.transform(found, lambda s: F.coalesce(F.try_element_at(pairs, s), F.try_element_at(pairs, F.regexp_replace(s, f"^{OPENING} under {ARTICLE}", "under "))))


#: Every known sentence has one of these words, so other texts need no cutting.
ANCHORS = ("licen", "permission", "warranty", "warranties", "redistribut", "copyright", "spdx", "public domain", "gpl", "under", "version", "copies", "permitted", "advertising")


def _sequence(ids: list[str]) -> str:
    return "".join(f";{k};" for k in ids)


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """docs with sentence_ids (array) and licenses (array in order of name; empty if none).

    Null and empty texts have neither. Each row is scanned for itself, so repeated rows get the same answer; an empty table
    gives an empty result. Rules are tried in order at each place of the sequence. Other columns come back as they are; one
    named as a column of the result with `_in` behind its name.
    """
    sentences, rules = sentences or known(), rules or RULES
    for s in sentences:
        if not any(a in s for a in ANCHORS) and not s.startswith("under "):
            raise ValueError(f"no anchor in {s!r}")
    likely = F.col("text").rlike("(?i)" + "|".join(a.replace(" ", r"[^a-z0-9]+(?:(?:dnl|rem|c|[0-9a-z]{1,3}\))[^a-z0-9]+)?") for a in ANCHORS))
    none = F.array().cast("array<string>")
    df = packed(docs, "text").withColumn("_ids", F.when(likely, _ids(F.col("text"), sentences)).otherwise(none))
    line = F.concat(F.lit(""), F.array_join(F.transform("_ids", lambda k: F.concat(F.lit(";"), k, F.lit(";"))), ""))
    licence = F.create_map(*[F.lit(x) for k, q in reversed(rules) for x in (_sequence(q), k)])
    hits = F.regexp_extract_all(line, F.lit("|".join(re.escape(_sequence(q)) for _, q in rules)), F.lit(0))
    df = df.withColumn("_licenses", F.when(F.size("_ids") > 0, F.sort_array(F.array_distinct(F.transform(hits, lambda q: F.try_element_at(licence, q))))).otherwise(none))
    return unpacked(df, docs.columns, ("text",), sentence_ids=F.col("_ids"), licenses=F.col("_licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    values = ", ".join(f"('{s}', '{k}')" for s, k in sorted(known().items()))
    rules = ", ".join(f"'{_sequence(q)}': '{k}'" for k, q in RULES)
    pattern = "|".join(re.escape(_sequence(q)) for _, q in RULES)
    return f"""
WITH known(s, k) AS (VALUES {values}),
cut AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '(?i)(spdx-license-identifier):', '\\1', 'g') || ' ', '\\n|[.:;!?]\\s+') AS p FROM documents),
each_ AS (SELECT doc_id, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS t FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM cut)),
ids AS (SELECT e.doc_id, count(*) AS n, string_agg(known.k, ',' ORDER BY e.i) AS ids, string_agg(';' || known.k || ';', '' ORDER BY e.i) AS line FROM each_ e JOIN known ON known.s IN (e.t, regexp_replace(e.t, '^{OPENING} under {ARTICLE}', 'under ')) AND NOT (starts_with(known.s, 'under ') AND e.t = known.s) GROUP BY e.doc_id),
lic AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(line, '{pattern}'), lambda q: MAP {{{rules}}}[q]))), ',') AS licenses FROM ids)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN ids ON ids.doc_id = d.doc_id LEFT JOIN lic ON lic.doc_id = d.doc_id
"""


SQL = _sql()
