"""Licence scans: known sentences become identifiers, and identifier sequences are matched against licence rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known licence sentences by identifier, and the rules as ordered identifiers.
SENTENCES = {
    1: "This work is licensed under the GNU General Public License, version 3",
    2: "Licensed under CC BY-NC 4.0",
    3: "All rights reserved",
    4: "Released under the MIT License",
    5: "Licensed under the Apache License, Version 2.0",
    6: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    7: "You may not use this file except in compliance with the License",
    8: "You may obtain a copy of the License at",
    9: "http://www.apache.org/licenses/LICENSE-2.0",
    10: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    12: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    13: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    14: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    15: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    16: "This program is free software",
    17: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    18: "either version 2 of the License, or (at your option) any later version",
    19: "either version 3 of the License, or (at your option) any later version",
    20: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    21: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    22: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    23: "Licensed under CC BY 4.0",
    24: "Licensed under CC BY-SA 4.0",
    25: "This work is dedicated to the public domain",
    26: "This is free and unencumbered software released into the public domain",
    27: "Licensed under the MIT License",
    28: "This work is licensed under the GNU General Public License, version 2",
    29: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    30: "SPDX-License-Identifier: MIT",
    31: "SPDX-License-Identifier: Apache-2.0",
    32: "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    33: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    34: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    35: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    36: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    37: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    38: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    39: "This library is free software",
    40: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    41: "either version 2.1 of the License, or (at your option) any later version",
    42: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    43: "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    44: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    45: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    46: "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation",
    47: "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    48: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    49: "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required",
    50: "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    51: "Distributed under the Boost Software License, Version 1.0",
    52: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    53: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    54: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    55: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    56: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    57: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    58: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    59: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers",
    60: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution",
    61: "Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder",
    62: "version 2 of the License",
    63: "version 3 of the License",
    64: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    65: "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    66: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    67: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    68: "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    69: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    71: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    72: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    73: "The author disclaims copyright to this source code",
    74: "In place of a legal notice, here is a blessing",
    75: "As long as you retain this notice you can do whatever you want with this stuff",
    76: "This software is provided 'as-is', without any express or implied warranty",
    77: "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    78: "This package is free software",
    79: "you can redistribute it and/or modify it under the same terms as Perl itself",
}
#: Other wordings of known sentences, by identifier.
WORDINGS = {
    9: ["https://www.apache.org/licenses/LICENSE-2.0"],
    11: ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    14: ["2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    15: ["Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    16: ["This file is free software"],
    61: ["Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium"],
    67: ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"],
}
#: Full names that stand behind "licensed under", without a final "license", by licence.
NAMES = {
    "0BSD": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agplv3", "agpl 3 0", "gnu agplv3"],
    "AGPL-3.0-or-later": ["gnu affero general public license version 3 or later", "agplv3 or later"],
    "Apache-2.0": ["apache", "apache 2", "apache 2 0", "apache v2", "apache v2 0", "apache license v2", "apache license v2 0", "apache license 2 0", "apache license version 2", "apache license version 2 0", "apache version 2 0", "asl 2 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "two clause bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "three clause bsd"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "cddl 1 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public license version 1 2", "eupl 1 2", "eupl v1 2"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gplv2", "gpl v2", "gpl 2 0", "gnu gplv2", "gnu gpl v2", "gnu gpl version 2"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license v2 or later", "gplv2 or later", "gpl v2 or later", "gnu gpl v2 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gplv3", "gpl v3", "gpl 3 0", "gnu gplv3", "gnu gpl v3", "gnu gpl version 3"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license v3 or later", "gplv3 or later", "gpl v3 or later", "gnu gpl v3 or later"],
    "ISC": ["isc"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1"],
    "LGPL-2.1-or-later": ["gnu lesser general public license version 2 1 or later", "lgplv2 1 or later", "lgpl v2 1 or later"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "lgplv3", "lgpl v3", "lgpl 3 0"],
    "LGPL-3.0-or-later": ["gnu lesser general public license version 3 or later", "lgplv3 or later", "lgpl v3 or later"],
    "MIT": ["mit", "expat", "mit expat", "x11 mit"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2 0"],
    "NCSA": ["university of illinois ncsa open source", "university of illinois open source"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "open font license version 1 1", "ofl 1 1"],
    "PostgreSQL": ["postgresql"],
    "Python-2.0": ["psf license agreement", "python software foundation"],
    "Unlicense": ["unlicense", "the unlicense"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public"],
    "Zlib": ["zlib", "zlib libpng"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal"],
}
#: Creative Commons licences by the parts of their names; with VERSIONS they give names by rule (named()).
PARTS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-ND": "attribution noderivatives", "BY-NC": "attribution noncommercial", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: A statement of a name: it counts as "licensed under <name>".
STATES = "^(?:(?:this|the|all)(?: [a-z0-9]+){1,3} (?:is|are) )?(?:licensed|released|distributed|published|available|made available) under (?:the )?(?:terms of )?(?:the |an? )?(.*?)(?: licen[sc]e)?$"
RULES = [
    ("Apache-2.0", (6, 7, 8, 9)),
    ("Apache-2.0", (6, 7)),
    ("Apache-2.0", (5,)),
    ("Apache-2.0", (31,)),
    ("MIT", (10, 11)),
    ("MIT", (4,)),
    ("MIT", (27,)),
    ("MIT", (30,)),
    ("BSD-3-Clause", (12, 13, 14, 15)),
    ("BSD-2-Clause", (12, 13, 14)),
    ("GPL-2.0-or-later", (16, 17, 18)),
    ("GPL-3.0-or-later", (16, 17, 19)),
    ("GPL-2.0-only", (28,)),
    ("GPL-3.0-only", (1,)),
    ("ISC", (20,)),
    ("CC-BY-4.0", (21,)),
    ("CC-BY-4.0", (23,)),
    ("CC-BY-SA-4.0", (22,)),
    ("CC-BY-SA-4.0", (24,)),
    ("CC-BY-NC-4.0", (2,)),
    ("CC0-1.0", (25,)),
    ("Unlicense", (26,)),
    ("MPL-2.0", (29,)),
    ("all-rights-reserved", (3,)),
    ("MIT-0", (54,)),
    ("NCSA", (58, 59, 60)),
    ("X11", (10, 11, 61)),
    ("BSD-3-Clause", (12, 13, 14, 77)),
    ("BSD-4-Clause", (12, 13, 14, 57, 15)),
    ("BSD-4-Clause", (12, 13, 14, 57, 77)),
    ("GPL-3.0-or-later", (16, 33)),
    ("GPL-2.0-or-later", (16, 34)),
    ("GPL-2.0-only", (16, 35)),
    ("GPL-2.0-only", (16, 17, 62)),
    ("GPL-3.0-only", (16, 17, 63)),
    ("GPL-2.0-only", (16, 36)),
    ("GPL-3.0-only", (16, 37)),
    ("GPL-3.0-only", (16, 38)),
    ("LGPL-2.1-or-later", (39, 40, 41)),
    ("LGPL-2.1-or-later", (16, 40, 41)),
    ("LGPL-3.0-or-later", (39, 40, 19)),
    ("LGPL-3.0-or-later", (16, 40, 19)),
    ("LGPL-3.0-or-later", (39, 42)),
    ("LGPL-3.0-or-later", (16, 42)),
    ("LGPL-2.0-or-later", (39, 43, 18)),
    ("AGPL-3.0-or-later", (16, 44)),
    ("AGPL-3.0-or-later", (16, 45, 19)),
    ("GFDL-1.2-or-later", (46,)),
    ("GFDL-1.3-or-later", (47,)),
    ("Zlib", (76, 48)),
    ("Zlib", (48, 49, 50)),
    ("Zlib", (48, 50)),
    ("BSL-1.0", (51,)),
    ("BSL-1.0", (52,)),
    ("0BSD", (53,)),
    ("ISC", (56,)),
    ("curl", (56, 61)),
    ("PostgreSQL", (55,)),
    ("WTFPL", (64,)),
    ("OFL-1.1", (65,)),
    ("EPL-1.0", (66,)),
    ("EPL-2.0", (67,)),
    ("CDDL-1.0", (68,)),
    ("MPL-1.1", (69,)),
    ("Unlicense", (71,)),
    ("CC0-1.0", (72,)),
    ("blessing", (73, 74)),
    ("Beerware", (75,)),
    ("Artistic-1.0-Perl", (78, 79)),
    ("Artistic-1.0-Perl", (39, 79)),
    ("Artistic-1.0-Perl", (16, 79)),
]
#: Any holder's name in the third BSD condition counts as this one.
HOLDER, HELD = "^(?:3 |c )?neither the name of .* nor the names of (?:its|the) contributors ", "neither the name of the copyright holder nor the names of its contributors "
#: Identifiers that SPDX lines held before "-only" and "-or-later" came.
OLD_SPDX = {"gpl 2 0": "GPL-2.0-only", "gpl 3 0": "GPL-3.0-only", "lgpl 2 1": "LGPL-2.1-only", "lgpl 3 0": "LGPL-3.0-only", "agpl 3 0": "AGPL-3.0-only"}
#: Each known sentence holds one of these, so a text without any needs no splitting. No white space: between
#: two words a text may have any.
ANCHORS = ["licens", "licenc", "reserved", "permission", "redistribut", "software", "domain", "copyright", "this notice", "legal notice", "same terms"]
#: Sentences end at this punctuation before white space. Split are the text by lines as well, and with its
#: lines joined: a notice may stand on a line of its own or be wrapped. It may also be wrapped below a line
#: without punctuation (paragraphs()).
BY_LINE, WRAPPED = "[.!?:;]+[ \\t\\r]+|[.!?:;]*\\n", "[.!?:;]+[ \\t\\r\\n]+"
LETTERS = "[^a-z0-9]+"
#: Between the licences of an SPDX line's expression, and exceptions within one (of up to 1,000 characters).
TAG = "SPDX-License-Identifier:"
JOINS, EXCEPTION = f"[ \\t)]+(?:OR|AND)[ \\t(]+(?<={TAG}[^\\n]{{0,1000}})", f"[ \\t]+WITH[ \\t]+[A-Za-z0-9.+-]+(?<={TAG}[^\\n]{{0,1000}})"
#: A line without letters and digits: blank, but for comment signs.
BLANK = "[^a-zA-Z0-9\\n]{0,80}\\n"


def normalised(sentence: str) -> str:
    """Lower-case ASCII letters and digits, single spaces between runs of them; a version's + is "or later"."""
    lower = sentence.lower().replace(".0+", ".0 or later").replace(".1+", ".1 or later")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in lower).split())


@dataclass(frozen=True)
class Table:
    """Identifiers by normalised sentence, rules as ordered identifiers, and what splitting needs to know of the sentences.

    `halves`: first pieces of the sentences that the patterns cut in two. `begins`: first words, at most nine, of those that
    may begin a line below one without punctuation; nine words tell a sentence's beginning from the middle of another one.
    """

    known: dict[str, int]
    rules: list[tuple[str, tuple[int, ...]]]
    halves: list[str]
    begins: list[tuple[str, ...]]


def named() -> dict[str, str]:
    """Licence by normalised sentence that only names it: "licensed under <name>", or an SPDX line."""
    names = {normalised(f"licensed under {n}"): i for i, all_of in NAMES.items() for n in all_of}
    for part, words in PARTS.items():
        for v in VERSIONS:
            for full in (f"cc {part} {v}", f"creative commons {words} {v}", f"creative commons {words} {v} international", f"creative commons {words} {v} unported", f"creative commons {part} {v}"):
                names[normalised(f"licensed under {full}")] = f"CC-{part}-{v}"
    stated = dict.fromkeys([*NAMES, *(n for n, _ in RULES if n != "all-rights-reserved"), *names.values()])
    return names | {normalised(f"SPDX-License-Identifier: {i}"): i for i in stated} | {f"spdx license identifier {n}": i for n, i in OLD_SPDX.items()}


@cache
def built_in() -> Table:
    """SENTENCES with their WORDINGS, and RULES; a numbered sentence has the identifier of the plain one."""
    known = {normalised(s): k for k, s in SENTENCES.items()} | {normalised(w): k for k, all_of in WORDINGS.items() for w in all_of}
    known[normalised(SENTENCES[32])] = 13
    begins = sorted({tuple(k.split()[:9]) for k in known})
    raw = [*SENTENCES.values(), *(w for all_of in WORDINGS.values() for w in all_of)]
    cut = [[normalised(q) for q in re.split(BY_LINE, s)] for s in raw]
    rules = list(RULES)
    for sentence, name in named().items():
        if sentence not in known:
            known[sentence] = 1000 + len(known)
            rules.append((name, (known[sentence],)))
    return Table(known, rules, sorted({c[0] for c in cut if len(c) == 2 and c[1] not in known}), begins)


def from_texts(texts: dict[str, str]) -> Table:
    """A table of whole licence texts by licence: each text's sentences of three words or more, in order, are a rule.

    A text must hold one of ANCHORS and such a sentence. It is found with any comment
    signs and line breaks, as long as its blank lines stand where they do here; sentences unknown here may lie between its own.
    """
    base = f"{WRAPPED}|[.!?:;]*\\n{BLANK}"
    pieces = lambda text, pattern: [n for n in (normalised(q) for q in re.split(pattern, text)) if n.count(" ") >= 2]
    whole = [pieces(text, base) for text in texts.values()]
    begins = sorted({tuple(n.split()[:9]) for w in whole for n in w if n.count(" ") >= 8})
    known: dict[str, int] = {}
    rules = []
    for (name, text), plain in zip(texts.items(), whole, strict=True):
        if not plain or not any(a in text.lower() for a in ANCHORS):
            raise ValueError(f"no sentence of a licence in the text of {name}")
        for sequence in {tuple(plain): 0, tuple(pieces(text, paragraphs(begins))): 0}:
            rules.append((name, tuple(known.setdefault(n, len(known)) for n in sequence)))
    return Table(known, rules, [], begins)


def paragraphs(begins: list[tuple[str, ...]]) -> str:
    """WRAPPED, and splits at blank lines and at each line that begins so, behind comment signs or not."""
    gap = "[^a-zA-Z0-9]+"
    first = "|".join(gap.join(b) for b in begins)
    return f"{WRAPPED}|[.!?:;]*\\n(?:{BLANK}|(?=[^a-zA-Z0-9]{{0,20}}(?i:{first or '(?!)'})))"


def _literal(of: dict) -> Column:
    """A constant map of strings; neither side may hold a comma or an equals sign."""
    return F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in of.items())), F.lit(","), F.lit("="))


def _sequence(text: Column, pattern: str, table: Table | None = None) -> Column:
    """Identifiers of the known sentences in order, as ,a,,b,,c, ."""
    table = table or built_in()
    ids = _literal(table.known)
    later = lambda s: F.replace(F.replace(F.lower(s), F.lit(".0+"), F.lit(".0 or later")), F.lit(".1+"), F.lit(".1 or later"))
    own = F.array(F.transform(F.split(text, pattern), lambda s: F.trim(F.regexp_replace(later(s), LETTERS, " "))))
    states = lambda s: F.when(F.contains(s, F.lit(" under ")), F.regexp_replace(s, STATES, "licensed under $1"))
    holder = lambda s: F.when(F.contains(s, F.lit("neither the name of ")), F.regexp_replace(s, HOLDER, HELD))
    # a few known sentences are cut in two by the patterns: a piece counts with its successor too
    two = lambda p, s, i: F.when(s.isin(table.halves), F.try_element_at(ids, F.concat(s, F.lit(" "), F.get(p, i + 1))))
    one = lambda p, s, i: F.coalesce(F.try_element_at(ids, s), F.try_element_at(ids, F.coalesce(states(s), holder(s))), *([two(p, s, i)] if table.halves else []))
    found = F.flatten(F.transform(own, lambda p: F.transform(p, lambda s, i: one(p, s, i))))
    return F.array_join(F.transform(F.filter(found, lambda k: k.isNotNull()), lambda k: F.concat(F.lit(","), k, F.lit(","))), "")


def _text(ids: tuple[int, ...]) -> str:
    return "".join(f",{k}," for k in ids)


def _lines_of_expressions(text: Column) -> Column:
    """text with an SPDX line for each licence of an SPDX expression."""
    plain = F.regexp_replace(F.regexp_replace(text, EXCEPTION, ""), JOINS, f"\n{TAG} ")
    return F.when(F.contains(text, F.lit(TAG)), plain).otherwise(text)


def _longer(rules: list[tuple[str, tuple[int, ...]]], name: str, ids: tuple[int, ...]) -> list[str]:
    """The least sequences of other licences that hold this one within, as text; what holds one of them isn't needed."""
    around = {_text(other) for n, other in rules if n != name and len(other) > len(ids) and _text(ids) in _text(other)}
    return sorted(a for a in around if not any(b != a and b in a for b in around))


def _times(sequence: Column, part: str) -> Column:
    return ((F.length(sequence) - F.length(F.replace(sequence, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _matches(rules: list[tuple[str, tuple[int, ...]]], *sequences: Column) -> Column:
    """Names of the licences with a rule in a sequence.

    A match within a longer one of another licence doesn't count: one sequence must hold the shorter more often than the
    longer ones stand in any, as one way of splitting may know the longer notice and another only its beginning.
    """
    # most rules are one sentence that stands in no other rule: those are looked up
    alone = {ids[0]: name for name, ids in rules if len(ids) == 1 and not _longer(rules, name, ids)}
    by_name: dict[str, list[Column]] = {}
    for name, ids in rules:
        longer = [F.greatest(*(_times(s, part) for s in sequences)) for part in _longer(rules, name, ids)]
        for own in sequences if alone.get(ids[0]) != name or len(ids) > 1 else ():
            test = _times(own, _text(ids)) > reduce(add, longer) if longer else F.contains(own, F.lit(_text(ids)))
            by_name.setdefault(name, []).append(test)
    single = F.array()
    if alone:
        names = _literal(alone)
        single = F.transform(F.split(F.concat(*sequences), ","), lambda k: F.try_element_at(names, k))
    found = F.concat(single.cast("array<string>"), F.array(*(F.when(reduce(or_, tests), F.lit(name)) for name, tests in by_name.items())).cast("array<string>"))
    none = reduce(and_, (s == "" for s in sequences))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.filter(found, lambda n: n.isNotNull()))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licenses (sorted, comma-joined, empty if none), n_licenses of every document.

    A rule matches where its identifiers follow one another in the document's sequence of known sentences;
    other sentences between them don't matter. Of an SPDX expression every licence counts. `texts` adds whole licence texts to the table (from_texts()).
    A null text has no licence. Rows are independent; the whole scan is one projection without a shuffle.
    """
    tables = [built_in()] + ([from_texts(texts)] if texts else [])
    text = F.coalesce("text", F.lit(""))
    # a lambda's argument is computed once, however often its body refers to it; a projection would be inlined
    candidate = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, (F.contains(t, F.lit(a)) for a in ANCHORS)))
    own = F.array(F.when(candidate, _lines_of_expressions(text)).otherwise(""))

    def names(table: Table) -> Column:
        patterns = (BY_LINE, WRAPPED, paragraphs(table.begins))
        sequences = F.transform(own, lambda t: F.struct(*(_sequence(t, p, table).alias(f"s{i}") for i, p in enumerate(patterns))))
        return F.transform(sequences, lambda s: _matches(table.rules, *(s[f"s{i}"] for i in range(len(patterns)))))

    found = F.array(F.array_sort(F.array_distinct(F.flatten(F.concat(*map(names, tables))))))
    result = F.transform(found, lambda f: F.struct(F.array_join(f, ",").alias("licenses"), F.size(f).alias("n_licenses")))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.inline(result))


def scan_sql() -> str:
    """The same over `documents`, for DuckDB."""
    table = built_in()
    keys = ", ".join(f"'{k}'" for k in table.known)
    ids = ", ".join(map(str, table.known.values()))
    later = "replace(replace(lower(s), '.0+', '.0 or later'), '.1+', '.1 or later')"
    other = f"""case when contains(s, ' under ') then regexp_replace(s, '{STATES}', 'licensed under \\1')
 when contains(s, 'neither the name of ') then regexp_replace(s, '{HOLDER}', '{HELD}') else '' end"""

    def sequence(pattern: str) -> str:
        normal = f"list_transform(string_split_regex(text, '{pattern}'), lambda s: trim(regexp_replace({later}, '{LETTERS}', ' ', 'g')))"
        places = f"list_filter(list_transform({normal}, lambda s: coalesce(list_position([{keys}], s), list_position([{keys}], {other}), 0)), lambda k: k > 0)"
        return f"array_to_string(list_transform({places}, lambda k: ',' || ([{ids}])[k] || ','), '')"

    def times(own: str, part: str) -> str:
        return f"(length({own}) - length(replace({own}, '{part}', ''))) // {len(part)}"

    tests: dict[str, list[str]] = {}
    for name, rule in table.rules:
        longer = " + ".join(f"greatest({times('a', part)}, {times('b', part)})" for part in _longer(table.rules, name, rule))
        tests.setdefault(name, []).extend(f"{times(own, _text(rule))} > {longer}" if longer else f"contains({own}, '{_text(rule)}')" for own in ("a", "b"))
    cases = ", ".join(f"case when {' or '.join(any_of)} then '{name}' end" for name, any_of in tests.items())
    return f"""select doc_id, array_to_string(f, ',') licenses, cast(len(f) as integer) n_licenses from (
 select doc_id, list_sort(list_filter([{cases}], lambda n: n is not null)) f from (
 select doc_id, {sequence(BY_LINE)} a, {sequence(WRAPPED)} b from (select doc_id, coalesce(text, '') as text from documents)))"""
