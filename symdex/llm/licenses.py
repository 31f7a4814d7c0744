"""License scans: known sentences of licences, then ordered rules over their sequence.

A text is cut into sentences, each is normalised, and a normalised sentence that the catalogue knows
becomes an identifier. Rules, the most particular first, look for runs of identifiers; a run that
a rule takes leaves a border, and so does an unknown sentence that speaks of licences, so that only
sentences that stand together make a run. All of it is DataFrame functions: one projection, no
shuffle, no Python. A text without any of the cue words, which every known sentence has, is
passed over after a few substring searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import ascii_lower, table

# ---- fixed values: words of public licences ------------------------------------------------

#: Every known sentence has one of these.
CUES = ("licen", "copyright", "permission", "redistribut", "warrant", "liab", "public domain", "free software", "endorse", "unencumbered", "as is", "mozilla", "spdx", "released under", "distributed under", "available under", "published under", "advertising materials")

#: Sentence identifiers and the sentences as written; they are normalised like any text.
SENTENCES = (
    ("MIT_GRANT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT_NOTICE", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT_ASIS", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MIT_LIABILITY", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT_TITLE", "The MIT License (MIT)"),
    ("MIT_TITLE", "MIT License"),
    ("ISC_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC_GRANT", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ZERO_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC_ASIS", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("ISC_LIABILITY", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD_INTRO", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD_ADVERTISING", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("BSD_NO_ENDORSE", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD_ASIS", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("APACHE2_TITLE", "Apache License Version 2.0, January 2004"),
    ("APACHE2_UNDER", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("APACHE2_COMPLY", "you may not use this file except in compliance with the License."),
    ("APACHE2_COPY", "You may obtain a copy of the License at"),
    ("APACHE2_UNLESS", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("APACHE2_SEE", "See the License for the specific language governing permissions and limitations under the License."),
    ("FREE_SOFTWARE", "This program is free software"),
    ("FREE_SOFTWARE", "This library is free software"),
    ("GPL_TERMS", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL_TERMS", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("V2_LATER", "either version 2 of the License, or (at your option) any later version."),
    ("V21_LATER", "either version 2.1 of the License, or (at your option) any later version."),
    ("V3_LATER", "either version 3 of the License, or (at your option) any later version."),
    ("AGPL_TERMS", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("V2_ONLY", "version 2 of the License."),
    ("V21_ONLY", "version 2.1 of the License."),
    ("V3_ONLY", "version 3 of the License."),
    ("GPL2_TITLE", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL3_TITLE", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL21_TITLE", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL3_TITLE", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL3_TITLE", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL2_ONLY", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License."),
    ("GPL2_ONLY", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2."),
    ("GPL3_ONLY", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("GPL3_ONLY", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("LGPL21_ONLY", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1 of the License."),
    ("LGPL3_ONLY", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("AGPL3_ONLY", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("AGPL3_ONLY", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3."),
    ("GPL2_LATER", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL21_LATER", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL3_LATER", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL2_ONLY", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL3_LATER", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL3_LATER", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL_HOPE", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("MPL2_TITLE", "Mozilla Public License Version 2.0"),
    ("BOOST_TITLE", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BOOST_GRANT", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BOOST_NOTICE", "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("EPL1_UNDER", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("EPL2_UNDER", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL2_UNDER", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at"),
    ("EUPL_UNDER", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")"),
    ("EUPL_TITLE", "EUROPEAN UNION PUBLIC LICENCE v. 1.2"),
    ("ARTISTIC2_TITLE", "The Artistic License 2.0"),
    ("WTFPL_TITLE", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("MPL2_UNDER", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2_COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ZLIB_ASIS", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZLIB_LIABLE", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("ZLIB_GRANT", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("UNLICENSE", "This is free and unencumbered software released into the public domain."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("PUBLIC_DOMAIN", "This work is in the public domain."),
    ("ALL_RIGHTS", "All rights reserved under copyright."),
    ("PROPRIETARY", "Unauthorized copying of this file, via any medium, is strictly prohibited without permission of the copyright holder."),
)

#: Names that follow "licensed under" and the like, as written, and the identifiers of those licences.
NAMES = (
    ("MIT", "MIT License"), ("MIT", "MIT"), ("ISC", "ISC License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Unlicense", "Unlicense"), ("WTFPL", "WTFPL"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "New BSD License"), ("BSD-2-Clause", "Simplified BSD License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("Apache-2.0", "Apache 2.0"),
    ("GPL-2.0-only", "GNU General Public License, version 2"), ("GPL-3.0-only", "GNU General Public License, version 3"), ("GPL-2.0-only", "GNU GPL v2"), ("GPL-3.0-only", "GNU GPL v3"), ("GPL-2.0-only", "GPLv2"), ("GPL-3.0-only", "GPLv3"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"), ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("Zlib", "zlib License"), ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("CC-BY-3.0", "CC BY 3.0"), ("CC-BY-SA-3.0", "CC BY-SA 3.0"),
    ("BSD-4-Clause", "BSD 4-Clause License"), ("BSL-1.0", "Boost Software License 1.0"), ("EPL-1.0", "Eclipse Public License v1.0"), ("EPL-1.0", "Eclipse Public License 1.0"), ("EPL-2.0", "Eclipse Public License v2.0"), ("EPL-2.0", "Eclipse Public License, version 2.0"), ("EUPL-1.2", "EUPL"), ("EUPL-1.2", "EUPL, version 1.2"), ("EUPL-1.2", "European Union Public Licence 1.2"),
    ("Artistic-2.0", "Artistic License 2.0"), ("Artistic-2.0", "Artistic License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("0BSD", "BSD Zero Clause License"), ("Apache-2.0", "Apache License"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0-only", "GNU General Public License v2.0"), ("GPL-3.0-only", "GNU General Public License v3.0"), ("GPL-2.0-only", "GPL version 2"), ("GPL-3.0-only", "GPL version 3"), ("LGPL-2.1-only", "LGPLv2.1"), ("LGPL-3.0-only", "LGPLv3"), ("AGPL-3.0-only", "AGPLv3"), ("AGPL-3.0-only", "GNU AGPL v3"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
)

#: Licence and the run of sentence identifiers that tells it, tried in this order.
RULES = (
    ("BSD-4-Clause", ("BSD_INTRO", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISING", "BSD_NO_ENDORSE", "BSD_ASIS")),
    ("BSD-4-Clause", ("BSD_INTRO", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISING")),
    ("BSD-3-Clause", ("BSD_INTRO", "BSD_SOURCE", "BSD_BINARY", "BSD_NO_ENDORSE", "BSD_ASIS")),
    ("BSD-3-Clause", ("BSD_INTRO", "BSD_SOURCE", "BSD_BINARY", "BSD_NO_ENDORSE")),
    ("BSD-2-Clause", ("BSD_INTRO", "BSD_SOURCE", "BSD_BINARY", "BSD_ASIS")),
    ("BSD-2-Clause", ("BSD_INTRO", "BSD_SOURCE", "BSD_BINARY")),
    ("BSD-1-Clause", ("BSD_INTRO", "BSD_SOURCE")),
    ("MIT", ("MIT_TITLE", "MIT_GRANT", "MIT_NOTICE", "MIT_ASIS", "MIT_LIABILITY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_ASIS", "MIT_LIABILITY")),
    ("MIT-0", ("MIT_GRANT", "MIT_ASIS", "MIT_LIABILITY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("ISC", ("ISC_GRANT", "ISC_ASIS", "ISC_LIABILITY")),
    ("0BSD", ("ZERO_GRANT", "ISC_ASIS", "ISC_LIABILITY")),
    ("ISC", ("ISC_GRANT",)),
    ("Apache-2.0", ("APACHE2_UNDER", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_UNLESS", "APACHE2_SEE")),
    ("Apache-2.0", ("APACHE2_UNDER", "APACHE2_COMPLY")),
    ("Apache-2.0", ("APACHE2_UNDER",)),
    ("Apache-2.0", ("APACHE2_TITLE",)),
    ("AGPL-3.0-or-later", ("AGPL3_LATER",)),
    ("AGPL-3.0-or-later", ("AGPL_TERMS", "V3_LATER")),
    ("AGPL-3.0-only", ("AGPL3_ONLY",)),
    ("AGPL-3.0-only", ("AGPL_TERMS", "V3_ONLY")),
    ("LGPL-2.1-or-later", ("LGPL21_LATER",)),
    ("LGPL-3.0-or-later", ("LGPL3_LATER",)),
    ("LGPL-2.1-only", ("LGPL21_ONLY",)),
    ("LGPL-2.1-only", ("LGPL_TERMS", "V21_ONLY")),
    ("LGPL-3.0-only", ("LGPL3_ONLY",)),
    ("LGPL-3.0-only", ("LGPL_TERMS", "V3_ONLY")),
    ("LGPL-2.1-or-later", ("LGPL_TERMS", "V21_LATER")),
    ("LGPL-3.0-or-later", ("LGPL_TERMS", "V3_LATER")),
    ("GPL-3.0-or-later", ("GPL3_LATER", "GPL_HOPE")),
    ("GPL-2.0-or-later", ("GPL_TERMS", "V2_LATER", "GPL_HOPE")),
    ("GPL-3.0-or-later", ("GPL3_LATER",)),
    ("GPL-3.0-or-later", ("GPL_TERMS", "V3_LATER")),
    ("GPL-2.0-or-later", ("GPL_TERMS", "V2_LATER")),
    ("GPL-2.0-or-later", ("GPL2_LATER",)),
    ("GPL-2.0-only", ("GPL2_ONLY",)),
    ("GPL-2.0-only", ("GPL_TERMS", "V2_ONLY")),
    ("GPL-3.0-only", ("GPL3_ONLY",)),
    ("GPL-3.0-only", ("GPL_TERMS", "V3_ONLY")),
    ("GPL-2.0-only", ("GPL2_TITLE",)),
    ("GPL-3.0-only", ("GPL3_TITLE",)),
    ("LGPL-2.1-only", ("LGPL21_TITLE",)),
    ("LGPL-3.0-only", ("LGPL3_TITLE",)),
    ("AGPL-3.0-only", ("AGPL3_TITLE",)),
    ("BSL-1.0", ("BOOST_TITLE", "BOOST_GRANT", "BOOST_NOTICE")),
    ("BSL-1.0", ("BOOST_GRANT", "BOOST_NOTICE")),
    ("BSL-1.0", ("BOOST_TITLE",)),
    ("EPL-1.0", ("EPL1_UNDER",)),
    ("EPL-2.0", ("EPL2_UNDER",)),
    ("EUPL-1.2", ("EUPL_UNDER",)),
    ("EUPL-1.2", ("EUPL_TITLE",)),
    ("Artistic-2.0", ("ARTISTIC2_TITLE",)),
    ("WTFPL", ("WTFPL_TITLE",)),
    ("MPL-2.0", ("MPL2_TITLE",)),
    ("MPL-2.0", ("MPL2_UNDER",)),
    ("Zlib", ("ZLIB_ASIS", "ZLIB_LIABLE", "ZLIB_GRANT")),
    ("Unlicense", ("UNLICENSE",)),
    ("CC0-1.0", ("CC0",)),
    ("LicenseRef-public-domain", ("PUBLIC_DOMAIN",)),
    ("LicenseRef-proprietary", ("PROPRIETARY",)),
    ("LicenseRef-proprietary", ("ALL_RIGHTS",)),
    ("MIT", ("MIT_TITLE",)),
)

# ---- rules of the language ------------------------------------------------------------------

_WS = r"[\x20\x09-\x0D]"
#: In turn: a tag keeps what it names; comment leaders go; blank lines, sentence ends and line starts with an opening word become borders.
CUTS = (
    ("(spdx-license-identifier):", "{1} "),
    (r"(^|\n)[\x20\x09]*(?://+|#+|/\*+|\*+/?|;+|--+|%+|>+)[\x20\x09]*", "{1}"),
    (rf"\n{_WS}*\n", "\x01"),
    (rf"([.!?:;])(?:{_WS}+|$)", "\x01"),
    (rf"\n{_WS}*(copyright|licensed|released|distributed|available|spdx|permission|redistribution|this|the|unless|you may)([^a-z])", "\x01{1}{2}"),
)
#: What a sentence loses: all but letters, digits, dots and plus signs; list marks at its start; dots at its ends.
CLEAN = ((r"[^a-z0-9.+]+", " "), (r"^[ .]*(?:[0-9a-z][. ]+)?|[. ]+$", ""))
#: Short statements: the name of the licence follows.
STATEMENT = r"^(?:this (?:[a-z]+ )?is )?(?:dual )?(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:(?:either|both) )?(?:the |an? )?(.+)$"
#: What parts the licences of a statement or an expression, and the end of a statement that allows later versions.
OR_AND, LATER = r" (?:or|and) (?:the |an? )?", r" or (?:at your option )?(?:any )?later(?: versions?)?$"
SPDX = r"^spdx license identifier ([a-z0-9.+ ]+)$"
COPYRIGHT = r"^copyright (?:c )?(?:[0-9]|by ).*$"
LINK = r"^https? .*$"


def clean(c: Column) -> Column:
    for pattern, by in CLEAN:
        c = F.regexp_replace(c, pattern, by)
    return c


def normal(text: str) -> str:
    """A catalogue text (one line) as `cut` and `clean` would leave it, its sentence borders as one blank."""
    import re

    text = re.sub(rf"([.!?:;])(?:{_WS}+|$)", " ", text.lower())
    for pattern, by in CLEAN:
        text = re.sub(pattern, by, text)
    return text


def catalogue() -> tuple[dict[str, str], dict[str, str]]:
    """Normalised first sentences to identifiers, normalised names to licences.

    A licence sentence with inner borders is known by its longest part.
    """
    import re

    known = {}
    for name, text in SENTENCES:
        parts = [normal(p) for p in re.split(rf"[.!?:;]{_WS}+", text)]
        known[max(parts, key=len)] = name
    return known, {normal(n): i for i, n in NAMES}


def identifiers() -> dict[str, str]:
    """Licences in lower case to their names as usually written."""
    return {i.lower(): i for i in sorted({i for i, _ in NAMES} | {i for i, _ in RULES})}


def in_map(pairs: dict[str, str], key: Column) -> Column:
    """The value of `key` in a small fixed map, null outside."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]), key)


def spdx_names(expression: Column) -> Column:
    """The licences of a normalised SPDX expression, |-joined; what isn't known stays as it is, exceptions go."""
    parts = F.split(F.replace(expression, F.lit(" or later"), F.lit("-or-later")), OR_AND)
    one = lambda p: F.replace(F.trim(F.regexp_replace(p, " with .*$", "")), F.lit(" "), F.lit("-"))
    return F.array_join(F.transform(F.transform(parts, one), lambda p: F.coalesce(in_map(identifiers(), p), p)), "|")


def stated_names(statement: Column) -> Column:
    """The licences that a statement names, |-joined; null if one of them is unknown."""
    names = catalogue()[1]
    later = F.regexp_like(statement, F.lit(LATER))
    found = F.transform(F.split(F.regexp_replace(statement, LATER, ""), OR_AND), lambda p: in_map(names, F.trim(p)))
    found = F.transform(found, lambda x: F.when(later, F.regexp_replace(x, "-only$", "-or-later")).otherwise(x))
    return F.when(~F.exists(found, lambda x: x.isNull()), F.array_join(found, "|"))


def identify(sentence: Column) -> Column:
    """The identifier of a normalised sentence; ? for an unknown one, nothing for a bare link."""
    known = catalogue()[0]
    spdx, stated = F.regexp_extract(sentence, SPDX, 1), F.regexp_extract(sentence, STATEMENT, 1)
    plain = F.coalesce(in_map(known, sentence), F.when(stated != "", F.concat(F.lit("UNDER:"), stated_names(stated))), F.lit("?"))
    return F.when(F.regexp_like(sentence, F.lit(COPYRIGHT)), "COPYRIGHT").when(F.regexp_like(sentence, F.lit(LINK)), "").when(spdx != "", F.concat(F.lit("SPDX:"), spdx_names(spdx))).otherwise(plain)


def has_cue(lower: Column) -> Column:
    found = F.contains(lower, F.lit(CUES[0]))
    for cue in CUES[1:]:
        found = found | F.contains(lower, F.lit(cue))
    return found


def sentences(text: Column) -> Column:
    """The normalised sentences of a text that have a cue; none for a null."""
    lower = ascii_lower(text)
    cut = lower
    for pattern, by in CUTS:
        cut = F.regexp_replace(cut, pattern, by.format("", "$1", "$2"))
    parts = F.transform(F.split(cut, "\x01"), lambda x: clean(x))
    cued = F.filter(parts, has_cue)
    return F.when(has_cue(lower), cued).otherwise(F.array().cast("array<string>"))


def apply_rules(ids: Column) -> Column:
    """The licences that a sequence of identifiers tells, sorted. Copyright lines and links stand in nobody's way, unknown sentences do."""
    told = F.filter(ids, lambda x: ~x.isin("COPYRIGHT", ""))
    start = F.struct(F.concat(F.lit(","), F.array_join(told, ",,"), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(run) + ",").alias("run")) for name, run in RULES])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["run"])
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["run"], F.lit(",?,"))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    by_rule = F.aggregate(rules, start, step, lambda acc: acc["found"])
    named = F.filter(told, lambda x: F.startswith(x, F.lit("UNDER:")) | F.startswith(x, F.lit("SPDX:")))
    by_name = F.flatten(F.transform(named, lambda x: F.split(F.regexp_replace(x, "^(UNDER|SPDX):", ""), r"\|")))
    return F.array_sort(F.array_distinct(F.concat(by_rule, by_name)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: the key, n_cued, n_known, sentence_ids, licenses, verdict.

    `n_cued` counts sentences that speak of licences, `n_known` those that the catalogue knows;
    `sentence_ids` are theirs in order and `licenses` what the rules make of them, comma-joined.
    The verdict is none (no such sentence), unknown (none of them leads to a licence) or known.
    Null and empty texts have none; repeated rows are rows of their own; other columns are ignored.
    """
    cued = docs.select(F.col(key), sentences(F.col(text)).alias("s"))
    known = cued.select(key, F.size("s").cast("long").alias("n_cued"), F.transform("s", lambda x: identify(x)).alias("all"))
    known = known.withColumn("ids", F.filter("all", lambda x: ~x.isin("?", "")))
    told = known.select("*", F.when(F.size("ids") > 0, apply_rules(F.col("all"))).otherwise(F.array().cast("array<string>")).alias("l"))
    verdict = F.when(F.col("n_cued") == 0, "none").when(F.size("l") == 0, "unknown").otherwise("known")
    return told.select(key, "n_cued", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("l", ",").alias("licenses"), verdict.alias("verdict"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents with the licences that they name or carry (cases: see `scan`)."""
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same scan in SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known, names = catalogue()
    cut = "l"
    for pattern, by in CUTS:
        by = by.format("", r"\1", r"\2")
        cut = f"regexp_replace({cut}, {q(pattern)}, {q(by)}, 'g')".replace("\x01", "' || chr(1) || '")
    cleaned = "x"
    for pattern, by in CLEAN:
        cleaned = f"regexp_replace({cleaned}, {q(pattern)}, {q(by)}, 'g')"
    cue = lambda c: "(" + " or ".join(f"contains({c}, {q(x)})" for x in CUES) + ")"
    a_map = lambda m: "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(m.items())) + "}"
    spdx = f"replace(regexp_extract(x, {q(SPDX)}, 1), ' or later', '-or-later')"
    one = "replace(trim(regexp_replace(p, ' with .*$', '')), ' ', '-')"
    spdx = f"array_to_string(list_transform(list_transform(regexp_split_to_array({spdx}, {q(OR_AND)}), lambda p: {one}), lambda p: coalesce({a_map(identifiers())}[p], p)), '|')"
    stated = f"regexp_extract(x, {q(STATEMENT)}, 1)"
    named = f"list_transform(regexp_split_to_array(regexp_replace({stated}, {q(LATER)}, ''), {q(OR_AND)}), lambda p: {a_map(names)}[trim(p)])"
    named = f"case when regexp_matches({stated}, {q(LATER)}) then list_transform({named}, lambda p: regexp_replace(p, '-only$', '-or-later')) else {named} end"
    named = f"case when {stated} <> '' and len(list_filter({named}, lambda p: p is null)) = 0 then 'UNDER:' || array_to_string({named}, '|') end"
    identify_sql = f"""case when regexp_matches(x, {q(COPYRIGHT)}) then 'COPYRIGHT' when regexp_matches(x, {q(LINK)}) then ''
      when regexp_extract(x, {q(SPDX)}, 1) <> '' then 'SPDX:' || {spdx} else coalesce({a_map(known)}[x], {named}, '?') end"""
    steps, rest = [], "r0"
    for i, (_, run) in enumerate(RULES, 1):
        steps.append(f"contains({rest}, {q(',' + ',,'.join(run) + ',')}) as m{i}, replace({rest}, {q(',' + ',,'.join(run) + ',')}, ',?,') as r{i}")
        rest = f"r{i}"
    found = ", ".join(f"case when m{i} then {q(name)} end" for i, (name, _) in enumerate(RULES, 1))
    return f"""
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as l from documents),
p as (select doc_id, case when {cue('l')} then list_transform(string_split({cut}, chr(1)), lambda x: {cleaned}) else [] end as parts from d),
s as (select doc_id, list_filter(parts, lambda x: {cue('x')}) as s from p),
k as (select doc_id, len(s)::bigint as n_cued, list_transform(s, lambda x: {identify_sql}) as every from s),
t as (select *, list_filter(every, lambda x: x not in ('?', '')) as ids, list_filter(every, lambda x: x not in ('COPYRIGHT', '')) as told from k),
u as (select *, ',' || coalesce(array_to_string(told, ',,'), '') || ',' as r0 from t),
m as (select *, {', '.join(steps)} from u),
f as (select *, list_sort(list_distinct(list_concat(list_filter([{found}], lambda x: x is not null), flatten(list_transform(list_filter(told, lambda x: starts_with(x, 'UNDER:') or starts_with(x, 'SPDX:')), lambda x: string_split(regexp_replace(x, '^(UNDER|SPDX):', ''), '|')))))) as lic from m)
select doc_id, n_cued, len(ids)::bigint as n_known, coalesce(array_to_string(ids, ','), '') as sentence_ids, coalesce(array_to_string(lic, ','), '') as licenses,
  case when n_cued = 0 then 'none' when len(lic) = 0 then 'unknown' else 'known' end as verdict from f
"""


ORACLE_OP5 = oracle()
