"""Licence scans by a positional index of rare words.

Licence templates are word sequences; the index has for each word its templates and places. A file's words that are
rarest in a template (its rarest quarter, by IDF among the templates) are looked up; postings whose places differ from the file's by about the same amount point to
a template near that offset: inserted and missing words shift what follows, so offsets may drift by a share of the
template's length. There the template's words are sought in the file's, and its mandatory phrases must stand near their
places. Only built-in functions are used, and nothing is shuffled.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.arrays import prefix_sums, run_starts
from quarrylight.llm.shared import fresh, kept_columns, let, text_of

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    """``phrases`` are mandatory, word by word as in ``text``."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())

    @property
    def drift(self) -> int:
        """By how many words parts of the template may be shifted against each other, about."""
        return max(2, len(self.words) // 8)


# Wordings in which public licences are named or begin.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("granted free of charge", "without restriction")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0 1 0", ("waived all copyright", "cc0 1 0")),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("free of charge", "without restriction", "substantial portions of the software")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""", ("with or without fee", "appear in all copies")),
    Template("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
        the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the
        name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ("source and binary forms", "endorse or promote products")),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        ("must not be misrepresented", "altered source versions")),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws,
        the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law.""", ("unencumbered software", "dedicate any and all copyright interest")),
    Template("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
        to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant,
        this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies
        or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
        ("accompanying documentation covered by this license", "machine executable object code")),
    Template("apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License"
        shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or
        entity authorized by the copyright owner that is granting the License.""", ("apache license version 2 0", "terms and conditions for use")),
    Template("gpl-2.0", """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim
        copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it. By
        contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.""",
        ("gnu general public license version 2", "verbatim copies of this license document")),
    Template("gpl-3.0", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies
        of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.""",
        ("gnu general public license version 3", "verbatim copies of this license document")),
    Template("lgpl-3.0", """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim
        copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the
        GNU General Public License, supplemented by the additional permissions listed below.""", ("gnu lesser general public license version 3", "verbatim copies of this license document")),
    Template("agpl-3.0", """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute
        verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds
        of works, specifically designed to ensure cooperation with the community in the case of network server software.""",
        ("gnu affero general public license version 3", "verbatim copies of this license document")),
    Template("mpl-2.0", """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns
        Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.""",
        ("mozilla public license version 2 0", "covered software")),
)
# Identifiers of licences as source files name them.
SPDX = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)


def identified(label: str, expression: str) -> Template:
    """The template of an identifier line whose licence expression names ``label``."""
    whole = " ".join(re.findall("[a-z0-9]+", f"spdx license identifier {expression}".lower()))
    return Template(label, whole, ("spdx license identifier", whole))


#: An identifier alone, and the two that are most often given as a choice.
IDENTIFIERS = (*[identified(x.lower(), x) for x in SPDX], identified("apache-2.0", "MIT OR Apache-2.0"), identified("mit", "Apache-2.0 OR MIT"))


@dataclass(frozen=True)
class Index:
    """``postings``: of each word that is among the rarest of some template, (template, place) there. ``anchors``: how many a template has."""

    templates: tuple[Template, ...]
    postings: dict[str, list[tuple[int, int]]]
    anchors: list[int]

    @classmethod
    def of(cls, templates: tuple[Template, ...] = TEMPLATES + IDENTIFIERS, share: float = 0.25, least: int = 3) -> Index:
        """Each template is looked up by its own words of highest IDF: a ``share`` of its distinct words, ``least`` of them or more."""
        words = [t.words for t in templates]
        frequency = Counter(w for ws in words for w in set(ws))
        idf = {w: math.log(len(templates) / n) for w, n in frequency.items()}
        postings: dict[str, list[tuple[int, int]]] = {}
        anchors = [0] * len(templates)
        for t, ws in enumerate(words):
            own = sorted(set(ws), key=lambda w: (-idf[w], w))
            rare = set(own[: max(least, int(len(own) * share))])
            for at, w in enumerate(ws):
                if w in rare:
                    postings.setdefault(w, []).append((t, at))
                    anchors[t] += 1
        return cls(tuple(templates), postings, anchors)


def normal(text: Column) -> Column:
    """Lower-case words with one space between, before and after them; one space if there are none."""
    # only A-Z are lowered; the quick way does the same where there is nothing but ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    words = F.trim(F.regexp_replace(low, _NOT_WORD, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def base_matches(padded: Column, base: dict[str, str]) -> Column:
    """array<struct<word, label>> of the places where a phrase's words stand consecutively."""
    pattern = "(?<= )(?:" + "|".join(base) + ")(?= )"
    labels = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])

    def places(found: Column) -> Column:
        def of(gaps: Column) -> Column:
            own = F.slice(gaps, F.lit(1), F.size(found))
            words = F.zip_with(own, found, lambda g, m: _spaces(g) + _spaces(m))
            starts = F.zip_with(prefix_sums(words), own, lambda before, g: before + _spaces(g) - 1)
            return F.zip_with(starts, found, lambda at, m: F.struct(at.alias("word"), F.element_at(labels, m).alias("label")))

        return let(F.split(padded, pattern, -1), of)

    return let(F.regexp_extract_all(padded, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, places(m)))


def template_matches(padded: Column, index: Index, least_share: float, slack: int) -> Column:
    """array<struct<label, score>> of the templates found; null if none of the mandatory phrases stands in the text."""
    likely = None
    for phrase in sorted({t.phrases[0] for t in index.templates}):
        likely = padded.contains(f" {phrase} ") if likely is None else likely | padded.contains(f" {phrase} ")
    posts = {w: [{"t": t, "at": at, "d": index.templates[t].drift} for t, at in p] for w, p in index.postings.items()}
    table = F.from_json(F.lit(json.dumps(posts)), "map<string,array<struct<t:int,at:int,d:int>>>")
    phrases = lambda t: [{"text": f" {p} ", "at": len(" ".join(t.words).partition(p)[0].split()), "n": len(p.split())} for p in t.phrases]
    known = F.from_json(
        F.lit(json.dumps([{"label": t.label, "words": sorted(set(t.words)), "n": len(t.words), "d": t.drift, "anchors": a, "phrases": phrases(t)} for t, a in zip(index.templates, index.anchors, strict=True)])),
        "array<struct<label:string,words:array<string>,n:int,d:int,anchors:int,phrases:array<struct<text:string,at:int,n:int>>>>",
    )
    wide = 1 << 40

    def verified(words: Column, code: Column, hits: Column) -> Column:
        """struct<label, score> of the template and offsets in ``code`` with ``hits`` rare words there, or null."""

        def of(t: Column, first: Column) -> Column:
            """``first``: the smallest offset; the others are less than twice the drift above."""
            about = lambda at, n: F.slice(words, (F.greatest(first + at - slack, F.lit(0)) + 1).cast("int"), (n + 2 * (t["d"] + slack)).cast("int"))
            share = F.size(F.array_intersect(t["words"], about(F.lit(0), t["n"]))) / F.size(t["words"])
            near = lambda p: F.concat(F.lit(" "), F.array_join(about(p["at"], p["n"]), " "), F.lit(" ")).contains(p["text"])
            good = (hits * 3 >= t["anchors"]) & (share >= least_share) & F.forall(t["phrases"], near)
            return F.when(good, F.struct(t["label"].alias("label"), share.alias("score")))

        return let(F.get(known, F.floor(code / wide).cast("int")), lambda t: of(t, (F.pmod(code, F.lit(wide)) - wide // 2) * t["d"]))

    def of(words: Column) -> Column:
        # rare words are told by a hash table; the map is read for them only
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*sorted(posts)), F.struct(F.element_at(table, w).alias("posts"), i.alias("i")))), lambda x: x.isNotNull())
        # an offset counts in two overlapping ranges, so that no two near ones are parted
        step = lambda x, p: F.floor((x["i"] - p["at"]) / p["d"]).cast("long") + wide // 2
        codes = F.flatten(F.transform(at, lambda x: F.flatten(F.transform(x["posts"], lambda p: F.array(p["t"].cast("long") * wide + step(x, p), p["t"].cast("long") * wide + step(x, p) - 1)))))

        def tally(c: Column) -> Column:
            def runs(starts: Column) -> Column:
                found = F.transform(starts, lambda s, j: verified(words, F.get(c, s), F.coalesce(F.get(starts, j + 1), F.size(c)) - s))
                return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))

            return let(run_starts(c), runs)

        return let(F.array_sort(codes), tally)

    return F.when(likely, let(F.split(F.trim(padded), " ", -1), of))


def scan(docs: DataFrame, text: str = "text", index: Index | None = None, base: dict[str, str] | None = None, least_share: float = 0.6, slack: int = 3) -> DataFrame:
    """``docs`` without ``text``, with n_words, base (array<struct<word, label>>), found (array<struct<label, score>>).

    ``base`` are the plain phrases' places (words from 0), ``found`` the templates of whose rare words a third stands
    at one offset (within twice the drift), with at least ``least_share`` of their words there and every mandatory phrase near its place (within the template's drift and ``slack`` words); both are empty arrays
    where there is nothing. A null text is empty and has no words. Repeated rows get equal results, an empty table gives no
    rows, whole texts are searched. Columns of the new names are replaced.
    """
    index = index or Index.of()
    kept = kept_columns(docs, text, "n_words", "base", "found")
    own_, found_ = fresh(docs, "_words", "_found")
    # a column of its own, so that it is made once for each row
    own = docs.select(*kept, let(normal(text_of(text)), lambda p: F.struct(p.alias("padded"), F.greatest(_spaces(p) - 1, F.lit(0)).alias("n_words"))).alias(own_))
    padded = F.col(f"{own_}.padded")
    one = let(
        padded,
        lambda p: F.struct(
            F.coalesce(base_matches(p, BASE if base is None else base), F.array().cast("array<struct<word:bigint,label:string>>")).alias("base"),
            F.coalesce(template_matches(p, index, least_share, slack), F.array().cast("array<struct<label:string,score:double>>")).alias("found"),
        ),
    )
    return own.select(*kept, F.col(f"{own_}.n_words").alias("n_words"), one.alias(found_)).select(*kept, "n_words", f"{found_}.base", f"{found_}.found")
