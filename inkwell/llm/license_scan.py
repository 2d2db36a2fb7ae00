"""Licence scan by canonical digests (native).

Texts are brought to a canonical form: lower case, no copyright lines, no
punctuation, one spelling of words that are spelt in several ways, single
blanks. Digests of whole canonical texts are hash-joined to those of known
licences; digests of whole canonical lines to those of known licence notices.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import chain, product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import join_counted, let, stored

#: Lines that only state whose work it is (fixed values, lower case).
COPYRIGHT = (r"^[^a-z0-9©(]*(copyright[^a-z0-9]*(\(c\)|©|[0-9<\[{])|©|\(c\)[^a-z0-9]*[0-9]"
             r"|all rights reserved[^a-z0-9]*$)")
#: Equivalent spellings: each word on the left is written as on the right (fixed values).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "owner": "holder", "owners": "holders", "percent": "per cent", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sublicence": "sub license", "sublicense": "sub license",
    "utilisation": "utilization", "whilst": "while", "https": "http",
}

_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_ISC_END = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_BSD_START = """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission."""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licences known by their whole text (fixed values).
LICENCES = {
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""" + _AS_IS,
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.""" + _ISC_END,
    "0BSD": """
Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted.""" + _ISC_END,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_END,
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use of
this software.
Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Notices known by a whole line (fixed values).
NOTICES = {
    "0BSD": ("SPDX-License-Identifier: 0BSD",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3",
                 "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   'Licensed under the Apache License, Version 2.0 (the "License");',
                   "SPDX-License-Identifier: Apache-2.0"),
    "Artistic-2.0": ("SPDX-License-Identifier: Artistic-2.0",),
    "BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause",),
    "BSD-3-Clause": ("SPDX-License-Identifier: BSD-3-Clause",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("SPDX-License-Identifier: CC0-1.0",),
    "EPL-2.0": ("SPDX-License-Identifier: EPL-2.0",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2",
                "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",
                "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "ISC": ("SPDX-License-Identifier: ISC",),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License",
            "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("SPDX-License-Identifier: MPL-2.0",),
    "OFL-1.1": ("SPDX-License-Identifier: OFL-1.1",),
    "Unlicense": ("SPDX-License-Identifier: Unlicense",),
    "Zlib": ("SPDX-License-Identifier: Zlib",),
}
#: Published texts of the longer licences, one file each, as their stewards print them.
TEXTS = Path(__file__).parent / "licences"
#: What stands before some of them where a work carries them (fixed values).
PREFACES = {"OFL-1.1": tuple(
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.\n"
    f"This license is copied below, and is also available with a FAQ at: {address}\n"
    for address in ("http://scripts.sil.org/OFL", "https://openfontlicense.org"))}
#: Title lines of the licences above (fixed values); each also goes with "The" before it.
TITLES = {
    "MIT": ("MIT License", "MIT License (MIT)", "MIT", "Expat License", "MIT License (Expat)", "License: MIT"),
    "ISC": ("ISC License", "ISC License (ISC)", "ISC", "ISC License (ISCL)", "License: ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD",
             "BSD Zero Clause License (0BSD)", "Zero-Clause BSD (0BSD)", "BSD 0-Clause License",
             "0-Clause BSD License", "Zero-Clause BSD License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License',
                     "Simplified BSD License", "FreeBSD License", "BSD License", "BSD-2-Clause",
                     "BSD 2-Clause License (BSD-2-Clause)", "BSD Two-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License',
                     "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License",
                     "BSD-3-Clause", "BSD 3-Clause License (BSD-3-Clause)", "BSD Three-Clause License"),
    "Zlib": ("zlib License", "zlib/libpng License", "zlib License (Zlib)", "zlib/libpng License (Zlib)",
             "zlib", "License: Zlib"),
}
#: Parties that disclaim, and that are not liable, in the BSD licences in use.
_PARTIES = (
    ("copyright holders and contributors", "copyright holder or contributors"),
    ("copyright holders and contributors", "copyright holders or contributors"),
    ("copyright holder and contributors", "copyright holder or contributors"),
    ("copyright holder and contributors", "copyright holders or contributors"),
    ("author and contributors", "author or contributors"), ("authors and contributors", "authors or contributors"),
    ("regents and contributors", "regents or contributors"), ("author", "author"), ("authors", "authors"),
    ("copyright holder", "copyright holder"), ("copyright holders", "copyright holders"))
_BSD_WORDS = tuple((("by the copyright holders and contributors", f"by the {by}"),
                    ("shall the copyright holder or contributors", f"shall the {liable}"))
                   for by, liable in _PARTIES)
_THIRD = "neither the name of the copyright holder nor the names of its contributors"
_THIRDS = tuple(((_THIRD, f"neither {x}"),) for x in (
    _THIRD[8:], "the name of the copyright holder nor the names of contributors",
    "the names of the copyright holders nor the names of its contributors",
    "the names of the copyright holders nor the names of their contributors",
    "the name of the copyright holders nor the names of its contributors",
    "the name of the author nor the names of its contributors",
    "the name of the author nor the names of contributors",
    "the name of the university nor the names of its contributors"))
_ISC_WORDS = (((), (("and or distribute", "and distribute"),)),
              tuple((("the author", x),) for x in ("the author", "the authors", "the copyright holder",
                                                   "the copyright holders")))
#: Wordings in use: of each tuple one set of (canonical words, words in their place) applies.
WORDINGS = {
    "MIT": (((), (("permission notice shall", "permission notice including the next paragraph shall"),)),
            tuple((("shall the authors or copyright holders", f"shall the {x}"),) for x in (
                "authors or copyright holders", "copyright holders or authors", "copyright holders", "authors"))),
    "ISC": _ISC_WORDS,
    "0BSD": _ISC_WORDS,
    "BSD-2-Clause": (_BSD_WORDS,),
    "BSD-3-Clause": (_BSD_WORDS, _THIRDS),
    "Zlib": (((), (("the authors be held", "the author be held"),)),),
}
#: List enumerators of the first, second and third condition; bullets leave none.
ENUMERATORS = (("1", "2", "3"), ("", "", ""), ("a", "b", "c"), ("i", "ii", "iii"))
#: How the listed conditions start, as canonical text, three to a licence (fixed values).
STARTS = ("redistributions of source code must", "redistributions in binary form must", "neither the name",
           "the origin of this software", "altered source versions", "this notice may not be removed")
_SPELT = " (" + "|".join(SPELLINGS) + ") "


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for copyright lines."""
    def spelt(x: Column) -> Column:
        made = x
        for word, standard in SPELLINGS.items():
            made = F.replace(made, F.lit(f" {word} "), F.lit(f" {standard.replace(' ', '  ')} "))
        return F.when(x.rlike(_SPELT), made).otherwise(x)

    def clean(low: Column) -> Column:
        # Two blanks between words: each word keeps its own pair.
        spaced = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
        plain = F.trim(F.regexp_replace(let(spaced, spelt), " +", " "))
        return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(plain)

    return let(F.lower(line), clean)


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != "")


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; how its lines are broken is no part of it."""
    return F.array_join(canonical_lines(text), " ")


def _worded(licence: str, body: str) -> set[str]:
    """Canonical text ``body`` in all wordings and with all enumerators in use."""
    out = set()
    for marks, *sets in product(ENUMERATORS, *WORDINGS.get(licence, ())):
        text = body
        for words, others in chain(*sets):
            text = text.replace(words, others)
        for k, start in enumerate(STARTS):
            text = text.replace(f" {k % 3 + 1} {start}", f" {marks[k % 3]} {start}".replace("  ", " "))
        out.add(text)
    return out


def texts() -> list[tuple[str, str]]:
    """(licence, text) of the published texts: whole, up to the end of the terms
    where instructions for use follow, and after their prefaces."""
    found = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text("utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        prefaced = [preface + text for preface in PREFACES.get(path.stem, ())]
        found += [(path.stem, x) for x in dict.fromkeys((text, terms, terms + end, *prefaced))]
    return found


def known_licences(spark: SparkSession, licences: dict[str, str] = LICENCES,
                   notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """(kind, digest, licence, n) of the given texts in their published forms
    (titles, wordings, enumerators), the texts in ``TEXTS`` and the notices; a
    digest that several have belongs to the first in code point order."""
    rows = [("form", k, v) for k, v in licences.items()]
    rows += [("title", k, the + t) for k, ts in TITLES.items() for t in ts for the in ("", "The ")]
    rows += [("text", k, v) for k, v in texts()]
    rows += [("notice", k, v) for k, lines in notices.items() for v in lines]
    given = spark.createDataFrame(rows, "kind string, licence string, text string")
    plain = given.select("kind", "licence", canonical(F.col("text")).alias("c")).collect()
    made = {(r.kind, r.licence, r.c) for r in plain if r.kind in ("text", "notice")}
    for r in plain:
        if r.kind == "form":
            titles = [t.c + " " for t in plain if (t.kind, t.licence) == ("title", r.licence)]
            made |= {("text", r.licence, t + body)
                     for t, body in product(["", *titles], _worded(r.licence, r.c))}
    known: dict[tuple[str, str], tuple[str, int]] = {}
    for kind, licence, c in sorted(made):
        known.setdefault((kind, sha256(c.encode()).hexdigest()), (licence, len(c)))
    return spark.createDataFrame([(*key, *value) for key, value in known.items()],
                                 "kind string, digest string, licence string, n int")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_sha256, licence, n_notices, notices) of every document.

    ``text_sha256`` is the digest of the canonical text, ``licence`` the known
    licence that is this text (null: none), ``n_notices`` the number of lines
    that are known notices and ``notices`` their licences, sorted, joined by
    commas. Null, empty and copyright-only texts have the empty canonical text
    and match nothing. Repeated rows are all scanned; extra columns are not
    read; no rows, no output.
    """
    spark = docs.sparkSession
    known = stored(known_licences(spark) if known is None else known, "licences")
    longest = known.where("kind = 'notice'").agg(F.max("n")).first()[0] or 0
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    # A line longer than every notice is none; the others are looked up.
    rows = stored(rows.select(
        "row", "doc_id", digest(F.array_join("lines", " ")).alias("text_sha256"),
        F.transform(F.filter("lines", lambda x: F.length(x) <= longest), digest).alias("short")),
        "licence-digests")
    keyed = rows.select("row", "doc_id", "text_sha256", F.explode(F.concat(
        F.array(F.struct(F.lit("text").alias("kind"), F.col("text_sha256").alias("digest"))),
        F.transform("short", lambda d: F.struct(F.lit("notice").alias("kind"), d.alias("digest")))
    )).alias("key")).select("row", "doc_id", "text_sha256", "key.kind", "key.digest")
    found = join_counted(keyed, known.drop("n"), ["kind", "digest"], "left")
    whole, notice = F.col("kind") == "text", F.col("kind") == "notice"
    out = found.groupBy("row", "doc_id", "text_sha256").agg(
        F.max(F.when(whole, F.col("licence"))).alias("licence"),
        F.count(F.when(notice, F.col("licence"))).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set(F.when(notice, F.col("licence")))), ",").alias("notices"))
    return out.drop("row")


def query(docs: DataFrame) -> DataFrame:
    """op3: licences and notices of all documents."""
    return scan(docs)
