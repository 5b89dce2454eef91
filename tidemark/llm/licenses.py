"""Licence scans by canonical digests, in DataFrame expressions only.

A text is made canonical (case, copyright statements, punctuation and white space, equivalent
spellings), digested, and hash-joined to the digests of known licence texts and notices, which go
through the same expression.  Looked up are whole documents and every line of them, each as an
entire text.  The known table is a fixed list of some two hundred rows, so its digests are broadcast and
no document is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Spellings that mean the same in a licence, of single words and of several.
WORDS = (("licence", "license"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"), ("https", "http"))
PHRASES = (
    ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("all rights reserved", ""),
)
#: A line that states a copyright: it opens with the word or sign and has the sign or a year.  What stands
#: behind a full stop in it and begins with a capital is no longer part of the statement.
COPYRIGHT = r"""(?im)^[^\p{L}\p{N}(\n]*(?:copyright|\(c\))[^\n]*?(?:\(c\)|[0-9]{4})[^\n]*?(?:[\p{L}\p{N}>)]{2}\.[ \t]+((?-i:[\p{Lu}"]))|$)"""
NOT_WORD_OR_BREAK = r"[^\p{L}\p{N}\n]+"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_BODY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_BODY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
    "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Short licence texts and customary notices, by SPDX identifier.
LISTED = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_BODY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_BODY),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_BODY),
    ("BSD-3-Clause", _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_BODY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: Customary title lines of texts that have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "The BSD License", "BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Revised BSD License", "Modified BSD License", "The BSD License", "BSD License", "BSD-3-Clause"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSL-1.0": (),
}
APPENDIX = re.compile(r"^[ ]*(?:APPENDIX: How to apply|(?:Appendix: )?How to Apply These Terms)", re.M | re.I)
BLANK_OWNER = re.compile(r"^[ ]*Copyright [\[{<]yyyy.*$", re.M)
NUMBERED = re.compile(r"\b[1-4]\. (?=Redistributions|Neither)")


def _standard() -> Iterator[tuple[str, str]]:
    """(license_id, text) of the files in ``license_texts``: a file is named for all ids that its text stands for, joined by ``+``; what follows ``@`` tells versions apart."""
    for file in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        for name in file.name.removesuffix(".txt").partition("@")[0].split("+"):
            yield name, text


def _variants(name: str, text: str) -> Iterator[tuple[str, str]]:
    """A text as it is, and in the other forms in which it is customarily given."""
    appendix = APPENDIX.search(text)
    bodies = [text, BLANK_OWNER.sub("", text), *([text[: appendix.start()]] if appendix else [])]
    bodies += [re.sub(r"\s*END OF TERMS AND CONDITIONS\s*\Z", "\n", b) for b in bodies]
    if name in ("BSD-2-Clause", "BSD-3-Clause"):
        bodies.append(NUMBERED.sub("", text))
    elif name in ("ISC", "0BSD"):
        bodies.append(text.replace("and/or distribute", "and distribute"))
    elif name == "BSL-1.0":
        bodies.append(text.partition("\n")[2])
    for body in dict.fromkeys(bodies):
        yield name, body
        if len(text) > 300:
            yield from ((name, f"{title}\n\n{body}") for title in TITLES.get(name, ()))


#: (license_id, text) of all that is looked for; another table of this form can be given.
KNOWN = tuple(dict.fromkeys(v for name, text in (*LISTED, *_standard()) for v in _variants(name, text)))


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def _words(text: Column, stated: bool = False) -> Column:
    """The words of every line in lower case and common spelling, without copyright statements (``stated``: with them)."""
    signed = F.replace(text, F.lit("©"), F.lit("(c)"))
    kept = signed if stated else F.regexp_replace(signed, COPYRIGHT, "$1")
    return _replaced(F.regexp_replace(F.lower(kept), NOT_WORD_OR_BREAK, " "), WORDS)


def _spelt(words: Column) -> Column:
    """Phrases in common spelling, which no line break may part any more."""
    return F.regexp_replace(_replaced(words, PHRASES), " +", " ")


def _joined(words: Column) -> Column:
    """All lines as one, then the phrases: however a text is wrapped, it reads alike."""
    return F.trim(_spelt(F.regexp_replace(words, "[ \n]+", " ")))


def canonical(text: Column, stated: bool = False) -> Column:
    """The words of a text in lower case and common spelling, without copyright statements (``stated``: with them)."""
    return _joined(_words(text, stated))


def licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """One row of ``key``, ``scope``, ``line_no`` and ``license_id`` for each entire text found.

    ``scope`` is ``text`` for a whole document (``line_no`` 0) or ``line`` for a line of one,
    numbered from 1.  A whole document is looked up without the lines that state copyrights and with
    them, since a statement that was wrapped can't be told from text.  Null, empty and merely punctuated texts match nothing.  Repeated rows are
    found once each; a licence listed in two spellings counts once, and a text that stands for
    several licences (the GPL alone or with later versions) gives a row for each.  Other columns are not read,
    and an empty table gives an empty table.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(list(known), "license_id string, known string")
    digests = lambda stated: F.sha2(canonical(F.col("known"), stated), 256)
    table = given.select("license_id", F.explode(F.array(digests(False), digests(True))).alias("digest"))
    table = table.groupBy("digest").agg(F.sort_array(F.collect_set("license_id")).alias("ids"))  # some hundred rows

    def entire(words: Column) -> Column:
        """The canonical whole text and lines: what is done to every character is done once."""
        lines = F.transform(F.split(_spelt(words), "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.trim(x).alias("entire"), F.lit(None).cast("string").alias("stated")))
        stated = _joined(_words(F.col(text), stated=True))
        return F.concat(F.array(F.struct(F.lit(0).alias("line_no"), _joined(words).alias("entire"), stated.alias("stated"))), lines)

    each = docs.where(F.col(text).isNotNull()).select(F.col(key), F.explode(let(_words(F.col(text)), entire)).alias("e"))
    each = each.select(key, F.col("e.line_no").cast("long").alias("line_no"), F.sha2("e.entire", 256).alias("digest"), F.sha2("e.stated", 256).alias("whole"))
    scope = F.when(F.col("line_no") == 0, "text").otherwise("line")
    found = each.join(F.broadcast(table), "digest", "left").join(F.broadcast(table.select(F.col("digest").alias("whole"), F.col("ids").alias("more"))), "whole", "left")
    none = F.array().cast("array<string>")
    return found.select(key, scope.alias("scope"), "line_no", F.explode(F.array_union(F.coalesce("ids", none), F.coalesce("more", none))).alias("license_id"))
