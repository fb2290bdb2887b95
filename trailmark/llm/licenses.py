"""Licence scan by canonical digest lookup (native).

A text is brought to a canonical form (case, punctuation, copyright lines,
list marks, equivalent spellings, white space) and digested; known licences are
digested by the same expression, and a hash join of digests finds them. The
unit is the entire text; entire lines of the text are looked up in the same
table too, because documents often carry a licence notice as a line of prose.

The licence table is a parameter (license_id, text). Its size is checked before
it is broadcast: beyond ``BROADCAST_ROWS`` digests the join is left to Spark.

Defined cases: null or empty text, and text with nothing but copyright lines,
has the empty canonical form, which matches nothing; two known licences with one
canonical form: the first id in code point order wins; repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000

# Equivalent spellings (after lower-casing and the removal of punctuation).
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("noninfringement", "non infringement"),
    ("fulfil", "fulfill"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("recognise", "recognize"),
    ("whilst", "while"),
    ("gpl", "general public license"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)

# Texts, standard headers and notices known by default (texts of more than a few lines: ``license_texts``).
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE.")

#: Titles that a text may carry before it.
_TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause", "The BSD 3-Clause License", "New BSD License",
                     "BSD License"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def _apache_header(url: str) -> str:
    return ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
            f"License. You may obtain a copy of the License at\n{url}\nUnless required by applicable law or agreed to in writing, "
            "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
            "either express or implied. See the License for the specific language governing permissions and limitations under the License.")


def _gnu_header(thing: str, name: str, version: str, later: bool, mark: str, ending: str) -> str:
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return (f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by "
            f"the Free Software Foundation{',' if mark == ':' else ';'} {which}.\nThis {thing} is distributed in the hope that it will be "
            "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
            f"See the {name} for more details.\nYou should have received a copy of the {name} along with this {thing}{ending}")


#: Standard headers of source files (id, text).
_HEADERS = (
    *(("Apache-2.0", _apache_header(f"{scheme}://www.apache.org/licenses/LICENSE-2.0")) for scheme in ("http", "https")),
    *(("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
       f"distributed with this file, You can obtain one at {scheme}://mozilla.org/MPL/2.0/.") for scheme in ("http", "https")),
    *((f"{key}-{'or-later' if later else 'only'}", _gnu_header(thing, name, version, later, mark, ending))
      for key, name, version in (
          ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
          ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
          ("AGPL-3.0", "GNU Affero General Public License", "3"))
      for thing in ("program", "library") for later in (True, False) for mark in (":", ";")
      for ending in (*(f". If not, see <{scheme}://www.gnu.org/licenses/>." for scheme in ("http", "https")),
                     "; if not, see <https://www.gnu.org/licenses/>.",
                     "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
                     "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA.")),
)

#: Names of licences in notices of one line (id, names).
_NAMES = (
    ("MIT", ("MIT", "MIT License", "MIT License (MIT)")),
    ("ISC", ("ISC License",)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause License", "New BSD License", "Modified BSD License")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License",
                    "Apache 2.0", "Apache Software License 2.0")),
    ("Zlib", ("zlib License", "zlib/libpng License")),
    ("Unlicense", ("Unlicense",)),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0")),
    *((f"{short}-{version}.0", tuple(x for name in (f"{long}", f"GNU {long}") for x in (
        f"{name}, version {version}", f"{name} version {version}.0", f"{name} v{version}.0", f"{name} {version}", f"{name} {version}.0"))
       + (f"{short} {version}.0", f"{short}v{version}", f"GNU {short}v{version}", f"GNU {short} {version}.0", f"GNU {short} version {version}"))
      for short, long, version in (("GPL", "General Public License", 2), ("GPL", "General Public License", 3),
                                   ("LGPL", "Lesser General Public License", 3), ("AGPL", "Affero General Public License", 3))),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL 2.1", "LGPLv2.1")),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
    *((f"CC-{key}-{version}", (f"CC {key} {version}", f"CC-{key}-{version}", f"CC {key} {version} License",
                               f"Creative Commons {name} {version} International License"))
      for key, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                        ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for version in ("4.0",)),
)
_SUBJECTS = ("", *(f"This {x} is " for x in ("work", "project", "software")))
_VERBS = tuple(f"{x} under{terms}" for x in ("licensed", "released", "distributed") for terms in ("", " the terms of"))


def _full_texts() -> list[tuple[str, str]]:
    """The texts in ``license_texts`` (id.txt), as they are and with each paragraph in one line."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            text = f.read()
        forms = [text, text.replace("http://", "https://"), text.replace("https://", "http://")]
        end = "END OF TERMS AND CONDITIONS"
        if end in text:  # without the appendix on how to apply it
            forms += [x.split(end)[0] + end for x in forms]
        forms += ["\n".join(" ".join(p.split()) for p in x.split("\n\n")) for x in forms]
        key = name.removesuffix(".txt")
        heads = [""] if key not in _TITLES else [t + r for t in ("", *(f"{t}\n" for t in _TITLES[key])) for r in ("", "All rights reserved.\n")]
        out += [(key, head + x) for x in dict.fromkeys(forms) for head in heads]
    return out


def _notices() -> list[tuple[str, str]]:
    """Notices of one line: who is licensed under what, and SPDX tags."""
    out = []
    for key, names in _NAMES:
        for name in names:
            out += [(f"notice-{key}", f"{who}{verb} {the}{name}") for who in _SUBJECTS for verb in _VERBS for the in ("", "the ")]
        tags = (key, f"{key}-only", f"{key}-or-later", f"{key}+") if "GPL" in key else (key,)
        out += [(f"notice-{key}", f"SPDX-License-Identifier: {tag}") for tag in tags]
    return out


KNOWN = tuple(dict.fromkeys((
    ("MIT", "MIT License\nCopyright (c) year holders\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\nCopyright (c) year holders\n" + _ISC),
    ("ISC", _ISC),
    *((key, f"{title}\n{text}") for key, text in (("MIT", _MIT), ("ISC", _ISC)) for title in _TITLES[key]),
    *_full_texts(),
    *((f"notice-{key}", text) for key, text in _HEADERS),
    *_notices(),
    ("notice-all-rights-reserved", "All rights reserved."),
)))

# Patterns of the canonical form of a line (ASCII classes, so that any SQL engine agrees).
COPYRIGHT_LINE = r"^[ \t#*/;-]*(copyright|\(c\)|\x{A9})"
LIST_MARK = r"^[ \t]*(\(?[a-z0-9]{1,2}[.)]|[*+-])[ \t]+"
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Every spelling above holds one of these; a line without any needs no replacement.
_SPELLING_PARTS = ("licenc", "uthoris", "favour", "noninfr", "fulfil", "rganis", "recognis", "whilst", "gpl", "v2", "v3")


def canonical_line(line: Column) -> Column:
    """Canonical form of a lower-case line: words joined by one blank."""
    t = F.trim(F.regexp_replace(F.regexp_replace(line, LIST_MARK, ""), SEPARATORS, " "))
    fixed = F.concat(F.lit(" "), t, F.lit(" "))
    for old, new in SPELLINGS * 2:  # neighbours share a blank: the second pass takes those
        fixed = F.replace(fixed, F.lit(f" {old} "), F.lit(f" {new} "))
    fixed = F.trim(fixed)
    some = F.lit(False)
    for part in _SPELLING_PARTS:
        some = some | line.contains(part)
    return F.when(some, fixed).otherwise(t)


def canonical_lines(text: Column) -> Column:
    """Canonical forms of a text's lines, without copyright and empty lines."""
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    lines = F.filter(lines, lambda x: ~x.rlike(COPYRIGHT_LINE))
    return F.filter(F.transform(lines, canonical_line), lambda x: x != "")


def canonical(text: Column) -> Column:
    """Canonical form of an entire text: its lines' forms, joined by one blank."""
    return F.array_join(canonical_lines(text), " ")


def digest(canon: Column) -> Column:
    return F.when(F.length(canon) > 0, F.sha2(canon.cast("binary"), 256))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """(digest, license_id) of the licence table, and the lengths of its
    canonical forms (a text of another length can match none of them)."""
    if known is None:
        known = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    rows = known.select(F.col("license_id").alias("license_id"), canonical(F.col("text")).alias("_c"))
    rows = rows.select("license_id", digest(F.col("_c")).alias("_d"), F.length("_c").alias("_n"))
    rows = rows.filter("_d is not null").groupBy("_d").agg(F.min("license_id").alias("license_id"), F.first("_n").alias("_n"))
    size, lengths = rows.agg(F.count(F.lit(1)), F.collect_set("_n")).first()
    rows = rows.select("_d", "license_id")
    return (F.broadcast(rows) if size <= BROADCAST_ROWS else rows), sorted(lengths)


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, canonical_chars, digest, license_id (of the
    entire text, or null) and notices (sorted distinct ids of entire lines)."""
    table, lengths = known_digests(docs.sparkSession, known)
    near = lambda x: F.length(x).isin(lengths) if lengths else F.lit(False)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id", "text").alias("_k"),
                       canonical_lines(F.col("text")).alias("_lines"))
    rows = rows.select("doc_id", "_k", F.array_join("_lines", " ").alias("_c"), F.filter("_lines", near).alias("_near"))
    # lines of a known length are few; only they leave the document for the join
    rows = rows.select("doc_id", "_k", F.length("_c").cast("long").alias("canonical_chars"), digest(F.col("_c")).alias("_d"),
                       "_near")
    lines = rows.select("_k", F.explode("_near").alias("_line")).select("_k", digest(F.col("_line")).alias("_d"))
    notices = lines.join(table, "_d").groupBy("_k").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    out = rows.drop("_near").join(table, "_d", "left").join(notices, "_k", "left")
    return out.select("doc_id", "canonical_chars", F.col("_d").alias("digest"), "license_id",
                      F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
