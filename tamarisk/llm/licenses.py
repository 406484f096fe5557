"""Licence scans: canonical digests of entire texts, hash-joined to the digests of known licences and notices.

Spark SQL functions only. A text is brought to a canonical form - case, copyright lines, numbers of list items,
equivalent spellings, punctuation of any script and white space, comment marks and bullets among it - and its SHA-256
looked up. Whole documents are looked up, and each of their lines as a text of its own, so that one-line notices inside
longer documents are found.
"""

from __future__ import annotations

import hashlib
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm._common import stage

# Equivalent spellings, each replaced by the second form.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"),
    ("authorisation", "authorization"), ("organisation", "organization"), ("utilisation", "utilization"), ("recognised", "recognized"),
    ("favour", "favor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("fulfilment", "fulfillment"),
    ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http:", "https:"),
)

# Names that licences go by in notices.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}

# The sentences notices are made of.
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is licensed under the {}.", "This project is licensed under the {}.", "{}")

# Short licences in full, and the notices that Apache-2.0 and GPL-3.0 ask for.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}

# Title lines that the short licences come with, and the line that may stand between title and text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
RESERVED = "All rights reserved."

# Long licences in full, from files beside this one: where their text may begin besides the title, and end besides the file's end.
FILES = {
    "Apache-2.0": (("TERMS AND CONDITIONS FOR USE",), "END OF TERMS AND CONDITIONS"),
    "GPL-2.0": (("Preamble",), "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": (("Preamble",), "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0": (("This version of the GNU Lesser",), None),
    "MPL-2.0": (("1. Definitions",), None),
    "GPL-1.0": (("Preamble",), "END OF TERMS AND CONDITIONS"),
    "LGPL-2.0": (("Preamble",), "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": (("Preamble",), "END OF TERMS AND CONDITIONS"),
    "MPL-1.1": (("1. Definitions",), "EXHIBIT A"),
    "GFDL-1.2": (("0. PREAMBLE",), "ADDENDUM"),
    "GFDL-1.3": (("0. PREAMBLE",), "ADDENDUM"),
    "Artistic-1.0": (("Preamble",), None),
    "BSD-3-Clause": (("Redistribution and use",), None),
    "CC0-1.0": (("CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS NOT", "Statement of Purpose"), None),
}

#: A line that holds a copyright statement and nothing else, behind any comment mark; not a sentence of a licence that is wrapped before the word.
_COPYRIGHT_LINE = r"(^|\n)[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*(copyright(?![ \t]+(?:notices?|holders?|owners?|interests?|laws?)\b)|\(c\)|©)[^\n]*"
#: The number of a list item: behind the end of a sentence or the text's beginning, whatever lines and marks lie between.
_ITEM = r"(^|[.:;])([\x00-\x2D\x2F\x3C-\x60\x7B-\x7F]*)\b[0-9]{1,2}[.)]([ \t\r\n])"  # marks up to the last one, so that runs of dots cost no more
#: Licences up to which their table, of some 100 bytes a row, is broadcast.
BROADCAST_ROWS = 200_000
#: All that is no word: of ASCII, and the punctuation of Latin-1, of general use and of CJK (curly quotes, dashes, bullets, wide marks).
_PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}-\x{BF}\x{2000}-\x{206F}\x{25A0}-\x{25FF}\x{3000}-\x{303F}\x{FEFF}]+"


def canonical(text: F.Column) -> F.Column:
    """Lower case, no copyright lines or numbers of items, one spelling, words of letters and digits joined by one space."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "$1"), _ITEM, "$1$2$3")
    for form, kept in SPELLINGS:
        out = F.replace(out, F.lit(form), F.lit(kept))
    return F.trim(F.regexp_replace(out, _PUNCTUATION, " "))


def digest(text: F.Column) -> F.Column:
    return F.sha2(canonical(text), 256)


def full_texts() -> list[tuple[str, str]]:
    """(license, text): the licences in full, with and without title lines, the line of reserved rights and the annex."""
    short = [(k, "\n".join([title, *reserved, TEXTS[k]])) for k, titles in TITLES.items() for title in ("", *titles) for reserved in ((), (RESERVED,))]
    long = []
    for k, (begins, end) in FILES.items():
        text = files(__package__).joinpath("license_texts", f"{k}.txt").read_text("utf-8")
        for begin in (0, *(text.index(x) for x in begins)):
            long += [(k, text[begin:])] + ([(k, text[begin : text.index(end) + len(end)]), (k, text[begin : text.index(end)])] if end else [])
    return short + long


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(license, digest) of the licences and notices above, and of `more` (license, text). The fixed part is a few hundred rows."""
    rows = [(k, v) for k, v in TEXTS.items()] + full_texts() + [(k, form.format(name)) for k, names in NAMES.items() for name in names for form in NOTICES]
    texts = spark.createDataFrame(rows, "license string, text string")
    texts = texts.unionByName(more.select("license", "text")) if more is not None else texts
    return texts.select("license", digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: `key, whole_license, n_license_lines, line_licenses`.

    `whole_license` is the licence whose canonical digest the whole text has, else null. Lines are looked up the
    same way; `line_licenses` holds their licences, sorted and joined by commas, '' for none. Null and empty texts
    have none: an empty canonical form is no licence. Repeated rows get the same result each; keys need not be
    unique. Texts are taken whole, however long; an empty table gives no rows. Other columns are not read. The licence
    table is broadcast if its rows are counted to be few, so that lines meet it where they are; beyond that both shuffle.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = ["key", "_h", "_n"]
    ids = [F.col("key"), F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_n")]
    licenses = stage(licenses.select("digest", "license").where("digest is not null and license is not null"), "licenses")
    licenses = F.broadcast(licenses) if licenses.count() <= BROADCAST_ROWS else licenses
    whole = docs.select(*ids, digest(F.col("text")).alias("digest")).join(licenses, "digest", "left").select(*row, F.col("license").alias("whole_license"))
    # digests come out of the explode as values: filters on a column that is computed behind it would compute it again
    digests = F.posexplode_outer(F.transform(F.split("text", "\n"), digest)).alias("at", "digest")
    lines = docs.select(*ids, digests).where(F.col("digest") != hashlib.sha256(b"").hexdigest())
    found = lines.join(licenses, "digest").select(*row, "at", "license").distinct().groupBy(row).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("names"))
    same = F.col("w.key").eqNullSafe(F.col("l.key")) & (F.col("w._h") == F.col("l._h")) & (F.col("w._n") == F.col("l._n"))
    return whole.alias("w").join(found.alias("l"), same, "left").select(F.col("w.key").alias(key), "whole_license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))
