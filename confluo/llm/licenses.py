"""License scans: whole texts looked up by the digest of a canonical form.

The canonical form folds case, drops copyright and SPDX lines, numbers of clauses and a title above the text, maps
equivalent spellings to one, calls whoever a clause names the copyright holder, and turns every run of punctuation and white space into a single space. Its SHA-256 is joined with the digests
of known licence texts, which get the same treatment, so both sides always agree.

The list of licences is a fixed table of a few rows; its size is checked before it is broadcast, and
a larger one, passed by the caller, is joined by shuffling digests only. Copies of one text can't make
a task large: the corpus is streamed past the table.

Defined results: null text has a null digest and no licence; a text with nothing left after
normalising has the digest of the empty string and no licence; a digest known under several names
reports the first in alphabetical order; repeated rows are each looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000

#: Lines that only say who holds the copyright, by a sign, a year or a reservation beside the word.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:(?:portions )?copyright[^\n]*(?:\(c\)|©|(?:19|20)[0-9][0-9]|all rights reserved)|(?:\(c\)|©)[^\n]*(?:19|20)[0-9][0-9]|all rights reserved)[^\n]*$"
#: Lines of a holder's name without sign or year, before case folding; the words of a name have capitals.
HOLDER_LINE = r"(?m)^[^A-Za-z0-9\n]*(?:Portions )?Copyright(?: \([Cc]\))?(?:[ ,]+(?:[A-Z][^\s,]*|and|of|the|by|&|<[^>\n]*>)){1,20}[ .,]*$"
#: A line that only names the licence, after case folding.
SPDX_LINE = r"(?m)^[^a-z0-9\n]*spdx-license-identifier:[^\n]*$"
#: Whose name may not be used, after punctuation and spelling.
NAMED = r" neither the name of (?:[^ ]+ ){1,12}?nor the names of its contributors "
NAMELESS = " neither the name of the copyright holder nor the names of its contributors "
#: Numbers of clauses, and titles above a text, after case folding, punctuation and spelling.
CLAUSE_NUMBER = r"(?:^|[\x09-\x0D\x20])\(?[0-9]{1,2}[.)][\x09-\x0D\x20]+"
TITLE = r"^(?:the )?(?:(?:mit|isc|zlib|expat|x11|(?:new |modified |simplified )?bsd|bsd (?:[0-3]|zero|two|three) clause(?: (?:new or revised|new|revised|modified|simplified|freebsd|open source))?|(?:[0-3]|zero|two|three) clause bsd) license|(?:[0-3]|zero|two|three) clause bsd)(?: (?:mit|isc|x11|expat|zlib))? "
#: Equivalent spellings, applied after case folding and punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("redistributions", "redistribution"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
#: Public licence texts and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
}
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED")
#: Digests of the canonical forms of long public licences, as Debian's base-files ships their texts.
DIGESTS = {
    "Apache-2.0": "8e4e942e6a956e12cf4cf6b39ea046c36d8b53d6582218a1a46d98caab74708d",
    "Artistic-1.0": "b4afa077d253371bcb30944c7a16b4385d4d6a3a4220363535165a4734387bae",
    "CC0-1.0": "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a",
    "GFDL-1.2": "2571514419b03e83e7ed91b7c676e655dff276f8c8f6df5d1adb1deccd3ac72d",
    "GFDL-1.3": "2a4c5405e7b7e7a7174fd452baa7affa7bf64459b479abcd366833d27ab6cb06",
    "GPL-1.0": "dcaed0a1339d5df23af0df7988f9a4094490f7be57bf99e7ade811de3351656d",
    "GPL-2.0": "29c781c1bb5cfa33259c972f7a5d81accdc4c6749b6edd46b1773fb2be0c2c3e",
    "GPL-3.0": "dd59e81db3259ec0447ef0884b417482f8ff0a0c80c3a64c65b9236290bbd9b5",
    "LGPL-2.0": "41e812bc7f7e722920e0118340d2470ee1009174cbf9f2baa962556c286575ed",
    "LGPL-2.1": "7e125e82dd44641085c9a5d4eef7e13ed3262cc816b38d8318eed4a5fe112fbb",
    "LGPL-3.0": "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525",
    "MPL-1.1": "dade53e58e59e1dbb025ebbd3ed89cbd209dc5a5490eed9da2b6f1d2b808e5ca",
    "MPL-2.0": "cf0cbde7aa46b215c9fa1eda48a097d574d70a04e3c2fab1c0b55f755160d0d6",
}


def canonical(text: Column) -> Column:
    held = F.regexp_replace(F.translate(text, "\r", "\n"), HOLDER_LINE, "")
    folded = F.translate(held, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, SPDX_LINE, ""), COPYRIGHT_LINE, ""), CLAUSE_NUMBER, " ")
    plain = F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F©‘-‟]+", " ")
    spaced = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for old, new in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {old} "), F.lit(f" {new} "))
    spaced = F.regexp_replace(spaced, NAMED, NAMELESS)
    return F.regexp_replace(F.trim(spaced), TITLE, "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license) of the given texts, or of those that are known here."""
    rows = spark.createDataFrame(sorted((texts or KNOWN).items()), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame([(d, name) for name, d in DIGESTS.items()], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, license (null if unknown)."""
    known = known_digests(docs.sparkSession) if known is None else known
    rows = docs.select(F.col(key).alias("doc_id"), digest(F.col(text)).alias("digest"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(known) if small else known, "digest", "left").select("doc_id", "digest", "license")
