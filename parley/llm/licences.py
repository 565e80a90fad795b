"""Licence scans by canonical digest, with DataFrame functions only.

A text is made canonical: lower case, copyright lines and list marks out, equivalent spellings made one ("licence" and
"license"), everything but letters and digits turned into one space. The sha256 of that is its digest. Entire texts are
hash-joined to the digests of known licences. A document can also carry a licence as a notice among other text, so each
line, being a text of its own, is looked up in the same way.

A copyright line is one that begins with "copyright" or a sign and goes on with a sign, a year, a placeholder, or has a
year soon after, with the lines right below it that begin with "(c)"; so wrapped text that happens to begin a line with "copyright notice" stays. A line of more than
COPYRIGHT_MOST characters after that is text in one line, and loses only the statement up to its first full stop.

Lines are first joined by their first word to the first words that the known texts can begin with, so only lines that may
match are made canonical; whatever table of known texts a caller passes decides that. These words are counted, and broadcast
if they are no more than MOST_FIRSTS; otherwise all lines are digested. What matched is grouped by document: the texts themselves are
never shuffled, and of the known digests Spark's own size check decides.

Defined results: a null text is the empty text and matches nothing, as does a text that is empty once canonical; repeated
rows of one doc_id make one row, in which their notices add up; rows without doc_id count as one document; a digest of
several licences gets the least name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import table, whole_text

# Equivalent spellings, each with the one that stands for it, as whole words of the canonical text.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencee", "licensee"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("owner", "holder"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("https", "http"),
)

# Entire texts of known licences, with the titles that may stand above them.
TEXTS = (
    (
        "MIT",
        ("MIT License", "The MIT License", "The MIT License (MIT)"),
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "MIT-0",
        ("MIT No Attribution",),
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        ("ISC License", "The ISC License"),
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        ("BSD Zero Clause License", "Zero-Clause BSD"),
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        ("zlib License", "The zlib/libpng License"),
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-2-Clause",
        ("BSD 2-Clause License", "The 2-Clause BSD License"),
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        ("BSD 3-Clause License", "The 3-Clause BSD License"),
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        ("The Unlicense",),
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "BSL-1.0",
        ("Boost Software License - Version 1.0 - August 17th, 2003",),
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)

# The notices by which licences are named.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

#: All known (license, text): each entire text alone and below each of its titles, and the notices.
KNOWN = tuple((name, f"{title}\n\n{body}") for name, titles, body in TEXTS for title in ("", *titles)) + NOTICES

COPYRIGHT_MOST = 160
#: With more first words than this all lines are digested.
MOST_FIRSTS = 10_000
# What a copyright statement begins with, in lower case.
_STATEMENT = r"(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|copyright[ \t][^\n]{0,80}\b(?:19|20)[0-9][0-9]\b|\(c\)[ \t]*(?:copyright|[0-9<\[{])|©)"
COPYRIGHT_LINE = rf"^[^a-z0-9\n]*(?:{_STATEMENT}[^\n]{{0,{COPYRIGHT_MOST}}}(?:\n[^a-z0-9\n]*c\)[^\n]{{0,{COPYRIGHT_MOST}}})*|all rights reserved[^a-z0-9\n]*)$"
COPYRIGHT_START = rf"^[^a-z0-9\n]*{_STATEMENT}[^.\n]*(?:\.|$)"
_MARK = r"(?:[0-9]{1,2}[.)]|\([0-9a-z]\))[ \t]"
LIST_MARK = rf"(?:^|[.:;,])[ \t]*{_MARK}"  # at a line's start, or after a sentence where all stands in one line
_APART = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    low = F.lower(text)
    bare = low
    for pattern in (COPYRIGHT_LINE, COPYRIGHT_START):
        bare = F.regexp_replace(bare, f"(?md){pattern}", " ")
    signs = [low.contains(x) for x in ("copyright", "(c)", "©", "all rights reserved")]  # most texts hold none
    low = F.when(signs[0] | signs[1] | signs[2] | signs[3], bare).otherwise(low)
    low = F.regexp_replace(low, f"(?md){LIST_MARK}", " ")
    plain = F.trim(F.regexp_replace(low, _APART, " "))
    out = plain
    for spelling, one in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{spelling}\b", one)
    spelled = r"\b(?:" + "|".join(spelling for spelling, _ in SPELLINGS) + r")\b"
    return F.when(plain.rlike(spelled), out).otherwise(plain)  # most texts need one search and no replacement


def digest(text: Column) -> Column:
    """The digest of a text's canonical form; null where that form is empty."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_texts(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """license, text, of the caller or of this module."""
    return known.select("license", "text") if known is not None else spark.createDataFrame(list(KNOWN), "license string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """known_digest, license: one row for each digest."""
    found = known.select(digest(F.col("text")).alias("known_digest"), "license").where("known_digest is not null")
    return found.groupBy("known_digest").agg(F.min("license").alias("license"))


def first_words(known: DataFrame) -> DataFrame:
    """first: the words that the canonical form of a known text begins with, equivalent spellings included."""
    of = known.select(F.split(canonical(F.col("text")), " ")[0].alias("first"))
    spelled = [F.when(F.col("first") == one.split(" ")[0], spelling.split(" ")[0]) for spelling, one in SPELLINGS]
    return of.select(F.explode(F.array_compact(F.array("first", *spelled))).alias("first")).where("first != ''").distinct()


def pieces(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, line (0: the entire text; k: its k-th line) and the digest, of each text and of each line that may match."""
    text = whole_text()
    entire = F.array(F.struct(F.lit(0).alias("line"), text.alias("text")))
    lines = F.transform(F.split(text, "\n"), lambda line, k: F.struct((k + 1).alias("line"), line.alias("text")))
    each = docs.select("doc_id", F.inline(F.concat(entire, lines)))
    # a list mark or a copyright statement hides the first word; such lines are few, and all of them are digested
    bare = F.lower("text").rlike(rf"^[^\p{{L}}\p{{N}}]*(?:{_MARK}|copyright|c\)|©)")
    told = F.when(F.col("line") > 0, F.when(bare, "*").otherwise(F.regexp_extract(F.lower("text"), _WORD, 0)))
    firsts = first_words(known)
    if firsts.limit(MOST_FIRSTS + 1).count() > MOST_FIRSTS:
        return each.select("doc_id", "line", digest(F.col("text")).alias("digest"))
    may = F.broadcast(firsts.select("first", F.lit(True).alias("may")))
    met = each.withColumn("told", told).join(may, F.col("told") == F.col("first"), "left").where("line = 0 or may or told = '*'")
    return met.select("doc_id", "line", digest(F.col("text")).alias("digest"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_license, notices, n_notices.

    known: license, text; this module's where it is not given. text_license: the licence that the entire text is; notices: the
    licences that its lines name, sorted, comma-joined (empty: none); n_notices: lines that are such a notice.
    """
    known = known_texts(docs.sparkSession, known)
    found = pieces(docs, known).join(known_digests(known), F.col("digest") == F.col("known_digest"), "left")
    out = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("line") == 0, F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.col("license")))), ",").alias("notices"),
        F.count(F.when(F.col("line") > 0, F.col("license"))).alias("n_notices"),
    )
    return out


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_digest(text: str) -> str:
    form = f"lower({text})"
    for pattern in (COPYRIGHT_LINE, COPYRIGHT_START, LIST_MARK):
        form = f"regexp_replace({form}, '(?m){pattern}', ' ', 'g')"
    form = f"trim(regexp_replace({form}, '{_APART}', ' ', 'g'))"
    for spelling, one in SPELLINGS:
        form = rf"regexp_replace({form}, '\b{spelling}\b', '{one}', 'g')"
    return f"nullif(sha256({form}), sha256(''))"


def sql() -> str:
    """The rows of op2 in DuckDB, where every line is digested."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""with known as (select {_sql_digest("t")} as known_digest, min(license) as license from (values {values}) k(license, t) group by 1),
    lines as (select doc_id, 0 as line, coalesce(text, '') as t from documents union all
        select doc_id, 1 as line, unnest(string_split(coalesce(text, ''), chr(10))) as t from documents),
    pieces as (select doc_id, line, {_sql_digest("t")} as digest from lines)
    select doc_id, min(case when line = 0 then license end) as text_license,
        coalesce(string_agg(distinct case when line > 0 then license end, ',' order by case when line > 0 then license end), '') as notices,
        count(case when line > 0 then license end) as n_notices
    from pieces left join known on digest = known_digest group by doc_id"""
