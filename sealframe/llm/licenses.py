"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact shingle containment verifies.

Templates are cut into pieces of 1, 2, 4, ... shingles (five words each), and texts into overlapping windows of the same
sizes, so that a window over a copy of a piece has nearly the piece's shingles. With a step of a quarter of the size, the
nearest window shares at least 7 of 9 shingles with an exact copy, and with one that has 0.8 of the template's shingles at
least about half. Each of BANDS bands is one MinHash, so the chance to miss that is 0.5 ** BANDS, below 0.0003.

Only windows with a shingle of some template can share a MinHash with a piece, so the others are left out before any
MinHash is made. All steps are built-in functions, joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealframe.llm.shared import SPACE, cut, opaque, small

SHINGLE, CONTAINMENT = 5, 0.8
#: Bands of one MinHash each; sizes of windows, in shingles.
BANDS, SIZES = 12, (1, 2, 4, 8, 16)
#: Templates, at most, which bounds what is broadcast.
MOST = 2_000
#: The part of a license's name that is its family, once the letters before GNU's are gone.
FAMILY, GNU = "^[A-Za-z]+", "^[AL]GPL"

#: Characters that a scan takes as spaces: marks don't matter. Digits do, as versions are told apart by them.
IGNORED = ".,;:!?()[]{}<>\"'`|*#&_-/\\=+~@$%^"

_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."

#: Texts and notices of public licenses. Their names' first letters are their families.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(name="General Public License", version="2")),
    ("GPL-3.0", _GNU.format(name="General Public License", version="3")),
    ("LGPL-2.1", _GNU.format(name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", _GNU.format(name="Lesser General Public License", version="3")),
    ("AGPL-3.0", _GNU.format(name="Affero General Public License", version="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)


def words_of(text: Column) -> Column:
    """Lower-cased words without marks; none for null."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), IGNORED, " " * len(IGNORED))
    return F.filter(F.split(plain, SPACE), lambda x: x != "")


def shingle_hashes(words: Column) -> Column:
    """Hashes of all shingles in order; of all words together if there are fewer."""
    n = F.size(words)
    all_of = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(n >= SHINGLE, all_of).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<long>"))


def bands(shingles: Column) -> Column:
    """The MinHashes of a window's shingles, one for each band."""
    least = lambda k: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k))))
    return F.array(*map(least, range(BANDS)))


def templates(spark: SparkSession, notices: Sequence[tuple[str, str]] | DataFrame = NOTICES) -> DataFrame:
    """template (number), license, shingles (distinct hashes), in_order; of at most MOST templates, else an error."""
    if isinstance(notices, DataFrame):
        rows = [(r["license"], r["text"]) for r in notices.select("license", "text").limit(MOST + 1).collect()]
        notices = sorted(rows, key=lambda r: (r[0] or "", r[1] or ""))
    if len(notices) > MOST:
        raise ValueError(f"more than {MOST} templates")
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(notices)], "template int, license string, text string")
    return cut(rows.withColumn("words", words_of(F.col("text"))).select("template", "license", shingle_hashes(F.col("words")).alias("in_order")).where("size(in_order) > 0").withColumn("shingles", F.array_distinct("in_order")))


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] | DataFrame = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, template, n_shingles (of the template), n_found, containment: a row for each template that a row of docs holds.

    Of templates of one family, such as versions of a license, the one with the highest containment counts, and of those
    the longest; of ties all. notices: (license, text), also as a table of these columns. Null, empty and short texts hold
    none, and texts of any length are read whole. Each row of docs is scanned by itself, so null and repeated doc_ids are
    kept as they are; other columns are ignored; an empty table gives no rows, and so do no notices.
    """
    known = templates(docs.sparkSession, notices)
    wanted = [r[0] for r in known.select(F.explode("shingles")).distinct().collect()]  # of at most MOST templates
    n = F.size("shingles")
    pieces = known.select("template", F.col("in_order").alias("shingles")).withColumn("size", F.array_max(F.filter(F.array(*(F.lit(s) for s in SIZES)), lambda s: s <= n)))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1, F.col("size")), lambda i: F.least(i, n - F.col("size"))))
    pieces = pieces.select("template", "size", F.explode(starts).alias("at"), "shingles").select("template", "size", F.posexplode(bands(F.slice("shingles", F.col("at") + 1, F.col("size")))).alias("band", "least"))
    pieces = cut(pieces.distinct())
    hashed = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words")).select("doc_id", opaque(shingle_hashes(F.col("words"))).alias("shingles"))
    held = hashed.where(F.arrays_overlap("shingles", F.lit(wanted).cast("array<long>")))
    held = cut(held.withColumn("row", F.monotonically_increasing_id()))
    hit = F.filter(F.transform("shingles", lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
    found = held.select("row", "shingles", hit.alias("hits"))
    step = lambda s: max(1, s // 4)
    # windows of a size begin at multiples of its step; those over a hit are the last ones that begin at or before it
    around = lambda s: F.array_distinct(F.flatten(F.transform("hits", lambda p: F.filter(F.array(*((F.floor(p / step(s)) - k) * step(s) for k in range(-(-s // step(s))))), lambda at: (at >= 0) & (at + s > p)))))
    sized = lambda s: F.transform(around(s), lambda at: F.struct(F.lit(s).alias("size"), at.cast("int").alias("at")))
    windows = F.flatten(F.array(*map(sized, SIZES)))
    each = found.select("row", "shingles", F.explode(windows).alias("w")).select("row", F.col("w.size").alias("size"), F.slice("shingles", F.col("w.at") + 1, F.col("w.size")).alias("inside"))
    marked = each.select("row", "size", F.posexplode(bands(F.col("inside"))).alias("band", "least"))
    pairs = marked.join(small(pieces), ["size", "band", "least"]).select("row", "template").distinct()
    of = known.select("template", "license", F.col("shingles").alias("of"))
    full = pairs.join(held, "row").join(F.broadcast(of), "template")  # a row for each configured notice
    out = full.select("row", "doc_id", "license", "template", F.size("of").alias("n_shingles"), F.size(F.array_intersect("of", "shingles")).alias("n_found"))
    out = out.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= CONTAINMENT)
    # at most MOST rows in a window: templates of one family in one text
    of_family = Window.partitionBy("row", F.regexp_extract(F.regexp_replace("license", GNU, "GPL"), FAMILY, 0)).orderBy(F.desc("containment"), F.desc("n_shingles"))
    return out.withColumn("rank", F.rank().over(of_family)).where("rank = 1").drop("row", "rank")


def digests(docs: DataFrame) -> DataFrame:
    """Every notice of every document, with its exact containment."""
    return scan(docs)


#: The same by brute force, in DuckDB's SQL: each text's distinct shingles against each notice's.
SQL = """
with notices(template, license, text) as (values {notices}),
both_ as (select null::bigint as template, doc_id, row_number() over () as rn, text from documents union all select template, null, 0, text from notices),
worded as (select template, doc_id, rn, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{ignored}', '{blanks}'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as w from both_),
shingled as (select template, doc_id, rn, case when len(w) >= {k} then list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from worded),
of_ as (select s.template, n.license, s.s from shingled s join notices n on s.template = n.template),
one as (select template, license, len(s) as n_shingles, unnest(s) as x from of_),
text_ as (select doc_id, rn, unnest(s) as x from shingled where template is null),
found as (select rn, doc_id, license, template::int as template, n_shingles::int as n_shingles, count(*)::int as n_found, count(*) / n_shingles as containment
from text_ join one using (x) group by doc_id, rn, license, template, n_shingles having count(*) / n_shingles >= {least})
select doc_id, license, template, n_shingles, n_found, containment from found qualify rank() over (partition by rn, regexp_extract(regexp_replace(license, '{gnu}', 'GPL'), '{family}') order by containment desc, n_shingles desc) = 1
""".format(
    notices=", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(NOTICES)), ignored=IGNORED.replace("'", "''"), blanks=" " * len(IGNORED), k=SHINGLE, least=CONTAINMENT, family=FAMILY, gnu=GNU
)
