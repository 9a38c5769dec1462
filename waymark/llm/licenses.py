"""Licence scans: Dice coefficient over word bigrams between texts and licence templates, in DataFrame operations only.

The units compared are every line of a document, the whole document if it has several lines and, for a licence that none of
these match, the span of the document's words with the highest coefficient (wrapped comment headers, notices inside a
long line; one unit a licence). Text is lower-cased and cut into words of letters and digits; a unit is its set of word bigrams.
With sizes a and b the coefficient is at most 2 min(a, b) / (a + b), so a template of size b can only match
units of t/(2-t) b to (2-t)/t b bigrams: units outside all ranges are dropped before their
bigrams are laid out, and a bigram meets only templates whose range holds its unit.
A span can only match if the document holds t/(2-t) b of the template's b bigrams. In the few documents that do, a best
span starts and ends at shared bigrams; one pass from each of them, over (2-t)/t times the template's length, counts the
distinct and the shared bigrams (those whose last occurrence lies before the start).

Defined results: null, empty and one-word texts match nothing; repeated rows get equal results; ties between templates go to the
first name; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import materialize, text_or_empty

THRESHOLD = 0.8
#: Template bigrams up to which they are sent to every task (24 bytes each).
BROADCAST_ROWS = 200_000
#: Distinct size ranges of templates up to which units are held against each of them before their bigrams are laid out.
RANGES = 500
NOT_WORDS = r"[^\p{L}\p{N}]+"

# Licence notices and texts.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        'appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/."
    ),
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense notice": 'This is free and unencumbered software released into the public domain.',
    "Unlicense": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source '
        'code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this '
        'software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our '
        'heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE '
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        'NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN '
        'CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must '
        'retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of '
        'conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND '
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
        'DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT '
        'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN '
        'CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must '
        'retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of '
        'conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its '
        'contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND '
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
        'DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT '
        'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN '
        'CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        'Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following '
        'restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an '
        'acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as '
        'being the original software. 3. This notice may not be removed or altered from any source distribution.'
    ),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") '
        'to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is '
        'furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the '
        'following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are '
        'solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        'INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE '
        'DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE '
        'OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "MPL-2.0 notice": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at '
        'https://mozilla.org/MPL/2.0/.'
    ),
    "EPL-2.0 notice": 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    "GPL-2.0 header": (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either '
        'version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied '
        'warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public '
        'License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.'
    ),
    "LGPL-2.1 header": (
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; '
        'either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU '
        'Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.'
    ),
    "LGPL-3.0 header": (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; '
        'either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU '
        'Lesser General Public License along with this program; if not, see <https://www.gnu.org/licenses/>.'
    ),
    "AGPL-3.0 header": (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; '
        'either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the '
        'implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU '
        'Affero General Public License along with this program; if not, see <https://www.gnu.org/licenses/>.'
    ),
    "CC0-1.0 notice": (
        'To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed '
        'without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this work. If not, see https://creativecommons.org/publicdomain/zero/1.0/.'
    ),
    "CC-BY-SA-4.0 notice": 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORDS), "")


def _bigrams(w: Column, n: Column) -> Column:
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))).otherwise(F.array().cast("array<bigint>"))


def _sets(df: DataFrame) -> DataFrame:
    """df (unit text in __u) with its bigram set b and size nb."""
    d = df.withColumn("__w", words_of(F.col("__u"))).drop("__u").withColumn("__n", F.size("__w"))
    return d.withColumn("b", _bigrams(F.col("__w"), F.col("__n"))).drop("__w", "__n").withColumn("nb", F.coalesce(F.size("b"), F.lit(0)))


def _merged(ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted size ranges put together where they meet; of more than RANGES, the whole extent."""
    if len(ranges) > RANGES:
        return [(0.0, float("inf"))]
    out: list[tuple[float, float]] = []
    for lo, hi in ranges:
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def matches(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(__id, __rid, unit, license, dice): units of distinct texts with a template at or above the threshold. unit -1 is the whole text, -2 a span."""
    length = F.greatest(F.size(words_of(F.col("text"))) - 1, F.lit(0)).alias("tn")
    t = materialize(_sets(known.select("license", length, F.col("text").alias("__u"))).filter("nb > 0"), "templates")
    low, high = F.lit(threshold / (2 - threshold)), F.lit((2 - threshold) / threshold)
    grams = t.select("license", "tn", F.col("nb").alias("tb"), (low * F.col("nb") - 1e-9).alias("lo"), (high * F.col("nb") + 1e-9).alias("hi"), F.explode("b").alias("h"))
    ranges = _merged([(r.lo, r.hi) for r in grams.select("lo", "hi").distinct().orderBy("lo").limit(RANGES + 1).collect()])
    if grams.count() <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    lines = F.split(F.col("__t"), "\n")
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col, text_col).alias("__rid"), text_or_empty(F.col(text_col)).alias("__t"))
    units = texts.withColumn("__row", F.monotonically_increasing_id()).withColumn("__l", lines).withColumn("__l", F.when(F.size("__l") > 1, F.concat("__l", F.array("__t"))).otherwise(F.col("__l"))).drop("__t")
    units = units.withColumn("__k", F.size("__l"))
    # outer: the plain form puts a filter on the array's size below, where it would be computed twice
    units = units.select("__id", "__rid", "__row", "__k", F.posexplode_outer("__l").alias("__p", "__u"))
    units = units.withColumn("whole", F.col("__p") == F.col("__k") - 1)
    units = units.withColumn("unit", F.when((F.col("__k") > 1) & F.col("whole"), F.lit(-1)).otherwise(F.col("__p"))).drop("__k", "__p")
    # no filter on nb: Spark would push it below, where the bigrams would be computed twice
    fits = reduce(or_, [F.col("nb").between(lo, hi) for lo, hi in ranges], F.lit(False))
    sets = _sets(units).withColumn("b", F.when(fits | F.col("whole"), F.col("b")))
    sized = (F.col("nb") >= F.col("lo")) & (F.col("nb") <= F.col("hi"))
    met = sets.select("__id", "__rid", "__row", "unit", "whole", "nb", F.explode_outer("b").alias("h")).join(grams, "h").filter(F.col("whole") | sized)
    # bigrams of a unit are distinct; rows are told apart, so that repeated ones do not add up
    met = met.groupBy("__id", "__rid", "__row", "unit", "whole", "nb", "license", "tn", "tb", "lo", "hi").agg(F.count("*").alias("both"))
    met = met.withColumn("dice", 2 * F.col("both") / (F.col("nb") + F.col("tb"))).withColumn("found", sized & (F.col("dice") >= threshold))
    met = materialize(met.filter(F.col("found") | (F.col("whole") & (F.col("both") >= F.col("lo")))), "licenses-met")
    found = met.filter("found").select("__id", "__rid", "unit", "license", "dice").distinct()
    same = ["__rid", "license"]  # __rid tells ids and texts apart
    wanted = materialize(met.filter("whole").select("__id", "__rid", "license", "tn", "tb").distinct().join(found.select(*same).distinct(), same, "left_anti"), "licenses-wanted")
    return found if wanted.isEmpty() else found.unionByName(_spans(texts, wanted, grams, threshold))


def _spans(texts: DataFrame, wanted: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """(__id, __rid, unit, license, dice): the best span of each text (__rid, __t) for each licence of wanted (__id, __rid, license, tn, tb)."""
    own = texts.join(wanted.select("__rid").distinct(), "__rid", "left_semi").select("__rid", words_of(F.col("__t")).alias("__w")).dropDuplicates(["__rid"])
    at = own.select("__rid", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("__w") - 2), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1)))).alias("pos", "h"))
    at = at.withColumn("last", F.coalesce(F.lag("pos").over(W.partitionBy("__rid", "h").orderBy("pos")), F.lit(-1)))
    marked = at.join(wanted, "__rid").join(grams.select("license", "h", F.lit(True).alias("hit")), ["license", "h"], "left")
    rows = marked.groupBy("__id", "__rid", "license", "tn", "tb").agg(F.array_sort(F.collect_list(F.struct("pos", "last", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("seq"))
    longest = F.floor((2 - threshold) / threshold * F.col("tn") + 1e-9).cast("int")

    def best_from(start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            new = x["last"] < start
            size, both = acc["size"] + new.cast("int"), acc["both"] + (new & x["hit"]).cast("int")
            return F.struct(size.alias("size"), both.alias("both"), F.greatest(acc["best"], 2 * both / (size + F.col("tb"))).alias("best"))

        return F.aggregate(F.slice("seq", start + 1, longest), F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0.0).alias("best")), step, lambda acc: acc["best"])

    starts = F.transform(F.filter("seq", lambda x: x["hit"]), lambda x: x["pos"])
    best = rows.select("__id", "__rid", F.lit(-2).alias("unit"), "license", F.array_max(F.transform(starts, best_from)).alias("dice"))
    return best.filter(F.col("dice") >= threshold)


def scan(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, licenses, best_license, best_dice of every document."""
    known = templates(docs.sparkSession) if known is None else known
    found = matches(docs.select("doc_id", "text"), known, threshold=threshold)
    best = found.groupBy("__id", "__rid").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("license")), ", ").alias("licenses"),
        F.min(F.struct((-F.round("dice", 9)).alias("d"), F.col("license"))).alias("top"),
    ).select(F.col("__id").alias("b_id"), F.col("__rid").alias("b_rid"), "n", "licenses", F.col("top.license").alias("best_license"), (-F.col("top.d")).alias("best_dice"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__rid"))
    return rows.join(best, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("__rid") == F.col("b_rid")), "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), "best_license", "best_dice"
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB: every unit against every template, without pruning."""
    values = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH known(license, text) AS (VALUES {values}),
t AS (SELECT license, {grams} AS b FROM (SELECT license, {words.format('text')} AS w FROM known)),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM docs
  UNION ALL SELECT doc_id, text FROM docs WHERE contains(text, chr(10))
),
s AS (SELECT doc_id, {grams} AS b FROM (SELECT doc_id, {words.format('u')} AS w FROM units) WHERE len(w) > 1),
m AS (
  SELECT doc_id, license, 2 * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice FROM s, t
  WHERE 2 * least(len(s.b), len(t.b)) >= {threshold} * (len(s.b) + len(t.b)) - 1e-9
),
g AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ', ') AS licenses,
         round(max(dice), 9) AS best_dice, arg_min(license, (-round(dice, 9), license)) AS best_license
  FROM m WHERE dice >= {threshold} GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM docs d LEFT JOIN g ON d.doc_id = g.doc_id
"""
