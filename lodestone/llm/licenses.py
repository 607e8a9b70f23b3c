"""License scans by Dice coefficients over word bigrams; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: The least Dice coefficient that counts as a match.
LEAST = 0.8

#: Bigrams of templates that are broadcast; longer lists are joined by shuffle.
BROADCAST = 100_000
#: Places in a template's order key: a window of any template is as long as WIDE of them.
WIDE = 1_000_000_000

# Usual wordings of licence notices, and whole texts of short licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "0BSD-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _plain(text: F.Column) -> F.Column:
    """Normalised text: lower case, letters and digits; all else, line breaks too, is one space between words."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def _trie(texts: list[str]) -> str:
    """A regular expression for any of texts that shares their beginnings, so that a miss is seen at the first letters."""
    if texts == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for x in texts:
        heads.setdefault(x[:1], []).append(x[1:])
    parts = [re.escape(head) + _trie(rest) for head, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _known(spark: SparkSession, templates: dict[str, str], ratio: float) -> tuple[list[tuple], str]:
    """A row for each distinct bigram of each template, and a pattern that is in every text that can match.

    A match holds ratio of a template's bigrams at least. So it holds one of any so many as may be missing and one more; of
    each template those of the longest words are asked for, which are rare in other texts.
    """
    rows, asked = [], set()
    for license, plain in spark.createDataFrame([*templates.items()], "license string, text string").select("license", _plain(F.col("text"))).collect():
        words = plain.split(" ")
        if len(words) < 2:
            raise ValueError(f"template {license} has fewer than two words")
        grams = [*dict.fromkeys(zip(words, words[1:]))]
        span, b = len(words) - 1, len(grams)
        rows += [(license, b, span, WIDE // span, k, x, y) for k, (x, y) in enumerate(grams)]
        most = b - math.ceil(ratio * b - 1e-9) + 1
        asked |= {" ".join(g) for g in sorted(grams, key=lambda g: (-min(map(len, g)), -sum(map(len, g)), g))[:most]}
    return rows, f" {_trie(sorted(x + ' ' for x in asked))}"


def _islands(rows: DataFrame, key: str) -> DataFrame:
    """rows with island: runs of intervals [at, last] that share places with one another, within equal keys."""
    order = W.partitionBy(key).orderBy("at", "last")
    new = F.col("at") > F.coalesce(F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    return rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def _apart(runs: str) -> F.Column:
    """Of runs in order, those that share no word with one that was taken before. The runs of an island are few."""

    def take(taken: F.Column, r: F.Column) -> F.Column:
        return F.when(F.exists(taken, lambda x: (x["at"] <= r["last"]) & (x["last"] >= r["at"])), taken).otherwise(F.concat(taken, F.array(r)))

    return F.aggregate(runs, F.slice(runs, 1, 0), take)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_matches, licenses, best, best_dice for every row of docs (doc_id, text; others are not read).

    Texts are normalised whole (see _plain), so it doesn't matter how a notice is wrapped. A template of m words is compared
    with each run of m words (fewer at the text's end) that begins with one of its bigrams, wherever that stands, by the
    Dice coefficient of their sets of word bigrams, 2 * common / (a + b); `least` is a match. Of a template's matches one
    counts if no better one shares words with it (ties: the first). Those that are left are taken in the order of their common bigrams, most
    first, so that a text counts rather than a notice within it (ties: by Dice, then by name), but for those that share words
    with one taken before. licenses names the templates taken, in order; best is that of most common bigrams.

    Bounds on sizes prune: a run matches a template of b bigrams only if it holds least / (2 - least) * b of them. So texts
    without any of the bigrams that such a run can't do without are dropped, then templates that have too few of their bigrams
    in a text or are too long for it; runs are measured only where enough bigrams of the template lie. Texts meet templates
    by bigrams, in a join that broadcasts the templates' bigrams if there are no more than BROADCAST.
    Defined results: null and empty texts, and texts of one word, match nothing. A null doc_id is kept. Rows that repeat are
    alike, row by row. Very long texts are compared whole. An empty table gives an empty table.
    """
    spark, ratio = docs.sparkSession, least / (2 - least)
    known, asked = _known(spark, templates or TEMPLATES, ratio)
    parts = spark.createDataFrame(known, "license string, b int, span int, step long, gram int, first string, second string")
    parts = F.broadcast(parts) if len(known) <= BROADCAST else parts

    plain = _plain(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), plain.alias("plain"))
    n_words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.translate("plain", " ", "")) + 1)
    near = F.concat(F.lit(" "), "plain", F.lit(" ")).rlike(asked)
    # Numbers of rows are written with them, and so stay what they are; so are the few texts that can match.
    rows = written(rows.select("doc_id", "row", n_words.alias("n_words"), F.when(near, F.col("plain")).alias("plain")))
    texts = rows.where("plain IS NOT NULL").select("row", "n_words", F.split("plain", " ").alias("words"))

    met = texts.select("row", "n_words", F.posexplode(F.arrays_zip(F.col("words").alias("first"), F.slice("words", 2, F.col("n_words")).alias("second"))).alias("at", "pair"))
    met = met.select("row", "n_words", "at", F.col("pair").getField("first").alias("w1"), F.col("pair").getField("second").alias("w2"))
    met = met.join(parts, (F.col("w1") == F.col("first")) & (F.col("w2") == F.col("second"))).where(F.col("n_words") - 1 >= ratio * F.col("b"))
    met = met.select("row", "n_words", "license", "b", "span", "gram", "at", (F.col("at") * F.col("step")).alias("place"))
    own = W.partitionBy("row", "license")
    met = met.withColumn("all", F.size(F.collect_set("gram").over(own))).where(F.col("all") >= ratio * F.col("b"))
    # place is `at` stretched so that all templates' runs are WIDE long, since a frame has one length.
    run = own.orderBy("place").rangeBetween(0, WIDE - 10_000)
    met = met.withColumn("common", F.size(F.collect_set("gram").over(run))).where(F.col("common") >= ratio * F.col("b"))
    runs = met.groupBy("row").agg(F.collect_list(F.struct("license", "b", "span", "at", "common")).alias("runs"))

    pairs = F.zip_with(F.slice("words", 1, F.col("n_words") - 1), F.slice("words", 2, F.col("n_words") - 1), lambda x, y: F.concat_ws(" ", x, y))
    measured = texts.select("row", "n_words", pairs.alias("pairs")).join(runs, "row")

    def dice(r: F.Column) -> F.Column:
        a = F.size(F.array_distinct(F.slice("pairs", r["at"] + 1, r["span"])))
        return F.struct(r["license"].alias("license"), r["at"].alias("at"), F.least(r["at"] + r["span"], F.col("n_words") - 1).alias("last"), r["span"].alias("span"), r["common"].alias("common"), (F.lit(2.0) * r["common"] / (a + r["b"])).alias("dice"))

    found = measured.select("row", F.inline(F.transform("runs", dice))).where(F.col("dice") >= least)
    near = own.orderBy("place").rangeBetween(-WIDE, WIDE)  # runs of the template that share a word with this one
    rank = F.struct("dice", (-F.col("at")).alias("first"))
    found = found.withColumn("place", F.col("at") * F.expr(f"{WIDE} div span")).withColumn("best", rank == F.max(rank).over(near)).where("best")
    found = found.select("row", "license", "at", "last", (-F.col("dice")).alias("far"), (-F.col("common")).alias("few"))
    found = _islands(found, "row").groupBy("row", "island").agg(F.array_sort(F.collect_list(F.struct("few", "far", "license", "at", "last"))).alias("runs"))
    found = found.select("row", F.explode(_apart("runs")).alias("top"))
    found = found.groupBy("row").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("top.license")), ",").alias("licenses"), F.min("top").alias("top"))
    out = rows.select("doc_id", "row", "n_words").join(found, "row", "left")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.col("top.license").alias("best"), (-F.col("top.far")).alias("best_dice"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SQL_WORDS = "list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_SQL_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"

#: Every run of a template's length that begins with one of its bigrams is measured; nothing is pruned.
OP6_SQL = f"""
WITH RECURSIVE known AS (
  SELECT license, {_SQL_WORDS} AS w FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}) t(license, text)
), template AS (
  SELECT license, len(w) AS m, list_distinct({_SQL_PAIRS}) AS grams FROM known
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents
), paired AS (
  SELECT r, len(w) AS n, {_SQL_PAIRS} AS g FROM texts
), bigram AS (
  SELECT r, unnest(range(1, n)) AS pos, unnest(g) AS gram FROM paired
), begun AS (
  SELECT r, pos, license FROM bigram JOIN (SELECT license, unnest(grams) AS gram FROM template) USING (gram)
), run AS (
  SELECT r, license, pos, least(pos + m - 1, n) AS last, list_distinct(g[pos:pos + m - 2]) AS own, grams FROM begun JOIN template USING (license) JOIN paired USING (r)
), fits AS (
  SELECT r, license, pos, last, len(list_intersect(own, grams)) AS common, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM run WHERE 3 * len(own) >= 2 * len(grams)
), good AS (
  SELECT * FROM fits WHERE dice >= {LEAST}
), single AS (
  SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM good h WHERE h.r = g.r AND h.license = g.license AND h.pos <= g.last AND h.last >= g.pos AND (h.dice > g.dice OR h.dice = g.dice AND h.pos < g.pos))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY common DESC, dice DESC, license, pos) AS nth FROM single
), taken AS (
  SELECT DISTINCT r, 0::BIGINT AS nth, []::STRUCT(pos BIGINT, last BIGINT)[] AS got, false AS took FROM ranked
  UNION ALL
  SELECT r, k.nth, CASE WHEN k.free THEN list_append(got, {{'pos': k.pos, 'last': k.last}}) ELSE got END, k.free
  FROM (SELECT t.r, t.got, n.nth, n.pos, n.last, len(list_filter(t.got, lambda x: x.pos <= n.last AND x.last >= n.pos)) = 0 AS free FROM taken t JOIN ranked n ON n.r = t.r AND n.nth = t.nth + 1) k
), best AS (
  SELECT ranked.* FROM ranked JOIN taken USING (r, nth) WHERE took
), found AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, first(license ORDER BY common DESC, dice DESC, license) AS best, first(dice ORDER BY common DESC, dice DESC, license) AS best_dice FROM best GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best, best_dice FROM texts LEFT JOIN found USING (r)
"""
