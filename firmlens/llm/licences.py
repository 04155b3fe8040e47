"""Licence scans: Dice coefficient over word bigrams between passages and licence templates.

A document's lines, its blocks between blank lines, its whole text and all runs of its words are
normalised (lower case, letters and digits) and compared with templates of licence texts and notices.
Dice counts repeated bigrams as often as they occur. Runs find a licence wherever it stands: over
several paragraphs or comment lines inside a longer text, wrapped, or inside a long line. A run is
reported where it is best among the runs that overlap it, unless it lies inside a line, block or whole
text that matches the same licence; a run inside another one is not counted again. Three bounds come
first, and none can lose a match:

* Sizes. Dice of at least t needs t / (2 - t) <= size / size of template <= (2 - t) / t, so only
  templates of a fitting size are candidates, and most long texts have none.
* Key words. A match holds at least t / (2 - t) of a template's bigrams. For each template words are
  chosen that touch more than the rest of its bigrams, so a match holds one of them.
* Shared bigrams. Runs are sought for templates of which the text holds t / (2 - t) of the bigrams
  somewhere, and begin and end at bigrams of the template, since others only lower the coefficient.

Null and empty texts match nothing. Rows that repeat a doc_id count as one document. Null doc_ids
are one document too.
"""
from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table

MIN_DICE = 0.8
#: Words too common to serve as key words.
COMMON = frozenset("the of and to in or any is for this a be as by that with on it an are from not all you may at no".split())

_WITHOUT_WARRANTY = ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                     "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
                     "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
                     "with the software or the use or other dealings in the software")
_BSD_TERMS = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
              "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
              "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
              "documentation and or other materials provided with the distribution")
_BSD_NAMES = ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission")
_BSD_WARRANTY = ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited "
                 "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder "
                 "or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
                 "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of "
                 "liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
                 "software even if advised of the possibility of such damage")
#: Public licence texts and common notices, as (licence, text).
TEMPLATES = [
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
            "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the "
            "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WITHOUT_WARRANTY),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "this project is licensed under the mit license see the license file for details"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
            "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
            "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
            "negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
             "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
             "alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not "
             "claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be "
             "appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original "
             "software this notice may not be removed or altered from any source distribution"),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("Apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
                   "a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
                   "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
                   "see the license for the specific language governing permissions and limitations under the license"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
                "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
                "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
                "general public license for more details you should have received a copy of the gnu general public license along with this program if not see "
                "http www gnu org licenses"),
    ("LGPL-3.0", "this work is licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "this work is licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
                "can obtain one at http mozilla org mpl 2 0"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC0-1.0", "this work is dedicated to the public domain under the cc0 1 0 universal public domain dedication"),
]


def bigrams_of(text: str) -> Counter:
    words = text.split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def key_words(templates: list[tuple[str, str]], min_dice: float = MIN_DICE) -> list[str]:
    """Words of which every match of a template holds at least one."""
    chosen: dict[str, None] = {}
    for _, text in templates:
        pairs = bigrams_of(text)
        left = {p: c for p, c in pairs.items() if not any(w in chosen for w in p.split())}
        spare = sum(pairs.values()) * (1 - min_dice / (2 - min_dice))  # bigrams that a match may lack
        while sum(pairs.values()) - sum(left.values()) <= spare:
            touched: Counter = Counter()
            for p, c in left.items():
                touched.update({w: c for w in set(p.split())})
            word = max(touched, key=lambda w: (w not in COMMON, len(w) > 3, touched[w], w))
            chosen[word] = None
            left = {p: c for p, c in left.items() if word not in p.split()}
    return list(chosen)


def _known(templates: list[tuple[str, str]], low: float, high: float) -> Column:
    """Templates as structs: size m, numbered and distinct bigrams, how often each occurs, and the bounds of runs."""
    rows = []
    for name, text in templates:
        pairs = bigrams_of(text)
        m = sum(pairs.values())
        least = math.ceil(m * low - 1e-9)  # bigrams that a match shares
        rows.append(F.struct(F.lit(name).alias("licence"), F.lit(m).alias("m"), F.lit(_numbered(text)).alias("own"), F.lit("|".join(pairs)).alias("kinds"),
                             F.lit(",".join(map(str, pairs.values()))).alias("counts"), F.lit(len(pairs) - m + least).alias("need"),
                             F.lit(least).alias("least"), F.lit(math.floor(m * high + 1e-9)).alias("reach")))
    return F.array(*rows)


def _runs(min_dice: float) -> Column:
    """Matching runs of words as (s, e, dice), bigrams s to e; ``hits`` are the places of the template's bigrams in the text."""
    m, reach, least = F.col("m"), F.col("reach"), F.col("least")

    def best_from(a):
        begin = F.get("hits", a)["at"]

        def add(acc, y):
            shared = acc["shared"] + F.when(y["spent"] < a, 1).otherwise(0)
            dice = 2.0 * shared / (y["at"] - begin + 1 + m)
            better = dice > acc["dice"]
            return F.struct(shared.alias("shared"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, y["at"]).otherwise(acc["e"]).alias("e"))

        start = F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(-1).alias("e"))
        return F.aggregate(F.slice("hits", a + 1, reach), start, add, lambda acc: F.struct(begin.alias("s"), acc["e"].alias("e"), acc["dice"].alias("dice")))

    starts = F.filter(F.sequence(F.lit(0), F.size("hits") - least), lambda a: F.get("hits", a + least - 1)["at"] - F.get("hits", a)["at"] < reach)
    found = F.filter(F.transform(starts, best_from), lambda x: x["dice"] >= min_dice)

    def apart(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        return (F.when((F.size(acc) == 0) | (x["s"] > last["e"]), F.concat(acc, F.array(x)))
                .when(x["dice"] > last["dice"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc))

    none = F.array().cast("array<struct<s:int,e:int,dice:double>>")
    return F.when(F.size("hits") >= least, F.aggregate(found, none, apart)).otherwise(none)


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, licence, dice, n_passages): licences that a passage of the document matches, with the best coefficient."""
    templates = TEMPLATES if templates is None else templates
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    sizes = [sum(bigrams_of(t).values()) for _, t in templates]
    held = rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in key_words(templates, min_dice))})(?![a-z0-9])"
    plain = F.regexp_replace(F.lower("text"), r"[^a-z0-9\n]+", " ")
    normal = documents.select("doc_id", F.inline(F.array(F.struct(plain.alias("plain"))))).filter(F.col("plain").rlike(held))
    # the whole text comes first, so it keeps place 0 where a line or block equals it
    passages = F.array_distinct(F.transform(F.concat(F.array("plain"), F.split("plain", "\n"), F.split("plain", "\n ?\n")),
                                            lambda p: F.trim(F.regexp_replace(p, r"[ \n]+", " "))))
    units = normal.select("doc_id", F.xxhash64("plain").alias("h"), F.posexplode(passages).alias("pos", "unit")).filter(F.col("unit").rlike(held))
    n = F.length("unit") - F.length(F.translate("unit", " ", ""))  # bigrams: one less than words
    fits = (F.col("n") >= min(sizes) * low) & (F.col("n") <= max(sizes) * high)
    sized = units.withColumn("n", n).filter((F.col("n") >= min(sizes) * low) & ((F.col("n") <= max(sizes) * high) | (F.col("pos") == 0)))
    words = F.split("unit", " ")
    pairs = F.zip_with(F.slice(words, 1, F.col("n")), F.slice(words, 2, F.col("n")), lambda a, b: F.concat_ws(" ", a, b))
    # repeated bigrams are numbered, so that equal numbers of them meet in the intersection
    numbered = F.transform("pairs", lambda p, i: F.concat_ws("#", p, F.size(F.filter(F.slice("pairs", 1, i + 1), lambda q: q == p))))
    every = F.split(F.lit("|".join(dict.fromkeys(p for _, t in templates for p in bigrams_of(t)))), r"\|")
    known = F.filter(_known(templates, low, high), lambda t: ((F.col("n") >= t["m"] * low) & (F.col("n") <= t["m"] * high))
                     | (F.col("met").isNotNull() & (F.size(F.array_intersect("met", F.split(t["kinds"], r"\|"))) >= t["need"])))
    candidates = (sized.select("doc_id", "h", "pos", "unit", "n", F.inline(F.array(F.struct(pairs.alias("pairs")))))
                  .select("doc_id", "h", "pos", "unit", "n", "pairs", F.inline(F.array(F.struct(
                      F.when(fits, numbered).alias("numbered"), F.when(F.col("pos") == 0, F.array_intersect("pairs", every)).alias("met")))))
                  .select("doc_id", "h", "pos", "unit", "n", "pairs", "numbered", F.inline(known)))
    shared = F.size(F.array_intersect("numbered", F.split("own", r"\|")))
    fit = (F.col("n") >= F.col("m") * low) & (F.col("n") <= F.col("m") * high)
    cut = F.when(fit, 2.0 * shared / (F.col("n") + F.col("m")))
    kinds, counts = F.split("kinds", r"\|"), F.split("counts", ",")
    places = F.filter(F.transform("pairs", lambda p, i: F.struct(i.alias("at"), F.array_position("kind_list", p).cast("int").alias("kind"))), lambda x: x["kind"] > 0)

    def spent(x, j):
        """With the hit before which no run may begin if this hit is to count: the template has its bigram only so often."""
        skip = F.greatest(j - F.col("reach"), F.lit(0))
        before = F.filter(F.transform(F.slice("places", skip + 1, j - skip), lambda y, i: F.when(y["kind"] == x["kind"], skip + i)), lambda i: i.isNotNull())
        often = F.get("count_list", x["kind"] - 1).cast("int")
        return F.struct(x["at"].alias("at"), F.coalesce(F.when(F.size(before) >= often, F.get(before, F.size(before) - often)), F.lit(-1)).alias("spent"))

    base = ["doc_id", "h", "unit", "licence", "m", "least", "reach"]
    placed = candidates.select(*base, F.inline(F.array(F.struct(cut.alias("cut"), kinds.alias("kind_list"), counts.alias("count_list"),
                               F.when(F.col("pos") == 0, F.col("pairs")).otherwise(F.array().cast("array<string>")).alias("pairs")))))
    placed = placed.select(*base, "cut", "count_list", F.inline(F.array(F.struct(places.alias("places")))))
    placed = placed.select(*base, "cut", F.inline(F.array(F.struct(F.transform("places", spent).alias("hits")))))
    placed = placed.select("doc_id", "h", "unit", "licence", "cut", F.inline(F.array(F.struct(_runs(min_dice).alias("runs")))))
    texts = F.transform("runs", lambda x: F.struct(F.array_join(F.slice(words, x["s"] + 1, x["e"] - x["s"] + 2), " ").alias("unit"), x["dice"].alias("dice"), F.lit(False).alias("cut")))
    whole = F.array(F.struct(F.col("unit"), F.col("cut").alias("dice"), F.lit(True).alias("cut")))
    scored = placed.select("doc_id", "h", "licence", F.explode(F.concat(whole, texts)).alias("p")).filter(F.col("p.dice") >= min_dice)

    def inside(x, y):
        return F.contains(F.concat(F.lit(" "), y["unit"], F.lit(" ")), F.concat(F.lit(" "), x["unit"], F.lit(" ")))

    # per text, so that the passages compared with each other are those of one text
    all_ = scored.groupBy("doc_id", "h", "licence").agg(F.collect_set("p").alias("all"))
    taken = F.filter("all", lambda x: x["cut"] | ~F.exists("all", lambda y: y["cut"] & inside(x, y)))
    kept = all_.select("doc_id", "licence", F.inline(F.array(F.struct(taken.alias("taken")))))
    counted = F.filter("taken", lambda x: x["cut"] | ~F.exists("taken", lambda y: (y["unit"] != x["unit"]) & inside(x, y)))
    best = kept.select("doc_id", "licence", F.array_max(F.transform("taken", lambda x: x["dice"])).alias("dice"), F.explode(F.transform(counted, lambda x: x["unit"])).alias("unit"))
    return best.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("n_passages"))


def _numbered(text: str) -> str:
    return "|".join(f"{p}#{k}" for p, c in bigrams_of(text).items() for k in range(1, c + 1))


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) t(k, licence, body)),
own AS (SELECT k, licence, list_extract(w, i) || ' ' || list_extract(w, i + 1) AS p FROM (SELECT k, licence, string_split(body, ' ') AS w FROM templates), range(1, 400) r(i) WHERE i < len(w)),
own_counts AS (SELECT k, licence, p, count(*) AS c FROM own GROUP BY ALL),
own_sizes AS (SELECT k, licence, count(*) AS m FROM own GROUP BY ALL),
plain AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
units AS (SELECT DISTINCT doc_id, trim(regexp_replace(u, '[ \\n]+', ' ', 'g')) AS unit FROM (
  SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n ?\\n'), [t])) AS u FROM plain)),
sized AS (SELECT doc_id, unit, string_split(unit, ' ') AS w, len(string_split(unit, ' ')) - 1 AS n FROM units WHERE length(unit) - length(replace(unit, ' ', '')) BETWEEN 1 AND 400),
numbered AS (SELECT row_number() OVER () AS u, * FROM sized),
pairs AS (SELECT u, doc_id, unit, n, list_extract(w, i) || ' ' || list_extract(w, i + 1) AS p FROM numbered, range(1, 401) r(i) WHERE i <= n),
pair_counts AS (SELECT u, doc_id, unit, n, p, count(*) AS c FROM pairs GROUP BY ALL),
met AS (SELECT u, doc_id, unit, n, k, licence, sum(least(a.c, b.c)) AS s FROM pair_counts a JOIN own_counts b USING (p) GROUP BY ALL)
SELECT doc_id, licence, max(2.0::DOUBLE * s / (n + m)) AS dice, count(DISTINCT unit) AS n_passages
FROM met JOIN own_sizes USING (k, licence) WHERE 2.0::DOUBLE * s / (n + m) >= {MIN_DICE} GROUP BY doc_id, licence"""


@query("op9_licence_bigrams", sql=_oracle())
def op9_licence_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
