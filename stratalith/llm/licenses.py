"""License scans by a positional index of rare words. DataFrame functions only; no shuffle, no Python on the executors.

Of every license text below, the `keys` words with the highest inverse document frequency over all texts are indexed with their
positions. A file's words are looked up in that index, so those that speak most for one license weigh most; every posting votes for the place
where its text would begin (word position - position in the text). Votes of one text whose places lie within `slack` words of the next are one
window, so that words put in or left out (line marks of comments, names, changed words) move a place but don't lose it; within a window each
indexed position counts once. A window whose share of the indexed weight reaches `least` is a place of the text if all mandatory phrases stand in the stretch it covers,
words that no license text has being passed over. Beside that, the plain phrases of PHRASES are counted.

Defined results: null text is empty: no words, no places, null first_word and last_word, empty labels, score 0. `places` holds every place by
license, then start; `matches` the best of each license (of equal ones the first). A place's start is its heaviest offset (of equal ones the first).
Repeated rows are scanned row by row; an empty table gives an empty result; other columns, whatever their names, are not read. Texts of any length are
read whole; a file's votes are folded in one pass after sorting.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# fixed values: plain phrases and their labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# fixed values: (label, license text or notice in words, mandatory phrases)
_WARRANTY = "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_HOLDERS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"
_GNU = "it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version this {2} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details you should have received a copy of the gnu {0} along with this {2}"
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is " + _WARRANTY, ["permission is hereby granted free of charge", "sublicense and or sell"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["licensed under the apache license", "in compliance with the license"]),
    ("gpl", "this program is free software you can redistribute it and or modify " + _GNU.format("general public license", "3", "program"), ["the terms of the gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify " + _GNU.format("lesser general public license", "2 1", "library"), ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution " + _HOLDERS, ["use in source and binary forms", "must retain the above copyright"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ["terms of the mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits", ["for any purpose with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", ["free and unencumbered software", "the public domain"]),
    ("agpl", "this program is free software you can redistribute it and or modify " + _GNU.format("affero general public license", "3", "program"), ["gnu affero general public license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution", ["the origin of this software must not be misrepresented"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", ["any person or organization obtaining a copy", "prepare derivative works"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0", ["terms of the eclipse public license"]),
]


def rare_words(keys: int) -> list[tuple[str, int, int, float]]:
    """(word, notice, position, weight) of each notice's `keys` rarest words; ties go to the longer, then the first by name."""
    split = [text.split() for _, text, _ in NOTICES]
    df = Counter(w for words in split for w in set(words))
    # in steps of 1/1024, so that sums don't depend on their order
    idf = {w: round(1024 * math.log(1 + len(split) / n)) / 1024 for w, n in df.items()}
    out = []
    for t, words in enumerate(split):
        chosen = set(sorted(set(words), key=lambda w: (-idf[w], -len(w), w))[:keys])
        out += [(w, t, p, idf[w]) for p, w in enumerate(words) if w in chosen]
    return out


def _votes(hits: Column, index: list[tuple[str, int, int, float]]) -> Column:
    postings: dict[str, list[Column]] = {}
    for w, t, p, weight in index:
        postings.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(weight).alias("weight")))
    table = F.create_map(*[x for w, found in postings.items() for x in (F.lit(w), F.array(*found))])
    indexed = F.filter(hits, lambda h: h["w"].isin(list(postings)))
    return F.array_sort(F.flatten(F.transform(indexed, lambda h: F.transform(F.try_element_at(table, h["w"]), lambda e: F.struct(e["t"].alias("t"), (h["i"] - e["p"]).alias("at"), e["p"].alias("p"), e["weight"].alias("weight"))))))


def _fold(least: list[float], slack: int) -> str:
    """Folds sorted votes into windows whose sum reaches `least` of their notice: first and last offset, heaviest offset, sum."""
    place = "named_struct('t', a.t, 'first', a.first, 'at', CASE WHEN a.run > a.top THEN a.here ELSE a.at END, 'last', a.here, 'sum', a.sum)"
    enough = f"a.t >= 0 AND a.sum >= element_at(array({', '.join(f'{x!r}D' for x in least)}), greatest(a.t, 0) + 1)"
    # here: the offset at hand, run: its weight so far; at, top: the heaviest offset before it; seen: the notice's positions that voted
    return f"""aggregate(concat(votes, array(named_struct('t', -1, 'at', 0, 'p', 0, 'weight', 0D))),
  named_struct('t', -1, 'first', 0, 'here', 0, 'run', 0D, 'at', 0, 'top', 0D, 'sum', 0D, 'seen', cast(array() as array<int>), 'done', cast(array() as array<struct<t:int,first:int,at:int,last:int,sum:double>>)),
  (a, v) -> CASE
    WHEN v.t = a.t AND v.at <= a.here + {slack} THEN named_struct('t', a.t, 'first', a.first, 'here', v.at,
      'run', CASE WHEN v.at = a.here THEN a.run + v.weight ELSE v.weight END,
      'at', CASE WHEN v.at <> a.here AND a.run > a.top THEN a.here ELSE a.at END, 'top', CASE WHEN v.at <> a.here THEN greatest(a.run, a.top) ELSE a.top END,
      'sum', CASE WHEN array_contains(a.seen, v.p) THEN a.sum ELSE a.sum + v.weight END,
      'seen', CASE WHEN array_contains(a.seen, v.p) THEN a.seen ELSE concat(a.seen, array(v.p)) END, 'done', a.done)
    ELSE named_struct('t', v.t, 'first', v.at, 'here', v.at, 'run', v.weight, 'at', v.at, 'top', 0D, 'sum', v.weight, 'seen', array(v.p),
      'done', CASE WHEN {enough} THEN concat(a.done, array({place})) ELSE a.done END)
  END, a -> a.done)"""


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: int = 24, least: float = 0.6, slack: int = 4) -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches and places (label, start word, coverage)."""
    index = rare_words(keys)
    total = {t: sum(w for _, x, _, w in index if x == t) for t in range(len(NOTICES))}
    vocabulary = sorted({w for _, text, _ in NOTICES for w in text.split()})
    wanted = sorted({w for w, *_ in index} | {p.split()[0] for p, _ in PHRASES})
    # a match needs its first mandatory phrase, a plain phrase ends in "license"
    anchors = sorted({max(phrases[0].split(), key=len) for _, _, phrases in NOTICES} | {"license"})
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # lower() also folds letters beyond ASCII; none of them becomes a word break or turns into one of the words looked up
    rows = rows.withColumn("_lower", F.lower("_text")).withColumn("n_words", F.regexp_count("_text", F.lit(WORD)).cast("long"))
    hint = None
    for a in anchors:
        hint = F.contains("_lower", F.lit(a)) if hint is None else hint | F.contains("_lower", F.lit(a))
    rows = rows.withColumn("_words", F.when(hint, F.regexp_extract_all("_lower", F.lit(WORD), 0)).otherwise(F.expr("cast(array() as array<string>)"))).drop("_lower", "_text")
    rows = rows.withColumn("_hits", F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(wanted)))

    def stands(h: Column, phrase: str) -> Column:
        words = phrase.split()
        test = h["w"] == words[0]
        for k, w in enumerate(words[1:], 1):
            test = test & (F.coalesce(F.get(F.col("_words"), h["i"] + k), F.lit("")) == w)
        return test

    label_of = lambda h: F.coalesce(*[F.when(stands(h, p), F.lit(label)) for p, label in PHRASES])
    rows = rows.withColumn("_base", F.filter(F.transform("_hits", lambda h: F.struct(h["i"].alias("i"), label_of(h).alias("label"))), lambda b: b["label"].isNotNull()))
    rows = rows.withColumn("votes", _votes(F.col("_hits"), index)).withColumn("_windows", F.expr(_fold([least * total[t] for t in range(len(NOTICES))], slack)))

    lengths = F.array(*[F.lit(len(text.split())) for _, text, _ in NOTICES])
    totals = F.array(*[F.lit(float(total[t])) for t in range(len(NOTICES))])

    def stretch(b: Column) -> Column:
        """The window's words that some license text has."""
        begin = F.greatest(b["first"], F.lit(0))
        words = F.slice("_words", begin + 1, F.greatest(b["last"] + F.get(lengths, b["t"]) + slack - begin, F.lit(1)))
        return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w.isin(vocabulary)), " "), F.lit(" "))

    rows = rows.withColumn("_read", F.transform("_windows", lambda b: F.struct(b["t"].alias("t"), F.greatest(b["at"], F.lit(0)).cast("long").alias("start"), F.least(F.lit(1.0), b["sum"] / F.get(totals, b["t"])).alias("coverage"), stretch(b).alias("words"))))

    def match(b: Column) -> Column:
        found = []
        for t, (label, _, phrases) in enumerate(NOTICES):
            test = b["t"] == t
            for p in phrases:
                test = test & F.contains(b["words"], F.lit(f" {p} "))
            found.append(F.when(test, F.struct(F.lit(label).alias("label"), b["start"].alias("start"), b["coverage"].alias("coverage"))))
        return F.coalesce(*found)

    rows = rows.withColumn("places", F.array_sort(F.filter(F.transform("_read", match), lambda m: m.isNotNull())))

    def best(label: str) -> Column:
        mine = F.array_max(F.transform(F.filter("places", lambda m: m["label"] == label), lambda m: F.struct(m["coverage"].alias("coverage"), (-m["start"]).alias("before"))))
        return F.when(mine.isNotNull(), F.struct(F.lit(label).alias("label"), (-mine["before"]).alias("start"), mine["coverage"].alias("coverage")))

    some = F.size("places") > 0
    rows = rows.withColumn("matches", F.when(some, F.filter(F.array(*[best(label) for label, *_ in NOTICES]), lambda m: m.isNotNull())).otherwise(F.col("places")))
    base_set = F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"])))
    return rows.select(
        id_col,
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["i"])).cast("long").alias("last_word"),
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.greatest(F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0))).alias("score"),
        "matches",
        "places",
    )
