"""License scanning by a positional index of rare words.

Templates are license texts and notices. How rare a word is (IDF) is counted over all files; each template's rarest words have
postings (template, position). Files that hold any of these words look up theirs, and each posting votes for (template, where the
template would begin); votes that agree on a beginning are an intersection of postings by relative position. Where they reach a
share of the weight of the template's rare words, the template's mandatory phrase is verified at its own place. The scan is SQL
functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_WARRANTY = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
    "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)


def _gnu(name: str, version: str) -> str:
    return (
        f"this program is free software you can redistribute it and or modify it under the terms of the gnu {name} general public license as published by the free software foundation "
        f"either version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        f"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} general public license for more details"
    ).replace("  ", " ")


#: Label, words of a license text or notice, its mandatory phrase. Words are lower-case runs of letters and digits.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2 0",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses"),
    ("gpl-2.0", _gnu("", "2"), "gnu general public license"),
    ("gpl-3.0", _gnu("", "3"), "gnu general public license"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", _gnu("lesser", "3"), "gnu lesser general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", _gnu("affero", "3"), "gnu affero general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd-2-clause", f"{_BSD} {_WARRANTY}", "redistribution and use in source and binary forms"),
    (
        "bsd-3-clause",
        f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_WARRANTY}",
        "endorse or promote products derived from this software",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify and or distribute this software",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "copyright and related and neighboring rights"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        "unencumbered software released into the public domain",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "alter it and redistribute it freely",
    ),
    ("proprietary", "all rights reserved unauthorized copying of this file is strictly prohibited", "unauthorized copying of this file"),
    ("proprietary", "proprietary and confidential all rights reserved", "proprietary and confidential"),
]
#: Rarest words of a template that are indexed, and the share of their weight that must agree.
RARE, SHARE = 8, 0.6
#: Word characters of lower-cased text; others separate words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Every word of the templates.
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def _words(files: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, norm): lower-cased words, each between two blanks."""
    # A-Z alone in lower case, separators as single blanks
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _SEPARATORS, " ")), F.lit(" "))
    return files.select(F.col(key).alias("doc_id"), norm.alias("norm"))


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def weights(files: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, float]:
    """The IDF of each word of the templates over all files; only counts of these words are gathered."""
    held = F.expr(f"array_intersect(split(norm, ' '), {_array(VOCABULARY)})")
    # the blank word stands for the file itself
    counts = _words(files, key, text).select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}
    return {w: math.log((1 + found.get("", 0)) / (1 + found.get(w, 0))) + 0.001 for w in VOCABULARY}


def index(idf: dict[str, float]) -> tuple[list[tuple[str, int, int, float]], list[float]]:
    """Postings (word, template, position, IDF) of each template's rarest words, and the sum of their weights. Of equally rare words
    the earlier one is rarer; a word stands for its first place."""
    postings, total = [], []
    for t, (_, text, _) in enumerate(TEMPLATES):
        own = text.split()
        rare = sorted(set(own), key=lambda w: (-idf[w], own.index(w)))[:RARE]
        postings += [(w, t, own.index(w), idf[w]) for w in rare]
        total.append(sum(idf[w] for w in rare))
    return postings, total


def scan(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of files.

    score is the largest share of a verified template's weight that agrees, 1 where only a base phrase is found, else 0. A null
    text counts as empty: no words, null places, empty labels. Repeated rows give repeated results, no rows none. Files are read twice:
    once for the words' weights.
    """
    postings, total = index(weights(files, key, text))
    df = _words(files, key, text)
    blanks = "(length({0}) - length(replace({0}, ' ', '')))"
    df = df.withColumn("n_words", F.expr(f"cast(CASE WHEN norm = '  ' THEN 0 ELSE {blanks.format('norm')} - 1 END AS long)"))
    # pieces around each phrase: the words before a place are the blanks before it, less the one that begins the text
    df = df.withColumn("licensed", F.expr("contains(norm, ' license ')"))
    for i, phrase in enumerate(BASE):
        df = df.withColumn(f"b{i}", F.expr(f"CASE WHEN licensed THEN split(norm, '(?<= ){phrase}(?= )', -1) ELSE array(norm) END"))
    df = df.withColumn("n_base", F.expr(" + ".join(f"size(b{i}) - 1" for i in range(len(BASE)))).cast("long"))
    first = [f"CASE WHEN size(b{i}) > 1 THEN {blanks.format(f'b{i}[0]')} - 1 END" for i in range(len(BASE))]
    last = [f"CASE WHEN size(b{i}) > 1 THEN n_words - ({blanks.format(f'element_at(b{i}, -1)')} - 1) - {len(p.split())} END" for i, p in enumerate(BASE)]
    df = df.withColumns({"first_word": F.expr(f"cast(least({', '.join(first)}) AS long)"), "last_word": F.expr(f"cast(greatest({', '.join(last)}) AS long)")})
    base = ", ".join(f"CASE WHEN size(b{i}) > 1 THEN '{label}' END" for i, label in enumerate(BASE.values()))
    df = df.withColumn("base", F.expr(f"array_compact(array({base}))"))
    # the file's rare words with their places, looked up in the index
    listed: dict[str, list[str]] = {}
    for w, t, p, v in postings:
        listed.setdefault(w, []).append(f"named_struct('t', {t}, 'p', {p}, 'v', {v!r}D)")
    df = df.withColumn("word", F.expr("split(trim(norm), ' ')"))
    df = df.withColumn("word", F.expr(f"CASE WHEN arrays_overlap(word, {_array(sorted(listed))}) THEN word ELSE cast(array() AS array<string>) END"))
    df = df.withColumn("met", F.expr(f"filter(transform(word, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains({_array(sorted(listed))}, x.w))"))
    table = f"map_from_arrays({_array(list(listed))}, array({', '.join(f'array({chr(44).join(p)})' for p in listed.values())}))"
    df = df.withColumn("votes", F.expr(f"array_sort(flatten(transform(met, x -> transform(element_at({table}, x.w), q -> named_struct('t', q.t, 'o', x.i - q.p, 'v', q.v)))))"))
    # votes for one beginning stand together and are RARE at most: the first of them sums all
    sums = f"transform(votes, (x, j) -> named_struct('t', x.t, 'o', x.o, 's', aggregate(filter(slice(votes, j + 1, {RARE}), y -> y.t = x.t AND y.o = x.o), 0D, (a, y) -> a + y.v) / element_at(array({', '.join(f'{x!r}D' for x in total)}), x.t + 1)))"
    df = df.withColumn("agreed", F.expr(f"filter({sums}, z -> z.s >= {SHARE}D)"))
    phrases = []
    for _, text_, phrase in TEMPLATES:
        at = f" {text_} ".index(f" {phrase} ")
        phrases.append(f"named_struct('q', {len(text_[:at].split())}, 'n', {len(phrase.split())}, 'p', '{phrase}')")
    verified = f"filter(agreed, z -> exists(array(element_at(array({', '.join(phrases)}), z.t + 1)), k -> z.o + k.q >= 0 AND array_join(slice(word, greatest(z.o + k.q, 0) + 1, k.n), ' ') = k.p))"
    df = df.withColumn("found", F.expr(verified))
    named = _array([label for label, _, _ in TEMPLATES])
    labels = "array_join(array_sort(array_distinct({})), ',')"
    return df.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.expr(labels.format("base")).alias("base_labels"),
        F.expr(labels.format(f"concat(base, transform(found, z -> element_at({named}, z.t + 1)))")).alias("labels"),
        F.expr("greatest(CASE WHEN n_base > 0 AND size(found) = 0 THEN 1D ELSE 0D END, least(1D, coalesce(array_max(transform(found, z -> z.s)), 0D)))").alias("score"),
    )
