"""License scans by a positional rare-token index.

The index holds, for each word of the license templates, its places in them, and its weight: the inverse document frequency
over the whole corpus. A template has mandatory phrases; the highest-weighted word of each is its key, so every phrase in a
document is found from a place of its key, by relative position. Phrases of one template that follow each other at about the
template's distances are anchors of a match. Between two anchors, postings of the other words are intersected by relative
position, within the shifts that the anchors show and a little more; the share of the template's weight that stands so is the match's score.
A label needs all mandatory phrases and a share of SHARE; a match that lacks some is partial: it has a score but no label.
Short names ("mit license") are templates that are one mandatory phrase; all their places are reported.

Defined cases: null text counts as empty; no words gives nulls and score 0; repeated rows stay repeated, and a row is judged by
its text alone, whatever its doc_id; extra columns are ignored; an empty table gives an empty result; words of a notice may be
changed, added or left out between its mandatory phrases, which then lowers the score.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import batches, doc_texts, documents, words

#: The share of a template's weight that must agree at one start.
SHARE = 0.6
#: How far the distance of two mandatory phrases may be from the template's, as a share of it.
DRIFT = 0.5

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Names and tags: label, phrase.
NAMES = (
    ("mit", "spdx license identifier mit"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("apache-2.0", "apache license version 2 0"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license"),
    ("bsd", "bsd license"),
    ("isc", "isc license"),
    ("bsl", "boost software license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal"),
)

_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_KEYS = ("redistribution and use in source and binary forms", "provided that the following conditions are met", "must retain the above copyright notice", "provided by the copyright holders and contributors as is")

#: Whole notices: label, words, mandatory phrases in order.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("permission is hereby granted free of charge", "deal in the software without restriction", "included in all copies or substantial portions of the software", "the software is provided as is")),
    ("bsd-2", f"{_BSD} {_AS_IS}", _BSD_KEYS),
    ("bsd-3", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}", (*_BSD_KEYS[:3], "used to endorse or promote products derived from this software", _BSD_KEYS[3])),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("permission to use copy modify", "with or without fee is hereby granted", "appear in all copies", "disclaims all warranties with regard to this software")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution", ("alter it and redistribute it freely", "must not claim that you wrote the original software", "altered source versions must be plainly marked as such")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("except in compliance with the license", "distributed on an as is basis", "governing permissions and limitations under the license")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses", ("under the terms of the gnu general public license", "distributed in the hope that it will be useful", "received a copy of the gnu general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this library if not see http www gnu org licenses", ("under the terms of the gnu lesser general public license", "distributed in the hope that it will be useful", "received a copy of the gnu lesser general public license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law", ("free and unencumbered software released into the public domain", "dedicate any and all copyright interest", "an overt act of relinquishment in perpetuity")),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool


def templates() -> list[Template]:
    def one(label: str, text: str, phrases: tuple[str, ...], base: bool) -> Template:
        w, places, at = tuple(words(text)), [], 0
        for p in (tuple(words(x)) for x in phrases):
            at = next(i for i in range(at, len(w)) if w[i : i + len(p)] == p)
            places.append((at, p))
        return Template(label, w, tuple(places), base)

    return [one(label, p, (p,), True) for p, label in BASE] + [one(label, p, (p,), False) for label, p in NAMES] + [one(label, t, p, False) for label, t, p in TEMPLATES]


class Index:
    def __init__(self, weight: dict[bytes, float]):
        self.templates, self.weight = templates(), weight
        #: Templates, phrases and places in them of the phrases' keys, and places of all words in each template.
        self.keys: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.places: list[dict[bytes, list[int]]] = []
        self.total = []
        for k, t in enumerate(self.templates):
            for n, (_, p) in enumerate(t.phrases):
                i = max(range(len(p)), key=lambda i: (weight[p[i]], -i))
                self.keys[p[i]].append((k, n, i))
            held = defaultdict(list)
            for i, x in enumerate(t.words):
                held[x].append(i)
            self.places.append(dict(held))
            self.total.append(sum(weight[w] for w in t.words))

    def phrases(self, w: list[bytes]) -> dict[int, dict[int, list[int]]]:
        """Template, phrase: where it stands."""
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, x in enumerate(w):
            for k, n, j in self.keys.get(x, ()):
                p = self.templates[k].phrases[n][1]
                if i >= j and tuple(w[i - j : i - j + len(p)]) == p:
                    found[k][n].append(i - j)
        return found

    def match(self, w: list[bytes]) -> list[tuple[int, int, int, float, bool]]:
        """(template, start, words, share, whether all mandatory phrases and enough of the weight stand), by template and start."""
        if self.keys.keys().isdisjoint(w):
            return []
        out = []
        for k, found in self.phrases(w).items():
            t = self.templates[k]
            if len(t.phrases) == 1:
                out += [(k, at, len(t.words), 1.0, True) for at in found[0]]
                continue
            used: set[tuple[int, int]] = set()
            for n, at in sorted((n, at) for n, places in found.items() for at in places):
                if (n, at) in used:
                    continue
                anchors = self.chain(t, found, n, at)
                used.update(anchors)
                share = self.share(k, w, anchors)
                begin, end = anchors[0][1], anchors[-1][1] + len(t.phrases[anchors[-1][0]][1])
                out.append((k, begin, end - begin, share, len(anchors) == len(t.phrases) and share >= SHARE))
        return sorted(out)

    @staticmethod
    def chain(t: Template, found: dict[int, list[int]], n: int, at: int) -> list[tuple[int, int]]:
        """(phrase, place) from phrase n at at on: each next one is the first within DRIFT of the template's distance."""
        out = [(n, at)]
        for m in range(n + 1, len(t.phrases)):
            k, p = out[-1]
            far = t.phrases[m][0] - t.phrases[k][0]
            slack = max(8, int(DRIFT * far))
            places = found.get(m, [])
            i = bisect_left(places, max(p + len(t.phrases[k][1]), p + far - slack))
            if i < len(places) and places[i] <= p + far + slack:
                out.append((m, places[i]))
        return out

    def share(self, k: int, w: list[bytes], anchors: list[tuple[int, int]]) -> float:
        """The share of template k's weight that stands at its relative place, within the shifts of the anchors around it."""
        t, places, held = self.templates[k], self.places[k], set()
        shifts = [(t.phrases[n][0], at - t.phrases[n][0]) for n, at in anchors]
        ends = [(0, shifts[0][1]), *shifts, (len(t.words), shifts[-1][1])]
        for (i, s), (j, z) in zip(ends, ends[1:]):
            slack = max(3, (j - i) // 8)  # words added and left out again between the anchors
            low, high = min(s, z) - slack, max(s, z) + slack
            for p in range(max(0, i + s), min(len(w), j + z)):
                for q in places.get(w[p], ()):
                    if i <= q < j and low <= p - q <= high:
                        held.add(q)
        return sum(self.weight[t.words[q]] for q in held) / self.total[k]


def weights(docs: DataFrame) -> dict[bytes, float]:
    """Inverse document frequencies over all documents of the templates' words, a few hundred at most."""
    vocabulary = sorted({w for t in templates() for w in t.words})
    held = frozenset(vocabulary)

    def run(it: Iterator) -> Iterator:
        n, total = defaultdict(int), 0
        for (texts,) in batches(it, "text"):
            total += len(texts)
            for t in texts:
                for w in held.intersection(words(t)):
                    n[w] += 1
        yield pa.record_batch([pa.array([*n, b""], pa.binary()), pa.array([*n.values(), total], pa.int64())], names=["word", "n"])

    rows = doc_texts(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    return {w: math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) + 1 for w in vocabulary}


def license_matches(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, matches (label, base, start, length, share, whole: all mandatory phrases and enough weight) of every row."""
    index = Index(weights(docs))
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("length", pa.int32()), ("share", pa.float64()), ("whole", pa.bool_())]))

    def run(it: Iterator) -> Iterator:
        for ids, texts in batches(it, "doc_id", "text"):
            n, found = [], []
            for t in texts:
                w = words(t)
                n.append(len(w))
                found.append([{"label": (x := index.templates[k]).label, "base": x.base, "start": at, "length": size, "share": share, "whole": whole} for k, at, size, share, whole in index.match(w)])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "matches"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_words long, matches array<struct<label: string, base: boolean, start: long, length: int, share: double, whole: boolean>>")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = license_matches(documents(spark, sf_dir))
    base = F.filter("matches", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    labels = lambda a: F.array_join(F.sort_array(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    score = F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)))
    whole = F.filter("matches", lambda x: x["whole"])
    return m.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(whole).alias("labels"), score.alias("score"))
