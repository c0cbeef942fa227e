"""License scans with a positional index of rare licence words.

Licence templates are word sequences with mandatory key phrases. Document frequencies of all template words are counted
over the whole corpus, which gives each word its IDF. Of each file the licence words of highest IDF are looked up, as
many as it takes to decide on every template that the file's vocabulary allows. Postings (template, offset) turn each
occurrence into the place where the template would begin; places on which all looked-up words of a template agree are
intersected, and there the key phrases are verified word for word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import slices, utf8

#: Bytes that separate words become blanks, A-Z become small; what is not ASCII stays.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: A file may have so many words more or less than the template between its key phrases and around them.
SLACK = 24


@dataclass(frozen=True)
class Template:
    """A licence text and its mandatory key phrases, each with its offset in the text; the first one is where a match is reported.

    A base template is its phrase and nothing else.
    """

    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool = False


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def template(label: str, text: str, *phrases: str, base: bool = False) -> Template:
    words = tuple(words_of(text.encode()))
    found = []
    for phrase in phrases or (text,):
        p = tuple(words_of(phrase.encode()))
        found.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
    return Template(label, words, tuple(found), base)


BASE = (
    template("gpl", "gnu general public license", base=True),
    template("apache", "apache license", base=True),
    template("cc-by", "cc by", base=True),
    template("mit", "mit license", base=True),
)

#: Public licence texts and notices: fixed values.
NOTICES = (
    template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "permission is hereby granted free of charge",
        "the rights to use copy modify merge publish distribute sublicense and or sell",
    ),
    template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "permission to use copy modify and or distribute this software",
        "with or without fee is hereby granted",
    ),
    template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "redistribution and use in source and binary forms",
        "redistributions of source code must retain the above copyright notice",
    ),
    template(
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "apache license version 2.0",
        "you may not use this file except in compliance with the license",
    ),
    template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "under the terms of the gnu general public license as published by the free software foundation",
        "distributed in the hope that it will be useful",
    ),
    template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
        "in no event will the authors be held liable",
    ),
    template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    template(
        "mpl-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "subject to the terms of the mozilla public license v 2.0",
        "if a copy of the mpl was not distributed with this file",
    ),
    template("apache-2.0", "licensed under the apache license version 2.0", "apache license version 2.0"),
    template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    template("cc-by-nc", "licensed under cc by-nc 4.0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by-sa 4.0", "cc by sa"),
    template("cc0", "cc0 1.0 universal public domain dedication", "cc0 1.0"),
)


def inverse_frequencies(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, float]:
    """IDF of each word of the (fixed) vocabulary, log((1 + documents) / (1 + documents with it)), over all rows and whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in slices(batches, text):
            total[b""] += batch.num_rows
            for t in utf8(batch.column(text)):
                if t:
                    total.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r.word): r.n for r in rows.collect()}  # at most one row for each template word
    return {w: math.log((1 + found.get(b"", 0)) / (1 + found.get(w, 0))) for w in vocabulary}


class PositionalIndex:
    """Postings of the words of all first key phrases: word -> (template, offset within the phrase)."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float], rare_words: int):
        self.templates, self.rare_words = templates, rare_words
        self.needs = [frozenset(w for _, p in x.phrases for w in p) for x in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, x in enumerate(templates):
            for offset, word in enumerate(x.phrases[0][1]):
                self.postings.setdefault(word, []).append((t, offset))
        self.vocabulary = frozenset(w for need in self.needs for w in need)
        self.order = {w: (-idf.get(w, 0.0), w) for w in self.vocabulary}

    def looked_up(self, present: set[bytes]) -> dict[int, set[bytes]]:
        """For each template that a file with these licence words can hold: which of its words are looked up.

        The file's words are taken by falling IDF until each such template has ``rare_words`` of its first phrase, or all if it has fewer.
        """
        open_ = {t: min(self.rare_words, len(set(self.templates[t].phrases[0][1]))) for t, need in enumerate(self.needs) if need <= present}
        chosen: dict[int, set[bytes]] = {t: set() for t in open_}
        for word in sorted(present.intersection(self.postings), key=self.order.__getitem__):
            if not open_:
                break
            for t in {t for t, _ in self.postings[word]}:
                if t in open_:
                    chosen[t].add(word)
                    open_[t] -= 1
                    if not open_[t]:
                        del open_[t]
        return chosen

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Verified matches (template, word where its first key phrase begins, score) of one file, in order of template and place."""
        chosen = self.looked_up(self.vocabulary.intersection(words))
        if not chosen:
            return []
        by_word: dict[bytes, list[tuple[int, int]]] = {}
        for t, some in chosen.items():
            for word in some:
                by_word.setdefault(word, []).extend(x for x in self.postings[word] if x[0] == t)
        places: dict[tuple[int, int], set[bytes]] = {}
        for i, word in enumerate(words):
            for t, offset in by_word.get(word, ()):
                places.setdefault((t, i - offset), set()).add(word)
        found = []
        for (t, at), agree in sorted(places.items()):
            if at >= 0 and len(agree) == len(chosen[t]) and (score := self._verify(self.templates[t], words, at)):
                found.append((t, at, score))
        return found

    def _verify(self, x: Template, words: list[bytes], at: int) -> float:
        """0 unless all key phrases stand where they should, with some slack; else the share of the template's words that are met in order."""
        first, phrase = x.phrases[0]
        if tuple(words[at : at + len(phrase)]) != phrase:
            return 0.0
        for offset, other in x.phrases[1:]:
            low = max(0, at + offset - first - SLACK)
            stretch = words[low : at + offset - first + SLACK + len(other)]
            if not any(tuple(stretch[i : i + len(other)]) == other for i in range(len(stretch) - len(other) + 1)):
                return 0.0
        return in_order(x.words, words[max(0, at - first - SLACK) : at - first + len(x.words) + SLACK]) / len(x.words)


def in_order(words: tuple[bytes, ...], window: list[bytes]) -> int:
    """How many of ``words`` are met in order, going through the window once; a word that is not ahead is skipped."""
    found = i = 0
    for w in words:
        try:
            i = window.index(w, i) + 1
            found += 1
        except ValueError:
            continue
    return found


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, templates: tuple[Template, ...] = BASE + NOTICES, rare_words: int = 2) -> DataFrame:
    """One row (doc_id, n_words, matches) per row of ``docs``; matches: array of (label, base, word, n_words, score).

    A match gives the word where the first key phrase begins (from 0) and its length. Whole texts are scanned, every place
    counts, however many words have to be looked up for it. Null and empty texts have no words and no matches. Ties in IDF go to
    the word first by bytes, and change no result. Rows repeat as they came; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    vocabulary = {w for x in templates for _, p in x.phrases for w in p}
    index = PositionalIndex(templates, inverse_frequencies(docs, "text", vocabulary), rare_words)
    match = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, matches = [], []
            for t in utf8(batch.column("text")):
                words = words_of(t) if t else []
                sizes.append(len(words))
                matches.append([{"label": templates[k].label, "base": templates[k].base, "word": at, "n_words": len(templates[k].phrases[0][1]), "score": s} for k, at, s in index.scan(words)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(matches, match)], names=["doc_id", "n_words", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, n_words bigint, matches array<struct<label:string,base:boolean,word:bigint,n_words:bigint,score:double>>")


def license_digest(scans: DataFrame) -> DataFrame:
    """Counts, first and last places and label lists of ``scan_licenses`` rows."""
    base = F.filter("matches", lambda m: m["base"])
    words = F.transform(base, lambda m: m["word"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    return scans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The whole result in SQL: phrases and windows of every template by list functions, at each place where a first phrase stands."""
    text = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    rows = ", ".join(f"('{x.label}', {str(x.base).lower()}, {text(x.words)}, {x.phrases[0][0]}, {text(x.phrases[0][1])}, [{', '.join(f'{{o: {o}, p: {text(p)}}}' for o, p in x.phrases[1:])}]::STRUCT(o BIGINT, p VARCHAR[])[])" for x in BASE + NOTICES)
    return f"""
WITH t(label, base, words, o, phrase, more) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT k, w, unnest(range(len(w)))::BIGINT AS i FROM d WHERE len(list_intersect(w, ['license', 'cc', 'cc0', 'permission', 'redistribution', 'unencumbered', 'mozilla'])) > 0),
a AS (SELECT k, w, i, t.* FROM p JOIN t ON w[i + 1] = phrase[1] WHERE w[i + 1 : i + len(phrase)] = phrase),
v AS (SELECT * FROM a WHERE len(list_filter(more, lambda m: len(list_filter(range(greatest(0, i + m.o - o - {SLACK}), least(len(w) - len(m.p), i + m.o - o + {SLACK}) + 1), lambda j: w[j + 1 : j + len(m.p)] = m.p)) > 0)) = len(more)),
s AS (SELECT k, label, base, i, list_reduce(list_prepend({{pos: 0::BIGINT, n: 0::BIGINT, w: ''}}, list_transform(words, lambda x: {{pos: 0::BIGINT, n: 0::BIGINT, w: x}})),
        lambda a, b: CASE WHEN list_position(w[greatest(0, i - o - {SLACK}) + 1 + a.pos : i - o + len(words) + {SLACK}], b.w) > 0
          THEN {{pos: a.pos + list_position(w[greatest(0, i - o - {SLACK}) + 1 + a.pos : i - o + len(words) + {SLACK}], b.w), n: a.n + 1, w: ''}} ELSE a END).n / len(words) AS score FROM v),
m AS (SELECT k, count(*) FILTER (base) AS n, min(i) FILTER (base) AS low, max(i) FILTER (base) AS high, max(score) AS score,
        list_sort(list_distinct(list(label) FILTER (base))) AS b, list_sort(list_distinct(list(label))) AS l FROM s GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low AS first_word, high AS last_word,
  coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN m USING (k)
"""


ORACLE_SQL = _oracle()
