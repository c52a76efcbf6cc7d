"""License notices by a positional index over rare words.

Documents are first counted by Spark: in how many does each word of the templates occur? The words that are rarest by that
count are the only ones that are looked up. In a file, the places of those it holds are taken against the places the word
has in templates; words of one notice agree in the difference, so their postings are intersected by relative position.
What agrees is compared with the template, and stands only if the template's mandatory phrases are there as well.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.shared import pick

# Digits, lower-cased letters and all that is not ASCII belong to words, everything else parts them.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RARE = 6  # words of a template that are looked up
AGREE = 0.5  # share of those, of the ones looked up, that must stand in one line with the template
SLACK = 4  # words that may have been put in or left out between two of them
LEAST_SHARE = 0.7  # of a template's words

FOUND = "array<struct<label: string, exact: boolean, start: long, length: long, share: double>>"


class Template(NamedTuple):
    """A notice, and the phrases of it that must be there word for word. An exact one is a phrase as a whole."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    exact: bool = False


# Phrases and their labels.
PHRASES = [
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
]

# Usual notices and the beginning of license texts, by the names of the SPDX list.
NOTICES = [
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met: Redistributions of source code must retain the above copyright "
             "notice, this list of conditions and the following disclaimer.",
             ("redistribution and use in source and binary forms", "this list of conditions and the following disclaimer")),
    Template("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
             "or promote products derived from this software without specific prior written permission.",
             ("used to endorse or promote products derived from this software", "specific prior written permission")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
             "to this work.", ("waived all copyright and related or neighboring rights",)),
    Template("GPL-2.0", "GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("GPL-3.0", "GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the "
             "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
             "your option) any later version.", ("gnu general public license as published by the free software foundation",
                                                 "either version 2 of the license")),
    Template("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
             "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
             "your option) any later version.", ("gnu general public license as published by the free software foundation",
                                                 "either version 3 of the license")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies.",
             ("for any purpose with or without fee is hereby granted", "permission notice appear in all copies")),
    Template("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
             "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
             "not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.",
             ("free and unencumbered software released into the public domain",)),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software.",
             ("in no event will the authors be held liable for any damages arising from the use of this software",)),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def vocabulary(templates: Iterable[Template]) -> list[str]:
    return sorted({word.decode() for template in templates for word in words_of(template.text.encode())})


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each of the words; one row a word reaches the driver."""
    wanted = {word.encode() for word in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).cast(pa.binary()):
                counted.update(wanted.intersection(words_of(text.as_py() or b"")))
        told = [*((word.decode(), times) for word, times in counted.items()), (None, n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in told], pa.string()), pa.array([t for _, t in told], pa.int64())],
                                         names=["word", "n"])

    rows = pick(docs, "text").select(F.col("text").cast("string")).mapInArrow(run, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {row.word: row.n for row in rows}
    return found.pop(None, 0), found


@dataclass
class Index:
    """Postings of the rarest words of the templates: word to (template, place)."""

    templates: list[Template]
    words: list[list[bytes]] = field(default_factory=list)
    needed: list[int] = field(default_factory=list)
    phrases: list[list[tuple[int, list[bytes]]]] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, templates: list[Template], documents: int, frequencies: dict[str, int]) -> Index:
        index, postings = cls(templates), defaultdict(list)
        for number, template in enumerate(templates):
            words = words_of(template.text.encode())
            rarest = sorted(set(words), key=lambda w: (-math.log((documents + 1) / (frequencies.get(w.decode(), 0) + 1)), w))
            looked_up = set(rarest[:1] if template.exact else rarest[:RARE])
            for place, word in enumerate(words):
                if word in looked_up:
                    postings[word].append((number, place))
            index.words.append(words)
            index.needed.append(max(1, math.ceil(AGREE * len(looked_up))))
            index.phrases.append([(_place(words, parts), parts) for parts in map(lambda p: words_of(p.encode()), template.phrases)])
        index.postings = dict(postings)
        return index

    def search(self, words: list[bytes]) -> Iterator[tuple[str, bool, int, int, float]]:
        """label, exact, start, length, share of every notice in the words of a file."""
        present = self.postings.keys() & set(words)
        if not present:
            return
        shifts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)  # template to relative positions, ascending
        for at, word in enumerate(words):
            if word in present:
                for number, place in self.postings[word]:
                    shifts[number].append((at - place, word))
        for number, found in shifts.items():
            template, said = self.templates[number], self.words[number]
            if template.exact:
                starts = sorted({shift for shift, _ in found})
                yield from ((template.label, True, at, len(said), 1.0) for at in starts if at >= 0 and words[at:at + len(said)] == said)
            else:
                for low, high in _agreeing(sorted(found), self.needed[number]):
                    begin, end = max(low, 0), high + len(said)
                    share = (Counter(said) & Counter(words[begin:end])).total() / len(said)
                    if share >= LEAST_SHARE and all(_stands(words, parts, low + place - SLACK, high + place + SLACK)
                                                    for place, parts in self.phrases[number]):
                        yield template.label, False, begin, min(end, len(words)) - begin, share


def _place(words: list[bytes], parts: list[bytes]) -> int:
    for at in range(len(words) - len(parts) + 1):
        if words[at:at + len(parts)] == parts:
            return at
    raise ValueError(f"a mandatory phrase is not in its template: {b' '.join(parts).decode()}")


def _stands(words: list[bytes], parts: list[bytes], first: int, last: int) -> bool:
    return any(words[at:at + len(parts)] == parts for at in range(max(first, 0), last + 1))


def _agreeing(found: list[tuple[int, bytes]], needed: int) -> Iterator[tuple[int, int]]:
    """Lowest and highest relative position of every run of at least ``needed`` different words with gaps up to the slack."""
    at = 0
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end][0] - found[end - 1][0] <= SLACK and found[end][0] - found[at][0] <= RARE * SLACK:
            end += 1
        if len({word for _, word in found[at:end]}) >= needed:
            yield found[at][0], found[end - 1][0]
        at = end


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words and found: label, exact, start, length (in words) and share of words of every notice, for each row.

    NULL, empty and wordless texts have no words and no notices. Repeated rows get the same answer, other columns are ignored
    whatever their names, no rows give no rows, and a long text is searched as a whole. Equal rarity is settled by the word.
    """
    known = [*PHRASES, *NOTICES] if templates is None else templates
    index = Index.of(known, *document_frequencies(docs, vocabulary(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()),
                                   ("share", pa.float64())]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                sizes.append(len(words))
                found.append([dict(zip(names, place)) for place in index.search(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind)],
                                             names=["doc_id", "n_words", "found"])

    texts = pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words long, found {FOUND}")
