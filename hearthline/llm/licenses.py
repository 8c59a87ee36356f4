"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a sentence, over the lines it is wrapped into, or a line. It matches a template if it holds at
least `least` of the template's distinct words. Template words are ordered by their frequency over all documents, rarest first: a block
that matches has one of a template's |t| - ceil(least |t|) + 1 rarest words (prefix filter), at least
ceil(least |t|) words (length filter), and, at the place of the first common word, enough words left on
both sides (positional filter); what passes is verified. All that meet the threshold are told in `templates`.

A short template meets the threshold without the very word that names its licence, and sister licences share most of
their words. So a template gives its label only where its telling phrases stand in the block, word after word (a name,
a version; one of several ways to say it), and where no other matching template with its own telling phrases accounts
for more: one whose words in the block are all of this one's and more, or the same and a greater share of its own.
Templates
are a fixed small list, so their index is sent to every task; documents are not shuffled. The score is 1 where a
phrase stands, else the greatest share of a template that a block holds; equal shares all count.

Null and empty texts have no words and no labels. Repeated rows are judged each on its own. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.decontaminate import WORD_BYTES, words_of

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Statements of public licences by which their texts are known, their labels, and the phrases that must
# stand there for the label (each one, in one of the ways that are parted by |). Sentences that several licences share
# (disclaimers of warranty) tell none and are left out.
TEMPLATES = [
    ("mit", "released under the mit license", ("mit",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("free of charge", "obtaining a copy")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial portions",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("apache", "released under the apache license", ("apache license|apache software license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache", "license version 2|license 2|apache 2")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache", "license version 2|license 2|apache 2")),
    ("gpl", "released under the gpl license", ("gpl",)),
    ("gpl", "licensed under the gnu general public license", ("gnu general public license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3|license v3|license 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2|license v2|license 2")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("lgpl", "released under the lgpl license", ("lgpl",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license", "version 3|license v3|license 3")),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("affero general public license", "version 3")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4",)),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4",)),
    ("cc-by-4.0", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-sa-4.0", "licensed under the creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4|attribution share alike 4",)),
    ("cc-by-nc-4.0", "licensed under the creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4|attribution non commercial 4",)),
    ("cc-by-nc-sa-4.0", "licensed under the creative commons attribution noncommercial sharealike 4 0 international license", ("noncommercial sharealike 4|non commercial share alike 4|noncommercial share alike 4",)),
    ("cc0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("public domain",)),
    ("bsd", "released under the bsd license", ("bsd",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", ("mpl",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "this notice may not be removed or altered from any source distribution", ("removed or altered",)),
]
BLOCK_END = re.compile(rb"(?<=[.!?])[\x09-\x0D\x20]+|\n+")
#: Blocks go over single line ends.
JOINED_END = re.compile(rb"(?<=[.!?])[\x09-\x0D\x20]+|\n[\x09-\x0D\x20]*\n")


class TemplateIndex:
    """Prefix lists of templates (label, text, telling phrases) whose words are ordered by a corpus's frequencies."""

    def __init__(self, templates: list[tuple], frequency: dict[bytes, int], least: float):
        self.least, self.templates, self.prefixes, self.telling = least, [], {}, []
        words = {w for _, text, *_ in templates for w in text.encode().split()}
        self.rank = {w: k for k, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        for label, text, *telling in templates:
            own = sorted({self.rank[w] for w in text.encode().split()})
            need = math.ceil(least * len(own) - 1e-9)
            for at, r in enumerate(own[: len(own) - need + 1]):
                self.prefixes.setdefault(r, []).append((len(self.templates), at))
            self.templates.append((label, own, need))
            self.telling.append([[f" {way} ".encode() for way in phrase.split("|")] for phrase in (telling[0] if telling else ())])
        self.prefix_words = {w for w, r in self.rank.items() if r in self.prefixes}

    def block(self, words: list[bytes]) -> Iterator[tuple[int, float]]:
        """(number, containment) of each template that a block's words meet."""
        return ((t, len(both) / len(self.templates[t][1])) for t, both in self.met(words))

    def settled(self, words: list[bytes], met: list[tuple[int, set[int]]] | None = None) -> Iterator[tuple[str, float]]:
        """(label, containment) of the templates that name a block's licences."""
        line = b" " + b" ".join(words) + b" "
        told = [(t, both) for t, both in (self.met(words) if met is None else met) if all(any(way in line for way in ways) for ways in self.telling[t])]
        size = lambda t: len(self.templates[t][1])
        for t, both in told:
            if not any(both < other or both == other and size(u) < size(t) for u, other in told):
                yield self.templates[t][0], len(both) / size(t)

    def met(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(number, common words) of each template that a block's words meet: the join itself, whole."""
        have = sorted({self.rank[w] for w in words if w in self.rank})
        tried = set()
        for k, r in enumerate(have):
            for t, at in self.prefixes.get(r, ()):
                _, own, need = self.templates[t]
                if t in tried or len(have) < need or 1 + min(len(have) - k - 1, len(own) - at - 1) < need:
                    continue  # the first common word decides; a later one leaves fewer
                tried.add(t)
                both = set(own).intersection(have)
                if len(both) >= need:
                    yield t, both


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    line, out, starts = b" " + b" ".join(words) + b" ", [], None
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        at = line.find(sought)
        while at >= 0:
            if starts is None:
                starts, position = [], 0
                for w in words:
                    starts.append(position)
                    position += len(w) + 1
            out.append((bisect_right(starts, at) - 1, label))
            at = line.find(sought, at + 1)
    return out


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each template word occurs in all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(w for w in words_of(text.as_py()) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return {r["word"].encode(): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, least: float = 0.8, templates: list[tuple] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document, and templates: the
    numbers (from 0) of all templates that some block meets at the threshold."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    frequency = frequencies(docs, {w for _, text, *_ in templates for w in text.encode().split()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, frequency, least)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                words = data.translate(WORD_BYTES).split()
                places = phrase_places(words, phrases)
                base, found, numbers, score = {label for _, label in places}, set(), set(), 1.0 if places else 0.0
                if not index.prefix_words.isdisjoint(words):
                    for joined in JOINED_END.split(data):
                        for block in {joined, *BLOCK_END.split(joined)}:
                            words_of_block = block.translate(WORD_BYTES).split()
                            met = [*index.met(words_of_block)]
                            numbers.update(t for t, _ in met)
                            for label, share in index.settled(words_of_block, met) if met else ():
                                found.add(label)
                                score = max(score, share)
                at = [p for p, _ in places]
                for column, value in zip(out, (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score, sorted(numbers))):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32())]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))], ["doc_id", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates array<int>")
