"""Licence scans by a positional index of rare words.

The templates are short licence notices, each with key phrases that a text must have. A first pass counts in how many documents
each template word lies: the rarest words of a template, by these counts of all documents, are its anchors, with their
positions. The second pass looks up the words of every document that are anchors of a template. A hit says where the template would begin
in the document, the word's place less its position in the template; where enough distinct anchors of one template agree on a
beginning, but for a few words put in or left out, the key phrases are looked for at their places, and only if all stand
there the template's label is given.

A document's score is the largest share of a template's distinct words around such a place, 1 with a base phrase and 0
without a label. Null text is empty and has no labels. Repeated rows give equal rows; an empty table gives none; other
columns are ignored. The words of the templates bound what goes to the driver and back.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold.llm.text import documents

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, notice, key phrases. The notices are those that licences ask to be put into files.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "sublicense and or sell copies"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted", "appear in all copies"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "must retain the above copyright notice"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["permission is granted to anyone to use this software", "alter it and redistribute it freely"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["the apache license version 2 0", "except in compliance with the license"]),
    ("apache-2", "licensed under the apache license version 2", ["apache license version 2"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["terms of the gnu general public license", "version 2 of the license"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["terms of the gnu general public license", "version 3 of the license"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["the mozilla public license v 2 0"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["the eclipse public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "into the public domain"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["licensed under cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["licensed under cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["licensed under cc by 4"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
#: Anchors of a template, the share of them that has to agree, words that a beginning may be off, words of a band of beginnings.
ANCHORS, AGREE, SLACK, BAND = 6, 0.6, 4, 8
_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
_SPACED = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased."""
    return (text or "").encode().translate(_SPACED).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    #: (position, words) of the key phrases
    keys: list[tuple[int, list[bytes]]]


def templates(given=TEMPLATES) -> list[Template]:
    out = []
    for label, notice, phrases in given:
        own = words(notice)
        keys = [(next(k for k in range(len(own)) if own[k : k + len(p)] == p), p) for p in map(words, phrases)]
        out.append(Template(label, own, keys))
    return out


class Index:
    """Anchors: word -> (template, position)s; ``need``: the anchors that have to agree, of each template."""

    def __init__(self, given: list[Template], documents_with: dict[bytes, int]):
        self.templates, self.anchors, self.need = given, defaultdict(list), []
        self.base = [(words(p), label) for p, label in BASE.items()]
        #: a base phrase is looked for around its rarest word
        self.rarest: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (phrase, _) in enumerate(self.base):
            word = min(phrase, key=lambda w: (documents_with.get(w, 0), w))
            self.rarest[word].append((k, phrase.index(word)))
        for k, t in enumerate(given):
            rare = sorted(set(t.words), key=lambda w: (documents_with.get(w, 0), w))[:ANCHORS]
            self.need.append(-int(-AGREE * len(rare) // 1))
            for at, w in enumerate(t.words):
                if w in rare:
                    self.anchors[w].append((k, at))

    def base_places(self, text: list[bytes]) -> list[tuple[int, str]]:
        """(word, label) of all places of the base phrases."""
        out = []
        for at, w in enumerate(text):
            for k, shift in self.rarest.get(w, ()):
                phrase, label = self.base[k]
                if at >= shift and text[at - shift : at - shift + len(phrase)] == phrase:
                    out.append((at - shift, label))
        return out

    def found(self, text: list[bytes]) -> dict[int, float]:
        """The templates that stand in a text, with the largest share of their words there."""
        anchors = self.anchors
        agreed: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for at, w in enumerate(text):
            if w in anchors:
                for k, position in anchors[w]:
                    band = (at - position) // BAND
                    agreed[k, band].add(w)  # a beginning may lie in this band or be counted with the one before
                    agreed[k, band - 1].add(w)
        out: dict[int, float] = {}
        for (k, band), own in agreed.items():
            if len(own) >= self.need[k] and self._keys_stand(text, self.templates[k], band):
                out[k] = max(out.get(k, 0.0), self._share(text, self.templates[k], band))
        return out

    @staticmethod
    def _keys_stand(text: list[bytes], t: Template, band: int) -> bool:
        first, end = band * BAND - SLACK, (band + 2) * BAND + SLACK
        return all(any(text[s : s + len(p)] == p for s in range(max(0, first + at), max(0, end + at))) for at, p in t.keys)

    @staticmethod
    def _share(text: list[bytes], t: Template, band: int) -> float:
        around = set(text[max(0, band * BAND - SLACK) : max(0, (band + 2) * BAND + SLACK + len(t.words))])
        own = set(t.words)
        return len(own & around) / len(own)


def documents_with(docs: DataFrame, given: list[Template]) -> dict[bytes, int]:
    """In how many rows of docs each word of the templates and the base phrases lies; as many entries as these have words at most."""
    vocabulary = {w for t in given for w in t.words} | {w for p in BASE for w in words(p)}

    def count(batches):
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                n.update(vocabulary.intersection(words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in rows.collect()}


def scan(docs: DataFrame, given: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs."""
    given = given or templates()
    index = Index(given, documents_with(docs, given))
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = words(x.as_py())
                base, more = index.base_places(text), index.found(text)
                at, labels = [p for p, _ in base], {label for _, label in base}
                score = 1.0 if base else max(more.values(), default=0.0)
                rows.append((len(text), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {given[k].label for k in more})), score))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]], ["doc_id", *[n for n, _ in fields]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op12(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _listed(p: list[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in p) + "]"


OP12_SQL = rf"""
with tw(k, pos, w) as (values {_values((k, at, w.decode()) for k, t in enumerate(templates()) for at, w in enumerate(t.words))}),
label(k, label, size) as (values {_values((k, t.label, len(t.words)) for k, t in enumerate(templates()))}),
keys(k, pos, phrase) as (values {", ".join(f"({k}, {at}, {_listed(p)})" for k, t in enumerate(templates()) for at, p in t.keys)}),
base(phrase, label) as (values {", ".join(f"({_listed(words(p))}, '{label}')" for p, label in BASE.items())}),
d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from documents),
w as (
  select r, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as p from d),
df as (
  select w, count(distinct r) as n from w where w in (select w from tw) group by w),
own as (
  select distinct k, tw.w, coalesce(n, 0) as n from tw left join df using (w)),
anchor as (
  select k, w from own qualify row_number() over (partition by k order by n, w) <= {ANCHORS}),
need as (
  select k, ceil({AGREE} * count(*)) as need from anchor group by k),
hit as (
  select r, k, w, floor((p - pos) / {BAND}.0)::bigint as band from w join anchor using (w) join tw using (k, w)),
agreed as (
  select r, k, b.band from (select r, k, w, unnest([band, band - 1]) as band from hit) b join need using (k) group by r, k, b.band, need having count(distinct w) >= need),
stand as (
  select r, k, band from agreed a join d using (r)
  where not exists (select 1 from keys where keys.k = a.k and not list_bool_or(list_transform(range(greatest(0, band * {BAND} - {SLACK} + pos), greatest(0, (band + 2) * {BAND} + {SLACK} + pos)), lambda s: ws[s + 1 : s + len(phrase)] = phrase)))),
share as (
  select r, s.k, s.band, any_value(label.label) as label, count(distinct o.w) filter (where list_contains(ws[greatest(0, s.band * {BAND} - {SLACK}) + 1 : greatest(0, (s.band + 2) * {BAND} + {SLACK} + size)], o.w)) / count(distinct o.w) as share
  from stand s join label using (k) join own o using (k) join d using (r) group by r, s.k, s.band),
places as (
  select r, b.label, p from w join base b on w.w = b.phrase[1] join d using (r) where ws[p + 1 : p + len(b.phrase)] = b.phrase),
pb as (
  select r, count(*) as n, min(p) as first_word, max(p) as last_word, string_agg(distinct label, ',' order by label) as labels from places group by r),
pl as (
  select r, string_agg(distinct label, ',' order by label) as labels, max(share) as score from (select r, label, share from share union all select r, label, 1.0 from places) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(pb.labels, '') as base_labels,
  coalesce(pl.labels, '') as labels, coalesce(score, 0)::double as score
from d left join pb using (r) left join pl using (r)
"""
