"""Licence scan with a positional index of rare words.

Templates (licence phrases and notices) are indexed as postings: word -> (template, place). The rarity of a licence word
is its inverse document frequency over all documents. Then every text is read once more:

* a phrase that must stand word for word is looked up by its rarest word; each place of that word gives a start, and the
  other words must stand at their relative places (all places are found);
* a longer notice is looked up by its own rarest words, as many as it takes that no text can reach ``least_share``
  without one of them at its place; each of their occurrences points to a start, and every start is scored by the share
  of the template's rarity that stands at its place, and needs ``least_votes`` different words there and the template's
  key phrases within it. So no notice is lost, whatever else stands in the file.

Null and empty texts have no words; a repeated row is scanned alike; ties of rarity go to the earlier word in the
template list; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import record, slices, texts
from opslens.llm.wordscan import Lookup, Powers, Words

# The contract's phrases and their labels.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"),
           ("mit", "mit license"))
# Notices of common public licences with the phrases that must stand in them.
NOTICES = (
    ("agpl-notice", "it under the terms of the gnu affero general public license as published by the free software "
     "foundation", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", ("source and binary forms", "with or without modification")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation",
     ("gnu general public license", "free software foundation")),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", ("with or without fee", "hereby granted")),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", ("hereby granted free of charge", "obtaining a copy")),
    ("mit-release", "released under the mit license", ("the mit license",)),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
)
SCAN = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double")
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                   ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                   ("score", pa.float64())])


class Index:
    """The templates by words, and the rarity of their words once it is known."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(label, text.split()) for label, text in phrases]
        self.notices = [(label, text.split(), [k.split() for k in keys]) for label, text, keys in notices]
        seen: dict[str, int] = {}
        for _, words in [*self.phrases, *[n[:2] for n in self.notices]]:
            for w in words:
                seen.setdefault(w, len(seen))
        self.words, self.id = list(seen), seen
        self.rarity = np.ones(len(self.words))

    def lookup(self, want: np.ndarray, least_share: float) -> np.ndarray:
        """The rarest of these words without which less than the share of rarity is left; a start needs one of them."""
        weight, used = self.rarity[want], np.zeros(len(want), bool)
        for v in want[np.argsort(-weight, kind="stable")]:
            if weight[~used].sum() < (least_share - 1e-9) * weight.sum():
                break
            used |= want == v
        return np.flatnonzero(used)

    def places(self, ids: np.ndarray, doc: np.ndarray, words: list[str]) -> np.ndarray:
        """Starts at which these words stand consecutively in one text; the rarest word is looked up first."""
        want = np.array([self.id[w] for w in words])
        by = np.argsort(-self.rarity[want], kind="stable")
        at = np.flatnonzero(ids == want[by[0]]) - by[0]
        at = at[(at >= 0) & (at + len(words) <= len(ids))]
        for j in by[1:]:
            at = at[ids[at + j] == want[j]]
        return at[doc[at] == doc[at + len(words) - 1]] if len(at) else at


def document_frequency(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """(documents, documents per licence word), over all texts; one row of counts per task."""
    n_words = len(index.words)

    def run(batches):
        lookup, powers, got, n = Lookup(index.words), Powers(), np.zeros(n_words, np.int64), 0
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            n += batch.num_rows
            for a, b in slices(batch, 1):
                w = Words(body.slice(a, b - a).to_pylist(), powers)
                ids = lookup.ids(w.hash)
                hit = np.flatnonzero(ids >= 0)
                got += np.bincount(np.unique(w.doc[hit] * n_words + ids[hit]) % n_words, minlength=n_words)
        if n:
            yield pa.RecordBatch.from_pydict({"word": pa.array(range(-1, n_words), pa.int32()),
                                              "n": pa.array([n, *got.tolist()], pa.int64())})

    sums = texts(docs).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in sums.collect()}  # a row per licence word
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(n_words)], np.int64)


def scan(docs: DataFrame, *, phrases=PHRASES, notices=NOTICES, least_votes: int = 3, least_share: float = 0.7,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document."""
    index = Index(phrases, notices)
    n, df = document_frequency(docs, index)
    index.rarity = np.log((n + 1) / (df + 0.5))

    def run(batches):
        lookup, powers = Lookup(index.words), Powers()
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            for a, b in slices(batch, 1):
                w = Words(body.slice(a, b - a).to_pylist(), powers)
                ids = lookup.ids(w.hash)
                n_docs = b - a
                base, also, score = [[] for _ in range(n_docs)], [set() for _ in range(n_docs)], np.zeros(n_docs)
                for label, words in index.phrases:
                    for p in index.places(ids, w.doc, words):
                        base[w.doc[p]].append((int(w.index[p]), label))
                        score[w.doc[p]] = 1.0
                for d, label, share in notices_in(index, w, ids, least_votes, least_share):
                    also[d].add(label)
                    score[d] = max(score[d], share)
                yield record({
                    "doc_id": batch.column(0).slice(a, b - a), "n_words": w.count, "n_base": [len(x) for x in base],
                    "first_word": [min(x)[0] if x else None for x in base],
                    "last_word": [max(x)[0] if x else None for x in base],
                    "base_labels": [",".join(sorted({y for _, y in x})) for x in base],
                    "labels": [",".join(sorted({y for _, y in x} | z)) for x, z in zip(base, also)],
                    "score": score,
                }, ARROW)

    return texts(docs, key, text).mapInArrow(run, SCAN)


def notices_in(index: Index, w: Words, ids, least_votes: int, least_share: float):
    """(document, label, greatest share of rarity) of the notices in each text."""
    first, last = np.cumsum(w.count) - w.count, np.cumsum(w.count)
    for label, words, keys in index.notices:
        want = np.array([index.id[x] for x in words])
        phrases = [np.array([index.id[x] for x in key]) for key in keys]
        # a notice needs its key phrases, so only texts with the rarest key word can hold it
        gate = max((v for phrase in phrases for v in phrase), key=lambda v: index.rarity[v])
        open_ = np.zeros(len(w.at), bool)
        open_[w.doc[ids == gate]] = True
        if not open_.any():
            continue
        hit = np.flatnonzero(ids >= 0)
        hit = hit[open_[w.doc[hit]]]
        spots = []
        for place in index.lookup(want, least_share):
            at = hit[ids[hit] == want[place]]
            spots.append(np.stack([w.doc[at], at - place]))
        doc, start = np.unique(np.concatenate(spots, axis=1), axis=1)
        weight, of = index.rarity[want], {v: np.flatnonzero(want == v) for v in np.unique(want)}
        best = np.zeros(len(w.at))
        for a in range(0, len(doc), 4096):
            d = doc[a:a + 4096]
            at = start[a:a + 4096, None] + np.arange(len(want))
            inside = (at >= first[d, None]) & (at < last[d, None])
            got = np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], -1)
            same = got == want
            share = np.where(same, weight, 0.0).sum(axis=1) / weight.sum()
            votes = sum(same[:, places].any(axis=1) for places in of.values())
            ok = (share >= least_share) & (votes >= min(least_votes, len(of)))
            for phrase in phrases:
                starts = range(len(want) - len(phrase) + 1)
                ok[ok] = np.any([(got[ok, o:o + len(phrase)] == phrase).all(axis=1) for o in starts], axis=0)
            np.maximum.at(best, d[ok], share[ok])
        for d in np.flatnonzero(best):
            yield int(d), label, float(best[d])
