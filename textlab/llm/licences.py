"""License scans by a positional rare-token index.

Templates are short licence notices, each with a mandatory key phrase. One pass
counts in how many documents each licence word occurs; a template is indexed by
its ``RARE`` words of highest inverse document frequency, as postings (word ->
template, position). A file's occurrences of indexed words vote for template
starts (own position minus the posting's); where ``RARE`` - 1 or more distinct
words agree on a start, the template's key phrase must stand word for word at
its place. The score is the share of the template's words found in place.

Base phrases are counted wherever their words stand one after the other.

Both passes read whole texts in Arrow batches and shuffle nothing but the word
counts (one row a task and licence word); words are compared by 64-bit hashes.

Null and empty texts have no words and no labels, score 0. Null ids pass
through, repeated rows are scanned alike, other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.hashing import runs_of, word_hashes

# fixed values: base phrases and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# notices (public licence texts, first words) and the phrase that must be there
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
     "granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license", "apache license version 2"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
            "by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
     "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
]
RARE = 3
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for p in BASE for w in p.split()})


def _hash_of(words) -> np.ndarray:
    return word_hashes([" ".join(words)], gaps_of="other")[0]


def _frequency_batches(batches):
    vocabulary = _hash_of(VOCABULARY)
    order = np.argsort(vocabulary)
    ranked = vocabulary[order]
    seen, docs = np.zeros(len(ranked), np.int64), 0
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, b in runs_of(texts):
            h, ptr = word_hashes(texts[a:b], gaps_of="other")
            at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
            hit = np.flatnonzero(ranked[at] == h)
            doc = np.searchsorted(ptr, hit, "right") - 1
            pair = np.unique(doc * len(ranked) + at[hit])
            seen += np.bincount(pair % len(ranked), minlength=len(ranked))
        docs += len(pdf)
    yield pd.DataFrame({"word": [VOCABULARY[i] for i in order] + [""], "n": [*seen, docs]})


def document_frequencies(docs: DataFrame) -> tuple[dict, int]:
    """Documents that hold each licence word (a fixed, small list), and all documents."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(
        _frequency_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: int(r["n"]) for r in rows}
    total = got.pop("", 0)
    return got, total


def rare_index(frequency: dict, total: int) -> dict:
    """word -> [(template, position)] for the rarest words of every template."""
    idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) for w in VOCABULARY}
    index: dict = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        once = [w for w, c in Counter(words).items() if c == 1]
        for w in sorted(once, key=lambda w: (-idf[w], w))[:RARE]:
            index.setdefault(w, []).append((t, words.index(w)))
    return index


def _places(h, ptr, phrase_hashes):
    """Starts of a phrase's words one after the other within one text."""
    n, k = len(h), len(phrase_hashes)
    if n < k:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[: n - k + 1] == phrase_hashes[0])
    for j in range(1, k):
        at = at[h[at + j] == phrase_hashes[j]]
    doc = np.searchsorted(ptr, at, "right") - 1
    return at[at + k <= ptr[doc + 1]]


def _match(h, ptr, index, templates, keys):
    """(doc, template, share of its words in place) of verified notices."""
    votes: dict = {}
    for w, postings in index.items():
        for p in np.flatnonzero(h == w).tolist():
            doc = int(np.searchsorted(ptr, p, "right")) - 1
            for t, q in postings:
                votes.setdefault((doc, t, p - q), set()).add(w)
    out = []
    for (doc, t, start), words in votes.items():
        if len(words) < min(RARE, sum(any(x == t for x, _ in v) for v in index.values())) - 1 or not words:
            continue
        offset, key = keys[t]
        a, b = int(ptr[doc]), int(ptr[doc + 1])
        if start + offset < a or start + offset + len(key) > b or not (h[start + offset: start + offset + len(key)] == key).all():
            continue
        lo, hi = max(start, a), min(start + len(templates[t]), b)
        share = float((h[lo:hi] == templates[t][lo - start: hi - start]).sum()) / len(templates[t])
        out.append((doc, t, share))
    return out


def _label_batches(index_words: dict):
    def run(batches):
        index = {int(_hash_of([w])[0]): p for w, p in index_words.items()}
        index = {np.uint64(k): v for k, v in index.items()}
        templates = [_hash_of(text.split()) for _, text, _ in TEMPLATES]
        keys = []
        for _, text, key in TEMPLATES:
            words, part = text.split(), key.split()
            keys.append((next(i for i in range(len(words)) if words[i: i + len(part)] == part), _hash_of(part)))
        base = {p: _hash_of(p.split()) for p in BASE}
        for pdf, (x, y) in ((pdf, run) for pdf in batches for run in runs_of(pdf["text"].tolist())):
            pdf = pdf.iloc[x:y]
            h, ptr = word_hashes(pdf["text"].tolist(), gaps_of="other")
            n = len(pdf)
            n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
            base_labels, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
            for phrase, hashes in base.items():
                for p in _places(h, ptr, hashes).tolist():
                    doc = int(np.searchsorted(ptr, p, "right")) - 1
                    at = p - int(ptr[doc])
                    n_base[doc] += 1
                    first[doc] = at if first[doc] is None else min(first[doc], at)
                    last[doc] = at if last[doc] is None else max(last[doc], at)
                    base_labels[doc].add(BASE[phrase])
                    labels[doc].add(BASE[phrase])
                    score[doc] = 1.0
            for doc, t, share in _match(h, ptr, index, templates, keys):
                labels[doc].add(TEMPLATES[t][0])
                score[doc] = max(score[doc], share)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "n_words": np.diff(ptr), "n_base": n_base,
                "first_word": pd.array(first, "Int64"), "last_word": pd.array(last, "Int64"),
                "base_labels": [",".join(sorted(x)) for x in base_labels],
                "labels": [",".join(sorted(x)) for x in labels], "score": score})
    return run


def licence_labels(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base places and labels, all labels and the best score."""
    frequency, total = document_frequencies(docs)
    # ids travel through pandas as strings: numbers with nulls among them would turn into floats
    slim = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInPandas(_label_batches(rare_index(frequency, total)),
                           "doc_id string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                           "base_labels string, labels string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
