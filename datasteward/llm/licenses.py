"""Licence notices by fuzzy search: exact seeds of each notice locate candidates, bounded-error matching verifies them.

A notice with k errors allowed is split into k + 1 seeds; a match with at most k edits leaves one of them intact. One pass
of an automaton over the words of the text finds all seeds of all notices, and the regex library matches the notice with at
most k edits around each. Nothing is shuffled; the work is in proportion to the text."""

from __future__ import annotations

from bisect import bisect_right

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # letters and digits, and all beyond ASCII

# Phrases whose exact places are always reported, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Short notices of public licences as words, with their labels.
NOTICES = BASE + (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("gnu general public license", "gpl"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("under the bsd license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons zero v1 0 universal", "cc0"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by sa 4 0", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)


def errors_allowed(notice: str, least: int = 10, most: int = 4) -> int:
    """One edit for each ``least`` characters, ``most`` at the most: none in a notice of fewer characters."""
    return min(most, len(notice) // least)


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """(place, text) of errors + 1 parts of nearly equal length that make up the notice."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8, with A-Z in lower case."""
    return text.encode().translate(_LOWER).split()


class Scanner:
    """The automaton of all seeds and the pattern of each notice."""

    def __init__(self, notices=NOTICES, base=BASE, least: int = 10, most: int = 4):
        self.base = [(f" {phrase} ", label) for phrase, label in base]
        self.notices, places = [], {}
        for phrase, label in notices:
            k = errors_allowed(phrase, least, most)
            fuzzy = f"{{e<={k}}}" if k else ""
            self.notices.append((len(phrase), k, label, regex.compile(f"(?b)(?:{regex.escape(phrase)}){fuzzy}")))
            for at, seed in seeds(phrase, k):
                places.setdefault(seed, []).append((len(self.notices) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for seed, found in places.items():
            self.automaton.add_word(seed, (len(seed), found))
        self.automaton.make_automaton()

    def _candidates(self, text: str) -> list[tuple[int, int, int]]:
        """(notice, first, last): where a match may begin by a seed, give or take its errors; one for each neighbourhood."""
        found = {(notice, end + 1 - size - at) for end, (size, where) in self.automaton.iter(text) for notice, at in where}
        out: list[tuple[int, int, int]] = []
        for notice, start in sorted(found):
            if out and out[-1][0] == notice and start - out[-1][1] <= 2 * self.notices[notice][1]:
                out[-1] = (notice, out[-1][1], start)
            else:
                out.append((notice, start, start))
        return out

    def _matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) of the verified matches in a text of words with one space around each. Only whole words
        match: every run of words that begins near a candidate and is long enough is held against the notice. Of matches that
        overlap the one with the smallest share of edits stays, then the longer, then the first."""
        hits = set()
        for notice, first, last in self._candidates(text):
            length, k, _, pattern = self.notices[notice]
            start = text.find(" ", max(0, first - k - 1)) + 1
            while 0 < start <= last + k:
                end = text.find(" ", start + max(1, length - k))
                while 0 < end <= start + length + k:
                    m = pattern.fullmatch(text, start, end)
                    if m:
                        hits.add((start, end, sum(m.fuzzy_counts), notice))
                    end = text.find(" ", end + 1)
                start = text.find(" ", start) + 1
        kept: list[tuple[int, int]] = []
        out = []
        for a, b, edits, notice in sorted(hits, key=lambda h: (h[2] / self.notices[h[3]][0], h[0] - h[1], h[0], h[3])):
            at = bisect_right(kept, (a, b))
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
                kept.insert(at, (a, b))
                out.append((a, b, edits, notice))
        return sorted(out)

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict]]:
        """(number of words, places of base phrases, spans). A place is a word counted from 0; a span has the code points of
        the original text, end exclusive."""
        words = words_of(text or "")
        line = f" {b' '.join(words).decode()} "
        base_at, spans_at = [], self._matches(line)
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                base_at.append((at + 1, label))
                at = line.find(phrase, at + 1)
        if not base_at and not spans_at:
            return len(words), [], []
        starts, at = [], 1
        for w in words:
            starts.append(at)
            at += len(w.decode()) + 1
        base = [{"label": label, "word": bisect_right(starts, a) - 1} for a, label in sorted(base_at)]
        places = [m.span() for m in WORD.finditer(text)]
        spans = [{"label": self.notices[n][2], "start": places[bisect_right(starts, a) - 1][0],
                  "end": places[bisect_right(starts, b - 1) - 1][1], "edits": e, "likeness": 1 - e / self.notices[n][0]}
                 for a, b, e, n in spans_at]
        return len(words), base, spans


SPAN = "struct<label:string,start:long,end:long,edits:int,likeness:double>"
FOUND = f"struct<n_words:long,base:array<struct<label:string,word:long>>,spans:array<{SPAN}>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                                  ("edits", pa.int32()), ("likeness", pa.float64())])))])


def scan_licenses(docs: DataFrame, notices=NOTICES, base=BASE, id_col: str = "doc_id", text_col: str = "text",
                  least: int = 10, most: int = 4) -> DataFrame:
    """(doc_id, n_words, base, spans) for every row of ``docs``.

    base: (label, word) for every place where the words of a ``base`` phrase stand consecutively. spans: (label, start, end,
    edits, likeness) of every notice that occurs with at most ``errors_allowed`` edits between two word bounds of the text in
    lower case with one space between words; likeness is 1 minus the edits per character. Null and empty texts have no words,
    places or spans. Rows with a null id are scanned like others, repeated rows get equal results, an empty table gives no
    rows, and extra columns of ``docs`` are ignored. Texts of any length are scanned whole."""
    def run(texts: pa.Array) -> pa.Array:
        scanner = Scanner(notices, base, least, most)
        out = []
        for a in range(0, len(texts), 256):
            for t in texts[a:a + 256].to_pylist():
                n, places, spans = scanner.scan(t)
                out.append({"n_words": n, "base": places, "spans": spans})
        return pa.array(out, _FOUND)
    # not deterministic to the optimizer, which else scans once more for every filter on the result
    rows = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(run, FOUND).asNondeterministic()(F.col(text_col)).alias("found"))
    return rows.select("doc_id", "found.n_words", "found.base", "found.spans")


def labelled(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of ``scan_licenses``' rows: score is the
    largest likeness, 1 for a base phrase, 0 without any; labels are empty and words null where nothing was found."""
    names = F.col("base.label")
    both = F.concat(names, F.col("spans.label"))
    best = F.greatest(F.coalesce(F.array_max("spans.likeness"), F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"), best.alias("score"))
