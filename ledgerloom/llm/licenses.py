"""License scans: fuzzy search for short notices."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, prepare_tasks

# Phrases whose exact occurrences are the base result, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices that are searched with errors, and their labels. Words as the scan sees them.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2": "apache-2.0",
    "licensed under the apache license version 1 1": "apache-1.1",
    "the apache software license version 1 1": "apache-1.1",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "licensed under the boost software license version 1 0": "bsl-1.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "under the terms of the gnu general public license version 2": "gpl-2.0",
    "under the terms of the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "gnu library general public license": "lgpl",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3.0",
    "gnu free documentation license": "gfdl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "licensed under cc by 3 0": "cc-by-3.0",
    "licensed under cc by sa 3 0": "cc-by-sa-3.0",
    "licensed under cc by nc 3 0": "cc-by-nc-3.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "mozilla public license version 1 1": "mpl-1.1",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license version 1 0": "epl-1.0",
    "eclipse public license version 2 0": "epl-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "all rights reserved": "reserved",
}
# Words that tell licenses apart, as numbers do; they must stand in a match as they stand in the notice.
TELLING = frozenset(("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs", "lesser", "library", "affero"))
#: Edits (insertions, deletions, substitutions of characters) allowed: one in so many characters of the notice.
CHARS_PER_EDIT = 12
#: Bytes that are word characters stay, A-Z becomes a-z, all others become spaces.
_SPACED = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


class Hit(NamedTuple):
    label: str
    start: int
    end: int
    edits: int
    score: float


def max_edits(notice: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(notice) // chars_per_edit


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``notice`` in edits + 1 parts: with no more edits than that, one part at least stands in the text unchanged."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def telling(words: list[str]) -> list[str]:
    """The numbers and telling words among ``words``, in their order."""
    return [w for w in words if w in TELLING or w.isdecimal()]


def normalised(text: str) -> str:
    """Words of ``text`` with one space between them: A-Z lower-cased, words being runs of ASCII letters, digits and non-ASCII characters."""
    return b" ".join(text.encode().translate(_SPACED).split()).decode()


class Scanner:
    def __init__(self, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.seeds, found = ahocorasick.Automaton(), {}
        self.notices = []
        for k, (notice, label) in enumerate((notices or NOTICES).items()):
            e = max_edits(notice, chars_per_edit)
            words = notice.split(" ")
            self.notices.append((label, len(notice), e, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={e}}}"), telling(words), words[-1].isdecimal()))
            for at, piece in pieces(notice, e):
                found.setdefault(piece, []).append((k, at, len(piece)))
        for piece, where in found.items():
            self.seeds.add_word(piece, where)
        self.seeds.make_automaton()

    def fuzzy(self, text: str) -> list[Hit]:
        """The best matches in a normalised text: of all spans of whole words within the allowed edits of a notice, those that have
        most of it right stay where spans overlap, of one notice or of several.

        A part found at i puts the notice's start within the allowed edits of i less the part's place, and every match has a part
        that stands unchanged, so the borders of words there are all the spans there are. Numbers and telling words of a span must
        be those of the notice, and no number goes on behind a notice that ends with one: version 2 is not version 2.1, nor NC SA.
        """
        spans: dict[tuple[int, int, int], int | None] = {}
        for last, where in self.seeds.iter(text):
            for k, at, n in where:
                _, size, e, pattern, told, numbered = self.notices[k]
                start = last - n + 1 - at
                for u in self.borders(text, start - e - 1, start + e, 1):
                    for v in self.borders(text, max(u + size - e, last + 1 - e), u + size + e + 1, 0):
                        if u < v and (k, u, v) not in spans:
                            f = pattern.fullmatch(text, u, v)
                            if f and (telling(text[u:v].split(" ")) != told or numbered and text[v + 1 : v + 12].split(" ")[0].isdecimal()):
                                f = None
                            spans[k, u, v] = sum(f.fuzzy_counts) if f else None
        hits: list[Hit] = []
        kept: list[tuple[int, int]] = []
        for _, u, v, k, edits in sorted((edits - self.notices[k][1], u, v, k, edits) for (k, u, v), edits in spans.items() if edits is not None):
            i = bisect.bisect(kept, (u, v))
            if (i == 0 or kept[i - 1][1] <= u) and (i == len(kept) or v <= kept[i][0]):
                kept.insert(i, (u, v))
                label, size = self.notices[k][:2]
                hits.append(Hit(label, u, v, edits, round(1 - edits / size, 6)))
        return sorted(hits, key=lambda h: (h.start, h.end, h.label, h.edits))

    @staticmethod
    def words(text: str) -> list[int]:
        """Where each word of a normalised text begins."""
        return list(itertools.accumulate((len(w) + 1 for w in text.split(" ")[:-1]), initial=0)) if text else []

    @staticmethod
    def borders(text: str, a: int, b: int, after: int) -> list[int]:
        """Places of spaces in [a, b), or after them, the text being framed by one space on each side."""
        found, at = [], text.find(" ", max(0, a), max(0, b))
        while at >= 0:
            found.append(at + after)
            at = text.find(" ", at + 1, b)
        return [0] * (after and a <= -1 < b) + found + [len(text)] * (not after and a <= len(text) < b)

    def base(self, text: str) -> list[tuple[int, str]]:
        """(word number, label) of each exact place of a base phrase in a normalised text."""
        places, framed = [], f" {text} "
        for phrase, label in BASE.items():
            at = framed.find(f" {phrase} ")
            while at >= 0:
                places.append((at, label))
                at = framed.find(f" {phrase} ", at + 1)
        begins = self.words(text) if places else []
        return sorted((bisect.bisect_left(begins, at), label) for at, label in places)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per row: doc_id, n_words, the exact places of the base phrases, labels with those of the fuzzy search, score and spans.

    ``spans`` has each match of a notice: start and end word numbers (end exclusive) and edits. ``score`` is 1 if a base
    phrase occurs, else the largest share of a matched notice's characters without an edit, else 0. Of overlapping matches, that
    which has most characters of its notice right stays. ``notices`` are normalised texts with their labels, the library's own
    short ones by default; the time a text takes is in proportion to its length and to the
    places where parts of notices stand in it. Null text counts as
    empty: no words, no places, empty labels, score 0. Ids may be null or repeat. Empty input gives no rows. Other columns
    are ignored. Texts are searched whole.
    """
    prepare_tasks(docs.sparkSession)
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, chars_per_edit)
        for batch in byte_slices(batches, "text", 1 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                norm = normalised(text or "")
                base, fuzzy = scanner.base(norm), scanner.fuzzy(norm)
                exact, labels = {x for _, x in base}, {x for _, x in base} | {h.label for h in fuzzy}
                score = 1.0 if base else max([0.0, *(h.score for h in fuzzy)])
                begins = scanner.words(norm) if fuzzy else []
                spans = [{"label": h.label, "start": bisect.bisect_left(begins, h.start), "end": bisect.bisect_left(begins, h.end), "edits": h.edits} for h in fuzzy]
                rows.append(
                    (norm.count(" ") + 1 if norm else 0, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(exact)), ",".join(sorted(labels)), score, spans)
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans_type]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(docs.dtypes)[id_col]}, {RESULT}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of all documents, its spans as label:start:end:edits. Null and empty texts have no words and score 0."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])), ",")
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("spans", spans)
