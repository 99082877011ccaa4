"""Fill-in-the-middle examples: texts cut at units found by SWAR words over their UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, prepare_tasks

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
SLICE_BYTES = 4 << 20
#: Words worked on at once, which bounds what arithmetic on a very long text holds besides its marks.
BLOCK = 1 << 17

ONES = np.uint64(0x0101010101010101)
HIGH, LOW = ONES * np.uint64(0x80), ONES * np.uint64(0x7F)


def _in_each(byte) -> np.uint64 | np.ndarray:
    return np.asarray(byte).astype(np.uint64) * ONES


def white(x: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is white space (0x20, 0x09 to 0x0D); sums of seven bits each stay within their bytes."""
    y = x & LOW
    return (((y + _in_each(0x80 - 0x09)) & ~(y + _in_each(0x80 - 0x0E))) | ((y + _in_each(0x80 - 0x20)) & ~(y + _in_each(0x80 - 0x21)))) & ~x & HIGH


class Marks:
    """High bits of marked bytes in 64-bit words, with the number of marks before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before ``at``, which is below the words' end."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (inside * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, from 1: its word by search in the running counts, its place by the sums of bytes in the word."""
        word = np.searchsorted(self.before, k, "left") - 1
        up_to = (self.words[word] >> np.uint64(7)) * ONES  # byte i has the marks of bytes 0 to i
        fewer = ~(up_to + _in_each(0x80 - (k - self.before[word]))) & HIGH
        return 8 * word + np.bitwise_count(fewer)


def units_and_characters(data: np.ndarray, stops: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the bytes that end a unit, and of those that begin a code point, for texts laid end to end in ``data``.

    A unit ends where white space follows another byte, and at the end of a text. ``stops`` are the ends of texts that have bytes.
    """
    # A word of zeros at least comes after the last byte, so that every byte has one after it.
    words = np.zeros(len(data) // 8 + 2, "<u8")
    words.view(np.uint8)[: len(data)] = data
    ends, starts = np.zeros_like(words), np.zeros_like(words)
    for a in range(0, len(words) - 1, BLOCK):
        b = min(a + BLOCK, len(words) - 1)
        blank, x = white(words[a : b + 1]), words[a:b]
        ends[a:b] = ((blank[:-1] >> np.uint64(8)) | (blank[1:] << np.uint64(56))) & ~blank[:-1]
        starts[a:b] = HIGH & ~(x & ~(x << np.uint64(1)))  # all but 10xxxxxx
    last = stops - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * np.uint64(8)))
    return Marks(ends), Marks(starts)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, laid end to end, and the bounds of its texts."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, bounds - bounds[0]


def _rearranged(batches: Iterator[pa.RecordBatch], rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        texts = pc.fill_null(batch.column("text"), "")
        h1, h2, h3, h4 = (batch.column(c).to_numpy() for c in ("h1", "h2", "h3", "h4"))
        data, bounds = _bytes_of(texts)
        start, stop = bounds[:-1], bounds[1:]
        units, characters = units_and_characters(data, stop[stop > start])
        first = units.rank(start)
        n = units.rank(stop) - first
        marked = np.zeros(len(n), bool)
        for mark in (PREFIX, SUFFIX, MIDDLE):
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = (stop == start) | marked | (h3 % 100 >= rate)
        spm = ~plain & (h4 % 100 < spm_rate)
        cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), 0)
        cuts[:, plain] = 0
        at = np.broadcast_to(start, cuts.shape).copy()
        at[cuts > 0] = units.select((first + cuts)[cuts > 0]) + 1
        counted = characters.rank(np.stack([start, at[0], at[1]]))
        held, out = data.tobytes(), []
        for i, (a, b, c, d) in enumerate(zip(start.tolist(), at[0].tolist(), at[1].tolist(), stop.tolist())):
            if plain[i]:
                out.append(held[a:d])
            elif spm[i]:
                out.append(b"".join((SUFFIX.encode(), held[c:d], PREFIX.encode(), held[a:b], MIDDLE.encode(), held[b:c])))
            else:
                out.append(b"".join((PREFIX.encode(), held[a:b], SUFFIX.encode(), held[c:d], MIDDLE.encode(), held[b:c])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        chars = [pa.array(counted[i + 1] - counted[i], pa.int64(), mask=plain) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, pa.array(out, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, a row per row.

    A unit is a run of white space and the visible run after it, or white space at the end. Two numbers between 0 and n, from a
    hash of seed and id, cut the text in prefix, middle and suffix; ``rate`` in 100 texts are rearranged, ``spm_rate`` in 100 of
    them suffix first. A text that is empty or holds one of the marks stays as it is, so that every output can be undone.

    A null text is an empty one; rows of one id get the same numbers, and a null id those of an empty id. Repeated rows are kept.
    Empty input gives no rows, and other columns are neither read nor returned. A task holds some megabytes of texts at a time, or
    one longer text with two marks for each of its bytes.
    """
    prepare_tasks(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    parts = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("_digest")).select("doc_id", "text", *parts)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(lambda batches: _rearranged(batches, rate, spm_rate), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone: no part holds a mark, so each mark is found once."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged and restored, as digests of both. Null texts are empty texts and plain; repeated ids are cut alike."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
v AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM w
"""
