"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, prepare_tasks

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 1024
#: Bytes of text per call of the encoder.
BATCH_BYTES = 1 << 20
#: Bytes of segments, and of what it takes to keep them, that a process remembers before it starts afresh; longer segments never are.
REMEMBERED, SHORT = 64 << 20, 64
#: Characters that are no white space in any sense: visible ASCII, letters and digits of all scripts. A cut between one of them
#: and white space is safe: white space never joins what stands before it, and the pieces on either side are matched without
#: regard to the other. No special string contains white space.
SAFE = r"[!-~\w]"
SAFE_END = re.compile(SAFE + r"\Z")
#: So is a cut between a letter and a sign beyond ASCII, such as an ideographic comma: both are matched for as long as their kind
#: lasts, and special strings and contractions have ASCII signs only.
SAFE_CUT = re.compile(rf"(?<={SAFE})(?=[ \t\n\r])|(?<=[^\W\d_])(?=[\u3000-\u3003\u3008-\u3011\uff01\uff0c\uff1a\uff1b\uff1f])")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Counter:
    """Counts tokens of texts; equal segments are encoded once as long as they are remembered."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, remembered: int = REMEMBERED):
        self.tokenizer, self.batch_bytes, self.remembered = _tokenizer(path), batch_bytes, remembered
        self.known: dict[str, int] = {}
        self.held = 0

    def _encode(self, new: list[str]) -> list[int]:
        """Numbers of tokens, in calls of about ``batch_bytes``."""
        counts: list[int] = []
        start = used = 0
        for i, s in enumerate(new):
            used += len(s) if s.isascii() else len(s.encode())
            if used >= self.batch_bytes or i + 1 == len(new):
                counts += map(len, self.tokenizer.encode_batch_fast(new[start : i + 1], add_special_tokens=False))
                start, used = i + 1, 0
        return counts

    def _count(self, segments: list[str]) -> np.ndarray:
        """The count of each of some distinct segments; long ones are cut again where that is safe."""
        out = np.zeros(len(segments), np.int64)
        known, new, where = self.known, [], []
        for i, s in enumerate(segments):
            if (n := known.get(s)) is not None:
                out[i] = n
            else:
                for part in (s,) if len(s) <= SHORT else SAFE_CUT.split(s):
                    new.append(part)
                    where.append(i)
        counts = self._encode(new)
        np.add.at(out, where, counts)
        if self.held > self.remembered:
            self.known, self.held = {}, 0
        short = [(s, n) for s, n in zip(new, counts) if len(s) <= SHORT]
        self.known.update(short)
        self.held += sum(len(s) + 120 for s, _ in short)
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The count of each text. Texts are split at spaces and equal pieces numbered in Arrow, so that each is looked at once."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        full = texts.filter(pa.array(sizes > 0))
        if not len(full):
            return out
        lists = pc.split_pattern(full, pattern=" ")
        coded = lists.flatten().dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        # A piece goes with the space before it. Where the one before ends in no safe character the two stay together.
        begins = np.ones(len(index), bool)
        begins[1:] = np.array([bool(SAFE_END.search(s)) for s in names])[index[:-1]]
        begins[bounds[:-1]] = True
        firsts = np.flatnonzero(begins)
        lasts = np.append(firsts[1:], len(index))
        opening = np.zeros(len(index), bool)
        opening[bounds[:-1]] = True
        plain = (lasts - firsts == 1) & ~opening[firsts]
        counts = np.zeros(len(firsts), np.int64)
        numbers, at = np.unique(index[firsts[plain]], return_inverse=True)
        counts[plain] = self._count([" " + names[k] for k in numbers.tolist()])[at] if len(numbers) else 0
        other = np.flatnonzero(~plain)
        made = [("" if opening[a] else " ") + " ".join([names[k] for k in index[a:b].tolist()]) for a, b in zip(firsts[other].tolist(), lasts[other].tolist())]
        distinct = list(dict.fromkeys(made))
        found = dict(zip(distinct, self._count(distinct).tolist()))
        counts[other] = [found[s] for s in made]
        out[sizes > 0] = np.add.reduceat(counts, np.searchsorted(firsts, bounds[:-1]))
        return out


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit for every row, as the tokenizers library counts the whole text.

    No begin, end or added special tokens, no truncation; special strings inside a text are handled as the library does by
    default. Null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row gets its own result. Empty
    input gives no rows. Only the two named columns are read, so others may have any name.

    Texts reach the encoder in batches of about ``batch_bytes``. All texts are cut where the vocabulary's own splitting always
    cuts: mostly between words, so a very long text never makes one large call, and a segment that recurs is encoded once (which
    takes less time than whole texts do). Only lengths leave the Arrow function. What has no safe boundary at all is encoded
    whole, and not remembered.
    """
    path = tokenizer or tokenizer_path()
    prepare_tasks(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, batch_bytes)
        for batch in byte_slices(batches, "text", batch_bytes):
            n = counter(batch.column("text").fill_null(""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents with the library's own default vocabulary. Null and empty texts have 0 bytes and 0 tokens."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
