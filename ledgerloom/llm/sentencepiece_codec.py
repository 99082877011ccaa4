"""SentencePiece encoding and decoding with seeded merge-dropout."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, prepare_tasks

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
MARK = "▁"
#: Words with the spaces before them; no merge crosses a border between two of them if ``Model`` finds the borders closed:
#: no piece has a letter of this alphabet beside another character but the mark, a line feed, or the mark after a character.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Words: a line feed, or the spaces before what follows and then letters, or characters of no other kind, for as long as they last.
OTHER, LETTER, SPACE, NEW_LINE = range(4)
KINDS = np.zeros(0x110000, np.uint8)
KINDS[[ord(m) for m in re.findall(f"[{LETTERS}]", "".join(map(chr, range(0x250))))]] = LETTER
KINDS[0x20], KINDS[0x0A] = SPACE, NEW_LINE
#: Longer words go through a heap, one occurrence at a time, instead of the table of their length.
LONG = 48
#: Bytes of text that are encoded together.
BATCH_BYTES = 2 << 20
#: Characters of the words that are worked out in one table.
CELLS = 1 << 17
NEVER = np.int32(1 << 30)
_NONE = np.zeros(0, np.int32)
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs, equal outputs, on every machine."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def key_of(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


class Model:
    """Pieces of a merge-type model as tables: characters to ids, and pairs of ids to the rank and id of what they merge to."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        special = [p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)]
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.byte_id = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        text_of = [b"" if special[i] else self.pieces[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_id):
            text_of[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text_of), np.uint8)
        self.text_size = np.array([len(t) for t in text_of])
        self.text_at = np.cumsum(self.text_size) - self.text_size
        ids = {s: i for i, s in enumerate(self.pieces) if not special[i]}
        self.chars = np.full(0x110000, -1, np.int32)
        for s, i in ids.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        # A space in a text stands for the mark; the mark itself, as a character of a text, is spelled in bytes.
        self.chars[0x20], self.chars[ord(MARK)] = ids[MARK], -1
        by_rank = sorted(ids.values(), key=lambda i: (-p.get_score(i), i))
        self.by_rank, ranks = np.array(by_rank, np.int32), {i: r for r, i in enumerate(by_rank)}
        self.pairs = {(ids[s[:k]], ids[s[k:]]): (ranks[i], i) for s, i in ids.items() for k in range(1, len(s)) if s[:k] in ids and s[k:] in ids}
        self._table()
        crossing = re.compile(rf"[{LETTERS}][^{LETTERS}]|[^{LETTERS}{MARK}][{LETTERS}]|\n|[^{MARK}]{MARK}")
        #: Whether merges stay inside words; if not, a whole text is one word.
        self.closed = not any(crossing.search(t) for t in ids)

    def _table(self) -> None:
        bits = (4 * len(self.pairs)).bit_length()
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NEVER, np.int32)
        for (a, b), (r, i) in self.pairs.items():
            key = a << 32 | b
            slot = ((key * int(_GOLDEN)) & (1 << 64) - 1) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.rank[slot] = key, r

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merge; NEVER where there is none."""
        key = (a.astype(np.int64) << 32 | b).ravel()
        slot = ((key.view(np.uint64) * _GOLDEN) >> self.shift).view(np.int64)
        here = self.keys[slot]
        rank = np.where(here == key, self.rank[slot], NEVER)
        todo = np.flatnonzero((here != key) & (here >= 0) & (key >= 0))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & len(self.keys) - 1
            here = self.keys[slot[todo]]
            hit = here == key[todo]
            rank[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
        return rank.reshape(a.shape)


@functools.cache
def load(path: str) -> Model:
    return Model(path)


def spots(start, middle, end) -> np.ndarray:
    """A hash of the candidate that joins [start, middle) and [middle, end) of its word; different candidates have different ones."""
    spot = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return (spot + _M2) * _GOLDEN


def _limit(dropout: float) -> int:
    return min((1 << 64) - 1, int(dropout * (1 << 64)))


def below(keyed: np.ndarray, limit: int) -> np.ndarray:
    """Whether candidates are skipped: spot and key, hashed together, are below the rate. It is a function of these alone, so it
    does not matter in which order candidates are looked at."""
    return mix(keyed) < np.uint64(limit)


def mix_int(x: int) -> int:
    """``mix`` of one number."""
    x = (x ^ x >> 30) * int(_M1) & _ALL
    x = (x ^ x >> 27) * int(_M2) & _ALL
    return x ^ x >> 31


def spot_int(start: int, middle: int, end: int) -> int:
    """``spots`` of one candidate."""
    return (((start << 42 & _ALL) ^ middle << 21 ^ end) + int(_M2) & _ALL) * int(_GOLDEN) & _ALL


class Segmenter:
    """Segments words by agenda processing: a candidate merge that comes up is skipped or enters the agenda, which is worked off
    by rank and then from the left. Whether it is skipped depends on the candidate and the word's key."""

    def __init__(self, model: Model, dropout: float):
        self.model, self.dropout, self.limit = model, dropout, _limit(dropout)

    def by_heap(self, word: str, key: int) -> tuple[np.ndarray, int]:
        """Token ids of one word, and the number of skipped candidates; n log n for a word of n characters."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        ids = self.model.chars[points].tolist()
        n, heap, dropped, pairs = len(ids), [], 0, self.model.pairs
        left, right, end = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))

        def offer(i: int, j: int) -> int:
            if i < 0 or j < 0 or not (m := pairs.get((ids[i], ids[j]))):
                return 0
            if self.limit and mix_int(spot_int(i, j, end[j]) ^ key) < self.limit:
                return 1
            heapq.heappush(heap, (m[0], i, j, end[j], m[1]))
            return 0

        for i in range(n - 1):
            dropped += offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, j, stop, merged = heapq.heappop(heap)
            if gone[i] or gone[j] or right[i] != j or end[j] != stop:
                continue
            ids[i], end[i], right[i], gone[j] = merged, stop, right[j], True
            if right[j] >= 0:
                left[right[j]] = i
            dropped += offer(left[i], i) + offer(i, right[i])
        keep = [i for i in range(n) if not gone[i]]
        return self.spell(word, [ids[i] for i in keep], keep), dropped

    def by_table(self, points: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many words at once, a row each: in each round every word takes its best candidate. Returns the ids of all
        words, one after the other, how many each has, and how many candidates were skipped in each.

        ``points`` has the characters of all words, one after the other, and ``sizes`` their numbers; ``keys`` the key of each word.
        """
        n, width = len(sizes), int(sizes.max(initial=0)) + 1
        real = np.arange(width) < sizes[:, None]
        ids = np.full(n * width, -2, np.int32)
        ids[real.ravel()] = self.model.chars[points]
        after = np.arange(1, n * width + 1)
        before = after - 2
        rank = np.full(n * width, NEVER, np.int32)
        alive, dropped = real.ravel().copy(), np.zeros(n, np.int64)

        def offer(i: np.ndarray, r: np.ndarray) -> None:
            if self.limit:
                there = np.flatnonzero(r < NEVER)
                i_ = i[there]
                j_, row = after[i_], i_ // width
                first = row * width
                skip = below(spots(i_ - first, j_ - first, after[j_] - first) ^ keys[row], self.limit)
                r[there[skip]] = NEVER
                np.add.at(dropped, row[skip], 1)
            rank[i] = r

        i = np.flatnonzero(alive & np.append(alive[1:], False))
        offer(i, self.model.look_up(ids[i], ids[i + 1]))
        rows = np.arange(n)
        table = rank.reshape(n, width)
        while len(rows):
            here = table[rows]
            column = here.argmin(1)
            best = here[np.arange(len(rows)), column]
            left = best < NEVER
            rows, column, best = rows[left], column[left], best[left]
            i = rows * width + column
            j = after[i]
            ids[i], alive[j], rank[j], rank[i] = self.model.by_rank[best], False, NEVER, NEVER
            after[i] = after[j]
            before[after[i]] = i
            # A word's end has a place of its own behind it, which is no candidate's left side and has no id.
            i = np.concatenate([i, before[i[column > 0]]])
            offer(i, self.model.look_up(ids[i], ids[after[i]]))
        counts = alive.reshape(n, width).sum(1)
        if (bad := np.flatnonzero(alive & (ids < 0))).size:
            return *self._spelled(ids, alive, counts, bad // width, np.flatnonzero(alive), bad, points, real), dropped
        return ids[alive], counts, dropped

    def _spelled(self, ids, alive, counts, rows, where, bad, points, real) -> tuple[np.ndarray, np.ndarray]:
        """The ids where some characters have no piece and are spelled in bytes."""
        char = np.zeros(len(ids), np.uint32)
        char[real.ravel()] = points
        spelled = [np.array([self.model.byte_id[b] for b in chr(c).encode()], np.int32) for c in char[bad].tolist()]
        parts = np.split(ids[alive], np.searchsorted(where, bad))
        out = np.concatenate([parts[0], *(x for s, p in zip(spelled, parts[1:]) for x in (s, p[1:]))])
        return out, counts + np.bincount(rows, [len(s) - 1 for s in spelled], len(counts)).astype(np.int64)

    def spell(self, word: str, ids: list[int], starts: list[int]) -> np.ndarray:
        """Token ids; characters without a piece in bytes."""
        return np.array([t for i, s in zip(ids, starts) for t in ([i] if i >= 0 else [self.model.byte_id[b] for b in word[s].encode()])], np.int32)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words, which stand by size, for one table each: of similar size, and ``CELLS`` characters at most."""
    a = 0
    while a < len(sizes):
        least = int(sizes[a])
        b = min(int(np.searchsorted(sizes, least + 1 + least // 8, "right")), a + CELLS // (least + 2 + least // 8))
        yield a, b
        a = b


class Codec:
    """Encodes texts; each occurrence of a word has a key of its own, under which candidate merges are skipped.

    All words of a batch are worked out together, in tables of words of similar size; nothing is kept from batch to batch.
    """

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        self.model, self.seed = load(path), seed
        self.segmenter = Segmenter(self.model, dropout)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of all texts with a space before each, the sizes of their words, and how many words each text has."""
        points = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32)
        full = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        first = (np.cumsum(full) - full)[full > 0]
        begins = np.zeros(len(points), bool)
        if self.model.closed:
            kind = KINDS[points]
            begins[1:] = (kind[1:] == NEW_LINE) | ((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
        begins[first] = True
        where = np.flatnonzero(begins)
        counts = np.zeros(len(texts), np.int64)
        counts[full > 0] = np.diff(np.append(np.searchsorted(where, first), len(where)))
        return points, np.diff(np.append(where, len(points))), counts

    def occurrence_keys(self, doc_keys: list, counts: np.ndarray) -> np.ndarray:
        """The key of each word of each document, from the seed, the document's key and the place of the word in it."""
        own = np.array([key_of(self.seed, "draw", k) for k in doc_keys], np.uint64)
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return mix(place.astype(np.uint64) * _GOLDEN + np.repeat(own, counts))

    def encode(self, keys: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each has; how many candidates were skipped in each)."""
        points, sizes, words = self.cut(texts)
        own = self.occurrence_keys(keys, words)
        order = np.argsort(np.minimum(sizes, 0xFFFF).astype(np.uint16), kind="stable")
        begins = (np.cumsum(sizes) - sizes)[order]
        sizes, own = sizes[order], own[order]
        short, found = int(np.searchsorted(sizes, LONG, "right")), [(_NONE, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in chunks(sizes[:short]):
            found.append(self.segmenter.by_table(points[spread(begins[a:b], sizes[a:b])], sizes[a:b], own[a:b]))
        for k in range(short, len(sizes)):
            ids, skips = self.segmenter.by_heap(points[begins[k] : begins[k] + sizes[k]].tobytes().decode("utf-32-le"), int(own[k]))
            found.append((ids, np.array([len(ids)]), np.array([skips])))
        ids, n, skips = (np.concatenate(x) for x in zip(*found))
        at = np.empty((3, len(sizes)), np.int64)
        at[:, order] = np.cumsum(n) - n, n, skips
        ends = np.append(0, np.cumsum(words))
        per_text = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        return ids[spread(at[0], at[1])], per_text(at[1]), per_text(at[2])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of sequences of ids, in UTF-8; the inverse of ``encode`` for every text, seed and rate."""
        sizes = self.model.text_size[ids]
        whole = self.model.text[spread(self.model.text_at[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        return [whole[a + 1 : b] for a, b in zip(ends, ends[1:])]


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = DROPOUT, seed: int = SEED
) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, n_skipped for every row; ids decode to exactly the row's text.

    Merges run as the model's agenda would, best rank first and from the left, but each candidate merge is skipped if a hash
    keyed by seed, id, position of the word and place in the word falls below ``dropout``, for each occurrence of a word on its
    own. Reruns agree; other seeds and ids give other segmentations. With
    ``dropout=0`` ids are those of the sentencepiece library, but for U+2581 in a text, which is spelled in bytes here so
    that it comes back.

    Null text counts as empty and gives no ids. Ids of rows may be null or repeat: rows with equal id and text get equal
    ids. Empty input gives no rows. Other columns are ignored. Words of any length are encoded whole.
    """
    path = model or model_path()
    prepare_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codec(path, dropout, seed)
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            doc_ids = batch.column("doc_id")
            ids, counts, skipped = coder.encode(doc_ids.to_pylist(), [t or "" for t in batch.column("text").to_pylist()])
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(ends, pa.array(ids)), pa.array(counts), pa.array(skipped)], ["doc_id", "ids", "n_tokens", "n_skipped"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, n_tokens long, n_skipped long")


def decode_documents(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text for every row of ids; null ids give empty text. Ids must come from ``encode_documents`` or the same model."""
    path = model or model_path()
    prepare_tasks(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codec(path, 0.0)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            texts = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    rows = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(coded.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, n_skipped, ids_sha256 (of ids as little-endian 32-bit integers) and decoded_ok, whether the ids decode to the text.

    The same codec as ``encode_documents`` and ``decode_documents``, in one pass, so that ids need not leave the task. Nulls,
    repeats and empty input are as in ``encode_documents``.
    """
    path = model or model_path()
    prepare_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codec(path, dropout, seed)
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            doc_ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            ids, counts, skipped = coder.encode(doc_ids.to_pylist(), texts)
            ends = (4 * np.append(0, np.cumsum(counts))).tolist()
            stored = memoryview(ids.astype("<i4").tobytes())
            digests = [hashlib.sha256(stored[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
            same = [a == b.encode() for a, b in zip(coder.decode(ids, counts), texts)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.array(skipped), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "n_skipped", "ids_sha256", "decoded_ok"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, n_skipped long, ids_sha256 string, decoded_ok boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with dropout and decoded again. Null and empty texts have no tokens."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
