"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, prepare_tasks
from .wordhash import NOT_ALNUM, Words

#: Of the hashed terms; words have the lower half of the ids, first letters the upper one.
BITS = 19
FACTORS = 4
PREFIXES = (4, 5)
#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 12_000
#: Bytes of their terms, at most: in the order of a hash, rows are taken up to this.
TRAIN_BYTES = 64 << 20
FOLDS, HELD_OUT = 5, 0
#: Rows of the sample that a term must occur in to be looked at by itself, and that a pair must occur in.
MIN_ROWS, PAIR_ROWS = 3, 20
#: Chance of even one pair being taken for telling where none is; terms of a block of pairs; steps of the fit at least.
PAIR_CHANCE, BLOCK_TERMS, LEAST_STEPS = 1e-3, 1024, 1500


@dataclass
class Model:
    """score = sigmoid(bias + sum of linear weights + sum over pairs of terms of the product of their factors)."""

    bits: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of documents whose distinct terms are ids[bounds[i]:bounds[i + 1]]."""
        out = np.full(len(bounds) - 1, self.bias, np.float64)
        full = np.flatnonzero(np.diff(bounds))
        if full.size:
            at = bounds[:-1][full]
            v = self.factors[ids]
            total = np.add.reduceat(v, at, axis=0)
            squares = np.add.reduceat((v * v).sum(1), at)
            out[full] += np.add.reduceat(self.linear[ids], at) + 0.5 * ((total * total).sum(1) - squares)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(share) -> np.ndarray:
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def term_ids(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, and bounds: its words and their first bytes, lower-cased in ASCII."""
    words = Words(texts, NOT_ALNUM, PREFIXES)
    shift, half = np.uint64(65 - bits), np.uint64(1 << (bits - 1))
    table = np.stack([words.hash >> shift, *((h >> shift) + half for h in words.prefix_hash)])
    ids, bounds = [], [0]
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        ids.append(np.unique(table[:, a:b]))
        bounds.append(bounds[-1] + len(ids[-1]))
    return np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64), np.array(bounds)


def row_counts(ids: np.ndarray, size: int) -> np.ndarray:
    """In how many rows each term is; some ids at a time, which keeps what numpy holds besides small."""
    return sum((np.bincount(ids[i : i + (1 << 20)], minlength=size) for i in range(0, len(ids), 1 << 20)), np.zeros(size, np.int64))


def telling(n: np.ndarray, ones: np.ndarray, share: float, z: float = 3.0) -> np.ndarray:
    """Whether each term is in ``MIN_ROWS`` rows or more, and with label 1 more or less often than chance by ``z`` deviations."""
    return (n >= MIN_ROWS) & (np.abs(ones - n * share) >= z * np.sqrt(np.maximum(n, 1) * share * (1 - share)))


@dataclass
class _Pairing:
    """The sample as pairs are counted in it: for each row its terms by number, for each term the share of label 1."""

    at: np.ndarray
    bounds: np.ndarray
    labels: np.ndarray
    rate: np.ndarray
    share: float

    def seen(self, block: int, rows: slice) -> np.ndarray:
        """Rows by the terms of a block, 1 where a row has the term."""
        first, width = block * BLOCK_TERMS, min(BLOCK_TERMS, len(self.rate) - block * BLOCK_TERMS)
        bounds = self.bounds[rows.start : rows.stop + 1]
        at, own = self.at[bounds[0] : bounds[-1]] - first, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        here = (at >= 0) & (at < width)
        out = np.zeros((len(bounds) - 1, width), np.float32)
        out[own[here], at[here]] = 1
        return out

    def telling(self, i: int, j: int) -> np.ndarray:
        """Terms of blocks ``i`` and ``j`` that are halves of telling pairs between them (see ``telling_pairs``)."""
        a, b, most = i * BLOCK_TERMS, j * BLOCK_TERMS, len(self.rate)
        both = np.zeros((min(BLOCK_TERMS, most - a), min(BLOCK_TERMS, most - b)), np.float32)
        toxic = np.zeros_like(both)
        for start in range(0, len(self.labels), 2048):
            rows = slice(start, min(start + 2048, len(self.labels)))
            x, y = self.seen(i, rows), self.seen(j, rows)
            ones = self.labels[rows] > 0
            both += x.T @ y
            toxic += x[ones].T @ y[ones]
        tests = max(1.0, most * (most - 1) / 2)
        surprise = np.log(tests / PAIR_CHANCE)
        off = np.zeros(both.shape, bool)
        p, q = self.rate[a : a + len(both), None], self.rate[None, b : b + both.shape[1]]
        added = sigmoid(_logit(p) + _logit(q) - _logit(self.share))
        share = toxic / np.maximum(both, 1)
        for bound, side in ((np.maximum, 1), (np.minimum, -1)):
            expected = np.clip(bound(bound(p, q), added), 1e-3, 1 - 1e-3)
            with np.errstate(divide="ignore", invalid="ignore"):
                apart = np.where(share > 0, share * np.log(share / expected), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - expected)), 0)
            off |= (side * (share - expected) > 0) & (both * apart >= surprise)
        off &= both >= PAIR_ROWS
        if i == j:
            np.fill_diagonal(off, False)
        return np.union1d(np.flatnonzero(off.any(1)) + a, np.flatnonzero(off.any(0)) + b)


def telling_pairs(ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, n: np.ndarray, ones: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """Whether each word is half of a pair that tells more than its halves do: of the rows with both, ``PAIR_ROWS`` at least, the share
    with label 1 is above the shares of both words and above what their weights add up to, or below all three, by more than
    chance would give in any of the pairs.

    All pairs of words that occur in ``PAIR_ROWS`` rows are counted, in blocks of words, which are tasks where a session is given. By
    Chernoff's bound, ``t`` rows have a share at least as far off with a chance of exp(-t * divergence), which must be below
    ``PAIR_CHANCE`` over the number of pairs.
    """
    used = np.zeros(len(n), bool)
    terms = np.flatnonzero(n[: len(n) // 2] >= PAIR_ROWS)
    if len(terms) < 2:
        return used
    place = np.full(len(n), -1, np.int32)
    place[terms] = np.arange(len(terms), dtype=np.int32)
    at = place[ids]
    # Counted row by row: a running sum over all terms would be twice the sample's size.
    kept = np.cumsum([0, *(np.count_nonzero(at[a:b] >= 0) for a, b in zip(bounds.tolist(), bounds[1:].tolist()))])
    at = at[at >= 0]
    pairing = _Pairing(at, kept, labels, ones[terms] / n[terms], float(labels.mean()))
    blocks = -(-len(terms) // BLOCK_TERMS)
    todo = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    if spark is None:
        found = [pairing.telling(i, j) for i, j in todo]
        used[terms[np.concatenate(found)]] = True
        return used
    shared = spark.sparkContext.broadcast(pairing)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"term": pa.array(shared.value.telling(*todo[k]), pa.int64())})

    rows = spark.range(0, len(todo), 1, len(todo)).mapInArrow(count, "term long").distinct().collect()
    shared.unpersist()
    used[terms[np.array([r.term for r in rows], np.int64)]] = True
    return used


def fit(ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 8, batch: int = 16, seed: int = 7, spark: SparkSession | None = None) -> Model:
    """Logistic loss over the terms that tell the classes apart, by themselves or as halves of pairs. Linear weights by FTRL with an L1
    term, factors by AdaGrad with an L2 term.

    All other terms have weight 0 and no factors. A small sample is gone through until ``LEAST_STEPS`` are made. Without both classes the model gives the share of label 1.
    """
    rng, size, n = np.random.default_rng(seed), 1 << bits, len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    model = Model(bits, float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    if not 0 < labels.sum() < n:
        return model
    rows, ones = row_counts(ids, size), row_counts(ids[np.repeat(labels > 0, np.diff(bounds))], size)
    keep = (telling(rows, ones, labels.mean()) | telling_pairs(ids, bounds, labels, rows, ones, spark))[ids]
    bounds = np.append(np.int32(0), np.cumsum(keep, dtype=np.int32))[bounds]
    ids = ids[keep]
    # Weights are fitted on the few terms in use, under numbers of their own.
    names, ids = np.unique(ids, return_inverse=True)
    size = max(1, len(names))
    small = Model(bits, model.bias, np.zeros(size), rng.normal(0, 0.01, (size, factors)))
    z, squares, v_squares = np.zeros(size), np.zeros(size), np.full(size, 1e-2)
    alpha, beta, l1, l2, v_rate, v_l2 = 0.3, 1.0, 0.3, 0.1, 0.05, 1e-3
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // n))):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            lengths = bounds[rows + 1] - bounds[rows]
            at = np.cumsum(lengths) - lengths
            own = np.repeat(np.arange(len(rows)), lengths)
            x = ids[np.repeat(bounds[rows] - at, lengths) + np.arange(int(lengths.sum()))]
            error = sigmoid(small.logits(x, np.append(at, len(x)))) - labels[rows]
            small.bias -= 0.05 * float(error.mean())
            if not len(x):
                continue
            terms, where = np.unique(x, return_inverse=True)
            g = np.bincount(where, error[own], len(terms))
            grown = squares[terms] + g * g
            z[terms] += g - (np.sqrt(grown) - np.sqrt(squares[terms])) / alpha * small.linear[terms]
            squares[terms] = grown
            s = z[terms]
            small.linear[terms] = np.where(np.abs(s) <= l1, 0, -(s - np.sign(s) * l1) / ((beta + np.sqrt(grown)) / alpha + l2))
            v = small.factors[x]
            total = np.stack([np.bincount(own, v[:, k], len(rows)) for k in range(factors)], 1)
            gv = error[own, None] * (total[own] - v)
            g = np.stack([np.bincount(where, gv[:, k], len(terms)) for k in range(factors)], 1) + v_l2 * small.factors[terms]
            v_squares[terms] += (g * g).mean(1)
            small.factors[terms] -= v_rate * g / np.sqrt(v_squares[terms])[:, None]
    model.bias = small.bias
    model.linear[names], model.factors[names] = small.linear[: len(names)], small.factors[: len(names)]
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, by five. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, bits: int = BITS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``train_rows`` labelled rows that are not held out, of ``train_bytes`` of terms; a bounded sample, so it is fitted in one place.

    Rows with null id or label are left out; of several labels of an id the largest counts. Documents with equal terms and
    label count once, before anything is bounded, however many rows an id has. Without labelled rows every score is one half.
    """
    spark = docs.sparkSession
    prepare_tasks(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 1 << 20):
            ids, bounds = term_ids([t.encode() for t in batch.column("text").to_pylist()], bits)
            terms = [ids[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(terms, pa.binary())], ["label", "terms"])

    once = rows.select("label", "text").mapInArrow(hashed, "label double, terms binary").distinct()
    order = [F.xxhash64("terms"), "label", "terms"]
    bounded = once.orderBy(*order).limit(train_rows)
    held = F.sum(F.octet_length("terms")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the sample's rows
    sample = bounded.withColumn("_held", held).where(F.col("_held") <= train_bytes).select("label", "terms")
    found = sample.toArrow().combine_chunks()
    known_labels, terms = found.column("label").to_numpy(), found.column("terms")
    bounds = np.append(0, np.cumsum(pc.binary_length(terms).to_numpy() // 4, dtype=np.int64))
    pieces = [np.frombuffer(x.buffers()[2], "<i4", int(pc.sum(pc.binary_length(x)).as_py() or 0) // 4) for x in terms.chunks if len(x) and x.buffers()[2]]
    ids = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    del found, terms, pieces
    return fit(ids, bounds, known_labels, bits, spark=spark)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every row, from the whole text alone.

    Null and empty texts have no terms and get the score of the bias. Ids may be null or repeat. Empty input gives no rows.
    Other columns are ignored. The model has a fixed size and goes to the tasks by broadcast.
    """
    prepare_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 1 << 20):
            ids, bounds = term_ids([(t or "").encode() for t in batch.column("text").to_pylist()], shared.value.bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(shared.value.logits(ids, bounds)))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(score, f"doc_id {dict(docs.dtypes)[id_col]}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not predict as toxic, with all their columns unchanged.

    Null and empty texts have the score of the bias. Ids are not looked at, rows may repeat, and each is judged by its own text.
    Empty input gives no rows.
    """
    prepare_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices([batch], batch.schema.field(at).name, 1 << 20):
                ids, bounds = term_ids([(t or "").encode() for t in part.column(at).to_pylist()], shared.value.bits)
                yield part.filter(pa.array(sigmoid(shared.value.logits(ids, bounds)) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled ones that are not held out. Null and empty texts get the bias's score; null ids are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
