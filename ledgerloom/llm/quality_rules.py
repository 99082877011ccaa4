"""Quality rules: word statistics of texts, and decision lists learned from labelled ones by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, prepare_tasks
from .toxicity import held_out
from .wordhash import SPACES

#: Labelled rows that rules are learned from, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Thresholds tried for a statistic, conditions of a rule, rules of a list; rows that a rule must single out in either half of the
#: sample, and the share of them that must have its label.
CUTS, CONDITIONS, RULES, LEAST_ROWS, LEAST_PRECISION = 64, 4, 32, 2, 0.9
SLICE_BYTES = 1 << 20
#: Ids of three words fit one number below this many distinct words.
PACKED = 1 << 21

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_same_next", "n_single",
    "n_letters", "n_upper", "n_digits", "n_marks",
]


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_IS_SYMBOL = _table(lambda b: chr(b) in SYMBOLS)
_IS_UPPER = _table(lambda b: 0x41 <= b <= 0x5A)
_IS_LETTER = _table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_IS_DIGIT = _table(lambda b: 0x30 <= b <= 0x39)
_IS_MARK = _table(lambda b: 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E)


def _same(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each piece data[bounds[i]:bounds[i + 1]]; equal pieces, and only they, have equal numbers."""
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.tobytes())])
    return held.dictionary_encode().indices.to_numpy().astype(np.int64)


def _windows(ids: np.ndarray) -> np.ndarray:
    """A number for each three neighbours, the same for the same three."""
    most = int(ids.max()) + 1
    if most <= PACKED:
        return (ids[:-2] * PACKED + ids[1:-1]) * PACKED + ids[2:]
    pairs = np.unique(ids[:-1] * most + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * most + ids[2:]


def _recurring(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value occurs again in its text."""
    order = np.lexsort((value, doc))
    twin = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros(len(doc), bool)
    out[order] = np.append(twin, False) | np.append(False, twin)
    return out


def _distinct(doc: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """How many distinct values each text has."""
    order = np.lexsort((value, doc))
    new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])) if len(doc) else np.zeros(0, bool)
    return np.bincount(doc[order][new], minlength=texts)


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text. Words are runs of bytes other than 0x20 and 0x09 to 0x0D; lines end at line feeds and count if they hold a word."""
    n = len(texts)
    if not n:
        return {c: np.zeros(0, np.int64) for c in COUNTS}
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))
    starts = np.append(0, ends[:-1])

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    inside = ~SPACES[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    doc = np.searchsorted(ends, begin, "right")
    n_words = np.bincount(doc, minlength=n)
    whole = (data & 0xC0) != 0x80
    out = {
        "n_words": n_words, "word_chars": per_text(inside & whole), "n_symbols": per_text(_IS_SYMBOL[data]), "n_letters": per_text(_IS_LETTER[data]),
        "n_upper": per_text(_IS_UPPER[data]), "n_digits": per_text(_IS_DIGIT[data]), "n_marks": per_text(_IS_MARK[data]),
    }
    breaks = np.flatnonzero(data == 0x0A) + 1
    worded = np.unique(np.searchsorted(breaks, begin, "right"))  # lines that hold a word
    line_doc = np.searchsorted(ends, breaks[worded] - 1, "right")
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_doc, _same(data, np.append(0, breaks))[worded], n)
    ids = _same(data[inside], np.append(0, np.cumsum(length)))
    out["n_distinct"] = _distinct(doc, ids, n)
    within = doc[1:] == doc[:-1]
    out["n_same_next"] = np.bincount(doc[1:][within & (ids[1:] == ids[:-1])], minlength=n)
    first = np.cumsum(length) - length
    letters = np.add.reduceat(whole[inside], first, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    out["n_single"] = np.bincount(doc[letters == 1], minlength=n)
    covered = np.zeros(len(ids), bool)
    if len(ids) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        at = at[_recurring(doc[at], _windows(ids)[at])]
        for i in range(3):
            covered[at + i] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts ``COUNTS`` of each row's whole text.

    A null text has no words, as an empty one. Ids may be null or repeat; each row is counted by itself. Empty input gives no
    rows; other columns are not read. A task holds a megabyte of texts at a time, or one longer text.
    """
    prepare_tasks(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            found = count_texts([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, f"doc_id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def features() -> dict[str, Column]:
    """Statistics that rules may use, from the counts; 0 where there is nothing to divide by."""
    return {
        "words": F.col("n_words").cast("double"), "chars_per_word": _share("word_chars", "n_words"), "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"), "repeat_share": _share("n_repeat_words", "n_words"), "words_per_line": _share("n_words", "n_lines"),
        "distinct_share": _share("n_distinct", "n_words"), "same_next_share": _share("n_same_next", "n_words"), "single_share": _share("n_single", "n_words"),
        "upper_share": _share("n_upper", "n_letters"), "digit_share": _share("n_digits", "word_chars"), "mark_share": _share("n_marks", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.threshold if self.above else values < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: then ``keep`` is the verdict, if no rule before it has spoken."""

    conditions: tuple[Condition, ...]
    keep: bool

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool = True

    def _chain(self, value, last: Column) -> Column:
        out = None
        for i, r in enumerate(self.rules):
            out = (F if out is None else out).when(r.column(), value(i, r))
        return last if out is None else out.otherwise(last)

    def verdict(self) -> Column:
        """The ordered conditional expression over columns named as in ``features``."""
        return self._chain(lambda i, r: F.lit(r.keep), F.lit(self.default))

    def reason(self) -> Column:
        """The text of the rule that speaks; null for the default."""
        return self._chain(lambda i, r: F.lit(str(r)), F.lit(None).cast("string"))

    def sql(self) -> str:
        branches = [f"WHEN {r} THEN {str(r.keep).lower()}" for r in self.rules]
        return f"CASE {' '.join(branches)} ELSE {str(self.default).lower()} END" if branches else str(self.default).lower()


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a condition gains: rows of the label that stay, times the bits by which they are purer."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray]) -> list[Condition]:
    """Conditions added one by one, each the one that gains most on the rows still covered, until no row of the other label is left."""
    found: list[Condition] = []
    live = np.ones(len(y), bool)
    while len(found) < CONDITIONS and (~y[live]).any():
        p0, n0 = float(y[live].sum()), float((~y[live]).sum())
        best, chosen = 1e-9, None
        for name, at in cuts.items():
            if not len(at):
                continue
            place = np.searchsorted(at, x[name][live], "right")  # value >= at[place - 1]
            p = np.bincount(place[y[live]], minlength=len(at) + 1)
            n = np.bincount(place[~y[live]], minlength=len(at) + 1)
            below_p, below_n = np.cumsum(p)[:-1], np.cumsum(n)[:-1]
            for above, (pp, nn) in ((True, (p0 - below_p, n0 - below_n)), (False, (below_p, below_n))):
                gain = np.where(pp >= LEAST_ROWS, _gain(p0, n0, pp.astype(float), nn.astype(float)), -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, chosen = float(gain[i]), Condition(name, above, float(at[i]))
        if chosen is None:
            break
        found.append(chosen)
        live &= chosen.holds(x[chosen.statistic])
    return found


def _covers(rule: list[Condition], x: dict[str, np.ndarray], size: int) -> np.ndarray:
    return reduce(lambda a, c: a & c.holds(x[c.statistic]), rule, np.ones(size, bool))


def _prune(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """The rule without those last conditions that don't help on rows it wasn't grown on."""

    def worth(length: int) -> float:
        hit = _covers(rule[:length], x, len(y))
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, grown_on: np.ndarray) -> DecisionList:
    """Sequential covering: a rule for the bad rows is grown on one part, pruned on the other, and the rows it covers leave both.

    A rule stays in the list if it covers ``LEAST_ROWS`` bad rows of either part and ``LEAST_PRECISION`` of the rows that it covers
    in all are bad; the first that doesn't ends the list. What no rule covers is kept.
    """
    cuts = {}
    for name, v in x.items():
        levels = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1), method="inverted_cdf")) if len(v) else np.zeros(0)
        # Bad rows have levels of their own, for a rarer kind may lie between two quantiles of all.
        own = np.unique(np.quantile(v[bad], np.linspace(0, 1, CUTS + 1), method="inverted_cdf")) if bad.any() else np.zeros(0)
        levels = np.union1d(levels, own)
        cuts[name] = (levels[1:] + levels[:-1]) / 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < RULES:
        a, b = left & grown_on, left & ~grown_on
        if (bad & a).sum() < LEAST_ROWS or (bad & b).sum() < LEAST_ROWS:
            break
        rule = _grow({k: v[a] for k, v in x.items()}, bad[a], cuts)
        rule = _prune(rule, {k: v[b] for k, v in x.items()}, bad[b])
        hit = _covers(rule, x, len(bad)) & left
        if not rule or min((hit & bad & a).sum(), (hit & bad & b).sum()) < LEAST_ROWS or (hit & bad).sum() < LEAST_PRECISION * hit.sum():
            break
        rules.append(Rule(tuple(rule), keep=False))
        left &= ~hit
    return DecisionList(tuple(rules))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DecisionList:
    """A decision list from labelled rows of ``statistics`` that are not held out (label 0 is bad, others are good).

    Rows with null id or label are left out; of several labels of an id the smallest counts, and rows equal in label and
    statistics count once. At most ``train_rows`` of them, those with the smallest hash, come to the driver, as a dozen numbers
    each; two thirds grow rules and a third prunes them. Without labelled rows, or with one label only, all is kept.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) == 0).alias("_bad"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    named = features()
    rows = stats.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_bad", *(v.alias(k) for k, v in named.items())).distinct()
    mixed = F.xxhash64("_bad", *named)
    sample = rows.withColumn("_hash", mixed).orderBy("_hash", *named, "_bad").limit(train_rows).toArrow()
    x = {k: sample.column(k).to_numpy() for k in named}
    return learn(x, sample.column("_bad").to_numpy().astype(bool), sample.column("_hash").to_numpy() % 3 != 0)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``statistics`` with base_failed, kept (not base_failed, and the list's verdict) and rule, the text of the rule that spoke
    (``base`` where the base rule did, null where nothing speaks against a row). Rows are judged one by one; none for no rows."""
    named = stats.withColumns(features()).withColumn("base_failed", base_failed())
    rule = F.when(F.col("base_failed"), F.lit("base")).otherwise(rules.reason())
    return named.withColumn("kept", ~F.col("base_failed") & rules.verdict()).withColumn("rule", rule).drop(*features())


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents, by rules learned from the labelled ones that pass the base rule and are not held out.

    Null and empty texts have no words and fail the base rule. Without labels that tell, the verdict is that of the base rule.
    """
    stats = materialize(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-statistics")
    rules = train(stats.where(~base_failed()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of op12, which SQL can give: counts of every document and whether it fails the base rule."""
    found = statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("base_failed", base_failed())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "base_failed")


QUALITY_STATISTICS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM t, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS r(k) GROUP BY 1),
s AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct FROM t LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""
