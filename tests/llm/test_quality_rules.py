"""Word statistics against a plain version, and decision lists that are learned from planted rules."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules as QR
from support import DATA, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {k for k, n in Counter(windows).items() if n > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in QR.SYMBOLS for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, g in enumerate(windows) if g in twice for k in range(3)}), "n_lines": len(lines), "n_distinct": len(set(w)),
        "n_same_next": sum(a == b for a, b in zip(w, w[1:])), "n_single": sum(len(x) == 1 for x in w), "n_letters": len(re.findall("[A-Za-z]", text)),
        "n_upper": len(re.findall("[A-Z]", text)), "n_digits": len(re.findall("[0-9]", text)), "n_marks": len(re.findall(r"[!-/:-@\[-`{-~]", text)),
    }


@pytest.mark.parametrize("packed", [QR.PACKED, 2])
def test_counts(packed, monkeypatch):
    monkeypatch.setattr(QR, "PACKED", packed)
    rng = random.Random(4)
    parts = ["a", "B", "é", "# ", " ", "\n", "\n", "x y z ", "\t", "1", "\x0b", "\x1c", "日本 "]
    texts = ["", " ", "\n\n"] + ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 9, 60, 400]))) for _ in range(400)]
    found = QR.count_texts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {c: int(found[c][i]) for c in QR.COUNTS} == plain_counts(t), repr(t)


def test_odd_rows_and_empty_input(odd, empty):
    found = sorted((tuple(r) for r in QR.statistics(odd).collect()), key=repr)
    assert found == sorted(((r.doc_id, *(plain_counts(r.text)[c] for c in QR.COUNTS)) for r in odd.select("doc_id", "text").collect()), key=repr)
    assert QR.statistics(empty).count() == 0 and QR.judge(QR.statistics(empty), QR.DecisionList(())).count() == 0


def planted(n=3000, seed=2):
    """Rows that are bad if a > 0.8, or if b < 0.1 and c > 0.5; one in 100 labels is wrong."""
    rng = np.random.default_rng(seed)
    x = {k: rng.random(n) for k in "abcd"}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.1) & (x["c"] > 0.5))
    return x, bad, bad ^ (rng.random(n) < 0.01), rng.random(n) < 2 / 3


def test_planted_rules_are_learned():
    x, bad, said, part = planted()
    found = QR.learn(x, said, part)
    assert 2 <= len(found.rules) <= 6 and {c.statistic for r in found.rules for c in r.conditions} <= set("abc")
    hit = np.zeros(len(bad), bool)
    for r in found.rules:
        hit |= QR._covers(list(r.conditions), x, len(bad))
    assert (hit == bad).mean() > 0.99


def test_no_rule_without_evidence():
    x, bad, said, part = planted()
    rng = np.random.default_rng(9)
    assert QR.learn(x, np.zeros(len(bad), bool), part).rules == ()
    assert QR.learn(x, rng.random(len(bad)) < 0.1, part).rules == ()
    none = {k: v[:0] for k, v in x.items()}
    assert QR.learn(none, bad[:0], part[:0]).rules == ()


def test_list_is_ordered_and_its_sql_is_the_same(spark):
    rules = QR.DecisionList((QR.Rule((QR.Condition("a", True, 0.9),), True), QR.Rule((QR.Condition("a", True, 0.5), QR.Condition("b", False, 0.5)), False)))
    df = spark.createDataFrame([(0.95, 0.1), (0.6, 0.1), (0.6, 0.7), (0.1, 0.1), (None, 0.1)], "a double, b double")
    found = df.select(rules.verdict().alias("v"), F.expr(rules.sql()).alias("s"), rules.reason().alias("r")).collect()
    assert [r.v for r in found] == [r.s for r in found] == [True, False, True, True, True]
    assert [r.r for r in found] == ["a >= 0.9", "a >= 0.5 AND b < 0.5", None, None, None]
    assert df.select(QR.DecisionList(()).verdict().alias("v")).distinct().collect() == [(True,)]


def test_training_sample_is_bounded_and_skips_nulls(spark):
    words = [f"w{k}" for k in range(600)]
    rows = [(i, " ".join(words[: 60 + i] + (["###"] * 20 if i % 3 == 0 else []))) for i in range(1, 400)] + [(None, "w"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(1, 400)] + [(None, 0), (5, None)], "doc_id long, quality int")
    stats = QR.statistics(docs)
    found = QR.judge(stats.where(~QR.base_failed()), QR.train(stats.where(~QR.base_failed()), labels))
    assert {(r.doc_id, r.kept) for r in found.where("doc_id IS NOT NULL").collect()} == {(i, i % 3 != 0) for i in range(1, 400)}
    assert QR.train(stats, labels, train_rows=3).rules == () and QR.train(stats, labels.limit(0)).rules == ()
    again = docs.where("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text")
    assert len(QR.train(QR.statistics(docs.unionByName(again)), labels).rules) == 1


def test_query_base_columns_and_held_out_accuracy(spark):
    d = f"{DATA}/sf0.1"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = QR.op12_quality_rules(spark, d).collect()
    assert len(found) == len(docs)
    for r in found[::17]:
        own = plain_counts(docs[r.doc_id])
        assert all(r[c] == own[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r.base_failed == (own["n_words"] < 50 or 100 * own["n_repeat_words"] > 50 * own["n_words"]) and not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(r.kept, quality[r.doc_id]) for r in found if r.doc_id in quality and crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    bad, good = [k for k, q in judged if q == 0], [k for k, q in judged if q]
    assert len(bad) > 20 and sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.99 * len(good)


def test_statistics_query_equals_sql(spark, oracle):
    assert same_rows(QR.quality_statistics(spark, f"{DATA}/sf0.01"), *oracle(QR.QUALITY_STATISTICS_SQL, "sf0.01"))
