"""Fill-in-the-middle examples against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_in_middle as FIM
from support import DATA, same_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_marks_and_selection():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"ab \n\t\x0e\x08\x1f!\xc3\xa9\x7f\x80\xff\x00", np.uint8), 10_007)
    ends, starts = FIM.units_and_characters(data, np.array([10_007]))
    space = np.isin(data, [0x20, *range(9, 14)])
    wanted = np.flatnonzero(~space & np.append(space[1:], True) | (np.arange(len(data)) == len(data) - 1))
    assert (ends.select(np.arange(1, len(wanted) + 1)) == wanted).all() and ends.before[-1] == len(wanted)
    at = np.arange(len(data) + 1)
    assert (ends.rank(at) == np.searchsorted(wanted, at)).all()
    assert (starts.rank(at) == np.append(0, np.cumsum((data & 0xC0) != 0x80))).all()


def test_blocks_join(monkeypatch):
    data = np.frombuffer("ab cd  ef\ngé ".encode() * 50, np.uint8)
    whole = FIM.units_and_characters(data, np.array([len(data)]))
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(FIM, "BLOCK", size)
        cut = FIM.units_and_characters(data, np.array([len(data)]))
        assert all((x.words == y.words).all() for x, y in zip(whole, cut))


def test_odd_rows_and_empty_input(odd, empty):
    found = in_order(FIM.fill_in_middle(odd).collect())
    ours = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in found]
    assert ours == in_order(plain_version(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect())
    assert FIM.fill_in_middle(empty).count() == 0


def test_random_texts_and_restoring(spark):
    rng = random.Random(11)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "é", "日本", "\x0b", "\x1c", " ", "<", "S>", "<P", ">", "𝒳", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 40, 300])))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = FIM.fill_in_middle(df).withColumn("back", FIM.restored(F.col("output"), F.col("form"))).collect()
    assert in_order(r[:6] for r in found) == in_order(plain_version(*r) for r in rows)
    assert {(r.doc_id, r.back) for r in found} == set(rows) and {r.form for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, oracle, size):
    assert same_rows(FIM.op11_fill_in_middle(spark, f"{DATA}/{size}"), *oracle(FIM.OP11_SQL, size))
