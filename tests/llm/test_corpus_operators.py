"""Dedup, near duplicates, mixing, personal data, WARC and the pipeline: against brute force and SQL."""

import base64
import hashlib
import random
import uuid
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import plain
from support import DATA, same_rows
from ledgerloom.llm import exact_dedup, mixing, ngram_join, pii, queries, warc
from ledgerloom.llm.components import connected_components


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, oracle, name):
    assert same_rows(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), *oracle(queries.SQL[name]))


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_media_columns", "op4_sentencepiece", "op8_license_scan", "op9_toxicity"])
def test_query_has_a_row_for_each_document(spark, name):
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").count() == spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").count()


# exact dedup


def test_exact_duplicates(odd, empty):
    rows = [(r.doc_id, plain.lower(r.text)) for r in odd.collect()]
    size = Counter(t for _, t in rows)
    best = {t: max((d for d, u in rows if u == t and d is not None), default=None) for t in size}
    found = exact_dedup.exact_duplicates(odd, digest=True).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == sorted(((d, best[t], size[t], plain.sha(t)) for d, t in rows), key=str)
    kept = [r.text_sha256 for r in found if r.kept]
    assert sorted(kept) == sorted(map(plain.sha, size)), "one row of each group stays"
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_drop_exact_duplicates(odd, empty):
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(plain.lower(r.text) for r in kept.collect()) == sorted({plain.lower(r.text) for r in odd.collect()})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_drop_exact_duplicates_of_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "Ab", 5, "p"), (2, "aB", 6, "q"), (3, "c", 7, "r"), (None, None, 8, "s")], "_id long, _text string, _len int, _own1 string")
    kept = exact_dedup.drop_exact_duplicates(rows, "_id", "_text")
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "aB", 6, "q"), (3, "c", 7, "r"), (None, None, 8, "s")], key=str)


def test_long_texts_with_equal_prefixes_are_told_apart(spark):
    head = "h" * 1000
    found = exact_dedup.exact_duplicates(frame(spark, [head + "a", head + "b", head + "A", head]))
    assert sorted((r.doc_id, r.keep_id) for r in found.collect()) == [(0, 2), (1, 1), (2, 2), (3, 3)]


# near duplicates


def check_components(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, links = plain.components(rows), plain.link_counts(rows)
    ours = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()), key=str)
    assert ours == sorted(((d, len(plain.shingles(t)), want[i], links[i]) for i, (d, t) in enumerate(rows)), key=str)


def test_components_of_odd_rows(odd, empty):
    check_components(odd)
    assert ngram_join.jaccard_classes(empty).count() == 0


@pytest.mark.parametrize(("members", "worth"), [(128, 0.7), (3, 0.7), (2, 9.0)])
def test_links_equal_brute_force(spark, monkeypatch, members, worth):
    """With small parts as well, so that regions are split into cells, again and again, and compared in blocks."""
    from llm_data import near_copies

    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "WORTH", worth)
    monkeypatch.setattr(ngram_join, "PIVOTS", 4 if members < 128 else 16)
    check_components(frame(spark, near_copies(seed=members)))


def test_all_links_of_a_group_are_counted(spark):
    words = [f"g{i}" for i in range(300)]
    texts = [" ".join([*words[:k * 10], f"own{k}", *words[k * 10 + 1 :]]) for k in range(20)]
    found = ngram_join.jaccard_classes(frame(spark, texts)).collect()
    assert sum(r.n_links for r in found) == 2 * 190 and {r.component_id for r in found} == {0}


def test_regions_become_cells(spark):
    """Clusters around the members of one region: cells leave most pairs out, and replicate what lies between."""
    sets = [np.sort(np.concatenate([np.arange(20), 1000 * (c + 1) + np.arange(40), [10**6 + i]])).astype("<u8") for c in range(8) for i in range(40)]
    rows = [(0, 0, i, len(s), 0, 320, 3) for i, s in enumerate(sets)]
    big = spark.createDataFrame(rows, "cell long, p long, x long, n long, outer long, m long, parts long")
    cells, whole = ngram_join._split(big, spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "x long, set binary"), 0)
    per = cells.groupBy("cell").agg(F.count_if(F.col("outer") == 0).alias("home"), F.count_if(F.col("outer") > 0).alias("guests")).collect()
    assert whole.count() == 0 and sum(r.home for r in per) == 320 and sum(r.home * (r.home + 2 * r.guests) for r in per) < 0.7 * 320**2


def test_links_at_the_threshold(spark):
    """Sets of 9 and 9 with 8 in common: 8 of 10, which links; 7 of 11 doesn't."""
    w = [f"t{i}" for i in range(13)]
    texts = [" ".join(w), " ".join([*w[:12], "other"]), " ".join([*w[:11], "y", "z"]), " ".join(w[:4]), " ".join(w[:4]).upper()]
    check_components(frame(spark, texts))


def test_chains_join(spark):
    check_components(frame(spark, [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 60, 4)]))


def test_drop_near_duplicates(spark, odd):
    from llm_data import near_copies

    df = frame(spark, near_copies(seed=8)).withColumn("extra", F.lit(1))
    want = plain.components([(r.doc_id, r.text) for r in df.collect()])
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert ngram_join.drop_near_duplicates(odd).columns == odd.columns


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(500, k) for k in range(501, 560)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[k] for k in (100, 200, 300)} == {100} and {found[k] for k in range(500, 560)} == {500}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# mixing


def test_targets_stop_at_the_cap(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), ("d", 1000), (None, 0)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights, target = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1])), {}
    free, left = dict(sizes), 1.5 * 3010
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * dict(sizes)[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * dict(sizes)[s]
            left -= target[s]
            del free[s]
    assert found == pytest.approx(target)


def test_mix_comes_near_its_targets(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    rows = mixing.systematic_copies(docs)
    per = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 0.03 * r.target and r.most <= 2 for r in per)
    assert rows.exceptAll(mixing.systematic_copies(docs.repartition(5))).count() == 0
    taken = {}
    for r in mixing.systematic_copies(odd).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.exceptAll(odd.unionByName(odd)).count() == 0
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}
    assert mixing.systematic_copies(empty).count() == 0 and mixing.mix(empty).count() == 0


# personal data

PRIVATE = [
    "a@b.co, x@y, a@b@c.d; a.b.@c-d.e.f_g@h.i", "1.2.3.4.5 256.1.1.1 001.2.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111",
    "+1 (523) 555-1055 +12 +123456789 +1 555 0000 4111111111111111", "é@é.é é1.1.1.1é a@b.cé", "4" * 13 + " " + "0" * 16, "+" * 50 + "1" + "(" * 50 + "2", "a" * 3000 + "@b.c",
    "née 10.0.0.1 a@b.c " * 700,
]


def test_base_spans_equal_brute_force(spark, odd):
    real = [r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("text rlike '[0-9]{4}|@'").limit(150).collect()]
    df = frame(spark, [*PRIVATE, *real], 1000).unionByName(odd.select("doc_id", "text"))
    found = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.base]) for r in pii.find_personal_data(df).collect()), key=str)
    assert found == sorted(((r.doc_id, plain.private(r.text)) for r in df.collect()), key=str)


def test_context_finds_unseen_identifiers(spark, empty):
    seen = [f"Please ring hotline +1 (523) 555-{1000 + i} today" for i in range(8)]
    texts = [*seen, "Please ring hotline +1-523 now", "hotline +9 (888) 777-6666", "Version 3.14 of chapter 12-34 is out", "mail bob@x.org", "mail amy@y.org", "mail joe@z.org", "mail root@localhost or 5", "mail ann@x.org", "mail eve@x.org"]
    found = {r.doc_id: [(s.kind, s.value) for s in r.extra] for r in pii.find_personal_data(frame(spark, texts), min_confidence=0.6).collect()}
    assert found[14] == [("ctx_email", "root@localhost")]
    assert found[8] == [("ctx_phone", "+1-523")]
    assert not any(found[i] for i in [*range(8), 9, 10, 11, 12, 13, 15, 16])
    assert pii.find_personal_data(empty).count() == 0


def test_context_finds_other_forms(spark):
    """At the production parameters: numbers without the base form's sign, in several tokens, in words, and by the word after."""
    cards = [n for n in range(1111, 1400) if plain.luhn(f"411111111111{n}")][:12]
    seeds = [f"Call +49 30 5551{i:03}. Mail p{i}@x.org ip 10.0.0.{i} card 4111 1111 1111 {n} ok" for i, n in enumerate(cards)]
    seeds += [f"+49 89 7771{i:03} ringing" for i in range(12)]
    texts = [
        "call 0171 2345678 now", "ip fe80::1ff:fe23:4567 up", "card 4111.1111.1111.1112", "mail jane at example dot com soon", "0171 7654321 ringing",
        "call zero one seven one two three four", "call 5 times", "call 12.05.2024", "call me@home", "meet 0171 2345679 there", "ip dead::beef", "mail @jane", *["call unit-771234"] * 3,
    ]
    found = {r.doc_id: [(s.kind, s.value) for s in r.extra] for r in pii.find_personal_data(frame(spark, [*seeds, *texts])).collect()}
    assert [found[i] for i in range(24)] == [[]] * 24
    want = [
        "phone:0171 2345678", "ip:fe80::1ff:fe23:4567", "card:4111.1111.1111.1112", "email:jane at example dot com", "phone:0171 7654321",
        "phone:zero one seven one two three four", None, None, None, None, "ip:dead::beef", None, *["phone:unit-771234"] * 3,
    ]
    assert [found[i] for i in range(24, 39)] == [[(f"ctx_{w.split(':')[0]}", w.split(":", 1)[1])] if w else [] for w in want]


def test_personal_data_query_equals_brute_force(spark):
    """Counts and digest of the base spans, and ``spans``, which begins with them and goes on with those that context adds."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    added = plain.contextual(docs.items())
    assert any(k == "ctx_secret" for spans in added.values() for k, _, _ in spans)
    rows = pii.op6_personal_data(spark, f"{DATA}/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = plain.private(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        more = [s.split(":") for s in r.spans[len(joined) :].split(",") if s]
        assert all(k.startswith("ctx_") and 0 <= int(a) < int(b) <= len(docs[r.doc_id]) for k, a, b in more)
        assert not any(int(a) < d and c < int(b) for _, a, b in more for _, c, d in base)
        assert [(k, int(a), int(b)) for k, a, b in more] == added.get(r.doc_id, []) and r.n_spans == len(base) + len(more)


def test_credentials_are_found_by_their_context(spark):
    """Quoted random strings are seeds; what stands in their place in other texts is found, and such strings elsewhere are not."""
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(9)]
    texts = [f'set api token = "{k}" here {i}' for i, k in enumerate(keys[:6])]
    texts += [f"token = abc123x9876, {keys[6]}", f'commit "{keys[7]}" fixed', f"sha {keys[8]}", "token 12", f'TOKEN = "{keys[0]}"!!', None, ""]
    docs = frame(spark, texts)
    found = {r.doc_id: [(s.kind, s.start, s.end, s.value) for s in r.extra] for r in pii.find_personal_data(docs).collect()}
    assert [found[i] for i in range(6)] == [[("ctx_secret", 17, 57, k)] for k in keys[:6]]
    assert found[6] == [("ctx_secret", 8, 19, "abc123x9876")] and found[10] == [("ctx_secret", 9, 49, keys[0])]
    assert not any(found[i] for i in (7, 8, 9, 11, 12))
    assert {i: [s[:3] for s in v] for i, v in found.items() if v} == plain.contextual(enumerate(texts))


@pytest.mark.parametrize("support, confidence", [(2, 0.5), (3, 0.6), (5, 0.8)])
def test_context_equals_brute_force(spark, odd, support, confidence):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("text rlike '[0-9]{4}|@'").limit(120).collect()]
    seeds = [f"Call +49 30 5551{i:03}. Mail p{i}@x.org ip 10.0.0.{i} ok" for i in range(6)]
    more = [*seeds, *PRIVATE, "call 0171 2345678 now", "0171 2345678 please", "0171 999999 please", "mail me@home or ring 0171 2345678", "ip fe80::1ff:fe23:4567 ok", "call 12 call 13", *(r.text for r in odd.collect())]
    rows += [(100_000 + i, t) for i, t in enumerate(more)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), min_support=support, min_confidence=confidence)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.extra] for r in found.collect() if r.extra}
    assert got == plain.contextual(rows, support=support, confidence=confidence) and got


def test_a_few_seeds_do_not_claim_a_common_context(spark):
    """Order numbers stand where some phones do; the words further off tell them apart."""
    seeds = [f"Her phone number +49 30 5551{i:03} is new" for i in range(5)]
    orders = [f"The order number {83728371 + 7 * i} was sent" for i in range(200)]
    texts = [*seeds, *orders, "His phone number 0171 2345678 rang"]
    found = {r.doc_id: [(s.kind, s.value) for s in r.extra] for r in pii.find_personal_data(frame(spark, texts)).collect() if r.extra}
    assert found == {205: [("ctx_phone", "0171 2345678")]}


def test_unseen_identifiers_in_a_planted_corpus(spark):
    """Shapes that no expression for identifiers has, among other numbers in like contexts: precision and recall by kind."""
    cards = [n for n in range(1000, 9999) if plain.luhn(f"411111111111{n}")]
    planted = {
        "phone": (["call me under", "my mobile is", "phone number"], lambda i: f"+49 30 55{i:05}", lambda i: (f"0171 23{i:05}", f"(030) 9{i:06}", f"ext-77{i:05}")[i % 3]),
        "ip": (["logged in from", "client address", "banned host"], lambda i: f"10.0.{i // 200}.{i % 200}", lambda i: (f"fe80::{i + 4096:x}:1", f"2001:db8::{i + 256:x}", f"host-44{i:05}")[i % 3]),
        "card": (["charged to card", "visa ending", "paid with"], lambda i: f"4111 1111 1111 {cards[i]}", lambda i: (f"4111.1111.1111.{i:04}", f"4111/1111/1111/{i:04}")[i % 2]),
        "email": (["write to", "contact via"], lambda i: f"p{i}@x.org", lambda i: (f"user{i}@intranet", f"p{i} at example dot com")[i % 2]),
    }
    rng, texts, want = random.Random(5), [], set()
    fill = lambda: " ".join(rng.choice(["red", "stone", "river", "walks", "under", "old", "light"]) for _ in range(rng.randint(2, 6)))
    for kind, (contexts, seed, other) in planted.items():
        for i in range(150):
            unseen = i % 5 == 0
            value = (other if unseen else seed)(i)
            if unseen:
                want.add((len(texts), f"ctx_{kind}", value))
            texts.append(f"{fill()} {contexts[i % len(contexts)]} {value} {fill()}")
    texts += [f"{fill()} {c} {9_000_000 + 13 * i} {fill()}" for i in range(150) for c in ("order number", "invoice number", "counted", "batch")]
    found = {(r.doc_id, s.kind, s.value) for r in pii.find_personal_data(frame(spark, texts)).collect() for s in r.extra}
    assert len(found & want) >= 0.95 * len(found) and len(found & want) >= 0.95 * len(want)
    assert {k for _, k, _ in found & want} == {f"ctx_{k}" for k in planted}


def test_contexts_of_mentions(spark):
    texts = ["one two three four 123456 five, six -- seven eight", "a" * 40 + " b 777777 " + "c" * 40, "x ......... 888888", "999999", "é'e-_ 'f (1234567) ... Ü"]
    spans = frame(spark, texts).select("doc_id", pii.spans_of(F.col("text"), pii.MENTION, words=True).alias("s"))
    got = {r.doc_id: set(r.p) for r in spans.select("doc_id", pii.patterns_of(F.col("s")[0]["left"], F.col("s")[0]["right"]).alias("p")).collect()}
    shape = {"left": lambda w: " ".join(w) + "|", "right": lambda w: "|" + " ".join(w), "both": "|".join}
    for i, t in enumerate(texts):
        m = regex.search(pii.MENTION, t)
        assert got[i] == {shape[side](w) for side, *w in plain.contexts(t[: m.start()], t[m.end() :])}
    assert got[0] == {"four|", "three four|", "two three four|", "|five", "|five six", "|five six seven", "four|five"} and got[3] == set() == got[2]


def test_copies_do_not_make_a_pattern(spark):
    texts = ["call number +1 (523) 555-1055 now"] * 30 + ["call number 77-88 now"]
    assert not any(r.extra for r in pii.find_personal_data(frame(spark, texts)).collect())


def test_personal_data_stays_in_the_jvm(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pii.op6_personal_data(spark, f"{DATA}/sf0.001").explain()
        exact_dedup.op7_exact_dedup(spark, f"{DATA}/sf0.001").explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


# WARC


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_rows(manifest, *args, **options):
    rows = warc.read_warc(manifest, *args, **options)
    return rows.withColumn("page_id", warc.page_of(F.col("record_id"))).withColumn("refers_to", warc.page_of(F.col("refers_to"))).collect()


def test_warc_round_trip(spark, odd, tmp_path):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "kind", "digest", "revisit")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    for split in (37, 1000, 1 << 20):
        rows = warc_rows(manifest, split, payload=True)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in rows), key=str)
        assert got == sorted(((r.page_id, len((r.html or "").encode()), digest((r.html or "").encode())) for r in pages.collect()), key=str)
        assert all(r.digest_ok is None and r.payload is None if r.record_type == "revisit" else r.digest_ok and digest(r.payload) == r.payload_digest for r in rows)
        assert all(r.date for r in rows) and len({r.record_id for r in rows}) == len(rows) - 2, "two rows repeat another's id and payload"
    first = {}
    for r in pages.collect():
        if r.page_id is not None:
            first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    by_digest = {digest(t.encode()): p for t, p in first.items()}
    for r in rows:
        revisit = r.payload_digest in by_digest and r.page_id != by_digest[r.payload_digest]
        assert (r.record_type, r.refers_to) == (("revisit", by_digest[r.payload_digest]) if revisit else ("response", None))


def test_small_payloads_are_never_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "long" * 9), (4, "u", "long" * 9)], "page_id long, url string, html string")
    rows = warc_rows(warc.write_warc(pages, f"file://{tmp_path}/w", min_bytes=10))
    assert {r.page_id: r.refers_to for r in rows} == {1: None, 2: None, 3: None, 4: 3}


def archive(spark, tmp_path, data):
    name = tmp_path / f"{uuid.uuid4().hex}.warc.gz"
    name.write_bytes(data)
    return spark.createDataFrame([(f"file://{name}", len(data))], "path string, n_bytes long")


def member(head, body=b"", level=6):
    import zlib

    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n") + packer.flush()


def test_reader_is_not_fooled(spark, tmp_path):
    """Gzip magic in payloads, an archive quoted in a stored payload, and damaged members between two records."""
    inner = warc.record_bytes(99, "u", b"inner", digest(b"inner"))
    quoted = member(["WARC/1.1", "WARC-Type: resource", "WARC-Record-ID: <urn:page:1:x>", "WARC-Target-URI: u", f"WARC-Payload-Digest: sha1:{digest(inner * 3)}"], inner * 3, level=0)
    last = warc.record_bytes(2, "u", b"\x1f\x8b\x08 end", digest(b"\x1f\x8b\x08 end"))
    broken = warc.record_bytes(3, "u", bytes(range(256)) * 20, digest(b""))
    broken = broken[: len(broken) // 2] + bytes(40) + broken[len(broken) // 2 + 40 :]
    files = archive(spark, tmp_path, quoted + b"\x1f\x8b\x08 broken " + broken + last)
    for split in (16, 64, 250, 1 << 20):
        assert sorted((r.page_id, r.digest_ok) for r in warc_rows(files, split)) == [(1, True), (2, True)]
        assert sorted(r.record_type for r in warc_rows(files, split, damaged=True)) == ["damaged", "resource", "response"]


def test_reader_takes_archives_of_other_writers(spark, tmp_path):
    """Unknown types, no digests or other ones, ids of any form, names in any case, and a file cut short."""
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/plain\r\n\r\nhello"
    data = b"".join([
        member(["WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z"], b"software: x\r\n"),
        member(["WARC/1.0", "warc-type: Response", "warc-record-id: <urn:uuid:2>", "Warc-Target-Uri: http://a/", "content-type: application/http; msgtype=response"], http),
        member(["WARC/1.0", "WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:3>", "WARC-Payload-Digest: md5:abc"], b"m"),
        member(["WARC/1.0", "WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:4>", "WARC-Refers-To: <urn:uuid:2>"]),
        member(["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:5>"], b"lost" * 500)[:-30],
    ])
    for split in (100, 1 << 20):
        rows = sorted(warc.read_warc(archive(spark, tmp_path, data), split, payload=True, damaged=True).collect(), key=lambda r: r.offset)
        assert [(r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.digest_ok, r.refers_to) for r in rows] == [
            ("urn:uuid:1", "warcinfo", 13, digest(b"software: x\r\n"), None, None), ("urn:uuid:2", "response", 5, digest(b"hello"), None, None),
            ("urn:uuid:3", "metadata", 1, "md5:abc", None, None), ("urn:uuid:4", "revisit", None, None, None, "urn:uuid:2"), (None, "damaged", None, None, None, None),
        ]
        assert bytes(rows[1].payload) == b"hello" and rows[1].url == "http://a/"


def plain_record(version, name, body, extra=()):
    head = [version, "WARC-Type: resource", f"WARC-Record-ID: <{name}>", *extra, f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("split", [30_000, 4 << 20])
def test_records_that_share_a_member_and_plain_archives(spark, tmp_path, split):
    import gzip

    bodies = [b"a" * 300_000, b"WARC/1.0\r\nnot a record " * 20, random.Random(2).randbytes(200_000), bytes(range(256)) * 40]
    records = [plain_record(v, f"r{i}", b) for i, (v, b) in enumerate(zip(("WARC/1.1", "WARC/1.0", "WARC/0.18", "WARC/0.17"), bodies))]
    want = [(f"r{i}", len(b), digest(b), bytes(b)) for i, b in enumerate(bodies)]
    for data in (b"".join(records), gzip.compress(b"".join(records)), gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])), b"".join(map(gzip.compress, records))):
        rows = warc.read_warc(archive(spark, tmp_path, data), split, payload=True, damaged=True).orderBy("offset", "inside").collect()
        assert [(r.record_id, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in rows] == want


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_whatever_is_not_read_is_a_damaged_row(spark, tmp_path, split):
    import gzip

    good = [plain_record("WARC/1.0", f"r{i}", b"x" * 50) for i in range(3)]
    files = {
        b"no archive at all" * 20: [("damaged", 0, 340)], b"junk" + gzip.compress(good[0]): [("damaged", 0, 4), ("resource", 4, None)],
        good[0] + b"garbage" * 30 + b"\r\n" + good[1]: [("resource", 0, None), ("damaged", len(good[0]), len(good[0]) + 212), ("resource", len(good[0]) + 212, None)],
        gzip.compress(good[0] + b"trailing text"): [("damaged", 0, None), ("resource", 0, None)], good[0] + good[1][:-30]: [("resource", 0, None), ("damaged", len(good[0]), len(good[0] + good[1]) - 30)],
        gzip.compress(good[0]) + b"\x00" * 99: [("resource", 0, None), ("damaged", len(gzip.compress(good[0])), len(gzip.compress(good[0])) + 99)],
    }
    for data, want in files.items():
        rows = warc.read_warc(archive(spark, tmp_path, data), split, damaged=True).orderBy("offset", "record_type").collect()
        assert [(r.record_type, r.offset) for r in rows] == [w[:2] for w in want] and all(w[2] in (None, r.end) for r, w in zip(rows, want)), data
        assert warc.read_warc(archive(spark, tmp_path, data), split).count() == sum(w[0] == "resource" for w in want)


def test_warc_of_nothing(spark, empty):
    pages = empty.selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    assert warc.read_warc(warc.write_warc(pages)).count() == 0


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [sorted(r.doc_id for r in d.collect()) for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1]) and set(ids[1]) < set(ids[0])
    texts = [plain.lower(r.text) for r in seen[1].collect()]
    assert sorted(set(texts)) == sorted(plain.lower(r.text) for r in seen[2].collect())
    rows = [(r.doc_id, r.text) for r in seen[2].collect()]
    want = plain.components(rows)
    assert ids[3] == sorted({want[i] if plain.shingles(t) else d for i, (d, t) in enumerate(rows)})
    copies = {r.doc_id: r.copies for r in mixing.systematic_copies(seen[3]).collect() if r.copies}
    assert dict(Counter(ids[4])) == copies and ids[5] == ids[4]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == ids[5]


def test_pipeline_handles_odd_and_empty_rows(spark, odd, empty):
    import corpus_pipeline

    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, f"{DATA}/sf0.001")
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() == 0
