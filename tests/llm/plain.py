"""Plain versions of operators, without Spark, that tests compare with."""

import hashlib
import re

import regex
from ledgerloom.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


def shingles(text, n=5):
    w = WORD.findall(lower(text))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows):
    """{row number: component id} of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(doc_id, least.get(r, doc_id))
    return {i: least.get(find(i)) for i in range(len(rows))}


def link_counts(rows):
    """{row number: number of other rows it links with} of (doc_id, text) rows."""
    sets, found = [shingles(t) for _, t in rows], dict.fromkeys(range(len(rows)), 0)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                found[i] += 1
                found[j] += 1
    return found


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d if i % 2 == 0 else 2 * d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def private(text):
    """Base spans as (kind, start, end)."""
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits) if digits else False, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


def contexts(before, after):
    """Patterns of a mention from the text before and after it, word by word outwards."""
    word, left, right, at = r"\p{L}[\p{L}\p{M}'_-]{0,30}+", [], [], 0
    while len(left) < 3:  # the leftmost start from which one more word can be said, then fewer other characters than nine
        need = "".join(rf"[^\p{{L}}]{{1,8}}+{word}" for _ in left)
        m = regex.search(rf"({word}){need}[^\p{{L}}]{{0,8}}+\Z", before)
        if not m:
            break
        left.insert(0, m[1].lower())
    while len(right) < 3:
        m = regex.compile(rf"[^\p{{L}}]{{{1 if right else 0},8}}+({word})").match(after, at)
        if not m:
            break
        right.append(m[1].lower())
        at = m.end()
    found = {("left", *left[-k:]) for k in range(1, len(left) + 1)} | {("right", *right[:k]) for k in range(1, len(right) + 1)}
    return found | ({("both", left[-1], right[0])} if left and right else set())


def contextual(rows, rounds=3, support=5, confidence=0.8, unseen=0.1):
    """{id: spans that context adds, as (kind, start, end)} of (id, text) rows, from dictionaries of all patterns and instances."""
    found, seeds, where, plain_numbers = [], {}, {}, set()
    for i, text in rows:
        text, base = text or "", private(text)
        hits = list(regex.finditer(pii.MENTION, text))
        ends = [0, *(m.end() for m in hits)]
        starts = [*(m.start() for m in hits), len(text)]
        for k, m in enumerate(hits):
            patterns = contexts(text[ends[k] : starts[k]], text[ends[k + 1] : starts[k + 1]])
            own = next(((kind, text[a:b]) for kind, a, b in base if a < m.end() and m.start() < b), None)
            secret = bool(regex.match(pii.SECRET, m[0]))
            if own or secret:
                seeds[own[1] if own else m[0]] = {**seeds.get(own[1] if own else m[0], {}), (own[0] if own else "secret"): 1.0}
            digits = regex.sub("[^0-9]", "", m[0])
            if "@" in m[0]:
                ordinary = not regex.search(r"[\p{L}\p{N}]@[\p{L}\p{N}\[]", m[0])
            else:
                short = len(digits) < 6 and not regex.search(r"^\(?\+[0-9]|[0-9]\.[0-9]+\.[0-9]|:[0-9A-Fa-f]*:", m[0]) and not regex.search(pii.SPELLED_DIGITS, m[0])
                ordinary = (short or len(digits) > 19 or bool(regex.search(pii._DATE, m[0]))) and not regex.search(pii.SPELLED_AT, m[0]) and not secret
            value = own[1] if own else m[0]
            for p in patterns:
                where.setdefault(p, {}).setdefault(value, []).append((own is not None or secret, ordinary))
            found.append((i, m, patterns, own, secret, ordinary))

    def form(value, kind):
        address = "@" in value or bool(regex.search(pii.SPELLED_AT, value))
        return address == (kind == "email") and (kind == "secret" or not regex.match(pii.SECRET, value))

    scores, best = dict(seeds), {}
    for _ in range(rounds):
        best = {}
        for p, values in where.items():
            negative = sum(not any(s for s, _ in v) and all(o for _, o in v) for v in values.values())
            kinds = [(k, s) for v in values for k, s in scores.get(v, {}).items()]
            for kind in {k for k, _ in kinds}:
                mine = [s for k, s in kinds if k == kind]
                c = sum(mine) / (len(kinds) + negative + unseen * max(len(values) - len(kinds) - negative, 0))
                if len(mine) >= support and c >= confidence:
                    best[p] = max(best.get(p, (0, "")), (c, kind))
        scores = dict(seeds)
        for p, (c, kind) in best.items():
            for v, seen in where[p].items():
                if v not in seeds and not all(o for _, o in seen) and form(v, kind):
                    (k, old), = scores.get(v, {"": 0}).items()
                    c2, k2 = max((old, k), (c, kind))
                    scores[v] = {k2: c2}
    out = {}
    for i, m, patterns, own, _, ordinary in found:
        fits = [best[p] for p in patterns if p in best and form(m[0], best[p][1])]
        if fits and not own and not ordinary:
            kind, (a, b) = max(fits)[1], m.span()
            if kind == "secret":
                inner = regex.search(r"[\p{L}\p{N}](?:.*[\p{L}\p{N}=])?", m[0])
                a, b = m.start() + inner.start(), m.start() + inner.end()
            out.setdefault(i, []).append((f"ctx_{kind}", a, b))
    return {i: sorted(v) for i, v in out.items()}


def base_phrases(text):
    """(number of words, places as (word, label)) of the license scan."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = []
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(places)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
