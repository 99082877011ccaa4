"""Personal data by bootstrapped contextual extraction, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hint_small, materialize

# What counts as an identifier, in the order of the result.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_AT, _DOT = r"(?:\x20at\x20|\x20?[\[(]\x20?at\x20?[\])]\x20?)", r"(?:\.|\x20dot\x20|\x20?[\[(]\x20?dot\x20?[\])]\x20?)"
#: An address in words: 'jane at example dot com', 'jane (at) example.com'. A plain 'at' needs a 'dot', for it is a common word.
SPELLED_AT = rf"(?i:[a-z0-9._%+-]++(?:{_AT}(?=[a-z0-9-]++\x20?[\[(]?\x20?dot\b)|\x20?[\[(]\x20?at\x20?[\])]\x20?)[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++)"
_WORD_DIGIT = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
SPELLED_DIGITS = rf"(?i:{_WORD_DIGIT}(?:[\x20,-]{{1,2}}+{_WORD_DIGIT}){{5,}}+(?![\p{{L}}\p{{N}}]))"
_ENDS = r"(?=[^\p{L}\p{N}@\x20\x09-\x0D]{0,4}(?:[\x20\x09-\x0D]|$))"
_QUAD = r"[0-9]++(?:\.[0-9]++){3}+"
_NUMBER = r"[0-9]++(?:[().:/-]{1,3}+[0-9]++)*+"
#: A mention, in this order: a spelled-out address or number; a dotted quad; a run of adjacent numbers; a token with a digit or
#: an @; an address in hexadecimal groups.
MENTION = (
    rf"(?<![^\x20\x09-\x0D])(?:{SPELLED_AT}|{SPELLED_DIGITS}|{_QUAD}{_ENDS}"
    rf"|[+(]{{0,3}}+{_NUMBER}{_ENDS}(?:(?:(?<=\([0-9]{{1,6}})\))?+[\x20/-]{{1,3}}+(?!{_QUAD})\(?{_NUMBER}{_ENDS})*+"
    r"|[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+|[A-Fa-f]{0,4}+:[A-Fa-f]{0,4}+:[A-Fa-f:]*+(?![^\x20\x09-\x0D]))"
)
#: Texts without any of these have no mention.
_HINT = rf"[0-9@]|[A-Fa-f]:|:[A-Fa-f]|(?i:\bdot\b|{_WORD_DIGIT}[\x20,-])"
#: A credential: a quoted run of at least 32 letters and digits, four digits and a letter among them.
SECRET = r"""^["'](?=(?:[A-Za-z+]*+[0-9]){4})(?=[0-9]*+[A-Za-z])[A-Za-z0-9+]{32,}+={0,2}["']"""
_DATE = r"^\D*(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2}(?:[0-9]{2})?|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?!\d)\D*$"
#: A word of a context, at most 31 characters of it, and how many there are on a side, with up to eight other characters between.
WORD = r"\p{L}[\p{L}\p{M}'_-]{0,30}+"
CONTEXT_WORDS = 3
_BETWEEN = r"[^\p{L}]"
_BEFORE = rf"((?:{WORD}{_BETWEEN}{{1,8}}+){{0,{CONTEXT_WORDS - 1}}}{WORD}){_BETWEEN}{{0,8}}+\z"
_AFTER = rf"^{_BETWEEN}{{0,8}}+({WORD}(?:{_BETWEEN}{{1,8}}+{WORD}){{0,{CONTEXT_WORDS - 1}}}+)"
#: No context is longer than this, so no more of the text beside a mention is searched for it.
_REACH = CONTEXT_WORDS * (31 + 8)
ROUNDS = 3
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
#: The prior that a value that nothing is known of is no identifier: it weighs so much against a pattern.
UNSEEN_WEIGHT = 0.1


#: Running sums over arrays go by blocks of so many items: appending to an array copies it, and blocks keep that short.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, start: Column, size, item, kind: str) -> Column:
    """``item(position before, x)`` for each x of ``items``, the position growing by ``size(x)`` from ``start``."""
    state = F.struct(start.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(item(acc["at"], x))).alias("out"))

    return F.aggregate(items, state, step, lambda acc: acc["out"])


def _places(sizes: Column) -> Column:
    """(start, end) of each match from the (gap, size) pairs of a text, which must not be empty."""
    whole = lambda s: s["gap"] + s["size"]
    span = lambda at, s: F.struct((at + s["gap"]).alias("start"), (at + whole(s)).alias("end"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK)))

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, s: acc + whole(s)))
        starts = _running(totals, F.lit(0), lambda t: t, lambda at, t: at, "int")
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: _running(b, at, whole, span, "struct<start:int,end:int>")))

    return _let(blocks, placed)


def spans_of(text: Column, pattern: str, words: bool = False) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of (start, end, value), in code points.

    Built from the text between the matches and the matches themselves, each read by one pass of the pattern. With ``words``
    also up to ``CONTEXT_WORDS`` words before and after each match, lower-cased, in the order of the text.
    """
    fields = "start:int,end:int,value:string" + (",left:array<string>,right:array<string>" if words else "")
    none = F.expr(f"cast(array() as array<struct<{fields}>>)")

    def build(m: Column) -> Column:
        gaps = F.slice(m["between"], 1, F.size(m["found"]))
        sizes = F.zip_with(gaps, m["found"], lambda b, v: F.struct(F.length(b).alias("gap"), F.length(v).alias("size")))
        spans = F.zip_with(_let(sizes, _places), m["found"], lambda e, v: F.struct(e["start"].alias("start"), e["end"].alias("end"), v.alias("value")))
        if words:
            listed = lambda chain: F.regexp_extract_all(F.lower(chain), F.lit(WORD), F.lit(0))
            before = lambda b: listed(F.regexp_extract(F.right(b, F.lit(_REACH)), _BEFORE, 1))
            after = lambda b: listed(F.regexp_extract(F.left(b, F.lit(_REACH)), _AFTER, 1))
            sides = F.zip_with(gaps, F.slice(m["between"], 2, F.size(m["found"])), lambda b, a: F.struct(before(b).alias("left"), after(a).alias("right")))
            spans = F.zip_with(spans, sides, lambda s, w: F.struct(*(s[k].alias(k) for k in ("start", "end", "value")), w["left"].alias("left"), w["right"].alias("right")))
        return F.when(F.size(m["found"]) > 0, spans).otherwise(none)

    return _let(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), build)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn test."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _small_parts(value: Column) -> Column:
    """Whether all parts of a dotted number are at most 255, however many zeros lead."""
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).try_cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """All base spans as an array of (kind, start, end, value), by kind in the order of ``KINDS`` and then by start."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def found(pattern: str, worth: Column, holds) -> Column:
        return F.filter(F.when(worth, spans_of(text, pattern)).otherwise(empty), lambda s: holds(s["value"]))

    n = lambda v: F.length(_digits(v))
    per_kind = {
        "email": found(EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        "ip": found(IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _small_parts),
        "card": found(CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda v: (n(v) <= 19) & luhn(v)),
        "phone": found(PHONE, F.contains(text, F.lit("+")), lambda v: n(v).between(9, 15)),
    }
    def named(kind: str) -> Column:
        return F.transform(per_kind[kind], lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*(named(k) for k in KINDS))


def is_address(value: Column) -> Column:
    """Whether a mention has the form of an e-mail address, in signs or in words; all other kinds are numbers."""
    return F.contains(value, F.lit("@")) | value.rlike(SPELLED_AT)


def is_ordinary(value: Column) -> Column:
    """Whether a mention is known to be no identifier: a handle or price with an @, a date, a number of more than 19 digits, or
    one of fewer than six without a leading plus, two dots or two colons."""
    n = F.length(_digits(value))
    short = (n < 6) & ~value.rlike(r"^\(?\+[0-9]|[0-9]\.[0-9]+\.[0-9]|:[0-9A-Fa-f]*:") & ~value.rlike(SPELLED_DIGITS)
    number = (n > 19) | value.rlike(_DATE) | short
    number = number & ~value.rlike(SPELLED_AT) & ~value.rlike(SECRET)
    return F.when(F.contains(value, F.lit("@")), ~value.rlike(r"[\p{L}\p{N}]@[\p{L}\p{N}\[]")).otherwise(number)


def has_form(value: Column, kind: Column) -> Column:
    """Whether a mention can be of a kind: e-mails are addresses and others are not, and a credential is no number."""
    return (is_address(value) == (kind == "email")) & ((kind == "secret") | ~value.rlike(SECRET))


def patterns_of(left: Column, right: Column) -> Column:
    """The lexical patterns of a mention: one to three words before it, one to three after it, and the nearest on both sides."""
    none, bar, space = F.expr("cast(array() as array<string>)"), F.lit("|"), " "
    sizes = lambda words: F.sequence(F.lit(1), F.size(words))
    lefts = F.transform(sizes(left), lambda k: F.concat(F.array_join(F.slice(left, F.size(left) - k + 1, k), space), bar))
    rights = F.transform(sizes(right), lambda k: F.concat(bar, F.array_join(F.slice(right, F.lit(1), k), space)))
    both = F.array(F.concat(F.get(left, F.size(left) - 1), bar, F.get(right, F.lit(0))))
    has_left, has_right = F.size(left) > 0, F.size(right) > 0
    return F.concat(F.when(has_left, lefts).otherwise(none), F.when(has_right, rights).otherwise(none), F.when(has_left & has_right, both).otherwise(none))


def _bootstrap(mentions: DataFrame, rounds: int, min_support: int, min_confidence: float, unseen_weight: float) -> DataFrame:
    """Patterns with their kind and confidence from the graph of patterns and instances.

    ``mentions`` has pattern, value (of the base span that touches the mention, else its own), kind (of that span, or that of
    credentials, else null) and ordinary. An instance is a value, an edge says that it occurs in a pattern. Base values of a
    kind score 1, ordinary values are known negatives, and others are unseen. In each round a pattern's confidence for a kind is
    the score of its instances of that kind over the number of its instances that have a score or are negatives, counted once
    each, and ``unseen_weight`` times that of the rest, if at least ``min_support`` have a score of the kind; an unseen instance of
    a form that the kind can have then gets the confidence of its best pattern above the threshold, and with it a score.

    Patterns of fewer than ``min_support`` distinct values can never hold, so they leave before the rounds.
    """
    edges = materialize(mentions.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.min("ordinary").alias("ordinary")), "pii-edges")
    negative = F.count_if(F.col("kind").isNull() & F.col("ordinary"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n_values"), negative.alias("negatives")).where(F.col("n_values") >= min_support)
    sizes = materialize(sizes, "pii-sizes")
    edges = materialize(edges.join(hint_small(sizes.select("pattern"), 24, "pattern"), "pattern"), "pii-graph")
    seeds = materialize(edges.where("kind IS NOT NULL").groupBy("value", "kind").agg(F.lit(1.0).alias("score")), "pii-seeds")
    unseen = edges.where("kind IS NULL AND NOT ordinary").select("pattern", "value").join(seeds.select("value").distinct(), "value", "left_anti")
    scores, patterns = seeds, None
    for k in range(rounds):
        support = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("score").alias("mass"))
        per_kind = support.groupBy("pattern").agg(F.sum("support").alias("scored"), F.collect_list(F.struct("kind", "support", "mass")).alias("kinds"))
        known = F.col("scored") + F.col("negatives")
        rest = F.greatest(F.col("n_values") - known, F.lit(0))
        weighed = per_kind.join(sizes, "pattern").select("pattern", (known + F.lit(unseen_weight) * rest).alias("n"), F.explode("kinds").alias("s"))
        good = weighed.select("pattern", "s.kind", "s.support", (F.col("s.mass") / F.col("n")).alias("confidence")).where(F.col("support") >= min_support)
        best = F.max(F.struct("confidence", "kind"))
        good = good.where(F.col("confidence") >= min_confidence).groupBy("pattern").agg(best.alias("b"))
        patterns = materialize(good.select("pattern", F.col("b.kind").alias("kind"), F.col("b.confidence").alias("confidence")), f"pii-patterns-{k}")
        if k + 1 < rounds:
            found = unseen.join(hint_small(patterns, 64, "pattern"), "pattern").where(has_form(F.col("value"), F.col("kind")))
            grown = found.groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("value", "b.kind", F.col("b.confidence").alias("score"))
            scores = materialize(seeds.unionByName(grown), f"pii-scores-{k}")
    return patterns


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
    unseen_weight: float = UNSEEN_WEIGHT,
) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, value), for every row: base spans by kind, then those that context adds.

    Base spans are the four fixed patterns with their checks. They and quoted credentials (``SECRET``) are the seeds. Mentions are runs of adjacent numbers, other tokens with a digit
    or an @, and forms in (English) words. Its patterns are the one to three words before it, those after it, and the nearest
    on both sides joined, whatever the mention looks like. Base values seed a graph of patterns and values over the whole corpus, which is scored in ``rounds``
    rounds; mentions in patterns of ``min_confidence`` and more that no base span touches are added with kind ``ctx_<kind>``,
    unless they are ordinary numbers or have no form of that kind (an e-mail has an @ or says 'at', other kinds have neither).
    A value of which nothing is known weighs ``unseen_weight`` against its patterns, so many of them outweigh a few seeds.
    Credentials are no base spans: they too are added, as ``ctx_secret`` and without quotes, only where such a pattern holds.
    Patterns are learnt from distinct values, so copies of a document carry no weight.

    Null text counts as empty and has no spans. Ids may be null or repeat. Empty input gives no rows. Other columns are
    ignored. Positions are code points, end exclusive.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    no_mentions = F.expr("cast(array() as array<struct<start:int,end:int,value:string,left:array<string>,right:array<string>>>)")
    read = read.withColumn("mentions", F.when(F.col("text").rlike(_HINT), spans_of(F.col("text"), MENTION, words=True)).otherwise(no_mentions))

    def mark(m: Column) -> Column:
        touched = F.get(F.filter("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])), F.lit(0))
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right"),
            F.coalesce(touched["kind"], F.when(m["value"].rlike(SECRET), "secret")).alias("kind"), F.coalesce(touched["value"], m["value"]).alias("instance"), is_ordinary(m["value"]).alias("ordinary"),
        )

    marked = F.filter(F.transform("mentions", mark), lambda m: (F.size(m["left"]) > 0) | (F.size(m["right"]) > 0))
    # Rows are numbered as they are written, for ids may repeat.
    rows = materialize(read.select("doc_id", "base", marked.alias("mentions"), F.monotonically_increasing_id().alias("_row")), "pii-rows")
    mentions = rows.select("_row", F.explode("mentions").alias("m")).withColumn("patterns", patterns_of(F.col("m.left"), F.col("m.right")))
    edges = mentions.select(F.explode("patterns").alias("pattern"), F.col("m.instance").alias("value"), "m.kind", "m.ordinary")
    patterns = _bootstrap(edges, rounds, min_support, min_confidence, unseen_weight)
    free = mentions.where("(m.kind IS NULL OR m.kind = 'secret') AND NOT m.ordinary")
    free = free.select("_row", F.explode("patterns").alias("pattern"), "m.start", "m.end", "m.value")
    fits = free.join(hint_small(patterns, 64, "pattern"), "pattern").where(has_form(F.col("value"), F.col("kind")))
    once = fits.groupBy("_row", "start", "end", "value").agg(F.max(F.struct("confidence", "kind")).alias("b")).withColumn("kind", F.col("b.kind"))
    # A credential's span is what stands inside its quotes.
    bare = F.when(F.col("kind") == "secret", F.regexp_extract("value", r"[\p{L}\p{N}](?:.*[\p{L}\p{N}=])?", 0)).otherwise(F.col("value"))
    once = once.withColumn("start", F.col("start") + F.position(bare, F.col("value")) - 1).withColumn("value", bare)
    once = once.withColumn("end", F.col("start") + F.length("value"))
    added = once.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("ctx_"), "kind").alias("kind"), "start", "end", "value"))).alias("extra")
    )
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")
    return rows.join(hint_small(materialize(added, "pii-added"), 200), "_row", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base spans counted and digested, all spans, and how many there are of both sorts.

    Null and empty texts have none: zeros, the digest of the empty string, and no spans.
    """
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans"))
