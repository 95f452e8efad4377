"""Personal data: fixed patterns, and terms that disclose them.

Patterns find e-mail addresses, IP addresses, card and phone numbers with code-point offsets. What they find are the
protected entities, and those of one e-mail domain, network (the first part of an address), card issuer (six digits) or dialling
prefix (four digits) are one group: single addresses and numbers seldom recur, groups have counts. How strongly a term
reveals a group is estimated from the corpus: with p(c) the share of distinct texts that hold group c, p(t) that of texts
that hold term t, and p(c, t) that of texts that hold both (or, with a context of n characters, that have t within n
characters of an entity of c), the disclosure is PMI(c; t) / IC(c), which is 1 if t occurs with c only, and never more.
All counts are of distinct texts, so copies of a text count once. Terms whose disclosure is at least THRESHOLD are spans
too (kind "term"), in every document that holds an entity of the group: elsewhere there is nothing that they could be
traced to. A pair seen in fewer than MIN_TEXTS texts is no estimate and discloses nothing. `sanitise` generalises entities
to their kind and removes terms.

Column functions only. Regular expressions start at run boundaries and use possessive quantifiers, so a text of one
very long token costs linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut, maybe_in, reducer, split_by
from sunlattice.llm.words import bound, words_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, fixed by contract: those of the docstring of `base_spans`, with equivalent linear-time starts.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any match implies.
_HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MIN_TEXTS, THRESHOLD = 3, 0.75
#: Digits of a number that name its issuer or its dialling prefix.
PREFIXES = {"card": 6, "phone": 4}
#: Characters of the pieces that a text is cut into where spans are replaced.
CHUNK = 2_048

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Running sums, maxima or the like of an array of int, in blocks of the root of its size: a fold that appends to an
    array copies it, so one fold over all values would cost the square of their number."""
    none = F.array().cast("array<int>")
    first = F.lit(zero)

    def folded(items: Column, start: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            now = combine(a["at"], x)
            return F.struct(now.alias("at"), F.concat(a["found"], F.array(now)).alias("found"))

        return F.aggregate(items, F.struct(start.alias("at"), none.alias("found")), step, lambda a: a["found"])

    def joined_up(blocks: Column) -> Column:
        totals = folded(F.transform(blocks, lambda b: F.aggregate(b, first, combine)), first)
        starts = F.concat(F.array(first), F.slice(totals, 1, F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, starts, folded))

    def blocked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        cuts = F.sequence(F.lit(0), F.size(v) - 1, width)
        return F.when(F.size(v) > 0, bound(F.transform(cuts, lambda k: F.slice(v, k + 1, width)), joined_up)).otherwise(none)

    return bound(values, blocked)


def spans_of(text: Column, pattern: Column | str, kind: str) -> Column:
    """Leftmost non-overlapping matches with code-point offsets, end exclusive: running sums of the lengths of matches and
    of the pieces between them."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def located(matches: Column) -> Column:
        pieces = F.slice(F.split(text, regex, -1), 1, F.size(matches))
        steps = F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.length(m))
        ends = running(steps, lambda a, x: a + x)

        def span(m: Column, end: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"))

        return F.zip_with(matches, ends, span)

    matches = F.regexp_extract_all(text, regex, F.lit(0))
    return bound(matches, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(_none()))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, double).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weighed(i)), F.lit(10)) == 0


def _valid(span: Column, kind: str) -> Column:
    value = span["value"]
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    r"""For each kind, the spans that stay.

    email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`; ip `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)` with parts of at
    most 255; card `[0-9]([\x20-]?[0-9])+` with 13 to 19 digits that pass Luhn; phone `\+[0-9][\x20().0-9-]+[0-9]` with 9
    to 15 digits. Matches that fail are dropped and not retried.
    """
    body = F.coalesce(text, F.lit(""))
    out = {}
    for kind in KINDS:
        out[kind] = F.when(body.rlike(_HINTS[kind]), _kept(body, kind)).otherwise(_none())
    return out


def _kept(body: Column, kind: str) -> Column:
    def holds(span: Column) -> Column:
        return _valid(span, kind)

    return F.filter(spans_of(body, PATTERNS[kind], kind), holds)


def entity_group(span: Column) -> Column:
    """The e-mail domain, network, card issuer or dialling prefix that stands for an entity in the counts."""
    value = span["value"]
    group = F.when(span["kind"] == "email", F.lower(F.substring_index(value, "@", -1)))
    group = group.when(span["kind"] == "ip", F.substring_index(value, ".", 1))
    for kind, digits in PREFIXES.items():
        group = group.when(span["kind"] == kind, F.substring(_digits(value), 1, digits))
    return F.concat(span["kind"], F.lit(":"), group)


def _replaced(text: Column, spans: Column, mark) -> Column:
    """The text with mark(span) in place of each span; of overlapping ones the first counts, the longer if they start
    together. Pieces come from chunks of the text and are joined once, so the work is that of the text and its spans."""
    order = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    )
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def of(chunks: Column, order: Column, tops: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / CHUNK).cast("int")
            last = F.floor(end / CHUNK).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
            return F.when(end > start, F.substring(near, start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))

        def put(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(tops, i - 1), F.lit(0))
            return F.concat(piece(at, s["start"]), F.when(s["start"] >= at, mark(s)).otherwise(F.lit("")))

        rest = piece(F.coalesce(F.get(tops, F.size(tops) - 1), F.lit(0)), F.length(text))
        return F.concat(F.array_join(F.transform(order, put), ""), rest)

    def topped(chunks: Column, order: Column) -> Column:
        ends = running(F.transform(order, lambda s: -s["back"]), lambda a, x: F.greatest(a, x))
        return bound(ends, lambda t: of(chunks, order, t))

    return bound(chunks, lambda c: bound(order, lambda o: topped(c, o)))


def _terms(text: Column) -> Column:
    """Distinct lower-case runs of letters."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.array_distinct(F.filter(F.split(letters, " ", -1), lambda w: w != ""))


def _together(base: DataFrame, total: int, min_texts: int, threshold: float, context: int | None) -> DataFrame:
    """(entity, n_entity, doc_key, term): the terms that texts have with each of their groups of entities.

    base: doc_key, text and spans of the rows with entities. Groups of fewer than min_texts texts are left out, and so are
    pairs that can't reach the threshold, as the term is in too many of the texts with entities alone: a term beside all
    groups of a long list of addresses makes no rows.
    """
    once = base.dropDuplicates(["doc_key"])
    # entities themselves are no terms
    around = _terms(_replaced(F.col("text"), F.col("spans"), lambda s: F.lit(" ")))
    held = once.select("doc_key", F.explode("spans").alias("s"))
    pairs = cut(held.select("doc_key", entity_group(F.col("s")).alias("entity")).distinct())
    often = pairs.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_texts)
    wanted = cut(pairs.join(often, "entity"))
    texts = once.join(wanted.select("doc_key").distinct(), "doc_key", "left_semi")
    if context is None:
        terms = cut(texts.select("doc_key", F.explode(around).alias("term")))
        seen = terms.groupBy("term").agg(F.count("*").alias("n_seen")).where(F.col("n_seen") >= min_texts)
        terms = terms.join(seen, "term")
        n = F.lit(float(max(total, 1)))
        most = F.log(F.least("n_entity", "n_seen") * n / (F.col("n_entity") * F.col("n_seen")))
        may_reach = most >= threshold * F.log(n / F.col("n_entity")) - 1e-9
        left = wanted.withColumnRenamed("doc_key", "doc")
        return left.join(terms, (F.col("doc") == F.col("doc_key")) & may_reach).select("entity", "n_entity", "doc_key", "term")
    seen = texts.withColumn("around", around).select("doc_key", "text", "around", F.explode("spans").alias("s"))
    near = F.concat(
        F.substring(F.col("text"), F.greatest(F.col("s.start") - context, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(context))),
        F.lit(" \n "),
        F.substring(F.col("text"), F.col("s.end") + 1, F.lit(context)),
    )
    terms = seen.select("doc_key", entity_group(F.col("s")).alias("entity"), F.explode(F.array_intersect(_terms(near), "around")).alias("term")).distinct()
    return wanted.join(terms, ["doc_key", "entity"])


def disclosing_terms(
    base: DataFrame, docs: DataFrame, min_texts: int = MIN_TEXTS, threshold: float = THRESHOLD, context: int | None = None
) -> DataFrame:
    """(doc_key, entity, term, disclosure): the terms that each text holds and that disclose a group of entities it holds.

    `base` has doc_key, text and spans of the rows with entities, `docs` all rows. context: how many characters from an
    entity a term may stand to count as together with it; the whole text by default.
    """
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_key", F.xxhash64("text"))
    texts = cut(keyed.groupBy("doc_key").agg(F.count("*").alias("n")))
    total = texts.count()
    held = cut(_together(base, total, min_texts, threshold, context))
    together = held.groupBy("entity", "term").agg(F.first("n_entity").alias("n_entity"), F.count("*").alias("n_both"))
    together = cut(together.where(F.col("n_both") >= min_texts))
    # only rows whose text may have copies are made distinct
    copied, single = split_by(keyed, "doc_key", reducer(texts.where("n > 1").select("doc_key")))
    candidates = reducer(together.select("term"))

    def spread(rows: DataFrame) -> DataFrame:
        return split_by(rows.select("doc_key", F.explode(_terms(F.col("text"))).alias("term")), "term", candidates)[0]

    once = spread(copied).distinct().select("term").unionByName(spread(single).select("term"))
    counts = once.groupBy("term").agg(F.count("*").alias("n_term"))
    n = F.lit(float(max(total, 1)))
    information = F.log(n / F.col("n_entity"))
    pmi = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    found = cut(
        together.join(counts, "term")
        .where(information > 0)
        .select("entity", "term", (pmi / information).alias("disclosure"))
        .where(F.col("disclosure") >= threshold)
    )
    return maybe_in(held.select("doc_key", "entity", "term"), "term", found.select("term")).join(found, ["entity", "term"])


def find_spans(docs: DataFrame, **options) -> DataFrame:
    """`docs` with `spans`: array of (kind, start, end, value), by kind as in KINDS and then "term", then by start.

    Null and empty texts have none; repeated rows have equal spans; null ids pass through (spans depend on the text
    alone); an empty table gives an empty one; other columns pass through, and a column named spans is replaced.
    """
    columns = [c for c in docs.columns if c != "spans"]
    found = base_spans(F.col("text"))
    plain = docs.select(*columns, F.concat(*[found[k] for k in KINDS]).alias("spans"))
    base = cut(plain.where(F.size("spans") > 0).withColumn("doc_key", F.xxhash64("text")))
    of_text = (
        disclosing_terms(base, docs, **options)
        .groupBy("doc_key")
        .agg(F.sort_array(F.collect_set("term")).alias("_terms"))
    )
    words = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
    more = F.when(F.col("_terms").isNotNull(), spans_of(F.col("text"), words, "term")).otherwise(_none())
    richer = base.join(of_text, "doc_key", "left").select(*columns, F.concat("spans", more).alias("spans"))
    return plain.where(F.size("spans") == 0).unionByName(richer)


def joined(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """`docs` with entities generalised to their kind, as [EMAIL], and disclosing terms removed; overlaps are merged."""
    spanned = find_spans(docs, **options)

    def mark(s: Column) -> Column:
        return F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    clean = F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    return spanned.withColumn("text", clean)


def op8_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spanned = find_spans(docs)

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return spanned.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("term").alias("n_term"),
    )
