"""Secrets in whole texts: fixed patterns, and character Markov models of random strings."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import inner_names, make_room

# The kinds in their order, and what each must match.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the run in full, 20 characters or more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

LEAST_VARIED = 6  # different characters of a random string of 16 and more
LEAST_MEAN = 1.2  # log-likelihood ratio per pair of characters
SYMBOLS = 128
BACK_OFF = 4.0
MARK = "﷐"  # a noncharacter; in a text that holds it, it is replaced before marking
COVER = "\ufdd1"  # another one: what covers matches of the fixed patterns
CHUNK = 256  # pieces, an even number


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where a function per element reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at every match: pieces 2, 4, 6 ... are the matches, the others lie between them."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Matches of ``pattern`` as an array of (start, order, end, value), in code points.

    The lengths of the pieces give the places. They are summed per chunk of pieces; the chunks'
    totals give each its offset, and each is walked by itself, so the work follows the length of the
    text, however many matches it has. A chunk has an even number of pieces and starts outside a match.
    """
    order = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("start"), F.lit(order).alias("kind"),
                        end.alias("end"), piece.alias("value"))
        found = state["inside"] & keep(piece)
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"),
                        F.when(found, F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    def walk(chunk: Column, offset: Column) -> Column:
        start = F.struct(offset.alias("at"), F.lit(False).alias("inside"), empty.alias("spans"))
        return F.aggregate(F.coalesce(chunk, F.array().cast("array<string>")), start, step, lambda state: state["spans"])

    def total(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda at, piece: at + F.length(piece))

    def offsets(chunks: Column) -> Column:
        return F.aggregate(
            F.transform(chunks, total), F.array(F.lit(0)),
            lambda ends, size: F.array_append(ends, F.element_at(ends, -1) + size))

    def cut(pieces: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(CHUNK))
        return F.transform(firsts, lambda first: F.slice(pieces, first, F.lit(CHUNK)))

    found = _bound(_bound(_pieces(text, pattern), cut), lambda chunks: F.flatten(F.zip_with(chunks, offsets(chunks), walk)))
    return F.coalesce(found, empty)


def _covered(text: Column, pattern: str, keep) -> Column:
    """The text with every character of a kept match replaced by ``COVER``: places stay."""
    pieces = F.transform(
        _pieces(text, pattern),
        lambda piece, i: F.when((i % 2 == 1) & keep(piece), F.repeat(F.lit(COVER), F.length(piece))).otherwise(piece))
    return F.array_join(pieces, "")


def _long_enough(piece: Column) -> Column:
    return F.length(F.regexp_extract(piece, ASSIGN, 2)) >= ASSIGN_LEAST


def _any(piece: Column) -> Column:
    return F.lit(True)


INNER = ("_text", "_assign", "_access", "_hex")


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``_text`` (never null, free of marks) and the span arrays of the fixed patterns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(COVER))
    clean = F.when(marked, F.translate(text, MARK + COVER, "��")).otherwise(text)
    rows = docs.withColumn("_text", clean)
    return rows.withColumns({
        "_assign": _spans(F.col("_text"), ASSIGN, "assign", _long_enough),
        "_access": _spans(F.col("_text"), ACCESS, "access", _any),
        "_hex": _spans(F.col("_text"), HEX, "hex", _any)})


@inner_names(*INNER)
def labelled_samples(docs: DataFrame, id_col: str, text_col: str, sample_docs: int, seed: int) -> DataFrame:
    """``(value, random)`` from about ``sample_docs`` documents, chosen by a hash of the id.

    Values that the fixed patterns find (mostly hex and assigned values) are samples of random strings; the other
    words of eight and more letters, digits and signs of the same texts, as they are, in capitals and joined, are
    ordinary identifiers.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = base_spans(docs.filter(draw), text_col)
    found = F.concat(
        F.transform("_assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
        F.transform("_access", lambda s: s["value"]), F.transform("_hex", lambda s: s["value"]))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{8,}"), F.lit(0))
    # Ordinary identifiers also come in capitals and joined to longer ones.
    ordinary = _bound(words, lambda given: F.concat(
        given, F.transform(given, lambda word: F.upper(word)),
        F.array(F.array_join(given, "_"), F.upper(F.array_join(given, "_")), F.array_join(given, "-"),
                F.upper(F.array_join(given, "-")), F.array_join(given, "/"))))
    return rows.select(F.explode(found).alias("value"), F.lit(True).alias("random")).unionByName(
        rows.select(F.explode(ordinary).alias("value"), F.lit(False).alias("random")))


def train_markov(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of every character pair: random string over ordinary identifier.

    Two first-order chains over ASCII, backed off to the frequency of the second character
    (that one add-one smoothed). Pairs are counted in Spark; the driver receives at most 2 x 128 x 128
    counts. None unless both labels occur.
    """
    chars = samples.select("random", F.transform(F.split("value", ""), lambda c: F.ascii(c)).alias("c"))
    pairs = chars.select("random", F.explode(F.arrays_zip(
        F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))).alias("a"),
        F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))).alias("b"))).alias("p"))
    pairs = pairs.filter(f"p.a between 1 and {SYMBOLS - 1} and p.b between 1 and {SYMBOLS - 1}")
    rows = pairs.groupBy("random", "p.a", "p.b").count().collect()
    if {row["random"] for row in rows} != {True, False}:
        return None
    seen = {row["a"] for row in rows} | {row["b"] for row in rows}
    counts: dict = {True: defaultdict(int), False: defaultdict(int)}
    before: dict = {True: defaultdict(int), False: defaultdict(int)}
    after: dict = {True: defaultdict(int), False: defaultdict(int)}
    for row in rows:
        counts[row["random"]][row["a"], row["b"]] += row["count"]
        before[row["random"]][row["a"]] += row["count"]
        after[row["random"]][row["b"]] += row["count"]
    totals = {label: sum(after[label].values()) for label in after}

    def log(label: bool, a: int, b: int) -> float:
        alone = (after[label][b] + 1) / (totals[label] + len(seen) + 1)
        return math.log((counts[label][a, b] + BACK_OFF * alone) / (before[label][a] + BACK_OFF))

    return [round(log(True, a, b) - log(False, a, b), 4) for a in range(SYMBOLS) for b in range(SYMBOLS)]


def _ratio(token: Column, table: Column) -> Column:
    """Sum of the pair ratios of a token."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    first = F.slice(codes, F.lit(1), F.size(codes) - 1)
    second = F.slice(codes, F.lit(2), F.size(codes) - 1)
    places = F.zip_with(first, second, lambda a, b: a * SYMBOLS + b + 1)
    return F.aggregate(places, F.lit(0.0), lambda total, at: total + F.coalesce(
        F.try_element_at(table, at.cast("int")), F.lit(0.0)))


@inner_names(*INNER, "_known", "_rest", "_token")
def find_secrets(
    docs: DataFrame, model: list[float] | None, text_col: str = "text", least_ratio: float = 10.0,
    least_mean: float = LEAST_MEAN,
) -> DataFrame:
    """Add ``secret_spans``: array of (start, kind, end, value) ordered by start, then kind.

    ``kind`` is the index into ``KINDS``; places count code points, the end exclusive. Kinds
    ``assign, access, hex`` come from the fixed patterns. ``random`` are tokens of 16 and
    more characters, apart from all others, which the model of random strings explains better
    than that of ordinary identifiers: by ``least_ratio`` (natural log) or more in all, and by ``least_mean`` or more
    per pair of characters, so that length alone convicts nothing. Null counts as empty,
    an empty text has no span, and a text is searched whole. Other columns are kept, but for
    an earlier ``secret_spans``.
    """
    docs = make_room(docs, "secret_spans")
    rows = base_spans(docs, text_col)
    known = F.concat("_assign", "_access", "_hex")
    if model is None:
        spans = F.array_sort(known)
    else:
        table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
        # A token is a longest run of its characters, so one that meets a match of the fixed patterns
        # anywhere shows as a run with covered characters.
        rest = _covered(_covered(_covered(F.col("_text"), ASSIGN, _long_enough), ACCESS, _any), HEX, _any)
        rows = rows.withColumn("_known", known).withColumn("_rest", rest)
        rows = rows.withColumn("_token", _spans(
            F.col("_rest"), f"[A-Za-z0-9+/_={COVER}-]{{16,}}", "random", lambda piece: ~F.contains(piece, F.lit(COVER))))

        def random(token: Column) -> Column:
            ratio = _ratio(token["value"], table)
            varied = F.size(F.array_distinct(F.split(token["value"], ""))) >= LEAST_VARIED
            return varied & (ratio >= F.greatest(F.lit(least_ratio), (F.length(token["value"]) - 1) * F.lit(least_mean)))

        spans = F.array_sort(F.concat("_known", F.filter("_token", random)))
    return rows.withColumn("secret_spans", spans).select(*docs.columns, "secret_spans")


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
