"""Quality rules judged per host: failure rates shrunk towards the corpus, handed back to documents."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.wordhash import string_buffers
from tablewright.session import materialize

PIECE = 1 << 22  # bytes of text looked at together; a longer text is a piece of its own
SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: Share of failing documents, after shrinking, from which a host is watched, and from which
#: all of it goes.
WATCHED, BLOCKED = 0.25, 0.5


def base_rules() -> dict[str, Column]:
    """The rules that reject a document by itself."""
    words = F.col("n_words")
    return {
        "few_words": words < LEAST_WORDS,
        "repeats": F.col("n_repeat_words") * 100 > words * REPEAT_PERCENT,
    }


def host_rules() -> dict[str, Column]:
    """All rules that count for a host: the base ones, and others that a good document may
    break now and then."""
    words = F.col("n_words")
    return {
        **base_rules(),
        "symbols": F.col("n_symbols") * 10 > words,
        "repeated_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "word_length": (F.col("word_chars") < words * 3) | (F.col("word_chars") > words * 10),
    }


def _rows_of(items: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(items)), np.diff(items.offsets.to_numpy()))


def _codes(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0]


def _repeated(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three that occurs twice or more in their row."""
    covered = np.zeros(len(words), bool)
    start = np.flatnonzero(rows[2:] == rows[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    if len(start):
        base = np.int64(words.max()) + 1
        window = _codes(words[start] * base + words[start + 1]) * base + words[start + 2]
        window = _codes(_codes(window) * (np.int64(rows[-1]) + 1) + rows[start])
        found = start[np.bincount(window)[window] > 1]
        for step in range(3):
            covered[found + step] = True
    return covered


def measure_texts(texts: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` per text, by exact comparison of words and lines."""
    count = len(texts)
    total = partial(np.bincount, minlength=count)
    split = pc.ascii_split_whitespace(texts)
    words, rows = split.values, _rows_of(split)
    filled = pc.greater(pc.binary_length(words), 0)
    words, rows = words.filter(filled), rows[filled.to_numpy(zero_copy_only=False)]
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    lines = pc.split_pattern(texts, "\n")
    line_rows = _rows_of(lines)
    worded = pc.match_substring_regex(lines.values, HAS_WORD)
    line_rows = line_rows[worded.to_numpy(zero_copy_only=False)]
    line_codes = lines.values.filter(worded).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = ~pd.Series(line_codes * (count + 1) + line_rows).duplicated().to_numpy()
    n_lines = total(line_rows)
    return np.stack([
        total(rows), total(rows, weights=lengths).astype(np.int64),
        pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64),
        n_lines, n_lines - total(line_rows[first]), total(rows[_repeated(codes, rows)])], axis=1).astype(np.int64)


def _measure(batches):
    for batch in batches:
        texts = batch.column(1).fill_null("")
        _, offsets = string_buffers(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            end = min(end, len(texts))
            found = measure_texts(texts.slice(at, end - at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at),
                 *[pa.array(column) for column in found.T.copy()]], ["doc_id", "host", *MEASURES])
            at = end


def document_measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """``doc_id, host`` and ``MEASURES`` of every row.

    Words end at white space (0x20, 0x09 to 0x0D), lines at ``\\n``; only lines with a word count. A null text is
    empty and has zeros. Memory follows the longest text, or ``PIECE`` bytes. Other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(host_col).cast("string").alias("host"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_measure, f"doc_id {id_type}, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_rates(measures: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``host, n_docs`` and, per rule, the count of failing documents; null hosts are left out."""
    return measures.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(F.coalesce(rule, F.lit(False)).cast("long")).alias(name) for name, rule in rules.items()])


def beta_prior(n_hosts: float, n_docs: float, squares: float, fails: float, spread: float) -> tuple[float, float]:
    """``(alpha, beta)`` of the failure rates of hosts by moments.

    Input are sums over hosts: 1, n, n^2, k and k^2 / n. The mean is k / n overall; the
    correlation of two documents of one host follows from the weighted variance of
    the rates less what chance gives. It lies between 1 / (n + 1), where the prior
    weighs as much as the whole corpus, and 1/2, a flat prior's spread.
    """
    mean = fails / n_docs if n_docs else 0.0
    noise = mean * (1 - mean)
    scale = noise * (n_docs - squares / n_docs - (n_hosts - 1)) if n_docs else 0.0
    shared = (spread - n_docs * mean * mean - noise * (n_hosts - 1)) / scale if scale > 0 else 0.0
    shared = min(max(shared, 1 / (n_docs + 1)), 0.5)
    weight = 1 / shared - 1
    return mean * weight, (1 - mean) * weight


def host_verdicts(rates: DataFrame, rules: list[str], watched: float = WATCHED, blocked: float = BLOCKED) -> DataFrame:
    """Add ``rate_<rule>``, the posterior mean of each rule's failure rate, and ``verdict``: ``blocked``, ``watched``
    or ``ok``, by the largest of them.

    One row of sums reaches the driver: five numbers a rule. A host of few documents stays near the
    corpus; a host of many speaks for itself. ``rates`` is read twice: write it first.
    """
    n = F.col("n_docs").cast("double")
    sums = [F.count(F.lit(1)).alias("_hosts"), F.sum(n).alias("_docs"), F.sum(n * n).alias("_squares")]
    for rule in rules:
        k = F.col(rule).cast("double")
        sums += [F.sum(k).alias(f"{rule}_fails"), F.sum(k * k / n).alias(f"{rule}_spread")]
    found = rates.agg(*sums).first()
    shrunk = {}
    for rule in rules:
        alpha, beta = beta_prior(found["_hosts"], found["_docs"] or 0.0, found["_squares"] or 0.0,
                                 found[f"{rule}_fails"] or 0.0, found[f"{rule}_spread"] or 0.0)
        shrunk[f"rate_{rule}"] = (F.col(rule) + F.lit(alpha)) / (n + F.lit(alpha + beta))
    rows = rates.withColumns(shrunk)
    worst = F.greatest(*[F.col(name) for name in shrunk]) if len(shrunk) > 1 else F.col(next(iter(shrunk)))
    verdict = F.when(worst >= blocked, "blocked").when(worst >= watched, "watched").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    watched: float = WATCHED, blocked: float = BLOCKED,
) -> DataFrame:
    """``doc_id``, ``MEASURES``, ``base_failed, kept, host_verdict`` of every row.

    A document that breaks a base rule goes. Of the others, those of a blocked host go, and those of a
    watched host that break any rule. Documents without a host are judged by the base rules alone
    (``host_verdict`` null). Repeated rows are judged like any other and count again for their host; an
    empty table gives no rows. Hosts are counted by an aggregate with map-side combination; only
    hosts that are not ``ok`` are joined back, without a broadcast hint.
    """
    measures = materialize(document_measures(docs, id_col, text_col, host_col), "measures")
    rules = host_rules()
    rates = materialize(host_rates(measures, rules), "hosts")
    hosts = host_verdicts(rates, list(rules), watched, blocked)
    hosts = materialize(hosts.filter("verdict <> 'ok'").select("host", "verdict"), "verdicts")
    base = _any(base_rules())
    rows = measures.join(hosts, "host", "left")
    bad = (F.col("verdict") == "blocked") | ((F.col("verdict") == "watched") & _any(rules))
    verdict = F.when(F.col("host").isNotNull(), F.coalesce("verdict", F.lit("ok")))
    return rows.select(
        "doc_id", *MEASURES, base.alias("base_failed"), (~base & ~F.coalesce(bad, F.lit(False))).alias("kept"),
        verdict.alias("host_verdict"))


def _any(rules: dict[str, Column]) -> Column:
    found = F.lit(False)
    for rule in rules.values():
        found = found | rule
    return found
