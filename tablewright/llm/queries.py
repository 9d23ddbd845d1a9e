"""Registered queries of the package, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.decontaminate import find_leaks
from tablewright.llm.filter_audit import audit_filters, document_failures, with_labels
from tablewright.llm.html_extract import extract_pages
from tablewright.llm.language import identify_language, train_language_model
from tablewright.llm.licenses import scan_licenses
from tablewright.llm.line_dedup import dedup_lines
from tablewright.llm.mixing import mix_sources
from tablewright.llm.near_dedup import near_duplicates
from tablewright.llm.quality_rules import judge_documents
from tablewright.llm.secrets import find_secrets, labelled_samples, span_digest, train_markov
from tablewright.llm.sharding import shard_documents
from tablewright.llm.token_alignment import align_tokens
from tablewright.llm.winnowing import fingerprint_documents, fingerprint_text


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of all documents that repeat a benchmark item."""
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = train_markov(labelled_samples(docs, "doc_id", "text", sample_docs=20_000, seed=3))
    found = find_secrets(docs, model).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("secret_spans")).alias("spans"))


def held_out() -> Column:
    """Documents that no language model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents, learnt from those that are not held out."""
    docs = _table(spark, folder, "documents")
    rest = F.coalesce(held_out(), F.lit(False))
    model = train_language_model(docs.filter(~rest))
    return identify_language(docs, model).select(
        "doc_id", rest.alias("held_out"), "lang_pred", "score")


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return shard_documents(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of all documents."""
    return mix_sources(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents. The table has no paths; a document counts as the file
    ``source/<hundreds of its id>/<id>``."""
    number = F.col("doc_id").cast("string")
    path = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 100).cast("string"), number)
    return scan_licenses(_table(spark, folder, "documents").withColumn("path", path))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = fingerprint_documents(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprint_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that each document loses, of all documents."""
    found = dedup_lines(_table(spark, folder, "documents"), least_words=1)
    return found.select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
        F.concat_ws(",", F.transform("dropped", lambda p: p.cast("string"))).alias("dropped"))


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates of all documents at a Jaccard of 0.85."""
    return near_duplicates(_table(spark, folder, "documents"), percent=85)


TOKENIZERS = "/opt/tokenizers"


def op11_token_alignment(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Tokens of two public tokenizers aligned on all documents."""
    return align_tokens(
        _table(spark, folder, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from all documents in each of their 120 orders, per source."""
    failures = document_failures(_table(spark, folder, "documents"))
    return audit_filters(with_labels(failures, _table(spark, folder, "labels")))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules on all documents, with the verdicts on their sources."""
    return judge_documents(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_verdict")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_fingerprints": op8_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_rules": op13_quality_rules,
}

SQL = {
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5('11:' || doc_id::VARCHAR) AS key,
                coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM d GROUP BY source),
        f AS (
            SELECT *, 2.0::DOUBLE * source_size AS bound,
                (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(2.0::DOUBLE * source_size) OVER (
                    ORDER BY 2.0::DOUBLE * source_size / weight, encode(source) NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
                sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, encode(source) NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
            FROM s),
        t AS (
            SELECT source, source_size, least(bound, coalesce(max(CASE
                WHEN left_over / open_weight * weight <= bound THEN left_over / open_weight END) OVER () * weight,
                bound)) AS target
            FROM f),
        p AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
                coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE
            budget // source_size * size
            + greatest(0, least(size, budget - budget // source_size * source_size - before)) END)::BIGINT AS taken
        FROM p
    """,
    "op12_filter_audit": r"""
        WITH l AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        m AS (
            SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
                (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT AS c,
                regexp_matches(text, '[#$%&*|]')::INT AS d,
                coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS e
            FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        n AS (
            SELECT part, concat(CASE a WHEN 1 THEN 'A' ELSE '' END, CASE b WHEN 1 THEN 'B' ELSE '' END,
                    CASE c WHEN 1 THEN 'C' ELSE '' END, CASE d WHEN 1 THEN 'D' ELSE '' END,
                    CASE e WHEN 1 THEN 'E' ELSE '' END) AS fails,
                count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
            FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (
            SELECT concat(p.f, q.f, r.f, s.f, t.f) AS filter_order FROM f p, f q, f r, f s, f t
            WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
        g AS (
            SELECT o.filter_order, n.*, coalesce(list_min(list_transform(list_filter(string_split(fails, ''),
                lambda x: x <> ''), lambda x: instr(o.filter_order, x))), 6) AS gone
            FROM o, n),
        c AS (
            SELECT part, filter_order, step, sum(n * (gone > step)::INT)::BIGINT AS kept,
                sum(n * (gone = step)::INT)::BIGINT AS removed,
                sum(n * (gone < step AND contains(fails, filter_order[step]))::INT)::BIGINT AS redundant,
                sum(n * (fails = filter_order[step])::INT)::BIGINT AS unique_fails,
                sum(good * (gone = step)::INT)::BIGINT AS good_lost,
                sum(toxic * (gone = step)::INT)::BIGINT AS toxic_lost
            FROM g, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step) GROUP BY ALL)
        SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM c
    """,
    "op13_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        x AS (SELECT r, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS p FROM d),
        y AS (
            SELECT r, p, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY r ORDER BY p)),
        t AS (
            SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) > 1 AS found FROM y WHERE c IS NOT NULL),
        u AS (
            SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM t WHERE found)
            GROUP BY r),
        m AS (
            SELECT doc_id, host, len(w)::BIGINT AS n_words,
                coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
                coalesce(u.n, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN u USING (r)),
        b AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                [n_words < 50, n_repeat_words * 100 > n_words * 50, n_symbols * 10 > n_words,
                 n_dup_lines * 10 > n_lines * 3, word_chars < n_words * 3 OR word_chars > n_words * 10] AS fails
            FROM m),
        k AS (
            SELECT host, rule, count(*)::DOUBLE AS n, sum(fails[rule]::INT)::DOUBLE AS k
            FROM b, (SELECT unnest([1, 2, 3, 4, 5]) AS rule) WHERE host IS NOT NULL GROUP BY ALL),
        p AS (
            SELECT rule, sum(n) AS docs, sum(k) / sum(n) AS mean,
                sum(k * k / n) - sum(k) * sum(k) / sum(n)
                    - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * (count(*) - 1) AS extra,
                sum(k) / sum(n) * (1 - sum(k) / sum(n)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) AS scale
            FROM k GROUP BY rule),
        a AS (
            SELECT *, 1 / least(0.5, greatest(1 / (docs + 1), CASE WHEN scale > 0 THEN extra / scale ELSE 0 END)) - 1
                AS weight FROM p),
        h AS (
            SELECT host, max((k + mean * weight) / (n + weight)) AS worst FROM k JOIN a USING (rule) GROUP BY host),
        v AS (
            SELECT host, CASE WHEN worst >= 0.5 THEN 'blocked' WHEN worst >= 0.25 THEN 'watched' ELSE 'ok' END
                AS host_verdict FROM h)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(host_verdict, 'ok') <> 'blocked'
                AND NOT (coalesce(host_verdict, 'ok') = 'watched' AND list_bool_or(fails)) AS kept, host_verdict
        FROM b LEFT JOIN v USING (host)
    """,
}
