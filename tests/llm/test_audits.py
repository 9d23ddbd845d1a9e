"""Token alignment, filter audit and quality rules against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import duckdb
import numpy as np
import pytest

from tablewright.llm import queries as registered
from tablewright.llm import token_alignment as ta
from tablewright.llm.filter_audit import audit_filters, document_failures, lehmer_rank, removal_edges, with_labels
from tablewright.llm.quality_rules import beta_prior, document_measures, host_verdicts, judge_documents, measure_texts

FILES = f"{registered.TOKENIZERS}/byte_bpe_50k.json", f"{registered.TOKENIZERS}/piece_bpe_32k.model"
ODD = ["", None, "a", " lead", "two  blanks\n\ttabs ", "日本語のテキスト、漢字。", "emoji \U0001f600\U0001f469‍\U0001f680 end",
       "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "=" * 3000, "x\x00y", "naïve café ǆ ﬁ", "\r\n\r\n", "ab" * 900,
       "̧́ combining é", "１２３ ½ Ⅷ", "﻿bom", "a b c", "  "]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- token alignment

def plain_alignment(texts):
    """Everything by loops over tokens."""
    aligner = ta.Aligner(*[open(f, "rb").read() for f in FILES])
    docs, held = [], defaultdict(set)
    for d, text in enumerate(texts):
        whole = (" " + (text or "")).encode()
        a = aligner.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = aligner.b.encode(text) if text else []
        pa_, pb = [aligner.pieces_a[i] for i in a], [aligner.pieces_b[i] for i in b]
        if b"".join(pa_) != whole or b"".join(pb) != whole:
            docs.append(([], [], []))
            continue
        ends = lambda pieces: np.cumsum([len(p) for p in pieces]).tolist()
        ends_a, ends_b = ends(pa_), ends(pb)
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a) if start < e <= cut], [i for i, e in zip(b, ends_b) if start < e <= cut]))
            start = cut
        docs.append((a, b, groups))
        for x, y in groups:
            for i in x:
                for j in y:
                    held[i, j].add(d)
    highest = Counter()
    for (i, _), found in held.items():
        highest[i] = max(highest[i], len(found))
    out = []
    for a, b, groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(len(held[p]) == highest[p[0]] for p in links),
                    sum(len(held[p]) for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def plain_texts(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    return [t[:1500] for t in texts[:60]] + ODD


def test_alignment_equals_loops_over_tokens(spark, folder):
    texts = plain_texts(spark, folder)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = sorted(rows_of(ta.align_tokens(docs, *FILES)))
    assert [r[1:] for r in found] == plain_alignment(texts)


def test_alignment_over_full_containers_and_wide_groups(spark, folder, monkeypatch):
    """Containers closed early, dense planes and counted groups give the same rows."""
    aligner = ta.Aligner(*[open(f, "rb").read() for f in FILES])
    texts = plain_texts(spark, folder) + ["same words again, same words again"] * 700
    columns, keys, counts = aligner.align([t or "" for t in texts])
    monkeypatch.setattr(ta, "WIDE_GROUP", 2)
    again, keys_again, counts_again = aligner.align([t or "" for t in texts])
    assert (keys == keys_again).all() and (counts == counts_again).all() and counts.sum() == sum(columns["n_links"])
    pairs, n_docs, planes = ta.multiplicity_planes(keys, counts)
    assert any(len(cell) == ta.BITMAP_BYTES for row in planes.to_pylist() for cell in row)
    seen = Counter()
    union = defaultdict(set)
    for row, bit, doc in ta.plane_members(planes):
        for r, i, d in zip(row.tolist(), bit.tolist(), doc.tolist()):
            seen[int(pairs[r]) * ta.CONTAINER_DOCS + d] += 1 << i
            union[r].add(d)
    assert seen == dict(zip(keys.tolist(), counts.tolist()))
    assert [len(union[r]) for r in range(len(pairs))] == n_docs.tolist()


def test_counts_pass_between_containers(spark, folder):
    texts = plain_texts(spark, folder)[:30] * 3
    expected = plain_alignment(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    _, postings, _ = ta.pair_index(docs, *FILES)
    assert postings.select("container").distinct().count() == 7
    assert [r[1:] for r in sorted(rows_of(ta.align_tokens(docs, *FILES)))] == expected


def test_alignment_of_odd_tables(spark, odd_docs):
    found = rows_of(ta.align_tokens(odd_docs, *FILES))
    assert len(found) == 13
    by_id = {r[0]: r[1:] for r in found}
    assert by_id[4] == by_id[5] == by_id[12] == (0, 0, 0, 0, 0, 0, "") and by_id[7][0] > 10_000 and by_id[None][0] > 0
    assert ta.align_tokens(odd_docs.limit(0), *FILES).count() == 0


def test_ranked_merges_equal_the_files_own_tokenizer(spark, folder):
    aligner = ta.Aligner(*[open(f, "rb").read() for f in FILES])
    assert aligner.ranked
    texts = [f"a{c}b 1{c}2 {c}{c}  {c} '{c}!" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)])]
    texts += [t or "" for t in plain_texts(spark, folder)] + [" " * 50_000 + "x", "a" * 30_000]
    ranked = [aligner.ranked.encode_ordinary(t) for t in texts]
    assert ranked == [e.ids for e in aligner.a.encode_batch_fast(texts, add_special_tokens=False)]
    long = "word" + "\n" * 2_000_000 + " end"
    columns, _, counts = aligner.align([long, ""])
    assert columns["n_a"][0] > 1_000 and columns["n_links"].tolist() == [counts.sum(), 0]


# --- filter audit

def test_intervals_cover_every_removal_once():
    orders = list(permutations(range(4)))
    assert [lehmer_rank(o, 4) for o in orders] == list(range(24))
    cells = defaultdict(int)
    for mask, step, rank, change in removal_edges(4):
        for later in range(rank, factorial(4)):
            cells[mask, step, later] += change
    for mask in range(1, 16):
        for rank, order in enumerate(orders):
            gone = next(k for k, f in enumerate(order, 1) if mask >> f & 1)
            assert [cells[mask, k, rank] for k in range(1, 5)] == [int(k == gone) for k in range(1, 5)]


def plain_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [(i, s or "", t or "") for i, t, s in docs]
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    fails = []
    for i, part, text in texts:
        words = word.findall(text)
        f = set()
        f |= {"A"} if len(words) < 50 else set()
        f |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and t == text for j, _, t in texts) else set()
        fails.append((part, f, i in good, i in toxic))
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in x[1] for x in own) - len(gone),
                    sum(x[1] == {letter} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_applying_every_order(spark, odd_docs):
    extra = [(20 + i, t, s) for i, (t, s) in enumerate([
        ("A " * 60, "a"), ("A " * 60, "b"), ("A " * 60, None), ("w# " * 70, "a"), ("", "a"), ("HELLO YOU", "b"),
        (" ".join(f"word{i}" for i in range(80)) + "$", "b"), (" ".join(f"word{i}" for i in range(80)), "")])]
    docs = odd_docs.select("doc_id", "text", "source").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, source string"))
    marks = [(1, 1, 1), (2, 0, 1), (20, 1, 0), (20, 0, None), (21, None, 1), (None, 1, 1), (99, 1, 1), (25, 1, 0), (9, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = rows_of(audit_filters(with_labels(document_failures(docs), labels)))
    expected = plain_audit(rows_of(docs), marks)
    assert len(found) == len(expected) and {r[:3]: list(r[3:]) for r in found} == expected
    assert audit_filters(with_labels(document_failures(docs.limit(0)), labels.limit(0))).count() == 0


# --- quality rules

def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {p + k for p, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(repeated))


def test_measures_equal_plain_ones(spark, odd_docs, docs):
    texts = ["a a a a", "a b c a b c", "x\ny\nx\n x\nx\r\n \n\n", "é ü # * < |   tail", "\x1c \x1d\x85 q", "a b a b a", *filter(None, ODD)]
    import pyarrow as pa

    assert [tuple(r) for r in measure_texts(pa.array(texts)).tolist()] == [plain_measures(t) for t in texts]
    for rows in (odd_docs, docs):
        found = rows_of(document_measures(rows))
        given = rows_of(rows.select("doc_id", "source", "text"))
        assert sorted(map(repr, found)) == sorted(repr((i, s, *plain_measures(t))) for i, s, t in given)


def test_prior_finds_the_rates_it_was_drawn_from():
    random = np.random.default_rng(5)
    n = random.integers(20, 400, 4_000)
    k = random.binomial(n, random.beta(2.0, 6.0, 4_000))
    a, b = beta_prior(len(n), n.sum(), (n * n).sum(), k.sum(), (k * k / n).sum())
    assert a == pytest.approx(2, rel=0.1) and b == pytest.approx(6, rel=0.1)
    k = random.binomial(n, 0.1)
    assert sum(beta_prior(len(n), n.sum(), (n * n).sum(), k.sum(), (k * k / n).sum())) > 1_000  # no spread: all shrink


def test_rates_of_small_hosts_shrink(spark):
    rates = spark.createDataFrame([(f"h{i}", 100, 10 + i % 3) for i in range(40)] + [("one", 1, 1), ("bad", 500, 450)],
                                  "host string, n_docs long, rule long")
    found = {r["host"]: (r["rate_rule"], r["verdict"]) for r in host_verdicts(rates, ["rule"]).collect()}
    assert found["bad"][1] == "blocked" and 0.85 < found["bad"][0] < 0.9
    assert found["one"][0] < 0.6 and found["h0"][1] == "ok"


def test_documents_of_bad_hosts_go(spark, odd_docs):
    good = " ".join(f"ordinary{i}" for i in range(60))
    rows = [(f"fine{h}", good if d % 10 else "short") for h in range(30) for d in range(30)]
    rows += [("junk", "short" if d % 10 else good) for d in range(300)]
    rows += [("edge", good + " #" * 20 if d % 10 < 4 else good) for d in range(300)] + [(None, good), (None, "short")]
    docs = spark.createDataFrame([(i, h, t, "clash") for i, (h, t) in enumerate(rows)],
                                 "doc_id long, source string, text string, kept string")
    found = {r["doc_id"]: r for r in judge_documents(docs).collect()}
    for i, (host, text) in enumerate(rows):
        kept = len(text.split()) >= 50 and host != "junk" and not (host == "edge" and "#" in text)
        assert (found[i]["kept"], found[i]["base_failed"]) == (kept, len(text.split()) < 50), (host, text)
    assert len(rows_of(judge_documents(odd_docs))) == 13 and judge_documents(odd_docs.limit(0)).count() == 0


# --- SQL on rows that the tables do not have

@pytest.mark.parametrize("name, table", [("op12_filter_audit", "odd"), ("op13_quality_rules", "odd")])
def test_sql_agrees_on_odd_rows(spark, odd_docs, tmp_path, name, table):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    connection = duckdb.connect()
    for t in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    answer = connection.execute(registered.SQL[name])
    names = [c[0] for c in answer.description]
    found = [tuple(r[n] for n in names) for r in registered.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, answer.fetchall()))
