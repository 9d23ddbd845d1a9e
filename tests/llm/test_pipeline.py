"""The pipeline's stages, each against a plain version on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as pipeline
from tablewright.llm import queries as registered
from tablewright.llm.decontaminate import align
from test_pairs import brute_components
from test_single import plain_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_stage_drops_what_has_no_letters_and_no_clean_document(spark, folder, docs):
    rows = docs.collect()
    kept = {r["doc_id"] for r in pipeline.keep_known_languages(spark, docs, folder).collect()}
    letters = {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
    assert kept <= letters
    words = {r["doc_id"] for r in rows if len(re.findall(r"[^\W\d_]{2,}", r["text"] or "")) >= 20}
    assert len(words & kept) >= 0.99 * len(words) > 0


def test_near_duplicate_stage_agrees_with_brute_force(spark, folder, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    root = brute_components(texts, 80)
    kept = [r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, folder).collect()]
    assert sorted(kept) == sorted(i for i in texts if root[i] == i) and len(kept) < len(texts)


def test_leak_stage_agrees_with_alignment_of_all_pairs(spark, folder, docs):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    code = defaultdict(lambda: len(code) + 1)
    words = lambda text: [code[w] for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())]
    grams = lambda found: {tuple(found[i : i + 3]) for i in range(len(found) - 2)}
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    held, leaks = {i: grams(t) for i, t in texts.items()}, set()
    for item in items:
        own = words(item["text"])
        near = [i for i in texts if len(own) >= 3 and held[i] & grams(own)]
        best = align([np.array(own, np.uint64)] * len(near), [np.array(texts[i], np.uint64) for i in near])[0] if near else []
        leaks |= {i for i, score in zip(near, best) if score >= 0.5 * 2 * len(own)}
    kept = {r["doc_id"] for r in pipeline.drop_leaks(spark, docs, folder).collect()}
    assert leaks and kept == set(texts) - leaks


def test_mixing_stage_meets_plain_targets(spark, folder, docs):
    given = {r["doc_id"]: r for r in docs.collect()}
    sizes = Counter()
    for row in given.values():
        sizes[row["source"]] += len(WORD.findall(row["text"] or ""))
    out, taken, cut = pipeline.mix(spark, docs, folder).collect(), Counter(), Counter()
    for row in out:
        taken[row["source"]] += len(WORD.findall(row["text"]))
        if row["text"] != given[row["doc_id"]]["text"]:
            cut[row["source"]] += 1
            assert given[row["doc_id"]]["text"].startswith(row["text"])
    assert dict(taken) == {source: round(target) for source, target in plain_targets(sizes).items()}
    assert max(cut.values(), default=0) <= 1 and max(Counter(r["doc_id"] for r in out).values()) <= 3


def test_sharding_stage_is_even_and_keeps_equal_texts_together(spark, folder, docs):
    rows = pipeline.shard(spark, docs, folder).collect()
    size, places, of_text = Counter(), defaultdict(list), defaultdict(set)
    for row in rows:
        size[row["shard"]] += len((row["text"] or "").encode()) + 1
        places[row["shard"]].append(row["slot"])
        of_text[row["text"]].add(row["shard"])
    assert all(len(shards) == 1 for shards in of_text.values()) and len(rows) == docs.count()
    assert all(sorted(slots) == list(range(len(slots))) for slots in places.values())
    groups = Counter()
    for row in rows:
        groups[row["text"]] += len((row["text"] or "").encode()) + 1
    assert max(size.values()) <= sum(size.values()) / 16 + max(groups.values())


def test_each_stage_keeps_the_columns_and_takes_effect(spark, folder, docs):
    rows = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == docs.columns, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
        assert rows.count() > 0
    last = pipeline.STAGES[-1][1](spark, rows, folder)
    assert last.count() == rows.count() and {"shard", "slot"} <= set(last.columns)


def test_stages_on_odd_rows(spark, odd_docs, folder):
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, folder)
        assert out.columns == odd_docs.columns, name
        assert stage(spark, odd_docs.limit(0), folder).count() == 0, name
    assert pipeline.shard(spark, odd_docs, folder).count() == 13


def test_run_gives_all_stages(spark, folder):
    found = pipeline.run(spark, folder)
    assert found.count() > 0 and found.filter("shard is null").count() == 0


def test_every_operator_has_a_query():
    names = {name.split("_")[0] for name in registered.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)} and set(registered.SQL) <= set(registered.QUERIES)
