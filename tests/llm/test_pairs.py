"""Near duplicates, leaks, lines: against brute force, and odd rows."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from tablewright.llm import queries as registered
from tablewright.llm.components import components
from tablewright.llm.decontaminate import SEED_WORDS, _grams, _seen, align, find_leaks, find_windows, gram_filter, rare_seeds
from tablewright.llm.line_dedup import dedup_lines, without_lines
from tablewright.llm.near_dedup import near_duplicates
from tablewright.llm.wordhash import PIECE, shingle_sets


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = []
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    return union_find(sets, links)


def test_near_duplicates_agree_with_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for percent in (80, 85):
        found = near_duplicates(docs, percent=percent).collect()
        wanted = brute_components(texts, percent)
        assert {r["doc_id"]: r["component_id"] for r in found} == wanted
        assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]])) for r in found)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_star_of_near_copies(spark):
    """Copies that are near their original but not near each other are one component."""
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        copy = list(words)
        copy[10 + i] = copy[100 + i] = copy[195 - 2 * i] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(f"u{i}-{j}" for j in range(50))) for i in range(40)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(dict(rows), 85)


def test_near_duplicates_of_odd_rows(odd_docs):
    found = near_duplicates(odd_docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()}
    assert found.count() == 13
    assert {(1, 15, 1, True), (2, 15, 1, False), (3, 15, 1, False), (4, 0, 4, True), (5, 0, 5, True),
            (6, 0, 6, True), (9, 1, 9, True), (None, 17, None, True), (12, 0, 12, True)} <= rows
    assert [r for r in rows if r[0] == 8][0][2] == 7
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_words_of_a_text_longer_than_a_piece():
    text = "one two " * (PIECE // 6) + "x" * 100 + " end"
    found = list(shingle_sets(pa.array([text, None, "", "One TWO three four five"]), 5))
    assert [len(s) for s in found] == [len(shingles(t)) for t in (text, None, "", "One TWO three four five")]
    again = list(shingle_sets(pa.array(["one two three four five"]), 5))
    assert np.array_equal(again[0], found[3])


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 3), (20, 21), (30, 30)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    wanted = {n: 1 for n in (1, 2, 3, 8, 9, 10)} | {20: 20, 21: 20}
    assert {r["node"]: r["component"] for r in found} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_alignment(a, b):
    best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            rows[i + 1][j + 1] = max(
                0, rows[i][j] + (2 if a[i] == b[j] else -1), rows[i][j + 1] - 1, rows[i + 1][j] - 1)
            best = max(best, rows[i + 1][j + 1])
    return best


def test_alignment_agrees_with_the_plain_recurrence():
    random = np.random.default_rng(5)
    left = [random.integers(1, 6, random.integers(1, 30)).astype(np.uint64) for _ in range(50)]
    right = [random.integers(1, 6, random.integers(1, 40)).astype(np.uint64) for _ in range(50)]
    best, _, ends = align(left, right)
    assert best.tolist() == [plain_alignment(a, b) for a, b in zip(left, right)]
    for a, b, score, end in zip(left, right, best, ends):
        assert plain_alignment(a, b[:end]) == score


def test_leaks_exact_edited_and_clean(spark):
    items = [(1, " ".join(f"item{i}" for i in range(40))), (2, "the one and the other of the one"),
             (3, None), (4, ""), (5, "two words")]
    copied = items[0][1].split()
    edited = [w if i % 7 else f"changed{i}" for i, w in enumerate(copied)]
    shorter = [w for i, w in enumerate(copied) if i % 9]
    filler = [f"filler{i}" for i in range(300)]
    rows = [
        (1, " ".join(filler + copied + filler)), (2, " ".join(filler + edited + filler[::-1])),
        (3, "Prefix. " + ", ".join(shorter).upper() + "!"), (4, " ".join(filler)),
        (5, " ".join(filler + copied[:6] + filler)), (6, None), (7, ""), (None, items[0][1])]
    rows += [(100 + i, " ".join(filler + copied)) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, 1) for i in (1, 2, 3, *range(100, 130))}
    spans = {r["doc_id"]: (r["score"], r["start_word"], r["end_word"]) for r in found}
    assert spans[1] == (1.0, 300, 340) and 0.5 < spans[2][0] < 1
    assert find_leaks(table.limit(0), table.selectExpr("doc_id as item_id", "text")).count() == 0


def test_edited_copy_of_an_item_that_many_documents_hold(spark):
    copied = [f"item{i}" for i in range(40)]
    edited = [f"changed{i}" if i < 20 and i % 3 == 2 else w for i, w in enumerate(copied)]
    rows = [(i, " ".join(copied)) for i in range(30)] + [(30, "before " + " ".join(edited))]
    rows += [(i, f"filler{i} text") for i in range(31, 1000)]
    items = spark.createDataFrame([(1, " ".join(copied))], "item_id long, text string")
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r["doc_id"] for r in found} == set(range(31))


def windows_of(docs, items):
    grams = items.mapInArrow(lambda b: _grams(b, SEED_WORDS), "item_id long, place long, gram long, words long")
    known = gram_filter(grams)
    seen = docs.mapInArrow(lambda b: _seen(b, SEED_WORDS, known), "doc_id long, at long, gram long")
    seen = seen.join(grams.select("gram").distinct(), "gram", "left_semi")
    return find_windows(seen, rare_seeds(grams, seen))


def test_one_intact_gram_is_enough(spark):
    words = [f"w{i}" for i in range(1, 13)]
    edited = [w if i not in (3, 6, 9) else f"other{i}" for i, w in enumerate(words, 1)]
    long = [f"l{i}" for i in range(40)]
    shifted = [w for i, w in enumerate(long) if i != 20]
    rows = [(1, " ".join(["a"] * 30 + edited + ["b"] * 30)), (2, " ".join(["c"] * 15 + shifted)), (3, "c d e f g")]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(long))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(found) == {(1, 1), (2, 2)} and found[1, 1] == 15 / 24 and found[2, 2] == 77 / 80


def test_everyday_grams_give_no_windows(spark):
    rows = [(i, f"x{i} y{i} one of the z{i} and so on u{i} v{i}") for i in range(2000)]
    item = "a b c one of the d e f g h i and so on j k l m n"
    docs = spark.createDataFrame(rows + [(5000, f"q {item} r")], "doc_id long, text string")
    windows = windows_of(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r["doc_id"] for r in windows.collect()] == [5000]


def test_leaks_agree_with_alignment_of_all_pairs(spark):
    """Every pair that keeps one gram and scores 0.5 is found, through all kinds of edits."""
    random = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [list(random.choice(vocabulary, random.integers(6, 60))) for _ in range(40)]
    texts = []
    for _ in range(300):
        item = list(items[random.integers(len(items))])
        rate = random.uniform(0, 0.45)
        kept = []
        for word in item:
            roll = random.uniform()
            if roll < rate / 2:
                kept.append(str(random.choice(vocabulary)))
            elif roll < rate * 0.75:
                kept += [word, str(random.choice(vocabulary))]
            elif roll >= rate:
                kept.append(word)
        texts.append([*random.choice(vocabulary, 40), *kept, *random.choice(vocabulary, 25)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(docs, table).collect()}
    code = {w: i + 1 for i, w in enumerate(vocabulary)}
    as_codes = lambda words: np.array([code[w] for w in words], np.uint64)
    grams = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    expected = {}
    for j, item in enumerate(items):
        best, _, _ = align([as_codes(item)] * len(texts), [as_codes(t) for t in texts])
        own = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
        for i, score in enumerate(best / (2 * len(item))):
            if score >= 0.5 and grams[i] & own:
                expected[i, j] = score
    assert len(expected) > 200
    assert found == expected


def test_leaks_of_odd_rows(odd_docs, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta", 5)], "item_id long, text string, doc_id int")
    assert {r["doc_id"] for r in find_leaks(odd_docs, items).collect()} == {1, 2, 3}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_lines_that_repeat_go_and_near_ones_too(spark):
    base = " ".join(f"word{i}" for i in range(80))
    near = base.replace("word40 ", "word4O ")
    rows = [(1, f"{base}\nshort one\n{base}"), (2, f"own line of this text\n{near}\nshort one"),
            (3, f"{base.upper()}!\nown Line of  this text."), (4, None), (5, ""), (None, "own line of this text")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in dedup_lines(table).collect()}
    assert found[1]["dropped"] == [2] and found[1]["n_lines"] == 3
    assert found[2]["dropped"] == [1]
    assert found[3]["dropped"] == [0, 1] and found[None]["dropped"] == []
    assert found[4]["n_lines"] == 0 and found[5]["dropped"] == []


def test_lines_with_a_changed_word_go_whatever_their_length(spark):
    random = np.random.default_rng(7)
    rows = []
    for size in (10, 12, 20, 50, 100, 600):
        for _ in range(15):
            words = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(size)]
            other = list(words)
            other[random.integers(size)] = "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    rows += [(1000, "one two three four"), (1001, "one two thrice fore")]
    found = {r["doc_id"]: r["dropped"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: [0] if i % 2 and i < 1000 else [] for i, _ in rows}


def test_exact_repeats_of_lines_agree_with_brute_force(docs):
    found = {r["doc_id"]: r["dropped"] for r in dedup_lines(docs).collect()}
    seen, exact = set(), 0
    for row in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        for place, line in enumerate((row["text"] or "").split("\n")):
            words = tuple(WORD.findall(line.lower()))
            if len(words) < 4:
                assert place not in found[row["doc_id"]]
            elif words in seen:
                exact += 1
                assert place in found[row["doc_id"]]
            seen.add(words)
    assert exact and sum(map(len, found.values())) >= exact


def test_query_drops_repeats_of_short_lines_too(spark, folder, docs):
    found = {r["doc_id"]: r["dropped"].split(",") for r in registered.op9_line_dedup(spark, folder).collect()}
    seen, short = set(), 0
    for row in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        for place, line in enumerate((row["text"] or "").split("\n")):
            words = tuple(WORD.findall(line.lower()))
            if words in seen:
                short += len(words) < 4
                assert str(place) in found[row["doc_id"]]
            elif words:
                seen.add(words)
    assert short


def test_lines_of_odd_rows(odd_docs):
    rows = dedup_lines(odd_docs).collect()
    assert len(rows) == 13
    dropped = {r["doc_id"]: r["dropped"] for r in rows}
    assert dropped[1] == [] and dropped[2] == [0] and dropped[3] == [0] and dropped[8] in ([], [0])
    assert dedup_lines(odd_docs.limit(0)).count() == 0


def test_text_without_its_dropped_lines(spark):
    table = spark.createDataFrame([("a\nb\nc", [1]), ("a", [0]), ("a\n\nb", [])], "t string, d array<int>")
    assert [r[0] for r in table.select(without_lines(table.t, table.d)).collect()] == ["a\nc", "", "a\n\nb"]


def test_only_shared_keys_of_lines_are_joined(spark, monkeypatch):
    """Every key of every line went through the join, though most are of one line."""
    from tablewright.llm import line_dedup

    rows = [(i, 0, [1_000 * i + k for k in range(40)] + [7, i // 100]) for i in range(1, 301)] + [(None, 1, [3, 4])]
    sketches = spark.createDataFrame(rows, "id long, place int, keys array<bigint>")
    passed, thin = [], line_dedup.possibly_in
    monkeypatch.setattr(line_dedup, "possibly_in", lambda *given: passed.append(thin(*given)) or passed[-1])
    found = line_dedup._shared_keys(sketches)
    assert sorted((r["id"], r["key"]) for r in found.collect()) == sorted(
        (i, key) for i in range(1, 301) for key in (7, i // 100) if (key < 3 or key == 7))
    assert passed[0].count() < 1_500


def test_repeated_ids_keep_their_own_first_lines(spark):
    """Two rows of one id have different lines at one place: each is a node of its own."""
    line = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, line), (1, "another text of quite different words stands in this row"), (2, line + " x"),
            (3, "another text of quite different words stands in this Row")]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["dropped"]) for r in found) == [(1, []), (1, []), (2, [0]), (3, [0])]


def letters(random, size):
    return "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), size))


def test_lines_that_quote_one_passage_do_not_all_meet(spark, monkeypatch):
    """Lines that have keys enough elsewhere are left to those; a similar pair among them is found."""
    from tablewright.llm import line_dedup

    random = np.random.default_rng(11)
    passage = [letters(random, 7) for _ in range(12)]
    pool, lines = list(letters(random, 36 * 7)), []  # the same letters in every line, so that counts tell nothing
    for _ in range(150):
        own = "".join(random.permutation(pool))
        own = [own[i : i + 7] for i in range(0, len(own), 7)]
        lines.append(" ".join(own[:18] + passage + own[18:]))
    lines.append(lines[77].replace(" ", "  ", 3)[:-4] + "else")
    met, confirm = [], line_dedup._confirmed
    monkeypatch.setattr(line_dedup, "_confirmed", lambda *given: met.append(given[0].count()) or confirm(*given))
    found = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["dropped"] for r in found} == {i: [0] if i == 150 else [] for i in range(151)}
    assert sum(met) < 3_000


def test_keys_of_a_line_are_few_and_similar_lines_share_one(spark):
    """A line had up to 48 keys. Every tenth character changed at a random place is the worst case."""
    from tablewright.llm import line_dedup

    random = np.random.default_rng(12)
    rows, bands = [], ((45, 90), (100, 160), (160, 400), (400, 1_500))
    for k, (least, most) in enumerate(bands):
        for i in range(100):
            size, blanks = random.integers(least, most), i % 4 > 0  # one in four has no blanks
            line, text = [], letters(random, size)
            while text:
                n = random.integers(2, 11)
                line.append(text[:n])
                text = text[n:]
            line = (" " if blanks else "").join(line)
            other = list(line)
            for at in random.choice(len(other), len(other) // 10, replace=False):
                other[at] = letters(random, 1)
            rows += [(2_000 * k + 2 * i, 0, line), (2_000 * k + 2 * i + 1, 0, "".join(other))]
    table = spark.createDataFrame([(*row, row[2].split(" ")) for row in rows], "id long, place int, line string, words array<string>")
    sketches = line_dedup.sketched(table)
    keys = {r["id"]: set(r["keys"]) for r in sketches.select("id", "keys").collect()}
    assert sum(map(len, keys.values())) < 24 * len(keys)
    for k in range(len(bands)):
        assert sum(bool(keys[2_000 * k + 2 * i] & keys[2_000 * k + 2 * i + 1]) for i in range(100)) >= 90


def test_equal_ends_add_no_edits(spark):
    from tablewright.llm import line_dedup

    rows = [("", ""), ("a", ""), ("abcdefgh", "abcdefgh"), ("über den Berg", "über dem Berg"), ("aaaa", "aaaaaa"),
            ("x" * 50 + "one" + "y" * 70, "x" * 50 + "three" + "y" * 70), ("abab", "baba"), ("𝔞bc𝔡e", "𝔞bcde")]
    from pyspark.sql import functions as F
    table = spark.createDataFrame(rows, "x string, y string")
    rest = table.withColumn("rest", line_dedup._uneven("x", "y")[0])
    found = rest.select(F.levenshtein("x", "y").alias("n"), F.levenshtein("rest.x", "rest.y").alias("m")).collect()
    assert [r["m"] for r in found] == [r["n"] for r in found]
    assert sum(len(r["rest"]["x"]) for r in rest.collect()) < 60


def test_all_lines_of_a_crowd_are_still_to_meet(spark):
    """Lines with ten keys elsewhere met only the first line of a key that more than fifty have."""
    from tablewright.llm import line_dedup

    rows = [(7, i, i, 16, (100, 20)) for i in range(60)] + [(8, i, i, 16, (100, 20)) for i in range(4)] + [
        (9, i, 1, 16, (100, 20)) for i in range(70)] + [(10, i, i, 16, (100, 20)) for i in range(2)]
    placed = spark.createDataFrame(rows, "key long, node long, component long, n_keys int, look struct<chars:int,words:int>")
    found = line_dedup._unsettled(placed).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in found} == {7: 60, 8: 4}


def test_grams_of_crowded_lines_rule_out_no_similar_pair(spark):
    from pyspark.sql import functions as F

    from tablewright.llm import line_dedup

    random = np.random.default_rng(13)
    rows = []
    for i in range(60):
        line = list(letters(random, int(random.integers(9, 1_900))))
        other, most = list(line), len(line) // 10
        for at in random.choice(len(line), most, replace=False):
            other[at] = ["", letters(random, 1), letters(random, 1) + other[at]][i % 3]
        rows += [(i, "".join(line), "".join(other)), (100 + i, "".join(line), "".join(random.permutation(line)))]
    rows.append((99, "ab", "abc"))
    pairs = spark.createDataFrame(rows, "n int, x string, y string")
    for name in ("x", "y"):
        bits = line_dedup.gram_bits(pairs.select(F.concat("n", F.lit(name)).alias("h"), F.col(name).alias("line")))
        pairs = pairs.join(bits.withColumnsRenamed({"h": "k"}), F.concat("n", F.lit(name)) == F.col("k"), "left").drop("k")
        look = F.struct(F.length(name).alias("chars"), F.lit(1).alias("words")).alias("look")
        pairs = pairs.withColumn(f"_{name}", F.struct(look, "bits")).drop("bits")
    pairs = pairs.withColumn("ok", F.levenshtein("x", "y") <= F.floor(F.greatest(F.length("x"), F.length("y")) * 0.1 + 1e-6))
    found = pairs.withColumn("fit", line_dedup._grams_fit("_x", "_y", 0.9)).select("n", "ok", "fit", "x").collect()
    assert all(r["fit"] for r in found if r["ok"]) and sum(r["ok"] for r in found) >= 60
    assert not any(r["fit"] for r in found if r["n"] >= 100 and 60 <= len(r["x"]) <= 700)


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    """The shuffle files of all steps stayed until the driver's collector came."""
    from tablewright.llm import line_dedup

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, write = spark.conf.get(name), [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda *given: seen.append((given[1], spark.conf.get(name))) or write(*given))
    rows = [(1, "one line of five words"), (2, "one line of five words")]
    assert [r["dropped"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [[], [0]]
    assert {on for step, on in seen if step != "drops"} == {"true"} and spark.conf.get(name) == before
