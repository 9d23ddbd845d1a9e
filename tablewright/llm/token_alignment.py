"""Align the tokens of two tokenizers by bytes; count linked ids with an inverted index of bitmaps."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.wordhash import string_buffers
from tablewright.session import materialize

PIECE = 1 << 18  # bytes of text encoded together; a longer text is a piece of its own
CONTAINER_DOCS = 8_192  # documents of one bitmap
CONTAINER_POSTINGS = 2_000_000  # a container is closed after the document that reaches this
BITMAP_BYTES = CONTAINER_DOCS // 8
WIDE_GROUP = 4_096  # links of a group beyond which ids are counted before they are paired
SPACE_MARK = "▁"
# Fixed value: the pattern by which byte-level BPE splits a text before its merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANK = re.compile(r"\s{1000}")  # the pattern above backtracks once per character of such a run
_loaded: dict[tuple[str, str], "Aligner"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is visible
    in Latin-1, else the next code point from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_pieces(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    letters = byte_letters()
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        known = all(c in letters for c in entry)
        pieces[i] = bytes(letters[c] for c in entry) if known else entry.encode()
    return pieces


def sentence_pieces(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: the mark is a space, ``<0xHH>`` a byte."""
    def piece(i: int) -> bytes:
        entry = model.id_to_piece(i)
        return bytes([int(entry[3:5], 16)]) if model.is_byte(i) else entry.replace(SPACE_MARK, " ").encode()

    return [piece(i) for i in range(model.get_piece_size())]


def merge_ranks(file: str) -> dict[bytes, int] | None:
    """Rank of every entry of a byte-level BPE file, if ids follow the order of the merges and nothing
    but the usual pattern precedes them; else None."""
    given = json.loads(file)
    model, before = given["model"], given.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
             and not before.get("add_prefix_space") and not given.get("normalizer") and not model.get("ignore_merges"))
    letters, vocabulary = byte_letters(), model.get("vocab", {})
    if not plain or any(c not in letters for entry in vocabulary for c in entry):
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocabulary[entry] for entry in merged]
    if ids != list(range(256, 256 + len(ids))):
        return None
    return {bytes(letters[c] for c in entry): i for entry, i in vocabulary.items()}


class Aligner:
    """Two tokenizers, loaded once per Python worker.

    A's merges are applied by rank where the file allows it, which gives the same ids several times faster; texts
    with a very long run of white space, and other files, take the file's own tokenizer.
    """

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        ranks = merge_ranks(byte_bpe.decode())
        self.ranked = Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_bpe)
        self.pieces_a = byte_level_pieces(self.a.get_vocab(with_added_tokens=True))
        self.pieces_b = sentence_pieces(self.b)
        self.bytes_a = np.array([len(p) for p in self.pieces_a])
        self.bytes_b = np.array([len(p) for p in self.pieces_b])
        a = [str(i).encode() for i in range(len(self.pieces_a))]
        b = [str(i).encode() for i in range(len(self.pieces_b))]
        # A's ids inside a group and at its end, then B's.
        self.written = np.array(
            [s + b"," for s in a] + [s + b"|" for s in a] + [s + b"," for s in b] + [s + b";" for s in b], object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[int]]:
        """Ids of both for every text, and the bytes of space + text; no ids where a tokenizer's
        bytes are not these."""
        spaced = [" " + t for t in texts]
        if self.ranked:
            a = [[] if LONG_BLANK.search(t) else self.ranked.encode_ordinary(t) for t in spaced]
        else:
            a = [[] for _ in spaced]
        rest = [i for i, ids in enumerate(a) if not ids]
        for i, found in zip(rest, self.a.encode_batch_fast([spaced[i] for i in rest], add_special_tokens=False)):
            a[i] = found.ids
        b = self.b.encode(texts, num_threads=1)
        sizes = []
        for i, text in enumerate(spaced):
            whole = text.encode()
            same = (texts[i] and b"".join(map(self.pieces_a.__getitem__, a[i])) == whole
                    and b"".join(map(self.pieces_b.__getitem__, b[i])) == whole)
            if not same:
                a[i], b[i], whole = [], [], b""
            sizes.append(len(whole))
        return a, b, sizes

    def align(self, texts: list[str]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Columns of counts and digests per text; then the links, as ``pair * CONTAINER_DOCS + row of the text``
        in order, with how often each occurs. A pair is ``id of A * size of B + id of B``."""
        lists_a, lists_b, sizes = self.encode(texts)
        n = len(texts)
        n_a, n_b = np.array([len(x) for x in lists_a]), np.array([len(x) for x in lists_b])
        a = np.fromiter(chain.from_iterable(lists_a), np.int64, n_a.sum())
        b = np.fromiter(chain.from_iterable(lists_b), np.int64, n_b.sum())
        doc_ends = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        at_end = np.zeros(int(doc_ends[-1]) + 1 if n else 1, bool)
        at_end[ends_a] = True
        shared = np.flatnonzero(at_end[ends_b])
        cuts = ends_b[shared]  # bytes at which both end a token
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        doc = np.searchsorted(doc_ends, cuts)
        in_a, in_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        links = np.zeros(n, np.int64)
        np.add.at(links, doc, in_a * in_b)
        columns = {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=n), "n_links": links,
            "groups_sha256": self._digests(a, b, of_a, of_b, in_a, in_b, n_a + n_b)}
        return columns, *self._links(a, b, of_a, in_a, in_b, doc)

    def _digests(self, a, b, of_a, of_b, in_a, in_b, tokens) -> list[str]:
        order = np.empty(len(a) + len(b), np.int64)
        last_a = np.diff(of_a, append=-1) != 0
        last_b = np.diff(of_b, append=-1) != 0
        a_through, b_through = np.cumsum(in_a), np.cumsum(in_b)
        size_a, size_b = len(self.pieces_a), len(self.pieces_b)
        order[np.arange(len(a)) + (b_through - in_b)[of_a]] = a + last_a * size_a
        order[np.arange(len(b)) + a_through[of_b]] = b + 2 * size_a + last_b * size_b
        out, at = [], 0
        for count in tokens.tolist():
            parts = self.written[order[at : at + count]].tolist()
            at += count
            out.append(hashlib.sha256(b"".join(parts)[:-1]).hexdigest() if count else "")
        return out

    def _links(self, a, b, of_a, in_a, in_b, doc) -> tuple[np.ndarray, np.ndarray]:
        size_b = len(self.pieces_b)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        wide = in_a * in_b > WIDE_GROUP
        times = np.where(wide, 0, in_b)[of_a]
        left = np.repeat(np.arange(len(a)), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + first_b[of_a[left]]
        keys = (a[left] * size_b + b[right]) * CONTAINER_DOCS + doc[of_a[left]]
        keys, counts = np.unique(keys, return_counts=True)
        if not wide.any():
            return keys, counts
        more, often = [keys], [counts]
        for g in np.flatnonzero(wide):
            ids_a, many_a = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ids_b, many_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            more.append(((ids_a[:, None] * size_b + ids_b) * CONTAINER_DOCS + doc[g]).ravel())
            often.append((many_a[:, None] * many_b).ravel())
        keys, place = np.unique(np.concatenate(more), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.concatenate(often))
        return keys, counts


def multiplicity_planes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Per pair: itself, the number of its documents, and its planes.

    Plane i holds the documents in whose count of links bit i is set, as a list of 16-bit
    numbers, or as a bitmap of ``BITMAP_BYTES`` where that is smaller. The union of a pair's planes
    is the bitmap of its documents. ``keys`` (pair * CONTAINER_DOCS + document) are distinct and in order.
    """
    pairs, first, n_docs = np.unique(keys // CONTAINER_DOCS, return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(pairs)), n_docs)
    doc = keys % CONTAINER_DOCS
    top = np.frexp(np.maximum.reduceat(counts, first))[1] if len(pairs) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(top)]).astype(np.int64)  # first plane of each row
    places, docs = [], []
    for bit in range(int(top.max(initial=0))):
        held = np.flatnonzero(counts >> bit & 1)
        places.append(starts[row[held]] + bit)
        docs.append(doc[held])
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    order = np.argsort(place, kind="stable")
    place, docs = place[order], docs[order]
    held = np.bincount(place, minlength=int(starts[-1]))
    dense = held * 2 >= BITMAP_BYTES
    parts, sizes = _packed(docs, held, dense)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    planes = pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(parts)])
    return pairs, n_docs, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), planes)


def _packed(docs: np.ndarray, held: np.ndarray, dense: np.ndarray) -> tuple[bytes, np.ndarray]:
    lists = docs.astype("<u2")
    if not dense.any():
        return lists.tobytes(), held * 2
    ends = np.cumsum(held)
    out, at = [], 0
    for i in np.flatnonzero(dense):
        start = ends[i] - held[i]
        bits = np.zeros(CONTAINER_DOCS, bool)
        bits[docs[start : ends[i]]] = True
        out += [lists[at:start].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        at = ends[i]
    out.append(lists[at:].tobytes())
    return b"".join(out), np.where(dense, BITMAP_BYTES, held * 2)


def plane_members(planes: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``(row, bit, document)``, one entry per document of every plane."""
    counts = np.diff(planes.offsets.to_numpy())
    row = np.repeat(np.arange(len(planes)), counts)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    cells = planes.flatten()
    sizes = pc.binary_length(cells).to_numpy()
    dense = sizes == BITMAP_BYTES
    lists = b"".join(cells.filter(pa.array(~dense)).to_pylist())
    times = np.where(dense, 0, sizes // 2)
    yield np.repeat(row, times), np.repeat(bit, times), np.frombuffer(lists, "<u2").astype(np.int64)
    for i in np.flatnonzero(dense):
        bits = np.unpackbits(np.frombuffer(cells[int(i)].as_py(), np.uint8), bitorder="little")
        docs = np.flatnonzero(bits)
        yield np.full(len(docs), row[i]), np.full(len(docs), bit[i]), docs


def _index(batches, files, id_type: pa.DataType):
    """Rows of documents and rows of pairs of one partition, container by container."""
    key = tuple(hashlib.sha256(f).hexdigest() for f in files.value)
    if key not in _loaded:
        _loaded[key] = Aligner(*files.value)
    aligner = _loaded[key]
    container = TaskContext.get().partitionId() << 32
    docs: list[pa.Table] = []
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    rows = postings = 0
    for batch in batches:
        texts = batch.column(1).fill_null("")
        _, offsets = string_buffers(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            end = min(end, len(texts), at + CONTAINER_DOCS - rows)
            columns, found, often = aligner.align(texts.slice(at, end - at).to_pylist())
            docs.append(pa.table({
                "ordinal": pa.array(np.arange(rows, rows + end - at, dtype=np.int32)),
                "doc_id": batch.column(0).slice(at, end - at), **columns}))
            keys.append(found + rows)  # the row within the container; pairs stay as they are
            counts.append(often)
            rows, postings, at = rows + end - at, postings + len(found), end
            if rows == CONTAINER_DOCS or postings >= CONTAINER_POSTINGS:
                yield from _container(container, docs, keys, counts, id_type)
                container, docs, keys, counts, rows, postings = container + 1, [], [], [], 0, 0
    if rows:
        yield from _container(container, docs, keys, counts, id_type)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("container", pa.int64()), ("ordinal", pa.int32()), ("doc_id", id_type), ("n_a", pa.int64()),
        ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("pair", pa.int64()), ("n_docs", pa.int64()), ("planes", pa.list_(pa.binary()))])


def _container(container: int, docs, keys, counts, id_type):
    schema = _schema(id_type)
    table = pa.concat_tables(docs)
    table = table.append_column("container", pa.array(np.full(len(table), container)))
    yield from _filled(table, schema)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    pairs, n_docs, planes = multiplicity_planes(keys[order], counts[order])
    table = pa.table({"container": pa.array(np.full(len(pairs), container)), "pair": pairs,
                      "n_docs": n_docs, "planes": planes})
    yield from _filled(table, schema)


def _filled(table: pa.Table, schema: pa.Schema):
    for field in schema:
        if field.name not in table.column_names:
            table = table.append_column(field.name, pa.nulls(len(table), field.type))
    table = table.select(schema.names).cast(schema)
    yield from table.to_batches(max_chunksize=50_000)


def _return_scores(documents: pa.Table, postings: pa.Table) -> pa.Table:
    """Add what the postings of one container say about each of its documents."""
    ordinal = documents["ordinal"].to_numpy()
    total, best = np.zeros(CONTAINER_DOCS, np.int64), np.zeros(CONTAINER_DOCS, np.int64)
    count, is_best = postings["count"].to_numpy(), postings["best"].to_numpy()
    at = 0
    for chunk in postings["planes"].chunks:
        for row, bit, doc in plane_members(chunk):
            np.add.at(total, doc, count[at + row] << bit)
            np.add.at(best, doc, is_best[at + row] << bit)
        at += len(chunk)
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(best[ordinal]))
    kept = kept.append_column("count_sum", pa.array(total[ordinal]))
    return kept.append_column("groups_sha256", documents["groups_sha256"])


def pair_index(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame, int]:
    """Tokenize once; rows of documents, rows of pairs, and the size of B's vocabulary.

    Rows of documents: ``holder`` (their container), ``ordinal, doc_id, n_a, n_b, n_groups, n_links, groups_sha256``. Rows of
    pairs, one per pair and container: ``container, pair, n_docs, planes``. A container holds up to
    ``CONTAINER_DOCS`` consecutive rows of one partition; it is written together, so an executor
    lost later changes nothing. The two files are read on the driver and broadcast (2 MB).
    """
    spark = docs.sparkSession
    files = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as file:
            files.append(file.read())
    size_b = len(sentence_pieces(_processor(files[1])))
    sent = spark.sparkContext.broadcast(tuple(files))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ("container long, ordinal int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string, pair long, n_docs long, planes array<binary>")
    index = materialize(rows.mapInArrow(lambda batches: _index(batches, sent, pa.int64()), schema), "alignment")
    documents = index.filter("pair IS NULL").select(
        F.col("container").alias("holder"), "ordinal", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return documents, index.filter("pair IS NOT NULL").select("container", "pair", "n_docs", "planes"), size_b


def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def pair_counts(postings: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best``: in how many documents a pair is linked, and 1 if no other pair of its A id
    is linked in more.

    Containers hold different documents, so the union of a pair's bitmaps has the sum of their
    sizes. A pair that every document holds is one row per container, and those are
    summed before the shuffle. The table of the highest counts has at most a row per id of A.
    """
    counts = postings.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    counts = materialize(counts.withColumn("_a", F.floor(F.col("pair") / size_b)), "pairs")
    highest = counts.groupBy("_a").agg(F.max("count").alias("_highest"))
    return counts.join(F.broadcast(highest), "_a").select(
        "pair", "count", (F.col("count") == F.col("_highest")).cast("long").alias("best"))


def align_tokens(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Align the tokens of a byte-level BPE (A) and a sentencepiece model (B) on every text.

    A group is a stretch of bytes between two places where both end a token; its A and B occurrences are all
    linked. Returns, per row, ``doc_id`` (long), ``n_a, n_b, n_groups, n_links``, ``n_best`` (links whose pair is its
    A id's most frequent, by documents, ties included), ``count_sum`` (documents of the pair, over links) and
    ``groups_sha256``. A null or empty text, and one whose bytes a tokenizer changes, has zeros and ''. Every
    row is a document, also one with a repeated or null id. Memory follows the longest text and the
    distinct pairs of a container. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    documents, postings, size_b = pair_index(docs, byte_bpe, piece_bpe, id_col, text_col)
    scored = postings.join(pair_counts(postings, size_b), "pair").select("container", "planes", "count", "best")
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")
    return documents.groupBy("holder").cogroup(scored.groupBy("container")).applyInArrow(_return_scores, schema)
