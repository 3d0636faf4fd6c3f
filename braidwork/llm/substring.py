"""Substring dedup by level-wise doubling: repeated windows of 25 words alone are extended to windows of 50.

Level one: in every 50-word window the smallest hash among its 25-word windows is its anchor (a choice by content: equal
windows have equal anchors), so about one position in 14 is looked at. Anchors are brought together by hash, and those
in two documents or more survive. Level two: only windows over a surviving anchor are hashed at full length, brought
together by their anchor, and compared with the smallest doc_id that holds the same window. The survivors of that level
are the result; there is none beyond it.

Both exchanges carry packed arrays, one row for each batch of documents and bucket. Before an exchange each batch keeps
one document (the smallest) for each hash and answers for its other documents itself, so what a passage shared by a
third of all documents sends is one entry a batch. Texts are exchanged only for documents that take part at a level.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import RowFilter, bound_batches, buckets, materialize
from .words import U64, Words, chunks, mix, mix_one, pieces, window_hashes

WINDOW = 50
_ROWS = "bucket int, kind int, doc long, mark long, n long, payload binary"
_NAMES = ["bucket", "kind", "doc", "mark", "n", "payload"]


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each whole window of the chunk's documents: where it starts, its anchor's hash, and its document."""
    half = (window + 1) // 2
    span = window - half + 1
    counts = np.diff(words.offsets)
    number = np.maximum(counts - window + 1, 0)
    starts = np.repeat(words.offsets[:-1] - np.r_[0, np.cumsum(number)[:-1]], number) + np.arange(number.sum())
    if not len(starts):
        return starts, np.zeros(0, U64), starts
    grams = window_hashes(words.hashes, half)
    return starts, np.lib.stride_tricks.sliding_window_view(grams, span).min(axis=1)[starts], np.repeat(np.arange(len(counts)), number)


def _plain(words: Words, d: int) -> list[bytes]:
    return words.raw[words.doc_bytes[d] : words.doc_bytes[d + 1]].tobytes().split()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(values)])


def _pass_on(owner, values, keys, marks, n_buckets, kind=1):
    """Rows (kind, doc, mark, values of that document), to a bucket by document."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    for at, n in zip(*_runs(owner), strict=True):
        o = owner[at]
        yield (mix_one(int(keys[o]) & (2**64 - 1)) % n_buckets, kind, int(keys[o]), int(marks[o]), None, values[at : at + n].tobytes())


def _first_of(hashes, owner, keys):
    """Order by (hash, key); for each entry the smallest key with its hash, and whether the hash has two keys or more."""
    order = np.lexsort((keys[owner], hashes))
    h, k = hashes[order], keys[owner[order]]
    at, n = _runs(h)
    return order, np.repeat(k[at], n), np.repeat(k[at] != k[at + n - 1], n)


def _level_one(batches, n_buckets: int, window: int):
    """From (doc, mark, text): base rows (kind 2), known repeats (kind 1) and anchors to compare (kind 0)."""
    for batch in pieces(batches, 2):
        valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        keys = batch.column(0).fill_null(0).to_numpy()
        marks = batch.column(1).to_numpy()
        rows, hashes, owner = [], [], []
        for words in chunks(batch.column(2)):
            for d in range(len(words)):
                i = words.row + d
                key = int(keys[i]) if valid[i] else None
                plain = _plain(words, d)
                rows.append(((int(keys[i]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 20) % n_buckets, 2, key, int(marks[i]), len(plain), hashlib.sha256(b" ".join(plain)).digest()))
            _, anchor, doc = _anchors(words, window)
            first, _ = _runs(anchor + mix(doc.astype(U64)))
            ok = valid[words.row + doc[first]]
            hashes.append(anchor[first[ok]])
            owner.append(words.row + doc[first[ok]])
        hashes, owner = np.concatenate(hashes or [np.zeros(0, U64)]), np.concatenate(owner or [np.zeros(0, np.int64)])
        if len(hashes):
            order, least, shared = _first_of(hashes, owner, keys)
            h, o = hashes[order], owner[order]
            rows += _pass_on(o[shared], h[shared], keys, marks, n_buckets)
            send = np.flatnonzero(keys[o] == least)
            send = send[np.r_[True, h[send][1:] != h[send][:-1]]]
            rows += _entries(h[send], o[send], keys, marks, None, n_buckets)
        yield _batch(rows)


def _entries(hashes, owner, keys, marks, places, n_buckets, route=None):
    """Packed rows of kind 0: documents, marks, counts, hashes and (level two) places, one row for each bucket."""
    bucket = ((mix(hashes) if route is None else mix(route)) % U64(n_buckets)).astype(np.int64)
    order = np.lexsort((hashes if places is None else places, owner, bucket))
    bucket, hashes, owner = bucket[order], hashes[order], owner[order]
    places = None if places is None else places[order]
    for at, n in zip(*_runs(bucket), strict=True):
        o = owner[at : at + n]
        first, count = _runs(o)
        who = o[first]
        parts = [np.array([len(who), n], np.uint32), keys[who].astype(np.int64), marks[who].astype(np.int64), hashes[at : at + n], count.astype(np.uint32)]
        if places is not None:
            parts.append(places[at : at + n].astype(np.uint32))
        yield (int(bucket[at]), 0, None, None, None, b"".join(p.tobytes() for p in parts))


def _unpack(column, with_places: bool):
    keys, marks, hashes, owner, places, base = [], [], [], [], [], 0
    for p in column:
        raw = p.as_buffer()
        m, n = (int(v) for v in np.frombuffer(raw, np.uint32, 2))
        keys.append(np.frombuffer(raw, np.int64, m, 8))
        marks.append(np.frombuffer(raw, np.int64, m, 8 + 8 * m))
        hashes.append(np.frombuffer(raw, U64, n, 8 + 16 * m))
        owner.append(base + np.repeat(np.arange(m), np.frombuffer(raw, np.uint32, m, 8 + 16 * m + 8 * n)))
        if with_places:
            places.append(np.frombuffer(raw, np.uint32, n, 8 + 20 * m + 8 * n))
        base += m
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(keys, np.int64), join(marks, np.int64), join(hashes, U64), join(owner, np.int64), join(places, np.uint32)


def _compare(table: pa.Table, with_places: bool) -> pa.Table:
    """One bucket: passes on kinds 1 and 2; of kind 0, the entries that are repeated (level one) or that a document with
    a smaller key has too (level two, as places), by document."""
    kind = table.column("kind").to_numpy()
    out = [table.filter(pa.array(kind != 0))]
    keys, marks, hashes, owner, places = _unpack(table.filter(pa.array(kind == 0)).column("payload"), with_places)
    if len(hashes):
        order, least, shared = _first_of(hashes, owner, keys)
        hit = order[keys[owner[order]] > least] if with_places else order[shared]
        rows = list(_pass_on(owner[hit], places[hit] if with_places else hashes[hit], keys, marks, 1))
        if rows:
            out.append(pa.Table.from_batches([_batch(rows)]).cast(out[0].schema))
    return pa.concat_tables(out)


def _level_two(batches, n_buckets: int, window: int):
    """From (doc, mark, text, arrays of surviving anchors): known repeats (kind 1) and windows to compare (kind 0)."""
    for batch in pieces(batches, 2):
        keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        survivors = batch.column(3)
        hashes, owner, places, route = [], [], [], []
        for words in chunks(batch.column(2)):
            start, anchor, doc = _anchors(words, window)
            full = window_hashes(words.hashes, window)
            bounds = np.searchsorted(doc, np.arange(len(words) + 1))
            for d in range(len(words)):
                lo, hi = bounds[d], bounds[d + 1]
                if lo == hi:
                    continue
                known = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in survivors[words.row + d].values])
                on = lo + np.flatnonzero(np.isin(anchor[lo:hi], known))
                hashes.append(full[start[on]])
                places.append(start[on] - words.offsets[d])
                owner.append(np.full(len(on), words.row + d))
                route.append(anchor[on])
        if not hashes:
            continue
        hashes, owner, places, route = (np.concatenate(x) for x in (hashes, owner, places, route))
        if not len(hashes):
            continue
        order, least, _ = _first_of(hashes, owner, keys)
        larger = keys[owner[order]] > least
        lost, send = order[larger], order[~larger]
        rows = list(_pass_on(owner[lost], places[lost].astype(np.uint32), keys, marks, n_buckets))
        rows += _entries(hashes[send], owner[send], keys, marks, places[send], n_buckets, route[send])
        yield _batch(rows)


def _cut(batches, window: int, names: list[str]):
    """From (doc, mark, text, arrays of covered window places): what is left of each text."""
    for batch in pieces(batches, 2):
        removed, digest, left = [], [], []
        for words in chunks(batch.column(2)):
            for d in range(len(words)):
                plain = _plain(words, d)
                at = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3)[words.row + d].values])).astype(np.int64)
                step = np.zeros(len(plain) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                kept = b" ".join(w for w, g in zip(plain, gone, strict=True) if not g)
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
        columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)


def _gathered(found: DataFrame) -> DataFrame:
    return found.where("kind = 1").groupBy("doc", "mark").agg(F.collect_list("payload").alias("parts"))


def _with_text(source: DataFrame, parts: DataFrame) -> DataFrame:
    """Join texts to what is known of some documents; the others' texts are held back before the exchange."""
    return RowFilter(parts, "doc").keep(source, "doc").join(parts, ["doc", "mark"]).select("doc", "mark", "text", "parts")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row for each row of `docs`: (key, n_words, n_removed, kept_sha256 and, if keep_text, kept).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if it lies in a window of `window` consecutive words of its
    document whose word sequence also starts in a document with a smaller key. Windows are judged on the input, not on
    what is left; repeats within a document and between rows of one key remove nothing. `kept` joins the remaining words
    by one space; for rows that lose nothing it is null, their text stands as it is.
    Null or empty text: no words, digest of the empty string. Null key: nothing is removed and nothing compared with it.
    Repeated rows: each gets the same result. Empty table: no rows. Other columns are ignored.
    Windows are compared by 64-bit hashes.
    """
    bound_batches(docs.sparkSession)
    mark = F.xxhash64(F.col(text))
    source = docs.select(F.col(key).cast("long").alias("doc"), mark.alias("mark"), F.col(text).alias("text"))
    n = buckets(source)
    one = source.mapInArrow(lambda b: _level_one(b, n, window), _ROWS)
    one = materialize(one.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _compare(t, False), _ROWS), "anchors")
    two = _with_text(source, materialize(_gathered(one), "survivors")).mapInArrow(lambda b: _level_two(b, n, window), _ROWS)
    two = two.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _compare(t, True), _ROWS)
    covered = materialize(_gathered(two), "covered")
    names = ["doc", "mark", "n_removed", "cut_sha256", "kept"][: 5 if keep_text else 4]
    cut = _with_text(source, covered).mapInArrow(lambda b: _cut(b, window, names), "doc long, mark long, n_removed long, cut_sha256 string" + ", kept string" * keep_text)
    cut = cut.dropDuplicates(["doc", "mark"])
    base = one.where("kind = 2").select("doc", "mark", F.col("n").alias("n_words"), F.lower(F.hex("payload")).alias("whole"))
    return base.join(cut, ["doc", "mark"], "left").select(
        F.col("doc").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha256", "whole").alias("kept_sha256"), *(["kept"] if keep_text else [])
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
