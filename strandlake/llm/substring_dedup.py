"""Substring dedup: content-defined chunks, deduplicated by digest.

A gear hash rolls over the UTF-8 bytes of a text. A chunk ends before a word
whose hash (of the 16 bytes before it) is smaller than those of the words
beside it, so a boundary depends on the bytes near it alone: a passage is cut
the same way wherever it stands, an insertion moves no boundary but those
beside it, and chunks are whole words. Only stretches of more than MOST bytes
without a boundary are cut further, at gear boundaries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import BYTES, is_marked, marked, small_batches, span_hashes, spread_join, stored, tidy

GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256, dtype=np.uint16)
CUT_BITS = 4  # top bits that are zero at a gear boundary
SIDE = 2  # a word with a boundary before it has a smaller hash than so many words on each side
LEAST, MOST = 16, 64  # bytes from a gear boundary to the next in a stretch without word boundaries, and of any chunk
MIN_WORDS = 24  # a repeated passage has so many words at least, in whole chunks


def gear(data: np.ndarray) -> np.ndarray:
    """16-bit rolling hash at each byte: the sum over the last 16 bytes of GEAR[byte] << distance."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """End (exclusive) of each chunk of one text's bytes: before a word, or in a long stretch without one, a code point.

    Equal hashes beside each other give no boundary but before the first.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    space = _space(data)
    words = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    h = gear(data)
    m, rank = len(words), h[words - 1].astype(np.int32)
    beside = np.full(m + 2 * SIDE, -1, np.int32)  # nothing is smaller than a text's ends
    beside[SIDE : SIDE + m] = rank
    cut = np.ones(m, bool)
    for k in range(1, SIDE + 1):
        cut &= (rank < beside[SIDE - k : SIDE - k + m]) & (rank <= beside[SIDE + k : SIDE + k + m])
    ends = np.append(words[cut], n)
    if (np.diff(ends, prepend=0) <= MOST).all():
        return ends
    out, last = [], 0
    for end in ends.tolist():
        out += _cut_further(data, space, h, last, end)
        out.append(end)
        last = end
    return np.array(out, np.int64)


def _cut_further(data: np.ndarray, space: np.ndarray, h: np.ndarray, last: int, end: int) -> list[int]:
    """Cuts between two boundaries more than MOST bytes apart: before words if there are any, else between code points;
    at the first gear boundary, or where there is none at the smallest hash."""
    out = []
    while end - last > MOST:
        at = np.arange(last + LEAST, last + MOST + 1)
        for open_at in (space[at - 1] & ~space[at], (data[at] & 0xC0) != 0x80):
            if open_at.any():
                at = at[open_at]
                break
        rank = h[at - 1]
        last = int(at[(rank >> np.uint16(16 - CUT_BITS) == 0).argmax() if (rank >> np.uint16(16 - CUT_BITS) == 0).any() else rank.argmin()])
        out.append(last)
    return out


GROUP_BYTES = 1 << 20


@tidy
def _chunks(batches: Iterator[pd.DataFrame], marks: Broadcast | None = None) -> Iterator[pd.DataFrame]:
    """One row per chunk (per marked one, if there are marks): digest (two hashes), document, place (number in the text, then
    the text's crc32), start and length in bytes, words that begin in it."""
    for pdf in batches:
        ids, texts = pdf["_id"].to_numpy(), pdf["_text"].tolist()
        at = 0
        while at < len(texts):
            group, owner, size = [], [], 0
            while at < len(texts) and (not group or size < GROUP_BYTES):
                raw = (texts[at] or "").encode("utf-8", "surrogatepass")
                if raw:
                    group.append(raw)
                    owner.append(at)
                    size += len(raw)
                at += 1
            if not group:
                continue
            data = np.frombuffer(b"".join(group), np.uint8)
            base = np.concatenate(([0], np.cumsum([len(g) for g in group])))
            ends = [chunk_ends(data[a:b]) + a for a, b in zip(base[:-1], base[1:])]
            counts = np.array([len(e) for e in ends])
            end = np.concatenate(ends)
            start = np.concatenate([np.concatenate(([a], e[:-1])) for a, e in zip(base[:-1], ends)])
            space = _space(data)
            begins = ~space
            begins[1:] &= space[:-1]
            begins[base[:-1]] = ~space[base[:-1]]
            words = np.add.reduceat(begins, start, dtype=np.int64)
            doc = np.repeat(np.arange(len(group)), counts)
            number = np.arange(len(end)) - np.repeat(np.cumsum(counts) - counts, counts)
            crc = np.array([zlib.crc32(g) for g in group], np.int64)
            d1 = span_hashes(data, start, end)
            keep = np.ones(len(d1), bool) if marks is None else is_marked(marks.value, d1)
            yield pd.DataFrame(
                {
                    "_d1": d1[keep].view(np.int64),
                    "_d2": span_hashes(data, start[keep], end[keep], BYTES).view(np.int64),
                    "_id": ids[np.array(owner)[doc[keep]]],
                    "_at": (number[keep].astype(np.int64) << 32) | crc[doc[keep]],
                    "_start": (start - base[doc])[keep].astype(np.int32),
                    "_len": (end - start)[keep].astype(np.int32),
                    "_words": words[keep].astype(np.int32),
                }
            )


_CHUNK = "_d1 long, _d2 long, _id long, _at long, _start int, _len int, _words int"
_TEXT = ["_id", "_crc"]  # what tells one text from another


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Passages that occur elsewhere too: ``id_col, start, length, n_words, n_chunks, first_doc_id, removed``.

    A chunk is repeated when its digest occurs more than once, in one text or
    in several; a passage is a run of consecutive repeated chunks with
    ``min_words`` words at least. ``start`` and ``length`` count UTF-8 bytes of
    the whole text; both ends lie before a word or at the text's ends, but in
    stretches of over MOST bytes without a word's beginning. The first
    occurrence of a chunk is that of the smallest (id, chunk number, crc32 of
    the text); ``first_doc_id`` is the smallest id that holds one of the
    passage's chunks, and a passage is ``removed`` as a whole unless some
    chunk of it is a first occurrence; :func:`passage_spans` tells such chunks
    from the others, and is what to cut by.

    Null, empty and short texts have no passage. Rows with a null id have no
    handle and take no part. Rows repeated under one id with one text count
    once; texts that share an id but differ are looked at each, as texts of
    that id. Digests have 128 bits. Other columns are not read.
    """
    passages = _runs(docs, id_col, text_col).groupBy(*_TEXT, "_run").agg(*_span(), F.min(~F.col("_is_first")).alias("removed"))
    return passages.where(F.col("n_words") >= min_words).select(
        F.col("_id").alias(id_col), "start", "length", "n_words", "n_chunks", "first_doc_id", "removed"
    )


def _span() -> list[Column]:
    """Place, size and first document of a group of consecutive chunks."""
    return [
        F.min("_start").alias("start"),
        F.sum("_len").cast("int").alias("length"),
        F.sum("_words").cast("int").alias("n_words"),
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        F.min("_first").alias("first_doc_id"),
    ]


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per repeated chunk, with its run of consecutive repeated chunks and whether it is a first occurrence.

    A digest is repeated if its occurrences differ in document or place, so
    chunks are combined map-side. Chunks are cut twice, which costs less than
    to write them; the second time only those whose bit is marked, the
    repeated ones and few others, leave the worker. Marks have a fixed size;
    the join that follows is exact.
    """
    small_batches(docs.sparkSession)
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    seen = (
        source.mapInPandas(_chunks, _CHUNK)
        .groupBy("_d1", "_d2")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.min("_at").alias("_a"), F.max("_at").alias("_b"))
        .where("_first < _last or _a < _b")
        .select("_d1", "_d2", "_n", "_first")
    )
    seen = stored(seen, "substring-repeated")
    marks = docs.sparkSession.sparkContext.broadcast(marked(seen, "_d1"))
    repeated = source.mapInPandas(lambda batches: _chunks(batches, marks), _CHUNK)
    again = spread_join(repeated, seen, ["_d1", "_d2"], "_n", ["_id"])
    in_text = Window.partitionBy("_d1", "_d2", "_part", "_id").orderBy("_at")
    again = again.select(
        "_id",
        "_at",
        F.col("_at").bitwiseAND(F.lit((1 << 32) - 1)).alias("_crc"),
        F.shiftright("_at", 32).cast("int").alias("_number"),
        "_start", "_len", "_words", "_first",
        ((F.col("_first") == F.col("_id")) & (F.rank().over(in_text) == 1)).alias("_is_first"),
    ).dropDuplicates([*_TEXT, "_at"])
    here = Window.partitionBy(*_TEXT).orderBy("_number")
    return again.withColumn("_run", F.col("_number") - F.row_number().over(here))


def passage_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """The passages of :func:`repeated_passages`, split where first occurrences and later copies meet.

    ``id_col, start, length, n_words, n_chunks, first_doc_id, removed`` of each
    span, with ``passage_start, passage_words`` of the passage it lies in and
    ``text_crc32`` of its text's UTF-8 bytes. A span is ``removed`` when its
    chunks are no first occurrences, so of every chunk of a passage the first
    copy alone stays. ``min_words`` holds for the passage; its spans may be
    shorter.
    """
    here = Window.partitionBy(*_TEXT).orderBy("_number")
    turn = (F.lag("_run").over(here) != F.col("_run")) | (F.lag("_is_first").over(here) != F.col("_is_first"))
    chunks = _runs(docs, id_col, text_col).withColumn("_turn", F.coalesce(turn.cast("int"), F.lit(0)))
    spans = chunks.withColumn("_span", F.sum("_turn").over(here)).groupBy(*_TEXT, "_run", "_span", "_is_first").agg(*_span())
    whole = Window.partitionBy(*_TEXT, "_run")
    spans = spans.withColumn("passage_start", F.min("start").over(whole)).withColumn("passage_words", F.sum("n_words").over(whole).cast("int"))
    return spans.where(F.col("passage_words") >= min_words).select(
        F.col("_id").alias(id_col), "start", "length", "n_words", "n_chunks", "first_doc_id",
        (~F.col("_is_first")).alias("removed"), "passage_start", "passage_words", F.col("_crc").alias("text_crc32"),
    )


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every removed passage cut out of its text; other columns, of any name, unchanged. Native.

    Where ``passages`` has ``text_crc32``, spans meet the rows of their id
    that hold their text, else all rows of their id. Rows without a removed
    passage, with a null id or a null text come back as they are.
    """
    exact = "text_crc32" in passages.columns
    key = [F.col(id_col).alias("key"), *([F.col("text_crc32").alias("crc")] if exact else [])]
    cut = passages.where("removed").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("cuts"))
    body = F.col("row").getField(text_col)
    raw = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    spans = F.concat("cuts", F.array(F.struct(F.octet_length(raw).alias("start"), F.lit(0).alias("length"))))
    first = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("kept"))
    kept = F.aggregate(
        spans,
        first,
        lambda acc, s: F.struct(
            (s["start"] + s["length"]).alias("at"),
            F.concat(acc["kept"], F.substring(raw, acc["at"] + F.lit(1), s["start"] - acc["at"])).alias("kept"),
        ),
        lambda acc: F.decode(acc["kept"], "UTF-8"),
    )
    met = F.col("row").getField(id_col) == F.col("key")
    if exact:
        met &= F.crc32(raw) == F.col("crc")
    joined = docs.select(F.struct("*").alias("row")).join(cut, met, "left")
    text = F.when(F.col("cuts").isNull(), body).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
