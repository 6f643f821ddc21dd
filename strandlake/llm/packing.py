"""Best-fit packing by minimum bin slack.

Bins are planned on the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are: for each bin a bitset
subset-sum over the lengths still available finds the fullest feasible
combination, and it is removed as often as the counts allow. Pieces then take
their places by rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import small_batches, stored, tidy

CAPACITY = 2048
RANK_BLOCK = 250  # pieces of one length that are ranked together, about
SUPER = 1000  # blocks of one length whose counts are added up together
CACHE = 600_000  # words kept with their ids in a worker


def _byte_char(b: int) -> str:
    """How byte-level BPE spells a byte: printable Latin-1 as itself, the others from U+0100 on in order."""
    plain = lambda x: 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
    return chr(b) if plain(b) else chr(256 + sum(not plain(x) for x in range(b)))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Letters whose lower-casing, normal form and byte-level spelling are plain: a-z and, from U+00DF on, the
# lower-case letters of Latin-1. A word of these, symbols after it at most, needs no pre-tokenizer.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")
_SPELL = {c: "".join(_byte_char(b) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


#: The normaliser, pre-tokenizer and word mark for which texts may be encoded word by word.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def wordwise(tokenizer) -> bool:
    """Whether the tokenizer is one whose texts may be encoded word by word: WORDWISE, BPE, special tokens that begin with ``<|``."""
    parts = {"normalizer": tokenizer.normalizer, "pre_tokenizer": tokenizer.pre_tokenizer}
    state = {name: part and json.loads(part.__getstate__()) for name, part in parts.items()}
    special = all(t.content.startswith("<|") and not (t.normalized or t.lstrip or t.rstrip) for t in tokenizer.get_added_tokens_decoder().values())
    return state == WORDWISE and type(tokenizer.model).__name__ == "BPE" and special


class WordIds(dict):
    """Space-free words to their ids' bytes (little-endian unsigned 32 bits), filled as words are met.

    For tokenizers that :func:`wordwise` knows; others encode whole texts.
    Their pre-tokenizer never joins what white space parts and drops
    the white space, so a text's ids are those of its words in order. A word
    of plain letters, or of symbols, goes straight to the BPE model; one of
    letters then symbols is two such words; any other word goes through the
    whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.wordwise = wordwise(self.tokenizer)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        low = word.lower()
        plain = _PLAIN.fullmatch(low)
        if not plain or low.startswith("<|") or "<|" in low:
            ids = struct_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif plain[1] and plain[2]:
            ids = self[plain[1]] + self[plain[2]]
        elif not low:
            ids = b""
        else:
            spelt = low if low.isascii() else low.translate(_SPELL)
            ids = struct_ids([t.id for t in self.model.tokenize(spelt)])
        self[word] = ids
        return ids


def struct_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def encode_text(text: str | None, words: WordIds) -> bytes:
    """The whole text's ids, four bytes each, as the tokenizer's ``encode`` gives them."""
    if not words.wordwise:
        return struct_ids(words.tokenizer.encode(text or "", add_special_tokens=False).ids)
    parts = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return b"".join(map(words.__getitem__, parts))


def fullest(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths (repeats allowed up to their counts) whose sum is the largest that ``capacity`` holds.

    Starts from the longest length available; the rest is found by subset sums
    kept as bits of one integer, each length added as often as it still fits,
    lengths in falling order, stopping once the bin is full.
    """
    have = np.flatnonzero(counts)[::-1]
    first = int(have[0])
    room = capacity - first
    if not room:
        return [first]
    left = counts.copy()
    left[first] -= 1
    full = (1 << (room + 1)) - 1
    bits, layers = 1, []
    for size in have[have <= room].tolist():
        for _ in range(min(int(left[size]), room // size)):
            grown = bits | ((bits << size) & full)
            if grown == bits:
                break
            layers.append((size, bits))
            bits = grown
        if bits >> room:
            break
    total, out = bits.bit_length() - 1, [first]
    for size, before in reversed(layers):
        if not (before >> total) & 1:
            out.append(size)
            total -= size
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths in order of place) and how many bins each fills."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    bins = []
    while counts.any():
        pattern = fullest(counts, capacity)
        sizes, need = np.unique(pattern, return_counts=True)
        times = int((counts[sizes] // need).min())
        counts[sizes] -= need * times
        bins.append((pattern, times))
    return bins


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """``_row, _id, piece, start, length, ids_crc32[, ids]``: each document's ids and ``end_id``, cut at ``capacity``."""

    @tidy
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = WordIds(tokenizer_path), struct_ids([end_id])
        for pdf in batches:
            out = []
            for row, key, text in zip(pdf["_row"], pdf["_id"], pdf["_text"]):
                raw = encode_text(text, words) + end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    ids = (np.frombuffer(part, "<u4").astype(np.int32),) if with_ids else ()
                    out.append((row, key, n, at // 4, len(part) // 4, zlib.crc32(part)) + ids)
            yield pd.DataFrame(out, columns=["_row", "_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    small_batches(docs.sparkSession, 1000)
    kind = "_row long, _id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    source = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")
    )
    return source.mapInPandas(pieces, kind)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]``: one row per piece.

    Every document's ids and ``end_id`` form one piece if they fit into
    ``capacity`` tokens, else consecutive full pieces and a shorter last one.
    Pieces fill sequences from offset 0 without gaps. ``with_ids`` adds the
    piece's tokens, so that the sequences can be written out by sorting on
    (sequence_id, offset).

    A null or empty text is the end id alone. Null ids stay null; rows
    repeated under one id are packed each. Empty table: empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # slots[length]: first rank, first sequence, slots of a bin for it, and their offsets, in order of rank
    slots: dict[int, list[tuple[int, int, list[int]]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan(histogram, capacity):
        places: dict[int, list[int]] = {}
        at = 0
        for size in pattern:
            places.setdefault(size, []).append(at)
            at += size
        for size, offsets in places.items():
            slots.setdefault(size, []).append((taken.get(size, 0), sequence, offsets))
            taken[size] = taken.get(size, 0) + times * len(offsets)
        sequence += times
    firsts = {size: np.array([s[0] for s in rows]) for size, rows in slots.items()}

    blocks = spark.createDataFrame(
        [(int(size), -(-n // RANK_BLOCK)) for size, n in histogram.items()] or [(0, 1)], "length long, _blocks long"
    )
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("_block", F.pmod(F.xxhash64("_row", "piece"), F.col("_blocks")))
    # pieces before a block: those of the groups of blocks before its own, and of the blocks before it in its group
    zero = F.lit(0).cast("long")
    sizes = dealt.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_super", F.floor(F.col("_block") / SUPER))
    so_far = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("length", "_super").agg(F.sum("_n").alias("_sn"))
    groups = groups.select("length", "_super", F.coalesce(F.sum("_sn").over(so_far(["length"], "_super")), zero).alias("_before"))
    own = F.coalesce(F.sum("_n").over(so_far(["length", "_super"], "_block")), zero)
    base = sizes.withColumn("_own", own).join(groups, ["length", "_super"])
    base = stored(base.select(F.col("length").alias("_l"), F.col("_block").alias("_b"), (F.col("_before") + F.col("_own")).alias("_base")), "pack-ranks")
    within = Window.partitionBy("length", "_block").orderBy("_row", "piece")
    ranked = dealt.join(base, (F.col("length") == F.col("_l")) & (F.col("_block") == F.col("_b"))).withColumn(
        "_rank", F.col("_base") + F.row_number().over(within) - 1
    )

    @tidy
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            at = np.empty(len(pdf), np.int64)
            for size in np.unique(length):
                own = length == size
                at[own] = np.searchsorted(firsts[int(size)], rank[own], side="right") - 1
            for i, (size, r, k) in enumerate(zip(length.tolist(), rank.tolist(), at.tolist())):
                first, bin0, offsets = slots[size][k]
                q, s = divmod(r - first, len(offsets))
                sequence[i], offset[i] = bin0 + q, offsets[s]
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    cols = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = "_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    placed = ranked.select(*cols, "_rank").mapInPandas(place, kind)
    id_type = docs.schema[id_col].dataType
    return placed.select(
        F.col("_id").cast(id_type).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] * with_ids)
    )
