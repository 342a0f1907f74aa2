"""Best-fit packing with certified repacking.

Documents are tokenised once; only those longer than a sequence are cut, the remainder going
first, so every later piece fills a sequence alone. The remaining pieces are spread over
pools of bounded size by a row number. Every pool runs best-fit decreasing and computes lower
bounds on its bin count from dual-feasible functions. A pool whose bins equal its bound is
certified. Pools with gaps exchange the pieces of their bins that are not full (and certified
ones those of their emptiest bin), which are dealt to fewer pools and packed again; a pool
keeps its former bins when packing again saves none.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm._common import materialise, release

POOL = 100_000


#: White space runs beyond this are left to the tokenizers library: tiktoken's pattern recurses on them.
LONG_GAP = 10_000


def _byte_values() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Token ids as packed little-endian 32-bit words, as tokenizers gives them for a byte-level
    BPE file without a prefix space: encode(text, add_special_tokens=False).

    Added tokens (``<|endoftext|>``) are taken out of a text first, as that call does. What is
    between them is made with tiktoken from the same file's vocabulary: a boundary between a
    non-space and a single space always ends a token there, so a text is cut at its spaces and
    each piece's ids are looked up or made once. Texts with runs of white space are encoded
    whole, and those with very long runs by tokenizers. At most ``room`` pieces are remembered,
    the first seen.
    """

    def __init__(self, path: str, room: int = 300_000):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        byte, self._path, self._exact = _byte_values(), path, None
        self._added = {t["content"]: self._pack([t["id"]]) for t in found["added_tokens"]}
        self._split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True)) + ")") if self._added else None
        ranks = {bytes(byte[c] for c in token): n for token, n in found["model"]["vocab"].items() if token not in self._added}
        made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ordinary, self._one = made.encode_ordinary, made._core_bpe.encode_single_piece
        self._gap = re.compile(rf"\s{{{LONG_GAP}}}")
        self._room, self._known = room, {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> list[int]:
        if len(text) >= LONG_GAP and self._gap.search(text):
            if self._exact is None:
                from tokenizers import Tokenizer

                self._exact = Tokenizer.from_file(self._path)
            return self._exact.encode(text, add_special_tokens=False).ids
        return self._ordinary(text)

    def _make(self, word: str) -> bytes:
        """Ids of a space and ``word``."""
        core = word.rstrip(".,")
        if core.isalpha():
            known = self._known.get(core)
            if known is None:
                known = self._pack(self._one((" " + core).encode()))
                if len(self._known) < self._room:
                    self._known[core] = known
            if core == word:
                return known
            made = known + self._pack(self._one(word[len(core) :].encode()))
        else:
            made = self._pack(self._whole(" " + word))
        if len(self._known) < self._room and len(word) < 64:
            self._known[word] = made
        return made

    def _plain(self, text: str) -> bytes:
        words = text.split(" ")
        if not all(words) or any(gap in text for gap in ("\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\x85 ", "\xa0 ")) or (
            not text.isascii() and any(w[-1].isspace() for w in words)
        ):
            return self._pack(self._whole(text))
        get, make = self._known.get, self._make
        return b"".join([self._pack(self._whole(words[0]))] + [get(w) or make(w) for w in words[1:]])

    def __call__(self, text: str) -> bytes:
        if self._split is None or not any(t in text for t in self._added):
            return self._plain(text)
        return b"".join(self._added.get(part) or self._plain(part) for part in self._split.split(text) if part)


@cache
def encoder(path: str) -> ByteBPE:
    """One encoder a worker process: later tasks of the same worker find its words made."""
    return ByteBPE(path)


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, uid): what each document is cut into.

    Null text is an empty one and gives one piece that holds the end token alone. uid numbers
    the rows of the scan; it is only fixed once this is materialised.
    """
    ids = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(tokenizer), struct.pack("<I", end)
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                packed = encode(text.as_py() or "") + close
                total = len(packed) // 4
                begin, n = 0, 0
                while begin < total:
                    stop = begin + ((total - begin) % limit or limit)
                    row.append(i)
                    piece.append(n)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(zlib.crc32(packed[4 * begin : 4 * stop]))
                    begin, n = stop, n + 1
            uid = np.arange(at, at + len(row))
            at += len(row)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(uid)],
                ["id", "piece", "start", "length", "ids_crc32", "uid"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        cut, f"id {ids.simpleString()}, piece int, start long, length long, ids_crc32 long, uid long"
    )


def lower_bound(counts: np.ndarray, limit: int) -> int:
    """No packing of counts[i] items of size i uses fewer bins: the best dual-feasible bound."""
    if not counts.any():
        return 0
    size = np.arange(limit + 1)
    best = -(-int((counts * size).sum()) // limit)
    # Larger than limit - e counts whole, below e counts nothing, between stays itself.
    number, weight = np.cumsum(counts), np.cumsum(counts * size)
    e = np.arange(1, limit // 2 + 1)
    big = number[limit] - number[limit - e]
    mid = weight[limit - e] - weight[e - 1]
    best = max(best, int((big + -(-mid // limit)).max()))
    for k in range(1, 33):  # (k + 1) x / limit rounded down to steps of 1 / k, whole ones kept
        up = (k + 1) * size
        f = np.where(up % limit == 0, size * k, (up // limit) * limit)
        best = max(best, -(-int((counts * f).sum()) // (limit * k)))
    return best


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing over lengths sorted downwards: bin and offset of each, bins used."""
    room = [[] for _ in range(limit + 1)]
    mask, used = 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, b = limit, used
            used += 1
        where[i], offset[i] = b, limit - left
        left -= n
        if left:
            room[left].append(b)
            mask |= 1 << left
    return where, offset, used


_COLUMNS = "piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, certified boolean, fill long, emptiest boolean"


def _pack_pool(limit: int, code: int):
    """Packs one pool's rows; sequence ids are pool numbers and bins under the round's code."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        n = rows["length"].to_numpy()
        where, offset, used = best_fit(n, limit)
        old = rows["sequence_id"].nunique() if code else used + 1
        bound = lower_bound(np.bincount(n, minlength=limit + 1), limit)
        if used < old:
            sequence, bins = (code << 48) + (int(key[0]) << 20) + where, used
            rows["sequence_id"], rows["offset"] = sequence, offset
        else:
            where, bins = pd.factorize(rows["sequence_id"])[0], old
        fill = np.bincount(where, n, bins).astype(np.int64)
        rows["certified"], rows["fill"] = bins == bound, fill[where]
        rows["emptiest"] = where == int(fill.argmin())
        return rows[["id", "piece", "start", "length", "ids_crc32", "uid", "sequence_id", "offset", "certified", "fill", "emptiest"]]

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL,
) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each is packed at.

    certified tells whether the pool that packed a piece last met its lower bound, so that no
    packing of that pool's pieces has fewer sequences; a full piece is a sequence of its own.
    Rounds go on until one saves no sequence: how many there are, and how many pools, follows
    from the pieces alone, not from the cluster.

    Null and empty texts are one piece (the end token). Very long texts are one row's work and
    any number of pieces. Repeated rows and null ids are packed like any others; pieces of equal
    length go in the order of the scan. An empty table gives an empty result. Other columns are
    not read, whatever their names. A pool holds about ``pool`` rows of eleven numbers, whatever
    the size of the input.
    """
    cut = materialise(pieces(docs, tokenizer, limit, end, id_col, text_col), "pieces")
    ids = cut.schema["id"].dataType.simpleString()
    placed = lambda c: {"sequence_id": c, "offset": F.lit(0).cast("long"), "certified": F.lit(True)}
    full = cut.where(F.col("length") == limit).withColumns(placed(-F.col("uid") - 1))
    small = cut.where(F.col("length") < limit).withColumns(placed(F.lit(-1).cast("long")))
    keep = ["id", "piece", "start", "length", "ids_crc32", "uid", "sequence_id", "offset", "certified"]
    done, move, code = [full.select(keep)], small.select(keep), 0
    waiting, before = move.count(), None
    while waiting:
        pools = -(-waiting // pool)
        packed = materialise(
            move.drop("certified").withColumn("pool", F.pmod(F.xxhash64("uid", F.lit(code)), F.lit(pools))).groupBy("pool")
            .applyInPandas(_pack_pool(limit, code), f"id {ids}, {_COLUMNS}"),
            f"packed{code}",
        )
        again, head = (F.col("fill") < limit) & (~F.col("certified") | F.col("emptiest")), F.col("offset") == 0
        bins, waiting, left = packed.agg(F.count_if(head), F.count_if(again), F.count_if(again & head)).first()
        # One pool has nobody to exchange with.
        if pools == 1 or not waiting or (before is not None and bins >= before):
            done.append(packed.select(keep))
            break
        done.append(packed.where(~again).select(keep))
        move, before, code = packed.where(again).select(keep), left, code + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
