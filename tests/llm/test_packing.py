from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirespark.llm.packing import ByteBPE, best_fit, lower_bound, pack_documents
from tests.llm.helpers import DOCS, awkward, clash

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def same(text, fast=ByteBPE(JSON), whole=Tokenizer.from_file(JSON)):
    ids = whole.encode(text, add_special_tokens=False).ids
    return fast(text) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.sampled_from("ab cdé'.,s!  \n\t 漢1-_\x85 "), max_size=30), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " "]))))
def test_tokens_are_the_tokenizers(parts):
    assert same("".join(parts))


@pytest.mark.parametrize("sign", [" ", "\n", " \n", "\t", "\u3000", "a", "ab", "漢", "x ", "<|endoftext|>"])
def test_tokens_of_a_million_signs(sign):
    assert same(sign * (1_000_000 // len(sign) // (4 if sign == "漢" else 1)))
    assert same("word" + sign * 20_000 + "<|endoftext|>" + sign * 20_000 + "end")


def test_added_token_is_one_id():
    assert ByteBPE(JSON)("<|endoftext|> hi") == struct.pack("<2I", 50256, 23105)


def check(rows, docs, tokenizer, limit=1024):
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    wanted = {}
    for d in docs:
        ids = ids_of(tokenizer, d[1])
        cuts, at = [], 0
        while at < len(ids):
            stop = at + ((len(ids) - at) % limit or limit)
            cuts.append((len(cuts), at, stop - at, zlib.crc32(struct.pack(f"<{stop - at}I", *ids[at:stop]))))
            at = stop
        wanted.setdefault(d[0], []).extend(cuts)
    found = {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in pieces.items()}
    assert found == {k: sorted(v) for k, v in wanted.items()}
    return len(bins)


def test_round_trip_of_awkward_rows(spark, tokenizer):
    docs = awkward()
    rows = pack_documents(clash(spark.createDataFrame(docs, DOCS)), JSON).collect()
    used = check(rows, docs, tokenizer)
    assert used == -(-sum(r["length"] for r in rows) // 1024)


def test_pools_exchange_until_certified(spark, tokenizer):
    docs = [(i, "word " * (i * 37 % 700), None, None, None) for i in range(400)]
    df = spark.createDataFrame(docs, DOCS)
    rows = pack_documents(df, JSON, pool=60).collect()
    used = check(rows, docs, tokenizer)
    lengths = np.array([r["length"] for r in rows])
    bound = lower_bound(np.bincount(lengths, minlength=1025), 1024)
    assert bound <= used <= bound + 2
    assert any(r["certified"] for r in rows)


def test_packing_does_not_depend_on_the_cluster(spark, tokenizer):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 700), None, None, None) for i in range(300)], DOCS).coalesce(1)
    lists = []
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        lists.append(sorted(map(tuple, pack_documents(docs, JSON, pool=50).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert lists[0] == lists[1]


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS), JSON).count() == 0


def test_bounds_never_exceed_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = np.sort(rng.integers(1, 21, rng.integers(1, 9)))[::-1]
        limit = 20

        def fits(bins, rest):
            if not len(rest):
                return True
            return any(fits(bins[:i] + [b - rest[0]] + bins[i + 1 :], rest[1:]) for i, b in enumerate(bins) if b >= rest[0])

        best = next(n for n in range(1, 10) if fits([limit] * n, list(sizes)))
        assert lower_bound(np.bincount(sizes, minlength=limit + 1), limit) <= best <= best_fit(sizes, limit)[2]


def test_bound_certifies_halves():
    """Items just over a half: no two share a bin, which the sum alone does not see."""
    counts = np.bincount([513] * 10, minlength=1025)
    assert lower_bound(counts, 1024) == 10 == best_fit(np.array([513] * 10), 1024)[2]
