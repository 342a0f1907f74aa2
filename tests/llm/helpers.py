"""Small tables with the awkward cases that every operator meets."""

from __future__ import annotations

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["id", "score", "size", "rank", "fp", "key", "piece", "h", "group", "u", "__copies", "text_", "label"]


def long_text(seed: int, words: int) -> str:
    syllables = "the of and ing tion er re st on an en th he in at".split()
    x, out = seed * 7919 + 13, []
    for _ in range(words):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        out.append("".join(syllables[(x >> s) % 15] for s in range(4, 4 + 4 * (1 + (x >> 3) % 3), 4)))
    return " ".join(out)


def awkward() -> list[tuple]:
    texts = [None, "", "   ", "one", "Ünï cödé ß 漢字 text", "a\x00b", "<|endoftext|> [INST] </s>", long_text(1, 20000), long_text(2, 60),
             long_text(2, 60), long_text(2, 60) + " tail", "\n\n", "tabs\tand  double  spaces \n x", "!!! ???", "1 2 3 4 5"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, "no id", None, None, 5)]


def clash(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
