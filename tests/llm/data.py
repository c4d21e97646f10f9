"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, uid long, fp long"
LETTERS = {"aa": "abcdef ghij", "bb": "klmnopq rst", "cc": "uvwxyz áéí"}


def words(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(LETTERS[lang].replace(" ", "")) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out: list[tuple] = []
    for k in range(n):
        lang = rng.choice(list(LETTERS))
        text = words(rng, lang, rng.choice((1, 2, 3, 9, 40, 150))) + rng.choice((".", "!\n", "", " \t"))
        out.append((k, text, lang, rng.choice(("s0", "s0", "s1", "ß2")), len(text)))
    base = words(rng, "aa", 120)
    extra = [
        (10000, None, "aa", "s0", None), (10001, "", "bb", None, 0), (10002, " \t\n", None, None, 3), (10003, base, "aa", "s1", 0), (10004, base, "aa", "s1", 0), (10004, base, "aa", "s1", 0),
        (10005, base.replace(" ", "  \n", 5), "aa", "s0", 0), (10006, base + " zz", "aa", "s0", 0), (None, base, "aa", None, 0), (None, None, None, None, None), (10007, "12345 !!", "bb", "s1", 8),
        (10008, words(rng, "bb", 6000), "bb", "s0", 0), (10009, "Ünï cödé ☃ " * 4, "cc", "s1", 0), (10010, "x" * 9000, "cc", "late", 0), (10011, "<|endoftext|> a  b   c d", "aa", "s1", 0),
    ]
    return [(*r, 5, 0.5, 9, 3) for r in out + extra]


def documents(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
