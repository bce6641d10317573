"""Small tables with the cases every operator must define."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "shard int, slot string, ids string, spans int, chunk string, fp string, start string, blob string, kept int"
)


def words(draw: random.Random, n: int) -> str:
    stock = "the of and red Éa straße token house: runs, over 12 lazy. dogs'll über naïve 日本 x|y $$$ ab".split()
    return " ".join(draw.choice(stock) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    draw = random.Random(seed)
    base = [words(draw, n) for n in (60, 200, 35, 90, 400)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, None), (11, ""), (12, " \n "), (13, "one"), (14, "two words")]
    rows += [(20, base[1]), (21, base[1]), (20, base[1])]  # copies, and a repeated row
    rows += [(22, base[4].replace("red", "blue", 1)), (23, base[4] + " tail")]
    rows += [(None, base[0]), (None, words(draw, 50))]
    rows += [(30, words(draw, 30_000)), (31, "a" * 5000), (32, "ab " * 3000)]
    rows += [(40, "My password = 'hunter2222' and AKIA" + "ABCDEFGH12345678 and " + "0af9" * 8)]
    rows += [(41, base[2] + "\n" + base[3] + "\n" + base[2]), (42, "Line one.\nLine one.\n\nLine one.")]
    return rows


def documents(spark, rows=None):
    """``documents`` with further columns whose names clash with those operators use."""
    rows = texts() if rows is None else rows
    sources = ["a", "a", "a", "b", None]
    full = [
        (i, t, "en", sources[n % 5], len(t or ""), n, "s", "i", n, "c", "f", "st", "b", n) for n, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
