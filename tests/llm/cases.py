"""Small tables of hard cases, shared by the tests."""

from __future__ import annotations

import random

LETTERS = "aeinorst"


def text_of(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(seed=1, n=60):
    """(doc_id, text): fresh texts, exact and near copies, shared passages, a hot group, null, empty and long ones."""
    rng = random.Random(seed)
    passage, line = text_of(rng, 70), text_of(rng, 90)
    rows = [(i, text_of(rng, rng.randint(1, 200))) for i in range(n)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 20, 2)]
    rows += [(200 + i, f"{rows[i][1]} {text_of(rng, 2)}") for i in range(1, 30, 3)]
    rows += [(300 + i, f"{text_of(rng, 30)} {passage} {text_of(rng, 20)}") for i in range(8)]
    hot = text_of(rng, 120)
    rows += [(400 + i, f"{hot} {i}") for i in range(40)]
    rows += [(500 + i, hot) for i in range(20)]
    rows += [(600, None), (601, ""), (602, "  \t\n "), (603, "one"), (604, "One"), (605, "a b c"), (606, "A b\tc")]
    rows += [(700, f"{line} {line} {line}"), (701, text_of(rng, 9_000) + " " + passage), (702, "x" * 3_000), (703, "ab" * 1_500)]
    rows += [(704, "Ünïcode — naïve 日本語 text🎉   end"), (705, "a\x00b ▁c"), (706, "wörd " * 120)]
    return rows


def frame(spark, rows):
    """The documents with columns whose names clash with those inside the operators."""
    wide = [(i, t, "en", "src", len(t or ""), "x", 7) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, node string, chunk int"
    return spark.createDataFrame(wide, kinds)
