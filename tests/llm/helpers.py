"""Rows that every operator must bear."""

import random

CLASH = "fp long, component_id long, rank long, part int, text_key long, carried int, leaks int, node string, value string"


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def messy_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty, blank, very long, tied and repeated rows."""
    long, shared = words(60_000, 1, 50_000), words(80, 2)
    return [
        (None, None), (None, shared), (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one"), (5, "One"), (6, "..."), (7, long), (8, shared),
        (9, f"start {shared} end"), (9, f"start {shared} end"), (10, shared), (11, "é ü 漢字 \x85 word"), (12, f"{words(70, 3)} {shared} {words(70, 4)}"),
    ]


def documents(spark, rows=None):
    """documents with clashing extra columns."""
    rows = messy_rows() if rows is None else rows
    filled = [(i, t, "en", "s", len(t) if t is not None else None, 1, 2, 3, 4, 5, 6, 7, "n", "v") for i, t in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
