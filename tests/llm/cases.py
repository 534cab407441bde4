"""Documents with every awkward case, and the words of the two rules."""

import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size int, score string, shard string, words string, block string, host string, n_blocks string"
)
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
BASE = [
    (0, "the cat sat on the mat and looked at the moon for a long time today", "en", "a"),
    (1, "the cat sat on the mat and looked at the moon for a long time today", "en", "a"),
    (2, "The Cat sat on the mat and looked at the moon for a long time TODAY", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \n\t ", "de", None),
    (6, "eins zwei drei vier", "de", "c"),
    (7, LONG, None, "c"),
    (8, LONG + " end", "de", None),
    (9, "Éa éa straße 12 – naïve word", "fr", "d"),
    (10, "%%% ### 12345", "es", "d"),
    (11, "one", None, None),
    (None, "no id but text", "en", "a"),
    (None, None, None, None),
    (6, "eins zwei drei vier", "de", "c"),
]


def documents(spark, rows=None):
    rows = BASE if rows is None else rows
    return spark.createDataFrame([(*r, None, 1, "s", "t", "u", "v", "w", "x") for r in rows], SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
