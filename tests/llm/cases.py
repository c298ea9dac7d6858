"""Rows that every operator has to take, and plain reference computations."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, low=3, high=9):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(low, high))) for _ in range(n))


def odd_documents():
    """(doc_id, text, lang): nulls, blanks, ties, repeats, non-ASCII and a long text."""
    base = prose(1, 80)
    lines = "\n".join(prose(s, 12) + "." for s in range(40, 46))
    near = base.split()
    near[40] = "changed"
    return [
        (1, base, "en"), (2, base, "de"), (3, " ".join(near), None), (4, None, "en"), (5, "", "en"), (6, " \n\t ", None),
        (7, "word", "en"), (8, "Ünï cödé 🙂 " * 30, "de"), (9, lines, "en"), (10, "intro line.\n" + lines + "\nlast line.", "en"),
        (11, prose(2, 30_000), "en"), (12, "ab " * 5_000, "en"), (None, prose(3, 50), "en"), (13, base, "en"), (13, base, "en"),
        (14, "x" * 50_000, "en"), (15, "a b c d", "en"), (16, "A, B. c d!", "en"), (17, prose(4, 60) + "\n\n" + prose(5, 60), "en"),
    ]


SCHEMA = "doc_id long, text string, lang string"


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def clashing(frame, *names):
    """The frame with extra columns of these names."""
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.lit(7) for n in names})
