"""Small documents and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, `hits` string, line string"


def documents(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", None) for i, t, s in rows], SCHEMA).repartition(3)


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "one text without an id", "b"), (5, "same same", "a"), (5, "same same", "a"), (6, "same same", None),
         (7, "word " * 30000, "c"), (8, "x" * 200_000, "c"), (9, "é ☃ 🙂 " * 20, "d")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0, str(r)))
