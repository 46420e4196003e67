"""Small tables with nulls, empty, blank and long texts, ties, repeated rows and extra columns of clashing names."""

import random
import zlib

FOLDER = "/root/testdata/sf0.001"
EXTRA = ("part", "fp", "root", "value", "a", "b", "n", "size", "shard", "bucket", "text_hash", "_id", "_hash", "place", "label", "count")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def prose(rng, words, start=0):
    return " ".join(f"w{start + rng.randrange(400)}" for _ in range(words))


def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    other = prose(rng, 80, 1000)
    return [
        (1, base), (2, base), (3, base.replace("w", "W", 1) + " tail"), (4, other), (5, None), (6, ""), (7, " \t\n "),
        (8, "one"), (9, "Two Words"), (9, "Two Words"), (None, "no id at all here"), (None, None), (10, prose(rng, 9000)),
        (11, other + " end"), (12, "日本語 テキスト ÉTÉ naïve"), (13, "!!! ... ???"), (14, "a b c  d\r\ne \U0001f600"),
    ]


def docs(spark, rows=None, lang=None):
    rows = texts() if rows is None else rows
    lang = lang or {}
    full = [(i, t, lang.get(i, "en"), "s", None if t is None else len(t), *["x"] * len(EXTRA)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
