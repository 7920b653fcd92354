"""Small tables for the edge cases every operator has to take: nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(12_000))
ODD = [
    (1, "The cat sat on the mat and the dog lay by the door of the house in the sun", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, " \t\n ", "de", "b"),
    (5, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (6, LONG, "en", "b"),
    (7, "éàü ß İ 日本語 x", "fr", "c"),
    (8, "a b c", "en", "c"),
    (9, "a b c", "en", None),
    (None, "no id here and none there", "en", "a"),
    (10, "spam " * 400, "en", "a"),
]
#: Names that operators might use inside.
CLASHES = "key node fam bucket root quality words blob findings size target mix n kind p path content _whole _words _id _first".split()


def documents(spark, rows=ODD, clash=False):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(*r, len(r[1] or "")) for r in rows]
    if clash:
        schema += "".join(f", `{c}` string" for c in CLASHES)
        full = [(*r, *["x"] * len(CLASHES)) for r in full]
    return spark.createDataFrame(full, schema)


def table(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width, percent):
    """Smallest id reachable by links, by all pairs that share a shingle."""
    sets: dict = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, all_ in sets.items() for s in all_ if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
