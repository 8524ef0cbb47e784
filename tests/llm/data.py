"""Small inputs with every awkward case, shared by the tests."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

WORDS = "the house of river stone and garden was built by people from far with care in summer light over hills".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 8 & 15] + ("" if x >> 16 & 3 else str(x >> 20 & 63)))
    return " ".join(out)


def texts() -> list[tuple]:
    """(doc_id, text, source)"""
    rows = [(i, sentence(i, 12 + 5 * i), f"s{i % 3}") for i in range(30)]
    copy = rows[7][1]
    rows += [(100 + i, copy, "s1") for i in range(6)]                       # exact copies
    rows += [(120, copy, "s1"), (120, copy, "s1")]                          # repeated rows
    rows += [(200, None, "s0"), (201, "", None), (202, "   \n\t ", "s0"), (None, "no id here", "s2"), (None, None, None)]
    rows += [(300, "word " * 20_000, "s0"), (301, "é" * 5_000, "s0"), (302, "a\x1cb \x0b c\xa0d\x85e 日本 😀 don't", "s2")]
    return rows


DOCS = StructType([
    StructField("fp", StringType()), StructField("doc_id", LongType()), StructField("text", StringType()), StructField("Text", StringType()),
    StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("n", LongType()),
    StructField("_k", StringType()), StructField("ids", StringType()),
])


def documents(spark, rows=None):
    """The rows with extra columns whose names the operators use themselves."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([("x", i, t, "clash", None, s, None if t is None else len(t), 1, "k", "z") for i, t, s in rows], DOCS)


def same_rows(got, want) -> bool:
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)
