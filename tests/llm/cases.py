"""Awkward documents that every operator must take, and plain models of the contracts."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FOLDER = "/root/testdata/sf0.001"

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double,"
    " ids string, spans string, component_id long, text_key string, kept string, _key string,"
    " label int, n_tokens long, word string"
)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def thue_morse(n=2048):
    """A word and its complement, whose sums of products modulo 2^64 are equal."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


PLAIN = "One two three four five six seven eight nine ten eleven twelve."


def awkward(spark):
    """Null and empty texts, null and repeated keys, repeated rows, a long text, extra
    columns whose names the operators use themselves."""
    rows = [
        (1, PLAIN, "en", "a"),
        (2, PLAIN, "en", "a"),
        (2, PLAIN, "en", "a"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, " \n\t ", "xx", "b"),
        (None, PLAIN, "en", "a"),
        (None, None, None, None),
        (6, LONG, "de", "c"),
        (7, LONG + " end", "de", "c"),
        (8, "same key, one text", "en", "a"),
        (8, "same key, another text", "en", "a"),
        (9, "a", "en", "a"),
        (10, "é😀\x00 ñ <|endoftext|> it's 12%", "fr", "a"),
    ]
    extra = (0.5, "x", "y", 7, "z", "no", "k", 3, 4, "w")
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(spark, folder=FOLDER):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, folder).collect()}


def shingles(text):
    words = WORDS.findall(text.translate(FOLD))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
