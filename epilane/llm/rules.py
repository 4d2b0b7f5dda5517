"""Quality rules with a divergence test against language references.

Built-in functions only. The table itself gives the references: a word is common in a
language if its mean share of the language's documents is large enough, and the
histograms of all documents that pass the base rules, over character classes and over
their language's common words, add up to the language's reference. A document is kept if
its mean Jensen-Shannon distance to its language is small, if it is too short to judge,
or if its language has no reference.

Cases: a null text counts as no words and fails the base rules; null keys, repeated rows
and other columns pass through unharmed (only the key, text and language are read); an
empty table gives an empty result; documents without a language, and of languages with
too few documents, are judged by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilane.session import Scratch

SPACES = r"[ \t\n\x0B\f\r]"

SYMBOLS = r"[#*$%&|<>]"
CHAR_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.!?]+", "pause": "[,;:'\"-]+"}
# Spaces, the classes above, bytes beyond one per character, and all else.
CHAR_BINS = ["space", *CHAR_CLASSES, "wide", "other"]
# Frequent function words, for callers that learn no vocabulary.
FUNCTION_WORDS = (
    "the of and to in is that for with on le la les des et du que pour dans est der die das und ist nicht mit"
    " ein auf zu el los las de y por con un no se"
).split()
# A language needs this many documents and this share of all; a word this mean share.
MIN_DOCUMENTS, MIN_PART, COMMON_SHARE = 20, 0.001, 0.005
MIN_WORDS, MAX_DISTANCE = 50, 0.25


def _left(name: str, drop: int) -> Column:
    return F.slice(name, F.lit(1), F.greatest(F.size(name) - drop, F.lit(0)))


def _right(name: str, drop: int) -> Column:
    return F.slice(name, F.lit(drop + 1), F.greatest(F.size(name) - drop, F.lit(0)))


def _long(col: Column) -> Column:
    return col.cast("long")


def _words(text: Column) -> Column:
    """Words of a text; trimmed first, so that no piece is empty."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare != "", F.split(bare, SPACES + "+")).otherwise(F.array().cast("array<string>"))


def common_words(
    documents: DataFrame, scratch: Scratch, min_words: int, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang,vocab``: the common words of every language with enough documents.

    Each document of ``min_words`` words or more spreads a weight of one over its words, so
    the shares of a language add up to one: at most ``1 / COMMON_SHARE`` words are common,
    and at most ``1 / MIN_PART`` languages have any.
    """
    words = documents.select(
        F.col(lang_col).cast("string").alias("lang"), _words(F.lower(F.col(text_col))).alias("words")
    ).filter(F.col("lang").isNotNull() & (F.size("words") >= min_words))
    weights = scratch.table(
        words.select("lang", (1.0 / F.size("words")).alias("weight"), F.explode("words").alias("word"))
        .groupBy("lang", "word")
        .agg(F.sum("weight").alias("weight")),
        "weights",
    )
    sizes = weights.groupBy("lang").agg(F.round(F.sum("weight")).alias("n"))
    whole = weights.agg(F.sum("weight")).first()[0] or 0.0
    large = sizes.filter(F.col("n") >= F.greatest(F.lit(float(MIN_DOCUMENTS)), F.lit(MIN_PART * whole)))
    return (
        weights.join(F.broadcast(large), "lang")  # 1 / MIN_PART rows at most
        .filter(F.col("weight") >= COMMON_SHARE * F.col("n"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list("word")).alias("vocab"))
    )


def text_counts(
    documents: DataFrame,
    vocabulary: DataFrame | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Counts per document from its whole text; ``chars`` and ``common`` are histograms,
    the latter over the common words of the document's language and all others. Without a
    vocabulary ``FUNCTION_WORDS`` are the common words of every document.

    The steps are separate projections that name each array at least twice, so that the
    optimizer does not put one into the next and work it out again per element.
    """
    df = documents.select(
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    if vocabulary is None:
        df = df.withColumn("vocab", F.array(*(F.lit(w) for w in FUNCTION_WORDS)))
    else:
        df = df.join(F.broadcast(vocabulary), "lang", "left")  # bounded, see common_words
        df = df.withColumn("vocab", F.coalesce("vocab", F.array().cast("array<string>")))
    df = df.select(
        "id",
        "lang",
        "vocab",
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"),
        _long(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        _long(F.char_length("text")).alias("n_chars"),
        _long(F.octet_length("text")).alias("n_bytes"),
        *(
            _long(F.regexp_count("text", F.lit(rx))).alias(f"c_{name}")
            for name, rx in CHAR_CLASSES.items()
        ),
    )
    def known(word):
        return word.isin(FUNCTION_WORDS) if vocabulary is None else F.array_contains("vocab", word)

    df = df.select(
        "id",
        "lang",
        "vocab",
        _long(F.size("words")).alias("n_words"),
        "n_symbols",
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_chars",
        (F.col("n_bytes") - F.col("n_chars")).alias("c_wide"),
        *(f"c_{name}" for name in CHAR_CLASSES),
        F.aggregate("words", _long(F.lit(0)), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.filter("words", lambda w: known(F.lower(w))).alias("known"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    # Hashes of 2, 4 and 5 words from those of 1, 2 and 4.
    chain = ["id", "lang", "n_words", "n_symbols", "n_dup_lines", "word_chars"]
    df = df.withColumn("known", F.transform("known", lambda w: F.lower(w)))
    df = df.select(
        *chain,
        F.array(
            F.col("n_chars") - F.col("word_chars"),
            *(F.col(f"c_{name}") for name in CHAR_CLASSES),
            "c_wide",
            F.greatest(
                F.col("word_chars")
                - F.col("c_wide")
                - sum((F.col(f"c_{name}") for name in CHAR_CLASSES), F.lit(0)),
                _long(F.lit(0)),
            ),
        ).alias("chars"),
        F.transform(
            "vocab",
            lambda v: _long(F.size("known") - F.size(F.array_remove("known", v))),
        ).alias("common"),
        (F.col("n_words") - F.size("known")).alias("uncommon"),
        "h1",
        F.zip_with(_left("h1", 1), _right("h1", 1), lambda a, b: F.xxhash64(a, b)).alias("h2"),
    )
    chain += ["chars", "common", "uncommon"]
    df = df.select(
        *chain,
        "h1",
        F.zip_with(_left("h2", 2), _right("h2", 2), lambda a, b: F.xxhash64(a, b)).alias("h4"),
    )
    df = df.select(
        *chain,
        F.zip_with(_left("h4", 1), _right("h1", 4), lambda a, b: F.xxhash64(a, b)).alias("h5"),
    )
    # Most texts repeat no window; only the windows of the others are sorted, so that
    # equal ones come side by side with their places.
    df = df.select(
        *chain,
        F.when(
            F.size("h5") > F.size(F.array_distinct("h5")),
            F.array_sort(F.transform("h5", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("sorted"),
    )
    df = df.select(
        *chain,
        F.zip_with(
            _left("sorted", 1),
            _right("sorted", 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
                F.array().cast("array<int>")
            ),
        ).alias("same"),
    )
    df = df.select(*chain, F.array_sort(F.array_distinct(F.flatten("same"))).alias("places"))
    # A repeated place adds 5 words, or the gap to the next one if that is smaller.
    df = df.select(
        *chain,
        F.size("places").alias("n_places"),
        F.zip_with(
            _left("places", 1), _right("places", 1), lambda a, b: F.least(b - a, F.lit(5))
        ).alias("gaps"),
    )
    return df.select(
        "id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(
            F.col("n_places") > 0,
            F.aggregate("gaps", _long(F.lit(5)), lambda a, g: a + g),
        )
        .otherwise(_long(F.lit(0)))
        .alias("n_repeat_words"),
        "chars",
        F.aggregate("chars", _long(F.lit(0)), lambda a, c: a + c).alias("chars_total"),
        F.concat("common", F.array("uncommon")).alias("common"),
        F.col("n_words").alias("common_total"),
    )


def _distance(name: str) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram column to its language's shares."""
    total = F.col(f"{name}_total")

    def part(x, mean):
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0)

    parts = F.zip_with(
        F.transform(name, lambda c: c / total),
        f"{name}_shares",
        lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2),
    )
    divergence = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(1.0)


def _shares(accepted: DataFrame, name: str) -> DataFrame:
    """``lang`` and the shares of each bin over the summed histograms of a language."""
    summed = accepted.select("lang", F.posexplode(name).alias("bin", "n")).groupBy("lang", "bin").agg(
        F.sum("n").alias("n")
    )
    listed = summed.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda b: b["n"]).alias("sums"),
        F.sum("n").alias("whole"),
    )
    return listed.select(
        "lang",
        F.transform("sums", lambda n: F.when(F.col("whole") > 0, n / F.col("whole")).otherwise(0.0)).alias(
            f"{name}_shares"
        ),
    )


def quality_rules(
    documents: DataFrame,
    max_distance: float = MAX_DISTANCE,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Counts, base verdict, distance to the document's language, final verdict.

    ``min_words`` is the length under which the divergence is not judged. Only the
    references, one row for each language that has one, are broadcast.
    """
    with Scratch(documents.sparkSession) as scratch:
        vocabulary = scratch.table(
            common_words(documents, scratch, min_words, text_col, lang_col), "vocabulary"
        )
        counts = scratch.table(
            text_counts(documents, vocabulary, id_col, text_col, lang_col), "counts"
        ).withColumn(
            "base_failed",
            (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        )
        accepted = counts.filter(~F.col("base_failed")).join(F.broadcast(vocabulary.select("lang")), "lang")
        references = _shares(accepted, "chars").join(_shares(accepted, "common"), "lang")
        judged = counts.join(F.broadcast(references), "lang", "left")
        distance = (_distance("chars") + _distance("common")) / 2
        known = (F.col("n_words") >= min_words) & F.col("chars_shares").isNotNull()
        return scratch.result(
            judged.select(
                F.col("id").alias(id_col),
                "n_words",
                "word_chars",
                "n_symbols",
                "n_dup_lines",
                "n_repeat_words",
                "base_failed",
                F.when(known, distance).alias("distance"),
            ).withColumn(
                "kept",
                ~F.col("base_failed") & F.coalesce(F.col("distance") <= max_distance, F.lit(True)),
            )
        )


def op10_quality_rules(spark, folder):
    rows = quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.withColumn("distance", F.round("distance", 6))
