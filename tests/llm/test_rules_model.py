import collections
import random
import re

import pytest

import __spark_entry__ as entry_point
from epilane.llm import rules

from . import cases


def model(text):
    words = cases.WORDS.findall(text)
    n = len(words)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = set()
    for i in range(n - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if cases.WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), symbols, repeated, len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_of_whole_documents(spark):
    rows = entry_point.queries()["op10_quality_rules"](spark, cases.FOLDER).collect()
    texts = cases.texts(spark)
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == model(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_plan_has_no_python(spark):
    vocabulary = spark.createDataFrame([("en", ["the"])], "lang string, vocab array<string>")
    plan = rules.text_counts(cases.documents(spark), vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward_and_empty(spark):
    rows = rules.quality_rules(cases.awkward(spark)).collect()
    assert len(rows) == 14
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_words"] == 0 and by_id[3]["base_failed"] and not by_id[3]["kept"]
    assert by_id[1]["kept"] and by_id[1]["distance"] is None
    assert rules.quality_rules(cases.nothing(spark)).count() == 0


def test_divergence_rejects_noise_and_keeps_prose(spark):
    random.seed(4)
    vocabulary = [*"the of and to in is that for with on".split() * 4, *(f"{a}{b}er" for a in "bcdfglmp" for b in "aeiou")]
    docs = [(i, " ".join(random.choices(vocabulary, k=150)) + ".", "en") for i in range(30)]
    docs.append((99, " ".join(f"9{i}#7$%{i * 7919}" for i in range(80)), "en"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in rules.quality_rules(frame, max_distance=0.3).collect()}
    assert not kept[99] and all(kept[i] for i in range(30))


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "x x x x x x x", "a b c d e f a b c d e g", "a\na\n\n \na"])
def test_small_texts(spark, text):
    frame = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    r = rules.quality_rules(frame).first()
    assert tuple(r[c] for c in COLUMNS) == model(text)


RUSSIAN = "и в не на что с по это как к но мы из за то для у от так же".split()
GREEK = "και το να του η που με την ο σε για τα δεν είναι από".split()


def prose(rng, common, letters, n=90):
    rare = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(n)]
    words = [rng.choice(common) if rng.random() < 0.45 else rare[i] for i in range(n)]
    return " ".join(words).capitalize() + "."


def test_languages_are_learned_and_unknown_ones_pass(spark):
    rng = random.Random(7)
    docs = []
    for i in range(60):
        docs.append((i, prose(rng, "the of and to in is that for with on".split(), "abcdefghilmnoprstu"), "en"))
        docs.append((100 + i, prose(rng, RUSSIAN, "абвгдежзиклмнопрстуя"), "ru"))
    docs += [(300, prose(rng, GREEK, "αβγδεηικλμνοπρστω"), "el"), (301, prose(rng, GREEK, "αβγδεηικλμνοπρστω"), None)]
    junk = " ".join(f"9{i}#7$%{i * 7919}" for i in range(80))
    docs += [(400, junk, "en"), (401, junk, "ru")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in rules.quality_rules(frame).collect()}
    assert not found[400]["kept"] and not found[401]["kept"]
    assert all(r["kept"] for k, r in found.items() if k < 400)
    # Too few Greek documents for a reference; those of no language have none.
    assert found[300]["distance"] is None and found[301]["distance"] is None
    assert all(found[100 + i]["distance"] is not None for i in range(60))
