import pytest

import __spark_entry__ as entry_point
from epilane.llm import decontaminate

from . import cases

ITEM = (
    "A train leaves Boston at 60 miles per hour and travels for 3 hours before it stops"
    " so how far did it travel at 60 miles per hour?"
)
CASES = [
    (1, ITEM, True, True),
    (2, "Intro. " + ITEM + " More text follows here.", True, True),
    (3, ITEM.replace("Boston", "Denver").replace("60 miles", "75 km"), True, False),
    (4, ITEM.replace("60", "75", 1), False, None),  # one value for two: not the same slots
    (5, ITEM[:40], False, None),
    (6, "Nothing of the kind, " * 20, False, None),
    (7, ITEM.upper(), True, True),
    (8, None, False, None),
    (9, "", False, None),
    (None, ITEM, True, True),
    (1, ITEM, True, True),
]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_templates_and_slots_both_ways(spark, limit):
    benchmark = spark.createDataFrame(
        [(1, ITEM, "x"), (2, None, "x"), (3, "too short", "x"), (None, ITEM, "x"), (4, ITEM, "x")],
        "item_id long, text string, code string",
    )
    frame = spark.createDataFrame([(k, t, 5) for k, t, _, _ in CASES], "doc_id long, text string, item_id int")
    found = decontaminate.find_contamination(frame, benchmark, max_local_windows=limit)
    rows = sorted(((r["doc_id"], r["contaminated"], r["exact"]) for r in found.collect()), key=str)
    assert rows == sorted(((k, bad, exact) for k, _, bad, exact in CASES), key=str)
    assert {(r["item_id"], r["n_items"]) for r in found.filter("contaminated").collect()} == {(1, 2)}
    kept = decontaminate.drop_contaminated(frame, benchmark, max_local_windows=limit)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 8, 9]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    found = entry_point.queries()["op7_decontaminate"](spark, folder).collect()
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = cases.texts(spark, folder)
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    flat = {k: " ".join(t.lower().split()) for k, t in texts.items()}
    whole = {k for k, t in flat.items() if any(" ".join(i.lower().split()) in t for i in items)}
    bad = {r["doc_id"] for r in found if r["contaminated"]}
    assert whole <= bad
    # What else is found shares a window of plain words with an item.
    def windows(text):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    of_items = set().union(*map(windows, items))
    assert all(windows(texts[k]) & of_items for k in bad - whole)


def test_both_ways_agree_on_the_table(spark):
    folder = "/root/testdata/sf0.01"
    documents = cases.documents(spark, folder)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    a, b = (
        sorted(map(tuple, decontaminate.find_contamination(documents, benchmark, max_local_windows=n).collect()), key=str)
        for n in (200_000, 10)
    )
    assert a == b


def test_agreement():
    assert decontaminate.agreement([(1, 1), (2, 2)]) == 2
    assert decontaminate.agreement([(1, 5), (2, 6), (1, 5)]) == 1
    assert decontaminate.agreement([(1, 5), (1, 6)]) == 0
    assert decontaminate.agreement([]) == 2


def test_awkward_and_empty(spark):
    frame, none = cases.awkward(spark), cases.nothing(spark)
    items = spark.createDataFrame([(1, cases.PLAIN)], "item_id long, text string")
    for limit in (200_000, 0):
        rows = decontaminate.find_contamination(frame, items, max_local_windows=limit).collect()
        assert len(rows) == 14
        assert [str(r["doc_id"]) for r in rows if r["contaminated"]].count("2") == 2
        assert decontaminate.find_contamination(none, items, max_local_windows=limit).count() == 0
        assert decontaminate.find_contamination(frame, items.limit(0), max_local_windows=limit).count() == 14
        assert decontaminate.drop_contaminated(none, items, max_local_windows=limit).count() == 0


def bad_ids(spark, items, texts, limit):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find_contamination(frame, benchmark, max_local_windows=limit)
    bad = sorted(r["doc_id"] for r in found.filter("contaminated").collect())
    kept = decontaminate.drop_contaminated(frame, benchmark, max_local_windows=limit)
    assert sorted([*bad, *(r["doc_id"] for r in kept.collect())]) == list(range(len(texts)))
    return bad


def letters(n, lead="w"):
    return [lead + "".join(chr(97 + int(c)) for c in str(i)) for i in range(n)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_part_of_a_long_item(spark, limit):
    middle, long = letters(42, "m"), letters(200, "l")
    texts = [
        " ".join(part)
        for words in (middle, long)
        for part in (words[:13], words[20:33], words[-13:], words[:12], words[5:17], words[:7] + ["x"] + words[7:14])
    ]
    texts = [f"before it {t} after it" for t in texts]
    assert bad_ids(spark, [" ".join(middle), " ".join(long)], texts, limit) == [0, 1, 2, 6, 7, 8]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_one_disputed_slot_leaves_the_rest(spark, limit):
    a, b, c = (" ".join(letters(30, x)) for x in "abc")
    item = f"{a} 60 {b} 60 {c}"
    texts = [
        item.replace("60", "75", 1),
        f"{a} 75 {b} 60 {b}",
        item.replace("60", "75"),
        f"{a[: a.index(' ab')]} 75 {b[: b.index(' bb')]} 60",
    ]
    assert bad_ids(spark, [item], texts, limit) == [0, 1, 2]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_runs_are_cut_at_the_edge_of_an_item(spark, limit):
    words = letters(20)
    item = f"60 {' '.join(words[:10])} 60 {' '.join(words[10:])} 60"
    texts = [item, f"In 2020 {item}", f"{item} 17 more", f"page 4. {item} 5 6", f"in 2020 {item.replace('60', '75')} 3"]
    assert bad_ids(spark, [item], texts, limit) == [0, 1, 2, 3, 4]
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find_contamination(frame, benchmark, max_local_windows=limit)
    assert [r["exact"] for r in found.orderBy("doc_id").collect()] == [True] * 4 + [False]


def test_longest_agreeing_stretch():
    def windows(values):
        return [
            (k, [(p, 1, v) for p, v in values if k <= p < k + decontaminate.WINDOW]) for k in range(40)
        ]

    stretch = decontaminate.agreeing_stretch
    assert stretch(windows([])) == list(range(40))
    assert stretch(windows([(20, 5), (30, 5)])) == list(range(40))
    assert stretch(windows([(10, 5), (30, 6)])) == list(range(11, 40))
    assert stretch(windows([(30, 5), (32, 6)])) == list(range(25))
    assert stretch([(0, []), (1, []), (30, [])]) == [0, 1]
    assert stretch([(0, [(1, 1, 1), (2, 1, 2)])]) == stretch([]) == []


@pytest.mark.parametrize("limit", [200_000, 0])
def test_items_with_few_plain_words(spark, limit):
    items = [
        "What is the capital of France?",
        "12 + 34 * 56 - 78 = 9 10 11 12",
        "mix 3 kg with 4 litres then 5 kg with 6 litres or 7 kg and 8 litres for 9 hours",
        "Who wins",
        "rate 5 kg 6 from 7 kg 8 to 9 kg 10 at 11 kg 12",
        "?!",
        None,
    ]
    texts = [
        "So I ask: what is the capital of France, and why",
        "what is the capital of Spain",
        "in 2020: 12 + 34 * 56 - 78 = 9 10 11 12 13 14",
        "12 + 34 * 56 - 79 = 9 10 11 13",
        f"please {items[2]} now",
        "mix 13 kg with 14 litres then 15 kg with 16 litres or 17 kg and 18 litres for 19 hours",
        "who wins?",
        "who wins here",
        f"at 4 {items[4]} 3",
        "rate 15 kg 6 from 17 kg 8 to 19 kg 10 at 1 kg 12",
        "",
    ]
    assert bad_ids(spark, items, texts, limit) == [0, 2, 4, 5, 6, 8]
    benchmark = spark.createDataFrame([*enumerate(items), (None, items[0])], "item_id long, text string")
    unseen = decontaminate.unseen_items(benchmark).collect()
    assert sorted(str(r["item_id"]) for r in unseen) == ["5", "6", "None"]


def test_number_heavy_part_belongs_to_the_run(spark):
    words = letters(40)
    item = " ".join([*words[:20], "3 kg 4 kg 5 kg of 6 kg 7 m 8 kg 9 m", *words[20:]])
    part = " ".join(["x", *words[17:20], "3 kg 4 kg 5 kg of 6 kg 7 m 8 kg 9 m", "y"])
    for limit in (200_000, 0):
        assert bad_ids(spark, [item], [part, part.replace("7", "5")], limit) == [0]
