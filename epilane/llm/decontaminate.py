"""Benchmark passages in documents, also with other numbers, names and units.

Both sides become templates: lower-case words, with numbers, names (capitalised inside a
sentence) and units after numbers replaced by typed placeholders, runs of one type by one.
Windows of ``WINDOW`` template words are joined by hash. For each document and item the
windows must cover enough of the item, or hold a run of ``RUN`` words of it (all words of
a shorter item), and the slots must agree: along one placement, one value of the item
always stands for the same value of the document. Equal values are an exact copy, others a
re-parameterised one. Where slots disagree, the longest stretch within which they agree
counts if it has twice ``min_run`` words. A run of one type at the edge of a window may go
on outside it, so only its word next to the window's other words is compared there.

Where ``WINDOW`` template words hold under ``LITERALS`` plain ones, two other windows stand
in: one that goes on to the last of ``LITERALS`` plain words, and one whose values must be
equal. Items under ``WINDOW`` template words are matched on their words as they are, in
windows of ``WINDOW`` or of the item's length; under ``LITERALS`` words they count only
where they are the whole text.

Benchmark windows travel to the tasks if they are few (``max_local_windows``, a checked
size); beyond that the windows of documents are joined with them by a shuffle. Both ways
give the same rows.

Cases: a null or empty text holds nothing; a null key is judged like others; repeated
rows are judged alike; items without a key or any word match nothing (``unseen_items``
names them); ties between items go to the smaller id; other columns
are not read; empty tables give an empty result or one without findings.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.llm.words import BASE, Rolling, WordHasher, mix, release

WINDOW = 8
LITERALS = 5  # plain words that a window needs
RUN = 13  # template words in a row that are a finding whatever share of the item they are
WORD, NUMBER, NAME, UNIT = range(4)
# Kinds of windows: enough plain words; up to the last plain word needed; equal values;
# words as they are.
PLAIN, WIDE, EQUAL, RAW = range(4)
# Units that may follow a number.
UNITS = (
    "% percent kg g mg lb lbs oz km m cm mm mile miles ft feet foot inch inches yard yards"
    " l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes"
    " h hour hours day days week weeks month months year years mph kmh $ dollar dollars euro"
    " euros cent cents pound pounds degree degrees"
).split()


class Words(NamedTuple):
    """Words of many texts, runs of one placeholder as one word.

    ``head`` and ``tail`` are the values of a run's first and last word.
    """

    template: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    owner: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    several: np.ndarray
    raw_value: np.ndarray
    raw_owner: np.ndarray


class Windows(NamedTuple):
    """Windows of many texts: start, hash, text number, kind and width."""

    at: np.ndarray
    code: np.ndarray
    owner: np.ndarray
    rule: np.ndarray
    width: np.ndarray


class Templates:
    """Template words of many texts at once, from their bytes."""

    def __init__(self):
        self.hasher = WordHasher(fold=True)
        self.rolling = Rolling()
        letters = np.zeros(256, bool)
        letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
        self.gap = ~letters
        self.stop = np.zeros(256, bool)
        self.stop[[ord(c) for c in ".!?\n\""]] = True
        self.units = np.array([self.word(u) for u in UNITS], np.uint64)

    def word(self, text: str) -> np.uint64:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.hasher.stretches(data, np.array([0]), np.array([len(data)]))[0]

    def words(self, texts: list[bytes]):
        """Template hash, type, value hash, text number, value hash of the first and last
        word, and whether there are several, of every word or run in order."""
        data = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"\n", np.uint8)
        n = len(data)
        gap = self.gap[data]
        sign = (data == 36) | (data == 37)  # $ and % are words of their own
        edge = gap | np.concatenate([[True], gap[:-1]])
        first = np.flatnonzero((~gap & edge) | sign)
        ends_word = ~gap & np.concatenate([gap[1:], [True]])
        stop = np.flatnonzero(ends_word | sign) + 1
        value = self.hasher.stretches(data, first, stop)
        ends = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(ends, first, side="right")
        lead = data[first]
        kind = np.full(len(first), WORD, np.int8)
        kind[(lead >= 48) & (lead <= 57)] = NUMBER
        # A name: a capital, then small letters, with no stop between it and the last word.
        second = data[np.minimum(first + 1, n - 1)]
        stops = np.concatenate([[0], np.cumsum(self.stop[data])])
        before = np.concatenate([[0], stop[:-1]])
        inside = (stops[first] == stops[before]) & np.concatenate([[False], owner[1:] == owner[:-1]])
        small = ((second >= 97) & (second <= 122)) | (second >= 128)
        kind[(lead >= 65) & (lead <= 90) & small & inside & (stop - first > 1)] = NAME
        after = np.concatenate([[False], (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])])
        unit = np.isin(value, self.units) & (after | sign[first])
        kind[unit] = UNIT
        # One placeholder for a run of one type.
        start = np.ones(len(kind), bool)
        start[1:] = (kind[1:] == WORD) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
        group = np.cumsum(start) - 1
        total = np.zeros(int(start.sum()), np.uint64)
        place = np.arange(len(kind)) - np.flatnonzero(start)[group] if len(kind) else np.zeros(0, int)
        np.add.at(total, group, value * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)))
        heads = np.flatnonzero(start)
        tails = np.append(heads[1:], len(kind)) - 1 if len(kind) else heads
        raw_owner = owner
        kind, owner = kind[start], owner[start]
        template = np.where(kind == WORD, total, kind.astype(np.uint64))
        return Words(template, kind, total, owner, value[heads], value[tails], tails > heads, value, raw_owner)

    def windows(self, texts: list[bytes], size: int, raw=()):
        """The windows of all kinds, and the words; ``raw`` has the widths of raw windows."""
        words = self.words(texts)
        template, kind, owner = words.template, words.kind, words.owner
        n = max(len(template) - size + 1, 0)
        chain = np.zeros(n, np.uint64)
        plain = np.zeros(n, np.int64)
        for k in range(size):
            chain = mix(chain * np.uint64(31) + template[k : k + n])
            plain += kind[k : k + n] == WORD
        inside = owner[:n] == owner[size - 1 :]
        enough = plain >= min(LITERALS, size)
        at = np.flatnonzero(inside & enough)
        parts = [Windows(at, chain[at], owner[at], np.full(len(at), PLAIN), np.full(len(at), size))]
        few = np.flatnonzero(inside & ~enough)
        if len(few):
            parts += [self._wide(words, few), self._equal(words, few, size)]
        parts += [self._raw(words, width) for width in raw]
        return Windows(*(np.concatenate(c) for c in zip(*parts, strict=True))), words

    def _wide(self, words: Words, at: np.ndarray) -> Windows:
        """Windows from a plain word to the last of ``LITERALS`` plain words."""
        n = len(words.template)
        plain = np.flatnonzero(words.kind == WORD)
        at = at[words.kind[at] == WORD]
        rank = np.searchsorted(plain, at) + LITERALS - 1
        at, last = at[rank < len(plain)], plain[rank[rank < len(plain)]]
        one = words.owner[at] == words.owner[last]
        at, last = at[one], last[one]
        spread_out = mix(words.template + np.uint64(BASE))
        sums = self.rolling.sums([spread_out >> np.uint64(33), (spread_out << np.uint64(31)) >> np.uint64(33)])
        code = mix(self.rolling.name(sums, at, last + 1) + np.uint64(WIDE))
        return Windows(at, code, words.owner[at], np.full(len(at), WIDE), last + 1 - at)

    @staticmethod
    def _equal(words: Words, at: np.ndarray, size: int) -> Windows:
        chain = np.full(len(at), EQUAL, np.uint64)
        for k in range(size):
            value = words.tail if k == 0 else words.head if k == size - 1 else words.value
            chain = mix(chain * np.uint64(31) + value[at + k])
        return Windows(at, chain, words.owner[at], np.full(len(at), EQUAL), np.full(len(at), size))

    @staticmethod
    def _raw(words: Words, width: int) -> Windows:
        """Windows of ``width`` words as they are; below 0, whole texts of so many words."""
        value, owner = words.raw_value, words.raw_owner
        size = abs(width)
        n = max(len(value) - size + 1, 0)
        at = np.flatnonzero(owner[:n] == owner[size - 1 :][:n])
        if width < 0:
            at = at[np.bincount(owner)[owner[at]] == size]
        chain = np.full(len(at), RAW + 2 * size + (width < 0) + 100, np.uint64)
        for k in range(size):
            chain = mix(chain * np.uint64(31) + value[at + k])
        return Windows(at, chain, owner[at], np.full(len(at), RAW), np.full(len(at), width))


def agreement(pairs: list[tuple[int, int]]) -> int:
    """2 if all values are equal, 1 if one value always stands for the same, else 0."""
    if all(a == b for a, b in pairs):
        return 2
    forth: dict[int, int] = {}
    for a, b in pairs:
        if forth.setdefault(a, b) != b:
            return 0
    return 1


def longest_run(places) -> int:
    """Most template words in a row that windows at ``places`` of an item cover."""
    best, start, stop = 0, 0, -1
    for at in sorted(places):
        if at > stop:
            start = at
        stop = at + WINDOW
        best = max(best, stop - start)
    return best


def agreeing_stretch(windows: list[tuple[int, list]]) -> list[int]:
    """Places of the windows of the longest stretch without a gap whose slots agree."""
    windows = sorted(windows)
    seen: dict = defaultdict(lambda: defaultdict(int))
    first, torn, best, longest = 0, 0, [], 0

    def drop():
        nonlocal first, torn
        for _, a, b in windows[first][1]:
            seen[a][b] -= 1
            if not seen[a][b]:
                del seen[a][b]
                torn -= len(seen[a]) == 1
        first += 1

    for k, (at, slots) in enumerate(windows):
        while first < k and at > windows[k - 1][0] + WINDOW:
            drop()
        for _, a, b in slots:
            torn += b not in seen[a] and len(seen[a]) == 1
            seen[a][b] += 1
        while torn:
            drop()
        if first <= k and at + WINDOW - windows[first][0] > longest:
            longest = at + WINDOW - windows[first][0]
            best = [x for x, _ in windows[first : k + 1]]
    return best


def judge(hits: list[tuple], min_coverage: float, min_run: int):
    """Findings of one document: (item, coverage, exact).

    ``hits`` are (item, place in the item, kind of window, width, windows of the item by
    kind, words of the item, place in the document, slots) with slots as (place in the
    item, item's value, document's value). Windows of one placement (difference of the
    places) are judged together. Of a placement whose slots disagree the longest agreeing
    stretch counts, from twice ``min_run`` words on, and never as an exact copy. An item is
    found by its coverage or by ``min_run`` words in a row of one placement. Coverage is
    the highest share of its windows: of the plain ones, of those and the wide ones, of the
    plain ones and those of equal values.
    """
    placed = defaultdict(list)
    totals = {}
    for item, at_item, rule, width, total, length, at_doc, slots in hits:
        placed[item, at_doc - at_item].append((at_item, rule, width, slots))
        totals[item] = total, length
    best: dict[int, tuple[set, bool, int]] = {}
    for (item, _), windows in sorted(placed.items()):
        slots = {x for *_, found in windows for x in found}
        grade = agreement([(a, b) for _, a, b in sorted(slots)])
        if grade:
            # A wide window covers every window of the usual width within it.
            reach = longest_run(
                x for at, rule, width, _ in windows for x in (range(at, at + width - WINDOW + 1) if rule == WIDE else [at])
            )
            places = {(at, rule) for at, rule, _, _ in windows}
        else:
            usual = [w for w in windows if w[1] != WIDE]
            held = set(agreeing_stretch([(at, found) for at, _, _, found in usual]))
            reach = longest_run(held)
            places = {(at, rule) for at, rule, _, _ in usual if at in held}
        if grade or reach >= 2 * min_run:
            covered, exact, run = best.get(item, (set(), True, 0))
            best[item] = covered | places, exact and grade == 2, max(run, reach)
    out = []
    for item, (covered, exact, run) in best.items():
        total, length = totals[item]
        coverage = max(
            sum(rule in kinds for _, rule in covered) / sum(total[k] for k in kinds)
            for kinds in ((PLAIN,), (PLAIN, WIDE), (PLAIN, EQUAL), (RAW,))
            if sum(total[k] for k in kinds)
        )
        if coverage >= min_coverage or run >= min(min_run, length):
            out.append((item, coverage, exact))
    return out


class Index:
    """Benchmark windows by hash."""

    def __init__(self, rows):
        self.places = defaultdict(list)
        for *place, code, slots in rows:
            self.places[code].append((*place, slots))
        self.codes = np.array(sorted(self.places), np.uint64)
        self.raw = sorted({width for _, _, rule, width, *_ in rows if rule == RAW})


SEVERAL = 8  # added to the type of a run of several words at a window's edge


def _slots(words: Words, at: int, size: int) -> list[tuple[int, int, int]]:
    """(offset, type, value) of the placeholders of a window; runs are cut at its edges."""
    out = []
    for k in range(size):
        kind = int(words.kind[at + k])
        if kind == WORD:
            continue
        value = words.value
        if k in (0, size - 1):
            value = words.tail if k == 0 else words.head
            kind += SEVERAL * bool(words.several[at + k])
        out.append((k, kind, int(value[at + k])))
    return out


def _flat_slots(words: Words, at: int, rule: int, width: int) -> list[int]:
    """Offset, type and value of a window's slots in turn; equal values need no slots."""
    if rule > WIDE:
        return []
    return [x for k, kind, value in _slots(words, at, width) for x in (k, kind, _signed(value))]


ITEM_WINDOWS = (
    "item_id long, at long, rule long, width long, total array<long>, length long, code long,"
    " slots array<long>"
)


def item_rows(templates: Templates, key: int, text: str | None) -> list[tuple]:
    """The windows of one item, as in ``ITEM_WINDOWS``."""
    found, words = templates.windows([(text or "").encode()], WINDOW)
    length = len(words.owner)
    if length < WINDOW:
        # As it is, in words that runs do not shorten.
        length = len(words.raw_owner)
        width = -length if length < LITERALS else min(length, WINDOW)
        found = templates._raw(words, width) if length else found
    total = np.bincount(found.rule, minlength=RAW + 1).tolist()
    return [
        (key, at, rule, width, total, length, code, _flat_slots(words, at, rule, width))
        for at, code, rule, width in zip(
            *(c.tolist() for c in (found.at, found.code.view(np.int64), found.rule, found.width)), strict=True
        )
    ]


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of every item; ``total`` counts them by kind, ``slots`` holds offset, type
    and value in turn."""

    def run(batches):
        templates = Templates()
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += item_rows(templates, key, text)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            one, many = pa.int64(), pa.list_(pa.int64())
            kinds = [one, one, one, one, many, one, one, many]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["item_id", "at", "rule", "width", "total", "length", "code", "slots"],
            )

    rows = benchmark.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long"), F.col(text_col).cast("string")
    )
    return rows.mapInArrow(run, ITEM_WINDOWS)


def unseen_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The items that no document can match: without a key or any word."""
    seen = item_windows(benchmark, id_col, text_col).select(F.col("item_id").alias("seen_id")).distinct()
    return benchmark.join(seen, F.col(id_col).cast("long") == seen["seen_id"], "left_anti")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hit(item, at_item, rule, width, total, length, item_slots, at_doc, doc_slots):
    slots = []
    for (offset, x, a), (_, y, b) in zip(item_slots, doc_slots, strict=True):
        # Cut runs are compared with runs cut at the same edge only.
        side = 1 + (offset > 0) if max(x, y) >= SEVERAL else 0
        slots.append((at_item + offset, (side, a), (side, b)))
    return item, at_item, rule, width, total, length, at_doc, slots


def _triples(flat) -> list[tuple[int, int, int]]:
    return [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]


RESULT = (
    "doc_id long, contaminated boolean, item_id long, n_items long, coverage double,"
    " exact boolean, kept boolean"
)


def _verdict(found: list[tuple]) -> tuple:
    if not found:
        return False, None, 0, 0.0, None, True
    item, coverage, exact = min(found, key=lambda x: (-x[1], x[0]))
    return True, item, len(found), coverage, exact, False


def _chunks(batch, limit: int = 1 << 20):
    release()
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit)))
        part = batch.slice(start, stop - start)
        yield part.column(0), [(t or "").encode() for t in part.column(1).to_pylist()]
        start = stop


def _verdict_batch(keys, verdicts) -> pa.RecordBatch:
    columns = list(zip(*verdicts, strict=True))
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
        names=["doc_id", "contaminated", "item_id", "n_items", "coverage", "exact", "kept"],
    )


class Judge:
    """Verdicts on texts, with the benchmark windows at hand."""

    def __init__(self, rows: list[tuple], min_coverage: float, min_run: int):
        self.templates, self.index = Templates(), Index(rows)
        self.min_coverage, self.min_run = min_coverage, min_run

    def verdicts(self, texts: list[bytes]) -> list[tuple]:
        found, words = self.templates.windows(texts, WINDOW, self.index.raw)
        known = np.zeros(len(found.code), bool)
        if len(self.index.codes):
            place = np.searchsorted(self.index.codes, found.code)
            known = self.index.codes[np.minimum(place, len(self.index.codes) - 1)] == found.code
        hits = defaultdict(list)
        for a, code, owner, rule, width in zip(*(c[known].tolist() for c in found), strict=True):
            mine = _triples(_flat_slots(words, a, rule, width))
            for item in self.index.places[code]:
                hits[owner].append(_hit(*item, a, mine))
        return [
            _verdict(judge(hits.get(i, []), self.min_coverage, self.min_run)) for i in range(len(texts))
        ]


PLACE = ("item_id", "at", "rule", "width", "total", "length")


def _packed(rows: list) -> list[tuple]:
    return [
        (*(r[c] for c in PLACE), r["code"] % (1 << 64), _triples(r["slots"]))
        for r in rows
    ]


def _local(documents: DataFrame, rows: list, min_coverage: float, min_run: int) -> DataFrame:
    """Judge each document where it is."""
    packed = _packed(rows)

    def run(batches):
        judge_ = Judge(packed, min_coverage, min_run)
        for batch in batches:
            for keys, texts in _chunks(batch):
                yield _verdict_batch(keys, judge_.verdicts(texts))

    return documents.mapInArrow(run, RESULT)


DOC_WINDOWS = "text_key binary, at long, code long, slots array<long>"


def _text_key(name: str):
    return F.unhex(F.md5(F.coalesce(F.col(name).cast("string"), F.lit(""))))


def _best_items(keyed: DataFrame, windows: DataFrame, min_coverage: float, min_run: int) -> DataFrame:
    """Contaminated texts by digest, with their best item."""
    # At most 8 widths.
    raw = [r[0] for r in windows.filter(F.col("rule") == RAW).select("width").distinct().collect()]

    def cut(batches):
        templates = Templates()
        for batch in batches:
            for keys, texts in _chunks(batch):
                found, words = templates.windows(texts, WINDOW, raw)
                slots = [
                    _flat_slots(words, *w)
                    for w in zip(*(c.tolist() for c in (found.at, found.rule, found.width)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(found.owner)),
                        pa.array(found.at, pa.int64()),
                        pa.array(found.code.view(np.int64)),
                        pa.array(slots, pa.list_(pa.int64())),
                    ],
                    names=["text_key", "at", "code", "slots"],
                )

    mine = (
        keyed.select("text_key", "text").dropDuplicates(["text_key"]).mapInArrow(cut, DOC_WINDOWS)
    )
    hits = mine.join(
        windows.select(
            *(F.col(c).alias(f"item_{c}" if c == "at" else c) for c in PLACE),
            "code",
            F.col("slots").alias("item_slots"),
        ),
        "code",
    )

    def decide(table: pa.Table) -> pa.Table:
        rows = [
            _hit(
                *(r["item_at" if c == "at" else c] for c in PLACE),
                _triples(r["item_slots"]),
                r["at"],
                _triples(r["slots"]),
            )
            for r in table.to_pylist()
        ]
        found = judge(rows, min_coverage, min_run)
        return pa.table(
            {
                "text_key": pa.array([table["text_key"][0].as_py()] * len(found), pa.binary()),
                "item_id": pa.array([x[0] for x in found], pa.int64()),
                "coverage": pa.array([x[1] for x in found], pa.float64()),
                "exact": pa.array([x[2] for x in found], pa.bool_()),
            }
        )

    findings = hits.groupBy("text_key", "item_id").applyInArrow(
        decide, "text_key binary, item_id long, coverage double, exact boolean"
    )
    return findings.groupBy("text_key").agg(
        F.count("*").alias("n_items"),
        F.min_by(F.struct("item_id", "coverage", "exact"), F.struct(-F.col("coverage"), "item_id")).alias("x"),
    )


def _joined(documents: DataFrame, windows: DataFrame, min_coverage: float, min_run: int) -> DataFrame:
    """The same verdicts by a shuffle join of windows and a grouping by text."""
    keyed = documents.withColumn("text_key", _text_key("text"))
    best = _best_items(keyed, windows, min_coverage, min_run)
    return keyed.join(best, "text_key", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.col("x.item_id").alias("item_id"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("x.coverage", F.lit(0.0)).alias("coverage"),
        F.col("x.exact").alias("exact"),
        F.col("n_items").isNull().alias("kept"),
    )


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    min_coverage: float = 0.5,
    max_local_windows: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_run: int = RUN,
) -> DataFrame:
    """Per document: contaminated or not, best item, items found, coverage, exact copy;
    ``kept`` is the opposite of ``contaminated``.

    Coverage counts the item's windows that one or several agreeing placements share; an
    item is found below ``min_coverage``, too, if one of them holds ``min_run`` of its
    template words in a row.
    """
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    windows = item_windows(benchmark)
    held = _few(windows, max_local_windows)
    if held is not None:
        found = _local(rows, held, min_coverage, min_run)
    else:
        found = _joined(rows, windows, min_coverage, min_run)
    return found.withColumnRenamed("doc_id", id_col)


def _few(windows: DataFrame, limit: int) -> list | None:
    """The windows, if there are at most ``limit``."""
    return windows.collect() if windows.count() <= limit else None


def drop_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    min_coverage: float = 0.5,
    max_local_windows: int = 200_000,
    text_col: str = "text",
    min_run: int = RUN,
) -> DataFrame:
    """The rows of ``documents``, all columns, without a benchmark passage."""
    windows = item_windows(benchmark)
    held = _few(windows, max_local_windows)
    if held is None:
        bad = _best_items(
            documents.select(_text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")),
            windows,
            min_coverage,
            min_run,
        ).select("text_key")
        return documents.join(bad, _text_key(text_col) == bad["text_key"], "left_anti")
    place, packed = documents.columns.index(text_col), _packed(held)

    def run(batches):
        judge_ = Judge(packed, min_coverage, min_run)
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(place)] * 2, names=["key", "text"])
            bad = [v[0] for _, texts in _chunks(pair) for v in judge_.verdicts(texts)]
            if bad:
                yield batch.filter(pa.array([not x for x in bad]))

    return documents.mapInArrow(run, documents.schema)


def op7_decontaminate(spark, folder):
    return find_contamination(
        spark.read.parquet(f"{folder}/documents.parquet"),
        spark.read.parquet(f"{folder}/benchmark.parquet"),
    )
