"""Toxicity by a learned lexicon, matched with spelling errors and judged in context.

Fitting takes labelled documents (a bounded sample, ``max_train``): words, and stems that
several words start with, become terms if they are far commoner in toxic documents. The
terms form a trie. Its intersection with Levenshtein automata is built once as one table
of states, so that matching a word with an error costs one lookup per letter, for all
words of a chunk at once. A hit counts by its context: quotation marks around it and
words of reporting near it speak for quotation, words of address for abuse. A logistic
model turns the counts of hits into a score.

Words within one error of a term that clean training documents hold are entered as
harmless. Labels, language, source and key are never inputs of a score.

Cases: a null or empty text has no hits and gets the score of a text without hits; a null
key is scored and counts as not held out; repeated rows are scored alike; rows without a
label do not train; without a toxic training document there is no term and every score is
the smoothed share of toxic ones; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilane.llm.words import release
from epilane.session import Scratch

FOLDS = 5
SHORTEST = 3  # letters of a term
# Words of reporting and words of address.
REPORTING = (
    "said says called calls wrote quote quoted word term phrase dit écrit mot sagte nannte"
    " wort dijo palabra llamó"
).split()
ADDRESS = "you your yours u ur you're toi tu vous ton du dich dir dein usted ustedes vos".split()
QUOTES = '"“”„«»'
BREAKS = " \t\n\r\x0b\x0c.,;:!?()[]{}<>|/\\…—–-'’" + QUOTES
WINDOW = 6
MISSPELT = 0.7  # what a hit with an error is worth
TOXIC, HARMLESS, REPORTS, ADDRESSES = range(4)
FEATURES = ("any", "log_hits", "plain", "quoted", "misspelt", "addressed", "share", "weight")
# Ridge towards these: a quotation counts less than a plain hit.
PRIOR = np.array([1.0, 0.5, 1.0, -0.5, 0.0, 0.5, 0.0, 0.5])


@dataclass
class Entry:
    text: str
    kind: int
    weight: float = 0.0
    stem: bool = False
    errors: int = 0


class Matcher:
    """Trie of entries with up to one error, as a table of states over letter classes."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, entry in enumerate(entries):
            node = 0
            for c in entry.text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                node = children[node][c]
            ends[node].append(i)
        letters = sorted({c for e in entries for c in e.text})
        self.letters = letters
        classes = [*letters, None]  # None: any other letter
        depth = max((len(e.text) for e in entries), default=0)
        self.depth = depth + 2

        # A state is a set of (node, errors so far), and the best stem seen on the way.
        def spread(places):
            best: dict[int, int] = {}
            stack = list(places)
            while stack:
                node, errors = stack.pop()
                if best.get(node, 9) <= errors:
                    continue
                best[node] = errors
                if errors < 1:
                    stack += [(child, errors + 1) for child in children[node].values()]
            return frozenset(best.items())

        def hit(places, stems):
            found = [
                (errors, entries[i].kind != HARMLESS, i)
                for node, errors in places
                for i in ends[node]
                if entries[i].stem == stems and errors <= entries[i].errors
            ]
            return min(found, default=None)

        start = (spread([(0, 0)]), None)
        numbers, queue, rows, accepts = {start: 0}, [start], [], []
        while queue:
            places, stem = queue.pop(0)
            whole = hit(places, False)
            accepts.append(min([x for x in (whole, stem) if x is not None], default=None))
            row = []
            for c in classes:
                step = []
                for node, errors in places:
                    if c in children[node]:
                        step.append((children[node][c], errors))
                    if errors < 1:
                        step.append((node, errors + 1))
                        step += [(child, errors + 1) for child in children[node].values()]
                after = spread(step)
                found = hit(after, True)
                kept = min([x for x in (stem, found) if x is not None], default=None)
                state = (after, kept)
                if state not in numbers:
                    numbers[state] = len(numbers)
                    queue.append(state)
                row.append(numbers[state])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.entry = np.array([-1 if x is None else x[2] for x in accepts], np.int32)
        self.error = np.array([0 if x is None else x[0] for x in accepts], np.int8)
        dead = numbers.get((frozenset(), None), -1)
        self.dead = dead

    def run(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Entry (or -1) and errors of every word, from the class of each letter."""
        state = np.zeros(len(starts), np.int32)
        live = np.arange(len(starts))
        for k in range(self.depth):
            live = live[sizes[live] > k]
            if len(live) == 0:
                break
            after = self.table[state[live], letters[starts[live] + k]]
            state[live] = after
            live = live[after != self.dead]
        # A word longer than every entry can only hold a stem.
        return self.entry[state], self.error[state]


@dataclass
class Model:
    entries: list[Entry]
    rate: float
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -3.0


class Scorer:
    """Features of many texts at once."""

    def __init__(self, model: Model, matcher: Matcher):
        self.model = model
        self.matcher = matcher
        self.classes = np.full(0x110000, len(self.matcher.letters), np.uint8)
        for i, c in enumerate(self.matcher.letters):
            self.classes[ord(c)] = i
        self.breaks = np.zeros(0x110000, bool)
        self.breaks[[ord(c) for c in BREAKS]] = True
        self.breaks[0x85] = self.breaks[0xA0] = True
        self.quotes = np.zeros(0x110000, bool)
        self.quotes[[ord(c) for c in QUOTES]] = True
        self.kinds = np.array([e.kind for e in model.entries] or [HARMLESS], np.int8)
        self.term_weights = np.array([e.weight for e in model.entries] or [0.0])

    def hits(self, texts: list[str]):
        """Text number, entry, errors, quotation and address of every toxic hit, words per
        text, and the hit words."""
        lowered = [t.lower() for t in texts]
        joined = "\n".join(lowered) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in lowered])
        off = self.breaks[points]
        first = np.flatnonzero(~off & np.concatenate([[True], off[:-1]]))
        stop = np.flatnonzero(off & np.concatenate([[False], ~off[:-1]]))
        owner = np.searchsorted(ends, first, side="right")
        entry, error = self.matcher.run(self.classes[points], first, stop - first)
        kind = np.where(entry >= 0, self.kinds[entry], -1)
        at = np.flatnonzero(kind == TOXIC)
        starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        low = np.maximum(at - WINDOW, starts[owner[at]])
        high = np.minimum(at + WINDOW + 1, starts[owner[at] + 1])

        def near(which):
            sums = np.concatenate([[0], np.cumsum(kind == which)])
            return sums[high] > sums[low]

        # Quotation is within a line, so that a stray mark inverts no more than its line.
        marks = np.concatenate([[0], np.cumsum(self.quotes[points])])
        lines = np.flatnonzero(points == 10)
        line = np.searchsorted(lines, first[at])
        base = np.where(line > 0, lines[np.maximum(line - 1, 0)], 0)
        before = marks[first[at]] - marks[base]
        left = marks[lines[line]] - marks[first[at]]
        quoted = ((before % 2 == 1) & (left > 0)) | near(REPORTS)
        words = [joined[a:b] for a, b in zip(first[at].tolist(), stop[at].tolist(), strict=True)]
        return owner[at], entry[at], error[at], quoted, near(ADDRESSES), np.diff(starts), words

    def features(self, texts: list[str]) -> np.ndarray:
        owner, entry, error, quoted, address, n_words, _ = self.hits(texts)
        n = len(texts)

        def count(which):
            return np.bincount(owner[which], minlength=n).astype(float)

        hits = count(np.ones(len(owner), bool))
        worth = self.term_weights[entry] * np.where(error > 0, MISSPELT, 1.0)
        weight = np.zeros(n)
        np.maximum.at(weight, owner, worth)
        plain = np.bincount(owner, weights=worth * ~quoted, minlength=n)
        return np.stack(
            [
                hits > 0,
                np.log1p(hits),
                np.log1p(plain),
                np.log1p(count(quoted)),
                np.log1p(count(error > 0)),
                np.log1p(count(address)),
                np.minimum(10 * hits / np.maximum(n_words, 1), 1.0),
                weight,
            ],
            1,
        )

    def scores(self, texts: list[str]) -> np.ndarray:
        if not any(e.kind == TOXIC for e in self.model.entries):
            return np.full(len(texts), self.model.rate)
        raw = self.features(texts) @ self.model.weights + self.model.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _chunks(batch, limit: int = 1 << 20):
    """Slices of a (key, text) batch with about ``limit`` bytes of text."""
    release()
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit)))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(1).to_pylist()]
        start = stop


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    rest = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))
    return F.coalesce(rest == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """``label`` and ``text`` of at most about ``max_train`` labelled rows, by key hash."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    usable = usable.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("label"))
    n = usable.count()
    if n > max_train:
        usable = usable.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(max_train / n * (1 << 30)))
    # At most about max_train rows of two numbers each.
    return documents.select(
        F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text")
    ).join(F.broadcast(usable), "key")


def _terms(rows: DataFrame, n_toxic: int, n_clean: int, min_docs: int, min_odds: float):
    """All words and stems over the thresholds, by their documents among toxic and clean
    ones. The sample bounds their number: each takes ``min_docs`` of its toxic documents."""
    words = F.filter(
        F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}@*$#]+"), lambda w: F.char_length(w) >= SHORTEST
    )
    # Copies of one document would make any of its words a term; a term must have several
    # following words, so each document gives one of them.
    pairs = rows.select("label", "key", words.alias("words")).select(
        "label",
        "key",
        F.explode(F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")).alias("next"))).alias("x"),
    )
    single = pairs.select("label", "key", F.col("x.words").alias("word"), F.col("x.next").alias("next"))
    stems = single.select(
        "label", "key", "word", "next", F.explode(F.sequence(F.lit(4), F.lit(6))).alias("size")
    ).filter(F.char_length("word") > F.col("size"))
    stems = stems.select(
        "label", "key", F.substring("word", F.lit(1), F.col("size")).alias("stem"), "word", "next"
    )

    def count(df, text, kind):
        return (
            df.groupBy(text, "key", "label")
            .agg(F.min("next").alias("next"), F.min(kind).alias("kind"))
            .groupBy(text)
            .agg(
                F.sum("label").alias("toxic"),
                F.count("*").alias("docs"),
                F.approx_count_distinct("next").alias("nexts"),
                F.approx_count_distinct("kind").alias("kinds"),
            )
            .filter((F.col("toxic") >= min_docs) & (F.col("nexts") >= min_docs))
        )

    counted, by_stem = count(single, "word", "word"), count(stems, "stem", "word")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log(
        (F.col("docs") - F.col("toxic") + 0.5) / (n_clean + 1)
    )

    def best(df, text, stem):
        return (
            df.withColumn("odds", odds)
            .filter(F.col("odds") >= min_odds)
            .select(F.col(text).alias("text"), "odds", "toxic", F.lit(stem).alias("stem"))
        )

    found = best(counted, "word", False).unionByName(best(by_stem.filter("kinds >= 8"), "stem", True))
    return found.orderBy(F.desc(F.col("odds") * F.col("toxic")), "text").collect()


def _fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a ridge towards ``PRIOR``."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    centre = np.concatenate([PRIOR, [-3.0]])
    ridge = np.concatenate([np.full(len(PRIOR), 1.0), [0.01]])
    w = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (p - y) + ridge * (w - centre)
        bend = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    max_train: int = 8_000,
    min_docs: int = 8,
    min_share: float = 0.01,
    min_odds: float = 3.0,
) -> Model:
    """Learn terms, harmless neighbours and weights from a bounded sample of rows.

    A term occurs in ``min_docs`` toxic training documents and in ``min_share`` of them.
    Whether it is also found with an error depends on what the sample holds near it (see
    ``_neighbours``). The sample is written once; it bounds the terms, the words near them
    and the row of numbers per training document that come to the driver.
    """
    with Scratch(documents.sparkSession) as scratch:
        rows = scratch.table(training_rows(documents, labels, max_train), "training")
        return _fit(rows, min_docs, min_share, min_odds)


def _fit(rows: DataFrame, min_docs: int, min_share: float, min_odds: float) -> Model:
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    context = [Entry(w, REPORTS) for w in REPORTING] + [Entry(w, ADDRESSES) for w in ADDRESS]
    if n_toxic == 0:
        return Model(context, rate=min(rate, 0.49))
    least = max(min_docs, int(np.ceil(min_share * n_toxic)))
    found = _terms(rows, n_toxic, n_clean, least, min_odds)
    words = [r for r in found if not r["stem"]]
    stems: list[str] = []
    for r in sorted((r for r in found if r["stem"]), key=lambda r: (len(r["text"]), r["text"])):
        # A stem that is mostly one word is that word.
        led = max((w["toxic"] for w in words if w["text"].startswith(r["text"])), default=0)
        if 2 * led < r["toxic"] and not r["text"].startswith(tuple(stems)):
            stems.append(r["text"])
    top = max((r["odds"] for r in found), default=1.0)
    terms = []
    for r in found:
        if r["stem"] and r["text"] in stems:
            terms.append(Entry(r["text"], TOXIC, r["odds"] / top, True, 1))
        elif not r["stem"] and not r["text"].startswith(tuple(stems)):
            terms.append(Entry(r["text"], TOXIC, r["odds"] / top, False, 1))
    taken = {e.text for e in terms}
    model = Model(terms + [e for e in context if e.text not in taken], rate=rate)
    model.entries += _neighbours(rows, model, taken)

    matcher = Matcher(model.entries)

    def measure(batches):
        scorer = Scorer(model, matcher)
        for batch in batches:
            for part, texts in _chunks(batch):
                x = scorer.features(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))],
                    names=["label", *FEATURES],
                )

    schema = "label int, " + ", ".join(f"`{f}` double" for f in FEATURES)
    sample = rows.select("label", "text").mapInArrow(measure, schema).toPandas()
    model.weights, model.bias = _fit_weights(
        sample[list(FEATURES)].to_numpy(), sample["label"].to_numpy(float)
    )
    return model


def _neighbours(rows: DataFrame, model: Model, taken: set[str]) -> list[Entry]:
    """Words with an error against a term that clean training documents hold, as harmless
    entries. A term with more such words than misspellings in toxic documents only is too
    close to the common vocabulary and is found without errors from then on."""
    matcher = Matcher(model.entries)

    def near(batches):
        scorer = Scorer(model, matcher)
        for batch in batches:
            for part, texts in _chunks(batch):
                owner, entry, error, _, _, _, words = scorer.hits(texts)
                label = part.column(0).to_numpy(zero_copy_only=False)[owner]
                hits = zip(entry.tolist(), words, label.tolist(), error.tolist(), strict=True)
                held = sorted({(e, w, y) for e, w, y, wrong in hits if wrong > 0})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([e for e, _, _ in held], pa.int32()),
                        pa.array([w for _, w, _ in held], pa.string()),
                        pa.array([y for _, _, y in held], pa.int32()),
                    ],
                    names=["entry", "word", "label"],
                )

    found = (
        rows.select("label", "text")
        .mapInArrow(near, "entry int, word string, label int")
        .groupBy("entry", "word")
        .agg(F.min("label").alias("label"))
        .collect()
    )
    clean, wrong = Counter(), Counter()
    harmless = set()
    for r in found:
        if r["label"] == 0 and r["word"] not in taken:
            clean[r["entry"]] += 1
            harmless.add(r["word"])
        else:
            wrong[r["entry"]] += 1
    for i, entry in enumerate(model.entries):
        if entry.kind == TOXIC and clean[i] > wrong[i] + 1:
            entry.errors = 0
    return [Entry(w, HARMLESS) for w in sorted(harmless)]


def score_toxicity(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``score`` and ``predicted`` per row, from its whole text."""

    matcher = Matcher(model.entries)

    def run(batches):
        scorer = Scorer(model, matcher)
        for batch in batches:
            for part, texts in _chunks(batch):
                scores = scorer.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, score double, predicted int")


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, that are not predicted toxic."""
    place, matcher = documents.columns.index(text_col), Matcher(model.entries)

    def run(batches):
        scorer = Scorer(model, matcher)
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(place)] * 2, names=["key", "text"])
            scores = [scorer.scores(texts) for _, texts in _chunks(pair)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return documents.mapInArrow(run, documents.schema)


def op3_toxicity(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit_toxicity(documents, labels)
    return score_toxicity(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted"
    )
