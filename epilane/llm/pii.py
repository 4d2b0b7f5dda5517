"""Personal data by patterns and a semi-Markov conditional random field.

Patterns with checks give the base spans. The field looks at the stretches around digits
and at signs once more: every run of up to ``MAX_ATOMS`` atoms (words, numbers, signs) is
a candidate segment for each kind that its letters allow, scored as a whole (digits,
groups, separators, checks, words before it, what touches it). Dynamic programming over
the atoms picks segments and kinds jointly. Its weights are fitted to the base spans of a
bounded sample and to disguised copies of them (no plus sign, other separators, "(at)"),
by the likelihood of the whole segmentation, so it adds what the patterns miss. Found
spans that touch a base span are dropped; base spans always stay.

Cases: a null or empty text has no spans; a null key is kept; repeated rows are handled
alike; texts without digits, at signs and bracketed dots are skipped; without a base span
in the sample the starting weights are used; other columns pass through ``redact``; an
empty table gives an empty result. A stretch goes on while the next digit or sign is near,
however long it gets, so no segment is cut.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 24
# The base patterns. An email is found from its at sign.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot) ?[)\]}]")
ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
DISGUISED_AT = re.compile(r" ?[(\[{] ?at ?[)\]}] ?")
DISGUISED_DOT = re.compile(r" ?[(\[{] ?dot ?[)\]}] ?")
DOT_BEFORE = re.compile(r"[(\[{] ?dot ?[)\]}] ?$")
DIGIT_BESIDE = re.compile(r"[0-9][ .-]$")
DIGIT_NEXT = re.compile(r"[ .-][0-9]")
ABROAD = re.compile(r"\+(?!1\b)([0-9]{1,3})( [0-9]+(?: [0-9]+){2,})")
CUES = {
    "email": re.compile(r"(mail|contact|write|reach)\W*\w*\W*$", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|addr|from)\W*\w*\W*$", re.I),
    "card": re.compile(r"(card|visa|mastercard|amex|credit|carte|karte|tarjeta)\W*\w*\W*$", re.I),
    "phone": re.compile(r"(tel|phone|call|mobile|fax|cell|whatsapp|llama|appel)\W*\w*\W*$", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base span, in order."""
    found = []
    at, taken = text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            taken = match.end()
        at = text.find("@", max(at + 1, taken))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def stretches(text: str, reach: int = 2) -> list[tuple[int, int]]:
    """Places of tokens with a digit, an at sign or a bracketed dot, with ``reach`` tokens
    on either side; places that touch are one stretch.
    """
    out: list[list[int]] = []
    token = 0  # end of the last trigger's token
    for m in TRIGGER.finditer(text):
        if m.end() <= token:
            continue
        start, end = m.start(), m.end()
        low = out[-1][1] if out else 0
        for _ in range(reach + 1):
            while start > low and not text[start - 1].isspace():
                start -= 1
            if start > low and _ < reach:
                start -= 1
        for _ in range(reach + 1):
            while end < len(text) and not text[end].isspace():
                end += 1
            if not _:
                token = end
            if end < len(text) and _ < reach:
                end += 1
        if out and start <= low:
            out[-1][1] = max(end, low)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def sample_pieces(text: str, limit: int = 400) -> list[str]:
    """The stretches of a text, those over ``limit`` letters in parts, for the fit.

    Parts end at white space outside base spans, where there is one.
    """
    out = []
    for low, high in stretches(text):
        piece = text[low:high]
        if len(piece) <= limit:
            out.append(piece)
            continue
        spans, at, last, k = base_spans(piece), 0, 0, 0
        for m in re.finditer(r"\s", piece):
            while k < len(spans) and spans[k][2] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < m.start():
                continue
            if m.start() - at > limit and last > at:
                out.append(piece[at:last])
                at = last
            last = m.start()
        if len(piece) - at > limit and last > at:
            out.append(piece[at:last])
            at = last
        out.append(piece[at:])
    return [p for p in out if len(p) <= limit]


class Lattice:
    """Candidate segments of a stretch: (first atom, last atom + 1, kind, features)."""

    def __init__(self, text: str):
        self.cuts = [0]
        self.atoms = []
        for m in ATOM.finditer(text):
            self.atoms.append(m.group())
            self.cuts.append(m.end())
        self.text = text

    @cached_property
    def candidates(self) -> list[tuple]:
        return list(self.segments())

    def segments(self):
        """The candidates one after another; long stretches do not hold them all."""
        text = self.text
        for i, atom in enumerate(self.atoms):
            if not (atom[0].isalnum() or atom in "+("):
                continue
            for j in range(i + 1, min(i + MAX_ATOMS, len(self.atoms)) + 1):
                last = self.atoms[j - 1]
                if "\n" in last:
                    break
                if not last[0].isalnum():
                    continue
                piece = text[self.cuts[i] : self.cuts[j]]
                if len(piece) > 80:
                    break
                for kind in allowed(piece):
                    names = features(text, self.cuts[i], self.cuts[j], piece, kind)
                    yield i, j, kind, names


SIMPLE = re.compile(r"[0-9 ().+/-]+")
EMAIL_LIKE = re.compile(r"[^\s@]+@[^\s@]+")


def allowed(piece: str) -> list[int]:
    """Kinds that the letters of a segment allow."""
    if SIMPLE.fullmatch(piece):
        kinds = []
        n = len(_digits(piece))
        if piece[0].isdigit() and piece.count(".") == 3 and re.fullmatch(r"[0-9.]+", piece):
            kinds.append(1)
        if piece[0].isdigit() and 12 <= n <= 19 and re.fullmatch(r"[0-9 -]+", piece):
            kinds.append(2)
        if 7 <= n <= 15:
            kinds.append(3)
        return kinds
    if piece[0].isalnum() and (EMAIL_LIKE.fullmatch(piece) or DISGUISED_AT.search(piece)):
        return [0]
    return []


def features(text: str, start: int, end: int, piece: str, kind: int) -> list[str]:
    """Names of the whole-span features of a segment, for one kind."""
    n = len(_digits(piece))
    out = ["bias"]
    if kind == 0:
        plain = DISGUISED_DOT.sub(".", DISGUISED_AT.sub("@", piece))
        local, _, domain = plain.partition("@")
        whole = DOMAIN.fullmatch(domain) is not None and bool(local) and set(local) <= LOCAL
        out += [f"shape={whole}", f"tld={bool(re.search(r'[.][A-Za-z]{2,10}$', domain))}"]
    else:
        groups = re.split(r"[^0-9]+", piece.strip("+() "))
        out += [f"digits={n}", f"groups={min(len(groups), 6)}"]
        signs = "".join(sorted(set(re.sub(r"[0-9]", "", piece))))
        out.append(f"signs={signs}")
        if kind == 1:
            out.append(f"range={all(len(g) < 4 and g and int(g) < 256 for g in groups)}")
        if kind == 2:
            out += [f"luhn={luhn(_digits(piece))}", f"even={len({len(g) for g in groups[:-1]}) <= 1}"]
        if kind == 3:
            sizes = [len(g) for g in groups]
            out += [
                f"plus={piece[0] == '+'}",
                f"tail={sizes[-1]}",
                f"middle={sizes[-2] if len(sizes) > 1 else 0}",
                f"paren={'(' in piece and ')' in piece}",
                f"open={piece.count('(') == piece.count(')')}",
            ]
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == 0 and DISGUISED_DOT.match(text, end):
        after = "a"  # the address goes on
    if kind == 0 and DOT_BEFORE.search(text[max(0, start - 10) : start]):
        before = "a"
    out.append(f"left={_touch(before)}")
    out.append(f"right={_touch(after)}{_touch(text[end + 1 : end + 2]) if after in '.,-' else ''}")
    if kind:
        # Does a further group of digits stand beside it?
        more = DIGIT_BESIDE.search(text[max(0, start - 3) : start]), DIGIT_NEXT.match(text, end)
        out += [f"from={more[0] is not None}", f"on={more[1] is not None}"]
    cue = CUES[KINDS[kind]].search(text[max(0, start - 30) : start])
    out.append(f"cue={cue is not None}")
    return [f"{KINDS[kind]}:{f}" for f in out]


def _touch(c: str) -> str:
    if not c or c.isspace():
        return "space"
    if c.isdigit():
        return "digit"
    return "letter" if c.isalpha() else "sign"


# Starting weights, before any fit.
START = {
    **{f"{k}:bias": -6.0 for k in KINDS},
    "email:shape=True": 7.0,
    "email:shape=False": -7.0,
    "ip:range=True": 7.0,
    "ip:range=False": -7.0,
    "card:luhn=True": 6.5,
    "card:luhn=False": -7.0,
    "phone:plus=True": 3.0,
    "phone:open=False": -5.0,
    "phone:tail=4": 1.5,
    "phone:middle=3": 1.5,
    **{f"{k}:cue=True": 1.5 for k in KINDS},
    **{f"{k}:{side}={what}": -6.0 for k in KINDS for side in ("left", "right") for what in ("digit", "letter")},
}


def _scores(lattice: Lattice, weights: dict[str, float]) -> list[float]:
    return [sum(weights.get(f, 0.0) for f in c[3]) for c in lattice.candidates]


def best_segments(lattice: Lattice, weights: dict[str, float], floor: float = 0.0):
    """Segments (first, last + 1, kind) of the best segmentation; plain atoms score 0."""
    n = len(lattice.atoms)
    by_end: dict[int, list] = {}
    for i, j, kind, names in lattice.segments():
        score = sum(weights.get(f, 0.0) for f in names)
        if score > floor:
            by_end.setdefault(j, []).append((i, score, kind))
    if not by_end:
        return []
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for i, score, kind in by_end.get(j, ()):
            if value[i] + score > value[j]:
                value[j], back[j] = value[i] + score, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _log_sum(a: float, b: float) -> float:
    low, high = min(a, b), max(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _gradient(lattice: Lattice, weights, gold) -> dict[str, float]:
    """Features of the gold segmentation minus their expectation."""
    n = len(lattice.atoms)
    scores = _scores(lattice, weights)
    ends: dict[int, list] = {}
    starts: dict[int, list] = {}
    for k, c in enumerate(lattice.candidates):
        ends.setdefault(c[1], []).append(k)
        starts.setdefault(c[0], []).append(k)
    ahead = [0.0] + [-math.inf] * n
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for k in ends.get(j, ()):
            ahead[j] = _log_sum(ahead[j], ahead[lattice.candidates[k][0]] + scores[k])
    behind = [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in starts.get(i, ()):
            behind[i] = _log_sum(behind[i], behind[lattice.candidates[k][1]] + scores[k])
    out: dict[str, float] = {}
    for k, (i, j, kind, names) in enumerate(lattice.candidates):
        share = math.exp(min(ahead[i] + scores[k] + behind[j] - ahead[n], 0.0))
        change = ((i, j, kind) in gold) - share
        if abs(change) > 1e-6:
            for f in names:
                out[f] = out.get(f, 0.0) + change
    return out


def _disguise(text: str, start: int, end: int, kind: int, pick: int) -> tuple[str, int]:
    """A span written as the patterns do not find it; its new text and shift of start."""
    piece = text[start:end]
    if kind == 0:
        signs = [(" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")][pick % 3]
        return piece.replace("@", signs[0]).replace(".", signs[1]) if pick % 2 else piece.replace("@", signs[0]), 0
    if kind == 3:
        digits = _digits(piece)
        if pick % 3 == 0:
            return piece.lstrip("+"), 0
        abroad = ABROAD.fullmatch(piece)
        if abroad:
            return (f"0{abroad[2][1:]}" if pick % 3 == 1 else f"00{abroad[1]}{abroad[2]}"), 0
        local = digits[-10:]
        sign = "-. "[pick % 3]
        return f"{local[:3]}{sign}{local[3:6]}{sign}{local[6:]}" if len(local) == 10 else piece.lstrip("+"), 0
    return piece, 0


def fit_segments(samples: list[str], rounds: int = 5, rate: float = 0.3, ridge: float = 0.02) -> dict[str, float]:
    """Weights of the field from stretches of text, by stochastic gradient steps.

    Each stretch is seen as it is, and with its base spans disguised.
    """
    examples = []
    for k, text in enumerate(samples):
        spans = base_spans(text)
        kept, last = [], 0
        for s, kind, e in spans:
            if s >= last:
                kept.append((s, kind, e))
                last = e
        for disguised in (False, True):
            out, gold, at = "", set(), 0
            for s, kind, e in kept:
                out += text[at:s]
                piece = _disguise(text, s, e, kind, k)[0] if disguised else text[s:e]
                gold.add((len(out), len(out) + len(piece), kind))
                out += piece
                at = e
            out += text[at:]
            lattice = Lattice(out)
            place = {c: i for i, c in enumerate(lattice.cuts)}
            atoms = {(place[s], place[e], kind) for s, e, kind in gold if s in place and e in place}
            if lattice.candidates:
                examples.append((lattice, atoms))
    weights = dict(START)
    for r in range(rounds):
        for lattice, gold in examples:
            step = rate / (1 + r)
            for f, change in _gradient(lattice, weights, gold).items():
                now = weights.get(f, 0.0)
                weights[f] = now + step * (change - ridge * (now - START.get(f, 0.0)))
    return weights


def all_spans(text: str, weights: dict[str, float]) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) of base and added spans, in order."""
    if not TRIGGER.search(text):
        return []
    found = [(*s, True) for s in base_spans(text)]
    covered = sorted((s, e) for s, _, e, _ in found)
    for low, high in stretches(text):
        piece = text[low:high]
        lattice = Lattice(piece)
        for i, j, kind in best_segments(lattice, weights):
            start, end = low + lattice.cuts[i], low + lattice.cuts[j]
            if not any(s < end and start < e for s, e in covered):
                found.append((start, kind, end, False))
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)


def fit_pii(
    documents: DataFrame, max_documents: int = 20_000, max_stretches: int = 600, text_col: str = "text"
) -> dict[str, float]:
    """Fit the field on stretches of a sample of about ``max_documents`` texts.

    At most ``max_stretches`` stretches come to the driver.
    """
    n = documents.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(text.alias("text"))
    if n > max_documents:
        share = int(max_documents / n * (1 << 30))
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share)
    rows = rows.filter(F.col("text").rlike("[0-9@]"))

    def cut(batches):
        for batch in batches:
            held = []
            for t in batch.column(0).to_pylist():
                held += sample_pieces(t)[:5]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["piece"])

    pieces = rows.mapInArrow(cut, "piece string").distinct()
    chosen = pieces.orderBy(F.xxhash64("piece"), "piece").limit(max_stretches).collect()
    return fit_segments([r["piece"] for r in chosen])


def find_pii(
    documents: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Key and ``spans`` of every row, in code points, from its whole text."""

    def run(batches):
        for batch in batches:
            spans = []
            for text in batch.column(1):
                found = all_spans(text.as_py() or "", weights)
                spans.append(
                    [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in found]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, SPAN_TYPE)], names=[id_col, "spans"]
            )

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, spans {SPANS}")


def redact(
    documents: DataFrame, weights: dict[str, float], text_col: str = "text", size_col: str = "n_chars"
) -> DataFrame:
    """``documents`` with every span replaced by its kind in capitals, ``<EMAIL>``.

    ``size_col``, if there, becomes the length of the new text; null texts stay null.
    """

    def clean(text):
        if text is None:
            return None
        out, at = [], 0
        for start, kind, end, _ in all_spans(text, weights):
            if end <= at:
                continue
            out += [text[at : max(start, at)], f"<{KINDS[kind].upper()}>"]
            at = end
        return "".join([*out, text[at:]]) if out else text

    place = documents.columns.index(text_col)
    names = documents.columns

    def run(batches):
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column(place)], pa.string())
            columns = [texts if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = documents.mapInArrow(run, documents.schema)
    if size_col in names:
        kind = documents.schema[size_col].dataType
        out = out.withColumn(
            size_col,
            F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(
                F.char_length(text_col).cast(kind)
            ),
        )
    return out


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of base spans, and all spans as text."""
    def text(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
            ),
            ",",
        )

    def of_kind(kind):
        return F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))

    base = F.filter("spans", lambda x: x["base"])
    return found.select(
        id_col,
        *(
            F.size(of_kind(kind)).cast("long").alias(f"n_{kind}")
            for kind in KINDS
        ),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op4_pii(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return span_digests(find_pii(documents, fit_pii(documents)))
