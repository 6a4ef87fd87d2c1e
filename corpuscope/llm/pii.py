"""Personal data: high-recall candidates, boosted trees on format and context, calibrated thresholds."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.boosting import Boosted, binned_table, boosted, fit_boosted_table, matrix, table_cuts
from corpuscope.llm.common import small_batches, whole_text
from corpuscope.session import materialise

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCUMENTS = None  # without effect, as nothing is drawn any more; a test still sets the name
CHUNK = 10_000  # candidates that a task passes on at once
STEPS = 1 << 16  # thresholds are whole multiples of 1 / STEPS, so that the driver gets that many sums a kind and label at most
PRECISION = 0.95  # that a kind's threshold must reach on the held-out candidates
PRIOR = 20.0  # candidates that all kinds' precision counts for where a kind has too few of its own

# The contract's patterns, in forms that take time in proportion to the text: an email is found by its
# @ sign, and runs of digits are taken whole, as no shorter part of a run could match where the whole one does not.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# High-recall generators; their spans may overlap those of other kinds.
WIDE = {
    "email": re.compile(  # from the sign between name and domain on; names have 64 characters at most
        r"\s?(?:@|[(\[]\s?at\s?[)\]])\s?[^\s<>(),;:\"'\[\]]{1,255}(?:\s?[(\[]\s?dot\s?[)\]]\s?[^\s<>(),;:\"'\[\]]{1,255})*"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.,:][0-9]{1,3}){2,5}|[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}"),
    "card": re.compile(r"[0-9](?:[ ./-]{0,2}[0-9]){11,22}"),
    "phone": re.compile(r"(?:\+|\(|\b00)?[0-9](?:[ ()./-]{0,2}[0-9]){5,17}"),
}
NAME = re.compile(r"[^\s<>(),;:\"'\[\]@]+$")
CONTEXT = 24
HINTS = {
    "email": ("mail", "contact", "@"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def is_valid(kind: str, hit: str) -> bool:
    digits = "".join(c for c in hit if "0" <= c <= "9")
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain with a dot."""
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end and (domain := DOMAIN.match(text, at)):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping per kind, failing matches dropped."""
    found = [(0, start, end) for start, end in _emails(text)]
    kinds = () if not DIGIT.search(text) else (1, 2, 3) if "+" in text else (1, 2)
    return found + [
        (k, m.start(), m.end()) for k in kinds for m in BASE[KINDS[k]].finditer(text) if is_valid(KINDS[k], m[0])
    ]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all generators."""
    kinds = [0] if "@" in text or "at)" in text or "at]" in text or "at " in text and ("(" in text or "[" in text) else []
    kinds += [1, 2, 3] if DIGIT.search(text) else []
    found = []
    for k in kinds:
        for m in WIDE[KINDS[k]].finditer(text):
            name = NAME.search(text[max(0, m.start() - 64) : m.start()]) if k == 0 else None
            if k or name:
                found.append((k, m.start() - len(name[0]) if name else m.start(), m.end()))
    return found


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span, and what stands around it."""
    hit = text[start:end]
    digits = "".join(c for c in hit if "0" <= c <= "9")
    groups = [len(g) for g in re.findall("[0-9]+", hit)] or [0]
    parts = [int(p[:6]) for p in re.findall("[0-9]+", hit)] or [0]
    before, behind = text[max(0, start - CONTEXT) : start].lower(), text[end : end + 1]
    domain = hit.rpartition("@")[2]
    return [
        *(float(kind == k) for k in range(len(KINDS))), len(hit), len(digits), len(groups), max(groups), min(groups),
        max(parts), float(luhn(digits)) if digits else 0.0, hit.count("."), hit.count("-"), hit.count(" "), hit.count("@"),
        float(hit.startswith("+")), hit.count("("), hit.count("/"), sum(c.isalpha() for c in hit),
        float("." in domain and not domain.startswith(".") and not domain.endswith(".")),
        float(hit.isascii()), len(domain), float(before[-1:].isalnum()), float(behind.isalnum()),
        *(float(any(h in before for h in HINTS[k])) for k in KINDS),
    ]


class Covered:
    """Spans that are taken, as disjoint ranges in order: each question takes a binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        """A span that overlaps none."""
        i = bisect_right(self.ends, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def covers_base(base: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a candidate covers one of the kind's base spans (in order, not overlapping) and little else."""
    i = bisect_left(base, (start - 1, start - 1))
    while i < len(base) and base[i][1] <= end + 1:
        if base[i][1] - base[i][0] >= 0.8 * (end - start):
            return True
        i += 1
    return False


@dataclass
class Redactor:
    trees: Boosted
    thresholds: list[float]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """The base spans, and candidates above their kind's threshold that touch no span chosen before.

        Of overlapping candidates the likelier wins; ties go to the longer, then to the one further left.
        """
        chosen = base_spans(text)
        found = candidates(text)
        covered = Covered(chosen)
        found = [c for c in found if not covered.overlaps(c[1], c[2])]
        if found:
            odds = self.trees.probability(np.array([features(text, *c) for c in found], float))
            order = sorted(range(len(found)), key=lambda i: (-odds[i], found[i][1] - found[i][2], found[i][1]))
            for i in order:
                kind, start, end = found[i]
                if odds[i] >= self.thresholds[kind] and not covered.overlaps(start, end):
                    covered.add(start, end)
                    chosen.append((kind, start, end))
        return sorted(chosen)


def _lowest(odds: np.ndarray, exact: np.ndarray, precision: float) -> float | None:
    """The last of the falling ``odds`` from which on the precision holds; rows of equal odds stand or fall together."""
    good = np.flatnonzero((exact >= precision) & np.r_[odds[1:] < odds[:-1], np.ones(min(1, len(odds)), bool)])
    return float(max(0.5, odds[good[-1]])) if len(good) else None


def _threshold(
    odds: np.ndarray, labels: np.ndarray, weights: np.ndarray, kinds: np.ndarray, kind: int, precision: float
) -> float:
    """Lowest threshold from which on the precision of the kind's held-out candidates holds.

    A kind that has too few of them to show it takes the precision of all kinds at the same threshold for ``PRIOR``
    candidates of its own. Above 1, so that nothing passes, only if that falls short as well. ``weights`` say how many
    candidates a row stands for.
    """
    order = np.argsort(-odds, kind="stable")
    odds, labels, weights, own = odds[order], labels[order], weights[order], kinds[order] == kind

    def sums(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counted = np.where(rows, weights, 0.0)
        return np.cumsum(counted * labels), np.cumsum(counted)

    right, seen = sums(own)
    # Laplace's rule keeps a handful of lucky rows from deciding.
    found = _lowest(odds[own], ((right + 1) / (seen + 2))[own], precision)
    if found is None:
        all_right, all_seen = sums(np.ones(len(odds), bool))
        pooled = (all_right + 1) / (all_seen + 2)
        found = _lowest(odds, (right + PRIOR * pooled) / (seen + PRIOR), precision)
    return 2.0 if found is None else found


def labelled_candidates(docs: DataFrame) -> DataFrame:
    """The candidates of all documents (text): held_out, kind, y, x (the features) and n, how often these occur.

    The validated fixed patterns are the labels: a candidate that covers what one of them found, and little else, is
    positive. The hash of the text decides which documents train and which calibrate, so equal texts are on one side.
    """
    names = ["held_out", "kind", "y", "x"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bool, int, int, list[float]]] = []

        def chunk() -> pa.RecordBatch:
            types = pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32())
            columns = [pa.array(column, t) for column, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for text, held_out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                if not (found := candidates(text)):
                    continue
                by_kind: list[list[tuple[int, int]]] = [[] for _ in KINDS]
                for kind, start, end in sorted(base_spans(text)):
                    by_kind[kind].append((start, end))
                for kind, start, end in found:
                    x = [int(v) for v in features(text, kind, start, end)]
                    rows.append((held_out, kind, int(covers_base(by_kind[kind], start, end)), x))
                    if len(rows) == CHUNK:
                        yield chunk()
        if rows:
            yield chunk()

    part = F.shiftrightunsigned(F.xxhash64("text", F.lit(11)), 32).bitwiseAND(1) == 1
    found = docs.select("text", part.alias("held_out")).mapInArrow(extract, "held_out boolean, kind int, y int, x array<int>")
    return found.groupBy(*names).agg(F.count("*").alias("n"))


def fit_redactor(docs: DataFrame) -> Redactor:
    """Trees and thresholds from all candidates of all documents (text).

    Trees learn from the candidates that are not held out, equal ones as one row with their number; a threshold of each
    kind comes from those that are. Tables stay on the executors: the driver gets the features' cuts, the sums of each
    level of a tree, and the held-out candidates' numbers by kind, label and odds in steps of 1 / ``STEPS``. A feature has
    a million values at most, but for an email's length and what it counts in it.
    """
    found = materialise(labelled_candidates(docs), "candidates")
    cuts = table_cuts(found.where(~F.col("held_out")), F.col("kind"))
    binned = materialise(binned_table(found, cuts, ["held_out", "kind"]), "binned")
    trees, coarse = fit_boosted_table(binned.where(~F.col("held_out")), cuts)
    plain, width = astuple(coarse), len(cuts)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = boosted(plain)
        for batch in batches:
            odds = model.probability(matrix(batch.column("x"), width))
            steps = pa.array(np.floor(odds * STEPS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("y"), steps, batch.column("n")], names=["kind", "y", "step", "n"])

    seen = binned.where("held_out").mapInArrow(step, "kind int, y int, step int, n long").groupBy("kind", "y", "step").agg(
        F.sum("n").alias("n")).orderBy("kind", "step", "y").toArrow()
    kinds, y, steps, n = (seen.column(name).to_numpy() for name in ("kind", "y", "step", "n"))
    return Redactor(trees, [_threshold(steps / STEPS, y, n.astype(float), kinds, k, PRECISION) for k in range(len(KINDS))])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of structs (kind, start, end), both by kind, then start.

    ``kind`` numbers ``KINDS``; offsets are code points, the end is exclusive. ``base`` holds the validated matches of
    the fixed patterns, ``spans`` those and the candidates that the trees add. NULL texts count as empty. Ids may be
    NULL or repeat; further columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession, 4)
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    # Lists alone: broadcasts do not carry classes to executors without this package.
    shared = docs.sparkSession.sparkContext.broadcast(astuple(fit_redactor(slim)))
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda rows: [{"kind": k, "start": s, "end": e} for k, s, e in rows]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, thresholds = shared.value
        redactor = Redactor(boosted(trees), thresholds)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([named(base_spans(t)) for t in texts], span),
                 pa.array([named(redactor.spans(t)) for t in texts], span)],
                names=["doc_id", "base", "spans"],
            )

    id_type = slim.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind: int, start: int, end: int>>"
    return slim.mapInArrow(find, f"doc_id {id_type}, base {spans}, spans {spans}")
