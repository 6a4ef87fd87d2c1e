"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuscope.llm.common import small_batches, whole_text
from corpuscope.session import materialise

MAX_DOCUMENTS = 12_000  # labelled documents that the fit may read, half of them of either label if there are so many
MAX_SEGMENTS = 30_000  # sentences that the field is fitted on, half of them with a labelled token if there are so many
BUCKETS = 1 << 20  # hashed word features; fixes the size of the model
MIN_DOCUMENTS = 4  # toxic documents that a feature must occur in to count
TOXIC_ODDS = 1.0  # log odds from which a token of a toxic document is labelled toxic

WINDOW_TOKENS = 64  # at least so many tokens of a long sentence are run at a time, with overlap on either side
FORGOTTEN = 1e-9  # change of a token's log odds that the ends of the overlap may cause

TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
SENTENCE_ENDS = frozenset(".!?\n")
LEVELS = np.array([0.5, 1.5, 2.5, 4.0])  # of a token's log odds
N_FEATURES = len(LEVELS) + 3  # bias, level of the token, evidence before and behind it


def _features_of(word: str) -> tuple[int, int, int]:
    """Buckets of the word, and of its first four and five letters: stems recur with other endings."""
    return tuple(xxhash.xxh3_64_intdigest(f"{k}:{word[:k] if k else word}") % BUCKETS for k in (0, 4, 5))


class Evidence:
    """Log odds of words: the largest of their features', 0 for words without any."""

    def __init__(self, odds: dict[int, float]):
        self.odds = odds
        self.known: dict[str, float] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 500_000:  # only a cache
            known.clear()
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = max(self.odds.get(b, 0.0) for b in _features_of(word.lower()))
            out.append(value)
        return np.array(out)


def _sentences(tokens: list[str]) -> np.ndarray:
    """First token of each sentence; an end mark belongs to the sentence it ends. All tokens are in some sentence."""
    first = [0]
    for i, token in enumerate(tokens[:-1], 1):
        if token in SENTENCE_ENDS:
            first.append(i)
    return np.array(first)


def _pieces(first: np.ndarray, total: int, some: np.ndarray) -> np.ndarray:
    """First tokens of the fit's pieces: sentences, longer ones cut where neither neighbour has evidence or label.

    A piece has ``WINDOW_TOKENS`` tokens or more. No feature changes, and the steps that are lost are between tokens
    far from evidence, of which others show enough. Where evidence leaves no such place, the sentence stays whole.
    """
    found = []
    quiet = np.flatnonzero(~(some[1:] | some[:-1])) + 1
    for start, end in zip(first.tolist(), [*first[1:].tolist(), total]):
        found.append(start)
        while end - found[-1] > WINDOW_TOKENS:
            k = np.searchsorted(quiet, found[-1] + WINDOW_TOKENS)
            if k == len(quiet) or quiet[k] >= end:
                break
            found.append(int(quiet[k]))
    return np.array(found)


def _unary(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature matrix of tokens; neighbours do not reach over the sentence's ends."""
    some = (odds > 0).astype(float)
    before, behind = np.r_[0.0, some[:-1]], np.r_[some[1:], 0.0]
    before[first] = 0.0
    behind[first[1:] - 1] = 0.0
    return np.column_stack([np.ones(len(odds)), odds[:, None] > LEVELS, before, behind]).astype(float)


@dataclass
class Field:
    """Two labels; ``unary`` weighs the features for label 1, ``moves`` the steps between labels."""

    unary: np.ndarray
    moves: np.ndarray

    def overlap(self) -> float:
        """Tokens after which a pass has forgotten its start.

        One step brings any two vectors closer by tanh(d / 4) in Hilbert's metric, d being the log cross ratio of the
        moves, whatever the tokens' own weights; after the first step they are at most d apart.
        """
        apart = abs(self.moves[0, 0] + self.moves[1, 1] - self.moves[0, 1] - self.moves[1, 0])
        shrinks = math.tanh(apart / 4)
        if apart * shrinks <= FORGOTTEN:
            return 2
        return 2 + math.ceil(math.log(FORGOTTEN / apart) / math.log(shrinks)) if shrinks < 1 else math.inf

    def _windows(self, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, core begin, core end, end) of each run; the cores of a sentence make it up, without overlap."""
        overlap = self.overlap()
        core = max(WINDOW_TOKENS, 2 * overlap)
        if sizes.max() <= core + overlap:
            return start, start, start + sizes, start + sizes
        core, overlap = int(core), int(overlap)
        parts = np.where(sizes > core + overlap, -(-sizes // core), 1)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        low, high = np.repeat(start, parts), np.repeat(start + sizes, parts)
        begin = low + nth * core
        end = np.where(np.repeat(parts, parts) == nth + 1, high, begin + core)
        return np.maximum(begin - overlap, low), begin, end, np.minimum(end + overlap, high)

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label 1) of each token, expected counts of the moves, log of all sentences' normalisers.

        Forward and backward passes go over all sentences at once, a position at a time, longest sentences first. Long
        sentences are run in windows that overlap until the passes have forgotten the windows' ends; inner tokens
        alone count, so the results are those of the whole sentence.
        """
        total = len(features)
        score = np.clip(features @ self.unary, -30, 30)
        step = np.exp(self.moves)
        begin, core, core_end, end = self._windows(first, np.diff(np.r_[first, total]))
        sizes = end - begin
        at_run = np.cumsum(sizes) - sizes
        token = np.arange(sizes.sum()) + np.repeat(begin - at_run, sizes)
        inner = (token >= np.repeat(core, sizes)) & (token < np.repeat(core_end, sizes))
        emit = np.ones((len(token), 2))
        emit[:, 1] = np.exp(score[token])
        order = np.argsort(-sizes, kind="stable")
        start, sizes = at_run[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        alpha, scale = np.empty((len(token), 2)), np.empty(len(token))
        for t, k in enumerate(active):
            at = start[:k] + t
            value = emit[at] if t == 0 else (alpha[at - 1] @ step) * emit[at]
            scale[at] = value.sum(axis=1)
            alpha[at] = value / scale[at, None]
        beta = np.ones((len(token), 2))
        pairs = np.zeros((2, 2))
        for t in range(len(active) - 1, 0, -1):
            at = start[: active[t]] + t
            ahead = emit[at] * beta[at] / scale[at, None]
            beta[at - 1] = ahead @ step.T
            pairs += (alpha[at - 1].T @ (ahead * inner[at, None])) * step
        return (alpha[:, 1] * beta[:, 1])[inner], pairs, float(np.log(scale[inner]).sum())

    @classmethod
    def fit(cls, features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> Field:
        """Maximises the penalised conditional likelihood by gradient steps of adapted length."""
        field = cls(np.zeros(features.shape[1]), np.zeros((2, 2)))
        field.unary[0] = -2.0
        inner = np.ones(len(labels), bool)
        inner[first] = False
        moves = np.zeros((2, 2))
        np.add.at(moves, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
        target, size = features.T @ labels, max(1, len(labels))
        mean, spread = np.zeros(len(target) + 4), np.zeros(len(target) + 4)
        for n in range(1, rounds + 1):
            expected, pairs, _ = field.marginals(features, first)
            weights = np.r_[field.unary, field.moves.ravel()]
            slope = np.r_[target - features.T @ expected, (moves - pairs).ravel()] / size - penalty * weights / 10
            mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
            weights = weights + 0.2 * (mean / (1 - 0.9**n)) / (np.sqrt(spread / (1 - 0.99**n)) + 1e-9)
            field = cls(weights[: len(target)], weights[len(target) :].reshape(2, 2))
        return field


@dataclass
class Model:
    evidence: Evidence
    field: Field
    weights: np.ndarray

    def tag(self, texts: list[str]) -> list[tuple[list[float], list[tuple[int, int, float]]]]:
        """Of each text, features (largest marginal, log of expected toxic tokens, of their share) and spans.

        The sentences of all texts are run together. Those without any evidence are not run: all their tokens are like
        those far from evidence in others.
        """
        sizes, places, runs = [], [], []
        for n, text in enumerate(texts):
            words = TOKEN.findall(text)
            sizes.append(len(words))
            odds = self.evidence.of(words)
            if not odds.any():
                continue
            first = _sentences(words)
            ends = np.r_[first[1:], len(words)]
            for k in np.flatnonzero(np.maximum.reduceat(odds, first) > 0):
                places.append((n, int(first[k]), int(ends[k])))
                runs.append(odds[first[k] : ends[k]])
        found: list[tuple[list[float], list[tuple[int, int, float]]]] = [([0.0, 0.0, 0.0], []) for _ in texts]
        if not runs:
            return found
        starts = np.cumsum([0, *map(len, runs)])[:-1]
        marginals, _, _ = self.field.marginals(_unary(np.concatenate(runs), starts), starts)
        shown: dict[int, dict[int, float]] = {}
        largest: dict[int, float] = {}
        for (n, start, _), at, run in zip(places, starts, runs):
            part = marginals[at : at + len(run)]
            largest[n] = max(largest.get(n, 0.0), float(part.max()))
            for k in np.flatnonzero(part >= 0.5):
                shown.setdefault(n, {})[start + int(k)] = float(part[k])
        for n, top in largest.items():
            toxic = shown.get(n, {})
            total = sum(toxic.values())
            spans: list[tuple[int, int, float]] = []
            last = -2
            for i, match in enumerate(TOKEN.finditer(texts[n])) if toxic else ():
                if i in toxic:
                    if last == i - 1:
                        spans[-1] = (spans[-1][0], match.end(), max(spans[-1][2], toxic[i]))
                    else:
                        spans.append((match.start(), match.end(), toxic[i]))
                    last = i
            found[n] = [top, math.log1p(total), math.log1p(100 * total / sizes[n])], spans
        return found

    def score(self, features: list[float]) -> float:
        return 1 / (1 + math.exp(-float(np.clip(self.weights[0] + self.weights[1:] @ features, -35, 35))))


def _logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the constant is not penalised."""
    design = np.column_stack([np.ones(len(features)), features])
    weights = weights / weights.sum() if len(weights) else weights
    beta = np.zeros(design.shape[1])
    ridge = np.diag([1e-6, *[penalty / 10] * features.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weights * (labels - p)) - ridge @ beta
        curve = (design * (weights * p * (1 - p))[:, None]).T @ design + ridge
        beta = beta + np.clip(np.linalg.solve(curve, slope), -3, 3)
    return beta


def _training_texts(docs: DataFrame, labels: DataFrame, train: Column, max_documents: int) -> DataFrame:
    """doc_id, text, toxic, part (0 or 1) of at most ``max_documents`` labelled documents, drawn by a hash of the id."""
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("toxic") != 0).cast("int")).alias("toxic")
    ).withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    halves = [known.where(F.col("toxic") == y).orderBy("draw", "doc_id").limit(max_documents // 2) for y in (0, 1)]
    # At most max_documents ids are broadcast.
    drawn = halves[0].unionByName(halves[1]).withColumn("part", F.pmod("draw", F.lit(2)).cast("int")).drop("draw")
    return docs.join(F.broadcast(drawn), "doc_id")


def _counts(texts: DataFrame) -> DataFrame:
    """part, bucket, toxic and clean: documents that have a feature, per part and label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            rows: dict[tuple[int, int], list[int]] = {}
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "part"))):
                found = set()
                for word in {w.lower() for w in TOKEN.findall(text)}:
                    features = known.get(word)
                    if features is None:
                        features = known[word] = _features_of(word)
                    found.update(features)
                for bucket in found:
                    rows.setdefault((part, bucket), [0, 0])[toxic] += 1
            if len(known) > 500_000:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.int32()), pa.array([k[1] for k in rows], pa.int32()),
                 pa.array([v[1] for v in rows.values()], pa.int64()), pa.array([v[0] for v in rows.values()], pa.int64())],
                names=["part", "bucket", "toxic", "clean"],
            )

    return texts.mapInArrow(count, "part int, bucket int, toxic long, clean long").groupBy("part", "bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _odds(rows: list, toxic: int, clean: int) -> dict[int, float]:
    """Smoothed log odds, less two standard errors, of the features that speak for toxicity."""
    found = {}
    for bucket, t, c in rows:
        value = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        value -= 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= MIN_DOCUMENTS and value > 0.25:
            found[bucket] = value
    return found


def _segments(texts: DataFrame, label_odds: dict[int, float], feature_odds: dict[int, float]) -> DataFrame:
    """Sentences of the sample with token evidence and labels: odds, labels (arrays), marked (has label 1).

    Of sentences with neither, every sixteenth of a text is taken: they differ in length alone. Long sentences are
    cut by ``_pieces``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, evidence = Evidence(label_odds), Evidence(feature_odds)
        for batch in batches:
            all_odds, all_labels, draws = [], [], []
            for text, toxic, doc_id in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "doc_id"))):
                words = TOKEN.findall(text)
                if not words:
                    continue
                odds = evidence.of(words)
                labels = ((labeller.of(words) >= TOXIC_ODDS) & (toxic == 1)).astype(np.int8)
                first = _pieces(_sentences(words), len(words), (odds > 0) | (labels > 0))
                for k, (start, end) in enumerate(zip(first, [*first[1:], len(words)])):
                    if odds[start:end].any() or labels[start:end].any() or k % 16 == 0:
                        all_odds.append(odds[start:end].astype(np.float32))
                        all_labels.append(labels[start:end])
                        draws.append(xxhash.xxh3_64_intdigest(f"{doc_id}:{k}") >> 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(draws, pa.int64()), pa.array([int(x.any()) for x in all_labels], pa.int32()),
                 pa.array([x.tobytes() for x in all_odds], pa.binary()), pa.array([x.tobytes() for x in all_labels], pa.binary())],
                names=["draw", "marked", "odds", "labels"],
            )

    return texts.mapInArrow(cut, "draw long, marked int, odds binary, labels binary")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, max_documents: int = MAX_DOCUMENTS
) -> Model | None:
    """A model fitted on a bounded sample of labelled documents (doc_id, text; doc_id, toxic), or None without labels.

    ``train`` is a condition on the ids that may be learned from. Labels are of documents, the field learns from
    labelled tokens: in one half of the sample, words and word beginnings get their log odds of toxic documents, and
    with these the tokens of toxic documents are labelled; the other half's log odds are the features. So the field
    learns how far evidence of its own can be trusted, and what it is worth in company. Repeated labels of a document
    count as their maximum; NULL labels and ids are passed over.
    """
    small_batches(docs.sparkSession)
    condition = F.lit(True) if train is None else train
    slots = 2 * docs.sparkSession.sparkContext.defaultParallelism
    texts = materialise(_training_texts(docs, labels, condition, max_documents).repartition(slots, "doc_id"), "labelled")
    sizes = {(r.part, r.toxic): r["count"] for r in texts.groupBy("part", "toxic").count().collect()}
    if len({toxic for _, toxic in sizes}) < 2:
        return None
    # At most BUCKETS features in either part, of which those in enough toxic documents come to the driver.
    rows = _counts(texts).where("toxic > 0").groupBy("bucket").pivot("part", [0, 1]).agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    ).fillna(0).where(f"`0_toxic` + `1_toxic` >= {MIN_DOCUMENTS}").collect()
    size = lambda part, toxic: sizes.get((part, toxic), 0)
    halves = [
        _odds([(r.bucket, r[f"{p}_toxic"], r[f"{p}_clean"]) for r in rows], size(p, 1), size(p, 0)) for p in (0, 1)
    ]
    whole = _odds(
        [(r.bucket, r["0_toxic"] + r["1_toxic"], r["0_clean"] + r["1_clean"]) for r in rows],
        size(0, 1) + size(1, 1), size(0, 0) + size(1, 0),
    )
    drawn = materialise(_segments(texts, halves[0] or whole, halves[1] or whole), "segments")
    segments = [s for y in (0, 1) for s in drawn.where(F.col("marked") == y).orderBy("draw").limit(MAX_SEGMENTS // 2).collect()]
    if not segments:
        return None  # no labelled text has a word
    odds = [np.frombuffer(s.odds, np.float32).astype(float) for s in segments]
    first = np.cumsum([0, *(len(x) for x in odds)])[:-1]
    tokens = np.concatenate([np.frombuffer(s.labels, np.int8) for s in segments]).astype(int)
    field = Field.fit(_unary(np.concatenate(odds), first), first, tokens)
    model = Model(Evidence(whole), field, np.zeros(4))
    rated = _rated(texts, model, keep=["toxic"]).select("toxic", "features").collect()
    y = np.array([r.toxic for r in rated], float)
    totals = {r.toxic: r["n"] for r in labels.where(condition & F.col("toxic").isNotNull()).groupBy(
        (F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # The sample has as many of either label as it can; weights give the labels their shares back.
    weigh = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    model.weights = _logistic(np.array([r.features for r in rated], float), y, weigh)
    return model


def _rated(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and features, score and spans of each text."""
    # Arrays alone: broadcasts do not carry classes to executors without this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.evidence.odds, model.field.unary, model.field.moves, model.weights))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, unary, moves, weights = shared.value
        own = Model(Evidence(odds), Field(unary, moves), weights)
        for batch in batches:
            features, scores, spans = [], [], []
            for values, found in own.tag([text or "" for text in batch.column("text").to_pylist()]):
                features.append(values)
                scores.append(own.score(values))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(features, pa.list_(pa.float64())), pa.array(scores, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                names=[*keep, "features", "score", "spans"],
            )

    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + T.StructType.fromDDL("features array<double>, score double, spans array<struct<start: int, end: int, score: double>>").fields
    )
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rate, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from 0.5 on), spans (start, end, score).

    Spans are runs of tokens whose marginal of label 1 is 0.5 or more, in code points, end exclusive. The score is a
    logistic regression on the largest marginal, the expected number of toxic tokens and their share. NULL and empty
    texts score as texts without evidence. Without labels of both kinds, or any word in the
    labelled texts, every score is 0. Ids may be NULL or repeat;
    further columns are not read; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    model = fit_toxicity(slim, labels, train, max_documents)
    if model is None:
        spans = F.array().cast("array<struct<start: int, end: int, score: double>>")
        return slim.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), spans.alias("spans"))
    return _rated(slim, model, keep=["doc_id"]).select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without documents predicted toxic; all columns stay. One pass: rows carry their columns along."""
    model = fit_toxicity(
        docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")), labels, train
    )
    if model is None:
        return docs
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    packed = docs.select(others.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    clean = _rated(packed, model, keep=["row", "text"]).where("score < 0.5")
    return clean.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
