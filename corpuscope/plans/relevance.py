"""Relevance filter: sample, label, train, tune, score, write back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuscope.fixed_values import KEYWORDS, TRAINING_SAMPLE_ROWS
from corpuscope.functions import text
from corpuscope.functions.hashing import hash_uniform
from corpuscope.operators import features, joins, metrics, models, mutation, neighbours, sampling
from corpuscope.session import materialise
from corpuscope.streaming import ingest


def draw_training_sample(videos: DataFrame, transcripts: DataFrame, manual_labels: DataFrame,
                         keywords: Sequence[str] = tuple(KEYWORDS), n: int = TRAINING_SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """Up to ``n`` unlabelled videos with transcript, drawn by inverse keyword frequency."""
    frame = joins.sampling_frame(videos, transcripts, manual_labels, "video_id", "transcript")
    weighted = sampling.sampling_weights(frame, "keywords", keywords)
    return sampling.weighted_sample(weighted, "video_id", "sampling_weight", n, seed)


def replies_to(sample: DataFrame, scorer, keywords: Sequence[str] = tuple(KEYWORDS)) -> DataFrame:
    """video_id, reply and gpt_label, NULL where the reply is no label."""
    prompts = sample.select("video_id", text.build_prompt(
        F.col("title"), F.col("description"), F.col("transcript"), keywords).alias("prompt"))
    replies = sampling.batch_label(prompts, "prompt", scorer)
    return replies.select("video_id", "reply", text.parse_label(F.col("reply")).alias("gpt_label"))


def label_sample(sample: DataFrame, labels: DataFrame, scorer, keywords: Sequence[str] = tuple(KEYWORDS)) -> DataFrame:
    """Label rows not labelled before and add them to ``labels``; unreadable replies are left out."""
    fresh = replies_to(joins.anti_filter(sample, labels, "video_id"), scorer, keywords).drop("reply")
    return mutation.upsert_ignore(labels, fresh.where("gpt_label IS NOT NULL"), "video_id", ["gpt_label"])


class LabellingJob:
    """Labelling that may be stopped and started again at any point; all of its state lies below ``root``.

    Samples are queued as files of ``rows_per_file`` rows. A run takes ``files_per_batch`` of them at a time through the
    labeller; a batch's labels and rejected ids are in their logs before the checkpoint calls it done. So a lost run
    repeats one batch at most, no video has two labels, and videos labelled before, also under a lost checkpoint, are
    not sent to the labeller again.
    """

    QUEUED = "video_id string, title string, description string, transcript string"
    LABELLED = "video_id string, reply string, gpt_label int"

    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 10_000, files_per_batch: int = 64):
        self.spark, self.root, self.rows_per_file, self.files_per_batch = spark, root, rows_per_file, files_per_batch

    def _queued(self) -> DataFrame:
        return ingest.read_landed(self.spark, f"{self.root}/queue", T.StructType.fromDDL(self.QUEUED))

    def enqueue(self, sample: DataFrame) -> None:
        """Adds the videos of ``sample`` that were not queued before; of rows with one id, one; none without an id."""
        columns = self._queued().columns
        rows = mutation.keep_first(sample.select(*columns).where("video_id IS NOT NULL"), "video_id", columns[1:])
        joins.anti_filter(rows, self._queued(), "video_id").write.mode("append").option(
            "maxRecordsPerFile", self.rows_per_file).parquet(f"{self.root}/queue")

    def run(self, scorer, keywords: Sequence[str] = tuple(KEYWORDS), done: DataFrame | None = None) -> None:
        """Labels what is queued, but for the ids of ``done``, and stops."""
        settled = self.labels().select("video_id").unionByName(self.rejects())
        if done is not None:
            settled = settled.unionByName(done.select(F.col("video_id").cast("string")))
        queue = ingest.open_stream(
            self.spark, f"{self.root}/queue", T.StructType.fromDDL(self.QUEUED), "parquet", self.files_per_batch)
        # The join comes before the labeller: a settled video costs no call.
        ingest.stream_ingest(
            replies_to(joins.anti_filter(queue, settled, "video_id"), scorer, keywords), f"{self.root}/labels",
            f"{self.root}/checkpoint", "video_id", ["gpt_label"], failed_path=f"{self.root}/rejects",
            succeeded=F.col("gpt_label").isNotNull())

    def labels(self) -> DataFrame:
        return ingest.read_ignore(self.spark, f"{self.root}/labels", T.StructType.fromDDL(self.LABELLED))

    def rejects(self) -> DataFrame:
        """Ids whose reply was no label."""
        return ingest.read_ignore(self.spark, f"{self.root}/rejects", T.StructType.fromDDL("video_id string"))


class RelevanceModel:
    """Chosen classifier with its threshold."""

    def __init__(self, scorer: models.ModelScorer, threshold: float, table: DataFrame | None = None, name: str | None = None):
        self.scorer, self.threshold, self.table, self.name = scorer, threshold, table, name

    def save(self, path: str) -> None:
        """Scaler, classifier or margin models with their sigmoid terms, isotonic curve and threshold in one folder."""
        self.scorer.with_threshold(self.threshold).save(path)


def load_labeller(path: str) -> models.ModelScorer:
    """A saved model: gives ``score``, ``confidence`` and ``predicted_label`` of rows with ``features``."""
    return models.ModelScorer.load(path)


def as_features(embeddings: DataFrame, *columns: str) -> DataFrame:
    """The vectors with their interaction feature, as the models take them."""
    crossed = embeddings.withColumn("embedding", features.interaction(F.col("embedding").cast("array<double>")))
    return models.with_features(crossed, "embedding").select(*columns, "features")


def train(embeddings: DataFrame, train_labels: DataFrame, heldout_labels: DataFrame, label: str = "label",
          names: Sequence[str] = ("logreg", "forest", "boosted", "svm", "mlp"), balance: bool = True,
          weighted: bool = False, **options) -> RelevanceModel:
    """Align labels, balance the training part, split the rest in halves, compare models.

    The scaler is part of each model's pipeline. Class weights are optional, as the
    balanced classes do not need them.
    """
    aligned = materialise(joins.align_labels(embeddings, train_labels, heldout_labels, "video_id", label), "aligned")
    fit_rows = aligned.where("split = 'train'").select("video_id", "embedding", label)
    heldout = aligned.where("split = 'heldout'").select("video_id", "embedding", label)
    halves = sampling.stratified_split(heldout, "video_id", label)
    if balance:
        fit_rows = neighbours.smote_balance(fit_rows, "video_id", "embedding", label)
    prepared = lambda df: as_features(df, "video_id", label)
    fit_rows = materialise(prepared(fit_rows), "train")
    val = materialise(prepared(halves.where("split = 'val'")), "val")
    test = materialise(prepared(halves.where("split = 'test'")), "test")
    if weighted:
        fit_rows = models.with_class_weight(fit_rows, label, metrics.class_weight(val, label).head()["weight_0"])
    table, scorers = models.compare_models(fit_rows, val, test, "video_id", label, names, **options)
    best = models.best_model(table).head()
    return RelevanceModel(scorers[best["model"]], best["threshold"], table, best["model"])


def score_and_write_back(model: RelevanceModel, embeddings: DataFrame, videos: DataFrame, labelled: DataFrame) -> DataFrame:
    """Videos with predicted label and confidence for every unlabelled vector."""
    rows = as_features(embeddings, "video_id")
    scored = models.score_all(model.scorer, rows, "video_id", model.threshold, exclude=labelled)
    return mutation.update_by_key(videos, scored, "video_id", ["predicted_label", "confidence"])


def document_scores(spark, sf_dir: str) -> DataFrame:
    """The whole flow with documents as videos and the given vectors and labels.

    Documents with a manual label are held out, six in ten of the other vectors are labelled for training, and the
    rest are scored: whether a document got a score, and whether its label follows from score and threshold.
    """
    from corpuscope.plans.registry import load

    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("video_id"), "lang",
        F.lit(None).cast("int").alias("predicted_label"), F.lit(None).cast("double").alias("confidence"))
    vectors = materialise(load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("video_id"), "embedding", "label"), "vectors")
    truth = vectors.select("video_id", (F.col("label") >= 7).cast("int").alias("label"))
    manual = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("video_id"))
    heldout = joins.semi_filter(truth, manual, "video_id")
    fit_labels = joins.anti_filter(truth, manual, "video_id").where(hash_uniform(F.col("video_id")) < 0.6)
    model = train(vectors.drop("label"), fit_labels, heldout)
    labelled = heldout.select("video_id").unionByName(fit_labels.select("video_id"))
    scored = score_and_write_back(model, vectors.drop("label"), docs, labelled)
    return scored.select(
        "video_id", "lang", F.col("confidence").isNotNull().alias("scored"),
        (F.col("predicted_label") == (F.col("confidence") >= model.threshold).cast("int")).alias("consistent"))
