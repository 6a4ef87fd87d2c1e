"""Benchmark decontamination by a broadcast hash set of normalised word windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.llm.common import free_names, lower_ascii, whole_text
from corpuscope.session import materialise

WINDOW_WORDS = 13
SET_BOUND = 100_000  # windows in one broadcast set, about 10 MB; a larger benchmark is taken in blocks of this size
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of a text whose capitals are still there


def words_of(text: Column) -> Column:
    """Lower-cased (A to Z) words: runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def benchmark_windows(
    benchmark: DataFrame, window_words: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct windows: gram (words joined by a space), gram_words, items (ids as sorted text).

    An item of fewer words than a window is one window; an item without words has none. NULL ids count as empty text.
    """
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(whole_text(text_col)).alias("words")
    ).where(F.size("words") > 0)
    grams = items.select(
        "item", F.least(F.size("words"), F.lit(window_words)).alias("gram_words"),
        F.explode(F.expr(
            f"transform(sequence(1, greatest(size(words) - {window_words - 1}, 1)),"
            f" i -> array_join(slice(words, i, {window_words}), ' '))"
        )).alias("gram"),
    )
    return grams.groupBy("gram", "gram_words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _signature(words: int, at: str = "i") -> str:
    """Hash of a window's first, middle and last word: cheap enough for every position, checked in full later."""
    return f"xxhash64(get(words, {at}), get(words, {at} + {words // 2}), get(words, {at} + {words - 1}))"


def _scan(numbered: DataFrame, grams: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n_words, start, gram_words, items: a row per verified hit, and one for any other row.

    ``grams`` is one block, so both the literal hash set and the broadcast table are bounded by ``SET_BOUND``.
    """
    signed = grams.select("gram_words", F.split("gram", " ").alias("words"))
    lengths: dict[int, set[int]] = {}
    for row in signed.select("gram_words", F.expr(
        "xxhash64(get(words, 0), get(words, gram_words div 2), get(words, gram_words - 1))").alias("s")
    ).distinct().collect():
        lengths.setdefault(row.gram_words, set()).add(row.s)
    worded = numbered.select("row", "doc_id", "text_hash", words_of(F.col("body")).alias("words"))
    found = worded.select(
        "row", "doc_id", "text_hash", "words",
        *(F.expr(
            f"filter(if(size(words) < {n}, array(), sequence(0, size(words) - {n})),"
            f" i -> {_signature(n)} in ({', '.join(map(str, sorted(signatures)))}))"
        ).alias(f"at_{n}") for n, signatures in lengths.items()),
    )
    windows = [
        F.expr(f"transform(at_{n}, i -> struct(i as start, {n} as gram_words, array_join(slice(words, i + 1, {n}), ' ') as gram))")
        for n in lengths
    ] or [F.expr("cast(array() as array<struct<start: int, gram_words: int, gram: string>>)")]
    seen = found.select(
        "row", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
        F.explode_outer(F.concat(*windows)).alias("hit"),
    ).select("row", "doc_id", "text_hash", "n_words", "hit.*")
    return seen.join(F.broadcast(grams), ["gram", "gram_words"], "left").select(
        "row", "doc_id", "text_hash", "n_words",
        F.when(F.col("items").isNotNull(), F.col("start")).alias("start"),
        F.when(F.col("items").isNotNull(), F.col("gram_words")).alias("gram_words"), "items",
    )


def hits(
    docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, set_bound: int = SET_BOUND,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Verified occurrences of benchmark windows, and an empty row for each document without one.

    The signatures of the windows are a hash set inside the scan; windows that pass it are compared word by word
    with the benchmark's. A benchmark of more than ``set_bound`` windows is taken in blocks over a numbered copy of
    the documents in the shared folder; the result is the same.
    """
    grams = materialise(benchmark_windows(benchmark, window_words), "windows")
    blocks = -(-grams.count() // set_bound) or 1
    body = whole_text(text_col)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), body.alias("body"),
        F.xxhash64(body).alias("text_hash"),
    )
    if blocks == 1:
        return _scan(numbered, grams)
    numbered = materialise(numbered, "numbered")
    block = F.pmod(F.xxhash64("gram"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (_scan(numbered, grams.where(block == b)) for b in range(blocks)))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, min_share: float = 0.05,
    set_bound: int = SET_BOUND, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items (sorted ids), contaminated.

    A word inside any occurrence of a window is hit. A document is contaminated when it has a hit word and hit words
    are at least ``min_share`` of its words. NULL and empty texts have no words. Ids may be NULL or repeat: each row
    is judged by itself. Empty tables give no rows (documents) or no hits (benchmark); further columns are not read.
    """
    found = hits(docs, benchmark, window_words, set_bound, id_col, text_col)
    ordered = Window.partitionBy("row").orderBy("start", "gram_words")
    reached = F.max(F.col("start") + F.col("gram_words")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("gram_words") - F.greatest("start", F.coalesce(reached, F.lit(0)))
    counted = found.withColumn("fresh", F.greatest(fresh, F.lit(0)).cast("long")).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.max("n_words").alias("n_words"),
        F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    enough = F.expr(f"n_hit * {round(1 / min_share)} >= n_words") if (1 / min_share).is_integer() else (
        F.col("n_hit") >= F.col("n_words") * min_share
    )
    return counted.select(
        "doc_id", "text_hash", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & enough).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay. Rows equal in id and text share their fate."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad_id, bad_hash = free_names(docs, "_bad_id", "_bad_hash")
    bad = contamination(docs, benchmark, **options).where("contaminated").select(
        F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)
    )
    same = F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.xxhash64(whole_text(text_col)) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit words, and the white space and marks before each, taken out of the text.

    Texts without a hit stay as they are, NULL texts stay NULL.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    of, hit_id, hit_hash, gaps, words = free_names(docs, "_spans", "_hit_id", "_hit_hash", "_gaps", "_words")
    spans = hits(docs, benchmark, **options).where("start is not null").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "gram_words")).alias(of)
    ).select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash), of)
    same = F.col(id_col).eqNullSafe(F.col(hit_id)) & (F.xxhash64(whole_text(text_col)) == F.col(hit_hash))
    joined = docs.join(spans, same, "left").withColumns({
        gaps: F.split(F.col(text_col), IS_WORD, -1), words: F.regexp_extract_all(text_col, F.lit(IS_WORD), F.lit(0)),
    })
    kept = F.expr(
        f"concat(array_join(transform({words}, (w, i) ->"
        f" if(exists({of}, s -> i >= s.start and i < s.start + s.gram_words), '', concat({gaps}[i], w))), ''),"
        f" element_at({gaps}, -1))"
    )
    return joined.withColumn(text_col, F.when(F.col(of).isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)
