"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.common import whole_text

# The contract's patterns, each with the length that a match (for ``assign`` its last group) must have.
KEY_WORDS = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
ASSIGN_HEAD = rf"(?:{KEY_WORDS})[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+"
# Runs that are too short to count need no match of their own: nothing inside them can be longer.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

# The entropy search.
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
# Character classes: letters that belong, and the entropy in bits that some window of 20 characters must reach. Of 20
# random characters a hex string has about 3.2 bits, one of 64 letters about 4.0; prose stays below both.
CLASSES = {"hex": ("0123456789abcdefABCDEF", 3.0), "base64": (None, 3.7)}
# Harmless strings that look random: identifiers with hyphens, paths and addresses, plain words, numbers, repeats.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+$",
    r"^(?!.*(?:[a-z][A-Z]|[A-Z]{2}))[A-Za-z+/_=-]+$",
    r"^[0-9+=/_-]+$",
    r"^(.{1,6}?)\1{2,}.{0,5}$",
)


SPAN = "struct<start: int, kind: int, end: int, hit: string>"


BLOCK = 128  # elements that one accumulator gathers: arrays are copied when they grow


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``: an expression that a lambda mentions is computed for every element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocks(array: str) -> str:
    return _bound(
        array, "whole", f"transform(sequence(0, greatest(size(whole) - 1, 0) div {BLOCK}), j -> slice(whole, j * {BLOCK} + 1, {BLOCK}))"
    )


def _carried(totals: str, step: str) -> str:
    """What each block starts with: the totals of the blocks before it."""
    return f"aggregate({totals}, array(0), (s, t) -> concat(s, array({step.format('element_at(s, -1)', 't')})))"


def _gathered(blocks: str, starts: str, state: str, element: str) -> str:
    """The arrays that ``element`` gives for each x, in order; ``acc.at`` starts anew in each block and becomes ``state``."""
    return _bound(starts, "carried", (
        f"flatten(transform({blocks}, (b, j) -> aggregate(b, named_struct('at', carried[j], 'found', cast(array() as array<{SPAN}>)),"
        f" (acc, x) -> named_struct('at', {state}, 'found', concat(acc.found, {element}))).found))"
    ))


def _located(pieces: DataFrame, kinds: int) -> DataFrame:
    """Matches of each kind as structs, from the pieces between matches (gap_k) and the matches (hit_k).

    The lengths of both, summed from the left, are the offsets: totals of blocks first, then inside the blocks, so the
    work is in proportion to the number of matches.
    """
    every = range(kinds)
    rows = pieces.selectExpr("doc_id", *(
        _bound(f"gap_{k}", "gaps", (
            f"transform(hit_{k}, (h, i) -> named_struct('skip', char_length(gaps[i]), 'n', char_length(h), 'hit', h))"
        )) + f" AS rows_{k}" for k in every
    ))
    cut = rows.selectExpr("doc_id", *(f"{_blocks(f'rows_{k}')} AS blocks_{k}" for k in every))
    summed = cut.selectExpr("*", *(
        f"transform(blocks_{k}, b -> aggregate(b, 0, (t, x) -> t + x.skip + x.n)) AS totals_{k}" for k in every
    ))
    started = summed.selectExpr("*", *(f"{_carried(f'totals_{k}', '{0} + {1}')} AS starts_{k}" for k in every))
    return started.selectExpr("doc_id", *(
        _gathered(
            f"blocks_{k}", f"starts_{k}", "acc.at + x.skip + x.n",
            f"array(named_struct('start', acc.at + x.skip, 'kind', {k}, 'end', acc.at + x.skip + x.n, 'hit', x.hit))",
        ) + f" AS spans_{k}" for k in every
    ))


def _free(based: DataFrame) -> DataFrame:
    """doc_id, base, and as ``free`` the spans_3 that overlap none of base.

    In the order of both, a candidate is free when no base span before it reaches it and the very next element is no
    base span that begins inside it: candidates do not overlap one another.
    """
    lined = based.selectExpr(
        "doc_id", "base", "spans_3", "size(base) > 0 AND size(spans_3) > 0 AS mixed",
        f"CASE WHEN size(base) > 0 AND size(spans_3) > 0 THEN array_sort(concat(base, spans_3)) ELSE cast(array() as array<{SPAN}>) END AS line",
    )
    paired = lined.selectExpr(
        "doc_id", "base", "spans_3", "mixed",
        _bound("line", "all", (
            "transform(all, (m, i) -> named_struct('m', m, 'next', if(get(all, i + 1).kind < 3, get(all, i + 1).start, NULL)))"
        )) + " AS pairs",
    )
    cut = paired.selectExpr("doc_id", "base", "spans_3", "mixed", f"{_blocks('pairs')} AS blocks")
    reach = "if({0}.m.kind < 3, greatest({1}, {0}.m.end), {1})"
    summed = cut.selectExpr("*", f"transform(blocks, b -> aggregate(b, 0, (t, x) -> {reach.format('x', 't')})) AS totals")
    started = summed.selectExpr("*", f"{_carried('totals', 'greatest({0}, {1})')} AS starts")
    clear = "x.m.kind = 3 AND acc.at <= x.m.start AND coalesce(x.next >= x.m.end, true)"
    merged = _gathered("blocks", "starts", reach.format("x", "acc.at"), f"if({clear}, array(x.m), cast(array() as array<{SPAN}>))")
    return started.selectExpr("doc_id", "base", f"CASE WHEN mixed THEN {merged} ELSE spans_3 END AS free")


def _weight(count: Column) -> Column:
    return F.when(count <= 1, F.lit(0.0)).otherwise(count * F.log2(count.cast("double")))


def max_window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any ``window`` characters in a row (of the whole text if it is shorter).

    The window slides one character at a time. Only the counts of the character that enters and of the one that
    leaves change, so the sum of n log n is carried on by their four terms. The text is split into characters once,
    so the work is in proportion to its length.
    """
    # A transform over one element binds the characters to a name.
    return F.get(F.transform(F.array(F.split(text, "")), lambda chars: _slide(chars, window)), F.lit(0))


def _slide(chars: Column, window: int) -> Column:
    length = F.size(chars)
    size = F.least(length, F.lit(window))

    def count(char: Column, start: Column, length: Column) -> Column:
        return F.size(F.filter(F.slice(chars, start, length), lambda c: c == char))

    def at(i: Column) -> Column:
        return F.element_at(chars, i)

    first = F.aggregate(
        F.sequence(F.lit(1), size), F.lit(0.0),
        lambda acc, i: acc + _weight(count(at(i), F.lit(1), i)) - _weight(count(at(i), F.lit(1), i) - 1),
    )

    def slide(acc: Column, i: Column) -> Column:
        # The window [i - window, i) becomes [i - window + 1, i + 1), counted from 1.
        before, after = count(at(i - window), i - window, F.lit(window)), count(at(i), i - window + 1, F.lit(window))
        total = acc["sum"] - _weight(before) + _weight(before - 1) - _weight(after - 1) + _weight(after)
        return F.struct(total.alias("sum"), F.least(acc["least"], total).alias("least"))

    least = F.when(length <= window, first).otherwise(F.aggregate(
        F.sequence(F.lit(window + 1), F.greatest(length, F.lit(window + 1))),
        F.struct(first.alias("sum"), first.alias("least")), slide,
    )["least"])
    return F.when(size < 1, F.lit(0.0)).otherwise(F.log2(size.cast("double")) - least / size)


def _looks_secret(hit: Column) -> Column:
    """A candidate that is not allow-listed and whose entropy reaches the bar of its character class."""
    harmless = reduce(Column.__or__, (hit.rlike(pattern) for pattern in ALLOWED))
    letters, hex_bar = CLASSES["hex"]
    bar = F.when(F.length(F.translate(hit, letters, "")) == 0, F.lit(hex_bar)).otherwise(F.lit(CLASSES["base64"][1]))
    return ~harmless & (max_window_entropy(hit) >= bar)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and secrets, an array of structs (start, kind, end, hit).

    ``kind`` numbers ``KINDS``; offsets are code points, the end is exclusive; the array is sorted by start, then kind.
    ``assign``, ``access`` and ``hex`` are leftmost matches of fixed patterns that are long enough. ``entropy`` adds
    candidate strings with a window of high entropy for their character class, unless they are allow-listed or
    overlap one of the former. NULL texts count as empty; ids may be NULL or repeat, each row is judged by itself;
    further columns are not read; an empty table gives no rows.
    """
    body = F.col("body")
    none = F.array().cast("array<string>")
    pieces = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body")).select("doc_id", *(
        F.when(body.rlike(pattern), column).otherwise(none).alias(f"{name}_{kind}")
        for kind, pattern in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))
        for name, column in (
            ("gap", F.split(body, pattern, -1)), ("hit", F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
        )
    ))
    spans = _located(pieces, len(KINDS))
    value = lambda m: F.regexp_replace(m["hit"], f"^{ASSIGN_HEAD}", "")
    based = spans.select(
        "doc_id", "spans_3",
        F.concat(F.filter("spans_0", lambda m: F.length(value(m)) >= 8), "spans_1", "spans_2").alias("base"),
    )
    return _free(based).select(
        "doc_id", F.array_sort(F.concat("base", F.filter("free", lambda m: _looks_secret(m["hit"])))).alias("secrets")
    )


def named_spans(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans as text: kind:start:end, comma-joined in the order of the array."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))),
        ",",
    )
