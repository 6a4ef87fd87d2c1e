"""URL filter: rules first, then a tree of path templates per host, judged by smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.llm.common import lower_ascii
from corpuscope.operators.joins import skew_join
from corpuscope.session import materialise

# The contract's rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEW = 3  # a segment on fewer pages is a wildcard
RARE = 1000  # so is one on less than this part of its branch's pages; at most this many siblings are left
VARIED, PAGES_EACH = 10, 5  # and every segment, where more than VARIED stand on fewer than PAGES_EACH pages on average
STRENGTH = 4.0  # pages that the prior of a branch counts for
Z = 2.0  # standard errors within which two branches count as alike
REJECT = 0.5


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits the columns host and path, else NULL; of equally long ones the last given wins."""
    host, path = F.col("host"), F.col("path")
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _sums() -> tuple[Column, Column]:
    return F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")


def _smoothed(blocked: str, labelled: str, prior: Column) -> Column:
    return (F.col(blocked) + F.lit(STRENGTH) * prior) / (F.col(labelled) + F.lit(STRENGTH))


def _generalised(heads: DataFrame) -> DataFrame:
    """Adds ``branch``: the segment itself, or ``*`` where it varies; the end of a path (an empty segment) stays."""
    node = heads.groupBy("host", "node").agg(F.sum("pages").alias("node_pages"), F.count(F.lit(1)).alias("node_heads"))
    varies = (
        (F.col("pages") < FEW) | (F.col("pages") * RARE < F.col("node_pages"))
        | (F.col("node_heads") > VARIED) & (F.col("node_pages") < F.col("node_heads") * PAGES_EACH)
    )
    return heads.join(node, ["host", "node"]).withColumn(
        "branch", F.when((F.col("head") != "") & varies, "*").otherwise(F.col("head"))
    ).drop("node_pages", "node_heads")


def _merge_alike(branches: DataFrame) -> DataFrame:
    """Adds the labels of the group of siblings that a branch belongs to.

    Siblings with labels stand in the order of their shares of blocked ones; where two neighbours differ by more than
    ``Z`` standard errors of their difference, a new group begins. A node has at most ``RARE`` siblings, a wildcard and
    an end, so its window is small whatever the corpus. Branches without labels belong to no group.
    """
    siblings = ["host", "node", F.col("labelled") > 0]
    order = Window.partitionBy(*siblings).orderBy("share", "labelled", "branch")
    blocked, labelled = F.col("blocked").cast("double"), F.col("labelled").cast("double")
    before, before_labelled = F.lag(blocked).over(order), F.lag(labelled).over(order)
    pooled = (blocked + before) / (labelled + before_labelled)
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / labelled + F.lit(1.0) / before_labelled))
    parts = F.coalesce(F.col("share") - F.lag("share").over(order) > F.lit(Z) * error, F.lit(False)).cast("int")
    grouped = branches.withColumn("share", F.try_divide(blocked, labelled)).withColumn("parts", parts)
    grouped = grouped.withColumn("group", F.sum("parts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*siblings, "group")
    return grouped.withColumns({
        "group_blocked": F.sum("blocked").over(group), "group_labelled": F.sum("labelled").over(group),
    }).drop("share", "parts", "group")


def _split_nodes(rows: DataFrame, top: bool) -> DataFrame:
    """The templates of all nodes whose labels disagree, one branching further down, with the purity of their branch.

    What all templates of a node have in common is passed over, so that a round ends at a real branching. Nodes whose
    labels agree, or that hold a single template, are leaves and give no rows.
    """
    node = ["host", "node"]
    nodes = rows.groupBy(*node).agg(*_sums(), F.min("rest").alias("low"), F.max("rest").alias("high"))
    if top:
        nodes = nodes.withColumn("skip", F.lit(0))
    else:
        shared = F.transform(
            F.sequence(F.lit(0), F.least(F.size("low"), F.size("high"))),
            lambda i: F.get("low", i).eqNullSafe(F.get("high", i)))
        nodes = nodes.where("blocked > 0 AND blocked < labelled AND low <> high").withColumn(
            "skip", (F.array_position(shared, False) - 1).cast("int"))
    opened = materialise(rows.join(nodes.select(*node, "skip"), node).withColumns({
        "head": F.coalesce(F.get("rest", F.col("skip")), F.lit("")),
        "node": F.array_join(F.concat(F.array("node"), F.slice("rest", F.lit(1), F.col("skip"))), "/"),
        "rest": F.slice("rest", F.col("skip") + 2, F.size("rest")),
    }).drop("skip"), "opened")
    heads = materialise(opened.groupBy(*node, "head").agg(F.sum("pages").alias("pages"), *_sums(), F.max("purity").alias("prior")), "heads")
    heads = _generalised(heads)
    branches = heads.groupBy(*node, "branch").agg(*_sums(), F.max("prior").alias("prior"))
    if top:
        overall = branches.agg(((F.sum("blocked") + 1.0) / (F.sum("labelled") + 2.0)).alias("share"))
        shapes = branches.groupBy("branch").agg(*_sums()).select(
            "branch", _smoothed("blocked", "labelled", F.coalesce(overall.scalar(), F.lit(0.5))).alias("prior"))
        branches = branches.drop("prior").join(shapes, "branch")
    judged = _merge_alike(branches).select(
        *node, "branch", _smoothed("group_blocked", "group_labelled", F.col("prior")).alias("purity"))
    lookup = heads.select(*node, "head", "branch").join(judged, [*node, "branch"])
    return opened.drop("purity").join(lookup, [*node, "head"]).select(
        "host", "template", F.concat_ws("/", "node", "branch").alias("node"), "rest", "purity", "pages", "blocked", "labelled")


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits decides. Other pages are judged by the template tree of their host: paths split into
    segments, runs of digits in them ``*``. Labels are ``labels`` (host, path, blocked boolean) or, by default, the pages
    that a rule decides. From the root on, a branch whose labels disagree is split at its next segment, to any depth:
    segments that vary become a wildcard (``FEW``, ``RARE``, ``VARIED``), siblings with like shares of blocked labels are merged,
    and a branch's purity is the share of its group, smoothed towards its parent's; that of a first segment towards the
    same one on all hosts, and this towards the share of all labels. A page goes by the deepest branch it reaches; more
    than ``REJECT`` is blocked. There are as many rounds as branchings with mixed labels on one path, at most.

    NULL urls and those without ``://`` have an empty host and path and one template of their own. Ids may be NULL or
    repeat; further columns are not read; an empty table gives no rows. Ties (equal purity to the bar) are allowed.
    """
    url = F.col(url_col)
    read = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("decided", longest_rule(rules))

    def templated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("template", F.array_join(F.array_remove(F.split(F.regexp_replace("path", "[0-9]+", "*"), "/"), ""), "/"))

    labelled = templated(read.where("decided is not null").select(
        "host", "path", (F.col("decided.verdict") == "block").alias("is_blocked")
    ) if labels is None else labels.select("host", "path", F.col("blocked").alias("is_blocked")))

    keys = ["host", "template"]
    # One row per template: counts of pages and labels, added up before the shuffle.
    counted = templated(read).groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    marked = labelled.groupBy(*keys).agg(
        F.sum(F.col("is_blocked").cast("long")).alias("blocked"), F.count("is_blocked").alias("labelled")
    )
    level = counted.join(marked, keys, "left").fillna(0, ["blocked", "labelled"]).select(
        *keys, F.lit("").alias("node"), F.array_remove(F.split("template", "/"), "").alias("rest"),
        F.lit(0.5).alias("purity"), "pages", "blocked", "labelled")
    level = materialise(_split_nodes(materialise(level, "templates"), top=True), "branches")
    judged, depth = level.select(*keys, F.lit(0).alias("depth"), "purity"), 0
    while not level.isEmpty():
        depth += 1
        level = materialise(_split_nodes(level, top=False), "branches")
        judged = judged.unionAll(level.select(*keys, F.lit(depth).alias("depth"), "purity"))
    verdicts = judged.groupBy(*keys).agg((F.max_by("purity", "depth") > REJECT).alias("rejected"))
    own = skew_join(templated(read), verdicts, keys, "left")
    return own.select(
        "page_id", "host", "path", F.col("decided.rule").alias("rule"),
        F.coalesce(F.col("decided.verdict"), F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
    )
