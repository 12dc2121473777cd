"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source).  A token budget goes down the tree by
integer weights.  No node gets more than it can supply (its tokens times
``max_epochs``); what a child cannot take goes to its siblings by weight, and
only what they all cannot take shows as a shortage one level up, where the
parent's own siblings share it.  A leaf's target is met by whole epochs of all
its documents and a prefix of one more epoch in a seeded order; a prefix ends
before the first document that would pass the target.

The prefix needs no task per leaf: order keys are hashes, so a leaf's documents
are dealt into 4,096 buckets by the key's leading digits, bucket sums are added
up, and documents are only sorted within their bucket.  A source that holds a
third of all rows is spread like any other.  Budgets are integers throughout.

Nulls: a null text has no tokens, a null language or source is a leaf value
'none', a null id orders by the word null and the text's hash.  Documents without
tokens of a leaf with a target are part of its epochs.  Repeated rows count each.
An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = ("domain", "lang", "source")
BUCKET_DIGITS = 3


def numbered_domain(source: Column) -> Column:
    """Default domains: the source's trailing number modulo 4."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(
        F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def byte_tokens(text: Column) -> Column:
    """Token estimate: a token for every four bytes, rounded up."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")


def _weight(c: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])
    return F.coalesce(F.try_element_at(table, F.col(c)), F.lit(1).cast("long"))


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Splits each parent's ``budget`` among its children ``name`` by ``w``,
    up to their ``cap``: adds ``alloc``."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.when(F.col("w") == 0, 0.0).otherwise(F.col("cap") / F.col("w")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    n = nodes.withColumns({"_s": F.coalesce(F.sum("cap").over(before), zero),
                           "_w": F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), zero)})
    full = F.col("cap") * F.col("_w") <= F.col("w") * (F.col("budget") - F.col("_s"))
    n = n.withColumn("_full", full)
    n = n.withColumns({"_taken": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(zero)).over(by),
                       "_left": F.sum(F.when(F.col("_full"), zero).otherwise(F.col("w"))).over(by)})
    rest = F.expr("(w * (budget - _taken)) div greatest(_left, 1)")
    return n.withColumn("alloc", F.when(F.col("_full"), F.col("cap")).otherwise(rest)).drop(
        "_s", "_w", "_full", "_taken", "_left")


def leaf_targets(docs: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """Per leaf ``supply``, ``target``, whole ``epochs`` and the ``rest``.

    ``docs`` has the leaf columns and ``tokens``; ``budget`` is a column over
    ``total`` (the tokens of all leaves).
    """
    leaves = docs.groupBy(*LEAF).agg(F.sum("tokens").alias("supply"))
    wd, wl, ws = (_weight(c, weights.get(c, {})) for c in LEAF)
    nodes = leaves.withColumns({"wd": wd, "wl": wl, "ws": ws, "total": F.sum("supply").over(Window.partitionBy())})
    # a node without weight, or below one, supplies nothing
    usable = (F.col("wd") > 0) & (F.col("wl") > 0) & (F.col("ws") > 0)
    nodes = nodes.withColumn("leaf_cap", F.when(usable, F.col("supply") * max_epochs).otherwise(F.lit(0).cast("long")))
    caps = nodes.withColumns({
        "lang_cap": F.sum("leaf_cap").over(Window.partitionBy("domain", "lang")),
        "domain_cap": F.sum("leaf_cap").over(Window.partitionBy("domain")),
        "all_cap": F.sum("leaf_cap").over(Window.partitionBy())})
    root = F.least(budget.cast("long"), F.col("all_cap"))
    d = caps.select("domain", F.col("wd").alias("w"), F.col("domain_cap").alias("cap"), root.alias("budget")).distinct()
    d = _share(d, [], "domain").select("domain", F.col("alloc").alias("d_alloc"))
    lg = caps.select("domain", "lang", F.col("wl").alias("w"), F.col("lang_cap").alias("cap")).distinct()
    lg = lg.join(d, "domain").withColumnRenamed("d_alloc", "budget")
    lg = _share(lg, ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("l_alloc"))
    s = caps.select(*LEAF, "supply", F.col("ws").alias("w"), F.col("leaf_cap").alias("cap")).join(lg, ["domain", "lang"])
    s = _share(s.withColumnRenamed("l_alloc", "budget"), ["domain", "lang"], "source")
    return s.select(*LEAF, "supply", F.col("alloc").alias("target"),
                    F.expr("alloc div greatest(supply, 1)").alias("epochs"),
                    (F.col("alloc") % F.greatest("supply", F.lit(1).cast("long"))).alias("rest"))


def _chosen(docs: DataFrame, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int, seed: int,
            id_col: str, text_col: str, lang_col: str, source_col: str, domain_of, tokens_of) -> DataFrame:
    """``(id, th, domain, lang, source, tokens, copies)``, a row for each chosen
    row; ``th`` is the text's hash."""
    none = F.lit("none")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("order_text"),
                       F.coalesce(F.col(lang_col), none).alias("lang"),
                       F.coalesce(F.col(source_col), none).alias("source"), tokens_of(F.col(text_col)).alias("tokens"))
    rows = rows.withColumn("domain", domain_of(F.col("source")))
    targets = leaf_targets(rows, F.expr(f"(total * {int(budget_percent)}) div 100"), weights, max_epochs)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"),
                            F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null"), "order_text"))))
    keyed = rows.join(targets.filter("target > 0"), list(LEAF)).withColumn("key", key)
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("held"))
    ahead = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0).cast("long"))).drop("held")
    run = (Window.partitionBy(*LEAF, "bucket").orderBy("key", "id", "tokens")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = keyed.join(sums, [*LEAF, "bucket"]).withColumn("upto", F.col("ahead") + F.sum("tokens").over(run))
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("upto") <= F.col("rest")), 1).otherwise(0)
    return placed.select("id", "th", *LEAF, "tokens", copies.cast("long").alias("copies")).filter("copies > 0")


def mix(docs: DataFrame, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int = 2,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source", domain_of=numbered_domain, tokens_of=byte_tokens) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens, copies)`` of the chosen
    documents: ``copies`` epochs of each.  The budget is ``budget_percent`` of
    the corpus in tokens."""
    rows = _chosen(docs, budget_percent, weights, max_epochs, seed, id_col, text_col, lang_col, source_col, domain_of, tokens_of)
    return rows.select(F.col("id").alias(id_col), *LEAF, F.col("tokens").alias("n_tokens"), "copies")


def mixed_documents(docs: DataFrame, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int = 2,
                    seed: int = 42, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    source_col: str = "source", domain_of=numbered_domain, tokens_of=byte_tokens) -> DataFrame:
    """The mixture itself: rows of ``docs`` with all their columns, one for
    each epoch that holds the document.

    Rows are found again by id, text, language and source, so rows without an id
    and rows of one id are told apart.  Rows alike in all four are one document:
    it comes as often as they were chosen together, by one of them."""
    rows = _chosen(docs, budget_percent, weights, max_epochs, seed, id_col, text_col, lang_col, source_col, domain_of, tokens_of)
    chosen = rows.groupBy("id", "th", "lang", "source").agg(F.sum("copies").alias("times")).select(
        F.struct("id", "th", "lang", "source").alias("__row"), F.col("times").alias("__times"))
    none = F.lit("none")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                   F.coalesce(F.col(lang_col), none).alias("lang"), F.coalesce(F.col(source_col), none).alias("source"))
    named = docs.withColumn("__row", key)
    # rows that repeat are few or none: only they are brought together
    repeated = named.groupBy("__row").count().filter("count > 1").select("__row")
    same = lambda a, b: a["__row"].eqNullSafe(b["__row"])
    single = named.join(repeated, same(named, repeated), "left_anti")
    one = named.join(repeated, same(named, repeated), "left_semi").dropDuplicates(["__row"])
    rows = single.unionByName(one)
    both = rows.join(chosen, same(rows, chosen)).select(*[rows[c] for c in rows.columns if c != "__row"], "__times")
    return both.withColumn("__epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).drop("__epoch", "__times")
