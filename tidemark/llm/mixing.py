"""Mixing sources to target weights over a domain, language and source tree.

The budget goes down the tree. At each node it is shared among the children by weight; a child that holds
fewer tokens than its share gives the shortage to its siblings, and only what all of them together cannot
supply goes back to the parent's siblings. In closed form: a child is exhausted if and only if
``capacity * (weights of it and of the children with larger capacity per weight) <= weight * (budget left)``.
Each leaf then takes a prefix of its token stream: epoch after epoch, each in an order drawn from the seed.

Prefixes are found without sorting a leaf in one place: a leaf's last epoch is cut into ``BUCKETS`` ranges of
its order, the tokens per range are summed and accumulated, and only the documents of the one range in which
the budget ends are ordered. That gives one cut per leaf; the documents are then filtered by their leaf's cut
and are never shuffled by it, unless there are more leaves than a broadcast may hold.
A document belongs to the prefix if the running sum with it stays within the leaf's tokens.

Null and unknown domains, languages and sources are the child ``(none)``; unlisted children have weight 1.
Null texts hold no tokens. Rows that agree in doc_id (or have none) and in tokens are taken or left together,
repeated rows among them. An empty table gives no rows. ``mix`` replaces columns of ``docs`` named like a column that it
adds, in any case of letters; ``keep`` gives the columns of ``docs`` as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, numbered, written

NONE = "(none)"
LEVELS = ("domain", "lang", "source")
BUCKETS = 4096
#: Source by its number: a table of four domains is enough to show three levels.
DOMAINS = ("web", "books", "code", "forums")
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"web": 4, "books": 3, "code": 2, "forums": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 1},
}
_WIDE = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The domain of a source named ``src<n>``, by n modulo the number of domains."""
    n = F.regexp_extract(source, r"^src(\d{1,9})$", 1)
    return F.when(n != "", F.element_at(F.array(*map(F.lit, DOMAINS)), (n.cast("int") % len(DOMAINS) + 1).cast("int"))).otherwise(F.lit(NONE))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast(_WIDE)


def _share(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Share ``budget`` among the children of each parent; capacity, weight and the parent's budget come in."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), level)
    to_here, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*parent)
    rows = children.withColumn("used", (F.sum("capacity").over(to_here) - F.col("capacity")).cast(_WIDE))
    rows = rows.withColumn("open", (F.sum("weight").over(whole) - F.sum("weight").over(to_here) + F.col("weight")).cast(_WIDE))
    exhausted = F.col("capacity") * F.col("open") <= F.col("weight") * (F.col("budget") - F.col("used"))
    rows = rows.withColumn("exhausted", F.min(exhausted.cast("int")).over(to_here) == 1)
    rows = rows.withColumn("taken", F.coalesce(F.sum(F.when(F.col("exhausted"), F.col("capacity"))).over(whole), F.lit(0)).cast(_WIDE))
    rows = rows.withColumn("open", F.sum(F.when(~F.col("exhausted"), F.col("weight"))).over(whole).cast(_WIDE))
    part = F.expr(f"cast((budget - taken) * weight div open as {_WIDE})")
    return rows.withColumn("budget", F.when(F.col("exhausted"), F.col("capacity")).otherwise(part)).drop("used", "open", "exhausted", "taken", "weight")


def budgets(leaves: DataFrame, fraction: tuple[int, int], weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """Per leaf (domain, lang, source, tokens): tokens and ``budget``, at most tokens * max_epochs.

    ``fraction``, a ratio of integers, says how much of all tokens the mixture is to hold.
    """
    rows = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast(_WIDE)).withColumn("root", F.lit(0))
    above = rows.groupBy("root").agg(F.expr(f"cast(sum(cast(tokens as {_WIDE})) * {fraction[0]} div {fraction[1]} as {_WIDE})").alias("budget"))
    for depth, level in enumerate(LEVELS):
        parent = ["root", *LEVELS[:depth]]
        nodes = rows.groupBy(*parent, level).agg(F.sum("capacity").cast(_WIDE).alias("capacity")).withColumn("weight", _weight(level, weights))
        above = _share(nodes.join(above.select(*parent, "budget"), parent), parent, level)
    return above.join(leaves, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def _draw(seed: int, epoch: Column) -> Column:
    """60 bits of a seeded digest, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _range_of(draw: Column) -> Column:
    return F.shiftright(draw, 60 - (BUCKETS.bit_length() - 1)).cast("int")


def cuts(narrow: DataFrame, fraction: tuple[int, int], weights: dict[str, dict[str, int]], max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: whole epochs, then how far the next one goes (range, draw and tokens of its last document)."""
    leaf = list(LEVELS)
    plan = budgets(narrow.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), fraction, weights, max_epochs)
    plan = plan.withColumn("epochs", F.expr("case when tokens = 0 then 0 else budget div tokens end").cast("int"))
    plan = written(plan.select(*leaf, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("room")), "mix-plan")
    rows = narrow.join(plan, leaf).withColumn("draw", _draw(seed, F.col("epochs"))).withColumn("range", _range_of(F.col("draw")))
    sums = rows.groupBy(*leaf, "range").agg(F.sum("tokens").alias("held"), F.max("room").alias("room"))
    sums = sums.withColumn("end", F.sum("held").over(Window.partitionBy(*leaf).orderBy("range")))
    last = sums.where(F.col("end") > F.col("room")).groupBy(*leaf).agg(F.min(F.struct("range", (F.col("end") - F.col("held")).alias("begin"))).alias("last"))
    last = written(last.select(*leaf, F.col("last.range").alias("cut_range"), F.col("last.begin").alias("begin")), "mix-ranges")
    edge = rows.join(last, leaf).where(F.col("range") == F.col("cut_range"))
    running = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("draw", "tokens").rangeBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("sum", F.col("begin") + running).where(F.col("sum") <= F.col("room"))
    edge = edge.groupBy(*leaf).agg(F.max(F.struct("draw", "tokens")).alias("cut"))
    out = plan.join(last, leaf, "left").join(edge, leaf, "left")
    out = written(out.select(*leaf, "epochs", F.coalesce("cut_range", F.lit(BUCKETS)).alias("cut_range"), "cut"), "mix-cuts")
    discard(plan, last, narrow)
    return out


ADDED = ("mix_domain", "n_tokens", "epoch", "draw")


def _mixture(docs: DataFrame, fraction: tuple[int, int], weights: dict[str, dict[str, int]] | None, max_epochs: int, seed: int) -> tuple[DataFrame, list[Column]]:
    """The rows of the mixture with the added columns, and the columns of ``docs``, which it holds under other names."""
    weights = WEIGHTS if weights is None else weights
    if any(w < 1 for level in weights.values() for w in level.values()):
        raise ValueError("weights are integers from 1")
    leaf = [c.alias(k) for k, c in zip(LEVELS, (domain_of(F.col("source")), F.coalesce(F.col("lang"), F.lit(NONE)), F.coalesce(F.col("source"), F.lit(NONE))), strict=True)]
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    narrow = written(docs.select(*leaf, "doc_id", tokens.alias("tokens")), "mix-tokens")
    cut = cuts(narrow, fraction, weights, max_epochs, seed)
    columns, back = numbered(docs)
    rows = docs.select(*columns, *leaf, "doc_id", tokens.alias("n_tokens")).join(cut, list(LEVELS))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.col("epochs"), F.lit(max_epochs - 1)))))
    rows = rows.withColumn("draw", _draw(seed, F.col("epoch")))
    at, here = F.struct("draw", F.col("n_tokens").alias("tokens")), _range_of(F.col("draw"))
    below = (here < F.col("cut_range")) | F.coalesce((here == F.col("cut_range")) & (at <= F.col("cut")), F.lit(False))
    return rows.where((F.col("epoch") < F.col("epochs")) | below).withColumnRenamed("domain", "mix_domain"), back


def mix(docs: DataFrame, fraction: tuple[int, int] = (3, 4), weights: dict[str, dict[str, int]] | None = None, max_epochs: int = 1, seed: int = 17) -> DataFrame:
    """The rows of the mixture: all columns of ``docs`` with mix_domain, n_tokens, epoch (from 0) and draw.

    A document stands once for each epoch in which its leaf's prefix holds it.
    """
    rows, columns = _mixture(docs, fraction, weights, max_epochs, seed)
    return rows.select(*[c for c, name in zip(columns, docs.columns, strict=True) if name.lower() not in ADDED], *ADDED)


def keep(docs: DataFrame, fraction: tuple[int, int] = (3, 4), weights: dict[str, dict[str, int]] | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that a mixture of one epoch holds, with their columns."""
    rows, columns = _mixture(docs, fraction, weights, 1, seed)
    return rows.select(*columns)
