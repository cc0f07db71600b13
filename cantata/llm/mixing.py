"""Mixing sources to target weights by hierarchical budgeting.

The leaves of the domain-language-source tree hold documents. A token budget flows from the
root down: at each node it is dealt to the children by weight, no child gets more than its
subtree can give (its tokens times the epochs allowed), and what a full child cannot take
goes to its siblings. Only if all siblings are full does a shortage reach an ancestor's
siblings, since a subtree's capacity bounds what its parent is given. The division has a
closed form: children sorted by capacity per weight, running sums, no loop.

Each leaf then takes whole epochs and, of the last one, the prefix of documents in a seeded
order that fits its budget. The order is split into ranges of the seeded hash, so that a
leaf with a third of all rows is summed by range and only the range in which the budget
ends is sorted; nothing gathers a leaf in one task. All budgets are integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.llm.common import same, staged

#: Target weights by domain; a language's or a source's share in its parent is equal unless given.
WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SHARE, MAX_EPOCHS, SEED, RANGES = 0.6, 3, 17, 4096
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source of the synthetic tables, by its number: web, books or code; other names are web."""
    number = F.try_to_number(F.regexp_extract(source, r"([0-9]{1,6})$", 1), F.lit("999999"))
    return F.when(number % 4 == 1, "books").when(number % 4 == 3, "code").otherwise("web")


def weight_of(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, w in weights.items():
        out = F.when(column == key, F.lit(w)).otherwise(out)
    return out.cast("long")


def _deal(children: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Adds budget: the parent's (column ``pot``) over children by weight ``w``, at most ``cap`` each.

    In the order of cap / w, a child is full if its share of what those before it left covers its
    cap; then the rest share by weight, rounded down, and the first of them take what rounding left.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), child)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    full = children.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps"), (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"))
    full = full.withColumn("full", F.expr("cap * w_left <= (pot - caps) * w"))
    rest = full.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)).alias("taken"),
        F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), F.lit(0)).alias("w_rest"),
    )
    dealt = rest.withColumn("budget", F.expr("CASE WHEN full THEN cap ELSE w * (pot - taken) div w_rest END"))
    left = dealt.select("*", (F.least("pot", F.sum("cap").over(whole)) - F.sum("budget").over(whole)).alias("left"), F.row_number().over(Window.partitionBy(*parent, "full").orderBy(child)).alias("rn"))
    more = F.when(~F.col("full") & (F.col("rn") <= F.col("left")), F.least(F.lit(1), F.col("cap") - F.col("budget"))).otherwise(0)
    return left.withColumn("budget", F.col("budget") + more).drop("caps", "w_left", "full", "taken", "w_rest", "left", "rn")


def leaf_budgets(leaves: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf; leaves: domain, lang, source, w_domain, w_lang, w_source, tokens.

    The table has a row per source and language, not per document. What has a weight of zero or less, at any
    level, has no budget: its siblings share.
    """
    thousandth = round(share * 1000)
    weights = [f"w_{level}" for level in LEVELS]
    none = F.least(*weights) <= 0
    caps = leaves.withColumn("cap", F.when(none, F.lit(0)).otherwise(F.col("tokens") * max_epochs)).withColumns({w: F.greatest(w, F.lit(1)) for w in weights})
    node = {n: caps.groupBy(*LEVELS[:n]).agg(F.sum("cap").alias("cap"), F.first(f"w_{LEVELS[n - 1]}").alias("w")) for n in (1, 2)}
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    top = _deal(node[1].withColumn("pot", F.lit(int(total) * thousandth // 1000)).withColumn("root", F.lit(0)), ["root"], "domain").select("domain", F.col("budget").alias("pot"))
    k = lambda df, names: df.select(*[F.col(n).alias(f"p_{n}") for n in names], "pot")
    on = lambda a, b, names: a.join(b, [same(a[n], b[f"p_{n}"]) for n in names]).drop(*[f"p_{n}" for n in names])
    mid = _deal(on(node[2], k(top, LEVELS[:1]), LEVELS[:1]), LEVELS[:1], "lang").select("domain", "lang", F.col("budget").alias("pot"))
    low = caps.select(*LEVELS, "tokens", "cap", F.col("w_source").alias("w"))
    return _deal(on(low, k(mid, LEVELS[:2]), LEVELS[:2]), LEVELS[:2], "source").select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weights: dict[str, int] = WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """The documents of the mixture: doc_id, domain, lang, source, n_tokens, epochs (how often it is taken).

    A token is a word between white space; null and empty texts have none and are never taken; very
    long texts are counted whole.
    A null lang or source is a leaf of its own. The order of an epoch is md5 of seed, leaf epoch
    and doc_id, then doc_id, so ties are repeated doc_ids only: these rows are taken together or
    not, as one document of the sum of their tokens. An empty table gives no rows.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(domain if domain is not None else domain_of(F.col(source_col)), F.lit("web")).alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
    )
    base = staged(base).where("n_tokens > 0")  # ids, names and counts: no text
    leaves = base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = staged(leaves.select("*", weight_of(F.col("domain"), weights).alias("w_domain"), weight_of(F.col("lang"), lang_weights).alias("w_lang"), F.lit(1).cast("long").alias("w_source")))
    budgets = leaf_budgets(leaves, share, max_epochs)
    plan = staged(budgets.select(*[F.col(n).alias(f"b_{n}") for n in LEVELS], F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("part")))
    on_leaf = lambda a: [same(a[n], plan[f"b_{n}"]) for n in LEVELS]
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranked = base.join(plan, on_leaf(base)).drop(*[f"b_{n}" for n in LEVELS])
    ranked = ranked.select("*", rank.alias("rank")).withColumn("range", F.expr(f"cast(conv(substr(rank, 1, 8), 16, 10) AS bigint) * {ranges} div 4294967296"))

    sums = ranked.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("t"), F.first("part").alias("part"))
    run = Window.partitionBy(*LEVELS).orderBy("range")  # at most `ranges` rows a leaf
    cut = sums.select("*", F.sum("t").over(run).alias("upto"))
    edge = staged(cut.select(*[F.col(n).alias(f"e_{n}") for n in LEVELS], F.col("range").alias("e_range"), (F.col("upto") - F.col("t")).alias("before"), (F.col("upto") <= F.col("part")).alias("inside")))
    placed = ranked.join(edge, [same(ranked[n], edge[f"e_{n}"]) for n in LEVELS] + [ranked["range"] == edge["e_range"]])
    inside = placed.where("inside").select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + 1).alias("epochs"))
    beyond = placed.where("NOT inside AND before >= part").select("doc_id", *LEVELS, "n_tokens", F.col("whole").alias("epochs"))
    upto = Window.partitionBy(*LEVELS, "range").orderBy("rank", "doc_id")
    split = placed.where("NOT inside AND before < part").select("*", (F.col("before") + F.sum("n_tokens").over(upto)).alias("upto"))
    split = split.select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + (F.col("upto") <= F.col("part")).cast("int")).alias("epochs"))
    return inside.unionByName(beyond).unionByName(split).where("epochs > 0")
