"""URL filter: rules first, then path templates judged by smoothed labelled purity.

Per host, the path's segments form a tree of templates. A segment that is a number, a hexadecimal run or
mixes letters and digits becomes a wildcard. Of the other branches of a node, those whose share of
blocked labels does not differ from that of their labelled siblings (two-proportion z of ``z``) are
merged into the wildcard branch; a branch that differs, or has all the node's labels, stays apart. Branches
without labels stay apart from those with labels: nothing speaks for or against them.

The URLs that a rule decides are the labels, and those of a label table; a rule for a path so labels its
branch only. A template is judged by its own labels: its share of blocked ones, smoothed towards one half.
It is rejected when that exceeds ``reject``, so what has no labels is allowed.

Templates are aggregated before anything is joined; only DataFrame functions run. A round of jobs
splits all open nodes at once. Chains of single children are passed in one step (the common beginning of a node's least and
greatest path), and nodes without labels are closed, so the rounds follow the branchings between labelled
paths, not their length; after ``DEPTH`` branchings a node is judged as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantata.llm.common import staged

#: The contract's rules: host (with its subdomains), path prefix, verdict. Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
WILD = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]+)(\.[A-Za-z]+)?$"
SMOOTHING, Z, REJECT, DEPTH = 2, 1.96, 0.5, 24


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest rule that fits, as its name (what=0) or its verdict (what=1)."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit([h + p, verdict][what])).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", smoothing: int = SMOOTHING, z: float = Z, reject: float = REJECT, depth: int = DEPTH) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, template, verdict.

    labels: optional (page_id, blocked boolean) of pages that no rule decides; blocked wins if they differ.
    A null url, or one without ``://``, has an empty host and path and is judged as the host ''.
    Repeated rows count as often as they occur; very long urls cost no more rounds than others. Without any label
    all templates are allowed; shares of exactly ``reject`` are. A template that was closed early ends in
    ``/**``. Other columns are not read. An empty table gives no rows.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.select("*", rule_of(F.col("host"), F.col("path"), rules, 0).alias("rule"), rule_of(F.col("host"), F.col("path"), rules, 1).alias("ruled"))
    if labels is not None:
        known = labels.where(F.col("blocked").isNotNull()).groupBy(F.col("page_id").alias("l_id")).agg(F.bool_or("blocked").alias("blocked"))
        base = base.join(known, base["page_id"] == known["l_id"], "left").drop("l_id")
    else:
        base = base.withColumn("blocked", F.lit(None).cast("boolean"))
    base = base.withColumn("label", F.coalesce("ruled", F.when(F.col("blocked"), "block").when(~F.col("blocked"), "allow"))).drop("blocked")
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    made = F.transform(parts, lambda s: F.when(s.rlike(WILD), F.concat(F.lit("*"), F.regexp_extract(s, WILD, 1))).otherwise(s))
    tree = base.select("*", made.alias("seg"))
    leaves = staged(tree.groupBy("host", "seg").agg(F.count("label").alias("n"), F.count_if(F.col("label") == "block").alias("bad")))

    judged = _templates(leaves, z, depth)
    shares = judged.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(F.col("host").alias("s_host"), F.col("template").alias("s_template"), ((F.col("bad") + smoothing * 0.5) / (F.col("n") + smoothing)).alias("share"))
    judged = judged.join(shares, (judged["host"] == shares["s_host"]) & (judged["template"] == shares["s_template"]))
    verdicts = staged(judged.select(F.col("host").alias("v_host"), F.col("seg").alias("v_seg"), F.col("template"), "share"))
    out = tree.join(verdicts, (tree["host"] == verdicts["v_host"]) & (tree["seg"] == verdicts["v_seg"]), "left")
    method = F.when(F.round("share", 9) > reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", "template", F.coalesce("ruled", method).alias("verdict"))


def _templates(leaves: DataFrame, z: float, depth: int) -> DataFrame:
    """(host, seg, n, bad, template) of every distinct path; leaves: host, seg, n, bad."""
    names = ["host", "seg", "n", "bad"]
    done, open_ = [], leaves.select(*names, F.lit("").alias("node"), F.col("seg").alias("rest"))
    for turn in range(depth + 1):
        groups = open_.groupBy("host", "node").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.min("rest").alias("a"), F.max("rest").alias("b"))
        # The least and the greatest path of a node share what all share.
        apart = F.expr("array_position(zip_with(a, b, (x, y) -> x <=> y), false)")
        common = F.when(apart > 0, F.slice("a", 1, F.greatest(apart - 1, F.lit(0)).cast("int"))).otherwise(F.slice("a", 1, F.least(F.size("a"), F.size("b"))))
        groups = groups.select(F.col("host").alias("g_host"), F.col("node").alias("g_node"), "all_n", "all_bad", common.alias("common"), (F.col("all_n") == 0).alias("bare"), (F.col("a") == F.col("b")).alias("single"))
        groups = staged(groups)
        met = open_.join(groups, (open_["host"] == groups["g_host"]) & (open_["node"] == groups["g_node"]))
        path = F.concat("node", F.expr("array_join(transform(common, s -> concat('/', s)), '')"))
        full = F.when(path == "", "/").otherwise(path)
        closed = F.col("bare") | F.col("single") | F.lit(turn == depth)
        done.append(staged(met.where(closed).select(*names, F.when(F.col("single"), full).otherwise(F.concat(path, F.lit("/**"))).alias("template"))))
        more = staged(met.where(~closed).select(*names, path.alias("node"), F.expr("slice(rest, size(common) + 1, greatest(size(rest) - size(common), 0))").alias("rest"), "all_n", "all_bad"))
        if more.isEmpty():
            break
        kid = F.coalesce(F.get("rest", F.lit(0)), F.lit(""))  # none: the path ends here
        kids = more.groupBy("host", "node", kid.alias("kid")).agg(F.sum("n").alias("k_n"), F.sum("bad").alias("k_bad"), F.max("all_n").alias("all_n"), F.max("all_bad").alias("all_bad"))
        alike = F.expr(f"k_n > 0 AND all_n > k_n AND abs(k_bad / k_n - (all_bad - k_bad) / (all_n - k_n)) <= {z} * sqrt(all_bad / all_n * (1 - all_bad / all_n) * (1 / k_n + 1 / (all_n - k_n)))")
        step = F.when(F.col("k_n") == 0, F.lit("?")).when(alike & ~F.col("kid").rlike(r"^(\*.*)?$"), F.lit("*")).otherwise(F.col("kid"))
        steps = kids.select(F.col("host").alias("k_host"), F.col("node").alias("k_node"), "kid", step.alias("step"))
        found = more.join(steps, (more["host"] == steps["k_host"]) & (more["node"] == steps["k_node"]) & (kid == steps["kid"]))
        open_ = found.select(*names, F.concat("node", F.lit("/"), "step").alias("node"), F.expr("slice(rest, 2, greatest(size(rest) - 1, 0))").alias("rest"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
