"""Score text: parts, normalisation, counts, tokens and invalid codes.

Inputs: scores (score_id, text) or parts (score_id, part, part_text). Nothing here gathers
more than one score: windows and ordered joins are by score and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PARTS = 6
TOKEN = r"[a-gA-GrR][+#-]?[0-9]*\.*|[nN][0-9]*\.*|[tToOlLvV][0-9]*\.*|[<>&]|[^\s]"
#: Maximal codes for the check of single characters: a code and what clings to it.
CODE = r"[a-grR][+#-]*[0-9]*\.*|[A-Za-z][0-9]*\.*|[0-9]+|\s+|[^A-Za-z0-9\s]"


def dealt(parts: DataFrame) -> DataFrame:
    """Parts dealt by score and part while they are texts: windows over what is cut from them then shuffle nothing more."""
    return parts.repartition("score_id", "part")


def normalize_command_case(parts: DataFrame, col: str = "part_text") -> DataFrame:
    """T, O, L and V in upper case; r, n and a to g in lower; other letters as they are."""
    return parts.withColumn(col, F.translate(col, "tolvRNABCDEFG", "TOLVrnabcdefg"))


def _body(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(bare.rlike(r"(?is)^\s*MML\s*@"), F.regexp_replace(F.regexp_replace(bare, r"(?is)^\s*MML\s*@", ""), r"\s*;?\s*$", "")).otherwise(bare)


def split_parts(scores: DataFrame, max_parts: int = MAX_PARTS, strict: bool = False) -> DataFrame:
    """(score_id, part, part_text), trimmed; strict drops scores with brackets, others are cut to max_parts."""
    if strict:
        scores = scores.where(~F.col("text").rlike(r"[\[\]]"))
    body = scores.select("score_id", _body(F.col("text")).alias("body"))
    return body.select("score_id", F.posexplode(F.split("body", ",")).alias("part", "part_text")).where((F.col("part") < max_parts)).select("score_id", "part", F.trim("part_text").alias("part_text"))


def compose_mml(parts: DataFrame, preserve_empty: bool = True, part_count: int = MAX_PARTS) -> DataFrame:
    """(score_id, text): parts in order between MML@ and ``;``, blanks kept up to part_count or dropped."""
    kept = parts if preserve_empty else parts.where(F.trim("part_text") != "")
    listed = kept.where(F.col("part") < part_count).groupBy("score_id").agg(F.map_from_entries(F.collect_list(F.struct("part", F.trim("part_text")))).alias("m"))
    if preserve_empty:
        joined = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(part_count - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(""))), ",")
    else:
        joined = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda i: F.col("m")[i]), ",")
    return listed.select("score_id", F.concat(F.lit("MML@"), joined, F.lit(";")).alias("text"))


def normalize_display(scores: DataFrame) -> DataFrame:
    """Scores as ``MML@`` with exactly six case-normalised parts."""
    pieces = F.transform(F.split(_body(F.col("text")), ","), lambda p: F.trim(F.translate(p, "tolvRNABCDEFG", "TOLVrnabcdefg")))
    six = F.slice(F.concat(pieces, F.array_repeat(F.lit(""), MAX_PARTS)), 1, MAX_PARTS)
    return scores.select("score_id", F.concat(F.lit("MML@"), F.array_join(six, ","), F.lit(";")).alias("text"))


def valid_mml_file(scores: DataFrame) -> DataFrame:
    return scores.select("score_id", F.trim("text").rlike(r"(?s)^MML@.*;$").alias("is_valid"))


def tokenize_parts(parts: DataFrame) -> DataFrame:
    """(score_id, part, tok, raw, kind, num, dots, acc) up to a ``;``; kinds: note rest N T O L V < > & bad."""
    body = F.regexp_extract(F.col("part_text"), r"(?s)^[^;]*", 0)
    raw = F.col("raw")
    head = F.lower(F.substring(raw, 1, 1))
    digits = F.regexp_extract(raw, "[0-9]+", 0)
    kind = (
        F.when(head.rlike("[a-g]"), "note").when(head == "r", "rest").when(head.rlike("[ntolv]"), F.upper(head)).when(raw.isin("<", ">", "&"), raw).otherwise("bad")
    )
    tokens = parts.select("score_id", "part", F.posexplode(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))).alias("tok", "raw"))
    return tokens.select(
        "score_id", "part", "tok", "raw", kind.alias("kind"),
        F.when(digits != "", F.expr("try_cast(regexp_extract(raw, '[0-9]+', 0) AS int)")).alias("num"),
        F.length(F.regexp_extract(raw, r"\.*$", 0)).alias("dots"),
        F.when(head.rlike("[a-g]"), F.length(F.regexp_replace(raw, "[^+#]", "")) - F.length(F.regexp_replace(raw, "[^-]", ""))).otherwise(0).alias("acc"),
    )


def invalid_code_spans(parts: DataFrame) -> DataFrame:
    """(score_id, part, offset, length) of codes that are no valid, case-normalised MML.

    A code is valid if it is a note or rest with a valid length and dots, N 0-127, T 32-255, O 0-9,
    L or V with a valid number, < or >, white space, or & before a note or rest.
    """
    pieces = dealt(parts.select("score_id", "part", "part_text")).select("score_id", "part", F.posexplode(F.regexp_extract_all("part_text", F.lit(CODE), F.lit(0))).alias("i", "code"))
    order = Window.partitionBy("score_id", "part").orderBy("i")
    placed = pieces.select("*", (F.sum(F.length("code")).over(order) - F.length("code")).cast("int").alias("offset"))
    following = F.lead("code").over(order)  # white space comes in maximal runs: what follows one is solid
    after = F.when(following.rlike(r"^\s"), F.lead("code", 2).over(order)).otherwise(following)
    code, length = F.col("code"), r"(1|2|4|8|16|32|64)?"
    good = (
        code.rlike(rf"^([a-g][+#-]?|r){length}\.*$") | code.rlike(r"^n([0-9]|[0-9][0-9]|1[01][0-9]|12[0-7])\.*$") | code.rlike(r"^T(3[2-9]|[4-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")
        | code.rlike(r"^O[0-9]$") | code.rlike(r"^L(1|2|4|8|16|32|64)\.*$") | code.rlike(r"^V([0-9]|1[0-5])$") | code.rlike(r"^(\s+|[<>])$") | ((code == "&") & F.coalesce(F.col("after").rlike("^[a-grn]"), F.lit(False)))
    )
    return placed.withColumn("after", after).where(~good).select("score_id", "part", "offset", F.length("code").alias("length"))


def invalid_code_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("score_id", "part").agg(F.sum("length").alias("n_bad"))


def match_spans(df: DataFrame, keys: list[str], col: str, pattern: str) -> DataFrame:
    """keys, n, offset, raw of each match: an offset is what pieces and matches before it hold."""
    both = F.arrays_zip(F.split(col, pattern, -1).alias("gap"), F.regexp_extract_all(col, F.lit(pattern), F.lit(0)).alias("raw"))
    found = df.select(*keys, F.posexplode(both).alias("n", "x")).select(*keys, "n", F.col("x.gap").alias("gap"), F.col("x.raw").alias("raw"))
    order = Window.partitionBy(*keys).orderBy("n")
    at = F.sum(F.length("gap") + F.coalesce(F.length("raw"), F.lit(0))).over(order) - F.length("raw")
    return found.select(*keys, "n", at.cast("int").alias("offset"), "raw").where("raw IS NOT NULL")


def tempo_code_spans(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """(score_id, part, start, end) of tempo codes that touch no invalid span."""
    found = match_spans(parts, ["score_id", "part"], "part_text", r"[tT]\s*[0-9]+").select("score_id", "part", F.col("offset").alias("start"), (F.col("offset") + F.length("raw")).alias("end"))
    bad = spans.select(F.col("score_id").alias("b_score"), F.col("part").alias("b_part"), F.col("offset").alias("b_from"), (F.col("offset") + F.col("length")).alias("b_to"))
    on = (F.col("score_id") == F.col("b_score")) & (F.col("part") == F.col("b_part")) & (F.col("b_from") < F.col("end")) & (F.col("b_to") > F.col("start"))
    return found.join(bad, on, "left_anti")


def char_counts(parts: DataFrame) -> DataFrame:
    """(score_id, part, chars) with totals by score (part null) and of all (both null)."""
    return parts.rollup("score_id", "part").agg(F.sum(F.length(F.trim("part_text"))).alias("chars"))


def channel_counts(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part") < MAX_PARTS).groupBy("score_id").agg(F.count_if(F.trim("part_text") != "").alias("channels"))


def over_limit_parts(parts: DataFrame, max_chars: int = 2400) -> DataFrame:
    return parts.select("score_id", "part", F.length("part_text").alias("chars")).where(F.col("chars") > max(200, max_chars))


def shaped(candidates: DataFrame) -> DataFrame:
    """Candidates of the MML alphabet with a command: only these need to be parsed."""
    return candidates.where(F.col("part_text").rlike(r"^[A-GNOLRTVa-gnolrtv0-9+#.&<>\s-]+$") & F.col("part_text").rlike(r"(?i)[a-grnt]"))


def looks_like_part(candidates: DataFrame, errors: DataFrame) -> DataFrame:
    """Shaped candidates whose parts have no parse error."""
    return shaped(candidates).join(errors.select("score_id", "part"), ["score_id", "part"], "left_anti")
