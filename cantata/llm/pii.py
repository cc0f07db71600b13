"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts their score.

Matches are found by the built-in regular expressions; their offsets follow from the pieces
between them: a match begins after all pieces and matches before it. Texts that cannot
hold a kind (no ``@``, no digit, no ``+``) skip its expression. The kinds email, ip, card and
phone are fixed by contract and always reported; iban (mod 97), ssn and secret (long hexadecimal
or key-like values) are added when their score, raised or lowered by words among the
``CONTEXT`` code points before them (back to the match of the kind before), reaches ``REPORT`` and they
overlap no base span.

Only DataFrame functions run, in one pass without a shuffle. Running sums and maxima are scans by
doubling, n log n in the number of matches, and no step reads a text again for each match, so
very long texts with very many matches take time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the contract, by kind in the order listed. ``\G`` or no local-part character
#: before it is where a leftmost e-mail match can begin: tried elsewhere it fails in the same way,
#: so long runs are scanned once.
#: Possessive loops match the same (what follows them cannot begin inside) and do not recurse.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: What the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{40}|[0-9A-F]{32})(?![A-Za-z0-9])"
#: Words that raise or lower a score, and by how much.
CONTEXT, REPORT = 48, 0.5
RAISE = r"(?i)\b(iban|account|konto|bank|compte|cuenta|ssn|social security|payment|card|call|phone|tel|mail|contact|token|secret|password|passwd|api[_-]?key|key)\b"
LOWER = r"(?i)\b(example|sample|test|dummy|order|invoice|version|serial|commit|checksum|sha1|md5|digest)\b"
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "secret": 0.4}


_MATCH = "array<struct<s:int,e:int,m:string,before:string>>"


def _scan(values: str, combine: str) -> str:
    """SQL of the running combination (of ``x`` and an earlier ``y``) of an array, in log2(n) steps of doubling width."""
    at = "shiftleft(1, k)"
    step = f"transform(acc, (x, i) -> CASE WHEN i >= {at} THEN {combine.replace('y', f'get(acc, i - {at})')} ELSE x END)"
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({values}), 2))) AS int) - 1), {values}, (acc, k) -> {step})"


def _proposed(kind: str) -> str:
    """SQL array of (s, e, m, before) of an expression's matches: code points, end exclusive; before: the text that leads to it.

    m_, p_ and c_kind hold the matches, the pieces between them and the running ends of the matches.
    """
    m, p, c = f"m_{kind}", f"p_{kind}", f"c_{kind}"
    row = f"named_struct('s', c - length(get({m}, i)), 'e', c, 'm', get({m}, i), 'before', right(get({p}, i), {CONTEXT}))"
    return f"CAST(transform({c}, (c, i) -> {row}) AS {_MATCH})"


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The mod-97 check of an IBAN without spaces."""
    moved = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit(""))),
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and found, an array of (s, rank, e, kind, base, score) by start, then kind.

    Null and empty texts have none; repeated rows each get their row; other columns are not read.
    Very long texts are read whole. Of two added spans that overlap, both are reported.
    """
    digit = F.col("text").rlike(r"[0-9][\x20-]?[0-9]")
    guards = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": digit, "phone": F.col("text").rlike(r"\+[0-9]"), "iban": F.col("text").rlike("[A-Z]{2}[0-9]{2}"), "ssn": F.col("text").rlike("[0-9]-[0-9]{2}-[0-9]"), "secret": F.col("text").rlike("[0-9a-f]{32}|[0-9A-F]{32}|AKIA|gh[pousr]_|sk-")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "secret": SECRET}
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    any_kind = F.col("text").rlike("@|[0-9]{2}|[0-9][.-]|\\+[0-9]|[0-9]\\x20|gh[pousr]_|sk-|AKIA|[0-9a-f]{32}|[0-9A-F]{32}")
    texts = base.select("doc_id", F.when(any_kind, F.col("text")).otherwise("").alias("text"))
    none = F.array().cast("array<string>")
    cut = texts.select("doc_id", *[F.when(guards[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in patterns.items()], *[F.when(guards[k], F.split("text", p, -1)).otherwise(none).alias(f"p_{k}") for k, p in patterns.items()])
    ends = {k: _scan(f"transform(m_{k}, (m, i) -> length(m) + length(get(p_{k}, i)))", "x + y") for k in patterns}
    proposed = cut.select("*", *[F.expr(f"CASE WHEN size(m_{k}) = 0 THEN CAST(array() AS array<int>) ELSE {e} END").alias(f"c_{k}") for k, e in ends.items()])
    proposed = proposed.select("doc_id", *[F.expr(_proposed(k)).alias(f"s_{k}") for k in patterns])

    def scored(kind: str, rank: int) -> Column:
        def span(x: Column) -> Column:
            score = SCORES[kind] + F.when(x["before"].rlike(RAISE), 0.2).otherwise(0.0) - F.when(x["before"].rlike(LOWER), 0.3).otherwise(0.0)
            return F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("base"), F.round(score, 3).alias("score"))

        return F.transform(F.filter(f"s_{kind}", lambda x: _VALID[kind](x["m"])), span)

    kinds = list(patterns)
    added = F.filter(F.concat(*[k for k in kinds if k not in BASE]), lambda a: a["score"] >= REPORT)
    spans = proposed.select("doc_id", *[scored(k, i).alias(k) for i, k in enumerate(kinds)]).select("doc_id", F.concat(*BASE).alias("fixed"), added.alias("added"))
    # An added span is free if no base span before it in order ends beyond its start, and none after it begins before its end.
    merged = spans.select("doc_id", "fixed", "added", F.when(F.size("added") == 0, F.array_sort("fixed")).otherwise(F.array_sort(F.concat("fixed", "added"))).alias("all"))
    back = "reverse(transform(`all`, x -> if(x.base, x.s, 2147483647)))"
    marked = merged.select(
        "doc_id",
        "all",
        "added",
        F.expr(f"CASE WHEN size(added) = 0 THEN CAST(array() AS array<int>) ELSE {_scan('transform(`all`, x -> if(x.base, x.e, 0))', 'greatest(x, y)')} END").alias("reach"),
        F.expr(f"CASE WHEN size(added) = 0 THEN CAST(array() AS array<int>) ELSE reverse({_scan(back, 'least(x, y)')}) END").alias("next"),
    )
    # reach and next are named twice each, so that they stay columns and are not found again for each span
    return marked.select("doc_id", F.expr("CASE WHEN size(added) = 0 OR size(reach) = 0 OR size(next) = 0 THEN `all` ELSE filter(`all`, (x, i) -> x.base OR (get(reach, i) <= x.s AND get(next, i) >= x.e)) END").alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
