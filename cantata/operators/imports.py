"""Extraction of score text from legacy project files. Inputs: texts (score_id, text). All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantata.operators.text import compose_mml, match_spans

CAP, SELECTED = 96, 6
#: Legal lengths on the 1/64 grid, and what a legacy length is made of. Fixed values.
LEGAL = [1, 2, 4, 8, 16, 32, 64]


def section_blocks(texts: DataFrame) -> DataFrame:
    """(score_id, section, channel_no, line_no, line): lines under the latest ``[Title]``; channel_no of ``[ChannelN]``."""
    lines = texts.select("score_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    order = Window.partitionBy("score_id").orderBy("line_no")
    title = F.regexp_extract("line", r"^\s*\[([^\]]*)\]\s*$", 1)
    marked = lines.withColumn("header", title != "").withColumn("section", F.last(F.when(title != "", title), ignorenulls=True).over(order))
    number = F.expr("try_cast(regexp_extract(section, '(?i)^Channel([0-9]{1,6})$', 1) AS int)")
    return marked.where("NOT header AND section IS NOT NULL").select("score_id", "section", number.alias("channel_no"), "line_no", "line")


def section_channel_name(blocks: DataFrame) -> DataFrame:
    """The first usable ``// name`` comment of each channel."""
    name = F.trim(F.regexp_extract("line", r"^\s*//\s*(.+)$", 1))
    usable = blocks.where("channel_no IS NOT NULL").withColumn("name", name).where((F.col("name") != "") & ~F.col("name").rlike(r"(?i)^(#.*|initialize|init|using_extension|using_channel)$"))
    return usable.groupBy("score_id", "channel_no").agg(F.min_by("name", "line_no").alias("name"))


def section_clean_code(blocks: DataFrame) -> DataFrame:
    """(score_id, channel_no, code): the channel's lines without measure marks, comments and foreign commands."""
    bare = F.regexp_replace(F.regexp_replace("line", r"/\*.*?\*/", ""), r"//.*$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?i)EX[0-9]+", ""), r"(?i)Y\s*[0-9]+\s*,\s*[0-9]+", ""), r"[@~]\s*[0-9]+", "")
    kept = F.regexp_replace(bare, r"[^A-GNOLRTVa-gnolrtv0-9+#.&<>-]", "")
    lines = blocks.where("channel_no IS NOT NULL").select("score_id", "channel_no", "line_no", kept.alias("code"))
    joined = lines.groupBy("score_id", "channel_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "code"))), lambda x: x["code"]), "").alias("code"))
    return joined.where("code <> ''")


def scale_legacy_volume(tokens: DataFrame) -> DataFrame:
    """V over 15 as a MIDI volume: round(min(127, n) * 15 / 127)."""
    loud = (F.col("kind") == "V") & (F.col("num") > 15)
    num = F.when(loud, F.floor(F.least(F.col("num"), F.lit(127)) * 15 / 127 + 0.5).cast("int")).otherwise(F.col("num"))
    return tokens.withColumn("raw", F.when(loud, F.concat(F.lit("V"), num)).otherwise(F.col("raw"))).withColumn("num", num)


def project_global_tempo(blocks: DataFrame) -> DataFrame:
    """(score_id, bpm): the first T of Channel1, else of the file, within 32 to 255."""
    found = blocks.withColumn("t", F.regexp_extract(F.regexp_replace("line", r"/\*.*?\*/|//.*$", ""), r"(?i)T\s*([0-9]{1,6})", 1)).where("t <> ''").withColumn("t", F.col("t").cast("int"))
    first = F.min_by("t", F.struct(F.coalesce(F.col("channel_no") != 1, F.lit(True)), F.col("line_no")))
    return found.groupBy("score_id").agg(F.least(F.lit(255), F.greatest(F.lit(32), first)).alias("bpm"))


def apply_global_tempo(candidates: DataFrame, tempo: DataFrame) -> DataFrame:
    """Puts the score's tempo in front of values that begin with none."""
    joined = candidates.join(tempo, "score_id", "left")
    lead = F.col("value").rlike(r"(?i)^\s*T\s*[0-9]") | F.col("bpm").isNull()
    return joined.withColumn("value", F.when(lead, F.col("value")).otherwise(F.concat(F.lit("T"), F.col("bpm"), F.col("value")))).drop("bpm")


def embedded_mml_candidates(texts: DataFrame, cap: int = CAP) -> DataFrame:
    """(score_id, n, offset, value): the parts of every ``MML@...;`` block, numbered, at most cap a file (the format's limit)."""
    blocks = match_spans(texts, ["score_id"], "text", r"(?i)MML@[^;]*;")
    parts = blocks.select("score_id", "offset", F.posexplode(F.split(F.regexp_replace("raw", r"(?i)^MML@|;$", ""), ",")).alias("k", "value"))
    order = Window.partitionBy("score_id").orderBy("offset", "k")
    return parts.where(F.trim("value") != "").withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("score_id", "n", "offset", "value")


def keyed_candidates(texts: DataFrame, cap: int = CAP) -> DataFrame:
    """Where blocks are too few: values of ``key=value`` lines, of ``<tag>``s, and bare lines of codes, by offset."""
    kinds = [r"(?im)^\s*(?:melody|chord[0-9]*|mml|part[0-9]*)\s*=\s*[^\r\n]+", r"(?i)<(?:melody|chord[0-9]*|mml|part|string)[^>]*>[^<]+", r"(?m)^[A-GNOLRTVa-gnolrtv0-9+#.&<>-]{4,}$"]
    found = None
    for pattern in kinds:
        some = match_spans(texts, ["score_id"], "text", pattern).select("score_id", "offset", F.trim(F.regexp_replace("raw", r"(?i)^\s*\w+\s*=\s*|^<[^>]*>", "")).alias("value"))
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("score_id").orderBy("offset", "value")
    return found.distinct().where("value <> ''").withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("score_id", "n", "offset", "value")


def clean_candidate(col: Column) -> Column:
    """Without CDATA marks, escapes, entities, ``MML@`` and ``;``; \\uXXXX of ASCII letters become those."""
    bare = F.regexp_replace(F.regexp_replace(col, r"<!\[CDATA\[|\]\]>", ""), r"\\[nrt]", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    pieces = F.regexp_extract_all(bare, F.lit(r"(?s)\\u[0-9a-fA-F]{4}|."), F.lit(0))
    text = F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) == 6, F.char(F.conv(F.substring(p, 3, 4), 16, 10).cast("long"))).otherwise(p)), "")
    return F.trim(F.regexp_replace(F.when(bare.contains("\\u"), text).otherwise(bare), r"(?i)^\s*MML@|;\s*$", ""))


def name_markers(texts: DataFrame) -> DataFrame:
    """(score_id, offset, name) of name tags, attributes and keys, each once."""
    kinds = [r"(?i)<name>[^<]+", r'(?i)\bname\s*=\s*"[^"]+', r"(?im)^\s*name\s*=\s*[^\"\r\n]+"]
    found = None
    for pattern in kinds:
        some = match_spans(texts, ["score_id"], "text", pattern).select("score_id", "offset", F.trim(F.regexp_replace("raw", r'(?i)^<name>|^\s*name\s*=\s*"?', "")).alias("name"))
        found = some if found is None else found.unionByName(some)
    return found.where("name <> ''").dropDuplicates(["score_id", "offset", "name"])


def candidate_names(candidates: DataFrame, markers: DataFrame, before: int = 2400, after: int = 900) -> DataFrame:
    """Adds the name of the nearest marker at most ``before`` in front, else at most ``after`` behind, else the marker of the same number."""
    order = Window.partitionBy("score_id").orderBy("offset", "name")
    m = markers.select(F.col("score_id").alias("m_score"), F.col("offset").alias("m_at"), F.col("name").alias("m_name"), F.row_number().over(order).alias("m_n"))
    far = F.col("offset") - F.col("m_at")
    rank = F.when(far.between(0, before), F.struct(F.lit(0).alias("p"), far.alias("d"))).when(far.between(-after, -1), F.struct(F.lit(1).alias("p"), (-far).alias("d"))).when(F.col("n") == F.col("m_n"), F.struct(F.lit(2).alias("p"), F.lit(0).alias("d")))
    met = candidates.join(m, (F.col("score_id") == F.col("m_score")) & (far.between(-after, before) | (F.col("n") == F.col("m_n"))), "left").withColumn("rank", rank)
    return met.groupBy("score_id", "n", "offset", "value").agg(F.min_by("m_name", F.struct("rank", "m_at")).alias("name"))


def _pieces(length: int) -> list[str]:
    """A legacy length as legal ones, rounded to the 1/64 grid, half up; at least 1/64."""
    left, out = max(1, (128 + length) // (2 * length)), []
    for n in LEGAL:
        while left >= 64 // n:
            out.append(str(n))
            left -= 64 // n
    return out


#: An L command whose number an int holds; what is longer leaves the carried length as it is.
CARRYING = r"[lL]0*(?:[0-9]{1,9}|1[0-9]{9}|20[0-9]{8}|21[0-3][0-9]{7}|214[0-6][0-9]{6}|2147[0-3][0-9]{5}|21474[0-7][0-9]{4}|214748[0-2][0-9]{3}|2147483[0-5][0-9]{2}|21474836[0-3][0-9]|214748364[0-7])(?![0-9])"


def legacy_lengths(parts: DataFrame) -> DataFrame:
    """Notes and rests of lengths that are no power of two become sums of legal ones, tied for notes; a legacy L is carried.

    Texts are split in front of each L that carries a length, so each piece has one carried length, and a part is spelled
    within its row: its codes are neither shuffled nor gathered.
    """
    odd = {n: _pieces(n) for n in range(1, 65) if n not in LEGAL}
    table = F.create_map(*[x for n, p in odd.items() for x in (F.lit(n), F.array(*map(F.lit, p)))])
    pattern = r"(?s)[a-gA-GrR][+#-]?[0-9]*\.*|[lL][0-9]+\.*|[nN][0-9]+\.*|[^a-gA-GrRlLnN]+|."
    number = lambda raw: F.nullif(F.regexp_extract(raw, "[0-9]+", 0), F.lit("")).try_cast("int")

    def spelled(code: Column, carried: Column) -> Column:
        raw, head, own = code["raw"], code["head"], code["own"]
        split = F.element_at(table, F.coalesce(own, carried))
        joined = lambda by: F.array_join(F.transform(split, lambda p: F.concat(head, p)), by)
        return (
            F.when(raw.rlike("^[lL]") & F.element_at(table, own).isNotNull(), "")
            .when((head == "") | split.isNull(), raw).when(head.rlike("^[rR]"), joined("")).otherwise(joined("&"))
        )

    def piece(text: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda raw: F.struct(raw.alias("raw"), F.regexp_extract(raw, r"^[a-gA-GrR][+#-]?", 0).alias("head"), number(raw).alias("own")))
        carried = number(F.regexp_extract(text, "^[lL][0-9]+", 0))
        return F.array_join(F.transform(codes, lambda code: spelled(code, carried)), "")

    pieces = F.split("part_text", f"(?={CARRYING})")
    return parts.where("part_text <> ''").select("score_id", "part", F.array_join(F.transform(pieces, piece), "").alias("part_text"))


def parts_topk(candidates: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each file."""
    order = Window.partitionBy("score_id").orderBy("n")
    return candidates.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def select_parts(candidates: DataFrame, k: int = SELECTED) -> DataFrame:
    return parts_topk(candidates, k).select("score_id", (F.row_number().over(Window.partitionBy("score_id").orderBy("n")) - 1).alias("part"), F.col("value").alias("part_text"))


def import_parts(texts: DataFrame) -> DataFrame:
    """Scores from project texts: embedded blocks, cleaned, legal lengths, six parts, composed."""
    found = embedded_mml_candidates(texts).withColumn("value", clean_candidate(F.col("value")))
    return compose_mml(legacy_lengths(select_parts(found)), True)
