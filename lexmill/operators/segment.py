"""Segmentation of regulations: numbered articles and clauses with chapter and section carried along.

Lines are rows (doc, pos, line). All windows of an operator have one partitioning, by document, so the rows are
shuffled once. A document's lines stand in one window partition: texts of up to some 10**5 lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, article_number, strip

#: Numeral characters that number chapters, sections and articles. Fixed values.
NUMERALS = "一二三四五六七八九十百千零〇两"


def article_label(numerals: str = NUMERALS) -> str:
    """Pattern of an article label: a Chinese numeral, or digits with points; spaces may stand inside."""
    return f"第[{SPACE}]*(?:[{numerals}]+|[0-9]+(?:\\.[0-9]+)*)[{SPACE}]*条"


def text_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, line) of all non-blank lines, trimmed; pos counts all lines from 0."""
    rows = docs.select(doc, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "line"))
    return rows.withColumn("line", strip("line")).where("line <> ''")


def classify_lines(df: DataFrame, line: str = "line", numerals: str = NUMERALS) -> DataFrame:
    """Add kind: chapter, section, article, clause or continuation."""
    x = F.col(line)
    return df.withColumn(
        "kind",
        F.when(x.rlike(f"^(?:第[{numerals}]+章|[A-Z][{SPACE}]*章)"), "chapter")
        .when(x.rlike(f"^(?:第[{numerals}]+节|[A-Z][{SPACE}]*节)"), "section")
        .when(x.rlike("^" + article_label(numerals)), "article")
        .when(x.rlike(f"^[0-9]+(?:\\.[0-9]+)*(?:[{SPACE}]|[\\x{{4e00}}-\\x{{9fff}}])"), "clause")
        .otherwise("continuation"),
    )


def presplit_paras(df: DataFrame, doc: str, pos: str, para: str, numerals: str = NUMERALS) -> DataFrame:
    """Cut a paragraph before those article labels whose numbers go up by one, the first seen starting the run.

    Other labels are citations and stay inside. The fold yields one character for each piece; pieces are then glued by a
    running count.
    """
    pieces = F.split(F.col(para), f"(?=第[{numerals}]+条)")
    number = lambda p: article_number(F.regexp_extract(p, f"^第([{numerals}]+)条", 1))
    rows = df.withColumn("_pieces", pieces).withColumn("_numbers", F.transform("_pieces", number))
    start = F.struct(F.lit(None).cast("int").alias("prev"), F.lit("").alias("cut"))

    def step(s: Column, n: Column) -> Column:
        take = F.coalesce(s["prev"].isNull() & n.isNotNull() | (n == s["prev"] + 1), F.lit(False))
        return F.struct(F.when(take, n).otherwise(s["prev"]).alias("prev"), F.concat(s["cut"], F.when(take, "1").otherwise("0")).alias("cut"))

    labels = F.size(F.filter("_numbers", lambda n: n.isNotNull()))
    rows = rows.withColumn("_cut", F.when(labels > 1, F.aggregate("_numbers", start, step, lambda s: s["cut"])))
    whole = rows.where("_cut IS NULL").select(doc, pos, F.lit(0).alias("part"), para)
    split = rows.where("_cut IS NOT NULL").select(doc, pos, "_cut", F.posexplode("_pieces").alias("k", "piece"))
    at = Window.partitionBy(doc, pos).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    split = split.select(doc, pos, "k", "piece", F.sum(F.substring(F.col("_cut"), F.col("k") + 1, F.lit(1)).cast("int")).over(at).alias("part"))
    split = split.groupBy(doc, pos, "part").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
    split = split.select(doc, pos, F.col("part").cast("int"), strip(F.array_join("p.piece", "")).alias(para)).where(f"{para} <> ''")
    return whole.unionByName(split)


def parse_articles(df: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line", mode: str = "article", numerals: str = NUMERALS) -> DataFrame:
    """One row per article: doc, art_pos, chapter, section, label, body.

    A chapter or section line closes the open article, and lines up to the next article are dropped, as are those
    before the first. A new chapter clears the section. In mode ``clause`` an undotted number opens a chapter and a
    dotted one a clause. Empty bodies are dropped.
    """
    rows = classify_lines(df, line, numerals)
    if mode == "clause":
        label = F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)", 1)
        kind = F.when((F.col("kind") == "clause") & ~label.contains("."), "chapter").when(F.col("kind") == "clause", "article").otherwise("continuation")
        head = f"^[0-9]+(?:\\.[0-9]+)*[{SPACE}]*"
    else:
        kind = F.when(F.col("kind") == "clause", "continuation").otherwise(F.col("kind"))
        label = F.regexp_replace(F.regexp_extract(line, f"^({article_label(numerals)})", 1), f"[{SPACE}]+", "")
        head = f"^{article_label(numerals)}[{SPACE}]*"
    rows = rows.withColumn("kind", kind)
    upto = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_chapters", F.sum((F.col("kind") == "chapter").cast("int")).over(upto))
    rows = rows.withColumn("_block", F.sum((F.col("kind") != "continuation").cast("int")).over(upto))
    rows = rows.withColumn("chapter", F.last(F.when(F.col("kind") == "chapter", F.col(line)), True).over(upto))
    # the section belongs to the chapter in which it stands
    section = F.last(F.when(F.col("kind") == "section", F.struct("_chapters", F.col(line).alias("s"))), True).over(upto)
    rows = rows.withColumn("_section", section)
    rows = rows.withColumn("section", F.when(F.col("_section._chapters") == F.col("_chapters"), F.col("_section.s")))
    own = F.when(F.col("kind") == "article", F.regexp_replace(line, head, "")).otherwise(F.col(line))
    opened = F.when(F.col("kind") == "article", F.struct("chapter", "section", label.alias("label")))
    blocks = rows.groupBy(doc, "_block").agg(
        F.min(F.col(pos)).alias("art_pos"),
        F.max(opened).alias("open"),
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), own.alias("x")))).alias("lines"),
    )
    out = blocks.where("open IS NOT NULL").select(doc, "art_pos", "open.chapter", "open.section", "open.label", F.array_join("lines.x", "\n").alias("body"))
    return out.where(strip("body") != "")


def split_or_fulltext(docs: DataFrame, doc: str, text: str, numerals: str = NUMERALS) -> DataFrame:
    """Articles of the texts that have labels; the other texts, null ones too, as one row without a label.

    A text whose labels all stand inside lines is cut before each of them, and its pieces keep their label.
    """
    one = f"第[{numerals}0-9]+条"
    kind = (
        F.when(F.col(text).rlike(rf"(?m)^[{SPACE}]*{article_label(numerals)}"), "lines")
        .when(F.col(text).rlike(one), "inside").otherwise("none")
    )
    rows = docs.withColumn("_kind", kind)
    bare = lambda at, label, body: [doc, at.alias("art_pos"), *(F.lit(None).cast("string").alias(c) for c in ("chapter", "section")), label.alias("label"), body.alias("body")]
    whole = rows.where("_kind = 'none'").select(*bare(F.lit(0), F.lit(None).cast("string"), F.col(text)))
    pieces = rows.where("_kind = 'inside'").select(doc, F.posexplode(F.split(F.col(text), f"(?={one})")).alias("k", "piece")).where(F.col("piece").rlike(f"^{one}"))
    pieces = pieces.select(*bare(F.col("k"), F.regexp_extract("piece", f"^({one})", 1), strip("piece")))
    return whole.unionByName(pieces).unionByName(parse_articles(text_lines(rows.where("_kind = 'lines'"), doc, text), doc))


def build_chunks(articles: DataFrame, docs: DataFrame, doc: str, source: str) -> DataFrame:
    """Articles with their document's metadata and chunk_id ``<source>::<label or 全文>``."""
    return articles.join(docs, doc).withColumn("chunk_id", F.concat(F.col(source).cast("string"), F.lit("::"), F.coalesce("label", F.lit("全文"))))


def min_length_gate(df: DataFrame, body: str = "body", label: str = "label", min_article: int = 8, min_full: int = 150) -> DataFrame:
    """Add kept and reason: articles need 8 characters without line breaks, whole texts 150."""
    size = F.length(F.replace(F.col(body), F.lit("\n"), F.lit("")))
    least = F.when(F.col(label).isNull(), min_full).otherwise(min_article)
    return df.withColumn("kept", size >= least).withColumn("reason", F.when(size < least, F.concat(F.lit("too short: "), size.cast("string"))))


def assemble_numbers(df: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """Join number fragments ``5.`` ``2.`` and ``1 title`` into rows (doc, pos, number, title); others have no number.

    A number is valid if its first part is 1 to 9 and it has at most four parts; of a longer run of fragments the
    leading ones are text. A fragment run ends with the first line that is not one.
    """
    frag = F.col(line).rlike(r"^[0-9]+\.$")
    rows = df.withColumn("_frag", frag.cast("int"))
    upto = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    # a run holds fragments and the line after them
    rows = rows.withColumn("_run", F.coalesce(F.sum(1 - F.col("_frag")).over(upto), F.lit(0)))
    runs = rows.groupBy(doc, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_frag").alias("f"), F.col(line).alias("x")))).alias("r"))
    parts = F.transform(F.filter("r", lambda x: x["f"] == 1), lambda x: F.regexp_replace(x["x"], r"\.$", ""))
    last = F.element_at("r", -1)
    number = F.regexp_extract(last["x"], rf"^([0-9]+)(?:[{SPACE}]+.*)?$", 1)
    runs = runs.withColumn("_parts", parts).withColumn("_end", F.when(last["f"] == 0, F.nullif(number, F.lit("")))).withColumn("_title", strip(F.regexp_replace(last["x"], r"^[0-9]+", "")))
    frags = F.size("_parts")
    # how many leading fragments stay text: the first part must be one digit 1..9, with at most three fragments
    skip = F.array_min(F.filter(F.sequence(F.lit(0), frags), lambda k: (k < frags) & (frags - k <= 3) & F.coalesce(F.get("_parts", k).rlike("^[1-9]$"), F.lit(False))))
    runs = runs.withColumn("_skip", F.when(F.col("_end").isNotNull() & (frags > 0), skip))
    # fragments that make no number leave the line after them to itself
    runs = runs.withColumn("_top", F.col("_skip").isNull() & (last["f"] == 0) & last["x"].rlike(rf"^[1-9][{SPACE}]+[^{SPACE}]"))
    text = F.when(F.col("_skip").isNotNull(), F.slice("r", F.lit(1), F.col("_skip"))).when(F.col("_top"), F.slice("r", F.lit(1), F.size("r") - 1)).otherwise(F.col("r"))
    plain = runs.select(doc, F.explode(text).alias("x")).select(doc, F.col("x.p").alias("pos"), F.lit(None).cast("string").alias("number"), F.col("x.x").alias("title"))
    joined = F.when(F.col("_top"), F.col("_end")).otherwise(F.array_join(F.concat(F.slice("_parts", F.col("_skip") + 1, frags), F.array("_end")), "."))
    first = F.when(F.col("_top"), last["p"]).otherwise(F.get("r", F.col("_skip"))["p"])
    heads = runs.where("_top OR _skip IS NOT NULL").select(doc, first.alias("pos"), joined.alias("number"), F.col("_title").alias("title"))
    return plain.unionByName(heads)


def group_units(df: DataFrame, doc: str = "doc_id", drop_chapters: tuple[int, ...] = (), min_len: int = 12) -> DataFrame:
    """Roll numbered lines (doc, pos, number, title) up to units of the second level, in order of first appearance.

    Text lines (null number) belong to the number above them. Deeper numbers keep their heading in the text; units
    of fewer than ``min_len`` characters and of dropped chapters go.
    """
    upto = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_num", F.last("number", True).over(upto)).where("_num IS NOT NULL")
    key = F.substring_index("_num", ".", 2)
    rows = rows.withColumn("unit", key).where(~F.substring_index("_num", ".", 1).cast("int").isin(*drop_chapters) if drop_chapters else F.lit(True))
    own = F.col("number") == F.col("unit")
    text = F.when(F.col("number").isNull(), F.col("title")).when(own, F.lit(None)).when(F.col("title") != "", F.concat_ws(" ", "number", "title"))
    units = rows.groupBy(doc, "unit").agg(
        F.min("pos").alias("art_pos"),
        F.max_by(F.when(own, F.col("title")), F.when(own, F.col("pos"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("pos", text.alias("x"))))).alias("t"),
    )
    head = F.when(F.col("heading") != "", F.concat_ws(" ", "unit", "heading"))
    body = strip(F.concat_ws("\n", head, F.nullif(F.array_join("t.x", "\n"), F.lit(""))))
    out = units.select(doc, "art_pos", "unit", F.nullif("heading", F.lit("")).alias("heading"), body.alias("body"))
    return out.where(F.length(F.replace("body", F.lit("\n"), F.lit(""))) >= min_len)


def guarded_clauses(df: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line", stop_chapter: int = 99, max_heading: int = 15) -> DataFrame:
    """(doc, pos, kind, chapter): a number opens a chapter only if it is the next one and its heading is short and no
    sentence; a dotted number opens a clause only if it belongs to a chapter already open; chapter ``stop_chapter``
    ends the document. Whether a number is accepted depends on those accepted before, hence a fold."""
    number = F.regexp_extract(line, rf"^([0-9]+(?:\.[0-9]+)*)[{SPACE}]", 1)
    rest = strip(F.regexp_replace(line, r"^[0-9.]+", ""))
    top = F.try_element_at(F.split(number, r"\."), F.lit(1)).try_cast("int")
    short = (F.length(rest) <= max_heading) & ~rest.contains("。")
    rows = df.select(doc, F.struct(F.col(pos).alias("p"), number.alias("n"), top.alias("t"), short.alias("s")).alias("x"))
    docs = rows.groupBy(doc).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        dotted = x["n"].contains(".")
        chapter = F.coalesce((x["n"] != "") & ~dotted & (x["t"] == s["open"] + 1) & x["s"], F.lit(False))
        now = F.when(chapter, x["t"]).otherwise(s["open"])
        kind = F.when(now >= stop_chapter, "s").when(chapter, "c").when(dotted & (x["t"] >= 1) & (x["t"] <= s["open"]), "l").otherwise("t")
        return F.struct(now.alias("open"), F.concat(s["out"], kind).alias("out"))

    # one character a line; accepted chapters are 1, 2, 3, ..., so a running count numbers them
    flags = docs.withColumn("_kinds", F.aggregate("xs", start, step, lambda s: s["out"]))
    lines = flags.select(doc, "_kinds", F.posexplode("xs").alias("k", "x")).select(doc, "k", F.col("x.p").cast("int").alias("pos"), F.substring(F.col("_kinds"), F.col("k") + 1, F.lit(1)).alias("flag"))
    upto = Window.partitionBy(doc).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.sum((F.col("flag") == "c").cast("int")).over(upto).cast("int")
    names = F.create_map(*(F.lit(v) for pair in (("c", "chapter"), ("l", "clause"), ("t", "text")) for v in pair))
    return lines.withColumn("chapter", chapter).where("flag <> 's'").select(doc, "pos", F.element_at(names, F.col("flag")).alias("kind"), "chapter")


def parent_child_chunks(df: DataFrame, key: str, text: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """Overlapping children of each text that keep the parent's key: child, start and text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length({text}) - {overlap} - 1) div {step}"))) if overlap else F.sequence(F.lit(0), F.expr(f"greatest(length({text}) - 1, 0) div {step}"))
    rows = df.select(F.col(key).alias("parent"), text, F.posexplode(starts).alias("child", "k"))
    return rows.select("parent", "child", (F.col("k") * step).alias("start"), F.substring(F.col(text), F.col("k") * step + 1, F.lit(size)).alias("text"))
