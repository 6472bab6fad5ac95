"""Chunking: windows of tokens over sections, packed paragraphs or whole texts.

Tokens are runs without white space. Windows and their rebalancing are closed forms over arrays; packing and
merging reset as they go: folds over a file's own array (`aggregate`) that carry a few numbers and give each item the
number of its group, after which groups are put together by a grouping. So nothing leaves the JVM, each file is a row, and
a file of a million units takes seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsluice.functions.text import normalize, word_count

MAX_TOKENS, OVERLAP, MIN_TOKENS = 512, 64, 30
#: Tokens whose lengths are added up as one when offsets are worked out.
OFFSET_STEP = 1024
#: Items whose group starts a fold notes in one list.
FOLD_STEP = 128
_I = "int"


def window_ranges(n: Column, most: int, overlap: int, least: int) -> Column:
    """Array of (a, b): token ranges of at most `most`, each `most - overlap` on; a last one shorter than
    `least` is evened out with the one before."""
    step = max(1, most - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - most) / F.lit(step)).cast(_I))
    plain = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast(_I).alias("a"), F.least(i * step + most, n).cast(_I).alias("b")))
    a = F.element_at(plain, -2)["a"]
    mid = (a + F.floor((n - a) / 2)).cast(_I)
    even = F.concat(F.slice(plain, 1, F.size(plain) - 2), F.array(F.struct(a.alias("a"), F.least(mid + overlap, n).cast(_I).alias("b")), F.struct(mid.alias("a"), n.cast(_I).alias("b"))))
    short = (F.size(plain) >= 2) & (n - F.element_at(plain, -1)["a"] < least)
    return F.when(n <= 0, F.array().cast("array<struct<a:int,b:int>>")).when(short, even).otherwise(plain)


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _added(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda x, y: x + y)


def windows_of(segments: DataFrame, most: int, overlap: int, least: int) -> DataFrame:
    """segments: file_id, seg_no, seg_start, text and any labels. One row per window: text, tokens, offsets.

    A segment stays one row: its tokens, each with the white space before it, are an array. A window that is the whole
    segment begins where that does; else its offset is the length of all full steps of `OFFSET_STEP` tokens before it and of
    the tokens before it of its own step."""

    def window(tokens: Column, a: Column, b: Column, at: Column) -> Column:
        first = F.get(tokens, a)
        gap = F.length(first) - F.length(F.regexp_replace(first, r"(?U)^\s+", ""))
        text = F.array_join(F.slice(tokens, a + 1, b - a), "")
        return F.struct(F.substring(text, gap + 1, F.length(text)).alias("chunk_text"), (b - a).cast(_I).alias("token_count"), (at + gap).alias("a"), (at + F.length(text)).alias("b"))

    def several(tokens: Column) -> Column:
        def of_steps(lengths: Column, sums: Column) -> Column:
            def before(i: Column) -> Column:
                full = F.floor(i / OFFSET_STEP).cast(_I)
                return F.get(sums, full) + _added(F.slice(lengths, full * OFFSET_STEP + 1, i - full * OFFSET_STEP))

            return F.transform(window_ranges(F.size(tokens), most, overlap, least), lambda w: _bound(before(w["a"]), lambda at: window(tokens, w["a"], w["b"], at)))

        def summed(lengths: Column) -> Column:
            steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / OFFSET_STEP).cast(_I)), lambda g: _added(F.slice(lengths, g * OFFSET_STEP + 1, F.lit(OFFSET_STEP))))
            running = _bound(steps, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda k: _added(F.slice(x, F.lit(1), k))))
            return _bound(running, lambda sums: of_steps(lengths, sums))

        return _bound(F.transform(tokens, F.length), summed)

    def of_tokens(tokens: Column) -> Column:
        whole = window(tokens, F.lit(0), F.size(tokens), F.lit(0))
        return F.when((F.size(tokens) > 0) & (F.size(tokens) <= most), F.array(whole)).otherwise(several(tokens))

    windows = _bound(F.regexp_extract_all("text", F.lit(r"((?U)\s*\S+)"), F.lit(1)), of_tokens)
    each = segments.withColumn("__w", F.explode(windows))
    return (
        each.withColumn("chunk_text", F.col("__w.chunk_text"))
        .withColumn("token_count", F.col("__w.token_count"))
        .withColumn("char_start", (F.col("seg_start") + F.col("__w.a")).cast(_I))
        .withColumn("char_end", (F.col("seg_start") + F.col("__w.b")).cast(_I))
        .drop("text", "seg_start", "__w")
    )


def units(blocks: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """blocks: file_id, page_no, block_no, text (blanks dropped) in reading order. Adds unit_no, the section
    a block starts or stands in, and its character range in the blocks joined by line feeds.

    A block whose normalised text equals a section title starts that section; of titles that are equal so,
    the last one given names it (sections: file_id, section_no, title)."""
    order = Window.partitionBy("file_id").orderBy("page_no", "block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.where("text <> ''").withColumn("unit_no", F.row_number().over(order)).withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast(_I))
    out = out.withColumn("char_end", (F.col("char_start") + F.length("text")).cast(_I))
    if sections is None:
        return out.withColumn("section_title", F.lit(None).cast("string"))
    named = sections.withColumn("__key", normalize(F.col("title"))).where("__key <> ''").groupBy("file_id", "__key").agg(F.max_by("title", "section_no").alias("__title"))
    out = out.withColumn("__key", normalize(F.col("text"))).join(named, ["file_id", "__key"], "left").drop("__key")
    return out.withColumn("section_title", F.last("__title", ignorenulls=True).over(order)).drop("__title")


def section_groups(us: DataFrame) -> DataFrame:
    """Adds seg_no: consecutive units of one section."""
    order = Window.partitionBy("file_id").orderBy("unit_no")
    new = ~F.col("section_title").eqNullSafe(F.lag("section_title").over(order)) | (F.col("unit_no") == 1)
    return us.withColumn("seg_no", F.sum(new.cast(_I)).over(order).cast(_I))


def planned_groups(us: DataFrame, strategy: str, most: int) -> DataFrame:
    """us: units with the seg_no of their section. Sets seg_no by the plan of the file: `section` where a unit
    matched a section, else `paragraph` where there are several, else `sliding` (all one)."""
    fields = ["unit_no", "text", "char_start", "char_end", "page_no", "section_title"]
    listed = us.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(*fields, "seg_no"))).alias("__u"))
    matched = F.exists("__u", lambda u: u["section_title"].isNotNull()) & F.lit(strategy == "section")
    packed = packed_groups(F.transform("__u", lambda u: word_count(u["text"])), most)
    several = (F.size("__u") > 1) & F.lit(strategy != "sliding")
    seg = F.when(matched, F.col("__u")["seg_no"]).when(several, packed).otherwise(F.transform("__u", lambda u: F.lit(1)))
    each = listed.select("file_id", F.explode(F.arrays_zip(F.col("__u").alias("u"), seg.alias("seg_no"))).alias("__z"))
    return each.select("file_id", "__z.seg_no", *(f"__z.u.{c}" for c in fields))


def _groups(items: Column, state: Column, step) -> Column:
    """The group of each item of an array, from 1. step: the state of the group so far, the item, and whether it is the
    very first, to (does it begin a group, the state after it).

    The fold notes where groups begin, for `FOLD_STEP` items in a list of their own: noting copies the list, so n items take
    some n * FOLD_STEP copies, not n * n."""

    def within(acc: Column, x: Column) -> Column:
        new, after = step(acc["state"], x, acc["at"] == 0)
        return F.struct(after.alias("state"), (acc["at"] + 1).alias("at"), F.when(new, F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"))

    def over(these: Column) -> Column:
        def part(acc: Column, k: Column) -> Column:
            begin = F.struct(acc["state"].alias("state"), acc["at"].alias("at"), F.array().cast("array<int>").alias("out"))
            done = F.aggregate(F.slice(these, k * FOLD_STEP + 1, F.lit(FOLD_STEP)), begin, within)
            return _bound(done, lambda d: F.struct(d["state"].alias("state"), d["at"].alias("at"), F.concat(acc["parts"], F.array(d["out"])).alias("parts")))

        begin = F.struct(state.alias("state"), F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
        starts = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(these) - 1) / FOLD_STEP).cast(_I)), begin, part)["parts"])
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(these)))
        numbered = lambda lengths: F.flatten(F.transform(lengths, lambda n, k: F.array_repeat(k + 1, n)))
        return _bound(starts, lambda s: numbered(F.zip_with(s, ends(s), lambda a, b: b - a)))

    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(_bound(items, over))


def packed_groups(sizes: Column, most: int) -> Column:
    """sizes: tokens of a file's units. The group of each, from 1: units packed one after the other while their
    tokens add up to at most `most`."""

    def step(held: Column, n: Column, first: Column) -> tuple[Column, Column]:
        new = first | (held["sum"] + n > most)
        return new, F.struct(F.when(new, n).otherwise(held["sum"] + n).alias("sum"))

    return _groups(sizes, F.struct(F.lit(0).alias("sum")), step)


def merged_groups(items: Column, least: int, most: int) -> Column:
    """items: is_table and token_count of a file's chunks. The group of each, from 1: a chunk shorter than `least`
    joins the group before, if that isn't a table and tokens add up to at most `most`; tables never."""

    def step(held: Column, c: Column, first: Column) -> tuple[Column, Column]:
        sum_ = held["token_count"] + c["token_count"]
        fits = ~first & ~c["is_table"] & ~held["is_table"] & (c["token_count"] < least) & (sum_ <= most)
        return ~fits, F.struct(F.when(fits, False).otherwise(c["is_table"]).alias("is_table"), F.when(fits, sum_).otherwise(c["token_count"]).alias("token_count"))

    return _groups(items, F.struct(F.lit(False).alias("is_table"), F.lit(0).alias("token_count")), step)


def segments_of(grouped: DataFrame) -> DataFrame:
    """One row per segment: its text, start, and its units for looking up pages and sections."""
    us = F.sort_array(F.collect_list(F.struct("unit_no", "text", "char_start", "char_end", "page_no", "section_title")))
    return grouped.groupBy("file_id", "seg_no").agg(us.alias("__us")).select("file_id", "seg_no", F.col("__us")[0]["char_start"].alias("seg_start"), F.array_join(F.col("__us")["text"], "\n").alias("text"), F.transform("__us", lambda u: u.dropFields("text")).alias("us"))


def labelled(chunks: DataFrame) -> DataFrame:
    """Page and section of the unit that holds a chunk's first character. A character at a unit's end belongs
    to that unit; such units lie in the chunk's own segment or, at its very start, end the one before."""
    at = F.element_at(F.filter("us", lambda u: (u["char_start"] <= F.col("char_start")) & (F.col("char_start") <= u["char_end"])), 1)
    return chunks.withColumn("__u", at).withColumn("page_number", F.col("__u")["page_no"]).withColumn("section_title", F.col("__u")["section_title"]).drop("__u", "us")


def merged_chunks(chunks: DataFrame, least: int, most: int) -> DataFrame:
    """chunks: file_id, place, is_table and the chunk's fields. One shorter than `least` joins the chunk before
    (which may have been merged itself) if their tokens add up to at most `most`; tables never. The earlier
    chunk's labels stay, its end moves. chunk_index is the place that is left."""
    kind = "struct<is_table:boolean,place:int,chunk_text:string,token_count:int,page_number:int,sheet_name:string,section_title:string,char_start:int,char_end:int>"
    fields = ["is_table", "place", "chunk_text", "token_count", "page_number", "sheet_name", "section_title", "char_start", "char_end"]
    listed = chunks.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).cast(f"array<{kind}>").alias("__c"))

    seg = merged_groups(F.transform("__c", lambda c: F.struct(c["is_table"].alias("is_table"), c["token_count"].alias("token_count"))), least, most)
    each = listed.select("file_id", F.explode(F.arrays_zip(F.col("__c").alias("c"), seg.alias("seg"))).alias("__z")).select("file_id", "__z.seg", "__z.c.*")
    group = each.groupBy("file_id", "seg").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("g"))
    merged = {"chunk_text": F.array_join(F.col("g")["chunk_text"], "\n"), "token_count": _added(F.col("g")["token_count"]), "char_end": F.try_element_at(F.array_compact(F.col("g")["char_end"]), F.lit(-1))}
    return group.select("file_id", (F.col("seg") - 1).alias("chunk_index"), *(merged.get(x, F.col("g")[0][x]).alias(x) for x in fields if x != "place"))


def chunk_files(blocks: DataFrame, sections: DataFrame | None = None, tables: DataFrame | None = None, *, strategy: str = "section", most: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> DataFrame:
    """blocks → chunks of CHUNKS without ids, plus is_table. Per file: `section` needs a block that matched a
    section, else `paragraph`; that needs more than one block, else `sliding`. Tables (file_id, table_no,
    page_no, sheet_name, text) follow the text, each whole."""
    us = section_groups(units(blocks, sections if strategy == "section" else None))
    body = labelled(windows_of(segments_of(planned_groups(us, strategy, most)), most, overlap, least))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("seg_no", "char_start"))
    body = body.select("file_id", place.alias("place"), F.lit(False).alias("is_table"), "chunk_text", "token_count", "page_number", F.lit(None).cast("string").alias("sheet_name"), "section_title", "char_start", "char_end")
    if tables is not None:
        extra = tables.where(F.trim("text") != "").select("file_id", F.col("table_no").cast(_I).alias("place"), F.lit(True).alias("is_table"), F.col("text").alias("chunk_text"), word_count(F.col("text")).alias("token_count"), F.col("page_no").alias("page_number"), "sheet_name", F.lit(None).cast("string").alias("section_title"), F.lit(None).cast(_I).alias("char_start"), F.lit(None).cast(_I).alias("char_end"))
        body = body.unionByName(extra)
    return merged_chunks(body, least, most).withColumn("chunk_text_norm", normalize(F.col("chunk_text")))


def sliding_chunks(texts: DataFrame, *, most: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> DataFrame:
    """texts: file_id, text. Windows of the whole text: file_id, chunk_index, chunk_text, token_count. White
    space between tokens is one space in the chunk; a file's tokens stay one array in its row."""
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
    each = texts.select("file_id", tokens.alias("__t")).select("file_id", "__t", F.posexplode(window_ranges(F.size("__t"), most, overlap, least)).alias("chunk_index", "__w"))
    size = (F.col("__w.b") - F.col("__w.a")).cast(_I)
    return each.select("file_id", "chunk_index", F.array_join(F.slice("__t", F.col("__w.a") + 1, size), " ").alias("chunk_text"), size.alias("token_count"))


def chunk_metrics(chunks: DataFrame, *, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """Per file: counts, mean, 95th percentile and maximum of tokens, ratios, score."""
    below, cut = F.avg((F.col("token_count") < least).cast("double")), F.avg((F.col("token_count") >= most).cast("double"))
    aligned = F.avg(F.when(~F.col("is_table"), F.col("section_title").isNotNull().cast("double")))
    return chunks.groupBy("file_id").agg(
        F.count("*").alias("chunk_count"), F.round(F.avg("token_count"), 2).alias("token_avg"), F.round(F.expr("percentile(token_count, 0.95)"), 2).alias("token_p95"),
        F.max("token_count").alias("token_max"), F.round(below, 4).alias("below_min_ratio"), F.round(cut, 4).alias("truncated_ratio"),
        F.round(F.coalesce(aligned, F.lit(0.0)), 4).alias("section_alignment_ratio"), F.count_if("is_table").alias("table_chunks"),
        F.round(100.0 * (1 - cut) * (1 - below), 2).alias("chunk_score"),
    )


def metadata_fill(chunks: DataFrame) -> DataFrame:
    share = lambda x: F.round(F.avg(x.cast("double")), 4)
    filled = {c: F.col(n).isNotNull() for c, n in (("page_number_fill", "page_number"), ("sheet_name_fill", "sheet_name"), ("section_title_fill", "section_title"))}
    filled["char_span_fill"] = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    return chunks.groupBy("file_id").agg(F.count("*").alias("chunk_count"), *(share(x).alias(c) for c, x in filled.items()))


def chunk_flags(metrics: DataFrame) -> DataFrame:
    """soft_flag: too many chunks are cut at the limit (from the rounded ratio)."""
    return metrics.withColumn("soft_flag", F.col("truncated_ratio") > 0.30)
