"""Documents to chunks: two levels of windows, duplicates by content, summaries, metadata and auxiliary queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import EXPANSION_RULES, HIGHLIGHTS, SETTINGS, Settings
from corvane.functions.text import YEAR, content_hash, has_any, let, squeeze, strip, windows

SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def fixed_chunks(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(doc_id, j, chunk) windows whose squeezed text has the least length; j counts all windows from 1."""
    rows = docs.select("doc_id", F.posexplode(windows(F.col("text"), s.chunk, s.overlap)).alias("j", "chunk"))
    return rows.select("doc_id", (F.col("j") + 1).alias("j"), squeeze(F.col("chunk")).alias("chunk")).where(F.length("chunk") >= s.least_chunk)


def parents(corpus: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    size, overlap = s.parent
    # outer: a plain one has its array worked out once more, by the filter that Spark infers
    rows = corpus.select("*", F.posexplode_outer(windows(F.col("text"), size, overlap)).alias("i", "parent_text")).drop("text").where("parent_text IS NOT NULL")
    return rows.withColumn("i", F.col("i") + 1).withColumn("parent_id", F.concat(F.col("doc_id").cast("string"), F.lit("-parent-"), F.col("i").cast("string"))).withColumn("section_hint", section_hint(F.col("parent_text")))


def section_hint(text: Column) -> Column:
    """A chapter, else an article, else the first line that isn't blank, cut to 40 characters."""
    first = F.substring(F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != ""), F.lit(0)), F.lit("")), 1, 40)
    number = "[一二三四五六七八九十百零0-9]+"
    found = [strip(F.regexp_extract(text, rf"(第{number}{k}[^\n。；]*)", 1)) for k in "章条"]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], first)


def summary(text: Column) -> Column:
    """Up to four lines with a marked word, else the first three, each cut to 80 characters, 320 in all."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != "")
    marked = F.slice(F.filter(lines, lambda x: has_any(x, HIGHLIGHTS)), 1, 4)
    chosen = F.when(F.size(marked) > 0, marked).otherwise(F.slice(lines, 1, 3))
    return F.substring(F.array_join(F.transform(chosen, lambda x: F.substring(x, 1, 80)), "；"), 1, 320)


def two_level_chunks(corpus: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Small chunks (first of equal contents of an address) and a summary row for each parent, in one table.

    Texts are dealt out first, so that all cores cut them however few row groups the files have."""
    p = parents(corpus.repartition(F.xxhash64("doc_id", "text")), s)
    pieces = F.transform(windows(F.col("parent_text"), s.chunk, s.overlap), squeeze)  # inside the generator, so that the filter does not squeeze again
    small = p.select("*", F.posexplode_outer(pieces).alias("j", "chunk_text")).withColumn("j", F.col("j") + 1)
    small = small.where(F.length("chunk_text") >= s.least_chunk).withColumn("chunk_text_hash", F.sha1(F.lower("chunk_text")))  # that is content_hash, of a squeezed text
    first = Window.partitionBy("source_url", "chunk_text_hash").orderBy("doc_id", "i", "j")
    small = small.withColumn("r_", F.row_number().over(first)).where("r_ = 1").drop("r_")
    small = small.withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("i").cast("string"), F.col("j").cast("string"))).withColumn("chunk_level", F.lit("small"))
    total = p.withColumn("chunk_text", summary(F.col("parent_text"))).withColumn("chunk_text_hash", content_hash(F.col("chunk_text")))
    total = total.withColumn("j", F.lit(0)).withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.lit("summary"), F.col("i").cast("string"))).withColumn("chunk_level", F.lit("summary"))
    return small.unionByName(total)


def contextual(title: Column, topic: Column, publish: Column, effective: Column, expire: Column, text: Column, section: Column | None = None) -> Column:
    """A chunk's text under its title, topic, dates and section."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    head = [F.concat(F.lit("标题："), title), F.concat(F.lit("主题："), topic), line("发布时间：", publish), line("生效时间：", effective), line("失效时间：", expire)]
    return F.concat_ws("\n", *head, *([line("章节点：", section)] if section is not None else []), F.concat(F.lit("正文："), strip(text)))


def header_metadata(files: DataFrame) -> DataFrame:
    """source_url, title, publish and grab dates and topic of files (name, text) whose first lines carry them."""
    lines = F.split("text", r"\r\n|\r|\n")
    date_ = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
    dated = lambda prefix: F.coalesce(F.regexp_extract(F.get(F.filter(F.slice(lines, 1, 12), lambda x: F.startswith(x, F.lit(prefix)) & x.rlike(date_)), F.lit(0)), date_, 1), F.lit(""))
    topic = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"^[0-9]+-", "")
    title = F.get(F.filter(F.slice(lines, 1, 8), lambda x: F.startswith(x, F.lit("网页标题："))), F.lit(0))
    return files.select(
        "*", F.regexp_extract(F.get(lines, F.lit(0)), r"来源：([^）]+)）", 1).alias("source_url"), F.coalesce(F.nullif(strip(F.regexp_replace(title, "^网页标题：", "")), F.lit("")), topic).alias("source_title"),
        dated("发布时间：").alias("publish_date"), dated("抓取时间：").alias("grab_date"), topic.alias("topic"),
    )


def validity(title: Column, topic: Column, publish: Column, text: Column, notices: tuple = ("公告", "通知"), policies: tuple = ("章程", "政策", "招生", "录取", "资助")) -> tuple[Column, Column]:
    """From when until when a text holds, by its title, its topic and the years that it names."""
    head = F.concat_ws(" ", title, topic)
    year = F.coalesce(F.nullif(F.regexp_extract(head, YEAR, 1), F.lit("")), F.regexp_extract(F.substring(text, 1, 800), YEAR, 1))
    notice, policy = (publish != "") & has_any(head, notices), (year != "") & has_any(head, policies)
    return F.when(notice, publish).when(policy, F.concat(year, F.lit("-01-01"))).otherwise(""), F.when(notice, "").when(policy, F.concat(year, F.lit("-12-31"))).otherwise("")


def keywords(chunk: Column, rules: tuple = EXPANSION_RULES) -> Column:
    found = F.flatten(F.array(*[F.when(chunk.contains(w), F.array(*[F.lit(a) for a in also])).otherwise(F.array().cast("array<string>")) for w, also in rules]))
    first = F.substring(F.coalesce(F.get(F.filter(F.transform(F.split(chunk, r"[。；\n]"), strip), lambda x: x != ""), F.lit(0)), F.lit("")), 1, 18)
    one = lambda x: F.when(x != "", F.array(x)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(let(first, one)))), 1, 3)


def expansions(chunk: Column, title: Column, topic: Column, section: Column, rules: tuple = EXPANSION_RULES) -> Column:
    """Up to three auxiliary queries of a chunk: 4 to 40 characters, with a Han character or a digit, each once whatever the case."""
    empty = F.lit("")
    limits = F.slice(F.array_distinct(F.regexp_extract_all(chunk, F.lit(r"(20[0-9]{2}|[0-9]+元|[0-9]+分|本科|专科|理工类|艺术类|国家助学贷款)"), F.lit(1))), 1, 3)
    year = F.regexp_extract(F.concat_ws(" ", title, chunk), YEAR, 1)
    join = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x != ""), " ")
    anchor = F.coalesce(F.nullif(strip(section), empty), F.nullif(topic, empty), title)

    def made(words: Column, limits: Column, year: Column) -> Column:
        word = F.coalesce(F.get(words, F.lit(0)), empty)
        one = join(topic, anchor, F.when(word != "", word).otherwise("政策"))
        two = F.when(F.size(words) > 0, join(F.coalesce(F.nullif(title, empty), topic), F.array_join(F.slice(words, 1, 2), " "))).otherwise("")
        three = F.when(F.size(limits) > 0, join(year, F.when(F.size(words) > 0, word).otherwise(topic), F.array_join(F.slice(limits, 1, 2), " "))).otherwise("")
        more = join(year, F.coalesce(F.nullif(topic, empty), title), F.lit("官方规定"))
        return let(F.filter(F.array(one, two, three), lambda x: x != ""), lambda some: F.when((F.size(some) < 3) & (year != ""), F.array_append(some, more)).otherwise(some))

    some = let(keywords(chunk, rules), lambda w: let(limits, lambda x: let(year, lambda y: made(w, x, y))))
    good = let(F.lower(squeeze(chunk)), lambda own: F.filter(F.transform(some, squeeze), lambda x: F.length(x).between(4, 40) & (F.lower(x) != own) & x.rlike(r"[\x{4e00}-\x{9fff}0-9]")))
    once = F.aggregate(good, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return F.slice(once, 1, 3)


def sparse_view(content: Column, queries: Column) -> Column:
    """What the sparse index sees of a chunk: its content and its auxiliary queries."""
    return F.concat_ws("\n", content, F.when(F.size(queries) > 0, F.array_join(F.transform(queries, lambda q: F.concat(F.lit("辅助查询："), q)), "\n")))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs and joined up again with an overlap."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    if sep:
        first, *rest = text.split(sep)
        parts = [p for p in [first, *[sep + r for r in rest]] if p]
    else:
        parts = list(text)
    out, held, length = [], [], 0

    def close() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for p in parts:
        if len(p) > size and finer:
            close()
            held, length = [], 0
            out += split_recursively(p, size, overlap, finer)
            continue
        if held and length + len(p) > size:
            close()
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    close()
    return out


def recursive_chunks(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(doc_id, j, chunk) by separators."""
    size, overlap = s.chunk, s.overlap

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.fillna("").map(lambda x: split_recursively(x, size, overlap))

    return docs.select("doc_id", F.posexplode(split("text")).alias("j", "chunk"))
