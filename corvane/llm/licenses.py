"""License scans with DataFrame functions only: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates become lower-case words of letters and digits, and those become hashes of five words in a row (a text of fewer
words, but not none, is one). Templates are put in classes by the power of two, 2**c, that covers their shingles. A text's windows of
class c hold 2 * 2**c shingles, and a new one starts every 2**c, so that every stretch as long as a template lies whole in a window.
A template of the class that is contained to ``least`` (0.8) shares 0.19 or more of the union with that window, so with ``bands``
(64) of one row at least one agrees with probability 1 - 0.81**64, over 0.999998. Windows without any shingle of a
template can't agree in any band and are left out before the bands are computed. Candidates are verified by exact containment.

A text's shingles are searched for places first, place by place; windows are cut from the texts that have some, so that no row carries a whole text but
the text's own. Null and empty texts match nothing; null doc_ids and repeated rows keep a row each; without templates or rows nothing
matches; a template of null text or no words is ignored; a very long text is one row (8 bytes a word); columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import columns, read

SHINGLE, BANDS, LEAST = 5, 64, 0.8
#: Templates of at most so many characters in all are broadcast; more are joined by shuffle.
BROADCAST_CHARS = 1 << 20

#: Notices searched for by default; any table of (license_id, text) will do.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-terms", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit-terms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license_id string, text string")


def with_shingles(df: DataFrame) -> DataFrame:
    """``df`` with ``shingles``, hashes in the order of the text, in place of ``text``."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    none = F.array().cast("array<bigint>")

    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)

    return df.withColumn("shingles", F.get(F.transform(F.array(words), hashes), F.lit(0))).drop("text")  # as a lambda's variable, words are made once for each text


def bands(shingles: str, n: int) -> Column:
    per_band = lambda w: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_min(F.transform(w, lambda h: F.xxhash64(h, i))))
    return F.get(F.transform(F.array(shingles), per_band), F.lit(0))


def license_scan(docs: DataFrame, notices: DataFrame | None = None, n_bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """A row for each window and template contained in it: doc_id, row_ (hash of the text), license_id, window (first shingle), containment."""
    notices = columns(notices if notices is not None else templates(docs.sparkSession), "license_id", "text")
    small = (notices.agg(F.sum(F.length("text"))).first()[0] or 0) <= BROADCAST_CHARS
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    known = with_shingles(notices).withColumn("shingles", F.array_distinct("shingles")).where(F.size("shingles") > 0)
    known = known.withColumn("c", F.ceil(F.log2(F.size("shingles"))).cast("int")).withColumnRenamed("shingles", "wanted")
    member = known.select(F.explode("wanted").alias("m_"), F.col("c")).distinct()
    rows = columns(docs, "doc_id", "text").withColumn("row_", F.xxhash64("text"))
    hits = with_shingles(rows).select("doc_id", "row_", F.posexplode("shingles").alias("at", "h")).join(side(member), F.col("h") == F.col("m_"))
    k = F.floor(F.col("at") / F.expr("shiftleft(1, c)")).cast("int")
    places = hits.select("doc_id", "row_", "c", F.explode(F.filter(F.array(k, k - 1), lambda x: x >= 0)).alias("k"))
    places = places.groupBy(F.col("doc_id").alias("d_"), F.col("row_").alias("r_")).agg(F.collect_set(F.struct("c", "k")).alias("places"))  # of one text
    texts = with_shingles(rows.join(places, F.col("doc_id").eqNullSafe(F.col("d_")) & F.col("row_").eqNullSafe(F.col("r_"))))

    def cut(p: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), p["c"])
        return F.struct(p["c"].alias("c"), p["k"].alias("k"), F.array_distinct(F.slice("shingles", p["k"] * step + 1, 2 * step)).alias("window"))

    windows = texts.select("doc_id", "row_", F.explode(F.transform("places", cut)).alias("w")).select("doc_id", "row_", "w.*")
    near = (
        windows.select("doc_id", "row_", "c", "k", "window", F.posexplode(bands("window", n_bands)).alias("band", "value"))
        .join(side(known.select(F.col("c").alias("c_"), "license_id", "wanted", F.posexplode(bands("wanted", n_bands)).alias("b_", "v_"))), (F.col("c") == F.col("c_")) & (F.col("band") == F.col("b_")) & (F.col("value") == F.col("v_")))
        .groupBy("doc_id", "row_", "c", "k", "license_id").agg(F.first("window").alias("window"), F.first("wanted").alias("wanted"))
    )
    share = F.size(F.array_intersect("window", "wanted")) / F.size("wanted")
    return near.select("doc_id", "row_", "license_id", (F.col("k") * F.expr("shiftleft(1, c)")).alias("window"), share.alias("containment")).where(F.col("containment") >= least)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: number of licenses, their ids in order, and the largest containment."""
    docs = columns(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = license_scan(docs).groupBy("doc_id", "row_").agg(F.array_sort(F.collect_set("license_id")).alias("ids"), F.max("containment").alias("containment"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_"))
    found = found.select(F.col("doc_id").alias("d_"), F.col("row_").alias("r_"), "ids", "containment")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("row_") == F.col("r_")), "left").select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment")
    )
