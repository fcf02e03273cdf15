"""Licence scans: lines compared with licence templates by Dice over word bigrams.

All of it is DataFrame operations. A line is lower-cased and reduced to runs of
a-z and 0-9. Its number of distinct bigrams bounds the templates it can resemble:
Dice of at least t needs sizes within a factor of t / (2 - t). Lines that no template
can match are dropped before their bigrams are spread; the rest meet the templates'
bigrams in an equi-join, and shared bigrams are counted before rows move.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleanery.llm.common import two_columns

#: Usual wordings of licence notices, one line each.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
THRESHOLD = 0.75
#: Templates are joined by broadcast; more bigrams than this are refused.
TEMPLATE_BIGRAMS = 100_000


def _let(value, body):
    """Evaluates ``value`` once for all its uses in ``body``; a plain column would be inlined into each."""
    return F.transform(F.array(value), body)[0]


def bigrams(text):
    """Distinct word bigrams of a normalised text; a single word is its own bigram, no word gives none."""

    def pairs(words):
        joined = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(joined))

    return _let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), pairs)


def license_matches(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per line that resembles a template: id, line (from 1), license, dice.

    A line gets its best template: highest Dice, then first name. Lines end at line
    feeds; lines without a-z or 0-9 match nothing. Null and empty texts give no rows.
    Rows that share an id are one document: the same line of them counts once for each
    distinct wording. Other columns are ignored.
    """
    spark = df.sparkSession
    named = spark.createDataFrame(sorted(templates.items()) or [("", "")], "license string, template string")
    named = named.withColumn("b", bigrams(F.col("template"))).withColumn("size_t", F.size("b")).filter("size_t > 0")
    sizes = [r["size_t"] for r in named.select("size_t").collect()]
    if sum(sizes) > TEMPLATE_BIGRAMS:
        raise ValueError(f"templates have more than {TEMPLATE_BIGRAMS} bigrams")
    factor = threshold / (2 - threshold)
    low, high = min(sizes, default=1) * factor, max(sizes, default=0) / factor
    spread = named.select("license", "size_t", F.explode("b").alias("bigram"))

    rows = two_columns(df, id_col, text_col)
    lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    none = F.array().cast("array<struct<size_l:int,wording:int,bigram:string>>")

    def sized(b):
        spread = F.transform(b, lambda x: F.struct(F.size(b).alias("size_l"), F.hash(b).alias("wording"), x.alias("bigram")))
        return F.when(F.size(b).between(low, high), spread).otherwise(none)

    met = lines.select("id", "line", F.explode(_let(bigrams(F.col("content")), sized)).alias("x")).select("id", "line", "x.*")
    met = met.join(F.broadcast(spread), "bigram")
    met = met.filter((F.col("size_l") >= F.lit(factor) * F.col("size_t")) & (F.col("size_l") * F.lit(factor) <= F.col("size_t")))
    shared = met.groupBy("id", "line", "wording", "license", "size_l", "size_t").agg(F.countDistinct("bigram").alias("both"))
    scored = shared.withColumn("dice", 2 * F.col("both") / (F.col("size_l") + F.col("size_t"))).filter(F.col("dice") >= threshold)
    best = Window.partitionBy("id", "line", "wording").orderBy(F.desc("dice"), "license")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select(
        F.col("id").alias(id_col), (F.col("line") + 1).cast("bigint").alias("line"), "license", "dice"
    )


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_matches, licenses (sorted names, comma-joined; null if none), best_license, best_dice.

    The best is the match of highest Dice, then first name, then first line.
    """
    matches = license_matches(df, id_col, text_col, **options)
    found = matches.groupBy(F.col(id_col).alias("i")).agg(
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"),
    )
    rows = df.select(F.col(id_col).alias("id")).join(found, F.col("id").eqNullSafe(F.col("i")), "left")
    return rows.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"), "licenses",
        F.col("best.license").alias("best_license"), (-F.col("best.d")).alias("best_dice"),
    )
