"""License scans: word grams of texts are joined to places in templates and vote for diagonals. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases that are found as they stand, and the wording of well-known notices.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Words of a gram that phrases and notices are looked up by.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals of a notice so many words apart, and a third of its length at most, are one; it must show this share of its grams,
#: in a span so many times its length.
NEIGHBOUR, SHARE, STRETCH = 8, 0.6, 2
#: Words of a text that are taken apart together.
BLOCK = 256
#: The gram that stands for a text itself, so that one without any hit keeps its row.
ITSELF = -1


def words(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII; null has none."""
    kept = "0123456789abcdefghijklmnopqrstuvwxyz"
    upper = kept[10:].upper()
    other = "".join(chr(c) for c in range(128) if chr(c) not in kept + upper)
    plain = F.translate(F.coalesce(text, F.lit("")), upper + other, kept[10:] + " " * len(other))
    return F.array_remove(F.split(plain, " "), "")


def gram_hash(at: Column, after: Column, i: Column, k: int) -> Column:
    """The hash of the k words from place i of `after`, the first of which is `at`."""
    return F.xxhash64(F.lit(k), at, *(F.get(after, i + j) for j in range(1, k)))


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """A row for each place of each template: its hash, words and what is known of the template. As many rows as the templates
    have words, which are an argument: that bounds what is broadcast."""
    rows = [(label, text.split(), k, base) for own, k, base in ((phrases, PHRASE_GRAM, True), (notices, NOTICE_GRAM, False)) for label, text in own]
    if any(len(w) < k or len(w) - k > 61 for _, w, k, _ in rows):
        raise ValueError(f"a phrase has at least {PHRASE_GRAM} words, a notice {NOTICE_GRAM}, and neither more than 61 grams besides the first")
    grams = [(t, label, base, len(w), len(w) - k + 1, at, k, w[at : at + k]) for t, (label, w, k, base) in enumerate(rows) for at in range(len(w) - k + 1)]
    table = spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(g, ("template", "label", "base", "length", "grams", "place", "k", "gram"), strict=True))) for g in grams))).alias("g")).select("g.*")
    first = F.element_at("gram", 1)
    hashed = F.when(F.col("k") == PHRASE_GRAM, gram_hash(first, F.col("gram"), F.lit(0), PHRASE_GRAM)).otherwise(gram_hash(first, F.col("gram"), F.lit(0), NOTICE_GRAM))
    own = spark.range(1).select(F.lit(ITSELF).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), *(F.lit(0).alias(c) for c in ("length", "grams", "place", "k")), F.array().cast("array<string>").alias("gram"), F.lit(ITSELF).cast("long").alias("hash"))
    return table.withColumn("hash", hashed).unionByName(own)


def hits(docs: DataFrame, id_col: str, text_col: str, templates: DataFrame) -> DataFrame:
    """Per row of docs and gram that it shares with a template: uid (a number of the row), id, n_words, what is known of the
    template, and start, the gram's first word. Every row also has one for the template ITSELF.

    Words are cut into blocks that overlap by a gram; a block's grams are hashed, exploded and joined in one stage, where the
    words themselves are compared as well: a hit is exact. Only hits leave the stage.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 1, F.lit(0)), F.lit(BLOCK)), lambda s: F.slice("words", s + 1, F.lit(BLOCK + NOTICE_GRAM - 1)))
    rows = rows.select("uid", "id", "n_words", F.posexplode(blocks).alias("number", "block"))
    own, block = F.slice("block", 1, BLOCK), F.col("block")

    def hashes(k: int) -> Column:
        return F.transform(own, lambda w, i: gram_hash(w, block, i, k))

    whole = F.when(F.col("number") == 0, F.array(F.lit(ITSELF).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    grams = rows.select("*", F.least(F.size("block"), F.lit(BLOCK)).alias("held"), F.posexplode(F.concat(hashes(PHRASE_GRAM), hashes(NOTICE_GRAM), whole)).alias("at", "of"))
    place = F.col("at") % F.greatest("held", F.lit(1))
    same = F.when(F.col("template") == ITSELF, True).otherwise(F.slice(block, place + 1, F.greatest("k", F.lit(1))) == F.col("gram"))
    found = grams.join(F.broadcast(templates), (F.col("of") == F.col("hash")) & same)
    return found.select("uid", "id", "n_words", "template", "label", "base", "length", "grams", "place", "k", (F.col("number") * BLOCK + place).cast("long").alias("start"))


def spans(found: DataFrame) -> DataFrame:
    """Where templates stand: per row of docs and span the words `first` to `last`, `share` (of the template's grams that stand in it) and
    whether it is taken (`good`). Rows of the template ITSELF are passed on.

    Hits vote for their diagonal, the word at which the template would begin. A phrase stands on one diagonal with all its
    grams. Neighbouring diagonals of a notice are merged, so that words may be added or left out; the different grams in them
    count, and the span's length unless one diagonal has all grams. Copies that follow each other stay apart.
    """
    keys = ["uid", "id", "n_words", "template", "label", "base", "length", "grams", "k"]
    votes = found.groupBy(*keys, (F.col("start") - F.col("place")).alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, place))").alias("seen"), F.min("start").alias("first"), (F.max("start") + F.max("k") - 1).alias("last")
    )
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    begins = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.least(F.lit(NEIGHBOUR), F.floor(F.col("length") / 3)), F.lit(True))
    # the first diagonal of those that are merged names them
    named = votes.withColumn("merged", F.max(F.when(begins, F.col("diagonal"))).over(order))
    own = named.groupBy(*keys, "merged").agg(F.expr("max(bit_count(seen))").alias("alone"), F.expr("bit_count(bit_or(seen))").alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.col("seen") / F.greatest("grams", F.lit(1))
    fits = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("length")
    good = (F.col("template") != ITSELF) & F.when(F.col("base"), F.col("seen") == F.col("grams")).otherwise((F.col("alone") == F.col("grams")) | (share >= SHARE) & fits)
    return own.withColumns({"share": F.when(F.col("template") == ITSELF, 0.0).otherwise(share), "good": good})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """Per row of docs: id, n_words, n_base (places where a phrase stands), first_word and last_word (the smallest and the
    largest of those, in words from 0; null if none), base_labels (of phrases), labels (of phrases and notices; both sorted
    and comma-joined), score (the largest share of a template's grams in one place, 1 where one stands whole, 0 without any).

    phrases must stand word for word, notices may differ (see spans). Null and empty texts have no words and no labels; repeated rows and
    rows without ids are rows of their own; an empty table gives an empty result. Other columns are not carried. Texts are
    read once and not shuffled; what is shuffled are hits, and a row's hits are spread by template and diagonal.
    """
    # the columns' names may clash with the table's own: only the two that are needed go on
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = spans(hits(own, "id", "text", template_grams(docs.sparkSession, phrases, notices)))
    place = F.when(F.col("good") & F.col("base"), F.col("first"))
    label = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = found.groupBy("uid", "id", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"), label(F.col("good") & F.col("base")).alias("base_labels"), label(F.col("good")).alias("labels"), F.max("share").alias("score")
    )
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
