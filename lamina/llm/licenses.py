"""License scans by diagonal voting, in DataFrame functions only.

Every word of a text is hashed once, and neighbouring hashes make the rolling
hashes of its word pairs. Those that are no pair of the fixed templates drop out
inside the array; the others are joined to the template positions by hash (and by
the words themselves, so a hit is exact). Hits of one text and template are
gathered by diagonal, the difference of both positions: a phrase that stands whole
in the text gives one diagonal with a vote for every pair of the template.
Diagonals a few words apart belong to one notice with words put in or left out;
they are merged. A merged span is verified by place: what counts is the longest
chain of its hits that rises in the text and in the template and is not much wider
than the template, so the right words in another order are no notice.

The join partner is the template table, fixed below, so it is broadcast. A
sentinel at the end of every text carries its word count through the same join,
so texts are read and cut into words once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import texts, tune

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of well-known license notices, found even with words put in, changed or left out.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "you may not use this file except in compliance with the license": "apache-grant",
    "subject to the terms of the mozilla public license": "mpl-grant",
    "licensed under the creative commons attribution": "cc-grant",
    "all rights reserved": "all-rights-reserved",
    "released into the public domain": "public-domain",
}
#: Diagonals at most this far apart are one span.
MERGE_WITHIN = 3
#: Share of a notice's word pairs that verifies a merged span.
COVERED = 0.6
#: Words that a verified chain may be wider than its template, as a share of it and besides.
WIDER, SLACK = 1.5, 4
SENTINEL = -1


def _pairs() -> list[tuple[int, str, bool, int, int, str, str]]:
    """Number, label, whether of the contract, pairs, place and both words of each template pair."""
    rows = []
    for number, (phrase, label) in enumerate([*BASE_PHRASES.items(), *NOTICES.items()]):
        words = phrase.split()
        rows += [(number, label, phrase in BASE_PHRASES, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    return rows


def _joint(a: Column, b: Column) -> Column:
    """The hash of a pair, of the hashes of its words."""
    return a.bitwiseXOR(F.shiftleft(b, 1))


def templates(spark: SparkSession) -> DataFrame:
    """One row for each word pair of each template, and the sentinel's row."""
    table = spark.createDataFrame([(SENTINEL, "", True, 1, 0, "", ""), *_pairs()], "template int, label string, base boolean, n_pairs int, at int, t_one string, t_two string")
    return table.withColumn("h", _joint(F.xxhash64("t_one"), F.xxhash64("t_two")))


def _longest_chain(hits: Column, n_pairs: Column) -> Column:
    """Hits of the longest chain that rises in ``pos`` and ``at``, of those not wider than the template allows.

    A fold over the hits by ``pos`` keeps for each template place the longest chain that ends there and where it began.
    """
    width = (n_pairs * WIDER + SLACK).cast("int")
    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("begin"))
    start = F.struct(F.transform(F.sequence(F.lit(1), n_pairs), lambda _: none).alias("ends"), F.lit(0).alias("best"))

    def step(state: Column, hit: Column) -> Column:
        near = F.filter(F.slice(state["ends"], F.lit(1), hit["at"]), lambda x: (x["size"] > 0) & (hit["pos"] - x["begin"] <= width))
        before = F.array_max(near)
        one = F.when(before.isNull(), F.struct(F.lit(1).alias("size"), hit["pos"].alias("begin"))).otherwise(F.struct((before["size"] + 1).alias("size"), before["begin"].alias("begin")))
        kept = lambda x: F.when((x["size"] > 0) & (hit["pos"] - x["begin"] <= width), F.greatest(x, one)).otherwise(one)
        ends = F.transform(state["ends"], lambda x, i: F.when(i == hit["at"], kept(x)).otherwise(x))
        return F.struct(ends.alias("ends"), F.greatest(state["best"], one["size"]).alias("best"))

    return F.aggregate(hits, start, step, lambda state: state["best"])


def scan(docs: DataFrame) -> DataFrame:
    """License places of every whole text.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; ``score`` is the verified share of
    the best template, 0 without one. A null or empty text has no words and empty labels. Repeated rows stay repeated,
    a null key is kept, other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    hashed = cut.select("doc_id", "key", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    table = templates(spark)
    known = [r["h"] for r in table.where(F.col("template") != SENTINEL).select("h").distinct().collect()]  # a fixed few dozen
    joint = F.zip_with("hs", F.slice("hs", F.lit(2), F.greatest(F.size("hs"), F.lit(1))), _joint)
    word = lambda i: F.get("words", i)
    hit = lambda h, i: F.when(h.isin(known), F.struct(i.alias("pos"), h.alias("h"), word(i).alias("one"), word(i + 1).alias("two")))
    whole_row = F.struct(F.size("words").alias("pos"), _joint(F.xxhash64(F.lit("")), F.xxhash64(F.lit(""))).alias("h"), F.lit("").alias("one"), F.lit("").alias("two"))
    found = F.concat(F.filter(F.transform(joint, hit), lambda x: x.isNotNull()), F.array(whole_row))
    each = hashed.select("doc_id", "key", F.inline(found))
    hits = each.join(F.broadcast(table), "h").where((F.col("one") == F.col("t_one")) & (F.col("two") == F.col("t_two")))

    whole = F.col("template") == SENTINEL
    diagonal = F.when(whole, F.col("pos")).otherwise(F.col("pos") - F.col("at"))
    place = F.struct(F.col("pos").alias("pos"), F.col("at").alias("at"))
    votes = hits.groupBy("doc_id", "key", "template", "label", "base", "n_pairs", diagonal.alias("diagonal")).agg(F.collect_set(place).alias("seen"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= MERGE_WITHIN, 0).otherwise(1)
    # a base phrase has to stand whole, so only its full diagonals go on and none are merged
    useful = votes.where(whole | ~F.col("base") | (F.size("seen") == F.col("n_pairs")))
    spans = useful.withColumn("opens", F.when(F.col("base"), F.lit(1)).otherwise(opens)).withColumn("span", F.sum("opens").over(own))
    merged = spans.groupBy("doc_id", "key", "template", "label", "base", "n_pairs", "span").agg(
        F.min("diagonal").alias("start"), F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"), F.max("rows").alias("rows")
    )
    touched = F.size(F.array_distinct(F.transform("seen", lambda x: x["at"])))
    candidate = merged.where(F.col("base") | (touched >= COVERED * F.col("n_pairs")))
    share = F.when(F.col("base"), F.lit(1.0)).otherwise(_longest_chain(F.col("seen"), F.col("n_pairs")) / F.col("n_pairs"))
    good = candidate.withColumn("share", share).where(F.col("share") >= COVERED)
    is_base = F.col("base") & ~whole
    found = good.groupBy("doc_id", "key").agg(
        F.max(F.when(whole, F.col("start"))).cast("long").alias("n_words"),
        F.max(F.when(whole, F.col("rows"))).alias("copies"),
        F.count_if(is_base).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(~whole, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    again = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.drop("_copy", "copies", "key")
