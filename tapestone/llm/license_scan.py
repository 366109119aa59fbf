"""License scan: an exact set-similarity join of text blocks with license notices.

A notice of up to n words lies whole in one window of 2n words that begin every n words; these windows are the blocks.
A block holds a notice if at least ``threshold`` of the notice's distinct words are in it. Words are put in one order by
the number of documents that have them, the rarest first. A block that holds a notice has one of its few rarest words
(prefix filter), as many of its words as are needed (length filter), and enough words after the first common one on
either side (positional filter); what passes is counted in full. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases whose places are counted, and short notices of well-known licenses.
PHRASES = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))
NOTICES = (
    ("reserved", "all rights reserved"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "released under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
)
#: Templates beyond this number, or with more words, are refused: their words are literals of the plan and their index is broadcast.
MOST_TEMPLATES, MOST_WORDS, LEAST_WIDTH = 1000, 512, 8
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. The one other character that lower case turns into ASCII, the Kelvin sign, is replaced by the Angstrom sign first; null has none."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), F.lit(WORD), F.lit(0))


def templates_of(notices: tuple[tuple[str, str], ...], threshold: float) -> list[dict]:
    """Each distinct notice with its words, how many are needed, and the width n of its blocks (a power of two). ValueError beyond the limits."""
    out = []
    for label, text in dict.fromkeys(notices):
        words = re.findall(WORD, text.translate({ord(c): c.lower() for c in LETTERS}))
        if not words or len(words) > MOST_WORDS or len(out) == MOST_TEMPLATES:
            raise ValueError(f"1 to {MOST_WORDS} words a template, and up to {MOST_TEMPLATES} templates")
        distinct = list(dict.fromkeys(words))
        width = max(LEAST_WIDTH, 1 << (len(words) - 1).bit_length())
        out.append({"id": len(out), "label": label, "words": distinct, "need": max(1, math.ceil(round(threshold * len(distinct), 9))), "width": width})
    return out


def rarest_first(words: DataFrame, known: list[str]) -> list[str]:
    """``known`` by the number of rows of ``words`` that have each, then by name. A count for each known word reaches the driver."""
    held = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, known)))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def phrase_places(words: str, phrase: tuple[str, ...]) -> Column:
    """Where the words of a phrase stand one after the other, ascending, words counted from 0."""

    def whole(i: Column) -> Column:
        out = i.isNotNull()
        for k, word in enumerate(phrase[1:], 1):
            out = out & (F.get(F.col(words), i + k) == word)
        return out

    at = F.filter(F.transform(F.col(words), lambda w, i: F.when(w == phrase[0], i)), whole)
    return F.when(F.array_contains(words, phrase[-1]) & F.array_contains(words, phrase[0]), at).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places, blocks) of each row of ``docs``.

    ``places`` are the (label, at) of the fixed phrases, by label, then place. ``blocks`` are the (label, template, start,
    length, containment) of every block that holds at least ``threshold`` of a notice's distinct words: words
    ``start`` to ``start + length`` of the text, by start, length and template. A notice of nine distinct words or fewer must be whole,
    by default. A null or empty text has no words; null and repeated ids are rows of their own; other columns are ignored;
    an empty table gives an empty result. Texts are read twice, for the order of words and for the blocks, and aren't
    shuffled: what is written is the blocks that have a rare word of a notice of their width.
    """
    templates = templates_of(notices, threshold)
    # a generator keeps the words of a text from being taken anew wherever they are used
    words = docs.select(F.col(id_col).alias("_tp_id"), F.explode(F.array(words_of(F.col(text_col)))).alias("words"))
    order = rarest_first(words, sorted({w for t in templates for w in t["words"]}))
    rank = {w: i for i, w in enumerate(order)}
    index, prefixes = [], {}
    for t in templates:
        t["words"].sort(key=rank.__getitem__)
        for i, w in enumerate(t["words"][: len(t["words"]) - t["need"] + 1]):
            index.append((t, i, w))
            prefixes.setdefault(t["width"], set()).add(w)

    def blocks(width: int) -> Column:
        """The blocks of this width with a prefix word, and which template words each has, the rarest first."""
        telling = F.array(*[F.lit(w) for w in sorted(prefixes[width])])
        hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(telling, w), F.floor(i / width).cast("int"))), lambda at: at.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda at: F.when(at > 0, F.array(at, at - 1)).otherwise(F.array(at)))))
        found = F.transform(starts, lambda at: F.struct(F.lit(width).alias("width"), (at * width).alias("start"), F.array_intersect(F.array(*map(F.lit, order)), F.slice("words", at * width + 1, 2 * width)).alias("held")))
        none = F.array().cast("array<struct<width: int, start: int, held: array<string>>>")
        return F.when(F.arrays_overlap("words", telling), found).otherwise(none)

    def named(label: str, at: Column) -> Column:
        return F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))

    places = F.concat(*[named(label, phrase_places("words", phrase)) for label, phrase in PHRASES])
    told = words.select(F.monotonically_increasing_id().alias("_row"), "_tp_id", F.size("words").cast("long").alias("n_words"), places.alias("places"), F.concat(*[blocks(w) for w in sorted(prefixes)]).alias("candidates"))
    told = saved(told, "license-blocks")

    as_rows = F.array(*[F.struct(F.lit(t["width"]).alias("width"), F.lit(w).alias("word"), F.lit(i).alias("i"), F.lit(t["id"]).alias("template"), F.lit(t["label"]).alias("label"), F.array(*map(F.lit, t["words"])).alias("words"), F.lit(t["need"]).alias("need")) for t, i, w in index])
    wanted = docs.sparkSession.range(1).select(F.inline(as_rows))
    block = told.select("_row", F.explode("candidates").alias("c")).select("_row", "c.*")
    tokens = block.select("_row", "width", "start", "held", F.posexplode("held").alias("j", "word"))
    met = tokens.join(F.broadcast(wanted), ["width", "word"])  # bounded by MOST_TEMPLATES and MOST_WORDS
    enough = (F.size("held") >= F.col("need")) & (1 + F.least(F.size("words") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need"))
    overlap = F.size(F.array_intersect("held", "words"))
    close = met.filter(enough).withColumn("overlap", overlap).filter("overlap >= need")
    found = close.select("_row", F.struct(F.col("start").cast("long").alias("start"), (2 * F.col("width")).alias("length"), "template", "label", (F.col("overlap") / F.size("words")).alias("containment")).alias("m"))
    by_row = found.groupBy("_row").agg(F.array_sort(F.collect_set("m")).alias("m"))
    of_block = F.transform("m", lambda m: F.struct(m["label"].alias("label"), m["template"].alias("template"), m["start"].alias("start"), F.least(m["length"].cast("long"), F.col("n_words") - m["start"]).alias("length"), m["containment"].alias("containment")))
    empty = F.array().cast("array<struct<label: string, template: int, start: bigint, length: bigint, containment: double>>")
    return told.join(by_row, "_row", "left").select(F.col("_tp_id").alias(id_col), "n_words", "places", F.coalesce(of_block, empty).alias("blocks"))


def oracle(threshold: float = 0.9) -> str:
    """The same by counting, for every block and notice, the distinct words of the notice in the block."""
    templates = templates_of(NOTICES, threshold)
    told = ", ".join(f"({t['id']}, '{t['label']}', {t['width']}, {t['need']}, {len(t['words'])}, '{w}')" for t in templates for w in t["words"])
    phrase = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE " + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(p)) for label, p in PHRASES
    )
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
places AS ({phrase}),
t(template, label, width, need, size, word) AS (VALUES {told}),
pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM w),
hit AS (SELECT p.doc_id, t.template, t.label, t.need, t.size, t.word, p.p // t.width AS block FROM pos p JOIN t USING (word)),
both_blocks AS (SELECT * FROM hit UNION ALL SELECT * REPLACE (block - 1 AS block) FROM hit WHERE block > 0),
m AS (SELECT doc_id, label, count(DISTINCT word) / any_value(size) AS containment FROM both_blocks GROUP BY doc_id, template, label, block HAVING count(DISTINCT word) >= any_value(need)),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(s) AS score FROM (SELECT doc_id, label, 1.0 AS s FROM places UNION ALL SELECT doc_id, label, containment FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)"""
