"""Licence notices and texts in documents by Dice coefficient, in DataFrame operations only.

Text is normalised to lower-case letters and digits and becomes word bigrams.
With Dice 2 i / (m + t) >= d, and as i <= m, a template of t bigrams can only
match where i >= d t / (2 - d) of them occur; documents that hold fewer of every
template's bigrams, counted in an equi-join, are dropped.  In the others

* whole lines are held against the notices, and
* windows of consecutive words, over line ends and within longer lines, against
  the notices and the passages of full licence texts.  Words of a window that
  stand before its first or after its last bigram of the template only lower
  its Dice, so windows start and end at such bigrams.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import ascii_lower, broadcast_if_small
from tallyloom.scratch import cut

#: More candidate documents than this are joined by shuffling, not broadcast.
BROADCAST_DOCS = 1_000_000

# Common short licence notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Released under the ISC License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


# Of full texts whose passages are alike the earlier one names them.
FULL_TEXTS = ("MIT", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0")


def passages(text: str, least: int = 12, most: int = 120) -> list[str]:
    """Paragraphs of a licence text: headings of fewer than ``least`` words are
    left out, longer ones than ``most`` words are cut into equal parts."""
    found = []
    for words in map(_words, re.split(r"\n\s*\n", text)):
        parts = -(-len(words) // most)
        if len(words) >= least:
            found += [" ".join(words[len(words) * i // parts : len(words) * (i + 1) // parts]) for i in range(parts)]
    return found


def full_texts() -> list[tuple[str, str]]:
    """Licence and passage of every full licence text, each passage once."""
    folder, found = Path(__file__).parent / "licenses", {}
    for name in FULL_TEXTS:
        for passage in passages((folder / f"{name}.txt").read_text()):
            found.setdefault(passage, name)
    return [(name, passage) for passage, name in found.items()]


def normalised(text: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one space."""
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct bigrams of an array of two or more words."""
    following = F.slice(words, 2, F.size(words) - 1)
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    texts: list[tuple[str, str]] | None = None,
    crowded: int = 2_000,
) -> DataFrame:
    """Return doc_id, line, license, template, shared, dice: the best template
    of every line whose Dice coefficient reaches ``percent`` hundredths, and of
    every window of words elsewhere that does.

    ``line`` counts from 1 and is a window's first; ``template`` is the place in
    ``templates`` from 0 and goes on in ``texts``, passages of full licence
    texts (``full_texts()`` when None), which only windows are held against.  Of
    equal coefficients the earlier template wins.  Of the windows of a document
    those are taken, by Dice, template and place, that share no word with a
    window taken before and no line with a matched line of the same licence or
    of no smaller Dice; matched lines always stay.  A window has at most
    (200 - percent) / percent times its template's bigrams, repeats included.
    Null texts, empty texts and texts of fewer than two words match nothing.  A
    null id stays null; rows that repeat an id and a text give one set of rows.
    An empty table gives an empty result; other columns are ignored.  More than
    ``crowded`` windows that hang together are settled in rounds over words, with
    the same result and in time linear in their number.  The lists
    of templates are constants of the program, which bounds what is broadcast.
    """
    spark = docs.sparkSession
    every = [*templates, *(full_texts() if texts is None else texts)]
    known = [(i, name, _words(text)) for i, (name, text) in enumerate(every)]
    known = [(i, name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))), len(w) - 1) for i, name, w in known if len(w) > 1]
    needed = lambda t: -(-percent * t // (200 - percent))
    known = spark.createDataFrame(
        [(i, name, pairs, len(pairs), needed(len(pairs)), n * (200 - percent) // percent) for i, name, pairs, n in known],
        "template int, license string, known array<string>, t int, needed int, longest int",
    )
    notices = F.col("template") < len(templates)

    # Documents with as many of a template's bigrams as a match takes.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    words = rows.select("doc_id", "h", F.split(normalised(F.col("text")), " ").alias("words")).where(F.size("words") > 1)
    following = F.slice("words", 2, F.size("words") - 1)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), following, lambda a, b: F.concat(a, F.lit(" "), b))
    listed = known.select("template", "needed", F.explode("known").alias("pair")).withColumn("pair_id", F.xxhash64("pair"))
    # A common bigram stands in many passages, so only its number is shuffled; templates come after.
    held = (
        words.select("doc_id", "h", F.explode(pairs).alias("pair"))
        .join(F.broadcast(listed.select("pair", "pair_id").distinct()), "pair")
        .groupBy("doc_id", "h")
        .agg(F.collect_set("pair_id").alias("ids"))
        .select("doc_id", "h", F.explode("ids").alias("pair_id"))
        .join(F.broadcast(listed.select("template", "needed", "pair_id")), "pair_id")
        .groupBy("doc_id", "h", "template", "needed")
        .agg(F.count("*").alias("i"))
        .where(F.col("i") >= F.col("needed"))
    )
    held = cut(held.groupBy("doc_id", "h").agg(F.collect_list("template").alias("held")), "license-held")
    few = broadcast_if_small(held.select(F.col("doc_id").alias("held_id"), F.col("h").alias("held_h"), "held"), BROADCAST_DOCS)
    found = rows.join(few, (F.col("h") == F.col("held_h")) & F.col("doc_id").eqNullSafe(F.col("held_id")))
    found = found.groupBy("doc_id", "h").agg(F.first("held").alias("held"), F.first("text").alias("text"))
    found = found.withColumn("raws", F.split("text", "\n")).select("doc_id", "held", F.transform("raws", lambda x: F.split(normalised(x), " ")).alias("lines"))
    found = cut(found.withColumn("doc", F.monotonically_increasing_id()), "license-candidates")

    # Whole lines.
    key = ["doc", "doc_id", "line"]
    lines = found.select("doc", "doc_id", F.posexplode("lines").alias("at", "words")).where(F.size("words") > 1)
    lines = lines.select("doc", "doc_id", (F.col("at") + 1).alias("line"), bigrams(F.col("words")).alias("pairs")).withColumn("m", F.size("pairs"))
    listed = known.where(notices).select("template", "license", "t", F.explode("known").alias("pair"))
    counted = (
        lines.select(*key, "m", F.explode("pairs").alias("pair"))
        .join(F.broadcast(listed), "pair")
        .groupBy(*key, "m", "template", "license", "t")
        .agg(F.countDistinct("pair").alias("shared"))
        .where(200 * F.col("shared") >= percent * (F.col("m") + F.col("t")))
    )
    dice = (2 * F.col("shared") / (F.col("m") + F.col("t"))).alias("dice")
    best = F.max(F.struct(dice, (-F.col("template")).alias("minus"), "license", "shared"))
    whole = counted.groupBy(*key).agg(best.alias("b"))
    whole = whole.select("doc", "doc_id", F.col("line").cast("int").alias("line"), "b.license", (-F.col("b.minus")).alias("template"), "b.shared", (-F.col("b.dice")).alias("minus"))
    whole = cut(whole, "license-lines")

    # Windows: bigrams start to stop, which are words start to stop + 1.
    placed = F.flatten(F.transform("lines", lambda ws, i: F.transform(F.filter(ws, lambda w: w != ""), lambda w: F.struct((i + 1).cast("int").alias("line"), w.alias("word")))))
    texts_of = found.select("doc", "doc_id", "held", placed.alias("placed"))
    texts_of = texts_of.select("doc", "doc_id", "held", F.col("placed.line").alias("at"), F.col("placed.word").alias("words")).where(F.size("words") > 1)
    texts_of = texts_of.select("doc", "doc_id", "at", pairs.alias("pairs"), F.explode("held").alias("template"))
    hits = F.filter(F.transform("pairs", lambda x, i: F.when(F.array_contains(F.col("known"), x), i.cast("int")).otherwise(-1)), lambda i: i >= 0)
    starts = lambda a, i: F.struct(
        a.alias("start"),
        F.slice("pairs", a + 1, F.col("longest")).alias("local"),
        F.filter(F.slice("hits", i + F.col("needed"), F.col("longest") - F.col("needed") + 1), lambda b: b - a < F.col("longest")).alias("stops"),
    )
    begun = texts_of.join(F.broadcast(known), "template").withColumn("hits", hits)
    begun = begun.select("doc", "doc_id", "at", "template", "license", "known", "t", F.inline(F.transform("hits", starts)))
    lined = F.slice("at", F.col("start") + 1, F.size("local") + 1).alias("ats")
    begun = begun.where(F.size("stops") > 0).select("doc", "doc_id", "template", "license", "known", "t", "start", "local", "stops", lined)
    ended = begun.select("*", F.explode("stops").alias("stop"))
    inside = F.slice("local", 1, F.col("stop") - F.col("start") + 1)
    ended = ended.select(
        "doc", "doc_id", "license", "template", "t", "start", "stop", F.array_distinct(F.slice("ats", 1, F.col("stop") - F.col("start") + 2)).alias("lines"),
        F.size(F.array_distinct(inside)).alias("m"), F.size(F.array_intersect(inside, F.col("known"))).cast("long").alias("shared"),
    ).where(200 * F.col("shared") >= percent * (F.col("m") + F.col("t")))
    ended = cut(ended.select("doc", "doc_id", (-dice).alias("minus"), "template", "start", "stop", "lines", "license", "shared"), "license-windows")

    # Windows on a matched line of the same licence or of no smaller Dice go.
    on = ended.select("doc", "template", "start", "stop", "minus", "license", F.explode("lines").alias("line"))
    lines = whole.select("doc", "line", F.col("minus").alias("line_minus"), F.col("license").alias("line_license"))
    stronger = (F.col("line_minus") <= F.col("minus")) | (F.col("line_license") == F.col("license"))
    gone = on.join(lines, ["doc", "line"]).where(stronger).select("doc", "template", "start", "stop").distinct()
    free = ended.join(gone, ["doc", "template", "start", "stop"], "left_anti").withColumn("line", F.element_at("lines", 1)).drop("lines")
    taken = _best_windows(cut(free, "license-free"), crowded)
    taken = taken.unionByName(whole.select("doc_id", "line", "license", "template", "shared", "minus"))
    return taken.select("doc_id", "line", "license", "template", "shared", (-F.col("minus")).alias("dice"))


def _best_windows(live: DataFrame, crowded: int) -> DataFrame:
    """Of windows those that a walk by Dice, template and place takes: each that
    shares no word with one taken before.

    Windows that hang together over shared words are an island.  A small island
    is walked in one row.  In a large one every window is taken that is the best
    on each of its words, as the walk takes it whatever the others are; what it
    shares words with goes, and the rest is parted into islands again."""
    rank = ["minus", "template", "start", "stop"]
    found = None
    while True:
        before = Window.partitionBy("doc").orderBy("start", "stop", "template").rowsBetween(Window.unboundedPreceding, -1)
        begins = F.coalesce(F.col("start") > F.max("stop").over(before) + 1, F.lit(True))
        running = Window.partitionBy("doc").orderBy("start", "stop", "template").rowsBetween(Window.unboundedPreceding, 0)
        islands = live.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(running))
        item = F.struct(*rank, "line", "license", "shared")
        islands = cut(islands.groupBy("doc", "doc_id", "island").agg(F.array_sort(F.collect_list(item)).alias("ranked")), "license-islands")
        meets = lambda x, k: (x["start"] <= k["stop"] + 1) & (k["start"] <= x["stop"] + 1)
        take = lambda kept, x: F.when(F.exists(kept, lambda k: meets(x, k)), kept).otherwise(F.concat(kept, F.array(x)))
        small = islands.where(F.size("ranked") <= crowded)
        small = small.select("doc_id", F.inline(F.aggregate("ranked", F.slice("ranked", 1, 0), take)))
        columns = ["doc_id", "line", "license", "template", "shared", "minus"]
        found = small.select(columns) if found is None else found.unionByName(small.select(columns))
        large = cut(islands.where(F.size("ranked") > crowded).select("doc", "doc_id", F.inline("ranked")), "license-large")
        if large.isEmpty():
            return found
        spread = large.select("doc", F.struct(*rank).alias("rank"), F.explode(F.sequence("start", F.col("stop") + 1)).alias("word"))
        best = cut(spread.groupBy("doc", "word").agg(F.min("rank").alias("best")), "license-best")
        wins = spread.join(best, ["doc", "word"]).groupBy("doc", "rank").agg(F.bool_and(F.col("best") == F.col("rank")).alias("wins"))
        winners = cut(wins.where("wins").select("doc", "rank"), "license-winners")
        used = winners.select("doc", F.explode(F.sequence("rank.start", F.col("rank.stop") + 1)).alias("word"))
        blocked = spread.join(used, ["doc", "word"], "left_semi").select("doc", "rank.*").distinct()
        found = found.unionByName(large.join(winners.select("doc", "rank.*"), ["doc", *rank], "left_semi").select(columns))
        live = cut(large.join(blocked, ["doc", *rank], "left_anti"), "license-live")


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()
