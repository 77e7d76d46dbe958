"""Licence scans by sparse TF-IDF cosine and directory inheritance (operator 3, native).

``own_licences`` takes whole texts. Each line, sentence (wrapped or not), block of lines and the whole text is a unit, with no
word asked of it. Units are compared with statements, notices, titles and whole licence texts, with weights from these
templates alone, so names, years and wrapping do not count. A template is found in a unit whose cosine with it is
``threshold`` or more and that holds ``SHARE`` of its weight. Less than that share is left without the template's anchors
(its longest words, over 1 - SHARE of its weight), so texts and units without any are passed over without loss. SPDX tags
are read as written.

``statements`` is the narrower form whose results the SQL of op3_licence_scan fixes: single lines that hold a licence
word, against one sentence a licence. Equal lines are one row with its count, so a line that a third of all files carry
costs as much as any. The best template at ``threshold`` or more is the line's, and the best line's is the file's.

In both, a file without a licence takes that of the nearest directory upwards that a licence file declares, found by
equi-joins of directories with their ancestors. All steps are built-in functions.

Defined cases: a null text has no statement; a null path is the root directory's; ties between templates and between
licence files go to the smaller name; repeated rows get equal results; extra columns are kept where asked for; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key

#: SPDX identifiers and the statement each is known by.
TEMPLATES = {
    "AGPL-3.0": "this work is licensed under the gnu affero general public license version 3",
    "Apache-2.0": "licensed under the apache license version 2.0",
    "BSD-3-Clause": "redistribution and use in source and binary forms are permitted under the bsd 3 clause license",
    "CC-BY-4.0": "licensed under creative commons attribution cc by 4.0",
    "CC-BY-NC-4.0": "licensed under cc by nc 4.0",
    "GPL-2.0": "this work is licensed under the gnu general public license version 2",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "LGPL-3.0": "this work is licensed under the gnu lesser general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license version 2.0",
    "Proprietary": "all rights reserved",
}
TRIGGER = r"(?i)licen[sc]e|copyright|spdx|all rights reserved|redistribution"
#: The same for Java, whose (?i) knows ASCII only: SQL's also takes the long s.
JAVA_TRIGGER = r"(?i)licen[sſc]e|copyright|[sſ]pdx|all right[sſ] re[sſ]erved|redi[sſ]tribution"
TERM = r"[0-9a-z]+(?:\.[0-9]+)*"

_NOTICE = "this program is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_LATER = _NOTICE + " either version {} of the license or at your option any later version"


def _gnu(name: str, short: str, version: str) -> list[str]:
    return [
        f"this work is licensed under the {name} version {version}", f"licensed under the {name} version {version}", f"{name} version {version}", f"{name} v{version}", f"{short} version {version}",
        f"{short}v{version}", f"{short} {version}", _LATER.format(name, version), _NOTICE.format(name) + f" version {version} of the license", _NOTICE.format(f"{name} version {version}"),
    ]


#: The statements, notices and titles of licences, beside the whole texts in licence_texts.
STATEMENTS = {
    "AGPL-3.0": [*_gnu("gnu affero general public license", "agpl", "3"), "gnu affero general public license version 3 19 november 2007"],
    "Apache-2.0": [
        "licensed under the apache license version 2.0", "apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache license version 2.0 january 2004",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    ],
    "BSD-2-Clause": ["released under the bsd 2 clause license", "bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["redistribution and use in source and binary forms are permitted under the bsd 3 clause license", "bsd 3 clause license", "new bsd license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CC-BY-4.0": ["licensed under creative commons attribution cc by 4.0", "licensed under cc by 4.0", "creative commons attribution 4.0 international license", "creative commons attribution 4.0 international public license"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial 4.0 international public license"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike 4.0 international public license"],
    "CC0-1.0": ["cc0 1.0 universal", "creative commons zero cc0 1.0 universal public domain dedication"],
    "GPL-2.0": [*_gnu("gnu general public license", "gpl", "2"), "gnu general public license version 2 june 1991"],
    "GPL-3.0": [*_gnu("gnu general public license", "gpl", "3"), "gnu general public license version 3 29 june 2007"],
    "ISC": ["released under the isc license", "isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL-2.1": [*_gnu("gnu lesser general public license", "lgpl", "2.1"), "gnu lesser general public license version 2.1 february 1999"],
    "LGPL-3.0": [*_gnu("gnu lesser general public license", "lgpl", "3"), "gnu lesser general public license version 3 29 june 2007"],
    "MIT": [
        "released under the mit license", "licensed under the mit license", "mit license", "the mit license mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license version 2.0", "mozilla public license version 2.0", "mozilla public license 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"],
    "Proprietary": ["all rights reserved"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
}
#: A template is found only in units that hold this share of its weight.
SHARE = 0.8
SPDX = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX_NONE = r"^(AND|OR|WITH|NONE|NOASSERTION)$|[Ee]xception"
SPDX_TAIL = r"(-only|-or-later|\+)?[.-]*$"
#: Ends of sentences inside a line, and at its end.
STOP, STOP_END = r"([.;!?])[ \t]+", r"[.;!?][ \t\r]*$"


def template_terms() -> list[tuple[str, int, list[str]]]:
    """(licence, number, terms) of all templates: statements, then whole texts."""
    forms = [(k, t) for k, v in STATEMENTS.items() for t in v]
    forms += [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]
    return [(k, n, re.findall(TERM, t.lower())) for n, (k, t) in enumerate(forms)]


@cache
def _weights() -> tuple[dict[str, float], list[tuple[str, int, str, float, bool, float, float]]]:
    """idf by term; (licence, template, term, weight, whether it is an anchor, the template's length and total weight)."""
    forms = [(k, n, Counter(t)) for k, n, t in template_terms()]
    df = Counter(t for _, _, c in forms for t in c)
    idf = {t: math.log((1.0 + len(forms)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for licence, n, c in forms:
        y = {t: (1 + math.log(k)) * idf[t] for t, k in c.items()}
        total, held, anchors = sum(y.values()), 0.0, set()
        for t in sorted(y, key=lambda t: (-len(t) * t.isalpha(), -idf[t], t)):
            if held > (1 - SHARE) * total + 1e-5 * total:
                break
            held += y[t]
            anchors.add(t)
        rows += [(licence, n, t, w, t in anchors, math.sqrt(sum(v * v for v in y.values())), total) for t, w in y.items()]
    return idf, rows


def _terms(text: Column) -> Column:
    # in SQL the dotted capital I becomes a plain i; Java adds a combining dot, which would end the term
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), F.lit(TERM), F.lit(0))


def _units(texts: DataFrame) -> DataFrame:
    """texts(file, text) -> file, line, sentence, block, terms: pieces of lines that no unit cuts."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    parts = F.split(F.regexp_replace("body", STOP, "$1\u0001"), "\u0001")
    lines = lines.select("file", "line", (~F.lower("body").rlike("[0-9a-z]")).alias("blank"), parts.alias("parts"))
    pieces = lines.select("file", "line", "blank", F.size("parts").alias("n"), F.posexplode("parts").alias("place", "piece"))
    ends = F.col("blank") | (F.col("place") < F.col("n") - 1) | F.col("piece").rlike(STOP_END)
    before = Window.partitionBy("file").orderBy("line", "place").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    return pieces.select("file", "line", count(ends).alias("sentence"), count(F.col("blank")).alias("block"), _terms(F.col("piece")).alias("terms"))


def own_licences(files: DataFrame, threshold: float) -> DataFrame:
    """files(text) -> file (the text's key), licence, score: the best licence found in each distinct text that has any.

    A reservation of all rights counts only where no other licence is found.
    """
    spark = files.sparkSession
    idf, rows = _weights()
    anchors = sorted({r[2] for r in rows if r[4]})
    some = F.arrays_overlap(_terms(F.col("text")), F.array(*map(F.lit, anchors)))
    texts = files.filter(F.col("text").contains("SPDX-License-Identifier:") | some).groupBy(text_key(F.col("text")).alias("file")).agg(F.first("text").alias("text"))
    texts = materialize(texts, "licence-texts")
    words = F.broadcast(spark.createDataFrame([(t, w, t in set(anchors)) for t, w in idf.items()], "term string, idf double, marks boolean"))
    forms = F.broadcast(spark.createDataFrame(rows, "licence string, form int, term string, y double, anchor boolean, length double, total double"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("no")) for k, c in enumerate(("line", "sentence", "block"))], F.struct(F.lit(3).alias("kind"), F.lit(0).cast("long").alias("no")))
    found = _units(texts).select("file", "line", "sentence", "block", F.explode("terms").alias("term")).join(words, "term")
    found = found.select("file", F.explode(kinds).alias("unit"), "term", "idf", "marks").groupBy("file", "unit", "term", "idf", "marks").agg(F.count("*").alias("tf"))
    x = (F.log("tf") + 1) * F.col("idf")
    units = found.groupBy("file", "unit").agg(F.sqrt(F.sum(x * x)).alias("size"), F.max("marks").alias("marked"), F.collect_list(F.struct("term", x.alias("x"))).alias("v")).filter("marked")
    pairs = units.select("file", "unit", "size", F.explode("v").alias("v")).select("file", "unit", "size", "v.*").join(forms, "term")
    pairs = pairs.groupBy("file", "unit", "size", "licence", "form", "length", "total").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum("y").alias("held"), F.max("anchor").alias("marked"))
    score = F.round(F.col("dot") / (F.col("size") * F.col("length")), 6)
    pairs = pairs.filter(F.col("marked") & (F.round(F.col("held") / F.col("total"), 6) >= SHARE)).select("file", "licence", score.alias("score")).filter(F.col("score") >= threshold)
    tags = texts.filter(F.col("text").contains("SPDX-License-Identifier:")).select("file", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("tag"))
    tags = tags.select("file", F.explode(F.regexp_extract_all("tag", F.lit(SPDX_ID), F.lit(0))).alias("id")).filter(~F.col("id").rlike(SPDX_NONE))
    tags = tags.select("file", F.regexp_replace("id", SPDX_TAIL, "").alias("licence"), F.lit(1.0).alias("score"))
    order = F.struct(F.col("licence") == "Proprietary", -F.col("score"), F.col("licence"))
    return pairs.unionByName(tags).groupBy("file").agg(F.min_by(F.struct("licence", "score"), order).alias("own")).select("file", "own.licence", "own.score")


def statements(files: DataFrame, threshold: float) -> DataFrame:
    """files(path, text) -> line, licence, score: distinct licence lines and their best template."""
    lines = files.filter(F.col("text").rlike(JAVA_TRIGGER)).select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(JAVA_TRIGGER))
    lines = materialize(lines.groupBy("line").agg(F.count("*").alias("n")), "licence-lines")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tf = lines.select("line", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count("*").alias("tf"))
    templates = files.sparkSession.createDataFrame([(k, t) for k, v in TEMPLATES.items() for t in v.split()], "licence string, term string").groupBy("licence", "term").agg(F.count("*").alias("tt"))
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    idf = df.select("term", weight.alias("idf"))
    line_terms = tf.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("x"))
    template_terms = templates.join(df, "term", "left").select("licence", "term", (F.col("tt") * weight).alias("y"))
    line_size = line_terms.groupBy("line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("line_size"))
    template_size = template_terms.groupBy("licence").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("template_size"))
    dots = line_terms.join(template_terms, "term").groupBy("line", "licence").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("line_size") * F.col("template_size")), 6)
    scored = dots.join(line_size, "line").join(template_size, "licence").select("line", "licence", cosine.alias("score")).filter(F.col("score") >= threshold)
    best = Window.partitionBy("line").orderBy(F.desc("score"), "licence")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("line", "licence", "score")


def scan(files: DataFrame, is_licence_file: Column, keep: list[str], threshold: float = 0.6, lines_only: bool = False) -> DataFrame:
    """files(path, text, ...) -> keep, path, own_licence, score, licence, origin (own, inherited, none), distance.

    ``is_licence_file`` may use path, words (of the text) and the input's columns. With ``lines_only`` licences are
    those of single lines that hold a licence word.
    """
    files = files.withColumn("path", F.coalesce("path", F.lit("")))
    if lines_only:
        known = statements(files, threshold)
        # the file's lines, kept only for files with any; the rest of the plan is narrow
        key = F.xxhash64(F.col("path"), *[F.col(c) for c in keep])
        lines = files.filter(F.col("text").rlike(JAVA_TRIGGER)).select(key.alias("file"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(JAVA_TRIGGER)).distinct()
        own = lines.join(known, "line").groupBy("file").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("licence"))).alias("own")).select("file", "own.licence", "own.score")
    else:
        key = text_key(F.col("text"))
        own = own_licences(files, threshold)
    rows = files.select(*keep, "path", is_licence_file.alias("declares"), key.alias("file"))
    folder = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    rows = rows.join(own, "file", "left").withColumn("folder", folder)
    declared = rows.filter(F.col("declares") & F.col("licence").isNotNull()).groupBy("folder").agg(F.min_by("licence", F.struct("path", "licence")).alias("declared"))
    # each folder with all its ancestors, itself at distance 0
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    up = rows.select("folder").distinct().select("folder", F.explode(F.sequence(F.lit(0), depth)).alias("distance"))
    ancestor = F.expr("array_join(slice(split(folder, '/'), 1, greatest(0, size(split(folder, '/')) - distance)), '/')")
    near = up.select("folder", "distance", ancestor.alias("above")).join(declared.withColumnRenamed("folder", "above"), "above")
    near = near.groupBy("folder").agg(F.min_by(F.struct("declared", "distance"), "distance").alias("near")).select("folder", "near.declared", "near.distance")
    out = rows.join(near, "folder", "left")
    inherits = F.col("licence").isNull() & F.col("declared").isNotNull()
    return out.select(
        *keep, "path", F.col("licence").alias("own_licence"), "score", F.coalesce("licence", "declared").alias("licence"),
        F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"), F.when(inherits, F.col("distance")).alias("distance"),
    )
