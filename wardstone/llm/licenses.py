"""Licence scans: TF-IDF cosine of statements to templates, then inheritance from the nearest licensed directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, stored, table

#: Wordings that name or make up a licence, by SPDX identifier. Fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": (
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}
#: Each identifier as a source file's tag names it; the GNU ones also with their two endings.
TEMPLATES = {
    name: (*wordings, *(f"SPDX-License-Identifier: {name}{end}" for end in (("", "-only", "-or-later") if "GPL" in name else ("",))))
    for name, wordings in TEMPLATES.items()
}
THRESHOLD = 0.7
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"

_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_BREAK = re.compile(r"<[^>]*>|[\n\r]+|(?<=[.!?;]) ")
#: What parts paragraphs: a tag, or a line without a letter or digit.
_PARAGRAPH = re.compile(r"<[^>]*>|(?:\r\n|\r(?!\n)|\n)[^\n\r0-9A-Za-z<]*(?=[\n\r])")
#: A line's end with the comment signs that begin the next line.
_WRAP = re.compile(r"[\n\r]+[ \t]*(?:[*#;%!]+|//+|--+|\(\*|dnl\b|REM\b)?[ \t]*")
_SENTENCE = re.compile(r"(?<=[.!?]) ")


def terms(statement: str) -> list[str]:
    return _TERM.findall(statement.lower())


def statements(text: str) -> list[str]:
    """Sentences and lines of a text, its tags taken as breaks, then the sentences that its lines or semicolons cut."""
    found = [x for x in _BREAK.split(text) if x and not x.isspace()]
    known = {x.strip() for x in found}
    if "\n" in text or "\r" in text or "; " in text:
        joined = (x.strip() for p in _PARAGRAPH.split(text) if p for x in _SENTENCE.split(_WRAP.sub(" ", p)))
        found += [x for x in joined if x and x not in known]
    return found


class Matcher:
    """Sparse cosine to the templates under given term statistics. Terms of no template have the weight of an unseen one."""

    def __init__(self, n: int, frequencies: dict[str, int], templates: dict[str, tuple[str, ...]]):
        self.unseen = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in frequencies.items()}
        self.names: list[str] = []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for name, wordings in sorted(templates.items()):
            for wording in wordings:
                vector = {t: c * self.idf.get(t, self.unseen) for t, c in Counter(terms(wording)).items()}
                norm = math.sqrt(sum(x * x for x in vector.values()))
                for t, x in vector.items():
                    self.postings.setdefault(t, []).append((len(self.names), x / norm))
                self.names.append(name)

    def best(self, statement: str, least: float = 0.0) -> tuple[float, str] | None:
        """Largest cosine and its licence; None where no cosine can reach `least`, by the share of the norm that template terms make."""
        found = terms(statement)
        inside = [t for t in found if t in self.idf]
        if not inside:
            return None
        known = sum((c * self.idf[t]) ** 2 for t, c in Counter(inside).items())
        if known < least * least * (known + (len(found) - len(inside)) * self.unseen**2):
            return None
        vector = {t: c * self.idf.get(t, self.unseen) for t, c in Counter(found).items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        sums: dict[int, float] = {}
        for t, x in vector.items():
            for k, y in self.postings.get(t, ()):
                sums[k] = sums.get(k, 0.0) + x * y
        scored = [(x / norm, self.names[k]) for k, x in sums.items()]
        top = max(s for s, _ in scored)
        return top, min(name for s, name in scored if s == top)


def remembered(f, most: int = 50_000):
    """f that keeps its results for strings that come again, as pages of one site repeat theirs; emptied when it is full."""
    known: dict = {}

    def call(x: str):
        if x not in known:
            if len(known) >= most:
                known.clear()
            known[x] = f(x)
        return known[x]

    return call


def vocabulary(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({t for wordings in templates.values() for w in wordings for t in terms(w)})


def statement_counts(files: DataFrame, templates: dict[str, tuple[str, ...]]) -> tuple[int, dict[str, int]]:
    """Statements in all texts, and how many hold each template term; one number a term comes to the driver."""
    words = set(vocabulary(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        words_of = remembered(lambda part: words.intersection(terms(part)))
        for batch in batches:
            for text in rows_of(batch, "text"):
                parts = statements(text.as_py() or "")
                n += len(parts)
                for part in parts:
                    found.update(words_of(part))
        found[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r.term: r.n for r in rows}
    return counts.pop("", 0), {t: counts.get(t, 0) for t in words}


def scan_licenses(
    files: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
    license_file: str = LICENSE_FILE,
) -> DataFrame:
    """Licence of each file: id, path, license, score, via (`own`, `directory` or null), directory.

    Input: id, path, text. Every statement of the whole text (a line or sentence, HTML tags taken
    as breaks, and each sentence that goes over several lines, without comment signs) is a sparse TF-IDF vector; inverse frequencies come from all statements of all
    files. The statement nearest to a template gives the file's own licence if their cosine
    reaches the threshold; ties go to the first name. Other files inherit from the nearest
    ancestor directory that a licence file in it, or its index (a path ending in a slash), licenses;
    of several the best score counts, then the first name.

    A version line with the date of a GNU licence is taken for that licence, by itself too. Texts that
    share their first sentences, as BSD-2-Clause and BSD-3-Clause do, go by the sentence nearest to a template.

    Null texts count as empty. Null paths inherit nothing. Repeated rows give a row each. A file
    with neither has null license, score, via and directory. An empty table gives no rows.
    """
    files = files.select("id", "path", "text")
    n, frequencies = statement_counts(files, templates)
    shipped = files.sparkSession.sparkContext.broadcast(Matcher(n, frequencies, templates))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = remembered(lambda x: shipped.value.best(x, threshold))
        for batch in batches:
            names, scores = [], []
            for text in rows_of(batch, "text"):
                found = [b for x in statements(text.as_py() or "") if (b := best(x))]
                top = min(found, key=lambda b: (-b[0], b[1]), default=(0.0, ""))
                names.append(top[1] if top[0] >= threshold else None)
                scores.append(top[0] if top[0] >= threshold else None)
            yield pa.RecordBatch.from_arrays(
                [rows_of(batch, "id"), rows_of(batch, "path"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "path", "license", "score"],
            )

    own = stored(files.mapInArrow(judge, "id long, path string, license string, score double"), "licenses")
    plain = F.regexp_replace(F.regexp_replace("path", r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = F.split(plain, "/")
    placed = own.withColumn("parts", parts).withColumn("base", F.element_at("parts", -1)).withColumn(
        "dirs", F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0)))
    )
    best = Window.partitionBy("directory").orderBy(F.desc("score"), "license")
    licensed = (
        placed.where(F.col("license").isNotNull() & ((F.col("base") == "") | F.col("base").rlike(license_file)))
        .select(F.array_join("dirs", "/").alias("directory"), F.col("license").alias("dir_license"), "score", "license")
        .groupBy("directory", "dir_license", "license").agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(best)).where("place = 1")
        .select("directory", "dir_license", F.col("score").alias("dir_score"))
    )
    orphans = placed.where(F.col("license").isNull() & (F.size("dirs") > 0)).select("path", "dirs").distinct()
    ancestors = orphans.select(
        "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda i: F.struct(
            i.alias("depth"), F.array_join(F.slice("dirs", F.lit(1), i), "/").alias("directory")))).alias("a"),
    ).select("path", "a.depth", "a.directory")
    inherited = ancestors.join(licensed, "directory").groupBy("path").agg(
        F.max(F.struct("depth", "directory", "dir_license", "dir_score")).alias("found")
    )
    return own.join(inherited, "path", "left").select(
        "id", "path",
        F.coalesce("license", "found.dir_license").alias("license"),
        F.coalesce("score", "found.dir_score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("found").isNotNull(), "directory").alias("via"),
        F.when(F.col("license").isNull(), F.col("found.directory")).alias("directory"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("path"), F.col("html").alias("text"))
    return scan_licenses(pages).withColumnRenamed("id", "page_id").withColumnRenamed("path", "url")


QUERIES = {"op4_license_scan": op4_license_scan}
SQL: dict[str, str] = {}
