"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A file's header lines are those that speak of licences or rights; each is compared to every form of every template, by
the cosine of TF-IDF vectors (document frequencies are those of the template forms). A file's own licence is that of its
best form, if good enough. A file that is named like a licence file, or holds words that licence bodies begin with, is
also compared as a whole to whole licence texts; what that finds comes before what a line says. A file that consists of
licence text to a given share, is named like one, or matches a whole text, is a licence file and speaks for its
directory; files without a licence of their own inherit from their nearest ancestor directory that has a licence file.

Defined cases: null and empty texts have no header lines; null paths have no directory and inherit nothing; of equal
cosines the licence, and of equal licence files the path, that sorts first wins; rows that repeat get equal rows; no
templates match nothing; an empty table gives an empty result; further columns are not returned; a `keep` column that is
named like a column of the result comes back as kept_<name>."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm.common import ascii_lower, materialise, skew_join, table

#: Forms of headers by licence; pass your own for more licences or whole licence texts.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA-4.0": ["Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "GPL-3.0": ["Licensed under the GNU General Public License, version 3.", "This program is free software under the terms of the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Confidential and proprietary."],
}
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole licence texts by licence; pass your own for longer ones.
TEXTS: dict[str, list[str]] = {
    "BSD-2-Clause": [_BSD_GRANT + _BSD_DISCLAIMER],
    "BSD-3-Clause": [_BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER],
    "ISC": [_ISC_GRANT],
    "MIT": [_MIT_GRANT],
}
#: Words that say that a text may hold a licence body.
BODY = r"(?i)permission\s+is\s+hereby\s+granted|is\s+hereby\s+granted,\s+provided|redistribution\s+and\s+use\s+in\s+source"
HEADER = r"(?i)licen[sc]|copyright|spdx|all rights reserved|creative commons"
LICENSE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
_WORD = r"[a-z0-9]+"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(_WORD), F.lit(0))


class Templates:
    """Weights of the template forms, by term; their size is the templates'."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.forms = [(name, Counter(re.findall(_WORD, form.lower()))) for name, forms in sorted(templates.items()) for form in forms]
        seen = Counter(term for _, terms in self.forms for term in terms)
        self.unseen = math.log(1 + len(self.forms)) + 1
        self.idf = {term: math.log((1 + len(self.forms)) / (1 + n)) + 1 for term, n in seen.items()}

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per term: idf, and (form, licence, weight over the form's norm) of each form that has it."""
        by_term: dict[str, list[Column]] = {}
        for k, (name, terms) in enumerate(self.forms):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in terms.items()))
            for t, n in terms.items():
                by_term.setdefault(t, []).append(F.struct(F.lit(k).alias("form"), F.lit(name).alias("license"), F.lit(n * self.idf[t] / norm).alias("part")))
        kind = "array<struct<term:string,idf:double,forms:array<struct<form:int,license:string,part:double>>>>"
        rows = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(self.idf[t]).alias("idf"), F.array(*forms).alias("forms")) for t, forms in by_term.items()]).cast(kind)
        return spark.range(1).select(F.inline(rows))


def own_licenses(files: DataFrame, templates: Templates, min_cosine: float, whole: bool = False) -> DataFrame:
    """A row per row number of files that has a licence of its own: row, license, cosine; from its header lines, or else its text as a whole."""
    if whole:
        lines = files.select("row", F.lit(0).alias("line"), F.col("text").alias("said"))
    else:
        lines = files.where(F.col("text").rlike(HEADER)).select("row", F.posexplode_outer(F.split("text", r"[\r\n]+")).alias("line", "said"))
        lines = lines.where(F.col("said").rlike(HEADER))
    terms = lines.select("row", "line", F.explode(_terms(F.col("said"))).alias("term"))
    counts = terms.groupBy("row", "line", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(F.broadcast(templates.frame(files.sparkSession)), "term", "left")
    weighed = weighed.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(templates.unseen)))
    norms = F.sum(F.col("w") * F.col("w"))
    # the norm of a line is summed beside the dot products: form -1 takes every term once
    own = F.array(F.struct(F.lit(-1).alias("form"), F.lit("").alias("license"), F.lit(0.0).alias("part")))
    spread = weighed.select("row", "line", "w", F.explode(F.concat(own, F.coalesce("forms", F.array().cast("array<struct<form:int,license:string,part:double>>")))).alias("f"))
    dots = spread.groupBy("row", "line", "f.form", "f.license").agg(F.sum(F.col("w") * F.col("f.part")).alias("dot"), norms.alias("square"))
    by_line = dots.groupBy("row", "line").agg(
        F.max(F.when(F.col("form") < 0, F.sqrt("square"))).alias("norm"), F.max(F.when(F.col("form") >= 0, F.col("dot"))).alias("dot"))
    tied = dots.where("form >= 0").join(by_line.select("row", "line", "norm", F.col("dot").alias("best")), ["row", "line"]).where("dot = best")
    cosine = F.floor(F.col("dot") / F.col("norm") * 1e6 + 0.5) / 1e6
    best = tied.select("row", cosine.alias("cosine"), "license").where(F.col("cosine") >= min_cosine)
    ordered = best.groupBy("row", "license").agg(F.max("cosine").alias("cosine"))
    return ordered.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b")).select("row", "b.license", (-F.col("b.less")).alias("cosine"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, min_cosine: float = 0.6, license_share: float = 0.2, keep: list[str] | None = None,
         texts: dict[str, list[str]] | None = None, min_text_cosine: float = 0.85) -> DataFrame:
    """A row per file: `keep` columns, path, own_license, cosine (null without one), license (own or inherited) and inherited_from (the directory; null unless inherited)."""
    known, bodies = Templates(TEMPLATES if templates is None else templates), Templates(TEXTS if texts is None else texts)
    ours = {"path", "own_license", "cosine", "license", "inherited_from"}
    carried = {f"_keep{k}": c for k, c in enumerate(keep or [])}
    back = [F.col(k).alias(f"kept_{c}" if c.lower() in ours else c) for k, c in carried.items()]
    base = files.select(*[files[f"`{c}`"].alias(k) for k, c in carried.items()], files[f"`{path_col}`"].alias("path"), F.coalesce(files[f"`{text_col}`"], F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    headers = F.filter(F.split("text", r"[\r\n]+"), lambda x: x.rlike(HEADER))
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    said = F.aggregate(headers, F.lit(0), lambda n, x: n + words(x))
    is_header = F.col("text").rlike(HEADER)
    share = F.when(is_header, said / words(F.col("text"))).otherwise(F.lit(0.0))
    kept = F.array_join(headers, "\n")
    parts = F.split("path", "/")
    named = F.coalesce(F.element_at(parts, -1).rlike(LICENSE_NAME), F.lit(False))
    body = F.when(named | F.col("text").rlike(BODY), F.col("text"))
    slim = base.select(*carried, "path", "row", share.alias("share"), F.when(is_header, kept).alias("text"), body.alias("body"))
    slim = materialise(slim, "files")  # of the texts only the header lines and licence bodies go on; row numbers are fixed here
    by_line = own_licenses(slim.where("text is not null").select("row", "text"), known, min_cosine)
    by_text = own_licenses(slim.where("body is not null").select("row", F.col("body").alias("text")), bodies, min_text_cosine, whole=True)
    either = by_line.withColumn("whole", F.lit(False)).unionByName(by_text.withColumn("whole", F.lit(True)))
    found = materialise(either.groupBy("row").agg(F.max_by(F.struct("license", "cosine", "whole"), "whole").alias("b")).select("row", "b.*"), "own")
    placed = slim.select(*carried, "path", "row", "share").join(found, "row", "left")
    depth = F.size(parts) - 1  # directories above the file
    directory = F.array_join(F.slice(parts, 1, depth), "/")
    speaks = placed.where(F.col("license").isNotNull() & F.col("path").isNotNull() & ((F.col("share") >= license_share) | named | F.col("whole")))
    best = speaks.select(F.when(depth > 0, directory).otherwise(F.lit("")).alias("dir"), F.struct((-F.col("cosine")).alias("less"), "license", "path").alias("b")).groupBy("dir").agg(F.min("b").alias("b"))
    voices = materialise(best.select("dir", F.col("b.license").alias("dir_license")), "voices")
    lone = placed.where(F.col("license").isNull() & F.col("path").isNotNull())
    above = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    asks = materialise(lone.select("row", F.explode_outer(above).alias("a")).select("row", "a.depth", "a.dir"), "ancestors")
    heard = skew_join(asks, voices, "dir").groupBy("row").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("v"))
    out = placed.join(heard, "row", "left")
    return out.select(*back, "path", F.col("license").alias("own_license"), "cosine", F.coalesce("license", "v.dir_license").alias("license"), F.when(F.col("license").isNull(), F.col("v.dir")).alias("inherited_from"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    documents = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return scan(documents.withColumn("path", path), keep=["doc_id"])
