"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Only DataFrame functions. Licence texts of a file are its lines with a licence word, its
blocks of consecutive lines with one, all these blocks together, and the whole text of a
licence file (one named like one, or one that consists of licence lines by three quarters).
Copyright notices (holder and years) do not count. Terms are weighted by term frequency and
an inverse frequency counted over all licence texts, for every term. The vectors are sparse
rows (text, term) joined with the rows (template, term); the templates are a fixed list, and
so is what is broadcast. A file whose best cosine reaches the threshold declares that
licence. A licence file declares it for its directory, and a file that declares none takes
that of the nearest directory above it: the different directories are joined by path with
the licensed ones, prefix by prefix, and the files with the directories, dealt over salts
since one directory may hold most files.

Cases: null texts and paths count as empty ones; a file without directory can only inherit
from the root; equal cosines go to the first template name; several licence files of a
directory: the best cosine, then the first name; rows are told apart by a row number, so
repeated rows each get their result; lines of any length count whole; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_GNU = "you can redistribute it and/or modify it under the terms of the gnu {0} as published by the free software foundation, either version {1} of the license, or (at your option) any later version. it is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {0} for more details. you should have received a copy of the gnu {0} along with this program. if not, see https://www.gnu.org/licenses/"
_BSD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
# Licence, wording of its notices and texts.
TEMPLATES = [
    ("AGPL-3.0", "licensed under the gnu affero general public license, version 3"),
    ("AGPL-3.0", "gnu affero general public license version 3, 19 november 2007"),
    ("AGPL-3.0", _GNU.format("affero general public license", 3)),
    ("Apache-2.0", "licensed under the apache license, version 2.0"),
    ("Apache-2.0", "licensed under the apache license, version 2.0 (the license)"),
    ("Apache-2.0", "apache license version 2.0, january 2004 http://www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution"),
    ("Apache-2.0", "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    ("BSD-3-Clause", "use of this source code is governed by a bsd-style license that can be found in the license file."),
    ("BSL-1.0", "boost software license version 1.0. distributed under the boost software license, version 1.0. see accompanying file license_1_0.txt or copy at http://www.boost.org/license_1_0.txt"),
    ("CC-BY-4.0", "this work is licensed under cc by 4.0 creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0 creative commons attribution-sharealike 4.0 international license"),
    ("CC0-1.0", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. cc0 1.0 public domain dedication"),
    ("GPL-2.0", "this program is licensed under the gnu general public license, version 2"),
    ("GPL-2.0", "gnu general public license version 2, june 1991"),
    ("GPL-2.0", _GNU.format("general public license", 2)),
    ("GPL-3.0", "this work is licensed under the gnu general public license, version 3"),
    ("GPL-3.0", "gnu general public license version 3, 29 june 2007"),
    ("GPL-3.0", _GNU.format("general public license", 3)),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("LGPL-3.0", "licensed under the gnu lesser general public license, version 3"),
    ("LGPL-3.0", "gnu lesser general public license version 3, 29 june 2007"),
    ("LGPL-3.0", _GNU.format("lesser general public license", 3)),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license. see license file in the project root for full license information"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "confidential and proprietary. all rights reserved. unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("Unlicense", "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. the origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. this notice may not be removed or altered from any source distribution."),
]
TEMPLATES += [(name, f"spdx-license-identifier: {name.lower()}") for name in sorted({name for name, _ in TEMPLATES} - {"Proprietary"})]
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|redistribution and use|permission (?:is hereby|to use)|permission is granted"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
SPLIT = r"[^a-z0-9.+-]+"
BLANK = r"\n[^A-Za-z0-9]*\n"  # between blocks: lines without a letter or digit
NOTICE = r"(?i)copyright\s*(?:\(c\)|©)?\s*[0-9][0-9, -]*[^,.;\n]*"
SALTS = 16


def terms_of(text: Column) -> Column:
    """Lower-case terms, without full stops at either end."""
    return F.filter(F.transform(F.split(F.lower(text), SPLIT), lambda x: F.btrim(x, F.lit(".-"))), lambda x: x != "")


def _idf(n: float, df: float) -> float:
    from math import log

    return log((1 + n) / (1 + df)) + 1


def _words(text: str) -> list[str]:
    import re

    return [w for w in (x.strip(".-") for x in re.split(SPLIT, text.lower())) if w]


def licence_texts(files: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """(row, id, dir, is_file, n, terms): a row for every licence text of a file (n counts
    them), and one with null terms for a file without any."""
    text, path = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(path, F.lit(""))
    cue = text.rlike(CUE)
    lines = F.when(cue, F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)))
    blocks = F.when(cue, F.filter(F.split(text, BLANK), lambda x: x.rlike(CUE)))
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"), text.alias("text"), lines.alias("lines"), blocks.alias("blocks"))
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.size(terms_of(x)))
    cue_terms = size(F.col("lines"))
    is_file = F.col("name").rlike(FILE_NAME) | F.coalesce(F.when(F.col("lines").isNotNull(), 4 * cue_terms >= 3 * F.size(terms_of(F.col("text")))), F.lit(False))
    rows = rows.withColumn("is_file", is_file)
    none = F.array().cast("array<string>")
    many = F.when(F.size("blocks") > 1, F.array(F.array_join("blocks", "\n"))).otherwise(none)
    found = F.concat("lines", F.filter("blocks", lambda x: x.contains("\n")), many)
    parts = F.concat(F.when(F.col("is_file"), F.array("text")).otherwise(none), F.coalesce(F.when(F.col("lines").isNotNull(), found), none))
    rows = rows.select("row", "id", "dir", "is_file", F.posexplode_outer(parts).alias("n", "part"))
    return rows.select("row", "id", "dir", "is_file", "n", F.when(F.col("n").isNotNull(), terms_of(F.regexp_replace("part", NOTICE, " "))).alias("terms"))


def cosines(texts: DataFrame) -> DataFrame:
    """(row, n, licence, cosine) of each licence text and each template it shares terms with."""
    spark = texts.sparkSession
    vocabulary = sorted({w for _, t in TEMPLATES for w in _words(t)})
    held = texts.where("terms is not null")
    n = held.count()
    sparse = held.select("row", "n", F.explode("terms").alias("term")).groupBy("row", "n", "term").agg(F.count("*").alias("tf"))
    sparse = materialize(sparse, "terms")
    often = materialize(sparse.groupBy("term").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    known = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    df = {r["term"]: r["df"] for r in sparse.join(F.broadcast(known), "term").groupBy("term").agg(F.count("*").alias("df")).collect()}  # at most the templates' terms
    weights = []
    for k, (_, t) in enumerate(TEMPLATES):
        words = _words(t)
        own = {w: words.count(w) * _idf(n, df.get(w, 0)) for w in words}
        norm = sum(v * v for v in own.values()) ** 0.5
        weights += [(k, w, v / norm) for w, v in own.items()]
    idf = F.log((1.0 + n) / (1 + F.coalesce("df", F.lit(1)))) + 1
    sparse = sparse.join(often, "term", "left").withColumn("weight", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    table = spark.createDataFrame(weights, "template int, term string, share double")
    dots = sparse.join(F.broadcast(table), "term").groupBy("row", "n", "template").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    names = F.array(*(F.lit(name) for name, _ in TEMPLATES))
    return dots.join(sparse.groupBy("row", "n").agg(norm.alias("norm")), ["row", "n"]).select("row", "n", names[F.col("template")].alias("licence"), F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))


def scan(files: DataFrame, path: Column, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, declared, cosine, licence, origin, licence_dir) for every row: origin is
    header, file, inherited or none."""
    texts = materialize(licence_texts(files, id_col, text_col, path), "licence-texts")
    best = cosines(texts).where(F.col("cosine") >= threshold).groupBy("row").agg(F.max("cosine").alias("cosine"), F.min_by("licence", F.struct(-F.col("cosine"), F.col("licence"))).alias("declared"))
    rows = materialize(texts.where("n is null or n = 0").select("row", "id", "dir", "is_file").join(best, "row", "left"), "declared")
    licensed = rows.where("is_file and declared is not null").groupBy("dir").agg(F.min_by("declared", F.struct(-F.col("cosine"), F.col("declared"))).alias("licence"))
    steps = F.split(F.col("dir"), "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("above")))
    need = rows.where("declared is null")
    dirs = need.select("dir").distinct().select("dir", F.explode(above).alias("x")).select("dir", "x.depth", "x.above")
    near = dirs.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("licence", F.col("above").alias("licence_dir")), "depth").alias("from"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("dir", "salt", "from.*")
    found = need.withColumn("salt", F.expr(f"cast(pmod(row, {SALTS}) as int)")).join(near, ["dir", "salt"], "left")
    inherited = found.select("id", "declared", "cosine", "licence", F.when(F.col("licence").isNotNull(), "inherited").otherwise("none").alias("origin"), "licence_dir")
    own = rows.where("declared is not null").select("id", "declared", "cosine", F.col("declared").alias("licence"), F.when(F.col("is_file"), "file").otherwise("header").alias("origin"), F.lit(None).cast("string").alias("licence_dir"))
    return own.unionByName(inherited).withColumnRenamed("id", id_col)
