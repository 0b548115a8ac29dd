"""Licence scans: sparse TF-IDF cosine to licence templates, then inheritance from the nearest ancestor folder.

Headers are read in windows of joined lines: each line, and runs of 4 and 16 lines, each beginning half a run after the
one before, so that a notice may stand anywhere in a file and be wrapped at any width; comment marks are no terms. A licence file (named LICENSE,
LICENCE, COPYING or NOTICE) is also read as a whole. Each of these units is a sparse vector of its terms, weighted by
tf * ln(1 + N / df), where df counts, over the whole corpus, the files that have the term (a term of no file counts as in one), and is
compared with templates: headers, short statements, SPDX lines, full texts, and of very long texts their title and first words. A file's own licence is its best
template's, if the cosine reaches MIN_SCORE. A licence file also speaks for its folder and all folders below: a file
without a licence of its own inherits that of the nearest ancestor folder that has one. Only DataFrame functions.

Which units are scored follows from MIN_SCORE alone. Terms of a template whose weights' root sum of squares stays below MIN_SCORE can't give that cosine by themselves,
so a unit that reaches it has one of the others, its keys; the most common terms are set aside first. Units without any key are
left out without loss.

Defined results: a null or empty text has no licence of its own, but may inherit; ties of templates prefer the first
id in order; of several licence files of a folder the highest score speaks for it, ties by template, then path; a
null path neither gives nor inherits; rows of one path are read as one file and each returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_SCORE = 0.6
#: Lines of a window; 0 stands for a whole licence file.
SIZES = (1, 4, 16)
#: Parts that the files of one folder are dealt into, as a folder may hold most of them.
SALTS = 16
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"

# Statements, headers and texts of licences as their publishers word them
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and dedicated this work to the public domain under CC0 1.0"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("MIT", "Distributed under the MIT license"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
LICENSES = sorted({k for k, _ in TEMPLATES})
# Licences that SPDX lines name as this version alone, or as it and later ones
VERSIONED = ["AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"]
LICENSES = sorted([*LICENSES, *(f"{k}-{which}" for k in VERSIONED for which in ("only", "or-later"))])
TEMPLATES += [(k, f"SPDX-License-Identifier: {k}") for k in LICENSES]


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and inner dots or hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, k, body) for i, (k, body) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, license string, body string").select("template", "license", F.explode(terms(F.col("body"))).alias("term"))


def _vectors(rows: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """keys, term, weight: unit vectors of rows (keys, term)."""
    tf = rows.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    weighted = tf.join(idf.hint("merge"), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norm.hint("merge"), keys).select(*keys, "term", (F.col("weight") / F.col("norm")).alias("weight"))


def _windows() -> Column:
    """size and number w of each window that a line of a file is in."""
    line, one = F.col("line"), lambda size, w: F.struct(F.lit(size).alias("size"), w.cast("int").alias("w"))
    found = [one(0, F.when(F.col("path").rlike(LICENCE_FILE), 0))]
    for size in SIZES:
        k = F.floor(line / max(size // 2, 1))
        found += [one(size, k)] + ([one(size, k - 1)] if size > 1 else [])
    return F.filter(F.array(*found), lambda x: x["w"] >= 0)


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", r"\n")).alias("line", "body")).select("path", "line", terms(F.col("body")).alias("terms"))


def _keys(vectors: DataFrame, idf: DataFrame) -> list[str]:
    """Terms of the templates of which a unit that reaches MIN_SCORE has one: at most as many as the templates have."""
    light = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template").orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, 0))
    heavy = vectors.join(idf.hint("merge"), "term").withColumn("light", light).where(F.col("light") >= MIN_SCORE * MIN_SCORE * 0.999)
    return sorted(r["term"] for r in heavy.select("term").distinct().collect())


def own_licenses(files: DataFrame) -> DataFrame:
    """path, license, score of every file (its own best template, or null)."""
    spark = files.sparkSession
    files = files.select("path", "text")
    known = templates(spark)
    n = F.lit(max(files.count(), 1)).cast("double")
    seen = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    seen = common.materialize(seen, "document-frequencies")
    weigh = lambda asked: asked.distinct().join(seen.hint("merge"), "term", "left").select("term", F.log1p(n / F.coalesce("df", F.lit(1))).alias("idf"))
    common_first = weigh(known.select("term"))
    wanted = common.materialize(_vectors(known, ["template", "license"], common_first), "templates")

    keys = F.array(*map(F.lit, _keys(wanted, common_first)))
    # lines of files without a key are never split off
    near = files.where(F.col("path").isNotNull() & F.arrays_overlap(terms(F.col("text")), keys))
    keyed = _lines(near).where(F.arrays_overlap("terms", keys))
    units = common.materialize(keyed.select("path", F.explode(_windows()).alias("u")).select("path", "u.size", "u.w").distinct(), "licence-units")
    rows = _lines(near).select("path", "terms", F.explode(_windows()).alias("u")).select("path", "u.size", "u.w", "terms").join(units.hint("merge"), ["path", "size", "w"], "left_semi")
    rows = common.materialize(rows.select("path", "size", "w", F.explode("terms").alias("term")), "licence-terms")
    # as many rows as the templates have terms
    want = F.broadcast(wanted.select("template", "license", "term", F.col("weight").alias("want")))
    cosine = _vectors(rows, ["path", "size", "w"], weigh(rows.select("term"))).join(want, "term").groupBy("path", "size", "w", "template", "license").agg(F.sum(F.col("weight") * F.col("want")).alias("cosine"))
    best = cosine.where(F.col("cosine") >= MIN_SCORE).groupBy("path", "license").agg(F.round(F.max("cosine"), 6).alias("score"))
    best = best.groupBy("path").agg(F.max_by("license", F.struct("score", _rank())).alias("license"), F.max("score").alias("score"))
    return files.select("path").join(best.hint("merge"), "path", "left").select("path", "license", "score")


def _rank() -> Column:
    """For ties in max_by: the first licence in order ranks highest."""
    rank = {k: len(LICENSES) - i for i, k in enumerate(LICENSES)}
    return F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))[F.col("license")]


def scan(files: DataFrame) -> DataFrame:
    """path, license, score, inherited_from: own licence, or that of the nearest ancestor folder (its path then given)."""
    own = common.materialize(own_licenses(files), "own-licences")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    speaks = own.where(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).withColumn("folder", folder)
    speaks = speaks.groupBy("folder").agg(F.max_by("license", F.struct("score", _rank())).alias("folder_license"))
    bare = own.where(F.col("license").isNull() & F.col("path").isNotNull())
    # folders are few beside files: find each folder's licence once, then join files to their folder
    folders = bare.select(folder.alias("of")).distinct()
    chain = folders.select("of", F.posexplode(_ancestors("of")).alias("steps", "folder"))
    nearest = chain.join(speaks.hint("merge"), "folder").groupBy("of").agg(F.min_by(F.struct("folder", "folder_license"), "steps").alias("up"))
    nearest = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = bare.withColumns({"of": folder, "salt": F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")})
    heirs = salted.join(nearest.hint("merge"), ["of", "salt"], "left").select("path", F.col("up.folder_license").alias("license"), F.lit(None).cast("double").alias("score"), F.col("up.folder").alias("inherited_from"))
    rest = own.where(F.col("license").isNotNull() | F.col("path").isNull()).select("path", "license", "score", F.lit(None).cast("string").alias("inherited_from"))
    return rest.unionByName(heirs)


def _ancestors(name: str) -> Column:
    """The folder itself, its ancestors and the root, nearest first."""
    parts = F.split(F.col(name), "/")
    chain = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(F.col(name) == "", F.array(F.lit(""))).otherwise(F.concat(chain, F.array(F.lit(""))))
