"""License notices and whole license texts by MinHash bands over overlapping windows and exact shingle containment, in SQL functions only.

Texts and templates are words (runs of letters and digits, lower-case) and 5-word shingles, hashed to 64 bits. A template of
m shingles is looked for in windows of 2s - 1 shingles at every s-th shingle, s >= m a power of two (LONG for
long ones), so each occurrence lies whole in a window. A window is cut into BINS by the top bits of the hashes, and
the minimum of each bin is a band of one row; a template is retrieved if one band agrees. A template of at least LONG / 2
shingles of which 0.8 stand in the window has a Jaccard index of 0.19 there at least, so 32 bands retrieve it with a
probability above 0.998 in each window it lies in. The windows of shorter templates have as many bins as shingles: each
shingle is its own minimum and its own band, and retrieval is certain; that is the exact end of the same rule.

A template of more than LONG shingles is cut into pieces of LONG (the last one ends with it), each with bands of its own. A window that one
piece retrieves is held against the whole template, and the distinct shingles found by all such windows of a text are counted. Where a text has
0.8 of the template, the windows inside it hold pieces at that share on average, each retrieved as above, so a template is missed
only if all of them are.

Retrieved pairs are verified by the exact share of the template's distinct shingles, THRESHOLD at least: those of the window, or
of the windows for long ones. The template tables are bounded by MOST_SHINGLES and broadcast; text is read once and only matches are shuffled.

Defined cases: null, empty and short texts have no shingles and no match; rows of one id are scanned apart and reported
together, as are rows without an id; copies of a notice in one document give one row; an empty table gives an empty result;
other columns are ignored; templates that together pass MOST_SHINGLES are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, LONG, BIN_BITS, THRESHOLD, MOST_SHINGLES = 5, 64, 5, 0.8, 50_000
SPLIT = r"[^\p{L}\p{N}]+"

#: Wording of well-known notices, and of whole licenses.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                 "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
                 "publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                             "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                             "governing permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
                "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
                "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
                "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
                "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
                "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
                "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
                "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
                "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
                "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
                  "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
                  "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
                  "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                  "derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND "
                  "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                  "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
                  "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
                  "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
                  "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
                 "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
                 "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
                 "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
                 "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
                 "not be removed or altered from any source distribution.",
}


def shingles(text: Column) -> Column:
    """Hashes of the text's 5-word shingles, in order."""
    def hashed(words: Column) -> Column:
        starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE))
        return F.coalesce(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])), F.array().cast("array<bigint>"))

    return F.transform(F.array(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")), hashed)[0]


def minima(ordered: str) -> Column:
    """The smallest hash of each bin of an ascending array column."""
    o = F.col(ordered)
    return F.filter(o, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(o, i - 1), 64 - BIN_BITS)))


def stride(m: Column) -> Column:
    return F.when(m >= LONG // 2, LONG).otherwise(F.pow(F.lit(2), F.ceil(F.log2(m))).cast("int"))


def template_bands(templates: DataFrame) -> DataFrame:
    """(band, kind, license, m, s, own): bands of all templates. kind 2: minima of the pieces of long ones, 1: minima of middle ones, 0: all shingles of short ones.

    own holds all distinct shingles of the template."""
    every = templates.where("license IS NOT NULL").select("license", F.array_distinct(shingles(F.col("text"))).alias("seq")).where("size(seq) > 0")
    if (every.agg(F.sum(F.size("seq"))).first()[0] or 0) > MOST_SHINGLES:
        raise ValueError(f"templates have more than {MOST_SHINGLES} shingles")
    m = F.size("seq")
    every = every.withColumns({"m": m, "s": stride(m), "kind": F.when(m > LONG, 2).otherwise((m >= LONG // 2).cast("int")), "own": F.array_sort("seq")})
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / LONG).cast("int")), lambda k: F.greatest(F.lit(1), F.least(k * LONG + 1, F.col("m") - LONG + 1))))
    pieces = every.select("license", "m", "s", "kind", "own", F.explode(F.transform(starts, lambda a: F.array_sort(F.slice("seq", a, LONG)))).alias("piece"))
    return pieces.select("license", "m", "s", "kind", "own", F.explode(F.when(F.col("kind") == 0, F.col("piece")).otherwise(minima("piece"))).alias("band"))


def scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, containment): licenses found in each document; containment in the best window, or of a long one in all its windows."""
    own = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), shingles(F.col(text)).alias("h")).where("size(h) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / LONG).cast("int")), lambda k: F.struct(k.alias("k"), F.slice("h", k * LONG + 1, 2 * LONG - 1).alias("part")))
    windows = own.select("key", "row", F.explode(cut).alias("w")).select("key", "row", "w.k", "w.part")
    windows = windows.withColumn("ordered", F.sort_array("part"))
    each = F.transform(F.slice("part", 1, LONG), lambda x, i: F.struct(x.alias("band"), F.lit(0).alias("low"), (F.col("k") * LONG + i).alias("at")))
    low = F.transform(minima("ordered"), lambda x: F.struct(x.alias("band"), F.lit(1).alias("low"), F.lit(0).alias("at")))
    bands = windows.select("key", "row", "k", "part", F.explode(F.concat(each, low)).alias("b")).select("key", "row", "k", "part", "b.*")
    hits = bands.join(F.broadcast(template_bands(templates).withColumn("low", (F.col("kind") > 0).cast("int"))), ["band", "low"])
    place = F.floor(F.col("at") / F.col("s")).cast("int")
    before = (place > 0) & (F.col("at") % F.col("s") != F.col("s") - 1)
    # a window of a middle or short template is its own group, all windows of a long one are one
    at = F.when(F.col("kind") == 2, F.array(F.lit(-1))).when(F.col("kind") == 1, F.array("k")).when(before, F.array(place, place - 1)).otherwise(F.array(place))
    found = F.when(F.col("kind") == 0, F.array("band")).otherwise(F.array_intersect("part", "own"))
    once = hits.select("key", "row", "license", "m", F.explode(at).alias("window"), "k", F.when(F.col("kind") == 0, F.col("band")).alias("of"), found.alias("found")).dropDuplicates(["row", "license", "window", "k", "of"])
    verified = once.select("key", "row", "license", "m", "window", F.explode("found").alias("shingle")).groupBy("key", "row", "license", "m", "window").agg(F.count_distinct("shingle").alias("held"))
    share = F.col("held") / F.col("m")
    return verified.where(share >= threshold).groupBy("key", "license").agg(F.max(share).alias("containment"))
