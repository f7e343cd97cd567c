"""Operator 6, license scans: MinHash bands over text windows (DataFrame functions only).

Texts and templates become shingles of ``K`` = 5 lower-case words. A text's
windows are ``WINDOW`` = 4 shingles (8 words) wide and overlap by four words;
each shingle is in one of them. A template's are taken at every shingle. Of
each window there are ``BANDS`` = 48 bands of one row, the least of its
shingles' hashes, which are made anew for each band, and windows that share a
band are joined: these bands alone retrieve templates.

A window that holds the only shingle of a five-word notice has a similarity of
1/4 to it, and 48 bands miss (3/4)^48, one in a million. In a template of at least
``LONG`` = 8 shingles that is contained to four fifths, some window of the text
is whole in it, so all its bands agree, and ``FEW`` = 4 bands are kept of such
templates. What the bands retrieve is verified exactly: the share of the
template's distinct shingles that occur in the text within a template's length
before and after the window must be at least ``CONTAINED`` = 0.8.

Templates are a fixed list, so their bands are a table of a known size and are
broadcast; nothing that grows with the corpus is. No text is shuffled or
written, only what is found.

Defined results: a null text is empty and has no license; a text of under five
words has none; each row of a text gives a row per license found in it, and
none if there is none; of several places of a license the best share and the
first word count; repeated rows repeat them; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tarn.llm import common

K = 5
CONTAINED = 0.8
WINDOW, BANDS = 4, 48
LONG, FEW = 8, 4

#: License texts and notices (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[str]) -> list[int]:
    """Spark's xxhash64 of each K words, for the few templates on the driver."""
    out = []
    for i in range(len(words) - K + 1):
        h = 42
        for w in words[i : i + K]:
            h = xxh64_intdigest(w.encode(), h)
        out.append(_signed(h))
    return out


def band_value(hashes: list[int], band: int) -> int:
    """The least hash of the band, each Spark's xxhash64 of (hash, band)."""
    return min(_signed(xxh64_intdigest(band.to_bytes(4, "little"), xxh64_intdigest((h & (1 << 64) - 1).to_bytes(8, "little"), 42))) for h in hashes)


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_tables(spark: SparkSession, templates) -> tuple[DataFrame, DataFrame]:
    """(template, license, n_words, parts) and (band, value, template)."""
    listed, bands = [], set()
    for t, (name, text) in enumerate(templates):
        hashes = shingle_hashes(template_words(text))
        listed.append((t, name, len(hashes) + K - 1, sorted(set(hashes))))
        for i in range(max(1, len(hashes) - WINDOW + 1)):
            bands |= {(band, band_value(hashes[i : i + WINDOW], band), t) for band in range(BANDS if len(hashes) < LONG else FEW) if hashes}
    return spark.createDataFrame(listed, "template int, license string, n_words int, parts array<bigint>"), spark.createDataFrame(sorted(bands), "band int, value bigint, template int")


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def hashed(words: Column) -> Column:
    """The hash of each K words in a row. The words are bound to a variable, so that they are made once."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - K)
        return F.when(F.size(w) >= K, F.transform(at, lambda i: F.xxhash64(*(w[i + j] for j in range(K))))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), of)[0]


def matches(docs: DataFrame, *keep: str, templates=TEMPLATES) -> DataFrame:
    """``keep`` and license, contained and first_word for each license of each row."""
    listed, bands = template_tables(docs.sparkSession, templates)
    # The id tells rows apart within this one plan, and is not kept.
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*keep).alias("_keep"), hashed(words_of("text")).alias("_parts"))
    # Windows and bands are rows of one generated loop each, so that no expression is too long to be compiled.
    windows = rows.where(F.size("_parts") > 0).select("_rid", "_keep", "_parts", F.explode(F.sequence(F.lit(0), F.size("_parts") - 1, F.lit(WINDOW))).alias("at"))
    windows = windows.select("*", *(F.get("_parts", F.col("at") + i).alias(f"h{i}") for i in range(WINDOW)))
    banded = windows.select("*", F.explode(F.array(*map(F.lit, range(BANDS)))).alias("band"))
    # The last window has fewer shingles, and the least of what there is; null has a hash too, so it is left out.
    value = F.least(*(F.when(F.col(f"h{i}").isNotNull(), F.xxhash64(f"h{i}", "band")) for i in range(WINDOW)))
    found = banded.select("_rid", "_keep", "_parts", "at", "band", value.alias("value")).join(F.broadcast(bands), ["band", "value"]).join(F.broadcast(listed), "template")
    first = F.greatest(F.lit(0), F.col("at") - F.col("n_words"))
    found = found.withColumn("first", first).withColumn("near", F.slice("_parts", F.col("first") + 1, F.col("at") + WINDOW + K - 1 + F.col("n_words") - F.col("first")))
    found = found.withColumn("shared", F.array_intersect("parts", "near")).withColumn("share", F.size("shared") / F.size("parts")).where(F.col("share") >= CONTAINED)
    word = F.col("first") + F.array_min(F.transform("shared", lambda h: F.array_position("near", h))) - 1
    best = found.groupBy("_rid", "license").agg(F.first("_keep").alias("_keep"), F.max("share").alias("contained"), F.min(word).alias("first_word"))
    return best.select("_keep.*", "license", F.round("contained", 6).alias("contained"), "first_word")


def op6_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.read(spark, sf_dir, "documents"), "doc_id")
