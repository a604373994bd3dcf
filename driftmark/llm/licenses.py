"""License scans with DataFrame functions only: MinHash bands of overlapping windows retrieve templates, exact containment verifies.

A text is cut into words (lower case, runs of letters and digits) and hashed shingles of five words; templates of fewer than
five words go by shingles of three. A template of s shingles falls into the size class m, the power of two from s on. Windows of
2m shingles begin every m shingles, so that any occurrence of up to m shingles lies whole in a window.

Shingles that no template of the class has can verify nothing, so a window is the set of those that some template has: the
shingles of a text are joined with the templates' ones and what is left is grouped by window. A window with fewer of them than the
threshold asks of the shortest template of its class is left out; this loses nothing. A window that holds a template entirely has a Jaccard
similarity of s / 2m > 1 / 4 at least with it, one that holds 0.8 of it more than 1 / 6; `bands` bands of one MinHash each
meet with probability 1 - (1 - 1 / 6) ** bands, 1 - 7e-6 for 65. What the bands retrieve is verified by the exact share of the template's shingles in the window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Identifiers whose SPDX lines are notices.
SPDX = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "BSL-1.0", "Artistic-2.0", "MIT", "ISC", "0BSD", "Unlicense", "Zlib", "WTFPL")

#: Notices of common licences as they are usually written, from the licences' own headers (fixed values).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License only."),
    ("LGPL-3.0-or-later", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-or-later", "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/."),
    ("AGPL-3.0-or-later", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("WTFPL", "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("Proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher"),
    ("Proprietary", "This software is the confidential and proprietary information of the copyright holder. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("Proprietary", "This material may not be published, broadcast, rewritten, or redistributed without permission."),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX if len(name.replace(".", "-").split("-")) > 1),
)

#: Whole texts of short licences (fixed values).
_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEXTS = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _MIT_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
)

#: Notices of three or four words, for shingles of three words.
SHORT = (
    ("Proprietary", "All rights reserved."), ("Proprietary", "Strictly confidential and proprietary."), ("Public domain", "Released into the public domain."),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX if len(name.replace(".", "-").split("-")) == 1),
)



def notices(spark: SparkSession, short: bool | None = False) -> DataFrame:
    """The notices above as templates (template_id, license, text): the long ones, the short ones, which have ids from 1000 on, or with None both."""
    rows = [(i, *x) for i, x in enumerate(NOTICES + TEXTS)] if not short else []
    rows += [(1000 + i, *x) for i, x in enumerate(SHORT)] if short is not False else []
    return spark.createDataFrame(rows, "template_id int, license string, text string")


def templates_of(spark: SparkSession, path: str) -> DataFrame:
    """Whole licence texts as templates: each file of a folder (or pattern) that Spark can read is one, under the file's name; its id is a hash of the name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("license"), F.col("value").alias("text")).select(F.hash("license").alias("template_id"), "license", "text")


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_list(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; of all words together if there are fewer."""
    at = lambda i, j: F.try_element_at(words, i + j)
    n = F.size(words)
    full = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(*[at(i, F.lit(j)) for j in range(k)]))
    return F.when(n >= 1, full).otherwise(F.array().cast("array<long>"))


#: Shingles of templates that go to all tasks at a time: 24 bytes each, 200 MB.
MOST_SENT = 8_000_000


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 65, short_words: int = 3, most_sent: int = MOST_SENT) -> DataFrame:
    """One row for each document and template of which a window holds `threshold` of the shingles or more.

    Columns: doc_id, template_id, license, containment, first_word (of the first best window's first word, from 0).
    Templates come as (template_id, license, text), as many as there are: where they have more than `most_sent` shingles, their
    shingles are joined in parts, one pass over the documents for each. Templates without words are left out; those of fewer than `words` words go by
    shingles of `short_words` words, and of all their words if they are fewer still. Null and empty texts match nothing. Rows of
    a null id are scanned, and repeated rows give repeated results. Other columns are not read. An empty table, on either side, gives no rows.
    """
    forms = templates.select("template_id", "license", word_list(F.col("text")).alias("w")).where("size(w) > 0")
    forms = forms.withColumn("k", F.when(F.size("w") >= words, words).otherwise(short_words))
    forms = forms.withColumn("theirs", F.array_distinct(F.when(F.col("k") == words, shingle_list(F.col("w"), words)).otherwise(shingle_list(F.col("w"), short_words)))).drop("w")
    forms = cut(forms.withColumn("m", F.pow(F.lit(2), F.ceil(F.log2(F.size("theirs").cast("double")))).cast("int")))
    classes = forms.groupBy("k", "m").agg(F.min(F.size("theirs")).alias("least")).collect()  # a row for each size class
    if not classes:
        return docs.sparkSession.createDataFrame([], "doc_id long, template_id int, license string, containment double, first_word int")
    known = cut(forms.select("m", F.explode("theirs").alias("g")).groupBy("g").agg(F.collect_set("m").alias("ms")))
    parts = known.count() // most_sent + 1

    # A row number in each step keeps the optimizer from moving a filter below the step, which would repeat its work for each use.
    number = F.monotonically_increasing_id()
    texts = docs.select(F.col(id_col).alias("doc_id"), number.alias("row"), word_list(F.col(text_col)).alias("w"))
    kinds = sorted({c.k for c in classes}, reverse=True)
    texts = texts.select("doc_id", F.coalesce("row", number).alias("row"), *[shingle_list(F.col("w"), k).alias(f"own{k}") for k in kinds])
    texts = texts.select("doc_id", F.coalesce("row", number).alias("row"), F.size(f"own{kinds[0]}").alias("n"), F.posexplode(F.concat(*[f"own{k}" for k in kinds])).alias("place", "g"))
    hits = None
    for part in range(parts):
        mine = known if parts == 1 else known.where(F.pmod("g", F.lit(parts)) == part)
        found = texts.join(F.broadcast(mine), "g")  # about most_sent shingles
        hits = found if hits is None else hits.unionByName(found)
    later = F.col("place") >= F.col("n")
    hits = hits.select("doc_id", "row", "g", F.when(later, F.col("place") - F.col("n")).otherwise(F.col("place")).alias("place"), F.when(later, kinds[-1]).otherwise(kinds[0]).alias("k"), F.explode("ms").alias("m"))

    # Each hit lies in the window that begins at the last multiple of m and in the one before.
    at = F.col("place") - F.col("place") % F.col("m")
    hits = hits.select("doc_id", "row", "k", "m", "g", F.explode(F.array(at, at - F.col("m"))).alias("first")).where("first >= 0")
    need = F.coalesce(*[F.when((F.col("k") == c.k) & (F.col("m") == c.m), math.ceil(threshold * c.least - 1e-9)) for c in classes])
    windows = hits.groupBy("doc_id", "row", "k", "m", "first").agg(F.collect_set("g").alias("mine")).where(F.size("mine") >= need)

    def signed(df: DataFrame, grams: str) -> DataFrame:
        bands_ = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(grams, lambda g: F.xxhash64(g, b))))
        return df.select("*", F.posexplode(bands_).alias("band", "least"))

    candidates = signed(windows, "mine").join(cut(signed(forms.select("template_id", "k", "m", "theirs"), "theirs").drop("theirs")), ["k", "m", "band", "least"])
    candidates = candidates.join(forms.select("template_id", "license", "theirs"), "template_id")
    share = F.size(F.array_intersect("theirs", "mine")) / F.size("theirs")
    found = candidates.select("doc_id", "row", "template_id", "license", "first", share.alias("containment")).where(F.col("containment") >= threshold)
    best = F.max(F.struct("containment", (-F.col("first")).alias("first")))
    return found.groupBy("doc_id", "row", "template_id", "license").agg(best.alias("b")).select("doc_id", "template_id", "license", "b.containment", (-F.col("b.first")).cast("int").alias("first_word"))
