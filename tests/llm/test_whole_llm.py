"""Training-data operators on whole inputs: beyond samples, opening sentences and single blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarframe.llm import decontaminate, licenses, urls


def test_url_suffixes_count_all_labels(spark):
    """Only the suffix tells what is blocked, and most suffixes have no row in the trees' sample."""
    rows = [(i, f"http://h.d{i % 300:03}.com/a", i % 300 % 2) for i in range(3000)]
    labelled = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    got = urls.judge(labelled.select("page_id", "url"), labelled, [], sample_rows=60).collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 300 % 2) for r in got) >= 2900
    known = {r.suffix: (r.labelled, r.blocked) for r in urls.suffix_labels(labelled.unionByName(labelled.withColumn("blocked", F.lit(None).cast("int")))).collect()}
    assert known == {f"d{k:03}.com": (10, 10 * (k % 2)) for k in range(300)}


def test_repeated_url_is_drawn_by_row(spark):
    labelled = spark.range(9000).selectExpr("id AS page_id", "case when id % 3 = 0 then 'http://same.com/x' else concat('http://u', id, '.com') end AS url", "cast(id % 2 AS int) AS blocked")
    sample = urls.drawn(labelled, 9000, 900)
    assert 800 <= sample.count() <= 1000 and 240 <= sample.where("url = 'http://same.com/x'").count() <= 360


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3 = BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."


def _scan(text):
    return licenses.scan(text.encode())[5:]


def test_license_texts_are_whole():
    whole = {"mit": (MIT, "mit-text"), "bsd": (BSD.format(""), "bsd-2-text"), "isc": (ISC, "isc-text"), "apache-2": (APACHE, "apache-2-notice")}
    for short, (text, full) in whole.items():
        assert _scan(text) == ({short, full}, 1.0)
        cut = text[: len(text) * 6 // 10]
        altered = text.replace("IMPLIED", "EXPLICIT").replace("implied", "explicit")
        low = 1.0 if short == "apache-2" else 0.75
        assert _scan(cut) == _scan(altered) == ({short}, low)
    assert _scan(BSD3) == ({"bsd", "bsd-3-text"}, 1.0)


def test_gnu_notices_have_their_own_labels():
    for kind, version, label in (("General Public License", "2", "gpl-2"), ("General Public License", "3", "gpl-3"), ("Lesser General Public License", "2.1", "lgpl-2.1"), ("Lesser General Public License", "3", "lgpl-3"), ("Affero General Public License", "3", "agpl-3")):
        text = GNU.format(kind, version)
        assert _scan(text) == ({label, f"{label}-notice"}, 1.0)
        assert _scan(text.split("\n")[0]) == ({label}, 0.75)
    assert [_scan(f"Licensed under the GNU {k} General Public License version 3")[0] for k in ("", "Lesser", "Affero")] == [{"gpl-3"}, {"lgpl-3"}, {"agpl-3"}]


def test_one_long_item_is_several_blocks(spark):
    """Patterns of one item stay within blocks of about the size asked for, and all are found."""
    words = [f"w{i}" for i in range(2000)]
    bench = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:5]))], "item_id long, text string")
    held = decontaminate._blocks(bench, 3, 50)
    sizes = [len(list(decontaminate._block(held.folder, k))) for k in range(held.number)]
    assert sum(sizes) == 1998 and max(sizes) <= 100
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1])), (3, "a w0 w1 w2 b")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench, window=3, block=50).collect()}
    assert got == {1: (2000, ["7", "8"]), 2: (0, []), 3: (3, ["7", "8"])}
