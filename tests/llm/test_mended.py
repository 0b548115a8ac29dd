"""Cases that earlier versions got wrong."""

import time

from pyspark.sql import functions as F

from gossamer.llm import html_text, toxicity


def text_of(spark, html):
    return html_text.extract(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["text"]


def test_inputs_of_every_type_show_their_value(spark):
    types = ["email", "number", "search", "tel", "url", "date", "text", "TEXT", "unknown", "submit"]
    html = "".join(f'<p><input type="{t}" value="v{k}"></p>' for k, t in enumerate(types))
    html += '<p><input value="plain"></p><p><input type=submit></p><p><input type=reset></p><p><input type=submit value=""></p><p><input type=image alt="Go"></p>'
    html += "".join(f'<p><input type={t} value="hid"></p>' for t in ("hidden", "checkbox", "radio", "password", "file"))
    assert text_of(spark, html).split() == [f"v{k}" for k in range(len(types))] + ["plain", "Submit", "Reset", "Go"]


def test_wide_spans_and_deep_quotes_take_little(spark):
    spans = "<table><tr>" + '<td colspan=1000 rowspan=65534>x</td>' * 60 + "</tr>" + "<tr><td>y</td><td>z</td></tr>" * 1500 + "</table>"
    quotes = "<blockquote>x" * 6000
    text_of(spark, "<p>warm")
    start = time.time()
    wide, deep = text_of(spark, spans), text_of(spark, quotes)
    assert time.time() - start < 20
    assert wide.count("z") == 1500 and wide.count("x") == 60 and len(wide) < 1_000_000
    assert deep.count("x") == 6000 and len(deep) < 1_000_000


def test_a_rowspan_ends_with_its_table_and_covers_its_columns(spark):
    html = "<table><tr><td rowspan=2>a</td><td>b</td><td rowspan=9>c</td></tr><tr><td>d</td></tr><tr><td>e</td><td>f</td></tr></table><p>after"
    assert text_of(spark, html) == "a | b | c\n  | d |\ne | f |\n\nafter"


def test_labels_without_documents_dont_shift_scores(spark):
    docs = spark.createDataFrame([(k, "you awful group" if k % 4 == 0 else f"a calm note {k % 7}") for k in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("label"))
    lost = labels.unionByName(spark.range(10_000, 10_300).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("label")))
    a, b = (dict(map(tuple, toxicity.score(docs, x).select("doc_id", F.round("score", 3)).collect())) for x in (labels, lost))
    assert max(abs(a[k] - b[k]) for k in a) < 0.1 and a[0] > 0.7 > 0.3 > a[1]


def test_licences_are_called_by_their_own_names(spark):
    from gossamer.llm import license_scan

    long = " ".join(f"This clause {k} speaks of conveying covered works under section {k % 17}." for k in range(300))
    title = "Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n"
    files = {
        "a/LICENSE": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n " + title + "  The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software.\n" + long,
        "b/COPYING": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA\n " + title + long,
        "c/COPYING": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n " + title + "  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n" + long,
        "d/x.c": "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;",
        "e/x.c": "/* SPDX-License-Identifier: LGPL-2.1-only */\nint main;",
        "f/x.c": "# SPDX-License-Identifier: GPL-2.0\n",
        "g/README": "Notes.\n\nDistributed under the MIT license\n\nMore notes.",
        "h/zlib.h": "  This software is provided 'as-is', without any express or implied\n  warranty.  In no event will the authors be held liable for any damages\n  arising from the use of this software.\n\n  Permission is granted to anyone to use this software for any purpose,\n  including commercial applications, and to alter it and redistribute it\n  freely, subject to the following restrictions:\n\n  1. The origin of this software must not be misrepresented; you must not\n     claim that you wrote the original software. If you use this software\n     in a product, an acknowledgment in the product documentation would be\n     appreciated but is not required.\n  2. Altered source versions must be plainly marked as such, and must not be\n     misrepresented as being the original software.\n  3. This notice may not be removed or altered from any source distribution.",
    }
    words = "the of and in that works with any other use is to be on for people of various sections and clauses".split()
    noise = [(f"n/{k}.txt", " ".join(words[(k * j) % len(words)] for j in range(40))) for k in range(300)]
    table = spark.createDataFrame([*files.items(), *noise], "path string, text string")
    got = {r.path: r.license for r in license_scan.scan(table).collect()}
    want = {"a/LICENSE": "AGPL-3.0", "b/COPYING": "LGPL-2.1", "c/COPYING": "GPL-3.0", "d/x.c": "GPL-2.0-or-later", "e/x.c": "LGPL-2.1-only", "f/x.c": "GPL-2.0", "g/README": "MIT", "h/zlib.h": "Zlib"}
    assert {k: got[k] for k in want} == want and not any(got[p] for p, _ in noise)


def test_recall_of_chosen_paths_at_the_threshold():
    """Sets whose similarity is just 0.8, of many sizes, equal in size or one within the other: nearly all meet in some leaf."""
    import numpy as np

    from gossamer.llm import chosen_path

    rng, runs, met, pairs = np.random.default_rng(1), chosen_path.runs_for(), 0, 0
    for size in (9, 18, 45, 90, 180, 450):
        for _ in range(60):
            words = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            same = size - size // 9  # 8 of 9 shared on both sides: 8 / 10
            equal = words[:size], np.concatenate([words[:same], words[size : 2 * size - same]])
            within = words[:size], words[: int(np.ceil(0.8 * size))]
            for a, b in (equal, within):
                assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
                met += bool(len(np.intersect1d(chosen_path.leaves(a, runs), chosen_path.leaves(b, runs))))
                pairs += 1
    assert met / pairs >= 0.99


def test_the_pipeline_rejects_by_quality_and_passes_the_rest_on(spark, tmp_path):
    """Labels of both kinds: what the classifier rejects is gone, what it accepts reaches the end, and duplicates are judged among the accepted alone."""
    import random

    import corpus_pipeline

    rnd = random.Random(8)
    good = ["river", "stone", "morning", "walked", "quiet", "letter", "garden", "window", "the", "of", "and", "under"]
    junk = ["$$$", "CLICK", "win!!!", "free", "xxx", "1000%", "buy", "now", ">>>", "http://x"]
    text = lambda words: " ".join(rnd.choice(words) for _ in range(60))
    rows = [(k, text(good if k % 2 else junk)) for k in range(300)]
    rows += [(300, rows[7][1]), (301, rows[8][1])]  # a copy of an accepted text, and of a rejected one
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 300, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, rows[21][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    accepted = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert len(accepted & set(range(1, 300, 2))) >= 145 and len(accepted & set(range(0, 300, 2))) <= 5 and {300} <= accepted and 301 not in accepted
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out <= accepted and 21 not in out
    assert 300 in out and 7 not in out  # of equal texts the largest id stays
    assert len(out) >= len(accepted) - 3
