"""Every operator on awkward rows, on empty tables and with clashing extra columns."""

import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from linearspark.llm import chat, decontaminate, extract, language_model, licences, lines, packing, quality, simhash, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2, "x") for i in range(0, 14)] + [(None, 1, 1, "x"), (3, None, None, "x"), (7, 5, 5, "x"), (4, 0, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, "One two three"), (4, "One two three"), (None, "null id")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_licences(spark, odd_docs, no_docs):
    known = licences.known_digests(spark)
    assert licences.scan(odd_docs, known).count() == 18       # the repeated row is one
    assert licences.scan(no_docs, known).count() == 0
    mit = "Copyright (c) 2020 Somebody\n\n" + licences._MIT.upper().replace(",", " ,")
    docs = spark.createDataFrame([(1, mit), (2, "Bla\n** Released  under the MIT licence\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs, known).collect()}
    assert got[1]["whole_text"] and got[1]["license_ids"] == ["MIT"]
    assert not got[2]["whole_text"] and got[2]["license_ids"] == ["MIT"]


def test_licences_inside_files(spark, odd_docs):
    """Known texts wrapped anew, as a comment inside a file, after a copyright in the same line, and incomplete."""
    blocks = licences.known_blocks(spark)
    texts = {name: text for name, text in licences.KNOWN if text in (licences._MIT, licences._UNLICENSE) or name.startswith("BSD-") and "\n" in text}
    comment = lambda t, width: "\n".join(
        " * " + line for block in t.split("\n\n") for line in [*textwrap.wrap(" ".join(block.split()), width), ""])
    rows, want = [], {}
    for name, text in texts.items():
        for i, width in enumerate((40, 100)):
            key = len(rows)
            rows.append((key, f"/*\n * Copyright (c) 2020 A. Body\n *\n{comment(text, width)}\n */\nimport sys\n"))
            want[key] = ([name], False)
        rows.append((len(rows), "\n\n".join(text.split("\n\n")[:-1]) + "\n\nother words"))
        want[len(rows) - 1] = ([], False)
        rows.append((len(rows), f"Copyright 2021 X\n\n{textwrap.fill(text.split(chr(10) * 2)[0], 30)}\n\n" + "\n\n".join(text.split("\n\n")[1:])))
        want[len(rows) - 1] = ([name], True)
    for text, ids in (("Copyright (c) 2020 Somebody. Released under the MIT License.", ["MIT"]),
                      ("Text before\n\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n\nafter", ["GPL-3.0"]),
                      ("Copyright (c) 2020 Somebody. All rights reserved.", [])):
        want[len(rows)] = (ids, len(ids) > 0 and "before" not in text)
        rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["license_ids"], r["whole_text"]) for r in licences.scan(docs, licences.known_digests(spark), blocks).collect()}
    assert got == want
    assert licences.scan(odd_docs, licences.known_digests(spark), blocks).count() == 18


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"),
                                        ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_licences(spark, file, name):
    """Entire long texts by their digests, wrapped anew; with the text given, also inside a file."""
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("this machine has no copies of the licence texts")
    text = path.read_text()
    # a copyright goes with its whole line, so the lines of blocks with one stay as they are
    wrapped = "\n\n".join(b if "copyright" in b.lower() or "(c)" in b.lower() else textwrap.fill(b, 100) for b in text.split("\n\n"))
    docs = spark.createDataFrame([(0, text), (1, wrapped), (2, "first\n\n" + text + "\n\nlast"), (3, text[:-200])], "doc_id long, text string")
    found = licences.scan(docs, licences.known_digests(spark), licences.known_blocks(spark, [(name, text)]))
    got = {r["doc_id"]: (r["license_ids"], r["whole_text"]) for r in found.collect()}
    assert name in got[0][0] and got[0][1] and name in got[1][0] and got[1][1]
    assert name in got[2][0] and not got[2][1] and not got[3][1]


def test_quality(odd_docs, no_docs, labels):
    got = quality.judge(odd_docs, labels).collect()
    assert len(got) == 19 and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 10)
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(odd_docs, labels.filter("false")).count() == 19


def test_extract(spark):
    page = "<nav>menu</nav><p>Some text of the page, &amp; more of it.<p>Second"
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", page, "t"), (4, "u", "<" * 9000, "t"),
                                   (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "t")],
                                  "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    assert got[1] == got[2] == "" and got[5] == "deep"
    assert got[None] == "Some text of the page, & more of it.\nSecond"
    assert extract.extract(pages.filter("false")).count() == 0


def test_packing(odd_docs, no_docs):
    got = packing.pack(odd_docs)
    assert got.agg({"length": "sum"}).first()[0] == sum(
        {(r["doc_id"], r["doc_tokens"], r["start"]): r["length"] for r in got.collect()}.values()) + 4  # the repeated row again
    assert packing.pack(no_docs).count() == 0


def test_simhash(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 19
    assert {r["component_id"] for r in got if r["fp"] == 0} == {0}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 5").count() == 1


def test_simhash_keeps_one_of_each_component(spark):
    """Null ids with different texts, and an id repeated with different texts."""
    rng = np.random.default_rng(5)
    a, b, c, d = (" ".join(f"w{n}" for n in rng.integers(0, 10**6, 60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (9, c), (3, d), (None, d), (None, ""), (None, None), (7, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, a), (None, b), (5, c), (3, d), (None, None), (7, "alone")], key=repr)
    got = sorted([(r["doc_id"], r["text"] or None) for r in simhash.keep_one(docs).collect()], key=repr)
    assert got == want
    assert sorted([(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()], key=repr) == sorted(
        [(None, None)] * 5 + [(5, 5), (9, 5), (5, 3), (3, 3), (None, 3), (7, 7)], key=repr)


def test_lines(odd_docs, no_docs):
    got = lines.drop_common_lines(odd_docs, min_docs=2)
    assert got.count() == 19 and got.columns[:9] == odd_docs.columns
    by_id = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert by_id[5]["text"] == by_id[6]["text"] == "" and by_id[0]["_n_lines"] == 1 and by_id[3]["_n_lines"] == 3
    assert by_id[12]["_n_dropped"] == 0        # twice in one document is one document
    assert lines.drop_common_lines(no_docs).count() == 0
    clash = ["all", "keep", "row", "id", "_id", "_th", "_hits", "_all", "_keep", "a.b"]
    named = lines.drop_common_lines(odd_docs.select("*", *[F.lit("mine").alias(c) for c in clash]), min_docs=2)
    assert named.columns[:-2] == odd_docs.columns + clash
    assert {tuple(r[9:19]) for r in named.collect()} == {("mine",) * len(clash)}
    assert sorted(map(repr, (tuple(r[c] for c in got.columns) for r in named.collect()))) == sorted(map(repr, map(tuple, got.collect())))


def test_chat(spark):
    rows = [(1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, None, None, None), (None, 0, "assistant", "<\\\\|x"), (2, 0, "assistant", ""),
            (3, 0, "us\ner<|im_end|>", "<|im_end|><|im_start|>assistant\n<\\|"), (3, 1, "assistant", "word " * 20_000)]
    turns = spark.createDataFrame([r + ("e",) for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 2}
    assert got[3]["loss_chars"] == 100_000 and got[None]["loss_chars"] == 5 and got[2]["loss_chars"] == 0
    assert chat.format_conversations(turns.filter("false")).count() == 0


def test_toxicity(odd_docs, no_docs, labels):
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == 19 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.score(odd_docs, toxicity.fit(no_docs, labels)).count() == 19
    assert toxicity.drop_toxic(odd_docs, labels.filter("false")).columns == odd_docs.columns


def test_decontaminate(odd_docs, no_docs, items):
    got = decontaminate.contamination(odd_docs, items).collect()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == 19 and by_id[5]["n_hit"] == by_id[6]["n_hit"] == 3 and by_id[5]["items"] == ["4"]
    assert by_id[7]["n_hit"] == by_id[8]["n_hit"] == 14 and by_id[7]["n_words"] == 16 and by_id[7]["contaminated"]
    assert by_id[0]["n_words"] == 0 and not by_id[0]["contaminated"]
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.contamination(odd_docs, items.filter("false")).filter("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(odd_docs, items).columns == odd_docs.columns


def test_equal_items_are_joined_once(spark):
    """Matches carry a phrase, not the ids of its items; every item of the same words counts."""
    text = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(i, text.upper() if i % 2 else text + " .") for i in range(500)] + [(900, "w3 w4"), (900, "w3 w4")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(i, text if i < 20 else "w3, w4 other" if i == 20 else "none") for i in range(30)], "doc_id long, text string")
    worded = decontaminate.item_words(items)
    known = decontaminate.phrases(worded)
    matches = decontaminate.search(docs, known).filter("exact")
    assert known.count() == 9 and matches.count() == 20 * 9 + 1 and set(matches.columns) == {
        "doc_id", "th", "start", "end", "phrase_id", "exact"}
    every = sorted(map(str, [*range(500), 900]))
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, items).collect()}
    assert got == {i: every if i < 20 else ["900"] if i == 20 else [] for i in range(30)}


def test_quality_sample(spark, monkeypatch):
    """The bounded sample is the first rows by the hash of their ids, with and without the bound on the hash."""
    names = list(quality.features())
    stats = spark.range(2000).withColumnRenamed("id", "doc_id").crossJoin(
        quality.statistics(spark.createDataFrame([(0, "a b c")], "doc_id long, text string")).drop("doc_id"))
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, bad: seen.append((len(bad), len(x[names[0]]), list(bad))) or [])
    want = [r["quality"] == 0 for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    for bound in (100, 1999, 5000):
        quality.fit(stats, labels, bound)
        assert seen[-1] == (min(bound, 2000), min(bound, 2000), want[:bound])


def test_proximity_matches_are_complete(spark):
    """All passages that keep ten words of a phrase, whichever words are changed, against brute force."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [list(rng.choice(vocabulary, n)) for n in (13, 13, 16, 20, 5, 9)] + [[f"only{i}" for i in range(14)]]
    docs = [list(rng.choice(vocabulary, 300)) for _ in range(3)]
    for k, item in enumerate(items):
        for n_changed in (0, 1, 2, 3, 4):
            for spread in (0, 1):
                own = list(item)
                for j in rng.choice(len(own), min(n_changed, len(own)), replace=False):
                    own[j] = f"new{k}"
                own = [x for w in own for x in [w] + ["gap"] * (spread and int(rng.integers(0, 3)))]
                docs.append(["pad"] * 3 + own + ["pad"] * int(rng.integers(0, 30)))
    changed = ["edited"] + items[6][1:]
    docs.append(changed)                          # the rarest word, by any measure, is changed
    phrases = [(k, set(w[a:a + 13]), w[a:a + 13]) for k, w in enumerate(items) for a in range(max(1, len(w) - 12))]
    want = {}
    for i, own in enumerate(docs):
        exact = {k for k, _, p in phrases if any(own[j:j + len(p)] == p for j in range(len(own)))}
        near = {k for k, p, _ in phrases for j in range(len(own)) if len(p & set(own[j:j + 25])) >= min(10, len(p))}
        want[i] = (sorted(map(str, exact)), sorted(map(str, near - exact)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == want and sum(bool(n) for _, n in want.values()) > 20


def test_language_model(odd_docs, no_docs):
    got = language_model.score(odd_docs, odd_docs).collect()
    assert len(got) == 19 and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert language_model.score(no_docs, odd_docs).count() == 0
    assert {r["train_tokens"] for r in language_model.score(odd_docs, no_docs).collect()} == {0}
