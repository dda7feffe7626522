"""Operators that SQL cannot express, against plain versions of their contracts."""

import re
import zlib
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations, product
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from linearspark.llm import extract, language_model, packing, quality, simhash, toxicity
from linearspark.llm.queries import QUERIES

from .conftest import SF, TEXTS

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_fingerprint(text):
    words = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id reachable over pairs of at most two differing bits."""
    root = {i: i for i in fps}
    changed = True
    near = [(a, b) for a, b in combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_simhash_query(spark, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_golay_links_are_exact(spark):
    """Chains and balls of close fingerprints: the same components as all pairs."""
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(12):
        at = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(25):
            fps.append(at)
            for bit in rng.choice(64, size=int(rng.integers(1, 4)), replace=False):
                at ^= 1 << int(bit)
    fps = dict(enumerate(dict.fromkeys(fps)))
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in fps.items()]
    frame = spark.createDataFrame(rows, "i long, fp long")
    pairs = simhash.links(frame.select("fp"))
    vertex = {fp: i for i, fp in rows}
    got = defaultdict(set)
    for r in simhash.connected_components(pairs).collect():
        got[r["root"]].add(vertex[r["vertex"]])
    want = defaultdict(set)
    for i, root in plain_components(fps).items():
        want[root].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_golay_code_is_perfect():
    index = simhash.golay_index()
    words = np.random.default_rng(0).integers(0, 1 << 21, 500)
    for a, b in combinations(range(21), 2):     # any two flips keep a common index
        keys = [{int(index[w ^ f]) for f in simhash._flips(21)} for w in words[:3]]
        other = [{int(index[w ^ 1 << a ^ 1 << b ^ f]) for f in simhash._flips(21)} for w in words[:3]]
        assert all(x & y for x, y in zip(keys, other))
    assert {len({int(index[w ^ f]) for f in simhash._flips(22)}) for w in words} <= set(range(1, 7))


def test_quality_query(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        words = SPACED.findall(text)
        grams = [tuple(words[j:j + 5]) for j in range(len(words) - 4)]
        count = Counter(grams)
        covered = {j + k for j, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        lines = text.split("\n")
        dup = sum(bool(SPACED.search(x)) and x in lines[:j] for j, x in enumerate(lines))
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_rules_are_learned_and_ordered(spark):
    rng = np.random.default_rng(0)
    x = {k: rng.random(4000) for k in quality.features()}
    bad = (x["digit_share"] >= 0.8) | (x["n_words"] < 0.1)
    rules = quality.learn(x, bad)
    hit = np.any([quality.covers(r, x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(4000, dtype=bool)) == []


def test_extract_query(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op3_html_extract"](spark, SF).collect():
        article = re.search("<article>(.*)</article>", html[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_extract_drops_what_is_no_article():
    content = "".join(f"<p>Paragraph {i} of the story, with enough words to be dense text.</p>" for i in range(4))
    noise = ('<div class="cookie-notice"><p>We use cookies to make this better.</p></div><aside>Side</aside>'
             '<form><label>Name</label></form><div id="comments"><p>A reader wrote a very long comment here, longer than all.</p></div>')
    page = (f"<html><body><header>Site</header><nav><a href=/>Home</a></nav><div><div class=story><h1>Title</h1>{content}"
            f"{noise}</div></div><footer>Foot</footer><script>var a='<p>x</p>'</script></body></html>")
    got = extract.main_text(page)
    assert got == "\n".join(["Title", *(f"Paragraph {i} of the story, with enough words to be dense text." for i in range(4))])


def test_packing_query(spark, texts):
    check_packing(QUERIES["op4_packing"](spark, SF).collect(), texts)


def check_packing(rows, texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(plain.encode(t, add_special_tokens=False).ids + [1], dtype="<u4") for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for own, total in [(sorted(p), len(ids[i])) for i, p in pieces.items()] + [(sorted(s), None) for s in sequences.values()]:
        at = 0
        for start, length in own:
            assert start == at
            at += length
        assert at == total if total else at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_tokens_equal_the_plain_tokenizer():
    from linearspark.llm.tokens import encode
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in filter(None, TEXTS):
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours():
    cells = np.array(list(product(range(8), repeat=3)))
    keys = packing.hilbert_key(cells, bits=3)
    path = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_toxicity"](spark, sf).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"]]
    caught = [p for y, p in held if y]
    wrong = [p for y, p in held if not y]
    assert sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.03


def test_toxicity_misspellings():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeinorst"), 5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        own = list(rng.choice(words, 40))
        if i % 2:
            own[int(rng.integers(40))] = ["worthless", "pathetic", "disgusting"][i % 3]
        texts.append(" ".join(own))
        labels.append(i % 2)
    model = toxicity.train(texts, labels)
    clean = list(rng.choice(words, 40))
    score = lambda extra: model.score(toxicity.highest_windows([" ".join(clean + extra)], model))[0]
    assert score(["w0rthlesss"]) > 0.7 > score([]) and score(["patheticc"]) > 0.7


def test_language_model_query(spark, texts):
    lower = lambda t: SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = Counter(w for i, t in texts.items() if not held[i] for w in lower(t))
    total, distinct = sum(count.values()), len(count)
    got = QUERIES["op10_lm_score"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        own = lower(texts[r["doc_id"]])
        base = sum(log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), total)
        assert r["n_known"] == sum(count[w] > 0 for w in own) and abs(r["base_score"] - base) < 1e-6 * abs(base)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    c, d = 300, language_model.DIM
    p = language_model.Parameters(rng.normal(size=(c, d)), rng.normal(size=(d, d)), rng.normal(size=(d, d)), rng.normal(size=(c, d)) / 3,
                                  rng.normal(size=c))
    s = language_model.Scorer.of(p)
    for a, b in rng.integers(0, c, (20, 2)):
        every = [s(np.array([b, a, t]), c - 1)[2] for t in range(c)]
        assert abs((10.0 ** np.array(every, dtype=np.float64)).sum() - 1) < 1e-3


def test_language_model_tokens(monkeypatch):
    texts = [None, "", " ", "a", "A b  a\tÄ\u00a0x\x0b", "\nlast line \r", "a " * 500, "Z"]
    monkeypatch.setattr(language_model, "BATCH_BYTES", 12)
    batch = pa.RecordBatch.from_arrays([pa.array(["out of the slice", *texts])], ["text"]).slice(1)
    got = []
    for piece in language_model._by_bytes([batch]):
        assert piece.num_rows == 1 or sum(len((t or "").encode()) for t in piece.column("text").to_pylist()) <= 12
        found = language_model.Tokens.of(piece)
        a, b = language_model.batch_contexts(found.codes, found.starts, -1)
        words = found.words.to_pylist()
        for one, *before in zip(*(np.split(x, found.starts[1:]) for x in (found.codes, a, b))):
            got.append([words[i] for i in one])
            assert [x.tolist() for x in before] == [x.tolist() for x in language_model.contexts(one, -1)]
    assert got == [(t or "").encode().lower().split() + [b""] for t in texts]


def test_language_model_score_by_hand(spark, texts, monkeypatch):
    """The score of every text from the fitted parameters by a plain softmax over all classes."""
    fitted = {}
    train, lexicon = language_model.train, language_model.lexicon
    monkeypatch.setattr(language_model, "train", lambda t, lex, **k: fitted.setdefault("p", train(t, lex, max_rounds=1, **k)))
    monkeypatch.setattr(language_model, "lexicon", lambda c: fitted.setdefault("lex", lexicon(c, shared_words=100, max_top=20)))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs, docs).collect()}
    p, lex = fitted["p"], fitted["lex"]
    lower = lambda t: SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""]
    count = Counter(w for t in texts.values() for w in lower(t))
    top = sorted((w for w in count if w), key=lambda w: (-count[w], w.encode()))[:20]
    assert lex.top == 20 and len(lex.number) <= 101
    kind = lambda w: 20 if not w else top.index(w) if w in top else 21 + zlib.crc32(w.encode()[-3:]) % lex.suffixes
    size, members = Counter(), Counter()
    for w, n in count.items():
        size[kind(w)] += n
        members[kind(w)] += 1
    first, second = p.context.astype(float) @ p.first, p.context.astype(float) @ p.second
    for i, text in texts.items():
        a = b = 20
        total = 0.0
        for w in lower(text):
            logits = (first[a] + second[b]) @ p.target.T + p.bias
            t = kind(w)
            total += (logits[t] - np.log(np.exp(logits).sum())) / np.log(10)
            if t > 20:
                total += log10((count[w] + 0.1) / (size[t] + 0.1 * (members[t] + 1)))
            a, b = t, a
        assert abs(total - got[i]) < 1e-4 * abs(total)


def test_language_model_does_not_depend_on_files(spark, tmp_path):
    """One file, 64 files, other split sizes: the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = []
    for files in (1, 64):
        path = str(tmp_path / f"d{files}")
        docs.repartition(files).write.parquet(path)
        cut = spark.read.parquet(path)
        found.append({r["doc_id"]: r["score"] for r in language_model.score(cut, cut.filter("doc_id % 10 > 0")).collect()})
    assert all(abs(found[0][i] - found[1][i]) < 1e-6 * abs(found[0][i]) for i in found[0])


def test_language_model_parts(spark):
    """Several parts and rounds: a round over parts lowers the objective, an empty part changes nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lex = language_model.lexicon(language_model.corpus_counts(docs))
    shared = spark.sparkContext.broadcast(lex)
    encoded = language_model.encode(docs, shared, 5)
    now, seen = language_model.start(lex), []
    for number in range(3):
        rows = language_model._one_round(encoded, shared, spark.sparkContext.broadcast(now), number, 5)
        now, objective = language_model._average(rows, lex.n_classes)
        seen.append(objective)
    assert seen[0] > seen[1] > seen[2]


def test_pipeline(spark, texts):
    """Each stage against a plain version on the rows of the stage before."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    clean, lined, unique, decontaminated = ({r["doc_id"]: r["text"] or "" for r in d.collect()} for d in seen[:-1])
    assert all(clean[i] == texts[i] for i in clean) and 0.7 * len(texts) < len(clean)
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    spread = Counter(k for t in clean.values() for k in {key(x) for x in t.split("\n")} if k)
    assert lined == {i: "\n".join(x for x in t.split("\n") if spread[key(x)] < 10) for i, t in clean.items()}
    root = plain_components({i: plain_fingerprint(t) for i, t in lined.items()})
    assert unique == {i: t for i, t in lined.items() if root[i] == i}
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [word(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[j:j + 13]) for w in items if w for j in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def dirty(text):
        own = word(text)
        hit = {j + k for m in sizes for j in range(len(own) - m + 1) if tuple(own[j:j + m]) in windows for k in range(m)}
        return bool(hit) and 20 * len(hit) >= len(own)

    assert decontaminated == {i: t for i, t in unique.items() if not dirty(t)}
    check_packing(seen[-1].collect(), decontaminated)
