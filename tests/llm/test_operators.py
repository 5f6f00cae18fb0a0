"""Each operator against brute force, on edge cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.llm import queries as Q
from tallystone.llm.containment import contained_items
from tallystone.llm.cut_extraction import extract_main_text, main_text, min_cut
from tallystone.llm.dart_minhash import dart_signatures, keep_one, near_duplicates, similar
from tallystone.llm.fm_index import FMIndex, WaveletMatrix
from tallystone.llm.license_scan import TEMPLATES, scan_licenses
from tallystone.llm.line_frequency import line_frequency
from tallystone.llm.piece_sampling import Sampler, sample_segmentations, vocabulary
from tallystone.llm.substring_dedup import remove_repeats
from tallystone.llm.subword_quality import quality_model, score_texts
from tallystone.llm.token_records import pack, token_records, unpack
from tallystone.llm.toxicity_chain import score_toxicity, toxicity_chain
from tallystone.llm.words import Texts, mix, shingles, windows

from .conftest import BASE, EDGES, LONG, docs_frame

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_words_and_hashes():
    texts = ["", " a b c\nd", "a b", "x" * 9]
    t = Texts(pa.array(texts))
    starts, ends, bounds = t.spans()
    assert np.diff(bounds).tolist() == [len(words(x)) for x in texts]
    h = t.hashes(starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    at, runs = windows(h, bounds, 2)
    assert len(at) == 2
    assert shingles(t)[0].tolist() == [1, 2, 3]


# 1 and 6
def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_learns_and_scores_every_row(spark, edges, nothing):
    good = [(i, f"the river and the field are calm number{i} today and the sun is out") for i in range(0, 120, 2)]
    bad = [(i, f"$$$ win### cash*** now!!! {i}%%% free$$$ $$$click") for i in range(1, 120, 2)]
    docs = docs_frame(spark, good + bad)
    marks = labels(spark, [(i, 1 - i % 2, 0) for i in range(80)] + [(500, None, 0), (None, 1, 1)])
    model = quality_model(docs, marks)
    rows = score_texts(docs, model).collect()
    assert all((r["_score"] > 0.5) == (r["doc_id"] % 2 == 0) for r in rows if r["doc_id"] >= 80)
    got = score_texts(edges, model)
    assert got.count() == len(EDGES) and got.columns.count("_score") == 1
    assert all(0 <= r["_score"] <= 1 for r in got.collect())
    assert score_texts(nothing, model).count() == 0
    assert score_texts(edges, quality_model(edges, labels(spark, []))).agg(F.min("_score"), F.max("_score")).first()[:] == (0.5, 0.5)


def test_quality_query_is_accurate_on_held_out_rows(spark):
    found = Q.QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    truth = Q.table(spark, "/root/testdata/sf0.01", "labels").toPandas()
    both = found.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert list(found.held_out) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]


def test_toxicity_chain(spark, edges, nothing):
    rows = [(i, f"plain text about birds {i} and trees" + (" you idiot" if i % 3 == 0 else "") + (" ###" if i % 2 else "")) for i in range(240)]
    docs = docs_frame(spark, rows)
    marks = labels(spark, [(i, 1 - i % 2, int(i % 3 == 0)) for i in range(150)])
    chain = toxicity_chain(docs, marks.withColumnRenamed("quality", "q"), ["q", "toxic"], min_docs=5)
    assert len(chain.models[1].chain) == 1
    got = score_toxicity(docs, chain).collect()
    assert all((r["_probabilities"][1] > 0.5) == (r["doc_id"] % 3 == 0) for r in got)
    assert score_toxicity(edges, chain).count() == len(EDGES)
    assert score_toxicity(nothing, chain).count() == 0
    flat = toxicity_chain(docs, marks.limit(0), ["quality", "toxic"])
    assert score_toxicity(edges, flat).first()["_probabilities"] == [0.5, 0.5]


# 2
PAGE = """<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href=/a>A</a></li><li><a>B</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Caf&eacute; &amp; bar</h1>
<p>First <b>part</b> of
 the story, with &lt;tags&gt; shown.<p>Second part.</p><div class="comments"><p>Nice post, I think so too.</p></div></article>
<aside class="sidebar">Related things</aside><form><label>Name</label></form><footer>&copy; 2020</footer></body></html>"""


def test_extraction(spark):
    assert main_text(PAGE) == "Café & bar\nFirst part of the story, with <tags> shown.\nSecond part."
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    assert main_text("<div>" * 3000 + "<p>" + "Long words here. " * 30 + "</p>").startswith("Long words")
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "y")], "page_id long, html string, _main_text string")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "html", "_main_text"] and got.count() == 3
    assert extract_main_text(pages.limit(0)).count() == 0


def test_unseen_elements_without_an_end_tag():
    story = "<article><p>First part of the story, which is long enough.</p><p>Second part of the story, also long.</p></article>"
    want = "First part of the story, which is long enough.\nSecond part of the story, also long."
    head = "<html><head><meta charset=utf-8><title>A <b>title</b></title><style>p {}</style><script>'<p>'</script>"
    assert main_text(f"{head}</head><body>{story}</body></html>") == want
    assert main_text(f"{head}<body>{story}</body></html>") == main_text(f"{head}{story}") == want
    assert main_text(f"{head}<noscript><img src=x></noscript><title>More</title><body>{story}") == want
    assert main_text(f"<head><noscript><link href=x><body>{story}") == want
    for tag in ("noscript", "svg", "object", "iframe", "canvas", "audio", "video", "template"):
        assert main_text(f"<body><div><{tag}>unseen {story}</div><p>Text after all of that, at last.</p>") == f"{want}\nText after all of that, at last."
        hidden = f"<{tag}><p>This is not shown to any of the readers.</p></{tag}>"
        assert main_text(f"<body><div>{hidden}{story}</div>") == want
        assert main_text(f"<body><div><{tag}>unseen {hidden}{story}</div>") == want
    assert main_text("<head><title>T</title>Words that end the head, as in browsers, and are long.") == "Words that end the head, as in browsers, and are long."
    assert main_text("<div><noscript>" * 2000 + story) == want


def test_min_cut_against_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        s, t = rng.random(n) * 3, rng.random(n) * 3
        edges = [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (n * 2, 2)) if a != b]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([(m >> i) & 1 for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(min_cut(list(s), list(t), edges)), best, abs_tol=1e-6)


def test_extraction_of_the_tables_pages(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in Q.table(spark, SMALL, "pages").collect()}
    for r in Q.QUERIES["op2_html_extraction"](spark, SMALL).collect():
        parts = re.split(r"</?(?:p|h1|br|article)\b[^>]*>", re.search(r"<article>.*</article>", pages[r["page_id"]], re.S)[0])
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
        assert r["text"] == "\n".join(p for p in want if p) and r["n_chars"] == len(r["text"])


# 3
def test_license_scan_against_all_templates(spark, edges, nothing):
    def grams(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        return set(zip(w, w[1:], strict=False))

    rows = [(1, "intro\n" + TEMPLATES["MIT"][1]), (2, TEMPLATES["GPL-3.0"][0] + "\nmore\n\nRELEASED under the mit license"), (3, "Some words here.")]
    got = {r["doc_id"]: {x["license"]: x["dice"] for x in r["_licenses"]} for r in scan_licenses(docs_frame(spark, rows)).collect()}
    for i, text in rows:
        best = {}
        for unit in [*text.split("\n"), *text.split("\n\n"), text]:
            a = grams(unit)
            # a unit reports its best template only
            scored = sorted((-2 * len(a & grams(t)) / (len(a) + len(grams(t))), n) for n, ts in TEMPLATES.items() for t in ts) if a else []
            if scored and -scored[0][0] >= 0.8:
                best[scored[0][1]] = max(best.get(scored[0][1], 0), -scored[0][0])
        assert got[i] == pytest.approx(best)
    assert set(got[2]) == {"GPL-3.0", "MIT"}
    assert scan_licenses(edges).count() == len(EDGES) and scan_licenses(nothing).count() == 0


def test_license_scan_finds_notices_inside_other_words(spark):
    rows = [
        ("Copyright (c) 2020 The Authors. Licensed under the Apache License, Version 2.0.", {"Apache-2.0": 1}),
        ("Copyright 2024 Foo Inc. All rights reserved.", {"Proprietary": 1}),
        ("This article is licensed under CC BY-NC 4.0. See the site for details.", {"CC-BY-NC-4.0": 1}),
        (f"{BASE} released under the MIT License {BASE} licensed under CC BY-SA 4.0 {BASE}", {"MIT": 1, "CC-BY-SA-4.0": 1}),
        (f"{BASE}. This work is licensed under the GNU General Public License, version 2. {BASE}", {"GPL-2.0": 1}),
        *[(f"{n} License\n\nCopyright (c) 2020 The Authors\n\n{TEMPLATES[n][-1]}", {n: 1}) for n in ("MIT", "BSD-3-Clause", "ISC", "Unlicense")],
        (f"{BASE}\n \t\nAll rights\nreserved.\n\r\n{BASE}", {"Proprietary": 1}),
        ("all rights reserved " * 500, {"Proprietary": 1}), ("all rights were reserved", {}), (BASE, {}), (None, {}),
    ]
    got = scan_licenses(docs_frame(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()
    assert {r["doc_id"]: {x["license"]: x["dice"] for x in r["_licenses"]} for r in got} == {i: w for i, (_, w) in enumerate(rows)}


def test_license_runs_against_all_runs(spark):
    templates = {"one": ["a b c d e", "b c"], "two": ["a b c x e f g"]}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("abcdefgxy"[int(x)] for x in rng.integers(0, 5 + i % 5, 30))) for i in range(60)]

    def grams(w):
        return set(zip(w, w[1:], strict=False))

    def best(text, names):
        w, most = text.split(), {}
        for n in names:
            for t in templates[n]:
                b = grams(t.split())
                dice = [2 * len(a & b) / (len(a) + len(b)) for i in range(len(w)) for j in range(i + 2, len(w) + 1) for a in [grams(w[i:j])]]
                most[n] = max([d for d in dice if d >= 0.8] + [most.get(n, 0)])
        return {n: d for n, d in most.items() if d}

    for name in templates:  # each licence alone: nothing overlaps
        got = scan_licenses(docs_frame(spark, rows), templates={name: templates[name]}).collect()
        assert {r["doc_id"]: {x["license"]: pytest.approx(x["dice"]) for x in r["_licenses"]} for r in got} == {i: best(t, [name]) for i, t in rows}
    for r in scan_licenses(docs_frame(spark, rows), templates=templates).collect():
        want = best(r["text"], templates)
        have = {x["license"]: x["dice"] for x in r["_licenses"]}
        assert set(have) <= set(want) and max(have.values(), default=0) == pytest.approx(max(want.values(), default=0))


# 4
def test_containment_against_brute_force(spark, edges, nothing):
    rng = np.random.default_rng(1)
    vocabulary_ = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary_, int(n)))) for i, n in enumerate([5, 8, 20, 40, 41, 60, 3, 1])] + [(90, ""), (91, None), (None, "a b c d e f"), (3, "several texts of one id are all searched for"), (3, "w1 w2 w3 w4 w5 w6"), (None, "w7 w8 w9 w10 w11 w12 w13")]
    docs = [(100, "before A b c d E f after"), (101, "they say several texts of one id are all searched for"), (102, "w7 w8 w9 w10 w11 w12 w13"), (103, "w1 w2 w3 w4 w5 w6 " + items[3][1])]
    for d in range(60):
        parts = [" ".join(rng.choice(vocabulary_, 30))]
        if d % 2:
            w = items[d % 8][1].upper().split()
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = "zz"
            parts.append(", ".join(w))
        docs.append((d, " ".join(parts)))

    def runs(text, k):
        w = re.findall(r"[0-9a-z]+", (text or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["_items"] for r in contained_items(docs_frame(spark, docs), table).collect()}
    for d, text in docs:
        want = set()
        for i, t in items:
            k = min(5, len((t or "").split()))
            if k and len(runs(t, k) & runs(text, k)) / len(runs(t, k)) >= 0.8:
                want.add(i)
        assert got[d] == sorted(want, key=lambda i: (i is None, i))
    assert got[100] == [None] and got[101] == [3] and got[103].count(3) == 1
    assert any(len(v) > 1 for v in got.values())
    assert contained_items(edges, table).count() == len(EDGES)
    assert contained_items(nothing, table).count() == 0
    assert contained_items(edges, table.limit(0)).where(F.size("_items") > 0).count() == 0


def test_containment_in_several_blocks(spark, monkeypatch):
    from tallystone.llm import containment

    docs, items = Q.table(spark, SMALL, "documents"), Q.table(spark, SMALL, "benchmark")
    want = sorted((r["doc_id"], r["_items"]) for r in contained_items(docs, items).collect())
    monkeypatch.setattr(containment, "BLOCK", 400)
    assert sorted((r["doc_id"], r["_items"]) for r in contained_items(docs, items).collect()) == want


# 5
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(lattice, node):
    """Log-chance of every path from a node to the end of its word, by its edges."""
    out = {}
    for e in range(lattice.edges[node], lattice.edges[node + 1]):
        to = lattice.to[e]
        rest = all_segmentations(lattice, to) if to >= lattice.n_last else {(): 0.0}
        out |= {(e, *path): math.log(lattice.chance[e]) + log for path, log in rest.items()}
    return out


@pytest.mark.parametrize("text", ["strong", "an old", "of it", "a", "river", "the sun", "calm", "word", "in no", "house"])
def test_more_samples_than_segmentations_returns_all_of_them(text):
    vocab, keys = vocabulary(MODEL), np.arange(20, dtype=np.int64) * 104729
    sampler = Sampler(vocab, Texts(pa.array([text] * len(keys))), keys, 1.0)
    want = {(): 0.0}
    for w in range(sampler.words[0], sampler.words[1]):
        own = all_segmentations(sampler.lattice, sampler.lattice.start[sampler.kind[w]])
        want = {(*a, *b): x + y for a, x in want.items() for b, y in own.items()}
    taken, threshold = sampler.sample(len(want) + 3)
    for i in range(len(keys)):
        got = {}
        for s, log, _ in taken[i]:
            path = sampler.paths[s]
            got[tuple(path.edge[path.bounds[i] : path.bounds[i + 1]].tolist())] = log
        assert len(taken[i]) == len(want) and threshold[i] == -np.inf
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in got)


def test_samples_are_distinct_exact_and_without_replacement():
    vocab, n = vocabulary(MODEL), 4000
    sampler = Sampler(vocab, Texts(pa.array(["the a"] * n)), np.arange(n, dtype=np.int64) * 7919, 0.5)
    taken, threshold = sampler.sample(3)
    first, pairs, chance = Counter(), Counter(), {}
    for i in range(n):
        paths = [tuple(sampler.ids(s, i)) for s, _, _ in taken[i]]
        assert len(set(paths)) == len(paths)
        order = [g for _, _, g in taken[i]]
        assert order == sorted(order, reverse=True) and threshold[i] <= order[-1]
        for p, (_, log, _) in zip(paths, taken[i], strict=True):
            chance[p] = math.exp(log)
        first[paths[0]] += 1
        pairs[paths[0], paths[1]] += 1
    for p, c in first.most_common(4):
        assert abs(c / n - chance[p]) < 0.03
    for (a, b), c in pairs.most_common(4):
        assert abs(c / n - chance[a] * chance[b] / (1 - chance[a])) < 0.03
    # inclusion scores weigh samples without bias: the weights estimate the total mass, 1
    total = np.mean([sum(math.exp(g) / -math.expm1(-math.exp(g - threshold[i])) for _, g, _ in taken[i]) for i in range(n)])
    assert abs(total - 1) < 0.02


def test_segmentations_decode_and_do_not_depend_on_partitions(spark, edges, nothing):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=MODEL)
    got = sample_segmentations(edges, MODEL, F.col("doc_id"), k=3).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert r["_round_trip"]
        for s in r["_samples"]:
            ids = np.frombuffer(s["ids"], "<u4").tolist()
            assert len(ids) == s["n_pieces"] and s["log_inclusion"] <= 0
            assert model.decode(ids) == (r["text"] or "")
        if not r["text"]:
            assert [s["n_pieces"] for s in r["_samples"]] == [0] and r["_samples"][0]["log_inclusion"] == 0
    again = sample_segmentations(edges.repartition(7), MODEL, F.col("doc_id"), k=3).collect()

    def key(rows):
        return sorted((str(r["doc_id"]), r["text"] or "", [bytes(s["ids"]) for s in r["_samples"]]) for r in rows)

    assert key(got) == key(again)
    assert sample_segmentations(nothing, MODEL, F.col("doc_id")).count() == 0


# 7
def line_truth(rows, min_docs, max_share, min_left):
    hosts, seen = defaultdict(set), defaultdict(set)
    split = lambda t: [x for x in (t or "").split("\n") if words(x)]
    norm = lambda x: " ".join(words(x.lower()))
    for i, t, h in rows:
        if t:
            hosts[h].add(t)
        for x in split(t):
            seen[h, norm(x)].add(t)
    out = []
    for i, t, h in rows:
        w = words(t)
        lines = split(t)
        grams = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        cover = {b for a in range(len(w) - 7) if grams[tuple(w[a : a + 8])] > 1 for b in range(a, a + 8)}
        gone = sum(len(words(x)) for x in lines if len(seen[h, norm(x)]) > min_docs and len(seen[h, norm(x)]) > max_share * len(hosts[h]))
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), gone, failed,
                    not failed and len(w) - gone >= min_left * len(w)))
    return sorted(out, key=str)


def test_line_frequency(spark, edges, nothing):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        body = "\n".join(" ".join(f"u{x}" for x in rng.integers(0, 400, 12)) for _ in range(int(rng.integers(1, 4))))
        if i % 2:
            body += "\nPlease  Accept our cookies and read the notice before you go on with it all day long"
        if i % 9 == 0:
            body += "\n" + body
        rows.append((i, body, f"h{i % 2}" if i % 5 else None))
    rows += [(200, rows[1][1], rows[1][2]), rows[3], (201, "## " * 30 + "a|b <c>", "h1")]
    got = line_frequency(docs_frame(spark, rows), min_docs=10, max_share=0.3).collect()
    assert sorted((tuple(r) for r in got), key=str) == line_truth(rows, 10, 0.3, 0.5)
    edge_rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in EDGES]
    assert sorted((tuple(r) for r in line_frequency(edges).collect()), key=str) == line_truth(edge_rows, 10, 0.05, 0.5)
    assert line_frequency(nothing).count() == 0


# 8
def removal_truth(rows):
    first = {}
    rank = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, float("inf")), rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {b for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < rank(i) for b in range(a, a + 13)}
        kept = " ".join(x for b, x in enumerate(w) if b not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 23, 600])
def test_repeats_against_brute_force(spark, edges, nothing, monkeypatch, size):
    from tallystone.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", size)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", size)
    rng = np.random.default_rng(2)
    passages = [" ".join(f"p{x}" for x in rng.integers(0, 50, 30)) for _ in range(4)]
    rows = []
    for i in range(50):
        own = lambda: " ".join(f"q{x}" for x in rng.integers(0, 9, 20))
        cut = passages[i % 4].split()
        a = int(rng.integers(0, 10))
        rows.append((int(rng.permutation(50)[0]) * 100 + i, f"{own()}\n{' '.join(cut[a:a + int(rng.integers(10, 21))])} {own()}"))
    rows += [(7, "same " * 60), (9000, "same " * 40), (9001, rows[0][1]), rows[1]]
    got = remove_repeats(docs_frame(spark, rows)).select("doc_id", "_n_words", "_n_removed", F.sha2("_kept", 256), "text").collect()
    assert sorted((str(r[0]), *r[1:4]) for r in got) == removal_truth(rows)
    assert sorted(r["text"] for r in got) == sorted(t for _, t in rows)
    if size > 1000:
        found = remove_repeats(edges)
        assert sorted((str(r[0]), *r[1:4]) for r in found.select("doc_id", "_n_words", "_n_removed", F.sha2("_kept", 256)).collect()) == removal_truth(
            [r[:2] for r in EDGES])
        assert found.where("text is null").count() == 3
        assert remove_repeats(nothing).count() == 0


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 37, 1000)
    matrix = WaveletMatrix(values, 37)
    for c in range(37):
        for i in (0, 1, 63, 64, 65, 500, 1000):
            assert matrix.rank(np.array([c]), np.array([i]))[0] == (values[:i] == c).sum()
    for trial in range(25):
        size, few = int(rng.integers(2, 14)), 3 + trial % 3
        texts = [rng.integers(1, few, rng.integers(1, 40)) for _ in range(12)]
        owner = rng.integers(0, 100, 12)
        index = FMIndex(np.concatenate([np.append(x, 0) for x in texts]), np.repeat(owner, [len(x) + 1 for x in texts]), size)
        queries = [rng.integers(0, few, rng.integers(1, 40)) for _ in range(10)] + texts[:3]
        bounds = np.concatenate([[0], np.cumsum([len(q) for q in queries])])
        found = dict(zip(*(x.tolist() for x in index.stream(np.concatenate(queries), bounds, block=5)), strict=True))
        least = {}
        for x, o in zip(texts, owner, strict=True):
            for i in range(len(x) - size + 1):
                least[tuple(x[i : i + size])] = min(least.get(tuple(x[i : i + size]), 999), o)
        want = {b + i: least[tuple(q[i : i + size])] for q, b in zip(queries, bounds, strict=False)
                for i in range(len(q) - size + 1) if tuple(q[i : i + size]) in least}
        assert found == want


# 9
def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    element = mix(np.arange(300, dtype=np.uint64))
    a, b = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    pair = dart_signatures(np.repeat([0, 1], 300), np.concatenate([element, element]), 2, 4096, np.concatenate([a, b]))
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((pair[0] == pair[1]).mean() - truth) < 0.04
    assert np.isinf(dart_signatures(np.zeros(0, int), np.zeros(0, np.uint64), 1, 8)).all()


def near_truth(rows):
    sets = {}
    for _, t in rows:
        w = words(t)
        if w:
            sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    texts = list(sets)
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    links = Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[top(a)] = top(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for i, t in rows:
        if t in sets and i is not None:
            least[top(t)] = min(least.get(top(t), i), i)
    return sorted(((i, least.get(top(t)) if t in sets else i, links[t]) for i, t in rows), key=str)


@pytest.mark.parametrize("blocks", [1024, 7])
def test_near_duplicates_against_brute_force(spark, edges, nothing, monkeypatch, blocks):
    from tallystone.llm import dart_minhash

    monkeypatch.setattr(dart_minhash, "BLOCK_TEXTS", blocks)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(8):
        base = [f"g{g}w{x}" for x in rng.integers(0, 90, 120)]
        for _ in range(12 if g else 30):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, rows[0][1]), (901, rows[0][1]), rows[5]]
    got = near_duplicates(docs_frame(spark, rows)).select("id", "class_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == near_truth(rows)
    kept = keep_one(docs_frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[1] for r in near_truth(rows)})
    if blocks > 100:
        found = near_duplicates(edges).select("id", "class_id", "n_links").collect()
        assert sorted((tuple(r) for r in found), key=str) == near_truth([r[:2] for r in EDGES])
        assert keep_one(edges).columns == edges.columns
        assert near_duplicates(nothing).count() == 0 and keep_one(nothing).count() == 0


def test_unrelated_texts_without_an_id_or_with_the_same_one_are_kept(spark):
    def own(i):
        return " ".join(f"t{i}w{j}" for j in range(30))

    rows = [*[(None, own(i)) for i in range(4)], (None, own(0)), (None, own(1) + " end"), *[(7, own(i)) for i in range(10, 14)], (7, own(10)),
            (8, own(11) + " end"), (None, own(12)), (None, "two words"), (7, "other words"), (None, None), (7, "")]
    kept = Counter((r["doc_id"], r["text"]) for r in keep_one(docs_frame(spark, rows).repartition(3)).collect())
    ends = [t for i, t in kept if t and t in (own(1), own(1) + " end")]  # of these near copies without an id one stays
    assert len(ends) == 1
    assert kept == Counter([(None, own(0)), (None, ends[0]), (None, own(2)), (None, own(3)), *[(7, own(i)) for i in range(10, 14)],
                            (None, "two words"), (7, "other words"), (None, None), (7, "")])


def test_similar_of_two_blocks():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.5 for b in sets] for a in sets])
    assert (similar(sets[:5], sets[5:], 0.5) == want[:5, 5:]).all()
    np.fill_diagonal(want, False)
    assert (similar(sets, None, 0.5) == want).all()


def test_similar_holds_at_the_threshold():
    lost = []
    for shared in range(4, 400, 4):  # a set and the same set with a quarter more: 0.8
        a, b = np.arange(shared, dtype=np.uint64), np.arange(shared * 5 // 4, dtype=np.uint64)
        beyond = np.arange(shared * 5 // 4 + 1, dtype=np.uint64)
        if not (similar([a, b], None, 0.8)[0, 1] and similar([a], [b], 0.8)[0, 0]) or similar([a], [beyond], 0.8)[0, 0]:
            lost.append(shared)
    assert not lost


# 10
def test_records_round_trip(spark, edges, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [r[:2] for r in EDGES] + [(20, "a<|endoftext|>b <|STARTOFTEXT|>"), (21, "x y\x1cz q\x85r"), (22, "é ́e ΑΣ ΣΑ")]
    got = token_records(docs_frame(spark, rows), path).collect()
    want, start = [], 0
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    by_id = defaultdict(list)
    for i, t in order:
        by_id[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    for r in got:
        assert r["start"] == start and bytes(r["ids"]) in by_id[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    assert token_records(nothing, path).count() == 0
    assert want == []


def test_damaged_records_are_refused():
    record = pack(b"payload")
    assert unpack(record * 2, len(record)) == b"payload"
    for at in (0, 9, 14, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            unpack(bytes(broken), 0)


def test_long_text_is_whole():
    assert len(words(LONG)) == 30_000 and len(words(BASE)) == 27


def test_pipeline(spark):
    import corpus_pipeline

    docs = Q.table(spark, SMALL, "documents")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SMALL)
        assert seen.columns == docs.columns
    last = corpus_pipeline.run(spark, SMALL).collect()
    assert 0 < len(last) <= docs.count() and all(r["round_trip"] for r in last)
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in seen.collect())
