import random
import re

import pytest
from pyspark.sql import functions as F

from tallystone.functions import wikitext as wt
from tallystone.operators import provenance, reuse
from tallystone.operators.citations import overlay_metadata
from tallystone.sources import layout_text, markup


def brute_spans(current, prior, n):
    def words(s):
        return [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", "", s.lower())) if w]

    known = set()
    for p in prior:
        w = words(p)
        known |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    w = words(current)
    flag = [False] * len(w)
    for i in range(len(w) - n + 1):
        if tuple(w[i:i + n]) in known:
            flag[i:i + n] = [True] * n
    spans, start = [], None
    for i, f in enumerate([*flag, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            spans.append((start, i - 1))
            start = None
    return spans


def test_reuse_equals_brute_force(spark):
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(["a", "b,", "C", "d!", "--"]) for _ in range(n))
    current = [(i, make(rng.randint(0, 40))) for i in range(60)] + [(99, None)]
    prior = [(i, make(rng.randint(0, 12))) for i in range(12)]
    cur, pri = spark.createDataFrame(current, "k int, t string"), spark.createDataFrame(prior, "k int, t string")
    spans = reuse.reused_spans(cur, "k", "t", pri, "t", 4)
    got = {}
    for r in spans.collect():
        got.setdefault(r.k, []).append((r.span_start, r.span_end))
    want = {k: s for k, t in current if t and (s := brute_spans(t, [p for _, p in prior], 4))}
    assert want and {k: sorted(v) for k, v in got.items()} == want


def test_marked_text(spark):
    cur = spark.createDataFrame([(1, "One two, three four five"), (2, "nothing shared here")], "k int, t string")
    pri = spark.createDataFrame([("two three four",)], "t string")
    spans = reuse.reused_spans(cur, "k", "t", pri, "t", 3)
    got = {r.k: r.marked for r in reuse.marked_text(cur, "k", "t", spans).collect()}
    assert got == {1: "One <mark>two, three four</mark> five", 2: "nothing shared here"}
    new = {r.k: r.marked for r in reuse.marked_text(cur, "k", "t", spans, new=True).collect()}
    assert new[1] == "<mark>One</mark> two, three four <mark>five</mark>"


@pytest.mark.parametrize("pack", [(20_000, 2_000), (3, 5)])
def test_first_seen_equals_scan(spark, monkeypatch, pack):
    monkeypatch.setattr(provenance, "PACK_SENTENCES", pack[0])
    monkeypatch.setattr(provenance, "PACK_REVISIONS", pack[1])
    rng = random.Random(2)
    texts = [(a, i, " ".join(rng.choice(["ab", "b", "cab", "a"]) for _ in range(rng.randint(0, 12)))) for a in "xy" for i in range(40)]
    asked = {(a, " ".join(rng.choice(["ab", "b", "ca", "a"]) for _ in range(n))) for a in "xyz" for n in (1, 1, 2, 3, 3, 4, 5, 6) for _ in range(6)}
    asked |= {("x", "a"), ("x", "b a"), ("x", "zz zz zz")}
    rev = spark.createDataFrame(texts, "art string, ts int, body string").withColumn("who", F.concat(F.lit("u"), "ts"))
    sen = spark.createDataFrame(sorted(asked), "art string, s string")
    got = {(r.art, r.s): (r.ts, r.who) for r in provenance.first_seen(sen, rev, "art", "s", "body", "ts", ["who"]).collect()}
    want = {}
    for a, s in asked:
        hits = [i for x, i, t in texts if x == a and s in t]
        want[(a, s)] = (min(hits), f"u{min(hits)}") if hits else (None, None)
    assert got == want


def test_first_seen_in_long_revisions_and_edge_rows(spark):
    base = [f"w{i % 997}x{i % 31}" for i in range(16_000)]
    texts = [("a", k, " ".join([*base[: 4000 * k], f"new{k} words here", *base[4000 * k :]])) for k in range(4)]
    texts += [("a", 1, "tie of two"), ("a", 1, None), ("a", None, None), ("b", 7, ""), (None, 1, "tie of two")]
    asked = [("a", f"new{k} words") for k in range(5)] + [("a", "tie of"), ("a", "tie of"), ("a", ""), ("a", None), ("b", "x"), (None, "tie"), ("c", "w1x1")]
    rev = spark.createDataFrame([(a, t, s, f"u{k}") for k, (a, t, s) in enumerate(texts)], "art string, ts int, body string, who string")
    sen = spark.createDataFrame(asked, "art string, s string")
    got = {(r.art, r.s): (r.ts, r.who) for r in provenance.first_seen(sen, rev, "art", "s", "body", "ts", ["who"]).collect()}
    assert got == {**{("a", f"new{k} words"): (k, f"u{k}") for k in range(4)}, ("a", "new4 words"): (None, None), ("a", "tie of"): (1, "u4"),
                   ("b", "x"): (None, None), (None, "tie"): (None, None), ("c", "w1x1"): (None, None)}


def test_fragments(spark):
    raw = ("== Head ==\n'''Bold''' words stand here in line.<ref name=a>gone</ref> Short one.\n"
           "{{Box|{{inner|x}}|y}}One two three [[File:a.jpg|b]]four five six! One two three four five six")
    df = spark.createDataFrame([(raw,)], "t string")
    assert sorted(df.select(wt.fragments(F.col("t"))).first()[0]) == ["Bold words stand here in line", "One two three four five six"]
    linked = spark.createDataFrame([("a b c d [[Target|shown text]] e.",)], "t string")
    assert linked.select(wt.fragments(F.col("t"), keep_link_text=True)).first()[0] == ["a b c d shown text e"]


def test_nested_templates_and_counts(spark):
    raw = ("{{Infobox place\n|name=[[A|B]]\n|pop={{convert|5|km|abbr={{on|{{x}}}}}}\n|empty=\n|name=Last}}"
           "<ref name=x/><ref>{{cite journal|title=T {{!}} U|volume=2|editor-last=Ed|editor-first=W|others=Zed|pages=3-4}}</ref>"
           "{{Citation|author=Solo Name|chapter=Ch|title=Book|date=May 1999}}{{harvc|c=x}}")
    df = spark.createDataFrame([(1, raw)], "k int, t string")
    r = df.select(wt.infobox(F.col("t")).alias("b"), wt.count_refs(F.col("t")).alias("s"), wt.count_refs(F.col("t"), strict=False).alias("c"),
                  wt.count_citations(F.col("t")).alias("n")).first()
    assert r.b["name"] == "Last" and r.b["empty"] is None and (r.s, r.c, r.n) == (2, 3, 1)
    refs = {x.template_name: x for x in wt.reference_table(df, "k", "t").collect()}
    j = refs["cite journal"]
    assert (j.itemType, j.title, j.pages) == ("journalArticle", "T | U", "3-4")
    assert [(c.creatorType, c.lastName) for c in j.creators] == [("editor", "Ed"), ("contributor", "Zed")]
    c = refs["citation"]
    assert (c.itemType, c.title, c.bookTitle, c.year, c.first_author) == ("bookSection", "Ch", "Book", "1999", "Solo Name")
    assert refs["harvc"].itemType == "bookSection"


def test_any_depth_and_any_number_of_authors(spark):
    deep = "{{a|" * 12 + "x" + "}}" * 12
    people = "".join(f"|last{i}=L{i}|first{i}=F{i}" for i in range(1, 15))
    raw = f"see {{{{cite book|title=T {deep} end{people}|note=[[a|b]]}}}} {{{{Infobox x\n|v={deep}\n|n={{{{nowrap|{{{{flag|Peru}}}}}}}}}}}} {{{{ open"
    df = spark.createDataFrame([(1, raw), (2, None)], "k int, t string")
    row = wt.reference_table(df, "k", "t").collect()
    assert len(row) == 1 and row[0].title == "T x end"
    assert [c.lastName for c in row[0].creators] == [f"L{i}" for i in range(1, 15)]
    boxes = {r.k: r.b for r in df.select("k", wt.infobox(F.col("t")).alias("b")).collect()}
    assert boxes == {1: {"v": None, "n": "Peru"}, 2: None}
    plain = df.where("k = 1").select(wt.without_templates(F.col("t")).alias("p")).first().p
    assert plain == "see   {{ open"


def test_localized_names(spark):
    raw = "{{Ouvrage|titre=Le Livre|nom=Dupont|prénom=Luc|année=1987|éditeur=Maison|lieu=Paris}}{{Cita publicación|título=Uno|publicación=Rev|páginas=1–2}}"
    rows = wt.reference_table(spark.createDataFrame([(1, raw)], "k int, t string"), "k", "t", localized=True).collect()
    by = {r.title: r for r in rows}
    assert (by["Le Livre"].itemType, by["Le Livre"].year, by["Le Livre"].place, by["Le Livre"].first_author) == ("book", "1987", "Paris", "Dupont, Luc")
    assert (by["Uno"].itemType, by["Uno"].publicationTitle, by["Uno"].pages) == ("journalArticle", "Rev", "1–2")


def test_census_years(spark):
    raw = "the 2012 national census, Censo de 2001; CPV 1992 and census of 1976, |population_as_of = 2012, in 1800"
    assert spark.createDataFrame([(raw,)], "t string").select(wt.census_years(F.col("t"))).first()[0] == ["1976", "1992", "2001", "2012"]


def test_layout_lines_and_headings(spark):
    lines = [(1, "010101 CHUQUISACA. Cp. Sucre 1,5 2,0 Quechua"), (2, "010201 Oropeza 1ª s. Yotala 3,25 4,0 Quechua some note"),
             (3, "010202 2ª s. Poroma 5,0 6,5 50% odd"), (4, "020101 LA PAZ. Capital La Paz 7,0 8,0"), (5, "020201 3ª s. Place 9,0 1,0")]
    df = layout_text.parse_lines(spark.createDataFrame(lines, "n int, value string"), "value", 2)
    rows = {r.n: r for r in layout_text.fill_headings(df, "n").collect()}
    assert [(rows[i].department, rows[i].province, rows[i].section, rows[i].place) for i in range(1, 6)] == [
        ("CHUQUISACA", None, "Cp", "Sucre"), ("CHUQUISACA", "Oropeza", "1", "Yotala"), ("CHUQUISACA", "Oropeza", "2", "Poroma"),
        ("LA PAZ", None, "Cp", "La Paz"), ("LA PAZ", None, "3", "Place")]
    assert (rows[2].n1, rows[2].group_name, rows[2].remark) == (3.25, "Quechua", "some note")
    assert (rows[3].group_name, rows[3].remark) == (None, "50% odd")


def test_links_and_cells(spark):
    html = """<table><tr><th>H[1]</th></tr><tr><td><a href="/wiki/A_b">A
      b</a></td></tr></table><a class=x href='u'>two</a>"""
    df = spark.createDataFrame([(1, html)], "k int, h string")
    assert [tuple(r)[1:] for r in markup.links(df, "k", "h").collect()] == [(0, "/wiki/A_b", "A b"), (1, "u", "two")]
    assert sorted((r.row_no, r.cell) for r in markup.cells(df, "k", "h").collect()) == [(0, "H"), (1, "A b")]


def test_overlay_statuses(spark):
    refs = spark.createDataFrame([(1, "d1", None, "t1"), (2, None, "i2", "t2"), (3, "dx", None, "t3"), (4, "d4", None, "t4")],
                                 "r int, doi string, isbn string, title string")
    extra = spark.createDataFrame([("d1", "New"), ("i2", "Two"), ("d4", "  ")], "key string, title string")
    out = overlay_metadata(refs, "r", {"doi": F.col("doi"), "isbn": F.col("isbn")}, extra, "key", ["title"])
    assert {r.r: (r.title, r.enrich_status) for r in out.collect()} == {
        1: ("New", "doi"), 2: ("Two", "isbn"), 3: ("t3", "skipped"), 4: ("t4", "failed")}


@pytest.mark.parametrize("value,want", [("{{lang|fr|Bon}}", "Bon"), ("{{nowrap|x y}}", "x y"), ("''it''", "it"), ("[[A|b]] [[C]]", "b C"), ("  ", None)])
def test_clean_wiki(spark, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(wt.clean_wiki(F.col("t"))).first()[0] == want


def test_latin_folding(spark):
    from tallystone.functions import text

    pairs = [("Škoda", "Skoda"), ("Łódź", "Lodz"), ("Ğ", "G"), ("ő", "o"), ("Þór", "THor"), ("e\u0301te\u0301", "ete"), ("Ŵǆ", "wdz"), ("ẞ", "ss")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(text.equivalent(F.col("a"), F.col("b")).alias("same")).collect()
    assert all(r.same for r in rows)
    kept = spark.createDataFrame([("Ёй か",)], "a string").select(text.fold_accents(F.col("a")).alias("x")).first().x
    assert kept == "Ёй か"


def test_padding_never_cuts(spark):
    from tallystone.functions.text import pad_zeros

    rows = spark.createDataFrame([("7",), ("12345-6789",), (None,)], "z string").select(pad_zeros(F.col("z"), 5).alias("z")).collect()
    assert [r.z for r in rows] == ["00007", "12345-6789", None]


def test_long_texts_are_split_once(spark):
    import time

    from tallystone.operators import reuse

    took = []
    for n in (4_000, 16_000):
        long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "k int, t string")
        start = time.perf_counter()
        assert reuse.reused_spans(long, "k", "t", long, "t").collect()[0].n_words == n
        took.append(time.perf_counter() - start)
    assert took[1] < 12
