"""Toxicity, language, pages, pieces and neighbours."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from railweave.llm.language import CLASSES, ORDER, language_query, table
from railweave.llm.neighbours import nearest
from railweave.llm.page_text import main_text, page_texts
from railweave.llm.pieces import MODEL, Pieces, decode_ids, encode_texts
from railweave.llm.toxicity import FACTORS, SLOTS, Machine, _terms, fit, toxicity_query


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(60)]
        # Toxic is the pair: an insult beside a mention.
        insult, mention = rng.random() < 0.5, rng.random() < 0.5
        w[3:3] = ["insult"] * insult + ["mention"] * mention
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(insult and mention)))
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x")], "doc_id long, text string, score string")
    labs = spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_query(docs, labs).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(held) > 250 and sum(p == y for p, y in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score
    none = toxicity_query(docs, labs.limit(0)).collect()
    assert {r.predicted for r in none} == {0}


def test_machine_learns_pairs_whose_members_say_nothing():
    """Toxic is one of two words without the other: neither word alone shifts the odds."""
    rng = np.random.default_rng(3)
    n, noise = 4000, 200
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    texts_ = [[*(["insult"] * int(x)), *(["mention"] * int(y)), *(f"w{k}" for k in rng.choice(noise, 12))] for x, y in zip(a, b, strict=True)]
    doc, slot = _terms(pa.array([" ".join(t) for t in texts_]))
    label = (a == b).astype(float)
    machine = fit(doc[doc < 3000], slot[doc < 3000], label[:3000], rounds=30)
    p = machine.scores(doc[doc >= 3000] - 3000, slot[doc >= 3000], 1000)
    assert ((p >= 0.5) == (label[3000:] > 0)).mean() > 0.97


def test_machine_scores_by_its_formula():
    rng = np.random.default_rng(7)
    feature = np.full(SLOTS, -1, dtype=np.int32)
    feature[:5] = np.arange(5)
    machine = Machine(feature, 0.3, rng.normal(size=5), rng.normal(size=(5, FACTORS)))
    texts_ = [[0, 1, 4], [2, 9], [], [0, 1, 2, 3, 4]]
    got = machine.scores(np.repeat(np.arange(4), [len(t) for t in texts_]), np.array([x for t in texts_ for x in t]), 4)
    for t, p in zip(texts_, got, strict=True):
        t = [x for x in t if x < 5]
        y = 0.3 + sum(machine.w[i] for i in t) + sum(machine.v[i] @ machine.v[j] for k, i in enumerate(t) for j in t[k + 1 :])
        assert p == pytest.approx(1 / (1 + math.exp(-y)))


def test_language_tables_are_probabilities():
    p = np.exp2(-table([b"abra cadabra", "größe ça".encode()])).reshape(CLASSES**ORDER, CLASSES)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": "the of and thing with".split(), "bb": "der die und auf nicht".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i, k in ((i, "aa" if i % 2 else "bb") for i in range(200))]
    rows += [(900, None, "aa"), (901, "123 ... !", None), (902, "", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_query(df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:200])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert {r.lang_pred for r in language_query(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_learns_every_value(spark):
    # 70 languages, the last ones the rarest: each writes its own two letters.
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = [letters[i] + letters[j] for i in range(26) for j in range(i)][:70]
    rows = [(i * 1000 + k, (pairs[i] + " ") * 20 + pairs[i][::-1], f"l{i:02}") for i in range(70) for k in range(6 if i < 64 else 5)]
    got = {r.doc_id: r for r in language_query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 line&nbsp;here<br>still &#233;<p>Second<div class=ad>Buy</div><ul><li>one<li>two</ul><form><input><label>Mail</label></form><table><tr><td>x<td>y</table></article>
<aside>Related</aside><section id="comments"><article class="comment">Nice</article></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\nFirst bold line here still é\nSecond\none\ntwo\nx\ny"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    long = "<p>" + "word " * 50 + "</p>"
    assert main_text(f"<div class=menu>m</div><div>{long}{long}</div><ul><li><a href=x>link</a></li><li><a href=y>link</a></li></ul>").count("word") == 100
    assert main_text("<article><p>cut <b>off") == "cut off"


def test_main_text_with_ordinary_names():
    long = "word " * 50
    page = f'<div id="page" class="wrapper"><h2 class="title">Head</h2><main id="main" class="site-main"><article id="post-1" class="post entry"><h1 id="top" class="entry-title">Title</h1><div class="content"><p class="lead">{long}</div></article></main></div>'
    assert main_text(page).endswith("Title\n" + long.strip())
    assert main_text(f'<div id="page"><div class="content"><p class="x">{long}</div></div>') == long.strip()


def test_ratios_select_beside_articles():
    long = "word " * 60
    teasers = "".join(f"<article><h3><a href=/{i}>More {i}</a></h3><p>Read on</p></article>" for i in range(3))
    found = main_text(f"<div><p>{long}</p><p>{long}</p><p>{long}</p></div><ul><li><a href=a>a</a><li><a href=b>b</a></ul><div>{teasers}</div>")
    assert found.count("word") == 180
    assert main_text(f"<div><p>{long}</p><p>{long}</p></div><nav>n</nav><p><a href=x>x</a></p><p><a href=x>x</a></p><p><a href=x>x</a></p><p><a href=x>x</a></p><div>{teasers}</div>").count("Read on") == 0
    links = "<p><a href=x>x</a></p>" * 9
    assert main_text(f"<div><article><p>{long}</p></article>{links}<article><p>Yes.</p></article></div>") == long.strip() + "\nYes."


def test_furniture_names_drop_no_main_text():
    long = "word " * 60
    want = long.strip()
    for name in ("has-sidebar", "no-sidebar", "content-with-sidebar", "overflow-hidden", "page-with-nav", "sidebar-right", "search"):
        assert main_text(f'<div class="{name}"><article><p>{long}</p></article></div>') == want
        assert main_text(f'<div id="{name}"><div class="menu">m</div><p>{long}</p></div><p><a href=x>x</a></p>') == want
    for name in ("id=discussion", "class=discussion", "class=copyright-law", 'class="search-results"', "id=cookies"):
        assert main_text(f"<article><p>{long}</p><section {name}><p>kept</p></section></article>") == want + "\nkept"
    for name in ("ad", "ad-slot-2", "x sidebar", "site-footer", "related-posts", "share_buttons", "comments", "cookie-notice", "hidden"):
        assert main_text(f'<article><p>{long}</p><div class="{name}"><p>{long} gone</p></div></article>') == want
        assert main_text(f'<div class="{name}"><p>{long} {long} gone</p></div><article><p>{long}</p></article>') == want
    assert main_text(f'<p>{long}<span class="ad">gone</span> end</p>') == long + "end"
    assert main_text(f'<main class="search"><p>{long}</p></main>') == want


def test_page_texts(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in page_texts(rows).collect()}
    assert got[1].n_chars == len(main_text(PAGE)) and got[2].text == ""


TEXTS = ["", " ", "   a  b", "Hello world\nfoo\tbar ", "x\r\n\t {\r", "日本語テキスト", "é€😀 ﬁ ½ ０", "a" * 300, "\x00\x01", " " * 40 + "q", "int main() {\r\n  return;\r\n}", "Straße übergröße l'été"]


def test_pieces_equal_the_library():
    pieces, lib = Pieces.read(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("the quick brown tion ing aeiou ,.!\n") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    for t in texts:
        ids = np.frombuffer(pieces.encode(t), dtype=np.int32).tolist()
        assert ids == lib.encode(t)
        assert pieces.decode(ids) == t


def test_unigram_pieces_maximise_the_score():
    p = Pieces(["<unk>", "a", "b", "ab", "abc", "c", "▁"], [0, -2.0, -2.0, -1.5, -9.0, -1.0, -1.0], ["unknown"] + ["piece"] * 6, False, True)
    assert p.fold("abc") == ["ab", "c"]


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    out = encode_texts(df, check=True)
    assert out.filter("round_trip").count() == len(TEXTS) + 1
    back = {r.doc_id: r.text for r in decode_ids(out).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [math.nan] + [1.0] * 15), (1060, [1.0]), (1061, [None] + [1.0] * 15)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    y = x.astype(np.float64)
    assert sorted(by) == list(range(0, 700, 20))
    for q, found in by.items():
        s = y @ y[q]
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == want
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-9) for r in found)


def test_nearest_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_by_length_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1, 2, 3), (0, [1.0, 0.0], 1, 2, 3), (1, [2.0, 1.0], 1, 2, 3), (1, [3.0, 1.0], 1, 2, 3), (2, [1.0], 1, 2, 3), (20, [4.0], 1, 2, 3), (None, [9.0], 1, 2, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d int, stripe int, rows int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 2.0), (20, 1, 2, 4.0)]
