"""Language identification, main text of pages, and the SentencePiece codec."""

import zlib

import duckdb
import numpy as np
import sentencepiece
from helpers import SMALL, documents, rows

from octofold.llm import html_text, language_id, spm_codec


def test_automaton_knows_exactly_the_substrings():
    rng = np.random.RandomState(0)
    for _ in range(30):
        s = rng.randint(0, 3, 30).tolist()
        moves = language_id.SuffixAutomaton(s).next
        have = {tuple(s[i:j]) for i in range(30) for j in range(i + 1, 31)}
        for _ in range(50):
            q = tuple(rng.randint(0, 3, rng.randint(1, 8)).tolist())
            at = 0
            for c in q:
                at = moves[at].get(c) if at is not None else None
            assert (at is not None) == (q in have)


def test_phrases_equal_greedy_parsing():
    ref = "the cat sat on the mat and the dog ran"
    m = language_id.Model({"x": [ref], "y": ["zzz qqq"]})
    for text in ("the cat ran", "dog and cat", "zebra!", "a" * 1000):
        symbols = m.symbol[language_id.code_units(text)].tolist()
        whole = m.symbol[language_id.code_units(ref)].tolist()
        have = {tuple(whole[i:j]) for i in range(len(whole)) for j in range(i + 1, len(whole) + 1)}
        n, i = 0, 0
        while i < len(symbols):
            stop = (i // language_id.WINDOW + 1) * language_id.WINDOW
            j = i + 1
            while j < min(stop, len(symbols)) and tuple(symbols[i : j + 1]) in have:
                j += 1
            n, i = n + 1, j
        assert m.phrases([text])[0, 0] == n


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    got = rows(language_id.predict(docs.select("doc_id", "text"), model))
    truth = rows(docs.select("doc_id", "lang"))
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == truth[i].lang for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    en, fr = "the quick brown fox and the lazy dog of this house " * 5, "le renard brun et la maison de cette rue avec une porte " * 5
    texts = [en, fr] * 6 + [None, "", "123 !!", "𝔘" * 5, en * 400]
    langs = ["en", "fr"] * 6 + [None] * 5
    docs = documents(spark, texts, [*range(1, 17), None], langs).withColumn("score", language_id.F.lit("mine"))
    model = language_id.learn(docs)
    got = language_id.predict(docs.drop("score"), model).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == "en" and by[2].lang_pred == "fr" and by[None].lang_pred == "en"
    assert [by[i].lang_pred for i in (13, 14, 15)] == ["und"] * 3
    kept = language_id.known_language(docs, model)
    assert kept.columns == docs.columns and kept.count() == 14
    assert language_id.predict(docs.drop("score"), language_id.Model({})).where("lang_pred <> 'und'").count() == 0
    assert language_id.learn(docs.limit(0)).languages == []


W = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore. "
PLAIN = f"""<html><body class="has-sidebar"><header><h1>Site</h1><a href=x>Home</a></header><div class=cookie-notice><p>{W}</p></div>
<div id="wrap"><div class="sidebar"><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div id="content"><h2>Title &amp; more</h2><p>{W}<p>{W * 2}<script>x="</p>"</script><div class="ad"><p>{W}</p></div><ul><li>one  thing<li>two&nbsp;things</ul></div>
<section class="comments"><h3>Comments</h3><p>{W}</p><p>{W * 3}</p></section></div><form><p>{W}</p></form><footer><p>(c) {W}</p></footer></body></html>"""


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    model = html_text.learn(pages)
    assert model.text(PLAIN).split("\n") == ["Title & more", W.strip(), (W * 2).strip(), "one thing", "two things"]
    found = rows(html_text.extract(pages, model), "page_id")
    for i, page in duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall():
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = [" ".join(html_text.entities.unescape(html_text.re.sub(r"<[^>]*>", " ", b) if "<br>" in b else html_text.re.sub(r"<[^>]*>", "", b)).split()) for b in html_text.re.split(r"</?(?:p|h1)>", body)]
        assert found[i].text == "\n".join(b for b in blocks if b) and found[i].n_chars == len(found[i].text)


def test_odd_pages(spark):
    model = html_text.TreeModel({})
    deep = "<div>" * 3000 + f"<p>{W * 3}</p>"
    sources = [None, "", "no tags", "<", "<p", "<!-- open", "<script>never closed", f"<article><p>{W}", deep, "</p></div>" * 50, f"<article>{W}<article>", '<a href="x>y">' + W]
    df = spark.createDataFrame([(i, None if i % 2 else "u", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    got = rows(html_text.extract(df, model), "page_id")
    assert got[0].text == "" and got[1].text == "" and got[7].text == W.strip() and len(got) == len(sources)
    assert html_text.learn(df.limit(0)).text(PLAIN) != "" and html_text.extract(df.limit(0), model).count() == 0


def brute_marginals(model, page):
    from itertools import product

    n = len(page.tag)
    total, on = 0.0, [0.0] * n
    own = [model.own(page, i) for i in range(n)]
    for labels in product(html_text.LABELS, repeat=n):
        p = html_text.ROOT[labels[0]] * own[0][labels[0]]
        for i in range(1, n):
            p *= own[i][labels[i]] * model.edge[html_text.group(page.tag[i])][labels[page.parent[i]]][labels[i]]
        total += p
        for i in range(n):
            on[i] += p * (labels[i] == html_text.CONTENT)
    return [x / total for x in on]


def test_messages_give_exact_marginals(spark):
    page = html_text.Page(f"<body><div class=menu>a</div><div><p>{W}</p><ul><li>c<li>d</ul></div><span id=x>e</span></body>")
    for model in (html_text.TreeModel({}), html_text.learn(spark.read.parquet(f"{SMALL}/pages.parquet"))):
        assert np.allclose(model.marginals(page), brute_marginals(model, page))


def test_codec_equals_the_library(spark):
    path = spm_codec.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  a  b ", "▁x ▁", "日本語 é\n\n\tx", "²² ²., m².", "😀" * 70, "a" * 5000, "word, word. (x) 'tis don't", "-" * 300 + "é" * 300]
    texts = odd + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()]
    got = rows(spm_codec.encode_texts(documents(spark, texts), path))
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t) and got[i].n_ids == len(got[i].ids)
        assert got[i].lossless == ("▁" not in t)
    none = rows(spm_codec.encode_texts(documents(spark, [None]), path))[0]
    assert none.n_ids == 0 and none.lossless
    back = rows(spm_codec.decode_ids(spark.createDataFrame([(i, list(got[i].ids)) for i in range(len(odd))] + [(99, None)], "doc_id long, ids array<int>"), path))
    assert all(back[i].text == t.replace("▁", " ") for i, t in enumerate(odd)) and back[99].text == ""


def test_streamed_chunks_equal_the_whole():
    own = spm_codec.codec(spm_codec.model_path())
    rng = np.random.RandomState(1)
    text = "".join(rng.choice(list("aeinrstlé日,.0123"), 4000))
    whole = [i for part in own.stream([text]) for i in part]
    cut = [text[i : i + 37] for i in range(0, len(text), 37)]
    parts = list(own.stream(cut))
    assert [i for p in parts for i in p] == whole and len(parts) > 10
