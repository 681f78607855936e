"""Encoders, classifier, pages, chats and vectors."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import embedding_dedup as ED
from ledgerloom.llm.chat_format import format_chats, schema_problems
from ledgerloom.llm.components import components, forest
from ledgerloom.llm.dom import Skeleton, match_trees, parse
from ledgerloom.llm.html_extraction import Page, chosen_blocks, extract_pages, host_of
from ledgerloom.llm.quality_classifier import keep_quality, quality_classifier
from ledgerloom.llm.sentencepiece_model import PieceModel, decode_pieces, encode_pieces
from ledgerloom.llm.token_file import ChunkEncoder, Segment, pack_segment, read_tokens, tokens_at, write_tokens
from ledgerloom.llm.words import Numbers

tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  two  spaces ", "tail ", "línea\nnueva\n\n x", "日本語 😀 текст", "a b　c", "don't  STOP!! #1\r\n", "x" * 500, "<|endoftext|> kept", "tab\tand\x0bfeed\x0c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "z") for i, t in enumerate(ODD * 3)] + [(None, None, 1, "z"), (2, "again", 1, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids int, start string")


def test_pieces_equal_the_reference_encoder():
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model, library = PieceModel.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    whole = PieceModel.load(path)
    whole.cuts = None  # the whole text as one lattice, no memo
    for t in [*ODD, "▁ a▁b", "▁", "word.Next,too;x!y?z:w 'q'. ...", "日本" * 400 + " x", "ab " * 9]:
        want = library.encode(t)
        assert np.frombuffer(model.encode(t), "<i4").tolist() == np.frombuffer(whole.encode(t), "<i4").tolist() == want
        assert model.decode(want) == library.decode(want) and ("▁" in t or model.decode(want) == t)


def model_file(pieces, kind):
    """A model file made by hand: unigram (1) or BPE (2)."""
    var = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + var(n >> 7)
    field = lambda number, data: var(number << 3 | 2) + var(len(data)) + data
    out = b""
    for text, score, piece_kind in pieces:
        out += field(1, field(1, text.encode()) + var(2 << 3 | 5) + np.float32(score).tobytes() + var(3 << 3) + var(piece_kind))
    return out + field(2, var(3 << 3) + var(kind)) + field(3, field(1, b"identity") + var(3 << 3) + var(0) + var(4 << 3) + var(0))


def test_unigram_paths_are_the_best_and_leave_early():
    draw = np.random.default_rng(2)
    pieces = [("<unk>", 0.0, 2)] + [(p, float(-draw.integers(1, 9)), 1) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa"]]
    model = PieceModel(model_file(pieces, 1))
    scores = {p: s for p, s, _ in pieces}
    for _ in range(30):
        text = "".join(draw.choice(list("abcz"), 40, p=[0.32, 0.32, 0.32, 0.04]))
        best = [0.0] + [-1e9] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 3), end):
                best[end] = max(best[end], best[start] + (scores[text[start:end]] if text[start:end] in scores else -10.0 if end - start == 1 else -1e9))
        parts = list(model.stream(text))
        ids = [i for p in parts for i in p]
        assert sum(scores[pieces[i][0]] if i else -10.0 for i in ids) == pytest.approx(best[-1])
        assert len(parts) > 1
    with pytest.raises(ValueError):
        PieceModel(model_file(pieces, 4))


def test_lattices_equal_the_stream(monkeypatch):
    """Texts that advance together get the ids that each gets alone, for both kinds of model, as do parts of a long text."""
    draw = np.random.default_rng(9)
    pieces = [("<unk>", 0.0, 2)] + [(p, float(-draw.integers(1, 9)), 1) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa", "▁", "▁a"]]
    texts = ["".join(draw.choice(list("abc▁z"), int(draw.integers(0, 60)), p=[0.3, 0.3, 0.29, 0.1, 0.01])) for _ in range(200)]
    for model in (PieceModel(model_file(pieces, 1)), PieceModel(model_file(pieces, 2)), PieceModel.load(tokenizers.path("piece_bpe_32k.model"))):
        got = model.lattices.encode(texts)
        assert [g is None for g in got] == [any(c not in model.ids for c in t) for t in texts]
        assert all(g is None or g == model.stream_ids(t) for g, t in zip(got, texts, strict=True))
    monkeypatch.setattr("ledgerloom.llm.sentencepiece_model.TOGETHER", 50)
    monkeypatch.setattr("ledgerloom.llm.sentencepiece_model.MEMO", 20)
    small, long = PieceModel.load(tokenizers.path("piece_bpe_32k.model")), "some words that come, and go. " * 30
    assert list(small.encode_all([long, "x", "", long])) == [model.stream_ids(model.marked(t)) for t in (long, "x", "", long)]


def test_pieces_stay_apart_as_the_merges_say():
    model = PieceModel.load(tokenizers.path("piece_bpe_32k.model"))

    def merged(text):
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = model.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or model.scores[k] > best):
                    best, at = model.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    draw, some = np.random.default_rng(3), [i for p, i in model.ids.items() if len(p) > 1 and p.isascii()]
    for a, b in draw.choice(some, (1500, 2)).tolist():
        assert model.apart(a, b) == (merged(model.pieces[a] + model.pieces[b]) == [model.pieces[a], model.pieces[b]])
        assert model.apart(-1, b) == (merged(model.pieces[b]) == [model.pieces[b]])


def test_numbers_are_found_again():
    draw, table, seen = np.random.default_rng(8), Numbers(16), {}
    for n in (3, 40, 5000):
        new = np.setdiff1d(draw.integers(0, 1 << 62, n), list(seen))
        table.put(new, np.arange(len(seen), len(seen) + len(new)))
        seen |= dict(zip(new.tolist(), range(len(seen), len(seen) + len(new)), strict=True))
        asked = np.concatenate((np.array(list(seen)), draw.integers(0, 1 << 62, 100)))
        assert table.get(asked).tolist() == [seen.get(k, -1) for k in asked.tolist()]


def test_chunked_ids_equal_the_library(monkeypatch):
    import random

    from ledgerloom.llm import token_file as TF

    monkeypatch.setattr(TF, "MEMO", 300)
    monkeypatch.setattr(TF, "CHUNK_BYTES", 40)
    encoder, draw = ChunkEncoder(tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    some = [" ", " ", "\n", "a", "B", "'s", "é", "1", ".", ",", "!", "'", "日", "\u0301", "ll", "?", "(", "×", "–", "don't", "İ", " the", "naïve", "ß", "\xa0", "  "]
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + ["plain words, many of them. " * 20 + "end"]
    assert sum(map(encoder.by_chunks, texts)) > 500
    for k in range(0, len(texts), 200):
        assert encoder.encode(texts[k : k + 200]) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[k : k + 200]]


def test_any_token_of_the_corpus_is_read_in_place(spark, docs, monkeypatch):
    from ledgerloom.llm import token_file as TF

    monkeypatch.setattr(TF, "SEGMENT_TOKENS", 50)
    path = tokenizers.path("byte_bpe_50k.json")
    segments = write_tokens(docs, path)
    library = ChunkEncoder(path).tokenizer
    rows = {(r["start"], r["n_tokens"]): r for r in read_tokens(segments).collect()}
    all_ids = np.concatenate([Segment(r["segment"]).ids() for r in sorted(segments.collect(), key=lambda r: (r["part"], r["sequence"]))]).tolist()
    assert all((r["first_id"], r["last_id"]) == (all_ids[at], 0) for (at, n), r in rows.items()) and segments.count() > 5
    assert sorted(all_ids) == sorted(i for r in docs.collect() for i in [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    places = spark.createDataFrame([(p,) for p in [*range(len(all_ids)), 3, -1, len(all_ids), None]], "place bigint")
    got = tokens_at(segments, places).collect()
    assert [r["token"] for r in sorted(got)] == all_ids


def test_piece_round_trip(docs):
    path = tokenizers.path("piece_bpe_32k.model")
    back = decode_pieces(encode_pieces(docs, path), path).collect()
    want = sorted([(r["doc_id"], r["text"] or "") for r in docs.collect()], key=str)
    assert sorted([(r["doc_id"], r["text"]) for r in back], key=str) == want
    assert encode_pieces(docs.where("doc_id < 0"), path).count() == 0


def test_segments_give_any_token():
    draw = np.random.default_rng(4)
    ids = np.concatenate((draw.integers(0, 1 << 20, 3000), draw.integers(0, 200, 3000))).astype(np.uint32)
    segment = Segment(pack_segment(ids, [5, None], np.array([0, 10, 6000])))
    assert segment.ids().tolist() == ids.tolist() and segment.doc_ids == [5, None]
    assert [segment.token(i) for i in range(len(ids))] == ids.tolist()
    with pytest.raises(ValueError):
        Segment(b"nope" + bytes(40))
    assert Segment(pack_segment(np.empty(0, np.uint32), [], np.array([0]))).ids().tolist() == []


def test_token_file_round_trip(docs):
    path = tokenizers.path("byte_bpe_50k.json")
    library = ChunkEncoder(path).tokenizer
    got = read_tokens(write_tokens(docs, path)).orderBy("start").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    digest = lambda t: (len(ids := [*library.encode(t or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted([(r["id"], r["n_tokens"], r["ids_crc32"]) for r in got], key=str) == sorted([(r["doc_id"], *digest(r["text"])) for r in docs.collect()], key=str)
    assert [r["id"] for r in got][0] is None and [r["id"] for r in got][1:] == sorted(r["id"] for r in got[1:])
    assert read_tokens(write_tokens(docs.where("doc_id < 0"), path)).count() == 0


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    sorted_scores = scores[order]
    first, last = np.searchsorted(sorted_scores, scores, "left"), np.searchsorted(sorted_scores, scores, "right")
    ranks = (first + last + 1) / 2
    n = truth.sum()
    return (ranks[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_held_out_rows_are_told_apart_and_scores_are_calibrated(spark):
    """The query's own scores on rows whose labels it never saw."""
    import pathlib

    from ledgerloom.llm.queries import op10_quality_classifier

    folder = "/root/testdata/sf0.1"
    if not pathlib.Path(folder).is_dir():
        pytest.skip("no test tables here")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op10_quality_classifier(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, truth = np.array([r["score"] for r in known]), np.array([labels[r["doc_id"]] for r in known])
    tenth = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(score[tenth == k].mean() - truth[tenth == k].mean()) * (tenth == k).mean() for k in np.unique(tenth))
    print(f"held out {len(known)}: AUC {auc(score, truth):.5f}, accuracy {((score >= 0.5) == truth).mean():.4f}, calibration error {error:.4f}")
    assert auc(score, truth) >= 0.995 and ((score >= 0.5) == truth).mean() >= 0.98 and error <= 0.03


def test_equal_texts_have_equal_scores(spark):
    rows = [(i % 7, "the same words again" if i % 2 else f"other words {i}", "x") for i in range(40)] + [(None, "the same words again", "x"), (50, "long " * 50000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 2, "doc_id bigint, quality int")
    got = quality_classifier(docs, labels).collect()
    assert len(got) == 42 and len({r["score"] for r in got if r["doc_id"] is None}) == 1
    assert len({r["score"] for r, (i, t, _) in zip(quality_classifier(docs.coalesce(1), labels).collect(), rows, strict=True) if t == "the same words again"}) == 1


def test_classifier_learns(spark):
    draw = np.random.default_rng(5)
    good = lambda: " ".join(f"word{draw.integers(80)}" for _ in range(60)) + "."
    bad = lambda: " ".join(f"WORD{draw.integers(80)}!!" for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "x") for i in range(300)] + [(1000, None, "x"), (1001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(200, 300))
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id BETWEEN 200 AND 299").count() == sum(i % 3 > 0 for i in range(200, 300))
    none = quality_classifier(docs, labels.where("quality = 1"))
    assert {r["score"] for r in none.collect()} == {1.0}
    assert quality_classifier(docs.where("doc_id < 0"), labels).count() == 0


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="page"><article><header><h2>Head &amp; line</h2><span>by us</span></header><p>One <b>two
three<p>Four&nbsp;five<div class="share-buttons">Tweet</div><ul><li>six<li>seven</ul><!-- hid > den --><form>Subscribe</form>%s</article>
<aside>More</aside></div><div class="comments"><p>Nice!</p></div><footer>&copy; us</footer></body></html>"""


def alone(html):
    """What is left of a page without a wrapper."""
    return chosen_blocks([(text, -1, -1, in_main, told, headline) for _, text, in_main, told, _, headline in Page(html).blocks], set(), set(), -1)


def test_main_text_of_a_page():
    assert alone(PAGE % "<p>eight") == ["Head & line", "One two three", "Four five", "six", "seven", "eight"]
    assert alone("plain <b>text</b> &lt;here&gt; <") == ["plain text <here> <"]
    assert alone("") == alone("<script>x") == []
    assert alone("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    assert alone("<p title=don't>it's</p><p title=\"a>b\">so</p> <a b=\"c>end") == ["it's", "so", "end"]
    assert alone("a<div>b<span class=ad>c</span>d</div>e<!-- f") == ["a", "b", "d", "e"]


def test_long_pages_take_seconds():
    import random
    import time

    draw, began = random.Random(1), time.time()
    for html in ('<a "x ' * 32_000, '<a b="x ' * 32_001, "<a b='x>" * 32_000, "</a " * 50_000, "<!-- " * 20_000, "<p>" + "<i>x</i>" * 40_000):
        Page(html)
    for n in (1000, 40_000):
        labels = [[1] + [draw.randrange(5) for _ in range(n)] + [9] * n for _ in range(2)]
        a, b = (Skeleton.of_rows(x, [0] * len(x), [-1] + [0] * n + [draw.randrange(1, n + 1) for _ in range(n)]) for x in labels)
        got = match_trees(a, b)
        assert len(got) > n / 5 and all(a.labels[i] == b.labels[j] for i, j in got.items())
        rows = sorted((i, j) for i, j in got.items() if 0 < i <= n)
        assert [j for _, j in rows] == sorted(j for _, j in rows)
    assert time.time() - began < 30


def neutral(html):
    """The same page without a telling tag or class."""
    import re

    return re.sub(r' class="[^"]*"', "", re.sub(r"(</?)(nav|article|footer|aside|main|header)\b", r"\1div", html or ""))


def test_slots_alone_find_the_article(spark, sf_dir):
    """Pages whose menus, adverts and footers look like any other part give the same text as when they say what they are."""
    import pathlib

    if not pathlib.Path(sf_dir).is_dir():
        pytest.skip("no test tables here")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url", "html").collect()]
    schema = "page_id bigint, url string, html string"
    told = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, schema)).collect()}
    bare = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame([(i, u, neutral(h)) for i, u, h in rows], schema)).collect()}
    hosts = {}
    for i, u, h in rows:
        hosts.setdefault(host_of(u), set()).add(h)
    wrapped = [i for i, u, _ in rows if len(hosts[host_of(u)]) >= 4]
    same = sum(told[i] == bare[i] for i in wrapped)
    changed = sum(bare[i] != "\n\n".join(alone(neutral(h))) for i, _, h in rows)
    print(f"{same} of {len(wrapped)} pages of hosts with a wrapper have the same text without telling markup; the wrapper changes {changed} of {len(rows)}")
    assert same >= 0.9 * len(wrapped) > 0 and changed > 0.5 * len(rows)


def test_layouts_of_a_host_get_wrappers_of_their_own(spark):
    story = lambda i: f"<p>story {i} of many words that differ {i * 7}</p><p>and it goes on {i * 3} until the end of {i}</p>"
    first = lambda i: f"<body><div><a href=x>menu {i % 3}</a> <a href=y>more {i}</a></div><div>{story(i)}</div><div>Powered by the engine</div></body>"
    second = lambda i: f"<body><table><tr><td><ul><li>offer {i % 5}</li></ul></td></tr><tr><td><section><blockquote>{story(i)}</blockquote></section></td></tr></table><pre>All rights</pre></body>"
    rows = [(i, f"http://a.example/{i}", (first if i % 2 == 0 else second)(i)) for i in range(24)] + [(50, "http://a.example/odd", "<ol><li>a third layout alone</li></ol>")]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"story {i} of many words that differ {i * 7}\n\nand it goes on {i * 3} until the end of {i}" for i in range(24)), got
    assert got[50] == "a third layout alone"


def test_every_layout_of_a_host_gets_a_wrapper(spark):
    """However many there are, and whichever round finds it."""
    page = lambda k, i: f"<body class=b{k}><div class=x{k}>top {k}</div><div class=y{k}><p>story {i} of many words {i * 7}</p><p>and its end {i * 3}</p></div><div class=z{k}>Powered by engine {k}</div></body>"
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i // 2 % (4 + 5 * (i % 2)), i)) for i in range(110)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"story {i} of many words {i * 7}\n\nand its end {i * 3}" for i in range(110)}


def test_simple_tree_matching_is_largest():
    tree = lambda spec: Skeleton.of_rows([s[0] for s in spec], [0] * len(spec), [s[1] for s in spec])
    a = tree([(1, -1), (2, 0), (3, 0), (4, 0), (3, 1)])
    b = tree([(1, -1), (3, 0), (2, 0), (4, 0), (3, 2)])
    got = match_trees(a, b)
    assert len(got) == 4 and got[0] == 0 and all(a.labels[i] == b.labels[j] for i, j in got.items())
    assert match_trees(tree([(1, -1)]), tree([(2, -1)])) == {}
    assert parse("<p>a<p>b").elements()[1].tag == "p"


def test_template_leaves_and_content_stays(spark):
    """A sentence that every page of a host has at one place goes; the same page elsewhere keeps it."""
    page = lambda i: f"<body><div><p>Powered by the same engine</p><p>story {i} of many words {i * 7}</p><p>its end {i * 3}</p></div></body>"
    rows = [(i, f"http://www.a.example/{i}", page(i)) for i in range(12)] + [(20, "http://b.example/", page(1)), (21, None, page(2)), (22, "http://a.example/x", None), (23, "http://a.example/y", "")]
    rows += [(i, "http://c.example/1", page(5)) for i in range(30, 40)]  # copies of one page aren't a template
    pages = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id bigint, url string, html string, node int, host string")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert got[3]["text"] == "story 3 of many words 21\n\nits end 9" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[20]["text"].startswith("Powered") and got[21]["text"].startswith("Powered") and got[35]["text"].startswith("Powered")
    assert got[22]["text"] == got[23]["text"] == "" and len(got) == len(rows)
    assert extract_pages(pages.where("page_id < 0")).count() == 0
    assert host_of("HTTPS://u:p@WWW.X.example:8080/a") == "x.example" and host_of("nothing") is None


def test_template_is_what_pages_agree_on(spark):
    """The least page's own wording at a node doesn't hide the others' notice, and short articles lose a long notice, too."""
    notice = "This long notice stands below each and every article of the host and says nothing at all about it."
    page = lambda i: f"<body><div><p>story {i}</p><p>{'Welcome to the new site' if i == 0 else notice}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(12, "http://a.example/12", f"<body><div><p></p><p>{notice}</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(1, 12)] == [f"story {i}" for i in range(1, 12)]
    assert got[0] == "story 0\n\nWelcome to the new site" and got[12] == notice


def test_tool_calls_are_linked_ordered_and_checked(spark):
    tools = '<tools>[{"name":"get","parameters":{"properties":{"city":{"type":"string"},"days":{"type":"integer"}},"required":["city"]}}]</tools>'
    call = lambda **x: f"<tool_call>{json.dumps(x)}</tool_call>"
    rows = [
        (1, 0, "system", tools), (1, 1, "assistant", "ok " + call(id="a", name="get", arguments={"days": 3, "city": 'X "y"'}) + call(id="b", name="get", arguments={"days": "z", "q": 1})), (1, 2, "user", "wait"),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "rb"})), (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "ra"})), (1, 5, "tool", json.dumps({"tool_call_id": "zz"})), (1, 6, "tool", "junk"),
        (1, 7, "assistant", "<tool_call>oops</tool_call>" + call(id="a", name="get", arguments={"city": "Y"})), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, None, None, None),
    ]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, id string, key int")
    got = format_chats(turns).orderBy("conv_id", "position").collect()
    one = [r for r in got if r["conv_id"] == 1]
    assert [r["turn"] for r in one] == [0, 1, 4, 3, 2, 5, 6, 7] and [r["position"] for r in one] == list(range(1, 9))
    assert (one[1]["n_calls"], one[1]["n_linked"], one[1]["problems"]) == (2, 2, "missing city; type of days; undeclared q")
    assert one[1]["message"].startswith('{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"city":"X \\"y\\"","days":3},"id":"a","name":"get"},')
    assert one[2]["message"] == '{"content":"ra","role":"tool","tool_call_id":"a"}'
    assert [r["problems"] for r in one[5:7]] == ["result without call", "unreadable result"] and "unreadable call" in one[7]["problems"] and "repeated identifier" in one[7]["problems"]
    assert all(json.loads(r["message"]) for r in got) and len(got) == len(rows)
    assert "undeclared tool" not in one[7]["problems"] and one[6]["message"] == '{"content":"junk","role":"tool"}'
    plan = format_chats(turns)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert format_chats(turns.where("turn < 0")).count() == 0


def check(value, schema, name=None):
    """JSON schema by plain recursion."""
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
    kind, own, child = kinds[type(value)], name or "arguments", lambda k: k if name is None else f"{name}.{k}"
    out = [f"type of {own}"] if schema.get("type", kind) not in (kind, "number" if kind == "integer" else kind) else []
    out += [f"value of {own}"] if "enum" in schema and not any(type(e) is type(value) and e == value for e in schema["enum"]) else []
    if kind == "object":
        told = schema.get("properties")
        out += [f"missing {child(k)}" for k in schema.get("required", []) if k not in value]
        out += [f"undeclared {child(k)}" for k in value if told is not None and schema.get("additionalProperties") is not True and k not in told]
        out += [p for k in value if k in (told or {}) for p in check(value[k], told[k], child(k))]
    if kind == "array" and "items" in schema:
        out += [p for i, x in enumerate(value) for p in check(x, schema["items"], f"{own}[{i}]")]
    return sorted(out)


def test_arguments_are_checked_as_their_schema_says(spark):
    import random

    draw = random.Random(4)
    schema = {
        "type": "object", "required": ["a", "z"], "properties": {
            "a": {"type": "integer"}, "b": {"enum": ["x", 2, None, True]}, "c": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "string"}}, "required": ["k"]}},
            "d": {"type": "object", "properties": {"e": {"type": "number"}}, "additionalProperties": True}, "f.g": {"type": "boolean"},
        },
    }
    leaf = lambda: draw.choice([1, 2.5, "x", True, None, "", [], {}, 2, [1], {"k": 3}])
    values = [{k: draw.choice([leaf(), [{"k": leaf()}, leaf()], {"e": leaf(), "x": leaf()}]) for k in draw.sample(["a", "b", "c", "d", "f.g", "q", "z"], draw.randint(0, 6))} for _ in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: sorted(r["p"]) for r in rows.select("i", schema_problems(F.col("v"), F.lit(json.dumps(schema))).alias("p")).collect()}
    assert got == {i: check(v, schema) for i, v in enumerate(values)}
    deep = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "array", "items": {"type": "array", "items": {"type": "string"}}}}}}
    assert spark.range(1).select(schema_problems(F.lit('{"a": [[["x"]]]}'), F.lit(json.dumps(deep)))).first()[0] == ["unchecked a[0][0]"]


def test_messages_without_calls_stay_spread(spark):
    """No null key in a join: each task keeps its share of the messages."""
    turns = spark.range(2000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'hi' AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = format_chats(turns.repartition(4)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == 4 and max(r["count"] for r in rows) < 700
    plan = format_chats(turns)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Union") == 1


def test_the_chat_query_equals_its_sql(spark, sf_dir):
    import os

    import duckdb

    from ledgerloom.llm.queries import ORACLE_SQL, op5_chat_format

    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough conversations for every kind of call
    df = op5_chat_format(spark, sf_dir)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = c.execute(ORACLE_SQL["op5_chat_format"])
    at = [[x[0] for x in found.description].index(name) for name in df.columns]
    want, got = sorted([tuple(r[i] for i in at) for r in found.fetchall()], key=str), sorted(map(tuple, df.collect()), key=str)
    assert got == want
    assert {p for r in got for p in r[6].split("; ")} >= {"", "call without result", "missing city", "type of days", "value of unit", "type of where.lat", "type of tags[0]", "undeclared q", "undeclared tool"}


def brute_vectors(rows, threshold):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            full = np.zeros(8)
            full[: len(v)] = v
            unit[k] = full / np.linalg.norm(full)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((r[0], links[k], least[find(k)]) for k, r in enumerate(rows))


@pytest.mark.parametrize(("blocks", "coarse", "exact", "kind"), [((2048, 8192), 2048, True, "double"), ((7, 5), 2048, True, "float"), ((2048, 8192), 2048, False, "float"), ((7, 5), 4, False, "double")])
def test_vectors_equal_brute_force(spark, monkeypatch, blocks, coarse, exact, kind):
    monkeypatch.setattr(ED, "MEMBER_BLOCK", blocks[0])
    monkeypatch.setattr(ED, "QUERY_BLOCK", blocks[1])
    monkeypatch.setattr(ED, "CELL_SIZE", 12)
    monkeypatch.setattr(ED, "COARSE", coarse)
    draw = np.random.default_rng(6)
    base = draw.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + draw.normal(scale=0.12 * (i % 4), size=8)).tolist(), int(i % 2)) for i in range(120)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(15)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 8, 0), (303, [1.0, float("nan")] + [0.0] * 6, 0), (304, [1.0, None] + [0.0] * 6, 0), (305, base[0].tolist(), None), (306, [float("inf")] + [1.0] * 7, 0), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1), (5, base[7].tolist(), 1), (309, (base[0] * 2).tolist(), 0)]
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    vectors = spark.createDataFrame([(*r, 1.0, "k") for r in rows], f"vec_id bigint, embedding array<{kind}>, label int, vec double, key string")
    got, want = ED.embedding_dedup(vectors, exact=exact).collect(), brute_vectors(rows, 0.93)
    links = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    if exact:
        assert links == want
    else:  # nothing that isn't there, and all but a hundredth of what is
        assert [x[0] for x in links] == [x[0] for x in want] and sum(x[1] for x in links) >= 0.99 * sum(x[1] for x in want)
        assert all(a[1] <= b[1] for a, b in zip(links, want, strict=True) if [x[0] for x in want].count(a[0]) == 1)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert ED.embedding_dedup(vectors.where("vec_id < 0")).count() == 0


def test_the_vector_query_finds_what_brute_force_finds(spark):
    import pathlib

    from ledgerloom.llm.queries import op2_embedding_dedup

    folder = "/root/testdata/check_s"  # its vectors have near copies
    if not pathlib.Path(folder).is_dir():
        pytest.skip("no test tables here")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    got = op2_embedding_dedup(spark, folder).toPandas().set_index("vec_id")["n_links"]
    want, found = 0, int(got.sum())
    for _, some in table.dropna(subset=["label"]).groupby("label"):
        some = some[[v is not None and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v) for v in some["embedding"]]]
        x = np.stack([np.array(v, float) for v in some["embedding"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n = (x @ x.T >= 0.93).sum(axis=1) - 1
        want += int(n.sum())
        assert (got[some["vec_id"]].to_numpy() <= n).all()
    print(f"{found} of {want} link ends found: recall {found / max(want, 1):.5f}")
    assert found >= 0.99 * want > 0


def test_probes_are_as_many_as_planted_pairs_need():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = ED.Quantiser(x, 64)
    probes, share = q.enough(x, 0.93, 0.999)
    assert 1 < probes < 20 and share >= 0.999 and q.enough(x, 0.93, 0.9)[0] <= probes
    near = q.ranked(x[:50], 64)
    assert all(sorted(r) == list(range(64)) for r in near.tolist())
    assert (near[:, 0] == ((x[:50, None] - q.centroids(np.arange(64))[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_components_and_forests(spark):
    draw = np.random.default_rng(7)
    a, b = draw.integers(0, 60, 45), draw.integers(0, 60, 45)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a bigint, b bigint")).collect()}
    p, q = forest(a, b)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert all(got[x] == find(x) for x in got) and {x for x, y in zip(a, b, strict=True) if x != y} <= set(got)
    assert len(p) == len(set(np.concatenate((a, b)).tolist())) - len({find(x) for x in np.concatenate((a, b)).tolist()}) and all(find(x) == find(y) for x, y in zip(p, q, strict=True))
