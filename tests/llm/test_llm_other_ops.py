"""Nearest neighbours, WARC, personal data, mixing, HTML, language and toxicity."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_cases import EDGES, documents

from riskloom.llm import ann, html_text, langid, mixing, pii, toxicity, warc
from riskloom.llm.common import hash_bound, read

# --- nearest neighbours


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        best = {}
        for a in [v for i, v in ok if i == q]:
            for i, b in ok:
                if i != q and len(a) == len(b):
                    s = float(ann.dots(a[None], b[None])[0] / (np.sqrt(ann.dots(a[None], a[None])[0]) * np.sqrt(ann.dots(b[None], b[None])[0])))
                    best[i] = max(best.get(i, -9), s)
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_edges(spark, block):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for k in range(0, 300)]
    rows += [(400 + k, rows[50][1]) for k in range(40)]  # ties with a query
    rows += [(500, [0.0] * 6), (550, None), (600, [float("nan")] * 6), (650, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6), (700, []), (750, [1.0, 2.0]), (751, [2.0, 4.1]),
             (800, [1e30] * 6), (801, [1e-30] * 6), (802, [float("inf")] * 6), (100, rows[100][1]), (100, rows[7][1]), (901, rows[3][1]), (901, rows[4][1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, dim string")
    got = ann.nearest(df.filter("vec_id % 50 = 0"), df, k=5, query_block=block, candidate_block=block).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute_nearest(rows, 5)
    none = df.filter("false")
    assert ann.nearest(none, df).count() == 0 and ann.nearest(df, none).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for d in (3, 64, 2500):
        a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.standard_cauchy((40, d)), rng.normal(size=(50, d))))
        (ai, s, ae, _), (bi, t, be, bb) = ann.quantise(a), ann.quantise(b)
        assert (np.abs(ann.int8_products(ai, bi) * s[:, None] * t - a @ b.T) <= be[None, :] + ae[:, None] * bb[None, :] + ann.ROUNDING).all()


def test_a_repeated_id_leaves_the_bounds_at_work(monkeypatch):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(64, 32)), rng.normal(size=(4096, 32))
    ids = np.arange(4096) + 10_000
    seen = []
    real = ann.dots
    monkeypatch.setattr(ann, "dots", lambda a, b: seen.append(len(a)) or real(a, b))

    def recomputed(c_ids):
        seen.clear()
        found = ann.nearest_in_tile(np.arange(64), q, c_ids, c, 5)
        return sum(seen) - 64 - 4096, found

    plain, _ = recomputed(ids)
    twice, found = recomputed(np.where(ids == 10_007, 10_003, ids))
    assert plain < 64 * 4096 / 50 and twice < 1.2 * plain + 64
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    cos[:, 3] = np.maximum(cos[:, 3], cos[:, 7])
    cos[:, 7] = -9
    assert {(x, y) for x, y, _ in found} == {(x, 10_000 + y) for x in range(64) for y in np.argsort(-cos[x])[:5].tolist()}


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 200_000
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "WARC/1.1\r\n\r\n" * 30),
             (7, "u", "WARC/1.1\r\n\r\n" * 30), (8, "u", "WARC/1.1\r\n\r\n" * 30)]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, digest string, n int").repartition(3)
    manifest = warc.write_warc(df, str(tmp_path / "w"), chunk_bytes=1000)
    chunks = warc.read_warc(manifest, chunk_bytes=4096)
    rows = chunks.collect()
    assert max(len(r["chunk"]) for r in rows) == 4096
    whole = {}
    for r in sorted(rows, key=lambda r: (r["page_id"] is not None, r["page_id"], r["chunk_no"])):
        if r["record_type"] == "response" and r["page_id"] not in (None, 7):
            whole[r["page_id"]] = whole.get(r["page_id"], b"") + bytes(r["chunk"])
            assert r["bytes_so_far"] == len(whole[r["page_id"]]) and r["digest_so_far"] == hashlib.sha256(whole[r["page_id"]]).hexdigest()
    assert whole == {1: big.encode(), 3: b"short", 4: b"short", 5: b"", 6: b""}
    last = sorted(((r["page_id"] or 0, r["bytes_so_far"], r["record_type"], r["refers_to"]) for r in rows if r["last"]), key=str)
    n, m = len(big.encode()), 12 * 30
    assert last == sorted([(0, n, "response", None), (1, n, "response", None), (2, n, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None),
                           (6, 0, "response", None), (7, m, "response", None), (7, m, "response", None), (8, m, "revisit", 7)], key=str)
    raw = b"".join(gzip.open(r["file"]).read() for r in manifest.collect())
    assert b"WARC-Target-URI: http://b/%0D%0AX: y\r\n" in raw and raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages)
    assert warc.read_warc(warc.write_warc(df.filter("false"), str(tmp_path / "e"))).count() == 0


# --- personal data


def brute_spans(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                 ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = [int(c) for c in m[0] if c in "0123456789"]
            odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and odd % 10 == 0) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("1234.@+- ()a%_é٣" if rng.random() < 0.5 else "12.@") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    texts = ["mail a.b@c.de, 4111 1111-1111 1111", "+1 (212) 555-1234 10.0.0.1 999.1.1.1", *[x for k, (_, x) in enumerate(EDGES) if k != 16]]
    assert pii.base_spans("1" * 500_000 + "@" + "a" * 500_000 + "+1" + " " * 500_000) == []  # quadratic for the plain patterns
    docs = documents(spark, [(k, t) for k, t in enumerate(texts)])
    got = pii.sanitise(docs).select("doc_id", "spans", "sanitised").collect()
    for r in got:
        t = texts[r["doc_id"]]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute_spans(t or "")
        assert (r["sanitised"] is None) == (t is None)
    assert next(r for r in got if r["doc_id"] == 0)["sanitised"] == "mail [EMAIL], [CARD]"
    assert pii.sanitise(docs.filter("false")).count() == 0


@pytest.mark.parametrize("fits", [True, False])
def test_disclosing_terms(spark, monkeypatch, fits):
    """A name that stands by one address in different contexts is marked everywhere; common words are not."""
    if not fits:
        monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    common = [f"word{k}" for k in range(40)]

    def words(n):
        return " ".join(rng.choices(common, k=n))

    rows = [(k, f"{words(20)} Zanthor {words(2)} zan@thor.org {words(20)}") for k in range(6)]
    rows += [(10 + k, f"{words(30)} user{k}@mail.org {words(30)}") for k in range(300)]
    copy = f"{words(12)} onlyhere {words(3)} copy@mail.org {words(9)}"
    rows += [(400 + k, copy) for k in range(9)] + [(500, "ZANTHOR speaks " + words(5)), (501, None), (501, "zanthor-zanthor")]
    docs = documents(spark, rows)
    assert {r["term"]: round(r["disclosure"], 3) for r in pii.disclosing_terms(docs).collect()} == {"zanthor": 0.75}
    got = pii.sanitise(docs).collect()
    marked = {(r["doc_id"], r["text"][s["start"]:s["end"]]) for r in got for s in r["spans"] if s["kind"] == "term"}
    assert marked == {(k, "Zanthor") for k in range(6)} | {(500, "ZANTHOR"), (501, "zanthor")}
    assert next(r for r in got if r["doc_id"] == 500)["sanitised"].startswith("[TERM] speaks")
    assert all([s["kind"] for s in r["spans"] if s["kind"] != "term"] == [k for k, _, _ in brute_spans(r["text"] or "")] for r in got)


# --- mixing


def test_mix_targets_and_limits(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 400)), "en", rng.choice(["a"] * 30 + ["b", "Ä", "z", None, ""])) for k in range(900)] + [(i, t, "en", "a") for i, t in EDGES if t != EDGES[14][1]] + [(7777, None, "en", "empty")]
    docs = documents(spark, rows)
    documents_, mixed = mixing.mix(docs, block_words=64)
    got = mixing.taken_words(docs, block_words=64).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by.items():
        assert sum(taken) == int(target) and target <= 2 * size
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6 * sum(s for s, _ in by) + 1
    again = sorted(map(str, mixing.taken_words(docs.repartition(5), block_words=64).collect()))
    assert again == sorted(map(str, got))
    # in every prefix of the schedule a source has about its share of words
    slots = sorted((r["slot"], r["source"] or "", r["n_words"]) for r in mixed.collect())
    total, share = sum(n for *_, n in slots), {}
    for _, s, n in slots:
        share[s] = share.get(s, 0) + n
    seen, done = dict.fromkeys(share, 0), 0
    for _, s, n in slots:
        seen[s] += n
        done += n
        assert abs(seen["a"] - share["a"] * done / total) < 64 * 12
    assert mixing.taken_words(docs.filter("false")).count() == 0


def test_targets_are_the_fixed_point():
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, 100, 1000, 10**6]) * rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
        if not sum(sizes):
            continue
        want, free = [0.0] * len(sizes), set(range(len(sizes)))
        left = 1.5 * sum(sizes)
        while True:
            level = left / sum(weights[k] for k in free)
            over = [k for k in free if level * weights[k] > 2 * sizes[k] * (1 + 1e-12)]
            if not over:
                break
            for k in over:
                want[k], left = 2.0 * sizes[k], left - 2 * sizes[k]
                free.remove(k)
        for k in free:
            want[k] = level * weights[k]
        assert np.allclose(mixing.capped_targets(sizes, weights), want, rtol=1e-9)


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1><a href=/>home</a></header>
<nav><ul><li><a href=a>menu</a><li><a href=b>entry</a></ul></nav><div id="cookie-notice">We use cookies to give you the best experience, please accept all of them now.</div>
{main}<aside><p>Other stories that you may like to read when you find some time for it.</p></aside>
<section class='post comments'><p>Great piece, I liked it a lot and read it twice, thank you so very much!</p></section><form>Your name <input name=x></form>
<footer>&copy; Site &middot; imprint</footer></body></html>"""
STORY = '<h2>Title&nbsp;here</h2><p><b>Lead &amp; more.<br><p>A first   paragraph\nof fair length with a <a href="x>y">li</a>nk inside it.<ul><li>one<li>two</ul><p>And the last paragraph, <!-- not this --> of some length too.'
TEXT = "Title here Lead & more. A first paragraph of fair length with a link inside it. one two And the last paragraph, of some length too."


@pytest.mark.parametrize("main", ["<article>%s</article>", '<div class="wrap no-sidebar"><div id=content>%s</div></div>', "<main><div>%s</div></main>", "<div>%s</div>", "<article><section>%s</section></article>"])
def test_main_text(main):
    assert html_text.main_text(PAGE.replace("{main}", main % STORY)) == TEXT
    assert html_text.main_text(PAGE.replace("{main}", main % STORY).replace("</body></html>", "").replace("</footer>", "")) == TEXT


@pytest.mark.parametrize("wrap", ['<div style="overflow:hidden">%s</div>', '<div class="overflow-hidden">%s</div>', '<div title="The hidden cost">%s</div>', "<div data-hidden=no>%s</div>",
                                  "<div title='x aria-hidden=true display:none class=\"comment\"'>%s</div>", '<div title="The hidden cost>%s</div>',
                                  '<svg width="1"/>%s', '<svg />%s<svg></svg>', "<math/>%s", "<svg>%s", "<form action=/>%s</form>", "<div><form id=f>%s</form></div>"])
@pytest.mark.parametrize("main", ["<article>%s</article>", "<div>%s</div>"])
def test_story_in_what_only_looks_hidden(main, wrap):
    assert html_text.main_text(PAGE.replace("{main}", main % (wrap % STORY))) == TEXT
    assert html_text.main_text(PAGE.replace("{main}", wrap % (main % STORY))) == TEXT


@pytest.mark.parametrize("part", ["<div hidden>no</div>", "<div HIDDEN=''>no</div>", '<p id=a aria-hidden="true">no</p>', "<div style='color:red; display : none'>no</div>", "<svg width=1/>no</svg>",
                                  '<svg><path d="/"/>no</svg>', "<form>no <input name=x/></form>"])
def test_what_is_hidden_stays_out(part):
    assert html_text.main_text(PAGE.replace("{main}", "<article>%s%s</article>" % (part, STORY))) == TEXT


def test_unended_drawings_are_read_once():
    assert html_text.main_text("<svg>" * 50_000 + "x") == "x"


def test_html_edges(spark):
    assert [html_text.main_text(x) for x in (None, "", " ", "plain  text", "<p>", "<article></article>", "a < b & c &amp; d")] == ["", "", "", "plain text", "", "", "a < b & c & d"]
    for x in ("<div>" * 20_000 + "x", "<a " * 50_000, "<!--" * 50_000, '<a b="' * 50_000, "<p>x</b>" * 30_000, "</div>" * 50_000, "<script>" * 20_000):
        html_text.main_text(x)
    long = PAGE.replace("{main}", "<article>" + "<p>word and word.</p>" * 30_000 + "</article>")
    rows = spark.createDataFrame([(1, "u", long, "x"), (2, None, None, "x"), (None, "u", "<p>a</p>", "x"), (1, "u", long, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows).collect()
    assert sorted(len(r["main_text"].split()) for r in got) == [0, 1, 90_000, 90_000]
    assert html_text.extract(rows.filter("false")).count() == 0


def test_pages_are_their_articles(spark, sf_dir):
    """All pages of the table: the words of the article element."""
    import html

    for r in html_text.extract(read(spark, sf_dir, "pages")).select("html", "main_text").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["main_text"] == " ".join(html.unescape(re.sub(r"<b>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))).split())


@pytest.mark.parametrize("name", ["related-work", "share-price", "notice-board", "search-strategy", "social-history", "comment-period", "respond-rates", "banner-ads-law", "login-shell", "overlay-network",
                                  "disclaimer", "no-sidebar", "with_comments", "ad-hoc", "cookie-recipes", "menu-of-options"])
@pytest.mark.parametrize("key", ["class", "id"])
def test_sections_of_a_story_stay(name, key):
    section = f'<section {key}="{name}"><p>A section of the story with a sentence of its own, which is as long as those around it are.</p></section>'
    for main in ("<article>%s</article>", "<div>%s</div>"):
        text = html_text.main_text(PAGE.replace("{main}", main % (STORY.replace("<p>And the last", section + "<p>And the last"))))
        assert text == TEXT.replace("And the last", "A section of the story with a sentence of its own, which is as long as those around it are. And the last")


REMARK = "<p>I have read this story twice now and must say that I do not agree with most of what it says.</p>"


@pytest.mark.parametrize("where, part", [
    ("after", f'<div id="comments"><ol><li><article class="comment-body">{REMARK}</article><li><article class="comment-body">{REMARK}</article></ol></div>'),
    ("inside", f'<section class="comments"><article class="comment">{REMARK}</article></section>'), ("after", f'<article class="comment">{REMARK}</article><article class="comment">{REMARK}</article>'),
    ("after", f'<div class="sidebar"><article class="teaser">{REMARK}</article></div>'), ("inside", f'<div class="promo-box"><article>{REMARK}</article></div>'),
    ("after", f'<ol class="comment-list">{REMARK * 9}</ol>'), ("inside", '<div class="notice">Short notice.</div>'), ("inside", f'<div class="ad_slot-3">{REMARK}</div>')])
def test_replies_and_sidebars_stay_out_with_their_articles(where, part):
    story = STORY + part if where == "inside" else STORY
    for main in ("<article>%s</article>", "<main><article>%s</article></main>"):
        assert html_text.main_text(PAGE.replace("{main}", main % story + (part if where == "after" else ""))) == TEXT


def plain_density(page):
    """Composite text density of a well-formed page without anything to take out, by the definition."""
    from html.parser import HTMLParser

    nodes = [{"tag": "#", "up": None, "text": "", "kids": []}]

    class Reader(HTMLParser):
        at = 0

        def handle_starttag(self, tag, attrs):
            nodes.append({"tag": tag, "up": self.at, "text": "", "kids": []})
            nodes[self.at]["kids"].append(len(nodes) - 1)
            self.at = len(nodes) - 1

        def handle_endtag(self, tag):
            self.at = nodes[self.at]["up"]

        def handle_data(self, data):
            nodes[self.at]["text"] += " ".join(data.split())

    Reader().feed(page)

    def all_of(k, what):
        return what(k) + sum(all_of(j, what) for j in nodes[k]["kids"])

    def linked(k):
        return k is not None and (nodes[k]["tag"] == "a" or linked(nodes[k]["up"]))

    body = next(k for k, x in enumerate(nodes) if x["tag"] == "body")

    def figures(k):
        return (all_of(k, lambda j: len(nodes[j]["text"])), all_of(k, lambda j: 1), all_of(k, lambda j: len(nodes[j]["text"]) * linked(j)), all_of(k, lambda j: nodes[j]["tag"] == "a"))

    share = figures(body)[2] / figures(body)[0]

    def density(k):
        c, t, lc, lt = figures(k)
        if not c:
            return 0
        lc, lt = max(1, lc), max(1, lt)
        return c / t * np.log(c * t / (lc * lt)) / np.log(np.log(c / max(1, c - lc) * lc + share * c + np.e))

    total = {k: sum(density(j) for j in x["kids"]) or density(k) for k, x in enumerate(nodes) if x["tag"] not in ("a", "b")}
    below = {k: [k, *(i for j in x["kids"] for i in [j, *below_of(nodes, j)])] for k, x in enumerate(nodes)}
    core = max((k for k in below[body] if k in total), key=lambda k: (total[k], -k))
    path = [core]
    while path[-1] != body:
        path.append(nodes[path[-1]]["up"])
    least = min(density(k) for k in path)
    wanted = {max((j for j in below[k] if j in total), key=lambda j: (total[j], -j)) for k in below[body] if k in total and density(k) >= least and figures(k)[0]} | {core}
    root = max(k for k in below if wanted <= set(below[k]))
    return " ".join(" ".join(nodes[k]["text"] for k in [root, *below_of(nodes, root)]).split())


def below_of(nodes, k):
    return [i for j in nodes[k]["kids"] for i in [j, *below_of(nodes, j)]]


def test_density_against_the_definition():
    rng = random.Random(12)

    def words(n):
        return " ".join(rng.choice(["alpha", "be", "gamma", "delta", "of", "epsilon"]) for _ in range(n))

    def block(deep):
        kind = rng.random()
        if deep and kind < 0.45:
            return f"<{(t := rng.choice(['div', 'section']))}>{''.join(block(deep - 1) for _ in range(rng.randint(1, 4)))}</{t}>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li><a>{words(rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        return f"<p>{words(rng.randint(3, 60))}</p>"

    for _ in range(400):
        page = f"<html><body>{''.join(block(3) for _ in range(rng.randint(1, 4)))}</body></html>"
        assert html_text.main_text(page) == plain_density(page), page


def test_pages_without_their_tags_are_the_same(spark, sf_dir):
    """Density alone gives every page's text: the article renamed to div."""
    for r in read(spark, sf_dir, "pages").select("html").collect():
        assert html_text.main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>")) == html_text.main_text(r["html"])


def test_clashing_main_text(spark):
    rows = spark.createDataFrame([(1, "<p>a b</p>", 7), (1, "<p>a b</p>", 8)], "page_id long, html string, main_text int")
    assert [(r["main_text"], r["page_id"]) for r in html_text.extract(rows).collect()] == [("a b", 1)] * 2


def test_text_in_several_articles():
    """Density selects, not the tag: every article that holds some of the text is in."""
    parts = [f"<p>{w} paragraph that is about as long as the other one, with no link in it.</p><p>And {w} sentence after it, which is long enough to be text.</p>" for w in ("One", "Two", "Three")]
    want = " ".join(re.sub("<[^>]*>", " ", "".join(parts)).split())
    for a in ("article", "div", "section"):
        assert html_text.main_text(PAGE.replace("{main}", "".join(f"<{a}>{x}</{a}>" for x in parts))) == want
        assert html_text.main_text(PAGE.replace("{main}", f"<div><main>{parts[0]}</main></div>" + "".join(f"<{a}>{x}</{a}>" for x in parts[1:]))) == want
    short = "<article><p>Short end.</p></article><article><a href=x>Another story</a></article>"
    assert html_text.main_text(PAGE.replace("{main}", f"<article>{''.join(parts)}</article>{short}")) == want + " Short end."


def test_pages_without_article_tags(spark, sf_dir):
    """All pages of the table with the article renamed to div: a run of the same words, over all pages 99 % of them."""
    rows = [r["html"] for r in read(spark, sf_dir, "pages").select("html").collect()]
    all_words = kept = 0
    for page in rows:
        want = html_text.main_text(page)
        got = html_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>"))
        assert got and got in want
        all_words += len(want.split())
        kept += len(got.split())
    assert kept >= 0.99 * all_words


# --- language


def test_code_lengths_are_those_of_the_tree():
    """Array look-ups against a plain PPM with escapes and exclusion."""
    rng = random.Random(6)
    train = {"aa": "".join(rng.choices("abc d", k=4000)).encode(), "bb": "".join(rng.choices("aabbe ", k=4000)).encode()}
    order, least = 2, 20
    counts = {k: np.unique(langid._strings(v, order), return_counts=True) for k, v in train.items()}
    trees = langid.ContextTrees(counts, order, least)
    alphabet = {*b" ".join(train.values()), 32}
    size = len(alphabet) + 1
    tables = {k: [{}, {}, {}] for k in train}
    for k, v in train.items():
        x = b" " * order + v + b" "
        for j in range(order, len(x)):
            for n in range(order + 1):
                row = tables[k][n].setdefault(x[j - n:j], {})
                row[x[j]] = row.get(x[j], 0) + 1
    known = {c for n in range(1, order + 1) for c in {*tables["aa"][n], *tables["bb"][n]} if max(sum(tables[k][n].get(c, {}).values()) for k in train) >= least}

    def p(lang, context, symbol, skip=frozenset()):
        def row_p(n, s):
            if n < 0:
                return 1 / size
            c = context[len(context) - n:]
            row = tables[lang][n].get(c, {})
            if n and (c not in known or not row):
                return row_p(n - 1, s)
            total, q = sum(row.values()), len(row)
            if s in row:
                return row[s] / (total + q)
            rest = 1 - sum(row_p(n - 1, y) for y in row)
            return q / (total + q) / rest * row_p(n - 1, s)

        n = order
        while n and context[len(context) - n:] not in known:
            n -= 1
        return row_p(n, symbol)

    text = b"abca bbe zab"
    x = b" " * order + text + b" "
    want = [-sum(np.log2(p(k, x[j - order:j], x[j] if x[j] in alphabet else -1)) for j in range(order, len(x))) for k in trees.langs]
    assert np.allclose(trees.code_lengths(text), want, rtol=1e-4)
    block, langid.BLOCK = langid.BLOCK, 5
    try:
        assert np.allclose(trees.code_lengths(text), want, rtol=1e-4)
    finally:
        langid.BLOCK = block


def test_language_edges_and_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    trees = langid.fit(langid.learnable(docs))
    held = langid.identify(docs.select("doc_id", "text"), trees).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    edges = langid.identify(documents(spark, EDGES), trees).collect()
    assert {r["lang_pred"] for r in edges if r["text"] is None or not any(c.isalpha() for c in r["text"])} == {"und"}
    assert {r["lang_pred"] for r in edges} - {"und"} <= {"en", "de", "fr", "es"}
    assert langid.fit(docs.filter("false")) is None
    assert {r["lang_pred"] for r in langid.identify(documents(spark, EDGES), None).collect()} == {"und"}
    assert langid.identify(documents(spark, []), trees).count() == 0


# --- both samples


def hot_documents(spark):
    """One doc_id on a third of the rows, each with another text, and once more with one text on 300 rows."""
    rows = [(7 if k % 3 == 0 else 1000 + k, f"{'hot' if k % 3 == 0 else 'cold'} words of text number {k}") for k in range(1200)]
    return documents(spark, rows + [(8, "same words of text")] * 300)


def test_sample_of_a_hot_doc_id(spark, monkeypatch):
    docs, drawn = hot_documents(spark), []
    monkeypatch.setattr(toxicity, "train", lambda found, labels: drawn.extend(zip(labels.tolist(), found)))
    labels = docs.select("doc_id", F.when(F.col("doc_id") == 1001, 1).otherwise(0).alias("toxic"))
    toxicity.fit(docs, labels, max_docs=60)
    assert [t for t, _ in drawn].count(1) == 1
    assert sum("same" in d for _, d in drawn) <= 1
    assert 30 <= len(drawn) <= 100 and 5 <= sum("hot" in d for _, d in drawn) <= 45
    monkeypatch.setattr(langid, "ContextTrees", lambda counts, *a: {k: int(n[s == int.from_bytes(b"text ", "big")].sum()) for k, (s, n) in counts.items()})
    train = docs.drop("lang").withColumn("lang", F.when(F.col("doc_id").isin(7, 8), "hot").otherwise("cold"))
    found = langid.fit(train, max_docs=60)
    assert set(found) == {"hot", "cold"} and all(30 <= n <= 100 for n in found.values())


def test_small_shares_keep_rows_or_raise(spark):
    assert [hash_bound(n, 1000) for n in (0, 1000)] == [(1 << 63) - 1] * 2
    for n in (10**6, 10**10, 10**15):
        assert abs((hash_bound(n, 1000) + (1 << 63) + 1) * n / (1 << 64) - 1000) < 1
    docs = hot_documents(spark).drop("lang").withColumn("lang", F.lit("xx"))
    with pytest.raises(ValueError):
        langid.fit(docs, max_docs=1e-9)
    with pytest.raises(ValueError):
        toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), max_docs=1e-9)


# --- toxicity


def test_words_are_hashed_alone_as_in_company(monkeypatch):
    words = ["a", "grumpf", "grumpfed", "Ünï😀", "x" * 5000, "", "fed"]
    row, bucket = toxicity.subwords(words)
    for k, w in enumerate(words):
        alone = toxicity.subwords([w])[1]
        marked = f"<{w}>"
        assert np.array_equal(np.sort(bucket[row == k]), np.sort(alone)) and len(alone) == 1 + sum(max(0, len(marked) - n + 1) for n in toxicity.GRAMS)
    shared = set(bucket[row == 1]) & set(bucket[row == 2])
    assert len(shared) >= 10 and len(set(bucket.tolist())) > 50
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS), 0.0)
    want = [model.weights[toxicity.subwords([w])[1]].mean() for w in words]
    assert np.allclose(model.words(words), want)
    monkeypatch.setattr(toxicity, "HASHED_CHARS", 9)
    assert np.allclose(model.words(words), want) and model.words([]) == []


def test_toxicity_learns_subwords(spark):
    rng = random.Random(2)
    syllables = ["ba", "do", "ki", "lu", "mer", "ta", "no", "vi", "sa", "re"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def text(bad):
        w = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(max(1, len(w) // 40) if bad else 0):
            w[rng.randrange(len(w))] = "grumpf" + rng.choice(["ed", "er", "ing", "y", "is", "", "ol"])
        return " ".join(w)

    rows = [(k, text(k % 4 == 0)) for k in range(800)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(800)] + [(None, 1, 1), (3, 1, None), (5, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, rows + EDGES[:4]), toxicity.learnable(labels))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, rows), model).collect()}
    held = [k for k in range(800) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.7) == (k % 4 == 0) for k in held]) > 0.97
    new = toxicity.score(documents(spark, [(1, text(False) + " grumpfuli grumpfist grumpfox grumpfen"), (2, text(False))]), model)
    assert {r["doc_id"]: r["score"] > 0.7 for r in new.collect()} == {1: True, 2: False}
    edges = toxicity.score(documents(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edges)
    one = toxicity.fit(documents(spark, rows), labels.filter("toxic = 1"))
    assert all(r["score"] > 0.99 for r in toxicity.score(documents(spark, EDGES), one).collect())
    assert toxicity.score(documents(spark, []), toxicity.fit(documents(spark, []), labels)).count() == 0


# --- clashing names, and sides too large to broadcast


def test_clashing_result_columns(spark):
    rows = spark.createDataFrame([(1, "mail a@b.org now", "x", 3, 0.5)], "doc_id long, text string, spans string, sanitised int, lang_pred double")
    got = pii.sanitise(rows.drop("lang_pred")).first()
    assert got["sanitised"] == "mail [EMAIL] now" and [s["kind"] for s in got["spans"]] == ["email"]
    train = spark.createDataFrame([(k, "le la les des une " * 9 if k % 2 else "the and of with that " * 9, "fr" if k % 2 else "en", "s", 0) for k in range(40)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    found = langid.identify(rows.drop("spans", "sanitised"), langid.fit(train)).first()
    assert found["lang_pred"] in ("fr", "en") and found["doc_id"] == 1


def test_sides_too_large_to_broadcast(spark, monkeypatch, tmp_path):
    from riskloom.llm import common, minhash
    rng = random.Random(11)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    rows = [(k, texts[k % 60] if k % 3 else texts[k % 60] + " end") for k in range(150)] + [(None, texts[0]), (7, None)]
    docs = documents(spark, rows)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))

    def results(path):
        archive = warc.read_warc(warc.write_warc(pages, str(tmp_path / path))).filter("last").select("page_id", "bytes_so_far", "digest_so_far", "record_type", "refers_to")
        model = toxicity.fit(docs, labels)
        return [sorted(map(str, x.collect())) for x in (mixing.taken_words(docs, block_words=32), archive, toxicity.score(docs.select("doc_id", "text"), model), minhash.one_of_each(docs.select("doc_id", "text"), n=2, threshold=(80, 100)))]

    broadcast = results("a")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for module in (mixing, warc, toxicity, minhash):
        if hasattr(module, "BROADCAST_BYTES"):
            monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert results("b") == broadcast


def test_disclosing_terms_are_counted_before_they_meet_the_pairs(spark):
    """Spark moves a semi join below the counts, where it hands on each word of each document."""
    docs = spark.createDataFrame([(i, f"word{i} alpha beta of zanthor at zan{i % 3}@mail{i % 3}.org then gamma{i}") for i in range(30)], "doc_id long, text string")
    text = pii.disclosing_terms(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in text and "Generate explode" in text
