"""Edge cases and brute-force comparisons of the operators: nulls, empty and long texts, ties, repeats, empty tables,
extra columns with clashing names."""

from __future__ import annotations

import os
import math
import random
from collections import Counter
import re
import sys
import textwrap

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
from oracle import compare  # noqa: E402

from corpusforge.llm import (  # noqa: E402
    decontaminate,
    html_text,
    language_id,
    license_scan,
    mixing,
    ngram_join,
    quality,
    quote_links,
    registry,
    suffix_dedup,
    url_filter,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu".split()


def prose(rng: random.Random, n: int, syllables=SYLLABLES) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def copies():
    """(doc_id, text) with exact and near copies, shared passages, repeats inside a text, nulls, short and long texts."""
    rng = random.Random(1)
    base = prose(rng, 300)
    passage = prose(rng, 60)
    words = base.split()
    rows = [(0, base), (1, base), (2, None), (3, ""), (4, " \n "), (5, "one"), (6, "One"), (7, "one two"), (8, "x" * 99), (9, "é" * 400)]
    for i in range(10, 40):
        w = list(words)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = prose(rng, 1) + "q"
        rows.append((i, " ".join(w)))
    for i in range(40, 60):
        rows.append((i, prose(rng, rng.randint(5, 120)) + " " + passage[: rng.randint(40, len(passage))] + " " + prose(rng, 30)))
    rows += [(60, passage * 3), (61, "ab" * 200), (62, prose(rng, 8000)), (-5, passage)]
    return rows


def test_suffix_dedup_is_brute_force(spark, copies):
    out = suffix_dedup.remove_repeats(spark, spark.createDataFrame(copies, "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert got == brute.repeats(copies)


@pytest.mark.parametrize("length,anchor", [(20, 8), (64, 16)])
def test_suffix_dedup_other_lengths(spark, copies, length, anchor):
    out = suffix_dedup.remove_repeats(spark, spark.createDataFrame(copies, "doc_id long, text string"), length, anchor, keep_text=False)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == brute.repeats(copies, length)


def test_suffix_dedup_edges(spark):
    text = prose(random.Random(3), 60)
    df = spark.createDataFrame([(1, text, 7), (1, text, 7), (None, text, 8), (2, text, 9), (3, None, 9)], "doc_id long, text string, n_bytes long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.kept_text) for r in suffix_dedup.remove_repeats(spark, df).collect())
    n = len(text.encode())
    assert got == [(False, 1, 0, text), (False, 1, 0, text), (False, 2, n, ""), (False, 3, 0, None), (True, 0, 0, text)]
    assert suffix_dedup.remove_repeats(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 60), (1, 95)])
def test_ngram_join_is_brute_force(spark, copies, size, percent):
    out = ngram_join.near_duplicate_groups(spark, spark.createDataFrame(copies, "doc_id long, text string"), size, percent, block_sets=8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute.near_components(copies, size, percent)


def test_ngram_join_small_sets_and_edges(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 14), ["a", "b", "c"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.near_duplicate_groups(spark, df, 1, 60)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute.near_components(rows, 1, 60)
    twice = df.limit(3).unionByName(df.limit(3)).unionByName(spark.createDataFrame([(None, "a b")], "doc_id long, text string"))
    assert ngram_join.near_duplicate_groups(spark, twice).count() == 3
    assert ngram_join.near_duplicate_groups(spark, df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([1, 3, 50, 200])), f"s{min(i % 9, 3)}", 1) for i in range(1500)]
    rows += [(9000, None, "s0", 1), (9001, "", None, 1), (9002, "a b c", None, 1), (1, rows[1][1], "s1", 1), (None, "x y", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(spark, df).collect()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(mixing.mix_sources(spark, df).collect(), key=str)
    size, target, taken = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s))
    left, open_, want = float(sum(size.values())), list(order), {}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    while True:  # the contract's own words: stop at 3 times the size, reshare by weight
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            open_.remove(s)
    for s in order:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= max(60, 0.01 * target[s])
        mine = [r for r in got if r.source == s and r.size]
        low, high = -10.0, 10.0  # the rate is min(3, exp(lam * size)): lam by halving, by hand
        for _ in range(200):
            mid = (low + high) / 2
            words = sum(r.size * min(3.0, math.exp(min(mid * r.size, 9.0))) for r in mine)
            low, high = (mid, high) if words < target[s] else (low, mid)
        for r in mine:
            rate = min(3.0, math.exp(min(low * r.size, 9.0)))
            assert math.floor(rate - 1e-5) <= r.copies <= math.ceil(rate + 1e-5)
    assert mixing.mix_sources(spark, df.limit(0)).count() == 0


HTML = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><h1>A &amp; B</h1><p>First <b>bold</b>
 text<br>goes on<p>Second &lt;x&gt; &#233;</p><form><input value=1><button>Go</button></form><ul><li>one<li>two</ul><aside>see also</aside></article>
<section id="comments"><p>Nice post</p></section><script>var a="</p>";</script><footer>&copy; me</footer>"""


def test_html_text(spark):
    assert html_text.main_text(HTML) == "A & B\nFirst bold text goes on\nSecond <x> é\none\ntwo"
    plain = "<div id=menu><a href=x>Home</a> <a href=y>News</a></div><div><p>" + "long text " * 20 + "</p><p>" + "more text " * 9 + "</p></div><div class=footer>end</div>"
    assert html_text.main_text(plain) == ("long text " * 20).strip() + "\n" + ("more text " * 9).strip()
    long = "<article><p>" + "word " * 200_000
    rows = [(1, None, "a"), (2, "", "a"), (3, HTML, "a"), (3, HTML, "a"), (4, long, "a"), (5, "<<p <!-- x", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in html_text.extract_main_text(df).collect())
    assert [g[0] for g in got] == [1, 2, 3, 3, 4, 5] and got[0][1:] == (0, 0) and got[4][1] == 999_999 and all(a == b for _, a, b in got)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def _page(*lines: str) -> str:
    return "".join(f"<p>{x}</p>" for x in lines)


LINKS = [f"<a href=x>Some other story {i}</a>" for i in range(6)]


def test_html_text_is_chosen_by_window_sums_beside_article_elements():
    text = [f"Paragraph {i} of the page " + "with words " * 20 for i in range(5)]
    cards = "".join(f"<article><h2><a href=x>Teaser {i}</a></h2></article>" for i in range(6))
    want = "\n".join(x.strip() for x in text)
    assert html_text.main_text(f"<div>{_page(*text)}</div>{cards}") == want
    assert html_text.main_text(f"{cards}<div>{_page(*text)}</div>") == want
    # lists of links and share lines inside main are no text, the linked title of an article is
    share = "<div><a href=x>Tweet</a> | <a href=y>Mail</a></div>"
    page = f"<main><h1><a href=x>Title</a></h1>{_page(*text[:3])}{_page('More news', *LINKS)}{_page(*text[3:])}{share}</main>"
    assert html_text.main_text(page) == "\n".join(["Title", *(x.strip() for x in text[:3]), "More news", *(x.strip() for x in text[3:])])
    assert html_text.main_text(f"{_page('More news', *LINKS)}<main>{_page(*text)}</main>") == want
    assert html_text.main_text("<article><p><a href=x>all of it linked</a></p></article>") == "all of it linked"


@pytest.mark.parametrize("name", ["has-sidebar", "content-sidebar-wrap", "reader-content", "legal-text", "site-search-results"])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_html_text_class_words_on_a_wrapper(name, tag):
    text = ["Title", "Words of the story " * 20, "a short one"]
    side = '<div class="sidebar"><p>' + "Latest and most read " * 9 + "</p></div>"
    want = "\n".join(x.strip() for x in text)
    assert html_text.main_text(f'<div class="{name}"><{tag}>{_page(*text)}</{tag}>{side}</div>') == want
    assert html_text.main_text(f'<{tag}>{_page(*text)}</{tag}><div class="{name}">{_page("Aside", "Words beside the story " * 20)}</div>') == want


def test_html_text_marks_evidence_and_edges():
    comments = '<ol class="comment-list">' + "".join(f"<li><article><p>{'I think so ' * 30}{i}</p></article></li>" for i in range(4)) + "</ol>"
    # more comment than article, with and without marks on the article itself
    assert html_text.main_text(f"<article><p>Short news.</p></article>{comments}") == "Short news."
    assert html_text.main_text(f'<article class="post comments-open"><p>Short news.</p></article>{comments}') == "Short news."
    assert html_text.main_text(f'<div class="has-sidebar"><article><p>Short news.</p></article>{comments}</div>') == "Short news."
    assert html_text.main_text(f"<div><p>{'Long news ' * 40}</p></div>{comments.replace('article', 'div')}") == ("Long news " * 40).strip()
    # a form around the page, a form in it
    form = "<form><p>Your name and address</p><input></form>"
    assert html_text.main_text(f"<form id=f><main><p>Short news.</p></main></form>{form}") == "Short news."
    assert html_text.main_text(f"{form}{form}") == ""
    assert html_text.main_text("<div class=widget>" * 20_000 + "<p>deep text") == "deep text"
    assert html_text.main_text(f"<article><p>Short news.</p>{form}<p>more</p></article>") == "Short news.\nmore"
    # marked parts of a line, marked blocks closed out of order
    assert html_text.main_text('<article><p>one <span class="ad">buy</span> two</p></article>') == "one two"
    assert html_text.main_text('<article><p>one</p><span><div class="ad">buy</span><p>two</p></article>') == "one\ntwo"


def test_html_text_references_and_unmarked_lines_beside_the_article():
    story = _page("Title", "Words of the story " * 20)
    want = "Title\n" + ("Words of the story " * 20).strip()
    notes = "".join(f"<li><a href=x>Source {i}</a></li>" for i in range(5))
    listed = want + "".join(f"\nSource {i}" for i in range(5))
    assert html_text.main_text(f"<article>{story}<ol>{notes}</ol></article>") == listed
    assert html_text.main_text(f'<article>{story}<ul class="references">{notes}</ul></article>') == listed
    assert html_text.main_text(f"<article>{story}</article><ul>{notes}</ul>") == want
    before, after = "<div><p>Fri 3 Dec. All prices in USD.</p></div>", "<div><p>Call us on 555-1234</p></div>"
    assert html_text.main_text(f"{before}<article>{story}</article>{after}") == want
    # a long text beside a teaser is text all the same
    assert html_text.main_text(f"<div>{story}</div><article><p>Read this too</p></article>") == want + "\nRead this too"


@pytest.mark.parametrize("tag", ["div", "main"])
def test_html_text_beside_one_very_long_block(tag):
    lines = [f"{i} " + "short one " * 30 for i in range(6)]
    lines = [*lines, "x" * 20_000, *lines, "<a href=x>a linked line</a>", "after the link"]
    bare = [re.sub("<[^>]*>", "", x).strip() for x in lines]
    assert html_text.main_text(f"<{tag}>{_page(*lines)}</{tag}>") == "\n".join(bare)
    # a short paragraph after a list of links
    assert html_text.main_text(f"<{tag}>{_page(*lines, *LINKS, 'Thanks.')}</{tag}>") == "\n".join([*bare, "Thanks."])


def test_license_scan(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + "\n" + prose(rng, 90)) for i in range(300)]
    rows += [(1000, "x\nLicensed under the Apache License, Version 2.0.\ny"), (1001, "RELEASED UNDER THE MIT LICENSE."), (1002, None), (1003, "")]
    rows += [(1004, prose(rng, 70) + " This work is licensed under the GNU General Public License, version 3. " + prose(rng, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as family")
    got = {(r.doc_id, r.line, r.family) for r in license_scan.scan_licences(spark, df).collect() if r.confirmed}
    assert got == {(1000, 1, "apache-2.0"), (1001, 0, "mit"), (1004, 0, "gpl")}
    assert license_scan.scan_licences(spark, df.limit(0)).count() == 0


def test_license_scan_reads_wrapped_notices(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + "\n" + prose(rng, 90)) for i in range(300)]
    bsd, gpl, mit = (license_scan.TEMPLATES[k][i] for k, i in (("bsd", 0), ("gpl", 1), ("mit", 2)))
    above = prose(rng, 12) + "\n\n"
    rows += [
        (1000, above + bsd.replace("without modification", "without\nmodification")),
        (1001, above + gpl.replace("modify it", "modify\nit") + "\n\n" + prose(rng, 50)),
        (1002, "# " + "\n# ".join(textwrap.wrap(mit, 30))),
        (1003, prose(rng, 70) + "\n" + "\n".join(textwrap.wrap(bsd, 24)) + "\n" + prose(rng, 70)),
        (1004, bsd.replace("without modification", "without\n \nmodification")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.family) for r in license_scan.scan_licences(spark, df).collect() if r.confirmed)
    assert got == [(1000, 2, "bsd"), (1001, 2, "gpl"), (1002, 0, "mit"), (1003, 1, "bsd")]


def test_license_scan_returns_every_notice_of_a_line(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30) + "\n" + prose(rng, 90)) for i in range(300)]
    mit, gpl, bsd = license_scan.TEMPLATES["mit"][2], license_scan.TEMPLATES["gpl"][0], license_scan.TEMPLATES["bsd"][0]
    rows += [
        (1000, f"{mit} {prose(rng, 100)} {gpl} {prose(rng, 60)} {mit}"),
        (1001, "Licensed under the MIT License or the Apache License, Version 2.0."),
        (1002, f"{gpl} {bsd}"),
        (1003, "Licensed under CC BY-SA 4.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.first_word, r.last_word, r.family) for r in license_scan.scan_licences(spark, df).collect() if r.confirmed)
    assert got == [
        (1000, 0, 0, 19, "mit"), (1000, 0, 120, 131, "gpl"), (1000, 0, 192, 211, "mit"),
        (1001, 0, 0, 4, "mit"), (1001, 0, 0, 11, "apache-2.0"),
        (1002, 0, 0, 11, "gpl"), (1002, 0, 12, 32, "bsd"),
        (1003, 0, 0, 6, "cc-by-sa"),
    ]


def test_language_id_held_out(spark):
    from corpusforge.llm.q_language_id import op5_language_id

    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op5_language_id(spark, sf).join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_fits_a_family_model():
    rng = random.Random(7)
    stems = {"aa": "ba ce di fo", "ab": "ba ce di gu", "ac": "ba ce gu fo", "zz": "xo zu vi te"}
    rows = [(prose(rng, 40, stems[k].split()), k) for k in stems for _ in range(30)]
    model = language_id.fit(pa.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=object))
    assert len(model["top"]) == len(model["groups"]) > 1 and ["zz"] in [list(g) for g in model["groups"]]
    # likenesses in a chain: single link over the pairs above the mean joins all
    chain = {k: np.eye(5)[i] + np.eye(5)[i + 1] for i, k in enumerate("abcd")}
    assert len(language_id.families(chain)) > 1
    assert language_id.families({k: chain[k] for k in "ab"}) == [["a"], ["b"]]


def test_language_id_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("der hund lief", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 !?", None), (103, "Ω", None), (104, "the " * 100_000, None), (None, "the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "9 as score")
    model = language_id.fit_language_model(spark, df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(df, model).collect()}
    assert [got[k][0] for k in (0, 1, 100, 101, 102, 104, None)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert got[103][0] in ("en", "de") and got[100][1] == 0.0
    assert language_id.fit_language_model(spark, df.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify_language(df, None).collect()} == {"und"}


def test_quote_links(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine!"), (1, 2, "user", "ok"),
        (1, 3, "user", "> hello  there.\n> How are you?\n\nAn old one"), (1, 4, "assistant", ">> How are you?\n> Fine!\nGood"),
        (2, 0, None, None), (2, 5000, "user", "> nobody said this"), (None, 1, "user", "x"), (1, 2, "user", "ok"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as branch")
    got = {(r.conv_id, r.turn): (r.reply_to, r.linked_by, r.branch, r.text) for r in quote_links.link_conversations(spark, df).collect()}
    assert got == {
        (1, 0): (None, "first", 0, "Hello there.\nHow are you?"), (1, 1): (0, "quote", 0, "Fine!"), (1, 2): (1, "previous", 0, "ok"),
        (1, 3): (0, "quote", 3, "An old one"), (1, 4): (1, "quote", 4, "Good"), (2, 0): (None, "first", 0, ""),
        (2, 5000): (0, "previous", 0, ""), (None, 1): (None, "first", 1, "x"),
    }
    assert quote_links.link_conversations(spark, df.limit(0)).count() == 0


def test_quotes_in_code_and_unmatched(spark):
    rows = [
        (1, 0, "user", "how do I import it?"), (1, 1, "user", "so:\n```python\n>>> import os\n```\n> how do I import it?\nlike that"),
        (1, 2, "user", "> never said\n>> nor this\nstill"), (1, 3, "user", "~~~\n> open to the end"), (1, 4, "user", "> ```\n> quoted fence\nno \x01 mark"),
    ]
    got = quote_links.link_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.linked_by, r.text, r.unmatched) for r in got} == {
        0: ("first", "how do I import it?", ""), 1: ("quote", "so:\n```python\n>>> import os\n```\nlike that", ""),
        2: ("previous", "still", "> never said\n>> nor this"), 3: ("previous", "~~~\n> open to the end", ""),
        4: ("previous", "no  mark", "> ```\n> quoted fence"),
    }


def test_reply_order_against_walking_the_tree(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in [None, *range(6)]:
        n, step = rng.choice([1, 40, 90]), rng.choice([1, 300])  # 300: turns lie in many slices
        parent, branch, depth, heirs = {}, {}, {}, set()
        for i in range(n):
            t = i * step
            if conv == 0 and i:
                said = 0  # all reply to the first
            else:
                said = rng.randrange(i) if i and rng.random() < (0.6 if conv != 1 else 0.0) else None
            rows.append((conv, t, "user", f"word {i} of {conv}" if said is None else f"> word {said} of {conv}\n\nword {i} of {conv}"))
            parent[t] = (i - 1 if said is None else said) * step if i else None
            depth[t] = depth[parent[t]] + 1 if i else 0
            branch[t] = branch[parent[t]] if i and parent[t] not in heirs else t
            heirs.add(parent[t])
        place = {t: k for k, t in enumerate(sorted(branch, key=lambda t: (branch[t], t)))}
        want |= {(conv, t): (parent[t], branch[t], depth[t], place[t]) for t in branch}
    rng.shuffle(rows)
    got = quote_links.link_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.branch, r.depth, r.position) for r in got} == want


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://net/", "http://a.NET", "https://x.example.net/en/1?q#f", "https://example.net/en", "ftp://notexample.net/de/",
        "http://a.example.com/de/x", "http://example.org/fr/", "http://evil.com/x.net/y", "http://cheap-pills.example.com/en/", "http://" + "a" * 5000 + ".net/",
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [(r.host[:20], r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).orderBy("page_id").collect()]
    assert [g[2] for g in got] == [None, None, None, "net/", None, "example.net/en/", "net/", "net/", "example.com/de/", "org/fr/", None, None, "net/"]
    assert [g[3] for g in got] == ["allow"] * 3 + ["block", "allow", "allow", "block", "block", "block", "allow", "allow", "block", "block"]
    assert got[5][:2] == ("x.example.net", "/en/1") and got[4][0] == "a.net" and got[2][:2] == ("", "")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(6)
    texts = [None, "", "a b a b a b a b", "x\nx\n\ny\nx ", "  é\x0bü", "# * $", "the a the a the a " * 400]
    texts += [prose(rng, rng.randint(1, 300), ["a", "b", "ca"]) for _ in range(60)]
    texts += [". ".join(prose(rng, 12) for _ in range(12)) + "." for _ in range(120)]
    texts += [" ".join(w + "###" for w in prose(rng, 150).split()) for _ in range(8)]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "true as kept")
    out = quality.judge_quality(spark, df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.text_counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    kept = {r.doc_id for r in out if r.kept}
    assert set(range(67, 187)) <= kept and not kept & set(range(187, 195))
    assert quality.judge_quality(spark, df.limit(0)).count() == 0


def test_quality_em_recovers_known_rates(spark):
    rng = random.Random(8)
    truth = {r: ({1: 0.9 - 0.05 * k, 0: 0.02 + 0.01 * k}, {1: 0.3, 0: 0.65 - 0.04 * k}) for k, r in enumerate(quality.RULES)}
    for rates in truth.values():
        for side in rates:
            side[-1] = 1 - side[1] - side[0]
    drawn, n = [], 20_000
    for i in range(n):
        bad = i >= 0.7 * n
        drawn.append((bad, tuple(rng.choices((1, 0, -1), [truth[r][bad][v] for v in (1, 0, -1)])[0] for r in quality.RULES)))
    counts = Counter(v for _, v in drawn)
    table = spark.createDataFrame([(*v, c) for v, c in counts.items()], ", ".join(f"{r} int" for r in quality.RULES) + ", n long")
    model = quality.fit_votes(table.coalesce(1))
    assert abs(model["good"] - 0.7) < 0.02
    for r, rates in truth.items():
        for k in (0, 1):
            assert all(abs(model[r][k][v] - rates[k][v]) < 0.04 for v in (1, 0, -1)), (r, model[r])
    judged = {tuple(x[: len(quality.RULES)]): x.p for x in table.withColumn("p", quality.posterior(model)).collect()}
    right = sum((judged[v] >= 0.5) != bad for bad, v in drawn)
    # one vote against is not enough: some patterns with one are kept, and fewer documents would be judged right by asking for none
    assert any(p >= 0.5 and v.count(0) == 1 for v, p in judged.items())
    assert right > 0.95 * n > sum((0 not in v) != bad for bad, v in drawn)


def test_short_items_need_more(spark):
    rng = random.Random(8)
    items = [(1, "Yes"), (2, "He said yes"), (3, "The old mill burned down twice."), (4, "What is the capital city of old France now? Paris"), (5, prose(rng, 12) + ".")]
    say = [
        (10, "He said yes to the plan"), (11, "yes!"), (12, "He said yes, he said yes"), (13, "he said YES"), (14, prose(rng, 40) + " the old mill burned down twice " + prose(rng, 9)),
        (15, "The old mill burned twice and fell down"), (16, "what is the capital city of old france now I asked in the capital Paris"),
        (17, prose(rng, 70) + " what is the capital city of old france now Paris " + prose(rng, 50)), (18, items[4][1] + " " + prose(rng, 30)), (None, items[4][1]), (18, items[4][1] + " " + prose(rng, 30)),
        (19, " ".join(items[4][1].split()[:6])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark, spark.createDataFrame(say, "doc_id long, text string"), bench)
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted([(11, 1), (13, 2), (14, 3), (17, 4), (18, 5), (None, 5)], key=str)


def test_decontaminate(spark):
    rng = random.Random(7)
    items = [(i, ". ".join(prose(rng, 12) for _ in range(3)) + ".") for i in range(30)] + [(30, None), (31, ""), (3, "Yes")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as score")
    rows = [(i, prose(rng, 200)) for i in range(50)] + [(200, None), (201, "")]
    leak = {100: items[3][1], 101: items[4][1].upper(), 102: items[5][1].replace(" ", "\n")}
    rows += [(d, prose(rng, 333) + " " + t + " " + prose(rng, 91)) for d, t in leak.items()]
    rows += [(103, prose(rng, 50) + " " + " ".join(items[6][1].split()[:8]) + " " + prose(rng, 50)), (104, prose(rng, 30_000) + " " + items[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs, bench).collect()}
    assert got == {(100, 3), (101, 4), (102, 5), (104, 7)}
    assert decontaminate.contaminated(spark, docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(spark, docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_oracle(spark, key):
    r = compare(spark, key, registry.queries()[key], registry.oracle_sql()[key], SF)
    assert r["status"] == "match", r


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        sizes.append(kept.count())
        assert name == "mix" or kept.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    near = brute.near_components([r for r in rows if r[1] and any(c.isalpha() for c in r[1])], 5, 80)
    assert sizes[2] == sum(d == c for d, (_, c) in near.items())
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
