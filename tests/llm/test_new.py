"""Fill-in-middle, spelling variants and main text of pages: brute force, small cases and edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from html import unescape
from itertools import product

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import fill_middle, html_extract, spelling
from fieldtrace.llm import queries as Q
from fieldtrace.llm.common import Scratch

SF = "/root/testdata/sf0.001"
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", "char": r"(?s)."}
#: Null, empty, only line ends, no end, sentinels, parts of sentinels, equal rows, a null id; `form` and `cut` are names used inside.
TEXTS = [None, "", "\n", "\n\n\n", "no end", "a\nb", "a\nb\n", "x <S> y\nz", "ends in <\nS> and <P\n>", "𝔘nicode\r\nnaïve\x0b\x85 tail\n", "same\nrow\n", "same\nrow\n", " lead  and trail \n ", "long line\n" * 20000]
ROWS = [(i if i != 4 else None, t, "mine", i) for i, t in enumerate(TEXTS)]
ROWS[11] = (10, *ROWS[11][1:])


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, form string, cut long")


# --- fill-in-middle -----------------------------------------------------------------------------------------------


def filled(doc_id, text, pattern, rate=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = [m[0] for m in re.finditer(pattern, text)]
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    p, s, m = marks
    form = "spm" if h4 % 100 < spm else "psm"
    return len(units), form, len(a), len(b), s + c + p + a + m + b if form == "spm" else p + a + s + c + m + b


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_middle_query_equals_the_rule_on_every_document(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = Counter()
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        n, form, a, b, out = filled(d, t, UNITS["line"])
        want[(d, n, form, a, b, sha(out), sha(t or ""))] += 1
    got = Q.op11_fill_middle(spark, SF)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {k[2] for k in want} >= {"psm", "spm"}


@pytest.mark.parametrize("unit", list(UNITS))
@pytest.mark.parametrize(("rate", "marks"), [(100, ("<P>", "<S>", "<M>")), (60, ("[[pre]]", "[[suf]]", "[[mid]]"))])
def test_fill_middle_units_edge_rows_and_restoring(spark, edge, unit, rate, marks):
    done, names = fill_middle.transform(edge, unit=unit, rate=rate, sentinels=marks)
    assert done.columns == ["doc_id", "text", "form", "cut", *names] and names[1] == "_form"
    want = Counter((r[0], r[3], *filled(r[0], r[1], UNITS[unit], rate, marks=marks)) for r in ROWS)
    assert Counter(tuple(r) for r in done.select("doc_id", "cut", *names).collect()) == want
    back = done.select("text", fill_middle.restore(F.col(names[4]), F.col(names[1]), marks).alias("back"))
    assert all((r.text or "") == r.back for r in back.collect())


def test_fill_middle_of_nothing_and_bad_options(spark, edge):
    assert fill_middle.digests(edge.filter("false")).collect() == []
    for marks in [("<a", "a>", "x"), ("aba", "x", "y"), ("<P>", "<P>", "<M>"), ("", "x", "y"), ("<PS>", "PS", "M")]:
        with pytest.raises(ValueError, match="sentinel"):
            fill_middle.transform(edge, sentinels=marks)
    with pytest.raises(ValueError, match="unit"):
        fill_middle.transform(edge, unit="page")


# --- spelling variants --------------------------------------------------------------------------------------------


def brute_words(docs, drop=199, least=5):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, factor=5):
    near = {w: [] for w in words}
    by_deletion = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_deletion.setdefault(v, []).append(w)
    for held in by_deletion.values():
        for a in held:
            near[a] += [b for b in held if b != a and one_edit(a, b)]
    form, out = {}, {}
    for w, n in words.items():
        best = min(set(near[w]), key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(set(near[w])), words.get(form[w]))
    return out


def test_spelling_query_equals_brute_force(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_groups(brute_words(zip(docs.doc_id, docs.text, strict=True)))
    got = Q.op12_spelling(spark, "/root/testdata/sf0.01")
    assert {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == want
    assert sum(x[1] is not None for x in want.values()) > 10 and any(x[4] > 3 for x in want.values())


def test_spelling_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(Q.SQL["op12_spelling"])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, Q.op12_spelling(spark, SF).select(*names).collect())) == Counter(want.fetchall())


@pytest.mark.parametrize("pairs", [1, 8, 4096])
def test_hot_segments_are_cut_further_without_losing_pairs(spark, pairs):
    rnd = random.Random(pairs)
    stems = ["prefix", "präfixe", "aaaaaa", "ababab"]
    made = {s + "".join(rnd.choices("abß", k=rnd.randint(0, 5))) for s in stems for _ in range(60)}
    made |= {"".join(rnd.choices("abß", k=rnd.randint(0, 4))) + s for s in stems for _ in range(60)}
    words = {w: 5 ** rnd.randint(1, 5) for w in made if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    scratch = Scratch(spark)
    found = [(r.word, r.other) for r in spelling.near(df, scratch, pairs).collect()]
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    scratch.drop()
    want = brute_groups(words)
    assert {r.word: (r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(df, 5, pairs).collect()} == want
    assert max(sum(1 for _ in iter(lambda w=[x]: w.__setitem__(0, want[w[0]][1]) or w[0], None)) for x in words) >= 2  # chains of forms


def test_spelling_edge_rows(spark):
    rows = [(None, "Übergang übergang ÜBERGANG", 1), (1, None, 2), (2, "", 3), (3, "short words only", 4), (4, "Wörter×Zeichen÷ " * 30000, 5), (4, "repeat repeat " * 3, 6), (4, "repeat repeat " * 3, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long")
    want = brute_words([r[:2] for r in rows], drop=3, least=2)
    got = spelling.count(spelling.runs(docs, 3), 2)
    assert {r.word: r.n for r in got.collect()} == want and len(want) == 2
    for nothing in (docs.filter("false"), docs.filter("doc_id = 1")):
        done = spelling.group(spelling.count(spelling.runs(nothing, 199), 5), 5)
        assert done.collect() == [] and set(done.columns) == {"word", "form", "root", "n", "n_near", "form_n"}


# --- main text of pages -------------------------------------------------------------------------------------------


def cut_value(terminal, edges, side):
    return sum(-v if s and v < 0 else v if not s and v > 0 else 0 for v, s in zip(terminal, side, strict=True)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])


@pytest.mark.parametrize("seed", range(60))
def test_minimum_cut_equals_all_labellings(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 9)
    terminal = [rnd.randint(-9, 9) for _ in range(n)]
    edges = {(a, b): rnd.randint(0, 7) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5}
    side = html_extract.min_cut(terminal, edges)
    best = min(cut_value(terminal, edges, s) for s in product([False, True], repeat=n))
    assert cut_value(terminal, edges, side) == best
    # Ties go to boilerplate: no other best labelling has fewer nodes of content.
    assert sum(side) == min(sum(s) for s in product([False, True], repeat=n) if cut_value(terminal, edges, s) == best)


def test_main_text_query_equals_the_articles(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    want = {}
    for p, u, h in zip(pages.page_id, pages.url, pages.html, strict=True):
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        text = "\n".join(x for x in parts if x)
        want[p] = (p, u, text, len(text))
    assert {r.page_id: tuple(r) for r in Q.op13_html_extract(spark, SF).collect()} == want


P1 = "The council voted on Tuesday to close the old bridge for repairs that will take at least two years."
P2 = "Residents have complained, because the detour adds twenty minutes to the way into town."
P3 = "It was time."
C1 = "I think that this is a terrible idea, and everybody that I know in town agrees with me on this."
SAYS = "You will never find a better offer than this one, so buy it now from our own shop in town."
LINKS = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(6))
LAYOUTS = {
    "sections": (
        f'<html><body class="home has-sidebar comments-open"><header><h1>Daily News</h1><p>{SAYS}</p></header><nav><ul>{LINKS}</ul></nav><main><article><h1>Bridge closes</h1><p>{P1}</p>'
        f'<div class="ad">{SAYS}</div><p>{P2}</p><p>{P3}</p><aside>{SAYS}</aside></article><section id="comments"><h2>2 comments</h2><article class="comment"><p>{C1}</p></article></section></main>'
        f'<aside class="sidebar"><p>{SAYS}</p></aside><footer><p>{SAYS}</p></footer></body></html>',
        ["Bridge closes", P1, P2, P3],
    ),
    "divisions": (
        f'<div id="wrapper"><div id="header"><a href="/">Site</a> <span>{SAYS}</span></div><div class="menu">{LINKS}</div><div id="cookie-notice">{SAYS}<button>OK</button></div><div id="content"><h1>Bridge closes</h1><p>{P1}</p>'
        f'<p>{P2}</p><p>{P3}</p><div id="comments"><h3>Comments</h3><p>{C1}</p></div></div><div id="sidebar"><h3>Popular</h3><ul>{LINKS}</ul><p>{SAYS}</p></div><form><label>{SAYS}</label><input></form><div id="footer">{SAYS}</div></div>',
        ["Bridge closes", P1, P2, P3],
    ),
    "no classes": (f"<body><table><tr><td><ul>{LINKS}</ul></td><td><font><p>{P1}<p>{P2}<p>{P3}</font></td></tr></table><p><a href=1>Contact</a> | <a href=2>Terms</a></p></body>", [P1, P2, P3]),
    "parts": (f"<article><h1>Title</h1><p>{P1}</p><h2>What to do</h2><ul><li>Bring water</li><li>Bring <a href=x>maps</a></li></ul><blockquote>{P2}</blockquote><pre>a  b\n c</pre></article>", ["Title", P1, "What to do", "Bring water", "Bring maps", P2, "a b c"]),
    "own header": (f'<article class="post comments-open"><header class="entry-header"><h1 class="entry-title">Bridge closes</h1></header><div class="entry-content"><p>{P1}</p></div><footer>Tags: <a>bridge</a></footer></article>', ["Bridge closes", P1]),
    "upper case, references, raw text": (
        f"<BODY><DIV CLASS=ad>{SAYS}</DIV><ARTICLE><P>{P1}<P>a &lt; b &amp;amp; c&nbsp;&nbsp;d &eacute;&#233;&#xE9;<BR>next 1 < 2<P>{P2}</ARTICLE><!-- <p>no</p> --><SCRIPT>if (a<b) write('<p>{SAYS}</p>')</SCRIPT><noscript><p>{SAYS}</p></noscript></BODY>",
        [P1, "a < b &amp; c d ééé next 1 < 2", P2],
    ),
    "hidden and roles": (f'<div role="navigation"><p>{SAYS}</p></div><div style="display: none"><p>{SAYS}</p></div><div role="main"><p>{P1}</p><p hidden>{SAYS}</p></div><div aria-hidden="true">{SAYS}</div>', [P1]),
    "a form around the page": (f'<form id="aspnetForm"><div id="main"><h1>Bridge closes</h1><p>{P1}</p></div></form>', ["Bridge closes", P1]),
    "unterminated": (f"<article><p>{P1}</p><p>{P2}<b title='x>y'> end<!-- <p>{SAYS}", [P1, P2 + " end"]),
    "menu only": (f"<nav><ul>{LINKS}</ul></nav>", []),
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert [t for t, _, kept in html_extract.labelled(page) if kept] == want


def test_a_short_line_goes_with_its_neighbours():
    alone = html_extract.labelled("<div><p>It was</p></div>")
    among = html_extract.labelled(f"<div><p>{P1}</p><p>It was</p><p>{P2}</p></div>")
    assert [k for *_, k in alone] == [False] and [k for *_, k in among] == [True, True, True]


def test_pages_edge_rows(spark):
    page = LAYOUTS["sections"][0]
    rows = [(1, None, "x"), (2, "", "x"), (3, page, "x"), (3, page, "x"), (None, "<p>" + P1, "x"), (5, "no markup at all, but quite a long sentence all the same.", "x"), (6, "<article>" + f"<p>{P1}</p>" * 40000, "x"), (7, "<div>" * 30000 + P1, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    done = html_extract.extract(df)
    assert done.columns == ["page_id", "html", "text", "_text", "blocks"]
    got = Counter((r.page_id, r._text) for r in done.collect())
    four = "\n".join(["Bridge closes", P1, P2, P3])
    assert got == Counter([(1, ""), (2, ""), (3, four), (3, four), (None, P1), (5, rows[5][1]), (6, "\n".join([P1] * 40000)), (7, P1)])
    assert html_extract.extract(df.filter("false")).collect() == []


# --- the pipeline as a whole --------------------------------------------------------------------------------------


def test_pipeline_runs_over_edge_rows_and_over_nothing(spark, tmp_path):
    import corpus_pipeline

    prose = [" ".join(f"{a}{i * 7 % 31}" for i, a in enumerate("the river runs down to the old mill where nobody has been for many years now".split() * 6)).replace("3", chr(97 + k)) for k in range(8)]
    rows = [(i, f"Document {i} speaks of this.\n{p} of {i}", "en", "a" if i % 2 else "b", 0) for i, p in enumerate(prose)]
    rows += [(100, None, "en", "a", 0), (101, "", None, None, 0), (102, rows[0][1], "en", "a", 0), (0, rows[0][1], "en", "b", 0), (103, rows[1][1], None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = [(i, 1, 0) for i in range(8)]
    for name, data, kind in (("documents", rows, schema), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/full/{name}.parquet")
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    done = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    kept = {r.doc_id for r in done}
    # Null and empty texts go; all that are left come through, more than once where their source asks for it.  The line
    # stage takes all lines of later copies, which then have an empty text.
    assert set(range(8)) <= kept <= set(range(8)) | {102, 103}
    assert all((r.n_tokens > 50) == (r.doc_id < 8) for r in done)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


# --- blocks of linked vectors -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "ring"), [(8, 0.01), (5, 0.2), (1000, 0.01)])
def test_links_of_blocks_equal_all_pairs(spark, monkeypatch, block, ring):
    import numpy as np

    from fieldtrace.llm import nn_descent

    monkeypatch.setattr(nn_descent, "BLOCK", block)
    monkeypatch.setattr(nn_descent, "RING", ring)
    rng = np.random.default_rng(block)
    groups = [rng.normal(0, spread, (n, 6)) + rng.normal(0, 1, 6) for n, spread in ((70, 0.02), (60, 0.2), (40, 0.8), (7, 0.1), (1, 0.1))]
    groups.append(np.vstack([np.eye(6)[:1], -np.eye(6)[:1]] * 6) * rng.uniform(1, 2, (12, 1)))  # the mean has no direction
    rows, want = [], {}
    for root, m in enumerate(groups):
        copies = rng.integers(1, 4, len(m))
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        linked = unit @ unit.T >= 0.93
        np.fill_diagonal(linked, False)
        for i, v in enumerate(m):
            node = root * 1000 + i
            rows.append((root, node, int(copies[i]), bytearray(v.astype(np.float64).tobytes())))
            want[node] = int(linked[i] @ copies)
    df = spark.createDataFrame(rows, "root long, node long, copies long, v binary").repartition(3)
    got = {r.node: r.links for r in nn_descent.block_links(df, 0.93).collect()}
    assert {n: got.get(n, 0) for n in want} == want


def test_places_of_keys():
    import numpy as np

    from fieldtrace.llm.context_tree import Places

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 40000):
        keys = rng.permutation(np.unique(rng.integers(0, 1 << 48, n)))
        asked = rng.integers(0, len(keys), 3 * n) if n else np.zeros(0, np.int64)
        assert np.array_equal(Places(keys).find(keys[asked]), asked)
    with pytest.raises(KeyError):
        Places(np.array([1, 2, 3])).find(np.array([2, 4]))
