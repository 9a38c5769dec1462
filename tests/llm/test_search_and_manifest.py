"""Page extraction, Merkle manifest, ranked search: against brute force, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import htmltext, merkle, treap

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- pages

PARA = "The committee met on Tuesday to go over the plans for the new bridge, and most of its members were in favour of them."


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("<p>", ""), ("Just &lt;plain&gt; text\n\n on  lines", "Just <plain> text on lines"),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>A&amp;B</h1><p><b>{PARA}<br><p>Short.</article><footer>&copy; us</footer>", f"A&B\n{PARA}\nShort."),
        (f"<header><h2>Site</h2></header><main><header><h1>Title</h1></header><p>{PARA}</p><aside>Side {PARA}</aside><p>x&nbsp;&eacute;</p><form>Mail <input></form></main>", f"Title\n{PARA}\nx é"),
        (f"<div id='content'><h1>Top</h1><p>{PARA}</p><p>Yes.</p><p>{PARA} Again.</p></div><div class='comments'><p>{PARA} I agree!</p></div>", f"Top\n{PARA}\nYes.\n{PARA} Again."),
        (f"<div class='cookie-notice'>{PARA}</div><div><div><p>{PARA} One.</p><p>{PARA} Two.</p></div></div><div class='sideBar'>{PARA}</div>", f"{PARA} One.\n{PARA} Two."),
        (f"<article><p>{PARA} <span class=ad>Buy now</span>End.</p><script>if (a < b) '</p>'</script><style>p{{}}</style><!-- {PARA} --><div class='related'>More</div></article>", f"{PARA} End."),
        (f"<article><p>{PARA}</p><section id=comments><article><p>{PARA} Comment.</p></article></section></article>", PARA),
        (f"<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><div><p>{PARA}</p><ul><li>First<li>Second</ul><p>{PARA}</p></div>", f"{PARA}\nFirst\nSecond\n{PARA}"),
        (f"<article><table><tr><td>a<td>b<tr><td>c</table><blockquote>{PARA}</blockquote></div></p></article>Trailing", f"a\nb\nc\n{PARA}"),
        (f"<body class='sidebar-left'><div class='has-sidebar content'><article class='post share-bar'><p>{PARA}</p></article></div><div class='no_js comments'><p>{PARA}</p></div></body>", PARA),
        ("<article><p>A</p></article>", "A"), ("<nav>Only a menu</nav>", ""), ("<article><h1>Unclosed <em>title</h1>tail", "Unclosed title\ntail"),
    ],
)
def test_main_text(html, want):
    assert htmltext.main_text(html) == want


def test_smoothing_and_cluster():
    assert htmltext.smoothed([3.0] * 7) == pytest.approx([3.0] * 7)
    assert htmltext.smoothed([0, 0, 1, 0, 0])[2] > htmltext.smoothed([0, 0, 1, 0, 0])[1] > 0
    lines = [htmltext.Line("x" * n, 1, 0, False, 0, False) for n in (5, 5, 5, 5, 200, 210, 190, 205, 5, 5, 5, 5)]
    assert [k for k, c in enumerate(htmltext.cluster(lines)) if c][0] in (3, 4)
    assert not htmltext.cluster(lines)[0] and not htmltext.cluster(lines)[-1]


def test_pages_with_odd_rows(spark):
    long = "<article>" + f"<p>{PARA}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 7), (1, "u", None, 7), (None, None, long, 0), (3, "v", "<article>é😀</article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text): r for r in htmltext.extract(pages).collect()}
    assert htmltext.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert got[3, "é😀"].n_chars == 2 and (1, "") in got and (None, "\n".join([PARA] * 20_000)) in got
    assert htmltext.extract(pages).count() == 4 and htmltext.extract(pages.limit(0)).count() == 0


# ---- manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves):
    """Root and, for each leaf, its list of (left, right) siblings, by going through the levels."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place // 8 * 8
            run = nodes[first : first + 8]
            paths[k].append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
            at[k] = place // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute_manifest(rows):
    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        by_lang[lang].append((doc_id is not None, doc_id or 0, leaf_of((doc_id, source, lang, n, text)), doc_id, text, source, n))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree_of([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs}
    root, upper = tree_of([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for x, path in zip(sorted(by_lang[lang], key=lambda x: x[:3]), trees[lang][1]):
            _, _, leaf, doc_id, text, source, n = x
            path, cur = path + upper[k], leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                cur = leaf_of((doc_id, source, lang, n, lower))
            for left, right in path:
                cur = sha(left + cur + right)
            out.append((doc_id, leaf, trees[lang][0], root, sha("".join(a + b for a, b in path)), cur, cur == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 130, "de": 64, "": 3, None: 8, **{f"l{k}": 1 + k % 3 for k in range(9)}}])
def test_manifest_against_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)
    rng, rows = random.Random(5), []
    for lang, n in sizes.items():
        rows += [(rng.randrange(10**9), rng.choice(["Été A", "plain text", "", None, "X" * 3000]), lang, rng.choice(["s", None]), rng.choice([3, None])) for _ in range(n)]
    if len(rows) > 100:
        rows += [(None, "NULL id", "en", "s", 1), (None, None, "en", None, None), rows[0], rows[0], rows[0]]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit("clash"))
    got = sorted((tuple(r) for r in merkle.verify_tampered(df).collect()), key=repr)
    assert got == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.verify_tampered(spark.createDataFrame([], DOCS)).count() == 0


# ---- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, queries, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(n))


@pytest.mark.parametrize("block,batch,query_terms", [(4096, 256, 200_000), (7, 3, 200_000), (64, 16, 60)])
def test_search_against_brute_force(spark, block, batch, query_terms, monkeypatch):
    for name, value in (("BLOCK_DOCS", block), ("BATCH", batch), ("QUERY_TERMS", query_terms), ("PIECE", 50), ("MERGE_TASKS", 2 if block == 7 else 1024)):
        monkeypatch.setattr(treap, name, value)
    rng = random.Random(11)
    docs = [(i, words(rng, rng.randrange(1, 80))) for i in range(400)] + [(500 + i, "W1, w2! w3?") for i in range(40)] + [(None, "w1 w2"), (None, "w1 w2"), (2**60 + 1, "w1 w2 w2"), (7, None), (8, ""), (9, " -- "), (10, "Été w1 " * 500), (11, words(rng, 20_000))]
    queries = [(q, words(rng, rng.randrange(1, 30))) for q in range(25)] + [(3, "w1 w1 w2"), (None, "été w5"), (90, None), (91, "unheard"), (92, "?")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    b = spark.createDataFrame(queries, "item_id long, text string").withColumn("item", F.lit("x"))
    got = sorted((tuple(r) for r in treap.top_documents(d, b).collect()), key=repr)
    assert got == brute_search(docs, queries, 20)


def test_search_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap.top_documents(d.limit(0), b).count() == 0 and treap.top_documents(d, b.limit(0)).count() == 0
    assert treap.top_documents(d, b).columns == ["item_id", "rank", "doc_id", "score"]


def test_grid_opens_few_cells(monkeypatch):
    """Best-first search over a block with one strong column opens few of its ranges, and finds the same as a whole pass."""
    rng = np.random.default_rng(2)
    rows, cols = np.nonzero(rng.random((60, 2048)) < 0.2)
    values = rng.integers(1, 100, len(rows))
    values[cols == 77] = 5000
    grid, own, weights = treap.Grid(rows, cols, values), np.arange(0, 60, 7), np.arange(1, 10, dtype=np.int64)
    whole = np.zeros((60, 2048), np.int64)
    whole[rows, cols] = values
    scores = weights @ whole[own]
    for k in (1, 20):
        col, score = grid.best(own, weights, k, 1)
        want = np.lexsort((np.arange(2048), -scores))[:k]
        assert (col == want).all() and (score == scores[want]).all()
