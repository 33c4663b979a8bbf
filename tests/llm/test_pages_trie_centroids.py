"""Main text of pages, prefix tries and centroid clusters: brute-force twins, SQL, and nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import html as H
import random
import re
import zlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegrid.llm import centroids, entry, html_text, prefix_trie
from tests.oracle import differences, duck

SF = "/root/testdata/sf0.001"


# 11
def test_pages_of_the_table_equal_a_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in entry.op11_ratio_content(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page.html, re.DOTALL)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[i].text == "\n\n".join(b for b in blocks if b) and got[i].n_chars == len(got[i].text) and got[i].url == page.url


STORY = "The river rose for three days before anyone in the valley thought of leaving it behind for good."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just  some\ttext", "just some text"),
        ("<script>var a = '<p>no</p>'</script><style>p{}</style>", ""),
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><main><h1>T &amp; U</h1><p>{STORY}<p>Ok.<ul><li>a<li>b&nbsp; c</ul></main><aside>{STORY}</aside><footer>{STORY}</footer>", f"T & U\n\n{STORY}\n\nOk.\n\na\n\nb c"),
        (f"<div class='cookie-notice'>{STORY}</div><article><header><h1>Title</h1><p>By me</p></header><p>{STORY}</p><div class='ad'><p>{STORY}</p></div><form><label>Mail</label><input></form><p>End</p><footer>tags</footer></article>", f"Title\n\n{STORY}\n\nEnd"),
        (f"<article><p>{STORY}</p></article><section id='comments'><article><p>{STORY} {STORY}</p></article><article><p>{STORY}</p></article></section>", STORY),
        (f"<div id=top><a href=/>One</a> <a href=/>Two</a></div><div class=post><h1>Title</h1><p>{STORY}</p><p>{STORY}</p><p>Short.</p></div><div class=sidebar><p>{STORY}</p></div><div><a href=/>Next page of this</a></div>", f"Title\n\n{STORY}\n\n{STORY}\n\nShort."),
        (f"<nav><a href=/>unclosed menu<article><p>{STORY}</p></article>", STORY),
        (f"<article><p>a<br>b <b>c</b>d<span class=ad>x</span> <span hidden>y</span>e</p><!-- <p>no</p> --><![if IE]><p>{STORY}</p></article>", f"a b cd e\n\n{STORY}"),
        (f"<form action=/><div><h1>Hm</h1><p>{STORY}</p><p>{STORY}</p></div></form>", f"Hm\n\n{STORY}\n\n{STORY}"),
        ("<div class=ad>Buy</div><footer>us</footer>", ""),
        (f"<article><p>{STORY} one</p></article><article><p>{STORY}</p></article>", f"{STORY} one"),
        (f"<main><article><p>{STORY} one</p></article><article><p>{STORY} two</p></article></main>", f"{STORY} one\n\n{STORY} two"),
        (f"<div role=banner><h1>Site</h1></div><div role=main><h1>T</h1><p>{STORY}</div></div><div class='side-column'><p>{STORY}</div><div class=cookieBar>{STORY}</div>", f"T\n\n{STORY}"),
        (f"<body><div id=wrap><div class=title><h1>T</h1></div><div class=text><p>{STORY}</p></div><div class=note><p>Short.</p></div><ul><li><a href=/>See this</a><li><a href=/>and that</a></ul><div class=text><p>{STORY}</p></div></div><div class=links><a href=/>a</a> <a href=/>b</a></div>", f"T\n\n{STORY}\n\nShort.\n\n{STORY}"),
        (f"<article><p>{STORY}</p><section aria-label=Comments><p>{STORY} {STORY}</p></section></article>", STORY),
        (f"<table><tr><td class=menu><a href=/>x</a><td><p>{STORY}<p>End.</table>", f"{STORY}\n\nEnd."),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><button>no</button><p>d</article><p>e", "a\n\nb\n\nc\n\nd"),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "u", f"<article><p>{STORY}</p></article>"), (1, "u", f"<article><p>{STORY}</p></article>"), (None, None, None), (2, None, "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    got = sorted(html_text.extract(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", len(STORY)), (1, "u", len(STORY)), (2, None, 999_999), (None, None, 0)]
    assert html_text.extract(df.limit(0)).collect() == []


# 12
def test_trie_equals_sql(spark):
    assert differences(entry.op12_prefix_trie(spark, SF), entry.ORACLE_SQL["op12_prefix_trie"], duck(SF)) == []


def _turns(rows):
    """(conv_id, turn, role, text) to each conversation's rebuilt turns."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:]
    return out


def _trie(rows):
    convs = _turns(rows)
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in under)
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in under)
        children = sum(len(q) == len(path) + 1 for q in under)
        out.append((min(members), len(path), parent, len(members), children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def _conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(130, 190), *range(-130, -90)]:
        n = rng.choice([0, 1, 2, 3, 5, 9])
        kind = rng.choice(["same", "same", "own"])
        rows += [(c, t if t != 2 or c % 7 else None, rng.choice(["user", None]) if kind == "own" else "user", [f"turn {t} é", "", None][t % 3] if kind == "same" else f"turn {t} of {c % 4}") for t in range(n)]
    return rows + rows[:5] + [(None, 1, "a", "b")]


@pytest.mark.parametrize(("shares", "most", "queue"), [(256, 100_000, 200_000), (4, 100_000, 2), (256, 0, 3), (2, 3, 1)])
def test_trie_equals_brute_force(spark, shares, most, queue):
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"key": F.lit(1), "depth": F.lit(2), "n_convs": F.lit("x")})
    assert sorted(tuple(r) for r in prefix_trie.trie(df, shares, most, queue).collect()) == _trie(rows)
    assert prefix_trie.trie(df.limit(0)).collect() == []


def test_hash_of_many_ends_is_pieced_together(spark):
    """One node takes all conversations; its ids go through many parts and pieces."""
    df = spark.range(5000).select(F.col("id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    want = collections.defaultdict(list)
    for c, turns in _turns([(c, 0, "user", "hello") for c in range(5000)]).items():
        want[len(turns)].append(c)
    steps = prefix_trie.paths(df)
    got = {r.sha for r in prefix_trie.ends(steps, most=100).collect()}
    assert got == {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in want.values()}


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, plain, out = prefix_trie.SpillingQueue(8), [], []
    for step in range(2000):
        if rng.random() < 0.6:
            item = (rng.randrange(50), bytes([rng.randrange(4)]), step % 3, 0)
            queue.push(item)
            plain.append(item)
        elif plain:
            plain.sort()
            assert queue.peek() == plain[0]
            out.append(queue.pop() == plain.pop(0))
    assert all(out) and queue.spilled > 100


# 13
def test_clusters_equal_sql(spark):
    assert differences(entry.op13_threshold_centroids(spark, SF), entry.ORACLE_SQL["op13_threshold_centroids"], duck(SF)) == []


@pytest.mark.parametrize("large", [False, True])
def test_nearest_equals_all_distances(large):
    rng = np.random.default_rng(2)
    c = rng.integers(-5, 6, (8, 6))
    c[5] = c[2]
    v = np.concatenate([rng.integers(-6, 7, (300, 6)), c])
    if large:
        v, c = v.astype(object) * 2**70, c.astype(object) * 2**70
    want = [min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(c.tolist())) for x in v.tolist()]
    number, best, computed = centroids.nearest(v, c)
    assert list(zip(best.tolist(), number.tolist())) == want and computed <= len(v) * 8


def test_walk_stops_before_distant_centroids():
    c = np.arange(8)[:, None] * np.full((8, 64), 1000)
    v = c[np.arange(800) % 8] + np.random.default_rng(1).integers(-20, 20, (800, 64))
    number, _, computed = centroids.nearest(v, c)
    assert number.tolist() == [i % 8 for i in range(800)] and computed < 800 * 4


def _cluster(rows, k, rounds, dims):
    kept = [(i, [floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        which = [near(v)[1] for _, v in kept]
        at = [[sum(x) // len(x) for x in zip(*mine)] if (mine := [v for (_, v), w in zip(kept, which) if w == n]) else c for n, c in enumerate(at)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, n in found:
        inertia[n] += d
    top = 2**63 - 1
    return sorted(((i, n, min(d, top), min(inertia[n], top), min(sum(inertia.values()), top), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, d, n in found), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e30])
def test_clusters_equal_brute_force(spark, scale):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.choice([-1, 1]) * scale + rng.random())) for _ in range(4)]) for i in range(60)]
    rows += [rows[0], rows[0], (None, [1.0] * 4), (70, None), (71, [1.0] * 3), (72, [float("nan")] * 4), (73, [1.0, None, 1.0, 1.0]), (74, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit(1), "cluster": F.lit("x"), "distance": F.lit(2)})
    for k in (3, 8):
        assert sorted((tuple(r) for r in centroids.cluster(df, k=k, dims=4).collect()), key=str) == _cluster(rows, k, 10, 4)
    assert len(centroids.cluster(df.where("vec_id in (1, 2)"), dims=4).collect()) == 2
    assert centroids.cluster(df.limit(0), dims=4).collect() == []
