"""Page extraction and embeddings."""

import numpy as np
import pytest

from casewright.llm.embedding_dedup import codes_of, learn_rotation, near_duplicates
from casewright.llm.html_text import content_side, extract_pages, main_text

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no</p>';</script></head><body class='has-sidebar'>"
    "<header><h1>Site</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy now, it is cheap.</div>"
    "<article><header><h1>Head &amp; title</h1></header><p><b>First&nbsp;\n paragraph &lt;here&gt;.<br><p>Second <a href=x>linked</a> one.</p><aside>See also this.</aside>"
    "<p>Ti.</p><form><input>Mail <button>Go</button></form></article><div id='comments'><p>Great article, I liked it very much indeed.</p></div>"
    "<div class='cookie-notice'>We use cookies.</div><footer>&copy; 2024</footer></body></html>"
)


def test_article_without_the_rest():
    assert main_text(PAGE) == "Head & title\nFirst paragraph <here>.\nSecond linked one.\nTi."


@pytest.mark.parametrize("html", [None, "", "   ", "<p", "<<<>>>", "<script>x", "<nav>a</nav>", "</div></p>", "<!-- open", "&#xD800; &#0;"])
def test_pages_without_text_or_broken(html):
    assert isinstance(main_text(html), str)


def test_page_without_article():
    html = "<div class='main'><p>%s</p><p>Short.</p><p>%s</p></div><ul class=menu><li><a>A</a><li><a>B</a></ul>" % ("word " * 30, "text " * 25)
    assert main_text(html) == "\n".join([("word " * 30).strip(), "Short.", ("text " * 25).strip()])


def test_minimum_cut_against_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = 7
        source, sink = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(int(a), int(b), float(rng.random() / 2)) for a, b in rng.integers(0, n, (10, 2)) if a != b]

        def cut(side):
            return sum(source[i] for i in range(n) if not side[i]) + sum(sink[i] for i in range(n) if side[i]) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cut([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cut(content_side(source, sink, edges)) == pytest.approx(best)


def test_pages_of_a_table(spark):
    rows = [(1, "u", PAGE), (1, None, PAGE), (None, "v", None), (3, "w", ""), (4, "x", "<p>%s.</p>" % ("many words " * 20_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS key", "3 AS n_chars")
    out = extract_pages(pages).collect()
    assert [(r.page_id, r.url) for r in out] == [(r[0], r[1]) for r in rows]
    assert all(r.n_chars == len(r.text) for r in out) and out[4].n_chars == 220_001 and out[2].text == "" == out[3].text
    assert extract_pages(pages.limit(0)).collect() == []


def groups(rows):
    """n_links and component of each row by brute force."""
    ok, unit = [], []
    for i, (_, v, label) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.asarray(v, float)
        good = x is not None and label is not None and len(x) == 16 and np.isfinite(x).all() and x.any()
        ok.append(good)
        unit.append(x / np.linalg.norm(x) if good else None)
    parent, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and float(unit[i] @ unit[j]) >= 0.98:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    members = {}
    for i, (key, _, _) in enumerate(rows):
        members.setdefault(root(i), []).append(key)
    least = [min((k for k in members[root(i)] if k is not None), default=None) for i in range(len(rows))]
    return sorted(((repr(k), n[i], repr(least[i]), k == least[i]) for i, (k, _, _) in enumerate(rows)))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(300):
        v = centres[i % 30] + rng.normal(size=16) * (0.02 if i % 3 else 0.6)
        rows.append((int((i * 7919) % 1000), [float(np.float32(c)) for c in v], i % 2))
    v = rows[0][1]
    rows += [
        (5000, v, 0), (5000, v, 0), (None, v, 0), (5001, [2 * c for c in v], 0), (5002, v, None), (5003, None, 0), (5004, [0.0] * 16, 0), (5005, v[:9], 0),
        (5006, [float("nan"), *v[1:]], 0), (5007, [None, *v[1:]], 0), (5008, [float("inf"), *v[1:]], 0), (5009, [], 0), (5010, v, 7),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS row", "'x' AS node", "2 AS n")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in near_duplicates(df).collect())
    want = groups(rows)
    assert len(got) == len(want)
    links = lambda rows: sum(r[1] for r in rows)
    assert 0.95 * links(want) <= links(got) <= links(want)
    assert sum(a != b for a, b in zip(got, want)) <= len(want) // 20
    assert near_duplicates(df.limit(0)).collect() == []
    assert [r.n_links for r in near_duplicates(df.where("embedding IS NULL")).collect()] == [0]


def test_codes_of_close_vectors_are_close():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation = learn_rotation(x)
    y = x + rng.normal(size=x.shape) * 0.2 / 8
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = codes_of(x, rotation), codes_of(y, rotation)
    blocks = np.bitwise_count((a ^ b).view(np.uint16).reshape(-1, 4))
    close = (x * y).sum(axis=1) >= 0.98
    assert close.mean() > 0.3 and (blocks[close].min(axis=1) <= 1).mean() > 0.98
    ones = np.unpackbits(a.view(np.uint8)).reshape(len(a), -1).mean(axis=0)
    assert (abs(ones - 0.5) < 0.15).all()
