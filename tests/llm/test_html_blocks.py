import numpy as np
import pytest

from kindred.llm import html_blocks as hb

WORDS = "river stone winter market letter garden summer bridge window paper".split()


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n)).capitalize() + "."


def page(i, article="article", ad="div class=\"ad\""):
    body = [prose(4, 100 * i)] + [prose(20 + 5 * j, 100 * i + j + 1) for j in range(2 + i % 4)]
    html = (
        f"<!DOCTYPE html><html><head><title>{prose(3, i)}</title><script>var t = \"</p>\";</script></head><body><nav><ul>"
        + "".join(f"<li><a href=/{j}>{WORDS[j]}</a></li>" for j in range(1 + i % 6))
        + f"</ul></nav><{ad}>{prose(6, 5000 + i)}</{ad.split()[0]}><{article}><h1>{body[0]}</h1>"
        + "".join(f"<p>{b}" for b in body[1:]) + f"</{article.split()[0]}><footer>&copy; {prose(5, i)}</footer>"
    )
    return html, "\n\n".join(body)


def test_pages(spark):
    made = [page(i) for i in range(80)]
    odd = [(900, None), (901, ""), (902, "<p"), (903, "<" * 5000), (904, "<div>" * 3000 + "x")]
    rows = [(i, "http://a", h, "t", 1) for i, (h, _) in enumerate(made)] + [(i, None, h, None, 1) for i, h in odd] + [(0, "http://a", made[0][0], "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    spec = hb.Labeller(steps=200, pages=60)
    got = hb.extract(df, spec).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert np.mean([by[i].text == t for i, (_, t) in enumerate(made)]) > 0.95
    assert all(by[i].text == "" for i in (900, 901, 902))
    assert hb.extract(df.limit(0), spec).count() == 0


@pytest.mark.parametrize("source, want", [
    ("<p>a &amp b&nbsp;&#233;<p>c\n d<br>e", ["a & b é", "c d e"]),
    ("<p>x<script>if (a < b) { '</p>' }</script>y<style>p{}</style><!-- <p>no --></p>z <b>w", ["xy", "z w"]),
    ("<ul><li>1<li>2</ul>3 < 4<select><option>no</select>", ["1", "2", "3 < 4"]),
    ('<a title="a > b">t</a><img alt="x"/>u<p', ["tu"]),
])
def test_blocks(source, want):
    assert [b.text for b in hb.blocks(source)] == want


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><meta charset=utf-8><link rel=x><body><p>a<p>b", ["a", "b"]),
    ("<head><title>t</title><script>s</script><p>a</p>b", ["a", "b"]),
    ("<head><title>t</title> a <b>b</b>", ["a b"]),
    ("<head><style>s</style></head><body>a", ["a"]),
    ("<head><title>t</title><button>no</button>a", ["a"]),
    ("<p>a<svg><g><text>no</text><p>b", ["a", "b"]),
    ("a<svg><foreignObject><p>no</p></foreignObject></svg><p>b", ["a", "b"]),
    ("a<select><option>no<input>b<button>no<button>no</button>c", ["abc"]),
])
def test_silent_elements_that_are_not_closed(source, want):
    assert [b.text for b in hb.blocks(source)] == want


@pytest.mark.parametrize("inner", ["<div>", "<table><tr><td>", "<font><b>"])
def test_names_and_links_above_thirty_levels(inner):
    text = prose(40, 1)
    for name, good in (("section class=comments", False), ("article", True)):
        found = hb.blocks(f"<body><{name}>" + inner * 30 + f"{text}</{name.split()[0]}><p>after")
        assert hb.weak_label(found[0]) == good and {"section", "article"} & set(found[0].path)
        assert not {"section", "article", ".comments"} & set(found[1].path)
    found = hb.blocks("<a href=/x>" + "<span>" * 30 + text + "</a><p>after<p><a name=top>" + text)
    assert [b.linked for b in found] == [1.0, 0.0, 0.0]


def test_gradients_equal_differences():
    spec = hb.Labeller(hidden=3, path_rows=16, path_size=4, word_size=3)
    network = hb.Network(spec)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    pages = [hb.describe(hb.blocks(h), spec) for h in ("<p>a b c.<p>d<div>e f</div>", "<nav>x</nav><p>yy z")]
    labels = np.array([[1, 0, 1], [0, 1, 0.0]])

    def loss():
        x, mask = network.inputs(pages)
        z = network.logits(x, mask)
        return float((mask * (np.log1p(np.exp(z)) - labels * z)).sum() / mask.sum())

    grads = network.gradients(pages, labels)
    for name, w in network.weights.items():
        flat = w.reshape(-1)
        for i in np.random.default_rng(0).permutation(flat.size)[:6]:
            kept, step = flat[i], 1e-2
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[i]) < 2e-3
