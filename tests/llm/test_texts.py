"""Classifiers, secrets and main texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptscreen.llm import html_text, quality, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


def docs_and_labels(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, y int").repartition(2)
    return docs, spark.createDataFrame([(i, q, q, "z") for i, q in labels], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("module, rows", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, module, rows):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (4, "word " * 50_000)]
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (3, None), (77, 0), (4, 5), (3, 1)]):
        docs, known = docs_and_labels(spark, texts, labels)
        model = module.fit(docs, known, F.lit(True))
        out = quality.score_column(docs.select("doc_id", "text"), model).collect()
        assert len(out) == len(texts)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    docs, known = docs_and_labels(spark, [], [])
    assert quality.score_column(docs.select("doc_id", "text"), module.fit(docs, known, F.lit(True))).collect() == []


@pytest.mark.parametrize("name, label, least, most", [("op10_quality", "quality", 0.98, 0.05), ("op4_toxicity", "toxic", 0.5, 0.1)])
def test_held_out(spark, name, label, least, most):
    import os

    from promptscreen.llm.queries import QUERIES

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = QUERIES[name](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = out.where("held_out").join(labels, "doc_id").collect()
    ones, zeros = [r for r in held if r[label] == 1], [r for r in held if r[label] == 0]
    assert np.mean([r.predicted for r in ones]) >= least
    assert np.mean([r.predicted for r in zeros]) <= most


def test_hinge_loss_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 20), [1000 + k]])) for k in y]
    model = quality.Model(rows, y, (1.0, 1.0))
    assert model.constant is None and model.slope > 0
    ratio = quality.log_count_ratio(rows, y)
    assert ratio[1001] > 1 and ratio[1000] < -1


def test_features_of_any_length():
    long = "a, B!! " * 400_000
    assert set(quality.features("a, B!! " * 50)) == set(quality.features(long))
    assert len(quality.features(None)) == len(quality.features("")) == 0


def test_compression_tells_apart():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))
    plain = lambda: " ".join(word() for _ in range(60))
    toxic = lambda: " ".join(rng.choice(["blastard", "grumpkin"]) if i % 12 == 5 else word() for i in range(60))
    texts, y = [toxic() if i % 4 == 0 else plain() for i in range(400)], np.array([int(i % 4 == 0) for i in range(400)])
    model = toxicity.Model(texts, y)
    assert b"blasta" in model.contents[0] and b"blasta" not in model.contents[1]
    assert np.mean([model.score(toxic()) >= 0.5 for _ in range(100)]) > 0.95
    assert np.mean([model.score(plain()) >= 0.5 for _ in range(100)]) < 0.02
    # The whole of a text counts, its end too.
    assert model.score(" ".join(plain() for _ in range(50)) + " " + toxic()) > model.score(" ".join(plain() for _ in range(50)))


# Secrets


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = [
    "", "nothing", 'Token: "abcdef" é PASSWORD=short token=x token = abcdefg', "AKIA" + "A1" * 8 + " AKIAshort", "0123456789abcdef" * 2, "api_key=0123456789abcdef0123456789",
    "secret:secret:abcdef", "a" * 100_000, "\U0001f642 token='\U0001f642' passwd='0123456'", "apikey==aaaaaa", "toKen=abcdefg ſecret=abcdefg",
]


def test_base_spans():
    rng = random.Random(4)
    bits = ["token", "=", ": ", '"', "secret", "abcdef", "0123456789abcdef0123456789", " ", "é", "AKIA", "ABCDEFGHIJKLMNOP1234", "api_key", "x", "\n", "passwd", "PassWord"]
    for text in TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]:
        assert secret_scan.base_spans(text) == brute_spans(text)


def test_field_adds_and_keeps():
    field = secret_scan.trained()
    for text in TEXTS:
        found = secret_scan.spans_of(text, field)
        assert [s for s in found if s[1] != 3] == brute_spans(text)
    assert secret_scan.joined(secret_scan.spans_of("Authorization: Bearer abcDEF1234567890abcdEFGH9", field)) == "crf:22:47"
    for clean in ("see item-12345-then-on and 2024-01-01T10:20 by 4111111111111111", "the anand of erhe, +1 (244) 555-4688"):
        assert secret_scan.spans_of(clean, field) == []
    held = secret_scan.examples(400, seed=99)
    hits = [any(s < b and a < e for s, _, e in secret_scan.spans_of(t, field)) for t, spans in held for a, b in spans]
    false = [bool(secret_scan.field_spans(t, field)) for t, spans in held if not spans]
    assert np.mean(hits) > 0.9 and np.mean(false) < 0.15


def test_viterbi_is_best():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(20):
        f = secret_scan.Field()
        f.move, s = rng.normal(size=(3, 3)), rng.normal(size=(5, 3))

        def score(path):
            steps = list(zip((0, *path), path))  # a chain begins as after OUTSIDE
            return -np.inf if (0, 2) in steps else sum(s[i, t] for i, t in enumerate(path)) + sum(f.move[a, b] for a, b in steps)

        assert f.viterbi(s) == list(max(itertools.product(range(3), repeat=5), key=score))


def test_secrets_table(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, spans string").repartition(3)
    out = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    assert len(out) == len(TEXTS) + 1 and out[len(TEXTS)].redacted is None
    assert out[3].redacted == "[SECRET] AKIAshort"
    assert secret_scan.scan_secrets(df.limit(0)).collect() == []


# Main text


CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; text", "plain & text"),
    ("<body><nav>m</nav><article><h1>T</h1><p>a <b>b</b>\n\t c<br>d<p>e</article><footer>f</footer>", "T\na b c d\ne"),
    ("<main><p>x</p><aside>no</aside><div class='ad box'>no</div><div class=comments><p>no</p></div><form>no</form><p>&#233;&nbsp;y</p></main>", "x\né y"),
    ("<article><script>var t='</p>';</script><style>p{}</style><p>a</p><!-- <p>no</p> --><p title='a>b'>c</p>", "a\nc"),
    ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1\n2\n3\n4"),
    ("<article><p>shadow of adder sidestep</p><p class='shadow'>kept</p></article>", "shadow of adder sidestep\nkept"),
    ("<article><p>cut &am", "cut &am"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_pages():
    assert html_text.main_text("<div>" * 20_000 + "x") == "x"


def test_templates(spark):
    """Containers that recur across a host's articles go; a copied article and a shared passage stay."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    box = "<div><p>Subscribe to our letters today</p></div>"
    pages = [(k, f"http://one.example/{k}", f"<body>{box}<p>{words(k)}</p><p>A shared passage.</p></body>") for k in range(20)]
    pages += [(100 + k, f"http://two.example/{k}", f"<body><div><p>{words(0)}</p></div></body>") for k in range(20)]
    pages += [(200, None, f"<body>{box}<p>alone</p></body>"), (None, "x", None), (0, "http://one.example/0", pages[0][2])]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string").repartition(4)
    out = {(r.page_id, r.url): r for r in html_text.extract_text(df).collect()}
    assert out[3, "http://one.example/3"].text == f"{words(3)}\nA shared passage."
    assert out[101, "http://two.example/1"].text == words(0)
    assert out[200, None].text == "Subscribe to our letters today\nalone" and out[None, "x"].n_chars == 0
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_pages(spark, sf):
    """On the tables' pages, whose articles are plain, against a search for paragraphs."""
    import html

    rows = html_text.op3_html(spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.DOTALL)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", m[1])]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
