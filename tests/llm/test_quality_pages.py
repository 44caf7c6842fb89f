from collections import Counter
import time
import pytest

from tests.llm.samples import SCHEMA, ordered, rows, split
from tidewright.llm import pages, quality


def measured(text):
    words, text = split(text), text or ""
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = text.split("\n")
    again = sum(1 for i, line in enumerate(lines) if line in lines[:i] and split(line))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated),
        sum(1 for line in lines if split(line)), len(set(words)), sum(a == b for a, b in zip(words, words[1:])),
    )


def test_measures_against_brute_force(spark):
    table = rows()
    table += [(900, "a b c d e f g h " * 3 + "x\n\nx\nx", *[None] * 7), (901, "*# é|日本　<b>\x0b%", *[None] * 7)]
    out = quality.measure(spark.createDataFrame(table, SCHEMA)).collect()
    assert ordered(out) == ordered((r[0], *measured(r[1])) for r in table)


def test_ledger_policies_and_ablations(spark):
    table = rows()
    ledger = quality.ledger(quality.measure(spark.createDataFrame(table, SCHEMA)))
    found = ledger.select("*", quality.passes(quality.BASE).alias("base"), quality.passes(quality.STANDARD).alias("kept")).collect()
    for r in found:
        want = sum(1 << bit for bit, fails in quality.RULES.values() if eval(fails, {}, r.asDict()))  # noqa: S307
        assert r.failed == want
        assert r.base == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words)
        assert r.kept <= r.base
    policies = [quality.BASE, quality.STANDARD, quality.STRICT]
    got = {(r["policy"], r["version"], r["rule"]): r for r in quality.ablations(ledger, policies).collect()}
    assert len(got) == sum(len(set(p.rules)) for p in policies)
    for p in policies:
        for rule in p.rules:
            bit, r = 1 << quality.RULES[rule][0], got[p.name, p.version, rule]
            assert r.n_rows == len(found)
            assert r.n_rejected == sum(1 for x in found if x.failed & p.mask)
            assert r.n_failed == sum(1 for x in found if x.failed & bit)
            assert r.n_only == sum(1 for x in found if x.failed & p.mask == bit)


def test_rules_have_bits_of_their_own():
    bits = [bit for bit, _ in quality.RULES.values()]
    assert len(set(bits)) == len(bits) and max(bits) < 63


def test_empty_tables_and_missing_measures(spark):
    assert quality.measure(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = spark.createDataFrame([(None,) * 8], ", ".join(f"{m} bigint" for m in quality.MEASURES))
    assert quality.ledger(nulls).first().failed == sum(1 << bit for bit, _ in quality.RULES.values())


TREE = pages.train_tree(pages.LABELLED)
LONG = " ".join(["several words of running text"] * 8)
PAGES = {
    "": "",
    "<article><h1>A</h1><p>one &amp; two<br>three &lt;b&gt;</p>\n\n<p>x</p></article>": "A\none & two three <b>\nx",
    f"<nav><a>m</a></nav><div class='ad'>buy<article><p>{LONG}</p></article><footer>f g</footer>": LONG,
    f"<body><header>Top</header><main><p>{LONG}<p>Short.</main><aside>s</aside>": f"{LONG}\nShort.",
    f"<article><p>{LONG}</p><form><p>mail {LONG}</p></form><section id=comments><article><p>{LONG} no</p></article></section><p>end</p></article>": f"{LONG}\nend",
    f"<article><script>var t='</p>';</script><style>p{{}}</style><!-- c --><p>{LONG}</p><div class='cookie-notice'>{LONG} c</div></article>": LONG,
    f"<div id=menu><ul><li><a>home</a><li><a>news</a></ul></div><h2>Title of it</h2><p>{LONG}</p><p>Yes.</p><p>{LONG} b</p><div>(c) me</div>": f"Title of it\n{LONG}\nYes.\n{LONG} b",
    f"<article><p>{LONG}</p><p>cut <b>short": f"{LONG}\ncut short",
    f"<article><p hidden>gone</p><p style='display: none'>gone</p><p>{LONG}</p></article>": LONG,
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert pages.main_text(html, TREE) == PAGES[html]


def test_many_unclosed_tags_take_no_search_each():
    html = "<article>" + "<b>" * 150_000 + "</i>" * 150_000 + f"<p>{LONG}</p>"
    started = time.time()
    assert pages.main_text(html, TREE) == LONG
    assert time.time() - started < 10


def test_tree_agrees_with_its_table():
    assert all(pages.classify(TREE, row[:-1]) == row[-1] for row in pages.LABELLED)
    assert pages.train_tree([(1.0, 0), (1.0, 1)]) == 0


def test_extract_rows(spark):
    table = [(i, "u", h, "old", "r") for i, h in enumerate(PAGES)] + [(None, None, None, None, None), (1, "u", "<<<>&", "o", "r")]
    df = spark.createDataFrame(table, "page_id bigint, url string, html string, text string, row string")
    out = pages.extract(df)
    assert sorted(out.columns) == ["n_chars", "page_id", "row", "text", "url"] and out.count() == len(table)
    got = {r.page_id: (r.text, r.n_chars) for r in out.filter("row = 'r' and page_id <> 1").collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values()) if i != 1}
    assert out.filter("page_id is null").first().text == ""
    assert pages.extract(df.limit(0)).count() == 0
