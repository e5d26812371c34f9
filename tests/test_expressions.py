"""Literal rows for every column expression."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framewise.fixed_values import (
    NON_POLITICAL_KEYWORDS,
    POLITICAL_KEYWORDS,
    STOP_WORDS,
    WHITE_SPACE,
    WHITE_SPACE_CHARS,
)
from framewise.functions import gates as G
from framewise.functions import scores as S
from framewise.functions.html import decode_entities, extract_headline, extract_links
from framewise.functions.labels import decode_label, encode_label, map_category
from framewise.functions.numbers import percent_text, round_half_even
from framewise.functions.text import clean_text, is_blank, norm_key, strip, word_tokens
from framewise.functions.urls import (
    authority,
    canonical_url,
    followable,
    is_article_link,
    resolve_url,
    same_site,
    site_links,
)


def apply(spark, values, *exprs, kind="string"):
    """Evaluate expressions over column ``x``, in the order of ``values``."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    out = rows.select("i", *[e.alias(f"r{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r)[1] if len(exprs) == 1 else tuple(r)[1:] for r in out]


CLEAN = [
    (None, ""),
    ("  PM's plan:\nSee HTTPS://x.in/a?b now ", "pm s plan see now"),
    ("xhttpfoo bar", "x bar"),
    ("http", "http"),
    ("see https://x\u00a0next", "see next"),
    ("चुनाव", ""),
    ("a\r\nb\tc", "a b c"),
    ("", ""),
]


def test_clean_text(spark):
    assert apply(spark, [a for a, _ in CLEAN], clean_text("x")) == [b for _, b in CLEAN]


def test_clean_text_follows_its_steps(spark):
    def steps(t):
        t = t.strip().replace("\n", " ").replace("\r", " ").lower()
        t = re.sub(r"http\S+", " ", t)
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t)).strip()

    pick = random.Random(1)
    alphabet = "abhtp019 .:/\t\n\r\u00a0\u2003\u3000é'Z-"
    texts = ["".join(pick.choice(alphabet) for _ in range(40)) for _ in range(500)]
    texts += ["x http://a\u00a0b", "httphttp c", "ab\u2028http://q\u2029d"]
    assert apply(spark, texts, clean_text("x")) == [steps(t) for t in texts]


def test_strip_and_keys(spark):
    texts = ["\u00a0 A b\t", "\u3000x\u2009", "", "  ", "İx ", None, "a\u200b"]
    want = [None if t is None else t.strip() for t in texts]
    assert apply(spark, texts, strip("x")) == want
    assert apply(spark, texts, norm_key("x")) == [None if t is None else t.lower().strip() for t in texts]
    assert apply(spark, texts, is_blank("x")) == [not (t or "").strip() for t in texts]


def test_white_space_is_the_same_set_twice():
    as_class = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m.group(1), WHITE_SPACE)
    found = {chr(i) for i in range(0x3100) if re.match(f"[{as_class}]", chr(i))}
    assert found == set(WHITE_SPACE_CHARS)
    assert found == {chr(i) for i in range(0x3100) if chr(i).isspace()}


def test_tokens(spark):
    assert apply(spark, ["A bc, d_e f1 É's"], word_tokens("x")) == [["bc", "d_e", "f1"]]


def test_stop_words_are_spark_defaults(spark):
    from pyspark.ml.feature import StopWordsRemover

    default = StopWordsRemover.loadDefaultStopWords("english")
    assert STOP_WORDS == [w for w in default if len(w) > 1 and "'" not in w] or set(STOP_WORDS) == {
        w for w in default if len(w) > 1 and "'" not in w
    }


LABELS = [
    ("Left", "Left", 0),
    ("Left-Center", "Left", 0),
    ("Center", "Neutral", 1),
    ("Center-Right", "Right", 2),
    ("Right", "Right", 2),
    ("Foo", "Right", 2),
    (None, "Right", 2),
]


def test_labels(spark):
    got = apply(
        spark,
        [c for c, _, _ in LABELS],
        map_category("x"),
        encode_label(map_category("x")),
        decode_label(encode_label(map_category("x"))),
    )
    assert got == [(b, i, b) for _, b, i in LABELS]


GATES = [
    ("Opposition criticizes government on farm laws", "biased_political"),
    ("Opposition criticizes govt on farm laws", "biased_political"),
    ("Supreme Court hears plea", "biased_political"),
    ("Supreme Court hears plea on new education policy...", "biased_political"),
    ("Hyderabad weather forecast for tomorrow", "non_political"),
    ("Modi to launch metro rail in Pune", "non_political"),
    ("By-election results: BJP ahead", "biased_political"),
    ("anti-national remark sparks row", "biased_political"),
    ("Article 370 verdict", "biased_political"),
    ("Cold  wave grips north", "neutral_political"),
    ("Cold wave grips north", "non_political"),
    ("Railways plan reviewed", "neutral_political"),
    ("चुनाव परिणाम", "neutral_political"),
    ("éd acté _bill bill_", "neutral_political"),
    ("ED, raids", "biased_political"),
    ("", "neutral_political"),
    (None, None),
]


def test_gates(spark):
    texts = [t for t, _ in GATES]
    assert apply(spark, texts, G.classify_gate("x")) == [g for _, g in GATES]
    stages = [{"biased_political": "model"}.get(g, g) for _, g in GATES]
    assert apply(spark, texts, G.deciding_stage("x")) == stages
    both = "Modi to launch metro rail in Pune"
    assert apply(spark, [both], G.is_non_political("x"), G.is_political("x")) == [(True, True)]


def test_gate_patterns_match_one_by_one_search(spark):
    """The factored pattern finds exactly what a search per keyword finds."""

    def search(t, words):
        return any(re.search(r"\b" + re.escape(w) + r"\b", t) for w in words)

    words = NON_POLITICAL_KEYWORDS + POLITICAL_KEYWORDS
    texts = [f"x {w} y" for w in words] + [f"x{w} y" for w in words] + [f"{w}é" for w in words]
    texts += [f"é-{w}" for w in words] + [f"{w}_" for w in words] + [f"²{w}" for w in words]
    texts += [w[:-1] for w in words] + [f"{w}s" for w in words] + [w.replace(" ", "  ") for w in words]
    got = apply(spark, texts, G.is_non_political("x"), G.is_political("x"))
    want = [(search(t, NON_POLITICAL_KEYWORDS), search(t, POLITICAL_KEYWORDS)) for t in texts]
    assert got == want
    hits = apply(spark, texts, G.matched_keywords("x"))
    for t, h in zip(texts, hits):
        assert sorted(h) == sorted(w for w in words if re.search(r"\b" + re.escape(w) + r"\b", t)), t


HEADLINES = [
    ('<meta property="og:title" content=" A "><title>B</title><h1>C</h1>', "A"),
    ("<META content='it\"s > A' PROPERTY='og:title'/><title>B</title>", 'it"s > A'),
    ('<meta name=x property=og:title content=A><title>B</title>', "A"),
    ('<meta property="og:title" content=""><title>B</title>', "B"),
    ('<meta property="og:title" content="   "><title>B</title>', ""),
    ('<meta property="og:title:alt" content="Z"><title>B</title>', "B"),
    ("<title>B &amp; C</title>", "B & C"),
    ("<title></title><h1>C</h1>", ""),
    ("<h1 class=x>C <b>bold</b></h1>", "C bold"),
    ("<p>none</p>", None),
    ("<!-- <title>no</title> --><title lang=en>\n B </title>", "B"),
    ("<script>var t='<title>no</title>'</script><title>B</title>", "B"),
    ("<title>It&#39;s &#x2014; 5 &lt; 6 &amp;lt; &#8377;1 &#0; &#xZ</title>", "It's — 5 < 6 &lt; ₹1 � &#xZ"),
]


def test_headline_of_page(spark):
    assert apply(spark, [h for h, _ in HEADLINES], extract_headline("x")) == [t for _, t in HEADLINES]


def test_entities_leave_other_text_alone(spark):
    texts = ["a & b", "&unknown; &", "&#; &#a", "plain", "&amp;amp;", "&nbsp;x", "&#128512;", "&#x1F600;!"]
    want = ["a & b", "&unknown; &", "&#; &#a", "plain", "&amp;", "\u00a0x", "😀", "😀!"]
    assert apply(spark, [*texts, None], decode_entities("x")) == [*want, None]


def test_links_of_page(spark):
    html = (
        '<a href="/a">x</a><A class="b" HREF=\'/b?q="1"\'>y</A><a href=/c>z</a><a name="n">no</a>'
        '<!-- <a href="/hidden"> --><script>"<a href=\'/js\'>"</script><a data-href="/no" href="/d&amp;e">'
        '<a href="">e</a><abbr href="/f">'
    )
    assert apply(spark, [html], extract_links("x")) == [["/a", '/b?q="1"', "/c", "/d&e", ""]]


BASE = "https://www.ndtv.com"
LINKS = [
    ("https://www.ndtv.com/a/?x=1", "https://www.ndtv.com/a"),
    ("//sports.www.ndtv.com/m", "https://sports.www.ndtv.com/m"),
    ("/india/", "https://www.ndtv.com/india"),
    ("politics/x", "https://www.ndtv.com/politics/x"),
    ("?page=2", "https://www.ndtv.com"),
    ("", "https://www.ndtv.com"),
    ("#top", "https://www.ndtv.com#top"),
    ("/a?b?c", "https://www.ndtv.com/a"),
    ("/a#f?x/", "https://www.ndtv.com/a#f"),
    ("http://evilwww.ndtv.com/z", "http://evilwww.ndtv.com/z"),
]
DROPPED = ["https://m.ndtv.com/q", "tel:123", "MAILTO:a@b", "mailto:a@b", "javascript:x()"]


def test_site_links(spark):
    for href, want in LINKS:
        assert apply(spark, [href], site_links(F.lit(BASE), F.array("x"))) == [[want]], href
    for href in DROPPED:
        assert apply(spark, [href], site_links(F.lit(BASE), F.array("x"))) == [[]], href


def test_resolve_url_follows_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://www.ndtv.com", "http://h/a/b", "http://h/a/b/", "http://h:8080/a/b?q=1", "http://u@h/x/y/z.html"]
    hrefs = [
        "", "x", "x/y", "/x", "/", "./x", "../x", "../../../x", "x/../y", "x/./y/", "..", ".", "/a/../b/..",
        "?q", "#f", "x?q#f", "//other/p", "//other", "http://o/p?q#f", "https://o/../p", "HTTP://o/p", "ftp://o/p",
        "mailto:a@b", "tel:1", "a//b", "/a//b", " /lead", "\t/tab\n", "x:y", "g;x=1/../y", "/a b/ü",
        "/.hidden", "/a/.b/..c", "http:x", "/x?y=a/../b", "/x#../y",
    ]
    cases = [(b, h) for b in bases for h in hrefs]
    rows = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(cases)], "i int, b string, h string")
    got = [r.u for r in rows.select("i", resolve_url("b", "h").alias("u")).orderBy("i").collect()]
    different = [(c, g, urljoin(*c)) for c, g in zip(cases, got) if g != urljoin(*c)]
    assert different == []


def test_url_parts(spark):
    urls = ["https://h:8/p", "http://h?x", "tel:1", "//h/p", "http://u:p@h#f"]
    assert apply(spark, urls, authority("x")) == ["h:8", "h", "", "", "u:p@h"]
    assert apply(spark, ["http://h/a//?q", "http://h/"], canonical_url("x")) == ["http://h/a", "http://h"]
    got = apply(spark, ["http://evilh.in/a", "http://h.in/a"], same_site("x", F.lit("http://h.in")),
                same_site("x", F.lit("http://h.in"), "exact"))
    assert got == [(True, False), (True, True)]
    assert apply(spark, ["/video/x", "/a/tag/b", "/tags", "/photos"], is_article_link("x")) == [False, False, True, False]
    assert apply(spark, ["mailto:x", "Mailto:x", "javascript:"], followable("x")) == [False, True, False]
    with pytest.raises(ValueError):
        same_site("x", "y", "other")


def test_rounding_follows_binary_value(spark):
    pick = random.Random(2)
    xs = [pick.random() for _ in range(3000)] + [k / 32 for k in range(33)]
    xs += [k / 20000 for k in range(1, 20000, 7)] + [k / 10000 for k in range(0, 10000, 3)]
    got = apply(spark, xs, round_half_even(F.col("x"), 4), percent_text(F.col("x")), kind="double")
    assert got == [(round(x, 4), f"{x:.1%}") for x in xs]


DECISIONS = [
    ([0.8, 0.6, 0.7, 0.5, 0.1, 0.1, 0.2, 0.2, 0.2, 0.2], (0.65, 0.2, 0.15), 0.45, "Left",
     "NLI analysis: Left framing detected (65.0% confidence)"),
    ([0.4] * 4 + [0.36] * 4 + [0.3, 0.34], (0.3704, 0.2963, 0.3333), 0.0371, "Neutral",
     "NLI analysis: ambiguous framing (gap 3.7% < threshold 8%)"),
    ([0.0] * 10, (0.33, 0.34, 0.33), 0.01, "Neutral",
     "NLI analysis: ambiguous framing (gap 1.0% < threshold 8%)"),
    ([0.54] * 4 + [0.46] * 4 + [0.0] * 2, (0.54, 0.0, 0.46), 0.08000000000000002, "Left",
     "NLI analysis: Left framing detected (54.0% confidence)"),
]


def test_margin_rule(spark):
    from framewise.operators.scoring import with_confidence, with_decision

    rows = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DECISIONS)], "i int, x array<double>")
    means = S.class_means(F.col("x"))
    named = rows.select("i", *[m.alias(n) for m, n in zip(means, ("mean_left", "mean_neutral", "mean_right"))])
    decided = with_decision(with_confidence(named))
    conf = S.confidence_columns()
    why = S.nli_reasoning(F.col("label"), conf, F.col("gap"))
    got = decided.select("i", *conf, "gap", "label", why).orderBy("i").collect()
    for (_, c, g, lab, why), row in zip(DECISIONS, got):
        assert tuple(row)[1:4] == c
        assert row.gap == pytest.approx(g, abs=1e-12)
        assert tuple(row)[5:] == (lab, why)


def test_softmax_and_ties(spark):
    import math

    p = S.softmax([F.col("x")[i] for i in range(3)])
    xs = [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [1000.0, 0.0, -1000.0]]
    got = apply(spark, xs, *p, S.best_label(p), kind="array<double>")
    assert got[0][:3] == pytest.approx([math.exp(v) / sum(map(math.exp, xs[0])) for v in xs[0]])
    assert [r[3] for r in got] == ["Right", "Left", "Left"]


def test_lexical_score(spark):
    text = "The Government, the ruling party: http://x.in/criticizes"
    words = S.known_words("x")
    got = apply(spark, [text, ""], S.lexical_scores(words))
    wanted = {"this", "text", "criticizes", "the", "government", "or", "ruling", "party"}
    assert got[0][0] == len(wanted & {"the", "government", "ruling", "party"}) / len(wanted)
    assert got[1] == [0.0] * 10


def test_all_named_references(spark):
    texts = ["caf&iacute; &agrave; &rarr;", "&amp;lt; &lt;b&gt;", "&copy2 &notanentity; &AMP", "&CounterClockwiseContourIntegral;", "a & b && &;"]
    want = ["café".replace("é", "í") + " à →", "&lt; <b>", "©2 ¬anentity; &", "∳", "a & b && &;"]
    assert apply(spark, texts, decode_entities("x")) == want


def test_broken_markup_takes_linear_time(spark):
    import time

    pages = ["<script " * 130_000, "<a " * 350_000, "<title>" * 150_000, "<!--" * 250_000, '<meta "' * 150_000, "<h1 " * 250_000]
    df = spark.createDataFrame([(p,) for p in pages], "x string")
    start = time.time()
    got = df.select(extract_headline("x").alias("t"), F.size(extract_links("x")).alias("n")).collect()
    assert len(got) == len(pages) and time.time() - start < 60
