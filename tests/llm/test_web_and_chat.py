import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from frameclinic.llm import chat_format as C
from frameclinic.llm import html_extract as H
from frameclinic.llm import url_rules as U

TREE = H.train()


def text_of(page):
    return H.main_text(H.blocks(page), TREE)


ARTICLE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy this now for little.</div><div id="cookie-notice"><p>We use cookies to please you.</p></div>'
    "<article><header><h1>A  title &amp; more</h1></header><p><b>Lead</b> of the\n text.<br><p>Second <a href='x'>linked</a> part &#233;&nbsp;x."
    '<div class="share"><a href="#">Share it</a></div><form><label>Mail</label><input name="m"><button>Go</button></form><p>One.</p>'
    '<section class="comments"><p>I liked this a lot, thank you for the nice and long text that you wrote.</p></section></article>'
    '<aside><p>Related things that you may like as well.</p></aside><footer>&copy; someone</footer></body></html>'
)


def test_article_only():
    assert text_of(ARTICLE) == "A title & more Lead of the text. Second linked part é x. One."


def test_pages_without_an_article_element():
    body = " ".join(["word"] * 40)
    page = f'<div><a href="/">Home</a> <a href="/n">News</a></div><div>{body}</div><p>{body}</p><div><a href="/x">more of it</a></div><p>Imprint</p>'
    assert text_of(page) == f"{body} {body}"


def test_broken_and_empty_pages():
    assert text_of("") == "" and text_of("<p") == "" and text_of("<script>x") == "" and text_of("<!-- x") == ""
    assert text_of("<article><p>cut <b>off here") == "cut off here"
    assert text_of("<article>a < b & c &lt;p&gt; </nav></div> d</article>") == "a < b & c <p> d"
    assert text_of("<article><p title=\"a > b\">x</p><p class='y>z'>w</article>") == "x w"


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<a href='", "'>", "word ", "&amp;", "<", ">", '"', "<!--", "-->", "<nav>", "</article>", "<article>"]), max_size=30))
def test_markup_never_fails(parts):
    text_of("".join(parts))


def test_tree_fits_its_table():
    import numpy as np

    rows = np.array(H.TRAINING, float)
    assert (TREE.predict(rows[:, :-1]) == rows[:, -1]).all()


def test_extraction_table(spark):
    rows = [(1, "u", ARTICLE, "x"), (2, None, None, "y"), (None, "u", "", "z"), (1, "u", ARTICLE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract_text(pages).collect()), key=str)
    t = "A title & more Lead of the text. Second linked part é x. One."
    assert got == sorted([(1, "u", t, len(t)), (1, "u", t, len(t)), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert H.extract_text(pages.limit(0)).count() == 0


chars = st.text(alphabet=st.sampled_from("\\#</turn>: \nassistantuser é"), max_size=30)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a:b\\", ""]), chars), max_size=8))
def test_round_trip(turns):
    found = list(C.examples(iter(turns)))
    if turns:
        assert C.parse(found[-1][0]) == turns
    replies = [C.unescape(t[a:b]) for t, a, b in found if a < b]
    assert replies == [t for r, t in turns if r == "assistant" and t]
    # each example is the turns up to its reply and nothing more
    ends = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
    assert [C.parse(t) for t, _, _ in found[: len(ends)]] == [turns[: i + 1] for i in ends]


def test_chat_tables(spark):
    tricky = "\\### Assistant: </turn> ok"
    rng = random.Random(1)
    rows = [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky), (1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "user", "c"),
            (None, 0, "user", "x"), (None, 1, None, "y"), (2, None, "system", ""), (3, 0, "assistant", "r"), (3, 0, "assistant", "r")]
    rows += [(9, i, ["user", "assistant"][i % 2], "long " * rng.randrange(400)) for i in range(300)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, example int")
    by = {r.conv_id: r for r in C.chat_digests(table).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        got = by[conv]
        assert (got.n_turns, got.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = C.format_chats(table).where("conv_id = 1").orderBy("example").collect()
    assert [(r.text, r.text[r.loss_start : r.loss_stop]) for r in examples] == [
        ("### user: </turn>\n### assistant: b</turn>\n", "b"), ("### user: </turn>\n### assistant: b</turn>\n### user: c</turn>\n", "")]
    assert C.chat_digests(table.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_match(host, path, rules=RULES):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (r[0].count("."), len(r[1])), default=None)
    return (best[0] + best[1], best[2]) if best else (None, "allow")


@settings(deadline=None, max_examples=300)
@given(st.sampled_from(["example.org", "a.Example.ORG", "org", "example.com", "xcom", "m.com", "", "org.", "example.org:80"]),
       st.sampled_from(["", "/", "/es", "/es/", "/es/x", "/en/", "/en/1", "/en/12/3", "/en//1", "/fr/1", "/de/", "/de"]),
       st.sampled_from(["", "?a=/es/", "#x", "/?y#z"]))
def test_longest_rule(host, path, rest):
    got_host, got_path = U.split_url(f"http://{host}{path}{rest}")
    assert got_host == host.translate({c: c + 32 for c in range(65, 91)}) and got_path.startswith(path)
    assert (U.RuleTrie(RULES).match(got_host, got_path) or (None, "allow")) == brute_match(got_host, got_path)


def test_random_rules():
    rng = random.Random(21)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice(["/", "x", "xy", "y/"]) for _ in range(rng.randrange(5)))
    for _ in range(60):
        rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), "/" + path()) for _ in range(12))}.values())
        trie = U.RuleTrie([(*rules[0][:2], "other"), *rules])  # of equal rules the last one counts
        for _ in range(60):
            h, p = host(), "/" + path()
            assert (trie.match(h, p) or (None, "allow")) == brute_match(h, p, rules)


def test_many_and_deep_rules(spark):
    deep = "/" + "s/" * 5_000
    rules = [(f"h{i}.example", "/", "block") for i in range(60_000)] + [("x." * 3_000 + "net", deep, "block")]
    urls = ["http://h59999.example/a", "http://h60000.example/a", f"http://{'x.' * 3_000}net{deep}end", "http://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    assert {r.page_id: r.verdict for r in U.judge_urls(pages, rules).collect()} == {0: "block", 1: "allow", 2: "block", 3: "allow"}


def test_odd_urls(spark):
    rows = [(1, None, "h"), (2, "no scheme", "h"), (None, "https://www.example.org/es/?q", "h"), (3, "x://", "h"), (3, "x://", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(tuple, U.judge_urls(pages, RULES).collect()), key=str)
    empty = ("", "", None, "allow")
    want = [(1, *empty), (2, *empty), (3, *empty), (3, *empty), (None, "www.example.org", "/es/", "example.org/es/", "block")]
    assert got == sorted(want, key=str)
    assert U.judge_urls(pages.limit(0), RULES).count() == 0


def test_an_article_in_a_wrapper_named_like_a_side_part():
    prose = "This is the article that the page was written for and it says a lot. " * 3
    side = "<aside><article><p>A teaser for another page of this site.</p></article></aside>"
    reply = '<div class="comments"><article><p>A reply of somebody who read it all.</p></article></div>'
    for head, tail in (
        ('<div class="layout has-sidebar">', "</div>"),
        ('<form id="aspnetForm">', "</form>"),
        ('<div class="layout has-sidebar"><form>', "</form></div>"),
    ):
        page = f"<html><body>{side}{head}<nav>Home</nav><article><p>{prose}</p></article><p>Menu</p>{reply}{tail}{side}</body></html>"
        assert H.main_text(H.blocks(page), H.train()) == prose.strip()
