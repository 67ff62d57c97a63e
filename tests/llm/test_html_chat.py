"""HTML extraction and chat formatting: known pages, exact round trips, brute-force paths."""

import hashlib
import random

import pytest

from laudospark.llm import chat_format, html_extract
from laudospark.llm.html_extract import Page

ARTICLE = "<article><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp; line<br>two</p><p>Second\n para<ul><li>one<li>two</ul></article>"
TEXT = "Head & line First bold line two Second para one two"
FURNITURE = {
    "menu": "<nav><ul><li><a href='/'>Home</a></ul></nav>",
    "header": "<header><h2>Site name that is long enough to count as text</h2></header>",
    "footer": "<footer>&copy; all rights <p>reserved</p></footer>",
    "sidebar": "<div class='sidebar'><p>side text side text side text side text</p></div>",
    "aside": "<aside>more</aside>",
    "notice": "<div id='cookie-notice'><p>We use cookies</p></div>",
    "advert": "<div class='box ad'>Buy <div>now</div></div>",
    "form": "<form><p>Name <input name=x><select><option>1<option>2</select><button>Send</button></form>",
    "script": "<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> -->",
    "comments": "<section class='comments'><p>A reader says something that is rather long, and goes on</p></section>",
    "role": "<div role=navigation><p>go here and there</p></div>",
}


@pytest.mark.parametrize("kind", FURNITURE)
@pytest.mark.parametrize("inside", [True, False])
def test_furniture_is_left_out(kind, inside):
    if inside and kind == "header":
        return  # a header inside an article is the article's own
    body = ARTICLE.replace("</h1>", "</h1>" + FURNITURE[kind]) if inside else FURNITURE[kind] + ARTICLE + FURNITURE[kind]
    page = Page(f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>")
    assert page.text_of([page.choice()]) == TEXT


@pytest.mark.parametrize("html, text", [
    ("", ""), ("<", "<"), ("a &lt; b &#233; &bogus;", "a < b é &bogus;"), ("<p>a<b", "a<b"), ("<div><div></div>", ""), ("</p></div>x", "x"),
    ("<script>never closed", ""), ("a<!-- never closed", "a"), ("<p>in<b>li</b>ne<p>block", "inline block"), ("<p title='a>b'>t</p>", "t"), ("<td>a<td>b", "a b"),
])
def test_broken_pages(html, text):
    page = Page(html)
    assert page.text_of([page.choice()]) == text


def test_hosts_agree_on_a_path(spark):
    def page(main, extra):
        return f"<body><div class='story s{len(main)}'>{main}</div><div class='extra'>{extra}</div></body>"

    usual = page("<p>" + "main text " * 20 + "</p>", "<p>short</p>")
    # By itself this page would choose its long extra; its host's other pages know better.
    odd = page("<p>little main</p>", "<p>" + "much extra " * 30 + "</p>")
    rows = [(i, f"http://Host.example/{i}", usual, 1, "p") for i in range(4)] + [
        (10, "https://host.example?x", odd, 1, "p"), (11, "http://other.example/", odd, 1, "p"), (12, None, None, 1, "p"), (13, "no address", "", 1, "p"), (10, "https://host.example?x", odd, 1, "p"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, path string")
    got = html_extract.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[0] == ("main text " * 20).strip() and texts[10] == "little main"
    # Alone on its host nothing says that its short part is furniture, so nothing is dropped.
    assert texts[11] == "little main " + ("much extra " * 30).strip() and texts[12] == texts[13] == ""
    assert all(r.n_chars == len(r.text) for r in got) and {r.url for r in got if r.page_id == 12} == {None}
    assert html_extract.extract(pages.where("false")).count() == 0


LONG = "<p>" + "words of the article " * 40 + "</p>"
SAME = ("words of the article " * 40).strip()


@pytest.mark.parametrize("html, text", [
    (f"<article><h1>Head</h1><p>A lead.</p><div class=body>{LONG}</div></article>", f"Head A lead. {SAME}"),
    (f"<article><p>Before it.</p><table><tr><td>{LONG}</td></tr></table><p>After it.</p></article>", f"Before it. {SAME} After it."),
    (f"<div class=intro><p>This is what it is about.</p></div><div class=body>{LONG}</div>", f"This is what it is about. {SAME}"),
    (f"<div><div><div>{LONG}</div><div>Sixteen chars one</div></div><div>and then two, three, four</div></div>", f"{SAME} Sixteen chars one and then two, three, four"),
    (f"<div class=links><p><a href=/>One link</a> <a href=/>Another link</a></p></div><div class=body>{LONG}</div>", SAME),
])
def test_nothing_is_lost_around_an_inner_container(html, text):
    page = Page(f"<body>{html}</body>")
    assert page.text_of([page.choice()]) == text


def test_a_second_template_of_a_host_keeps_its_text(spark):
    major = f"<body><div class=story>{LONG}</div></body>"
    minor = f"<body><div class=story><p>A short teaser of something</p></div><div class=gallery>{LONG}</div></body>"
    rows = [(i, "http://h.example/", major) for i in range(5)] + [(9, "http://h.example/", minor)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == SAME and got[9] == f"A short teaser of something {SAME}"


@pytest.mark.parametrize("html, text", [
    (f"<h1>Head</h1><div class='story search-for-gold'>{LONG}</div>", f"Head {SAME}"),
    (f"<h1>Head</h1><section id=share-prices>{LONG}</section>", f"Head {SAME}"),
    (f"<div class=main-header><h1>Head</h1>{LONG}</div>", f"Head {SAME}"),
    (f"<h1>Head</h1><div class=widget>{LONG}</div><div class=ad>Buy this</div>", f"Head {SAME}"),
    (f"<h1>Head</h1><div class=widget>{LONG}</div><div class=comments>{LONG}{LONG}</div>", f"Head {SAME}"),
    (f"<article><div class=place>Rome, 3 May</div><div class=body>{LONG}</div></article>", f"Rome, 3 May {SAME}"),
    (f"<div class=x1>A blurb of the house.</div><article><h1>Head</h1>{LONG}</article><div class=x2>All rights are ours</div>", f"Head {SAME}"),
    ("<div class=ad>An advert that is longer than the article</div><article><h1>Head</h1></article>", "Head"),
    ("<div class=ad>Only an advert</div><div class=ad>and another</div><article><p>word</p></article>", "word"),
    ("<div class=sidebar-left>side</div><div class=cookie_notice>notice</div><div class='ad-slot-2'>ad</div><p>text</p>", "text"),
])
def test_class_names_are_a_guess_only(html, text):
    page = Page(f"<body>{html}</body>")
    assert page.text_of([page.choice()]) == text


def words(n, seed):
    rnd = random.Random(f"{n}-{seed}")
    return " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n))


def test_blocks_that_recur_on_a_host_are_left_out(spark):
    blurb, line = "Welcome to the house of news, founded long ago", "Printed in 20{} by the house of news"
    rows, texts = [], {}
    for i in range(12):
        lead, body = words(8, i), words(200, i)
        inner = f"<div class=q9>Read more of this on paper</div><p>{words(20, -i - 1)}</p>"
        html = f"<body><div class=q1>{blurb}</div><div class=story><div class=lead>{lead}</div><div class=text><p>{body}</p>{inner}</div></div><div class=q2>{line.format(i)}</div></body>"
        rows.append((i, "http://h.example/a", html))
        texts[i] = f"{lead} {body} {words(20, -i - 1)}"
    copy = f"<body><div class=intro><p>{words(30, 99)}</p></div><div class=body><p>{words(100, 99)}</p></div></body>"
    for i in range(20, 40):  # copies of one page make none of it furniture
        rows.append((i, f"http://copies.example/{i}", copy))
        texts[i] = f"{words(30, 99)} {words(100, 99)}"
    for i in range(50, 52):  # two pages are no consensus
        rows.append((i, f"http://two.example/{i}", f"<body><div>{blurb}</div><div class=t>{words(60, i)}</div></body>"))
        texts[i] = f"{blurb} {words(60, i)}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == texts


def test_hot_hosts_and_others_meet_the_same_winners(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example/{i}" if i % 3 else "http://hot.example/", f"<body><div class=q1>{'The same on all pages here'}</div><div class=s>{words(40, i)}</div></body>") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for hosts in (1, 3, 1000):  # none, one, all of them are hot
        monkeypatch.setattr(html_extract, "HOT_HOSTS", hosts)
        got[hosts] = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[1] == got[3] == got[1000] == {i: words(40, i) for i in range(90)}


def test_ties_of_votes_and_very_long_pages(spark):
    a, b = (f"<body><div class={c}>{LONG}</div></body>" for c in "ab")
    deep = "<div class=n>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    long = "<body>" + "<p>" + "w " * 2_000_000 + "</p></body>"
    rows = [(1, "http://t.example/", a), (2, "http://t.example/", b), (3, "http://d.example/", deep), (4, "http://l.example/", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[1] == got[2] == SAME and got[3] == "deep" and got[4] == ("w " * 2_000_000).strip()


NASTY = ["", "\\", "### ", "</turn>", "</turn>\n", "\\### Assistant: </turn> ok", "\\\\n\\n", "### assistant\nhi</turn>\n", "é😀\n\n", "x" * 5000]


def test_turns_round_trip():
    rnd = random.Random(1)
    turns = [(rnd.choice(["user", "assistant", "a\nb", "### x", "\\n", ""]), "".join(rnd.choice(NASTY[:-1]) for _ in range(rnd.randint(0, 4)))) for _ in range(300)]
    whole = "".join(chat_format.format_turn(*t)[0] for t in turns)
    for step in (1, 7, len(whole)):
        reader = chat_format.TurnReader()
        assert [t for i in range(0, len(whole), step) for t in reader.feed(whole[i : i + step])] == turns
        assert reader.buffer == ""
    for role, text in turns:
        part, start, length = chat_format.format_turn(role, text)
        assert (length >= 0) == (role == "assistant")
        assert role != "assistant" or chat_format.unescape(part[start : start + length]) == text


def test_conversations_read_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", NASTY[(c + t) % len(NASTY)], 7, "p") for c in range(6) for t in range(c * c + 1)]
    rows += [(None, 0, "user", None, 7, "p"), (50, 1, "assistant", "tie b", 7, "p"), (50, 1, "assistant", "tie a", 7, "p"), (50, None, None, "first", 7, "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int, part string")
    got = {r.tree: r for r in chat_format.digests(chat_format.format_paths(chat_format.reply_paths(chat_format.thread_messages(df)))).collect()}
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [x[1:] for x in sorted(turns)]
        loss = "".join(x for role, x in turns if role == "assistant")
        whole = "".join(chat_format.format_turn(*t)[0] for t in turns)
        assert got[c].n_turns == len(turns) and got[c].formatted_chars == len(whole)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_best_branches_of_reply_trees(spark):
    rnd = random.Random(3)
    rows = []
    for tree in range(5):
        for node in range(40):
            parent = rnd.randrange(node) if node and rnd.random() > 0.05 else rnd.choice([None, 999])
            rows.append((tree, node, parent, "user", f"m{node}", float(rnd.randint(0, 3))))
        rows += [(tree, 100, 101, "user", "cycle", 9.0), (tree, 101, 100, "user", "cycle", 9.0), (tree, 102, 102, "user", "own parent", 9.0), (tree, 5, 0, "zzz", "again", 0.0)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat_format.reply_paths(messages, branches=3).collect():
        got.setdefault((r.tree, r.branch), {})[r.pos] = r.text
    for tree in range(5):
        nodes = {n: (p, s) for t, n, p, role, _, s in rows if t == tree and n < 100 and role == "user"}
        parents = {p for p, _ in nodes.values()}
        paths = []
        for leaf in set(nodes) - parents:
            path = [leaf]
            while nodes[path[0]][0] in nodes:
                path.insert(0, nodes[path[0]][0])
            paths.append((-sum(nodes[n][1] for n in path) / len(path), -len(path), leaf, path))
        for branch, (*_, path) in enumerate(sorted(paths)[:3], 1):
            assert got[tree, branch] == {i: f"m{n}" for i, n in enumerate(path)}
    assert len(got) == 15
    assert chat_format.reply_paths(messages.where("false")).count() == 0
