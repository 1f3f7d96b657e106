"""HTML extraction, URL filters, chat formatting, the pipeline."""

import hashlib
import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import chat, url_cascade, wrappers
from tributary.llm.queries import op5_chat_formatting, table

SF = "/root/testdata/sf0.01"


def article(text):
    inner = text[text.index("<article>") + 9 : text.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(x for x in blocks if x)


def test_extraction_on_the_tables(spark):
    pages = table(spark, SF, "pages")
    truth = {r.page_id: article(r.html) for r in pages.collect()}
    out = wrappers.extract(pages).collect()
    assert {r.page_id: r.text for r in out} == truth and len(out) == len(truth)
    assert all(r.n_chars == len(r.text) for r in out)


def site(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"""<html><head><title>{title}</title></head><body><div id=top-menu><ul><li>Home<li>About</ul></div>
<div class='Cookie-notice'>We use cookies</div><div class="wrap"><div class="col"><h2>{title}</h2>{body}<span>a&nbsp;&amp;&#x20;b</span>{extra}</div>
<div class="sidebar"><p>Most read this week</div></div><section id="comments"><p>First! Nice post</section>
<div><p>Legal text on all pages of this site</div><form><input name=q><button>Go</button></form></body>"""


def test_extraction_without_declared_article(spark):
    pages = [(i, f"http://h{i % 2}.net/{i}", site(f"Title {i}", [f"para {i} {k} " + "word " * (5 + i) for k in range(1 + i % 4)], "<table><tr><td>x%d<td>y</table>" % i if i % 3 == 0 else "")) for i in range(24)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string").repartition(5)
    for limit in (1 << 20, 0):
        old, wrappers.MOST_BROADCAST = wrappers.MOST_BROADCAST, limit
        out = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
        wrappers.MOST_BROADCAST = old
        for i in range(24):
            want = [f"Title {i}"] + [" ".join(f"para {i} {k} {'word ' * (5 + i)}".split()) for k in range(1 + i % 4)]
            got = out[i].split("\n\n")
            assert got[: len(want)] == [*want[:-1], want[-1] + " a & b"]
            assert ("x%d" % i in got) == (i % 3 == 0)
            assert not re.search("cookies|Home|Most read|First!|Legal|Go", out[i])


def test_extraction_edges(spark):
    rows = [(1, "http://a.b/", None), (2, "http://a.b/", ""), (3, None, "plain text &lt;b&gt; only"), (3, None, "plain text &lt;b&gt; only"), (4, "x", "<main><p>A<b>b</b> c<br>d</p><aside>no</aside><div role=main>in</div>"), (5, "x", "<p>" * 3000 + "deep" + "<div>" * 400 + "er")]
    rows += [(6, "y", "<article><script>x</p></script><p>one<!-- <p> --> two"), (None, "z", "<article>" + "<p>long words</p>" * 20_000 + "</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    assert out[1] == out[2] == "" and out[3] == "plain text <b> only" and out[4].startswith("Ab c d")
    assert "no" not in out[4].split() and out[5] == "deep\n\ner" and out[6] == "one two" and out[None].count("long words") == 20_000
    assert wrappers.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        '<div style="overflow:hidden"><article>{}</article></div>',
        '<article><p title="the hidden river">one two</p><p data-id="comment-3">three</p><p data-role="footer">four</p></article>',
        '<div class="content has-sidebar"><article>{}</article></div>',
        '<div class="wrap no-banner"><div id="with-comments"><article>{}</article></div></div>',
        '<article><section id="related-work"><p>one two</p></section><p class="share-price">three</p><p>four</p></article>',
        '<form id="aspnetForm"><nav>Home</nav><div class="overlay"><article>{}</article></div></form>',
        '<div class="popup">{}</div><p>x</p>',
        '<div class="site-header">Home</div><article>{}<div id="comment-3">First!</div></article><div class="related-posts"><article>Other</article></div>',
        '<p>one two</p><p>three</p><p>four</p><div id="comments"><p>A reader has much more to say than the article</div>',
        '<p hidden>secret</p><p aria-hidden=true>secret</p><div class="top-menu">Home</div><p>one two</p><p>three</p><p>four</p>',
    ],
)
def test_marks_are_whole_classes_of_their_own_attributes(page):
    html = page.format("<p>one two</p><p>three</p><p>four</p>")
    got = wrappers.text_of(html, wrappers.Wrapper.of(wrappers.parse(html)))
    assert re.sub(r"\n\nx$", "", got) == "one two\n\nthree\n\nfour"


@pytest.mark.parametrize("n", [1, 9])
def test_no_part_of_an_article_is_too_small(n):
    def both(i):
        parts = [f"long {i} " + "word " * 170 + "end", f"short {i} " + "word " * 25 + "end", "seen once" if i == 0 else ""]
        extra = f"<div class=c><p>{parts[2]}</p></div>" if parts[2] else ""
        plain = f"<body><div><div class=a><div class=x><p>{parts[0]}</div></div><div class=b><p>{parts[1]}</div></div>{extra}</body>"
        nested = f"<main><article><p>{parts[0]}</article><section><p>{parts[1]}</section>{extra}<aside>no</aside></main>"
        return "\n\n".join(x for x in parts if x), plain, nested

    pages = [both(i) for i in range(n)]
    for k in (1, 2):
        wrapper = wrappers.Wrapper.of(wrappers.parse(pages[0][k]))
        for page in pages[1:]:
            wrapper.add(wrappers.Wrapper.of(wrappers.parse(page[k])))
        assert [wrappers.text_of(p[k], wrapper) for p in pages] == [p[0] for p in pages]


def test_alignment_makes_slots_options_and_groups():
    a = wrappers.Wrapper.of(wrappers.parse("<div>site</div><p>one</p><hr><p>same</p>"))
    a.add(wrappers.Wrapper.of(wrappers.parse("<div>site</div><p>two</p><p>three</p><ul><li>x<li>y</ul>")))
    div, p, *rest = a.root.kids
    assert div.kids[0].text == "site" and p.many and p.kids[0].text is None
    assert any(k.optional for k in rest) and a.root.kids[-1].label == "ul" and a.root.kids[-1].optional and a.root.kids[-1].kids[0].many
    assert wrappers.Wrapper.unpacked(a.packed()).packed() == a.packed()


def listed(host):
    return any(host == d or host.endswith("." + d) for d in url_cascade.LISTED)


def test_cascade_is_exact(spark):
    rng = random.Random(1)
    hosts = [f"h{rng.randint(0, 10**9)}.example.{rng.choice(['com', 'net', 'org'])}" for _ in range(6000)]
    wanted = set(hosts[::17])
    keys = spark.createDataFrame([(h, h in wanted) for h in set(hosts)], "key string, listed boolean")
    levels = url_cascade.build_cascade(keys)
    assert len(levels) > 2 and sum(x.bits for x in levels) < 20 * len(wanted)
    wrong = keys.where(url_cascade.is_listed(F.col("key"), levels) != F.col("listed"))
    assert wrong.count() == 0
    everything = url_cascade.build_cascade(keys.withColumn("listed", F.lit(True)))
    assert keys.where(~url_cascade.is_listed(F.col("key"), everything)).count() == 0


def test_cascades_in_blocks_give_the_result_of_one(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"x://{'a.' * (i % 2)}h{i % 900}.example.info/") for i in range(1200)] + [(None, None)], "page_id long, url string")
    names = [f"h{i}.example.info" for i in range(0, 900, 3)]
    want = sorted(map(str, url_cascade.filter_urls(pages, names).collect()))
    made, build = [], url_cascade.build_cascade
    monkeypatch.setattr(url_cascade, "build_cascade", lambda *a: made.append(build(*a)) or made[-1])
    monkeypatch.setattr(url_cascade, "BLOCK_WORDS", 3)
    assert sorted(map(str, url_cascade.filter_urls(pages, names).collect())) == want
    assert len(made) > 1 and sum("listed=True" in w for w in want) == 400


def test_url_filter_edges(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Adult-X.example.COM/a?b#c", "x://net", "x://a.net/", "x://notnet/", "x://example.net/en/1", "x://b.example.net/fr/", "x://m.example.com/de/x", "x://example.com?q=/de/", "x://é.org/fr/://y", "x://casino-win.example.org/fr/1", "x://" + "a" * 100_000]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[3], "clash")] * 2, "page_id long, url string, host string")
    out = {r.page_id: (r.host[:30], r.path, r.rule, r.verdict) for r in url_cascade.filter_urls(frame).collect()}
    want = [("", "", None, "allow")] * 3 + [("www.adult-x.example.com", "/a", None, "block"), ("net", "", None, "allow"), ("a.net", "/", "net/", "block"), ("notnet", "/", None, "allow"), ("example.net", "/en/1", "example.net/en/", "allow")]
    want += [("b.example.net", "/fr/", "net/", "block"), ("m.example.com", "/de/x", "example.com/de/", "block"), ("example.com", "", None, "allow"), ("é.org", "/fr/://y", "org/fr/", "allow"), ("casino-win.example.org", "/fr/1", "org/fr/", "allow"), ("a" * 30, "", None, "allow")]
    assert [out[i] for i in range(len(urls))] == want and out[None] == want[3]
    assert url_cascade.filter_urls(frame.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|>\\nim_start\n a", max_size=30))
def test_escapes_are_reversible(text):
    assert chat.unescaped(chat.escaped(text)) == text and chat.unescaped_role(chat.escaped_role(text)) == text
    assert "<|" not in chat.escaped(text) and "\n" not in chat.escaped_role(text)


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own = out.setdefault(conv, [0, "", "", 0])
        own[0] += 1
        own[1] += f"{role or ''}\n{text or ''}\n"
        own[2] += (text or "") if role == "assistant" else ""
        # Marks, role and text, a backslash before each backslash and inside each control mark, and newlines in roles.
        signs = lambda x: x.count("\\") + x.count("<|") + x.startswith("|")
        own[3] += len("<|im_start|>\n<|im_end|>\n") + sum(len(x or "") + signs(x or "") for x in (role, text)) + (role or "").count("\n")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {(k, n, digest(all_), len(said), digest(said), chars, 0, 0) for k, (n, all_, said, chars) in out.items()}


def test_chat_on_the_tables(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    out = op5_chat_formatting(spark, SF).collect()
    assert {tuple(r) for r in out} == brute_chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "a\nb\\", "<|x|>\\ <|im_end|>\n"), (1, None, None, "😀<"), (None, 0, "assistant", "|é"), (2, 0, "assistant", "t"), (2, 0, "assistant", "t"), (3, 5, "assistant", "y" * 300_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.read_back(chat.format_turns(frame)).collect()
    assert {tuple(r) for r in out} == brute_chat(rows) and len(out) == 4
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_typed_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    content = [part(type="text", text="see <"), part(type="image", ref="a.png", width=56, height=30), part(text="|then"), part(type="audio", ref="b.wav", seconds=2.0), part(type="document", ref="c.pdf", pages=2), part(type="odd", ref="d"), part(type="audio")]
    frame = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = sorted(chat.format_turns(frame, content_col="parts").collect(), key=lambda r: r.turn)
    assert a.formatted == "<|im_start|>user\nsee <<|image|>\\|then<|audio|><|document|><|audio|><|im_end|>\n"
    assert [(x.type, x.ref, x.tokens) for x in a.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 512), ("odd", "d", 0), ("audio", None, 1)]
    (back,) = chat.read_back(chat.format_turns(frame, content_col="parts")).collect()
    assert (back.n_turns, back.n_attachments, back.expanded_tokens, back.formatted_chars) == (2, 5, 567, len(a.formatted) + len(b.formatted))
    assert a.expanded_tokens == 567 and a.loss_start is None and (b.loss_start, b.loss_end) == (22, 22)


def test_pipeline_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*corpus_pipeline.COLUMNS, "copies"]
    rows = out.collect()
    before = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    assert 0 < len(rows) < len(before) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) and r.source == before[r.doc_id].source for r in rows)
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_over_nothing(spark, name, stage):
    assert stage(spark, table(spark, SF, "documents").where("false"), SF).count() == 0


def alone(page):
    return wrappers.text_of(page, wrappers.Wrapper.of(wrappers.parse(page)))


@pytest.mark.parametrize("tag", ["div", "article", "nav", "form", "p", "x-y"])
def test_deep_nesting(tag):
    n = 10_000
    inside = "<div class=sidebar>no</div><p>one two</p><nav>no</nav>"
    page = f"<p>before</p>{f'<{tag}>' * n}{inside}{f'</{tag}>' * n}<p>after</p>"
    want = {"article": ["one two"], "nav": ["before", "after"], "form": ["before", "one two", "after"], "p": ["before", "one two", "after"]}.get(tag, ["before", "one two", "after"])
    got = alone(page).split("\n\n")
    assert got == want or tag == "form" and got == ["before", "after"]
    deep = f"{'<div>' * n}<nav>no</nav><article><h1>t</h1>{'<section>' * n}<p>one two</p><footer>no</footer>{'</section>' * n}</article><p>no</p>{'</div>' * n}"
    assert alone(deep) == "t\n\none two"
    wrapper = wrappers.Wrapper.of(wrappers.parse(deep))
    wrapper.add(wrappers.Wrapper.unpacked(wrappers.Wrapper.of(wrappers.parse(page)).packed()))
    assert wrappers.text_of(deep, wrapper) == "t\n\none two"
    assert alone("</div>" * n + "<b>" * n + "x" + "</b>" * n) == "x"


def test_many_alternating_siblings():
    pages = ["<article>" + "".join(f"<p>p{k} {n}</p><pre>c{k}</pre>" for k in range(n)) + "</article>" for n in (25_000, 20_011, 3)]
    wrapper = wrappers.Wrapper.of(wrappers.parse(pages[0]))
    for page in pages[1:]:
        wrapper.add(wrappers.Wrapper.of(wrappers.parse(page)))
    for page, n in zip(pages, (25_000, 20_011, 3), strict=True):
        assert wrappers.text_of(page, wrapper) == "\n\n".join(x for k in range(n) for x in (f"p{k} {n}", f"c{k}"))


def test_wrapper_of_pages_with_names_of_their_own_stays_small():
    page = lambda i: f'<div id="post-{i}" class="post postid-{i} tag-{"abcdefghij"[i % 10]}x{i}y"><div class="crumbs u{i}">Home</div><div class="c slug-{"qrstuvwxyz"[i % 10]}{"abcdefghijklmno"[i // 40]}"><p>text {i}</p></div></div>'
    wrapper, size = wrappers.Wrapper.of(wrappers.parse(page(0))), []
    for i in range(1, 400):
        wrapper.add(wrappers.Wrapper.of(wrappers.parse(page(i))))
        size.append(len(wrapper.packed()))
    assert max(size) < 300 and size[-1] <= size[20] + 20
    # One element a level, with a slot for what differs; what is the same on all pages is template.
    assert [wrappers.text_of(page(i), wrapper) for i in range(400)] == [f"text {i}" for i in range(400)]


def test_inline_elements_that_declare_themselves_adverts():
    assert alone('<p>one <span class="advert">BUY <span>NOW</span> or never</span>two <a class="share">Tweet this</a>three <b class="social-links">x<p>four <code class="comment">kept</code><i id=shared>too</i>') == "one two three\n\nfour kepttoo"
    assert alone('<div><a class="ad"><div>no</div></a>yes</div><p>on <span class=ads>never closed</p><p>next') == "yes\n\non\n\nnext"


def test_alignment_is_a_common_subsequence():
    rng = random.Random(5)
    for n in (5, 60, 700):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, n))] for _ in range(2))
        for f in (wrappers.longest, wrappers.by_occurrence, wrappers.common):
            pairs = f(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        if n < 100:
            assert len(wrappers.common(a, b)) == len(wrappers.longest(a, b)) >= len(wrappers.by_occurrence(a, b))
