import random
import time
from html.parser import HTMLParser

import pytest

from quillmatch.llm import html_text

PROSE = ("The river rose for three days and the people of the valley had to leave their houses, for it was clear that the dam would not hold. "
         "At night the water came over the wall and took the mill with it, but by then there was no one in it.")  # fmt: skip


def text(html):
    return html_text.main_text(html)


def test_article_among_everything_else():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>if (a < b) document.write("<p>no</p>");</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies and it is for you.</div>
    <main><article><h1>Short   heading</h1><p>{PROSE}</p><p>Fish &amp; chips &#x2014; caf&eacute;&nbsp;!</p><ul><li>one</li><li>two</li></ul></article></main>
    <aside>{PROSE}</aside><div id="comments"><p>{PROSE}</p></div><form><p>{PROSE}</p></form><footer>&copy; {PROSE}</footer><!-- <p>no</p> --></body></html>"""
    assert text(html) == f"Short heading\n{PROSE}\nFish & chips — café !\none\ntwo"


def test_without_marked_main_part():
    html = f"""<body><div><a href=a>Home</a> <a href=b>News</a> <a href=c>About the site</a></div><h2>Heading</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p>
    <div><a href=x>More news that is linked</a> | <a href=y>and more of it</a></div><div>Imprint</div></body>"""
    assert text(html) == f"Heading\n{PROSE}\nShort one.\n{PROSE}"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("", ""),
        ("plain text without any tag", "plain text without any tag"),
        (f"<p>{PROSE}", PROSE),
        (f"<article><p>{PROSE}<p>{PROSE}<br><br>{PROSE}</article></b></div>", "\n".join([PROSE] * 3)),
        (f"<article><p>{PROSE}</p><p title='a > b'>It <b>is</b> <i>so</i>.</p></article><foot", f"{PROSE}\nIt is so."),
        (f"<article><pre>{PROSE}\n\n  x\t y</pre></article>", f"{PROSE} x y"),
        ("<article><script>never closed <p>text", ""),
    ],
)
def test_pages(html, expected):
    assert text(html) == expected


def test_made_pages_give_their_articles(spark):
    """Pages of several layouts, each with its known article."""
    rng = random.Random(11)
    words = "the of and to in a is that for it as was with be by on river stone house night water people valley mill dam wall leave come take rise hold clear".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(8, 30))).capitalize() + "."
    paragraph = lambda: " ".join(sentence() for _ in range(rng.randint(3, 6)))
    menu = lambda: "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(rng.choices(words, k=6)))
    rows, expected = [], {}
    for i in range(60):
        parts = [paragraph() for _ in range(rng.randint(1, 8))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>\n  {}\n</p>", "<div>{}</div>"]).format(p) for p in parts)
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "{}"])
        rows.append((i, f"u{i}", f"<html><body><nav><ul>{menu()}</ul></nav><div class='ad'>{sentence()}</div>{wrap.format(body)}<div class=sidebar>{paragraph()}</div><footer>&copy; {sentence()}</footer></body></html>", "x"))
        expected[i] = "\n".join(parts)
    rows += [(60, None, None, "x"), (None, "u", "", "x"), (61, "v", "<article>" + f"<p>{PROSE}</p>" * 3000, "x")]
    expected |= {60: "", None: "", 61: "\n".join([PROSE] * 3000)}
    found = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r.page_id: r.text for r in found} == expected
    assert all(r.n_chars == len(r.text) for r in found) and len(found) == len(rows)
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (f"<article><p title=it's>{PROSE}</p><p>It's {PROSE}</p></article>", f"{PROSE}\nIt's {PROSE}"),
        (f"<article><p title=its'>{PROSE}</p><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p title=\"open>{PROSE}</p><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        *[(f'<article><p>{PROSE}</p><p class="{c}">{PROSE}</p></article>', f"{PROSE}\n{PROSE}") for c in ("share-price", "notice-board", "related-work", "toc-list")],
        *[(f'<article><p>{PROSE}</p><div class="x {c}"><p>{PROSE}</p></div></article>', PROSE) for c in ("share-buttons", "shareButtons", "ad", "post-comments", "related-posts", "cookie_notice", "page-footer")],
        (f"<article><p><a href=a>{PROSE}</a> and</p><p>Short</p><p>{PROSE}</p></article>", f"{PROSE} and\nShort\n{PROSE}"),
        (f"<article><p><a href=a>{PROSE}</a></p></article>", PROSE),
        (f"<div>{PROSE}</div><div role='main'><p>{PROSE}!</p></div><div>{PROSE}</div>", f"{PROSE}!"),
        (f"<article><svg viewBox='0 0 1 1'/><p>{PROSE}</p><object data=x /><title-bar>t</title-bar><math><mi>x</mi><mo>=</mo><mn>2</mn></math></article>", f"{PROSE}\nt\nx=2"),
        (f"<article><p>{PROSE}</p><svg><text>no</text></svg><object>no</object><noscript>no</noscript></article>", PROSE),
        (f'<div class="layout has-sidebar"><article><p>{PROSE}</p></article></div>', PROSE),
        (f'<div class="sidebar"><article><p>{PROSE}</p></article></div>', PROSE),
        (f"<form id=all><div>{PROSE}</div></form>", PROSE),
        (f'<article><p>{PROSE}</p></article><ol class="comment-list"><li><article class=comment><p>{PROSE}</p></article></ol>', PROSE),
        (f"<article><p>{PROSE}</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>Short</p></article>", f"{PROSE}\nShort"),
        (f"<article><ul><li>{PROSE}<li class=ad>no {PROSE}<li>{PROSE}</ul></article>", f"{PROSE}\n{PROSE}"),
        (f"<head><title>T</title><p>{PROSE}</p>", PROSE),
        (f"<article><table><tr><td>{PROSE}</div></td><td><aside>no</aside>{PROSE}</table></article>", f"{PROSE}\n{PROSE}"),
    ],
)
def test_marks_quotes_and_links(html, expected):
    assert text(html) == expected


@pytest.mark.parametrize("piece", ["<b>", "<div>", "<i><div>", "<table><td>", "<b class=ad>", "<a href='", '<x y="', "<ul><li>", "</div>", "<!--", "<a <"])
def test_time_grows_with_length_only(piece):
    took = []
    for n in (10_000, 80_000):
        began = time.process_time()
        assert text(f"<article><p>{PROSE}</p>" + piece * n).startswith(PROSE)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


class Plain(HTMLParser):
    """Another parser: the text blocks of the article, without what its tags and classes mark."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.fresh = [], [], True

    def handle_starttag(self, tag, attrs):
        out = tag in ("nav", "aside", "footer", "form", "script", "style") or any((v or "") in ("ad", "share-buttons", "comments") for _, v in attrs)
        self.fresh = self.fresh or tag not in ("b", "i", "a", "span")
        if tag != "br":
            self.stack.append((tag, out))

    def handle_endtag(self, tag):
        self.fresh = self.fresh or tag not in ("b", "i", "a", "span")
        while self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(out for _, out in self.stack) and data.strip():
            if self.fresh:
                self.blocks.append("")
            self.blocks[-1] += data
            self.fresh = False
        elif self.blocks and not self.fresh:
            self.blocks[-1] += data if any(t == "article" for t, _ in self.stack) else ""


def test_random_articles_against_another_parser():
    rng = random.Random(17)
    words = "the of and to in a river stone house night water people valley mill dam wall leave come &amp; caf&eacute; &lt;b&gt; x".split()
    quote = lambda v: rng.choice(['"{}"', "'{}'", " {} "]).format(v).strip()
    extra = lambda: "".join(rng.choice([" data-x=it's", " hidden", ' title="a > b"', " lang=en", " data-y='<p>'", ""]) for _ in range(2))

    def inline():
        w = lambda: " ".join(rng.choices(words, k=rng.randint(3, 25)))
        parts = [rng.choice(["{}", "<b>{}</b>", f"<a href={quote('/x')}>{{}}</a>", f"<span{extra()}>{{}}</span>"]).format(w()) for _ in range(rng.randint(2, 4))]
        return " ".join([w(), *parts])

    def body(depth):
        kind = rng.random()
        if kind < 0.25 and depth < 6:
            return f"<{(t := rng.choice(['div', 'section', 'blockquote']))}{extra()}>{body(depth + 1)}{body(depth + 1)}</{t}>"
        if kind < 0.4:
            return rng.choice(["<aside>{}</aside>", "<nav>{}</nav>", f"<div class={quote('ad')}>{{}}</div>", f"<p id={quote('comments')}>{{}}</p>", "<form>{}</form>", "<script>{}<p></script>", "<!-- {} -->"]).format(inline())
        return f"<p{extra()}>{inline()}</p>"

    for _ in range(300):
        inner = "<p>" + inline() + "</p>" + "".join(body(0) for _ in range(rng.randint(1, 6)))
        html = f"<html><body><nav>{inline()}</nav><div>{inline()}</div><article{extra()}>{inner}</article><footer>{inline()}</footer></body></html>"
        other = Plain()
        other.feed(html)
        assert text(html) == "\n".join(" ".join(b.split()) for b in other.blocks), html


main_text = html_text.main_text
SENTENCE = "This is the plain sentence that was written for the page and it says that the words of it are in the order in which they have been put by the one who wrote it."
SCRIPTS = {
    "Cyrillic": "Это предложение на русском языке, которое стоит на странице без всякой разметки главной части. " * 4,
    "Han": "这是一个没有标记主要部分的网页上的中文段落，它应该被完整地保留下来。" * 5,
    "Greek": "Αυτή είναι μια πρόταση στα ελληνικά που βρίσκεται στη σελίδα χωρίς σήμανση του κύριου μέρους. " * 4,
    "Arabic": "هذه جملة باللغة العربية توجد في الصفحة دون أي علامة للجزء الرئيسي منها ويجب أن تبقى كاملة. " * 4,
    "Devanagari": "यह हिन्दी का एक वाक्य है जो पृष्ठ पर बिना किसी मुख्य भाग के चिह्न के लिखा हुआ है और इसे रहना चाहिए। " * 4,
    "Thai": "นี่คือประโยคภาษาไทยที่อยู่ในหน้าเว็บโดยไม่มีเครื่องหมายส่วนหลักและควรจะถูกเก็บไว้ทั้งหมด" * 4,
    "Latin, another language": "Questa frase italiana sta sulla pagina senza alcun segno della parte principale, quindi bisogna conservarla tutta quanta. " * 3,
}


@pytest.mark.parametrize("text", SCRIPTS.values(), ids=SCRIPTS.keys())
def test_whole_pages_in_languages_without_a_list(text):
    text = text.strip()
    menu = "<nav><a href='/a'>One</a> <a href='/b'>Two</a></nav><ul><li><a href='/c'>Three</a></li></ul>"
    assert main_text(f"<div>{text}</div>") == text
    assert main_text(f"{menu}<div><p>{text}</p><p>{text}</p></div><div class='footer'>{text}</div>") == f"{text}\n{text}"


def test_a_quote_in_another_script_stays_in_an_english_page():
    quote = SCRIPTS["Cyrillic"].strip()
    assert main_text(f"<div><p>{SENTENCE} {SENTENCE}</p><p>{quote}</p><p>{SENTENCE} {SENTENCE}</p></div>").split("\n")[1] == quote


def test_an_opening_paragraph_beside_a_menu_stays():
    page = f"<nav><a href='/'>Home</a></nav><div><p>{SENTENCE}</p><p>Short one.</p><p>{SENTENCE} {SENTENCE}</p></div>"
    assert main_text(page) == f"{SENTENCE}\nShort one.\n{SENTENCE} {SENTENCE}"
    assert main_text(f"<nav><a href='/'>Home</a></nav><p>{SENTENCE}</p><footer>Small print.</footer>") == SENTENCE
    # between two menus it goes, where the page has other text
    between = f"<p>{SENTENCE} {SENTENCE}</p><nav><a href='/'>Home</a></nav><p>{SENTENCE}</p><nav><a href='/'>Home</a></nav>"
    assert main_text(between) == f"{SENTENCE} {SENTENCE}"


def test_pages_of_short_blocks():
    assert main_text("<div><p>Yes.</p><p>No.</p></div>") == "Yes.\nNo."
    assert main_text("<nav>Menu</nav><p>Yes.</p><p><a href='/x'>Elsewhere</a></p><div class='cookie-notice'>We use some.</div>") == "Yes."
    assert main_text("<p><a href='/x'>Only</a></p><p><a href='/y'>links</a></p>") == ""


@pytest.mark.parametrize("name", ["ad-unit-300", "advert-slot", "google-ads", "user-comments", "reader-comments", "articleComments", "AdSlot_3", "comment-author", "page__sidebar", "story-newsletter"])
def test_compound_names_that_mark(name):
    for page in (f"<article><p>{SENTENCE} {SENTENCE}</p><div class='x {name}'>{SENTENCE} Buy.</div></article>", f"<article><p>{SENTENCE} {SENTENCE}</p><div id='{name}'><p>{SENTENCE} {SENTENCE} Mine.</p></div></article>"):
        assert main_text(page) == f"{SENTENCE} {SENTENCE}"


@pytest.mark.parametrize("name", ["share-price", "notice-board", "has-sidebar", "title-bar", "market-share", "commentary", "post-content", "no-comments", "adagio", "shadow-box"])
def test_compound_names_that_do_not(name):
    assert main_text(f"<article><div class='{name}'><p>{SENTENCE}</p></div></article>") == SENTENCE
