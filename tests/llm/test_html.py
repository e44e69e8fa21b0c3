import html
import random
import re
import time

import pytest

from judgefuse.llm import html_text as H
from judgefuse.llm.html_text import blocks_of, extract, main_text

LONG = "The house of the king is on a hill and it was built by the people who lived in the town for many years. " * 3


def test_article_page():
    page = (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
            f"<div class='ad'>Buy now</div><article><h1>Head &amp; tail</h1><p>{LONG}<p>Short  one\n here.<br>x&lt;y</p>"
            f"<script>var a='</p>';</script></article><div id=comments><p>{LONG}</p></div>"
            f"<form><p>{LONG}</p></form><footer>&copy; {LONG}</footer></body></html>")
    assert main_text(page) == "\n".join(["Head & tail", LONG.strip(), "Short one here.", "x<y"])


def test_block_rules_without_article():
    page = (f"<body><div><a href=1>one</a> <a href=2>two</a></div><h2>Title</h2><div>{LONG}</div><div>A short line.</div>"
            f"<p>{LONG}</p><div><a href=3>more links to other pages of this site</a></div><p>tail</p></body>")
    assert main_text(page) == "\n".join(["Title", LONG.strip(), "A short line.", LONG.strip()])


def test_broken_pages():
    assert main_text("") == ""
    assert main_text("<!-- only") == ""
    assert main_text("<script>never closed") == ""
    assert main_text(f"<article><p>{LONG}") == LONG.strip()
    assert main_text("<article><div><p>a</article>b") == "a"


def test_links_and_menus_inside_an_article():
    menu = "".join(f"<li><a href=/{k}>Entry {k}</a>" for k in range(5))
    page = f"<article><p>{LONG}</p><p><a href=/x>One linked line</a></p><ul>{menu}</ul><p>{LONG}</p><p>© me</p></article><p>{LONG}</p>"
    assert main_text(page) == "\n".join([LONG.strip(), "One linked line", LONG.strip(), "© me"])


def test_wrappers_and_comment_articles():
    page = (f"<body class='has-sidebar'><div class='content-sidebar-wrap'><article class=post><p>{LONG}</p></article>"
            f"<div class='sidebar'><p>{LONG}</p></div></div><section id=comments><article class=comment><p>{LONG}</p></article>"
            f"</section><aside><article><p>{LONG}</p></article></aside></body>")
    assert main_text(page) == LONG.strip()


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "v", f"<article><p>{LONG * 200}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' as TEXT")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect())
    want = " ".join((LONG * 200).split())
    assert got == [(1, "", 0), (1, "", 0), (2, "", 0), (3, want, len(want))]
    assert extract(df.limit(0)).count() == 0


def test_teaser_articles_below_furniture_names():
    teasers = "".join(f"<article><p>Teaser {k}: {LONG}</p></article>" for k in range(2))
    for around in ("related", "sidebar"):
        for body in (f"<article><p>{LONG * 4}</p></article>", f"<div><p>{LONG * 4}</p><p>{LONG * 4}</p></div>"):
            page = f"<body>{body}<div class='{around}'>{teasers}</div></body>"
            got = main_text(page)
            assert "Teaser" not in got and LONG.strip() in got
    nested = f"<article><p>{LONG}</p><div class=related><article><p>Teaser {LONG}</p></article></div></article>"
    assert main_text(nested) == LONG.strip()


def test_passes_decide_inside_a_mark():
    promo = "<div>" + "<a href=/x>Read the story that all the people of the town are talking about</a> " * 3 + "</div>"
    links = "".join(f"<div><a href=/{k}>Story {k}</a></div>" for k in range(4))
    page = f"<article><p>{LONG}</p><p>A short line.</p><p>{LONG}</p>{promo}<p>Share this</p>{links}</article>"
    assert main_text(page) == "\n".join([LONG.strip(), "A short line.", LONG.strip()])


def test_text_outside_a_small_mark():
    page = f"<body><article><p>A teaser.</p></article><div>{LONG}</div><div>{LONG}</div></body>"
    assert main_text(page).count(LONG.strip()) == 2


def test_unknown_language():
    text = "Talon ikkunat avautuvat merelle ja illalla valo lankeaa lattialle pitkinä raitoina kunnes aurinko laskee. " * 3
    page = f"<body><div>{text}</div><div>Lyhyt rivi.</div><div>{text}</div><div><a href=/1>{text}</a></div></body>"
    assert main_text(page) == "\n".join([text.strip(), "Lyhyt rivi.", text.strip()])


def test_names_are_a_prior():
    prose = LONG.strip()
    assert main_text(f'<body><div id="social-history"><h1>The guild</h1><p>{LONG}</p></div></body>') == f"The guild\n{prose}"
    assert main_text(f'<body><div class="notice-board"><p>{LONG}</p><p>{LONG}</p></div></body>') == f"{prose}\n{prose}"
    assert main_text(f'<article><h1>The guild</h1><div class="social-text"><p>{LONG}</p></div></article>') == f"The guild\n{prose}"
    page = f'<body><div class="notice-board"><p>{LONG}</p><div class="widget"><p>{LONG}</p></div><p>{LONG}</p></div></body>'
    assert main_text(page) == f"{prose}\n{prose}"          # the named part of a released one is judged by itself
    assert main_text(f'<body><div class="sidebar"><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>') == f"{prose}\n{prose}"
    assert main_text(f'<div style="overflow: hidden" aria-hidden="false"><p>{LONG}</p></div>') == prose
    assert main_text(f'<div><p>{LONG}</p><p hidden>{LONG}</p></div>') == prose


def test_optional_end_tags():
    prose = LONG.strip()
    row = f"<tr><td class=ad>Buy now<td><p>{LONG}<td>{LONG}"
    assert main_text(f"<article><table>{row}{row}</table></article>") == "\n".join([prose] * 4)
    assert main_text(f"<article><ul><li class=promo>Buy<li>{LONG}</ul><p>{LONG}</article>") == f"{prose}\n{prose}"
    assert main_text(f"<article><dl><dt class=ad>Buy<dd>{LONG}</dl></article>") == prose


@pytest.mark.parametrize("unit", ["<li>item", "<tr><td>cell", "<div>text ", "<div class=widget>text ", "<a href=\"x y ", "<a b='c \"d ",
                                  "<svg> x ", "<a ", "<p class='", "</div", "<!", "<article><li>x", "<span class=ad>y"])
def test_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    begin = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - begin < 15  # quadratic scans took hours


def plain_blocks(page):
    """The same blocks by definition: tag ends by character, every fact by a walk over the open elements."""
    out, stack, parts, at, begin, linked, links = [], [], [], 0, 0, 0, 0
    state = (False, False, 0, False, False)
    number = 0

    def close():
        nonlocal parts, linked
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if text:
            out.append((text, linked, *state))
        parts, linked = [], 0

    def facts():
        soft = [x[3] for x in stack if x[1] == H.SOFT]
        return (any(x[1] == H.FIRM for x in stack), any(x[2] for x in stack), soft[-1] if soft else 0,
                any(x[0] in H.HEADINGS for x in stack), any(x[0] == "li" for x in stack))

    def last(tags):
        return max((k for k, x in enumerate(stack) if x[0] in tags), default=-1)

    def tag_end(k):
        first, quote = k, ""
        while k < len(page):
            c = page[k]
            if quote:
                quote = "" if c == quote else quote
            elif c == ">":
                return k
            elif c in "\"'":
                quote = c
            k += 1
        return page.find(">", first)

    def text_upto(k):
        nonlocal linked
        if k > begin:
            piece = html.unescape(page[begin:k])
            parts.append(piece)
            linked += len(re.sub(r"\s+", " ", piece).strip()) if links else 0

    while True:
        m = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)").search(page, at)
        if not m:
            text_upto(len(page))
            break
        if not m[2]:
            text_upto(m.start())
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            at = begin = len(page) if end < 0 else end + len(mark)
            continue
        end = tag_end(m.end())
        if end < 0:
            at = m.end()
            continue
        text_upto(m.start())
        at = begin = end + 1
        tag, attributes, closing = m[2].lower(), page[m.end():end], bool(m[1])
        if not closing and tag in H.NO_TEXT and not attributes.rstrip().endswith("/"):
            e = re.compile(rf"</{tag}\b[^<>]*>", re.I).search(page, at)
            at = begin = e.end() if e else len(page) if tag in ("script", "style") else at
            if tag in H.BLOCK:
                close()
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in H.BLOCK:
            close()
            links = 0
        if tag in H.VOID or tag not in H.BLOCK and not closing and not attributes:
            continue
        if closing:
            k = last((tag,))
            if k < 0 or tag in ("p", "li", "div") and last(H.SECTIONS) > k:
                continue
            if stack[k][1] or stack[k][2]:
                close()
            del stack[k:]
        else:
            if tag in H.BLOCK and last(("p",)) > last(H.PARAGRAPH_EDGES):
                del stack[last(("p",)):]
            ended, edges = H.ENDS.get(tag, ((), ()))
            while ended and last(ended) > last(edges):
                del stack[last(ended):]
            furniture = H.is_furniture(tag, attributes, any(x[2] for x in stack))
            if furniture:
                close()
            if not attributes.rstrip().endswith("/"):
                number += 1
                stack.append((tag, furniture, tag in ("article", "main") and not furniture, number))
        if facts()[:3] != state[:3]:
            close()
        state = facts()
    close()
    return out


def test_blocks_against_plain_version():
    rng = random.Random(5)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<table>", "</table>", "<tr>", "<td>", "<th>", "</td>",
              "<article>", "</article>", "<main>", "</main>", "<div class='ad'>", "<p class=widget>", "<span id=sidebar>", "</span>",
              "<nav>", "</nav>", "<aside>", "</aside>", "<h2>", "</h2>", "<a href=x>", "</a>", "<a href=\"q", "<b c='", "\"", "'", ">", "<", "<br>",
              "<br/>", "<!-- c", "-->", "<!x>", "<svg>", "</svg>", "<script>", "</script>", "<dt>", "<dd>", "<dl>", "</dl>", "<option>", "&amp;",
              "word ", "two words ", "\n", "x" * 80, "<header>", "</header>", "<section hidden>", "</section>", "<tbody>", "<div/>"]
    for _ in range(4000):
        page = "".join(rng.choices(pieces, k=rng.randint(1, 40)))
        got, around = blocks_of(page)
        assert [(b.text, b.linked, b.bad, b.inside, b.soft, b.heading, b.item) for b in got] == plain_blocks(page), page
        assert all(outer < k for k, outer in around.items())
