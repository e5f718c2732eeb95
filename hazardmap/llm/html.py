"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of tokens: words and tags.  A word scores positive, a tag negative, and one linear scan finds
the contiguous run of tokens with the highest sum.  How much a tag costs depends on its element; how much a word earns,
on whether it is a link and on the elements it stands in: their kind (`nav`, `footer`) and the whole words of their
class, id and role (`ad`, `cookie-notice`).  All these weights are learned from a small table of labelled pages by a
structured perceptron: tokens that the best run of a page lacks get dearer, those that it holds too much cheaper.
A word whose elements weigh more than a word's own score earns less than nothing (the words of one text together as
much as one, and their tags nothing, so that a long advert does not part an article).

A run takes the blocks at its ends whole, and one that has most of its score in one `article` (else `main`) element takes
that element whole; of the run, words go whose elements make them negative (an advert between two paragraphs, reader
comments at the end).  A kind or a class
that no labelled page holds weighs nothing, and neither headings nor the ids of sections and paragraphs weigh, so
text is never lost to a name.  The blocks of text that stay are the page's text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by two
line feeds in page order.  Null, empty and tag-only pages give an empty text.  Pages without any markup
are one block.  Broken markup (unclosed tags, a cut page) is read as far as it goes.  Time is linear in the
page's length, whatever its nesting.
"""

from __future__ import annotations

import html as codec
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, small_batches

#: Comments, CDATA, declarations and tags; a quote opens a value only right after "=".
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no text at all.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "option", "textarea", "button"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Elements that stand inside a line of text; every other tag ends a block, but for br, which is white space.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "header", "footer", "form", "pre", "blockquote", "hr", "figure", "main", "address", "fieldset", "details"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of any text: their kind says nothing about what stands in them.
FLOW = {"html", "body", "div", "p", "section", "main", "article", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre", "blockquote", "figure", "figcaption", "center", "details", "summary", "address"} | INLINE | HEADINGS | SILENT | VOID

#: The labelled table.  Parts of pages that are content ...
CONTENT = (
    "<h1>A title of words</h1><p>Some words of the story stand here in a row.</p><p>And more words of it follow in another paragraph.</p>",
    "<h2>Title here</h2><p>First part of a long text with many words.</p><ul><li>a point that is made</li><li>another point that is made</li></ul><p>The end of it all comes here.</p>",
    "<p>Words of a page that has no heading but many paragraphs.</p><p>They follow one another and are long enough.</p><blockquote>Someone said this at length.</blockquote>",
    '<h1>News of the day</h1><p>It was <b>said</b> that <a href="q">a link</a> may stand in a text.<br>So it goes on.</p><h2>Later</h2><p>More was told on the next day by the same people.</p>',
    "<h1>A heading</h1><p>The text of a page without any mark stands here.</p><table><tr><td>one cell</td><td>and two</td></tr><tr><td>three of them</td><td>and four</td></tr></table><pre>some code stands here</pre><p>It ends with these words.</p>",
    '<h1>Old page</h1><p>Pages of old have <i>no</i> elements that say what they are.<p>But they <a href="x">have links</a>, long paragraphs and <font color="red">colours</font>.<ul><li>First point of some length<li>Second point of some length</ul><p>Signed by the writer of this page.',
    '<h2>Sources</h2><p>All that was read for this text:</p><ul><li><a href="1">A book of many pages</a></li><li><a href="2">Another book by the same hand</a></li></ul><p>Each of them can be had.</p>',
    "<h1>Brief</h1><p>Short.</p>",
    '<section><h3>One step</h3><p>Take it slowly.</p></section><section class="text"><h3>The next</h3><div class="box"><p>Then go on from there as before.</p></div></section>',
    '<figure><img src="i"><figcaption>What is to be seen in the picture</figcaption></figure><p>The picture above shows it, as <em>was</em> said.</p><dl><dt>term</dt><dd>what it means in a few words</dd></dl>',
)
#: ... what goes round a page's content (%s) ...
ROUND = ("<article>%s</article>", "<main>%s</main>", '<div id="content">%s</div>', "<div>%s</div>", "%s", '<main><article class="post">%s</article></main>', "<table><tr><td>%s</td></tr></table>", '<div class="page"><div class="main">%s</div></div>')
#: ... and parts that are none.
ASIDE = (
    '<nav><ul><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul></nav>',
    '<div class="ad">Buy this now, it is cheap and good. Buy it today.</div>',
    "<footer>Site &middot; words here and all rights kept by those who made it.</footer>",
    '<header><h1>Site name</h1><a href="/">Home</a> and a line that says what it is for</header>',
    '<aside><h3>Other news</h3><p>Something else took place, too.</p> <a href="#">more</a></aside>',
    '<form><p>Tell us what you think of all this.</p><input name="q"><button>Go</button></form>',
    '<div class="cookie-notice">We use cookies, as all others do. <a href="c">Why?</a></div>',
    '<section class="comments"><p>Nice one! I liked how it was told.</p><p>I agree with what was said.</p></section>',
    '<div id="menu"><a href="a">A</a> <a href="b">B</a> <a href="c">C and more</a></div>',
    '<section class="related"><h3>Related</h3><a href="r">Read this too, it is much the same</a></section>',
    '<div id="sidebar"><h4>About</h4><p>This site was made by a few people.</p></div>',
    '<ul class="share"><li><a href="1">Share it</a></li><li><a href="2">Send it on</a></li></ul>',
    '<div id="comments"><h3>What readers say</h3><p>First! And last, as it seems.</p></div>',
    '<div class="newsletter"><p>Get our news by mail every week, for free.</p></div>',
    '<div id="footer">Made by us in our own time. <a href="i">Imprint</a></div>',
    '<div id="header"><a href="/">Home</a> The site of all sites for you and me</div>',
    '<div class="sidebar"><p>Words that stand on every page of the site.</p></div>',
    '<div role="navigation"><a href="1">First</a> <a href="2">Second</a> of all pages</div>',
    '<div class="advertisement"><p>The best of all shoes. Try them on and see.</p></div>',
    '<div class="banner">Now new in all our shops near you</div>',
    '<div class="comment"><p>What a fine text, thank you so much for it.</p></div>',
    '<ul class="breadcrumb"><li><a href="1">Home</a></li><li>Here you are</li></ul>',
    '<div class="social">Follow us here and there and where you like</div>',
    '<div class="nav"><a href="1">Start</a> <a href="2">Go on</a></div>',
    '<div class="ads"><p>Cheap flights to all the towns of the world.</p></div>',
    '<div role="complementary"><p>More things that you may want to know.</p></div>',
    '<div class="popup"><p>Wait, do not go yet, there is more.</p></div>',
    '<dialog open><p>You have to say yes first, then read on.</p></dialog>',
    '<div class="footer"><p>All rights are kept. Write to us by mail.</p></div>',
    '<div class="menu"><a href="1">Food</a> <a href="2">Drinks and more</a></div>',
    '<p class="notice">This page was not checked by anyone so far.</p>',
    '<div class="sponsored"><p>A word from those who pay for this.</p></div>',
    '<div role="banner"><p>The house paper of our town since long.</p></div>',
    '<div id="nav"><a href="1">Here</a> or <a href="2">there</a></div>',
    '<div class="widget"><p>The weather is fine today in our town.</p></div>',
    '<div role="contentinfo"><p>Who we are and where to find us.</p></div>',
    '<div class="promo"><p>Two for the price of one, this week only.</p></div>',
    '<div class="cookie-banner"><p>May we store a thing or two with you?</p></div>',
    '<ul class="breadcrumbs"><li><a href="1">Top</a></li><li>This page</li></ul>',
    '<div class="header"><p>Daily paper for the north and the south.</p></div>',
    '<div class="advert"><p>Fine chairs for your home, at half price.</p></div>',
    '<ol class="comment-list"><li>Not bad at all.</li><li>It could be better, I think.</li></ol>',
    '<div class="related-posts"><h3>See also</h3><p>What we wrote on the same thing before.</p></div>',
    '<div class="site-footer"><p>By the makers of other such sites.</p></div>',
    '<div class="site-header"><p>A site for those who read.</p></div>',
    '<div class="subscribe"><p>Read all of it for one coin a day.</p></div>',
    '<div class="modal"><p>Please log in to go on with this.</p></div>',
    '<menu><li>Cut this</li><li>Copy that</li></menu>',
)
#: Lists of links that nothing names; they stand before or after the content only.
LINKS = (
    '<ul><li><a href="1">Start</a></li><li><a href="2">News</a></li><li><a href="3">Sport</a></li><li><a href="4">About us</a></li></ul>',
    '<table><tr><td><a href="a">Home</a></td><td><a href="b">Shop</a></td></tr></table>',
    '<ul><li><a href="i">Imprint</a></li><li><a href="p">Privacy</a></li><li><a href="c">Contact</a></li></ul>',
    '<div><a href="a">Home</a> | <a href="b">Shop</a> | <a href="c">All that we do</a></div>',
)
#: A head inside an article is its own.
OWN_HEAD = "<header><h1>The title of it</h1><p>By one who knows it well</p></header>"


class Token(NamedTuple):
    """kind: 'text' or 'tag' (closing ones with /); at: where it starts; keys: what its weight depends on, those of the elements
    around apart; article, main: number of the element around (0: none)."""

    kind: str
    value: str
    at: int
    keys: tuple[str, ...]
    around: tuple[str, ...]
    article: int
    main: int


def element_keys(name: str, attributes: str, in_article: bool) -> tuple[str, ...]:
    """What an element says about the words in it."""
    if name in HEADINGS or name in ("html", "body", "main", "article"):
        return ()
    keys = [] if name in FLOW or name == "header" and in_article else [f"in {name}"]
    for m in _ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind in ("class", "role") or kind == "id" and name not in ("section", "p"):
            keys += [f"{'role' if kind == 'role' else 'name'} {word}" for word in (m[2] or m[3] or m[4] or "").lower().split()]
    return tuple(dict.fromkeys(keys))


def tokens(page: str) -> Iterator[Token]:
    """Text and tags outside elements that hold no text."""
    stack: list[tuple[str, tuple[str, ...]]] = []  # names, and keys of all elements down to each
    blocks: list[int] = []  # places in the stack of elements that are not inline
    count: Counter[str] = Counter()
    at, quiet, serial = 0, 0, 0
    around = {"article": [0], "main": [0]}

    def close(upto: int) -> None:
        nonlocal quiet
        while len(stack) > upto:
            name, _ = stack.pop()
            count[name] -= 1
            quiet -= name in SILENT
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if name in around:
                around[name].pop()

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not quiet:
            keys = ("word", "word a") if count["a"] else ("word",)
            yield Token("text", page[at:end], at, keys, stack[-1][1] if stack else (), around["article"][-1], around["main"][-1])
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        shown = not quiet
        inside = around["article"][-1], around["main"][-1]
        keys = stack[-1][1] if stack else ()
        if m[1]:
            if count[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
        else:
            if name in _CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)
            if name not in VOID:
                outer = stack[-1][1] if stack else ()
                own = element_keys(name, m[3] or "", bool(around["article"][-1]))
                keys = outer if not own or set(own) <= set(outer) else tuple(dict.fromkeys(outer + own))
                if name not in INLINE:
                    blocks.append(len(stack))
                stack.append((name, keys))
                count[name] += 1
                quiet += name in SILENT
                if name in around:
                    serial += 1
                    around[name].append(around[name][-1] or serial)  # the outermost one counts
                    inside = around["article"][-1], around["main"][-1]
                if name in _RAW:
                    stop = re.compile(rf"</{name}\b", re.I).search(page, at)
                    at = stop.start() if stop else len(page)
        if shown or not quiet:
            yield Token("tag", ("/" if m[1] else "") + name, m.start(), (f"tag {name}",), keys, *inside)


Weights = dict[str, float]


def score(token: Token, weights: Weights) -> float:
    """Of a word: the sum of its weights for each word of the text, once for all of them where it is foreign; of a tag: less its weight, nothing where it is foreign."""
    if token.kind == "tag":
        return 0.0 if foreign(token, weights) else -weights.get(token.keys[0], weights["tag"])
    words = len(token.value.split())
    return sum(weights.get(k, 0.0) for k in token.keys + token.around) * (min(words, 1) if foreign(token, weights) else words)


def labelled() -> Iterator[tuple[list[Token], list[bool]]]:
    """Tokens of the labelled pages, and which of them are content.  Every side part stands once before, inside and after content."""
    n = len(ASIDE)
    for i in range(n):
        body, frame = CONTENT[i % len(CONTENT)], ROUND[i % len(ROUND)]
        first, inner, last = ASIDE[i], ASIDE[(i + 17) % n], ASIDE[(i + 31) % n]
        cut = body.find("<p>", 4)
        head = OWN_HEAD if "<article" in frame and i % 3 == 0 else ""
        link = LINKS[i % len(LINKS)] if i % 3 == 1 else ""
        parts = [(link + first, False), (frame.split("%s")[0], False), (head + body[:cut], True), (inner if i % 2 else "", False), (body[cut:], True), (frame.split("%s")[1], False), (last + link, False)]
        page, spans = "<html><head><title>A b</title><style>p{}</style></head><body>", []
        for text, gold in parts:
            if gold:
                spans.append((len(page), len(page) + len(text)))
            page += text
        seen = [*tokens(page + "</body></html>")]
        yield seen, [any(a <= t.at < b for a, b in spans) for t in seen]


def foreign(token: Token, weights: Weights, margin: float = 0.0) -> bool:
    """Do the elements around a word make it negative, link or not?"""
    return bool(token.around) and weights["word"] + sum(weights.get(k, 0.0) for k in token.around) < margin


@lru_cache(1)
def train(rounds: int = 200, rate: float = 0.05, margin: float = 0.5) -> Weights:
    """Weights by key, by rounds over the labelled pages until none is wrong; "tag" is that of elements that they lack.

    A word of content must stay `margin` over 0 by its elements, any other word as much under it.
    """
    pages = [*labelled()]
    weights: Weights = {"word": 1.0, "word a": 0.0, "tag": 0.5} | {t.keys[0]: 0.5 for seen, _ in pages for t in seen if t.kind == "tag"}
    for _ in range(rounds):
        wrong = 0
        for seen, gold in pages:
            lo, hi = best_run([score(t, weights) for t in seen])
            inside = [i for i, g in enumerate(gold) if g]
            for i, t in enumerate(seen):
                chosen = lo <= i < hi
                if t.kind == "tag":
                    if chosen != (inside[0] <= i <= inside[-1]) and not foreign(t, weights):
                        weights[t.keys[0]] *= math.exp(rate if chosen else -rate)
                elif t.value.strip():
                    if t.around and (not foreign(t, weights, margin if gold[i] else -margin)) != gold[i]:
                        wrong += 1
                        for k in t.around:
                            weights[k] = weights.get(k, 0.0) + (rate if gold[i] else -rate)
                    if chosen != gold[i] and "word a" in t.keys:
                        weights["word a"] += rate if gold[i] else -rate
        if not wrong:
            break
    own = [math.log(w) for k, w in weights.items() if k.startswith("tag ")]
    return weights | {"tag": math.exp(sum(own) / len(own))}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the highest sum (first and longest among equals); empty if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total >= best and total > 0:
            best, found = total, (start, i + 1)
    return found


def whole_blocks(seen: list[Token], lo: int, hi: int) -> tuple[int, int]:
    """The run with all of the blocks that it starts and ends in."""
    ends = lambda t: t.kind == "tag" and t.value.lstrip("/") not in INLINE and t.value.lstrip("/") != "br"
    while lo < hi and lo > 0 and not ends(seen[lo]) and not ends(seen[lo - 1]):
        lo -= 1
    while lo < hi < len(seen) and not ends(seen[hi - 1]) and not ends(seen[hi]):
        hi += 1
    return lo, hi


def widened(seen: list[Token], scores: list[float], lo: int, hi: int) -> tuple[int, int]:
    """The run, or with it the whole of the article (else main) element in which most of its score lies."""
    for of in (lambda t: t.article, lambda t: t.main):
        sums: Counter[int] = Counter()
        for t, x in zip(seen[lo:hi], scores[lo:hi]):
            sums[of(t)] += max(x, 0.0)
        best = max(sums, key=sums.__getitem__, default=0)
        if best and 2 * sums[best] > sum(sums.values()):
            own = [i for i, t in enumerate(seen) if of(t) == best]
            return min(lo, own[0]), max(hi, own[-1] + 1)
    return lo, hi


def main_text(page: str | None, run_only: bool = False) -> str:
    """The text of a page; run_only gives what the best run alone holds."""
    if not page:
        return ""
    weights = train()
    seen = [*tokens(page)]
    scores = [score(t, weights) for t in seen]
    lo, hi = whole_blocks(seen, *best_run(scores))
    if not run_only:
        lo, hi = widened(seen, scores, lo, hi)
    blocks: list[list[str]] = [[]]
    for t in seen[lo:hi]:
        if t.kind == "text":
            if run_only or not foreign(t, weights):
                blocks[-1].append(codec.unescape(t.value))
        elif (name := t.value.lstrip("/")) == "br":
            blocks[-1].append(" ")
        elif name not in INLINE:
            blocks.append([])
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points); columns of these names are replaced."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("struct<text:string,n_chars:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(p) for p in batch]
            yield pd.DataFrame({"text": found, "n_chars": pd.Series([len(t) for t in found], dtype="int64")})
        release()

    out = pages.withColumn("__main", run(F.col(html)))
    return out.withColumns({"text": F.col("__main.text"), "n_chars": F.col("__main.n_chars")}).drop("__main")
