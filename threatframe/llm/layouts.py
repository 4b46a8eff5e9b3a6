"""Training pages for operator 12: sampled texts set in many layouts with known roles.

`pages` carries no labels.  What the sampled pages say by their own tags gives texts
of both kinds; this module sets them again in layouts that differ in tags, attribute
words, nesting, order, omitted end tags and missing attributes.  Every element whose
role is known from the layout carries it as `data-truth`: k (main text), d (anything
else) or m (holds both); elements without one share their parent's.
"""

from __future__ import annotations

from html import escape
from random import Random

_PREFIX = ["", "", "", "site-", "page-", "main-", "the-", "c-", "js-", "x12 ", "wrap ", "block-", "col-8 "]
_SUFFIX = ["", "", "", "-wrap", "-inner", "-container", "-block", "-area", "-box", "-1", " clearfix", "__list"]
_NOISE = ["", "wrapper", "container", "row", "inner", "layout grid", "page", "outer", "a1b2", "css-19x"]


class Layout:
    """One random page from paragraphs of main text, phrases and other paragraphs."""

    def __init__(self, rng: Random, paragraphs: list[str], phrases: list[str], others: list[str]):
        self.r, self.paragraphs, self.phrases, self.others = rng, paragraphs, phrases, others
        #: on some pages attributes say nothing
        self.named = rng.random() < 0.8
        self.closed = rng.random() < 0.75

    def tag(self, name: str, inside: str, role: str = "", words: str = "") -> str:
        r, attributes = self.r, ""
        if words and self.named:
            word = r.choice(words.split())
            value = (r.choice(_PREFIX) + word + r.choice(_SUFFIX)) if r.random() < 0.6 else word
            attributes = f' {r.choice(["class", "class", "id"])}="{value}"'
        elif r.random() < 0.2:
            attributes = f' class="{r.choice(_NOISE)}"'
        if role:
            attributes += f' data-truth="{role}"'
        if name in ("p", "li") and not self.closed and r.random() < 0.7:
            return f"<{name}{attributes}>{inside}"
        return f"<{name}{attributes}>{inside}</{name}>"

    def phrase(self, most: int = 8) -> str:
        words = self.r.choice(self.phrases).split() or ["x"]
        k = self.r.randrange(len(words))
        return escape(" ".join(words[k:k + self.r.randint(1, most)]))

    def prose(self, text: str) -> str:
        """A paragraph's inside, at times with inline markup."""
        words = escape(text).split(" ")
        if self.r.random() < 0.4 and len(words) > 3:
            k = self.r.randrange(len(words) - 1)
            t = self.r.choice(["b", "i", "em", "strong", "span", "a", "code"])
            words[k] = f"<{t}>{words[k]}" + (f"</{t}>" if self.r.random() < 0.8 else "")
        return " ".join(words) + ("<br>" if self.r.random() < 0.15 else "")

    def links(self, most: int = 8) -> str:
        items = [f'<a href="/x">{self.phrase(3)}</a>' for _ in range(self.r.randint(1, most))]
        way = self.r.random()
        if way < 0.6:
            return "<ul>" + "".join(self.tag("li", x) for x in items) + "</ul>"
        return (" | " if way < 0.8 else " ").join(items)

    # --- parts that are not main text ---

    def menu(self) -> str:
        if self.r.random() < 0.5:
            return self.tag("nav", self.links(), "d", "menu nav")
        return self.tag(self.r.choice(["div", "ul", "section"]), self.links(), "d",
                        "nav menu navbar navigation breadcrumb pagination topnav tabs links")

    def header(self) -> str:
        inside = [self.tag(self.r.choice(["h1", "h2", "div", "p", "a"]), self.phrase(4), words="logo brand title")]
        inside += [self.r.choice([self.menu, self.form, lambda: self.tag("p", self.phrase())])()
                   for _ in range(self.r.randint(0, 2))]
        name = "header" if self.r.random() < 0.5 else "div"
        return self.tag(name, "".join(inside), "d", "header masthead topbar banner branding")

    def footer(self) -> str:
        text = self.r.choice(["&copy; ", "Copyright ", "", "&copy; 2024 &middot; "]) + self.phrase(14)
        inside = self.r.choice([text, self.tag("p", text), self.links() + self.tag("p", text),
                                self.tag("div", self.links()) + text])
        return self.tag("footer" if self.r.random() < 0.6 else "div", inside, "d",
                        "footer foot copyright colophon legal imprint")

    def advert(self) -> str:
        text = self.r.choice([self.phrase(12), escape(self.r.choice(self.others))])
        inside = self.r.choice([text, self.tag("p", text), f'<a href="/x">{text}</a>',
                                self.tag("h3", self.phrase(4)) + self.tag("p", text)])
        return self.tag(self.r.choice(["div", "div", "section", "aside", "p", "span"]), inside, "d",
                        "ad ads advert advertisement sponsored promo sponsor adbox promoted")

    def notice(self) -> str:
        text = self.r.choice([self.phrase(14), escape(self.r.choice(self.others))])
        inside = self.r.choice([text, self.tag("p", text),
                                self.tag("p", text) + f"<button>{self.phrase(2)}</button>",
                                self.tag("h2", self.phrase(4)) + self.tag("p", text)])
        return self.tag(self.r.choice(["div", "div", "section", "p", "dialog", "aside"]), inside, "d",
                        "notice alert cookie consent gdpr message warning announcement disclaimer popup modal")

    def form(self) -> str:
        inside = "".join(self.r.choice([
            f"<label>{self.phrase(3)}</label><input type=text>", f"<button>{self.phrase(2)}</button>",
            self.tag("p", self.phrase(10)), f"<select><option>{self.phrase(2)}<option>{self.phrase(2)}</select>",
            "<textarea>x</textarea>", self.tag("h3", self.phrase(4))]) for _ in range(self.r.randint(1, 4)))
        return self.tag("form" if self.r.random() < 0.8 else "div", inside, "d",
                        "login search newsletter contact signup form register")

    def sidebar(self) -> str:
        parts = [lambda: self.tag("h3", self.phrase(4)) + self.links(), self.advert, self.form,
                 lambda: self.tag("p", escape(self.r.choice(self.others))),
                 lambda: self.tag("div", self.tag("h4", self.phrase(3)) + self.tag("p", self.phrase(20)))]
        inside = "".join(self.r.choice(parts)() for _ in range(self.r.randint(1, 4)))
        return self.tag("aside" if self.r.random() < 0.55 else "div", inside, "d",
                        "sidebar widget aside rail complementary widgets related")

    def comments(self) -> str:
        out = []
        for _ in range(self.r.randint(1, 5)):
            body = "".join(self.tag("p", self.prose(self.r.choice(self.others)))
                           for _ in range(self.r.randint(1, 2)))
            if self.r.random() < 0.6:
                body = self.tag(self.r.choice(["h4", "span", "div", "p"]), self.phrase(3), words="author byline") + body
            out.append(self.tag(self.r.choice(["div", "li", "article", "section"]), body,
                                words="comment reply response comments"))
        head = self.tag(self.r.choice(["h2", "h3"]), self.phrase(3)) if self.r.random() < 0.7 else ""
        tail = self.form() if self.r.random() < 0.4 else ""
        return self.tag(self.r.choice(["div", "section", "ol", "aside"]), head + "".join(out) + tail, "d",
                        "comments comment commentlist discussion responses replies feedback reviews")

    def related(self) -> str:
        inside = self.tag("h3", self.phrase(4)) + self.links()
        return self.tag(self.r.choice(["div", "section", "aside", "ul"]), inside, "d",
                        "related recommended more popular share social tags trending")

    # --- main text ---

    def block(self, text: str) -> str:
        way = self.r.random()
        if way < 0.8:
            return self.tag("p", self.prose(text))
        if way < 0.85:
            return "<blockquote>" + self.tag("p", self.prose(text)) + "</blockquote>"
        if way < 0.9:
            words = text.split(" ")
            k = max(1, len(words) // self.r.randint(1, 4))
            t = self.r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(self.tag("li", escape(" ".join(words[i:i + k])))
                                      for i in range(0, len(words), k)) + f"</{t}>"
        if way < 0.93:
            return self.tag("div", self.prose(text))
        if way < 0.96:
            return f"<figure><img src=x><figcaption>{escape(text[:80])}</figcaption></figure>"
        return self.tag("section", self.tag("h2", self.phrase(6)) + self.tag("p", self.prose(text)))

    def main(self) -> str:
        r = self.r
        body = []
        if r.random() < 0.85:
            head = self.tag(r.choice(["h1", "h1", "h1", "h2"]), self.phrase(12), words="title headline entry")
            body.append(self.tag("header", head, words="entry post article") if r.random() < 0.2 else head)
        for text in self.paragraphs:
            if r.random() < 0.1:
                body.append(self.tag(r.choice(["h2", "h3"]), self.phrase(6)))
            body.append(self.block(text))
            if r.random() < 0.08:
                body.append(r.choice([self.advert, self.notice, self.form, self.sidebar, self.related])())
        if r.random() < 0.3:
            body.append(r.choice([self.comments, self.related, self.advert, self.footer, self.form])())
        inside, way = "".join(body), r.random()
        words = "content article post entry story main text"
        if way < 0.45:
            out = self.tag("article", inside, "k", words)
            return self.tag("main", out, "k") if r.random() < 0.3 else out
        if way < 0.6:
            return self.tag("main", inside, "k", words)
        if way < 0.9:
            out = self.tag(r.choice(["div", "section"]), inside, "k", words)
            return self.tag("div", out, "k", words) if r.random() < 0.3 else out
        if way < 0.95:
            return f'<table data-truth=m><tr data-truth=m><td data-truth=k>{inside}</td>' \
                   f'<td data-truth=d>{self.links()}</td></tr></table>'
        return f'<div data-truth=k>{inside}</div>'

    def page(self) -> str:
        r = self.r
        before = [f() for f in (self.notice, self.header, self.menu, self.advert, self.form)
                  if r.random() < 0.45]
        r.shuffle(before)
        after = [f() for f in (self.comments, self.related, self.sidebar, self.advert, self.notice)
                 if r.random() < 0.35]
        r.shuffle(after)
        if r.random() < 0.75:
            after.append(self.footer())
        side = [self.sidebar()] if r.random() < 0.3 else []
        middle = [self.main(), *side]
        r.shuffle(middle)
        inside = "".join(middle)
        if r.random() < 0.35:
            inside = self.tag(r.choice(["div", "div", "main", "section"]), inside, "m", "content wrapper main page")
        inside = "".join(before) + inside + "".join(after)
        if r.random() < 0.3:
            inside = self.tag("div", inside, "m", "page wrapper container site")
        script = "<script>var t='</p>';</script>" if r.random() < 0.3 else ""
        return f"<html data-truth=m><head><title>x</title></head><body data-truth=m>{script}{inside}</body></html>"
