"""Labelled pages to train on: pages of many makes, their main text marked by an attribute.

The tables at hold have no labelled pages, so these are made from a rule, with
invented words: site headers, menus, sidebars, notices, adverts, forms, comments
and footers around and inside of an article, under the names that sites usually
give them, or under none.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from caseloom.llm.page_blocks import LABEL

# Names that pages give to their parts, and words that stand in them, in four languages.
NAMES = {
    "menu": "nav menu navbar navigation main-menu topnav site-nav breadcrumb breadcrumbs pagination tabs mobile-nav toc-nav".split(),
    "header": "header site-header masthead banner top branding page-header topbar".split(),
    "footer": "footer site-footer bottom page-footer colophon copyright legal foot".split(),
    "sidebar": "sidebar side aside widget related related-posts secondary right-col rail recommended trending popular tags sidebar-content".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert newsletter subscribe subscription paywall popup modal message promo-bar".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo ad-slot banner-ad google-ad adsbygoogle commercial".split(),
    "share": "share social sharing share-buttons follow toolbar actions".split(),
    "comments": "comments comment comment-list responses discussion disqus replies reply comment-body reader-comments".split(),
    "content": "content article post entry main story article-body post-content entry-content main-content text body page story-body".split(),
}
WORDS = {
    "menu": "Home,About,Contact,News,Sports,Start,Accueil,Inicio,Login,Blog,Shop,Archive,Kontakt,Contacto,Sitemap,Next,Previous,Search".split(","),
    "footer": ["© 2021 {}", "Copyright {} all rights reserved", "&copy; {} &middot; Privacy &middot; Terms", "Impressum Datenschutz {}",
               "Mentions légales {}", "Aviso legal {}", "Powered by {}", "{} &middot; {}", "All rights reserved. {}", "© {}"],
    "sidebar": ["Related", "Related articles", "Popular posts", "Recent posts", "Tags", "You may also like", "Read more", "Archives", "Most read",
                "Mehr zum Thema", "À lire aussi", "Más noticias", "Categories", "Follow us"],
    "notice": ["We use cookies to improve your experience. {}", "Subscribe to our newsletter {}", "This site uses cookies. Accept",
               "You have {} free articles left this month. Subscribe", "Sign up for our newsletter and {}", "Wir verwenden Cookies {}",
               "Ce site utilise des cookies {}", "Este sitio utiliza cookies {}", "Please enable JavaScript {}", "Your session has expired. {}"],
    "advert": ["Advertisement", "Sponsored", "Anzeige", "Werbung", "Publicité", "Publicidad", "Ad: {}", "Buy now! {}", "Sponsored content {}"],
    "share": ["Share", "Tweet", "Share this article", "Print", "E-mail", "Follow us on", "Teilen", "Partager", "Compartir"],
    "comments": ["Comments", "3 comments", "Leave a comment", "Responses", "12 Comments", "Kommentare", "Commentaires", "Comentarios", "Discussion", "Reader comments"],
    "form": ["Search", "Your e-mail", "Name", "Password", "Log in", "Send", "Submit", "Username", "Remember me", "Post comment", "Message"],
}
#: Words of any text, so that the ones among them that also stand in menus and notices tell nothing.
COMMON = ("the a to of and in this for with you your we our on is it that all have are more use up left from free next by improve "
          "der die das und zu mit von wir zum mehr ist le la les de et ce des utilise un une que el los y en este más lire").split()
_SYLLABLES = [c + v for c in "b c d f g h j k l m n p r s t v w z ch st".split() for v in "a e i o u é ü".split()]


class _Page:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        # names may tell all, a part, or nothing
        self.told = self.rnd.choice([1.0, 1.0, 0.7, 0.4])
        self.semantic = self.rnd.random() < 0.5

    def word(self) -> str:
        if self.rnd.random() < 0.3:
            return self.rnd.choice(COMMON)
        return "".join(self.rnd.choice(_SYLLABLES) for _ in range(self.rnd.randint(2, 5)))

    def run(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n)).capitalize()

    def prose(self) -> str:
        """Sentences; some with links, marks and odd characters in them."""
        out = []
        for _ in range(self.rnd.choice([1, 1, 2, 4, 8])):
            s = self.run(self.rnd.choice([1, 2, 5, 9, 14, 22]))
            if self.rnd.random() < 0.15:
                s += f' <a href="/{self.word()}">{self.run(2)}</a> {self.word()}'
            if self.rnd.random() < 0.2:
                s = f"<{'b'}>{s}</b>" + self.rnd.choice(["%%% ", "###", " &amp;", "***", ""]) + self.word()
            out.append(s + self.rnd.choice([".", ".", "!", "?", "", ",", "&amp;"]))
        text = " ".join(out)
        return text.upper() if self.rnd.random() < 0.03 and "<" not in text and "&" not in text else text

    def named(self, kind: str) -> str:
        """Attributes of an element of a kind."""
        if self.rnd.random() > self.told:
            return self.rnd.choice(["", "", ' class="%s%d"' % (self.rnd.choice("bcxz"), self.rnd.randint(1, 99)), ' class="row"', ' class="container"'])
        return ' %s="%s"' % (self.rnd.choice(["class", "class", "id"]), self.rnd.choice(NAMES[kind]))

    def wrapped(self, kind: str, element: str, inside: str, always: bool = False) -> str:
        if not (self.semantic and element != "div"):
            element = "div" if self.rnd.random() < 0.8 else "section"
        name = self.named(kind)
        if always and element in ("div", "section") and "=" not in name.replace('class="row"', "").replace('class="container"', ""):
            name = ' class="%s"' % self.rnd.choice(NAMES[kind])     # prose can be told from prose by its name only
        return f"<{element}{name}>{inside}</{element}>"

    def links(self, words: list[str], n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.rnd.choice([self.rnd.choice(words), self.word(), self.run(self.rnd.choice([2, 5, 8]))])}</a>' for _ in range(n)]
        if self.rnd.random() < 0.15:
            items = [self.run(self.rnd.choice([1, 2, 5])) for _ in items]
        form = self.rnd.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items) if form < 0.8 else "".join(f"<p>{i}</p>" for i in items)

    def some(self, kind: str) -> str:
        """One of a kind's usual texts."""
        text = self.rnd.choice(WORDS[kind])
        return text.replace("{}", self.run(self.rnd.randint(1, 5)))

    def menu(self) -> str:
        return self.wrapped("menu", "nav", self.links(WORDS["menu"], self.rnd.randint(3, 9)))

    def form(self) -> str:
        fields = "".join(f"<label>{self.some('form')}</label><input name='x'>" for _ in range(self.rnd.randint(1, 4)))
        return f"<form action='/'>{fields}<button>{self.some('form')}</button><p>{self.run(4)}</p></form>"

    def header(self) -> str:
        title = self.rnd.choice([f"<a href='/'>{self.run(2)}</a>", f"<p>{self.run(3)}</p>", f"<div>{self.run(2)}</div>", ""])
        inside = title + (self.menu() if self.rnd.random() < 0.5 else "") + (self.form() if self.rnd.random() < 0.3 else "")
        return self.wrapped("header", "header", inside)

    def advert(self) -> str:
        text = self.rnd.choice([self.some("advert"), self.run(self.rnd.randint(2, 14)) + ".", self.prose()])
        inside = self.rnd.choice([text, f"<p>{text}</p>", f"<div><a href='/'>{text}</a></div>"])
        return self.wrapped("advert", "div", inside, always=True)

    def notice(self) -> str:
        return self.wrapped("notice", "div", self.rnd.choice(["{}", "<p>{}</p>", "<p>{}</p><button>OK</button>"]).replace("{}", self.some("notice")), always=True)

    def sidebar(self) -> str:
        heading = f"<h{(h := self.rnd.randint(2, 4))}>{self.some('sidebar')}</h{h}>"
        more = f"<p>{self.prose()}</p>" if self.rnd.random() < 0.4 else ""
        return self.wrapped("sidebar", "aside", heading + self.links(WORDS["menu"], self.rnd.randint(2, 6)) + more, always=bool(more))

    def share(self) -> str:
        return self.wrapped("share", "div", " ".join(f"<a href='#'>{self.some('share')}</a>" for _ in range(self.rnd.randint(2, 4))))

    def comments(self) -> str:
        one = lambda: self.rnd.choice(["<div{0}><p>{1}</p><p>{2}</p></div>", "<li{0}><b>{1}</b> <p>{2}</p></li>"]).format(
            self.rnd.choice(["", ' class="comment"', ' class="reply"']), self.run(2), self.prose())
        heading = f"<h{(h := self.rnd.randint(2, 4))}>{self.some('comments')}</h{h}>"
        return self.wrapped("comments", "section", heading + "".join(one() for _ in range(self.rnd.randint(1, 5)))
                            + (self.form() if self.rnd.random() < 0.5 else ""), always=True)

    def footer(self) -> str:
        inside = self.rnd.choice([self.some("footer"), f"<p>{self.some('footer')}</p>", self.links(WORDS["menu"], 3) + f"<p>{self.some('footer')}</p>"])
        return self.wrapped("footer", "footer", inside)

    def article(self) -> str:
        on = f" {LABEL}"
        title = f"<h1{on}>{self.run(self.rnd.randint(1, 12))}</h1>"
        parts = [self.rnd.choice([title] * 5 + [f"<header>{title}</header>", f"<div{self.named('header')}>{title}</div>"])]
        paragraph = self.rnd.choice(["p"] * 6 + ["div", "section"])
        for _ in range(self.rnd.choice([0, 1, 3, 8, 15])):
            kind = self.rnd.random()
            if kind < 0.64:
                close = "" if paragraph == "p" and self.rnd.random() < 0.3 else f"</{paragraph}>"
                parts.append(f"<{paragraph}{on}>{self.prose()}{self.rnd.choice(['', '', '<br>'])}{close}")
            elif kind < 0.71:
                parts.append(f"<h{(h := self.rnd.randint(2, 4))}{on}>{self.run(self.rnd.randint(1, 6))}</h{h}>")
            elif kind < 0.77:
                parts.append("<ul>" + "".join(f"<li{on}>{self.run(self.rnd.randint(1, 12))}</li>" for _ in range(self.rnd.randint(2, 5))) + "</ul>")
            elif kind < 0.80:
                parts.append(f"<blockquote{on}><p>{self.prose()}</p></blockquote>")
            elif kind < 0.82:
                parts.append(f"<pre{on}>{self.run(6)}</pre>")
            elif kind < 0.84:
                rows = "".join(f"<tr><td{on}>{self.run(2)}</td><td{on}>{self.rnd.randint(1, 999)}</td></tr>" for _ in range(3))
                parts.append(f"<table>{rows}</table>")
            else:
                parts.append(self.rnd.choice([self.advert, self.advert, self.share, self.sidebar, self.notice])())
        if self.rnd.random() < 0.9:
            parts.append(f"<p{on}>{self.rnd.choice([self.prose(), self.prose(), self.run(self.rnd.randint(1, 3)) + '.'])}</p>")
        if self.rnd.random() < 0.1:
            parts.append(self.footer())
        element = self.rnd.choice(["article", "main", "div", "div"])
        name = self.named("content") if element == "div" or self.rnd.random() < 0.3 else ""
        inside = "".join(parts) + (self.comments() if self.rnd.random() < 0.1 else "")
        inside = f"<{element}{name}>{inside}</{element}>"
        return f"<div{self.named('content')}>{inside}</div>" if self.rnd.random() < 0.3 else inside

    def html(self) -> str:
        chance = lambda p, make: make() if self.rnd.random() < p else ""
        before = [chance(0.2, self.notice), chance(0.5, self.header), chance(0.8, self.menu), chance(0.4, self.advert), chance(0.25, self.sidebar)]
        behind = [chance(0.2, self.share), chance(0.35, self.comments), chance(0.3, self.sidebar), chance(0.3, self.advert),
                  chance(0.2, self.notice), chance(0.85, self.footer), chance(0.1, self.advert)]
        if self.rnd.random() < 0.3:
            self.rnd.shuffle(before)
        return (f"<!DOCTYPE html><html><head><title>{self.run(4)}</title></head><body>" + "\n".join(before) + self.article()
                + "\n".join(behind) + "</body></html>")


def labelled_pages(count: int, seed: int = 0) -> Iterator[str]:
    """``count`` pages; the same for the same seed."""
    for i in range(count):
        yield _Page(seed * 1_000_003 + i).html()
