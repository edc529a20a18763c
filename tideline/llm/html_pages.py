"""Labelled pages that train the extraction model: generated from a seed, by several grammars.

Grammar builds pages of semantic elements and English class names; Layouts builds what else is
common: ARIA roles, block__element names, names in other languages, tables as layout, pages of
nothing but div elements, and link lists without any name. Every element that bears text carries data-y: 1 for the article, 0 for everything else.
"""

from __future__ import annotations

import random

#: Words that sites use in class and id attributes, by the role of the element.
ROLES = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "mainmenu", "pagination", "pager", "tabs", "toc", "skip"],
    "header": ["header", "masthead", "topbar", "branding", "logo", "site", "tagline", "hero"],
    "footer": ["footer", "copyright", "legal", "bottom", "colophon", "imprint", "credits", "contact"],
    "sidebar": ["sidebar", "aside", "widget", "widgets", "related", "popular", "trending", "recommended", "rail", "tags", "archive", "archives", "author", "bio", "more", "teaser"],
    "notice": ["cookie", "cookies", "notice", "banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "message", "warning", "info", "privacy"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adsense", "dfp", "affiliate", "offer", "adbox", "adslot"],
    "form": ["form", "search", "login", "searchbox", "register", "poll", "vote"],
    "comments": ["comments", "comment", "reply", "replies", "disqus", "discussion", "respond", "reader", "responses", "feedback", "thread"],
    "share": ["share", "social", "sharing", "follow", "buttons", "toolbar", "meta", "byline"],
}
CONTENT = ["content", "article", "post", "entry", "story", "body", "text", "main", "page", "single", "prose", "articlebody", "maincontent", "hentry"]
TAGS = {"menu": ["nav", "ul", "div", "ol"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog", "p"], "advert": ["div", "aside", "ins", "section", "p"], "form": ["form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "p"]}
NEEDS_CLASS = {"notice", "advert", "comments", "share", "sidebar"}
SYLLABLES = ["ba", "co", "den", "fi", "gor", "hal", "in", "ka", "lo", "mer", "nu", "os", "pri", "qua", "ra", "sti", "tu", "vel", "wen", "yo"]


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.25:
            out += f' <a href="/x">{self.words(1, 3)}</a> <b>{self.words(1, 2)}</b>.'
        return out

    def attr(self, role: str) -> str:
        r = self.r
        names = CONTENT if role == "content" else ROLES[role]
        if role != "content" and role not in NEEDS_CLASS and r.random() < 0.3:
            return ""
        if role == "content" and r.random() < 0.35:
            return ""
        name = r.choice(names) + r.choice(["", "", "", "-1", "-box", "-wrap", "_inner", " clear", " block"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def boiler(self, role: str) -> str:
        r, tag = self.r, self.r.choice(TAGS[role])
        a = self.attr(role)
        if tag == "div" and not a:
            a = f' class="{r.choice(ROLES[role])}"'
        links = "".join(f'<li data-y="0"><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(r.randint(2, 8)))
        if tag in ("ul", "ol") and role != "comments":
            return f"<{tag}{a}>{links}</{tag}>"
        if role == "menu":
            inner = r.choice([f"<ul>{links}</ul>", " | ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(r.randint(2, 7)))])
        elif role == "form":
            inner = f'<label data-y="0">{self.words(1, 3)}</label><input><select><option data-y="0">{self.words(1, 2)}</option></select><button data-y="0">{self.words(1, 2)}</button>' + (f'<p data-y="0">{self.sentence()}</p>' if r.random() < 0.4 else "")
        elif role == "comments":
            child = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p", "blockquote"])
            inner = "".join(f'<{child}{r.choice(["", self.attr("comments")])} data-y="0">{r.choice(["", self.words(1, 2)])}<p data-y="0">{self.prose(1, 4)}</p></{child}>' if child != "p" else f'<p data-y="0">{self.prose(1, 4)}</p>' for _ in range(r.randint(1, 5)))
            inner = r.choice(["", f'<h3 data-y="0">{self.words(1, 3)}</h3>']) + inner
        elif role in ("sidebar", "footer", "header"):
            pieces = [f"<ul>{links}</ul>", f'<p data-y="0">{self.prose(1, 3)}</p>', f'<h3 data-y="0">{self.words(1, 4)}</h3>', f'<div data-y="0">{self.sentence()}</div>']
            inner = "".join(r.sample(pieces, r.randint(1, 3)))
            if role == "header" and r.random() < 0.4:
                inner = f'<h1 data-y="0">{self.words(1, 3)}</h1>' + inner
        else:
            inner = r.choice([self.sentence(), self.prose(1, 3), f'<p data-y="0">{self.prose(1, 3)}</p>', f'<span>{self.words(2, 6)}</span><button data-y="0">{self.words(1, 1)}</button>'])
        return f'<{tag}{a} data-y="0">{inner}</{tag}>'

    def article(self, insets: list[str]) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f'<{(h := r.choice(["h1", "h1", "h2"]))} data-y="1">{self.words(2, 9)}</{h}>')
        kind = r.random()
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if kind < 0.1:
                out.append(f'<div data-y="1">{self.prose()}</div>')
            elif x < 0.72:
                close = r.choice(["</p>", "</p>", "</p>", ""])
                out.append(f'<p data-y="1">{self.prose() if r.random() < 0.8 else self.words(1, 3)}{r.choice(["", "", "<br>"])}{close}')
            elif x < 0.8:
                out.append(f'<{(h := r.choice(["h2", "h3", "h4"]))} data-y="1">{self.words(1, 6)}</{h}>')
            elif x < 0.87:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f'<li data-y="1">{self.sentence()}</li>' for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif x < 0.91:
                out.append(f'<blockquote data-y="1">{self.prose(1, 3)}</blockquote>')
            elif x < 0.94:
                out.append("<table><tr>" + "".join(f'<td data-y="1">{self.words(1, 4)}</td>' for _ in range(3)) + "</tr></table>")
            elif x < 0.96:
                out.append(f'<pre data-y="1">{self.words(3, 12)}</pre>')
            else:
                out.append(f'<figure><img src="a.png"><figcaption data-y="1">{self.sentence()}</figcaption></figure>')
        for inset in insets:
            out.insert(r.randint(1, len(out)), inset)
        if kind > 0.93:
            return f'<div{self.attr("content")} data-y="1">' + "<br><br>".join(self.prose(2, 6) for _ in range(r.randint(1, 5))) + "</div>"
        body = "".join(out)
        for _ in range(r.randint(0, 2)):
            body = f'<{(t := r.choice(["div", "section"]))}{self.attr("content")}>{body}</{t}>'
        tag = r.choice(["article", "article", "main", "div"])
        a = self.attr("content")
        return f'<{tag}{a if tag != "div" or a else " class=" + chr(34) + r.choice(CONTENT) + chr(34)}>{body}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [self.boiler(k) for k in ("header", "menu", "notice", "advert") if r.random() < 0.5]
        after = [self.boiler(k) for k in ("sidebar", "comments", "share", "advert", "form", "notice", "footer", "menu") if r.random() < 0.45]
        r.shuffle(before)
        insets = [self.boiler(r.choice(["advert", "share", "sidebar", "form", "notice", "comments"])) for _ in range(r.choice([0, 0, 1, 2]))]
        inner = "".join(before) + self.article(insets) + "".join(after)
        for _ in range(r.randint(0, 2)):
            inner = f'<div{r.choice(["", " class=" + chr(34) + "container" + chr(34), " id=" + chr(34) + "wrapper" + chr(34)])}>{inner}</div>'
        return f"<html><head><title>{self.words(2, 5)}</title><script>var x = '<p>';</script></head><body>{inner}</body></html>"


#: Names in German, French and Spanish, by the role of the element.
FOREIGN = {
    "menu": ["navigation", "menue", "hauptmenue", "navigationsleiste", "menu-principal", "fil-ariane", "navegacion", "brotkrumen"],
    "header": ["kopfzeile", "kopf", "entete", "cabecera", "seitenkopf"],
    "footer": ["fusszeile", "fuss", "pied", "pied-de-page", "impressum", "pie", "mentions-legales"],
    "sidebar": ["seitenleiste", "rechts", "links", "marginale", "colonne", "lateral", "barra-lateral", "verwandte", "meistgelesen"],
    "notice": ["hinweis", "cookie-hinweis", "meldung", "bandeau", "aviso", "datenschutz"],
    "advert": ["werbung", "anzeige", "publicite", "pub", "publicidad", "anuncio", "sponsorise"],
    "form": ["suche", "anmeldung", "recherche", "formulaire", "buscar", "formular"],
    "comments": ["kommentare", "kommentar", "leserbriefe", "commentaires", "commentaire", "comentarios", "antworten"],
    "share": ["teilen", "partager", "compartir", "soziale"],
}
FOREIGN_CONTENT = ["inhalt", "artikel", "beitrag", "haupttext", "contenu", "corps", "texte", "contenido", "articulo", "cuerpo", "hauptspalte"]
#: Names of elements inside an article.
PARTS = {
    "title": ["title", "headline", "heading", "titel", "titre", "titulo", "subtitle", "header"],
    "lead": ["lead", "intro", "summary", "teaser", "excerpt", "standfirst", "vorspann", "chapo"],
    "head": ["header", "head", "top", "intro", "kopf"],
    "text": ["text", "paragraph", "para", "p", "copy", "body", "absatz", "texte"],
    "body": ["body", "content", "text", "inner", "main", "wrapper"],
}
ARIA = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search", "notice": "alert"}


class Layouts(Grammar):
    """Pages without the semantic elements that Grammar has."""

    def __init__(self, seed: int):
        super().__init__(seed)
        self.style = self.r.choice(["aria", "bem", "foreign", "table", "plain", "wiki"])

    def attr(self, role: str) -> str:
        r = self.r
        if self.style == "aria" and (role in ARIA or role == "content") and r.random() < 0.7:
            return f' role="{ARIA.get(role, r.choice(["main", "article"]))}"'
        if self.style == "foreign":
            return f' {r.choice(["class", "id"])}="{r.choice(FOREIGN_CONTENT if role == "content" else FOREIGN[role])}"'
        if self.style == "bem":
            return f' class="{r.choice(["c", "o", "l", "site", "js", "u"])}-{r.choice(CONTENT if role == "content" else ROLES[role])}{r.choice(["", "__inner", "__body", "--wide", "__item"])}"'
        return super().attr(role)

    def boiler(self, role: str) -> str:
        r = self.r
        if self.style in ("plain", "table", "wiki") and role in ("menu", "footer", "sidebar", "share") and r.random() < 0.5:
            links = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(3, 9))]
            return r.choice([f'<div data-y="0">{" ".join(links)}</div>', f'<p data-y="0">{" | ".join(links)}</p>', "<ul>" + "".join(f'<li data-y="0">{x}</li>' for x in links) + "</ul>"])
        return super().boiler(role)

    def part(self, kind: str) -> str:
        """Class of an element inside the article."""
        r = self.r
        if not self.named:
            return ""
        name = r.choice(PARTS[kind])
        if self.style == "bem":
            return f' class="{self.prefix}{self.block}__{name}{r.choice(["", "", " " + name + "--first"])}"'
        return f' class="{r.choice(["entry-", "article-", "post-", "", ""])}{name}"' if r.random() < 0.7 else ""

    def article(self, insets: list[str]) -> str:
        r, end = self.r, self.r.choice(["</p>", "</p>", ""])
        self.named, self.prefix, self.block = r.random() < 0.5 or self.style == "bem", r.choice(["", "c-", "o-"]), r.choice(CONTENT)
        out = []
        if r.random() < 0.8:
            title = f'<h1{self.part("title")} data-y="1">{self.words(2, 8)}</h1>'
            lead = f'<p{self.part("lead")} data-y="1">{self.prose(1, 2)}</p>' if r.random() < 0.3 else ""
            out.append(f'<{(t := r.choice(["header", "div"]))}{self.part("head")}>{title}{lead}</{t}>' if r.random() < 0.4 else title + lead)
        for _ in range(r.randint(2, 10)):
            x = r.random()
            if self.style == "plain" and x < 0.3:
                out.append(f'<div data-y="1">{self.prose(1, 5)}</div>')
            elif x < 0.75:
                out.append(f'<p{self.part("text")} data-y="1">{self.prose()}{end}')
            elif x < 0.85:
                out.append(f'<h2{self.part("title")} data-y="1">{self.words(1, 5)}</h2>')
            elif x < 0.93:
                out.append("<ul>" + "".join(f'<li data-y="1">{self.sentence()}</li>' for _ in range(r.randint(2, 5))) + "</ul>")
            else:
                out.append(f'<dl><dt data-y="1">{self.words(1, 3)}</dt><dd data-y="1">{self.sentence()}</dd></dl>')
        for inset in insets:
            out.insert(r.randint(1, len(out)), inset)
        body = "".join(out)
        if self.style == "bem" and r.random() < 0.6:
            body = f'<div class="{self.prefix}{self.block}__{r.choice(PARTS["body"])}">{body}</div>'
            return f'<{(t := r.choice(["div", "div", "article", "section"]))} class="{self.prefix}{self.block}">{body}</{t}>'
        return f'<div{self.attr("content") if self.style in ("aria", "bem", "foreign", "wiki") else r.choice(["", self.attr("content")])}>{body}</div>'

    def page(self) -> str:
        if self.style != "table":
            return super().page()
        r = self.r
        side = "".join(self.boiler(r.choice(["menu", "sidebar", "form", "advert"])) for _ in range(r.randint(1, 3)))
        insets = [self.boiler("advert")] if r.random() < 0.3 else []
        named = r.random() < 0.5
        cell = lambda role, inner: f'<td valign="top"{self.attr(role) if named else ""}{r.choice(["", " width=200"])}>{inner}</td>'
        article = self.article(insets)
        if r.random() < 0.5:  # without an element around it
            article = article[article.index(">") + 1 : article.rindex("<")]
        if r.random() < 0.3:
            side = "<br>".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(3, 9)))
        cells = [cell("menu", side), cell("content", article)]
        if r.random() < 0.3:
            cells.reverse()
        last = r.choice(["footer", "comments"])
        top = self.boiler("header") if r.random() < 0.5 else r.choice([f'<h1 data-y="0">{self.words(1, 4)}</h1>', self.words(1, 4)])
        bottom = self.boiler(last) if r.random() < 0.5 else f'{self.sentence()} <a href="/m">{self.words(1, 2)}</a>'
        rows = [f"<tr>{cell('header', top)}</tr>", f"<tr>{''.join(cells)}</tr>", f"<tr>{cell(last, bottom)}</tr>"]
        return f"<html><head><title>{self.words(2, 5)}</title></head><body><table>{''.join(rows[r.random() < 0.2 :])}</table></body></html>"


def labelled_pages(count: int, seed: int) -> list[str]:
    """Of five pages two are by Layouts."""
    return [(Layouts if k % 5 in (1, 3) else Grammar)(seed * 100_003 + k).page() for k in range(count)]
