"""Made-up web pages of many layouts, whose main blocks are known: the training set of the block labeller."""

from __future__ import annotations

from html import escape
from random import Random

#: Main blocks begin with this private-use character.
MARK = "\ue000"

# Frequent words of five languages, words that page furniture uses, and class or id words by
# what they hold.
FREQUENT = [
    "the of and to in a is that for it was on with as be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son elle mais comme nous sa ont tout aux cette ses",
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son",
    "di e il la che in un a per è una sono con non si da come le dei nel alla più ma della al lo anche ha gli del o se ci questo",
]
FURNITURE = (
    "home about contact login register search menu share tweet follow subscribe newsletter privacy policy terms cookies accept advertisement sponsored read more next previous comments reply "
    "related posts categories archives tags copyright reserved sitemap help start sign in up log out edit history print email download print agree settings skip javascript enable browser cart "
    "suche anmelden impressum datenschutz mehr lesen kommentare antworten startseite kontakt teilen accueil rechercher mentions légales connexion suivre abonnez "
    "partager commentaires répondre inicio buscar contacto privacidad compartir comentarios responder aviso legal leer más cerca accedi cerca condividi rispondi"
).split()
CLASSES = {
    "header": "header masthead top site-header branding banner-top topbar page-head logo",
    "nav": "nav menu navbar navigation main-menu breadcrumbs breadcrumb toc pager pagination tabs skip",
    "ad": "ad ads advert advertisement sponsored promo banner adsbygoogle commercial dfp ad-slot sponsor",
    "notice": "cookie notice cookie-banner consent gdpr alert popup modal newsletter-popup overlay message paywall",
    "sidebar": "sidebar aside widget secondary right-column rail related recommended popular trending widget-area more-stories",
    "footer": "footer site-footer bottom colophon copyright legal footnav foot credits",
    "comments": "comments comment-list commentlist responses disqus replies comment discussion user-comments reactions",
    "form": "form search-form newsletter signup subscribe login contact-form searchbox",
    "share": "share social sharing social-links share-buttons addthis follow tools actions",
    "main": "content article post entry main story post-content entry-content article-body text body-text page-content body articlebody document markdown prose",
}
TAGS = {
    "header": ["header", "header", "div", "td"],
    "nav": ["nav", "nav", "div", "ul", "td"],
    "ad": ["div", "aside", "section"],
    "notice": ["div", "section", "dialog", "aside"],
    "sidebar": ["aside", "div", "section", "td"],
    "footer": ["footer", "footer", "div", "p"],
    "comments": ["section", "div", "ol", "div"],
    "form": ["form"],
    "share": ["div", "ul", "p"],
    "main": ["article", "article", "main", "div", "section", "td"],
}
SEMANTIC = {"header", "nav", "aside", "footer", "form", "article", "main", "dialog"}
MONTHS = "January March June October Mai August décembre marzo"


class _Page:
    """One page's vocabulary and habits: bare is how often boxes go without class and id, sloppy how often tags stay open."""

    def __init__(self, rng: Random):
        self.rng = rng
        letters = "etaoinshrdlucmfwygpbvk" + rng.choice(["", "äöüß", "éèçêà", "ñóíáú"])
        syllables = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(40)]
        self.words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(300)]
        self.frequent = rng.choice(FREQUENT).split() if rng.random() < 0.7 else self.words[:25]
        self.bare = rng.choice([0.0, 0.0, 0.0, 0.3, 1.0])
        self.sloppy = rng.choice([0.0, 0.0, 0.0, 0.3, 1.0])
        self.signs = "".join(rng.choices("*!?#%&$+~|/=_<", k=rng.randint(1, 4))) if rng.random() < 0.2 else ""
        self.gap = rng.choice(["", " "])

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def count(self, least: int, most: int) -> int:
        return self.rng.randint(least, most)

    def word(self) -> str:
        return self.rng.choice(self.frequent) if self.chance(0.45) else self.rng.choice(self.words)

    def sentence(self, least: int = 1, most: int = 16) -> str:
        words = [self.word() + (self.rng.choice(["", ",", ",", ";", " –"]) if self.chance(0.08) else "") for _ in range(self.count(least, most))]
        if self.signs and self.chance(0.8):  # noisy text, as broken encodings and shouting leave it
            words = [w + self.gap + escape(self.rng.choice(self.signs) * self.count(0, 3)) for w in words]
        if self.chance(0.1):
            words[self.rng.randrange(len(words))] = str(self.count(1, 3000))
        return " ".join(words).capitalize() + (self.rng.choice(".....!?:") if self.chance(0.9) else "")

    def prose(self, most: int = 8) -> str:
        text = " ".join(self.sentence() for _ in range(self.count(1, most)))
        if self.chance(0.25):
            text = text.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
        if self.chance(0.15):
            tag = self.rng.choice("b i em strong span code".split())
            text = text.replace(" ", f" <{tag}>", 1) + ("" if self.chance(self.sloppy) else f"</{tag}>")
        return text.replace(" ", "<br>", 1) if self.chance(0.08) else text

    def label(self) -> str:
        words = [self.rng.choice(FURNITURE) if self.chance(0.6) else self.word() for _ in range(self.count(1, 4))]
        return " ".join(words).capitalize()

    def title(self) -> str:
        """A short heading, list item or table cell: often one or two words, without a full stop."""
        words = [self.rng.choice(self.words + FURNITURE[:40]) if self.chance(0.5) else self.word() for _ in range(self.rng.choice([1, 1, 2, 3, 4, 6]))]
        return (f"{self.count(1, 500)} " if self.chance(0.1) else "") + " ".join(words).capitalize() + ("." if self.chance(0.15) else "")

    def date(self) -> str:
        return f"{self.rng.choice(MONTHS.split())} {self.count(1, 28)}, {self.count(1996, 2030)}"

    def element(self, tag: str, inner: str) -> str:
        """A text element; sloppy pages leave it open."""
        return f"<{tag}>{inner}" + ("" if self.chance(self.sloppy) else f"</{tag}>")

    def box(self, kind: str, inner: str) -> str:
        tag = self.rng.choice(TAGS[kind])
        if tag == "td":
            return f"<table><tr><td>{inner}</td></tr></table>" if self.chance(self.bare) else f'<table><tr><td class="{self.rng.choice(CLASSES[kind].split())}">{inner}</td></tr></table>'
        attrs = ""
        if not self.chance(self.bare) and (tag not in SEMANTIC or self.chance(0.5)):
            name = self.rng.choice(CLASSES[kind].split())
            name = self.rng.choice([name, name, f"{name}-{self.word()}", f"site-{name}", f"{name}-box", f"{name}_wrapper", f"{self.word()} {name}"])
            attrs = f' {self.rng.choice(["class", "class", "id"])}="{name}"'
            if kind == "notice" and self.chance(0.3):
                attrs += ' style="display:none"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, most: int = 9) -> str:
        n, kind = self.count(1, most), self.rng.random()
        text = lambda: self.label() if self.chance(0.5) else self.sentence(1, 4) if self.chance(0.3) else self.word()
        link = lambda: f'<a href="/{self.word()}">{text()}</a>'
        if kind < 0.5:
            return "<ul>" + "".join(self.element("li", link()) for _ in range(n)) + "</ul>"
        if kind < 0.8:
            return self.rng.choice([" | ", " · ", " ", " &raquo; ", ", "]).join(link() for _ in range(n))
        return "".join(f"<div>{link()}</div>" for _ in range(n))

    def furniture(self, kind: str) -> str:
        c = self.rng.random()
        if kind == "header":
            inner = self.rng.choice([f"<h1><a href='/'>{self.label()}</a></h1>", f"<h2>{self.label()}</h2>", f"<a href='/'>{self.label()}</a>", f"<div>{self.label()}</div>", f"<b>{self.sentence(1, 4)}</b>"])
            inner += (f"<p>{self.sentence(2, 8)}</p>" if self.chance(0.4) else "") + (self.furniture("nav") if self.chance(0.4) else "")
        elif kind in ("nav", "share"):
            inner = self.links()
        elif kind == "ad":
            inner = self.prose(4) if c < 0.5 else f"<p>{self.prose(3)}</p>" if c < 0.7 else f'<a href="#">{self.sentence()}</a>' + (f"<p>{self.label()}</p>" if c < 0.85 else "")
        elif kind == "notice":
            inner = f"<p>{self.label()} {self.prose(3)}</p><button>{self.label()}</button>" if c < 0.5 else f"<noscript>{self.label()} {self.sentence()}</noscript>" if c < 0.65 else f"<h3>{self.label()}</h3>{self.prose(3)}" if c < 0.8 else self.prose(3)
        elif kind == "sidebar":
            inner = "".join(f"<h3>{self.label() if self.chance(0.7) else self.sentence(1, 5)}</h3>" + (self.links() if self.chance(0.6) else f"<p>{self.prose(4)}</p>") for _ in range(self.count(1, 3)))
        elif kind == "footer":
            owner = self.rng.choice([self.label(), f"{self.word()}.{self.rng.choice(['com', 'org', 'de', 'net'])}", self.sentence(1, 3)])
            mark = self.rng.choice([f"&copy; {self.count(1996, 2030)} {owner}", f"&copy; {owner}", f"Copyright {owner}", owner])
            more = self.rng.choice(["", f" &middot; {self.prose(2)}", f" | {self.links(4)}", f". {self.label()}", f"<p>{self.prose(3)}</p>"])
            mark = f"{self.label()} {self.date()}. {self.label()}" if self.chance(0.15) else mark
            inner = self.links() + (f"<p>{mark}{more}</p>" if c < 0.1 else "") if c < 0.3 else f"<p>{mark}{more}</p>" if c < 0.6 else mark + more
        elif kind == "comments":
            who = lambda: self.rng.choice([f"<b>{self.word()}</b>", f"<cite>{self.word()}</cite> <span>{self.date()}</span>", f"<h4>{self.word()}</h4>", f"<div>{self.word()} – {self.date()}</div>"])
            tag = self.rng.choice(["div", "div", "li", "article"])
            item = lambda: f'<{tag} class="comment">{who()}<p>{self.prose(5)}</p>' + (f'<a href="#">{self.label()}</a>' if c < 0.6 else "") + f"</{tag}>"
            inner = f"<h3>{self.label()}</h3>" + "".join(item() for _ in range(self.count(1, 5)))
        else:
            inner = f"<label>{self.label()}</label><input type=text>" + (f"<p>{self.sentence()}</p>" if c < 0.4 else "") + (f"<select><option>{self.label()}<option>{self.word()}</select>" if c > 0.7 else "") + f"<button>{self.label()}</button>"
        return self.box(kind, inner)

    def paragraph(self, style: str) -> str:
        """One piece of the article, in the page's style of paragraphs."""
        c = self.rng.random()
        text = MARK + (self.prose(12) if self.chance(0.75) else self.sentence(1, 6))
        if c < 0.68:
            return self.element("p", text) if style == "p" else f"<div>{text}</div>" if style == "div" else f"{text}<p>"
        if c < 0.77:
            return self.element(f"h{self.count(2, 4)}", MARK + self.title())
        if c < 0.85:
            tag, item = self.rng.choice(["ul", "ol"]), self.rng.choice([self.sentence, self.title])
            return f"<{tag}>" + "".join(self.element("li", MARK + item()) for _ in range(self.count(1, 8))) + f"</{tag}>"
        if c < 0.88:
            return f"<blockquote>{self.element('p', text) if self.chance(0.5) else text}</blockquote>"
        if c < 0.91:
            cells = lambda tag: "<tr>" + "".join(f"<{tag}>{MARK}{self.title()}</{tag}>" for _ in range(2)) + "</tr>"
            return "<table>" + (cells("th") if self.chance(0.5) else "") + "".join(cells("td") for _ in range(self.count(1, 4))) + "</table>"
        if c < 0.93:
            return f"<dl><dt>{MARK}{self.sentence(1, 3)}<dd>{MARK}{self.sentence()}</dl>"
        if c < 0.95:
            return f"<pre>{MARK}{self.word()} = {self.word()}({self.count(1, 99)})\n{self.word()}</pre>"
        if c < 0.97:
            return f"<figure><img src='x.png'><figcaption>{MARK}{self.sentence(2, 12)}</figcaption></figure>"
        return self.furniture(self.rng.choice(["ad", "ad", "share", "sidebar", "form", "notice", "nav"]))

    def main(self) -> str:
        style = self.rng.choice(["p"] * 7 + ["div", "loose"])
        out = []
        if self.chance(0.85):
            text = MARK + (self.sentence(1, 12) if self.chance(0.6) else self.title())
            head = self.element(self.rng.choice(["h1"] * 6 + ["h2"]), text) if self.chance(0.92) else f"<center><b>{text}</b></center><hr>"
            head += f"<p>{MARK}{self.sentence(5, 16)}</p>" if self.chance(0.1) else ""
            out.append(f"<header>{head}</header>" if self.chance(0.1) else head)
        most = self.rng.choice([3, 3, 16, 16, 30])
        out += [self.paragraph(style) for _ in range(self.count(1, most))]
        inner = "".join(out) + (self.furniture("share") if self.chance(0.12) else "") + (self.furniture("comments") if self.chance(0.06) else "")
        for _ in range(self.count(0, 2)):
            inner = f"<div>{inner}</div>" if self.chance(0.5) else inner
        return self.box("main", inner) if not (self.bare == 1.0 and self.chance(0.4)) else inner


def labelled_page(rng: Random) -> str:
    """One page; text that belongs to the article is preceded by MARK, block by block."""
    p = _Page(rng)
    before = [k for k, q in (("notice", 0.25), ("header", 0.5), ("nav", 0.7), ("form", 0.1), ("ad", 0.4), ("sidebar", 0.15)) if p.chance(q)]
    after = [k for k, q in (("share", 0.2), ("sidebar", 0.35), ("comments", 0.35), ("ad", 0.25), ("form", 0.15), ("nav", 0.15), ("footer", 0.8), ("notice", 0.15)) if p.chance(q)]
    if p.chance(0.2):
        rng.shuffle(before)
    if p.chance(0.12):  # columns of a layout table
        cells = [p.links() if p.chance(0.7) else p.furniture("sidebar"), p.main(), *([p.furniture(rng.choice(["ad", "sidebar"]))] if p.chance(0.4) else [])]
        if p.chance(0.2):
            cells[:2] = cells[1::-1]
        middle = "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"
    else:
        middle = p.main()
    if p.chance(0.1):
        middle += "<hr>"
        after = [k if k != "footer" or p.chance(0.5) else "small" for k in after]
    inner = "".join(p.furniture(k) for k in before) + middle + "".join(p.furniture(k) if k != "small" else f'<font size="1">{p.label()} {p.date()}. {p.label()}.</font>' for k in after)
    if p.chance(0.5):
        inner = f'<div class="{rng.choice(["wrapper", "container", "page", "row", "site"])}">{inner}</div>' if p.bare < 1 else f"<div>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{p.label()}</title><style>p{{}}</style></head><body>{inner}</body></html>"
