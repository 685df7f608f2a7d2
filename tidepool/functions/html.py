"""Web pages to markdown: adapter, main part, chrome removed, title, canonical link and language.

A page becomes a small tree by the standard parser; batches of pages go through
one Pandas UDF.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import plain
from tidepool.session import bounded_batches

# Marks of site generators, the places of their main parts, and page chrome.
ADAPTERS = (
    ("mintlify", r"(?i)mintlify", ("#content-area", ".mdx-content", "article", "main")),
    ("gitbook", r"(?i)gitbook", (".page-body", ".markdown-body", "article", "main")),
    ("docusaurus", r"(?i:docusaurus)|theme-doc-markdown|infima", (".theme-doc-markdown", "article", "main")),
    ("readme", r"readme\.io|rm-Markdown", (".rm-Markdown", "article", "main")),
    ("sphinx", r"(?i:sphinx)|wy-nav-content|rst-content", (".rst-content", "[role=main]", "article", "main")),
)
# Where a page's main part may be, in this order.
MAIN = (
    "article", "main", "[role=main]", ".markdown", ".md-content", ".doc-content", ".documentation",
    ".theme-doc-markdown", "#content", ".content",
)
# A site's chrome, and chrome within the main part.
SITE_CHROME = (
    "header", "footer", "nav", "aside", "[role=navigation]", "[role=banner]", "[role=contentinfo]", ".sidebar",
    ".side-bar", ".toc", ".table-of-contents", ".navbar", ".nav-bar", ".footer", ".header", ".breadcrumb",
    ".breadcrumbs", "#sidebar", "#toc", "#navbar", "#footer", "#header", ".mintlify-header",
)
CONTENT_CHROME = (
    ".headerlink", "a.anchor", ".hash-link", ".anchor-link", "[aria-hidden=true]", "button", "[role=tablist]",
    ".pagination-nav", ".pagination", ".theme-doc-footer", ".theme-edit-this-page", ".md-source", ".toc-copy",
    ".copy-button", ".copybtn", "[data-testid=page-toc]", ".on-this-page",
)
DROPPED = {"script", "style", "noscript", "svg", "iframe", "template", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "dl", "dt", "dd", "details", "summary", "body", "form", "tr"}
#: What an open element of the same group ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS_P = BLOCKS - {"li", "tr", "dt", "dd", "summary", "body"}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self):
        """This node and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in DROPPED:
                stack += reversed(node.children)
        return "".join(out)

    def matches(self, selector: str) -> bool:
        m = re.match(r"([a-z0-9]*)(?:([.#])([\w-]+)|\[([\w-]+)=([\w-]+)\])?$", selector)
        if m[1] and m[1] != self.tag:
            return False
        if m[2] == ".":
            return m[3] in (self.attrs.get("class") or "").split()
        if m[2] == "#":
            return self.attrs.get("id") == m[3]
        return not m[4] or self.attrs.get(m[4]) == m[5]

    def first(self, selector: str) -> Node | None:
        return next((n for n in self.walk() if n.matches(selector)), None)

    def without(self, selectors: list[str]) -> None:
        for node in list(self.walk()):
            node.children = [c for c in node.children if isinstance(c, str) or not any(c.matches(s) for s in selectors)]


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def _inline(node: Node) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in DROPPED:
            continue
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in ("strong", "b") and (s := _inline(c).strip()):
            out.append(f"**{s}**")
        elif c.tag in ("em", "i") and (s := _inline(c).strip()):
            out.append(f"_{s}_")
        elif c.tag == "code":
            out.append(f"`{c.text().strip()}`")
        elif c.tag == "a":
            s, href = _inline(c).strip(), c.attrs.get("href", "")
            out.append(f"[{s}]({href})" if href and s else s)
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})" if c.attrs.get("src") else "")
        else:
            out.append(_inline(c))
    return "".join(out)


def _table(node: Node) -> str:
    rows = [[re.sub(r"\s+", " ", _inline(c)).strip().replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _language(node: Node) -> str:
    for n in node.walk():
        if m := re.search(r"(?:language|lang|highlight-source)-([\w+#-]+)", n.attrs.get("class", "")):
            return m[1]
    return ""


def _blocks(node: Node, depth: int = 0) -> list[str]:
    """Markdown blocks of a node's children."""
    out: list[str] = []
    run: list = []

    def flush() -> None:
        box = Node("span")
        box.children = run[:]
        run.clear()
        s = re.sub(r" *\n *", "\n", _inline(box)).strip()
        if s:
            out.append(s)

    for c in node.children:
        if isinstance(c, str) or (c.tag not in BLOCKS and c.tag not in DROPPED and not any(n.tag in BLOCKS for n in c.walk())):
            run.append(c)
            continue
        flush()
        if c.tag in DROPPED:
            continue
        if re.fullmatch(r"h[1-6]", c.tag):
            if s := re.sub(r"\s+", " ", _inline(c)).strip():
                out.append(f"{'#' * int(c.tag[1])} {s}")
        elif c.tag == "pre":
            out.append(f"```{_language(c)}\n{c.text().strip(chr(10)).rstrip()}\n```")
        elif c.tag in ("ul", "ol") and depth < 60:
            items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
            lines = []
            for i, item in enumerate(items, 1):
                mark = f"{i}. " if c.tag == "ol" else "- "
                lines.append(mark + "\n".join(_blocks(item, depth + 1)).replace("\n", "\n" + " " * len(mark)))
            out.append("\n".join(lines))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "blockquote" and depth < 60:
            out.append("\n".join("> " + x for x in "\n\n".join(_blocks(c, depth + 1)).split("\n")))
        elif c.tag == "hr":
            out.append("---")
        elif depth < 400:
            out += _blocks(c, depth + 1)
        else:
            out.append(c.text().strip())
    flush()
    return [x for x in out if x]


def adapter(html: str, url: str = "") -> tuple[str, tuple[str, ...]]:
    for name, pattern, places in ADAPTERS:
        if re.search(pattern, html) or (name == "mintlify" and re.search(pattern, url)):
            return name, places
    return "generic", ()


def extract(html: str, url: str = "") -> dict:
    """title, markdown, adapter, canonical and lang of a page."""
    name, places = adapter(html, url)
    root = tree(html)
    top = root.first("html")
    canonical = next((n.attrs.get("href", "").strip() for n in root.walk() if n.tag == "link" and n.attrs.get("rel") == "canonical"), "")
    title = next((n.text() for n in root.walk() if n.tag == "title"), "") or ""
    if not title:  # the head's text doesn't count as text elsewhere
        title = next(("".join(c for c in n.children if isinstance(c, str)) for n in root.walk() if n.tag == "title"), "")
    heads = [n.text().strip() for n in root.walk() if n.tag == "h1"]
    root.without(SITE_CHROME)
    main = next((n for s in (*places, *MAIN) if (n := root.first(s)) is not None and len(n.text().strip()) > 80), None)
    main = main or root.first("body") or root
    main.without(CONTENT_CHROME)
    own = next((n.text().strip() for n in main.walk() if n.tag == "h1" and n.text().strip()), "")
    return {
        "title": plain.normalize_title(own or next((h for h in heads if h), "") or title.strip()),
        "markdown": plain.clean_markdown("\n\n".join(_blocks(main))),
        "adapter": name,
        "canonical": canonical or None,
        "lang": (top.attrs.get("lang", "").strip() or None) if top else None,
    }


def nav_links(html: str, base: str) -> list[str]:
    """Links of a page's navigation (else of its body) on the same host, resolved, once each."""
    from urllib.parse import urljoin, urlsplit

    root = tree(html)
    menus = [n for n in root.walk() if n.tag in ("nav", "aside") or re.search(r"sidebar|menu|toc", n.attrs.get("class", ""))]
    out: dict[str, None] = {}
    for box in menus or [root]:
        for a in box.walk():
            href = a.attrs.get("href", "") if a.tag == "a" else ""
            if href and not href.startswith(("#", "mailto:")):
                full = urljoin(base, href).split("#")[0]
                if urlsplit(full).scheme in ("http", "https") and urlsplit(full).netloc == urlsplit(base).netloc:
                    out[full] = None
    return list(out)


PAGE = "title string, markdown string, adapter string, canonical string, lang string"


def extracted(html: Column, url: Column) -> Column:
    """A struct of PAGE; a null page gives an empty one. Pages reach the workers in small batches."""
    if session := SparkSession.getActiveSession():
        bounded_batches(session)

    @F.pandas_udf(PAGE)
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = [extract(h or "", u or "") for h, u in zip(pages, urls, strict=True)]
        return pd.DataFrame(rows, columns=["title", "markdown", "adapter", "canonical", "lang"])

    return run(html, url)


def adapter_name(html: Column, url: Column) -> Column:
    """The adapter alone, as a built-in expression."""
    out = F.lit("generic")
    for name, pattern, _ in reversed(ADAPTERS):
        hit = html.rlike(pattern) | (url.rlike(pattern) if name == "mintlify" else F.lit(False))
        out = F.when(hit, name).otherwise(out)
    return out


def fallback_reason(mode: str, ok: Column, html: Column, markdown: Column) -> Column:
    """Why a page needs a browser; null if it doesn't."""
    from tidepool.functions.text import is_boilerplate

    if mode == "always":
        return F.lit("mode=always")
    if mode != "auto":
        return F.lit(None).cast("string")
    blocked = F.contains(html, F.lit("cf-browser-verification")) | F.contains(html, F.lit("Just a moment..."))
    return (
        F.when(~ok, "http_failed").when(F.trim(F.coalesce(html, F.lit(""))) == "", "empty_body").when(blocked, "cloudflare_challenge").when(markdown.isNull(), "extract_failed").when(is_boilerplate(markdown), "boilerplate_only")
    )
