"""HTML to markdown-like text and sections, by the standard library's tolerant parser.

These run as Arrow maps: one tree per document, built and rendered where its row is.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = {"p", "ul", "ol", "div", "blockquote", "table", "tr"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}


class Node:
    """An element; children are Nodes and strings."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def descendants(self):
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack += reversed(x.children)

    def find(self, names=None, css: str | None = None) -> Node | None:
        return next(self.find_all(names, css), None)

    def find_all(self, names=None, css: str | None = None):
        for x in self.descendants():
            if (names is None or x.name in names) and (css is None or css in (x.attrs.get("class") or "").split()):
                yield x

    def raw_text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.children)
            else:
                out.append(x)
        return "".join(out)

    def label(self) -> str:
        """Text pieces, each stripped, joined without a gap."""
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.children)
            else:
                out.append(x.strip())
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: Fixed names of the components that articles use, and the attribute that each is about.
MARKDOWN, SCREENSHOT, LINKS = ("Markdown", "text"), ("BlogScreenshot", "caption"), {"ExternalLink": "href", "Link": "path"}
_TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)")
_ATTRIBUTE = re.compile(r"\s*([^\s=/>{}\"']+)\s*(=?)\s*")
_DIRECTIVE = re.compile(r"\{[#/:@][^}]*\}")
_CALL = re.compile(r"""\w+\(\s*(["'])(.*?)\1\s*\)""", re.S)


def _braced(source: str, at: int) -> int:
    """The place behind the brace that closes the one at ``at``; braces in quotes don't count."""
    depth, quote = 0, ""
    for i in range(at, len(source)):
        c = source[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return i + 1
    return len(source)


def _attributes(source: str, at: int) -> tuple[list[tuple[str, str, bool]], bool, int]:
    """(name, value, whether it is an expression) of a tag's attributes, whether it closes itself, and the place behind it."""
    out: list[tuple[str, str, bool]] = []
    while at < len(source):
        if source[at] == ">":
            return out, False, at + 1
        if source.startswith("/>", at):
            return out, True, at + 2
        if source[at] == "{":  # a spread or a short form
            at = _braced(source, at)
            continue
        m = _ATTRIBUTE.match(source, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if not m[2]:
            out.append((m[1], "", False))
        elif source.startswith("{", at):
            stop = _braced(source, at)
            out.append((m[1], source[at + 1 : stop - 1].strip(), True))
            at = stop
        elif source[at : at + 1] in ("'", '"'):
            stop = source.find(source[at], at + 1)
            stop = len(source) if stop < 0 else stop
            out.append((m[1], source[at + 1 : stop], False))
            at = stop + 1
        else:
            stop = at
            while stop < len(source) and not source[stop].isspace() and source[stop] != ">":
                stop += 1
            out.append((m[1], source[at:stop], False))
            at = stop
    return out, False, at


def _plain(name: str, value: str, expression: bool, base_url: str) -> str | None:
    """An attribute as HTML has it; None for directives and handlers."""
    if name.startswith("class:") or (expression and name.startswith("on")):
        return None
    if expression:
        call = _CALL.fullmatch(value)
        if name == "href" and call:
            value = base_url + call[2]
        elif value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
    value = value.replace('"', "&quot;")
    return f' {name}="{value}"'


def plain_components(source: str, base_url: str = "") -> str:
    """Component markup as HTML that any parser reads.

    The source is read tag by tag, braces and quotes in attributes included.  Scripts and styles go; a Markdown component
    is its text in a pre block, a screenshot its caption, a link component an anchor; class directives, event handlers and template
    blocks go; an expression is its own text, an address that a helper makes is its argument under base_url.
    """
    out: list[str] = []
    at = 0
    while at < len(source):
        m = _TAG.search(source, at)
        comment = source.find("<!--", at)
        if comment >= 0 and (not m or comment < m.start()):
            stop = source.find("-->", comment)
            stop = len(source) if stop < 0 else stop + 3
            out += [_DIRECTIVE.sub("", source[at:comment]), source[comment:stop]]
            at = stop
            continue
        if not m:
            out.append(_DIRECTIVE.sub("", source[at:]))
            break
        out.append(_DIRECTIVE.sub("", source[at : m.start()]))
        closing, name = m[1], m[2]
        attributes, ended, at = _attributes(source, m.end())
        values = {n: v for n, v, _ in attributes}
        if name.lower() in ("script", "style") and not closing:
            stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = at if ended else stop.end() if stop else len(source)
        elif name == MARKDOWN[0]:
            out.append("" if closing else f"<pre>{values.get(MARKDOWN[1], '')}</pre>")
        elif name == SCREENSHOT[0]:
            out.append(f'<p class="figure">Screenshot: {values[SCREENSHOT[1]]}</p>' if SCREENSHOT[1] in values and not closing else "")
        else:
            if name in LINKS:
                attributes = [("href" if n == LINKS[name] else n, v, e) for n, v, e in attributes]
                name = "a"
            shown = "".join(filter(None, (_plain(n, v, e, base_url) for n, v, e in attributes)))
            out.append(f"<{closing}{name}{shown}{' /' if ended else ''}>")
    return "".join(out)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _image(node: Node) -> str:
    alt = node.attrs.get("alt", "").strip()
    return f"\n[image: {alt}]\n" if alt else ""


#: Elements that are written without looking at their children's own form.
LEAVES = {
    "script": lambda n: "",
    "style": lambda n: "",
    "br": lambda n: "\n",
    "img": _image,
    "pre": lambda n: f"\n```\n{n.raw_text()}\n```\n",
}
#: Fixed output forms: an element's stripped content stands for %s.
FORMS = {
    "strong": "**%s**", "b": "**%s**", "em": "_%s_", "i": "_%s_", "code": "`%s`", "li": "\n- %s", "td": "%s | ", "th": "%s | ",
    **{name: "\n%s\n" for name in BLOCK},
    **{name: "\n\n" + "#" * level + " %s\n\n" for name, level in HEADINGS.items()},
}


def _link(node: Node, label: str, base_url: str) -> str:
    """Markdown link; addresses that are expressions leave their label, paths get the base address."""
    href = node.attrs.get("href", "").strip()
    if href[:1] in ("", "{", "$"):
        return label
    target = base_url + href if href.startswith("/") else href
    return f"[{label}]({target})" if label else target


def render(node: Node | str, base_url: str = "") -> str:
    """Markdown-like text of one node, children first; a stack stands in for recursion, as markup can nest deep."""
    written: list[list[str]] = [[]]
    todo: list[tuple[Node | str, bool]] = [(node, False)]
    while todo:
        x, complete = todo.pop()
        if isinstance(x, str):
            written[-1].append(re.sub(r"[ \t\n]+", " ", x))
        elif complete:
            content = "".join(written.pop())
            if x.name == "a":
                content = _link(x, content.strip(), base_url)
            elif x.name in FORMS:
                content = FORMS[x.name] % content.strip()
            written[-1].append(content)
        elif x.name in LEAVES:
            written[-1].append(LEAVES[x.name](x))
        else:
            written.append([])
            todo.append((x, True))
            todo += [(c, False) for c in reversed(x.children)]
    return "".join(written[0])


def tidy_text(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r" *\n *", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def render_all(nodes: list, base_url: str = "") -> str:
    return tidy_text("".join(render(n, base_url) for n in nodes))


def to_markdown(html: str, base_url: str = "") -> str:
    return render_all(parse(html).children, base_url)


def _groups(nodes: list, tag: str, first: str | None):
    """(label, nodes) of the stretches between ``tag`` elements among siblings."""
    label, part = first, []
    for n in nodes:
        if isinstance(n, Node) and n.name == tag:
            yield label, part
            label, part = n.label(), []
        else:
            part.append(n)
    yield label, part


def article_sections(html: str, base_url: str = "") -> list[tuple[str | None, str | None, str]]:
    """(heading, subheading, text) per <section> and its <h3> parts; by <h2> where no section exists."""
    root = parse(html)
    sections = list(root.find_all({"section"}))
    if not sections:
        return [(h, None, render_all(nodes, base_url)) for h, nodes in _groups(root.children, "h2", None) if nodes]
    out = []
    for section in sections:
        head = section.find({"h2", "h3"})
        heading = None
        if head is not None:
            heading = head.label()
            head.parent.children.remove(head)
        for sub, nodes in _groups(section.children, "h3", None):
            text = render_all(nodes, base_url)
            if text or sub:
                out.append((heading, sub, text))
    return out


def card_sections(html: str, base_url: str = "", card: str = "collapsiblecard") -> list[tuple[str, str, str]]:
    """(number, title, text) of every card with .subtitle, .title and a .body that has text."""
    out = []
    for node in parse(html).find_all({card}):
        number, title, body = node.find(css="subtitle"), node.find(css="title"), node.find(css="body")
        if number is None or title is None or body is None:
            continue
        text = render_all(body.children, base_url)
        if text:
            out.append((number.label(), render_all(title.children, base_url).split("\n")[0].strip(), text))
    return out


def number_clauses(root: Node, css: str = "custom_list") -> None:
    """Write the counters of ul.<css> lists, given as --prefix and --suffix styles, into their items."""
    for ul in list(root.find_all({"ul"}, css)):
        style = ul.attrs.get("style", "")
        prefix = re.search(r"--prefix:\s*'([^']*)'", style)
        suffix = re.search(r"--suffix:\s*'([^']*)'", style)
        items = [c for c in ul.children if isinstance(c, Node) and c.name == "li"]
        for i, li in enumerate(items, 1):
            li.children.insert(0, f"{prefix[1] if prefix else ''}{i}{suffix[1] if suffix else ')'} ")
            li.name = "p"


def clause_groups(root: Node) -> list[tuple[str | None, list]]:
    """(heading, nodes) between h3 elements in document order, through any wrappers that hold some."""
    groups: list[tuple[str | None, list]] = [(None, [])]
    stack = list(reversed(root.children))
    while stack:
        x = stack.pop()
        if isinstance(x, Node) and x.name == "h3":
            groups.append((x.label(), []))
        elif isinstance(x, Node) and x.find({"h3"}) is not None:
            stack += reversed(x.children)
        else:
            groups[-1][1].append(x)
    return [g for g in groups if g[0] or g[1]]


ANCHOR = re.compile(r'<HashLinkTarget\b[^>]*\bid="(\d+)"[^>]*>')


def clause_sections(source: str, prepare=lambda s: s, base_url: str = "", least: int = 40) -> list[tuple[str, str, str | None, str]]:
    """(section id, section title, clause group, text) of numbered terms; id 0 is the preamble.

    The source is cut at its anchors before parsing, since its components defeat error recovery.
    """
    marks = list(ANCHOR.finditer(source))
    out = []
    head = parse(prepare(source[: marks[0].start()] if marks else source))
    number_clauses(head)
    preamble = head.find({"div"}, "preamble")
    if preamble is not None and (text := render_all(preamble.children, base_url)):
        out.append(("0", "Preamble", None, text))
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        root = parse(prepare(source[m.start() : after.start() if after else len(source)]))
        number_clauses(root)
        title = root.find({"h2"})
        if title is None:
            continue
        name = title.label()
        title.parent.children.remove(title)
        for heading, nodes in clause_groups(root):
            text = render_all(nodes, base_url)
            if len(text) >= least:
                out.append((m[1], name, heading, text))
    return out
