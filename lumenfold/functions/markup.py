"""The elements of an HTML page, in document order, as plain records."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from .style_rules import Sheet

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag closes when it stands innermost.
CLOSES = {"option": {"option"}, "li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
#: Elements whose text is kept whole; of others SHORT characters are.
WHOLE, SHORT, NEAREST, NEARBY = frozenset({"label", "option", "textarea"}), 201, 8, 120
UNSEEN = frozenset({"option", "script", "style"})
#: Attributes that name other elements, whose text is then kept whole.
REFERENCES = ("aria-labelledby", "aria-controls", "aria-owns", "list")


class _Scope:
    """A tree of its own: the document or an open shadow root."""

    def __init__(self, host: tuple[int, int]):
        self.host, self.elements, self.pieces, self.children, self.forms, self.sheet = host, [], [], {}, 0, Sheet()


class Page(HTMLParser):
    """Collects elements: node, parent, last (node of the subtree's end), prev (sibling), ancestors, nearest label and cell, form, attributes, texts.

    What a template holds is no part of the page, but where it is an open shadow root: a tree beside that of its host,
    whose elements see no styles of the other; names are looked up in the document, as pages do. Every pass is linear in the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.scopes, self.open, self.tags, self.unseen = [_Scope((0, 0))], [], Counter(), 0

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1]["tag"] in CLOSES.get(tag, ()):
            self.close_one()
        own = {}
        for key, value in attrs:
            own.setdefault(key, value or "")
        above = self.open[-1] if self.open else {"tag": "", "into": 0}
        scope = above["into"]
        e = {"tag": tag, "attrs": own, "scope": scope, "into": scope}
        if tag == "template":
            shadow = scope is not None and own.get("shadowrootmode", "").lower() == "open" and "node" in above and above["scope"] == scope
            e["into"] = len(self.scopes) if shadow else None
            if shadow:
                self.scopes.append(_Scope((scope, above["node"])))
        elif scope is not None:
            self._record(e, above if above.get("scope") == scope and "node" in above else None, self.scopes[scope])
        self.tags[tag] += 1
        self.unseen += tag in UNSEEN
        self.open.append(e)
        if tag in VOID:
            self.close_one()

    def _record(self, e: dict, up: dict | None, tree: _Scope) -> None:
        node, tag = len(tree.elements), e["tag"]
        ancestors = [] if up is None else [up["node"], *up["ancestors"][: NEAREST - 1]]
        e |= {"node": node, "parent": up and up["node"], "prev": tree.children.get(up and up["node"]), "ancestors": ancestors, "from": len(tree.pieces)}
        e |= {"label": node if tag == "label" else up and up["label"], "cell": node if tag == "td" else up and up["cell"], "form": up["form"] if up else -1}
        if tag == "form" and tree is self.scopes[0]:
            e["form"], tree.forms = tree.forms, tree.forms + 1
        tree.children[e["parent"]] = node
        tree.elements.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.tags[tag]:
            while self.open[-1]["tag"] != tag:
                self.close_one()
            self.close_one()

    def handle_data(self, data):
        into = self.open[-1]["into"] if self.open else 0
        if into is None:
            return
        tree = self.scopes[into]
        if self.open and self.open[-1]["tag"] == "style":
            tree.sheet.read(data)
        words = " ".join(data.split())
        if words:
            tree.pieces.append((data[0].isspace(), words, data[-1].isspace(), self.unseen > 0))
        elif tree.pieces:
            tree.pieces[-1] = (*tree.pieces[-1][:2], True, tree.pieces[-1][3])

    def close_one(self):
        e = self.open.pop()
        self.tags[e["tag"]] -= 1
        self.unseen -= e["tag"] in UNSEEN
        if "node" not in e:
            return
        tree = self.scopes[e["scope"]]
        e["last"], e["to"] = len(tree.elements) - 1, len(tree.pieces)
        e["text"] = _joined(tree.pieces, e["from"], e["to"], None if e["tag"] in WHOLE else SHORT, True)
        e["near"] = _joined(tree.pieces, e["from"], e["to"], NEARBY, False)


def _joined(pieces: list, start: int, stop: int, most: int | None, unseen: bool) -> str | None:
    """Pieces with blanks collapsed, `most` characters; None where nothing is left. Each piece has a character at least, so no more than `most` are read."""
    out, size, blank = [], 0, False
    for i in range(start, stop):
        before, words, after, hidden = pieces[i]
        if hidden and not unseen:
            continue
        if out and (blank or before):
            out.append(" ")
        out.append(words)
        size, blank = size + len(words), after
        if most and size > most:
            break
    text = "".join(out)
    return text[:most] or None


def _seen(tree: _Scope) -> None:
    """Sets shown: not hidden by an attribute, an inline style or a rule of the tree's style sheets, itself or by an element around it."""
    for e in tree.elements:  # parents come first
        own, up = e["attrs"], None if e["parent"] is None else tree.elements[e["parent"]]
        style = tree.sheet.style(e, tree.elements)
        clear = re.fullmatch(r"0*\.?0+%?", style.get("opacity", "1")) is not None
        seen = (up is None or up["inner"]) and "hidden" not in own and style.get("display") != "none" and style.get("visibility") not in ("hidden", "collapse")
        e["shown"], e["inner"] = seen and (not clear or own.get("type") in ("radio", "checkbox", "file")), seen and not clear


def _ordered(scopes: list[_Scope]) -> list[int]:
    """The document, then the shadow roots of its elements in their order, each followed by those within it."""
    within: dict[int, list] = {}
    for i, s in enumerate(scopes[1:], 1):
        within.setdefault(s.host[0], []).append((s.host[1], i))
    order, waiting = [], [0]
    while waiting:
        i = waiting.pop()
        order.append(i)
        waiting += [j for _, j in sorted(within.get(i, []), reverse=True)]
    return order


def elements(html: str | None) -> list[dict]:
    page = Page()
    page.feed(html or "")
    page.close()
    while page.open:
        page.close_one()
    named = {x for tree in page.scopes for e in tree.elements for r in REFERENCES if r in e["attrs"] for x in e["attrs"][r].split()}
    out = []
    for i in _ordered(page.scopes):
        tree, shift = page.scopes[i], len(out)
        _seen(tree)
        for e in tree.elements:
            if e["attrs"].get("id") in named:
                e["text"] = _joined(tree.pieces, e["from"], e["to"], None, True)
            for k in ("node", "parent", "prev", "last", "label", "cell"):
                e[k] = None if e[k] is None else e[k] + shift
            e["ancestors"] = [a + shift for a in e["ancestors"]]
            e["attrs"] = list(e["attrs"].items())
            out.append(e)
    return out
