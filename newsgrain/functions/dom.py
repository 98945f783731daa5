"""A small HTML tree on the standard library's parser, and a matcher for CSS and simple XPath selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

#: Elements without content, and which open elements a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def shown(self) -> str:
        """Text with runs of line ends and spaces as one space and br as a line end, stripped."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(re.sub("[\n\r ]+", " ", n))
            elif n.tag == "br":
                out.append("\n")
            else:
                stack.extend(reversed(n.children))
        return "".join(out).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.at = self.root

    def _open(self, tag: str) -> set[str]:
        return {tag}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        if tag == "html":
            for k, v in values.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag in BLOCKS and self._within("p"):
            self._close("p")
        for closed in ENDS.get(tag, ()):
            if self.at.tag == closed:
                self.at = self.at.parent or self.root
        node = Node(tag, values, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "html":
            self._close(tag)

    def _within(self, tag: str) -> bool:
        n: Node | None = self.at
        while n is not None and n.tag not in ("body", "td", "th"):
            if n.tag == tag:
                return True
            n = n.parent
        return False

    def _close(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def parse(html: str) -> Node:
    """The tree of a page; characters that XML forbids go first."""
    b = _Builder()
    b.feed(_BAD.sub("", html))
    b.close()
    return b.root


def paths(root: Node, attributes: tuple[str, ...] = ("class", "property", "itemprop")) -> set[str]:
    """Tag paths and attribute leaves; a leaf hangs on the path of its element (K1)."""
    out: set[str] = set()
    stack = [(root, root.tag)]
    while stack:
        node, path = stack.pop()
        out.add(path)
        for a in attributes:
            out.update(f"{path}/[@{a}={v}]" for v in node.attrs.get(a, "").split())
        stack += [(c, f"{path}/{c.tag}") for c in node.elements()]
    return out


_SIMPLE = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]")
_PSEUDO = re.compile(r"::(text|attr\(\s*([\w:-]+)\s*\))\s*$")

Test = tuple  # (kind, name, operator, value)
Step = tuple  # (combinator, tests)


def _compound(text: str) -> list[Test]:
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not supported: {text!r}")
        if m["tag"]:
            tests.append(("tag", m["tag"].lower(), None, None))
        elif m["cls"]:
            tests.append(("attr", "class", "~=", m["cls"]))
        elif m["id"]:
            tests.append(("attr", "id", "=", m["id"]))
        else:
            value = m["val"]
            tests.append(("attr", m["attr"].lower(), m["op"], value.strip("\"'") if value else None))
        at = m.end()
    if not tests:
        raise ValueError("empty selector")
    return tests


def _chain(text: str) -> list[Step]:
    tokens = re.findall(r"\s*[>+~]\s*(?![^\[]*\])|(?:\[[^\]]*\]|[^\s>+~\[])+|\s+", text.strip())
    steps, joint = [], ""
    for t in tokens:
        s = t.strip()
        if s in (">", "+", "~"):
            joint = s
        elif not s:
            joint = joint or " "
        else:
            steps.append((joint or " ", _compound(s)))
            joint = ""
    if not steps or joint.strip():
        raise ValueError(f"selector not supported: {text!r}")
    return steps


def _passes(node: Node, tests: list[Test]) -> bool:
    for kind, name, op, value in tests:
        if kind == "tag":
            if name not in ("*", node.tag):
                return False
            continue
        have = node.attrs.get(name)
        if have is None:
            return False
        ok = {
            None: True,
            "=": have == value,
            "~=": value in have.split(),
            "^=": bool(value) and have.startswith(value or ""),
            "$=": bool(value) and have.endswith(value or ""),
            "*=": bool(value) and (value or "") in have,
            "|=": have == value or have.startswith(f"{value}-"),
        }[op]
        if not ok:
            return False
    return True


def _matches(node: Node, steps: list[Step]) -> bool:
    joint, tests = steps[-1]
    if not _passes(node, tests):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if joint == ">":
        return node.parent is not None and _matches(node.parent, rest)
    if joint in "+~" and joint.strip():
        if node.parent is None:
            return False
        before = node.parent.elements()
        before = before[: before.index(node)]
        return any(_matches(x, rest) for x in (before[-1:] if joint == "+" else before))
    up = node.parent
    while up is not None:
        if _matches(up, rest):
            return True
        up = up.parent
    return False


def _xpath(expression: str):  # noqa: ANN202
    """Steps ``//tag`` and ``/tag`` with ``[@a]`` and ``[@a='v']``, ending in ``/@a`` or ``/text()`` perhaps."""
    m = re.fullmatch(r"((?://?(?:[\w*-]+)(?:\[@[\w:-]+(?:=(?:'[^']*'|\"[^\"]*\"))?\])*)+)(?:/(@[\w:-]+|text\(\)))?", expression.strip())
    if not m:
        raise ValueError(f"xpath not supported: {expression!r}")
    steps = []
    for joint, tag, conditions in re.findall(r"(//?)([\w*-]+)((?:\[[^\]]*\])*)", m[1]):
        tests: list[Test] = [("tag", tag.lower(), None, None)]
        for name, _, value in re.findall(r"\[@([\w:-]+)(=(?:'([^']*)'|\"[^\"]*\"))?\]", conditions):
            tests.append(("attr", name, "=" if _ else None, _[2:-1] if _ else value or None))
        steps.append((joint, tests))

    def run(root: Node) -> list[Node | str]:
        found = [root] if steps[0][0] == "/" and _passes(root, steps[0][1]) else [n for n in [root, *root.walk()] if steps[0][0] == "//" and _passes(n, steps[0][1])]
        for joint, tests in steps[1:]:
            nxt: list[Node] = []
            for n in found:
                for c in n.elements() if joint == "/" else n.walk():
                    if _passes(c, tests) and not any(c is x for x in nxt):
                        nxt.append(c)
            found = nxt
        if not m[2]:
            return list(found)
        if m[2] == "text()":
            return [c for n in found for c in n.children if isinstance(c, str)]
        return [n.attrs[m[2][1:]] for n in found if m[2][1:] in n.attrs]

    return run


def _css(selector: str):  # noqa: ANN202
    parts = []
    for piece in re.split(r",(?![^\[]*\])", selector):
        pseudo = _PSEUDO.search(piece)
        body = piece[: pseudo.start()] if pseudo else piece
        parts.append((_chain(body.strip() or "*"), pseudo[1] if pseudo else None, pseudo[2] if pseudo else None))

    def run(root: Node) -> list[Node | str]:
        out: list[Node | str] = []
        for node in [root, *root.walk()]:
            for steps, pseudo, attr in parts:
                if not _matches(node, steps):
                    continue
                if pseudo is None:
                    out.append(node)
                elif pseudo == "text":
                    out += [c for c in node.children if isinstance(c, str)]
                elif attr in node.attrs:
                    out.append(node.attrs[attr])
                else:
                    continue
                break
        return out

    return run


def main_content(root: Node) -> Node:
    """The densest block of text (J5): paragraphs score their length and commas for parent and grandparent, less by link share."""
    score: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for p in root.walk():
        if p.tag not in ("p", "pre", "td", "article"):
            continue
        t = p.text().strip()
        if len(t) < 25:
            continue
        gain = 1 + t.count(",") + min(len(t) / 100, 3)
        for up, part in ((p.parent, 1.0), (p.parent.parent if p.parent else None, 0.5)):
            if up is not None:
                nodes[id(up)] = up
                score[id(up)] = score.get(id(up), 0.0) + gain * part
    if not score:
        return root

    def weight(k: int) -> float:
        n = nodes[k]
        links = sum(len(a.text()) for a in n.walk() if a.tag == "a")
        return score[k] * (1 - links / max(len(n.text()), 1))

    return nodes[max(score, key=weight)]


TEXT, SUMMARY, XPATH = "((text))", "((readability.summary))", "((xpath))"


@lru_cache(maxsize=1024)
def compiled(alternative: str):  # noqa: ANN201
    """(extractor of a tree, whether to take shown text) of one alternative; (None, False) for an empty one."""
    s = alternative.strip()
    if not s:
        return None, False
    shown = s.startswith(TEXT)
    s = s.removeprefix(TEXT).strip()
    summary = s.startswith(SUMMARY)
    s = s.removeprefix(SUMMARY).strip()
    if not s:
        find = lambda root: [root]
    elif s.startswith(XPATH):
        find = _xpath(s.removeprefix(XPATH))
    else:
        find = _css(s)
    return (lambda root: find(main_content(root))) if summary else find, shown


def _alternatives(program: str) -> list[str]:
    """Split at semicolons outside quotes, after comments and one prefix of each kind."""
    s = re.sub(r"\(\(comment.*?\)\)", "", program)
    s = s.removeprefix("<domain>").strip()
    s = s.removeprefix("<default>").strip()
    return [x for x in re.findall(r"((?:\"[^\"]*\"|'[^']*'|[^;\"'])*)(?:;|$)", s)]


def compiles(program: str | None) -> bool:
    """Whether every alternative is understood (the smoke test of M3)."""
    try:
        for a in _alternatives(program or ""):
            compiled(a)
    except ValueError:
        return False
    return True


def extract(program: str | None, root: Node) -> tuple[list[str] | None, int | None]:
    """Texts found by the first alternative that finds any, and its index; (None, None) if none does."""
    if not program:
        return None, None
    for i, a in enumerate(_alternatives(program)):
        find, shown = compiled(a)
        if find is None:
            continue
        got = [x if isinstance(x, str) else x.shown() if shown else x.text() for x in find(root)]
        if any(g.strip() for g in got):
            return got, i
    return None, None


def annotations(root: Node) -> list[tuple[str, str, int, list[str] | None]]:
    """Semantic annotation found (J10): (scheme, what, number, sorted distinct values; none for elements)."""
    every = [root, *root.walk()]
    has = lambda n, *names: all(a in n.attrs for a in names)
    values = {
        ("rdfa", "property"): [n.attrs["property"] for n in every if has(n, "property")],
        ("rdfa", "datatype"): [n.attrs["property"] for n in every if has(n, "property", "datatype")],
        ("rdfa", "no content"): [n.attrs["property"] for n in every if has(n, "property") and not has(n, "content")],
        ("microdata", "itemprop"): [n.attrs["itemprop"] for n in every if has(n, "itemprop")],
        ("microdata", "datetime"): [n.attrs["itemprop"] for n in every if has(n, "itemprop", "datetime")],
    }
    entries = [n for n in every if "hentry" in n.attrs.get("class", "").split()]
    lines = {id(x): x for e in entries for x in [e, *e.walk()] if "dateline" in x.attrs.get("class", "").split()}
    out: list[tuple[str, str, int, list[str] | None]] = [(k, a, len(v), sorted(set(v))) for (k, a), v in values.items() if v]
    out += [("hnews", a, n, None) for a, n in (("hentry", len(entries)), ("dateline", len(lines))) if n]
    return out
