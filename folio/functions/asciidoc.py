"""AsciiDoc: documents to rows of nodes and to HTML.

A document is parsed by one worker, documents in parallel: blocks depend on what stands before them. The tree becomes
rows (path, kind, text, options), on which everything else (tables of contents, cross references, plain text, counters)
is DataFrame work. Rendering covers sections, paragraphs, listings, lists, tables, quotes, admonitions, images, links and
inline styles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.plans.durable import spread

ADMONITIONS = ("NOTE", "TIP", "IMPORTANT", "CAUTION", "WARNING")
# Addresses of players, the query that they begin with, and what options add to it.
PLAYERS = {
    "youtube": ("www.youtube.com/embed/", "?rel={}", (("start", "start={}"), ("end", "end={}"), ("autoplay", "autoplay=1"), ("loop", "loop=1"), ("muted", "mute=1"), ("nocontrols", "controls=0"), ("list", "list={}"), ("nofullscreen", "fs=0"), ("modest", "modestbranding=1"), ("theme", "theme={}"), ("lang", "hl={}"))),
    "vimeo": ("player.vimeo.com/video/", "", (("autoplay", "autoplay=1"), ("loop", "loop=1"), ("muted", "muted=1"), ("hash", "h={}"))),
}
_FENCES = {"----": "listing", "====": "example", "____": "quote", "****": "sidebar", "++++": "passthrough", "....": "literal", "--": "open", "|===": "table", "```": "listing"}
_ITEM = re.compile(r"^\s*(\*+|-|\.+|\d+\.|[A-Za-z]\.|[ivxIVX]+\))\s+(.*)$")
_TERM = re.compile(r"^(.+?)(:{2,4}|;;)(?:\s+(.*))?$")
_FENCE_STARTS = {f[0] for f in _FENCES}
_ADMONITION = re.compile(rf"^({'|'.join(ADMONITIONS)}): (.*)$")
_ATTRIBUTE = re.compile(r"^:(!?)([\w-]+)(!?):(?:\s+(.*))?$")


def _term(line: str) -> re.Match | None:
    return _TERM.match(line) if "::" in line or ";;" in line else None


@dataclass
class Node:
    kind: str
    text: str = ""
    options: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)


def options_of(text: str, first: str = "") -> dict[str, str]:
    """name=value, positional values, .role, #id and %option of a bracket's content; quotes protect commas."""
    out: dict[str, str] = {}
    place = 0
    for part in re.findall(r'(?:[^,"]|"[^"]*")+', text):
        part = part.strip()
        name, eq, value = part.partition("=")
        if eq and re.fullmatch(r"[\w-]+", name.strip()):
            out[name.strip()] = value.strip().strip('"')
            continue
        # A label is taken as it stands; marks within a style are short forms.
        head = part.strip('"') if first == "label" and part[:1] not in (".", "#", "%") else re.match(r"^[^.#%\"]*", part)[0]
        rest = "" if first == "label" and head and head == part.strip('"') else part[len(head) :]
        for mark, word in re.findall(r"([.#%])([\w-]+)", rest if not rest.startswith('"') else ""):
            key = {".": "role", "#": "id", "%": "opts"}[mark]
            out[key] = f"{out[key]}{' ' if key == 'role' else ','}{word}" if key in out else word
        head = part.strip('"') if rest.startswith('"') else head
        if head:
            out[first if first and place == 0 else str(place)] = head
        place += 1
    return out


_INLINE = re.compile(
    r"(?P<esc>\\[*_`#^~])|(?P<code>`([^`]+)`)|(?P<bold>\*\*(.+?)\*\*|\*(\S(?:[^*]*\S)?)\*)|(?P<italic>__(.+?)__|(?<!\w)_(\S(?:[^_]*\S)?)_(?!\w))|(?P<strike>~~(.+?)~~)|(?P<sub>~([^~\s]+)~)|(?P<sup>\^([^^\s]+)\^)"
    r"|(?P<mark>(?:\[(?P<mo>[^\]]*)\])?\#(?P<mt>[^#]+)\#)|(?P<place>\[\[\[?[\w-]+(?:,[^\]]*)?\]\]\]?)|(?P<ref><<([^,>]+)(?:,([^>]+))?>>)|(?P<mdimage>!\[(?P<mit>[^\]]*)\]\((?P<miu>[^)\s]+)\))|(?P<stem>stem:\[((?:\\\]|[^\]])*)\])|(?P<mdlink>\[(?P<mlt>[^\]]+)\]\((?P<mlu>[^)\s]+)\))|(?P<attr>\{([\w-]+(?::[^}]*)?)\})"
    r"|(?P<macro>(?<![\w])([a-z][\w]*)::?((?:[^\s\[\]]|(?<=icon:fas) |(?<=icon:far) |(?<=icon:fab) )*)\[((?:[^\[\]]|\[[^\[\]]*\])*)\])|(?P<url>(?:https?|ftp)://[^\s\[\]]+(?:\[([^\]]*)\])?)"
)


_MARKS = re.compile(r"[\\*`_#^~\[{<]|://")


def inline(text: str) -> list[Node]:
    """Styles, code, links, macros, references and attributes of a line; what matches nothing stays text."""
    if not _MARKS.search(text):
        return [Node("text", text)] if text else []
    out: list[Node] = []

    def plain(t: str) -> None:
        if t:
            if out and out[-1].kind == "text":
                out[-1].text += t
            else:
                out.append(Node("text", t))

    at = 0
    for m in _INLINE.finditer(text):
        plain(text[at : m.start()])
        at = m.end()
        kind = next(k for k in ("esc", "code", "bold", "italic", "strike", "sub", "sup", "mark", "place", "ref", "mdimage", "stem", "mdlink", "attr", "macro", "url") if m[k])
        body = m[kind]
        if kind == "esc":
            plain(body[1])
        elif kind == "code":
            out.append(Node("code", body[1:-1]))
        elif kind in ("bold", "italic", "strike", "sub", "sup"):
            n = 2 if body[:2] in ("**", "__", "~~") else 1
            out.append(Node(kind, body[n:-n]))
        elif kind == "mark":
            out.append(Node("mark", m["mt"], options_of(m["mo"] or "")))
        elif kind == "place":
            out.append(Node("place", body.strip("[]").partition(",")[0]))
        elif kind == "ref":
            target, _, label = body[2:-2].partition(",")
            out.append(Node("anchor", label.strip(), {"target": target.strip()}))
        elif kind == "mdimage":
            out.append(Node("macro", m["miu"], {"name": "image", "label": m["mit"]}))
        elif kind == "stem":
            out.append(Node("macro", body[6:-1], {"name": "stem"}))
        elif kind == "mdlink":
            out.append(Node("link", m["mlt"], {"target": m["mlu"]}))
        elif kind == "attr":
            out.append(Node("attribute", body[1:-1]))
        elif kind == "url":
            target, _, label = body.partition("[")
            out.append(Node("link", options_of(label[:-1], "label").get("label", "") if label else "", {"target": target}))
        else:
            name, rest = re.match(r"([a-z]\w*)::?(.*)", body, re.S).groups()
            label, _, opts = rest.partition("[")
            whole = name in ("footnote", "doublefootnote", "footnoteref", "pass", "kbd", "btn", "menu") or name in ("link", "xref") and not re.search(r"(^|,)\s*[\w-]+=", opts)
            opts = {"label": opts[:-1]} if whole else options_of(opts[:-1], "label")
            if name == "link":
                out.append(Node("link", opts.pop("label", ""), {"target": label} | opts))
            else:
                out.append(Node("macro", label, {"name": name} | opts))
    plain(text[at:])
    return out


class Parser:
    """Blocks of one document. include: the text of a path, or None."""

    def __init__(self, include: Callable[[str], str | None] | None = None, depth: int = 16):
        self.include, self.depth = include, depth
        self.attributes: dict[str, str] = {}

    def _included(self, text: str, depth: int) -> list[str]:
        out: list[str] = []
        skipping: list[bool] = []
        for line in text.split("\n"):
            if "::" not in line and not line.startswith(":"):
                if not any(skipping):
                    out.append(line)
                continue
            m = re.match(r"^(ifdef|ifndef|ifeval|endif)::([^\[]*)\[(.*)\]\s*$", line)
            if m:
                if m[1] == "endif":
                    if skipping:
                        skipping.pop()
                elif m[1] == "ifeval":
                    a, op, b = re.match(r"\s*(.*?)\s*(==|!=|<=|>=|<|>)\s*(.*?)\s*$", self._filled(m[3])).groups()
                    a, b = a.strip("\"'"), b.strip("\"'")
                    if op in ("<", ">", "<=", ">="):
                        a, b = float(a or "nan"), float(b or "nan")
                    skipping.append(not {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
                else:
                    test = all if "+" in m[2] else any
                    has = test(x.strip() in self.attributes for x in re.split(r"[,+]", m[2]))
                    skipping.append(has == (m[1] == "ifndef"))
                    if m[3]:
                        if not skipping.pop():
                            out.append(m[3])
                continue
            if any(skipping):
                continue
            a = _ATTRIBUTE.match(line)
            if a:
                self._set(a)
                out.append(line)
                continue
            m = re.match(r"^include::([^\[]+)\[(.*)\]\s*$", line)
            if m and self.include is not None:
                if depth >= self.depth:
                    raise ValueError(f"includes nest deeper than {self.depth}")
                found = self.include(self._filled(m[1]))
                if found is None:
                    if "optional" in m[2]:
                        continue
                    raise ValueError(f"no such include: {m[1]}")
                out += self._included(found.rstrip("\n"), depth + 1)
                continue
            out.append(line)
        return out

    def _set(self, m: re.Match) -> None:
        if m[1] or m[3]:
            self.attributes.pop(m[2], None)
        else:
            self.attributes[m[2]] = self._filled(m[4] or "")

    def _filled(self, text: str) -> str:
        return re.sub(r"\{([\w-]+)\}", lambda m: self.attributes.get(m[1], m[0]), text)

    def document(self, text: str, header: bool = True) -> Node:
        """header: the title and attributes at the start are the document's; else a title is a section of level 0."""
        lines = self._included(text.replace("\r\n", "\n"), 0)
        root = Node("document")
        k = 0
        if not header:
            root.children = self.blocks(lines)
            return root
        while k < len(lines) and (not lines[k].strip() or lines[k].startswith("//") and not lines[k].startswith("////")):
            k += 1
        if k < len(lines) and re.match(r"^[=#] ", lines[k]):
            root.options["title"] = lines[k][2:].strip()
            k += 1
            if k < len(lines) and re.match(r"^[^:=\[].*<[^>]+>", lines[k]):
                root.options["authors"] = lines[k].strip()
                k += 1
                if k < len(lines) and re.match(r"^v?\d[\w.]*(,|:|$)", lines[k]):
                    root.options["revision"] = lines[k].strip()
                    k += 1
            while k < len(lines) and (a := _ATTRIBUTE.match(lines[k])):
                root.options[f"attribute:{a[2]}"] = a[4] or ""
                k += 1
        root.children = self.blocks(lines[k:])
        return root

    def blocks(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        sections: list[tuple[int, Node]] = []
        options: dict[str, str] = {}
        k = 0

        def add(node: Node) -> None:
            nonlocal options
            node.options = options | node.options
            options = {}
            (sections[-1][1].children if sections else out).append(node)

        while k < len(lines):
            line = lines[k]
            stripped = line.strip()
            if not stripped:
                k += 1
            elif stripped.startswith("////"):
                k += 1
                while k < len(lines) and lines[k].strip() != stripped:
                    k += 1
                k += 1
            elif stripped.startswith("//"):
                k += 1
            elif m := _ATTRIBUTE.match(line):
                self._set(m)
                add(Node("set-attribute", m[4] or "", {"name": m[2]}))
                k += 1
            elif stripped[0] == "[" and (m := re.match(r"^\[\[([\w-]+)\]\]$", stripped)):
                options["id"] = m[1]
                k += 1
            elif stripped[0] == "[" and (m := re.match(r"^\[([^\[\]]*)\]$", stripped)) is not None:
                options |= options_of(m[1], "style")
                k += 1
            elif line[0] == "." and (m := re.match(r"^\.([^\s.].*)$", line)) is not None:
                options["title"] = m[1].strip()
                k += 1
            elif line[0] in "=#" and (m := re.match(r"^([=#]{1,6}) (.*)$", line)) is not None:
                level = len(m[1])
                if "discrete" in options.get("style", ""):
                    add(Node("floating-title", m[2].strip(), {"level": str(level)}))
                else:
                    while sections and sections[-1][0] >= level:
                        sections.pop()
                    node = Node("section", m[2].strip(), {"level": str(level)})
                    add(node)
                    sections.append((level, node))
                k += 1
            elif stripped in ("'''", "---", "***"):
                add(Node("rule"))
                k += 1
            elif stripped == "<<<":
                add(Node("page-break"))
                k += 1
            elif stripped[0] in _FENCE_STARTS and (fence := next((f for f in _FENCES if stripped == f or f == "```" and stripped.startswith(f) or len(stripped) > 4 and f in ("----", "====", "____", "****") and set(stripped) == set(f)), None)) is not None:
                end = stripped if fence != "```" else "```"
                stop = k + 1
                while stop < len(lines) and lines[stop].strip() != end:
                    stop += 1
                add(self._fenced(fence, lines[k + 1 : stop], options | ({"language": stripped[3:].strip()} if stripped[3:].strip() and fence == "```" else {})))
                k = stop + 1
            elif _ITEM.match(line) or (_term(line) and "://" not in line.split("::")[0]):
                stop = self._list_end(lines, k)
                add(self._list(lines[k:stop]))
                k = stop
            elif m := _ADMONITION.match(line):
                stop = self._text_end(lines, k)
                add(Node("admonition", "", {"level": m[1]}, [Node("paragraph", " ".join([m[2], *(x.strip() for x in lines[k + 1 : stop])]), {}, inline(" ".join([m[2], *lines[k + 1 : stop]])))]))
                k = stop
            elif line.startswith(">"):
                stop = k
                while stop < len(lines) and lines[stop].startswith(">"):
                    stop += 1
                add(Node("quote", "", {"plain": "true"}, self.blocks([re.sub(r"^> ?", "", x) for x in lines[k:stop]])))
                k = stop
            elif line[0] == "<" and (line.startswith("<.>") or re.match(r"^<\d+> ", line)):
                items = []
                while k < len(lines) and re.match(r"^<(\.|\d+)> ", lines[k]):
                    body = lines[k].split("> ", 1)[1]
                    items.append(Node("item", body, {}, inline(body)))
                    k += 1
                add(Node("callouts", "", {}, items))
            elif stripped.startswith("|") and k + 1 < len(lines) and re.match(r"^\s*\|[\s:|-]+\|\s*$", lines[k + 1]):
                rows = []
                while k < len(lines) and lines[k].strip().startswith("|"):
                    if not re.match(r"^\s*\|[\s:|-]+\|\s*$", lines[k]):
                        rows.append(Node("row", "", {}, [Node("cell", c.strip(), {}, inline(c.strip())) for c in lines[k].strip().split("|") if c.strip()]))
                    k += 1
                add(Node("table", "", {"header": "true"}, rows))
            elif "::" in stripped and (m := re.match(r"^(\w+)::([^\[]*)\[(.*)\]$", stripped)):
                add(Node("macro", m[2], {"name": m[1], "block": "true"} | options_of(m[3], "label")))
                k += 1
            else:
                stop = self._text_end(lines, k)
                hard = any(x.endswith(("  ", " +")) for x in lines[k : stop - 1])
                body = "\n".join(re.sub(r"(  | \+)$", "", x).rstrip() for x in lines[k:stop]) if hard else " ".join(x.rstrip() for x in lines[k:stop])
                style = options.get("style", "")
                if hard:
                    options["breaks"] = "true"
                if style in ADMONITIONS:
                    add(Node("admonition", "", {"level": style}, [Node("paragraph", body, {}, inline(body))]))
                elif style in ("quote", "abstract"):
                    add(Node("quote", "", {}, [Node("paragraph", body, {}, inline(body))]))
                else:
                    add(Node("paragraph", body, {}, inline(body)))
                k = stop
        return out

    @staticmethod
    def _text_end(lines: list[str], k: int) -> int:
        k += 1
        while k < len(lines) and (s := lines[k].strip()) and s not in _FENCES and not (s[0] == "[" and re.match(r"^\[[^\[\]]*\]$", s)):
            k += 1
        return k

    @staticmethod
    def _list_end(lines: list[str], k: int) -> int:
        fence = None
        while k < len(lines):
            s = lines[k].strip()
            if fence:
                fence = None if s == fence else fence
            elif s in _FENCES and s != "--":
                fence = s
            elif not s and not (k + 1 < len(lines) and (_ITEM.match(lines[k + 1]) or _term(lines[k + 1]))):
                return k
            k += 1
        return k

    def _list(self, lines: list[str]) -> Node:
        """Nests by the marker: a marker not seen yet on the way down opens a list below the last item."""
        root: Node | None = None
        stack: list[tuple[str, Node]] = []
        k = 0
        while k < len(lines):
            line = lines[k]
            item, term = _ITEM.match(line), _term(line)
            if item or term:
                marker, body = (item[1], item[2]) if item else (term[2], term[3] or "")
                family = marker if marker[0] in "*-." else re.sub(r"^\d+\.$", "1.", re.sub(r"^[A-Za-z]\.$", lambda m: "a." if m[0].islower() else "A.", re.sub(r"^[ivx]+\)$", "i)", re.sub(r"^[IVX]+\)$", "I)", marker))))
                kind = "ulist" if marker[0] in "*-" else "dlist" if not item else "olist"
                while stack and all(f != family for f, _ in stack[-1:]) and any(f == family for f, _ in stack):
                    stack.pop()
                if not stack or stack[-1][0] != family:
                    style = {"a.": "loweralpha", "A.": "upperalpha", "i)": "lowerroman", "I)": "upperroman"}.get(family, "")
                    node = Node(kind, "", {"style": style} if style else {})
                    if stack:
                        stack[-1][1].children[-1].children.append(node)
                    else:
                        root = node
                    stack.append((family, node))
                options = {}
                if item and (c := re.match(r"^\[([ x*])\] (.*)$", body)):
                    options, body = {"checked": str(c[1] != " ").lower()}, c[2]
                if not item:
                    options = {"term": term[1]}
                more: list[str] = []
                nested: list[str] = []
                k += 1
                while k < len(lines) and not _ITEM.match(lines[k]) and not (_term(lines[k]) and not nested):
                    if lines[k].strip() == "+":
                        nested.append("")
                        k += 1
                        if k < len(lines) and lines[k].strip() in _FENCES:
                            end = lines[k].strip()
                            nested.append(lines[k])
                            k += 1
                            while k < len(lines):
                                nested.append(lines[k])
                                k += 1
                                if nested[-1].strip() == end:
                                    break
                        continue
                    (nested if nested else more).append(lines[k])
                    k += 1
                body = " ".join([x for x in [body, *(m.strip() for m in more)] if x])
                stack[-1][1].children.append(Node("item", body, options, [Node("paragraph", body, {}, inline(body)), *self.blocks(nested)] if body else self.blocks(nested)))
            else:
                k += 1
        return root or Node("ulist")

    def _fenced(self, fence: str, lines: list[str], options: dict[str, str]) -> Node:
        kind = _FENCES[fence]
        if kind == "table":
            return self._table(lines, options)
        if kind in ("example", "quote", "sidebar", "open"):
            if options.get("style") in ADMONITIONS:
                return Node("admonition", "", {"level": options["style"]}, self.blocks(lines))
            return Node(kind, "", {}, self.blocks(lines))
        text = "\n".join(lines) + ("\n" if lines else "")
        if kind == "passthrough" and options.get("style") in ("stem", "latexmath", "asciimath"):
            return Node("stem", "\n".join(lines), {"kind": options["style"]})
        return Node(kind, text, {k: v for k, v in (("language", options.get("language") or options.get("1", "")),) if v})

    @staticmethod
    def _table(lines: list[str], options: dict[str, str]) -> Node:
        """Rows of as many cells as the columns, or else the first line, say; "2+" or ".3+" before a cell's bar are its spans."""
        cells: list[Node] = []
        first = 0
        for line in lines:
            parts = re.split(r"(?<!\\)\|", line)
            if parts[0].strip() and cells:
                cells[-1].text += "\n" + parts[0].strip()
            spans: dict[str, str] = {}
            for k, part in enumerate(parts[1:], 1):
                m = re.fullmatch(r"\s*(\d+)?(?:\.(\d+))?\+\s*", part)
                if m and (m[1] or m[2]) and k + 1 < len(parts):
                    spans = {name: v for name, v in (("colspan", m[1]), ("rowspan", m[2])) if v}
                else:
                    cells.append(Node("cell", part.strip(), spans | {"raw": part if k + 1 < len(parts) else part.rstrip()}))
                    spans = {}
            first = first or len(cells)
        for c in cells:
            c.children = inline(c.text)
        columns = [c for c in options.get("cols", "").split(",") if c.strip()]
        width = len(columns) or first or 1
        header = "noheader" not in options.get("options", options.get("opts", ""))
        return Node("table", "", {"columns": str(width), "header": str(header).lower()}, [Node("row", "", {}, cells[i : i + width]) for i in range(0, len(cells), width)])


def rows_of(node: Node, path: tuple[int, ...] = (), kinds: Collection[str] | None = None) -> list[tuple[list[int], str, str, dict[str, str]]]:
    """Of all nodes, or of those of some kinds."""
    out: list[tuple[list[int], str, str, dict[str, str]]] = []
    _add_rows(node, list(path), kinds, out)
    return out


def _add_rows(node: Node, path: list[int], kinds: Collection[str] | None, out: list) -> None:
    if kinds is None or node.kind in kinds:
        out.append((path[:], node.kind, node.text, node.options))
    for k, child in enumerate(node.children):
        path.append(k)
        _add_rows(child, path, kinds, out)
        path.pop()


def title_anchor(title: str, attributes: dict[str, str]) -> str:
    sep = attributes.get("idseparator", "_")
    plain = re.sub("<[^>]+>", "", title).lower().replace(" ", sep).replace("\n", "")
    return attributes.get("idprefix", "_") + re.sub(r"[^\w]", "", plain)


class Html:
    """One renderer for each document."""

    toc = ""

    def __init__(self, attributes: dict[str, str] | None = None, macros: dict[str, Callable[[Node], str]] | None = None):
        """macros: what further macros give, by name; they come before the known ones."""
        self.attributes = dict(attributes or {})
        self.macros = macros or {}
        self.titles: dict[str, str] = {}
        self.counters: dict[str, int] = {}
        self.notes: list[str] = []
        self.named: dict[str, int] = {}
        self.terms = 0

    def catalogue(self, node: Node) -> None:
        if node.kind == "set-attribute":
            self.attributes[node.options["name"]] = node.text
        if node.kind == "section":
            self.titles.setdefault(node.options.get("id") or title_anchor(node.text, self.attributes), node.text)
        for c in node.children:
            self.catalogue(c)

    def spans(self, nodes: list[Node]) -> str:
        return "".join(self.span(n) for n in nodes)

    def _image(self, n: Node) -> str:
        """The img element, inside its link if it has one."""
        src = n.text
        folder = self.attributes.get("imagesdir")
        if folder and not re.match(r"^(/|\w+:)", src):
            src = folder.rstrip("/") + "/" + src
        size = "".join(f' {k}="{escape(n.options[k])}"' for k in ("width", "height") if k in n.options)
        return f'<img src="{escape(src, quote=False)}" alt="{escape(n.options.get("alt") or n.options.get("label") or src.rsplit("/", 1)[-1])}"{size}>'

    def _footnote(self, key: str, label: str) -> str:
        if not label and key:
            number = self.named.get(key)
            return f' <sup class="footnoteref">[<a class="footnote" href="#_footnotedef_{number}" title="View footnote.">{number}</a>]</sup>\n' if number else f' <sup class="footnoteref red" title="Unresolved footnote reference.">[{escape(key)}]</sup>\n'
        self.notes.append(label)
        number = len(self.notes)
        if key:
            self.named[key] = number
        own = f' id="_footnote_{key}"' if key else ""
        return f' <sup class="footnote"{own}>[<a id="_footnoteref_{number}" class="footnote" href="#_footnotedef_{number}" title="View footnote.">{number}</a>]</sup>\n'

    def _macro(self, n: Node) -> str:
        name, label = n.options["name"], n.options.get("label", "")
        if name in self.macros:
            return self.macros[name](n)
        if name in ("audio", "video"):
            return self._media(n, label)
        if name == "counter":  # sets a number and shows nothing
            self.counters[n.text] = int(label or 1)
            return ""
        if name == "xref":
            file, hash_, anchor = n.text.partition("#")
            if file.endswith(".adoc"):
                file = self.attributes.get("relfileprefix", "") + file[: -len(".adoc")] + self.attributes.get("relfilesuffix", ".html")
            shown = label or self.titles.get(anchor or n.text, n.text)
            return f' <a href="{escape(file + hash_ + anchor)}">{self.spans(inline(shown))}</a>\n'
        if name == "image":
            role = " " + n.options["role"] if n.options.get("role") else ""
            return f' <span class="image{role}">{self._image(n)}</span>\n'
        if name == "icon":
            return f'<span class="icon"><i class="{escape(n.text)}"></i></span>'
        if name == "kbd":
            keys = [f"<kbd>{escape(k.strip(), quote=False)}</kbd>" for k in label.split("+")]
            return " + ".join(keys) + "\n" if len(keys) > 1 else f" {keys[0]}\n"
        if name == "btn":
            return f' <b class="button">{escape(label, quote=False)}</b>\n'
        if name == "menu":
            if not label:
                return f' <b class="menuref">{escape(n.text, quote=False)}</b>\n'
            *under, top = n.text.split(">")
            caret = '&#160;<b class="caret">&#8250;</b> '
            parts = [f'<b class="menu">{escape(top.strip(), quote=False)}</b>', *[f'<b class="submenu">{escape(u.strip(), quote=False)}</b>' for u in under], f'<b class="menuitem">{escape(label, quote=False)}</b>']
            return f' <span class="menuseq">{caret.join(parts)}</span>\n'
        if name == "pass":
            return label
        if name in ("footnote", "doublefootnote"):
            return self._footnote(n.text, label)
        if name == "footnoteref":
            key, _, text = label.partition(",")
            return self._footnote(key.strip(), text.strip())
        if name in ("stem", "asciimath"):
            return f" \\${n.text or label}\\$ "
        if name == "latexmath":
            return f" \\({n.text or label}\\) "
        if name in ("indexterm", "indexterm2"):
            self.terms += 1
            return f' <a id="indexterm-{self.terms}"></a>\n'
        return ""

    def _media(self, n: Node, label: str) -> str:
        """A player, in its block."""
        name, o = n.options["name"], n.options
        poster = label or o.get("poster", "")
        size = "".join(f' {k}="{escape(o[k])}"' for k in ("width", "height") if k in o)
        given = lambda *keys: "".join(f" {k}" for k in keys if k in o)
        controls = "" if "nocontrols" in o else " controls"
        preload = f' preload="{escape(o["preload"])}"' if "preload" in o else ""
        source = escape(n.text)
        if name == "audio":
            inner = f'  <audio src="{source}"{given("autoplay")}{controls}{given("loop", "muted")}{preload}>\n  Your browser does not support the audio tag.\n  </audio>\n'
        elif poster in PLAYERS:
            place, query, parts = PLAYERS[poster]
            scheme = self.attributes.get("asset-uri-scheme", "https")
            more = "".join("&amp;" + p.format(escape(o[k])) for k, p in parts if k in o)
            start = f"#at={escape(o['start'])}" if poster == "vimeo" and "start" in o else ""
            full = "" if "nofullscreen" in o else " allowfullscreen"
            inner = f'  <iframe{size} src="{scheme + ":" if scheme else ""}//{place}{source}{query.format(int("related" in o))}{more}{start}" frameborder="0"{full}>\n  </iframe>\n'
        else:
            span = f"#t={o.get('start', '')}{',' + o['end'] if 'end' in o else ''}" if "start" in o or "end" in o else ""
            shown = f' poster="{escape(poster)}"' if poster.strip() else ""
            inner = f'  <video src="{source}{escape(span)}"{size}{shown}{preload}{given("autoplay", "muted")}{controls}{given("loop")}>\n  Your browser does not support the video tag.\n  </video>\n'
        role = " " + o["role"] if o.get("role") else ""
        title = f'  <div class="title">{escape(o["title"], quote=False)}</div>\n' if "title" in o else ""
        if "block" not in o:
            return f' <div class="{name}block{role}">\n{title}{inner} </div>\n'
        side = "".join(f" {mark}{o[k]}" for k, mark in (("float", ""), ("align", "text-")) if k in o)
        return f' <div class="{name}block{side}{role}">\n{title} <div class="content">\n{inner} </div>\n </div>\n'

    def span(self, n: Node) -> str:
        text = escape(n.text, quote=False)
        role = f' class="{escape(n.options["role"])}"' if n.options.get("role") else ""
        tag = {"code": "code", "bold": "strong", "italic": "em", "strike": "del", "sub": "sub", "sup": "sup"}.get(n.kind)
        if tag:
            return f"<{tag}>{text}</{tag}>"
        if n.kind == "place":
            return f'<a id="{text}"></a>\n'
        if n.kind == "mark":
            return f"<mark{role}>{text}</mark>"
        if n.kind == "link":
            target = n.options["target"]
            window = ' target="_blank" rel="noopener"' if n.options.get("window") == "_blank" else ""
            return f' <a href="{escape(target)}"{role}{window}>{self.spans(inline(n.text)) if n.text and n.text != target else escape(target, quote=False)}</a>\n'
        if n.kind == "anchor":
            target = n.options["target"]
            return f' <a href="#{escape(target)}">{text or escape(self.titles.get(target, target), quote=False)}</a>\n'
        if n.kind == "attribute":
            name, _, start = n.text.partition(":")
            if name in ("counter", "counter2"):
                key, _, first = start.partition(":")
                shown = self.counters[key] + 1 if key in self.counters else int(first or (0 if name == "counter2" else 1))
                self.counters[key] = shown
                return str(shown)
            return escape(self.attributes.get(n.text, "{" + n.text + "}"), quote=False)
        if n.kind == "macro":
            return self._macro(n)
        return text

    def blocks(self, nodes: list[Node]) -> str:
        return "".join(self.block(n) for n in nodes)

    def _plain(self, nodes: list[Node]) -> str:
        """Content of quotes, notes and sidebars: a single paragraph without its own element."""
        if len(nodes) == 1 and nodes[0].kind == "paragraph":
            return self.spans(nodes[0].children)
        return self.blocks(nodes)

    def paragraph(self, n: Node, role: str) -> str:
        kids = n.children
        if n.options.get("breaks"):
            return f' <div class="paragraph{role}">\n{self.spans(kids).replace(chr(10), "<br>" + chr(10))} </div>\n'
        if len(kids) == 1 and not role and (kids[0].kind in ("link", "anchor") or kids[0].kind == "macro" and kids[0].options["name"] in ("xref", "icon", "menu", "indexterm", "indexterm2")):
            return self.span(kids[0])
        single = len(kids) == 1 and kids[0].kind == "text"
        inner = f"\n{escape(n.text, quote=False)}\n " if single else self.spans(kids)
        return f' <div class="paragraph{role}">\n <p>{inner}</p>\n </div>\n'

    def block(self, n: Node) -> str:
        role = " " + n.options["role"].replace(".", " ") if n.options.get("role") else ""
        kind = n.kind
        if kind == "paragraph":
            return self.paragraph(n, role)
        if kind == "section":
            level = int(n.options["level"])
            anchor = n.options.get("id") or title_anchor(re.sub(r"[`*_#]", "", n.text) if "`" in n.text else n.text, self.attributes)
            return f' <div class="sect{level - 1}{role}" id="{anchor}">\n  <h{level}>{self.spans(inline(n.text))}</h{level}>\n <div class="sectionbody">\n{self.blocks(n.children)} </div>\n </div>\n'
        if kind == "floating-title":
            return f' <h{n.options["level"]} class="discrete">{self.spans(inline(n.text))}</h{n.options["level"]}>\n'
        if kind in ("listing", "literal"):
            lang = n.options.get("language", "")
            body = re.sub(r"&lt;(\d+)&gt;", r'<b class="conum">(\1)</b>', escape(n.text)).replace("&#x27;", "'")
            counted = "linenums" in n.options.get("opts", "") or "linenums" in n.options
            if counted:
                lines = body.split("\n")
                body = "\n".join(f'<span class="linenums">{k}</span>{x}' if k <= len(lines) - (not lines[-1]) else x for k, x in enumerate(lines, 1))
            extra, mark = (' data-linenums="true"', " linenums") if counted else ("", "")
            code = f'<code class="language-{lang} hljs" data-lang="{lang}"{extra}>{body}</code>' if lang else f"<code{extra}>{body}</code>"
            return f' <div class="listingblock{role}">\n <div class="content">\n <pre class="highlightjs highlight{mark}">{code}</pre>\n </div>\n </div>\n'
        if kind in ("ulist", "olist"):
            tag = kind[:2]
            style = n.options.get("style", "")
            style = style if style in ("loweralpha", "upperalpha", "lowerroman", "upperroman") else ""
            letter = {"loweralpha": "a", "upperalpha": "A", "lowerroman": "i", "upperroman": "I"}.get(style)
            if n.children and all("checked" in c.options for c in n.children):
                marks = {"true": "&#10003;", "false": "&#10063;"}
                items = "".join(f"   <li>\n    <p>{marks[c.options['checked']]} {self.spans(c.children[0].children)}</p>\n{self.blocks(c.children[1:])}   </li>\n" for c in n.children)
                return f'  <div class="{kind} checklist{role}">\n  <{tag} class="checklist">\n{items}  </{tag}>\n  </div>\n '
            attrs = f' class="{style}" type="{letter}"' if letter else ""
            items = "".join(f"  <li>\n{self._item(c)}  </li>\n" for c in n.children)
            return f' <div class="{kind}{" " + style if style else ""}{role}">\n <{tag}{attrs}>\n{items} </{tag}>\n </div>\n'
        if kind == "dlist" and n.options.get("style") == "qanda":
            items = "".join(f"   <li>\n    <p><em>{self.spans(inline(c.options.get('term', '')))}</em></p>\n{self._answer(c, '    <p>{}</p>' + chr(10))}   </li>\n" for c in n.children)
            return f' <div class="qlist qanda{role}">\n  <ol>\n{items}  </ol>\n </div>\n'
        if kind == "dlist" and n.options.get("style") == "horizontal":
            items = "".join(f"   <tr>\n    <td class=\"hdlist1\">{self.spans(inline(c.options.get('term', '')))}</td>\n    <td class=\"hdlist2\">\n{self._answer(c, '{}    ')}</td>\n   </tr>\n" for c in n.children)
            return f' <div class="hdlist{role}">\n  <table>\n{items}  </table>\n </div>\n'
        if kind == "dlist":
            return f' <div class="dlist{role}">\n  <dl>\n{"".join(self._term(c) for c in n.children)}  </dl>\n </div>\n'
        if kind == "callouts":
            part = lambda c: f" <span>\n{escape(c.text, quote=False)}\n </span>\n" if c.kind == "text" else self.span(c)
            items = "".join("   <li>\n" + "".join(part(c) if k == 0 or i.children[k - 1].kind == "text" or c.kind != "text" else " " + part(c).lstrip(" ") for k, c in enumerate(i.children)) + "   </li>\n" for i in n.children)
            return f' <div class="colist arabic">\n  <ol>\n{items}  </ol>\n </div>\n'
        if kind == "admonition":
            level = n.options["level"]
            return f' <div class="admonitionblock {level.lower()}{role}">\n  <table>\n    <tbody>\n     <tr>\n      <td class="icon">\n     <div class="title">{level}</div>\n       </td>\n      <td class="content">\n{self._plain(n.children)}    </td>\n   </tr>\n      </tbody>\n  </table>\n </div>\n'
        if kind == "quote":
            by, cited = n.options.get("1"), n.options.get("2")
            cite = f"<br>\n<cite>{escape(cited, quote=False)}</cite>" if cited else ""
            credit = f'  <div class="attribution">\n&#8212; {escape(by, quote=False)}{cite}\n  </div>\n' if by else ""
            css = "" if n.options.get("plain") else f' class="quoteblock{" abstract" if n.options.get("style") == "abstract" else ""}{role}"'
            inner = "".join(self.spans(c.children) if c.kind == "paragraph" else self.block(c) for c in n.children)
            if n.options.get("style") == "verse":
                return f' <div class="verseblock{role}">\n  <pre class="content">\n{inner}  </pre>\n{credit} </div>'
            end = "" if credit or css == "" else "\n"
            return f" <div{css}>\n  <blockquote>\n{inner}  </blockquote>\n{credit} </div>{end}"
        if kind in ("example", "sidebar", "open"):
            return f' <div class="{kind}block{role}">\n  <div class="content">\n{self._plain(n.children)}  </div>\n </div>\n'
        if kind == "stem":
            left, right = ("\\[", "\\]") if n.options["kind"] == "latexmath" else ("\\$", "\\$")
            return f' <div class="stemblock">\n  <div class="content">\n {left}{n.text}{right}   </div>\n </div>\n'
        if kind == "passthrough":
            return "\n" + n.text
        if kind == "table":
            return self._table(n)
        if kind == "rule":
            return " <hr>\n"
        if kind == "macro":
            if n.options["name"] == "image":
                image, target = self._image(n), n.options.get("link")
                if target:
                    flags = re.split(r"[,\s]+", n.options.get("opts", ""))
                    flags += [v for k, v in n.options.items() if k.isdigit() and v in ("nofollow", "noopener")]
                    window = n.options.get("window")
                    rel = [x for x in ("nofollow", "noopener") if x in flags or x == "noopener" and window == "_blank"]
                    image = f'<a href="{escape(target)}"' + (f' target="{escape(window)}"' if window else "") + (f' rel="{" ".join(rel)}"' if rel else "") + f">\n  {image}\n </a>"
                return f' <div class="imageblock{role}">\n <div class="content">\n {image}\n </div>\n </div>\n'
            return self.toc if n.options["name"] == "toc" else self._macro(n)
        return ""

    def _item(self, n: Node) -> str:
        head, rest = (n.children[0], n.children[1:]) if n.children and n.children[0].kind == "paragraph" else (None, n.children)
        if head is None:
            return self.blocks(rest)
        if len(head.children) == 1:
            only = head.children[0]
            return (f" <p>\n{escape(head.text, quote=False)}\n </p>\n" if only.kind == "text" else f" <p>{self.span(only)}</p>") + self.blocks(rest)
        return f' <div class="paragraph">\n <p>{self.spans(head.children)}</p>\n </div>\n' + self.blocks(rest)

    def _answer(self, n: Node, shape: str) -> str:
        """What a term says: a single paragraph's text in the shape, or its blocks."""
        if len(n.children) == 1 and n.children[0].kind == "paragraph":
            return shape.format(self.spans(n.children[0].children))
        return self.blocks(n.children)

    def _term(self, n: Node) -> str:
        term = inline(n.options.get("term", ""))
        name = escape(term[0].text, quote=False) if len(term) == 1 and term[0].kind == "text" else f' <div class="paragraph">\n{self.spans(term)} </div>\n'
        body = n.children
        plain = len(body) == 1 and body[0].kind == "paragraph" and len(body[0].children) == 1 and body[0].children[0].kind == "text"
        return f'    <dt class="hdlist1">{name}</dt>\n    <dd>\n{"<p>" + escape(body[0].text, quote=False) + "</p>" + chr(10) if plain else self.blocks(body)}</dd>\n'

    def _cell(self, tag: str, c: Node, side: str, exact: bool) -> str:
        spans = "".join(f' {k}="{c.options[k]}"' for k in ("colspan", "rowspan") if k in c.options)
        text = escape(c.options.get("raw", c.text) if exact and len(c.text) == len(c.options.get("raw", "").strip()) else c.text, quote=False)
        if tag == "th":
            inner = f"{text}    " if not spans else f" <p>\n{text}\n </p>\n    "
            return f'    <th class="tableblock halign-{side}"{spans}>\n{inner}</th>\n'
        inner = self.spans(c.children) if not spans else f" <p>\n{text}\n </p>\n"
        return f'    <td class="tableblock halign-{side}"{spans}>\n<p class="tableblock">\n{inner}</p>\n    </td>\n'

    def _table(self, n: Node) -> str:
        o, rows = n.options, list(n.children)
        columns = [c.strip() for c in o.get("cols", "").split(",") if c.strip()]
        sides = [{"^": "center", ">": "right"}.get((re.findall(r"[<^>]", c) or ["<"])[0], "left") for c in columns]
        weights = [int((re.findall(r"\d+", c) or ["1"])[0]) for c in columns]
        share = int(100 / max(1, sum(weights)))
        shown = "".join(f'   <col style="width: {w * share}%;">\n' for w in weights)
        auto = "autowidth" in o
        if auto:
            shown = "   <col>\n" * max([len(r.children) for r in rows[:1]] + [0])
        side = lambda k: sides[k] if k < len(sides) else "left"
        line = lambda r, tag: "   <tr>\n" + "".join(self._cell(tag, c, side(k), bool(columns)) for k, c in enumerate(r.children)) + "   </tr>\n"
        head = f"  <thead>\n{line(rows.pop(0), 'th')}  </thead>\n" if o.get("header") == "true" and rows else ""
        body = f"  <tbody>\n{''.join(line(r, 'td') for r in rows)}  </tbody>\n" if rows else ""
        frame = {"topbot": "ends"}.get(o.get("frame", "all"), o.get("frame", "all"))
        classes = f"tableblock frame-{frame} grid-{o.get('grid', 'all')}" + (f" stripes-{o['stripes']}" if "stripes" in o else "") + (" fit-content" if auto else " stretch") + (" " + o["role"] if o.get("role") else "")
        title = f'  <caption class="title">{escape(o["title"], quote=False)}</caption>\n' if "title" in o else ""
        return f' <table class="{classes}">\n{title}  <colgroup>\n{shown}  </colgroup>\n{head}{body} </table>\n'

    def content(self, document: Node) -> str:
        for k, v in document.options.items():
            if k.startswith("attribute:"):
                self.attributes[k[10:]] = v
        self.catalogue(document)
        out = self.blocks(document.children)
        if self.notes:
            notes = "".join(f'  <div class="footnote" id="_footnotedef_{k}">\n   <a href="#_footnoteref_{k}">{k}</a>. {escape(t, quote=False)}\n  </div>\n' for k, t in enumerate(self.notes, 1))
            out += f' <div id="footnotes">\n  <hr>\n{notes} </div>\n'
        return out


def to_html(text: str, attributes: dict[str, str] | None = None, include: Callable[[str], str | None] | None = None, header: bool = True, macros: dict[str, Callable[[Node], str]] | None = None) -> str:
    parser = Parser(include)
    parser.attributes |= attributes or {}
    return Html(attributes, macros).content(parser.document(text, header))


def slides(text: str, attributes: dict[str, str] | None = None) -> str:
    """A deck: a section element for the title and one for each section of the first level, for any presenter that reads these."""
    parser = Parser()
    parser.attributes |= attributes or {}
    document = parser.document(text)
    page = Html(attributes)
    for k, v in document.options.items():
        if k.startswith("attribute:"):
            page.attributes[k[10:]] = v
    page.catalogue(document)
    title = document.options.get("title", "")
    out = [f'<section class="slide cover"><h1>{page.spans(inline(title))}</h1>\n</section>'] if title else []
    loose = [n for n in document.children if n.kind != "section"]
    if any(n.kind != "set-attribute" for n in loose):
        out.append(f'<section class="slide">\n{page.blocks(loose)}</section>')
    for n in document.children:
        if n.kind == "section":
            own = n.options.get("id") or title_anchor(n.text, page.attributes)
            role = " " + n.options["role"] if n.options.get("role") else ""
            out.append(f'<section class="slide{role}" id="{own}"><h2>{page.spans(inline(n.text))}</h2>\n{page.blocks(n.children)}</section>')
    return "\n".join(out)


NODES = "array<struct<path:array<int>,kind:string,text:string,options:map<string,string>>>"


def nodes(docs: DataFrame, key: str, text: str, includes: dict[str, str] | None = None, kinds: Collection[str] | None = None) -> DataFrame:
    """(key, path, kind, text, options) of all nodes, or those of some kinds; includes: a catalogue of known size, by path."""

    @F.pandas_udf(NODES)  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        get = (lambda p: includes.get(p)) if includes is not None else None
        return values.map(lambda t: [{"path": p, "kind": k, "text": x, "options": o} for p, k, x, o in rows_of(Parser(get).document(t or ""), (), kinds)])

    # A small file may hold many documents, and each costs far more than its bytes.
    return spread(docs.select(key, text)).select(key, F.explode(run(F.col(text))).alias("n")).select(key, "n.*")


def html(text: Column, attributes: dict[str, str] | None = None, macros: dict[str, Callable[[Node], str]] | None = None) -> Column:
    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else to_html(t, attributes, macros=macros))

    return run(text)


def decks(text: Column) -> Column:
    """Slides of each text."""

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else slides(t))

    return run(text)


def contents(tree: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """(key, toc): titles of sections up to levels, indented, in document order."""
    at = tree.where((F.col("kind") == "section") & (F.col("options")["level"].cast("int") <= levels + 1))
    line = F.concat(F.repeat(F.lit("  "), F.col("options")["level"].cast("int") - 2), F.lit("* "), "text")
    return at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))).alias("x")).select(key, F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("toc"))


def plain_text(tree: DataFrame, key: str) -> DataFrame:
    """(key, text): the text of inline nodes in document order."""
    at = tree.where(F.col("kind").isin("text", "bold", "italic", "code", "mark", "link", "sub", "sup", "strike"))
    return at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("x")).select(key, F.array_join(F.transform("x", lambda x: x["text"]), "").alias("text"))


def cross_references(tree: DataFrame, key: str) -> DataFrame:
    """(key, path, target, label): labels of references, else the first title with that id, else the target.

    Titles and references go one way together, as tree may have to be parsed for each time it is read.
    """
    anchor = F.coalesce(F.col("options")["id"], F.concat(F.lit("_"), F.regexp_replace(F.replace(F.lower("text"), F.lit(" "), F.lit("_")), r"[^\w]", "")))
    section = F.col("kind") == "section"
    both = tree.where(F.col("kind").isin("section", "anchor")).select(key, "path", "kind", "text", F.when(section, anchor).otherwise(F.col("options")["target"]).alias("target"))
    first = F.min(F.when(section & F.col(key).isNotNull(), F.struct("path", "text"))).over(Window.partitionBy(key, "target"))
    refs = both.withColumn("title", first["text"]).where("kind = 'anchor'")
    return refs.select(key, "path", "target", F.coalesce(F.nullif("text", F.lit("")), "title", "target").alias("label"))
