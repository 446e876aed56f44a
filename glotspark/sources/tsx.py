"""Hard-coded texts in JavaScript and TypeScript sources, with or without JSX.

A scanner turns a file into a tree of tokens: brackets, templates and JSX elements nest, the rest
is flat. The rules for texts need no more grammar than that. Positions count code points.

What is found: JSX text; runs of JSX text and {expressions} as one message; template literals;
string literals outside of + chains; + chains of literals and other operands. Nothing below a
call of intl.get or intl.getHTML is. Variables of a message are named after identifiers and
member expressions, else value<i>. Texts below a skipped call, below t(), in a module's name, a case
label, an object's key or the body of an enum are found but never replaced.

A file that cannot be scanned gives one row with an error and never fails its task.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

SCRIPT = re.compile("[一-龥]")
COLUMNS = "file string, ord long, text string, kind string, start int, end int, line int, vars array<string>, name string, intl_key string, error string"

_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff#@][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"\d[\w.]*|\.\d[\w]*")
_OPERATOR = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[^\s]")
_BLANK = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.S)
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
_BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "default", "instanceof"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
#: What ends an operand of a + chain.
_BREAKS = {",", ";", "=", "=>", "?", ":", "&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "+=", "-=", "-", "|", "&", "^", "...", "||=", "&&=", "??="}
_BREAK_WORDS = _BEFORE_EXPRESSION | {"as", "satisfies", "const", "let", "var", "export", "import", "from", "if", "for", "while", "extends"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Node:
    """kind: name, number, string, template, regex, op, group, jsx, text or slot."""

    kind: str
    value: str
    start: int
    end: int
    kids: list = field(default_factory=list)
    more: list = field(default_factory=list)


def unescape(raw: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code else _ESCAPES.get(m[4], "" if m[4] == "\r\n" else m[4])

    return _ESCAPE.sub(one, raw) if "\\" in raw else raw


class Scanner:
    def __init__(self, source: str, jsx: bool = True):
        self.s, self.i, self.jsx = source, 0, jsx

    def fail(self, what: str) -> ValueError:
        return ValueError(f"{what} at {self.i}")

    def blank(self) -> None:
        if m := _BLANK.match(self.s, self.i):
            self.i = m.end()

    def items(self, closer: str | None) -> list[Node]:
        """Nodes up to the closing bracket, which is taken, or to the end of the file."""
        out: list[Node] = []
        while True:
            self.blank()
            if self.i >= len(self.s):
                if closer:
                    raise self.fail(f"no {closer}")
                return out
            c = self.s[self.i]
            if c == closer:
                self.i += 1
                return out
            out.append(self.node(c, out[-1] if out else None))

    def starts_expression(self, last: Node | None) -> bool:
        if last is None:
            return True
        if last.kind == "name":
            return last.value in _BEFORE_EXPRESSION
        if last.kind == "group":
            return last.value == "{"
        return last.kind == "op" and last.value not in ("++", "--")

    def node(self, c: str, last: Node | None) -> Node:
        s, start = self.s, self.i
        if c in _PAIRS:
            self.i += 1
            kids = self.items(_PAIRS[c])
            return Node("group", c, start, self.i, kids)
        if c in ")]}":
            raise self.fail(f"stray {c}")
        if c in "\"'":
            return self.string(c)
        if c == "`":
            return self.template()
        if c == "<" and self.jsx and self.starts_expression(last) and not _GENERIC.match(s, start) and re.match(r"<(?:[A-Za-z_$]|\s*>)", s[start : start + 50]):
            return self.element()
        if c == "/" and self.starts_expression(last):
            return self.regex()
        if m := _NAME.match(s, start):
            self.i = m.end()
            return Node("name", m[0], start, self.i)
        m = _NUMBER.match(s, start)
        kind = "number" if m else "op"
        m = m or _OPERATOR.match(s, start)
        self.i = m.end()
        return Node(kind, m[0], start, self.i)

    def string(self, quote: str, escapes: bool = True) -> Node:
        start = self.i
        m = re.compile(rf"{quote}((?:[^{quote}\\\n]|\\.)*){quote}" if escapes else rf"{quote}([^{quote}]*){quote}", re.S).match(self.s, start)
        if not m:
            raise self.fail("open string")
        self.i = m.end()
        return Node("string", unescape(m[1]) if escapes else html.unescape(m[1]), start, self.i)

    def template(self) -> Node:
        """kids: the expressions; more: the texts between."""
        start, at, texts, kids = self.i, self.i + 1, [], []
        self.i += 1
        while True:
            if self.i >= len(self.s):
                raise self.fail("open template")
            c = self.s[self.i]
            if c == "\\":
                self.i += 2
            elif c == "`":
                texts.append(unescape(self.s[at : self.i]))
                self.i += 1
                return Node("template", "", start, self.i, kids, texts)
            elif self.s.startswith("${", self.i):
                texts.append(unescape(self.s[at : self.i]))
                self.i += 2
                kids.append(self.items("}"))
                at = self.i
            else:
                self.i += 1

    def regex(self) -> Node:
        start, in_class = self.i, False
        self.i += 1
        while self.i < len(self.s) and self.s[self.i] != "\n":
            c = self.s[self.i]
            self.i += 2 if c == "\\" else 1
            if c in "[]":
                in_class = c == "["
            elif c == "/" and not in_class:
                if m := _NAME.match(self.s, self.i):
                    self.i = m.end()
                return Node("regex", self.s[start : self.i], start, self.i)
        self.i = start + 1
        return Node("op", "/", start, self.i)

    def element(self) -> Node:
        """kids: children (text, slot, jsx); more: attribute values."""
        start = self.i
        self.i += 1
        self.blank()
        name, attributes = "", []
        if m := _JSX_NAME.match(self.s, self.i):
            name, self.i = m[0], m.end()
            self.blank()
            if self.s.startswith("<", self.i):
                depth = 0
                for m in re.compile("[<>]").finditer(self.s, self.i):
                    depth += 1 if m[0] == "<" else -1
                    if not depth:
                        self.i = m.end()
                        break
        while True:
            self.blank()
            if self.s.startswith("/>", self.i):
                self.i += 2
                return Node("jsx", name, start, self.i, [], attributes)
            if self.s.startswith(">", self.i):
                self.i += 1
                return Node("jsx", name, start, self.i, self.children(), attributes)
            if self.s.startswith("{", self.i):
                self.i += 1
                attributes.append(self.items("}"))
            elif m := _JSX_NAME.match(self.s, self.i):
                self.i = m.end()
                self.blank()
                if self.s.startswith("=", self.i):
                    self.i += 1
                    self.blank()
                    c = self.s[self.i : self.i + 1]
                    if c in ("'", '"'):
                        attributes.append([self.string(c, escapes=False)])
                    elif c == "{":
                        self.i += 1
                        attributes.append(self.items("}"))
                    else:
                        attributes.append([self.element()])
            else:
                raise self.fail("not a JSX attribute")

    def children(self) -> list[Node]:
        out: list[Node] = []
        while True:
            m = re.compile("[<{]").search(self.s, self.i)
            if not m:
                raise self.fail("open JSX element")
            if m.start() > self.i:
                out.append(Node("text", html.unescape(self.s[self.i : m.start()]), self.i, m.start()))
            self.i = m.start()
            if self.s.startswith("</", self.i):
                self.i = self.s.index(">", self.i) + 1
                return out
            if m[0] == "<":
                out.append(self.element())
            else:
                start = self.i
                self.i += 1
                out.append(Node("slot", "", start, self.i, self.items("}")))
                out[-1].end = self.i


@dataclass
class Site:
    text: str
    names: list[str]
    places: list[tuple[int, int]]
    start: int
    end: int
    wrap: bool
    getter: tuple[int, str] | None


#: Calls whose arguments stay, where the configuration does not say otherwise.
SKIP = ("console", "require", "import")
#: Calls that translate already.
TRANSLATORS = ("t",)


def has_jsx(nodes: list[Node]) -> bool:
    """Whether an element or a fragment stands anywhere in the tree."""
    return any(n.kind == "jsx" or n.kind == "group" and has_jsx(n.kids) or n.kind == "template" and any(has_jsx(k) for k in n.kids) for n in nodes)


class Extractor:
    def __init__(self, source: str, jsx: bool = True, script: re.Pattern = SCRIPT, skip: tuple[str, ...] = SKIP):
        self.source, self.script, self.skip = source, script, skip
        self.frozen, self.attribute = 0, False
        self.lines = [0] + [m.end() for m in re.finditer("\n", source)]
        self.found: list[tuple] = []
        self.tops: list[tuple] = []
        #: Where a text can be replaced: text, names, operands' places, place, and how (see rewrite).
        self.sites: list[Site] = []
        self.depth = 0
        tree = Scanner(source, jsx).items(None)
        self.has_jsx = has_jsx(tree)
        self.top_level(tree)
        self.walk(tree)

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def emit(self, text: str, kind: str, start: int, end: int, names: list[str] = (), operands: list[list[Node]] = (), wrap: bool = False, prop: Node | None = None) -> None:
        self.found.append((text, kind, start, end, self.line(start), list(names)))
        if not self.frozen:
            places = [(o[0].start, o[-1].end) for o in operands]
            self.sites.append(Site(text, list(names), places, start, end, wrap, (prop.start, prop.value) if prop is not None and not self.depth else None))

    # --- messages

    def variable(self, nodes: list[Node], i: int) -> str:
        """The name of an operand: an identifier, a member expression spelled with underscores, or value<i>."""
        if len(nodes) == 1 and nodes[0].kind == "name":
            return nodes[0].value
        member = len(nodes) > 1 and nodes[0].kind == "name" and nodes[0].value not in _BEFORE_EXPRESSION
        rest = nodes[1:]
        while member and rest:
            if rest[0].kind == "op" and rest[0].value == "." and len(rest) > 1 and rest[1].kind == "name":
                rest = rest[2:]
            elif rest[0].kind == "group" and rest[0].value == "[":
                rest = rest[1:]
            else:
                member = False
        return re.sub("[^a-zA-Z0-9]", "_", re.sub(r"\s", "", self.source[nodes[0].start : nodes[-1].end])) if member else f"value{i}"

    def message(self, texts: list[str], operands: list[list[Node]]) -> tuple[str, list[str]]:
        names = [self.variable(o, i) for i, o in enumerate(operands)]
        return "".join(t + (f"{{{names[i]}}}" if i < len(names) else "") for i, t in enumerate(texts)), names

    def chain(self, operands: list[list[Node]]) -> tuple[str, list[str], list[list[Node]]] | None:
        """The message of a + chain with text in its literals and some operand that is none."""
        texts, others, has_text = [""], [], False
        for o in operands:
            only = o[0] if len(o) == 1 else None
            if only and (only.kind == "string" or only.kind == "template" and not only.kids):
                value = only.value if only.kind == "string" else "".join(only.more)
                texts[-1] += value
                has_text |= bool(self.script.search(value))
            else:
                others.append(o)
                texts.append("")
        return (*self.message(texts, others), others) if others and has_text else None

    def operands(self, nodes: list[Node]) -> list[list[Node]] | None:
        """The operands, if nodes are one + chain; brackets around inner chains count for nothing."""
        out: list[list[Node]] = [[]]
        for n in nodes:
            if n.kind == "op" and n.value == "+" and out[-1]:
                out.append([])
            elif n.kind == "op" and n.value in _BREAKS or n.kind == "name" and n.value in _BREAK_WORDS:
                return None
            else:
                out[-1].append(n)
        if len(out) < 2 or not all(out):
            return None
        flat: list[list[Node]] = []
        for o in out:
            inner = self.operands(o[0].kids) if len(o) == 1 and o[0].kind == "group" and o[0].value == "(" else None
            flat += inner or [o]
        return flat

    # --- the walk

    def walk(self, nodes: list[Node], intl: bool = False, plus: bool = False) -> None:
        part: list[tuple[int, Node]] = []
        body = False  # of an arrow function, without braces
        for i, n in enumerate([*nodes, None]):
            stop = n is None or n.kind == "op" and n.value in _BREAKS or n.kind == "name" and n.value in _BREAK_WORDS
            if not stop:
                part.append((i, n))
                continue
            own = [x for _, x in part]
            found = self.operands(own)
            if found and not intl and not plus and (m := self.chain(found)):
                self.emit(m[0], "binary", own[0].start, own[-1].end, m[1], m[2], prop=self.property_key(nodes, part[0][0]))
            for j, x in part:
                self.visit(nodes, j, x, intl, plus or bool(found))
            part = []
            if body and (n is None or n.value in (",", ";", "const", "let", "var", "export", "import")):
                self.depth, body = self.depth - 1, False
            if n is not None and n.value == "=>" and not body and nodes[i + 1 : i + 2] and nodes[i + 1].value != "{":
                self.depth, body = self.depth + 1, True

    def visit(self, nodes: list[Node], i: int, n: Node, intl: bool, plus: bool) -> None:
        if n.kind == "string":
            if not intl and not plus and self.script.search(n.value):
                key = nodes[i + 1 : i + 2] and nodes[i + 1].value == ":" and (i == 0 or nodes[i - 1].value == ",")
                self.frozen += (fixed := bool(key) or i > 0 and nodes[i - 1].kind == "name" and nodes[i - 1].value in ("from", "import", "case"))
                self.emit(n.value, "string", n.start, n.end, wrap=self.attribute, prop=self.property_key(nodes, i))
                self.frozen -= fixed
        elif n.kind == "template":
            text, names = self.message(n.more, n.kids)
            if not intl and self.script.search(text):
                self.emit(text, "template", n.start, n.end, names, n.kids, prop=self.property_key(nodes, i))
            for k in n.kids:
                self.walk(k, intl, plus)
        elif n.kind == "group":
            called = n.value == "(" and i > 0 and (nodes[i - 1].kind == "name" and nodes[i - 1].value not in (_BREAK_WORDS - {"import"}) | {"function", "catch", "switch"} or nodes[i - 1].kind == "group" and nodes[i - 1].value != "{")
            members = n.value == "{" and i > 1 and (nodes[i - 2].kind, nodes[i - 2].value) == ("name", "enum")
            still, code = members or called and self.skipped(self.callee(nodes, i)), n.value == "{" and i > 0 and (nodes[i - 1].value == "=>" or nodes[i - 1].kind == "group")
            self.frozen += still
            self.depth += code
            self.walk(n.kids, intl or n.value == "(" and self.intl_call(nodes, i), plus and n.value != "{")
            self.frozen -= still
            self.depth -= code
        elif n.kind == "jsx":
            self.jsx(n, intl, plus)

    def callee(self, nodes: list[Node], i: int) -> str | None:
        """a for a(, a.b for a.b(, c for what goes on before .c(; None where no name is called."""
        if nodes[i - 1].kind != "name":
            return None
        if i < 3 or nodes[i - 2].value not in (".", "?."):
            return nodes[i - 1].value
        simple = nodes[i - 3].kind == "name" and (i < 4 or nodes[i - 4].value not in (".", "?."))
        return f"{nodes[i - 3].value}.{nodes[i - 1].value}" if simple else nodes[i - 1].value

    def skipped(self, name: str | None) -> bool:
        return name is None or name in TRANSLATORS or any(name == s or "." not in s and name.startswith(s + ".") for s in self.skip)

    def property_key(self, nodes: list[Node], i: int) -> Node | None:
        """The key of the object property whose value begins here; None elsewhere and for computed keys."""
        if i >= 2 and nodes[i - 1].value == ":" and nodes[i - 1].kind == "op" and nodes[i - 2].kind in ("name", "string") and (i == 2 or nodes[i - 3].value == ","):
            return nodes[i - 2]
        return None

    def intl_call(self, nodes: list[Node], i: int) -> bool:
        before = [(x.kind, x.value) for x in nodes[max(0, i - 3) : i]]
        return len(before) == 3 and before[0] == ("name", "intl") and before[1][1] in (".", "?.") and before[2][1] in ("get", "getHTML")

    def jsx(self, n: Node, intl: bool, plus: bool) -> None:
        for a in n.more:
            self.attribute = len(a) == 1 and a[0].kind == "string" and self.source[a[0].start - 1] == "="
            self.walk(a, intl, plus)
            self.attribute = False
        kids, i = n.kids, 0
        while i < len(kids):
            run = i
            while run < len(kids) and (kids[run].kind == "text" or kids[run].kind == "slot" and kids[run].kids):
                run += 1
            group = kids[i:run]
            plain = [re.sub(r"\r?\n\s*", "", k.value) if k.kind == "text" else None for k in group]
            if any(p is None for p in plain) and any(p and self.script.search(p) for p in plain):
                texts, slots = [""], []
                for k, p in zip(group, plain, strict=True):
                    if p is None:
                        slots.append(k.kids)
                        texts.append("")
                    else:
                        texts[-1] += p
                text, names = self.message(texts, slots)
                if not intl:
                    self.emit(text, "template", group[0].start, group[-1].end, names, slots, wrap=True)
                for s in slots:
                    self.walk(s, intl, plus)
                i = run
                continue
            k = kids[i]
            if k.kind == "text":
                if not intl and self.script.search(k.value):
                    lead = len(k.value) - len(k.value.lstrip())
                    tail = len(k.value) - len(k.value.rstrip())
                    plain = k.end - k.start == len(k.value)
                    self.emit(k.value.strip(), "jsx-text", k.start, k.end, wrap=True)
                    if plain and self.sites and self.sites[-1].start == k.start:
                        self.sites[-1].start, self.sites[-1].end = k.start + lead, k.end - tail
            elif k.kind == "jsx":
                self.jsx(k, intl, plus)
            else:
                self.walk(k.kids, intl, plus)
            i += 1

    def ends(self, tree: list[Node], j: int, at: int) -> bool:
        """Whether a declaration's value, which begins behind at, ends before node j: by a sign, a word, or a line's end."""
        n, last = tree[j], tree[j - 1]
        if n.kind == "op":
            return n.value in (";", ",")
        if n.kind == "name" and n.value in ("const", "let", "var", "export", "function", "class", "as"):
            return True
        return j > at + 1 and last.kind != "op" and n.kind not in ("group", "template") and self.line(n.start) > self.line(last.end)

    def top_level(self, tree: list[Node]) -> None:
        """Module-level constants whose whole value is a text, or an intl call."""
        for i, n in enumerate(tree):
            if not (n.kind == "name" and n.value in ("const", "let", "var") and i + 1 < len(tree) and tree[i + 1].kind == "name"):
                continue
            at = next((j for j in range(i + 2, min(i + 40, len(tree))) if tree[j].kind == "op" and tree[j].value in ("=", ";")), None)
            if at is None or tree[at].value != "=":
                continue
            end = next((j for j in range(at + 1, len(tree)) if self.ends(tree, j, at)), len(tree))
            value, name = tree[at + 1 : end], tree[i + 1]
            key, text = None, None
            if len(value) == 4 and value[3].kind == "group" and self.intl_call(value, 3):
                key = value[3].kids[0].value if value[3].kids and value[3].kids[0].kind == "string" else None
            elif len(value) == 1 and value[0].kind == "string" and self.script.search(value[0].value):
                text = value[0].value
            elif len(value) == 1 and value[0].kind == "template" and self.script.search(m := self.message(value[0].more, value[0].kids)[0]):
                text = m
            elif (o := self.operands(value)) and (c := self.chain(o)):
                text = c[0]
            else:
                continue
            self.tops.append((text, name.start, name.end, self.line(name.start), name.value, key))


def extract(source: str, jsx: bool = True, script: re.Pattern = SCRIPT) -> tuple[list[tuple], list[tuple]]:
    """(text, kind, start, end, line, vars) of each text in order, and (text, start, end, line, name, key) of module-level constants."""
    e = Extractor(source, jsx, script)
    return sorted(e.found, key=lambda x: (x[2], x[3])), e.tops


def rewrite(source: str, key_of: dict[str, str], jsx: bool = True, module: str = "react-intl-universal", skip: tuple[str, ...] = SKIP) -> tuple[str, int, int]:
    """The source with each text that has a key replaced by a call of intl.get, how many were, and how many became getters.

    Arguments of skipped calls, object keys, module names and case labels stay. A JSX text or
    attribute gets braces; a property of a module-level object becomes a getter, so that it is read
    late. The import is added where the source has none. Running it again changes nothing.
    """
    e = Extractor(source, jsx, skip=skip)
    sites = sorted((x for x in e.sites if x.text in key_of), key=lambda x: (x.start, -x.end))

    def call(x: Site) -> str:
        said = []
        for name, (a, b) in zip(x.names, x.places, strict=True):
            expression = part(a, b)
            said.append(name if expression == name else f"{name}: {expression}")
        quoted = key_of[x.text].replace("\\", "\\\\").replace("'", "\\'")
        return f"intl.get('{quoted}'" + (", { " + ", ".join(dict.fromkeys(said)) + " }" if said else "") + ")"

    def part(a: int, b: int) -> str:
        """What stands from a to b, with the outermost sites in it replaced, and those inside their operands."""
        out, at = [], a
        for x in sites:
            if x.start < at or x.end > b or x.start < a:
                continue
            begin, new = x.start, call(x)
            if x.getter and x.getter[0] >= at:
                begin, name = x.getter[0], source[x.getter[0] : source.index(":", x.getter[0])].strip()
                new = f"get {name}() {{ return {new} }}"
            elif x.wrap:
                new = f"{{{new}}}"
            out += [source[at:begin], new]
            at = x.end
        return "".join([*out, source[at:b]])

    if not sites:
        return source, 0, 0
    new = part(0, len(source))
    if not re.search(rf"^\s*import\s+(?:\*\s+as\s+)?intl\b", source, re.M) and not re.search(r"\b(?:const|let|var)\s+intl\b", source):
        if m := re.search(rf"^\s*import\s+(\w+)[^;\n]*from\s+['\"]{re.escape(module)}['\"];?[^\n]*\n", new, re.M):
            new = new[: m.end()] + f"const intl = {m[1]};\n" + new[m.end() :]
        else:
            new = f"import intl from '{module}';\n" + new
    return new, len(sites), sum(x.getter is not None for x in sites)


def may_hold_jsx(file: str | None) -> bool:
    """All sources but plain TypeScript, where < also begins a cast."""
    return not re.search(r"(?<!\.d)\.ts\Z", file or "")


def rewritten(files: DataFrame, keys: DataFrame, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """files (file, content) with code, n_replaced and n_getters; keys (file, text, key) as with_keys() gives them.

    Each file meets only its own keys, gathered by file; nothing is written back to the sources.
    """
    from pyspark.sql import functions as F

    own = keys.groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("text", "key"))).alias("keys"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for f, c, k in zip(frame["file"], frame["content"], frame["keys"], strict=True):
                try:
                    out.append((f, *rewrite(c, dict(k or {}), jsx=may_hold_jsx(f), skip=tuple(skip)), None))
                except Exception as e:
                    out.append((f, c, 0, 0, str(e)[:500]))
            yield pd.DataFrame(out, columns=["file", "code", "n_replaced", "n_getters", "error"])

    return files.join(own, "file", "left").select("file", "content", "keys").mapInPandas(run, "file string, code string, n_replaced long, n_getters long, error string")


def facts(files: DataFrame, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """file, has_jsx, file_type, is_data, extracted, data_constants, skipped, error: a row for each of files (file, content).

    A data file that holds JSX counts as a component's. extracted are the texts, skipped those of
    them that are never replaced, data_constants the properties of module-level objects that become
    getters. A file that cannot be scanned has nulls and an error.
    """
    from pyspark.sql import functions as F

    from glotspark.functions import paths

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for f, c in zip(frame["file"], frame["content"], strict=True):
                try:
                    e = Extractor(c or "", may_hold_jsx(f), skip=tuple(skip))
                    out.append((f, e.has_jsx, len(e.found), sum(x.getter is not None for x in e.sites), len(e.found) - len(e.sites), None))
                except Exception as error:
                    out.append((f, None, None, None, None, str(error)[:500]))
            table = pd.DataFrame(out, columns=["file", "has_jsx", "extracted", "data_constants", "skipped", "error"])
            yield table.astype({"has_jsx": "boolean"} | {c: "Int64" for c in ("extracted", "data_constants", "skipped")})

    rows = files.select("file", "content").mapInPandas(run, "file string, has_jsx boolean, extracted long, data_constants long, skipped long, error string")
    path = F.col("file")
    return rows.select("file", "has_jsx", paths.file_type(path).alias("file_type"), (paths.data_config_file(path) & ~F.coalesce("has_jsx", F.lit(False))).alias("is_data"), "extracted", "data_constants", "skipped", "error")


def rows_of(file: str, content: str | None) -> list[tuple]:
    try:
        found, tops = extract(content or "", jsx=may_hold_jsx(file))
    except Exception as e:
        return [(file, 0, None, "error", None, None, None, None, None, None, str(e)[:500])]
    out = [(file, i, t, kind, a, b, line, names, None, None, None) for i, (t, kind, a, b, line, names) in enumerate(found)]
    return out + [(file, i, t, "top-level", a, b, line, None, name, key, None) for i, (t, a, b, line, name, key) in enumerate(tops)]


def occurrences(files: DataFrame) -> DataFrame:
    """files (file, content) to rows of COLUMNS; kind tells texts, top-level constants and errors apart."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [r for f, c in zip(frame["file"], frame["content"], strict=True) for r in rows_of(f, c)]
            table = pd.DataFrame(out, columns=names)
            yield table.astype({c: "Int64" for c in ("ord", "start", "end", "line")})

    return files.select("file", "content").mapInPandas(run, COLUMNS)
