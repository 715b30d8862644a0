"""Source files split into their top-level definitions.

A file is first masked: comments, strings and character literals become blanks of the same length, so that what follows
sees code only. The mask's brackets give the nesting depth at each line; headers are then found by pattern where the
depth is that of the file (or of an impl block), and a definition ends at the first line that returns to that depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import accumulate


class ParseError(ValueError):
    """A file that can't be split; `kind` is unterminated, unterminated_comment, malformed_header or structural."""

    def __init__(self, kind: str, line: int = 0, detail: str = ""):
        super().__init__(f"{kind.replace('_', ' ')}" + (f" at line {line}" if line else "") + (f": {detail}" if detail else ""))
        self.kind, self.line = kind, line


Chunk = tuple[str, str]  # label, content


def split_lines(source: str) -> list[str]:
    """Lines without their ends, \\n or \\r\\n; nothing after a final end."""
    lines = source.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def disambiguate(chunks: list[Chunk]) -> list[Chunk]:
    """The second, third, … chunk of a label gets #2, #3, …; numbers that would meet another chunk's own label are passed over."""
    taken, seen = {label for label, _ in chunks}, Counter()
    out = []
    for label, content in chunks:
        seen[label] += 1
        name = label
        if seen[label] > 1:
            while (name := f"{label}#{seen[label]}") in taken:
                seen[label] += 1
            taken.add(name)
        out.append((name, content))
    return out


# What may hide code, by language: the opening pattern; the rest is found from there.
_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK = r"//[^\n]*", r"/\*", r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)", r"`"
OPENERS = {
    "proto": re.compile(f"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}", re.S),
    "go": re.compile(f"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|{_BACK}", re.S),
    "rust": re.compile(rf"{_LINE}|{_BLOCK}|\bb?r(#*)\"|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\(?:u\{{[^}}']*\}}|x[0-9a-fA-F]*|.)|[^'\\\n])'", re.S),
}
BRACKETS = {"proto": ("{", "}"), "go": ("{([", "})]"), "rust": ("{([", "})]")}
_COMMENT_EDGE = re.compile(r"/\*|\*/")


class Masked:
    """A source with everything but code blanked out."""

    def __init__(self, source: str, language: str):
        self.lines = split_lines(source)
        text = "\n".join(self.lines)
        code, at, hidden = [], 0, []
        for_comment = language == "rust"
        opener = OPENERS[language]
        while m := opener.search(text, at):
            end = m.end()
            if m[0] == "/*":
                end = self.comment_end(text, m.end(), for_comment)
                if end < 0:
                    raise ParseError("unterminated_comment", text.count("\n", 0, m.start()) + 1)
            elif m[0] == "`" or m.lastindex:
                close = "`" if m[0] == "`" else '"' + m[1]
                found = text.find(close, m.end())
                end = len(text) if found < 0 else found + len(close)
            elif language == "rust" and re.fullmatch(r'b?r"', m[0]):
                found = text.find('"', m.end())
                end = len(text) if found < 0 else found + 1
            code += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
            hidden.append((m.start(), end))
            at = end
        self.code = "".join([*code, text[at:]]).split("\n") if self.lines else []
        starts = [0, *accumulate(len(x) + 1 for x in self.lines)]
        #: Whether a line begins inside something hidden.
        self.inside = [False] * (len(self.lines) + 1)
        line = 0
        for a, b in hidden:
            while line < len(self.lines) and starts[line] <= a:
                line += 1
            k = line
            while k < len(self.lines) and starts[k] < b:
                self.inside[k] = True
                k += 1
            if b >= len(text) and language != "proto" and text[a : a + 1] in "`\"rb" and not self.closed(text[a:b]):
                self.inside[len(self.lines)] = True
        up, down = BRACKETS[language]
        change = [sum(map(c.count, up)) - sum(map(c.count, down)) for c in self.code]
        #: Depth at the start of each line, and after the last.
        self.depth = [0, *accumulate(change)]

    @staticmethod
    def closed(literal: str) -> bool:
        body = literal.lstrip("br")
        quote = body.lstrip("#")[:1]
        return len(body) > 1 and body.rstrip("#").endswith(quote)

    @staticmethod
    def comment_end(text: str, at: int, nests: bool) -> int:
        depth = 1
        while m := _COMMENT_EDGE.search(text, at):
            at = m.end()
            if m[0] == "*/":
                depth -= 1
                if not depth:
                    return at
            elif nests:
                depth += 1
        return -1

    def end_of(self, start: int, depth: int) -> int:
        """The first line from `start` after which the depth is `depth` again and nothing hidden goes on."""
        for i in range(start, len(self.lines)):
            if self.depth[i + 1] < 0:
                raise ParseError("unterminated", start + 1)
            if self.depth[i + 1] == depth and not self.inside[i + 1]:
                return i
        raise ParseError("unterminated", start + 1)

    def text(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first : last + 1])

    def after_comments(self, start: int) -> int:
        """The first of the // lines right above."""
        while start and self.lines[start - 1].lstrip().startswith("//"):
            start -= 1
        return start


def walk(m: Masked, header: Callable[[int], tuple[str, str, int | None] | None]) -> list[Chunk]:
    """Top-level definitions; `header` gives an action, a label and, to end early, a last line."""
    out, i = [], 0
    while i < len(m.lines):
        if m.depth[i] < 0:
            raise ParseError("unterminated", i)
        found = None if m.depth[i] or m.inside[i] else header(i)
        if not found:
            i += 1
            continue
        action, label, _ = found
        last = m.end_of(i, 0)
        if action == "keep":
            out.append((label, m.text(m.after_comments(i), last)))
        i = last + 1
    if m.depth[-1] < 0:
        raise ParseError("unterminated", len(m.lines))
    return disambiguate(out)


_PROTO = re.compile(r"(message|service|enum)\s+(.*)")
_PROTO_SKIP = re.compile(r"(?:option|extend)[\s(]")


def proto(source: str) -> list[Chunk]:
    """Messages, services and enums at column 0, nested ones with their parents."""
    m = Masked(source, "proto")

    def header(i: int):
        if found := _PROTO.match(m.lines[i]):
            name = re.match(r"\w+", found[2].lstrip())
            if not name or name[0][0].isdigit():
                raise ParseError("malformed_header", i + 1, f"{found[1]} without a name")
            return "keep", f"{found[1]} {name[0]}", None
        return ("skip", "", None) if _PROTO_SKIP.match(m.lines[i]) else None

    return walk(m, header)


_GO = re.compile(r"(func|type|const|var)\s+(.*)")
_IDENT = re.compile(r"\s*(\w*)")


def _go_label(m: Masked, i: int) -> tuple[str, str, None] | None:
    found = _GO.match(m.lines[i])
    if not found:
        return None
    keyword, rest = found[1], found[2].lstrip()
    if keyword == "func":
        owner = None
        if rest.startswith("("):
            inside, closed, rest = rest[1:].partition(")")
            words = inside.split()
            owner = words[-1].lstrip("*").partition("[")[0] if words else None
            if not closed:
                rest = ""
        name = _IDENT.match(rest)[1]
        return "keep" if name[:1].isupper() else "skip", f"func {owner}.{name}" if owner else f"func {name}", None
    if rest.startswith("("):
        last = m.end_of(i, 0)
        names = (_IDENT.match(x)[1] for x in [m.code[i].partition("(")[2], *m.code[i + 1 : last + 1]] if not x.lstrip().startswith(")"))
        return "keep", f"{keyword} {next(filter(None, names), 'block')}", None
    name = _IDENT.match(rest)[1]
    return ("keep" if name[:1].isupper() else "skip", f"{keyword} {name}", None) if name else None


def go(source: str) -> list[Chunk]:
    """Exported functions, methods, types, constants and variables; grouped declarations whole."""
    m = Masked(source, "go")
    return walk(m, lambda i: _go_label(m, i))


_VISIBLE = r"pub(?:\s*\([^)]*\))?\s+"
_MODIFIERS = r"(?:(?:default|async|unsafe|extern|const(?=\s+(?:(?:async|unsafe|extern)\s+)*fn\b))\s+)*"
_ITEM = re.compile(rf"\s*{_VISIBLE}{_MODIFIERS}(fn|struct|enum|trait|type|const|mod)\s+(?:r#)?(\w+)")
_METHOD = re.compile(rf"\s*({_VISIBLE})?{_MODIFIERS}fn\s+(?:r#)?(\w+)")
_IMPL = re.compile(r"\s*(?:(?:unsafe|default)\s+)*impl(?=[\s<]|$)")


def impl_target(header: str) -> tuple[str, bool]:
    """(type, whether a trait is implemented) of an impl header up to its brace."""
    rest = header.partition("{")[0][_IMPL.match(header).end() :].lstrip()
    if rest.startswith("<"):
        depths = list(accumulate((c == "<") - (c == ">") for c in rest.replace("->", "  ")))
        rest = rest[depths.index(0) + 1 :] if 0 in depths else rest
    rest = re.split(r"\bwhere\b", rest, maxsplit=1)[0]
    trait, is_trait, target = rest.partition(" for ") if re.search(r"\bfor\b", rest) and " for " in rest else (rest, "", "")
    name = re.match(r"[^\s<{]*", (target if is_trait else trait).strip())[0]
    return name.rpartition("::")[2], bool(is_trait)


def rust(source: str) -> list[Chunk]:
    """Public items, with the attributes and comments above them; methods of impl blocks as Type::method."""
    m, out = Masked(source, "rust"), []
    if any(d < 0 for d in m.depth):
        raise ParseError("unterminated", next(i for i, d in enumerate(m.depth) if d < 0))

    def preamble(i: int, depth: int, floor: int) -> int:
        first = i
        for k in range(i - 1, floor - 1, -1):
            if m.inside[k] or m.depth[k] != depth:
                continue
            if not m.lines[k].lstrip().startswith(("//", "#", "/*")):
                break
            first = k
        return first

    def methods(first: int, depth: int, owner: str, is_trait: bool) -> int:
        """Emits the methods of an impl block from line `first`; returns the line after the block."""
        i = floor = first
        while i < len(m.lines) and m.depth[i] >= depth:
            found = _METHOD.match(m.code[i]) if m.depth[i] == depth and not m.inside[i] else None
            if not found:
                i += 1
                continue
            last = m.end_of(i, depth)
            if is_trait or found[1]:
                out.append((f"{owner}::{found[2]}", m.text(preamble(i, depth, floor), last)))
            i = floor = last + 1
        return i

    i = floor = 0
    while i < len(m.lines):
        if m.depth[i] or m.inside[i]:
            i += 1
            continue
        if _IMPL.match(m.code[i]):
            last = i
            while last < len(m.lines) - 1 and not m.depth[last + 1] and "{" not in m.code[last]:
                last += 1
            if m.depth[last + 1] > 0:
                owner, is_trait = impl_target(" ".join(m.code[i : last + 1]))
                i = methods(last + 1, m.depth[last + 1], owner, is_trait)
            else:
                i = last + 1
            floor = i
            continue
        found = _ITEM.match(m.code[i])
        if not found:
            i += 1
            continue
        first = preamble(i, 0, floor)
        if found[1] == "mod":
            brace = m.code[i].find("{")
            declared = m.lines[i][:brace].rstrip() if brace >= 0 else m.lines[i].rstrip()
            out.append((f"mod {found[2]}", "\n".join([*m.lines[first:i], declared])))
            i += 1
        else:
            last = m.end_of(i, 0)
            out.append((f"{found[1]} {found[2]}", m.text(first, last)))
            i = last + 1
        floor = i
    return disambiguate(out)


def markdown(source: str) -> list[Chunk]:
    """Sections by level-2 headings outside of code fences; an introduction if it says more than the title."""
    lines, fence, heads = split_lines(source), "", []
    for i, line in enumerate(lines):
        t = line.lstrip()
        if t[:3] in ("```", "~~~"):
            fence = t[0] if not fence else "" if fence == t[0] else fence
        elif not fence and t.startswith("## "):
            heads.append((i, t[3:].strip().rstrip("#").strip() or "(section)"))
    intro = lines[: heads[0][0] if heads else len(lines)]
    out = []
    if any(x.strip() and not x.strip().startswith("# ") for x in intro):
        titles = (x.lstrip()[2:].strip().rstrip("#").strip() for x in intro if x.lstrip().startswith("# "))
        out.append((next(titles, "(preamble)"), "\n".join(intro)))
    ends = [i for i, _ in heads[1:]] + [len(lines)]
    out += [(label, "\n".join(lines[i:end])) for (i, label), end in zip(heads, ends)]
    return disambiguate(out)


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def _load_mapping(source: str):
    try:
        import yaml
    except ImportError:  # JSON is the subset that the standard library reads
        import json

        return json.loads(source) if source.strip() else None, lambda node: json.dumps(node, indent=2, ensure_ascii=False)
    return next(iter(yaml.safe_load_all(source)), None), lambda node: yaml.safe_dump(node, sort_keys=False, allow_unicode=True).strip()


def openapi(source: str) -> list[Chunk]:
    """One chunk an operation and a schema, written anew under a comment with the label."""
    try:
        root, dump = _load_mapping(source)
    except Exception as error:  # whatever the YAML reader calls it
        raise ParseError("structural", detail=str(error).replace("\n", " ")) from error
    if not isinstance(root, dict):
        return []

    def entries(node):
        return [(k, v) for k, v in node.items() if isinstance(k, str)] if isinstance(node, dict) else []

    out = [(f"{verb.upper()} {path}", op) for path, verbs in entries(root.get("paths")) for verb, op in entries(verbs) if verb.lower() in METHODS]
    components = root.get("components")
    for group in (components.get("schemas") if isinstance(components, dict) else None, root.get("definitions")):
        out += [(f"schema {name}", node) for name, node in entries(group)]
    return disambiguate([(label, f"# {label}\n{dump(node)}") for label, node in out])


PARSERS = {"proto": proto, "go": go, "rust": rust, "openapi": openapi, "markdown": markdown}
BY_EXTENSION = {"proto": proto, "go": go, "rs": rust}


def select_parser(doc_type: str, language: str, extension: str) -> Callable[[str], list[Chunk]] | None:
    """By language, else by extension; plans, and what neither knows, are taken whole."""
    if doc_type == "plan":
        return None
    return PARSERS.get(language) or BY_EXTENSION.get(extension.lower())
