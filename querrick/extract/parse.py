"""Definitions, token facts and references of a source text.

Python is read by its own parser. Other languages are read by patterns over
masked code and matching of braces, which is less than a grammar and enough for
definitions, calls and imports as they are usually written.
"""

from __future__ import annotations

import ast
import bisect
import keyword
import re
from dataclasses import dataclass, field

from ..fixed import MAX_CALL_CHARS, MAX_LITERAL_CHARS
from .lexer import Masked, closing, mask

IDENT = r"[A-Za-z_$¡-￿][A-Za-z0-9_$¡-￿]*"
WORD = re.compile(IDENT)
CALL = re.compile(rf"({IDENT}(?:\s*(?:\?\.|\.|::|->)\s*{IDENT})*)\s*(?:<[\w\s,<>\[\]]*>)?!?\(")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
SYMBOLISH = re.compile(r"[A-Z][A-Za-z0-9]+|[A-Z][A-Z0-9_]+")
OWN = ("this", "self", "super", "cls", "Self", "base", "parent")
KEYWORDS = frozenset("if for while switch catch return new function async await typeof elif else do try throw match when guard in not and or yield assert with lambda def class fn func fun import from foreach using lock sizeof nameof require_once include_once require include echo".split())
#: Words that are no identifiers, by language.
RESERVED = {
    "python": frozenset(keyword.kwlist),
    "typescript": frozenset("abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface keyof let namespace never new null number object of private protected public readonly return set static string super switch symbol this throw true try type typeof undefined unknown var void while with yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough false for func go goto if import interface iota map nil package range return select struct switch true type var".split()),
    "rust": frozenset("as async await bool break char const continue crate dyn else enum extern f32 f64 false fn for i16 i32 i64 i8 if impl in isize let loop match mod move mut pub ref return self static str struct super trait true type u16 u32 u64 u8 unsafe use usize where while".split()),
    "java": frozenset("abstract assert boolean break byte case catch char class continue default do double else enum extends false final finally float for if implements import instanceof int interface long native new null package private protected public record return short static super switch synchronized this throw throws transient true try void volatile while".split()),
    "csharp": frozenset("abstract as async await base bool break byte case catch char class const continue decimal default do double else enum extern false finally float for foreach get if in int interface internal is lock long namespace new null object out override params private protected public readonly record ref return sbyte sealed set short static string struct switch this throw true try typeof uint ulong unsafe using var virtual void while yield".split()),
    "kotlin": frozenset("abstract as break by catch class companion continue data do else enum false final finally for fun if import in inline inner interface internal is lateinit null object open override package private protected public return sealed super suspend this throw true try val var when while".split()),
    "swift": frozenset("as break case catch class continue default defer do else enum extension fallthrough false fileprivate final for func guard if import in init inout internal is let mutating nil open override private protocol public repeat rethrows return self static struct subscript super switch throw throws true try var where while".split()),
    "php": frozenset("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty extends false final finally fn for foreach function global if implements include instanceof interface isset list match namespace new null or print private protected public readonly require return static switch throw trait true try unset use var while yield".split()),
}
#: What stands before a name that is declared, not called.
DECLARED = re.compile(r"(?:\b(?:function|fn|func|fun|def|class)\s*\*?|\bfunc\s*\([^()]*\)|\b(?:public|private|protected|internal|fileprivate))\s+\Z")


@dataclass
class Definition:
    """A class, method or function; places are code points, lines count from 1."""

    kind: str
    name: str
    owner: str | None
    start: int
    end: int
    name_at: int
    body: int
    start_line: int = 0
    end_line: int = 0
    signature: str | None = None
    docstring: str | None = None
    exported: bool = False
    decorators: list[str] = field(default_factory=list)
    statements: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Ref:
    kind: str
    start: int
    end: int
    texts: list[str]
    module: str | None = None
    imported: str | None = None


@dataclass
class Parsed:
    definitions: list[Definition]
    refs: list[Ref]
    masked: Masked
    language: str
    failed: bool = False


class Lines:
    """From places to lines."""

    def __init__(self, text: str) -> None:
        self.starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]

    def of(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)


def parts_of(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


def unique(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))


# Python --------------------------------------------------------------------------------------------------------


def _python(text: str) -> Parsed:
    masked = mask(text, "python")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Parsed([], [], masked, "python", failed=True)
    lines, starts = text.split("\n"), Lines(text).starts

    def place(row: int, col: int) -> int:
        line = lines[row - 1]
        return starts[row - 1] + (col if line.isascii() else len(line.encode()[:col].decode(errors="ignore")))

    found: list[Definition] = []

    def visit(body: list[ast.stmt], owner: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(node, ast.ClassDef)
                at = place(node.lineno, node.col_offset)
                name_at = text.index(node.name, at + (6 if is_class else 4))
                end = place(node.end_lineno, node.end_col_offset)
                d = Definition("class" if is_class else "method" if owner else "function", node.name, None if is_class else owner, at, end, name_at, place(node.body[0].lineno, node.body[0].col_offset))
                d.start_line, d.end_line = node.lineno, node.end_lineno
                d.docstring = ast.get_docstring(node)
                d.exported = not node.name.startswith("_")
                d.decorators = [ast.unparse(x.func if isinstance(x, ast.Call) else x) for x in node.decorator_list]
                head = []
                for line in lines[node.lineno - 1 : node.lineno + 9]:
                    head.append(line)
                    if ":" in line:
                        break
                else:
                    head = head[:1]
                d.signature = "\n".join(head).strip()
                d.statements = [(s.lineno, s.end_lineno) for s in node.body]
                found.append(d)
                if is_class:
                    visit(node.body, node.name)
            else:
                for block in ("body", "orelse", "finalbody", "handlers"):
                    for inner in getattr(node, block, []) if isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While, ast.AsyncWith, ast.AsyncFor)) else []:
                        visit([inner] if isinstance(inner, ast.stmt) else inner.body, owner)

    visit(tree.body, None)
    refs: list[Ref] = []
    imported: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            module = None if isinstance(node, ast.Import) else "." * node.level + (node.module or "")
            for alias in node.names:
                local = alias.asname or (alias.name.split(".")[0] if module is None else alias.name)
                imported.add(local)
                at, end = place(alias.lineno, alias.col_offset), place(alias.end_lineno, alias.end_col_offset)
                refs.append(Ref("import", at, end, unique([local, alias.name.split(".")[-1]]), module if module is not None else alias.name, alias.name if module is not None else None))
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            chain = _chain(node.func)
            if chain:
                end = place(node.func.end_lineno, node.func.end_col_offset)
                refs.append(Ref("call", end - len(chain[-1]), end, called(chain, imported)))
        elif isinstance(node, ast.Name) and len(node.id) > 1 and SYMBOLISH.fullmatch(node.id):
            at = place(node.lineno, node.col_offset)
            refs.append(Ref("identifier", at, at + len(node.id), [node.id]))
    return Parsed(found, refs, masked, "python")


def _chain(node: ast.expr) -> list[str]:
    """Names of a dotted expression; of one that starts with something else, the names after it."""
    out: list[str] = []
    while isinstance(node, ast.Attribute):
        out.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        out.append(node.id)
    return out[::-1]


def called(chain: list[str], imported: set[str]) -> list[str]:
    """Tokens of a call: its name, and that with its receiver if the receiver is a path, imported or looks like a type."""
    base = chain[-1]
    if len(chain) < 2 or chain[-2] in OWN:
        return [base]
    receiver = chain[-2]
    return [base, f"{receiver}.{base}"] if len(chain) > 2 or receiver in imported or SYMBOLISH.fullmatch(receiver) else [base]


# Languages with braces -----------------------------------------------------------------------------------------

MODIFIERS = {
    "java": r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed|strictfp)\s+)*+",
    "csharp": r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|readonly|unsafe|extern|new)\s+)*+",
    "kotlin": r"(?:(?:public|private|protected|internal|open|abstract|sealed|data|inline|suspend|override|final|inner|enum|companion|operator|infix|tailrec|value|annotation)\s+)*",
    "swift": r"(?:(?:public|private|fileprivate|internal|open|static|final|class|override|mutating|convenience|required|indirect)\s+)*",
    "php": r"(?:(?:public|private|protected|static|final|abstract|readonly)\s+)*",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*",
    "go": "",
    "typescript": r"(?:(?:export|default|declare|abstract|async)\s+)*",
}
TYPE = r"[\w$.<>\[\],?\s:&|*]+?"
#: (classes, functions outside of classes, methods inside of them): patterns with a group ``name``.
HEADS = {
    "java": (rf"{MODIFIERS['java']}(?:class|interface|enum|record)\s+(?P<name>{IDENT})", None, rf"{MODIFIERS['java']}(?:<[^>]*>\s*)?(?!return\b|new\b|throw\b|else\b){TYPE}\s+(?P<name>{IDENT})\s*\([^;{{}}]*\)[^;{{}}=]*(?=[{{;])"),
    "csharp": (rf"{MODIFIERS['csharp']}(?:class|interface|struct|enum|record)\s+(?P<name>{IDENT})", None, rf"{MODIFIERS['csharp']}(?!return\b|new\b|throw\b|else\b|await\b|class\b|namespace\b){TYPE}\s+(?P<name>{IDENT})\s*(?:<[^>]*>)?\([^;{{}}]*\)[^;{{}}=]*(?=[{{;]|=>)"),
    "kotlin": (rf"{MODIFIERS['kotlin']}(?:class|interface|object)\s+(?P<name>{IDENT})", *2 * (rf"{MODIFIERS['kotlin']}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?(?P<name>{IDENT})\s*\(",)),
    "swift": (rf"{MODIFIERS['swift']}(?:class|struct|protocol|enum|actor)\s+(?!func\b|var\b|let\b)(?P<name>{IDENT})", *2 * (rf"{MODIFIERS['swift']}func\s+(?P<name>{IDENT})\s*(?:<[^>]*>)?\(",)),
    "php": (rf"{MODIFIERS['php']}(?:class|interface|trait|enum)\s+(?P<name>{IDENT})", *2 * (rf"{MODIFIERS['php']}function\s+&?(?P<name>{IDENT})\s*\(",)),
    "rust": (rf"{MODIFIERS['rust']}(?:(?:struct|enum|trait)\s+(?P<name>{IDENT})|impl(?:<[^>{{]*>)?\s+(?:[\w:<>&' ,]+\s+for\s+)?(?P<impl>{IDENT}))", *2 * (rf"{MODIFIERS['rust']}fn\s+(?P<name>{IDENT})\s*[<(]",)),
    "go": (rf"type\s+(?P<name>{IDENT})\s+(?:struct|interface)\b", rf"func\s+(?P<name>{IDENT})\s*[\[(]", None),
    "typescript": (
        rf"{MODIFIERS['typescript']}class\s+(?P<name>{IDENT})",
        rf"{MODIFIERS['typescript']}(?:function\s*\*?\s*(?P<name>{IDENT})\s*[<(]|(?:const|let|var)\s+(?P<arrow>{IDENT})\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:function\b|(?:<[^>]*>\s*)?\([^;{{}}]*?\)\s*(?::[^=;{{]+)?=>|{IDENT}\s*=>))",
        rf"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?(?P<name>#?{IDENT})\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?::[^={{;]+)?(?={{)",
    ),
}
HEADS |= {"javascript": HEADS["typescript"], "tsx": HEADS["typescript"]}
FLAVOUR = {"javascript": "typescript", "tsx": "typescript"}


def _braces(text: str, language: str) -> Parsed:
    masked = mask(text, language)
    code, lines = masked.code, Lines(text)
    failed = code.count("{") != code.count("}")
    classes, functions, methods = (re.compile(rf"(?:(?<=[\n;{{}}])|^)[ \t]*(?P<head>(?=\S)(?:{p}))") if p else None for p in HEADS[language])
    found: list[Definition] = []

    def add(m: re.Match, kind: str, owner: str | None, limit: int) -> Definition | None:
        group = next(g for g in m.re.groupindex if g != "head" and m[g])
        name = m[group]
        if name in KEYWORDS and not (language == "rust" and name == "new"):
            return None
        after = _past_parameters(code, m.end() - 1, limit) if kind != "class" and group == "name" and code[m.end() - 1] in "([<" else m.end()
        body, end = code.find("{", after), code.find(";", after)
        while language == "go" and kind != "class" and body > 0 and re.search(r"\b(?:interface|struct)\s*\Z", code[max(0, body - 12) : body]):
            body = code.find("{", closing(code, body))
        arrow = code.find("=>", m.start(), body if body > 0 else limit) if group == "arrow" or language == "csharp" else -1
        if kind != "class" and language == "kotlin":
            line = code.find("\n", m.end())
            if (eq := code.find("=", m.end(), line if line > 0 else limit)) >= 0 and (body < 0 or eq < body):
                body = -1
        if body < 0 or (0 <= end < body and not (kind == "class" and language == "rust" and end > body)):
            stop = end if end >= 0 and (arrow >= 0 or language != "kotlin") else code.find("\n", m.end())
            stop = limit - 1 if stop < 0 else stop
            body = stop
        elif arrow >= 0 and code[arrow + 2 : body].strip():
            stop = end if end >= 0 else code.find("\n", arrow)
            if stop > body:
                stop = max(stop, closing(code, body))
        else:
            stop = closing(code, body)
        if stop >= limit:
            stop = limit - 1
        d = Definition(kind, name, owner, m.start("head"), stop + 1, m.start(group), body)
        d.start_line, d.end_line = lines.of(d.start), lines.of(stop)
        _describe(d, text, masked, lines, language)
        if kind != "class":
            d.statements = _statements(code, body, stop, lines)
        found.append(d)
        return d

    def walk(start: int, end: int, owner: str | None) -> None:
        at = start
        while at < end:
            hits = [(m.start("head"), n, m) for n, p in ((0, classes), (1, methods if owner else functions)) if p and (m := p.search(code, at, end))]
            if not hits:
                return
            _, n, m = min(hits, key=lambda h: h[:2])
            d = add(m, "class" if n == 0 else "method" if owner else "function", None if n == 0 else owner, end)
            if d is None:
                at = m.start("head") + 1
            elif n == 0:
                if code[d.body : d.body + 1] == "{":
                    walk(d.body + 1, d.end - 1, d.name)
                at = max(d.end, at + 1)
            else:
                at = max(d.end, m.end())

    walk(0, len(code), None)
    return Parsed(found, _refs(text, masked, language, found), masked, language, failed and not found)


def _past_parameters(code: str, at: int, limit: int) -> int:
    """The place after the parameter list that starts at or after ``at``."""
    depth = 0
    for i in range(code.find("(", at) if "(" in code[at:limit] else at, limit):
        depth += (code[i] == "(") - (code[i] == ")")
        if not depth:
            return i + 1
    return at


def _statements(code: str, body: int, end: int, lines: Lines) -> list[tuple[int, int]]:
    """First and last lines of the statements at the top of a body."""
    out, depth, at = [], 0, None
    for i in range(body + 1, end):
        c = code[i]
        if at is None and not c.isspace():
            at = i
        depth += (c in "({[") - (c in ")}]")
        if at is not None and depth == 0 and (c in ";}" or (c == "\n" and code[at:i].strip())):
            out.append((lines.of(at), lines.of(i if c != "\n" else i - 1)))
            at = None
    if at is not None:
        out.append((lines.of(at), lines.of(end - 1)))
    return out


DECORATOR = {
    "java": re.compile(r"^\s*@([\w.]+)"), "kotlin": re.compile(r"^\s*@([\w.:]+)"), "typescript": re.compile(r"^\s*@([\w.$]+)"), "swift": re.compile(r"^\s*@([\w.]+)"),
    "dart": re.compile(r"^\s*@([\w.]+)"), "rust": re.compile(r"^\s*#\[\s*([\w:]+)"), "csharp": re.compile(r"^\s*\[\s*([\w.]+)"), "php": re.compile(r"^\s*#\[\s*([\w\\]+)"),
}
INLINE_DECORATOR = re.compile(r"@([\w.$:]+)(?:\([^)]*\))?\s+")


def _describe(d: Definition, text: str, masked: Masked, lines: Lines, language: str) -> None:
    """Signature, docstring, decorators and whether it is exported."""
    flavour = FLAVOUR.get(language, language)
    rows = text.split("\n")
    if flavour == "typescript":
        # one line, up to its brace or with its arrow
        first = rows[d.start_line - 1]
        d.signature = (first.partition("{")[0] if "{" in first else "".join(first.partition("=>")[:2])).strip()
    else:
        head = []
        for row in filter(None, rows[d.start_line - 1 : d.start_line + 9]):
            before, brace, _ = row.partition("{")
            head.append(before.strip() if brace else row)
            if brace:
                break
        d.signature = "\n".join(head).strip() or None
    pattern, at = DECORATOR.get(flavour), d.start_line - 2
    if pattern:
        d.decorators += INLINE_DECORATOR.findall(rows[d.start_line - 1][: d.start - lines.starts[d.start_line - 1]])
    doc: list[str] = []
    while at >= 0:
        row = rows[at].strip()
        if pattern and (m := pattern.match(rows[at])) and not row.startswith("//"):
            d.decorators.insert(0, m[1])
        elif row.endswith("*/"):
            top = at
            while top > 0 and "/*" not in rows[top]:
                top -= 1
            doc = [re.sub(r"^\s*/?\*+/?|\*/\s*$", "", x).strip() for x in rows[top : at + 1]] + doc
            at = top
        elif row.startswith("//"):
            doc.insert(0, row.lstrip("/!").strip())
        elif not row or not doc:
            break
        else:
            break
        at -= 1
    d.docstring = "\n".join(x for x in doc if x).strip() or None
    line = " ".join(rows[d.start_line - 1 : lines.of(d.name_at)])
    words = set(re.findall(r"\w+", line))
    d.exported = {
        "go": d.name[:1].isupper(), "rust": "pub" in words, "java": "public" in words, "csharp": "public" in words, "swift": bool({"public", "open"} & words),
        "kotlin": not {"private", "internal", "protected"} & words, "php": "public" in words or not {"private", "protected"} & words, "dart": not d.name.startswith("_"),
        "typescript": "export" in words,
    }.get(flavour, True)


IMPORTS = {
    "typescript": re.compile(r"(?m)^[ \t]*(?:import|export)\b([^;'\"]*?)\bfrom\s*['\"]([^'\"]+)['\"]|^[ \t]*import\s*(?P<bare>)['\"]([^'\"]+)['\"]"),
    "go": re.compile(r"(?m)^[ \t]*import\s+(?:\(([^)]*)\)|([\w.]+\s+)?\"([^\"]+)\")"),
    "rust": re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"),
    "java": re.compile(r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    "csharp": re.compile(r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;"),
    "kotlin": re.compile(r"(?m)^[ \t]*import\s+([\w.*]+)(?:\s+as\s+(\w+))?"),
    "swift": re.compile(r"(?m)^[ \t]*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func)\s+)?([\w.]+)"),
    "php": re.compile(r"(?m)^[ \t]*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*;"),
}


def _imports(text: str, masked: Masked, language: str) -> list[Ref]:
    """Imports as references: what module, which name of it, and the local name as token."""
    flavour = FLAVOUR.get(language, language)
    pattern, out = IMPORTS.get(flavour), []

    def one(at: int, token: str, module: str, imported: str | None) -> None:
        spot = text.find(token, at)
        spot = at if spot < 0 else spot
        out.append(Ref("import", spot, spot + len(token), unique([token] + ([imported] if imported and imported not in ("*", "default") else [])), module, imported))

    for m in pattern.finditer(text) if pattern else ():
        if masked.code[m.start() : m.end()].strip() == "":
            continue
        at = m.start()
        if flavour == "typescript":
            module = m[2] or m[4]
            clause = re.sub(r"^\s*type\b", "", m[1] or "")
            if inner := re.search(r"\{([^}]*)\}", clause):
                for item in filter(None, (x.strip() for x in inner[1].split(","))):
                    names = re.sub(r"^type\s+", "", item).split(" as ")
                    one(m.start(1) + inner.start(), names[-1].strip(), module, names[0].strip())
            rest = re.sub(r"\{[^}]*\}", "", clause)
            for item in filter(None, (x.strip() for x in rest.split(","))):
                star = re.match(r"\*\s+as\s+(\S+)", item)
                if star or re.fullmatch(IDENT, item):
                    one(m.start(1), star[1] if star else item, module, "*" if star else "default")
            if not clause.strip():
                one(at, module.rsplit("/", 1)[-1], module, None)
        elif flavour == "go":
            block = m[1] if m[1] is not None else f"{m[2] or ''}\"{m[3]}\""
            for alias, path in re.findall(r"(?m)([\w.]+\s+)?\"([^\"]+)\"", block):
                one(at, alias.strip() or path.rsplit("/", 1)[-1], path, None)
        elif flavour == "rust":
            for path, local in _use(m[1].strip(), ""):
                module, _, name = path.rpartition("::")
                one(at, local or name, module or name, name)
        else:
            alias = {"csharp": m[1] if m.re.groups > 1 else None, "kotlin": m[2] if m.re.groups > 1 else None, "php": m[2] if m.re.groups > 1 else None}.get(flavour)
            path = m[2] if flavour == "csharp" else m[1]
            name = re.split(r"[.\\]", path)[-1]
            one(at, alias or (path.split(".")[-2] if name == "*" and "." in path else name), path, name)
    return out


def _use(tree: str, base: str) -> list[tuple[str, str | None]]:
    """Paths of a Rust use tree, with their local names."""
    tree = tree.strip()
    if (brace := tree.find("{")) >= 0:
        prefix, out, depth, item = base + tree[:brace], [], 0, ""
        for c in tree[brace + 1 : tree.rfind("}")]:
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                out += _use(item, prefix)
                item = ""
            else:
                item += c
        return out + (_use(item, prefix) if item.strip() else [])
    path, _, local = tree.partition(" as ")
    path = (base + path.strip()).removesuffix("::self")
    return [(path, local.strip() or None)]


def _refs(text: str, masked: Masked, language: str, definitions: list[Definition]) -> list[Ref]:
    refs = _imports(text, masked, language)
    imported = {r.texts[0] for r in refs}
    code = masked.code
    heads = {d.name_at for d in definitions}
    for m in CALL.finditer(code):
        chain = [x for x in re.split(r"\s*(?:\?\.|\.|::|->)\s*", m[1])]
        base = chain[-1].lstrip("$")
        at = m.end(1) - len(chain[-1])
        if base in KEYWORDS or at in heads or DECLARED.search(code, max(0, m.start() - 200), m.start()):
            continue
        if not re.search(r"(?:^|[^.\w])\s*$", code[max(0, m.start() - 1) : m.start()]) and code[m.start() - 1 : m.start()] == ".":
            chain = ["", "", base]
            refs.append(Ref("call", at, m.end(1), [base]))
            continue
        refs.append(Ref("call", at, m.end(1), called([c.lstrip("$") for c in chain[:-1]] + [base], imported)))
    for m in WORD.finditer(code):
        if m.start() not in heads and len(m[0]) > 1 and SYMBOLISH.fullmatch(m[0]):
            refs.append(Ref("identifier", m.start(), m.end(), [m[0]]))
    return refs


def parse(text: str, language: str) -> Parsed | None:
    """None for a language that is not read."""
    if language == "python":
        return _python(text)
    return _braces(text, language) if language in HEADS else None


PRIORITY = {"import": 4, "call": 3, "identifier": 2, "string_literal": 1}


def dedupe(refs: list[Ref]) -> list[Ref]:
    """References of one place and first token as one: that of the highest kind, with the tokens of those it replaces or equals."""
    held: dict[tuple[int, int, str], Ref] = {}
    for r in refs:
        key = (r.start, r.end, r.texts[0])
        old = held.get(key)
        if old is None:
            held[key] = r
        elif PRIORITY[r.kind] > PRIORITY[old.kind]:
            held[key] = Ref(r.kind, r.start, r.end, unique(r.texts + old.texts), r.module, r.imported)
        elif PRIORITY[r.kind] == PRIORITY[old.kind]:
            old.texts = unique(old.texts + r.texts)
    return list(held.values())


def facts(parsed: Parsed | None, text: str, start: int, end: int) -> dict[str, list[str]]:
    """Identifiers, their parts, called names and string literals between two places; without a parse, by patterns over the text."""
    if parsed is None or parsed.failed:
        words = unique(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text[start:end]))
        literals = unique([m[2] for m in re.finditer(r"([\"'`])((?:\\.|(?!\1)[^\\\n])*)\1", text[start:end]) if 0 < len(m[2]) <= MAX_LITERAL_CHARS])
        return {"identifiers": words, "identifier_parts": unique([p for w in words for p in parts_of(w)]), "called_names": [], "string_literals": literals}
    code, reserved = parsed.masked.code, RESERVED.get(FLAVOUR.get(parsed.language, parsed.language), frozenset())
    words = unique([w for w in WORD.findall(code[start:end]) if w not in reserved])
    heads = {d.name_at for d in parsed.definitions}
    calls: list[str] = []
    for m in CALL.finditer(code, start, end):
        raw = re.sub(r"\s+", "", m[1])
        last = WORD.findall(raw)[-1]
        if last in KEYWORDS or m.end(1) - len(last) in heads or DECLARED.search(code, max(0, m.start() - 200), m.start()):
            continue
        calls += [raw, last] if len(raw) <= MAX_CALL_CHARS else [last]
    literals = [v[:MAX_LITERAL_CHARS] for s, e, v in parsed.masked.strings if start <= s and e <= end and v]
    return {"identifiers": words, "identifier_parts": unique([p for w in words for p in parts_of(w)]), "called_names": unique(calls), "string_literals": unique(literals)}
