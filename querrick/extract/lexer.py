"""Source texts with comments and strings blanked out, so that patterns meet code only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Masked:
    """``code`` has the text's length and line breaks; comments, and strings but for code inside of them, are blanks."""

    code: str
    strings: list[tuple[int, int, str]] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Quotes:
    """How a language writes comments and strings."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    strings: tuple[str, ...] = ('"', "'")
    raw: tuple[str, ...] = ()
    inside: str | None = None
    inside_in: tuple[str, ...] = ()
    multiline: tuple[str, ...] = ()
    char: bool = False


RULES = {
    "typescript": Quotes(strings=("`", '"', "'"), inside="${", inside_in=("`",), multiline=("`",)),
    "python": Quotes(line=("#",), block=(), strings=('"""', "'''", '"', "'"), multiline=('"""', "'''")),
    "go": Quotes(strings=("`", '"', "'"), raw=("`",), multiline=("`",)),
    "rust": Quotes(strings=('"',), multiline=('"',), char=True),
    "java": Quotes(strings=('"""', '"', "'"), multiline=('"""',)),
    "csharp": Quotes(strings=('"', "'"), inside="{", inside_in=()),
    "kotlin": Quotes(strings=('"""', '"', "'"), raw=('"""',), inside="${", inside_in=('"""', '"'), multiline=('"""',)),
    "swift": Quotes(strings=('"""', '"'), inside="\\(", inside_in=('"""', '"'), multiline=('"""',)),
    "php": Quotes(line=("//", "#"), strings=('"', "'"), inside="{$", inside_in=('"',), multiline=('"', "'")),
    "dart": Quotes(strings=('"""', "'''", '"', "'"), inside="${", inside_in=('"', "'"), multiline=('"""', "'''")),
}
RULES |= {"javascript": RULES["typescript"], "tsx": RULES["typescript"]}
CLOSERS = {"${": "}", "{": "}", "{$": "}", "\\(": ")"}
RUST_RAW = re.compile(r'b?r(#*)"')
RUST_CHAR = re.compile(r"b?'(\\.[^']*|[^'\\])'")
CSHARP_OPEN = re.compile(r'(\$@|@\$|\$|@)?"')


def mask(text: str, language: str) -> Masked:
    """The masked text of a language; one whose rules are not known is returned as it is."""
    rule = RULES.get(language)
    if rule is None:
        return Masked(text)
    out, done = list(text), Masked("")

    def blank(a: int, b: int) -> None:
        for i in range(a, b):
            if out[i] != "\n":
                out[i] = " "

    def string(at: int, quote: str, opened: int, raw: bool, inner: str | None) -> int:
        """Reads a string whose text starts at ``opened``; the place after it. Code inside is scanned as code."""
        i, last = opened, opened
        blank(at, opened)
        while i < len(text):
            if inner and text.startswith(inner, i):
                blank(last, i + len(inner))
                i = last = scan(i + len(inner), CLOSERS[inner])
                continue
            if not raw and text[i] == "\\":
                i += 2
                continue
            if text.startswith(quote, i):
                if raw and quote == '"' and text.startswith('""', i):
                    i += 2
                    continue
                break
            if text[i] == "\n" and quote not in rule.multiline and not raw:
                break
            i += 1
        end = min(i, len(text))
        done.strings.append((at, min(end + len(quote), len(text)), text[opened:end]))
        after = min(end + len(quote), len(text)) if text.startswith(quote, end) else end
        blank(last, after)
        return max(after, opened)

    def scan(i: int, closer: str | None) -> int:
        """Scans code up to the closing bracket of what encloses it, or to the end."""
        depth = 0
        opener = {"}": "{", ")": "("}.get(closer or "")
        signs = {s[0] for s in (*rule.line, *(b[0] for b in rule.block), *rule.strings)} | set((closer or "") + (opener or "") + {"rust": "br", "csharp": '$@"'}.get(language, "") + ("b'" if rule.char else ""))
        sign = re.compile("[" + re.escape("".join(sorted(signs))) + "]")
        while i < len(text):
            found_sign = sign.search(text, i)
            if not found_sign:
                return len(text)
            i = found_sign.start()
            c = text[i]
            if closer and c == opener:
                depth += 1
            elif closer and c == closer:
                if not depth:
                    out[i] = " "
                    return i + 1
                depth -= 1
            if any(text.startswith(s, i) for s in rule.line) and not (language == "php" and text.startswith("#[", i)):
                end = text.find("\n", i)
                end = len(text) if end < 0 else end
                done.comments.append((i, end))
                blank(i, end)
                i = end
                continue
            if found := next((b for b in rule.block if text.startswith(b[0], i)), None):
                end = text.find(found[1], i + len(found[0]))
                end = len(text) if end < 0 else end + len(found[1])
                done.comments.append((i, end))
                blank(i, end)
                i = end
                continue
            if language == "rust" and c in "br" and (m := RUST_RAW.match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
                i = string(i, '"' + m[1], m.end(), True, None) if m[1] else string(i, '"', m.end(), True, None)
                continue
            if rule.char and c in "b'" and (m := RUST_CHAR.match(text, i)):
                blank(i, m.end())
                i = m.end()
                continue
            if language == "csharp" and c in '$@"' and (m := CSHARP_OPEN.match(text, i)):
                mark = m[1] or ""
                i = string(i, '"', m.end(), "@" in mark, "{" if "$" in mark else None)
                continue
            if quote := next((q for q in rule.strings if text.startswith(q, i)), None):
                i = string(i, quote, i + len(quote), quote in rule.raw, rule.inside if quote in rule.inside_in else None)
                continue
            i += 1
        return i

    scan(0, None)
    done.code = "".join(out)
    done.strings.sort()
    return done


def closing(code: str, at: int) -> int:
    """The place of the brace that closes the one at ``at`` of masked code, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code) - 1
