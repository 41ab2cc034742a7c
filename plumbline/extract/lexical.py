"""Facts of other languages by their words and braces: the same fields, best effort.

A profile names a language's words; strings and comments are blanked first.
Functions are found by their heads, and end with their brace, their `end` or,
in languages of indentation, with the first line that is not deeper.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from plumbline.extract.python_ast import Facts, _h64


@dataclass(frozen=True)
class Profile:
    head: str
    comment: str = r"//[^\n]*|/\*.*?\*/"
    branch: str = r"\b(?:if|for|while|case|catch|foreach)\b|\?(?![.?:])"
    boolean: str = r"&&|\|\|"
    imports: str = r"^\s*(?:import|use|using|include|require)\s+([\w.:/\\{}* -]+)"
    close: str = "brace"
    opens: str = r"\b(?:function|do|if)\b"
    method: str = r"\b(?:class|struct|impl|interface|object|trait)\s+(\w+)"


_C_HEAD = r"^[ \t]*(?:[\w:<>,*&\[\]~ \t]+[ \t*&])?(\w+)[ \t]*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)[^;{}=]*\{"
_END = dict(close="end", comment=r"#[^\n]*", opens=r"\b(?:def|class|module|do|begin|case)\b|^\s*(?:if|unless|while|until|for)\b")
#: Words of the languages.
PROFILES = {
    "typescript": Profile(r"\b(?:function\s*\*?\s+(\w+)\s*|(?:(?:public|private|protected|static|async|get|set)\s+)*(\w+)\s*)(?:<[^>]*>)?\(([^(){};]*)\)\s*(?::[^={;]+)?\{", imports=r"""(?:from|import|require\()\s*["']([^"']+)["']""", boolean=r"&&|\|\||\?\?"),
    "rust": Profile(r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\(([^{;]*?)\)[^{;]*\{", branch=r"\b(?:if|for|while|loop)\b|=>(?!\s*_)", imports=r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "c": Profile(_C_HEAD, imports=r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]"""),
    "java": Profile(_C_HEAD, imports=r"^\s*import\s+(?:static\s+)?([\w.*]+)"),
    "csharp": Profile(_C_HEAD, imports=r"^\s*using\s+([\w.]+)\s*;"),
    "go": Profile(r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^{]*?)\)[^{\n]*\{", branch=r"\b(?:if|for|case)\b", imports=r"""^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$"""),
    "swift": Profile(r"\bfunc\s+(\w+)\s*(?:<[^>]*>)?\(([^{]*?)\)[^{]*\{", branch=r"\b(?:if|for|while|case|catch|guard|repeat)\b|\?(?![.?!:])", imports=r"^\s*import\s+(\w+)"),
    "zig": Profile(r"\bfn\s+(\w+)\s*\(([^{]*?)\)[^{;]*\{", branch=r"\b(?:if|for|while|catch|orelse)\b", boolean=r"\b(?:and|or)\b", imports=r"""@import\(\s*"([^"]+)"\s*\)"""),
    "kotlin": Profile(r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(([^{]*?)\)[^{=\n]*\{", branch=r"\b(?:if|for|while|catch)\b|->|\?:", imports=r"^\s*import\s+([\w.*]+)"),
    "php": Profile(r"\bfunction\s+&?(\w+)\s*\(([^{]*?)\)[^{;]*\{", comment=r"//[^\n]*|#[^\n]*|/\*.*?\*/", boolean=r"&&|\|\||\b(?:and|or)\b", imports=r"^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*[\"']([^\"']+))"),
    "d": Profile(_C_HEAD, imports=r"^\s*import\s+([\w.]+)"),
    "groovy": Profile(_C_HEAD, imports=r"^\s*import\s+([\w.*]+)"),
    "objectivec": Profile(r"^[-+]\s*\([^)]*\)\s*(\w+)([^{;]*)\{", imports=r"""^\s*[#@](?:import|include)\s*[<"]?([\w/.+-]+)"""),
    "tcl": Profile(r"^\s*proc\s+(\S+)\s+\{([^}]*)\}\s*\{", comment=r"^\s*#[^\n]*", branch=r"\b(?:if|elseif|for|foreach|while|catch|try)\b", imports=r"^\s*(?:package\s+require|source)\s+(\S+)"),
    "r": Profile(r"\b(\w[\w.]*)\s*(?:<-|=)\s*function\s*\(([^{]*?)\)\s*\{", comment=r"#[^\n]*", branch=r"\b(?:if|for|while|repeat|switch|tryCatch)\b", imports=r"""\b(?:library|require|source)\s*\(\s*["']?([\w./]+)"""),
    "ruby": Profile(r"^\s*def\s+(?:self\.)?(\w+[?!]?)\s*(?:\(([^)]*)\))?", branch=r"\b(?:if|elsif|unless|while|until|for|when|rescue)\b", boolean=r"&&|\|\||\b(?:and|or)\b", imports=r"""^\s*require(?:_relative)?\s*\(?\s*["']([^"']+)["']""", **_END),
    "lua": Profile(r"\bfunction\s+([\w.:]+)\s*\(([^)]*)\)", branch=r"\b(?:if|elseif|for|while|repeat)\b", boolean=r"\b(?:and|or)\b", imports=r"""\brequire\s*\(?\s*["']([^"']+)["']""", close="end", comment=r"--[^\n]*"),
    "haskell": Profile(r"^(\w+)\s+((?:[^=\n]*?))=(?!=)", comment=r"--[^\n]*|\{-.*?-\}", branch=r"\bif\b|\bcase\b|^\s*\|(?!\s*otherwise)|->", imports=r"^\s*import\s+(?:qualified\s+)?([\w.]+)", close="indent"),
    "cobol": Profile(r"^\s{0,11}([A-Z0-9][A-Z0-9-]*)\s*()\.\s*$", comment=r"^.{6}\*[^\n]*|\*>[^\n]*", branch=r"\b(?:IF|WHEN|PERFORM\s+UNTIL|PERFORM\s+VARYING)\b", boolean=r"\b(?:AND|OR)\b", imports=r"\b(?:COPY|CALL)\s+[\"']?([\w-]+)", close="next"),
}
PROFILES["javascript"] = PROFILES["typescript"]
PROFILES["cpp"] = PROFILES["c"]

_STRINGS = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')
#: Words that look like heads.
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "sizeof", "function", "constructor_"}


def _blank(text: str, pattern: str, flags: int = 0) -> str:
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=flags)


def _brace_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth <= 0:
            return m.start()
    return len(text)


def _depths(body: str) -> int:
    depth = most = 0
    for c in re.finditer(r"[{}]", body):
        depth += 1 if c[0] == "{" else -1
        most = max(most, depth - 1)
    return max(0, most)


def extract(source: str, lang: str) -> Facts | None:
    """The facts of a file in one of the profiled languages, or null for other languages."""
    p = PROFILES.get(lang)
    if p is None:
        return None
    clean = _blank(_blank(source, p.comment, re.S | re.M), _STRINGS.pattern)
    lines = clean.split("\n")
    out = Facts()
    out.imports = [(next(g for g in m.groups() if g).strip(), source.count("\n", 0, m.start(m.lastindex or 0)) + 1) for m in re.finditer(p.imports, source, re.M) if any(m.groups())]
    heads = [m for m in re.finditer(p.head, clean, re.M) if (m[1] or m[2]) not in _NOT_NAMES]
    for i, m in enumerate(heads):
        name = m[1] or m[2]
        params = m[m.lastindex] if m.lastindex and m.lastindex > 1 else ""
        start = clean.count("\n", 0, m.start(1) if m[1] else m.start(2)) + 1
        if p.close == "brace":
            stop = _brace_end(clean, m.end() - 1)
        elif p.close == "end":
            depth, stop = 1, len(clean)
            for w in re.compile(rf"{p.opens}|\bend\b", re.M).finditer(clean, m.end()):
                depth += -1 if w[0] == "end" else 1
                if depth == 0:
                    stop = w.end()
                    break
        else:
            stop = heads[i + 1].start() if i + 1 < len(heads) else len(clean)
        body = clean[m.end() : stop]
        end = start + clean.count("\n", m.start(), stop)
        branches = len(re.findall(p.branch, body, re.M))
        kinds = re.findall(r"\b(?:if|else|for|while|switch|case|return|try|catch|throw|break|continue)\b|[=+\-*/<>!&|]+|\w+(?=\()", body)
        shape = re.sub(r"\s+", " ", re.sub(r"\b\d[\w.]*\b", "0", re.sub(r"\b(?!(?:if|else|for|while|switch|case|return|try|catch)\b)[A-Za-z_]\w*", "n", body)))
        args = [a for a in re.split(r",(?![^<(]*[>)])", params) if a.strip()]
        out.functions.append({
            "function": name, "class": None, "parent": None, "is_ctor": False, "start_line": start, "end_line": end, "loc": sum(1 for x in lines[start - 1 : end] if x.strip()),
            "cc": 1 + branches + len(re.findall(p.boolean, body)), "cogc": branches, "nesting": _depths(body) if p.close == "brace" else 0, "bumps": 0, "compound": 0, "embedded_loc": 0,
            "empty_catch": len(re.findall(r"\bcatch\b[^{]*\{\s*\}", body)), "args": len(args), "typed": 0, "primitive": 0, "max_same": 0, "short_vars": 0, "match_arms": 0, "asserts": 0, "assert_hash": 0,
            "structural_hash": _h64(shape), "skeleton_hash": _h64(" ".join(sorted(kinds))), "distinct_kinds": len(set(kinds)), "fields": [], "foreign": [],
        })
    out.module = {"loc": sum(1 for x in lines if x.strip()), "functions": len(out.functions), "sum_cc": sum(f["cc"] for f in out.functions), "declarations": len(re.findall(p.method, clean)), "global_conditionals": 0, "global_nesting": 0}
    return out
