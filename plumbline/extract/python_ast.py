"""Facts of Python sources from the standard library's syntax tree."""

from __future__ import annotations

import ast
import hashlib
from dataclasses import dataclass, field

#: Fixed values.
PRIMITIVES = {"str", "int", "float", "bool", "bytes", "complex", "None"}
OWN = ("self", "cls")


def _h64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


@dataclass
class _Tally:
    """What the walk through a function's body has met so far."""

    cc: int = 1
    cogc: int = 0
    cog_nest: int = 0
    nesting: int = 0
    bumps: int = 0
    in_bump: bool = False
    compound: int = 0
    embedded: int = 0
    empty_catch: int = 0

    def branch(self) -> None:
        self.cogc += 1 + self.cog_nest

    def at_depth(self, depth: int, is_if: bool) -> None:
        self.cc += 1
        self.nesting = max(self.nesting, depth + 1)
        if depth < 2:
            self.in_bump = False
        elif is_if and not self.in_bump:
            self.bumps += 1
            self.in_bump = True


def _bool_ops(node: ast.AST) -> int:
    return sum(len(x.values) - 1 for x in ast.walk(node) if isinstance(x, ast.BoolOp))


def _bool_changes(node: ast.AST) -> int:
    """Runs of one boolean operator: a new run begins where the operator changes."""
    kinds: list[type] = []

    def visit(x: ast.AST) -> None:
        if isinstance(x, ast.BoolOp):
            for i, v in enumerate(x.values):
                visit(v)
                if i:
                    kinds.append(type(x.op))
        else:
            for y in ast.iter_child_nodes(x):
                visit(y)

    visit(node)
    return sum(1 for i, k in enumerate(kinds) if not i or kinds[i - 1] is not k)


class _Walk:
    def __init__(self, source: str):
        self.source, self.lines = source, source.split("\n")
        self.t = _Tally()

    def is_elif(self, node: ast.If) -> bool:
        return self.lines[node.lineno - 1][node.col_offset :].startswith("elif")

    def body(self, stmts: list, depth: int) -> None:
        for x in stmts:
            self.node(x, depth)

    def nested(self, stmts: list, depth: int) -> None:
        self.t.cog_nest += 1
        self.body(stmts, depth)
        self.t.cog_nest -= 1

    def condition(self, test: ast.AST) -> None:
        self.t.cogc += _bool_changes(test)
        if isinstance(test, (ast.Compare, ast.BoolOp)) or isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            first = self.source_of(test)
            if not first.startswith("(") and sum(first.count(f" {w} ") for w in ("and", "or", "not")) >= 2:
                self.t.compound += 1

    def source_of(self, node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a].encode()[node.col_offset : node.end_col_offset].decode(errors="replace")
        return "\n".join([self.lines[a].encode()[node.col_offset :].decode(errors="replace"), *self.lines[a + 1 : b], self.lines[b].encode()[: node.end_col_offset].decode(errors="replace")])

    def node(self, x: ast.AST, depth: int) -> None:
        t = self.t
        if isinstance(x, ast.If):
            self.if_(x, depth)
        elif isinstance(x, (ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)):
            t.at_depth(depth, False)
            t.branch()
            self.nested(x.body, depth + 1)
            if getattr(x, "orelse", None):
                t.cogc += 1
                self.nested(x.orelse, depth + 1)
        elif isinstance(x, (ast.Try, ast.TryStar)):
            self.nested(x.body, depth)
            for h in x.handlers:
                t.cc += 1
                t.branch()
                if all(isinstance(s, ast.Pass) for s in h.body):
                    t.empty_catch += 1
                self.nested(h.body, depth)
            if x.orelse:
                t.cogc += 1
                self.nested(x.orelse, depth)
            self.body(x.finalbody, depth)
        elif isinstance(x, ast.IfExp):
            t.cc += 1
            t.branch()
        elif isinstance(x, ast.Assert):
            if _bool_ops(x):
                t.cc += 1
        elif isinstance(x, (ast.Constant, ast.JoinedStr)):
            if isinstance(x, ast.JoinedStr) or isinstance(x.value, (str, bytes)):
                t.embedded = max(t.embedded, x.end_lineno - x.lineno + 1)
        else:
            for y in ast.iter_child_nodes(x):
                self.node(y, depth)

    def if_(self, x: ast.If, depth: int) -> None:
        t = self.t
        t.at_depth(depth, True)
        t.branch()
        self.condition(x.test)
        t.cc += _bool_ops(x.test)
        self.nested(x.body, depth + 1)
        rest = x.orelse
        while len(rest) == 1 and isinstance(rest[0], ast.If) and self.is_elif(rest[0]):
            e = rest[0]
            t.cc += 1 + 2 * _bool_ops(e.test)
            t.branch()
            self.condition(e.test)
            self.body(e.body, depth + 1)
            rest = e.orelse
        if rest:
            t.cogc += 1
            self.nested(rest, depth + 1)


def _shape(node: ast.AST) -> str:
    """Kinds in order, with names and literals collapsed."""
    if isinstance(node, ast.Constant):
        return "L"
    if isinstance(node, (ast.Name, ast.arg)):
        return "N"
    kids = [_shape(x) for x in ast.iter_child_nodes(node) if not isinstance(x, (ast.expr_context, ast.Load, ast.Store))]
    return f"{type(node).__name__}({','.join(kids)})"


def _skeleton(node: ast.AST) -> str:
    """Kinds of statements whatever their order."""
    kids = sorted(_skeleton(x) for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.excepthandler)))
    return f"{type(node).__name__}[{'|'.join(kids)}]"


def _attributes(node: ast.AST) -> tuple[list[str], list[tuple[str, str]]]:
    own, foreign = [], []
    for x in ast.walk(node):
        if isinstance(x, ast.Attribute):
            if isinstance(x.value, ast.Name):
                (own.append(x.attr) if x.value.id in OWN else foreign.append((x.value.id, x.attr)))
            elif not (isinstance(x.value, ast.Attribute) and isinstance(x.value.value, ast.Name) and x.value.value.id in OWN):
                foreign.append(("?", x.attr))
    return list(dict.fromkeys(own)), foreign


def _code_lines(lines: list[str]) -> int:
    return sum(1 for x in lines if x.strip() and not x.lstrip().startswith("#"))


def _parameters(args: ast.arguments) -> tuple[int, int, int, int]:
    """Count, primitive ones, typed ones, and most of one primitive type."""
    every = [*args.posonlyargs, *args.args, *args.kwonlyargs, *(x for x in (args.vararg, args.kwarg) if x)]
    typed = [a for a in every if a.annotation is not None]
    prims = [a.annotation.id if isinstance(a.annotation, ast.Name) else "None" for a in typed if isinstance(a.annotation, ast.Name) and a.annotation.id in PRIMITIVES or isinstance(a.annotation, ast.Constant) and a.annotation.value is None]
    return len(every), len(prims), len(typed), max((prims.count(p) for p in set(prims)), default=0)


def _short_names(body: list) -> int:
    found = set()
    for stmt in body:
        for x in ast.walk(stmt):
            targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AugAssign, ast.AnnAssign)) else []
            found.update(n.id for target in targets for n in ast.walk(target) if isinstance(n, ast.Name) and len(n.id) == 1)
    return len(found - {"_", "i", "j", "k"})


def _asserts(body: list) -> tuple[int, int]:
    """The longest run of assertions, a single other statement allowed in between, and a hash of all."""
    best = run = gap = 0
    shapes = []
    for x in body:
        if isinstance(x, ast.Assert):
            run, gap = run + 1, 0
            shapes.append(_shape(x))
            best = max(best, run)
        elif run and not gap:
            gap = 1
        else:
            run = gap = 0
    return best, _h64(";".join(shapes)) if shapes else 0


def _match_arms(body: list) -> int:
    best = 0
    for stmt in body:
        for x in ast.walk(stmt):
            if isinstance(x, ast.Match):
                text = [c for c in x.cases if isinstance(c.pattern, ast.MatchValue) and isinstance(c.pattern.value, ast.Constant) and isinstance(c.pattern.value.value, str)]
                open_ = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in x.cases)
                if not open_:
                    best = max(best, len(text))
    return best


@dataclass
class Facts:
    functions: list[dict] = field(default_factory=list)
    module: dict = field(default_factory=dict)
    imports: list[tuple[str, int]] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    classes: list[tuple[str, str | None]] = field(default_factory=list)


def _function(node, source: str, lines: list[str], cls: str | None, parent: str | None) -> dict:
    w = _Walk(source)
    w.body(node.body, 0)
    args, prims, typed, same = _parameters(node.args)
    kinds = {("Literal" if isinstance(x, ast.Constant) else type(x).__name__) for s in node.body for x in ast.walk(s)}
    asserts, assert_hash = _asserts(node.body)
    own, foreign = _attributes(node) if cls else ([], [])
    return {
        "function": f"{cls}.{node.name}" if cls else node.name, "class": cls, "parent": parent, "is_ctor": bool(cls) and node.name == "__init__",
        "start_line": node.lineno, "end_line": node.end_lineno, "loc": _code_lines(lines[node.lineno - 1 : node.end_lineno]),
        "cc": w.t.cc, "cogc": w.t.cogc, "nesting": w.t.nesting, "bumps": w.t.bumps, "compound": w.t.compound, "embedded_loc": w.t.embedded, "empty_catch": w.t.empty_catch,
        "args": max(0, args - 1) if cls else args, "typed": typed, "primitive": prims, "max_same": same, "short_vars": _short_names(node.body), "match_arms": _match_arms(node.body),
        "asserts": asserts, "assert_hash": assert_hash, "structural_hash": _h64(";".join(map(_shape, node.body))), "skeleton_hash": _h64(";".join(sorted(map(_skeleton, node.body)))), "distinct_kinds": len(kinds),
        "fields": own, "foreign": foreign,
    }


def extract(source: str) -> Facts | None:
    """Everything that one file tells, or null if it can't be parsed."""
    try:
        tree = ast.parse(source)
        lines, out = source.split("\n"), Facts()
        funcs = (ast.FunctionDef, ast.AsyncFunctionDef)
        for x in tree.body:
            if isinstance(x, funcs):
                out.functions.append(_function(x, source, lines, None, None))
            elif isinstance(x, ast.ClassDef):
                parent = next((b.id for b in x.bases if isinstance(b, ast.Name)), None)
                out.classes.append((x.name, parent))
                if not x.decorator_list:
                    out.functions += [_function(m, source, lines, x.name, parent) for m in x.body if isinstance(m, funcs)]
        nest = lambda x, d: max([d, *(nest(y, d + isinstance(y, (ast.If, ast.For, ast.While, ast.With))) for y in ast.iter_child_nodes(x) if isinstance(y, ast.stmt) and not isinstance(y, (*funcs, ast.ClassDef)))])
        out.module = {
            "loc": _code_lines(lines), "functions": len(out.functions), "sum_cc": sum(f["cc"] for f in out.functions),
            "declarations": sum(isinstance(x, ast.ClassDef) or bool(getattr(x, "decorator_list", None)) for x in tree.body),
            "global_conditionals": sum(isinstance(x, ast.If) for x in tree.body), "global_nesting": nest(tree, 0),
        }
        for x in ast.walk(tree):
            if isinstance(x, ast.Import):
                out.imports += [(a.name, x.lineno) for a in x.names]
            elif isinstance(x, ast.ImportFrom):
                out.imports.append(("." * x.level + (x.module or ""), x.lineno))
        for f in tree.body:
            for cls, m in [(None, f)] if isinstance(f, funcs) else [(f.name, m) for m in f.body if isinstance(m, funcs)] if isinstance(f, ast.ClassDef) else []:
                types = {a.arg: a.annotation.id for a in [*m.args.args, *m.args.kwonlyargs] if isinstance(a.annotation, ast.Name)}
                for s in ast.walk(m):
                    if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Name) and s.value.func.id[:1].isupper():
                        types.update({t.id: s.value.func.id for t in s.targets if isinstance(t, ast.Name)})
                for c in ast.walk(m):
                    if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute)):
                        recv = c.func.value.id if isinstance(c.func, ast.Attribute) and isinstance(c.func.value, ast.Name) else None
                        out.calls.append({"caller": f"{cls}.{m.name}" if cls else m.name, "class": cls, "callee": c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id, "receiver_type": cls if recv in OWN else types.get(recv) if recv else None, "line": c.lineno})
        return out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def unreachable_lines(source: str) -> list[tuple[str, int]]:
    """(function, line) of the first statement after one that never goes on, in any block of a function."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []

    def ends(x: ast.stmt) -> bool:
        if isinstance(x, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            return True
        if isinstance(x, ast.If):
            return bool(x.orelse) and ends(x.body[-1]) and ends(x.orelse[-1])
        if isinstance(x, ast.While):
            return isinstance(x.test, ast.Constant) and bool(x.test.value) and not any(isinstance(y, ast.Break) for y in ast.walk(x))
        return False

    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for b in ast.walk(f):
                for block in (getattr(b, k, None) for k in ("body", "orelse", "finalbody")):
                    if isinstance(block, list):
                        found += [(f.name, after.lineno) for before, after in zip(block, block[1:]) if ends(before)][:1]
    return sorted(set(found), key=lambda x: x[1])


def dead_stores(source: str) -> list[tuple[str, str, int]]:
    """(function, name, line) of local values that are never read: by liveness backwards through the blocks, loops until nothing changes."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found: set[tuple[str, str, int]] = set()

    def reads(x: ast.AST) -> set[str]:
        return {n.id for n in ast.walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}

    def back(block: list, live: set[str], func: str, keep: set[str], note: bool) -> set[str]:
        for x in reversed(block):
            if isinstance(x, ast.If):
                live = back(x.body, set(live), func, keep, note) | back(x.orelse, set(live), func, keep, note) | reads(x.test)
            elif isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
                head = reads(x.test) if isinstance(x, ast.While) else reads(x.iter)
                around = set(live) | head
                for _ in range(8):
                    new = around | back(x.body, set(around), func, keep, False)
                    if new == around:
                        break
                    around = new
                back(x.body, set(around), func, keep, note)
                live = around | back(x.orelse, set(live), func, keep, note)
            elif isinstance(x, (ast.With, ast.AsyncWith)):
                live = back(x.body, live, func, keep, note) | {n for i in x.items for n in reads(i.context_expr)}
            elif isinstance(x, (ast.Try, ast.TryStar)):
                after = back(x.finalbody, set(live), func, keep, note)
                handled = set().union(*[back(h.body, set(after), func, keep, note) for h in x.handlers]) if x.handlers else set()
                live = back(x.body, after | handled | reads(x) | back(x.orelse, set(after), func, keep, note), func, keep, False) | handled
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                live = live | reads(x)
            elif isinstance(x, (ast.Return, ast.Raise)):
                live = reads(x)
            elif isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                name = x.targets[0].id
                if note and name not in live and name not in keep and not name.startswith("_"):
                    found.add((func, name, x.lineno))
                live = live - {name} | reads(x.value)
            else:
                live = live | reads(x) | ({x.target.id} if isinstance(x, ast.AugAssign) and isinstance(x.target, ast.Name) else set())
        return live

    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = [y for y in ast.walk(f) if y is not f and isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda))]
            keep = {n for y in inner for n in reads(y)} | {n for y in ast.walk(f) if isinstance(y, (ast.Global, ast.Nonlocal)) for n in y.names}
            back(f.body, set(), f.name, keep, True)
    return sorted(found, key=lambda x: x[2])


def taint(source: str, sources: set[str], sinks: set[str], sanitizers: set[str]) -> list[tuple[str, str, int]]:
    """(function, sink, line): sinks that a value from a source reaches within a function, in the order of the text. An assignment passes it on, a clean one clears it, a sanitizer's result is clean."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []
    name = lambda c: c.func.attr if isinstance(c.func, ast.Attribute) else getattr(c.func, "id", "")
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        dirty: set[str] = set()

        def bad(x: ast.AST) -> bool:
            if isinstance(x, ast.Call):
                return name(x) not in sanitizers and (name(x) in sources or any(bad(y) for y in ast.iter_child_nodes(x)))
            if isinstance(x, ast.Name):
                return x.id in dirty
            return any(bad(y) for y in ast.iter_child_nodes(x))

        def visit(x: ast.AST) -> None:
            for c in [c for c in ast.walk(x) if isinstance(c, ast.Call)] if isinstance(x, (ast.Expr, ast.Assign, ast.Return)) else []:
                if name(c) in sinks and any(bad(a) for a in [*c.args, *(k.value for k in c.keywords)]):
                    found.append((f.name, name(c), c.lineno))
            if isinstance(x, ast.Assign):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        (dirty.add if bad(x.value) else dirty.discard)(t.id)
            for y in ast.iter_child_nodes(x):
                if isinstance(y, ast.stmt):
                    visit(y)

        for s in f.body:
            visit(s)
    return found
