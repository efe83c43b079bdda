"""Facts about one Python module: calls, functions, classes, assignments and imports, from one parse.

The extractor knows nothing of rules. Order numbers follow a breadth-first walk; where several nodes qualify, the
lowest number decides.
"""

from __future__ import annotations

import ast
from collections import deque

ARG = "struct<pos:int,kw:string,name:string,text:string,literals:array<string>,roots:array<string>>"
STEP = "struct<ord:int,kind:string,never:boolean,body:boolean,orelse:boolean,swallows:boolean,body_ranges:array<struct<lo:int,hi:int>>,orelse_ranges:array<struct<lo:int,hi:int>>,lo:int,hi:int>"
CALL = f"struct<ord:int,line:int,col:int,kind:string,callee:string,last:string,names:array<string>,exact:array<string>,mods:array<string>,receiver:string,module_name:string,text:string,args:array<{ARG}>,parent:string,origin:string,chain:array<string>,strong:boolean,fn:int,near_params:array<string>,fids:array<int>,constant_in:array<int>,steps:array<{STEP}>,classes:array<string>,class_bases:array<array<string>>,fn_decorators:array<string>>"
BRANCH = "struct<consts:array<string>,ranges:array<struct<lo:int,hi:int>>>"
DECORATOR = "struct<name:string,last:string,called:boolean,flags:array<string>>"
FUNCTION = f"struct<ord:int,name:string,lo:int,hi:int,decorators:array<{DECORATOR}>,params:array<string>,raises:boolean,bases:array<string>,passed_to:array<string>,listed_in:array<string>,branches:array<{BRANCH}>,action_lines:array<int>,aliases:array<struct<name:string,sources:array<string>>>>"
CLASS = "struct<ord:int,name:string,bases:array<string>,decorators:array<string>,truthy:array<string>,first_assigned:string>"
TEXT = "struct<line:int,col:int,target:string,value:string,fn:int>"
FACTS = f"calls:array<{CALL}>,functions:array<{FUNCTION}>,classes:array<{CLASS}>,made_with:array<struct<name:string,kw:string>>,texts:array<{TEXT}>,tool_names:array<string>,modules:array<string>,finally_ranges:array<struct<lo:int,hi:int>>,main_ranges:array<struct<lo:int,hi:int>>,class_ranges:array<struct<lo:int,hi:int>>"

PAYLOAD = {"args", "arguments", "cmd", "code", "command", "content", "file_path", "path", "payload", "query", "script", "shell", "sql", "url"}
ACTION_ENDINGS = ("Action", "Command", "Instruction", "Invocation", "ToolCall")
SCHEMA_KEYS = {"args_schema", "inputSchema", "input_schema", "parameters"}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
HOPS = 3


def dotted(node: ast.expr) -> str:
    """Names joined by dots; a root that is no plain name is left out."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(parts[::-1])


def target_name(call: ast.Call) -> str:
    return dotted(call.func) if isinstance(call.func, (ast.Name, ast.Attribute)) else ""


def decorator_name(node: ast.expr, last: bool = False) -> str:
    while isinstance(node, ast.Call):
        node = node.func
    name = dotted(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""
    return (node.attr if isinstance(node, ast.Attribute) else name) if last else name


def base_names(cls: ast.ClassDef, last: bool = False) -> list[str]:
    return [decorator_name(b, last) for b in cls.bases if isinstance(b, (ast.Name, ast.Attribute))]


def text_of(node: ast.expr) -> str | None:
    """A string literal's text; holes of an f-string are {var}; of a sum the left part must be text."""
    if isinstance(node, ast.Constant):
        return node.value if isinstance(node.value, str) else None
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else "{var}" for v in node.values if isinstance(v, ast.FormattedValue) or isinstance(v.value, str))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        left = text_of(node.left)
        return None if left is None else left + (text_of(node.right) or "")
    return None


def taint_roots(node: ast.expr) -> list[str]:
    """Names that an expression's value derives from."""
    match node:
        case ast.Name():
            return [node.id]
        case ast.JoinedStr():
            return [r for v in node.values if isinstance(v, ast.FormattedValue) for r in taint_roots(v.value)]
        case ast.BinOp():
            return taint_roots(node.left) + taint_roots(node.right)
        case ast.Attribute():
            while isinstance(node, ast.Attribute):
                node = node.value
            return [node.id] if isinstance(node, ast.Name) else []
        case ast.Call(func=ast.Attribute(value=value)):
            return taint_roots(value)
    return []


def parameters(fn) -> list[str]:
    a = fn.args
    return [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]


def ranges(nodes) -> list[dict]:
    return [{"lo": n.lineno, "hi": n.end_lineno} for n in nodes]


def swallows(handler: ast.ExceptHandler) -> bool:
    kinds = [] if handler.type is None else handler.type.elts if isinstance(handler.type, ast.Tuple) else [handler.type]
    return all(isinstance(k, ast.Name) and k.id in ("BaseException", "Exception") for k in kinds) and not any(isinstance(n, ast.Raise) for n in ast.walk(handler))


class Module:
    """One parsed module with its nodes in breadth-first order."""

    def __init__(self, source: str):
        self.nodes: list[ast.AST] = []
        self.parent: dict[ast.AST, ast.AST] = {}
        self.ord: dict[ast.AST, int] = {}
        todo = deque([ast.parse(source)])
        while todo:
            node = todo.popleft()
            self.ord[node] = len(self.nodes)
            self.nodes.append(node)
            for child in ast.iter_child_nodes(node):
                # operators and contexts are shared objects; they are never asked for
                self.parent[child] = node
                todo.append(child)
        self.functions = [n for n in self.nodes if isinstance(n, FUNCTIONS)]
        self.types: dict[str, str] = {}
        self.attributes: dict[str, str] = {}
        self.aliases: dict[str, str] = {}
        for n in self.nodes:
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
                self._typed(n)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                prefix = f"{n.module}." if isinstance(n, ast.ImportFrom) and n.module else ""
                self.aliases |= {a.asname: prefix + a.name for a in n.names if a.asname}

    def _typed(self, n: ast.Assign) -> None:
        made = target_name(n.value)
        factory = isinstance(n.value.func, ast.Attribute) and n.value.func.attr in ("Client", "client") and n.value.args
        service = n.value.args[0].value if factory and isinstance(n.value.args[0], ast.Constant) and isinstance(n.value.args[0].value, str) else None
        for t in n.targets:
            if isinstance(t, ast.Name):
                if made:
                    self.types[t.id] = made
                if service is not None:
                    self.types[t.id] = service
            elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and made:
                self.attributes[t.attr] = made

    def unalias(self, name: str) -> str:
        head, dot, tail = name.partition(".")
        return self.aliases.get(head, head) + dot + tail

    def above(self, node: ast.AST):
        while (node := self.parent.get(node)) is not None:
            yield node

    def origin(self, node: ast.expr, hops: int = 0) -> tuple[str, list[str], bool] | None:
        """(what made the value, the way from there, whether that is certain) of a call's receiver."""
        if hops > HOPS:
            return None
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call) and (inner := self.origin(node.func.value, hops + 1)):
                return inner[0], [*inner[1], f"{node.func.attr}()"], inner[2]
            name = target_name(node)
            return self.unalias(name or "(...)"), [f"{name}(...)"], True
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Call) and (inner := self.origin(node.value, hops + 1)):
            return inner[0], [*inner[1], f"{node.attr}()"], inner[2]
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            if node.value.id == "self":
                made = self.attributes.get(node.attr)
                return made and (self.unalias(made), [f"self.{node.attr}", f"{self.unalias(made)}(...)"], True)
            inner = self.origin(node.value, hops + 1)
            return (inner[0], [*inner[1], node.attr], True) if inner and inner[2] else None
        if isinstance(node, ast.Name):
            made = self.types.get(node.id)
            return (self.unalias(made), [f"{self.unalias(made)}(...)"], True) if made else (node.id, [node.id], False)
        return None

    def enclosing(self, line: int) -> int | None:
        return next((self.ord[f] for f in self.functions if f.lineno <= line <= f.end_lineno), None)

    def call(self, c: ast.Call) -> dict:
        f = c.func
        kind = "name" if isinstance(f, ast.Name) else "attr" if isinstance(f, ast.Attribute) else "other"
        callee = dotted(f) if kind != "other" else ""
        names, exact, mods = [callee] if callee else [], [], callee.split(".") if kind == "attr" else []
        if kind == "attr":
            root = f
            while isinstance(root, ast.Attribute):
                root = root.value
            if isinstance(root, ast.Name) and (made := self.types.get(root.id)):
                names.append(callee.replace(root.id, made, 1))
                exact.append(f"{made.split('.')[-1]}.{f.attr}")
                if f.value is root:
                    mods += [made, made.split(".")[-1]]
            if isinstance(f.value, ast.Call):
                inner = target_name(f.value)
                mods += inner.split(".") if inner else []
                if isinstance(f.value.func, ast.Attribute):
                    names.append(f"{inner}.{f.attr}")
        args = [self.argument(i, None, a) for i, a in enumerate(c.args)] + [self.argument(None, k.arg, k.value) for k in c.keywords]
        up = list(self.above(c))
        near = next((x for x in up if isinstance(x, FUNCTIONS)), None)
        inside = [x for x in up if isinstance(x, FUNCTIONS)]
        origin = self.origin(f.value) if kind == "attr" else None
        receiver = f.value.id if kind == "attr" and isinstance(f.value, ast.Name) else f.value.attr if kind == "attr" and isinstance(f.value, ast.Attribute) else ""
        return {
            "ord": self.ord[c], "line": c.lineno, "col": c.col_offset, "kind": kind, "callee": callee, "last": f.attr if kind == "attr" else callee,
            "names": names, "exact": exact, "mods": mods, "receiver": receiver, "module_name": f.value.id if kind == "attr" and isinstance(f.value, ast.Name) else "",
            "text": ast.unparse(c)[:120], "args": args, "parent": type(self.parent[c]).__name__,
            "origin": origin and origin[0] or "", "chain": origin[1] if origin else [], "strong": bool(origin and origin[2]),
            "fn": self.enclosing(c.lineno), "near_params": parameters(near) if near else [], "fids": [self.ord[x] for x in inside],
            "constant_in": [self.ord[x] for x in inside if self.all_constant(c, x)],
            "steps": [self.step(x, c.lineno) for x in up if isinstance(x, (ast.If, ast.ExceptHandler, ast.Try, ast.Lambda, *FUNCTIONS))],
            "classes": [x.name for x in up if isinstance(x, ast.ClassDef)], "class_bases": [base_names(x, True) for x in up if isinstance(x, ast.ClassDef)],
            "fn_decorators": [decorator_name(d, True) for x in inside for d in x.decorator_list],
        }

    @staticmethod
    def argument(pos: int | None, kw: str | None, a: ast.expr) -> dict:
        literals = [a.value] if isinstance(a, ast.Constant) and isinstance(a.value, str) else [e.value for e in a.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)] if isinstance(a, ast.List) else []
        return {"pos": pos, "kw": kw, "name": a.id if isinstance(a, ast.Name) else None, "text": text_of(a), "literals": literals, "roots": taint_roots(a)}

    def step(self, x: ast.AST, line: int) -> dict:
        def holds(nodes) -> bool:
            return any(n.lineno <= line <= n.end_lineno for n in nodes)

        out = {"ord": self.ord[x], "kind": "function" if isinstance(x, (ast.Lambda, *FUNCTIONS)) else type(x).__name__, "never": False, "body": False, "orelse": False, "swallows": False, "body_ranges": [], "orelse_ranges": [], "lo": x.lineno, "hi": x.end_lineno}
        if isinstance(x, ast.If):
            out |= {"never": isinstance(x.test, ast.Constant) and x.test.value in (False, 0, None), "body": holds(x.body), "orelse": holds(x.orelse), "body_ranges": ranges(x.body), "orelse_ranges": ranges(x.orelse)}
        elif isinstance(x, ast.Try):
            out |= {"body": holds(x.body), "body_ranges": ranges(x.body), "swallows": any(map(swallows, x.handlers))}
        return out

    def all_constant(self, c: ast.Call, fn: ast.AST) -> bool:
        """Whether a call passes literals and names alone that can only hold constants in this function."""
        values = [*c.args, *(k.value for k in c.keywords)]
        if not any(isinstance(v, ast.Name) for v in values):
            return False
        if not all(isinstance(v, (ast.Constant, ast.Name)) for v in values):
            return False
        params, bound = set(parameters(fn)), bindings(fn)
        seen: set[str]

        def constant(name: str) -> bool:
            if name in seen or name in params or not bound.get(name):
                return False
            seen.add(name)
            return all(isinstance(v, ast.Constant) or isinstance(v, ast.Name) and constant(v.id) or isinstance(v, (ast.List, ast.Set, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in v.elts) for v in bound[name])

        for v in values:
            seen = set()
            if isinstance(v, ast.Name) and not constant(v.id):
                return False
        return True

    def function(self, fn, calls: list[ast.Call]) -> dict:
        cls = self.parent.get(fn)
        listed, passed = [], []
        for c in calls:
            if any(isinstance(a, ast.Name) and a.id == fn.name for a in c.args):
                passed.append(target_name(c))
            for k in c.keywords:
                if k.arg and isinstance(k.value, (ast.List, ast.Tuple)):
                    for e in k.value.elts:
                        if any(isinstance(a, ast.Name) and a.id == fn.name for a in [e, *(e.args if isinstance(e, ast.Call) else [])]):
                            listed.append(k.arg)
        wanted = action_parameters(fn)
        inside = list(ast.walk(fn))
        lines = {c.lineno for c in inside if isinstance(c, ast.Call) and wanted for a in [*c.args, *(k.value for k in c.keywords)] for s in ast.walk(a) if isinstance(s, ast.Attribute) and isinstance(s.value, ast.Name) and s.value.id in wanted and s.attr in PAYLOAD}
        aliases: dict[str, set[str]] = {}
        for n in inside:
            if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.Name):
                own = aliases.setdefault(n.targets[0].id, set())
                own |= {n.value.id} | aliases.get(n.value.id, set())
        return {
            "ord": self.ord[fn], "name": fn.name, "lo": fn.lineno, "hi": fn.end_lineno, "params": parameters(fn), "raises": any(isinstance(n, ast.Raise) for n in inside),
            "decorators": [{"name": decorator_name(d), "last": decorator_name(d, True), "called": isinstance(d, ast.Call), "flags": flags(d)} for d in fn.decorator_list],
            "bases": base_names(cls) if isinstance(cls, ast.ClassDef) else [], "passed_to": passed, "listed_in": listed, "branches": [b for n in inside for b in branches(n)],
            "action_lines": sorted(lines), "aliases": [{"name": k, "sources": sorted(v)} for k, v in sorted(aliases.items())],
        }

    def facts(self) -> dict:
        calls = [n for n in self.nodes if isinstance(n, ast.Call)]
        classes = [n for n in self.nodes if isinstance(n, ast.ClassDef)]
        texts = [
            {"line": n.lineno, "col": n.col_offset, "target": t.id, "value": n.value.value, "fn": self.enclosing(n.lineno)}
            for n in self.nodes if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)
            for t in n.targets if isinstance(t, ast.Name)
        ]
        return {
            "calls": [self.call(c) for c in calls], "functions": [self.function(f, calls) for f in self.functions], "classes": [self.klass(c) for c in classes],
            "made_with": [{"name": decorator_name(c.func, True), "kw": k.arg} for c in calls for k in c.keywords if k.arg and decorator_name(c.func, True)],
            "texts": texts, "tool_names": sorted({t for n in self.nodes if isinstance(n, ast.Dict) for t in tool_names(n)}),
            "modules": [m for n in self.nodes for m in ([a.name for a in n.names] if isinstance(n, ast.Import) else [n.module] if isinstance(n, ast.ImportFrom) and n.module else [])],
            "finally_ranges": [r for n in self.nodes if isinstance(n, ast.Try) for r in ranges(n.finalbody)],
            "main_ranges": ranges(n for n in self.nodes if isinstance(n, ast.If) and isinstance(n.test, ast.Compare) and isinstance(n.test.left, ast.Name) and n.test.left.id == "__name__" and any(isinstance(c, ast.Constant) and c.value == "__main__" for c in n.test.comparators)),
            "class_ranges": ranges(classes),
        }

    @staticmethod
    def klass(c: ast.ClassDef) -> dict:
        truthy, first = [], None
        for s in c.body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
            names = [t.id for t in targets if isinstance(t, ast.Name)]
            if names and isinstance(s.value, ast.Constant) and s.value.value:
                truthy += names
            if names and isinstance(s, ast.Assign) and first is None:
                first = names[0]
        return {"ord": 0, "name": c.name, "bases": base_names(c, True), "decorators": [decorator_name(d, True) for d in c.decorator_list], "truthy": truthy, "first_assigned": first}


def flags(d: ast.expr) -> list[str]:
    """Keywords of a called decorator that are set to something that says yes."""
    if not isinstance(d, ast.Call):
        return []
    return [k.arg for k in d.keywords if k.arg and (isinstance(k.value, ast.Constant) and (k.value.value is True or k.value.value in (1, "1", "true", "True")) or isinstance(k.value, ast.Name) and k.value.id == "true")]


def bindings(fn: ast.AST) -> dict[str, list]:
    """Every value that each name is bound to in a function; None where it can't be followed."""
    out: dict[str, list] = {}

    def lost(target: ast.AST | None) -> None:
        for s in ast.walk(target) if target is not None else ():
            if isinstance(s, ast.Name):
                out.setdefault(s.id, []).append(None)

    for n in ast.walk(fn):
        match n:
            case ast.Assign():
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        out.setdefault(t.id, []).append(n.value)
                    else:
                        lost(t)
            case ast.AnnAssign(target=ast.Name(id=name)) | ast.NamedExpr(target=ast.Name(id=name)):
                out.setdefault(name, []).append(n.value)
            case ast.AugAssign() | ast.For() | ast.AsyncFor() | ast.comprehension():
                lost(n.target)
            case ast.withitem():
                lost(n.optional_vars)
            case ast.ExceptHandler(name=str(name)):
                out.setdefault(name, []).append(None)
            case ast.Global() | ast.Nonlocal():
                for name in n.names:
                    out.setdefault(name, []).append(None)
    return out


def action_parameters(fn) -> set[str]:
    out = set()
    for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]:
        for s in ast.walk(a.annotation) if a.annotation is not None else ():
            name = s.id if isinstance(s, ast.Name) else s.attr if isinstance(s, ast.Attribute) else s.value if isinstance(s, ast.Constant) and isinstance(s.value, str) else ""
            if name.endswith(ACTION_ENDINGS):
                out.add(a.arg)
    return out


def branches(n: ast.AST) -> list[dict]:
    """The constants that select a branch, and its lines."""
    if isinstance(n, ast.If):
        consts = []
        for c in ast.walk(n.test):
            if isinstance(c, ast.Compare):
                if any(isinstance(o, ast.Eq) for o in c.ops):
                    consts += [c.left, *c.comparators]
                if any(isinstance(o, ast.In) for o in c.ops):
                    consts += [e for s in c.comparators if isinstance(s, (ast.List, ast.Set, ast.Tuple)) for e in s.elts]
        found = [c.value for c in consts if isinstance(c, ast.Constant) and isinstance(c.value, str)]
        return [{"consts": found, "ranges": ranges([*n.body, *n.orelse])}] if found else []
    if isinstance(n, ast.Match):
        out = []
        for case in n.cases:
            found = [s.value.value for s in ast.walk(case.pattern) if isinstance(s, ast.MatchValue) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)]
            if found:
                out.append({"consts": found, "ranges": ranges(case.body)})
        return out
    return []


def tool_names(d: ast.Dict) -> list[str]:
    """Names that a literal of a tool's schema declares, nested under function or flat beside its parameters."""
    items = {k.value: v for k, v in zip(d.keys, d.values) if isinstance(k, ast.Constant) and isinstance(k.value, str)}
    holders = [items["function"]] if "type" in items and isinstance(items.get("function"), ast.Dict) else []
    holders += [d] if "name" in items and items.keys() & SCHEMA_KEYS else []
    return [v.value for h in holders for k, v in zip(h.keys, h.values) if isinstance(k, ast.Constant) and k.value == "name" and isinstance(v, ast.Constant) and isinstance(v.value, str)]


EMPTY = {k.split(":")[0]: [] for k in ("calls:", "functions:", "classes:", "made_with:", "texts:", "tool_names:", "modules:", "finally_ranges:", "main_ranges:", "class_ranges:")}


def extract(source: str) -> dict:
    """The facts of a module, and error: '' or why there are none. It never raises for any source."""
    try:
        return Module(source).facts() | {"error": ""}
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return EMPTY | {"error": f"{type(e).__name__}: {e}"}
