"""Source files to facts: imports, names they bind, uses of these, definitions, calls and exports.

Python is read by its own grammar, JavaScript, TypeScript, Go and Ruby by their statements. ``bind``: a local name and the
module or symbol it stands for. ``use``: a bound name with how it is used (call, attribute, decorator, annotation, name).
``export``: a public name with its sort. A definition ends where its block does.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

CODE = "repo_id string, path string, kind string, name string, detail string, line int, end_line int, ord int"


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


def _root(node: ast.AST) -> ast.AST:
    while isinstance(node, (ast.Attribute, ast.Call, ast.Subscript)):
        node = node.func if isinstance(node, ast.Call) else node.value
    return node


def _how(tree: ast.AST) -> dict[int, str]:
    """How names are used, by the identity of their nodes; the first that applies of decorator, annotation, call, attribute."""
    found: dict[int, str] = {}
    nodes = list(ast.walk(tree))
    for node in nodes:
        for d in getattr(node, "decorator_list", ()):
            found.setdefault(id(_root(d)), "decorator")
        for note in (getattr(node, "annotation", None), getattr(node, "returns", None)):
            for n in ast.walk(note) if isinstance(note, ast.AST) else ():
                found.setdefault(id(n), "annotation")
    for kind, how in ((ast.Call, "call"), (ast.Attribute, "attribute")):
        for node in nodes:
            if isinstance(node, kind):
                found.setdefault(id(_root(node)), how)
    return found


def _python_exports(tree: ast.Module) -> Iterator[tuple]:
    """What a module offers: ``__all__`` if it lists names, else all top-level names without a leading underscore."""
    sorts, listed = {}, None
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            sorts[node.name] = ("class" if isinstance(node, ast.ClassDef) else "function", node.lineno)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    sorts.setdefault(target.id, ("variable", node.lineno))
                    if target.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                        listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    for name in listed if listed is not None else [n for n in sorts if not n.startswith("_")]:
        sort, line = sorts.get(name, ("name", 1))
        yield "export", name, sort, line, line


def python_facts(text: str) -> Iterator[tuple]:
    """(kind, name, detail, line, end_line) of a module: ``import`` with the alias or source as detail, ``def``, ``call``, and see above."""
    tree = ast.parse(text)
    how, bound = _how(tree), set()
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    uses = []
    while todo:
        node, owner = todo.pop()
        children = list(ast.iter_child_nodes(node))
        inner = node.name if isinstance(node, ast.ClassDef) else "" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else owner
        if isinstance(node, ast.Import):
            for a in node.names:
                local, target = (a.asname, a.name) if a.asname else (a.name.partition(".")[0],) * 2
                bound.add(local)
                yield "import", a.name, a.asname, node.lineno, node.end_lineno
                yield "bind", local, target, node.lineno, node.end_lineno
        elif isinstance(node, ast.ImportFrom):
            source = "." * node.level + (node.module or "")
            for a in node.names:
                whole = f"{source}.{a.name}" if source else a.name
                yield "import", whole, a.asname or a.name, node.lineno, node.end_lineno
                if a.name != "*":
                    bound.add(a.asname or a.name)
                    yield "bind", a.asname or a.name, whole, node.lineno, node.end_lineno
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
            yield "def", f"{owner}.{node.name}" if owner else node.name, ",".join(args), node.lineno, node.end_lineno
        elif isinstance(node, ast.Call) and (name := _dotted(node.func)):
            yield "call", name, None, node.lineno, node.end_lineno
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            uses.append(node)
        todo += [(c, inner) for c in reversed(children)]
    for node in uses:  # an import may stand below a use in the text
        if node.id in bound:
            yield "use", node.id, how.get(id(node), "name"), node.lineno, node.end_lineno
    yield from _python_exports(tree)


_JS = [
    ("import", re.compile(r"""^\s*import\s+(?:type\s+)?(?P<detail>[^'"]*?)\s*(?:from\s+)?['"](?P<name>[^'"]+)['"]""")),
    ("import", re.compile(r"""(?:const|let|var)\s+(?P<detail>[\w${},\s:]+?)\s*=\s*(?:await\s+)?(?:require|import)\(\s*['"](?P<name>[^'"]+)['"]\s*\)""")),
    ("def", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*\((?P<detail>[^)]*)\)")),
    ("def", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?\(?(?P<detail>[^)=]*)\)?\s*=>")),
]
_JS_CALL = re.compile(r"(?<![\w$.])(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_JS_WORDS = frozenset("if for while switch catch function return typeof new await async require import super else do".split())


_JS_EXPORT = re.compile(r"^\s*export\s+(?:declare\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?P<sort>function|class|const|let|var|interface|type|enum)\s*\*?\s*(?P<name>[\w$]+)")
_JS_EXPORT_LIST = re.compile(r"(?:^\s*export|module\.exports\s*=)\s*\{(?P<names>[^}]*)\}")
_JS_EXPORT_ONE = re.compile(r"(?:module\.)?exports\.(?P<name>[\w$]+)\s*=")
_SORTS = {"const": "variable", "let": "variable", "var": "variable"}


def _block_end(lines: list[str], at: int) -> int:
    """Number of the line at which the block that opens at line ``at`` (from 0) closes; the line itself without one."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i + 1
        if not opened and i > at:
            break
    return len(lines) if opened else at + 1


def _js_binds(detail: str | None, module: str) -> Iterator[tuple[str, str]]:
    """(local name, what it stands for) of the clause of an import."""
    clause = re.sub(r"^type\s+", "", detail or "")
    inner = re.search(r"\{([^}]*)\}", clause)
    for part in (inner[1] if inner else "").split(","):
        names = re.split(r"\s+as\s+|\s*:\s*", part.strip().removeprefix("type "))
        if names[0]:
            yield names[-1], f"{module}.{names[0]}"
    for part in re.sub(r"\{[^}]*\}", "", clause).split(","):
        name = re.sub(r"^\*\s*as\s+", "", part.strip())
        if re.fullmatch(r"[\w$]+", name):
            yield name, module


def _uses(lines: list[str], bound: set[str], skip: set[int]) -> Iterator[tuple]:
    """Uses of bound names in lines without comments and texts."""
    if not bound:
        return
    pattern = re.compile(r"(?<![\w$.])(?P<at>@?)(?P<name>" + "|".join(map(re.escape, sorted(bound, key=len, reverse=True))) + r")(?![\w$])(?P<next>\s*\(|(?:\s*\.\s*[\w$]+)+\s*\(|\s*\.)?")
    for i, line in enumerate(lines, 1):
        if i not in skip:
            for m in pattern.finditer(line):
                how = "decorator" if m["at"] else "name" if not m["next"] else "call" if m["next"].endswith("(") else "attribute"
                yield "use", m["name"], how, i, i


_TEXTS = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`")


def javascript_facts(text: str) -> Iterator[tuple]:
    """The same of a JavaScript or TypeScript file, statement by statement; comments and strings are blanked for calls."""
    clean = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    lines = [re.sub(r"(?<!:)//.*", "", line) for line in clean.splitlines()]
    bare = [_TEXTS.sub("''", line) for line in lines]
    bound, imports = set(), set()
    for i, code in enumerate(lines, 1):
        named = False
        for kind, pattern in _JS:
            if m := pattern.search(code):
                yield kind, m["name"], " ".join((m["detail"] or "").split()) or None, i, _block_end(bare, i - 1) if kind == "def" else i
                named = named or kind == "def"
                if kind == "import":
                    imports.add(i)
                    for local, target in _js_binds(m["detail"], m["name"]):
                        bound.add(local)
                        yield "bind", local, target, i, i
        for m in _JS_CALL.finditer(bare[i - 1]):
            if m["name"] not in _JS_WORDS and not (named and re.search(rf"function\s*\*?\s*{re.escape(m['name'])}\s*\(", code)):
                yield "call", m["name"], None, i, i
        if m := _JS_EXPORT.search(code):
            yield "export", m["name"], _SORTS.get(m["sort"], m["sort"]), i, i
        elif m := _JS_EXPORT_LIST.search(code):
            for part in m["names"].split(","):
                names = re.split(r"\s+as\s+", part.strip())
                if re.fullmatch(r"[\w$]+", public := names[-1].partition(":")[0].strip()):
                    yield "export", public, "name", i, i
        elif m := _JS_EXPORT_ONE.search(code):
            yield "export", m["name"], "name", i, i
    yield from _uses(bare, bound, imports)


_GO_CALL = re.compile(r"(?<![\w.])(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\(")
_GO_WORDS = frozenset("if for switch func return go defer select import var const type range append len cap make new panic print println string int".split())


def go_facts(text: str) -> Iterator[tuple]:
    """Imports (single and in blocks, with aliases), functions, calls, uses; names in capitals are exports."""
    clean = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    lines = [re.sub(r"(?<!:)//.*", "", line) for line in clean.splitlines()]
    bare = [re.sub(r"\"[^\"\n]*\"|`[^`\n]*`", '""', line) for line in lines]
    bound, imports, block = set(), set(), False
    for i, code in enumerate(lines, 1):
        if re.match(r"\s*import\s*\(", code):
            block = True
        m = re.match(r"\s*(?:import\s+)?(?P<alias>[\w.]+\s+)?\"(?P<name>[^\"]+)\"\s*$", code) if block or code.lstrip().startswith("import") else None
        if m:
            alias = (m["alias"] or "").strip()
            local = alias or re.sub(r"^v\d+$", "", m["name"].rpartition("/")[2]) or m["name"].split("/")[-2]
            imports.add(i)
            yield "import", m["name"], alias or None, i, i
            if local not in (".", "_"):
                bound.add(local)
                yield "bind", local, m["name"], i, i
        if block and ")" in code:
            block = False
        if m := re.match(r"func\s+(?:\([^)]*?\*?(?P<owner>\w+)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<args>[^)]*)", code):
            name = f"{m['owner']}.{m['name']}" if m["owner"] else m["name"]
            yield "def", name, m["args"].strip() or None, i, _block_end(bare, i - 1)
            if m["name"][0].isupper() and not m["owner"]:
                yield "export", m["name"], "function", i, i
        elif m := re.match(r"type\s+(?P<name>[A-Z]\w*)\s", code):
            yield "export", m["name"], "type", i, i
        if not re.match(r"\s*(?:func|import)\b", code) and i not in imports:
            for m in _GO_CALL.finditer(bare[i - 1]):
                if m["name"] not in _GO_WORDS:
                    yield "call", m["name"], None, i, i
    yield from _uses(bare, bound, imports)


def ruby_facts(text: str) -> Iterator[tuple]:
    """Requires, which bind the constant that their last part spells, methods and classes, calls, uses."""
    lines = [re.sub(r"(?<!['\"])#.*", "", line) for line in text.splitlines()]
    bound, imports = set(), set()
    for i, code in enumerate(lines, 1):
        if m := re.match(r"\s*(?P<how>require|require_relative|load|gem)\s*\(?\s*['\"](?P<name>[^'\"]+)['\"]", code):
            imports.add(i)
            yield "import", m["name"], m["how"], i, i
            last = m["name"].rpartition("/")[2].removesuffix(".rb")
            for local in {"".join(x[:1].upper() + x[1:] for x in re.split(r"[_-]", last)), last.upper()}:
                bound.add(local)
                yield "bind", local, m["name"], i, i
        elif m := re.match(r"\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)\s*\(?(?P<args>[^)]*)", code):
            indent = len(code) - len(code.lstrip())
            end = next((n for n in range(i, len(lines)) if re.match(rf"\s{{{indent}}}end\b", lines[n])), i - 1)
            yield "def", m["name"], m["args"].strip() or None, i, end + 1
            yield "export", m["name"], "method", i, i
        elif m := re.match(r"\s*(?P<sort>class|module)\s+(?P<name>[A-Z][\w:]*)", code):
            yield "export", m["name"], m["sort"], i, i
        if i not in imports:
            for m in re.finditer(r"(?<![\w.:])(?P<name>[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*[?!]?)+|[a-z_]\w*(?=\())", _TEXTS.sub("''", code)):
                yield "call", m["name"].replace("::", "."), None, i, i
    yield from _uses([_TEXTS.sub("''", x).replace("::", ".") for x in lines], bound, imports)


def facts_of(path: str, text: str) -> list[tuple]:
    """Facts of one file by its ending; a file that can't be read has none."""
    try:
        if path.endswith(".py"):
            return list(python_facts(text))
        if path.endswith((".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx")):
            return list(javascript_facts(text))
        if path.endswith(".go"):
            return list(go_facts(text))
        if path.endswith(".rb"):
            return list(ruby_facts(text))
    except (SyntaxError, ValueError, RecursionError):
        pass
    return []


def facts(files: DataFrame) -> DataFrame:
    """Facts of ``files`` (repo_id, path, text), see ``CODE``."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in CODE.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int32()] * 3
        for batch in batches:
            out = []
            for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "text")), strict=True):
                out += [(repo, path, *f, i) for i, f in enumerate(facts_of(path or "", text or ""))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return files.select("repo_id", "path", "text").mapInArrow(run, CODE)
