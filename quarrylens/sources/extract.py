"""Extraction of symbols, literals, docstrings, calls, imports and edges from source text.

Languages are data: a registry of rules that an Arrow-batched ``mapInPandas`` applies, one row out a file. Python goes
through its own parser; brace languages through declaration patterns over text whose strings and comments are masked and a
bracket matcher; formats give their keys and their whole text. A file that fails gives an error text, never an exception.

Without a general parser library the rules cover declarations that begin a line; nested one-line declarations,
macros that make symbols and overloads by continuation lines aren't seen.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = """file_id long, file_path string, total_lines int, error string,
 symbols array<struct<name:string,kind:string,start_line:int,start_col:int,end_line:int,end_col:int,docstring:string,owner:string,has_todo:boolean,has_fixme:boolean,is_test:boolean,is_exported:boolean,is_deprecated:boolean>>,
 literals array<struct<text:string,line:int>>, docstrings array<string>, calls array<struct<name:string,receiver:string,line:int>>,
 imports array<struct<name:string,source:string,kind:string,line:int>>, edges array<struct<kind:string,owner:string,field:string,line:int>>, format_text string"""


@dataclass
class LanguageRules:
    """How declarations, exports, tests, comments and imports of a language look; each declaration pattern has a group "n"."""

    declarations: list[tuple[str, str]]
    exported: str = r"\bexport\b|\bpub\b|\bpublic\b"
    comment: str = r"//"
    quotes: str = "\"'`"
    imports: list[tuple[str, str]] = field(default_factory=list)
    containers: str = r"\b(?:class|struct|impl|interface|trait|enum|object)\s+(?:<[^>]*>\s*)?(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)"
    doc: str = "//"


_ID = r"(?P<n>[A-Za-z_$][\w$]*)"
_JS = LanguageRules(
    [
        (rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}\s*(?:<[^>]*>)?\(", "fn"),
        (rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}", "class"),
        (rf"(?:export\s+)?interface\s+{_ID}", "interface"),
        (rf"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{_ID}", "enum"),
        (rf"(?:export\s+)?type\s+{_ID}\s*(?:<[^>]*>)?\s*=", "type"),
        (rf"(?:export\s+)?(?:const|let|var)\s+{_ID}\b", "variable"),
        (rf"\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_ID}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{", "method"),
        (r"\s*(?:describe|it|test)\s*\(\s*[\"'`](?P<n>[^\"'`]+)", "test"),
    ],
    exported=r"^\s*export\b",
    imports=[(r"import\s+(?:type\s+)?(?:\*\s+as\s+(?P<n>\w+)|(?P<n2>[\w$]+)|\{\s*(?P<n3>[^}]*?)\s*\})?[^\"']*[\"'](?P<s>[^\"']+)[\"']", "import"), (r"(?:const|let|var)\s+(?P<n>\w+)\s*=\s*require\([\"'](?P<s>[^\"']+)", "require")],
)
REGISTRY: dict[str, LanguageRules] = {
    "javascript": _JS,
    "typescript": _JS,
    "go": LanguageRules(
        [(rf"func\s+\([^)]*\)\s*{_ID}\s*\(", "fn"), (rf"func\s+{_ID}\s*(?:\[[^\]]*\])?\(", "fn"), (rf"type\s+{_ID}\s+struct\b", "struct"), (rf"type\s+{_ID}\s+interface\b", "interface"), (rf"type\s+{_ID}\b", "type"), (rf"const\s+{_ID}\b", "const"), (rf"var\s+{_ID}\b", "variable")],
        exported=r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|const\s+|var\s+)[A-Z]",
        imports=[(r"import\s+(?:(?P<n>[\w.]+)\s+)?\"(?P<s>[^\"]+)\"", "import"), (r"\s+(?:(?P<n>[\w.]+)\s+)?\"(?P<s>[^\"]+)\"$", "import")],
        containers=r"func\s+\(\w*\s*\*?(?P<n>\w+)",
    ),
    "rust": LanguageRules(
        [
            (r"(?:unsafe\s+)?impl(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s+(?:!?[\w:]+(?:<(?:[^<>]|<[^<>]*>)*>)?\s+for\s+)?(?:&(?:'\w+\s+)?(?:mut\s+)?)?(?:\w+::)*(?P<n>[A-Za-z_]\w*)", "struct"),
            (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+{_ID}", "fn"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}", "struct"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}", "enum"),
            (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_ID}", "trait"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?{_ID}\s*:", "const"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+{_ID}", "mod"), (rf"\s*(?:pub(?:\([^)]*\))?\s+)?type\s+{_ID}", "type"), (rf"\s*macro_rules!\s*{_ID}", "fn"),
        ],
        exported=r"^\s*pub\b",
        quotes='"',
        imports=[(r"\s*(?:pub\s+)?use\s+(?P<s>[\w:]+)(?:::(?P<n>\w+|\*|\{[^}]*\}))?;", "use")],
    ),
    "java": LanguageRules(
        [
            (rf"\s*(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*class\s+{_ID}", "class"), (rf"\s*(?:(?:public|private|protected|static)\s+)*interface\s+{_ID}", "interface"), (rf"\s*(?:(?:public|private|protected|static)\s+)*enum\s+{_ID}", "enum"), (rf"\s*(?:(?:public|private|protected|static)\s+)*record\s+{_ID}", "record"),
            (rf"\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)[\w.<>\[\], ?]+\s+{_ID}\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?\{{", "method"), (rf"\s+(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w.<>\[\], ?]+\s+{_ID}\s*[=;]", "field"),
        ],
        exported=r"\bpublic\b",
        imports=[(r"import\s+(?:static\s+)?(?P<s>[\w.]+)\.(?P<n>\w+|\*);", "import")],
    ),
    "kotlin": LanguageRules(
        [(rf"\s*(?:[\w@]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_ID}\s*\(", "fn"), (rf"\s*(?:[\w@]+\s+)*class\s+{_ID}", "class"), (rf"\s*(?:[\w@]+\s+)*interface\s+{_ID}", "interface"), (rf"\s*(?:[\w@]+\s+)*object\s+{_ID}", "object"), (rf"\s*(?:[\w@]+\s+)*(?:val|var)\s+{_ID}", "property"), (rf"typealias\s+{_ID}", "type")],
        exported=r"^(?!.*\b(?:private|internal|protected)\b)",
        imports=[(r"import\s+(?P<s>[\w.]+)\.(?P<n>\w+|\*)", "import")],
    ),
    "c": LanguageRules(
        [(rf"(?:static\s+|inline\s+|extern\s+|const\s+|unsigned\s+|struct\s+)*[A-Za-z_]\w*[\s*]+{_ID}\s*\([^;]*\)\s*\{{", "fn"), (rf"(?:typedef\s+)?struct\s+{_ID}\s*\{{", "struct"), (rf"(?:typedef\s+)?enum\s+{_ID}", "enum"), (rf"#\s*define\s+{_ID}", "const"), (rf"(?:static\s+)?(?:const\s+)+[\w\s*]*?[\s*]{_ID}\s*(?:\[[^\]]*\])?\s*=", "const"), (rf"typedef\s+[^;{{]*?{_ID}\s*;", "type")],
        exported=r"^(?!.*\bstatic\b)",
        imports=[(r"#\s*include\s*[<\"](?P<s>[^>\"]+)[>\"]", "include")],
    ),
}
REGISTRY["cpp"] = LanguageRules([*REGISTRY["c"].declarations, (rf"\s*(?:template\s*<[^>]*>\s*)?class\s+{_ID}", "class"), (rf"namespace\s+{_ID}", "mod"), (rf"[\w:<>*& ]+\s+[\w:]+::{_ID}\s*\([^;]*\)\s*(?:const\s*)?\{{", "fn"), (rf"\s+(?!(?:else|return|new|throw|case)\b)[\w:<>*& ]+[\s*&]+(?!(?:if|for|while|switch|catch)\b){_ID}\s*\([^;]*\)\s*(?:(?:const|noexcept|override|final)\s*)*\{{", "method")], exported=r"^(?!.*\bstatic\b)", imports=REGISTRY["c"].imports)
LINE_RULES: dict[str, list[tuple[str, str]]] = {
    "bash": [(r"\s*(?:function\s+)?(?P<n>[\w-]+)\s*\(\)\s*\{?", "fn"), (r"(?:export\s+|readonly\s+|local\s+)?(?P<n>[A-Za-z_]\w*)=", "variable")],
    "sql": [(r"(?i)\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(?P<n>[\w.]+)", "struct"), (r"(?i)\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(?P<n>[\w.]+)", "type"), (r"(?i)\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\"`\[]?(?P<n>[\w.]+)", "fn")],
    "css": [(r"\s*(?P<n>--[\w-]+)\s*:", "const"), (r"(?P<n>[.#][\w-]+)[^{;]*\{", "type"), (r"\s+(?P<n>[a-z-]+)\s*:[^{;]+;", "property")],
    "less": [(r"\s*@(?P<n>[\w-]+)\s*:", "variable"), (r"\s*\.(?P<n>[\w-]+)\([^)]*\)\s*\{", "fn"), (r"(?P<n>[.#][\w-]+)[^{;]*\{", "type")],
    "json": [(r"\s*\"(?P<n>[^\"]+)\"\s*:", "property")],
    "yaml": [(r"\s*(?:-\s+)?(?P<n>[A-Za-z_][\w.-]*)\s*:(?:\s|$)", "property")],
    "toml": [(r"\s*\[+(?P<n>[\w.\"-]+)\]+", "type"), (r"\s*(?P<n>[\w.-]+)\s*=", "property")],
    "hcl": [(r"\s*\w+\s+\"[^\"]*\"\s+\"(?P<n>[^\"]+)\"\s*\{", "type"), (r"\s*\w+\s+\"(?P<n>[^\"]+)\"\s*\{", "type"), (r"\s*(?P<n>[\w-]+)\s*=(?!=)", "property")],
    "xml": [(r"\s*<(?P<n>[A-Za-z_][\w.:-]*)(?=[\s>/])", "type")],
    "html": [(r".*?<(?P<n>[A-Za-z][\w-]*)(?=[\s>/])", "type"), (r".*?\bid=\"(?P<n>[^\"]+)\"", "field")],
    "graphql": [(r"\s*(?:type|interface|input|enum|union|scalar)\s+(?P<n>\w+)", "type"), (r"\s+(?P<n>\w+)\s*(?:\([^)]*\))?\s*:", "field")],
    "proto": [(r"\s*(?:message|enum|service)\s+(?P<n>\w+)", "type"), (r"\s*rpc\s+(?P<n>\w+)", "fn"), (r"\s+(?:repeated\s+|optional\s+)?[\w.]+\s+(?P<n>\w+)\s*=\s*\d+", "field")],
    "make": [(r"(?P<n>[A-Za-z_][\w.-]*)\s*:(?!=)", "fn"), (r"(?P<n>[A-Za-z_]\w*)\s*[:?+]?=", "variable")],
    "cmake": [(r"(?i)\s*(?:function|macro)\s*\(\s*(?P<n>\w+)", "fn"), (r"(?i)\s*set\s*\(\s*(?P<n>\w+)", "variable"), (r"(?i)\s*add_(?:executable|library)\s*\(\s*(?P<n>[\w-]+)", "type")],
    "containerfile": [(r"(?i)from\s+\S+\s+as\s+(?P<n>\w+)", "type"), (r"(?i)(?:arg|env)\s+(?P<n>\w+)", "variable")],
    "starlark": [(r"def\s+(?P<n>\w+)\s*\(", "fn"), (r"(?P<n>[A-Z_]\w*)\s*=", "const")],
    "assembly": [(r"(?P<n>[A-Za-z_.$][\w.$]*):", "fn"), (r"\s*\.macro\s+(?P<n>\w+)", "fn"), (r"\s*\.equ\s+(?P<n>\w+)", "const")],
}
LINE_RULES["zsh"] = LINE_RULES["bash"]
FORMATS = frozenset({"json", "yaml", "toml", "xml", "html", "hcl", "graphql", "proto", "make", "cmake", "containerfile", "starlark", "css", "less", "sql", "bash"})
# fixed values: calls that write to and read from a collection held in a field, by language
EDGE_CALLS = {
    "rust": ("push push_back insert extend extend_from_slice", "iter iter_mut into_iter get first last"),
    "java": ("add addAll put putAll offer push enqueue", "iterator stream forEach get values keySet entrySet"),
    "kotlin": ("add addAll put putAll offer push enqueue", "iterator forEach get first last asSequence"),
    "python": ("append extend insert add update put", ""),
    "cpp": ("push_back emplace_back insert emplace push", "begin end cbegin cend front back at"),
    "go": ("append", ""),
}
MOST_EDGES = 256
_EDGE = re.compile(r"(?<![\w.>:])(?P<r>[A-Za-z_]\w*)(?:\.|->)(?P<f>[A-Za-z_]\w*)(?:\.|->)(?P<m>[A-Za-z_]\w*)\s*\(")
_APPEND = re.compile(r"\bappend\(\s*(?P<r>[A-Za-z_]\w*)\.(?P<f>[A-Za-z_]\w*)\s*,")
# how a parameter of a name is written: with its type after a colon, after a blank, or before it
_TYPED = {"rust": r"\b{}\s*:\s*(?P<t>[^,)=]+)", "python": r"\b{}\s*:\s*(?P<t>[^,)=]+)", "kotlin": r"\b{}\s*:\s*(?P<t>[^,)=]+)", "go": r"[(,]\s*{}\s+(?P<t>[^,)]+)", "java": r"[(,]\s*(?:final\s+)?(?P<t>[^(),]*?[\w>\]])\s+{}\s*[,)]", "cpp": r"[(,]\s*(?P<t>[^(),]*?[\w>&*])[\s&*]+{}\s*[,)]"}
_PY_MASK = re.compile(r"#[^\n]*|\"{3}(?:[^\"\\]|\\.|\"(?!\"\"))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


def collection_edges(masked: str, symbols: list[dict], language: str) -> list[dict]:
    """Writes to and reads from collections in fields: (kind, owner, field, line), the owner being the type whose field it is: that of the
    method around for ``self`` and ``this``, that of a parameter by its declared type. Where neither tells the type there is no edge.
    At most ``MOST_EDGES`` a file, each once a line."""
    if language not in EDGE_CALLS:
        return []
    from quarrylens.functions.structured import owner_type

    writes, reads = (frozenset(x.split()) for x in EDGE_CALLS[language])
    breaks = [m.start() for m in re.finditer("\n", masked)]
    lines = masked.split("\n")
    functions = sorted((s for s in symbols if s["kind"] in ("fn", "method", "function")), key=lambda s: s["end_line"] - s["start_line"])
    out: list[dict] = []
    seen = set()
    for m in sorted([*_EDGE.finditer(masked), *(_APPEND.finditer(masked) if language == "go" else [])], key=lambda m: m.start()):
        call = m.groupdict().get("m") or "append"
        kind = "producer" if call in writes else "consumer" if call in reads else None
        line = bisect_left(breaks, m.start()) + 1
        around = next((f for f in functions if f["start_line"] <= line <= f["end_line"]), None)
        if not kind or around is None:
            continue
        if m["r"] in ("self", "this"):
            owner = around["owner"]
        else:
            header = re.split(r"[{;]|:\s*$", "\n".join(lines[around["start_line"] - 1 : min(around["end_line"], around["start_line"] + 20)]), maxsplit=1, flags=re.M)[0]
            typed = re.search(_TYPED[language].format(re.escape(m["r"])), header)
            owner = owner_type(typed["t"].strip()) if typed else None
        edge = (kind, owner, m["f"], line)
        if owner and edge not in seen and len(out) < MOST_EDGES:
            seen.add(edge)
            out.append(dict(zip(("kind", "owner", "field", "line"), edge)))
    return out


_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_CALL = re.compile(r"(?:(?P<r>[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)(?:\.|::|->))?(?P<n>[A-Za-z_$][\w$]*)!?\s*\(")
_NO_CALL = frozenset("if for while switch catch return function fn func def class new await typeof sizeof match with elif and or not in is lambda print assert".split()) - {"print"}


def mask(text: str) -> str:
    """Text of the same length with comments and strings blanked."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def end_of_block(masked: str, at: int) -> int:
    """Position after the bracket block that opens next, or after the statement where none does."""
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth == 0 and c == "}":
                return i + 1
            if depth < 0:
                return i
        elif depth == 0 and (c == ";" or c == "\n" and not re.match(r"\s*[{.=:|&+]", masked[i + 1 : i + 40])):
            return i + 1 if c == ";" else i
    return len(masked)


def _comment_above(lines: list[str], at: int) -> list[str]:
    out: list[str] = []
    i = at - 1
    while i >= 0 and re.match(r"\s*(?://|/\*|\*|#(?!include|define)|@\w|#\[)", lines[i]):
        out.append(lines[i].strip())
        i -= 1
    return out[::-1]


def clean_doc(comment: list[str], plain: bool = False) -> str | None:
    """Text of documentation comments; plain ones only where the language has no others."""
    kept = []
    block = False
    for line in comment:
        if line.startswith("/**"):
            block = True
        if re.match(r"///|//!", line):
            kept.append(re.sub(r"^(?:///+|//!)\s?", "", line).strip())
        elif plain and line.startswith("//"):
            kept.append(line[2:].strip())
        elif block:
            kept.append(re.sub(r"^/?\*+\s?|\s*\*+/$", "", line).strip())
        if line.endswith("*/"):
            block = False
    text = "\n".join(kept).strip()
    return text or None


def _is_test_path(path: str) -> bool:
    low = path.lower()
    name = low.rpartition("/")[2]
    return bool(re.search(r"(?:^|/)tests?/", low)) or name.startswith("test_") or any(x in name for x in ("_test.", ".test.", "_spec.", ".spec."))


def _flags(text: str, comment: str, name: str, path: str, exported: bool) -> dict:
    both = f"{comment}\n{text}".lower()
    test = _is_test_path(path) or bool(re.match(r"(?i)test[_A-Z]|(?:Test|Benchmark|Example|Fuzz)[A-Z]", name)) or name.endswith("_test") or "@test" in both or "#[test]" in both
    return {"has_todo": "todo" in both, "has_fixme": "fixme" in both, "is_test": test, "is_exported": exported, "is_deprecated": "deprecated" in comment.lower()}


def _python(text: str, path: str) -> dict:
    tree = ast.parse(text)
    lines = text.split("\n")
    out: dict[str, list] = {"symbols": [], "literals": [], "docstrings": [], "calls": [], "imports": [], "edges": []}
    docs: set[int] = set()

    def visit(node: ast.AST, owner: str | None, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                doc = ast.get_docstring(child)
                if doc is not None and isinstance(child.body[0], ast.Expr):
                    docs.add(id(child.body[0].value))
                    out["docstrings"].append(doc)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                above = "\n".join(_comment_above(lines, first - 1))
                deco = "\n".join(ast.unparse(d) for d in child.decorator_list)
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                flags = _flags(body, f"{above}\n{deco}\n{doc or ''}", child.name, path, not child.name.startswith("_") and not inside)
                flags["is_test"] = flags["is_test"] or "test" in deco
                kind = "class" if isinstance(child, ast.ClassDef) else "fn"
                out["symbols"].append({"name": child.name, "kind": kind, "start_line": child.lineno, "start_col": child.col_offset + 1, "end_line": child.end_lineno, "end_col": child.end_col_offset + 1, "docstring": doc, "owner": owner if kind == "fn" else None, **flags})
                visit(child, child.name if kind == "class" else None, inside or kind == "fn")
                continue
            if isinstance(child, (ast.Assign, ast.AnnAssign)) and isinstance(node, (ast.Module, ast.ClassDef)):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name):
                        kind = "variable" if isinstance(node, ast.Module) else "field"
                        out["symbols"].append({"name": t.id, "kind": kind, "start_line": child.lineno, "start_col": child.col_offset + 1, "end_line": child.end_lineno, "end_col": child.end_col_offset + 1, "docstring": None, "owner": owner if kind == "field" else None, **_flags("", "", t.id, path, not t.id.startswith("_"))})
            if isinstance(child, ast.Constant) and isinstance(child.value, str) and id(child) not in docs:
                out["literals"].append({"text": child.value, "line": child.lineno})
            if isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    out["calls"].append({"name": f.id, "receiver": None, "line": child.lineno})
                elif isinstance(f, ast.Attribute):
                    out["calls"].append({"name": f.attr, "receiver": ast.unparse(f.value), "line": child.lineno})
            if isinstance(child, ast.Import):
                out["imports"] += [{"name": a.asname or a.name, "source": a.name, "kind": "namespace", "line": child.lineno} for a in child.names]
            if isinstance(child, ast.ImportFrom):
                out["imports"] += [{"name": a.asname or a.name, "source": "." * child.level + (child.module or ""), "kind": "glob" if a.name == "*" else "named", "line": child.lineno} for a in child.names]
            visit(child, owner, inside)

    doc = ast.get_docstring(tree)
    if doc:
        out["docstrings"].append(doc)
        docs.add(id(tree.body[0].value))
    visit(tree, None, False)
    out["edges"] = collection_edges(_PY_MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text), out["symbols"], "python")
    return out


def import_entries(line: str, rules: LanguageRules, line_no: int) -> list[dict]:
    """Imports that a line names: one entry a name; without names the source itself."""
    for pattern, kind in rules.imports:
        m = re.match(pattern, line)
        if not m:
            continue
        g = m.groupdict()
        names = [n for n in (g.get("n"), g.get("n2")) if n]
        many = g.get("n3") or (names[0][1:-1] if names and names[0].startswith("{") else None)
        if many is not None:
            names = [re.sub(r".*\bas\s+", "", x.strip()) for x in many.split(",") if x.strip()]
        names = names or [re.split(r"[/:.]+", g["s"].rstrip("/"))[-1]]
        return [{"name": n, "source": g["s"], "kind": "glob" if n == "*" else kind, "line": line_no} for n in names]
    return []


def _braces(text: str, path: str, language: str) -> dict:
    rules = REGISTRY[language]
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_at = lambda at: bisect_left(breaks, at) + 1
    masked, lines = mask(text), text.split("\n")
    out: dict[str, list] = {"symbols": [], "literals": [], "docstrings": [], "calls": [], "imports": [], "edges": []}
    masked_lines = masked.split("\n")
    start = 0
    scopes: list[tuple[int, str]] = []  # (end, name) of the containers around
    # a pattern is tried only where the signs that it ends with stand in the line
    compiled = [(re.compile(p), k, p.endswith(r"\{"), p.endswith(r"\(") or r"\([^;]*\)" in p) for p, k in rules.declarations]
    for i, (line, m_line) in enumerate(zip(lines, masked_lines)):
        while scopes and start >= scopes[-1][0]:
            scopes.pop()
        if "import" in line or "use" in line or "require" in line or "include" in line or language == "go" and '"' in line:
            out["imports"] += import_entries(line, rules, i + 1)
        source = line if language in ("javascript", "typescript") and re.match(r"\s*(?:describe|it|test)\s*\(", line) else m_line
        head = m_line.lstrip()[:1]
        if not (head.isalpha() or head in "_@#$" and head):
            compiled_here = []
        else:
            brace, paren = "{" in m_line, "(" in m_line
            compiled_here = [x for x in compiled if (brace or not x[2]) and (paren or not x[3])]
        for p, kind, _, _ in compiled_here:
            m = p.match(source)
            if not m:
                continue
            end = end_of_block(masked, start + len(m_line) - len(m_line.lstrip()))
            comment = _comment_above(lines, i)
            doc = clean_doc(comment, plain=language == "go")
            owner = scopes[-1][1] if scopes and kind in ("fn", "method", "field") else None
            if language == "go" and (r := re.match(rules.containers, m_line)):
                owner = r["n"]
            end_line = line_at(end)
            end_col = end - (text.rfind("\n", 0, end) + 1) + 1
            col = len(line) - len(line.lstrip()) + 1
            exported = bool(re.search(rules.exported, m_line))
            out["symbols"].append({"name": m["n"], "kind": kind, "start_line": i + 1, "start_col": col, "end_line": end_line, "end_col": end_col, "docstring": doc, "owner": owner, **_flags(text[start:end], "\n".join(comment), m["n"], path, exported)})
            if doc:
                out["docstrings"].append(doc)
            break
        c = re.search(rules.containers, m_line) if language != "go" and "{" in m_line else None
        if c:
            scopes.append((end_of_block(masked, start + c.start()), c["n"]))
        start += len(line) + 1
    for m in _MASK.finditer(text):
        s = m[0]
        if s[0] in rules.quotes and len(s) >= 2:
            out["literals"].append({"text": s[1:-1], "line": line_at(m.start())})
    for m in _CALL.finditer(masked):
        if m["n"] not in _NO_CALL:
            out["calls"].append({"name": m["n"], "receiver": m["r"], "line": line_at(m.start())})
    out["edges"] = collection_edges(masked, out["symbols"], language)
    return out


def _line_format(text: str, path: str, language: str) -> dict:
    out: dict[str, list] = {"symbols": [], "literals": [], "docstrings": [], "calls": [], "imports": [], "edges": []}
    for i, line in enumerate(text.split("\n")):
        for p, kind in LINE_RULES[language]:
            m = re.match(p, line)
            if m:
                out["symbols"].append({"name": m["n"], "kind": kind, "start_line": i + 1, "start_col": m.start("n") + 1, "end_line": i + 1, "end_col": len(line.rstrip("\r")) + 1, "docstring": None, "owner": None, **_flags(line, "", m["n"], path, True)})
                break
    return out


_SCRIPT = re.compile(r"(<script\b[^>]*>)(.*?)</script>", re.S | re.I)
_FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---", re.S)


def script_mask(text: str, extension: str) -> str:
    """The script parts of a composite file at their own places, everything else blanked: lines and columns are kept."""
    keep = [m.span(2) for m in _SCRIPT.finditer(text)]
    if extension == "astro" and (m := _FRONT.match(text)):
        keep.append(m.span(1))
    out = [c if c == "\n" else " " for c in text]
    for a, b in keep:
        out[a:b] = text[a:b]
    return "".join(out)


EMPTY = {"symbols": [], "literals": [], "docstrings": [], "calls": [], "imports": [], "edges": []}


def extract_file(path: str, text: str | None, language: str | None) -> dict:
    """Everything of one file; an unknown language gives empty lists, a failure an error text."""
    base: dict = {"file_path": path, "total_lines": len(text.splitlines()) if text else 0, "error": None, "format_text": None, **EMPTY}
    if not text or language is None:
        return base
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    try:
        if language == "python":
            base |= _python(text, path)
        elif language in ("vue", "astro", "svelte"):
            base |= _braces(script_mask(text, language), path, "typescript")
        elif language in REGISTRY:
            base |= _braces(text, path, language)
        elif language in LINE_RULES:
            base |= _line_format(text, path, language)
    except (SyntaxError, ValueError, RecursionError) as e:
        base["error"] = f"{type(e).__name__}: {e}"[:200]
    if language in FORMATS:
        base["format_text"] = text
    return base


def extract(files: DataFrame) -> DataFrame:
    """One row a file of (file_id, file_path, content): see ``SCHEMA``. The language is told by built-in expressions before the
    text reaches Python."""
    from quarrylens.functions.languages import language_of_path

    cols = [c.split(" ")[0].strip() for c in ("file_id", "file_path", "total_lines", "error", "symbols", "literals", "docstrings", "calls", "imports", "edges", "format_text")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"file_id": i, **extract_file(p, t, g)} for i, p, t, g in zip(f["file_id"], f["file_path"], f["content"], f["language"])]
            yield pd.DataFrame(rows, columns=cols)

    d = files.select("file_id", "file_path", "content", language_of_path(F.col("file_path")).alias("language"))
    return d.mapInPandas(run, SCHEMA)
