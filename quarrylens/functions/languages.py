"""Languages by extension and by exact file name, and the file classes that are never indexed."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.functions.text import extension, file_name

# fixed values: extensions and exact names of the supported languages
EXTENSIONS = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "s": "assembly", "asm": "assembly",
    "sql": "sql", "json": "json", "jsonc": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "xml": "xml", "xsd": "xml", "xsl": "xml", "xslt": "xml", "plist": "xml",
    "csproj": "xml", "props": "xml", "targets": "xml", "css": "css", "less": "less", "sh": "bash", "bash": "bash", "zsh": "zsh", "hcl": "hcl", "tf": "hcl", "tfvars": "hcl", "proto": "proto",
    "graphql": "graphql", "gql": "graphql", "mk": "make", "cmake": "cmake", "bzl": "starlark", "vue": "vue", "astro": "astro", "svelte": "svelte",
}
EXACT_NAMES = {"Dockerfile": "containerfile", "Containerfile": "containerfile", "Makefile": "make", "makefile": "make", "GNUmakefile": "make", "CMakeLists.txt": "cmake", "BUILD": "starlark", "WORKSPACE": "starlark"}
# fixed values: directories that no walk enters, and those that a walk enters only when asked to
ALWAYS_EXCLUDED_DIRS = [".git", ".svn", ".hg", ".bzr", ".jj", ".sl", ".quarrylens"]
JUNK_DIRS = ["node_modules", ".yarn", "target", "dist", "build", "vendor"]
MAX_INDEXED_BYTES = 1_048_576
# fixed values: file classes that are never indexed
_EXCLUDED_FILE = r"(?i)(?:\.lock|\.map|\.min\.(?:js|mjs|cjs|css|html)|\.bundle\.(?:js|mjs|cjs|css))$|^(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|bun\.lockb)$"
_PROSE_FILE = r"(?i)\.(?:md|mdx|txt)$"
# fixed values: first words of import lines, by language
IMPORT_LINE = {
    "python": r"^\s*(?:import|from)\s", "javascript": r"^\s*(?:import\s|export\s.*\sfrom\s|.*\brequire\()", "typescript": r"^\s*(?:import\s|export\s.*\sfrom\s|.*\brequire\()", "go": r"^\s*(?:import\b|\"[^\"]+\"$)",
    "rust": r"^\s*(?:pub\s+)?(?:use|extern\s+crate)\s", "java": r"^\s*import\s", "kotlin": r"^\s*import\s", "c": r"^\s*#\s*include\b", "cpp": r"^\s*#\s*include\b",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def language_of_path(path: Column) -> Column:
    """Exact file name first, then extension; null where neither is known."""
    return F.coalesce(_lookup(file_name(path), EXACT_NAMES), _lookup(extension(path), EXTENSIONS))


def is_excluded_file(path: Column) -> Column:
    """Locks, source maps, minified and bundled assets, and prose (but not CMakeLists.txt)."""
    name = file_name(path)
    return name.rlike(_EXCLUDED_FILE) | (name.rlike(_PROSE_FILE) & (name != "CMakeLists.txt"))


def in_junk_dir(path: Column, include_ignored: bool = False, more: tuple[str, ...] = ()) -> Column:
    """Does the path lie below a directory that walks leave out."""
    names = [*ALWAYS_EXCLUDED_DIRS, *([] if include_ignored else JUNK_DIRS), *more]
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(names))


def is_import_line(language: Column, line: Column) -> Column:
    out = F.lit(False)
    for lang, pattern in IMPORT_LINE.items():
        out = out | ((language == lang) & line.rlike(pattern))
    return F.coalesce(out, F.lit(False))


# fixed values: names by which a language hint may be given
LANGUAGE_ALIASES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "golang": "go", "kt": "kotlin", "c++": "cpp", "cxx": "cpp", "sh": "bash", "shell": "bash", "yml": "yaml", "tf": "hcl", "terraform": "hcl", "asm": "assembly"}


def normalize_language_hint(hint: str | None) -> str | None:
    h = (hint or "").strip().lower().lstrip(".")
    return LANGUAGE_ALIASES.get(h) or (h if h in set(EXTENSIONS.values()) else None)
