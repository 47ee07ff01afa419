"""Repository addresses and file paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists.
IGNORED_DIRECTORIES = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "target", "coverage", "generated", "vendor")
LANGUAGE_BY_SUFFIX = {
    ".py": "Python",
    ".c": "C",
    ".h": "C",
    ".cc": "C++",
    ".cpp": "C++",
    ".cxx": "C++",
    ".hpp": "C++",
    ".java": "Java",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".go": "Go",
    ".rs": "Rust",
    ".html": "HTML",
    ".htm": "HTML",
    ".css": "CSS",
    ".sql": "SQL",
    ".md": "Markdown",
    ".mdx": "Markdown",
    ".json": "JSON",
    ".yaml": "YAML",
    ".yml": "YAML",
}
#: Patterns of a name in lower case: never read, and its last suffix.
IGNORED_NAME = r"^\.env$|^\.env\.|\.min\.|\.generated\.|\.map$"
SUFFIX = r"[^.](\.[^.]+)$"


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def repository_address(url: Column, host: str = "github.com") -> Column:
    """struct(canonical_url, name) of https://host/owner/name[.git], null for anything else: another scheme or host, a
    port, user, query or fragment, or another number of path parts. White space around it and an empty query or fragment
    do not count."""
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = _parts(path)
    owner, name = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    ok = (scheme == "https") & (F.lower(authority) == host) & (F.size(parts) == 2) & (name != "") & ~url.rlike(r"\?[^#]|#.|;")
    return F.when(ok, F.struct(F.concat(F.lit(f"https://{host}/"), owner, F.lit("/"), name, F.lit(".git")).alias("canonical_url"), name.alias("name")))


def ignored_path(path: Column) -> Column:
    """Whether a parent directory is one that is never read, or the file is an environment, minified, generated or map file."""
    parts = F.split(path, "/")
    parents, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower(F.element_at(parts, -1))
    return F.arrays_overlap(parents, F.array(*map(F.lit, IGNORED_DIRECTORIES))) | name.rlike(IGNORED_NAME)


def language(path: Column) -> Column:
    """The language of a path's last suffix, null if there is none for it."""
    suffix = F.regexp_extract(F.lower(F.element_at(F.split(path, "/"), -1)), SUFFIX, 1)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])
    return F.try_element_at(table, suffix)


def indexed_path(path: Column) -> Column:
    """A relative path in normal form (a/./b and a//b are a/b); null for empty and absolute paths, backslashes, a
    leading ./ and .. anywhere."""
    parts = F.split(path, "/")
    bad = (F.trim(path) == "") | path.contains("\\") | path.startswith("/") | path.startswith("./") | F.array_contains(parts, "..")
    normal = F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/")
    return F.when(~bad & (normal != ""), normal)
