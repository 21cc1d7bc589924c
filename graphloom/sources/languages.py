"""Languages by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension, and by whole name.
EXTENSIONS = {
    "py": "Python", "pyi": "Python", "go": "Go", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "java": "Java", "kt": "Kotlin", "kts": "Kotlin",
    "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "cs": "C#", "rs": "Rust", "rb": "Ruby", "php": "PHP", "swift": "Swift", "scala": "Scala", "m": "Objective-C", "mm": "Objective-C",
    "lua": "Lua", "pl": "Perl", "pm": "Perl", "r": "R", "jl": "Julia", "hs": "Haskell", "ml": "OCaml", "mli": "OCaml", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "clj": "Clojure", "dart": "Dart", "zig": "Zig",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "sql": "SQL", "html": "HTML", "css": "CSS", "scss": "SCSS", "vue": "Vue", "svelte": "Svelte", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML",
    "md": "Markdown", "tf": "HCL", "hcl": "HCL", "proto": "Protocol Buffers", "graphql": "GraphQL", "gql": "GraphQL", "groovy": "Groovy", "gradle": "Groovy", "fs": "F#", "vb": "Visual Basic", "cu": "CUDA", "v": "Verilog", "sv": "SystemVerilog", "vhd": "VHDL", "asm": "Assembly", "s": "Assembly",
}
NAMES = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "CMakeLists.txt": "CMake", "Jenkinsfile": "Groovy", "Rakefile": "Ruby", "Gemfile": "Ruby", "BUILD": "Starlark", "WORKSPACE": "Starlark"}


def language_of(path: Column) -> Column:
    """The language of a path, or an empty text. The tables are literals of the expression, so nothing is joined."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    by_name, by_extension = (F.create_map(*(F.lit(x) for pair in t.items() for x in pair)) for t in (NAMES, EXTENSIONS))
    extension = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.coalesce(F.try_element_at(by_name, name), F.try_element_at(by_extension, extension), F.try_element_at(by_extension, F.lower(extension)), F.lit(""))
