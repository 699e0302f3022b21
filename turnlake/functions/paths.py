"""Paths, file kinds, shell commands and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as which kind of file, by extension.
FILE_CATEGORIES = {
    "code": """py js ts tsx jsx go rs java kt swift c cc cpp h hpp cs rb php pl sh ps1 psm1
               bash zsh sql lua dart scala ex exs erl hs ml vue svelte astro r m mm""".split(),
    "markup": "html htm css scss sass less xml svg tpl twig blade jinja jinja2 ejs".split(),
    "config": """json yaml yml toml ini env conf cfg gradle tf tfvars properties lock
                 dockerfile editorconfig gitignore npmrc""".split(),
    "docs": "md mdx txt rst adoc org".split(),
    "data": "csv tsv jsonl ndjson parquet db sqlite".split(),
}
SOURCE_CATEGORIES = ("code", "markup")
READONLY_TOOLS = ("Read", "Grep", "Glob", "ToolSearch", "WebFetch", "WebSearch", "LS")
MUTATING_TOOLS = ("Edit", "Write", "NotebookEdit", "MultiEdit")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; null where the last part of the path has none."""
    base = F.element_at(F.split(_slashed(path), "/"), -1)
    return F.when(base.contains("."), F.concat(F.lit("."), F.lower(F.element_at(F.split(base, r"\."), -1))))


def file_category(ext: Column) -> Column:
    out, bare = None, F.ltrim(F.lower(F.coalesce(ext, F.lit(""))), F.lit("."))
    for category, names in FILE_CATEGORIES.items():
        hit = bare.isin(*names) & ext.startswith(".")
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")


def _slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def project_of(cwd: Column, folder: Column) -> Column:
    """The project of a session: the last part of its working folder, else the transcript folder's name as it is."""
    named = F.element_at(F.split(F.rtrim(_slashed(cwd), F.lit("/")), "/"), -1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(folder, F.lit("")), F.lit("unknown"))


def slug(text: Column, limit: int = 80) -> Column:
    """A name for files: runs of other characters than letters, digits, dot, dash and underline become one dash."""
    return F.left(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit(limit))


def shell_program(command: Column) -> Column:
    """The first program of a command's first line, without assignments before it, quotes and folders; at most 40 characters."""
    head = F.regexp_replace(F.split(F.regexp_replace(command, r"(?U)^\s+", ""), "\n")[0], r"^[(& ]+", "")
    words = F.filter(F.split(head, r"(?U)\s+"), lambda w: (w != "") & ~(w.contains("=") & ~w.startswith("-")))
    name = _slashed(F.regexp_replace(F.get(words, F.lit(0)), "^[\"']+|[\"']+$", ""))
    return F.nullif(F.left(F.element_at(F.split(name, "/"), -1), F.lit(40)), F.lit(""))
