"""Column functions on texts, paths, names and versions; all of them stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of languages, and extensions with the language they stand for.
LANGUAGE_LABELS = {"python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "json": "JSON", "yaml": "YAML", "html": "HTML", "css": "CSS", "sql": "SQL", "toml": "TOML"}
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript"}
PARSED_EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
REPOSITORY_URL = r"^(?:https?://|git@|ssh://git@)?(?:www\.)?([\w.-]+)[/:]([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def terms(text: Column) -> Column:
    """The distinct lower-case terms of more than one letter, separated by blanks and the marks of paths and names."""
    parts = F.split(F.regexp_replace(F.lower(text), r"::|[_\-/.()]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 1))


def lexical_bonus(query: Column, *fields: Column) -> Column:
    """0.05 for each term of the query among the terms of the fields."""
    hay = F.array_distinct(F.flatten(F.array(*[terms(F.coalesce(f, F.lit(""))) for f in fields])))
    return F.lit(0.05) * F.size(F.array_intersect(terms(query), hay))


def normalized_language(language: Column) -> Column:
    """What follows the last dot, in lower case, with short names spelt out; null and empty are ``unknown``."""
    last = F.lower(F.trim(F.element_at(F.split(language, r"\."), -1)))
    return F.when(F.coalesce(F.length(last), F.lit(0)) == 0, "unknown").otherwise(F.coalesce(lookup(LANGUAGE_ALIASES, last), last))


def language_label(language: Column) -> Column:
    plain = normalized_language(language)
    return F.when(plain == "unknown", "Unknown language").otherwise(F.coalesce(lookup(LANGUAGE_LABELS, plain), F.initcap(F.regexp_replace(plain, "[-_]", " "))))


def format_bytes(n: Column) -> Column:
    """``1.5 KB`` and the like; null and negative sizes are not calculated."""
    unit = F.least(F.lit(3), F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)) + 1e-12)).cast("int")
    scaled = F.regexp_replace(F.format_number(n / F.pow(F.lit(1024.0), unit), 1), ",", "")
    name = F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit)
    return F.when(n.isNull() | (n < 0), "Not calculated").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat_ws(" ", scaled, name))


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def path_extension(path: Column) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_prefixes(path: Column) -> Column:
    """All directories above a path, from the top; empty for a file at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def is_safe_path(path: Column) -> Column:
    """Relative, without null bytes, drive letters and steps upwards."""
    plain = F.regexp_replace(path, r"\\", "/")
    return path.isNotNull() & (F.length(path) > 0) & ~plain.rlike(r"\x00|^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)")


def is_protected_path(path: Column) -> Column:
    """Files that hold keys and settings by their name."""
    return F.lower(clean_path(path)).rlike(r"(?:^|/)(?:\.env[^/]*|credentials[^/]*|secrets[^/]*|[^/]*\.(?:pem|key))$|(?:^|/)\.git/")


def repository_identity(url: Column) -> Column:
    """``host, owner, name`` of a repository's address in any spelling; null where it is none."""
    at = lambda k: F.nullif(F.regexp_extract(F.lower(F.trim(url)), REPOSITORY_URL, k), F.lit(""))
    return F.struct(at(1).alias("host"), at(2).alias("owner"), at(3).alias("name"))


def directory_name(name: Column) -> Column:
    """A name that is safe as a directory's."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def chunk_key(repository: Column, path: Column, parent: Column, symbol: Column, start: Column, end: Column) -> Column:
    """The identity of a chunk: 16 hexadecimal digits of a hash of place and name."""
    scope = F.when(parent.isNotNull() & (parent != ""), F.concat(parent, F.lit("."))).otherwise("")
    return F.left(F.sha2(F.concat(repository.cast("string"), F.lit(":"), path, F.lit(":"), scope, F.coalesce(symbol, F.lit("")), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")), 256), F.lit(16))


def first_version(text: Column) -> Column:
    """The first ``1``, ``1.2`` or ``1.2.3`` of a requirement; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+){0,2})", 1), F.lit(""))


def version_parts(version: Column) -> Column:
    """Up to three numbers, which compare like versions; a shorter prefix is smaller."""
    return F.transform(F.slice(F.split(F.regexp_extract(version, r"^\D*(\d+(?:\.\d+)*)", 1), r"\."), 1, 3), lambda x: F.expr("try_cast(0 as int)") if x is None else x.try_cast("int"))


def contains(text: Column, needle: str) -> Column:
    """Whether a text holds the needle, in any case; an empty needle is in every text."""
    return F.lower(text).contains(needle.strip().lower())
