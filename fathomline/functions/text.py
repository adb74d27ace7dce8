"""Text expressions: identifiers, tokens, previews, globs. All are built-in column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the keyword index: runs of letters and digits, lower case.
INDEX_TOKEN = r"[\p{L}\p{N}]+"
#: Tokens of names and queries: word characters in the Unicode sense.
WORD = r"[\p{L}\p{N}_]+"
PREVIEW_CHARS, SNIPPET_CHARS = 200, 160

#: The intents and the patterns that show them, tried on the lower-case query.
INTENTS = {
    "function_search": (r"\bfunction\b", r"\bdef\b", r"\bmethod\b", r"\bclass\b", r"how.*work", r"implement.*", r"algorithm.*"),
    "error_handling": (r"\berror\b", r"\bexception\b", r"\btry\b", r"\bcatch\b", r"handle.*error", r"exception.*handling"),
    "database": (r"\bdatabase\b", r"\bdb\b", r"\bquery\b", r"\bsql\b", r"\bmodel\b", r"\btable\b", r"connection"),
    "api": (r"\bapi\b", r"\bendpoint\b", r"\broute\b", r"\brequest\b", r"\bresponse\b", r"\bhttp\b", r"rest.*api"),
    "authentication": (r"\bauth\b", r"\blogin\b", r"\btoken\b", r"\bpassword\b", r"\bsession\b", r"authenticate", r"permission"),
    "testing": (r"\btest\b", r"\bmock\b", r"\bassert\b", r"\bfixture\b", r"unit.*test", r"integration.*test"),
}


def chunk_id(relative_path: Column, start: Column, end: Column, chunk_type: Column, name: Column) -> Column:
    """`relative_path:start-end:type[:name]`; the name is left out if null or empty."""
    base = F.concat(relative_path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), chunk_type)
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(base, F.lit(":"), name)).otherwise(base)


def preview(content: Column) -> Column:
    """The first 200 characters, with an ellipsis if there are more."""
    return F.when(F.length(content) > PREVIEW_CHARS, F.concat(F.substring(content, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(content)


def snippet(text: Column) -> Column:
    """The first line that is not blank, white space collapsed, cut to 160 characters; '' without one."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.length(F.regexp_replace(x, r"\s+", "")) > 0)
    line = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > SNIPPET_CHARS, F.concat(F.substring(line, 1, SNIPPET_CHARS - 3), F.lit("..."))).otherwise(line)


def name_tokens(text: Column) -> Column:
    """Normalised tokens: split at lower-upper case changes, underscores and hyphens; lower case; order and repeats kept."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2"), r"[_\-]", " ")
    return F.regexp_extract_all(F.lower(spaced), F.lit(WORD), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens of the keyword index."""
    return F.regexp_extract_all(F.lower(text), F.lit(INDEX_TOKEN), F.lit(0))


def expand_query(query: Column) -> Column:
    """Each blank-separated token followed by its camel, snake and kebab parts, every one once, in order of first sight."""
    tokens = F.filter(F.split(query, r"\s+"), lambda t: t != "")

    def parts(t: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(t, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z])([A-Z])", "$1 $2")
        return F.concat(F.array(t), F.filter(F.split(F.regexp_replace(cut, r"[_\-]", " "), r"\s+"), lambda x: x != ""))

    return F.array_join(F.array_distinct(F.flatten(F.transform(tokens, parts))), " ")


def intents(query: Column) -> Column:
    """Array of the intents whose patterns the query shows, in fixed order."""
    low = F.lower(query)
    found = [F.when(low.rlike("|".join(p)), F.lit(name)) for name, p in INTENTS.items()]
    return F.array_compact(F.array(*found))


def folders(relative_path: Column) -> Column:
    """Folder names of a relative path, the file name left out; separators may be either slash."""
    parts = F.split(F.regexp_replace(relative_path, r"\\", "/"), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def like_escape(text: str) -> str:
    """Text that a LIKE pattern with escape \\ takes literally."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def glob_to_like(pattern: str) -> str:
    """LIKE pattern of a path glob: * and ** cross folders, ? is one character, a plain text matches anywhere."""
    pattern = pattern.strip().replace("\\", "/")
    if not any(c in pattern for c in "*?"):
        return f"%{like_escape(pattern)}%"
    out: list[str] = []
    for c in pattern:
        piece = "%" if c == "*" else "_" if c == "?" else like_escape(c)
        if piece == "%" and out[-1:] == ["%"]:
            continue
        if piece == "%" and out[-2:] == ["%", "/"]:
            out.pop()  # %/% is one wildcard: folders between may be none
            continue
        out.append(piece)
    return "".join(out)


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches any of the globs."""
    return reduce(lambda a, b: a | b, [F.like(path, F.lit(glob_to_like(p)), F.lit("\\")) for p in patterns])


def extension_of(text: Column) -> Column:
    """An extension in lower case with a leading dot."""
    t = F.lower(F.trim(text))
    return F.when(t.startswith("."), t).otherwise(F.concat(F.lit("."), t))


def project_id(path: Column) -> Column:
    return F.md5(path)


def json_or(text: Column, schema: str, default: Column) -> Column:
    """A JSON text read with a schema; `default` where it is null, malformed or of another shape."""
    return F.coalesce(F.from_json(text, schema), default)


def positive_int(value: Column, default: int) -> Column:
    """A whole number above zero, whatever type it comes in; `default` for anything else, fractions and booleans included."""
    n = F.when(value.cast("string").rlike(r"^\s*\+?\d+\s*$"), value.cast("string").try_cast("int"))
    return F.when(n > 0, n).otherwise(F.lit(default))


def age_seconds(written: Column, now: Column | None = None) -> Column:
    """Seconds since a timestamp; null for null."""
    return F.unix_timestamp(F.current_timestamp() if now is None else now) - F.unix_timestamp(written)


def first_details(details: Column, cap: int = 50) -> Column:
    """struct<items, truncated, n>: the first `cap` elements of an array, and whether there are more."""
    n = F.coalesce(F.size(details), F.lit(0))
    return F.struct(F.slice(details, 1, cap).alias("items"), (n > cap).alias("truncated"), F.greatest(n, F.lit(0)).alias("n"))
