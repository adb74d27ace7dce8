"""Functions paired with their documentation, through a table of declared symbols.

One pass over the files reads, at each definition's own lines, its head and its documentation: the file decides. What is
documented there goes into a symbol table by project, language, qualified name and normalised signature, so overloads stay
apart. Every definition is then resolved against the table: its own declaration comes first, else that of a separate
declaration (an interface method, an overload signature) in whatever file it lies. Trivial texts never enter the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.current import current_rows
from fathomline.session import stored

_PY_STRING = re.compile(r"([rRuU]?)(\"\"\"((?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*)\"\"\"|'''((?:[^'\\]|\\[\s\S]|'(?!''))*)'''|\"((?:[^\"\\\n]|\\[\s\S])*)\"|'((?:[^'\\\n]|\\[\s\S])*)')")
_PY_SKIP = re.compile(r"[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|#[^\n]*|[()\[\]{}:]")
_DIRECTIVE = re.compile(r"^//(?:go:|line |export |extern |nolint\b)|^// \+build")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: Task tags: the rest of their line says what is still to be done. In lower case they need a mark behind them.
TASK = re.compile(r"^\W*(?:(?:TODO|FIXME|XXX|TBD|TBA)\b|(?i:todo|fixme|xxx|tbd|tba|wip)\b(?=\s*(?:[:(\[\-\u2013\u2014.!]|$))).*", re.M)
#: Lines that are nothing but a placeholder, or were put there by a tool.
PLACEHOLDER = re.compile(
    r"^\W*(?:n/?a|none|placeholder|lorem ipsum|undocumented|(?:description|summary|docstring|documentation)(?: (?:goes )?here)?|insert (?:a )?(?:description|documentation)(?: here)?|"
    r"(?:no|missing|needs|add|write) (?:a |the |some |proper )*(?:doc|docs|documentation|description|docstring|comment)s?(?: here)?(?: (?:for|of|to) \S+)?|auto-?generated (?:method|function|constructor|javadoc)?\s*(?:stub)?|non-javadoc|not (?:yet )?documented(?: yet)?|to be (?:written|done|documented|completed))\W*$",
    re.I | re.M,
)
_TAG = re.compile(r"^\s*(?:[@\\]|:)(param|parameter|arg|argument|type|rtype|returns?|throws|raises?|exception|see|link|inheritdoc|override|deprecated|since|author|version|tparam|template|typeparam)\b(?:\s*\{[^}]*\})?:?", re.I | re.M)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields|throws|note|notes|example|examples)\s*:?\s*$", re.I | re.M)
#: Words that carry nothing beyond a name.
FILLER = frozenset("a an the this that these those is are be was will would can does do did done it its of for to from in on at by with and or as into function functions method methods func def procedure routine constructor getter setter helper class see param params parameter parameters arg args argument arguments return returns returned value values type types void none null nil given self cls todo fixme tbd tba".split())


_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def\b", re.M)
_BEFORE_DOC = re.compile(r"(?:[ \t\f]|#[^\n]*|\n|\\\n)*")
_BETWEEN = re.compile(r"[ \t]*(?:\\\n[ \t]*)?")
_STATEMENT_END = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\n|$|;)")


def python_doc(text: str, start: int, end: int) -> str | None:
    """First string of the body of the definition at text[start:end] (decorators included); None without one."""
    m = _DEF.search(text, start, end)
    if not m:
        return None
    depth, at = 0, m.end()
    while True:
        m = _PY_SKIP.search(text, at)
        if not m:
            return None
        at = m.end()
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            break
    at = _BEFORE_DOC.match(text, at).end()
    found = []
    while True:
        m = _PY_STRING.match(text, at)
        if not m:
            break
        found.append(next(g for g in m.groups()[2:] if g is not None))
        at = _BETWEEN.match(text, m.end()).end()
    if not found or not _STATEMENT_END.match(text, at):
        return None
    return "".join(found)


def go_doc(lines: list[str], start: int) -> str | None:
    """The comment that ends on the line above `start`, directives left out."""
    if start == 0:
        return None
    last = lines[start - 1].strip()
    if last.startswith("//"):
        i = start - 1
        while i >= 0 and lines[i].strip().startswith("//"):
            i -= 1
        own = [x.strip() for x in lines[i + 1 : start]]
        own = [x for x in own if not _DIRECTIVE.match(x)]
        return "\n".join(x[2:] for x in own) if own else None
    if last.endswith("*/"):
        return _block(lines, start - 1, "/*")
    return None


def block_doc(lines: list[str], start: int) -> str | None:
    """The /** block that ends on the line above `start`."""
    return _block(lines, start - 1, "/**") if start and lines[start - 1].strip().endswith("*/") else None


def _block(lines: list[str], end: int, opening: str) -> str | None:
    i = end
    while i >= 0 and "/*" not in lines[i]:
        i -= 1
        if i >= 0 and "*/" in lines[i]:
            return None
    if i < 0:
        return None
    text = "\n".join(lines[i : end + 1]).strip()
    if not text.startswith(opening) or text == "/**/":
        return None
    text = text[len(opening) : -2] if len(text) >= len(opening) + 2 else ""
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in text.split("\n"))


def split_words(text: str) -> list[str]:
    """Lower-case words of a text, identifiers split at case changes, digits and underscores."""
    return [w.lower() for x in _WORD.findall(text) for w in _CAMEL.split(x)]


_MARK = re.compile(r"[()\[\]{};:]")
_PY_HEAD, _OPEN = re.compile(r"\bdef\b"), re.compile(r"\(")


def header_of(text: str, ext: str) -> str:
    """The definition's head: its text up to the body."""
    m = (_PY_HEAD if ext == "py" else _OPEN).search(text)
    depth = 0
    for m in _MARK.finditer(text, m.start() if m else 0):
        c = m.group()
        if c == "(" or c == "[":
            depth += 1
        elif c == ")" or c == "]":
            depth -= 1
        elif depth <= 0 and (c in "{;" or c == ":" and ext == "py"):
            return text[: m.start()]
    return text.split("\n")[0]


def parameters(head: str, name: str) -> list[str]:
    """Texts of the parameters in a definition's head."""
    m = re.search(re.escape(name or "") + r"\s*(?:<[^(]*>)?\s*\(", head)
    at = m.end() if m and name else head.find("(") + 1
    if at <= 0:
        return []
    out, depth, begin = [], 0, at
    for i in range(at, len(head)):
        c = head[i]
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and not head[i - 1 : i + 1] in ("=>", "->"):
            if depth == 0:
                out.append(head[begin:i])
                break
            depth -= 1
        elif c == "," and depth == 0:
            out.append(head[begin:i])
            begin = i + 1
    return [x.strip() for x in out if x.strip()]


def signature(params: list[str], ext: str) -> str:
    """Arity and, where the language writes them, types: names, defaults, modifiers and white space removed."""
    kinds = []
    for p in params:
        p = re.sub(r"\s*=[^>].*$", "", p, flags=re.S)
        if ext == "py":
            if p in ("self", "cls", "/", "*"):
                continue
            kinds.append("**" if p.startswith("**") else "*" if p.startswith("*") else "_")
        elif ext == "java":
            kinds.append(re.sub(r"\s+", "", re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+|\s+\w+$", "", p)))
        elif ext == "ts":
            kinds.append("".join(p.partition(":")[2].split()) or "any")
        else:
            kinds.append("_")
    return "(" + ",".join(kinds) + ")"


def is_trivial(doc: str | None, name: str, params: list[str]) -> bool:
    """Whether a documentation text says nothing beyond the names of the function and its parameters, or that it is to be written."""
    if not doc or not doc.strip():
        return True
    text = PLACEHOLDER.sub(" ", TASK.sub(" ", doc))
    text = _SECTION.sub(" ", _TAG.sub(" ", text))
    known = set(split_words(name or ""))
    for p in params:
        known.update(split_words(re.sub(r"=.*", "", p, flags=re.S)))
    return not any(w not in FILLER and w not in known for w in split_words(text))


def function_docs(chunks: DataFrame, files: DataFrame, content: bool = False) -> DataFrame:
    """(chunk_id, project_name, ext, name, parent_name, signature, doc, trivial boolean, content) of each current function and method.

    Definitions come from `chunks` (current by indexed_at), head, documentation and (if asked for) content from the current
    file (by modified_at) at the definition's lines. doc is null without documentation (then trivial is true). Chunks whose
    file is missing, or whose start line is null, are left out; a null end line means the end of the file. All
    definitions of one file go to one row of Python, without their texts: a file bounds them.
    """
    cols = {c: F.col(c) for c in ("file_path", "project_name", "name", "parent_name", "chunk_type", "start_line", "end_line")}
    cur = current_rows(chunks, ["chunk_id"], "indexed_at", cols).where("chunk_type IN ('function', 'method') AND file_path IS NOT NULL AND start_line >= 1")
    per_file = cur.groupBy("file_path").agg(F.first("project_name", True).alias("project_name"), F.collect_list(F.struct("chunk_id", "name", "parent_name", "start_line", "end_line")).alias("defs"))
    text = current_rows(files, ["file_path"], "modified_at", {"content": F.col("content")}).select("file_path", F.col("content").alias("text"))
    rows = per_file.join(text.where("text IS NOT NULL"), "file_path").withColumn("ext", F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for defs, project, text, ext in zip(pdf["defs"], pdf["project_name"], pdf["text"], pdf["ext"]):
                if "\r" in text:
                    text = text.replace("\r\n", "\n").replace("\r", "\n")
                lines = text.split("\n")
                begins = [0, *accumulate(len(x) + 1 for x in lines)]
                for d in defs:
                    at = d["start_line"] - 1
                    last = d["end_line"]
                    last = len(lines) if last is None or last != last else min(max(int(last), at), len(lines))
                    doc, body = None, ""
                    if at < len(lines):
                        body = text[begins[at] : begins[last]]
                        doc = python_doc(text, begins[at], begins[last]) if ext == "py" else go_doc(lines, at) if ext == "go" else block_doc(lines, at)
                    params = parameters(header_of(body, ext), d["name"] or "")
                    out.append((d["chunk_id"], project, ext, d["name"], d["parent_name"], signature(params, ext), doc, is_trivial(doc, d["name"], params), body if content else None))
            yield pd.DataFrame(out, columns=["chunk_id", "project_name", "ext", "name", "parent_name", "signature", "doc", "trivial", "content"])

    return rows.select("defs", "project_name", "text", "ext").mapInPandas(read, "chunk_id string, project_name string, ext string, name string, parent_name string, signature string, doc string, trivial boolean, content string")


SYMBOL = ["project_name", "ext", "qualified_name", "signature"]


def symbol_table(docs: DataFrame) -> DataFrame:
    """(SYMBOL..., decl_chunk_id, decl_doc): the documented declaration of each qualified name and signature, the smallest chunk_id of several.

    Aggregated on the map side, so a name that a third of all rows bear is one row; only members of a named parent are lent.
    """
    told = docs.where("NOT trivial AND parent_name <> '' AND name <> ''")
    return told.groupBy(*SYMBOL).agg(F.min(F.struct("chunk_id", "doc")).alias("d")).select(*SYMBOL, F.col("d.chunk_id").alias("decl_chunk_id"), F.col("d.doc").alias("decl_doc"))


def code_doc_pairs(docs: DataFrame) -> DataFrame:
    """(chunk_id, name, qualified_name, signature, doc, doc_chunk_id, content): pairs whose documentation is not trivial.

    Each definition is resolved against the symbol table. Its own declaration, where it is telling, stands before that of a
    separate declaration of the same project, language, qualified name and normalised signature; doc_chunk_id names the
    declaration. `docs` is read several times and should be stored.
    """
    q = docs.withColumn("qualified_name", F.concat_ws(".", F.when(F.col("parent_name") != "", F.col("parent_name")), "name"))
    own = ~F.col("trivial")
    found = q.join(symbol_table(q), SYMBOL, "left").where(own | F.col("decl_doc").isNotNull())
    doc, by = F.when(own, F.col("doc")).otherwise(F.col("decl_doc")), F.when(own, F.col("chunk_id")).otherwise(F.col("decl_chunk_id"))
    return found.select("chunk_id", "name", "qualified_name", "signature", doc.alias("doc"), by.alias("doc_chunk_id"), "content")


def documented_functions(chunks: DataFrame, files: DataFrame, content: bool = False) -> DataFrame:
    """code_doc_pairs of the tables, the files read once."""
    return code_doc_pairs(stored(function_docs(chunks, files, content)))
