"""Semantic chunks of source files: definitions, sections, configuration entries.

Python uses the standard parser; brace languages are cut by matching braces over a text whose comments and strings are
blanked out; others by their block words. A file without any definition becomes one `module` chunk. Exact agreement with
full grammars is not claimed for languages without a parser in the standard library.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.sources.languages import BARE, END_BLOCKS, EXTENSIONS, HASKELL_DEF, HTML_SECTIONS, LINE_ENDS, SPECS, SQL_OBJECT

SCHEMA = "chunk_type string, name string, parent_name string, docstring string, start_line int, end_line int, content string, calls array<string>, tags array<string>"
#: Limits of structured files.
MAX_CONFIG_BYTES, MAX_CONFIG_LINES = 10 * 1024 * 1024, 100_000
MAX_CALLS = 200
_CALL = re.compile(r"(?<![\w.])(?:[\w$]+\.)*([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function func def class elif except with sizeof and or not in lambda print super new await yield".split())


def normalise(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def language_of(path: str, exclude: frozenset[str] = frozenset()) -> str | None:
    """Language by lower-case suffix; None if unsupported or excluded."""
    m = re.search(r"(\.[^./\\]+)$", path.lower())
    return EXTENSIONS.get(m.group(1)) if m and m.group(1) not in exclude else None


def call_names(body: str) -> list[str]:
    """Called names in order of first sight, at most MAX_CALLS."""
    return list(dict.fromkeys(n for n in _CALL.findall(body) if n not in _NOT_CALLS))[:MAX_CALLS]


def _row(lines: list[str], kind: str, name: str | None, parent: str | None, doc: str | None, start: int, end: int, calls: bool = True) -> dict:
    content = "\n".join(lines[start - 1 : end])
    return {"chunk_type": kind, "name": name or None, "parent_name": parent or None, "docstring": doc, "start_line": start, "end_line": end, "content": content, "tags": None, "calls": call_names(content.partition("\n")[2] or "") if calls else []}


def python_chunks(text: str) -> list[dict]:
    """Classes, their methods and functions; bodies of functions are not searched. Decorators belong to the chunk."""
    tree = ast.parse(text)
    lines, out = text.split("\n"), []

    def visit(body: list[ast.stmt], parent: str | None) -> None:
        for n in body:
            if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(n, part, []) or [], parent)
                for h in getattr(n, "handlers", []):
                    visit(h.body, parent)
                continue
            start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            is_class = isinstance(n, ast.ClassDef)
            out.append(_row(lines, "class" if is_class else "method" if parent else "function", n.name, parent, ast.get_docstring(n, clean=True), start, n.end_lineno, not is_class))
            if is_class:
                visit(n.body, n.name)

    visit(tree.body, None)
    return out


def brace_chunks(text: str, lang: str) -> list[dict]:
    spec = SPECS[lang]
    lines = text.split("\n")
    masked = spec.mask.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text) if lang != "hcl" else re.sub(r"#[^\n]*|//[^\n]*", lambda m: " " * len(m.group()), text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out: list[dict] = []

    def line_at(pos: int) -> int:
        lo, hi = 0, len(starts) - 1
        while lo < hi - 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= pos else (lo, mid)
        return lo + 1

    pairs: dict[int, int] = {}
    stack = []
    for m in re.finditer(r"[{}]", masked):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()

    top, members = BARE.get(lang, ((), ()))

    def bare(item: int, at: int, parent: str | None) -> bool:
        """Emits the definition without a body that masked[item:at] is, if it is one."""
        for pattern, kind in [*top, *(members if parent else ())]:
            m = pattern.fullmatch(masked, item, at)
            if m:
                out.append(_row(lines, "method" if kind == "function" and parent else kind, text[m.start("n") : m.end("n")].strip(), parent, None, line_at(m.start("d")), line_at(max(m.start("d"), m.end("d") - 1)), kind in ("function", "method")))
                return True
        return False

    def visit(begin: int, end: int, parent: str | None, rules: list) -> None:
        at = item = begin
        depth = 0
        while at < end:
            c = masked[at]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth = max(0, depth - 1)
            elif c == ";" and depth == 0:
                bare(item, at, parent) or lang in LINE_ENDS and bare(max(item, masked.rfind("\n", begin, at) + 1), at, parent)
                item = at + 1
            elif c == "{":
                close = pairs.get(at, end)
                if depth:
                    at = close + 1
                    continue
                head = masked[item:at]
                found = None
                for pattern, kind, holds in rules:
                    for m in pattern.finditer(head):
                        line_start = head.rfind("\n", 0, m.start("n") if m.group("n") is not None else m.end()) + 1
                        lead = head[line_start : m.start()].strip()
                        if not lead and (found is None or m.start() > found[0].start()):
                            found = (m, kind, holds)
                    if found:
                        break
                if found:
                    m, kind, holds = found
                    begin_at = item + m.start() + len(m.group()) - len(m.group().lstrip())
                    name = (text[item + m.start("n") : item + m.end("n")] if m.group("n") else "").strip().replace('"', "")
                    owner = m.groupdict().get("p") or parent
                    kind = "method" if kind == "function" and parent else kind
                    out.append(_row(lines, kind, name, owner, None, line_at(begin_at), line_at(min(close, len(text) - 1)), not holds))
                    if holds:
                        visit(at + 1, close, name, spec.rules + spec.members)
                at = item = close + 1
                continue
            elif c == "\n" and lang in LINE_ENDS and depth == 0:
                line = max(item, masked.rfind("\n", begin, at) + 1)
                more = masked[at + 1 : end].lstrip()[:1] if masked[line:at].strip() else "{"
                if re.match(r"[^\n]*(?:import|package)\b[^\n{]*\Z", masked[item:at].lstrip("\n")) or more not in ("{", ".", "?", "|", "&", "+", "=", ":") and bare(line, at, parent):
                    item = at + 1
            at += 1
        if lang in LINE_ENDS and depth == 0:
            bare(max(item, masked.rfind("\n", begin, end) + 1), end, parent)

    visit(0, len(masked), None, spec.rules)
    return sorted(out, key=lambda r: (r["start_line"], -r["end_line"])) if top or members else out


_JSX_TAG = re.compile(r"<(?P<close>/)?(?P<n>[A-Za-z][\w.:-]*)?(?P<rest>(?:[^<>{}\"']|\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|=>)*)>")


def jsx_chunks(text: str, lang: str) -> list[dict]:
    """The definitions of a script and the outermost elements that stand outside all functions; functions with elements are components."""
    rows = brace_chunks(text, lang)
    lines = text.split("\n")
    elements, open_ = [], []
    for m in _JSX_TAG.finditer(text):
        before = text[: m.start()].rstrip()[-1:]
        word = re.search(r"(\w+)\s*$", text[max(0, m.start() - 20) : m.start()])
        if not open_ and (m.group("close") or before and (before.isalnum() or before in "_$)]") and not (word and word.group(1) in ("return", "default", "case"))):
            continue  # a comparison or type arguments
        line = text.count("\n", 0, m.start()) + 1
        if m.group("close"):
            name, start = open_.pop()
            if not open_:
                elements.append(("jsx_element", name, start, line))
        elif m.group("rest").endswith("/"):
            if not open_:
                elements.append(("jsx_self_closing_element", m.group("n"), line, text.count("\n", 0, m.end()) + 1))
        else:
            open_.append((m.group("n"), line))
    for r in rows:
        if r["chunk_type"] in ("function", "method") and any(r["start_line"] <= a and b <= r["end_line"] for _, _, a, b in elements):
            r["tags"] = ["component"]
    inside = lambda a, b: any(r["start_line"] <= a and b <= r["end_line"] for r in rows)
    rows += [_row(lines, kind, name, None, None, a, b, False) for kind, name, a, b in elements if not inside(a, b)]
    return sorted(rows, key=lambda r: (r["start_line"], -r["end_line"]))


def svelte_chunks(text: str) -> list[dict]:
    """`script` and `style` units of a component, and the definitions of its scripts with their lines in the file."""
    lines, out = text.split("\n"), []
    for m in re.finditer(r"<(?P<n>script|style)\b(?P<a>[^>]*)>(?P<b>[\s\S]*?)</(?P=n)\s*>", text, re.I):
        first, last = text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1
        kind = m.group("n").lower()
        out.append(_row(lines, kind, f"<{kind}>", None, None, first, last, False))
        if kind == "script":
            shift = text.count("\n", 0, m.start("b"))
            for r in brace_chunks(m.group("b"), "svelte"):
                out.append({**r, "start_line": r["start_line"] + shift, "end_line": r["end_line"] + shift})
    return out


def block_word_chunks(text: str, lang: str) -> list[dict]:
    """Languages whose blocks close with a word."""
    define, opens, closes = END_BLOCKS[lang]
    lines = text.split("\n")
    out, stack = [], []
    for i, line in enumerate(lines, 1):
        bare = re.sub(r"(?:--|#)[^\n]*$" if lang == "lua" else r"#[^{\n][^\n]*$", "", re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "", line))
        n_close = len(closes.findall(bare))
        m = define.match(bare)
        n_open = len(opens.findall(bare))
        if m:
            g = m.groupdict()
            holds = bool(g.get("n")) and lang != "lua"
            name = g.get("n") or g.get("m")
            parent = next((s[1] for s in reversed(stack) if s and s[3]), None)
            entry = (i, name, "class" if holds and g["k"] == "class" else "module" if holds else "method" if parent and lang == "ruby" else "function", holds, parent)
            if n_open > n_close:
                stack.append(entry)
                n_open -= 1
            else:
                out.append(_row(lines, entry[2], name, parent, None, i, i))
        for _ in range(n_open - min(n_open, n_close)):
            stack.append(None)
        for _ in range(n_close - min(n_open if not m else 0, n_close)):
            if stack:
                s = stack.pop()
                if s:
                    out.append(_row(lines, s[2], s[1], s[4], None, s[0], i, not s[3]))
    return sorted(out, key=lambda r: (r["start_line"], -r["end_line"]))


def sql_chunks(text: str) -> list[dict]:
    lines, out = text.split("\n"), []
    for m in SQL_OBJECT.finditer(text):
        end = text.find(";", m.end())
        tag = re.search(r"\$\w*\$", text[m.end() : end if end >= 0 else None])
        if tag:
            close = text.find(tag.group(), m.end() + tag.end())
            end = text.find(";", close) if close >= 0 else -1
        end = len(text) - 1 if end < 0 else end
        start = text.count("\n", 0, m.start() + len(m.group()) - len(m.group().lstrip())) + 1
        out.append(_row(lines, m.group("k").lower(), m.group("n").strip('"`'), None, None, start, text.count("\n", 0, end) + 1, False))
    return out


def haskell_chunks(text: str) -> list[dict]:
    lines = text.split("\n")
    marks = [(text.count("\n", 0, m.start()) + 1, m.group("k") or "function", (m.group("n") or m.group("m") or "").split(" ")[0]) for m in HASKELL_DEF.finditer(text) if (m.group("m") or "") not in ("module", "import", "where", "infixl", "infixr")]
    out = []
    for i, (line, kind, name) in enumerate(marks):
        if out and out[-1][1:] == [kind, name] and kind == "function":
            continue
        out.append([line, kind, name])
    ends = [x[0] - 1 for x in out[1:]] + [len(lines)]
    rows = []
    for (line, kind, name), end in zip(out, ends):
        while end > line and not lines[end - 1].strip():
            end -= 1
        rows.append(_row(lines, kind, name, None, None, line, end))
    return rows


class _Sections(HTMLParser):
    """Section elements with their lines; script and style are raw text, an unclosed section ends with the file."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.stack: list[tuple[str, int]] = []
        self.found: list[tuple[str, int, int]] = []
        self.last = text.count("\n") + 1 - text.endswith("\n")
        self.feed(text)
        self.close()
        self.found += [(t, a, self.last) for t, a in self.stack]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HTML_SECTIONS:
            self.stack.append((tag, self.getpos()[0]))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, a = self.stack.pop()
                if t == tag:
                    self.found.append((t, a, self.getpos()[0]))
                    break
                self.found.append((t, a, self.getpos()[0]))


def html_chunks(text: str) -> list[dict]:
    lines = text.split("\n")
    return [_row(lines, "element", f"<{t}>", None, None, a, b, False) for t, a, b in sorted(_Sections(text).found, key=lambda x: (x[1], -x[2]))]


def markdown_chunks(text: str) -> list[dict]:
    """One section per heading up to the next; text before the first is `Preamble`; code fences hide headings."""
    lines = text.split("\n")
    marks, fence = [], None
    for i, line in enumerate(lines, 1):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if m and (fence is None or line.strip().startswith(fence)):
            fence = None if fence else m.group(1)[:3]
        elif not fence and (h := re.match(r" {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", line)):
            marks.append((i, h.group(1)))
    if not marks:
        return [_row(lines, "document", None, None, None, 1, len(lines), False)] if text.strip() else []
    if marks[0][0] > 1 and "".join(lines[: marks[0][0] - 1]).strip():
        marks.insert(0, (1, "Preamble"))
    ends = [m[0] - 1 for m in marks[1:]] + [len(lines)]
    return [_row(lines, "section", name, None, None, a, b, False) for (a, name), b in zip(marks, ends)]


def parse_config(text: str, lang: str) -> list[object]:
    """Documents of a YAML, JSON or TOML text; raises on a syntax error."""
    if lang == "json":
        return [json.loads(text)]
    if lang == "toml":
        import tomllib

        return [tomllib.loads(text)]
    import yaml

    return list(yaml.safe_load_all(text))


def key_lines(lines: list[str], lang: str) -> dict[str, int]:
    """First line of every key; a TOML table counts by its whole name and by each part."""
    first: dict[str, int] = {}
    for i, line in enumerate(lines, 1):
        if lang == "json":
            keys = re.findall(r'"([^"\\]+)"\s*:', line)
        elif lang == "yaml":
            m = re.match(r"\s*(?:-\s*)?([^#:]*?)\s*:", line)
            keys = [m.group(1).strip("'\"")] if m and not line.lstrip().startswith("#") else []
        else:
            m = re.match(r"\s*\[+\s*([^\]]+?)\s*\]+\s*$|\s*([^#=\[]+?)\s*=", line)
            name = (m.group(1) or m.group(2)).strip("'\"") if m else ""
            keys = [name, *(x.strip().strip("'\"") for x in name.split("."))] if name else []
        for k in keys:
            if k:
                first.setdefault(k, i)
    return first


def config_chunks(text: str, lang: str) -> list[dict]:
    """Every nested mapping and list, and whatever stands at the root, with its key path and kind; one raw `document` if it does not parse."""
    lines = text.split("\n")
    try:
        docs = parse_config(text, lang)
    except Exception:
        return [{**_row(lines, "document", None, None, None, 1, len(lines), False), "tags": [lang, "config", "raw"]}]
    first = key_lines(lines, lang)
    docs = [x for x in docs if x is not None] if lang == "yaml" else docs
    out: list[dict] = []

    def render(value: object, path: str) -> str:
        if lang == "yaml":
            import yaml

            body = yaml.safe_dump(value, sort_keys=False, allow_unicode=True).rstrip("\n")
        else:
            body = json.dumps(value, indent=2, default=str, ensure_ascii=False)
        return f"Path: {path}\nFormat: {lang}\n{body}"

    def emit(holder: object, path: str, key: str, root: bool) -> None:
        """One chunk for each composite child of `holder`, at the root for every child; the holder's kind names it."""
        mapping = isinstance(holder, dict)
        for k, v in holder.items() if mapping else enumerate(holder) if isinstance(holder, list) else ():
            nested = isinstance(v, dict | list)
            if not (root or nested):
                continue
            below = (f"{path}.{k}" if path else str(k)) if mapping else f"{path}[{k}]"
            mine = str(k) if mapping else key or str(k)
            kind = ("config_section" if nested else "config_entry") if mapping else ("config_list" if nested else "config_item")
            body = render(v, below)
            line = first.get(mine, 1)
            tags = [lang, "config", "list" if not mapping else "mapping" if nested else "entry", *(["top_level"] if root else [])]
            out.append({"chunk_type": kind, "name": below, "parent_name": path or None, "docstring": None, "start_line": line, "end_line": min(max(1, len(lines)), line + body.count("\n")), "content": body, "tags": tags, "calls": []})
            if nested:
                emit(v, below, mine if mapping else key, False)

    for n, doc in enumerate(docs, 1):
        emit(doc, f"document_{n}" if len(docs) > 1 else "", f"document_{n}" if len(docs) > 1 else "", True)
    whole = _row(lines, "document", None, None, None, 1, max(1, len(lines)), False)
    return out or [{**whole, "content": render(docs[0] if docs else text, "document"), "tags": [lang, "config", "document"]}]


def chunk_text(text: str | None, path: str) -> list[dict]:
    """Chunks of one file; [] for unsupported, blank or unreadable texts."""
    lang = language_of(path)
    if lang is None or not text or not text.strip():
        return []
    text = normalise(text)
    try:
        if lang == "python":
            rows = python_chunks(text)
        elif lang in ("jsx", "tsx"):
            rows = jsx_chunks(text, lang)
        elif lang == "svelte":
            rows = svelte_chunks(text)
        elif lang in SPECS:
            rows = brace_chunks(text, lang)
        elif lang in END_BLOCKS:
            rows = block_word_chunks(text, lang)
        else:
            rows = {"sql": sql_chunks, "haskell": haskell_chunks, "html": html_chunks, "markdown": markdown_chunks}[lang](text) if lang not in ("yaml", "json", "toml") else config_chunks(text, lang)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return rows or [_row(text.split("\n"), "module", None, None, None, 1, len(text.split("\n")), False)]


def chunk_files(files: DataFrame, path: str = "relative_path", content: str = "content", max_bytes: int = MAX_CONFIG_BYTES, max_lines: int = MAX_CONFIG_LINES) -> DataFrame:
    """Chunks of each file with path, id, folders, language tag and preview. Structured files above the limits are left out (see skipped)."""
    kept = files.where(F.col(path).isNotNull() & ~_too_big(path, content, max_bytes, max_lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"relative_path": p, "language": language_of(p), **r} for p, t in zip(pdf["p"], pdf["t"]) for r in chunk_text(t, p)]
            yield pd.DataFrame(rows, columns=["relative_path", "language", *[c.split()[0] for c in SCHEMA.split(", ")]])

    rows = kept.select(F.regexp_replace(path, r"\\", "/").alias("p"), F.col(content).alias("t")).mapInPandas(run, "relative_path string, language string, " + SCHEMA)
    ident = T.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type"), F.col("name"))
    return rows.withColumn("chunk_id", ident).withColumn("folder_structure", T.folders(F.col("relative_path"))).withColumn("tags", F.when(F.col("tags").isNotNull() & F.col("chunk_type").startswith("config"), F.col("tags")).when(F.col("chunk_type") == "document", F.coalesce("tags", F.array("language"))).otherwise(derived_tags())).withColumn("content_preview", T.preview(F.col("content"))).withColumn("complexity_score", F.lit(0.0))


def derived_tags():
    """async, generator, export, generic, component, extension where a definition's head says so, then the language."""
    head, lang, kind = F.substring_index("content", "{", 1), F.col("language"), F.col("chunk_type")
    callable_ = kind.isin("function", "method", "constructor")
    script = lang.isin("javascript", "jsx", "typescript", "tsx", "svelte")
    tag = lambda cond, name: F.when(cond, name)
    return F.array_compact(F.array(
        tag(callable_ & ((script | lang.isin("csharp", "rust", "swift")) & head.rlike(r"\basync\b") | (lang == "python") & F.col("content").rlike(r"^(?:\s*@[^\n]*\n)*\s*async\s+def\b") | (lang == "kotlin") & head.rlike(r"\bsuspend\b")), "async"),
        tag(callable_ & script & head.rlike(r"\bfunction\s*\*|^\s*(?:static\s+|async\s+)*\*"), "generator"),
        tag(script & head.rlike(r"^\s*export\b"), "export"),
        tag(lang.isin("typescript", "tsx", "java", "csharp", "go", "kotlin", "scala") & F.col("name").isNotNull() & head.rlike(r"\w\s*(?:<[\w\s,.:?&\[\]]+>|\[[A-Z]\w*(?:\s+[\w~|. ]+)?\])\s*(?:\(|extends|implements|=|$|\bstruct|\binterface)"), "generic"),
        tag(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "component"), "component"),
        tag((lang == "swift") & head.rlike(r"^\s*(?:public\s+)?extension\b") | (lang == "kotlin") & head.rlike(r"\bfun\s+(?:<[^>]*>\s*)?[\w<>?]+\.\w+\s*\("), "extension"),
        lang,
    ))


def _too_big(path: str, content: str, max_bytes: int, max_lines: int):
    config = F.lower(F.col(path)).rlike(r"\.(?:ya?ml|json|toml)$")
    big = F.lit(False)
    if max_bytes > 0:
        big = big | (F.octet_length(content) > max_bytes)
    if max_lines > 0:
        big = big | (F.size(F.split(content, "\n")) > max_lines)
    return config & F.coalesce(big, F.lit(False))


def skipped(files: DataFrame, path: str = "relative_path", content: str = "content", max_bytes: int = MAX_CONFIG_BYTES, max_lines: int = MAX_CONFIG_LINES) -> DataFrame:
    """(path, reason, size) of the structured files above the limits."""
    out = files.where(_too_big(path, content, max_bytes, max_lines))
    reason = F.when(F.octet_length(content) > max_bytes, F.format_string("more than %d bytes", F.lit(max_bytes))).otherwise(F.format_string("more than %d lines", F.lit(max_lines)))
    return out.select(F.col(path).alias("path"), reason.alias("reason"), F.octet_length(content).cast("long").alias("size"))


def markdown_sections(files: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    """(path, name, start_line, end_line, content) of Markdown sections as a plan of built-in operators: split, running count, group.

    Headings inside ``` fences do not count. The window runs within one file.
    """
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n")).alias("_i", "line")).withColumn("n", F.col("_i") + 1)
    w = Window.partitionBy("path").orderBy("n")
    fence = lines.withColumn("_f", F.sum(F.col("line").rlike(r"^ {0,3}(```|~~~)").cast("int")).over(w))
    head = (F.col("_f") % 2 == 0) & F.col("line").rlike(r"^ {0,3}#{1,6}[ \t]+\S")
    marked = fence.withColumn("_h", head).withColumn("_s", F.sum(head.cast("int")).over(w))
    out = marked.groupBy("path", "_s").agg(F.max(F.when(F.col("_h"), F.col("line"))).alias("_t"), F.min("n").alias("start_line"), F.max("n").alias("end_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    name = F.when(F.col("_s") == 0, "Preamble").otherwise(F.regexp_replace(F.col("_t"), r"^ {0,3}#{1,6}[ \t]+|[ \t]+#*[ \t]*$", ""))
    return out.where("_s > 0 OR trim(content) <> ''").select("path", name.alias("name"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "content")
