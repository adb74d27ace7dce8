"""Splitting oversized items at natural boundaries by a recursive separator hierarchy.

Sections, paragraphs, lines, sentences, words, characters: a text above the limit is cut at the coarsest separator that
occurs in it, parts still above the limit at the next finer one, and neighbouring parts are packed greedily up to the
limit. What a section is depends on the language: headings in prose, definitions in code, outer ones before the methods
within them, each with the comments and decorators right above it. Every piece but the first begins with the longest run of whole trailing parts of its predecessor within the
overlap. Pieces are exact slices of the text, so nothing is lost and line numbers follow from offsets.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coarse to fine; each pattern matches at the end of a part, which keeps its separator.
_NEXT_LINE = r"(?:\r\n|\n|\r)"
_FINE = (re.compile(_NEXT_LINE + r"[ \t]*" + _NEXT_LINE), re.compile(_NEXT_LINE), re.compile(r"[.!?;][\"')\]]*\s+"), re.compile(r"\s+"))
_WORDS = r"(?:export|default|public|protected|private|internal|static|abstract|final|async|open|override|sealed|pub(?:\([a-z]+\))?|virtual|inline|declare|synchronized|readonly|suspend|unsafe|extern)[ \t]+"
_PROSE = r"#{1,6}[ \t]|=====|-----"
#: What begins a section: by language, before its modifiers; a member also begins with a name and its parameters.
_DEFINE = {
    "python": r"(?:class|def|async[ \t]+def)\b", "go": r"(?:func|type|var|const)\b", "java": r"(?:class|interface|enum|record|@interface)\b|(?:[\w<>\[\],.?]{1,200}[ \t]+){1,8}\w+[ \t]*\([^;\n]{0,400}\{?[ \t]*$",
    "javascript": r"(?:class|function|const|let|var|interface|enum|type|namespace)\b|(?:get[ \t]+|set[ \t]+|\*[ \t]*)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b)[\w$#]+[ \t]*(?:<[^>\n]{0,200}>)?\([^;\n]{0,400}\)[^;\n]{0,200}\{[ \t]*$",
    "": r"(?:class|interface|enum|struct|trait|impl|func|function|fn|def|type|module|namespace)\b",
}
_ABOVE = {"python": r"(?:[ \t]*(?:@|#)[^\r\n]*" + _NEXT_LINE + "){0,30}", "": r"(?:[ \t]*(?:@|//|/\*|\*)[^\r\n]*" + _NEXT_LINE + "){0,30}"}
_PROSE_LANGUAGES = ("markdown", "text", "rst", "html")
_LIKE = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "svelte": "javascript", "kotlin": "java", "csharp": "java", "scala": "java"}


@functools.cache
def hierarchy(language: str | None = None) -> tuple[re.Pattern, ...]:
    """Separators of a language: outermost definitions, then those one to three levels in, then paragraphs and finer; headings in prose.

    Without a language headings and outermost definitions both count.
    """
    lang = (language or "").strip().lower()
    lang = _LIKE.get(lang, lang)
    if lang in _PROSE_LANGUAGES:
        return (re.compile(_NEXT_LINE + rf"(?={_PROSE})"), *_FINE)
    if lang in ("yaml", "json", "toml"):
        return (re.compile(_NEXT_LINE + r"(?=[^\s#\]})-])"), re.compile(_NEXT_LINE + r"(?=[ \t]{1,4}[^\s#\]}])"), *_FINE)
    define = _DEFINE.get(lang, _DEFINE[""])
    above = _ABOVE.get(lang, _ABOVE[""])
    level = lambda indent: re.compile(_NEXT_LINE + rf"(?={above}{indent}(?:{_WORDS})*(?:{define}))", re.M)
    if not lang:
        return (re.compile(_NEXT_LINE + rf"(?={_PROSE}|(?:{_WORDS})*(?:{define}))"), *_FINE)
    return (level(""), level(r"(?: {1,4}|\t)"), level(r"(?: {5,8}|\t\t)"), level(r"(?: {9,12}|\t{3})"), *_FINE)


LINE_END = re.compile(r"\r\n|\n|\r")


def _first_of_run(text: str, cuts: list[int]) -> list[int]:
    """Cuts without those that part a comment or decorator from what it stands above."""
    out: list[int] = []
    last = None
    for c in cuts:
        if last is None or not _ONLY_ABOVE.fullmatch(text, last, c):
            out.append(c)
        last = c
    return out


_ONLY_ABOVE = re.compile(r"(?:[ \t]*(?:@|#|//|/\*|\*)[^\r\n]*(?:\r\n|\n|\r))+")


def _parts(text: str, begin: int, end: int, limit: int, level: int, levels: tuple[re.Pattern, ...]) -> Iterator[tuple[int, int]]:
    """Slices of at most `limit` characters that tile text[begin:end]."""
    stack = [(begin, end, level)]
    code = len(levels) > len(_FINE) + 1 or levels is hierarchy(None)
    while stack:
        b, e, lv = stack.pop()
        if e - b <= limit:
            yield b, e
            continue
        if lv == len(levels):
            for at in range(b, e, limit):  # no separator is left: characters; a "\r\n" is not torn apart unless the limit is 1
                yield at, min(e, at + limit)
            continue
        cuts = [m.end() for m in levels[lv].finditer(text, b, e) if b < m.end() < e]
        if code and lv < len(levels) - len(_FINE):
            cuts = _first_of_run(text, cuts)
        stack += [(x, y, lv + 1) for x, y in reversed(list(zip([b, *cuts], [*cuts, e])))]


def split_text(text: str, limit: int, overlap: int, language: str | None = None) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of `text`, each at most `limit` characters; consecutive ones share up to `overlap`.

    Parts are at most limit - overlap long, so an overlap of whole parts always fits before the next part.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    overlap = max(0, min(overlap, limit // 2))
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    out: list[tuple[int, int]] = []
    parts = list(_parts(text, 0, len(text), limit - overlap, 0, hierarchy(language)))
    first = 0  # index of the first part of the open piece
    for i, (_, e) in enumerate(parts):
        if e - parts[first][0] > limit:
            out.append((parts[first][0], parts[i][0]))
            k = i
            while k > first + 1 and parts[i][0] - parts[k - 1][0] <= overlap and e - parts[k - 1][0] <= limit:
                k -= 1
            begin = parts[k][0]
            if k == i and overlap:  # the last part alone is longer than the overlap: take its tail, from a word's start if there is one
                low = max(parts[i][0] - overlap, e - limit, out[-1][0] + 1)
                words = [m.end() for m in re.finditer(r"\s+", text[low : parts[i][0]])]
                begin = low + (words[0] if words and words[0] < parts[i][0] - low else 0)
                parts[k - 1] = (begin, parts[i][0])
                k -= 1
            first = k
    out.append((parts[first][0], len(text)))
    return out


def split_items(items: DataFrame, item: str, text: str, limit: int, overlap: int, start_line: str | None = None, keep_small: bool = False, language: str | None = None) -> DataFrame:
    """(item, piece int, begin int, end int, start_line int, end_line int, content) of the items above `limit`.

    Offsets count characters (code points); lines are inclusive and start at `start_line` (1 if null or not given); a
    line end is \\r\\n, \\n or \\r. Null and empty texts have no pieces. With `keep_small` items within the limit come
    out as one piece. `language` names the column that tells what a section is. Text columns of other rows are never sent to Python.
    """
    first = F.coalesce(F.col(f"`{start_line}`").cast("int"), F.lit(1)) if start_line else F.lit(1)
    rows = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"), first.alias("line"), (F.col(f"`{language}`") if language else F.lit(None).cast("string")).alias("lang")).where(F.length("text") > (0 if keep_small else limit))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, body, line, lang in zip(pdf["item"], pdf["text"], pdf["line"], pdf["lang"]):
                at, n = 0, line
                for k, (b, e) in enumerate(split_text(body, limit, overlap, lang)):
                    if b < at:
                        n -= len(LINE_END.findall(body, b, at))
                    else:
                        n += len(LINE_END.findall(body, at, b))
                    at = b
                    inner = len(LINE_END.findall(body, b, e))
                    last = n + inner - (1 if inner and body[e - 1] in "\r\n" else 0)
                    out.append((key, k, b, e, n, last, body[b:e]))
            yield pd.DataFrame(out, columns=["item", "piece", "begin", "end", "start_line", "end_line", "content"])

    kind = dict(rows.dtypes)["item"]
    return rows.mapInPandas(cut, f"item {kind}, piece int, begin int, end int, start_line int, end_line int, content string").withColumnRenamed("item", item)
