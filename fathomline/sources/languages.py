"""What the chunkers know of each language: comments, strings, definitions. Fixed values are the public syntax of the languages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Extension to language.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".svelte": "svelte", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".md": "markdown",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".cs": "csharp", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".html": "html", ".htm": "html", ".css": "css", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".sql": "sql", ".tf": "hcl", ".tfvars": "hcl", ".hcl": "hcl", ".scala": "scala", ".sc": "scala", ".lua": "lua", ".ex": "elixir", ".exs": "elixir", ".hs": "haskell",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
}
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_MODS = r"(?:(?:export|default|declare|public|private|protected|internal|static|abstract|final|open|override|virtual|sealed|readonly|async|suspend|inline|partial|unsafe|extern|native|synchronized|strictfp|const|pub(?:\([^)]*\))?|data|inner|operator|fileprivate|mutating|case|implicit|lazy|constexpr|explicit|get|set)\s+)*"
_ANNO = r"(?:(?:@[\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?|\[[^\]\n]*\]|#\[[^\]\n]*\])\s*)*"


@dataclass
class Spec:
    """How definitions of a brace language look. `rules` are tried on the text before a body: (pattern, type, holds members)."""

    rules: list[tuple[re.Pattern, str, bool]]
    mask: re.Pattern
    members: list[tuple[re.Pattern, str, bool]] = field(default_factory=list)


def _r(pattern: str, kind: str, holds: bool = False) -> tuple[re.Pattern, str, bool]:
    return re.compile(_ANNO + _MODS + pattern, re.S), kind, holds


def _mask(extra: str = "", comments: str = _C_COMMENT) -> re.Pattern:
    return re.compile("|".join(x for x in (comments, extra, _STRINGS) if x))


_JS = [_r(r"function\s*\*?\s*(?P<n>[\w$]+)?", "function"), _r(r"class\s+(?P<n>[\w$]+)", "class", True), _r(r"interface\s+(?P<n>[\w$]+)", "interface"), _r(r"enum\s+(?P<n>[\w$]+)", "enum"), _r(r"(?:namespace|module)\s+(?P<n>[\w$.]+)", "namespace", True), _r(r"type\s+(?P<n>[\w$]+)[^=]*=", "type"), _r(r"(?:let|var)?\s*(?P<n>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^={]+)?=>", "function")]
_JS_MEMBER = [_r(r"\*?\s*(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)[#\w$]+)\s*(?:<[^(]*>)?\s*\(", "method")]
_JAVA_TYPES = [_r(r"class\s+(?P<n>\w+)", "class", True), _r(r"record\s+(?P<n>\w+)", "record", True), _r(r"interface\s+(?P<n>\w+)", "interface", True), _r(r"enum\s+(?P<n>\w+)", "enum", True)]
_ANNOTATION = (re.compile(r"(?:(?:public|abstract|private|protected|static)\s+)*@interface\s+(?P<n>\w+)"), "annotation", True)
_CALLABLE = r"(?:[\w<>\[\]?,.&*:~ \t\n]+?[\s&*])?(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b|else\b|using\b|lock\b|foreach\b)~?[\w:~]+)\s*(?:<[^(]*>)?\s*\([^;{}]*\)[^;{}=]*$"
SPECS: dict[str, Spec] = {
    "javascript": Spec(_JS, _mask(r"`(?:[^`\\]|\\.)*`"), _JS_MEMBER),
    "go": Spec([_r(r"func\s*\(\s*(?:\w+\s+)?\*?(?P<p>\w+)[^)]*\)\s*(?P<n>\w+)", "method"), _r(r"func\s+(?P<n>\w+)", "function"), _r(r"type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct", "type"), _r(r"type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface", "interface")], _mask(r"`[^`]*`")),
    "java": Spec([_ANNOTATION, *_JAVA_TYPES], _mask(r"\"\"\"[\s\S]*?\"\"\""), [_r(_CALLABLE, "method")]),
    "csharp": Spec([_r(r"namespace\s+(?P<n>[\w.]+)", "namespace", True), _r(r"struct\s+(?P<n>\w+)", "struct", True), *_JAVA_TYPES], _mask(r"@\"(?:[^\"]|\"\")*\""), [_r(_CALLABLE, "method"), _r(r"(?:[\w<>\[\]?,.]+\s+)(?P<n>\w+)\s*$", "property")]),
    "kotlin": Spec([_r(r"companion\s+object(?:\s+(?P<n>\w+))?", "object", True), _r(r"object\s+(?P<n>\w+)", "object", True), _r(r"(?:class|interface)\s+(?P<n>\w+)", "class", True), _r(r"(?P<n>constructor)\s*\(", "constructor"), _r(r"(?P<n>init)\s*$", "init"), _r(r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<n>\w+)", "function")], _mask(r"\"\"\"[\s\S]*?\"\"\"")),
    "rust": Spec([_r(r"fn\s+(?P<n>\w+)", "function"), _r(r"impl(?:<[^{]*?>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?P<n>\w+)", "impl", True), _r(r"struct\s+(?P<n>\w+)", "struct"), _r(r"enum\s+(?P<n>\w+)", "enum"), _r(r"trait\s+(?P<n>\w+)", "trait", True), _r(r"mod\s+(?P<n>\w+)", "module", True), _r(r"macro_rules!\s*(?P<n>\w+)", "macro")], re.compile(_C_COMMENT + r"|r#\"[\s\S]*?\"#|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'")),
    "c": Spec([_r(r"(?:typedef\s+)?struct\s+(?P<n>\w*)\s*$", "struct"), _r(r"(?:typedef\s+)?union\s+(?P<n>\w*)\s*$", "union"), _r(r"(?:typedef\s+)?enum\s+(?P<n>\w*)\s*$", "enum"), _r(_CALLABLE, "function")], _mask(r"(?m:^[ \t]*#[^\n]*)")),
    "cpp": Spec([_r(r"namespace\s*(?P<n>[\w:]*)", "namespace", True), _r(r"(?:template\s*<[^{]*>\s*)?(?:class|struct)\s+(?P<n>\w+)", "class", True), _r(r"union\s+(?P<n>\w*)", "union"), _r(r"enum\s+(?:class\s+)?(?P<n>\w*)", "enum"), _r(_CALLABLE, "function")], _mask(r"(?m:^[ \t]*#[^\n]*)|R\"\([\s\S]*?\)\"")),
    "php": Spec([_r(r"(?:namespace)\s+(?P<n>[\w\\]+)", "namespace", True), _r(r"class\s+(?P<n>\w+)", "class", True), _r(r"interface\s+(?P<n>\w+)", "interface", True), _r(r"trait\s+(?P<n>\w+)", "trait", True), _r(r"enum\s+(?P<n>\w+)", "enum", True), _r(r"function\s+&?(?P<n>\w+)", "function")], _mask("", _C_COMMENT + r"|#[^\[\n][^\n]*")),
    "swift": Spec([_r(r"(?:class|struct|enum|extension|actor)\s+(?P<n>\w+)", "class", True), _r(r"protocol\s+(?P<n>\w+)", "protocol", True), _r(r"func\s+(?P<n>\w+)", "function"), _r(r"(?P<n>init)\b", "constructor"), _r(r"var\s+(?P<n>\w+)\s*:", "property")], _mask(r"\"\"\"[\s\S]*?\"\"\"")),
    "scala": Spec([_r(r"class\s+(?P<n>\w+)", "class", True), _r(r"object\s+(?P<n>\w+)", "object", True), _r(r"trait\s+(?P<n>\w+)", "trait", True), _r(r"def\s+(?P<n>[\w$]+)", "function")], _mask(r"\"\"\"[\s\S]*?\"\"\"")),
    "css": Spec([_r(r"(?P<n>@media[^{]*)$", "media_query", True), _r(r"(?P<n>@supports[^{]*)$", "supports", True), _r(r"(?P<n>@keyframes\s+[\w-]+)", "keyframes"), _r(r"(?P<n>[^{}@;]+)$", "style_rule")], re.compile(r"/\*[\s\S]*?\*/|" + _STRINGS)),
    "hcl": Spec([_r(r"(?P<n>[\w-]+(?:\s+\"[^\"]*\")*)\s*$", "block")], re.compile(r"#[^\n]*|" + _C_COMMENT)),
    "bash": Spec([_r(r"(?:function\s+)?(?P<n>[\w:-]+)\s*(?:\(\s*\))\s*$", "function"), _r(r"function\s+(?P<n>[\w:-]+)\s*$", "function")], re.compile(r"(?<![\w$])#[^\n]*|" + _STRINGS)),
}


def _b(pattern: str, kind: str) -> tuple[re.Pattern, str]:
    return re.compile(r"\s*(?P<d>" + _ANNO + _MODS + pattern + r")\s*", re.S), kind


_ARROW = _b(r"(?:let|var)?\s*(?P<n>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^={;]+)?=>\s*[^\s{;][^;]*", "function")
_BARE_METHOD = _b(r"(?:<[^<>]*>\s*)?[\w<>\[\]?,.\s]+?[\s\]>](?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b|throw\b)\w+)\s*(?:<[^(]*>)?\s*\([^;{}=]*\)(?:\s*throws\s+[\w.,\s]+)?", "method")
#: Definitions without a body, up to their semicolon or line end: at the top, and among members.
BARE: dict[str, tuple[list[tuple[re.Pattern, str]], list[tuple[re.Pattern, str]]]] = {
    "javascript": ([_ARROW, _b(r"type\s+(?P<n>[\w$]+)\s*(?:<[^=]*>)?\s*=\s*[^\s{;][^;]*", "type")], []),
    "go": ([_b(r"type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s*=?\s*(?!struct\b|interface\b)[\w*\[\]().,\s{}]*?[\w\])]+", "type")], []),
    "rust": ([_b(r"struct\s+(?P<n>\w+)\s*(?:<[^>]*>)?\s*(?:\([^;]*\))?[^;{]*", "struct"), _b(r"mod\s+(?P<n>\w+)", "module")], []),
    "java": ([], [_BARE_METHOD]),
    "csharp": ([_b(r"record\s+(?:struct\s+|class\s+)?(?P<n>\w+)\s*\([^;{]*\)[^;{]*", "record")], [_b(r"event\s+[\w<>.?]+\s+(?P<n>\w+)", "event"), _BARE_METHOD, _b(r"[\w<>\[\]?,.]+\s+(?P<n>\w+)\s*=>\s*[^;{]+", "property")]),
    "kotlin": ([_b(r"(?:enum\s+|annotation\s+)?class\s+(?P<n>\w+)[^={}\n]*", "class"), _b(r"object\s+(?P<n>\w+)[^={}\n]*", "object"), _b(r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<n>\w+)\s*\([^{}]*?\)[^{}=\n]*(?:=[^{}\n]+)?", "function"), _b(r"va[lr]\s+(?P<n>\w+)\s*[:=][^{}\n]+", "property")], []),
    "swift": ([_b(r"(?:let|var)\s+(?P<n>\w+)\s*[:=][^{}\n]+", "property")], []),
    "scala": ([_b(r"class\s+(?P<n>\w+)[^={}\n]*", "class"), _b(r"object\s+(?P<n>\w+)[^={}\n]*", "object"), _b(r"def\s+(?P<n>[\w$]+)[^{}\n]*", "function"), _b(r"va[lr]\s+(?P<n>\w+)\s*[:=][^{}\n]+", "property"), _b(r"type\s+(?P<n>\w+)[^{}\n]*", "type")], []),
    "php": ([], [_b(r"function\s+&?(?P<n>\w+)\s*\([^;{}]*\)[^;{}]*", "method")]),
    "cpp": ([_b(r"(?:template\s*<[^;{]*>\s*)?concept\s+(?P<n>\w+)\s*=[^;]+", "concept")], []),
    "css": ([_b(r"(?P<n>@import\s+[^;{]+)", "import"), _b(r"(?P<n>@charset\s+[^;{]+)", "charset")], []),
}
#: Languages in which a definition may also end with its line.
LINE_ENDS = ("go", "javascript", "typescript", "jsx", "tsx", "svelte", "swift", "kotlin", "scala", "bash")
for _same, _as in (("typescript", "javascript"), ("jsx", "javascript"), ("tsx", "javascript"), ("svelte", "javascript")):
    SPECS[_same] = SPECS[_as]
    BARE[_same] = BARE[_as]
#: Languages whose blocks end with `end`: definitions, and words that open a block that needs one.
END_BLOCKS = {
    "ruby": (re.compile(r"^\s*(?:(?P<k>class|module)\s+(?P<n>[\w:]+)|(?P<d>def)\s+(?:self\.)?(?P<m>[\w?!=]+))"), re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$"), re.compile(r"^\s*end\b")),
    "lua": (re.compile(r"^\s*(?:local\s+)?(?P<d>function)\s+(?P<m>[\w.:]+)|^\s*(?:local\s+)?(?P<n>[\w.]+)\s*=\s*(?P<k>function)\b"), re.compile(r"\bfunction\b|\bdo\b|\bthen\b|^\s*repeat\b"), re.compile(r"^\s*(?:end\b|until\b)")),
    "elixir": (re.compile(r"^\s*(?:(?P<k>defmodule|defprotocol|defimpl)\s+(?P<n>[\w.]+)|(?P<d>def|defp|defmacro|defmacrop|defguard|defguardp|defdelegate|defcallback|defstruct|defexception)\s+(?P<m>[\w?!]+))"), re.compile(r"\b(?:do|fn)\b(?!:)"), re.compile(r"\bend\b")),
}
SQL_OBJECT = re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(?P<k>table|view|index|function|procedure|type|trigger)\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"`]+)", re.I | re.M)
HASKELL_DEF = re.compile(r"^(?:(?P<k>data|newtype|type|class|instance)\s+(?P<n>[^=\n]*?)(?=\s*(?:=|where|$))|(?P<m>[a-z_][\w']*)\s*(?:::|[^=\n]*=))", re.M)
HTML_SECTIONS = ("script", "style", "head", "body", "nav", "main", "header", "footer", "section", "article", "aside", "form", "template")
