"""Scanners and dialect grammars of the supported languages.

A scanner turns text into token kinds (bytes ending with 0) and line-end flags, or None where no token fits. Grammars are
written from the public language references; they accept a little more than compilers do (label scopes, repeated names
and the like are not checked), never less on purpose.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from fathomline.llm.syntax.gll import Grammar

Scanned = tuple[bytes, bytes | None]


@dataclass
class Language:
    name: str
    grammar: Grammar
    starts: list[str]
    scan: Callable[[str, Grammar], Scanned | None]


NAME_RE = r"[^\W\d]\w*"
#: Marks among token kinds that no grammar knows: a line end, and a text that is no token.
LINE, WRONG = 254, 255


class Kinds(dict):
    """Token text -> kind, worked out once for each short text."""

    def __init__(self, kind_of: Callable[[str, Grammar], int], g: Grammar):
        super().__init__()
        self.kind_of, self.grammar = kind_of, g

    def __missing__(self, t: str) -> int:
        kind = self.kind_of(t, self.grammar)
        kind = WRONG if kind < 0 else kind
        if len(t) < 60 and len(self) < 500_000:
            self[t] = kind
        return kind


def _kinds(g: Grammar, kind_of: Callable[[str, Grammar], int]) -> Kinds:
    return g.__dict__.setdefault("seen", Kinds(kind_of, g))


def _unix(text: str) -> str:
    """Without byte order mark, line ends as \\n."""
    if text[:1] == "\ufeff":
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text

# ---------------------------------------------------------------- Python

PY_GRAMMAR = """
start_file : (NEWLINE | stmt)* ;
stmt ! : line | compound ;
line : simple (';' simple)* ';'? NEWLINE ;
simple ! : (targets '=')+ (yieldx | exprs) | single augop (yieldx | exprs) | single ':' expr ('=' (yieldx | exprs))? | exprs
  | yieldx | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'del' target (',' target)* ','? | 'assert' expr (',' expr)?
  | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)*
  | 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)*
  | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | '(' names ','? ')' | names)
  | 'type' NAME tparams? '=' expr ;
names ! : NAME ('as' NAME)? (',' NAME ('as' NAME)?)* ;
dotted ! : NAME ('.' NAME)* ;
augop ! : AUG ;
# What may be assigned to: names, attributes, items, and lists of these.
place ! : NAME | primary ('.' NAME | '[' subs ']') ;
target ! : place | '(' inner? ')' | '[' inner? ']' ;
targets ! : '*'? target (',' '*'? target)* ','? ;
inner : targets ;
single ! : place | '(' alone ')' ;
alone : single ;
compound ! : ('@' named NEWLINE)* ('async'? fdef | cdef) | 'async'? ('with' items block | 'for' targets 'in' exprs block else?)
  | 'if' named block ('elif' named block)* else? | 'while' named block else?
  | 'try' block ((('except' '*'? (exprs ('as' NAME)?)? block)+ else? ('finally' block)?) | 'finally' block)
  | 'match' exprs ':' NEWLINE INDENT ('case' pats ('if' named)? block)+ DEDENT ;
else ! : 'else' block ;
fdef ! : 'def' NAME tparams? '(' params? ')' ('->' expr)? block ;
cdef ! : 'class' NAME tparams? ('(' args? ')')? block ;
tparams : '[' tparam (',' tparam)* ','? ']' ;
tparam ! : ('*' | '**')? NAME (':' expr)? ('=' expr)? ;
items : witem (',' witem)* | '(' witem (',' witem)* ','? ')' ;
witem ! : expr ('as' target)? ;
block : ':' (line | NEWLINE+ INDENT (stmt | NEWLINE)+ DEDENT) ;
plain ! : NAME (':' expr)? ;
dflt ! : plain '=' expr ;
rest ! : '*' (NAME (':' (expr | '*' expr))?) (',' (plain | dflt))* (',' '**' plain)? | '*' (',' (plain | dflt))+ (',' '**' plain)? | '**' plain ;
params : (rest | plain (',' plain)* (',' '/' (',' plain)*)? (',' dflt)* (',' rest)? | plain (',' plain)* (',' dflt)+ ',' '/' (',' dflt)* (',' rest)? | dflt (',' dflt)* (',' '/' (',' dflt)*)? (',' rest)?) ','? ;
lplain ! : NAME ;
ldflt ! : lplain '=' expr ;
lrest ! : '*' NAME (',' (lplain | ldflt))* (',' '**' lplain)? | '*' (',' (lplain | ldflt))+ (',' '**' lplain)? | '**' lplain ;
lparams : (lrest | lplain (',' lplain)* (',' '/' (',' lplain)*)? (',' ldflt)* (',' lrest)? | lplain (',' lplain)* (',' ldflt)+ ',' '/' (',' ldflt)* (',' lrest)? | ldflt (',' ldflt)* (',' '/' (',' ldflt)*)? (',' lrest)?) ','? ;
yieldx : 'yield' ('from' expr | exprs)? ;
exprs ! : star (',' star)* ','? ;
star ! : '*' expr | named ;
named ! : NAME ':=' expr | choice ;
expr : choice ;
choice ! : 'lambda' lparams? ':' expr | disj ('if' disj 'else' expr)? ;
disj ! : unary ((OP | OPU | '|' | '*' | '**' | '/' | '@' | '-' | 'or' | 'and' | 'in' | 'is' 'not'? | 'not' 'in') unary)* ;
unary ! : ('not' | '-' | '~' | OPU | 'await')* primary ;
primary ! : atom ('.' NAME | '(' args? ')' | '[' subs ']')* ;
atom ! : NAME | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' round? ')' | '[' square? ']' | '{' dictset? '}' ;
round : yieldx | exprs | star comp ;
square : exprs | star comp ;
comp : ('async'? 'for' targets 'in' disj ('if' cond)*)+ ;
cond ! : 'lambda' lparams? ':' cond1 | NAME ':=' disj | disj ;
cond1 : cond2 ;
cond2 ! : 'lambda' lparams? ':' cond1 | disj ;
dictset : kv (',' kv)* ','? | kv comp | star (',' star)* ','? | star comp ;
kv ! : expr1 ':' expr | '**' disj ;
expr1 ! : choice ;
# Positional arguments come before named ones, and both before unpacked mappings.
args : first comp | first (',' first)* (',' second)* (',' third)* ','? | second (',' second)* (',' third)* ','? | third (',' third)* ','? ;
first ! : named | '*' expr ;
second ! : NAME '=' expr | '*' expr ;
third ! : NAME '=' expr | '**' expr ;
subs : sub (',' sub)* ','? ;
sub ! : star | expr1? ':' expr? (':' expr?)? ;
pats : pat (',' pat)* ','? ;
pat : '*' NAME | por ('as' NAME)? ;
por ! : pone ('|' pone)* ;
pone ! : '-'? NUM (('-' | OPU) NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (parg (',' parg)* ','?)? ')')? | '(' pats? ')' | '[' pats? ']' | '{' ((pkey (',' pkey)* ','?)?) '}' ;
parg ! : (NAME '=')? pat ;
pkey ! : (('-'? NUM | STR+ | 'None' | 'True' | 'False' | dotted) ':' pat) | '**' NAME ;
"""
PY_HARD = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
_PY_STR = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_PY_FIELD_BODY = r"\{(?=\s*[^\s}!:=])(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
#: f-strings whose fields pair up; a field may hold the string's own quotes.
_PY_FSTR = "(?:[fF][rR]?|[rR][fF])(?:" + "|".join(rf"{q}(?:[^{q[0]}\\{{}}{nl}]|\\[\s\S]|\{{\{{|\}}\}}|{more}{_PY_FIELD_BODY})*{q}" for q, nl, more in (('"""', "", '"(?!"")|'), ("'''", "", "'(?!'')|"), ('"', r"\n", ""), ("'", r"\n", ""))) + ")"
_PY_NUM = r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
_PY_OPS = r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=]"
PY_TOKENS = re.compile(rf"(?:[ \t\f]+|\\\n|\#[^\n]*)*+(\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*+[ \t\f]*|[^\W\d]\w*+(?![\"'])|{_PY_FSTR}|{_PY_STR}|(?:{_PY_NUM})(?!\w)|{NAME_RE}|{_PY_OPS}|[\s\S])")
_PY_NAME_ONLY, _PY_STR_ONLY, _PY_FSTR_ONLY, _PY_NUM_ONLY = (re.compile(x) for x in (NAME_RE, _PY_STR, _PY_FSTR, _PY_NUM))


def _py_kind(t: str, g: Grammar) -> int:
    k = g.kinds
    if t[0] == "\n":
        return LINE
    if _PY_NAME_ONLY.fullmatch(t):
        return k[t] if t in PY_HARD or t in g.soft else k["NAME"]
    if len(t) > 1 and t[-1] in "\"'" and (_PY_STR_ONLY.fullmatch(t) or _PY_FSTR_ONLY.fullmatch(t)):
        return k["STR"] if _py_string_ok(t) else -1
    if _PY_NUM_ONLY.fullmatch(t):
        return k["NUM"]
    if t == "+":
        return k["OPU"]
    if t in k:
        return k[t]
    if t in ("%", "//", ">>", "<<", "&", "|", "^", "<", ">", "<=", ">=", "==", "!="):
        return k["OP"]
    if t in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="):
        return k["AUG"]
    return -1


def _py_string_ok(t: str) -> bool:
    """False for an f-string that no field pattern fits."""
    quote = min(i for i in (t.find('"'), t.find("'")) if i >= 0)
    return "f" not in t[:quote].lower() or _PY_FSTR_ONLY.fullmatch(t) is not None


def scan_python(text: str, g: Grammar) -> Scanned | None:
    """Logical lines with INDENT and DEDENT; a `return` outside every function is refused here, since it depends on the lines around it."""
    k = g.kinds
    newline, indent_, dedent = bytes([k["NEWLINE"]]), k["INDENT"], bytes([k["DEDENT"]])
    ret, def_, class_, async_ = k["return"], k["def"], k["class"], k["async"]
    toks = PY_TOKENS.findall("\n" + _unix(text) + "\n")
    ids = bytes(map(_kinds(g, _py_kind).__getitem__, toks))
    if WRONG in ids:
        return None
    step = g.__dict__.get("depth_steps")
    if step is None:
        step = g.depth_steps = np.zeros(256, np.int8)
        step[[k[c] for c in "([{"]], step[[k[c] for c in ")]}"]] = 1, -1
    kinds = np.frombuffer(ids, np.uint8)
    depth = np.cumsum(step[kinds], dtype=np.int32)
    if depth.min(initial=0) < 0 or len(depth) and depth[-1]:
        return None
    ends = np.flatnonzero((kinds == LINE) & (depth == 0)).tolist()
    out = bytearray()
    stack, white, inside = [(0, 0)], "", [False]
    opens = False  # the last line begins a function
    for a, b in zip(ends, ends[1:]):
        line = ids[a + 1 : b]
        if not line:
            continue
        if LINE in line:
            line = line.replace(b"\xfe", b"")
        ws = toks[a].rpartition("\n")[2]
        if ws != white:
            own = ws.rpartition("\f")[2]
            here = (len(own.expandtabs(8)), len(own.expandtabs(1)))
            if here != stack[-1]:
                if here[0] > stack[-1][0] and here[1] > stack[-1][1]:
                    stack.append(here)
                    inside.append(opens if opens is not None else inside[-1])
                    out.append(indent_)
                else:
                    while stack and stack[-1][0] > here[0]:
                        stack.pop()
                        inside.pop()
                        out += dedent
                    if not stack or stack[-1] != here:
                        return None
            white = ws
        first = line[0]
        opens = True if first == def_ or first == async_ and line[1:2] == bytes([def_]) else False if first == class_ else None
        if not inside[-1] and not opens and ret in line:
            return None
        out += line
        out += newline
    out += dedent * (len(stack) - 1)
    out.append(0)
    return bytes(out), None


# ---------------------------------------------------------------- JavaScript and TypeScript

_JS_COMMON = """
start_module : item* ;
start_script : stmt* ;
item : 'import' ('type'? clause 'from')? STR withx? semi | 'export' exported | stmt ;
withx ! : ('with' | 'assert') '{' (objkey ':' STR (',' objkey ':' STR)* ','?)? '}' ;
clause ! : NAME (',' (named | '*' 'as' NAME))? | named | '*' 'as' NAME ;
named ! : '{' (spec (',' spec)* ','?)? '}' ;
spec ! : 'type'? (word | STR) ('as' (word | STR))? ;
exported ! : 'type'? ('*' ('as' (word | STR))? 'from' STR withx? semi | named ('from' STR withx?)? semi) | 'default' (func | deco* classx | expr semi) | ('var' | 'let' | 'const') declars semi | '=' exprs semi | decl ;
semi ! : ';' | ASI ;
stmt : block | ';' | simple | ('var' | 'let' | 'const') declars semi | decl | 'if' '(' exprs ')' stmt ('else' stmt)? | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' (';' | ASI)?
  | 'for' 'await'? '(' forhead ')' stmt | 'try' block ('catch' ('(' bind typed? ')')? block ('finally' block)? | 'finally' block)
  | 'switch' '(' exprs ')' '{' ('case' exprs ':' stmt* | 'default' ':' stmt*)* '}' | 'with' '(' exprs ')' stmt | NAME ':' stmt ;
forhead : (vars | exprs)? ';' exprs? ';' exprs? | ('var' | 'let' | 'const' | 'using')? bind ('in' | 'of') exprs | primary ('in' | 'of') exprs ;
simple ! : choice (',' expr)* semi | 'return' exprs? semi | 'throw' exprs semi | 'break' NAME? semi | 'continue' NAME? semi | 'debugger' semi ;
vars ! : ('var' | 'let' | 'const') declars ;
declars ! : declar (',' declar)* ;
block : '{' stmt* '}' ;
func : 'async'? 'function' '*'? NAME? sig block ;
bind : NAME | '[' (','* bindel (','+ bindel)* ','*)? ']' | '{' (bindprop (',' bindprop)* ','?)? '}' ;
bindel ! : '...' bind | bind ('=' expr)? ;
bindprop ! : '...' bind | NAME ('=' expr)? | objkey ':' bind ('=' expr)? ;
deco : '@' NAME ('.' word)* ('(' args? ')')? | '@' '(' exprs ')' ;
exprs ! : expr (',' expr)* ;
expr : choice ;
choice ! : arrow | 'yield' ('*'? expr)? | place assign expr | cond ;
# What may be assigned to: names, members, items, patterns, all of these in brackets.
place ! : NAME | array | object | '(' exprs ')' | primary member ;
member ! : '.' (word | PRIVATE) | '[' exprs ']' ;
assign ! : '=' | ASSIGN ;
cond ! : bins ('?' expr ':' expr)? ;
unary ! : ('typeof' | 'void' | 'delete' | 'await' | '!' | '~' | '+' | '-' | INCR)* primary postfix* ;
primary ! : atom trail* ;
args ! : arg (',' arg)* ','? ;
arg ! : '...'? expr ;
template : TPL | TPLHEAD exprs (TPLMID exprs)* TPLTAIL ;
array : '[' (','* arg (','+ arg)* ','* | ','+)? ']' ;
object : '{' (prop (',' prop)* ','?)? '}' ;
prop ! : '...' expr | NAME ('=' expr)? | objkey ':' expr | method ;
objkey ! : word | STR | NUM | '[' expr ']' | PRIVATE ;
word ! : NAME | KEYWORD | 'if' | 'else' | 'while' | 'do' | 'for' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'with' | 'return' | 'throw' | 'break' | 'continue' | 'debugger' | 'var' | 'const' | 'function' | 'class' | 'extends' | 'new' | 'super' | 'this' | 'null' | 'true' | 'false' | 'typeof' | 'void' | 'delete' | 'in' | 'instanceof' | 'import' | 'export' | 'yield' ;
"""
JS_GRAMMAR = _JS_COMMON + """
decl ! : func | deco* classx ;
typed ! : NEVER ;
declar ! : bind ('=' expr)? ;
sig ! : '(' (parm (',' parm)* ','?)? ')' ;
parm ! : deco* ('...' bind | bind ('=' expr)?) ;
classx : 'class' NAME? ('extends' unary)? '{' part* '}' ;
part ! : ';' | deco* 'static'? (method | 'accessor'? objkey ('=' expr)? semi) | 'static' block ;
method ! : ('async' | 'get' | 'set')? '*'? objkey sig block ;
arrow ! : 'async'? (NAME | sig) '=>' (expr | block) ;
bins ! : unary ((BIN | '+' | '-' | '*' | 'in' | 'instanceof') unary)* | PRIVATE 'in' unary ;
postfix ! : INCR ;
atom ! : NAME | NUM | STR | REGEX | template | array | object | '(' exprs ')' | 'this' | 'null' | 'true' | 'false' | 'super' | func | deco* classx | 'new' ('.' NAME | newx) | 'import' ('(' expr (',' expr)? ','? ')' | '.' word) ;
newx : 'new'? atom ('.' (word | PRIVATE) | '[' exprs ']' | template)* ('(' args? ')')? ;
trail ! : '.' (word | PRIVATE) | '?.' (word | PRIVATE | '[' exprs ']' | '(' args? ')') | '[' exprs ']' | '(' args? ')' | template ;
"""
TS_GRAMMAR = _JS_COMMON.replace("primary member ;", "primary (member | '!') ;") + """
start_ambient : item* ;
decl ! : func | funcsig | deco* 'abstract'? classx | 'interface' NAME tparams? ('extends' types)? tbody | 'type' NAME tparams? '=' type semi
  | 'const'? 'enum' NAME '{' (objkey ('=' expr)? (',' objkey ('=' expr)?)* ','?)? '}' | 'declare' ambient | ('namespace' | 'module') (NAME ('.' NAME)* | STR) '{' item* '}' | 'global' '{' item* '}'
  | 'import' NAME '=' exprs semi ;
ambient : decl | ('var' | 'let' | 'const') declars semi | ('namespace' | 'module') STR semi ;
funcsig ! : 'async'? 'function' '*'? NAME? sig semi ;
typed ! : ':' type ;
declar ! : bind '!'? typed? ('=' expr)? ;
sig : tparams? '(' (parm (',' parm)* ','?)? ')' (':' rettype)? ;
rettype ! : 'asserts' (NAME | 'this') | type ;
parm ! : deco* ('public' | 'private' | 'protected' | 'readonly' | 'override')* ('...' bind | bind | 'this') '?'? typed? ('=' expr)? ;
classx : 'class' NAME? tparams? ('extends' unary targs?)? ('implements' types)? '{' part* '}' ;
part ! : ';' | deco* modifier* (method | msig | 'accessor'? objkey ('?' | '!')? typed? ('=' expr)? semi | index semi) | 'static' block ;
modifier ! : 'public' | 'private' | 'protected' | 'readonly' | 'static' | 'abstract' | 'override' | 'declare' ;
method ! : ('async' | 'get' | 'set')? '*'? objkey '?'? sig block ;
msig ! : ('async' | 'get' | 'set')? '*'? objkey '?'? sig semi ;
index ! : '[' NAME ':' type ']' typed ;
types ! : tref (',' tref)* ;
tref ! : dotted targs? ;
dotted ! : NAME ('.' word)* ;
targs : '<' type (',' type)* ','? '>' ;
tparams : '<' tparam (',' tparam)* ','? '>' ;
tparam ! : ('in' | 'out' | 'const')* NAME ('extends' type)? ('=' type)? ;
type : tcond | 'asserts'? (NAME | 'this') 'is' type | tparams? tsig '=>' rettype | 'abstract'? 'new' tparams? tsig '=>' type ;
tsig ! : '(' (parm (',' parm)* ','?)? ')' ;
tcond ! : tunion ('extends' tunion '?' type ':' type)? ;
tunion ! : '|'? '&'? top (('|' | '&') top)* ;
top ! : ('keyof' | 'readonly' | 'unique' | 'infer')* tprim ('[' type? ']')* ;
tprim ! : NAME ('.' word)* targs? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | '(' type ')' | '[' (tel (',' tel)* ','?)? ']' | tbody | mapped | 'typeof' ('import' '(' STR ')' | NAME | 'this') ('.' (word | PRIVATE))* targs? | ttemplate | 'import' '(' STR ')' ('.' word)* targs? ;
ttemplate : TPL | TPLHEAD type (TPLMID type)* TPLTAIL ;
tel ! : '...'? (NAME '?'? ':')? type '?'? ;
mapped : '{' (('+' | '-')? 'readonly')? '[' NAME 'in' type ('as' type)? ']' (('+' | '-')? '?')? typed? (';' | ',')? '}' ;
tbody : '{' tmember* '}' ;
tmember ! : (('readonly'? objkey '?'? typed?) | ('get' | 'set')? objkey '?'? sig | 'new'? sig | ('readonly' | 'static')* index) (';' | ',' | ASI) ;
arrow ! : 'async'? (NAME | sig) '=>' (expr | block) ;
bins ! : unary ((BIN | '+' | '-' | '*' | '|' | '&' | '<' | '>' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof') unary | ('as' | 'satisfies') ('const' | type))* | PRIVATE 'in' unary ;
postfix ! : INCR | '!' ;
atom ! : NAME | NUM | STR | REGEX | template | array | object | '(' exprs ')' | 'this' | 'null' | 'true' | 'false' | 'super' | func | deco* 'abstract'? classx | 'new' ('.' NAME | newx) | 'import' ('(' expr (',' expr)? ','? ')' | '.' word) | cast ;
cast : '<' type '>' unary ;
newx : 'new'? atom ('.' (word | PRIVATE) | '[' exprs ']' | '!' | template)* targs? ('(' args? ')')? ;
trail ! : '.' (word | PRIVATE) | '?.' (word | PRIVATE | '[' exprs ']' | targs? '(' args? ')') | '[' exprs ']' | targs? '(' args? ')' | targs? template | '!' ('.' (word | PRIVATE) | '[' exprs ']' | '(' args? ')') ;
"""
_JS_SOFT = {k: "NAME" for k in "async of get set static let await type as from accessor assert using".split()}
_TS_SOFT = _JS_SOFT | {k: "NAME" for k in "interface enum namespace module declare abstract public private protected readonly override implements keyof infer is asserts satisfies unique global out".split()}
_JS_RESERVED = "if else while do for try catch finally switch case default with return throw break continue debugger var const function class extends new super this null true false typeof void delete in instanceof import export yield".split()
_JS_NUM = r"0[xX](?:_?[0-9a-fA-F])+n?|0[oO](?:_?[0-7])+n?|0[bB](?:_?[01])+n?|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?"
_JS_NAME = r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4})*"
_JS_STR = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_JS_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%&|^!~?:=<>()\[\]{},;.@]"
_JS_SKIP = r"(?:[ \t\f\v\xa0﻿]+|//[^\n  ]*|/\*(?:[^*\n  ]|\*(?!/))*\*/)*+"
_JS_LINE = r"[\n  ](?:\s+|//[^\n  ]*|/\*(?:[^*]|\*(?!/))*\*/)*+|/\*(?:[^*]|\*(?!/))*\*/"
JS_TOKENS = re.compile(rf"{_JS_SKIP}({_JS_LINE}|{_JS_STR}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*`|(?:{_JS_NUM})(?![\w$])|#{_JS_NAME}|{_JS_NAME}|{_JS_OPS}|[\s\S])")
_JS_SKIPPED = re.compile(_JS_SKIP)
_JS_NAME_ONLY, _JS_NUM_ONLY = re.compile(_JS_NAME), re.compile(_JS_NUM)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JS_TPL_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JS_BIN = {"/", "%", "**", "===", "!==", "==", "!=", "<=", ">=", "&&", "||", "??", "<<", "^"}


def _js_kind(t: str, g: Grammar) -> int:
    k = g.kinds
    c = t[0]
    if c in "\n\u2028\u2029" or t[:2] == "/*":
        return LINE
    if _JS_NAME_ONLY.fullmatch(t):
        if t in _JS_RESERVED or t in g.soft:
            return k[t]
        return k["NAME"]
    if c == " ":
        return k[t[1:]]
    if c in "\"'" and len(t) > 1:
        return k["STR"]
    if c == "`" and len(t) > 1:
        return k["TPL"]
    if c == "#" and len(t) > 1:
        return k["PRIVATE"]
    if _JS_NUM_ONLY.fullmatch(t):
        return k["NUM"]
    if t in ("++", "--"):
        return k["INCR"]
    if t in k and t != END_KIND:
        return k[t]
    if t in _JS_BIN or t in "|&<>" or t in (">>", ">>>"):
        return k["BIN"]
    if t[-1] == "=" and t not in ("=",):
        return k["ASSIGN"]
    return -1


END_KIND = "END"


def scan_js(text: str, g: Grammar) -> Scanned | None:
    text = _unix(text)
    if text[:2] == "#!":
        text = "//" + text[2:]
    text += "\n"
    cache = _kinds(g, _js_kind)
    toks = JS_TOKENS.findall(text)
    if "`" in toks or "/" in toks or "/=" in toks:
        toks = _js_slow(text)
        if toks is None:
            return None
    ids = bytes(map(cache.__getitem__, toks))
    if WRONG in ids:
        return None
    kinds = np.frombuffer(ids, np.uint8)
    ends = kinds == LINE
    fresh = np.r_[False, ends[:-1]][~ends] if len(ends) else ends
    return ids.translate(None, b"\xfe") + b"\0", fresh.astype(np.uint8).tobytes() + b"\1"


def _js_slow(text: str) -> list[str] | None:
    """Tokens of a text with regular expressions or templates, which only the tokens before them tell apart."""
    out: list[str] = []
    at, depth, templates = 0, 0, []
    before = None  # last token that counts
    n, skip = len(text), _JS_SKIPPED.match
    while at < n:
        at = skip(text, at).end()
        if at >= n:
            break
        c = text[at]
        if c == "`":
            m = _JS_TPL_PART.match(text, at + 1)
            if not m:
                return None
            at = m.end()
            if m.group(1) == "`":
                out.append(" TPL")
                before = "`"
            else:
                templates.append(depth)
                out.append(" TPLHEAD")
                before = "{"
            continue
        if c == "}" and templates and templates[-1] == depth:
            m = _JS_TPL_PART.match(text, at + 1)
            if not m:
                return None
            at = m.end()
            if m.group(1) == "`":
                templates.pop()
                out.append(" TPLTAIL")
                before = "`"
            else:
                out.append(" TPLMID")
                before = "{"
            continue
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            value = before is not None and (before in (")", "]", "}", "`", "this", "super", "null", "true", "false", "++", "--") or (before[0] not in "([{,;:=!&|?+-*%^~<>." and before not in _JS_RESERVED and before != "=>"))
            m = None if value else _JS_REGEX.match(text, at)
            if m:
                out.append(" REGEX")
                before = "]"
                at = m.end()
                continue
        m = JS_TOKENS.match(text, at)
        t = m.group(1)
        at = m.end()
        out.append(t)
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
        if c not in "\n\u2028\u2029" and t[:2] != "/*":
            before = t
    return None if templates else out


# ---------------------------------------------------------------- Go

GO_GRAMMAR = """
# The project's own indexer takes reserved words as package names (such files have chunks); no rule of the language, a dialect of ours.
start_file : 'package' (NAME ';' | KEYWORDS ';'?) ('import' (ispec | '(' (ispec ';')* ispec? ')') ';')* (top ';')* ;
ispec ! : ('.' | NAME)? STR ;
top ! : decl | 'func' NAME tparams? sig block? | 'func' params NAME sig block? ;
decl ! : 'var' (vspec | '(' (vspec ';')* vspec? ')') | 'const' (cspec | '(' (cspec ';')* cspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')') ;
vspec ! : names (type ('=' exprs)? | '=' exprs) ;
cspec ! : names (type? '=' exprs)? ;
tspec ! : NAME tparams? '='? type ;
names ! : NAME (',' NAME)* ;
tparams : '[' names constraint (',' names constraint)* ','? ']' ;
constraint ! : ('~'? type) ('|' '~'? type)* ;
sig ! : params (params | type)? ;
params : '(' (param (',' param)* ','?)? ')' ;
param ! : anytype | NAME '...'? type | '...' type ;
type : anytype ;
anytype ! : NAME ('.' NAME)? targs? | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | struct | iface | '(' type ')' ;
# Types that are no expressions.
puretype : '*' puretype | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | struct | iface ;
targs : '[' type (',' type)* ','? ']' ;
struct : 'struct' '{' (field ';')* field? '}' ;
field ! : (names type | '*'? NAME ('.' NAME)? targs?) STR? ;
iface : 'interface' '{' (ielem ';')* ielem? '}' ;
ielem ! : NAME sig | constraint ;
block : '{' stmts '}' ;
stmts ! : (stmt? ';')* stmt? ;
stmt : flat | decl | block | if | switch | for | 'select' '{' (('case' simple | 'default') ':' stmts)* '}' | NAME ':' stmt? ;
flat ! : simple | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | ('go' | 'defer') expr ;
simple ! : binary (',' expr)* (INCR | (ASSIGN | '=') exprs | '<-' expr)? | NAME (',' NAME)* ':=' exprs ;
if : 'if' (simple? ';')? hsimple block ('else' (if | block))? ;
switch ! : 'switch' (hsimple? ';')? hsimple? '{' (('case' casex (',' casex)* | 'default') ':' stmts)* '}' ;
casex ! : expr | puretype ;
for ! : 'for' (hsimple? (';' hsimple? ';' hsimple?)? | (exprs ('=' | ':='))? 'range' hexpr) block ;
hsimple ! : hexpr (',' hexpr)* (INCR | (ASSIGN | '=' | ':=') hexpr (',' hexpr)* | '<-' hexpr)? ;
exprs ! : expr (',' expr)* ;
expr : binary ;
binary ! : unary ((BIN | '*' | '<-' | '|' | '~') unary)* ;
hexpr : hunary ((BIN | '*' | '|') hunary)* ;
unary ! : ('*' | UN | '<-')* primary ;
hunary ! : ('*' | UN | '<-')* hprimary ;
primary ! : atom (trail | body)* ;
hprimary ! : atom trail* ;
atom ! : NAME | NUM | STR | '(' (expr | puretype) ')' | lit | conv | 'func' sig block ;
lit ! : ('[' (expr | '...')? ']' type | 'map' '[' type ']' type | struct) body ;
conv ! : ('[' ']' type | 'map' '[' type ']' type | 'chan' type | iface | 'func' sig) '(' (expr ','?)? ')' ;
trail ! : '.' (NAME | '(' (type | 'type') ')') | '[' (expr? ':' expr? (':' expr)? | targ (',' targ)* ','?) ']' | '(' (targ (',' targ)* '...'? ','?)? ')' ;
targ ! : expr | puretype ;
body : '{' (elem (',' elem)* ','?)? '}' ;
elem ! : (val ':')? val ;
val ! : expr | body ;
"""
GO_HARD = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_GO_NUM = r"0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?i?"
_GO_STR = r"`[^`]*`|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))'"
GO_TOKENS = re.compile(rf"(?:[ \t]+|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/)*+(\n(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*+|/\*(?:[^*]|\*(?!/))*\*/|{_GO_STR}|(?:{_GO_NUM})(?!\w)|{NAME_RE}|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{{}},;.:~]|[\s\S])")

_GO_NUM_ONLY = re.compile(_GO_NUM)


def _go_kind(t: str, g: Grammar) -> int:
    k = g.kinds
    c = t[0]
    if c == "\n" or t[:2] == "/*":
        return LINE
    if _PY_NAME_ONLY.fullmatch(t):
        return k[t] if t in GO_HARD else k["NAME"]
    if c in "\"'`" and len(t) > 1:
        return k["STR"]
    if _GO_NUM_ONLY.fullmatch(t):
        return k["NUM"]
    if t in ("++", "--"):
        return k["INCR"]
    if t in ("-", "+", "&", "^"):
        return k["UNBIN"]
    if t == "!":
        return k["UN"]
    if t in k and t != END_KIND:
        return k[t]
    if t in ("/", "%", "<<", ">>", "&^", "<", ">", "<=", ">=", "==", "!=", "&&", "||"):
        return k["BIN"]
    if len(t) > 1 and t[-1] == "=":
        return k["ASSIGN"]
    return -1


def scan_go(text: str, g: Grammar) -> Scanned | None:
    k = g.kinds
    rule = g.__dict__.get("line_rule")
    if rule is None:  # a line end after these is a semicolon
        ending = bytes(k[x] for x in ("NAME", "NUM", "STR", "INCR", "break", "continue", "fallthrough", "return", ")", "]", "}"))
        rule = g.line_rule = re.compile(rb"([" + re.escape(ending) + rb"])\xfe+")
    ids = bytes(map(_kinds(g, _go_kind).__getitem__, GO_TOKENS.findall(_unix(text) + "\n")))
    if WRONG in ids:
        return None
    semi = bytes([k[";"]])
    return rule.sub(lambda m: m.group(1) + semi, ids).translate(None, b"\xfe") + b"\0", None


# ---------------------------------------------------------------- Java

JAVA_GRAMMAR = """
# The project's own indexer takes reserved words as parts of package paths (such files have chunks); no rule of the language, a dialect of ours.
path ! : word ('.' word)* ;
word ! : NAME | PRIM | 'void' | KEYWORDS ;
start_unit : (anno* 'package' path ';')? (';' | 'import' 'static'? path ('.' '*')? ';')* (typedecl | ';')* ;
start_module : ('import' 'static'? qname ('.' '*')? ';')* anno* 'open'? 'module' qname '{' (('requires' ('transitive' | 'static')* qname | ('exports' | 'opens') qname ('to' qname (',' qname)*)? | 'uses' qname | 'provides' qname 'with' qname (',' qname)*) ';')* '}' ;
qname ! : NAME ('.' NAME)* ;
anno : '@' qname ('(' (NAME '=' aval (',' NAME '=' aval)* | aval)? ')')? ;
aval : cond | anno | '{' (aval (',' aval)*)? ','? '}' ;
mod ! : 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed' | anno ;
typedecl ! : mod* (class | iface | enum | record | atype) ;
class ! : 'class' NAME tparams? ('extends' type)? ('implements' types)? ('permits' types)? cbody ;
iface ! : 'interface' NAME tparams? ('extends' types)? ('permits' types)? cbody ;
atype ! : '@' 'interface' NAME cbody ;
enum ! : 'enum' NAME ('implements' types)? '{' (econst (',' econst)*)? ','? (';' member*)? '}' ;
econst ! : anno* NAME ('(' args? ')')? cbody? ;
record ! : 'record' NAME tparams? '(' (parm (',' parm)*)? ')' ('implements' types)? cbody ;
cbody : '{' member* '}' ;
member : ';' | 'static'? block | mod* (class | iface | enum | record | atype | tparams? rest) ;
rest ! : anytype NAME ('(' (parm (',' parm)*)? ')' dims ('throws' types)? (block | ';' | 'default' aval ';') | dims ('=' init)? (',' NAME dims ('=' init)?)* ';') | NAME '(' (parm (',' parm)*)? ')' ('throws' types)? block | NAME block ;
parm ! : (mod* anytype anno* '...'? (NAME dims | (NAME '.')? 'this')) ;
dims ! : (anno* '[' ']')* ;
types ! : type (',' type)* ;
type : anytype ;
anytype ! : anno* (PRIM | NAME targs? ('.' anno* NAME targs?)*) dims ;
tparams : '<' tparam (',' tparam)* '>' ;
tparam ! : anno* NAME ('extends' type ('&' type)*)? ;
targs : '<' (targ (',' targ)*)? '>' ;
targ ! : type | anno* '?' (('extends' | 'super') type)? ;
init ! : expr | braces ;
braces : '{' (init (',' init)*)? ','? '}' ;
block : '{' bstmt* '}' ;
bstmt ! : local | mod* (class | iface | enum | record) | inner ;
local ! : ('final' | anno)* anytype NAME dims ('=' init)? (',' NAME dims ('=' init)?)* ';' ;
stmt : inner ;
inner ! : block | ';' | flat | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (('final' | anno)* anytype NAME dims ('=' init)? (',' NAME dims ('=' init)?)* | choice (',' expr)*)? ';' expr? ';' exprs? ')' stmt | 'for' '(' ('final' | anno)* anytype NAME dims ':' expr ')' stmt
  | 'try' block ((catch+ ('finally' block)?) | 'finally' block) | 'try' '(' res (';' res)* ';'? ')' block catch* ('finally' block)?
  | switch | 'synchronized' '(' expr ')' block | NAME ':' stmt ;
flat ! : choice ';' | 'return' expr? ';' | 'throw' expr ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'assert' expr (':' expr)? ';' | 'yield' expr ';' ;
catch ! : 'catch' '(' ('final' | anno)* type ('|' type)* NAME ')' block ;
res ! : ('final' | anno)* anytype NAME '=' expr | primary ;
switch : 'switch' '(' expr ')' '{' (('case' label (',' label)* ('when' expr)? | 'default') (':' bstmt* | '->' (expr ';' | block | 'throw' expr ';')))* '}' ;
label ! : cond | 'default' | pattern ;
pattern : ('final' | anno)* anytype (NAME | '(' (pattern (',' pattern)*)? ')' NAME?) ;
exprs ! : expr (',' expr)* ;
expr : choice ;
choice ! : lambda | place ('=' | ASSIGN) expr | cond ;
# What may be assigned to: names, fields, array items, these in brackets.
place ! : NAME | '(' expr ')' | primary ('.' NAME | '[' expr ']') ;
lambda ! : (NAME | '(' (NAME (',' NAME)* | parm (',' parm)*)? ')') '->' (expr | block) ;
cond ! : bins ('?' expr ':' other)? ;
other : lambda | cond ;
bins ! : unary ((BIN | '+' | '-' | '*' | '&' | '|' | '<' | '>' | '>' '>' | '>' '>' '>') unary | 'instanceof' ('final'? type NAME? | pattern))* ;
unary ! : ('+' | '-' | '!' | '~' | INCR)* (cast | primary INCR*) ;
cast : '(' (PRIM dims | type ('&' type)*) ')' (('+' | '-' | '!' | '~' | INCR)* (cast | primary INCR*) | lambda) ;
primary ! : atom trail* ;
atom ! : NAME | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | 'new' creator | PRIM dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | NAME ('.' NAME)* ('[' ']')+ ('.' 'class' | '::' 'new') | anytype '::' (NAME | 'new') | switch ;
creator : targs? anno* (NAME targs? ('.' anno* NAME targs?)* | PRIM) ('(' args? ')' cbody? | ('[' expr ']')+ dims | ('[' ']')+ '{' (init (',' init)*)? ','? '}') ;
trail ! : '.' (targs? NAME | 'this' | 'class' | 'new' creator | targs? 'super') | '[' expr ']' | '(' args? ')' | '::' targs? (NAME | 'new') ;
args ! : expr (',' expr)* ;
"""
_JAVA_SOFT = {k: "NAME" for k in "record sealed permits yield when open module requires transitive exports opens to uses provides with".split()}
JAVA_HARD = "abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while null true false".split()
JAVA_PRIM = "boolean byte short int long char float double".split()
_JAVA_NUM = r"0[xX](?:_*[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+[fFdD]?)?[lL]?|0[bB](?:_*[01])+[lL]?|(?:\d(?:_*\d)*\.(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*|\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?[fFdDlL]?"
_JAVA_STR = r"\"\"\"[ \t\f]*\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n]))'"
_JAVA_NAME = r"(?:[^\W\d]|\$)[\w$]*"
JAVA_TOKENS = re.compile(rf"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*+({_JAVA_STR}|(?:{_JAVA_NUM})(?![\w$])|non-sealed|{_JAVA_NAME}|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^<>=!?~:;,.()\[\]{{}}@]|[\s\S])")
_JAVA_NAME_ONLY, _JAVA_NUM_ONLY = re.compile(_JAVA_NAME), re.compile(_JAVA_NUM)


def _java_kind(t: str, g: Grammar) -> int:
    k = g.kinds
    c = t[0]
    if _JAVA_NAME_ONLY.fullmatch(t):
        return k["PRIM"] if t in JAVA_PRIM else k["void"] if t == "void" else k[t] if t in JAVA_HARD and t in k else k[t] if t in g.soft else k["NAME"] if t not in ("const", "goto", "_") else -1
    if c in "\"'" and len(t) > 1:
        return k["STR"]
    if _JAVA_NUM_ONLY.fullmatch(t):
        return k["NUM"]
    if t in ("++", "--"):
        return k["INCR"]
    if t in k and t != END_KIND:
        return k[t]
    if t in ("/", "%", "^", "<<", "<=", ">=", "==", "!=", "&&", "||"):
        return k["BIN"]
    if len(t) > 1 and t[-1] == "=":
        return k["ASSIGN"]
    return -1


def _plain_scan(tokens: re.Pattern, kind_of: Callable[[str, Grammar], int], text: str, g: Grammar) -> Scanned | None:
    """Kinds of a language without line ends of its own; a NUL behind the text stops the last comment from being read again."""
    toks = tokens.findall(text + "\n\0")
    ids = bytes(map(_kinds(g, kind_of).__getitem__, toks[:-1]))
    return None if WRONG in ids or toks[-1] != "\0" else (ids + b"\0", None)


def scan_java(text: str, g: Grammar) -> Scanned | None:
    return _plain_scan(JAVA_TOKENS, _java_kind, _unix(text).rstrip("\x1a"), g)


# ---------------------------------------------------------------- JSON

JSON_GRAMMAR = """
start_value : value ;
value : STR | NUM | LITERAL | '{' (STR ':' value (',' STR ':' value)*)? '}' | '[' (value (',' value)*)? ']' ;
"""
JSON_TOKENS = re.compile(r"[ \t\r\n]*+(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|true|false|null|[{}\[\]:,]|[\s\S])")


def _json_kind(t: str, g: Grammar) -> int:
    k = g.kinds
    if t in "{}[]:,":
        return k[t]
    if t in ("true", "false", "null"):
        return k["LITERAL"]
    if t[0] == '"' and len(t) > 1:
        return k["STR"]
    return k["NUM"] if t[0] in "-0123456789" and t != "-" else -1


def scan_json(text: str, g: Grammar) -> Scanned | None:
    return _plain_scan(JSON_TOKENS, _json_kind, text.removeprefix("﻿"), g)


# ---------------------------------------------------------------- YAML

YAML_GRAMMAR = """
start_stream : DIRECTIVE* doc? ((DOCEND DIRECTIVE*)* DOCSTART doc?)* DOCEND* ;
doc : props? (map | seq) | inline NL ;
map : (pair)+ ;
pair : (KEY | QKEY) ((props? inline)? NL (INDENT (props NL)? (map | seq | cont) DEDENT)? | props NL (INDENT (map | seq | cont) DEDENT | sseq)? | NL sseq | blocks)
  | QMARK (item) (COLON item)? ;
sseq : (SDASH item)+ ;
seq : (DASH item)+ ;
item : NL (INDENT (map | seq | cont) DEDENT)? | props? inline NL (INDENT cont DEDENT)? | props NL (INDENT (map | seq | cont) DEDENT)? | blocks | NESTED props? (map | seq) DEDENT ;
cont : (inline NL)+ ;
blocks : props? BLOCK ;
props : (ANCHOR | TAG)+ ;
inline : SCALAR+ | QUOTED | ALIAS | flow ;
flow : '[' (fitem (',' fitem)* ','?)? ']' | '{' (fpair (',' fpair)* ','?)? '}' ;
fitem : fnode (':' fnode?)? | ':' fnode? ;
fpair : QMARK? fnode (':' fnode?)? | ':' fnode? ;
fnode : props? (SCALAR+ | QUOTED | ALIAS | flow) | props ;
"""
_Y_QUOTED = re.compile(r"\"(?:[^\"\\]|\\(?:[0abt\tnvfre \"/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'(?:[^']|'')*'")
_Y_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s]))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]|:\S))*")
_Y_FLOWPLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#:,\[\]{}]))*")


def scan_yaml(text: str, g: Grammar) -> Scanned | None:
    """Block structure as INDENT and DEDENT, one token for each scalar; None where indentation or a scalar is impossible."""
    k = g.kinds
    out = bytearray()
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f￾￿]", text):
        return None
    lines = text.split("\n")
    stack = [-1]  # columns of the open collections
    kinds = [""]
    n, row = len(lines), 0

    def close(col: int) -> None:
        while stack[-1] > col:
            stack.pop()
            if kinds.pop() != "top":
                out.append(k["DEDENT"])

    while row < n:
        line = lines[row]
        body = line.lstrip(" ")
        if not body.strip() or body.lstrip("\t")[:1] == "#":
            row += 1
            continue
        if body[0] == "\t":
            return None
        col = len(line) - len(body)
        if col == 0 and re.match(r"(---|\.\.\.)(\s|$)", line):
            close(-1)
            stack, kinds = [-1], [""]
            out.append(k["DOCSTART"] if line[0] == "-" else k["DOCEND"])
            rest = line[3:]
            if not rest.strip() or rest.lstrip()[:1] == "#":
                row += 1
                continue
            body = rest.lstrip()
            if line[0] == ".":
                return None
            col = len(line) - len(body)
        elif col == 0 and line[0] == "%" and stack == [-1]:
            out.append(k["DIRECTIVE"])
            row += 1
            continue
        at = col
        if col > stack[-1]:
            stack.append(col)
            if len(stack) == 2:
                kinds.append("top")
            else:
                kinds.append("in")
                out.append(k["INDENT"])
        else:
            close(col)
            if stack[-1] != col:
                return None
        # the entries of one line
        while True:
            if line[at] == "\t":
                return None
            m = re.match(r"-(?=[ \t]|$)", line[at:])
            if m or re.match(r"\?(?=[ \t]|$)", line[at:]) or re.match(r":(?=[ \t]|$)", line[at:]):
                c = line[at]
                out.append(k["DASH" if c == "-" else "QMARK" if c == "?" else "COLON"])
                nxt = at + 1
                while nxt < len(line) and line[nxt] in " \t":
                    nxt += 1
                if nxt >= len(line) or line[nxt] == "#":
                    out.append(k["NL"])
                    row += 1
                    break
                probe = line[nxt:]
                if re.match(r"[-?](?=[ \t]|$)", probe) or _yaml_key(probe):
                    if "\t" in line[at + 1 : nxt]:
                        return None
                    out.append(k["NESTED"])
                    stack.append(nxt)
                    kinds.append("in")
                    at = nxt
                    continue
                got = _yaml_value(lines, row, nxt, at, k, out)
                if got is None:
                    return None
                row = got
                break
            key = _yaml_key(line[at:])
            if key:
                out.append(k["QKEY" if line[at] in "\"'" else "KEY"])
                nxt = at + key
                while nxt < len(line) and line[nxt] in " \t":
                    nxt += 1
                if nxt >= len(line) or line[nxt] == "#":
                    out.append(k["NL"])
                    row += 1
                    break
                got = _yaml_value(lines, row, nxt, at, k, out)
                if got is None:
                    return None
                row = got
                break
            got = _yaml_value(lines, row, at, stack[-2] if len(stack) > 1 else -1, k, out)
            if got is None:
                return None
            row = got
            break
    close(-1)
    out.append(0)
    # sequences at the column of their key: a DASH right after KEY NL belongs to the key
    fixed = bytearray()
    key, qkey, nl, dash, sdash, indent_, dedent, nested = (k[x] for x in ("KEY", "QKEY", "NL", "DASH", "SDASH", "INDENT", "DEDENT", "NESTED"))
    open_: list[bool] = [False]  # whether dashes at this depth belong to the key before them
    for i, x in enumerate(out):
        if x in (indent_, nested):
            open_.append(False)
        elif x == dedent:
            if len(open_) > 1:
                open_.pop()
        elif x == dash:
            if i >= 1 and out[i - 1] == nl and i >= 2 and out[i - 2] in (key, qkey, k["ANCHOR"], k["TAG"]):
                open_[-1] = True
            if open_[-1]:
                fixed.append(sdash)
                continue
        elif x in (key, qkey):
            open_[-1] = False
        fixed.append(x)
    return bytes(fixed), None


def _yaml_key(s: str) -> int:
    """Length of `key:` at the start of `s`, 0 if there is none. Anchors and tags before a key count with it."""
    at = 0
    m = re.match(r"(?:[&!][^\s]*[ \t]+)+", s)
    if m:
        at = m.end()
    m = _Y_QUOTED.match(s, at) or _Y_PLAIN.match(s, at) or re.compile(r"\*[^\s:,\[\]{}]+").match(s, at)
    if not m or "\n" in m.group():
        return 0
    e = m.end()
    m2 = re.compile(r"[ \t]*:(?=[ \t]|$)").match(s, e)
    return m2.end() if m2 else 0


def _yaml_value(lines: list[str], row: int, at: int, parent: int, k: dict[str, int], out: bytearray) -> int | None:
    """Scan the value that begins at lines[row][at:]; the next row, or None. `parent` is the column it must be indented from."""
    line = lines[row]
    while True:
        m = re.compile(r"([&!])[^\s,\[\]{}]*").match(line, at)
        if not m:
            break
        out.append(k["ANCHOR" if m.group(1) == "&" else "TAG"])
        at = m.end()
        while at < len(line) and line[at] in " \t":
            at += 1
        if at >= len(line) or line[at] == "#":
            out.append(k["NL"])
            return row + 1
    c = line[at]
    if c in "|>":
        if not re.fullmatch(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:#.*)?", line[at:]) and not re.fullmatch(r"[|>](?:[+-]?[1-9]?|[1-9][+-])(?:[ \t]+#.*)?[ \t]*", line[at:]):
            return None
        row += 1
        while row < len(lines) and (not lines[row].strip() or len(lines[row]) - len(lines[row].lstrip(" ")) > parent):
            row += 1
        out.append(k["BLOCK"])
        return row
    if c in "[{":
        return _yaml_flow(lines, row, at, parent, k, out)
    if c in "\"'":
        text, r = line[at:], row
        m = _Y_QUOTED.match(text)
        while not m and r + 1 < len(lines):
            r += 1
            text += "\n" + lines[r]
            m = _Y_QUOTED.match(text)
        if not m:
            return None
        tail = text[m.end() :]
        if tail.strip() and not re.match(r"\s+#", tail):
            return None
        out += bytes([k["QUOTED"], k["NL"]])
        return r + 1
    if c == "*":
        m = re.compile(r"\*[^\s,\[\]{}]+[ \t]*(?:#.*)?$").match(line, at)
        if not m:
            return None
        out += bytes([k["ALIAS"], k["NL"]])
        return row + 1
    m = _Y_PLAIN.match(line, at)
    if not m:
        return None
    tail = line[m.end() :]
    if tail.strip() and not re.match(r"[ \t]+#", tail):
        return None
    out += bytes([k["SCALAR"], k["NL"]])
    row += 1
    while row < len(lines):  # a plain scalar goes on over deeper lines
        body = lines[row].lstrip(" ")
        if not body.strip():
            row += 1
            continue
        if len(lines[row]) - len(body) <= parent or body[0] == "#":
            break
        stripped = body.strip()
        if re.match(r"(---|\.\.\.)(\s|$)", lines[row]):
            break
        if re.search(r":(?=[ \t]|$)", re.sub(r"[ \t]#.*", "", stripped)):
            return None
        row += 1
    return row


def _yaml_flow(lines: list[str], row: int, at: int, parent: int, k: dict[str, int], out: bytearray) -> int | None:
    depth = 0
    line = lines[row]
    while True:
        while at < len(line) and line[at] in " \t":
            at += 1
        if at >= len(line) or line[at] == "#":
            if depth == 0:
                out.append(k["NL"])
                return row + 1
            row += 1
            if row >= len(lines):
                return None
            line, at = lines[row], 0
            if line.strip() and len(line) - len(line.lstrip(" ")) <= parent and line.strip()[0] not in "]}":
                return None
            continue
        if depth == 0 and out and out[-1] in (k["]"], k["}"]):
            return None
        c = line[at]
        if c in "[]{},":
            out.append(k[c])
            depth += (c in "[{") - (c in "]}")
            if depth < 0:
                return None
            at += 1
        elif c in "\"'":
            text, r = line[at:], row
            m = _Y_QUOTED.match(text)
            while not m and r + 1 < len(lines):
                r += 1
                text += "\n" + lines[r]
                m = _Y_QUOTED.match(text)
            if not m:
                return None
            out.append(k["QUOTED"])
            row, line, at = r, text, m.end()
        elif c == ":" and (at + 1 >= len(line) or line[at + 1] in " \t,[]{}" or out[-1] == k["QUOTED"]):
            out.append(k[":"])
            at += 1
        elif c == "?" and line[at + 1 : at + 2] in ("", " ", "\t"):
            out.append(k["QMARK"])
            at += 1
        elif c in "&!*":
            m = re.compile(r"[&!*][^\s,\[\]{}]*").match(line, at)
            out.append(k[{"&": "ANCHOR", "!": "TAG", "*": "ALIAS"}[c]])
            at = m.end()
        else:
            m = _Y_FLOWPLAIN.match(line, at)
            if not m:
                return None
            out.append(k["SCALAR"])
            at = m.end()


# ---------------------------------------------------------------- registry


def _with_words(grammar: str, words: list[str]) -> str:
    return grammar.replace("KEYWORDS", " | ".join(f"'{w}'" for w in words if w != "void"))


@functools.cache
def language(extension: str) -> Language | None:
    """The language of a file name extension, None if it is not supported. Built once in each process."""
    if extension == "py":
        g = Grammar(PY_GRAMMAR, {k: "NAME" for k in ("match", "case", "type")}, ("OPU", "OP", "AUG"))
        return Language("python", g, ["start_file"], scan_python)
    if extension == "js":
        return Language("javascript", Grammar(JS_GRAMMAR, _JS_SOFT), ["start_module", "start_script"], scan_js)
    if extension == "ts":
        return Language("typescript", Grammar(TS_GRAMMAR, _TS_SOFT), ["start_module", "start_script", "start_ambient"], scan_js)
    if extension == "go":
        # + - & ^ are both unary and binary
        return Language("go", Grammar(_with_words(GO_GRAMMAR, GO_HARD).replace("UN |", "UN | UNBIN |").replace("(BIN |", "(BIN | UNBIN |"), {}), ["start_file"], scan_go)
    if extension == "java":
        return Language("java", Grammar(_with_words(JAVA_GRAMMAR, JAVA_HARD).replace("(PRIM |", "(PRIM | 'void' |"), _JAVA_SOFT), ["start_unit", "start_module"], scan_java)
    if extension == "json":
        return Language("json", Grammar(JSON_GRAMMAR), ["start_value"], scan_json)
    if extension in ("yaml", "yml"):
        return Language("yaml", Grammar(YAML_GRAMMAR), ["start_stream"], scan_yaml)
    return None


def valid(text: str, extension: str) -> bool | None:
    """Whether some dialect of the extension's language derives the whole text; None if the language is not supported."""
    lang = language(extension)
    if lang is None:
        return None
    got = lang.scan(text, lang.grammar)
    return got is not None and lang.grammar.accepts(got[0], lang.starts, got[1])[0] is not None


