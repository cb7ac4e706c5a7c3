"""Small grammars for the languages of problem 5: token patterns and rules on which tokens may meet.

Python, JSON and TOML use the parsers of Python's library. The brace languages share one parser: it reads
tokens, matches brackets and checks each meeting of two tokens against the language's tables. YAML and shell
have their own line- and word-wise parsers. All take the whole text and say whether it is valid.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Grammar:
    """Tables of one brace language."""

    strings: str
    operators: str
    #: Words after which an operand may follow.
    lead: frozenset[str]
    #: Words that may follow an operand.
    infix: frozenset[str]
    #: Operators that may start an operand, and those that may end one.
    prefix: frozenset[str]
    postfix: frozenset[str]
    #: Words that may start a statement outside all brackets, or none for any.
    top: frozenset[str] = frozenset()
    first: str = ""
    #: A line's end ends a statement that could end there.
    newline_ends: bool = True
    #: Two names may meet as type and name.
    typed_names: bool = False
    generics: bool = False
    nested_comments: bool = False
    #: Words whose block needs a parenthesis first, and words before a function's name.
    paren_words: frozenset[str] = frozenset()
    function_words: frozenset[str] = frozenset()
    extra: frozenset[str] = frozenset()
    pattern: re.Pattern = field(init=False, default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        ops = "|".join(re.escape(o) for o in sorted(self.operators.split(), key=len, reverse=True))
        object.__setattr__(self, "pattern", re.compile(
            rf"(?:(?P<comment>//[^\n]*|/\*)|(?P<space>[ \t\r\f\v\ufeff]+)|(?P<newline>\n)|(?P<str>{self.strings})"
            rf"|(?P<num>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+)(?:[a-zA-Z]\w*)?)"
            rf"|(?P<word>[^\W\d]\w*[!]?(?=[(\[{{])|[^\W\d]\w*|[$\w]+)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<op>{ops}))[ \t\r]*"
        ))


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


DOUBLE, SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
C_OPS = "=== !== == != <= >= >>> << >> && || ++ -- += -= *= /= %= &= |= ^= <<= >>= => -> :: ... .. ?? ?. + - * / % = < > ! ~ & | ^ ? : ; , . @"
# The words and operators of each language.
JS_LEAD = words("async await break case class const continue default delete do else export extends finally for function get if import in instanceof let new of return set static switch throw try typeof var void while with yield from as")
TS_LEAD = JS_LEAD | words("abstract declare enum implements infer interface is keyof module namespace override private protected public readonly satisfies type unique asserts")
GRAMMARS = {
    "javascript": Grammar(
        strings=rf"{DOUBLE}|{SINGLE}", operators=C_OPS + " ** &&= ||= ??= #", lead=JS_LEAD, infix=words("of in instanceof as from extends"),
        prefix=words("! ~ + - ++ -- ... * #"), postfix=words("++ --"), paren_words=words("if while switch catch for"), function_words=words("function"), extra=words("js"),
    ),
    "typescript": Grammar(
        strings=rf"{DOUBLE}|{SINGLE}", operators=C_OPS + " ** &&= ||= ??= ?: # !:", lead=TS_LEAD, infix=words("of in instanceof as from extends implements is satisfies"),
        prefix=words("! ~ + - ++ -- ... * # @ | & <"), postfix=words("++ -- > >> >>> ! ?"), generics=True, paren_words=words("if while switch catch for"), function_words=words("function"), extra=words("js ts"),
    ),
    "java": Grammar(
        strings=rf'"""[\s\S]*?"""|{DOUBLE}|{SINGLE}', operators=C_OPS + " .* <> >>>=",
        lead=words("abstract assert break case catch class const continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public record return sealed static strictfp super switch synchronized this throw throws transient try volatile while yield non permits var boolean byte char double float int long short void"),
        infix=words("extends implements instanceof throws permits default"), prefix=words("! ~ + - ++ -- @ ? ..."), postfix=words("++ -- > >> >>> .* <> ? ..."),
        top=words("package import public private protected final abstract class interface enum record sealed static non @ ;"), newline_ends=False, typed_names=True, generics=True,
        paren_words=words("if while switch catch for synchronized"),
    ),
    "go": Grammar(
        strings=rf"`[^`]*`|{DOUBLE}|{SINGLE}", operators=C_OPS.replace("...", "") + " ... := <- &^ &^=",
        lead=words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"),
        infix=words("range struct interface map chan func"), prefix=words("! + - & * ^ <- ... ~"), postfix=words("++ -- ..."),
        top=words("package import func type var const"), first="package", typed_names=True, function_words=words("func"),
    ),
    "rust": Grammar(
        strings=rf'b?r#*"[\s\S]*?"#*|b?"(?:\\[\s\S]|[^"\\])*"|b?\'(?:\\[^\n]+?|[^\'\\\n])\'|\'[a-z_]\w*', operators=C_OPS + " ..= # $",
        lead=words("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while union box yield"),
        infix=words("as in where for if else mut dyn"), prefix=words("! - & && * | || .. ..= # < :: ? $"), postfix=words("? > >> >>> * .. $ !"),
        top=words("use pub fn struct enum impl trait const static type mod extern unsafe async macro_rules macro_rules! # union ;"), newline_ends=False, generics=True, nested_comments=True, function_words=words("fn"),
    ),
    "kotlin": Grammar(
        strings=rf'"""[\s\S]*?"""|{DOUBLE}|{SINGLE}', operators=C_OPS + " !! ?: .* !in !is ..<",
        lead=words("abstract annotation as break by catch class companion const constructor continue crossinline data do dynamic else enum expect external final finally for fun get if import in infix init inline inner interface internal is lateinit noinline null object open operator out override package private protected public reified return sealed set super suspend tailrec this throw try typealias typeof val value var vararg when where while actual"),
        infix=words("as by in is to until downTo step else where and or xor shl shr get set"), prefix=words("! + - ++ -- * :: @ .. !in !is ->"), postfix=words("++ -- !! ? > >> >>> .* *"),
        top=words("package import class object fun val var data private public internal protected sealed enum abstract open const annotation typealias @ interface override suspend inline lateinit operator tailrec infix external value expect actual final ;"),
        generics=True, nested_comments=True, paren_words=words("if while for catch"), function_words=words("fun"),
    ),
}
PAIRS = {")": "(", "]": "[", "}": "{"}
LIFETIME = "lifetime_"


class Invalid(Exception):
    """The text breaks a rule of the grammar."""


def tokens(text: str, g: Grammar) -> list[tuple[str, str, bool]]:
    """``(kind, text, after a line's end)``; raises Invalid where no token begins or one doesn't end."""
    out: list[tuple[str, str, bool]] = []
    at, fresh, n = 0, True, len(text)
    js = "js" in g.extra
    templates: list[int] = []
    depth = 0
    while at < n:
        if js and (text[at] == "`" or templates and text[at] == "}" and templates[-1] == depth):
            # A template: its fixed part up to the next placeholder or its end.
            m = re.compile(r"[`}](?:\\[\s\S]|\$(?!\{)|[^`\\$])*(\$\{|`)").match(text, at)
            if not m:
                raise Invalid("template")
            opened, closed = text[at] == "`", m.group(1) == "`"
            if opened:
                out.append(("str", "`", fresh))
                if not closed:
                    templates.append(depth)
                    out.append(("op", "+", False))
            elif closed:
                templates.pop()
                out += [("op", "+", False), ("str", "`", False)]
            else:
                out.append(("op", "+", False))
            at, fresh = m.end(), False
            continue
        if js and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            kind, last, _ = out[-1] if out else ("op", "", True)
            if kind in ("op", "open") and last not in ("++", "--") or kind == "word" and last in g.lead or last == "}":
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(text, at)
                if not m:
                    raise Invalid("regular expression")
                out.append(("str", "/", fresh))
                at, fresh = m.end(), False
                continue
        m = g.pattern.match(text, at)
        if not m:
            raise Invalid(f"character {text[at]!r}")
        kind = m.lastgroup or ""
        piece = m[kind]
        at = m.end()
        if kind == "newline":
            fresh = True
        elif kind == "comment":
            if piece == "/*":
                level = 1
                while level:
                    end = re.compile(r"\*/|/\*" if g.nested_comments else r"\*/").search(text, at)
                    if not end:
                        raise Invalid("comment")
                    level += 1 if end.group() == "/*" else -1
                    fresh |= "\n" in text[at : end.start()]
                    at = end.end()
        elif kind == "str" and piece[0] == "'" and (len(piece) == 1 or piece[-1] != "'"):
            out.append(("word", LIFETIME, fresh))
            fresh = False
        elif kind != "space":
            if kind == "open":
                depth += 1
            elif kind == "close":
                depth -= 1
            out.append((kind, piece, fresh))
            fresh = False
    if templates:
        raise Invalid("template")
    return out


#: Words that something must follow, and words whose parenthesis something may follow.
NEED_NAME = words("new const let var class import interface struct enum typeof instanceof throw package")
BEFORE_PAREN = words("for while if with switch")


def brace_language(text: str, g: Grammar) -> None:
    """Raise Invalid unless tokens, brackets and meetings of tokens are those of the language."""
    toks = tokens(text, g)
    if not toks:
        if g.first:
            raise Invalid("start")
        return
    js, typescript, go = "js" in g.extra, "ts" in g.extra, "func" in g.function_words
    if g.first and toks[0][1] != g.first:
        raise Invalid("start")
    stack: list[tuple[str, int]] = []
    opener: dict[int, int] = {}
    asked = [0]
    statement = True
    start_word = ""
    kind, t, fresh = "start", "", True
    nk, nt, n_fresh = toks[0]
    for i in range(len(toks)):
        pk, p = kind, t
        kind, t, fresh = nk, nt, n_fresh
        nk, nt, n_fresh = toks[i + 1] if i + 1 < len(toks) else ("end", "", True)
        ended = pk in ("str", "num", "close") or pk == "word" and (p not in g.lead or p in ("return", "break", "continue", "this", "self", "super", "null", "default", "fallthrough", "get", "set", "of", "as", "from", "async", "type", "data", "value")) or p in g.postfix and pk == "op"
        if not i or p in (";",) or p == "}" or p == "{" or (fresh and g.newline_ends and ended and not (kind == "op" and t not in g.prefix) and kind != "close" and t not in ("else", "catch", "finally", "while")):
            statement = pk != "op" or p == ";"
            start_word = t if statement else start_word
        else:
            statement = False
        inside = stack[-1][0] if stack else ""
        if statement and not stack and g.top and t not in g.top and not (p == "}" and (kind in ("op", "close") or t in ("else", "catch", "finally", "while"))):
            raise Invalid(f"top level {t!r}")
        if kind == "op":
            if js and t == "@" and not typescript:
                raise Invalid("@")
            if js and t == "#" and not stack or t in (">>", ">>>") and p in (">>", ">>>"):
                raise Invalid(t)
            binary = pk in ("op", "start", "open") and p not in g.postfix or pk == "word" and p in g.lead and p not in ("this", "self", "super", "null", "get", "set", "of", "as", "from", "type", "default", "crate", "async", "value", "data", "return", "break", "continue", "in", "out", "is", "init", "else", "class", "import", "loop", "static", "case", "import", "new", "yield", "export", "await", "throw") and t not in (".", ";", ":", "::", "?", "?:", "=>", "->", ",", "=", "<")
            if binary and t not in g.prefix and not (t == ";" and (p in (";", "{", "}") or inside == "(" or pk == "start")) and not (t == "," and inside == "[" and js) and not (t == ":" and p in ("default", "else", "?")) and not (t == "<" and g.generics and p in ("fun", "impl", "fn", ".")) and not (t == ">" and p in ("<", ",", "?") and g.generics) and not (t == "->" and p == "{") and not (t in (":", "?:") and p in ("?", ":") and go):
                raise Invalid(f"operator {p!r} {t!r}")
            if pk == "close" and p == "}" and fresh and t in ("=", "*", "/", "%", "==", "===", "<<", ">>", "+=", "<=", ">=") and not go:
                raise Invalid(f"operator after block {t!r}")
            if fresh and g.newline_ends and go and ended and t not in g.prefix:
                raise Invalid(f"line begins with {t!r}")
            if t == ";" and inside == "(" and not (stack[-1][1] and toks[stack[-1][1] - 1][1] in ("for", "await")) and not (stack and "try" == toks[stack[-1][1] - 1][1]):
                raise Invalid("; in parenthesis")
            if js:
                if t == "?" and not (typescript and nt in (":", ")", ",", ";", "=")):
                    asked[-1] += 1
                elif t == ":":
                    if asked[-1]:
                        asked[-1] -= 1
                    elif not typescript and (inside in ("(", "[") or not (inside == "{" and (pk in ("str", "num") or p == "]" or pk == "word" or p == ")") or start_word in ("case", "default") or i == 1 or toks[i - 2][1] in (";", "}", "{", ")"))):
                        raise Invalid("type in JavaScript")
                    elif not typescript and start_word in ("const", "let", "var", "function", "class", "private", "public") and inside != "{":
                        raise Invalid("type in JavaScript")
                    elif not typescript and toks[i - 2][1] in ("const", "let", "var", ")"):
                        raise Invalid("type in JavaScript")
        elif kind == "close":
            if not stack or stack[-1][0] != PAIRS[t]:
                raise Invalid(f"bracket {t!r}")
            opener[i] = stack.pop()[1]
            asked.pop()
            if pk == "op" and p not in g.postfix and p not in (",", ";", "}") and not (p == ":" and inside == "{") and not (p in ("*", "_") and go) and not (go and inside == "[" and p == ":") and not (p == "->") and not (p in ("..", ":", "=>") and inside in ("[", "{")):
                raise Invalid(f"operator {p!r} before {t!r}")
            if pk == "word" and (p in g.function_words or p in NEED_NAME):
                if not (p in ("class", "struct", "interface") or go and p in ("func",)):
                    raise Invalid(f"{p} before {t!r}")
        else:
            after_block = p == "}" or p == "{" or p == ";" or pk == "start"
            if kind in ("word", "num", "str") and ended and not after_block and not (fresh and g.newline_ends) and t not in g.infix:
                head = opener.get(i - 1, -1)
                before = toks[head - 1][1] if head > 0 else ""
                lead = pk == "word" and p in g.lead
                called = p == ")" and (before in g.paren_words or before in BEFORE_PAREN or before in g.function_words)
                signature = p == ")" and (go and (before in ("func",) or head > 1 and (toks[head - 2][1] == "func" or toks[head - 2][1] == ")" or toks[head - 1][1] in ("func", ")"))))
                named = g.typed_names and kind == "word" and (pk == "word" or p in ("]",)) and nk != "str" and (not go or inside == "(" or inside == "{" or start_word in ("type", "var", "const", "func", "import", "package") or p == "]")
                if named and not go:
                    named = nt in ("=", ";", ",", ")", "(", ":", "{", "[", "->", "...") or nt in ("throws", "extends", "implements")
                if named and go and inside == "{" and nk == "word" and not toks[i + 1][2]:
                    named = False
                cast = g.typed_names and not go and p == ")" and head >= 0 and i - 1 - head in (2, 4)
                annotated = pk == "word" and i > 1 and toks[i - 2][1] in ("@", ".") and g.top and "@" in g.top and _annotation(toks, i - 1) or p == ")" and head > 1 and toks[head - 2][1] == "@"
                macro = p == "]" and head > 0 and toks[head - 1][1] in ("#", "!")
                generic = p in g.postfix and pk == "op"
                if not (p == LIFETIME or lead or called or signature or named or cast or annotated or macro or generic):
                    raise Invalid(f"{p!r} {t!r}")
            if kind == "num" and t[-1].isalpha() and not re.fullmatch(r"(?:0[xXbBoO][\da-fA-F_]+|[\d_.]+(?:[eE][+-]?\d+)?)(?:[nfFdDlLuUi]|[iu](?:8|16|32|64|128|size)|f32|f64|UL|uL)?", t):
                raise Invalid(f"number {t!r}")
            if kind == "open":
                if js and t == "{" and statement and nk == "str" and toks[i + 2][1:2] == (":",):
                    raise Invalid("object at the start of a statement")
                stack.append((t, i))
                asked.append(0)
        if kind == "word" and t in g.paren_words and nt != "(" and not (p == "." or nt in (":", "=", ",")) and not (t == "for" and nt == "await") and not (t == "catch" and nt == "{") and not (t in ("while",) and nt == "("):
            raise Invalid(f"{t} without (")
        if kind == "word" and t in g.function_words and nk == "word" and toks[i + 2 : i + 3] and toks[i + 2][1] not in ("(", "<", "[", "."):
            raise Invalid(f"{t} without (")
        if kind == "word" and t in g.function_words and (nk == "end" or nk == "word" and i + 2 >= len(toks)):
            raise Invalid(f"{t} cut")
        if kind == "word" and t == "const" and js and nk == "word" and nt != "enum" and not (toks[i + 2 : i + 3] and toks[i + 2][1] in ("=", ":", "of", "in")):
            raise Invalid("const without value")
        if t == "}" and i in opener and g.typed_names and not go and p not in (";", "}", "{") and opener[i] > 1:
            bk, b, _ = toks[opener[i] - 1]
            if b == ")" or bk == "word" and toks[opener[i] - 2][1] != "enum" and b not in ("int", "long", "double", "String"):
                raise Invalid("statement without ;")
        if t == "}" and i in opener and (js or g.typed_names and not go) and opener[i] > 0 and toks[opener[i] - 1][1] == "try" and nt not in ("catch", "finally"):
            raise Invalid("try without catch")
    if stack:
        raise Invalid("bracket never closed")
    lk, lt, _ = toks[-1]
    if lk == "op" and lt not in (";",) and lt not in g.postfix or lk == "word" and lt in g.lead - words("this self super null return break continue get set of as from async type data value default"):
        raise Invalid("cut at the end")
    if not g.newline_ends and lt not in ("}", ";"):
        raise Invalid("cut at the end")


def _annotation(toks: list[tuple[str, str, bool]], i: int) -> bool:
    while i > 1 and toks[i - 1][1] == "." and toks[i - 2][0] == "word":
        i -= 2
    return i > 0 and toks[i - 1][1] == "@"


def python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text)


def strict_json(text: str) -> None:
    def refuse(value: str) -> None:
        raise Invalid(value)

    json.loads(text, parse_constant=refuse)


def toml(text: str) -> None:
    tomllib.loads(text.replace("\r\n", "\n"))


YAML_KEY = re.compile(r"""(?P<key>"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#&*!|>'"%@`{}\[\],?:-][^#{}\[\],]*?|[^\s#&*!|>'"%@`{}\[\],]*?[?:-][^\s#][^#{}\[\],]*?)\s*:(?:\s+|$)(?P<value>.*)$""")


def yaml(text: str) -> None:
    """Block mappings and lists by indentation, quoted, plain, block and flow scalars."""
    lines = text.replace("\r\n", "\n").split("\n")
    levels: list[tuple[int, str]] = []
    block, flow, quoted, open_value = -1, 0, "", False
    seen = False
    for line in lines:
        if block >= 0:
            if not line.strip() or len(line) - len(line.lstrip(" ")) > block:
                continue
            block = -1
        if quoted or flow:
            quoted, flow = _yaml_scalar(line, quoted, flow)
            continue
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if body in ("---", "...") or line.startswith("%YAML"):
            levels, open_value = [], False
            continue
        if line[: len(line) - len(line.lstrip())].count("\t"):
            raise Invalid("tab")
        indent = len(line) - len(line.lstrip(" "))
        plain_goes_on = levels and open_value and indent > levels[-1][0] and not re.match(r"- |-$", body) and not YAML_KEY.match(body)
        if plain_goes_on:
            if re.search(r":\s|\s#", body):
                raise Invalid("mapping in a scalar")
            continue
        while levels and indent < levels[-1][0]:
            levels.pop()
        if seen and not levels:
            raise Invalid("indentation")
        rest, col = body, indent
        while (m := re.match(r"-(?:\s+|$)", rest)) is not None:
            _yaml_level(levels, col, "list", open_value and col == indent)
            open_value = False
            col += m.end()
            rest = rest[m.end() :]
        seen = True
        if not rest or rest.startswith("#"):
            open_value = False
            continue
        m = YAML_KEY.match(rest)
        if m and not rest.startswith(("{", "[")):
            _yaml_level(levels, col, "map", open_value and col == indent)
            value = m.group("value").strip()
            open_value = False
        else:
            if rest is body:
                if levels or len([x for x in lines if x.strip() and not x.strip().startswith("#")]) > 1 and not rest.startswith(("{", "[", '"', "'")):
                    raise Invalid("no key")
            value = rest
        if not value or value.startswith("#"):
            continue
        value = re.sub(r"^(?:[&!]\S*\s+)+", "", value)
        if re.match(r"[|>][+-]?\d?[+-]?\s*(?:#.*)?$", value):
            block = levels[-1][0] if levels else 0
            continue
        if value[0] in "@`%":
            raise Invalid("reserved character")
        if value[0] in ",]}" or re.match(r"[-?:](?:\s|$)", value) or value[0] in "|>":
            raise Invalid("value")
        quoted, flow = _yaml_scalar(value, "", 0)
        if value[0] not in "\"'{[*&!":
            bare = re.split(r"\s#", value)[0]
            if re.search(r":(?:\s|$)", bare):
                raise Invalid("mapping in a value")
            open_value = True
    if quoted or flow:
        raise Invalid("never closed")


def _yaml_level(levels: list[tuple[int, str]], col: int, kind: str, after_scalar: bool) -> None:
    if levels and levels[-1][0] == col:
        if levels[-1][1] == kind:
            return
        if kind == "map" and levels[-1][1] == "list" and len(levels) > 1 and levels[-2] == (col, "map"):
            levels.pop()
            return
        if not (kind == "list" and levels[-1][1] == "map"):
            raise Invalid("mixed levels")
    elif levels and after_scalar and col > levels[-1][0]:
        raise Invalid("indentation")
    levels.append((col, kind))


def _yaml_scalar(value: str, quoted: str, flow: int) -> tuple[str, int]:
    """Follow quotes and flow brackets over one line."""
    i, start = 0, not quoted and not flow
    while i < len(value):
        ch = value[i]
        if quoted:
            if ch == "\\" and quoted == '"':
                i += 1
            elif ch == quoted:
                if quoted == "'" and value[i + 1 : i + 2] == "'":
                    i += 1
                else:
                    quoted = ""
                    rest = value[i + 1 :].strip()
                    if not flow and rest and not rest.startswith("#"):
                        raise Invalid("text after a quote")
        elif ch in "\"'" and (start or flow and re.search(r"[\[{,:]\s*$", value[:i])):
            quoted = ch
        elif ch in "[{" and (start or flow):
            flow += 1
        elif ch in "]}" and flow:
            flow -= 1
            rest = value[i + 1 :].strip()
            if not flow and rest and not rest.startswith("#"):
                raise Invalid("text after a bracket")
        elif ch == "#" and (i == 0 or value[i - 1].isspace()):
            break
        start = start and ch.isspace()
        i += 1
    return quoted, flow


def shell(text: str) -> None:
    """Bash: words, quotes, here-documents and the nesting of compound commands."""
    text = text.replace("\r\n", "\n")
    at, n, stack, start, expect = 0, len(text), [], True, ""
    heredocs: list[str] = []
    last_op = "\n"
    while at < n:
        ch = text[at]
        if ch == "\n":
            if expect == "target":
                raise Invalid("redirection")
            at += 1
            for tag in heredocs:
                m = re.compile(rf"^\t*{re.escape(tag)}$", re.M).search(text, at)
                if not m:
                    raise Invalid("here-document")
                at = m.end()
            heredocs = []
            start, last_op = True, "\n" if last_op not in ("|", "&&", "||") else last_op
            continue
        if ch in " \t" or text.startswith("\\\n", at):
            at += 2 if ch == "\\" else 1
            continue
        if ch == "#" and (at == 0 or text[at - 1] in " \t\n;(&|"):
            end = text.find("\n", at)
            at = n if end < 0 else end
            continue
        m = re.compile(r"<<-?\s*([\"']?)(\w+)\1").match(text, at)
        if m and not text.startswith("<<<", at):
            heredocs.append(m.group(2))
            at, start = m.end(), False
            continue
        m = re.compile(r";;&?|;&|&&|\|\||<<<|&>>|\d*>>|\d*[<>]&(?:\d+|-)?|&>|<>|>\||[;&|()]|\d*[<>]").match(text, at)
        if m and not (ch.isdigit() and m.group()[-1] not in "<>&-0123456789"):
            op = m.group()
            at = m.end()
            if expect == "target":
                raise Invalid("redirection")
            if op == "(" and stack and stack[-1] == "case-in" or op == "(" and text[at : at + 1] == "(":
                if text[at : at + 1] == "(" and not (stack and stack[-1] == "case-in"):
                    end = text.find("))", at)
                    if end < 0:
                        raise Invalid("((")
                    at, start = end + 2, False
                continue
            if op == "(":
                if re.compile(r"\s*\)").match(text, at):
                    if start:
                        raise Invalid("()")
                    at = re.compile(r"\s*\)").match(text, at).end()
                    start = True
                    last_op = "()"
                    continue
                if not start:
                    raise Invalid("(")
                stack.append("(")
                start = True
            elif op == ")":
                if stack and stack[-1] == "case-in":
                    stack[-1] = "case-body"
                    start = True
                elif stack and stack[-1] == "(":
                    stack.pop()
                    start = False
                else:
                    raise Invalid(")")
            elif op.startswith(";;") or op == ";&":
                if not stack or stack[-1] != "case-body":
                    raise Invalid(";;")
                stack[-1], start = "case-in", False
            elif op[-1] in "<>" and not op.endswith("&"):
                expect = "target"
                continue
            elif "&" in op and op[0] in "<>0123456789&" and op not in ("&", "&&"):
                if op.endswith("&") or op == "&>" or op == "&>>":
                    expect = "target"
                continue
            else:
                if start and last_op != "word" and not (op in (";", "&") and last_op == "}"):
                    raise Invalid(f"operator {op!r}")
                start = op != "|" or True
            last_op = op
            continue
        word, at = _shell_word(text, at)
        if expect == "target":
            expect = ""
            continue
        if stack and stack[-1] == "case-in":
            if word == "esac":
                stack.pop()
                start, last_op = False, "word"
            elif not re.compile(r"\s*[|)]").match(text, at):
                raise Invalid("pattern")
            elif text[at:].lstrip().startswith("|"):
                at = text.index("|", at) + 1
            continue
        if start:
            if word in ("if", "while", "until"):
                stack.append(word)
            elif word in ("then", "do"):
                want = ("if", "elif") if word == "then" else ("while", "until", "for", "select")
                if not stack or stack[-1] not in want:
                    raise Invalid(word)
                stack[-1] = word
            elif word in ("elif", "else"):
                if not stack or stack[-1] != "then":
                    raise Invalid(word)
                stack[-1] = word
            elif word == "fi":
                if not stack or stack[-1] not in ("then", "else"):
                    raise Invalid(word)
                stack.pop()
            elif word == "done":
                if not stack or stack[-1] != "do":
                    raise Invalid(word)
                stack.pop()
            elif word in ("for", "select"):
                m = re.compile(r"\s+(?:\(\(.*?\)\)|\w+(?:\s+in\b[^\n;]*)?)\s*[;\n]").match(text, at)
                if not m:
                    raise Invalid("for")
                stack.append(word)
                at = m.end()
                last_op = "\n"
                continue
            elif word == "case":
                _, at = _shell_word(text, re.compile(r"\s*").match(text, at).end())
                m = re.compile(r"\s+in\b").match(text, at)
                if not m:
                    raise Invalid("case")
                stack.append("case-in")
                at = m.end()
                continue
            elif word == "esac":
                if not stack or stack[-1] != "case-body":
                    raise Invalid(word)
                stack.pop()
            elif word == "{":
                stack.append("{")
            elif word == "}":
                if not stack or stack[-1] != "{":
                    raise Invalid("}")
                stack.pop()
            elif word == "[[":
                end = re.compile(r"\]\](?=[\s;&|)]|$)").search(text, at)
                if not end:
                    raise Invalid("[[")
                at = end.end()
            elif word == "function":
                _, at = _shell_word(text, re.compile(r"\s*").match(text, at).end())
                m = re.compile(r"\s*\(\s*\)").match(text, at)
                at = m.end() if m else at
                last_op = "()"
                continue
            if word in ("if", "while", "until", "then", "do", "else", "elif", "{", "!", "time"):
                last_op = "\n"
                continue
            if last_op == "()" and word not in ("{", "(", "if", "for", "while", "case", "[[") and not word.startswith("("):
                raise Invalid("function")
            start = False
        last_op = "word" if word not in ("}", "fi", "done", "esac") else "}"
    if stack or heredocs or expect:
        raise Invalid("never closed")
    if last_op in ("&&", "||", "|", "()"):
        raise Invalid("cut at the end")


def _shell_word(text: str, at: int) -> tuple[str, int]:
    """One word with its quotes and expansions; raises Invalid where one never closes."""
    begin, n = at, len(text)
    while at < n and text[at] not in " \t\n;&|()<>":
        ch = text[at]
        if ch == "\\":
            at += 2
        elif ch == "'":
            at = text.find("'", at + 1) + 1
            if not at:
                raise Invalid("quote")
        elif ch in "\"`":
            at = _shell_quoted(text, at + 1, ch)
        elif text.startswith(("${", "$("), at):
            at = _shell_quoted(text, at + 2, "}" if text[at + 1] == "{" else ")")
        elif ch == "$" and text[at + 1 : at + 2] == "'":
            m = re.compile(r"'(?:\\.|[^'\\])*'").match(text, at + 1)
            if not m:
                raise Invalid("quote")
            at = m.end()
        else:
            at += 1
            if text[at - 1] == "=" and text[at : at + 1] == "(":
                at = _shell_quoted(text, at + 1, ")")
    return text[begin:at], at


def _shell_quoted(text: str, at: int, end: str) -> int:
    while at < len(text):
        ch = text[at]
        if ch == end:
            return at + 1
        if ch == "\\":
            at += 2
        elif text.startswith(("${", "$("), at):
            at = _shell_quoted(text, at + 2, "}" if text[at + 1] == "{" else ")")
        elif end != '"' and ch == '"':
            at = _shell_quoted(text, at + 1, '"')
        elif end == ")" and ch == "(":
            at = _shell_quoted(text, at + 1, ")")
        elif end in ")" and ch == "'":
            at = text.find("'", at + 1) + 1
            if not at:
                raise Invalid("quote")
        else:
            at += 1
    raise Invalid("quote")


def _brace(name: str) -> Callable[[str], None]:
    return lambda text: brace_language(text, GRAMMARS[name])


PARSERS: dict[str, Callable[[str], None]] = {
    "python": python, "json": strict_json, "toml": toml, "yaml": yaml, "shell": shell, **{name: _brace(name) for name in GRAMMARS},
}


def parses(text: str, language: str) -> bool:
    """Whether the whole text is valid in the language; a text too deeply nested to be read is not."""
    try:
        PARSERS[language](text.removeprefix("\ufeff"))
    except (Invalid, SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def why(text: str, language: str) -> str:
    """What a parser says against the text, or an empty string."""
    try:
        PARSERS[language](text.removeprefix("\ufeff"))
    except (Invalid, SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return str(e)[:80] or type(e).__name__
    return ""
