"""Source files that do not parse: lexers with a pushdown stack for each language, then what no sentence holds."""

from __future__ import annotations

import json
import re
import warnings

# File name extensions and the language whose grammar they promise.
EXTENSIONS = {
    "ts": "ts", "tsx": "ts", "mts": "ts", "cts": "ts", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "java": "java", "cs": "cs", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "hh": "cpp",
    "go": "go", "rs": "rust", "py": "python", "pyi": "python", "json": "json", "sql": "sql", "yml": "yaml", "yaml": "yaml",
}

#: What stands for a literal once the lexer has read it.
LITERAL = ""

# The words of each language that are no plain names (contextual words included).
_COMMON = "break case class continue default do else enum for if new return static switch this throw try while catch finally public private protected const"
WORDS = {
    "js": _COMMON + " async await debugger delete export extends from function get import in instanceof let of set super typeof var void with yield as assert",
    "ts": _COMMON + " async await debugger delete export extends from function get import in instanceof let of set super typeof var void with yield as assert abstract accessor any asserts boolean bigint constructor declare global implements infer interface is keyof module namespace never number object out override package readonly require satisfies string symbol type undefined unique unknown using",
    "java": _COMMON + " abstract assert boolean byte char double extends final float implements import instanceof int interface long native package short strictfp super synchronized throws transient void volatile var record sealed permits non yield when module requires exports opens provides uses with to",
    "cs": _COMMON + " abstract add alias and as ascending async await base bool by byte char checked decimal delegate descending double dynamic equals event explicit extern fixed float foreach from get global goto group implicit in init int interface internal into is join let lock long managed namespace not nint object on operator or orderby out override params partial readonly record ref remove required sbyte scoped sealed select set short sizeof stackalloc string struct typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where with yield",
    "cpp": _COMMON + " alignas alignof and asm auto bool char char8_t char16_t char32_t compl concept consteval constexpr constinit const_cast co_await co_return co_yield decltype delete double dynamic_cast explicit export extern final float friend goto import inline int long module mutable namespace noexcept not operator or override register reinterpret_cast requires short signed sizeof static_assert static_cast struct template thread_local typedef typeid typename union unsigned using virtual void volatile wchar_t xor",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate default dyn else enum extern fn for if impl in let loop macro_rules match mod move mut pub ref return self Self static struct super trait type union unsafe use where while yield auto raw safe",
}

_BLOCK = r"/\*.*?\*/"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^`{}]|`(?:[^`\\]|\\.)*`|\{(?:[^`{}]|`(?:[^`\\]|\\.)*`)*\})*\})*`"
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[\n+])|(?<=return)|(?<=typeof)|(?<=case))[ \t]*(?P<x>/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
LEXERS = {
    "js": rf"(?P<c>//[^\n]*|{_BLOCK}|\A\#![^\n]*)|{_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX}",
    "java": rf'(?P<c>//[^\n]*|{_BLOCK})|"""(?:[^\\]|\\.)*?"""|{_DQ}|{_CHAR}',
    "cs": rf'(?P<c>//[^\n]*|{_BLOCK}|^[ \t]*\#[a-z][^\n]*)|\$*"""+.*?"""+|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?{_DQ}|{_CHAR}',
    "cpp": rf'(?P<c>//[^\n]*|{_BLOCK}|^[ \t]*\#[ \t]*[a-z](?:[^\n\\/]|\\.|/(?!\*)|{_BLOCK})*)|R"(?P<d>[^\s()\\"]*)\(.*?\)(?P=d)"|{_DQ}|(?<![0-9a-fA-F]){_CHAR}|(?<=\d)\'(?=\d)',
    "go": rf"(?P<c>//[^\n]*|{_BLOCK})|{_DQ}|{_CHAR}|`[^`]*`",
    "rust": rf'(?P<c>//[^\n]*|/\*(?:[^*/]|/(?!\*)|\*(?!/)|/\*.*?\*/)*\*/)|b?r(?P<h>\#*)".*?"(?P=h)|"(?:[^"\\]|\\.)*"|{_CHAR}|\'[A-Za-z_]\w*',
}
LEXERS["ts"] = LEXERS["js"]
LEXERS = {k: re.compile(v, re.S | re.M) for k, v in LEXERS.items()}
CONTROL = {"if", "while", "for", "switch", "catch", "foreach", "using", "lock", "with", "synchronized", "match", "fixed"}
CLASSES = {k: {w: "c" if w in CONTROL else "r" if w in ("return", "throw") else "k" for w in v.split()} for k, v in WORDS.items()}

_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|>{7}(?: |$)|\|{7}(?: |$)|={7}$)", re.M)
_CONTROL_CHARS = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f�]")
_ODD = {
    "js": r"[^\w\s$@#()\[\]{}<>=+\-*/%&|^!~?:;,.\\​-‍﻿]", "java": r"[^\w\s$@()\[\]{}<>=+\-*/%&|^!~?:;,.﻿]", "cs": r"[^\w\s@()\[\]{}<>=+\-*/%&|^!~?:;,.﻿]",
    "cpp": r"[^\w\s$()\[\]{}<>=+\-*/%&|^!~?:;,.\\﻿]", "go": r"[^\w\s()\[\]{}<>=+\-*/%&|^!:;,.~﻿]", "rust": r"[^\w\s$@#()\[\]{}<>=+\-*/%&|^!?:;,.﻿]",
}
_ODD["ts"] = _ODD["js"]
_ODD = {k: re.compile(v) for k, v in _ODD.items()}
_WORD = re.compile(r"\d[\w.]*|[^\W\d][\w$]*|\$[\w$]*")
_SPACE, _LINES = re.compile(r"[ \t\f\v\xa0]+"), re.compile(r"[ \t]*(?:\r?\n[ \t]*)+")
_HEADER, _PARENS = re.compile(r"c ?(?:k )?\([^()]*\)"), re.compile(r"\([^()]*\)")

# Sequences of token classes that no sentence of the language holds. i: name, k: word of the
# language, c: its header words, r: return or throw, 0: number, s: other literal, p: a pair of
# parentheses and what is in it, C: a header with its parentheses.
_ALL = r"i i i i|(?<!\[)= ?[;)\]}]|(?<![+/])[+/%|^] ?[;)\]]|(?<!\.)\. ?[;)\]}]|, ?;|(?<!c)(?<!c )[(\[] ?;|\( ?,|[s0] [i0s]|c ?[;}=]|i ip ?: ?(?:\n|\Z)|[=+*/%<>&|] ?\n?\Z|\A ?[)\]},]"
_BAD = {
    # type annotations are no JavaScript: in parameters, after them, of results
    "js": _ALL + r"|i [i0s]|p [i0s]|\( ?(?:[^(){}\[\]?]*, ?)?i ?\?? ?: ?[iks]|p ?: ?[ik](?: ?\[ ?\])* ?\{",
    "ts": _ALL.replace("<>&|]", "<&|]") + r"|i [i0s]|(?<!@i)(?<!@i )p [i0s]",
    "java": _ALL + r"|i [0s]|i i i|[0s]\n[ik]|(?<!@i)(?<!@i )(?<=i)p\n[ir]|i ?:= ?",
    "cs": _ALL + r"|i [0s]|[0s]\n[ir]|(?<=i)p\n[ir]|i ?:= ?",
    "cpp": _ALL.replace("[s0] [i0s]", "0 [i0s]") + r"|\.ip\n[ikrc]|= ?[^;{}\n,()]*[i0s]\n[irc]|i ?:= ?",
    "go": _ALL.replace(r", ?;|", r"") + r"|i i i|i 0|s i|;\n(?:\Z|[^\n])",
    "rust": _ALL + r"|i [i0s]|[0s]\n[irk]|\n?p\n[ir]",
}
_BAD = {k: re.compile(v) for k, v in _BAD.items()}


class _Broken(Exception):
    """What the lexer cannot go on from; its text is the reason."""


_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_MARK = re.compile(r"[\"'`/<()\[\]{}]")
_TAG = re.compile(r"<(?:[A-Za-z_$][\w$.:-]*(?=[\s/>{]|\Z)|(?=\s*>))")
_TAG_TOKEN = re.compile(r"\s+|/\*.*?\*/|//[^\n]*|[\w$.:@-]+|=|\"[^\"]*\"|'[^']*'|/\s*>|[>{]", re.S)
_TAG_END = re.compile(r"</\s*[\w$.:-]*\s*>")
_TEXT = re.compile(r"[^<{]*")
_LAST_WORD = re.compile(r"(?<![\w$.])[a-z]+\Z")
# Words after which an operand begins, and words whose parentheses are a header.
_BEFORE_OPERAND = frozenset("return typeof case in of delete void instanceof new throw do else yield await default extends".split())
_HEADS = frozenset("if while for with await".split())
_CLOSES = {"(": ")", "[": "]", "{": "}"}


def lex_js(text: str, jsx: bool) -> str:
    """Code of JavaScript or TypeScript without comments, each literal one mark; raises _Broken.

    One pass with a pushdown stack, whose top says how to read on: brackets, the
    expressions within templates (`), tags (T), the text between tags (C), and the
    expressions within both (E). What stands within ${} and within braces of tags comes
    out in parentheses behind the literal that it is part of.
    """
    out: list[str] = []
    stack: list[tuple[str, bool]] = []  # and whether a ( is a header's, a { a block's
    pos, n = (text.index("\n") if text.startswith("#!") and "\n" in text else 0), len(text)
    tail, head, block = "", False, True  # last code, and whether what closed last was a header, a block

    def operand_next() -> bool:
        """Whether an operand may stand here: then / begins a regular expression and < an element."""
        if not tail:
            return True
        c = tail[-1]
        if c == ")":
            return head
        if c == "}":
            return block
        if c in "+-":
            return tail[-2:] not in ("++", "--")
        if c in "=(,:;!&|?{[*%<>~^":
            return True
        w = _LAST_WORD.search(tail)
        return bool(w) and w[0] in _BEFORE_OPERAND

    def template(at: int) -> int:
        m = _CHUNK.match(text, at)
        if not m:
            raise _Broken("literal template")
        if m[1] != "`":
            stack.append(("`", False))
            out.append("(")
        return m.end()

    while True:
        top = stack[-1][0] if stack else ""
        if top == "T":
            m = _TAG_TOKEN.match(text, pos)
            if not m:
                raise _Broken("tag")
            pos = m.end()
            if m[0] == "{":
                stack.append(("E", False))
                out.append("(")
                tail = "("
            elif m[0] == ">":
                stack[-1] = ("C", False)
            elif m[0][0] == "/" and m[0][-1] == ">":
                stack.pop()
                tail = LITERAL
            continue
        if top == "C":
            pos = _TEXT.match(text, pos).end()
            if pos >= n:
                raise _Broken("tag not closed")
            if text[pos] == "{":
                stack.append(("E", False))
                out.append("(")
                tail, pos = "(", pos + 1
            elif m := _TAG_END.match(text, pos):
                stack.pop()
                tail, pos = LITERAL, m.end()
            elif m := _TAG.match(text, pos):
                stack.append(("T", False))
                pos = m.end()
            else:
                raise _Broken("tag")
            continue
        m = _MARK.search(text, pos)
        if not m:
            out.append(text[pos:])
            break
        i, c = m.start(), m[0]
        if i > pos:
            part = text[pos:i]
            out.append(part)
            if part := part.rstrip():
                tail = part[-16:]
        pos = i + 1
        if c in "([{":
            word = _LAST_WORD.search(tail) if c != "[" else None
            if c == "(":
                stack.append((c, bool(word) and word[0] in _HEADS))
            else:
                stack.append((c, c == "{" and (not tail or tail[-1] in ");{}>" or tail[-1].isalnum() and not (word and word[0] in _BEFORE_OPERAND - {"do", "else"}))))
            out.append(c)
            tail = c
        elif c in ")]}":
            if not stack:
                raise _Broken("bracket")
            opened, kind = stack.pop()
            if opened == "`" and c == "}":
                out.append(")")
                tail = LITERAL
                pos = template(pos)
            elif opened == "E" and c == "}":
                out.append(")")
            elif _CLOSES.get(opened) == c:
                out.append(c)
                tail = c
                head, block = (kind, block) if c == ")" else (head, kind)
            else:
                raise _Broken("bracket")
        elif c == "/":
            if text.startswith("//", i):
                pos = text.find("\n", i)
                pos = n if pos < 0 else pos
            elif text.startswith("/*", i):
                pos = text.find("*/", i + 2) + 2
                if pos < 2:
                    raise _Broken("comment")
                out.append("\n" if "\n" in text[i:pos] else " ")
            elif operand_next() and (m := _REGEX.match(text, i)):
                out.append(LITERAL)
                tail, pos = LITERAL, m.end()
            else:
                out.append(c)
                tail = c
        elif c == "<":
            if jsx and tail[-1:] != "<" and operand_next() and (m := _TAG.match(text, i)) and not _TYPE_PARAMETERS.match(text, i):
                out.append(LITERAL)
                stack.append(("T", False))
                pos = m.end()
            else:
                out.append(c)
                tail = c
        elif c == "`":
            out.append(LITERAL)
            tail = LITERAL
            pos = template(pos)
        else:
            if not (m := _STRING.match(text, i)):
                raise _Broken("literal")
            out.append(LITERAL)
            tail, pos = LITERAL, m.end()
    if stack:
        raise _Broken("bracket not closed" if stack[-1][0] in _CLOSES else "literal not closed")
    return "".join(out)


_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|\bextends\b|=(?!\s*[\"'{]))")
_BRACKET = re.compile(r"[()\[\]{}]")


def _balanced(code: str) -> bool:
    """Whether brackets close in the order of a stack."""
    stack: list[str] = []
    for c in _BRACKET.findall(code):
        if c in _CLOSES:
            stack.append(_CLOSES[c])
        elif not stack or stack.pop() != c:
            return False
    return not stack


_IFS = re.compile(r"(?<![\w$.#@])(?:if|else|let)\b(?!\s*:)|[{}]")


def _lone_else(code: str, language: str) -> bool:
    """Whether a block has an else for which no if is left in it. In Rust a let may have one too."""
    stack = [0]
    for c in _IFS.findall(code):
        if c == "{":
            stack.append(0)
        elif c == "}":
            if len(stack) > 1:
                stack.pop()
        elif c == "if" or (c == "let" and language == "rust"):
            stack[-1] += 1
        elif c == "else":
            stack[-1] -= 1
            if stack[-1] < 0:
                return True
    return False


def _outermost(code: str) -> str:
    """`code` without what stands in braces."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            if not depth:
                out.append(code[last : m.start()])
            depth += 1
        else:
            depth -= 1
            if not depth:
                last = m.end()
    out.append(code[last:])
    return "{}".join(out)


# Macros whose arguments are expressions.
_PLAIN_MACROS = "println print eprintln eprint format vec write writeln assert assert_eq assert_ne debug_assert panic matches todo unimplemented unreachable".split()
_MACRO = re.compile(rf"\b(?!(?:{'|'.join(_PLAIN_MACROS)})\b)\w+!\s*\w*\s*([(\[{{])")


def _without_macros(code: str) -> str:
    """`code` of Rust without the arguments of macros, which may be any tokens."""
    out, last = [], 0
    for m in _MACRO.finditer(code):
        if m.start() < last:
            continue
        depth = 0
        for b in _BRACKET.finditer(code, m.start(1)):
            depth += 1 if b[0] in _CLOSES else -1
            if not depth:
                break
        out.append(code[last : m.start()] + "x" + m[1] + _CLOSES[m[1]])
        last = b.end()
    return "".join([*out, code[last:]])


# What no sentence of the language holds, over code whose literals are marks.
_TWICE = r"\breturn[ \t]+return\b"
_STAR = rf"(?<![*+\-/%&|^])[+\-%&|^/][ \t]*\*(?![*=/])[ \t]*[\w({LITERAL}]"
_WRONG = {
    "js": rf"{_TWICE}|{_STAR}",
    "ts": rf"{_TWICE}|{_STAR}",
    "java": rf"{_TWICE}|{_STAR}|(?:(?<![\w.$])\d[\w.]*|{LITERAL})[ \t]+(?!instanceof\b)[A-Za-z_$]|(?<![\w$@.])(?!(?:if|while|for|switch|catch|synchronized|try|super|this)\b)\w+\(\)[ \t]+(?!(?:throws|default|instanceof|implements|extends|permits|when)\b)[A-Za-z_$]",
    "cs": _TWICE,
    "cpp": _TWICE,
    "go": _TWICE,
    "rust": rf"{_TWICE}|^[ \t]*let\b[^;{{}}\n]*=[^;{{}}\n]*[\w)\]{LITERAL}][ \t]*\n\s*(?:(?:let|return|for|while|fn|use|pub|struct|impl)\b|\}})",
}
_WRONG = {k: re.compile(v, re.M) for k, v in _WRONG.items()}
# Words with which a line outside all braces begins, where it is not indented.
_OUTER = {
    "go": re.compile(r"^(?!(?:package|import|const|var|type|func)\b)[A-Za-z_]\w*", re.M),
    "rust": re.compile(r"^(?!(?:use|mod|pub|fn|struct|enum|impl|trait|type|const|static|extern|unsafe|async|macro_rules|union|default|auto|crate|where|macro|safe|let)\b|r\#|[\w:]+!)[A-Za-z_]\w*(?!\s*(?:!|::|=>|->))\b(?=[ \t]+\w+[ \t]*[(<{])", re.M),
}


def classes(code: str, language: str) -> str:
    """The token classes of lexed code, one letter a token."""
    words = CLASSES[language]
    t = _WORD.sub(lambda m: words.get(m[0]) or ("0" if m[0][0].isdigit() else "i"), code).replace(LITERAL, "s")
    return _LINES.sub("\n", _SPACE.sub(" ", t))


def _first_branches(text: str) -> str:
    """`text` without what stands between #else or #elif and #endif."""
    out, skipped = [], [False]
    for line in text.split("\n"):
        if m := re.match(r"[ \t]*#[ \t]*(if|el|endif)", line):
            if m[1] == "if":
                skipped.append(skipped[-1])
            elif m[1] == "el":
                skipped[-1] = True
            elif len(skipped) > 1:
                skipped.pop()
            line = ""
        out.append("" if skipped[-1] else line)
    return "\n".join(out)


def _parse_c(text: str, language: str, jsx: bool = False) -> str | None:
    def literal(m):
        if m["c"] is not None:
            return "\n" if "\n" in m["c"] else " "
        if m[0][0] == "'" and m[0][-1] != "'":  # a lifetime
            return "T" if text[m.start() - 2 : m.start()] == "+ " else " "
        return LITERAL

    if _CONFLICT.search(text) and _CONFLICT.search(LEXERS[language].sub(literal, text)):
        return "conflict"
    if language in ("js", "ts"):
        try:
            code = lex_js(text, jsx)
        except _Broken as e:
            return "binary" if _CONTROL_CHARS.search(text) else str(e)
    else:
        code = LEXERS[language].sub(literal, text)
    if _CONTROL_CHARS.search(code):
        return "binary"
    if '"' in code or "'" in code or "`" in code:
        return "literal"
    if "/*" in code:
        return "comment"
    if _ODD[language].search(code):
        return "character"
    if not _balanced(code):
        # branches of the preprocessor may open what only one of them needs
        if language not in ("cpp", "cs") or not _balanced(code := LEXERS[language].sub(literal, _first_branches(text))):
            return "bracket"
    if bad := _WRONG[language].search(code):
        return f"statement {bad[0]!r}"
    # branches of the preprocessor and macros may hold an else without its if
    if not (language in ("cpp", "cs") and re.search(r"#\s*el", text) or language == "rust" and "!" in code) and _lone_else(code, language):
        return "statement else"
    if language in _OUTER and (bad := _OUTER[language].search(_outermost(code))):
        return f"statement {bad[0]!r}"
    if language == "rust":
        code = _without_macros(code)
    elif language in ("js", "ts"):
        code = re.sub(r"\bas\s+(?:catch|if|while|for|switch|with)\b", "as x", code)
    t = classes(code, language)
    t = re.sub(r"i(?: ?\?{0,1}\.\n?i)+", "i", t)
    n = -1
    while n != len(t):
        n = len(t)
        if bad := _BAD[language].search(t):
            return f"statement {t[max(0, bad.start() - 8) : bad.end() + 8]!r}"
        t = _PARENS.sub("p", _HEADER.sub("C", t))
    if extra := EXTRA.get(language):
        return extra(t, code)
    return None


def _go(t: str, code: str) -> str | None:
    return None if re.match(r"\s*package\s+\w+\s*(?:;|\n|\Z)", code) or not code.strip() else "statement package"


_TYPED = re.compile(r"\b(?:const|let|var)\s+[\w$]+\s*:\s*[\w{\[(]|^[ \t]*(?:export\s+)?(?:declare\s+)?(?:interface\s+\w+[^\n;=]*\{|type\s+\w+(?:<[^>\n]*>)?\s*=)", re.M)


def _js(t: str, code: str) -> str | None:
    return "statement type" if _TYPED.search(code) else None


EXTRA = {"go": _go, "js": _js}


# Operators with which no Python statement ends.
PYTHON_OPEN = frozenset("+ - * / // % ** @ = == != < > <= >= ~ & | ^ << >> . -> := += -= *= /= //= %= **= @= &= |= ^= <<= >>= not and or in is lambda if await".split())
_JSON = re.compile(r'(?P<s>[ \t\n\r]+)|(?P<v>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)|[\[\]{},:]', re.A)


def _parse_python(text: str) -> str | None:
    import ast

    if _CONFLICT.search(text):
        code = re.sub(r"'''.*?'''|\"\"\".*?\"\"\"", "", text, flags=re.S)
        if _CONFLICT.search(code):
            return "conflict"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        return "indent" if isinstance(e, IndentationError) else f"statement {e.msg}"
    except ValueError:
        return "binary"
    except (RecursionError, MemoryError):
        return _deep_python(text)
    return None


def _deep_python(text: str) -> str | None:
    """What the lexer and a stack of brackets find, for texts too deep for the parser."""
    import io
    import tokenize

    stack: list[str] = []
    last = ""
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.NEWLINE and last in PYTHON_OPEN and not re.search(r"\bimport\s*\*\s*(?:#.*)?$", t.line.rstrip()):
                return "statement end"
            if t.type == tokenize.OP:
                if t.string in "([{":
                    stack.append(t.string)
                elif t.string in ")]}" and (not stack or stack.pop() + t.string not in ("()", "[]", "{}")):
                    return "bracket"
            if t.type == tokenize.ERRORTOKEN:
                return "literal"
            if t.type not in (tokenize.COMMENT, tokenize.NL):
                last = t.string
    except IndentationError:
        return "indent"
    except (tokenize.TokenError, SyntaxError) as e:
        return f"statement {e}"[:60]
    return "bracket" if stack else None


def _parse_json(text: str) -> str | None:
    try:
        json.loads(text.removeprefix("﻿"))
    except ValueError as e:
        return "conflict" if _CONFLICT.search(text) else f"statement {e}"[:60]
    except (RecursionError, MemoryError):
        return _deep_json(text.removeprefix("\ufeff"))
    return None


def _deep_json(text: str) -> str | None:
    """The grammar of JSON by an explicit stack, for texts too deep for the parser."""
    stack: list[str] = []
    want, at = "value", 0  # value, first (a value or the end of a list), key, begin (a key or the end of an object), colon, next (a comma or an end), end
    for m in _JSON.finditer(text):
        if m.start() != at:
            break
        at, c = m.end(), m[0]
        if m["s"] is not None:
            continue
        if want in ("value", "first") and c in "[{":
            stack.append(c)
            want = "first" if c == "[" else "begin"
        elif (c == "]" and want in ("first", "next") and stack and stack[-1] == "[") or (c == "}" and want in ("begin", "next") and stack and stack[-1] == "{"):
            stack.pop()
            want = "next" if stack else "end"
        elif want in ("value", "first") and m["v"] is not None:
            want = "next" if stack else "end"
        elif want in ("key", "begin") and c[0] == '"':
            want = "colon"
        elif want == "colon" and c == ":":
            want = "value"
        elif want == "next" and c == ",":
            want = "value" if stack[-1] == "[" else "key"
        else:
            return f"statement at {m.start()}"
    if at != len(text):
        return "conflict" if _CONFLICT.search(text) else f"character at {at}"
    return None if want == "end" else "bracket"


# Words that begin an SQL statement, and words after which one cannot end.
SQL_BEGIN = "ALTER ANALYZE BEGIN CALL CHECKPOINT CLUSTER COMMENT COMMIT COPY CREATE DEALLOCATE DECLARE DELETE DELIMITER DESCRIBE DO DROP END EXEC EXECUTE EXPLAIN FETCH FLUSH GO GRANT IF IMPORT INSERT LOAD LOCK MERGE OPEN OPTIMIZE PRAGMA PREPARE PRINT REFRESH REINDEX RELEASE RENAME REPLACE RESET REVOKE ROLLBACK SAVEPOINT SELECT SET SHOW START TABLE TRUNCATE UNLOCK UPDATE USE VACUUM VALUES WHILE WITH".split()
SQL_OPEN = "ADD ALTER AND AS BETWEEN BY CREATE DELETE DISTINCT FROM GROUP HAVING IN INSERT INTO IS JOIN LIKE LIMIT NOT ON OR ORDER SELECT SET TABLE UNION UPDATE VALUES WHERE".split()
_SQL = re.compile(r"(?P<c>--[^\n]*|/\*.*?\*/)|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|(?P<d>\$\w*\$).*?(?P=d)|\[[A-Za-z_][\w ]*\]", re.S)
_SQL_BAD = re.compile(r"(?i)" + r"[,(] ?[,;)](?<!\( \))(?<!\(\))|, ?(?:FROM|WHERE|GROUP|ORDER|VALUES)\b|(?<!\S)(?:SELECT|WHERE|SET|BY) ?(?:;|$|\)|FROM\b|WHERE\b)|[=<>+/] ?(?:;|\)|,|$)| ?|" + r"(?:\b(?!(?:%s)\b)[a-z_]\w* ){5}" % "|".join("add all alter and any as asc begin between bigint boolean by cascade case char character check column commit constraint create cross current date day default delete desc distinct double drop each else end enum exists false first float for foreign from full function grant group having if ilike in index inner insert int integer interval into is join key last left like limit materialized natural no not null numeric of offset on only or order outer over partition password precision primary procedure recursive references replace restrict returning returns revoke right role row rows schema select sequence serial set smallint table temp temporary text then time timestamp to trigger true truncate type union unique unsigned update user using uuid values varchar varying view when where with without zone execute language after before instead new old rename owner database privileges public usage".split()))


def _parse_sql(text: str) -> str | None:
    code = _SQL.sub(lambda m: " " if m["c"] is not None else LITERAL, text)
    if _CONFLICT.search(code):
        return "conflict"
    if _CONTROL_CHARS.search(code):
        return "binary"
    if "'" in code or '"' in code or "`" in code:
        return "literal"
    if "/*" in code:
        return "comment"
    if "{" in code or "}" in code:
        return "character"
    if not _balanced(code):
        return "bracket"
    for s in code.split(";"):
        s = " ".join(s.split())
        if not s:
            continue
        words = s.upper().split(" ")
        if words[0].strip("(") not in SQL_BEGIN and s[0] != "\\":
            return "statement begin"
        if words[-1] in SQL_OPEN or s[-1] in ",=<>+(.":
            return "statement end"
        if words[0] in ("CREATE", "ALTER", "DROP", "INSERT", "UPDATE", "DELETE", "GRANT", "WITH") and len(words) < 3:
            return "statement end"
        if bad := _SQL_BAD.search(s):
            return f"statement {bad[0]!r}"
    return None


_KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},&*!|>'"%@`-][^#\n]*?|-[^\s#][^#\n]*?|\?)\s*:(?=\s|$)""")
_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", re.S)
_FLOW = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|(?:(?<=\s)|^)#[^\n]*", re.S)


def _parse_yaml(text: str) -> str | None:
    """Block structure by a stack of indents; flow collections by brackets; quotes over lines."""
    if _CONFLICT.search(text):
        return "conflict"
    if _CONTROL_CHARS.search(text):
        return "binary"
    lines = text.replace("\r\n", "\n").split("\n")
    stack: list[tuple[int, str]] = []  # indent and kind of each open block: map, seq
    i, n, plain = 0, len(lines), -1  # plain: least indent of lines that continue a plain scalar, -1 if none is open
    first_scalar = False
    while i < n:
        line = lines[i]
        i += 1
        body = line.strip()
        if not body or body[0] == "#":
            if body:
                plain = -1
            continue
        if line.startswith(("---", "...")) and (len(line) == 3 or line[3] in " \t"):
            stack, plain, first_scalar = [], -1, False
            continue
        if body[0] == "%" and not stack:
            continue
        indent = len(line) - len(line.lstrip(" "))
        if line[indent] == "\t":
            return "indent"
        rest, at = body, indent
        is_seq = rest == "-" or rest.startswith("- ")
        if plain >= 0 and indent >= plain and not (is_seq and stack and indent == stack[-1][0]):
            if _KEY.match(rest) and not is_seq:
                return "indent"  # a mapping inside a plain scalar
            continue
        plain = -1
        if first_scalar:
            return "statement"  # more follows a document that is one scalar
        while stack and stack[-1][0] > at:
            stack.pop()
        if stack and stack[-1][0] == at and stack[-1][1] == "seq" and not is_seq:
            stack.pop()  # a sequence may stand at its key's indent
        top = stack[-1][0] if stack else -1
        while is_seq:
            if not (stack and stack[-1] == (at, "seq")):
                if stack and stack[-1][0] == at and stack[-1][1] == "map" and not open_value:  # noqa: F821
                    return "statement"
                if stack and top < at and not open_value:  # noqa: F821
                    return "indent"
                stack.append((at, "seq"))
            inner = rest[1:]
            rest = inner.lstrip(" ")
            at += 1 + len(inner) - len(rest)
            open_value, top = True, stack[-1][0]
            is_seq = rest == "-" or rest.startswith("- ")
            if not rest:
                break
        if not rest or rest[0] == "#":
            open_value = True
            continue
        if m := _KEY.match(rest):
            if not (stack and stack[-1] == (at, "map")):
                if stack and not open_value:
                    return "indent"
                if not stack and at and any(l[:1].strip() and l[0] not in "#-%." for l in lines[: i - 1]):
                    return "indent"
                stack.append((at, "map"))
            rest = rest[m.end() :].strip()
            open_value = False
            if m[0][0] in "\"'" and not _QUOTED.match(m[0]):
                return "literal"
        elif stack and not (stack[-1][1] == "seq" or open_value):
            return "statement"
        elif not stack:
            first_scalar = True
        rest = re.sub(r"^(?:[&!][^\s]*\s*)+", "", rest)
        if not rest or rest[0] == "#":
            open_value = True
            continue
        open_value = False
        if rest[0] in "|>":
            if not re.fullmatch(r"[|>][+\-0-9]*\s*(?:#.*)?", rest):
                return "statement"
            parent = stack[-1][0] if stack else -1
            while i < n and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > parent):
                i += 1
        elif rest[0] in "\"'":
            whole, j = rest, i
            while not (m := _QUOTED.match(whole)):
                if j >= n or (lines[j].strip() and stack and not lines[j].startswith(" " * (stack[-1][0] + 1))):
                    return "literal"
                whole += "\n" + lines[j]
                j += 1
            i = j
            after = whole[m.end() :].strip()
            if after and after[0] != "#":
                return "literal"
        elif rest[0] in "[{":
            whole, j = rest, i
            while True:
                bare = _FLOW.sub("s", whole)
                depth = bare.count("[") + bare.count("{") - bare.count("]") - bare.count("}")
                if depth <= 0 or j >= n:
                    break
                if lines[j].strip() and stack and not lines[j].startswith(" " * (stack[-1][0] + 1)) and lines[j].strip()[0] not in "]}":
                    return "bracket"
                whole += "\n" + lines[j]
                j += 1
            i = j
            bare = _FLOW.sub("s", whole)
            if depth or not _balanced(bare) or '"' in bare:
                return "bracket"
            if re.search(r"[\]}]\s*[^\s,\]}:#s]", bare):
                return "statement"
        elif rest[0] in "@`%]},":
            return "character"
        elif rest[0] == "*":
            pass
        else:
            if re.search(r":\s", rest.split(" #")[0]) or rest.split(" #")[0].rstrip().endswith(":"):
                return "statement"
            plain = (stack[-1][0] if stack else -1) + 1
    return None


PARSERS = {"python": _parse_python, "json": _parse_json, "sql": _parse_sql, "yaml": _parse_yaml}


_JSX = re.compile(r"(?i)\.(?:[cm]?jsx?|tsx)\Z")


def language_of(path: str | None) -> str | None:
    """The grammar that the file name's extension promises; None where there is none to break."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def diagnose(text: str | None, path: str | None) -> str | None:
    """Why `text` is no valid text of its file's language; None if it parses, is null or empty, or has no grammar here."""
    language = language_of(path)
    if not text or not text.strip() or language is None:
        return None
    text = text.replace("\r\n", "\n")
    if language in PARSERS:
        return PARSERS[language](text)
    return _parse_c(text, language, _JSX.search(path) is not None)
