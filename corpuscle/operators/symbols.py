"""Declarations, imports, exports, outlines and test cases of source files.

Container stacks and comment state need a file's lines in order; one Arrow
function folds each file. Everything after it is DataFrame operations.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, lexer
from ..functions import text as T
from .keep import small_batches

GLOBAL = "(global)"
# What a declaration looks like, by language: (kind, pattern, group of the name).
_MODS = r"(?:(?:public|private|protected|internal|static|abstract|final|sealed|partial|virtual|override|async|readonly|synchronized|native|default)\s+)*"
_CS_TYPE = r"(?:(?:required|const|volatile|extern|new|unsafe)\s+)*[A-Za-z_][\w.]*(?:<[^()=;]*>)?(?:\[[,\s]*\])*\??"
_CS_STATEMENTS = ["return", "throw", "await", "yield", "goto", "using", "new", "else", "case", "in", "is", "as", "var", "delegate"]
DECLARATIONS: dict[str, list[tuple[str, str, int]]] = {
    "python": [
        ("class", r"^\s*class\s+([A-Za-z_]\w*)", 1),
        ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", 1),
        ("variable", r"^([A-Za-z_]\w*)\s*=(?!=)", 1),
    ],
    "javascript": [
        ("type", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|type|enum)\s+([A-Za-z_$][\w$]*)", 2),
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?(?:default\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", 1),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)", 1),
        # a member: modifiers, an accessor or a generator's star, a plain or private name, type parameters, parameters
        ("method", r"^\s*(?:(?:declare|override|abstract|accessor|protected|private|public|readonly|static|async|get|set)\s+)*\*?\s*#?([A-Za-z_$][\w$]*)\??\s*(?:<[^(]*>)?\s*\(", 1),
    ],
    "java": [
        ("type", rf"^\s*{_MODS}(class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)", 2),
        ("method", rf"^\s*{_MODS}[A-Za-z_][\w<>,\[\]?\s.]*\s+([A-Za-z_]\w*)\s*\(", 1),
    ],
    "csharp": [
        ("type", rf"^\s*{_MODS}(class|interface|struct|enum|record|namespace)\s+(?:(?:class|struct)\s+)?([A-Za-z_][\w.]*)", 2),
        ("delegate", rf"^\s*{_MODS}(?:unsafe\s+)?delegate\s+{_CS_TYPE}\s+([A-Za-z_]\w*)\s*(?:<[\w,\s]+>)?\s*\(", 1),
        ("operator", rf"^\s*{_MODS}(?:extern\s+)?(?:(?:implicit|explicit)\s+operator\s+(?:checked\s+)?|{_CS_TYPE}\s+operator\s*(?:checked\s+)?)([^\s(]+(?:\(\))?)\s*\(", 1),
        ("indexer", rf"^\s*{_MODS}{_CS_TYPE}\s+(?:[A-Za-z_][\w.<>,]*\.)?(this)\s*\[", 1),
        ("event", rf"^\s*{_MODS}event\s+{_CS_TYPE}\s+([A-Za-z_]\w*)\s*[;={{,]", 1),
        ("constructor", rf"^\s*{_MODS}([A-Za-z_]\w*)\s*\(", 1),
        ("method", rf"^\s*{_MODS}{_CS_TYPE}\s+([A-Za-z_]\w*)\s*(?:<[\w,\s]+>)?\s*\(", 1),
        ("property", rf"^\s*{_MODS}{_CS_TYPE}\s+([A-Za-z_]\w*)\s*(?:\{{|=>)", 1),
        ("field", rf"^\s*{_MODS}{_CS_TYPE}\s+([A-Za-z_]\w*)\s*(?:=[^=>]|;|,)", 1),
    ],
    "go": [
        ("function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^()]*\])?\s*\(", 1),
        ("type", r"^\s*type\s+([A-Za-z_]\w*)\b", 1),
        ("variable", r"^\s*(?:var|const)\s+([A-Za-z_]\w*)\b", 1),
    ],
    "rust": [
        # visibility, then the qualifiers in any number (an ABI is a string, blanked), the name, type parameters and lifetimes, parameters
        ("function", r"^\s*(?:pub\b\s*(?:\([^)]*\)\s*)?)?(?:(?:default|const|async|unsafe|safe|extern)\b[\s\"]*)*\bfn\s+(?:r#)?([A-Za-z_]\w*)\s*[<(]", 1),
        ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait|type|mod|const|static)\s+(?!mut\b)([A-Za-z_]\w*)", 2),
    ],
    "cpp": [
        ("type", r"^\s*(?:template\s*<[^>]+>\s*)?(?:typedef\s+)?(class|struct|enum|union|namespace)\s+([A-Za-z_]\w*)", 2),
        # specifiers and a return type, a declarator (name, operator or destructor), parameters, then what may follow them up to the body or the ';'
        ("function", r"^\s*(?!(?:return|else|throw|delete|new|case|goto|using|typedef)\b)(?:[A-Za-z_][\w:<>,\s]*?[\s*&]+)?[*&]*((?:[A-Za-z_]\w*(?:<[^<>()]*>)?::)*(?:~?[A-Za-z_]\w*|operator\s*(?:\(\)|[^\s\w(]+|\w+)))\s*\([^;{}]*\)(?:\s*(?:const|volatile|noexcept(?:\([^)]*\))?|override|final|&&?|->\s*[\w:<>*&\s]+|=\s*(?:0|default|delete)|:\s*[^;{]*|try))*\s*(?:\{.*|;)$", 1),
    ],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]
DECLARATIONS["c"] = DECLARATIONS["cpp"]
_COMPILED = {k: [(kind, re.compile(p), g) for kind, p, g in v] for k, v in DECLARATIONS.items()}
#: What any Python declaration begins with.
_PYTHON = re.compile(r"\s*(?:class|async|def)\b|[A-Za-z_]\w*\s*=").match
# the type that an impl block is for: what stands after `for`, if anything does, else the first type; paths by their last segment
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b\s*(?P<rest>.*)$")


def _implemented(line: str) -> str | None:
    m = _IMPL.match(line)
    if not m:
        return None
    rest = m["rest"]
    if rest.startswith("<"):  # type parameters, which may nest
        depth = 0
        for k, c in enumerate(rest):
            depth += (c == "<") - (c == ">" and rest[k - 1] != "-")
            if depth == 0:
                rest = rest[k + 1 :]
                break
    rest = re.split(r"\bwhere\b|\{", rest)[0]
    target = re.split(r"\bfor\b(?!\s*<)", rest)[-1]
    name = re.match(r"[\s&]*(?:'\w+\s+)?(?:mut\s+|dyn\s+)*((?:[A-Za-z_]\w*::)*)([A-Za-z_]\w*)", target)
    return name[2] if name else None


_SKIP = {
    "python": re.compile(r"^(?:#|@|import\b|from\b|$)"),
    "java": re.compile(r"^(?://|\*|/\*|@(?!interface)|import\b|package\b|$)"),
    "csharp": re.compile(r"^(?://|\*|/\*|\[|using\b|#|$)"),
    "javascript": re.compile(r"^(?://|\*|/\*|import\b|export \{|@|$)"),
    "go": re.compile(r"^(?://|\*|/\*|import\b|package\b|$)"),
    "rust": re.compile(r"^(?://|\*|/\*|use\b|#|$)"),
    "cpp": re.compile(r"^(?://|\*|/\*|#|using\b|$)"),
}
_SKIP["typescript"], _SKIP["c"] = _SKIP["javascript"], _SKIP["cpp"]
# Test cases by language; the annotated ones name a method in the next five lines.
TESTS = {
    "javascript": (None, re.compile(r"\b(?:it|test|describe)\s*\(\s*['\"`](.+?)['\"`]")),
    "python": (None, re.compile(r"^\s*(?:async\s+)?def\s+(test_\w*)\s*\(")),
    "java": (re.compile(r"@(?:Test|ParameterizedTest)\b"), re.compile(rf"^\s*{_MODS}[A-Za-z_][\w<>,\[\]?\s.]*\s+([A-Za-z_]\w*)\s*\(")),
    "csharp": (re.compile(r"\[(?:Fact|Theory|Test|TestMethod|TestCase)\b"), re.compile(rf"^\s*{_MODS}[A-Za-z_][\w<>,\[\]?\s.]*\s+([A-Za-z_]\w*)\s*\(")),
    "go": (None, re.compile(r"^\s*func\s+(Test\w+)\s*\(")),
    "rust": (re.compile(r"#\[(?:\w+::)?test\b"), re.compile(r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*\(")),
    "cpp": (None, re.compile(r"\b(?:TEST|TEST_F|TEST_P|TYPED_TEST|TEST_CASE)\s*\((.+?)\)")),
}
TESTS["typescript"], TESTS["c"] = TESTS["javascript"], TESTS["cpp"]


def split_lines(content: str | None) -> list[str]:
    """Lines without their ends; a last newline opens no line."""
    parts = lexer.parted(content or "")
    return parts[:-1] if parts[-1] == "" else parts


_ABOVE = ("//", "#", "/*", "*", "@", "[")


def _comment_start(lines: list[str], at: int, lang: str) -> int:
    """The first line (from 0) of the comments and annotations over a declaration; a blank line ends them."""
    first = at
    for k in range(at - 1, -1, -1):
        text = lines[k].strip()
        if not text:
            if first == at:
                continue
            break
        if not text.startswith(_ABOVE) and not (lang == "python" and text.startswith(('"""', "'''"))):
            break
        first = k
    return first


def _signature_end(code: list[str], at: int) -> int:
    """The line (from 0) where the brackets that a Python statement opens are closed again."""
    depth = 0
    for k in range(at, len(code)):
        depth += _opened(code[k])
        if depth <= 0 and not code[k].rstrip().endswith("\\"):
            return k
    return at


def _head_end(code: list[str], at: int, lang: str) -> int:
    """The last line (from 0) of a declaration's head: the first that has a brace or ends in ';' or ':'."""
    if lang == "python":
        return _signature_end(code, at)
    return next((k for k in range(at, len(code)) if "{" in code[k] or code[k].rstrip().endswith((";", ":"))), at)


def _end(lines: list[str], at: int, lang: str) -> int:
    """The last line (from 0) of the declaration at a line."""
    if lang == "python":
        own = len(lines[at]) - len(lines[at].lstrip())
        for k in range(_signature_end(lines, at) + 1, len(lines)):
            text = lines[k].lstrip()
            if text and len(lines[k]) - len(text) <= own:
                return k - 1
        return len(lines) - 1
    depth, seen = 0, False
    for k in range(at, len(lines)):
        seen |= "{" in lines[k]
        depth += lines[k].count("{") - lines[k].count("}")
        if not seen and lines[k].rstrip().endswith(";"):
            return k
        if seen and depth <= 0:
            return k
    return at if not seen else len(lines) - 1


def _opened(line: str) -> int:
    """How many more brackets a line opens than it closes."""
    return line.count("(") + line.count("[") + line.count("{") - line.count(")") - line.count("]") - line.count("}")


def declarations(content: str | None, lang: str, code: list[str] | None = None) -> list[tuple[str, str, str, int, int, int, str, int, int]]:
    """(name, kind, containing, start line, end line, depth, signature, first comment line, last line of the head), lines from 1. code: lexer.code_lines(), where a caller has them."""
    lines, out = split_lines(content), []
    code, stack, depth = lexer.code_lines(content, lang) if code is None else code, [], 0
    inside = 0  # brackets open before a Python line
    for k, line in enumerate(code):
        text = line.lstrip()
        if lang == "python":
            held, inside = inside, max(0, inside + _opened(line))
            if held or not text or text[0] in "\"'":
                continue
            if not _PYTHON(line) and (not stack or len(line) - len(text) > stack[-1][1]):  # opens none and ends none
                continue
        level = len(line) - len(text) if lang == "python" else depth
        start = depth
        if lang != "python":
            depth = max(0, depth + line.count("{") - line.count("}"))
            while stack and depth < stack[-1][1] + (1 if stack[-1][2] else 0):
                stack.pop()
            if stack and not stack[-1][2] and "{" in line:
                stack[-1] = (*stack[-1][:2], True)
        if _SKIP[lang].match(text):
            continue
        if lang == "python":
            while stack and level <= stack[-1][1]:
                stack.pop()
        holder = stack[-1][0] if stack else GLOBAL
        if lang == "rust" and (target := _implemented(line)):
            stack.append((target, start, "{" in line))
            continue
        for kind, pattern, group in _COMPILED[lang]:
            m = pattern.match(line)
            if not m or (kind == "method" and (not stack or m[group] in fixed.CONTROL_WORDS)):
                continue
            if kind == "function" and lang in ("cpp", "c") and m[group] in fixed.CONTROL_WORDS:
                continue
            # a call inside a body looks like a method: methods stand right inside their type
            if kind == "method" and lang in ("javascript", "typescript", "java") and start != stack[-1][1] + 1:
                continue
            if lang == "csharp" and kind != "type" and not _is_member(kind, m, stack, start, text):
                continue
            name = re.sub(r"<[^<>]*>", "", m[group]).split("::")[-1]
            kind = m[1] if kind == "type" and group == 2 else kind
            if lang == "rust" and kind == "function" and stack:
                kind = "method"
            end = k if kind == "variable" else _end(code, k, lang)
            names = [name, *_more_names(text)] if lang == "csharp" and kind in ("field", "event") else [name]
            out.extend((name, kind, GLOBAL if lang == "go" else holder, k + 1, max(end, k) + 1, len(stack), re.sub(r"\s*\{$", "", lines[k].strip()), _comment_start(lines, k, lang) + 1, _head_end(code, k, lang) + 1) for name in names)
            if lang == "python" and kind != "variable":
                stack.append((name, level, True))
            elif (kind in _HOLDERS or (kind == "type" and lang in ("javascript", "typescript"))) and lang not in ("go", "python") and not text.rstrip().endswith(";"):
                stack.append((name, start, "{" in line))
                if "{" in line and depth <= start:
                    stack.pop()
            break
    return out


_HOLDERS = ("class", "interface", "struct", "enum", "record", "namespace", "trait", "mod", "union")


def _more_names(text: str) -> list[str]:
    """The second and further names that a field's line declares; commas within brackets and type arguments part none."""
    flat, depth = [], 0
    for k, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[k - 1] != "="))
        flat.append(c if depth <= 0 else " ")
    return re.findall(r",\s*([A-Za-z_]\w*)\s*(?=[=,;]|$)", "".join(flat))


def _is_member(kind: str, m: re.Match, stack: list, start: int, text: str) -> bool:
    """Whether a line that looks like a C# member is one: directly inside a type, and no statement. Delegates may also stand outside."""
    if kind == "delegate":
        return not stack or start <= stack[-1][1] + 1
    if not stack or start != stack[-1][1] + 1 or not stack[-1][2] or text.split()[0].rstrip("(;") in _CS_STATEMENTS or m[1] in fixed.CONTROL_WORDS:
        return False
    return m[1] == stack[-1][0] if kind == "constructor" else m[1] != stack[-1][0]


def test_cases(content: str | None, lang: str) -> list[tuple[str, int]]:
    lines, out = split_lines(content), []
    mark, named = TESTS[lang]
    for k, line in enumerate(lines):
        if mark is None:
            out += [(m, k + 1) for m in named.findall(line)]
        elif mark.search(line):
            hit = next(((m[1], j + 1) for j in range(k, min(k + 6, len(lines))) if (m := named.match(lines[j]))), None)
            if hit and hit not in out:
                out.append(hit)
    return out


#: Kinds of declarations whose bodies hold calls.
BODIES = ("function", "method", "constructor", "class", "struct", "type")
_CALL_FORMS = {k: re.compile(v, re.ASCII) for k, v in fixed.CALLS.items()}
_NO_CALLS = re.compile(r"\s*(?://|#|/\*|\*|[\"'`])", re.ASCII).match
_SKIPPED = {k: frozenset(v) for k, v in fixed.SKIP_CALLS.items()}
_SKIPPED_ANYWHERE = frozenset(fixed.GLOBAL_SKIP_CALLS)


def _called(line: str, lang: str) -> list[tuple[int, str, str]]:
    """(position, name, qualifier) of a masked line's calls, without the language's own words."""
    skip = _SKIPPED.get(lang, ())
    found = enumerate(_CALL_FORMS[lang].findall(line))
    return [(k, d, q) for k, (q, d) in found if d.lower() not in _SKIPPED_ANYWHERE and d not in skip and q not in skip]


def declared_calls(content: str | None, lang: str, callees: int = fixed.CALLEES_PER_SYMBOL) -> list[tuple]:
    """declarations(), each with the (line, position, name, qualifier) of the names called in its body, at their first line.

    No calls stand on the first lines of declarations, and of each body the first
    `callees` names count; null where a declaration has no body.
    """
    code = lexer.code_lines(content, lang)
    found = declarations(content, lang, code)
    heads = {d[3] for d in found}
    at = [k for k, line in enumerate(code, 1) if "(" in line and k not in heads and not _NO_CALLS(line)]
    calls: dict[int, list[tuple[int, str, str]]] = {}  # by line; bodies stand in bodies
    out = []
    for d in found:
        if d[1] not in BODIES:
            out.append((*d, None))
            continue
        names: dict[str, tuple] = {}
        for k in at[bisect_left(at, d[3]) : bisect_right(at, d[4])]:
            if k not in calls:
                calls[k] = _called(code[k - 1], lang)
            for call in calls[k]:
                names.setdefault(call[1].lower(), (k, *call))
            if len(names) >= callees:
                break
        out.append((*d, list(names.values())[:callees]))
    return out


#: Rows that a task holds before it hands them on.
HELD = 20_000


def _fold(one, names: list[str], types: list[pa.DataType], weight=len):
    """A function for mapInArrow: the rows of one(content, language) of each file, a file at a time and HELD rows, by weight, or one file's at most together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), *types])], names=["path", "language", *names])

        for b in batches:
            cols: list[list] = [[] for _ in range(2 + len(names))]
            held = 0
            for k in range(b.num_rows):
                path, lang, content = (b.column(c)[k].as_py() for c in range(3))
                if lang not in DECLARATIONS:
                    continue
                rows = one(content, lang)
                held += weight(rows)
                for row in rows:
                    for c, v in zip(cols, (path, lang, *row)):
                        c.append(v)
                if held >= HELD:
                    yield handed()
                    cols, held = [[] for _ in cols], 0
            yield handed()

    return run


def _source(files: DataFrame) -> DataFrame:
    return files.select("path", T.language(F.col("path")).alias("language"), "content").filter("language is not null")


_NAMES = ["name", "kind", "containing", "start_line", "end_line", "depth", "signature", "comment_line", "head_line"]
_TYPES = [pa.string()] * 3 + [pa.int32()] * 3 + [pa.string()] + [pa.int32()] * 2
_SCHEMA = "path string, language string, name string, kind string, containing string, start_line int, end_line int, depth int, signature string, comment_line int, head_line int"
#: How declarations are found, by name; a language server's would be another entry.
EXTRACTORS = {"heuristic": declarations}


def extract_symbols(files: DataFrame, extractor: str = "heuristic") -> DataFrame:
    """(path, language, name, kind, containing, start_line, end_line, depth, signature, comment_line, head_line, is_test) of every declaration.

    comment_line: where the comments over it begin; head_line: where its head ends.
    """
    if extractor not in EXTRACTORS:
        raise ValueError(f"no extractor {extractor}; there are {', '.join(EXTRACTORS)}")
    out = _source(files).mapInArrow(_fold(EXTRACTORS[extractor], _NAMES, _TYPES), _SCHEMA)
    return out.withColumn("is_test", T.is_test_path(F.col("path")))


def extract_calls(files: DataFrame) -> DataFrame:
    """extract_symbols() with `calls`: what each declaration's body calls, from the same fold; see declared_calls().

    A file is masked once, and no line of it leaves the task.
    """
    small_batches(files.sparkSession)
    call = pa.list_(pa.struct([("line", pa.int32()), ("pos", pa.int32()), ("dst", pa.string()), ("qualifier", pa.string())]))
    run = _fold(declared_calls, [*_NAMES, "calls"], [*_TYPES, call], weight=lambda rows: sum(1 + len(r[-1] or ()) for r in rows))
    out = _source(files).mapInArrow(run, f"{_SCHEMA}, calls array<struct<line: int, pos: int, dst: string, qualifier: string>>")
    return out.withColumn("is_test", T.is_test_path(F.col("path")))


def mask_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text) of source files, strings and comments blanked: what calls are sought in."""
    x = _source(files).mapInArrow(_fold(lambda content, lang: list(enumerate(lexer.code_lines(content, lang), 1)), ["line_no", "text"], [pa.int32(), pa.string()]), "path string, language string, line_no int, text string")
    return x.drop("language")


def extract_test_cases(files: DataFrame) -> DataFrame:
    """(path, language, name, line) of test cases."""
    return _source(files).mapInArrow(_fold(test_cases, ["name", "line"], [pa.string(), pa.int32()]), "path string, language string, name string, line int")


def outline(symbols: DataFrame, path: str, cap: int = 120) -> DataFrame:
    """(line_no, depth, signature) of a file's outer declarations; a namespace around them is no depth of its own."""
    x = symbols.filter((F.col("path") == path) & (F.col("kind") != "variable"))
    spaced = F.coalesce(F.max(F.when(F.col("kind") == "namespace", F.when(F.col("end_line") > F.col("start_line"), 1).otherwise(0))).over(Window.partitionBy("path")), F.lit(0))
    x = x.withColumn("depth", F.greatest(F.col("depth") - F.when(F.col("kind") == "namespace", 0).otherwise(spaced), F.lit(0))).filter("depth <= 1")
    return x.select(F.col("start_line").alias("line_no"), "depth", F.left(T.clean_signature(F.col("signature")), F.lit(cap)).alias("signature")).orderBy("line_no")


_IMPORTS = {k: [re.compile(p) for p in v] for k, v in fixed.IMPORT_PATTERNS.items()}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
_GO_PATH = re.compile(r'^\s*(?:[\w.]+\s+)?"([^"]+)"')


def import_lines(content: str | None, lang: str) -> list[tuple[int, str]]:
    """(line, target) of a file's imports: one a line, the first form that matches."""
    out, block, heads = [], False, fixed.IMPORT_HEADS.get(lang)
    for k, line in enumerate(split_lines(content), 1):
        text = line.lstrip()
        if lang == "go":
            if text.startswith("import ("):
                block = True
            elif block and text.startswith(")"):
                block = False
            elif m := _GO_PATH.match(text if block else text[7:] if text.startswith("import ") else ""):
                out.append((k, m[1]))
            continue
        hit = next((m[1] for p in _IMPORTS.get(lang, []) if (m := p.search(line))), None)
        if hit:
            out.append((k, hit))
        if heads and text and not text.startswith(heads):
            break
    return out


def imports(files: DataFrame) -> DataFrame:
    """(path, language, line_no, target) of the files' imports."""
    return _source(files).mapInArrow(_fold(import_lines, ["line_no", "target"], [pa.int32(), pa.string()]), "path string, language string, line_no int, target string")


def exported_types(symbols: DataFrame) -> DataFrame:
    """(path, name) of the type names a file declares at its top."""
    types = F.col("kind").isin("class", "interface", "struct", "enum", "record", "trait", "type")
    return symbols.filter(types & ((F.col("language") != "go") | F.col("name").rlike("^[A-Z]"))).select("path", "name").distinct()
