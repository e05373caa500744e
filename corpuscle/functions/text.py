"""Column expressions over text, lines and paths."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def truncate_single_line(text: Column, limit: int = 180) -> Column:
    """Trimmed, white space collapsed, cut to limit code points with '...' after a cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def cap_line(text: Column, limit: int = 2000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def numbered(line_no: Column, text: Column) -> Column:
    """'    7| text'; longer numbers keep all their digits."""
    n = line_no.cast("string")
    return F.concat(F.lpad(n, F.greatest(F.length(n), F.lit(5)), F.lit(" ")), F.lit("| "), text)


def clean_signature(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"\{$", ""))


def mermaid_id(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), F.lit("_"))


def method_name(signature: Column) -> Column:
    """What stands before '(' and after the last '.'."""
    return F.substring_index(F.substring_index(signature, "(", 1), ".", -1)


def user_hash(email: Column) -> Column:
    """The first 16 hex digits of SHA-256 of the lower-cased text."""
    return F.left(F.sha2(F.lower(email), 256), F.lit(16))


def truncate_context(text: Column, limit: int) -> Column:
    """Cut at limit, back to the last newline if it lies beyond 80 % of it, and marked."""
    cut = F.left(text, F.lit(limit))
    last = F.lit(limit) - F.instr(F.reverse(cut), "\n")
    back = F.when(F.contains(cut, F.lit("\n")) & (last > 0.8 * limit), F.left(cut, last)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(back, F.lit("\n\n[... context truncated for length ...]")))


def keywords(question: Column, limit: int = 5) -> Column:
    """Up to limit words of three or more characters that are no stop words, first spelling kept."""
    words = F.filter(F.split(question, "[ \t\n\r,.?!:;()\\[\\]{}\"']+"), lambda w: F.length(w) > 2)
    words = F.filter(words, lambda w: ~F.lower(w).isin(fixed.KEYWORD_STOP_WORDS))
    return F.slice(F.filter(words, lambda w, k: F.array_position(F.transform(words, F.lower), F.lower(w)) == k + 1), 1, limit)


def symbol_candidates(question: Column, limit: int = 3) -> Column:
    """Backtick names and identifiers with an inner capital, of three or more characters, distinct without case."""
    found = F.regexp_extract_all(question, F.lit(rf"`[A-Za-z_][A-Za-z0-9_]*`|{fixed.CAMEL}"), F.lit(0))
    found = F.transform(found, lambda w: F.regexp_replace(w, "`", ""))
    found = F.filter(found, lambda w: (F.length(w) >= 3) & ~F.upper(w).isin(fixed.CANDIDATE_STOP_WORDS))
    return F.slice(F.filter(found, lambda w, k: F.array_position(F.transform(found, F.lower), F.lower(w)) == k + 1), 1, limit)


def complexity(question: Column) -> Column:
    """Simple, Standard or Complex."""
    words = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    names = F.regexp_count(question, F.lit(fixed.CAMEL))
    return (
        F.when(question.isNull() | (F.trim(F.regexp_replace(question, r"\s", "")) == ""), "Standard")
        .when(question.rlike(fixed.COMPLEX_QUESTION) | (words > 40) | (names >= 3), "Complex")
        .when(question.rlike(fixed.SIMPLE_QUESTION) & (words < 20) & (names <= 1), "Simple")
        .otherwise("Standard")
    )


def normalize_path(path: Column) -> Column:
    """Slashes forward, '.' and empty segments gone, '..' taken back."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))))
    return F.array_join(kept, "/")


def confined(path: Column, root: str) -> Column:
    """The normal path where it lies under root, without regard to case, else null."""
    p = normalize_path(path)
    base = root.replace("\\", "/").strip("/").lower()
    return F.when((F.lower(p) == base) | F.startswith(F.lower(p), F.lit(base + "/")), p)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case, with the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.try_element_at(table, extension(path))


def is_test_path(path: Column) -> Column:
    """Whether the file's stem or one of its directories contains test or spec."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return stem.rlike("(?i)test|spec") | F.exists(directories(path), lambda d: d.rlike("(?i)test|spec"))


def excluded(path: Column, profile: str) -> Column:
    return F.exists(directories(path), lambda d: F.lower(d).isin([x.lower() for x in fixed.EXCLUDED_DIRS[profile]]))


def upload_allowed(path: Column) -> Column:
    return ~excluded(path, "upload") & (F.lower(file_name(path)).isin(fixed.UPLOAD_FILES) | extension(path).isin(fixed.UPLOAD_EXTENSIONS))


def traversal_safe(ident: Column) -> Column:
    return ~(F.contains(ident, F.lit("..")) | F.contains(ident, F.lit("/")) | F.contains(ident, F.lit("\\")))


def executable(content: Column) -> Column:
    """Whether bytes of four or more begin as an executable."""
    head = F.hex(F.substring(content, 1, 4))
    return (F.octet_length(content) >= 4) & (F.startswith(head, F.lit("4D5A")) | head.isin(fixed.EXECUTABLE_MAGIC))


def binary_content(content: Column) -> Column:
    """Whether the first 4,096 bytes hold a NUL or over 30 % control bytes."""
    head = F.hex(F.substring(content, 1, 4096))
    n = F.length(head) / 2
    plain = F.length(F.regexp_replace(head, "(?:0[0-8BCE-F]|1[0-9A-F])|([0-9A-F]{2})", "$1")) / 2
    return head.rlike("^(?:[0-9A-F]{2})*00") | ((n - plain) > 0.3 * n)


def glob_regex(pattern: str, names_only: bool = False) -> str:
    """A case-insensitive regex for a glob: ** any path, * within a segment (all of it for names), ? one character."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out += {"*": ".*" if names_only else "[^/]*", "?": "[^/]"}.get(pattern[k], re.escape(pattern[k]))
            k += 1
    return f"(?i)^{out}$"


def glob_matches(path: Column, pattern: str) -> Column:
    """Whether the relative path or the file name matches."""
    rx = glob_regex(pattern.replace("\\", "/"))
    return path.rlike(rx) | file_name(path).rlike(rx)


def _compiles(pattern: str) -> bool:
    """Whether the JVM, which will run it, takes the pattern."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    try:
        SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def search_regex(pattern: str) -> str:
    """The pattern without regard to case; one that does not compile is taken literally."""
    return f"(?iu){pattern if _compiles(pattern) else re.escape(pattern)}"


def binary_path(path: Column) -> Column:
    return extension(path).isin(fixed.BINARY_EXTENSIONS)


def preview(text: Column, limit: int = 500) -> Column:
    """The first characters of a result: 500 of a preview, 5,000 of its details, 100 of arguments."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def detail_items(text: Column, limit: int = 6) -> Column:
    """The first lines that are not blank, trimmed."""
    return F.slice(F.filter(F.transform(line_array(text), lambda t: F.trim(t)), lambda v: v != ""), 1, limit)


def distinct_in_order(items: Column) -> Column:
    """An array's values, each where it stands first, without regard to case."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda v, k: F.array_position(low, F.lower(v)) == k + 1)


def line_array(content: Column) -> Column:
    """A text's lines; a last newline opens none; null for null."""
    parts = F.split(content, "\r\n|\n|\r")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def xml_attributes(content: Column, element: str, attribute: str) -> Column:
    """The attribute of every element of the local name, in order, whatever the prefixes; empty where the XML does not parse.

    xpath() and from_xml() fail a job or skip text on some malformed input, so a
    parser of the Python library decides. Null for null.
    """

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _attributes(t, element, attribute))

    return found(content)


def _attributes(text: str, element: str, attribute: str) -> list[str]:
    out: list[str] = []

    def start(name: str, attrs: dict[str, str]) -> None:
        if name.rpartition(":")[2] == element and attribute in attrs:
            out.append(attrs[attribute])

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    try:
        parser.Parse(text.removeprefix("\ufeff"), True)
    except (expat.ExpatError, ValueError):
        return []
    return out


def new_id() -> Column:
    """A random id of 32 hexadecimal digits."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


def mention_count(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(rf"\b{re.escape(name)}\b"))
