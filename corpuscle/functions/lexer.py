"""What of a source text is code: strings and comments blanked out, every position kept."""

from __future__ import annotations

import re

# How comments and literals are written, by language family. Each form ends with the text where its end is
# missing, and one-line forms end with the line. Order matters: longer openings stand first.
_BLOCK = r"/\*(?:[^*]+|\*(?!/))*(?:\*/)?"
_LINE = r"//[^\r\n]*"
_QUOTED = r'"(?:[^"\\\r\n]+|\\.)*"?'
_SINGLE = r"'(?:[^'\\\r\n]+|\\.)*'?"
_TRIPLE = r'"""(?:[^"\\]+|\\.|"(?!""))*(?:""")?'
FORMS = {
    "python": [r"#[^\r\n]*", _TRIPLE, _TRIPLE.replace('"', "'"), _QUOTED, _SINGLE],
    "java": [_BLOCK, _LINE, _TRIPLE, _QUOTED, _SINGLE],
    "javascript": [_BLOCK, _LINE, r"`(?:\\.|[^`\\])*`?", _QUOTED, _SINGLE],
    "csharp": [_BLOCK, _LINE, r'\$*"""+(?:(?!""")[\s\S])*(?:"""+)?', r'(?:@\$?|\$@)"(?:""|[^"])*"?', _QUOTED, _SINGLE],
    "go": [_BLOCK, _LINE, r"`[^`]*`?", _QUOTED, _SINGLE],
    # a quote that no second one follows at once opens a lifetime or a label
    "rust": [_BLOCK, _LINE, r'\bb?r(#*)"(?:(?!"\1)[\s\S])*(?:"\1)?', r'"(?:\\[\s\S]|[^"\\])*"?', r"'(?:\\(?:u\{[^}]*\}|x[0-9A-Fa-f]{2}|.)|[^'\\\r\n])'"],
    "cpp": [_BLOCK, _LINE, r'\bR"([^\s()\\]{0,16})\((?:(?!\)\1")[\s\S])*(?:\)\1")?', _QUOTED, r"(?<![0-9A-Za-z_])'(?:\\.|[^'\\\r\n])*'?"],
}
FORMS["typescript"], FORMS["c"] = FORMS["javascript"], FORMS["cpp"]
_COMPILED = {lang: re.compile("|".join(f"(?:{f})" for f in forms), re.S) for lang, forms in FORMS.items()}
_INK = re.compile(r"[^\s]")


def masked(text: str | None, lang: str) -> str:
    """The text with blanks for the characters of its strings and comments; line ends and lengths stay.

    The first character of a string stays, so that a string is still an operand.
    """

    def blank(m: re.Match) -> str:
        found = m[0]
        if found.isprintable():  # its only white space are blanks
            return " " * len(found) if found[0] in "/#" else found[0] + " " * (len(found) - 1)
        return _INK.sub(" ", found) if found[0] in "/#" else found[0] + _INK.sub(" ", found[1:])

    if lang not in _COMPILED:
        return text or ""
    return _COMPILED[lang].sub(blank, text or "")


def parted(text: str) -> list[str]:
    """What stands between the line ends of a text."""
    return re.split(r"\r\n|\n|\r", text) if "\r" in text else text.split("\n")


def code_lines(text: str | None, lang: str) -> list[str]:
    """The masked text's lines, split as source lines are; a last line end opens none."""
    parts = parted(masked(text, lang))
    return parts[:-1] if parts[-1] == "" else parts
