"""Structural tokens of source code: names and literals lose their spelling, comments go."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/|\#(?!\[)[^\n]*)|(?P<lit>\"\"\".*?\"\"\"|'''.*?'''|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<other>[^\s\w])""",
    re.DOTALL,
)
KEYWORDS = frozenset("as async await break case catch class const continue def default defer do elif else enum except export extends final finally fn for from func function go if impl implements import in interface let loop match mod mut new package pass pub raise return self static struct super switch this throw trait try type use var void while with yield contract mapping modifier".split())
LITERALS = frozenset(("true", "false", "null", "None", "True", "False", "nil"))


def tokens(source: str) -> list[str]:
    """Keywords and punctuation as they are, names as ID, literals as LIT."""
    out = []
    for m in _TOKEN.finditer(source):
        if m["lit"] is not None or (m["word"] in LITERALS):
            out.append("LIT")
        elif m["word"] is not None:
            out.append(m["word"] if m["word"] in KEYWORDS else "ID")
        elif m["other"] is not None:
            out.append(m["other"])
    return out
