"""Character classes that mean the same to Java's regular expressions as the reference language's defaults do.

Java's ``\\s`` and ``\\w`` are ASCII only and ``(?U)`` differs in a few code points, so the classes are spelt out.
"""

from __future__ import annotations

#: White space, as the inside of a character class.
WS = r"\t-\r\x1c- \x85\xa0  -     　"
S, NS = f"[{WS}]", f"[^{WS}]"
#: Letters, numerals and the underscore, as the inside of a character class.
WORD = r"\p{L}\p{N}_"
CJK = "[一-鿿]"
#: Line ends of a text split into lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANK_LINES = rf"\n{S}*\n+"

#: The same classes for SQL engines whose regular expressions are RE2.
SQL_WS = r"\t-\r\x{1C}- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SQL_LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
SQL_CJK = r"[\x{4E00}-\x{9FFF}]"
