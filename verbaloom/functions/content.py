"""What a text holds before any model sees it: white space, literal tokens, letters, and the label that rules alone give.

All are Column expressions. Patterns avoid look-around and class shorthands, so Java and RE2 read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space code points of Unicode text splitting.
WHITESPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPLIT = f"[{WHITESPACE}]+"
FIRST_TOKENS = 16
_SOLID = f"[^{WHITESPACE}]"
_WORD = r"[\p{L}\p{N}_]"
_NAME = r"[\p{L}\p{N}_-]"
# A URL, a www host, an email or a bare domain with a lower-case top label, in quotes or brackets.
LITERAL_TOKEN = (
    r"""[(<\["'«]*(?:"""
    rf"[A-Za-z][A-Za-z0-9+.-]*://{_SOLID}+"
    rf"|[Ww]{{3}}\.{_SOLID}+"
    rf"|[\p{{L}}\p{{N}}_.+-]+@{_NAME}+(?:\.{_NAME}+)+"
    rf"|{_NAME}+(?:\.{_NAME}+)*\.[a-z]{{2,24}}(?:[/?#:]{_SOLID}*)?"
    r""")[)>\]"'».,;:!?]*"""
)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    """No character but white space; null counts as blank."""
    return text_or_empty(text).rlike(f"^[{WHITESPACE}]*\\z")


def tokens(text: Column) -> Column:
    return F.split(text_or_empty(text), SPLIT)


def is_literal_token(token: Column) -> Column:
    return token.rlike(f"^(?:{LITERAL_TOKEN})\\z")


def letter_count(text: Column) -> Column:
    """All letters, less those of literal tokens; every literal holds a full stop or ://, so few tokens are looked at."""
    letters = lambda x: F.length(F.regexp_replace(x, r"\P{L}+", ""))
    near = F.filter(tokens(text), lambda t: (F.contains(t, F.lit(".")) | F.contains(t, F.lit("://"))) & is_literal_token(t))
    return letters(text_or_empty(text)) - F.aggregate(near, F.lit(0), lambda n, t: n + letters(t))


def has_linguistic_content(text: Column) -> Column:
    """Stops at the first token that has a letter; most texts have one among their first, so these are cut off first."""
    prose = lambda t: t.rlike(r"\p{L}") & ~is_literal_token(t)
    first = F.slice(F.split(text_or_empty(text), SPLIT, FIRST_TOKENS + 1), 1, FIRST_TOKENS)
    return F.exists(first, prose) | F.exists(tokens(text), prose)


def rule_label(text: Column) -> Column:
    """und for blank texts, zxx for texts without linguistic content, null where a model has to decide."""
    return F.when(is_blank(text), F.lit("und")).when(~has_linguistic_content(text), F.lit("zxx"))
