"""Repair of formulas in recognised text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


_COMMANDS = "|".join


def _where(c: Column, marks: tuple[str, ...], change) -> Column:
    """change(c), computed only where c holds one of the marks without which it changes nothing."""
    from .text import once

    def of(x: Column) -> Column:
        held = x.contains(marks[0])
        for m in marks[1:]:
            held = held | x.contains(m)
        return F.when(held, change(x)).otherwise(x)

    return once(c, of)


def common_errors(c: Column) -> Column:
    """Doubled backslashes before commands, fractions without arguments, roots without braces."""
    single = lambda x: F.regexp_replace(x, r"\\{2}(?=(?:" + _COMMANDS(V.DOUBLED_COMMANDS) + "))", r"\\")
    # what comes after a fraction's name and white space is neither its argument nor more white space
    filled = lambda x: F.regexp_replace(x, r"(?U)(?<=\\frac)(?=\s*(?:[^{\s]|\z))", "{}{}")
    rooted = lambda x: F.regexp_replace(x, r"(?<=\\sqrt)(\p{Alnum})", "{$1}")
    return _where(c, ("\\",), lambda x: _where(_where(_where(x, ("\\\\",), single), ("\\frac",), filled), ("\\sqrt",), rooted))


def missing_subscripts(c: Column, strict: bool = False) -> Column:
    """Commands and letters directly before braces gain an underscore; a letter at the very start doesn't.

    The last letter of any other command counts as a letter too; strict leaves commands alone.
    """
    # what follows is looked at first: few places are before a brace
    after_command = lambda x: F.regexp_replace(x, r"(?=\{)(?<=\\(?:" + _COMMANDS(V.SUBSCRIPT_COMMANDS) + r"))", "_")
    command = r"(?<!\\[A-Za-z]{2,21})" if strict else ""
    return _where(c, ("{",), lambda x: F.regexp_replace(after_command(x), r"(?U)(?=\{[A-Za-z0-9,\s]+\})(?<=[^\\_][A-Za-z])" + command, "_"))


def scripts(c: Column) -> Column:
    """Braces around scripts of several characters; a lone mark at the end goes."""
    ended = lambda x: F.regexp_replace(x, r"(?U)[\^_]\s*\z", "")
    return _where(c, ("_", "^"), lambda x: F.regexp_replace(ended(x), r"(?<!\\)([_^])(\p{Alnum}{2,}+)(?!\{)", "$1{$2}"))


def close_braces(c: Column, most: int = 10) -> Column:
    """As many closing braces as are missing, ten at most; escaped ones don't count."""
    from .text import once

    missing = lambda p: F.regexp_count(p, F.lit(r"\{")) - F.regexp_count(p, F.lit(r"\}"))
    more = lambda x: once(F.regexp_replace(x, r"\\[{}]", ""), lambda p: F.repeat(F.lit("}"), F.least(F.greatest(missing(p), F.lit(0)), F.lit(most))))
    return _where(c, ("{",), lambda x: F.concat(x, more(x)))


def spaces(c: Column) -> Column:
    """L06."""
    from .text import strip

    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def clean_latex(c: Column, only_math: bool = False) -> Column:
    """All repairs; without delimiters the whole text is one formula unless only_math."""
    from .text import once, over_math

    whole = not only_math
    text = over_math(common_errors(c), lambda m: scripts(missing_subscripts(m)), delimited=whole)
    return F.when(c == "", c).otherwise(over_math(once(text, close_braces), spaces, delimited=whole))
