"""What a rule's regular expression needs to be found, and whether Spark's dialect has all that it uses.

Rule authors write one dialect, Spark runs another (java.util.regex).  ``check`` refuses what only the authors' has; ``required``
reads the parse tree of a pattern and returns literals one of which stands in every text that it matches, so that a
plain substring test can rule most texts out before the expression runs.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Literals that are looked for, at most, and characters of one, at least.
MOST, SHORTEST = 16, 3
#: What Java's dialect lacks or reads otherwise.
_FOREIGN = {
    r"\(\?P[<=>]": "named groups of the form (?P...)",
    r"\(\?\(": "conditionals",
    r"\(\?#": "comments",
    r"\\[ZN]": r"\Z and \N",
    r"\(\?[a-zA-Z]*[aLu][a-zA-Z]*(?:-[a-zA-Z]+)?[:)]": "the flags a, L and u",
    r"\[[^\]\\]*(?:\\.[^\]\\]*)*(?:&&|\[(?!:))": "a bracket or && inside a class, which Java reads as an intersection or a nested class",
}


def check(pattern: str) -> str | None:
    """Why the pattern cannot be used; None if it can."""
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    for form, what in _FOREIGN.items():
        if re.search(rf"(?<!\\)(?:\\\\)*{form}", pattern):
            return f"not supported: {what}"
    return None


def java_error(spark, pattern: str) -> str | None:
    """What java.util.regex says against a pattern, in a session's JVM; None if it accepts it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # noqa: BLE001  (py4j wraps the exception of the JVM)
        return str(getattr(e, "java_exception", e)).split("\n")[0]
    return None


def _best(choices: list[frozenset[str]]) -> frozenset[str] | None:
    """Of several sets, each sufficient, the one whose shortest literal is longest."""
    good = [c for c in choices if len(c) <= MOST and min(map(len, c)) >= SHORTEST]
    return max(good, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _of(tree) -> frozenset[str] | None:
    choices, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is K.LITERAL and 32 <= arg < 127:
            run += chr(arg).lower()
            continue
        if op is K.AT:  # an anchor has no width
            continue
        if run:
            choices.append(frozenset([run]))
        run, inner = "", None
        if op is K.SUBPATTERN:
            inner = _of(arg[3])
        elif op is K.ATOMIC_GROUP:
            inner = _of(arg)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = _of(arg[2])
        elif op is K.BRANCH:
            parts = [_of(x) for x in arg[1]]
            inner = None if None in parts else frozenset().union(*parts)
        if inner is not None:
            choices.append(inner)
    return _best(choices)


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case literals, one of which any match contains (letters in either case, as long as the text is ASCII); None if there are
    none worth looking for.

    Flags inside a pattern change what its letters mean, so such a pattern has none, except for a leading (?i), which rules have
    anyway.
    """
    pattern = pattern.removeprefix("(?i)")
    if re.search(r"\(\?[a-zA-Z-]+[:)]", pattern):
        return None
    return _of(_parser.parse(pattern))
