"""What a regular expression cannot match without: literals by which an automaton picks the expressions worth running."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

#: Shorter literals say too little.
LEAST = 3
#: Alternatives of one expression that go to the automaton, at most.
MOST_ALTERNATIVES = 24

_LONG_S_AND_DOTLESS_I = str.maketrans({"ſ": "s", "ı": "i"})


def folded(text: str) -> str:
    """Lower case, such that an ASCII letter stands wherever an expression that ignores case takes one for it.

    Those are i for dotted and dotless I, s for the long s, and k for the Kelvin sign, which lower case itself changes.
    """
    if text.isascii():
        return text.lower()
    return text.replace("İ", "i").lower().translate(_LONG_S_AND_DOTLESS_I)


def _longest(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest member is longest, of those the smallest."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _of(nodes) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    run: list[str] = []

    def close() -> None:
        nonlocal run
        if len(run) >= LEAST:
            found.append(frozenset(["".join(run)]))
        run = []

    for kind, value in nodes:
        if kind is op.LITERAL and value < 128:
            run.append(chr(value).lower())
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # takes no room
        elif kind is op.SUBPATTERN and not value[1] and not value[2]:  # no flags of its own
            inner = list(value[3])
            if all(k is op.LITERAL and v < 128 for k, v in inner):
                run += [chr(v).lower() for _, v in inner]
            else:
                close()
                found += _of(inner)
        else:
            close()
            if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
                found += _of(value[2])
            elif kind is op.ATOMIC_GROUP:
                found += _of(value)
            elif kind is op.BRANCH:
                ways = [_longest(_of(way)) for way in value[1]]
                if all(ways) and len(union := frozenset().union(*ways)) <= MOST_ALTERNATIVES:
                    found.append(union)
    close()
    return found


#: A group without a number that a pattern begins with: alternatives of letters, digits and escaped signs, not repeated.
_WAYS = re.compile(r"\(\?:((?:[\w\-/ ]|\\[^\w\s|])*(?:\|(?:[\w\-/ ]|\\[^\w\s|])*)+)\)(?![*+?{])")


def alternatives(pattern: str) -> list[str]:
    """Patterns of which one holds exactly where ``pattern`` does: a plain group of alternatives at its beginning is taken apart.

    Each then goes by its own literal, and an alternative that many patterns share is one.
    """
    ways = _WAYS.match(pattern)
    return [f"(?:{way}){pattern[ways.end() :]}" for way in dict.fromkeys(ways[1].split("|"))] if ways else [pattern]


def needed(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case ASCII literals; every text that ``pattern`` matches, case ignored, contains one of each set once it is :func:`folded`.

    An expression that cannot be read raises ``re.error``.
    """
    return _of(parser.parse(pattern, re.I | re.S))


def required(pattern: str) -> frozenset[str] | None:
    """The set of :func:`needed` whose members are longest; None if there is none."""
    return _longest(needed(pattern))
