"""An index of a text's words for tables of word patterns.

Patterns of whole words, such as ``\\bbest\\b`` or ``\\bhow\\s+to\\b|\\bwhy\\b``, are compiled to words and phrases. A text
is split once; which of all patterns' words it has is one set intersection. A single word is then a lookup, a
phrase is searched for only where all its words occur, and what isn't made of words stays a pattern, tried where a string
that it needs occurs.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions.url import contains_any

SPACE = " "


def alternatives(pattern: str) -> list[str]:
    """The pattern's alternatives outside of brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def needed_text(alternative: str) -> str | None:
    """A string that any match of the alternative holds; None if it needs none of two characters."""
    bare = re.sub(r"\([^()]*\)[?*]?|\\[sdw][+*?]?|\\?.[?*]", "\0", alternative.replace(r"\b", ""))
    runs = re.findall(r"[a-z0-9-]{2,}", bare)
    return None if not runs or re.search(r"[\[\]{}|^$]", bare) else max(runs, key=len)


def spelled(pattern: str) -> set[str] | None:
    """All texts that a pattern of letters, groups, optional parts and white space stands for (a space for any white space); None for others."""
    done, at = {""}, 0
    while at < len(pattern):
        if pattern.startswith(r"\s+", at):
            part, at = {SPACE}, at + 3
        elif pattern[at] == "(":
            end, depth = at + 1, 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
            inner = [spelled(a) for a in alternatives(pattern[at + 1 : end - 1].removeprefix("?:"))]
            if any(x is None for x in inner):
                return None
            part, at = set().union(*inner), end
        elif pattern.startswith(r"\.", at):
            part, at = {"."}, at + 2
        elif re.match(r"[a-z0-9-]", pattern[at]):
            part, at = {pattern[at]}, at + 1
        else:
            return None
        if pattern[at : at + 1] == "?":
            part, at = part | {""}, at + 1
        done = {a + b for a in done for b in part}
    return done


@dataclass(frozen=True)
class Compiled:
    """A pattern as single words, phrases (their words and a pattern) and other alternatives (a string they need and the pattern)."""

    words: tuple[str, ...]
    phrases: tuple[tuple[tuple[str, ...], str], ...]
    others: tuple[tuple[str | None, str], ...]

    def vocabulary(self) -> set[str]:
        return {*self.words, *(w for words, _ in self.phrases for w in words)}


@functools.cache
def compiled(pattern: str) -> Compiled:
    words, phrases, others = [], [], []
    for alternative in alternatives(pattern):
        whole = re.fullmatch(r"\\b(.+)\\b", alternative)
        texts = spelled(whole.group(1)) if whole else None
        if texts is None or any(not t or not t[0].isalnum() for t in texts):
            others.append((needed_text(alternative), alternative))
            continue
        # a text that goes on after another one's end with what is no letter matches only where that one does
        texts = sorted(t for t in texts if not any(t != o and t.startswith(o) and not t[len(o)].isalnum() for o in texts))
        if any(not t[-1].isalnum() for t in texts):
            others.append((needed_text(alternative), alternative))
            continue
        words += [t for t in texts if t.isalnum()]
        for t in texts:
            if not t.isalnum():
                phrases.append((tuple(dict.fromkeys(re.split(r"[^a-z0-9]+", t))), r"\b" + re.escape(t).replace(r"\ ", r"\s+") + r"\b"))
    return Compiled(tuple(words), tuple(phrases), tuple(others))


def vocabulary(patterns: list[str]) -> list[str]:
    return sorted(set().union(*(compiled(p).vocabulary() for p in patterns)))


def known_words(low: Column, patterns: list[str]) -> Column:
    """Which words of the patterns a lower-cased text has."""
    words = vocabulary(patterns)
    return F.array_intersect(F.split(low, r"(?U)\W+"), F.array(*[F.lit(w) for w in words])) if words else F.array().cast("array<string>")


def matches(low: Column, known: Column, pattern: str) -> Column:
    """Whether a pattern occurs in the lower-cased text, given its ``known_words``."""
    c = compiled(pattern)
    found = [F.array_contains(known, c.words[0])] if len(c.words) == 1 else [F.arrays_overlap(known, F.array(*[F.lit(w) for w in c.words]))] if c.words else []
    for words, phrase in c.phrases:
        all_there = functools.reduce(lambda a, b: a & b, [F.array_contains(known, w) for w in words])
        found.append(all_there & low.rlike("(?U)" + phrase))
    for needed, other in c.others:
        tried = low.rlike("(?U)" + other)
        found.append(tried if needed is None else contains_any(low, [needed]) & tried)
    return functools.reduce(lambda a, b: a | b, found)
