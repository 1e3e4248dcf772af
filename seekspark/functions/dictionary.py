"""A tokenizer with a dictionary: its words are cut out of runs of letters by longest match."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.functions.text import TOKENIZERS, WORD, tokens

#: Words and letters of a dictionary at most: it is part of every plan that uses it.
MOST_WORDS, MOST_LETTERS = 100_000, 1_000_000
#: Branches of a trie's node that are tried one by one; more are halved by what they begin with.
FEW = 4
#: Stands for a cut: no letter, digit or mark of a word.
_CUT = "\x01"


def _escaped(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def _pattern(node: dict) -> str:
    """The trie as a regular expression that takes the longest word: a branch is left only where no longer word fits."""
    ends = "" in node
    below = sorted(c for c in node if c)
    if not below:
        return ""

    def choose(chars: list[str]) -> str:
        if len(chars) <= FEW:
            return "|".join(_escaped(c) + _pattern(node[c]) for c in chars)
        left, right = chars[: len(chars) // 2], chars[len(chars) // 2 :]
        part = lambda cs: f"(?=[{_escaped(cs[0])}-{_escaped(cs[-1])}])(?:{choose(cs)})"
        return f"{part(left)}|{part(right)}"

    if len(below) == 1 and not ends:
        return choose(below)
    return f"(?:{choose(below)})" + ("?" if ends else "")


def trie_pattern(words: Iterable[str]) -> str:
    """A regular expression (of Java's kind) that matches the longest of the words, lower-cased; empty for none.

    Words that aren't one run of letters and digits can't be in such a run and are left out.
    """
    own = {w for w in (x.strip().lower() for x in words if x) if re.fullmatch(r"\w+", w)}
    if len(own) > MOST_WORDS or sum(map(len, own)) > MOST_LETTERS:
        raise ValueError(f"a dictionary of {len(own)} words; {MOST_WORDS} words and {MOST_LETTERS} letters are the most")
    root: dict = {}
    for w in own:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}
    return _pattern(root)


@dataclass(frozen=True)
class Dictionary:
    """A tokenizer for documents and queries alike: equal dictionaries are equal, so that an index knows its own."""

    pattern: str = ""

    @classmethod
    def of(cls, words: Iterable[str]) -> Dictionary:
        return cls(trie_pattern(words))

    @classmethod
    def of_table(cls, words: DataFrame, column: str = "word") -> Dictionary:
        """The distinct words of a table; counted, and refused above MOST_WORDS, before they are collected."""
        own = words.select(F.lower(F.trim(column)).alias("w")).where("w != ''").distinct().limit(MOST_WORDS + 1)
        return cls.of(r.w for r in own.collect())

    def __call__(self, text: Column) -> Column:
        """Lower-cased words of the text: of each run of letters the dictionary's words, from the left and the longest at each place, and what is between them."""
        if not self.pattern:
            return tokens(text)
        marked = F.regexp_replace(F.lower(text), F.lit(f"({self.pattern})"), F.lit(f"{_CUT}$1{_CUT}"))
        return F.regexp_extract_all(F.coalesce(marked, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


#: Without words, which come from a table, it cuts like "word".
TOKENIZERS["dictionary"] = Dictionary()
