"""Places that a text names, found in one pass over its words.

Names are looked up by their first word in an index that every task builds once, so the cost follows the
words of the texts and hardly the number of names. Text and names go to Python in Arrow batches;
``scalars.tagged_names`` says the same in expressions, with one pattern for each name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def folded(text: str) -> str:
    """The text with each character in lower case, as long as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class NameIndex:
    """Names by their first word, with what stands around it in the name."""

    def __init__(self, names: Sequence[str]):
        self.names, self.by_word, self.wordless = list(names), {}, []
        for n, name in enumerate(names):
            low = folded(name)
            if first := WORD.search(low):
                self.by_word.setdefault(first[0], []).append((n, low, first.start()))
            elif low:
                self.wordless.append((n, low))

    def found(self, text: str | None) -> list[str]:
        """The names that stand in the text with no letter, digit or underscore right before or after, in the order of the list."""
        low, hits = folded(text or ""), set()
        inside = lambda k: 0 <= k < len(low) and WORD.match(low[k]) is not None
        alone = lambda a, name: not inside(a - 1) and not inside(a + len(name))
        for word in WORD.finditer(low):
            for n, name, before in self.by_word.get(word[0], ()):
                if n not in hits and (at := word.start() - before) >= 0 and low.startswith(name, at) and alone(at, name):
                    hits.add(n)
        for n, name in self.wordless:
            at = low.find(name)
            while at >= 0 and not alone(at, name):
                at = low.find(name, at + 1)
            if at >= 0:
                hits.add(n)
        return [self.names[n] for n in sorted(hits)]


def places(counties: Sequence[str], cities: Sequence[str], default_type: str, default_names: Sequence[str]) -> Callable[[Column], Column]:
    """A column function: struct of scope type and names; any county wins over any city, which wins over the default.

    A null text names nothing. Lists of thousands of names travel with the plan, once for each stage.
    """

    @F.pandas_udf("scope_type string, scope_names array<string>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        levels = [("county", NameIndex(counties)), ("city", NameIndex(cities))]
        for texts in batches:
            rows = []
            for text in texts:
                named = ((kind, found) for kind, index in levels if (found := index.found(text)))
                rows.append(next(named, (default_type, list(default_names))))
            yield pd.DataFrame(rows, columns=["scope_type", "scope_names"])

    return tag
