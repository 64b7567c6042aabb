"""Many words looked up in one pass over a text.

An Aho-Corasick automaton over all words of a rule set runs along each text once and notes where every word occurs first, so the time
does not grow with the number of words. Rules are then read from that small map by plain column functions. Short values (addresses,
link texts) are better served by `text.contains_any`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from hireatlas.functions.text import literal_array, strip
from hireatlas.functions.workers import GIVE_BACK_BYTES, give_back

# Tasks get this code with the function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def first_places(words: list[str], texts: Iterable[str | None]) -> Iterator[dict[str, int]]:
    """For each text its words with the first character each one occurs at, counted from 1."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in filter(None, words):
        automaton.add_word(word, (word, len(word)))
    automaton.make_automaton()
    always = {"": 1} if "" in words else {}
    for text in texts:
        found = dict(always)
        if text and len(automaton):
            for end, (word, length) in automaton.iter(text):
                if word not in found:
                    found[word] = end - length + 2
        yield found


def keyword_places(lowered: Column, words: Iterable[str]) -> Column:
    """``map<string,int>``: the words that occur in a text, with the place of their first occurrence. A null text has none."""
    words = list(dict.fromkeys(words))

    # A function of one batch, not of a stream of them: look-ups side by side then share one Python worker.
    def run(texts: pa.Array) -> pa.Array:
        maps = list(first_places(words, (text.as_py() for text in texts)))
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in maps], dtype=np.int64)]).astype(np.int32)
        keys, places = [w for m in maps for w in m], [p for m in maps for p in m.values()]
        if texts.nbytes > GIVE_BACK_BYTES:
            give_back()
        return pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys, pa.string()), pa.array(places, pa.int32()))

    return F.arrow_udf(run, "map<string,int>")(lowered)


def listed(places: Column, words: Iterable[str]) -> Column:
    """The words that occur, in the order of the list."""
    return F.array_intersect(literal_array(dict.fromkeys(words)), F.map_keys(places))


def any_of(places: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(literal_array(words), F.map_keys(places))


def tags_at(places: Column, rules: dict[str, list[str]]) -> Column:
    """Tags whose rule has a word that occurs, in rule order."""
    hits = [F.when(any_of(places, [w.lower() for w in words]), F.lit(tag)) for tag, words in rules.items()]
    return F.array_compact(F.array(*hits)) if hits else literal_array([])


def rule_words(rules: dict[str, list[str]]) -> list[str]:
    return [w.lower() for words in rules.values() for w in words]


def snippets_at(text: Column, places: Column, words: Iterable[str], limit: int, window: int = 80) -> Column:
    """Distinct excerpts around the first place of each word, in the order of the list, at most ``limit``."""

    def excerpt(word: Column) -> Column:
        at = F.try_element_at(places, word)
        first, last = F.greatest(at - F.lit(window), F.lit(1)), at - F.lit(1) + F.lit(window)
        return strip(F.substring(text, first, F.least(F.length(text), last) - first + F.lit(1)))

    found = F.transform(listed(places, words), excerpt)
    return F.slice(F.array_distinct(F.filter(found, lambda s: s != "")), 1, limit)
