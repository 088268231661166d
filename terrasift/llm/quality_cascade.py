"""Quality rules as a short-circuit cascade.

On a sample each rule's cost (seconds a text) and selectivity (share of texts that it rejects) are measured;
rules then run in order of rejection per cost, and a text leaves at the first rule that rejects it. What a rule
measures beyond the base is computed when the rule runs, once a text. The order only decides how much work is
done: the verdict is that of all rules together.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import SPACE, texts, tune, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = SPACE.encode()
#: Rows of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 1000


@dataclass
class Text:
    """A text with its base measures; others are computed once they are asked for."""

    raw: bytes
    words: list[bytes]
    hashes: np.ndarray
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @cached_property
    def kinds(self) -> np.ndarray:
        """How often each distinct word occurs."""
        return np.unique(self.hashes, return_counts=True)[1]

    @cached_property
    def characters(self) -> int:
        """Distinct code points."""
        return len(set(self.raw.decode("utf-8", "replace")))


def repeated_words(hashes: np.ndarray, k: int) -> int:
    """Words in windows of k words that are found twice or more, the first included."""
    if len(hashes) <= k:
        return 0
    w = windows(hashes, k)
    _, back, n = np.unique(w, return_inverse=True, return_counts=True)
    again = n[back] > 1
    if not again.any():
        return 0
    hit = np.zeros(len(hashes), bool)
    for j in range(k):
        hit[j : j + len(again)] |= again
    return int(hit.sum())


def measured(raw: bytes) -> Text:
    words = raw.split()
    hashes = word_hashes(words)
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    chars = len(raw.decode("utf-8", "replace"))
    return Text(raw, words, hashes, len(words), chars - (len(raw) - len(raw.translate(None, SPACES))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(hashes, 3))


# A rule says whether it rejects a text. Thresholds are wide: what is merely odd stays.


def too_short(t: Text) -> bool:
    return t.n_words < 50


def repetitive(t: Text) -> bool:
    return 100 * t.n_repeat_words > 50 * t.n_words


def symbols(t: Text) -> bool:
    """More than three symbols to ten words."""
    return 10 * t.n_symbols > 3 * t.n_words


def repeated_lines(t: Text) -> bool:
    """More than half of the lines repeat an earlier one."""
    return 2 * t.n_dup_lines > t.raw.count(b"\n") + 1


def word_length(t: Text) -> bool:
    """The mean word has under 2 or over 15 letters."""
    return not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


def shouting(t: Text) -> bool:
    """More capitals than small letters among A-Z."""
    upper = len(t.raw) - len(t.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(t.raw) - len(t.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower


def few_kinds(t: Text) -> bool:
    """Fewer distinct words than the root of their number."""
    return len(t.kinds) ** 2 < t.n_words


def one_word(t: Text) -> bool:
    """One word is more than three of ten."""
    return t.n_words > 0 and 10 * int(t.kinds.max()) > 3 * t.n_words


def few_characters(t: Text) -> bool:
    """Under twelve distinct characters."""
    return t.characters < 12


def looping_phrases(t: Text) -> bool:
    """More than 45 of 100 words stand in five-word windows that come again."""
    return 100 * repeated_words(t.hashes, 5) > 45 * t.n_words


def looping_sentences(t: Text) -> bool:
    """More than 40 of 100 words stand in ten-word windows that come again."""
    return 100 * repeated_words(t.hashes, 10) > 40 * t.n_words


BASE_RULES: tuple[Callable[[Text], bool], ...] = (too_short, repetitive)
RULES: tuple[Callable[[Text], bool], ...] = (
    *BASE_RULES, looping_phrases, looping_sentences, few_kinds, one_word, few_characters, symbols, repeated_lines, word_length, shouting,
)


def rule_figures(docs: DataFrame, rules: tuple[Callable[[Text], bool], ...] = RULES) -> dict[str, tuple[float, float]]:
    """Of each rule, seconds and rejected share, measured on about SAMPLE_ROWS rows drawn from the whole table."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hit, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in it:
            for raw in texts(b):
                t, n = measured(raw), n + 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hit[k] += rule(t)
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.__name__ for r in rules], "spent": spent, "hit": hit, "n": [n] * len(rules)}, pa.schema([("rule", pa.string()), ("spent", pa.float64()), ("hit", pa.int64()), ("n", pa.int64())]))

    got = docs.select("text").sample(False, share, 17).mapInArrow(work, "rule string, spent double, hit long, n long")
    rows = got.groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect()
    return {r.rule: (r.spent / max(1, r.n), r.hit / max(1, r.n)) for r in rows}


def ordered(rules: tuple[Callable[[Text], bool], ...], figures: dict[str, tuple[float, float]]) -> list[Callable[[Text], bool]]:
    """By rejection per cost, the highest first; ties in the given order."""
    worth = lambda r: figures.get(r.__name__, (1.0, 0.0))[1] / max(figures.get(r.__name__, (1.0, 0.0))[0], 1e-9)
    return sorted(rules, key=worth, reverse=True)


def expected_seconds(order: list[Callable[[Text], bool]], figures: dict[str, tuple[float, float]]) -> float:
    """Seconds a text of rules in an order, were they to reject texts independently."""
    total, still = 0.0, 1.0
    for rule in order:
        seconds, rejected = figures.get(rule.__name__, (0.0, 0.0))
        total += still * seconds
        still *= 1 - rejected
    return total


def judged(docs: DataFrame, rules: tuple[Callable[[Text], bool], ...] = RULES) -> DataFrame:
    """Per row: doc_id, base measures, base_failed, kept, and how many rules ran (rules_run varies with the order).

    A null or empty text has no words and fails the base. Repeated rows get one result each; null ids stay null;
    an empty table gives no rows; columns besides doc_id and text are not read. Texts of any length are judged whole.
    Rules of equal worth run in the given order.
    """
    tune(docs.sparkSession)
    cascade = ordered(rules, rule_figures(docs, rules))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for raw in texts(b):
                t, ran, kept = measured(raw), 0, True
                for rule in cascade:
                    ran += 1
                    if rule(t):
                        kept = False
                        break
                failed = any(rule(t) for rule in BASE_RULES)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept and not failed, ran))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rules_run"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rules_run int")
