"""Quality rules as weak supervision.

Every rule looks at one statistic of a text and votes that it is good (1) or bad (-1), or abstains (0).
Expectation-maximisation estimates, without labels, how often each rule votes bad on good and on bad texts; the posterior
probability that a text is good replaces a filter that all rules must pass.

The votes of all documents enter as counts of vote patterns. There are at most 3 ** len(RULES) of them, whatever the
corpus, so the iterations themselves run on a table of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.shared import pick, positional, staged

SYMBOLS = b"#*$%&|<>"
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
CONTINUATION = bytes(range(0x80, 0xC0))  # all bytes of a UTF-8 character but its first
WINDOW = 5
_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)

STATISTICS = ("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
              "n_upper long, n_letters long, n_bare long, n_loud long, n_distinct long")


def repeated_words(words: list[bytes], ids: np.ndarray) -> int:
    """Words inside five-word windows that occur at least twice, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    mixed = ids * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    n = len(words) - WINDOW + 1
    windows = sum((mixed[i:i + n] * _WEIGHTS[i] for i in range(1, WINDOW)), mixed[:n] * _WEIGHTS[0])
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(words) + 1, np.int64)
    for hit in (order[1:][same], order[:-1][same]):
        starts[hit] = 1
    covered = np.zeros(len(words) + 1, np.int64)
    places = np.flatnonzero(starts)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def found(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def statistics(text: bytes) -> tuple[int, ...]:
    """The columns of STATISTICS for one whole text."""
    words = text.split()
    joined = b"".join(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    repeats = repeated_words(words, ids) if len(known) < len(words) else 0
    seen: set[bytes] = set()
    lines = doubled = 0
    for line in text.split(b"\n"):
        if line.strip(BLANK):
            lines += 1
            doubled += line in seen
            seen.add(line)
    bare = [w for w in known if len(w) <= 2 and not w.isalnum() and w[0] < 128]
    return (len(words), len(joined.translate(None, CONTINUATION)), found(joined, SYMBOLS), lines, doubled, repeats,
            found(joined, CAPITALS), found(joined, LETTERS), sum(map(words.count, bare)), joined.count(b"!!"), len(known))


def add_statistics(docs: DataFrame, text: str) -> DataFrame:
    """All columns of ``docs`` and those of STATISTICS; ``text`` must not be renamed by it."""
    place, names = docs.columns.index(text), [x.split()[0] for x in STATISTICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(value or b"") for value in batch.column(place).cast(pa.binary()).to_pylist()]
            made = np.array(rows, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, i]) for i in range(len(names)))],
                                             names=[*batch.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, {STATISTICS}")


@dataclass(frozen=True)
class Rule:
    """Votes by a share of two statistics: bad beyond ``bad``, good within ``good``, nothing between them.

    ``slips`` is the highest believable rate of bad votes on good texts. Junk comes in kinds that break one rule each;
    without this bound the likelihood is highest where one kind alone is the bad class and the others count as good.
    """

    name: str
    share: Callable[[], Column]
    good: Callable[[Column], Column]
    bad: Callable[[Column], Column]
    slips: float

    def vote(self) -> Column:
        share = self.share()
        return F.when(self.bad(share), -1).when(self.good(share), 1).otherwise(0).cast("int")


def _per(part: str, whole: str) -> Callable[[], Column]:
    return lambda: F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _most(name: str, part: str, whole: str, good: float, bad: float, slips: float) -> Rule:
    return Rule(name, _per(part, whole), lambda x: x <= good, lambda x: x > bad, slips)


RULES = [
    Rule("enough words", lambda: F.col("n_words") * 1.0, lambda x: x >= 10, lambda x: x < 5, 0.05),
    Rule("word length", _per("word_chars", "n_words"), lambda x: x.between(3, 9), lambda x: (x < 2) | (x > 14), 0.02),
    _most("symbols", "n_symbols", "n_words", 0.05, 0.3, 0.001),
    _most("doubled lines", "n_dup_lines", "n_lines", 0.1, 0.4, 0.02),
    _most("repeated passages", "n_repeat_words", "n_words", 0.05, 0.2, 0.005),
    _most("capitals", "n_upper", "n_letters", 0.2, 0.5, 0.005),
    _most("words without letters", "n_bare", "n_words", 0.05, 0.2, 0.001),
    _most("shouting", "n_loud", "n_words", 0.02, 0.2, 0.005),
    Rule("variety", lambda: F.when(F.col("n_words") >= 30, F.col("n_distinct") / F.sqrt(F.col("n_words"))),
         lambda x: x >= 3, lambda x: x < 1.5, 0.02),
]


@dataclass(frozen=True)
class VoteModel:
    """Share of good texts, and for each rule the probability of a bad vote, given a vote, on good and on bad texts."""

    prior: float
    bad_on_good: tuple[float, ...]
    bad_on_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a text is good. Votes are independent given the class, so their weights add up."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for vote, on_good, on_bad in zip(votes, self.bad_on_good, self.bad_on_bad):
            odds = odds + F.when(vote == -1, float(np.log(on_good / on_bad))) \
                .when(vote == 1, float(np.log((1 - on_good) / (1 - on_bad)))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: np.ndarray, counts: np.ndarray, slips: np.ndarray | None = None, iterations: int = 50) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns and how many documents have each.

    It starts from the rules' own meaning (a bad vote speaks against a text), keeps to their ``slips``, and never lets a rule mean the opposite, so
    the classes can't change places and a text without a bad vote is never less likely good than the prior. Pseudo-counts
    keep every rate inside (0, 1), also where a rule never votes or there are no documents.
    """
    bad, good = (patterns == -1).astype(float), (patterns == 1).astype(float)
    slips = np.array([rule.slips for rule in RULES]) if slips is None else slips
    n_bad = bad.sum(axis=1)
    likely = np.where(n_bad == 0, 0.99, np.where(n_bad == 1, 0.05, 0.01))
    prior, on_good, on_bad = 0.8, np.full(patterns.shape[1], 0.01), np.full(patterns.shape[1], 0.3)
    for _ in range(iterations):
        for_good, for_bad = counts * likely, counts * (1 - likely)
        prior = float(np.clip((for_good.sum() + 8) / (counts.sum() + 10), 0.5, 0.999))
        on_good = (for_good @ bad + 0.5) / (for_good @ (bad + good) + 100)
        on_bad = np.maximum((for_bad @ bad + 3) / (for_bad @ (bad + good) + 10), on_good * 2)
        on_bad = np.minimum(on_bad, 0.99)
        on_good = np.minimum(np.minimum(on_good, on_bad / 2), slips)
        odds = np.log(prior / (1 - prior)) + bad @ np.log(on_good / on_bad) + good @ np.log((1 - on_good) / (1 - on_bad))
        likely = 1 / (1 + np.exp(-odds))
    return VoteModel(prior, tuple(map(float, on_good)), tuple(map(float, on_bad)))


def fit_votes(counted: DataFrame) -> VoteModel:
    """Fit on a table with the statistics of every document."""
    votes = [rule.vote().alias(f"v{i}") for i, rule in enumerate(RULES)]
    rows = counted.select(*votes).groupBy(*[f"v{i}" for i in range(len(RULES))]).count().collect()
    patterns = np.array([tuple(row)[:-1] for row in rows]).reshape(-1, len(RULES))
    order = np.lexsort(patterns.T) if len(rows) else []
    return fit(patterns[order], np.array([row[-1] for row in rows], float)[order])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(model: VoteModel) -> tuple[Column, Column]:
    posterior = model.posterior([rule.vote() for rule in RULES])
    return posterior, ~base_failed() & (posterior >= 0.5)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, all statistics, base_failed, posterior and kept.

    NULL and empty texts have no words and fail. Repeated rows count and are answered as often as they occur; no rows
    give no rows. Other columns are ignored, whatever their names.
    """
    counted = staged(add_statistics(pick(docs, "doc_id", "text"), "text").drop("text"), "statistics")
    posterior, kept = verdict(fit_votes(counted))
    return counted.withColumns({"base_failed": base_failed(), "posterior": posterior, "kept": kept})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged.

    Statistics are taken twice, once for the fit and once for the rows that pass through: words are counted again
    rather than texts shuffled or stored.
    """
    narrow = add_statistics(pick(docs, "text"), "text").drop("text")
    _, kept = verdict(fit_votes(narrow))
    places = positional(docs)
    judged = add_statistics(places, places.columns[docs.columns.index("text")])
    return judged.where(kept).select(*places.columns).toDF(*docs.columns)
