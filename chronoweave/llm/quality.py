"""Quality rules as a short-circuit cascade.

A rule rejects a document by a threshold on features of its text.  On a bounded sample
the cost of each rule alone and the share it rejects are measured; the cascade then runs
rules by rejections per second and stops at the first that rejects.  The verdict is the
conjunction of all rules, so it is the same for any order and any sample.
Features are computed when a rule or the caller asks for them, once for each document.

Defined results: a null text has no words; ids of any size stay as they are; lines and words follow the ASCII white space
of the package; rows are judged one by one, so repeats and ties keep their own rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import batch, extend, fields, slices
from ._text import WS, _long, grams, words

#: Rows of the sample by which rules are ordered.  It decides speed only.
SAMPLE_ROWS = 500
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_LETTER = np.zeros(256, bool)
_LETTER[[*_UPPER, *_LOWER, *range(128, 256)]] = True


class Page:
    """The features of one text, each computed when first asked for."""

    def __init__(self, text):
        self.text = text if isinstance(text, str) else ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def tokens(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.tokens)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, WS)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_marks(self) -> int:
        return self.raw.count(b"!") + self.raw.count(b"?")

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(WS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _LOWER))

    @cached_property
    def n_lettered(self) -> int:
        """Words with an ASCII letter or a character beyond ASCII."""
        if not self.raw:
            return 0
        buf = np.frombuffer(self.raw, np.uint8)
        starts, ends, _ = words(buf)
        seen = np.concatenate([[0], np.cumsum(_LETTER[buf])])
        return int((seen[ends] > seen[starts]).sum())

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more, the first included."""
        g = grams(_long(self.raw), 3)
        if not len(g):
            return 0
        _, at, count = np.unique(g, return_inverse=True, return_counts=True)
        twice, hit = count[at] > 1, np.zeros(len(g) + 2, bool)
        for k in range(3):
            hit[k : k + len(g)] |= twice
        return int(hit.sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Page], bool]


RULES = (
    Rule("few_words", lambda p: p.n_words < 50),
    Rule("symbols", lambda p: 10 * p.n_symbols > p.n_words),
    Rule("marks", lambda p: 2 * p.n_marks > p.n_words),
    Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 15 * p.n_words),
    Rule("lettered", lambda p: 10 * p.n_lettered < 7 * p.n_words),
    Rule("upper_case", lambda p: p.n_upper > 2 * p.n_lower),
    Rule("dup_lines", lambda p: 10 * p.n_dup_lines > 5 * len(p.lines)),
    Rule("repeats", lambda p: 100 * p.n_repeat_words > 50 * p.n_words),
)


def measured(texts: list, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, int]]:
    """(name, seconds, rejections) of each rule alone on some texts."""
    out = []
    for r in rules:
        pages = [Page(t) for t in texts]
        began = time.perf_counter()
        hits = sum(r.rejects(p) for p in pages)
        out.append((r.name, time.perf_counter() - began, hits))
    return out


def rejections_per_cost(found: list[tuple[str, float, int]]) -> list[str]:
    """Names of rules by rejections per second, best first."""
    return [name for _, name in sorted((((hits + 1e-3) / (seconds + 1e-9)), name) for name, seconds, hits in found)[::-1]]


def ordered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """``rules`` in cascade order, by a sample of at most ``sample_rows`` rows.

    The sample is measured where it lies; only a row for each rule reaches the driver.
    """
    out = fields("name string, seconds double, hits long")

    def measure(batches):
        for b in slices(batches, 64):
            rows = measured(b.column("text").to_pylist(), rules)
            yield batch(dict(zip(out.names, zip(*rows))), out)

    sample = docs.select(F.col(text_col).alias("text")).sample(0.2, seed=7).limit(sample_rows)
    found = sample.mapInArrow(measure, out).groupBy("name").agg(F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits")).collect()
    by = {r.name: r for r in rules}
    return tuple(by[name] for name in rejections_per_cost([tuple(r) for r in found])) if found else rules


def stopped_at(page: Page, rules: tuple[Rule, ...]) -> int | None:
    """The place of the first rule that rejects; later ones are not evaluated."""
    return next((k for k, r in enumerate(rules) if r.rejects(page)), None)


def keeps(page: Page, rules: tuple[Rule, ...]) -> bool:
    return stopped_at(page, rules) is None


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None, metrics: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept, stopped_by (the rule that rejected, or null) and rules_run.

    With ``metrics`` the base metrics and base_failed follow.  A document that a rule
    rejects costs only the features of the rules up to that one, and of the metrics asked for.
    """
    rules = rules or ordered(docs, text_col)

    def judge(texts):
        out = {"kept": [], "stopped_by": [], "rules_run": []} | ({m: [] for m in (*METRICS, "base_failed")} if metrics else {})
        for t in texts:
            page = Page(t)
            at = stopped_at(page, rules)
            out["kept"].append(at is None)
            out["stopped_by"].append(None if at is None else rules[at].name)
            out["rules_run"].append(len(rules) if at is None else at + 1)
            for m in (*METRICS, "base_failed") if metrics else ():
                out[m].append(getattr(page, m))
        return out

    made = "kept boolean, stopped_by string, rules_run int" + (", " + ", ".join(f"{m} long" for m in METRICS) + ", base_failed boolean" if metrics else "")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return extend(slim, ["text"], judge, made, ["doc_id"])


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the metrics, base_failed and kept.

    The base rule is among RULES, so that its failures are not kept whatever ``rules`` are given.
    """
    return quality_cascade(docs, id_col, text_col, rules, metrics=True).select("doc_id", *METRICS, "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns as they are."""
    rules = rules or ordered(docs, text_col)
    return extend(docs, [text_col], lambda texts: {"__keep": [keeps(Page(t), rules) for t in texts]}, "", docs.columns)
