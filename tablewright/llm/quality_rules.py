"""Quality rules as a short-circuit cascade (operator 10).

On a bounded sample every rule is run on every row, which gives its cost and the rows it rejects. Rules are then put in
order greedily: the next rule is the one that rejects most of the sample rows still standing per second of cost. Over
the whole table a row is left at the first rule that rejects it; a value that several rules need is computed once.
The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import spread

#: Rows of the sample (expected number) that orders the rules.
SAMPLE = 2_000
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


class Doc:
    """A text and what the rules may ask of it. A null text is an empty one."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def bytes(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.bytes.split()  # bytes are split at the six ASCII white space characters only

    @cached_property
    def ids(self) -> np.ndarray:
        """Words as numbers, equal words equal."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> int:
        return sum(self._lines.values())

    @cached_property
    def _lines(self) -> Counter:
        return Counter(x for x in self.bytes.split(b"\n") if x.split(None, 1))

    @cached_property
    def dup_lines(self) -> int:
        return self.lines - len(self._lines)

    @cached_property
    def repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more, the first occurrence included."""
        ids = self.ids
        if len(ids) < 4:
            return 0
        n = int(ids.max()) + 1
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        window = pair[:-1].astype(np.int64) * n + ids[2:]
        _, at, count = np.unique(window, return_inverse=True, return_counts=True)
        hit = count[at] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k:k + len(hit)] |= hit
        return int(covered.sum())

    @cached_property
    def with_letter(self) -> int:
        return sum(1 for w in self.text.split() if not w.isdigit() and any(map(str.isalpha, w)))


Rule = Callable[[Doc], bool]
#: Base rules first: any of them fails a document whatever the others say.
BASE: dict[str, Rule] = {
    "few_words": lambda d: len(d.words) < 50,
    "repeated_windows": lambda d: 100 * d.repeat_words > 50 * len(d.words),
}
RULES: dict[str, Rule] = {
    **BASE,
    "symbols": lambda d: 5 * d.symbols > len(d.words),
    "repeated_lines": lambda d: 100 * d.dup_lines > 30 * d.lines,
    "few_distinct": lambda d: 100 * d.distinct < 20 * min(len(d.words), 400),
    "few_letters": lambda d: 100 * d.with_letter < 75 * len(d.words),
    "word_length": lambda d: not 2 * len(d.words) <= d.word_chars <= 20 * len(d.words),
}


def order(docs: DataFrame, rules: dict[str, Rule] = RULES, sample: int = SAMPLE) -> list[str]:
    """Names of the rules, best rejection per cost first, from about `sample` rows."""
    share = min(1.0, sample / max(1, docs.count()))
    names = list(rules)

    def measure(batches):
        for b in batches:
            cost, bits = [], []
            for text in b.column(0).to_pylist():
                row = []
                bad = 0
                for i, n in enumerate(names):
                    doc = Doc(text)  # its own values: a rule pays for all it needs
                    start = time.perf_counter()
                    bad |= bool(rules[n](doc)) << i
                    row.append(time.perf_counter() - start)
                cost.append(row)
                bits.append(bad)
            yield pa.RecordBatch.from_arrays([pa.array(cost, pa.list_(pa.float64())), pa.array(bits, pa.int64())], ["cost", "bits"])

    rows = docs.select("text").sample(share, 7).mapInArrow(measure, "cost array<double>, bits bigint")
    cost = {n: F.sum(F.get("cost", F.lit(i))).alias(n) for i, n in enumerate(names)}
    kept = rows.groupBy("bits").agg(F.count(F.lit(1)).alias("_n"), *cost.values()).collect()  # at most 2 ** rules rows
    total = {n: sum(r[n] or 0.0 for r in kept) + 1e-9 for n in names}
    standing, out = {r["bits"]: r["_n"] for r in kept}, []
    while len(out) < len(names):
        best = max((n for n in names if n not in out), key=lambda n: sum(c for b, c in standing.items() if b >> names.index(n) & 1) / total[n])
        out.append(best)
        standing = {b: c for b, c in standing.items() if not b >> names.index(best) & 1}
    return out


def cascade(docs: DataFrame, rules: dict[str, Rule] = RULES, names: list[str] | None = None, measures: bool = False) -> DataFrame:
    """One row per document: doc_id, rejected_by (the first rule in order that rejects it, null if kept), kept.

    `measures` adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, for rejected rows too.
    Null and empty texts have no words and fail few_words; repeated rows, null ids and very long texts are rows like
    others; other columns are not read; an empty table gives no rows.
    """
    names = order(docs, rules) if names is None else names
    kind = docs.schema["doc_id"].dataType

    def judge(batches):
        for b in batches:
            first, values = [], []
            for text in b.column("text").to_pylist():
                d = Doc(text)
                first.append(next((n for n in names if rules[n](d)), None))
                if measures:
                    values.append((len(d.words), d.word_chars, d.symbols, d.dup_lines, d.repeat_words, any(f(d) for f in BASE.values())))
            cols = [b.column("doc_id"), pa.array(first, pa.string()), pa.array([x is None for x in first], pa.bool_())]
            if measures:
                cols += [pa.array(c, t) for c, t in zip(zip(*values) if values else [[]] * 6, [pa.int64()] * 5 + [pa.bool_()])]
            yield pa.RecordBatch.from_arrays(cols, schema_names)

    more = ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean" if measures else ""
    schema = f"doc_id {kind.simpleString()}, rejected_by string, kept boolean{more}"
    schema_names = [p.split()[0] for p in schema.split(", ")]
    return spread(docs.select("doc_id", "text")).mapInArrow(judge, schema)
