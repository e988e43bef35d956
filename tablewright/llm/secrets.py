"""Secret scans: fixed patterns, and character Markov models for the strings they miss (operator 6, DataFrame functions only).

Two first-order models over the 128 ASCII codes are trained from labelled samples: random strings (values that the
fixed patterns found in the corpus, and digests in hexadecimal and base 64) and ordinary identifiers (words of the
corpus that no pattern matched). A run of MIN_RUN or more token characters is a secret if its log-likelihood ratio
exceeds MARGIN. Only the transition counts, at most 128 x 128 numbers a class, reach the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import once

# The base patterns, the group that is measured and its least length. Hexadecimal runs and access keys
# end where their characters end, so their least length can be part of the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]

MIN_RUN = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
MARGIN = 10.0
#: The models learn from at most about this many documents and this many digests.
SAMPLE_DOCS, SAMPLE_DIGESTS = 5_000, 2_000
CODES = 128
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Code point spans of the leftmost non-overlapping matches whose group has at least `least` characters."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kept = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + F.length(m["g"])
        e = s + F.length(m["w"])
        one = F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(e.alias("at"), F.when(F.length(m["k"]) >= least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    pairs = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), whole.alias("w"), kept.alias("k")), lambda p: p)
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(pairs, start, step, lambda a: a["found"])).otherwise(F.array().cast(SPANS))


def codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, digests: int = SAMPLE_DIGESTS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each transition, by 128 * first + second."""
    rows = docs.count()
    share = max(1, rows // sample_docs)
    d = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(share)) == 0).select(F.coalesce("text", F.lit("")).alias("t"))
    values = [d.select(F.explode(F.regexp_extract_all("t", F.lit(p), F.lit(g))).alias("s")).filter(F.length("s") >= n) for _, p, g, n in KINDS]
    made = docs.sparkSession.range(digests).select(F.explode(F.array(F.sha2(F.col("id").cast("string"), 256), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id")), 256))))).alias("s"))
    random = made
    for v in values:
        random = random.unionByName(v)
    rest = F.col("t")
    for _, p, _, _ in KINDS:
        rest = F.regexp_replace(rest, p, " ")
    ordinary = d.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s"))
    c = random.select(F.lit(1).alias("random"), once(codes(F.col("s"))).alias("c")).unionByName(ordinary.select(F.lit(0).alias("random"), once(codes(F.col("s"))).alias("c")))
    c = c.filter(F.size("c") > 1)
    step = F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * CODES + F.get("c", i + 1)))
    counts = {0: [0] * CODES**2, 1: [0] * CODES**2}
    for r in c.select("random", step.alias("p")).groupBy("random", "p").count().collect():
        counts[r["random"]][r["p"]] = r["count"]
    # Additive smoothing over the 66 token characters.
    alpha, letters = 0.5, 66
    ratio = []
    for a in range(CODES):
        row1, row0 = counts[1][a * CODES:(a + 1) * CODES], counts[0][a * CODES:(a + 1) * CODES]
        n1, n0 = sum(row1) + alpha * letters, sum(row0) + alpha * letters
        ratio += [math.log((x + alpha) / n1) - math.log((y + alpha) / n0) for x, y in zip(row1, row0)]
    return ratio


def log_ratio(token: Column, ratio: list[float]) -> Column:
    """Log-likelihood ratio of a string; the literal is folded once."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratio])), "array<double>")
    start = F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("s"))
    return F.aggregate(codes(token), start, lambda acc, c: F.struct(c.alias("p"), (acc["s"] + F.when(acc["p"] < 0, 0.0).otherwise(F.get(table, acc["p"] * CODES + c))).alias("s")), lambda acc: acc["s"])


def scan(docs: DataFrame, ratio: list[float] | None = None, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, base and found, both arrays of (start, rank, end, kind) in order.

    `base` are the spans of the fixed patterns; `found` adds those of the models that overlap none of them. Offsets are
    code points, ends exclusive. Null, empty and blank texts give empty arrays; repeated rows and null ids are rows like
    others; other columns are not read; an empty table gives no rows. `ratio` is trained on the table if not given.
    """
    ratio = train(docs) if ratio is None else ratio
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    base = F.concat(*[spans(F.col("t"), p, g, n, kind, i) for i, (kind, p, g, n) in enumerate(KINDS)])
    d = d.select("doc_id", "t", once(F.array_sort(base)).alias("base"), once_spans(F.col("t")).alias("runs"))
    own = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"])) & (log_ratio(F.substring("t", r["start"] + 1, r["end"] - r["start"]), ratio) > margin))
    return d.select("doc_id", "base", F.array_sort(F.concat("base", own)).alias("found"))


def once_spans(text: Column) -> Column:
    return spans(text, RUN, 0, MIN_RUN, "markov", len(KINDS))


def written(found: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
