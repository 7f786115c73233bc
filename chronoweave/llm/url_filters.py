"""URL allow and block rules as a sort-merge range join.

A host's canonical key is its labels reversed, each ended by a NUL byte, so that a host
and all its subdomains are the keys with one prefix, which is one interval.  Pages and
rules are dealt out by ranges of that key; a rule goes to every range that its interval
meets, a page to one of the ranges that hold its key, by its id where a common host fills
several.  In each range one sweep in key order keeps the stack of rules whose intervals
are open; a page takes, of the stacked rules whose path its own path starts with, the one
with the longest rule string (then the longer host, then block).

Defined results: without ``://``, or null, host and path are empty; an unmatched page
takes ``default``; each row of the input gives one row.  The range bounds come from a
bounded sample and decide balance only.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import batch, fields, slices
from ._store import parts

#: Sampled keys by which ranges are drawn.
SAMPLE_KEYS = 20_000


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(bare, r"(?s)^[^/]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.substring(bare, F.length(host) + F.lit(1), F.length(bare))


def host_key(host) -> F.Column:
    """Labels reversed, each ended by NUL."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\0"), F.lit("\0"))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (host + path, or null) and verdict.

    ``rules`` has columns host, path and verdict.
    """
    spark = pages.sparkSession
    host, path = split_url(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")).cast("binary")).withColumn("spread", F.xxhash64("page_id", "path"))
    n = parts(spark)
    sample = base.select("key").sample(min(1.0, SAMPLE_KEYS / max(1, pages.count())), seed=5).limit(2 * SAMPLE_KEYS).collect()
    keys = sorted(bytes(r.key) for r in sample)
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []

    def ranges(low: bytes, high: bytes) -> tuple[int, int]:
        return bisect.bisect_left(bounds, low), bisect.bisect_right(bounds, high)

    id_type = base.schema["page_id"].dataType.simpleString()
    dealt = fields(f"range int, key binary, kind tinyint, spread long, page_id {id_type}, host string, path string, verdict string")

    def place(batches):
        for b in slices(batches):
            spans = [ranges(k, k) for k in b.column("key").to_pylist()]
            at = [a + s % (z - a + 1) for (a, z), s in zip(spans, b.column("spread").to_pylist())]
            own = {c: b.column(c) for c in ("key", "spread", "page_id", "host", "path")}
            yield batch(own | {"range": at, "kind": [1] * len(at), "verdict": [None] * len(at)}, dealt)

    def copy(batches):
        for b in batches:
            rows = []
            for h, p, v in zip(*(b.column(c).to_pylist() for c in ("host", "path", "verdict"))):
                k = b"".join(x.encode() + b"\0" for x in reversed(h.split(".")))
                a, z = ranges(k, k + b"\xff")
                rows += [(r, k, 0, 0, None, h, p, v) for r in range(a, z + 1)]
            yield batch(dict(zip(dealt.names, zip(*rows))) if rows else dict.fromkeys(dealt.names, []), dealt)

    both = base.mapInArrow(place, dealt).unionByName(rules.select("host", "path", "verdict").mapInArrow(copy, dealt))
    out = fields(f"page_id {id_type}, host string, path string, rule string, verdict string")

    def sweep(batches):
        stack, now = [], None
        for b in slices(batches):
            names, verdicts, pages = [], [], []
            for r, key, kind, h, p, v in zip(*(b.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict"))):
                if r != now:
                    stack, now = [], r
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                pages.append(kind == 1)
                if kind == 0:
                    stack.append((key, h, p, v))
                    best = None
                else:
                    best = max(((len(x[1]) + len(x[2]), len(x[1]), x[3] == "block", x) for x in stack if p.startswith(x[2])), default=None, key=lambda t: t[:3])
                names.append(best[3][1] + best[3][2] if best else None)
                verdicts.append(best[3][3] if best else default)
            own = {c: b.column(c) for c in ("page_id", "host", "path")}
            yield batch(own | {"rule": names, "verdict": verdicts}, out).filter(pa.array(pages, pa.bool_()))

    # ranged by the range's number, so that ranges and tasks are dealt out one to one
    return both.repartitionByRange(n, "range").sortWithinPartitions("range", "key", "kind").mapInArrow(sweep, out)
