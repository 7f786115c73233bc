"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

1. One pass over the texts gives each document's set size and a 128-bit digest of its
   shingle set, and counts all shingles in a fixed-size count sketch.  Equal sets collapse
   to their least doc_id.
2. A second pass orders each set rarest first by the sketch and gives its prefix of
   ``n - ceil(t n) + 1`` shingles.  Any order that is the same for all documents gives
   whole results, so the sketch's errors cost time only.  Prefix entries are ranged by
   (shingle, size, document), which splits even one shingle's documents over tasks, and
   those that no other document can match are dropped.
3. In turns, each component of linked documents proposes its nearest pair among the
   neighbours of its entries that pass the length, positional and suffix filters; the pairs
   are verified on the texts and components contract.  So a large group of near copies
   takes as many pairs as it has documents, and not its square.
4. A last turn makes the join whole: for every shingle whose documents are still of
   several components, all pairs of different components that pass the filters, each
   verified once.  Documents outside the shingle's main component probe its other
   documents, block by block where these are many.
The suffix filter bounds the distance of two sets from below by cutting them in cells of
which it compares the counts modulo two (SUFFIX cells, as bits).

Defined results: a null text is an empty one; a document without words has size 0 and
links with nothing; fewer than ``n`` words make one shingle; rows that repeat a doc_id
are one node; a null doc_id takes the component of its exact copies, or null if none has
an id.  Empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bits
from ._graph import components
from ._rows import batch, fields, lists, slices
from ._store import dealt, free, parts, save
from ._text import lower_bytes, mix, shingles, word_blocks

#: Counters of the shingle sketch (4 bytes each).
SKETCH = 1 << 20
#: Bits of the suffix filter.
SUFFIX = 256
#: Turns of nearest pairs at most, entries apart that they look at, and the share of proposed pairs that must link for another turn.
TURNS, REACH, WORTH = 6, 6, 0.5
#: Pairs for each entry that the last turn may meet; above that another turn follows if the one before has halved them.
MEET = 64
#: Documents of a shingle that probes meet at a time, and pairs that are filtered at a time.
BLOCK, PAIRS = 20_000, 1 << 20
#: For each task: prefix entries that are sorted out, entries whose neighbours are compared, documents, and pairs that are verified.
SHARE, EACH, NODES, TEXTS = 1 << 19, 50_000, 100_000, 2_000
#: Shingles of recently compared documents that a task keeps (8 bytes each).
KNOWN = 2_000_000
_U = np.uint64


def _sets(texts, n):
    for i, hashes in word_blocks(lower_bytes(texts)):
        for k, h in enumerate(hashes):
            yield i + k, shingles(h, n)


def _need(n, num: int, den: int):
    return -(-num * n // den)


def facts(docs: DataFrame, n: int) -> DataFrame:
    """Per document: size and digest; and rows of the sketch (seg, blob)."""
    out = fields("doc_id long, n long, d1 long, d2 long, seg int, blob binary")

    def read(batches):
        sketch = np.zeros(SKETCH, np.uint32)
        for b in slices(batches):
            size, d1, d2 = np.zeros((3, b.num_rows), np.int64)
            for i, s in _sets(b.column("text").to_pylist(), n):
                if len(s):
                    np.add.at(sketch, (s & _U(SKETCH - 1)).astype(np.int64), np.uint32(1))
                    size[i], d1[i], d2[i] = len(s), s.sum().astype(np.int64), mix(s ^ _U(0xA5A5A5A5)).sum().astype(np.int64)
            none = [None] * b.num_rows
            yield batch({"doc_id": b.column("doc_id"), "n": size, "d1": d1, "d2": d2, "seg": none, "blob": none}, out)
        rows = _bits.segments(sketch)
        none = [None] * len(rows)
        yield batch({"doc_id": none, "n": none, "d1": none, "d2": none, "seg": [s for s, _ in rows], "blob": [x for _, x in rows]}, out)

    return save(docs.mapInArrow(read, out))


def _suffix_bits(s: np.ndarray) -> bytes:
    """Counts modulo two of the set's SUFFIX cells."""
    return np.packbits((np.bincount((s >> _U(40)).astype(np.int64) % SUFFIX, minlength=SUFFIX) & 1).astype(np.uint8)).tobytes()


def _prefixes(docs: DataFrame, shared, one_of_each, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, prefix, suffix): each document's rarest shingles, rarest first, and its suffix bits.

    The filter ``one_of_each`` leaves out most copies; joins with the nodes leave out the rest.
    """
    out = fields("doc_id long, n int, prefix array<long>, suffix binary")

    def read(batches):
        count = shared.value
        for b in slices(batches):
            b = b.filter(pa.array(_bits.maybe(b.column("doc_id").to_numpy(), one_of_each.value)))
            sizes, heads, tails = np.zeros(b.num_rows, np.int32), [], []
            for i, s in _sets(b.column("text").to_pylist(), n):
                rare = np.argsort(count[(s & _U(SKETCH - 1)).astype(np.int64)], kind="stable")
                sizes[i] = len(s)
                heads.append(s[rare[: len(s) - _need(len(s), num, den) + 1]].view(np.int64) if len(s) else s.view(np.int64))
                tails.append(_suffix_bits(s))
            yield batch({"doc_id": b.column("doc_id"), "n": sizes, "prefix": lists(heads, pa.int64()), "suffix": tails}, out)

    return save(docs.where("doc_id is not null").mapInArrow(read, out).where("n > 0"))


def _columns(b: pa.RecordBatch, names) -> dict[str, np.ndarray]:
    out = {}
    for c in names:
        col = b.column(c)
        if pa.types.is_binary(col.type):  # suffix bits; a document of several sets has none
            blank = bytes(SUFFIX // 8)
            out["known"] = np.asarray(col.is_valid().to_numpy(zero_copy_only=False), bool)
            out[c] = np.frombuffer(b"".join(x or blank for x in col.to_pylist()), _U).reshape(-1, SUFFIX // 64)
        else:
            out[c] = col.to_numpy(zero_copy_only=False)
    return out


def _entries(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(h, doc_id, n, pos): prefix entries that may match another document's, in order of shingle and size."""
    rows = prefix.select("doc_id", "n", F.posexplode("prefix").alias("pos", "h"))
    keys, out = ("h", "n", "doc_id"), fields("h long, doc_id long, n int, pos int")

    def shared(batches):
        last, first = None, True  # the entry before this batch, not given yet
        for b in batches:
            cur = {c: b.column(c).to_numpy() for c in out.names}
            if last is not None:
                cur = {c: np.concatenate([last[c], cur[c]]) for c in cur}
            h, size, doc = cur["h"], cur["n"].astype(np.int64), cur["doc_id"]
            near = (h[1:] == h[:-1]) & (num * size[1:] <= den * size[:-1]) & (doc[1:] != doc[:-1])
            keep = np.concatenate([[first], near]) | np.concatenate([near, [False]])
            if last is not None:
                keep[0] |= last["keep"]
            yield batch({c: cur[c][:-1][keep[:-1]] for c in cur}, out)
            last, first = {c: cur[c][-1:] for c in cur} | {"keep": keep[-1]}, False
        if last is not None:  # at the border of a task: its match may lie beyond
            yield batch({c: last[c] for c in out.names}, out)

    total = prefix.agg(F.sum(F.size("prefix"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(parts(prefix.sparkSession), total // SHARE + 1), *keys)
    return save(dealt(ranged, total, SHARE // 4).sortWithinPartitions(*keys).select("h", "doc_id", "n", "pos").mapInArrow(shared, out))


def _passes(x: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of entries pass the length, positional and suffix filters; and a bound on their distance."""
    a, b = x["n"][i].astype(np.int64), x["n"][j].astype(np.int64)
    need = _need(a + b, num, num + den)
    ok = (num * np.maximum(a, b) <= den * np.minimum(a, b)) & (np.minimum(a - x["pos"][i], b - x["pos"][j]) >= need)
    apart = np.bitwise_count(x["suffix"][i] ^ x["suffix"][j]).sum(1).astype(np.int64)
    apart[~(x["known"][i] & x["known"][j])] = 0
    return ok & (apart <= a + b - 2 * need), apart / (a + b)


_PAIR = "a long, b long, ca long, cb long"


def _ordered(x: dict, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs of documents with their components, the lesser document first."""
    a, b, swap = x["doc_id"][i], x["doc_id"][j], x["doc_id"][i] > x["doc_id"][j]
    ca, cb = x["comp"][i], x["comp"][j]
    return {"a": np.where(swap, b, a), "b": np.where(swap, a, b), "ca": np.where(swap, cb, ca), "cb": np.where(swap, ca, cb)}


_ENTRY = ("h", "doc_id", "n", "pos", "suffix", "comp")


def _nearest(entries: DataFrame, nodes: DataFrame, turn: int, size: int, num: int, den: int) -> DataFrame:
    """For each component the pair of least bounded distance between neighbours of its entries.

    Neighbours stand near each other among a shingle's documents by size, or by hash in
    later turns; a pair lost at the border of a task is found by the last turn.
    """
    out = fields(f"comp long, apart double, {_PAIR}")

    def propose(batches):
        last = None
        for b in batches:
            x = _columns(b, _ENTRY)
            if last is not None:
                x = {c: np.concatenate([last[c], x[c]]) for c in x}
            last = {c: v[-REACH:] for c, v in x.items()}
            found, far = [], []
            for gap in range(1, REACH + 1):
                i = np.flatnonzero((x["h"][gap:] == x["h"][:-gap]) & (x["comp"][gap:] != x["comp"][:-gap])) if len(x["h"]) > gap else np.zeros(0, int)
                ok, apart = _passes(x, i, i + gap, num, den)
                found.append(np.stack([i[ok], i[ok] + gap]))
                far.append(apart[ok])
            (i, j), far = np.concatenate(found, 1), np.concatenate(far)
            comp, side = np.concatenate([x["comp"][i], x["comp"][j]]), np.tile(np.arange(len(i)), 2)
            order = np.lexsort((side, far[side], comp))
            comp, side = comp[order], side[order]
            head = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]])) if len(comp) else order
            yield batch({"comp": comp[head], "apart": far[side[head]], **_ordered(x, i[side[head]], j[side[head]])}, out)

    place = F.col("n") if turn == 0 else F.xxhash64("h", "doc_id", F.lit(turn))
    rows = entries.join(nodes, "doc_id").withColumn("place", place)
    keys = ("h", "place", "doc_id")
    ranged = dealt(rows.repartitionByRange(parts(nodes.sparkSession), *keys), size, EACH).sortWithinPartitions(*keys).select(*_ENTRY)
    best = dealt(ranged.mapInArrow(propose, out).groupBy("comp").agg(F.min(F.struct("apart", "a", "b", "ca", "cb")).alias("p")), size, EACH)
    return save(dealt(best.select("p.a", "p.b", "p.ca", "p.cb").distinct(), size, EACH))


def _open(entries: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(h, main, all, others): shingles whose documents are of several components, the one with most of them, and the numbers of all documents and of those outside it."""
    by = entries.join(nodes, "doc_id").groupBy("h", "comp").agg(F.count("*").alias("k"))
    of = by.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    return save(dealt(of, size, EACH).select("h", F.col("m.comp").alias("main"), "all", (F.col("all") - F.col("m.k")).alias("others")))


def _meets(open_: DataFrame) -> int:
    """A bound on the pairs that meet in the last turn."""
    return open_.agg(F.sum(F.col("others") * F.col("all"))).first()[0] or 0


def _rest(entries: DataFrame, nodes: DataFrame, open_: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """All pairs of different components that share a prefix shingle and pass the filters.

    Shingles with one main component go to one task, but for their documents, which are
    dealt in blocks: all shingles of a pair meet there, so that it is told once.
    """
    blocks = open_.groupBy("main").agg(F.ceil(F.sum("all") / BLOCK).cast("int").alias("blocks"))
    rows = entries.join(nodes, "doc_id").join(open_.select("h", "main").join(blocks, "main"), "h")
    targets = rows.select(*_ENTRY, "main", F.lit(0).alias("probe"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    probes = rows.where("comp <> main").select(*_ENTRY, "main", F.lit(1).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    out, used = fields(_PAIR), (*_ENTRY, "main", "block", "probe")

    def match(batches):
        held, told = None, None
        for b in batches:
            x = _columns(b, used)
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            differ = lambda *names: np.concatenate([[0], np.cumsum(np.any([x[c][1:] != x[c][:-1] for c in names], axis=0))]) if len(x["h"]) else np.zeros(0, int)
            group = differ("main", "block", "h")
            for found in _met(x, group, num, den):
                told = found if told is None else {c: np.concatenate([told[c], found[c]]) for c in found}
                told = _once(told)
                if len(told["a"]) > PAIRS:
                    yield batch(told, out)
                    told = None
            stay = (group == group[-1]) & (x["probe"] == 0) if len(group) else np.zeros(0, bool)
            held = {c: v[stay] for c, v in x.items()}
        if told is not None:
            yield batch(told, out)

    met = dealt(targets.unionByName(probes).repartition(parts(nodes.sparkSession), "main", "block"), size, EACH).sortWithinPartitions("main", "block", "h", "probe", "n", "doc_id")
    return save(dealt(met.select(*used).mapInArrow(match, out).distinct(), size, EACH))


def _once(pairs: dict) -> dict:
    first = np.unique(np.stack([pairs["a"], pairs["b"]]), axis=1, return_index=True)[1]
    return {c: v[first] for c, v in pairs.items()}


def _met(x: dict, group: np.ndarray, num: int, den: int):
    """The pairs of each probe with its group's documents, a bounded number at a time.

    Among documents outside the main component, the greater one probes.
    """
    t, p = np.flatnonzero(x["probe"] == 0), np.flatnonzero(x["probe"] == 1)
    size = x["n"].astype(np.int64)
    key = group[t] * (1 << 32) + size[t]
    low = np.searchsorted(key, group[p] * (1 << 32) + _need(size[p], num, den))
    high = np.searchsorted(key, group[p] * (1 << 32) + size[p] * den // num, "right")
    run = np.cumsum(high - low)
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + PAIRS, "right")))
        k = (high - low)[at:to]
        i = np.repeat(p[at:to], k)
        j = t[np.repeat(low[at:to], k) + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)]
        ok = (x["comp"][i] != x["comp"][j]) & ((x["comp"][j] == x["main"][j]) | (x["doc_id"][j] < x["doc_id"][i]))
        i, j = i[ok], j[ok]
        ok = _passes(x, i, j, num, den)[0]
        if ok.any():
            yield _once(_ordered(x, i[ok], j[ok]))
        at = to


def _texts(docs: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """(doc_id, t): lower-cased and compressed texts of the documents that have entries."""
    table = docs.sparkSession.sparkContext.broadcast(_bits.key_filter(entries, "doc_id", _bits.room(size)))
    text = fields("doc_id long, t binary")

    def pick(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(pa.array(_bits.maybe(b.column("doc_id").to_numpy(), table.value)))
            for s in slices([b]):
                yield batch({"doc_id": s.column("doc_id"), "t": [z.compress(x) for x in lower_bytes(s.column("text").to_pylist())]}, text)

    return save(docs.where("doc_id is not null").mapInArrow(pick, text))


def _verified(pairs: DataFrame, texts: DataFrame, count: int, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose Jaccard similarity is at least num/den, each compared once."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    table = pairs.sparkSession.sparkContext.broadcast(_bits.key_filter(wanted, "doc_id", _bits.room(count)))
    pair = fields(_PAIR)

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(_bits.maybe(b.column("doc_id").to_numpy(), table.value)))

    def compare(batches):
        z, known, held = zstandard.ZstdDecompressor(), {}, 0

        def read(blob):
            nonlocal held
            if blob not in known:
                if held > KNOWN:
                    known.clear()
                    held = 0
                known[blob] = next(_sets([z.decompress(blob).decode()], n))[1]
                held += len(known[blob])
            return known[blob]

        for b in slices(batches, 256):
            keep = []
            for ta, tb in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                one, other = read(ta), read(tb)
                both = len(one) + len(other)
                shared = both - len(np.unique(np.concatenate([one, other])))
                keep.append(den * shared >= num * (both - shared))
            yield b.select(pair.names).filter(pa.array(keep, pa.bool_()))

    texts = texts.mapInArrow(pick, texts.schema)
    a, b = texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    both = dealt(pairs.join(a, "a").join(b, "b"), count, TEXTS).select(*pair.names, "ta", "tb")
    return save(both.mapInArrow(compare, pair))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (least doc_id linked).

    Links are pairs whose sets of ``n``-word shingles have ``den * both >= num * either``.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = facts(docs, n)
    every = table.where("seg is null").drop("seg", "blob")
    sketch = _bits.merged(table.where("seg is not null").select("seg", "blob"), SKETCH, "uint32", "add")
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    sets = save(every.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id")))

    ids = sets.where("doc_id is not null").select("doc_id")
    one_of_each = docs.sparkSession.sparkContext.broadcast(_bits.key_filter(ids, "doc_id", _bits.room(ids.count())))
    prefix = _prefixes(docs, shared, one_of_each, n, num, den)
    one = F.when(F.min("suffix") == F.max("suffix"), F.min("suffix"))  # a doc_id of several sets has no suffix bits
    bits = prefix.groupBy("doc_id").agg(one.alias("suffix"))
    nodes = save(ids.distinct().join(bits, "doc_id").withColumn("comp", F.col("doc_id")))
    entries = _entries(prefix, num, den)
    free(prefix)

    size, docs_left = entries.count(), nodes.count()
    texts = _texts(docs, entries, size)

    turn, open_, meets = 0, None, float("inf")
    while turn <= TURNS:
        if turn == TURNS and open_ is None:
            open_ = _open(entries, nodes, size)
        pairs = _nearest(entries, nodes, turn, size, num, den) if turn < TURNS else _rest(entries, nodes, open_, size, num, den)
        count = pairs.count()
        links = _verified(pairs, texts, count, n, num, den)
        made = links.count()
        if made:
            near = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            now = nodes.join(near.withColumnRenamed("node", "comp"), "comp", "left").select("doc_id", "suffix", F.coalesce("component", "comp").alias("comp"))
            now = save(dealt(now, docs_left, NODES))
            free(nodes, near)
            nodes = now
        free(pairs, links)
        turn += 1
        if turn < TURNS and made <= WORTH * count:  # few links: on to the last turn, if turns no longer make that much smaller
            open_ = _open(entries, nodes, size)
            before, meets = meets, _meets(open_)
            if made and MEET * size < meets < before / 2:
                free(open_)
                open_ = None
            else:
                turn = TURNS

    known = save(sets.join(nodes.select("doc_id", "comp"), "doc_id", "left").select("d1", "d2", "n", "comp"))
    free(entries, nodes, texts, open_)
    out = every.select("doc_id", "n", "d1", "d2").join(known, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))
