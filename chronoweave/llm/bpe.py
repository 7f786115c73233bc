"""BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash over four words cuts each text at white space, so equal passages give
   equal chunks wherever they stand.  Each seam is checked: the words beside it, encoded
   together, must give what they give apart; where they don't, the cut is undone and the
   check repeated, until all seams agree.  Joined ids are then exact.
2. Chunk hashes (128 bits) are counted over all documents.  Those seen in two or more
   places go to a filter, which is broadcast; its size follows their number up to 32 MB.
3. Documents are read again.  Chunks outside the filter are encoded in place, and a
   document with no others is finished there.  Chunks in the filter are sent once each to
   be encoded once; their ids are joined back to the documents that hold them.
A false hit in the filter sends a chunk the longer way and changes no result; were the
filter full, all chunks would take it.

The tokenizer file decides.  Where its normaliser, splitter and decoder are those of
WORD_RULES, encoding goes pre-token by pre-token through bounded tables of known ones,
filled by the tokenizers library's model; that path is taken only for text whose characters it
treats in a plain way (Latin-1 without other control characters or added tokens).  With
the byte-level splitter the library encodes the chunks.  With any other rules, of which
nothing is known about white space, every text is one chunk and the library encodes and
decodes it.

Defined results: a null or empty text has no tokens; rows are encoded one by one, so a
repeated id or row gives its own row, and a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bits
from ._rows import batch, fields, lists, slices
from ._store import save
from ._text import BLOCK, _IS_WS, grams, words

#: A chunk ends where the rolling hash of four words is 0 modulo this: so many words on average.
CHUNK_WORDS = 64
#: Pre-tokens of each of a worker's two tables of known ones.
KNOWN = 100_000
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\x85\xa0-\xff]*")
_LETTERS, _NUMBERS = "a-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The rules for which pre-tokens are told by _PIECES, and those of the byte-level splitter.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
BYTE_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


def _follows(spec: dict, rules: dict) -> bool:
    """Whether a tokenizer file has these rules, a plain BPE model, and added tokens that are found in the raw text."""
    model = spec["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    return plain and all(spec.get(k) == v for k, v in rules.items())


class Encoder:
    """Exact ids of a text by the tokenizer file's own rules, with a bounded table of pre-tokens."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(text)
        self.by_words, self.model = _follows(spec, WORD_RULES), self.tok.model
        #: Whether no pre-token reaches from a word over white space into the next.
        self.cuttable = self.by_words or _follows(spec, BYTE_RULES)
        self.added = [t["content"] for t in spec["added_tokens"]]
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = [self.tok.id_to_token(i) for i in range(size)] if self.by_words else []
        #: Ids on their way between tasks take two bytes where the vocabulary allows it.
        self.sent = "<u2" if size <= 1 << 16 else "<u4"
        # ids as bytes of pre-tokens met since the table was last full, and of those met before
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, text: str) -> tuple[bytes, str | None]:
        """Ids as little-endian uint32, and decode(ids, skip_special_tokens=False) where that is at hand."""
        if not text:
            return b"", ""
        if not self.by_words or not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return _pack(self.tok.encode(text, add_special_tokens=False).ids), None
        if len(self.known) > KNOWN:
            self.known, self.before = {}, self.known
        pieces = _PIECES.findall(text.lower())
        found = list(map(self.known.get, pieces))
        if None in found:
            self._learn({p for p, ids in zip(pieces, found) if ids is None})
            found = map(self.known.__getitem__, pieces)
        return b"".join(found), None

    def _learn(self, new: set[str]) -> None:
        """Put pre-tokens in the table; the byte-level splitter leaves ASCII as it is, so the model alone tells the ids of that."""
        others = []
        for p in new:
            if p in self.before:
                self.known[p] = self.before[p]
            elif p.isascii():
                self.known[p] = _pack([t.id for t in self.model.tokenize(p)])
            else:
                others.append(p)
        for p, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False) if others else ()):
            self.known[p] = _pack(e.ids)

    def to_send(self, text: str) -> bytes:
        return np.frombuffer(self.encode(text)[0], "<u4").astype(self.sent).tobytes()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids)) if self.by_words else self.tok.decode(ids, skip_special_tokens=False)


def _encoder(spec: str) -> Encoder:
    """The worker's encoder; kept on an imported module, as this one is unpickled anew for each task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_chronoweave", {})
    if spec not in kept:
        kept[spec] = Encoder(spec)
    return kept[spec]


def _cuts(raw: bytes, every: int) -> Iterator[int]:
    """Byte offsets of the white space at which chunks end."""
    at = 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        buf = np.frombuffer(raw, np.uint8)
        while end < len(raw) and not _IS_WS[buf[end]]:
            end += 1
        _, ends, h = words(buf[at:end])
        roll = grams(h, 4)
        for k in np.flatnonzero(roll % np.uint64(every) == 0):
            cut = at + int(ends[k + 3])
            if cut < len(raw):
                yield cut
        at = end


def _edge(text: str, last: bool) -> str:
    """The last or first word of a text."""
    width = 64
    while True:
        found = (text[-width:] if last else text[:width]).split()
        if len(found) > 1 or width >= len(text):
            return (found[-1] if last else found[0]) if found else ""
        width *= 8


def chunks(text: str, enc: Encoder, every: int = CHUNK_WORDS) -> list[str]:
    """Content-defined chunks of a text whose ids, joined, are the ids of the text."""
    if not enc.cuttable:
        return [text] if text else []
    raw = text.encode()
    out, at = [], 0
    for cut in [*_cuts(raw, every), len(raw)]:
        piece = raw[at:cut].decode()
        at = cut
        while out and not _agrees(out[-1], piece, enc):
            piece = out.pop() + piece
        out.append(piece)
    return [x for x in out if x]


def _agrees(left: str, right: str, enc: Encoder) -> bool:
    """Whether the words beside a seam, encoded together, give what they give apart.

    A pre-token, an added token and a canonical composition never reach across white
    space, so one word on each side decides; with the word rules a seam of plain characters needs no encoding.
    """
    a, b = _edge(left, True), _edge(right, False)
    seam = right[: len(right) - len(right.lstrip())]
    if enc.by_words and seam and _PLAIN.fullmatch(a) and _PLAIN.fullmatch(b) and _PLAIN.fullmatch(seam):
        return True
    return bool(seam) and enc.encode(a + seam + b)[0] == enc.encode(a)[0] + enc.encode(seam + b)[0]


def _hash(piece: str) -> tuple[int, int]:
    """128 bits as two longs."""
    d = hashlib.blake2b(piece.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _digests(ids: bytes, text: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _encoded(docs: DataFrame, vocabulary: str | None, id_col: str, text_col: str, every: int, digests: bool):
    """What both forms of the result are made from: the broadcast file, finished rows, and the parts of the others.

    Finished rows have doc_id, and digests or else ids; parts have row, doc_id, k and ids, dealt by
    row and in order of k.  Ids are binary, in the encoder's ``sent`` width.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(open(vocabulary or default_path(), encoding="utf-8").read())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = fields("h1 long, h2 long")

    def hashes(batches):
        enc = _encoder(spec.value)
        for b in slices(batches):
            found = [_hash(c) for t in b.column("text").to_pylist() if t for c in chunks(t, enc, every)]
            two = np.array(found, np.int64).reshape(-1, 2)
            yield batch({"h1": two[:, 0], "h2": two[:, 1]}, key)

    shared = save(docs.mapInArrow(hashes, key).groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    table = spark.sparkContext.broadcast(_bits.key_filter(shared, "h1", _bits.room(shared.count())))
    out = fields("kind int, row long, doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string, k int, h1 long, h2 long, piece string")

    def first(batches):
        """kind 0: a finished row; 1: a part of a row, its ids or a shared chunk's hash; 2: a shared chunk."""
        enc, made, sent = _encoder(spec.value), TaskContext.get().partitionId() << 40, set()
        for b in slices(batches, 256):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                row, made = made, made + 1
                own = chunks(text, enc, every) if text else []
                keys = [_hash(c) for c in own]
                hit = _bits.maybe(np.array([h for h, _ in keys], np.int64), table.value) if keys else np.zeros(0, bool)
                if not hit.any():
                    ids, said = enc.encode(text or "")
                    said = enc.decode(np.frombuffer(ids, "<u4").tolist()) if said is None and digests else said
                    told = (None, *_digests(ids, said)) if digests else (np.frombuffer(ids, "<u4").astype(enc.sent).tobytes(), None, None, None)
                    rows.append((0, row, doc_id, *told, None, None, None, None))
                    continue
                for h, run in groupby(range(len(own)), hit.__getitem__):  # runs of unshared chunks are one part
                    run = list(run)
                    if not h:
                        rows.append((1, row, doc_id, enc.to_send("".join(own[run[0] : run[-1] + 1])), None, None, None, run[0], None, None, None))
                        continue
                    for k in run:
                        rows.append((1, row, doc_id, None, None, None, None, k, *keys[k], None))
                        if keys[k] not in sent:
                            sent.add(keys[k])
                            rows.append((2, None, None, None, None, None, None, None, *keys[k], own[k]))
            if len(sent) > 100_000:
                sent.clear()
            yield batch(dict(zip(out.names, zip(*rows))), out)

    sent = save(docs.mapInArrow(first, out))
    coded = fields("h1 long, h2 long, shared binary")

    def encode(batches):
        enc = _encoder(spec.value)
        for b in slices(batches):
            yield batch({"h1": b.column("h1"), "h2": b.column("h2"), "shared": [enc.to_send(p) for p in b.column("piece").to_pylist()]}, coded)

    once = save(sent.where("kind = 2").select("h1", "h2", "piece").dropDuplicates(["h1", "h2"]).mapInArrow(encode, coded))
    waits = sent.where("kind = 1").select("row", "doc_id", "k", "h1", "h2", "ids")
    refs = waits.where("h1 is not null").drop("ids").join(once, ["h1", "h2"]).select("row", "doc_id", "k", F.col("shared").alias("ids"))
    whole = refs.unionByName(waits.where("h1 is null").select("row", "doc_id", "k", "ids")).repartition("row").sortWithinPartitions("row", "k")
    return spec, sent.where("kind = 0"), whole


def _joined(batches) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of each row from its parts in order."""
    now, doc, held = None, None, []
    for b in slices(batches):
        for row, doc_id, ids in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "ids"))):
            if row != now:
                if now is not None:
                    yield doc, b"".join(held)
                now, doc, held = row, doc_id, []
            held.append(ids)
    if now is not None:
        yield doc, b"".join(held)


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", every: int = CHUNK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    ``vocabulary`` is the path of a tokenizer file on the driver; its text is broadcast.
    """
    spec, done, parts = _encoded(docs, vocabulary, id_col, text_col, every, True)
    out = fields("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def assemble(batches):
        enc, rows = _encoder(spec.value), []
        for doc_id, sent in _joined(batches):
            ids = np.frombuffer(sent, enc.sent)
            rows.append((doc_id, *_digests(ids.astype("<u4").tobytes(), enc.decode(ids.tolist()))))
            if len(rows) == 1024:
                yield batch(dict(zip(out.names, zip(*rows))), out)
                rows = []
        if rows:
            yield batch(dict(zip(out.names, zip(*rows))), out)

    return done.select(*out.names).unionByName(parts.mapInArrow(assemble, out))


#: Ids that a task holds before it gives them on.
HELD_IDS = 1 << 19


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", every: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_tokens and token ids (array of int) of each row."""
    spec, done, parts = _encoded(docs, vocabulary, id_col, text_col, every, False)
    wide = json.loads(spec.value)
    size = max([*wide["model"]["vocab"].values(), *(t["id"] for t in wide["added_tokens"])]) + 1
    width, out = "<u2" if size <= 1 << 16 else "<u4", fields("doc_id long, n_tokens long, ids array<int>")

    def told(rows):
        ids = [np.frombuffer(x, width) for _, x in rows]
        return batch({"doc_id": [d for d, _ in rows], "n_tokens": [len(x) for x in ids], "ids": lists(ids, pa.int32())}, out)

    def unpack(rows):
        held, n = [], 0
        for row in rows:
            held.append(row)
            n += len(row[1])
            if n > HELD_IDS:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)

    finished = lambda batches: unpack(r for b in slices(batches) for r in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()))
    joined = lambda batches: unpack(_joined(batches))
    return done.select("doc_id", "ids").mapInArrow(finished, out).unionByName(parts.mapInArrow(joined, out))
