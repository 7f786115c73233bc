"""Secret scans: fixed patterns, and character Markov models for random strings.

Two first-order Markov chains over ASCII characters are trained here from labelled strings:
random keys and ordinary identifiers.  Runs of ``[A-Za-z0-9_+/=-]``, without the characters of
pattern matches, are cut at separators.  A segment is a secret where the log-likelihood
ratio of its best window exceeds a threshold: MIXED_LEAST for neighbouring pieces that hold
mixed case or letters with digits, and for a piece of letters of one case, which invented
words come near, one that falls with its length (:func:`word_least`).  So is a whole run of
20 or more with a letter and a digit whose ratio per character exceeds a threshold set on a
held-out part of the labelled strings.  Segments of fewer than LEAST characters are not
scored: words of the documents reach the ratios of keys there.

Defined results: a null text is empty; offsets count code points, end exclusive; spans of
a kind are leftmost and do not overlap; very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import extend

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Characters of the shortest segment, and least ratio of the best window of mixed ones.
LEAST, MIXED_LEAST, DRIFT = 16, 10.0, 0.36
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{%d,}" % LEAST)
_PIECE = re.compile(r"[A-Za-z0-9]+")
_ONE_KIND = re.compile(r"[A-Z]?[a-z]*|[A-Z]*|[0-9]*")
#: Words before an assignment, as an ASCII-lowered text holds them.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_ONLY = bytes(0x78 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_RUN_ONLY = bytes(0x78 if re.match("[A-Za-z0-9_+/=-]", chr(c)) and c < 128 else 0x20 for c in range(256))

#: Stems of which ordinary identifiers are composed.
STEMS = (
    "get set list user name file path data test value index count table column query result server client request response "
    "message handler config option default error string number array object type class method module package version build "
    "update delete create insert select find search filter sort order group total price account payment customer product "
    "address street city country date time start end first last next previous page line word text image video audio node "
    "edge graph tree leaf root parent child left right top bottom width height color font style theme button label input "
    "through thing other another nothing information situation language question station nation international development "
    "government environment university community education experience association organisation administration management "
    "schon nicht werden sich einer keit heit ung verein gesetz stelle zeichen vorgang auftrag kunde rechnung adresse "
    "mentir nouvelle article valeur compte facture adresse client livraison quelque toujours elles notre votre heureux "
    "valor cuenta factura cliente direccion nombre fecha cantidad mientras siempre entonces llamada proceso ciudad "
    "output format parse render load save read write open close begin commit session cache buffer stream thread process "
    "queue stack event signal timer clock engine driver adapter factory manager service controller model view entity field"
).split()
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_KEYS = (_BASE64, _BASE64[:62], _BASE64[:26] + _BASE64[52:62], _BASE64[26:36] + _BASE64[52:62], _BASE64[26:62], _BASE64[:62] + "_-")


def labelled_samples(n: int = 6000, seed: int = 11) -> list[tuple[str, int]]:
    """(string, 1 random or 0 ordinary) for training, the same on every call."""
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append(("".join(rng.choice(_KEYS[i % len(_KEYS)]) for _ in range(rng.randint(20, 64))), 1))
        stems = [rng.choice(STEMS) for _ in range(rng.randint(3, 8))]
        number = rng.choice(["", str(rng.randint(0, 99)), str(rng.randint(1900, 2100)), f"v{rng.randint(1, 20)}", f"{rng.randint(2000, 2040)}{rng.randint(101, 1231):04d}"])
        if number:
            stems.insert(rng.randint(1, len(stems)), number)
        if i % 12 == 1:  # dates, serial numbers and fillers
            stems = [str(rng.randint(0, 10 ** rng.randint(2, 8))) for _ in range(rng.randint(3, 5))] + [rng.choice(STEMS)]
        elif i % 12 == 2:
            stems = [rng.choice("xa0-=_") * rng.randint(12, 30), rng.choice(STEMS), number or "1"]
        sep = ("_", "-", "/", "", "", "_")[i % 6]
        name = sep.join(x.upper() if i % 6 == 5 else x.capitalize() if i % 6 in (3, 4) else x for x in stems)
        out.append((name + "=" * (i % 97 == 0), 0))
    return out


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("ascii", "replace"), np.uint8).astype(np.int64) & 127


def _grams(s: str) -> np.ndarray:
    c = _codes(s)
    return c[:-1] * 128 + c[1:]


class MarkovRatio:
    """Two first-order character chains and the threshold on their log-likelihood ratio."""

    def __init__(self, samples: Iterable[tuple[str, int]], smoothing: float = 0.5, false_rate: float = 0.001):
        """Every fifth sample of a label is held out; the threshold lies midway
        between the level that ``false_rate`` of the held-out ordinary strings exceed and that which 1 % of the random ones miss."""
        samples = [(s, y) for s, y in samples if len(s) > 3]
        tables = []
        for label in (0, 1):
            own = [s for s, y in samples if y == label]
            count = np.full(128**2, smoothing, np.float64)
            for k, s in enumerate(own):
                if k % 5:
                    np.add.at(count, _grams(s), 1)
            count = count.reshape(128, 128)
            tables.append(np.log(count / count.sum(1, keepdims=True)).ravel())
        self.ratio = (tables[1] - tables[0]).astype(np.float32)
        held = {y: sorted(self.score(s) for s in [s for s, z in samples if z == y][::5]) for y in (0, 1)}
        low = max(0.0, held[0][max(0, math.ceil(len(held[0]) * (1 - false_rate)) - 1)]) if held[0] else 0.0
        high = held[1][len(held[1]) // 100] if held[1] else low
        self.threshold = max(low, (low + high) / 2)
        self.held_out = {"false": float(np.mean([x > self.threshold for x in held[0]])), "caught": float(np.mean([x > self.threshold for x in held[1]]))}

    def score(self, s: str) -> float:
        return _score(self.ratio, s)

    def plain(self) -> tuple[np.ndarray, float]:
        """What scanning needs: the table of ratios (64 kB, whatever the input) and the threshold."""
        return self.ratio, self.threshold


def _score(ratio: np.ndarray, s: str) -> float:
    """Log-likelihood ratio per character, random over ordinary."""
    return float(ratio[_grams(s)].mean()) if len(s) > 1 else 0.0


def _has_run(raw: bytes, classes: bytes, n: int) -> bool:
    return b"x" * n in raw.translate(classes)


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, by start and then kind as listed."""
    raw = text.encode() if raw is None else raw
    low, out = raw.lower(), []
    if any(w.encode() in low for w in _WORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _has_run(raw, _HEX_ONLY, 24):
        out += [(*m.span(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def word_least(n: int) -> float:
    """Least ratio of the best window in ``n`` letters of one case: no word of the documents of sf0.1 reaches it."""
    return max(12.0, 34.0 - 2.0 * (n - LEAST))


def _peak(ratio: np.ndarray, s: str) -> float:
    """The greatest sum of the ratio, less DRIFT a character, over windows of ``s``."""
    upto = np.concatenate([[0.0], np.cumsum(ratio[_grams(s)].astype(np.float64) - DRIFT)])
    return float((upto - np.minimum.accumulate(upto)).max())


def random_spans(s: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the random segments of a run."""
    if len(s) >= 20 and re.search("[0-9]", s) and re.search("[A-Za-z]", s) and _score(ratio, s) > threshold:
        return [(0, len(s))]
    groups, out = [], []  # of mixed pieces, with pieces under five characters among or beside them
    for m in _PIECE.finditer(s):
        (a, b), word = m.span(), bool(_ONE_KIND.fullmatch(m[0]))
        if word and b - a >= 5:
            groups.append([a, b, "word"])
        elif groups and groups[-1][2] != "word":
            groups[-1][1], groups[-1][2] = b, "mixed" if not word else groups[-1][2]
        else:
            groups.append([a, b, "short" if word else "mixed"])
    for a, b, kind in groups:
        least = {"mixed": MIXED_LEAST, "word": word_least(b - a) if s[a].isalpha() else math.inf, "short": math.inf}[kind]
        if b - a >= LEAST and _peak(ratio, s[a:b]) > least:
            out.append((a, b + len(re.match("={0,2}", s[b:])[0])))
    return out


def all_spans(text: str, ratio: np.ndarray, threshold: float) -> tuple[list, list]:
    """The pattern spans, and these with the random segments that the models add."""
    raw = text.encode()
    base = base_spans(text, raw)
    more = []
    if _has_run(raw, _RUN_ONLY, LEAST):
        for m in _RUN.finditer(text):
            at, parts = m.start(), []
            for a, b, _ in base:
                if b > at and a < m.end():
                    parts += [(at, a)] if a > at else []
                    at = b
            parts.append((at, m.end()))
            more += [(x + a, x + b, "random") for x, y in parts if y - x >= LEAST for a, b in random_spans(text[x:y], ratio, threshold)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_scan(docs: DataFrame, model: MarkovRatio | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access and n_hex (pattern spans by kind), base_sha256 (their digest) and spans, all spans as kind:start:end."""
    model = model or MarkovRatio(labelled_samples())
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def scan(texts):
        rows = [all_spans(t or "", *shared.value) for t in texts]
        out = {f"n_{k}": [sum(s[2] == k for s in b) for b, _ in rows] for k in KINDS[:3]}
        return out | {"base_sha256": [hashlib.sha256(_told(b).encode()).hexdigest() for b, _ in rows], "spans": [_told(s) for _, s in rows]}

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return extend(slim, ["text"], scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", ["doc_id"])


def redact_secrets(docs: DataFrame, model: MarkovRatio | None = None, text_col: str = "text", mark: str = "[SECRET]", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark``; ``size_col``, if there, follows the changed texts."""
    model = model or MarkovRatio(labelled_samples())
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def hide(text):
        if not text:
            return None
        out, at = [], 0
        for a, b, _ in all_spans(text, *shared.value)[1]:
            if b > at:
                out += [text[at:a], mark] if a >= at else []
                at = b
        return "".join([*out, text[at:]]) if out else None

    # only the changed texts come back from Python; all columns else keep their values
    found = extend(docs, [text_col], lambda texts: {"__redacted": [hide(t) for t in texts]}, "__redacted string", docs.columns)
    changed = F.col("__redacted")
    new = {text_col: F.coalesce(changed, F.col(text_col))}
    if size_col in docs.columns:
        new[size_col] = F.when(changed.isNull(), F.col(size_col)).otherwise(F.length(changed)).cast(docs.schema[size_col].dataType)
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
