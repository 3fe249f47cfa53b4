"""Operator 7: URL rules as globs, matched by a bit-parallel Shift-And automaton.

Every glob is compiled into one row of bits, all rows are packed into 64-bit
words, and one pass over the bytes of a URL simulates all globs at once: shift
the state by one bit, add the start bits, keep the bits whose position accepts
the byte, keep the bits that wait at a star. A batch of URLs advances together,
byte position by byte position.

The canonical URL is ``.`` + host + 0xFF + path (0xFF never occurs in UTF-8), so
a rule for host h and path p is the glob ``*.h<FF>p*``: the host itself and all
subdomains, and paths that start with p.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

EDGE = b"\xff"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: globs over host + path for URLs that no rule fits: these are blocked, all others allowed
JUNK_GLOBS = ("*cheap-pills*", "*casino*", "*porn*", "*xxx*", "*viagra*", "*free-money*")


def rule_glob(host: str, path: str) -> bytes:
    return b"*." + host.encode() + EDGE + path.encode() + b"*"


class Globs:
    """Globs (bytes; ``*`` any run of bytes, ``?`` any byte) as Shift-And masks over ``words`` 64-bit words."""

    def __init__(self, globs: list[bytes]):
        spans, bits = [], 0
        for g in globs:
            spans.append(bits)
            bits += len(g.replace(b"*", b"")) + 1  # one bit before the first byte and one after each
        self.n = len(globs)
        self.words = max(1, -(-bits // 64))
        self.accept = np.zeros((256, self.words), dtype=np.uint64)  # bits entered on a byte
        self.start, self.stay = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.ends = []
        for first, g in zip(spans, globs):
            at = first
            self._set(self.start, at)
            for c in g:
                if c == 0x2A:
                    self._set(self.stay, at)
                    continue
                at += 1
                for byte in range(256) if c == 0x3F else (c,):
                    self._set(self.accept[byte], at)
            self.ends.append((at // 64, np.uint64(at % 64)))

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """[texts, globs]: whether the whole text fits the glob."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offset = np.cumsum(sizes) - sizes
        state = np.tile(self.start, (len(texts), 1))
        live_at = sizes[order]
        for pos in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-live_at, -pos, side="left"))  # texts longer than pos
            rows = order[:n]
            d = state[rows]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[rows] = (moved & self.accept[data[offset[rows] + pos]]) | (d & self.stay)
        out = np.zeros((len(texts), self.n), dtype=bool)
        for k, (word, bit) in enumerate(self.ends):
            out[:, k] = (state[:, word] >> bit) & np.uint64(1) == 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = rest[:stop].translate(_LOWER)
    tail = rest[stop:]
    end = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host, tail[:end]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge_urls(pages: DataFrame, rules: tuple = RULES, junk: tuple = JUNK_GLOBS) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest fitting rule (host + path; the first of equals) gives the
    verdict; without one, rule is null and the URL is blocked if a junk glob
    fits host + path, else allowed. A null url or one without ``://`` has an
    empty host and path, fits no rule and is allowed. Columns of these names
    are replaced; every row and other column stays.
    """
    plain = pages.drop("host", "path", "rule", "verdict")
    n = len(plain.columns)
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    globs = Globs([rule_glob(h, p) for h, p, _ in ranked] + [g.encode() for g in junk])
    names = [h + p for h, p, _ in ranked] + [None]
    verdicts = [v for _, _, v in ranked]
    schema = StructType([*plain.schema.fields, *[StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(n).to_pylist()]
            fits = globs.match([b"." + h.encode() + EDGE + p.encode() for h, p in parts])
            by_rule = fits[:, : len(ranked)]
            which = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), len(ranked)) if len(ranked) else np.zeros(len(parts), np.int64)
            bad = fits[:, len(ranked) :].any(axis=1)
            verdict = [verdicts[k] if k < len(ranked) else "block" if b else "allow" for k, b in zip(which, bad)]
            cols = [[h for h, _ in parts], [p for _, p in parts], [names[k] for k in which], verdict]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *[pa.array(c, pa.string()) for c in cols]],
                names=[*batch.schema.names[:n], "host", "path", "rule", "verdict"],
            )

    return plain.select(*plain.columns, F.col("url").cast("string").alias("__url")).mapInArrow(rows, schema)
