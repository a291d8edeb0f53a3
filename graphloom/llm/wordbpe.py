"""Byte-level BPE of words inside one Python worker, merged by DuckDB.

A word is a match of the tokenizer's split pattern. Its tokens come from a DuckDB
recursive query over token-position rows: every round joins neighbouring tokens
with the merge table, contracts the leftmost pair of least rank in each word, and
drops words without a pair left; ordered aggregation gives back the sequences.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex

#: White space as the split pattern sees it in ASCII text.
_SPACE = r" \t\n\r\x0b\x0c"
_ASCII = re.compile(rf" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}A-Za-z0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PARTS = re.compile(r" ?[A-Z]?[a-z]+| ?[A-Z]+(?![a-z])")
#: Scripts of three-byte letters, which mostly write no blanks: each letter is a part.
_LETTERS = re.compile(r" ?[\u0800-\U0010ffff]")

_MERGE = """
WITH RECURSIVE s(step, wid, pos, tok, live) AS (
  SELECT 0, wid, pos, tok, true FROM fresh
  UNION ALL
  SELECT step, wid, pos, CASE WHEN pos = spot THEN made ELSE tok END AS tok, spot IS NOT NULL AS live
  FROM (
    SELECT p.step + 1 AS step, p.wid, p.pos, p.tok, p.before, m.made,
      min(CASE WHEN m.rank IS NOT NULL THEN m.rank * 4294967296 + p.pos END) OVER (PARTITION BY p.wid) % 4294967296 AS spot
    FROM (SELECT step, wid, pos, tok, lead(tok) OVER w AS nxt, lag(pos) OVER w AS before FROM s WHERE live WINDOW w AS (PARTITION BY wid ORDER BY pos)) p
    LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt) q
  WHERE spot IS NULL OR before IS DISTINCT FROM spot
)
SELECT wid, list(tok ORDER BY pos) FROM s WHERE NOT live GROUP BY wid
"""

#: The same for long words: a merge never makes a pair of lesser rank, so the occurrences of
#: the least pair follow each other from the left, and one round contracts them all. Only
#: pairs of equal tokens overlap; of such a run every second place counts.
_MERGE_RUNS = """
WITH RECURSIVE s(step, wid, pos, tok, live) AS (
  SELECT 0, wid, pos, tok, true FROM fresh
  UNION ALL
  SELECT step, wid, pos, CASE WHEN hit THEN made ELSE tok END AS tok, best IS NOT NULL AS live
  FROM (
    SELECT *, lag(hit) OVER (PARTITION BY wid ORDER BY pos) AS gone
    FROM (
      SELECT *, rank IS NOT NULL AND rank = best AND (n - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN n END) OVER (PARTITION BY wid ORDER BY pos), 0)) % 2 = 1 AS hit
      FROM (
        SELECT p.step + 1 AS step, p.wid, p.pos, p.tok, p.n, m.made, m.rank, min(m.rank) OVER (PARTITION BY p.wid) AS best
        FROM (SELECT step, wid, pos, tok, lead(tok) OVER w AS nxt, row_number() OVER w AS n FROM s WHERE live WINDOW w AS (PARTITION BY wid ORDER BY pos)) p
        LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt) q) h) g
  WHERE best IS NULL OR gone IS DISTINCT FROM true
)
SELECT wid, list(tok ORDER BY pos) FROM s WHERE NOT live GROUP BY wid
"""


def split_words(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _ANY).findall(text)


def _bytes_of_symbols() -> dict[str, int]:
    """The printable symbols that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes words of one vocabulary file, keeping what it has encoded.

    The cache holds at most ``keep`` words and is emptied when full; that bounds
    memory and changes no result. Long and compound words, and words of scripts
    without blanks, are put together from encoded parts: a sequence of tokens is the
    encoding of a word exactly if no neighbouring two of them would have merged
    otherwise. Where a seam does not hold, the tokens around it are encoded again by
    the same query, the seams of all words of a batch at once.
    """

    def __init__(self, vocabulary: str, keep: int = 400_000, chunk: int = 8_000, longest: int = 32) -> None:
        model = json.load(open(vocabulary))["model"]
        ids, byte = model["vocab"], _bytes_of_symbols()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.keep, self.chunk, self.longest = keep, chunk, longest
        self.ids: dict[str, tuple[int, ...]] = {}
        self._parts: dict[str, tuple[int, ...]] = {}
        self._around: dict[bytes, tuple[int, ...]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._byte_ids = np.zeros(256, np.int32)
        for symbol, b in byte.items():
            self._byte_ids[b] = ids[symbol]
        self.token_bytes = {i: bytes(byte[c] for c in t) for t, i in ids.items() if all(c in byte for c in t)}
        left, right, made = (np.array([ids[f(p)] for p in pairs], np.int32) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        rank = np.arange(len(pairs), dtype=np.int64)
        self._rank = {(a, b): i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
        self._halves = {m: (a, b, i) for i, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        self._decodes = False
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._db.register("given", pa.table({"l": left, "r": right, "made": made, "rank": rank}))
        self._db.execute("CREATE TABLE merges AS SELECT * FROM given")

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """The tokens of each word, by the recursive query over the whole word."""
        return self.contract([w.encode("utf-8", "surrogatepass") for w in words])

    def pieces(self, word: str) -> list[str]:
        """The parts a word is put together from, itself if it is short and simple."""
        ascii_only = word.isascii()
        if ascii_only and not word[-1:].isalpha():  # digits and signs have no parts
            parts = [word]
        else:
            parts = (_PARTS if ascii_only else _LETTERS).findall(word)
            if sum(map(len, parts)) != len(word):
                parts = [word]
        if len(word) <= (self.longest if ascii_only else self.longest // 4):  # so many bytes at most
            return parts
        step = self.longest // 2 if ascii_only else self.longest // 8
        out = []
        for p in parts:
            out += [p] if len(p) <= 2 * step else [p[at : at + step] for at in range(0, len(p), step)]
        return out

    def _known(self, parts: Iterable[str]) -> None:
        """Makes ``_parts`` hold the tokens of all the given parts."""
        ask = list({p for p in parts if p not in self._parts})
        self._parts.update(zip(ask, self.contract([p.encode("utf-8", "surrogatepass") for p in ask])))

    def assemble(self, rows: list[list[tuple[int, ...]]]) -> list[tuple[int, ...]]:
        """The tokens of each row's bytes, from the encodings of its consecutive pieces.

        Neighbouring pieces are joined two by two, level by level, in all rows at
        once. A seam holds if the two tokens at it stay apart. Else the last k tokens
        before it and the first k after it are encoded again as one word, for all
        open seams of the level in one query; k doubles until the seams around hold.
        """
        rows = [list(r) for r in rows]
        while any(len(r) > 1 for r in rows):
            seams = [(n, i) for n, r in enumerate(rows) for i in range(0, len(r) - 1, 2)]
            joined: dict[tuple[int, int], tuple[int, ...]] = {}
            k = 0
            while seams:
                left = []
                for n, i in seams:
                    x, y = rows[n][i], rows[n][i + 1]
                    if not x or not y:
                        joined[n, i] = x + y
                    elif k == 0 and self._stay_apart(x[-1], y[0]):
                        joined[n, i] = x + y
                    else:
                        left.append((n, i))
                k = k * 2 if k else 4
                of = self.token_bytes
                raw = [b"".join(of[t] for t in (*rows[n][i][-k:], *rows[n][i + 1][:k])) for n, i in left]
                seams = []
                for (n, i), middle in zip(left, self._windows(raw)):
                    x, y = rows[n][i], rows[n][i + 1]
                    before, after = x[:-k], y[k:]
                    if (not before or self._stay_apart(before[-1], middle[0])) and (not after or self._stay_apart(middle[-1], after[0])):
                        joined[n, i] = before + middle + after
                    else:
                        seams.append((n, i))
            rows = [[joined[n, i] if (n, i) in joined else r[i] for i in range(0, len(r), 2)] for n, r in enumerate(rows)]
        return [r[0] if r else () for r in rows]

    def _windows(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of the bytes around seams; of short ones they are kept."""
        ask = list({r for r in raw if r not in self._around})
        if len(self._around) + len(ask) > self.keep:
            self._around.clear()
            ask = list(set(raw))
        found = dict(zip(ask, self.contract(ask)))
        out = [found[r] if r in found else self._around[r] for r in raw]
        self._around.update((r, t) for r, t in found.items() if len(r) <= 64)
        return out

    def contract(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each byte string by the recursive query."""
        words = raw
        out: list[tuple[int, ...]] = [()] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of one length need about as many rounds
        ends = np.cumsum([len(words[i]) for i in order])
        at = 0
        while at < len(order):
            # every round of a query costs the same besides its rows, so a query takes many words; long ones by their bytes
            most = (int(ends[at - 1]) if at else 0) + self.chunk * self.longest
            until = max(at + 1, min(at + self.chunk, int(np.searchsorted(ends, most, "right"))))
            some, at = order[at:until], until
            raw = [words[i] for i in some]
            sizes = np.array([len(r) for r in raw])
            wid = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            pos = np.arange(len(wid), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            fresh = pa.table({"wid": wid, "pos": pos, "tok": self._byte_ids[np.frombuffer(b"".join(raw), np.uint8)]})
            self._db.register("fresh", fresh)
            for w, tokens in self._db.execute(_MERGE if sizes[-1] <= 64 else _MERGE_RUNS).fetchall():
                out[some[w]] = tuple(tokens)
            self._db.unregister("fresh")
        return out

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two tokens.

        Undoes the later of the two last merges at the seam, step by step; if two
        tokens met at the seam whose merge ranks before the one undone, it would
        have come first.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, fits, never = left, right, float("inf"), True, (-1, -1, -1)
        while True:
            if self._rank.get((a, b), float("inf")) < limit:
                fits = False
                break
            ha, hb = self._halves.get(a, never), self._halves.get(b, never)
            if ha[2] < 0 and hb[2] < 0:
                break
            # equal ranks mean the same pair twice; of these the left one merged first
            if ha[2] > hb[2]:
                a, limit = ha[1], ha[2]
            else:
                b, limit = hb[0], hb[2] + 0.5
        if len(self._fits) >= self.keep:
            self._fits.clear()
        self._fits[left, right] = fits
        return fits

    def learn(self, words: set[str]) -> None:
        """Makes ``ids`` hold all the given words."""
        new = [w for w in words if w not in self.ids]
        if not new:
            return
        if len(self.ids) + len(new) > self.keep:
            self.ids.clear()
            new = list(words)
        if len(self._parts) > self.keep:
            self._parts.clear()
        split = [self.pieces(w) for w in new]
        self._known(chain.from_iterable(split))
        known, fits, apart = self._parts, self._fits, self._stay_apart
        ids, open_words, rows = self.ids, [], []
        for w, parts in zip(new, split):
            if len(parts) == 1:
                ids[w] = known[parts[0]]
                continue
            row = [known[p] for p in parts]
            if all([fits[s] if (s := (x[-1], y[0])) in fits else apart(*s) for x, y in zip(row, row[1:])]):
                ids[w] = tuple(chain.from_iterable(row))
            else:
                open_words.append(w)
                rows.append(row)
        ids.update(zip(open_words, self.assemble(rows)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for null and empty ones."""
        words = [split_words(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(words)))
        ids = self.ids
        return [list(chain.from_iterable([ids[w] for w in ws])) for ws in words]

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        words = [split_words(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(words)))
        ids = self.ids
        some = [list(chain.from_iterable([ids[w] for w in ws])) for ws in words]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum([len(x) for x in some], out=offsets[1:])
        return np.fromiter(chain.from_iterable(some), np.int32, int(offsets[-1])), offsets

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        words = [split_words(t) if t else [] for t in texts]
        distinct = set(chain.from_iterable(words))
        self.learn(distinct)
        ids = self.ids
        size_of = {w: len(ids[w]) for w in distinct}.__getitem__
        return [sum(map(size_of, ws)) for ws in words]

    def decode(self, rows: list[list[int] | None]) -> list[str]:
        """The texts of id lists."""
        sizes = np.array([len(r or ()) for r in rows], np.int64)
        return self.decode_flat(sizes, np.fromiter(chain.from_iterable(r or () for r in rows), np.int32, int(sizes.sum())))

    def decode_flat(self, sizes: np.ndarray, tok: np.ndarray) -> list[str]:
        """The texts of id lists laid end to end, put together by an ordered aggregation."""
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if not self._decodes:  # each byte as the character of its number, so that pieces join as text
            self._db.register("given", pa.table({"tok": pa.array(list(self.token_bytes), pa.int32()), "raw": pa.array([v.decode("latin-1") for v in self.token_bytes.values()])}))
            self._db.execute("CREATE TABLE known AS SELECT * FROM given")
            self._decodes = True
        self._db.register("coded", pa.table({"doc": doc, "pos": np.arange(len(tok), dtype=np.int64), "tok": tok}))
        found = dict(self._db.execute("SELECT doc, string_agg(raw, '' ORDER BY pos) FROM coded JOIN known USING (tok) GROUP BY doc").fetchall())
        self._db.unregister("coded")
        return [found.get(i, "").encode("latin-1").decode("utf-8", "replace") for i in range(len(sizes))]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]
