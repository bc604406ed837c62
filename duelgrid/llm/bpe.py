"""Byte-level BPE by recursive queries, run by DuckDB inside each task.

A text is cut by the vocabulary's pattern into words. The distinct words a task has not met lately become rows (word,
position, token), at first one per byte. A recursive query joins neighbouring tokens with the merge table, finds the
pair of least rank in each word, contracts its leftmost occurrence, and goes on with the words that changed, until no
pair is left. A word that is itself a token is taken as it is, as the tiktoken library does.

A word of more than `LONG_BYTES` bytes is cut between bytes that stand side by side in no token, as no merge can cross
there; its pieces go through the same query. A piece still above `LONG_BYTES` does so in overlapping blocks. Tokens are a
piece's contraction if and only if every two neighbours are the contraction of their own bytes. So two overlapping
blocks join at any token that both hold at the same place: all neighbours then come from one block or the other. Blocks
without such a token (periods out of step, say) are contracted again from a token's start on, further back each time, at
last from the piece's start. Work grows with the length of the word, memory with `QUERY_WORDS` blocks.

Decoding joins ids with the vocabulary and strings the bytes together in order.

Spark deals out the texts; a task holds one piece of text of about `PIECE_BYTES`, the merge table and a bounded memory
of words. DuckDB runs in memory with one thread and a limit, and writes no files.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.arrow import Recent, pieces
from duelgrid.llm.packing import UNIT

PIECE_BYTES = 1 << 20
QUERY_WORDS = 10_000
QUERY_IDS = 400_000
LONG_BYTES = 256
BLOCK_BYTES, STRIDE_BYTES = 48, 32
BATCH_PIECES, WINDOW_BYTES = 100_000, 1 << 20
REMEMBERED_WORDS, REMEMBERED_UNITS = 600_000, 350_000  # twice as many at most
MEMORY = "200MB"

# A row's key is its word's number times 2^32 plus its place, so a neighbour is one key further.
CONTRACT = """
WITH RECURSIVE step AS (
  SELECT w::BIGINT * 4294967296 + pos AS key, tok, true AS live FROM start
  UNION ALL
  (WITH best AS (
     SELECT a.key >> 32 AS w, min(merges.merged::BIGINT * 4294967296 + (a.key & 4294967295)) AS found
     FROM step a JOIN step b ON b.key = a.key + 1 JOIN merges ON merges.pair = a.tok::BIGINT * 4294967296 + b.tok
     WHERE a.live AND b.live GROUP BY ALL
   )
   SELECT CASE WHEN (key & 4294967295) > (found & 4294967295) THEN key - 1 ELSE key END AS key,
     CASE WHEN (key & 4294967295) = (found & 4294967295) THEN (found >> 32)::INTEGER ELSE tok END AS tok, found IS NOT NULL AS live
   FROM step LEFT JOIN best ON step.key >> 32 = best.w
   WHERE step.live AND (found IS NULL OR (key & 4294967295) <> (found & 4294967295) + 1))
)
SELECT (key >> 32)::INTEGER AS w, list(tok ORDER BY key) AS ids FROM step WHERE NOT live GROUP BY ALL
"""

DECODE = "SELECT row, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (id) GROUP BY row"

_CODECS: dict[str, Codec] = {}


class Codec:
    """A rank file as DuckDB tables, and the words met lately."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        ranks = self.ranks
        halves = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(halves, np.int64).T
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._fill("merges", pa.table({"pair": (left << 32) + right, "merged": merged.astype(np.int32)}))
        self._fill("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.all_ids = np.array(list(ranks.values()), np.int32)
        self.adjacent = np.zeros((256, 256), bool)
        for t in ranks:
            self.adjacent[list(t[:-1]), list(t[1:])] = True
        self.sizes = {n: len(t) for t, n in ranks.items()}
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.words, self.units = Recent(REMEMBERED_WORDS), Recent(REMEMBERED_UNITS)

    def _fill(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        number = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pa.table({"w": number.astype(np.int32), "pos": place.astype(np.int32), "tok": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        found = self._ask(CONTRACT, "start", start)
        out = [b""] * len(words)
        lists = found.column("ids").combine_chunks()
        flat, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum(lists.value_lengths().to_numpy())
        for w, a, b in zip(found.column("w").to_pylist(), [0, *ends.tolist()], ends.tolist()):
            out[w] = flat[a:b].tobytes()
        return out

    def _joined(self, ids: array, end: int, block: array, start: int) -> int | None:
        """Go on from `ids`, which reach up to `end`, with a block from `start` on, at the last token of both.

        The new end, or None if they share no token.
        """
        places, at = {}, start
        for k, t in enumerate(block):
            places[at] = k
            at += self.sizes[t]
        for n in range(len(ids), 0, -1):
            if end <= start:
                break
            end -= self.sizes[ids[n - 1]]
            k = places.get(end)
            if k is not None and block[k] == ids[n - 1]:
                del ids[n:]
                ids.extend(block[k + 1 :])
                return at
        return None

    def _rejoined(self, raw: bytes, ids: array, end: int, stop: int, known: dict[bytes, array]) -> int:
        """Go on from `ids` up to `stop` by a block that begins where one of their tokens does."""
        least = BLOCK_BYTES
        while True:
            n, start = len(ids), end
            while n and end - start < least:
                n -= 1
                start -= self.sizes[ids[n]]
            part = raw[start:stop]
            if part not in known:
                known[part] = array("I", self._contracted([part])[0])
            if start == 0:
                ids[:] = known[part]
                return stop
            at = self._joined(ids, end, known[part], start)
            if at is not None:
                return at
            least *= 4

    def _in_blocks(self, words: list[bytes]) -> list[bytes]:
        ids, ends = [array("I") for _ in words], [0] * len(words)
        blocks = [(i, s) for i, w in enumerate(words) for s in range(0, max(1, len(w) - BLOCK_BYTES + STRIDE_BYTES), STRIDE_BYTES)]
        for first in range(0, len(blocks), QUERY_WORDS):
            batch = blocks[first : first + QUERY_WORDS]
            parts = list({words[i][s : s + BLOCK_BYTES] for i, s in batch})
            known = {p: array("I", x) for p, x in zip(parts, self._contracted(parts))}
            for i, s in batch:
                raw, stop = words[i], min(s + BLOCK_BYTES, len(words[i]))
                block = known[raw[s:stop]]
                if s == 0:
                    ids[i].extend(block)
                    ends[i] = stop
                else:
                    end = self._joined(ids[i], ends[i], block, s)
                    ends[i] = self._rejoined(raw, ids[i], ends[i], stop, known) if end is None else end
        return [np.array(x, "<u4").tobytes() for x in ids]

    def _pieces(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(word number, piece) between bytes that no token holds side by side."""
        for i, raw in enumerate(words):
            codes, begin = np.frombuffer(raw, np.uint8), 0
            for at in range(0, len(raw), WINDOW_BYTES):
                window = codes[at : at + WINDOW_BYTES + 1]
                for cut in (np.flatnonzero(~self.adjacent[window[:-1], window[1:]]) + at + 1).tolist():
                    yield i, raw[begin:cut]
                    begin = cut
            yield i, raw[begin:]

    def _contracted_long(self, words: list[bytes]) -> list[bytes]:
        out, pieces_left = [bytearray() for _ in words], self._pieces(words)
        while batch := list(islice(pieces_left, BATCH_PIECES)):
            distinct = {p for _, p in batch}
            short, long = [p for p in distinct if len(p) <= LONG_BYTES], [p for p in distinct if len(p) > LONG_BYTES]
            known = dict(zip(long, self._in_blocks(long)))
            for k in range(0, len(short), QUERY_WORDS):
                part = short[k : k + QUERY_WORDS]
                known.update(zip(part, self._contracted(part)))
            for i, p in batch:
                out[i] += known[p]
        return [bytes(x) for x in out]

    def _encode_words(self, words: list[str]) -> None:
        short, long = [], []
        for w in words:
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.words.young[w] = np.array([rank], "<u4").tobytes()
            else:
                (short if len(raw) <= LONG_BYTES else long).append((w, raw))
        for i in range(0, len(short), QUERY_WORDS):
            part = short[i : i + QUERY_WORDS]
            self.words.young.update(zip([w for w, _ in part], self._contracted([raw for _, raw in part])))
        self.words.young.update(zip([w for w, _ in long], self._contracted_long([raw for _, raw in long])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [UNIT.findall(t) for t in texts]
        fresh = self.units.missing(set().union(*cut))
        split = [self.cut(u) for u in fresh]
        self._encode_words(self.words.missing(set().union(*split)))
        known, words = self.units.young, self.words.young
        known.update(zip(fresh, [b"".join([words[w] for w in s]) for s in split]))
        return [b"".join([known[u] for u in units]) for units in cut]

    def _strung(self, ids: list[bytes]) -> list[bytes]:
        numbers = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if len(numbers) and not np.isin(numbers, self.all_ids).all():
            raise ValueError("an id is not in the vocabulary")
        row = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids]).astype(np.int32)
        table = pa.table({"row": row, "pos": np.arange(len(row), dtype=np.int32), "id": numbers})
        found = self._ask(DECODE, "ids", table)
        out = [b""] * len(ids)
        for i, text in zip(found.column("row").to_pylist(), found.column("hex").to_pylist()):
            out[i] = bytes.fromhex(text)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids; an id outside the vocabulary raises. Long lists go through in parts."""
        size = 4 * QUERY_IDS
        parts = [(i, x[k : k + size]) for i, x in enumerate(ids) for k in range(0, len(x), size)]
        out: list[list[bytes]] = [[] for _ in ids]
        group, held = [], 0
        for n, (i, part) in enumerate(parts):
            group.append((i, part))
            held += len(part)
            if held >= size or n == len(parts) - 1:
                for (row, _), text in zip(group, self._strung([p for _, p in group])):
                    out[row].append(text)
                group, held = [], 0
        return [b"".join(x) for x in out]


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _default(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(docs: DataFrame, path: str | None = None, back: bool = False) -> DataFrame:
    """doc_id and `ids` of every whole text, as the binary of little-endian unsigned 32-bit numbers.

    With `back`, also `decoded`, the bytes that the ids give. A null or empty text has no ids. No special tokens are
    read in a text. Repeated rows give repeated rows; other columns are not looked at; an empty table gives an empty
    one. One pass over the scan, no shuffle.
    """
    file = _default(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(file)
        for piece in pieces(batches, limit=PIECE_BYTES):
            ids = coder.encode([t or "" for t in piece.column("text").to_pylist()])
            columns = {"doc_id": piece.column("doc_id"), "ids": pa.array(ids, pa.binary())}
            if back:
                columns["decoded"] = pa.array(coder.decode(ids), pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded binary" * back)


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of its `ids` (null or empty: none)."""
    file = _default(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "ids", PIECE_BYTES):
            texts = codec(file).decode([x or b"" for x in piece.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes decoded from them."""
    both = encoded(docs, path, back=True)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
