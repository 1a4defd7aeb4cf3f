"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 6).

Each Arrow batch of a partition is split into words by the tokenizer's pattern; the words not met before become
token-position rows of a DuckDB table. A recursive query joins neighbouring rows with the merge table and contracts
the leftmost pairs of least rank of each word until no word has a pair left, then an ordered aggregation gives the
ids. Words are independent of their text, so nothing is shuffled and every text is encoded whole; words of any length
are encoded in pieces whose borders are then mended exactly, so memory does not grow with them.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the word pattern shared by the public byte-level BPE vocabularies.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one recursive query may come to hold, the longest piece of a word that it takes, and words kept by a worker.
ROWS_AT_ONCE, PIECE, WORDS_KEPT = 2_000_000, 64, 200_000

#: The query of one step: ``ready`` rows begin a pair of their word's least rank, ``ahead`` of them stand just before in
#: one run, of which every second one gives way to its left neighbour.
STEP = """
  SELECT word, pos, CASE WHEN ready AND ahead % 2 = 0 THEN made ELSE tok END AS tok, step + 1 AS step
  FROM (
    SELECT word, pos, tok, made, step, ready,
           seq - 1 - coalesce(max(CASE WHEN NOT ready THEN seq END) OVER (PARTITION BY word ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM (
      SELECT *, rank IS NOT NULL AND rank = best AS ready
      FROM (
        SELECT p.*, m.rank, m.made, min(m.rank) OVER (PARTITION BY p.word) AS best
        FROM (SELECT word, pos, tok, step, lead(tok) OVER w AS next, row_number() OVER w AS seq FROM {rows} WINDOW w AS (PARTITION BY word ORDER BY pos)) p
        LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next
      )
      WHERE best IS NOT NULL
    )
  )
  WHERE ahead % 2 = 0
"""

CONTRACT = f"""
WITH RECURSIVE t(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM symbols
  UNION ALL
  {STEP.format(rows="t")}
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM t) WHERE step = last
GROUP BY word ORDER BY word
"""

DECODE = "SELECT i.doc, string_agg(v.hex, '' ORDER BY i.pos) AS hex FROM ids i JOIN vocab v ON v.id = i.id GROUP BY i.doc"


@dataclass(frozen=True)
class ByteBpe:
    """A vocabulary of fixed size: the id of each single byte, the merges (left, right, rank, made) and each id's bytes."""

    byte_ids: np.ndarray
    merges: np.ndarray
    tokens: list[bytes]


def _printable_bytes() -> dict[str, int]:
    """The letters that stand for bytes in the JSON files: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_bpe(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> ByteBpe:
    """Read NAME.json (merges in order) or else NAME.tiktoken (every split of a token into two tokens is a merge)."""
    path = os.path.join(folder, f"{name}.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _printable_bytes(), model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)]
        byte_ids = [vocab[c] for c in sorted(letters, key=letters.get)]
    else:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            tokens[i] = word
        merges = [(ranks[w[:k]], ranks[w[k:]], i, i) for w, i in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        byte_ids = [ranks[bytes([b])] for b in range(256)]
    return ByteBpe(np.array(byte_ids, dtype=np.int32), np.array(merges, dtype=np.int32).reshape(-1, 4), tokens)


def _connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.execute("SET temp_directory = ''")  # batches are bounded, so nothing is spilled outside Spark
    return con


class _Encoder:
    """The state of one task: a DuckDB connection with the merge table, and the words met so far."""

    def __init__(self, bpe: ByteBpe):
        import regex

        self.words = regex.compile(WORDS)
        self.bytes = bpe.byte_ids
        self.con = _connect()
        l, r, rank, made = (pa.array(c) for c in bpe.merges.T)
        self.con.register("merge_rows", pa.table({"l": l, "r": r, "rank": rank, "made": made}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.tokens = bpe.tokens
        self.known: dict[str, list[int]] = {}

    def _symbols(self, words: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        return pa.table({"word": word, "pos": np.arange(len(flat), dtype=np.int32), "tok": flat})

    def _contract(self, words: list[bytes]) -> list[list[int]]:
        """The ids of short words by the recursive query, which keeps the rows of all steps until it ends."""
        out: list[list[int]] = []
        at, rows = 0, 0
        for i, w in enumerate([*words, None]):
            n = 0 if w is None else len(w) * (len(w) + 1) // 2
            if at < i and (w is None or rows + n > ROWS_AT_ONCE):
                self.con.register("symbols", self._symbols(words[at:i]))
                out += [row[1] for row in self.con.execute(CONTRACT).fetchall()]
                self.con.unregister("symbols")
                at, rows = i, 0
            rows += n
        return out

    def _contract_alone(self, word: bytes) -> list[int]:
        """The ids of one long word by the same step, a table each, of which only the last is kept."""
        self.con.register("symbols", self._symbols([word]))
        self.con.execute("CREATE OR REPLACE TABLE now AS SELECT word, pos, tok, 0 AS step FROM symbols")
        self.con.unregister("symbols")
        while True:
            self.con.execute(f"CREATE OR REPLACE TABLE later AS {STEP.format(rows='now')}")
            if not self.con.execute("SELECT count(*) FROM later").fetchone()[0]:
                return [r[0] for r in self.con.execute("SELECT tok FROM now ORDER BY pos").fetchall()]
            self.con.execute("DROP TABLE now")
            self.con.execute("ALTER TABLE later RENAME TO now")

    def _all(self, words: list[bytes]) -> dict[bytes, list[int]]:
        distinct = sorted(set(words))
        short = [w for w in distinct if len(w) <= 4 * PIECE]
        return dict(zip(short, self._contract(short))) | {w: self._contract_alone(w) for w in distinct if len(w) > 4 * PIECE}

    def _fits(self, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], bool]:
        """Whether two tokens in a row stay two tokens."""
        both = {p: self.tokens[p[0]] + self.tokens[p[1]] for p in set(pairs)}
        ids = self._all(list(both.values()))
        return {p: ids[w] == list(p) for p, w in both.items()}

    def _long(self, word: bytes) -> list[int]:
        """The ids of a word of any length, in pieces.

        A list of tokens is the encoding of its bytes exactly if any two neighbours are that of theirs: the first merge
        across a border would be made between the two alone as well. So pieces are encoded one by one, and at each
        border the tokens around it are encoded anew, twice as many each time, until their neighbours fit.
        """
        pieces = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
        ids = self._all(pieces)
        parts = [ids[p] for p in pieces]
        while len(parts) > 1:
            borders, size = list(range(0, len(parts) - 1, 2)), 4
            joined = dict.fromkeys(range(0, len(parts), 2), parts[-1])
            while borders:
                around = {j: (max(0, len(parts[j]) - size), min(size, len(parts[j + 1]))) for j in borders}
                bytes_of = {j: b"".join(self.tokens[i] for i in [*parts[j][a:], *parts[j + 1][:b]]) for j, (a, b) in around.items()}
                made = self._all(list(bytes_of.values()))
                ends = {j: [*zip(parts[j][a - 1 : a] if a else (), made[bytes_of[j]][:1]), *zip(made[bytes_of[j]][-1:], parts[j + 1][b : b + 1])] for j, (a, b) in around.items()}
                fits = self._fits([p for some in ends.values() for p in some])
                for j, (a, b) in around.items():
                    if all(fits[p] for p in ends[j]):
                        joined[j] = parts[j][:a] + made[bytes_of[j]] + parts[j + 1][b:]
                        borders.remove(j)
                size *= 2
            parts = [joined[j] for j in range(0, len(parts), 2)]
        return parts[0]

    def learn(self, words: set[str]) -> None:
        """Contract words not met before."""
        known = {w: w.encode("utf-8") for w in words}
        short = sorted(w for w, b in known.items() if len(b) <= PIECE)
        self.known.update(zip(short, self._contract([known[w] for w in short])))
        self.known.update((w, self._long(b)) for w, b in known.items() if len(b) > PIECE)

    def encode(self, texts: list[str | None]) -> Iterator[list[list[int]]]:
        """For each text the ids of its words."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        self.learn({w for words in split for w in words} - self.known.keys())
        known = self.known
        return ([known[w] for w in words] for words in split)


_encoders: dict[tuple[str, str], _Encoder] = {}


def _encoder(key: tuple[str, str], bpe: ByteBpe) -> _Encoder:
    """The encoder of this worker, kept for the partitions to come."""
    if key not in _encoders:
        _encoders[key] = _Encoder(bpe)
    return _encoders[key]


def _run_on_texts(df: DataFrame, text: str, out: StructField, tokenizer: str, folder: str, rows_at_once: int, result) -> DataFrame:
    """``df`` with ``text`` replaced by ``out``: what ``result`` makes of the ids of each text's words."""
    bpe = df.sparkSession.sparkContext.broadcast(load_bpe(tokenizer, folder))
    kept = [f for f in df.schema.fields if f.name not in (text, out.name)]
    schema, names = StructType([*kept, out]), [f.name for f in kept]
    kind = pa.list_(pa.int32()) if isinstance(out.dataType, ArrayType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                ids = _encoder((tokenizer, folder), bpe.value).encode(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([result(x) for x in ids], type=kind)], names=[*names, out.name])

    return df.select(*(F.col(f"`{n}`") for n in [*names, text])).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, rows_at_once: int = 1000) -> DataFrame:
    """``df`` without ``text`` and with the token ids of each text, without special tokens, in ``out``.

    Null and empty texts give an empty list. All other columns pass unchanged (one named like ``out`` is replaced),
    repeated rows stay repeated, and an empty table gives an empty one. The vocabulary, of fixed size, is read on
    the driver and sent to the tasks once.
    """
    return _run_on_texts(df, text, StructField(out, ArrayType(IntegerType()), False), tokenizer, folder, rows_at_once, lambda words: [i for ids in words for i in ids])


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, rows_at_once: int = 1000) -> DataFrame:
    """``df`` without ``text`` and with the number of its tokens in ``out``, 0 for null and empty texts; the cases of
    :func:`encode_corpus` hold."""
    return _run_on_texts(df, text, StructField(out, LongType(), False), tokenizer, folder, rows_at_once, lambda words: sum(map(len, words)))


def decode_corpus(df: DataFrame, ids: str = "ids", out: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` without ``ids`` and with the text they stand for in ``out``, by an ordered aggregation over positions.

    A null list gives null and an empty list an empty text. Bytes that are no UTF-8 become U+FFFD; an id outside the
    vocabulary raises an error.
    """
    bpe = df.sparkSession.sparkContext.broadcast(load_bpe(tokenizer, folder))
    kept = [f for f in df.schema.fields if f.name not in (ids, out)]
    schema = StructType([*kept, StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        con, n = None, 0
        for batch in batches:
            if con is None:
                con, n = _connect(), len(bpe.value.tokens)
                con.register("v", pa.table({"id": list(range(n)), "hex": [t.hex() for t in bpe.value.tokens]}))
                con.execute("CREATE TABLE vocab AS SELECT * FROM v")
            lists = [None if x is None else np.asarray(x, dtype=np.int64) for x in batch[ids]]
            sizes = [0 if x is None else len(x) for x in lists]
            flat = np.concatenate([x for x in lists if x is not None and len(x)] or [np.empty(0, np.int64)])
            if len(flat) and (flat.min() < 0 or flat.max() >= n):
                raise ValueError("an id is outside the vocabulary")
            con.register("ids", pa.table({"doc": np.repeat(np.arange(len(lists)), sizes), "pos": np.arange(len(flat)), "id": flat}))
            texts = {d: bytes.fromhex(h).decode("utf-8", "replace") for d, h in con.execute(DECODE).fetchall()}
            batch = batch[[f.name for f in kept]].copy()
            batch[out] = [None if x is None else texts.get(i, "") for i, x in enumerate(lists)]
            yield batch

    return df.mapInPandas(run, schema)
