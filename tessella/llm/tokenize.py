"""Encoding of a corpus with a public byte-level BPE vocabulary, by recursive DuckDB queries per partition.

Each partition splits its texts into words once, keeps every distinct word once, and hands the words to an
in-memory DuckDB: token-position rows join the merge table, and in each round every word contracts its pair of
least rank (the leftmost one of a pair of equal tokens, all of another pair), until no word has a pair left. An
ordered aggregation turns the rows back into the words' ids. Words seen before are not encoded again.

A word longer than ``PIECE`` bytes is encoded in overlapping pieces by the same query. Two neighbours of a piece's
encoding stay neighbours in every text that has them side by side, and a sequence whose neighbours all belong
together is the encoding of the whole; so pieces are joined at a token that both hold at the same place, and where
they share none the next piece begins at a token's end. Time and memory grow in proportion to the word.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Place of the vocabulary file; a parameter of ``encode``, never part of the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: fixed value: the pattern that this vocabulary splits words with
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of one query (words, and rows of all its rounds) and of the word cache of a task; neither limits what is encoded.
WORDS_PER_QUERY, ROWS_PER_QUERY, CACHED_WORDS = 20_000, 4_000_000, 300_000
#: Words of more bytes are encoded in pieces of at most so many bytes.
PIECE = 320

_ROUND = """
WITH seen AS (
  SELECT step, w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM t
), ranked AS (
  SELECT s.*, m.rank, m.merged, min(m.rank * 4294967296 + s.pos) OVER (PARTITION BY s.w) AS least FROM seen s LEFT JOIN merges m ON m.lhs = s.tok AND m.rhs = s.nxt
), turns AS (
  SELECT *, coalesce(rank = least // 4294967296 AND (tok <> nxt OR pos = least % 4294967296), false) AS takes FROM ranked WHERE least IS NOT NULL
), gone AS (
  SELECT *, coalesce(lag(takes) OVER (PARTITION BY w ORDER BY pos), false) AS taken FROM turns
)
SELECT step + 1 AS step, w, pos, CASE WHEN takes THEN merged ELSE tok END AS tok FROM gone WHERE NOT taken
"""
_CONTRACT = f"""
WITH RECURSIVE t AS (
  SELECT 0 AS step, w, pos, tok FROM start
  UNION ALL
  SELECT * FROM ({_ROUND})
)
SELECT w, list(tok ORDER BY pos) AS ids, list(pos ORDER BY pos) AS places FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM t) WHERE step = last GROUP BY w
"""


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class WordEncoder:
    """Encodes words with the merges of a vocabulary file in a DuckDB of its own."""

    def __init__(self, vocabulary: str):
        import duckdb
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p.split(" ", 1) if isinstance(p, str) else p for p in model["merges"]]
        letters = _byte_letters()
        self.bytes_to_id = [vocab[letters[b]] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({
            "rank": pa.array(range(len(pairs)), pa.int64()), "lhs": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
            "rhs": pa.array([vocab[b] for _, b in pairs], pa.int32()), "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        })
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.known: dict[str, list[int]] = {}
        byte = {c: b for b, c in letters.items()}
        self.letters = pa.table({"tok": pa.array(list(vocab.values()), pa.int32()), "piece": list(vocab)})
        self.byte_of = byte
        #: bytes of every token as a set of bits, with the token's length
        self.made_of = [(sum(1 << b for b in {byte[c] for c in tok}), len(tok)) for tok in vocab if all(c in byte for c in tok)]

    def contract(self, words: list[bytes], places: bool = False) -> list:
        """The ids of each of ``words`` (at most ``PIECE`` bytes each), with ``places`` as (ids, places of the tokens' first bytes)."""
        import numpy as np

        out: list = [([], []) if places else []] * len(words)
        at, to_id = 0, np.array(self.bytes_to_id, np.int32)
        while at < len(words):
            first, rows, sizes = at, 0, []
            while at < len(words) and at - first < WORDS_PER_QUERY and rows < ROWS_PER_QUERY:
                sizes.append(len(words[at]))
                rows += len(words[at]) ** 2
                at += 1
            size = np.array(sizes, np.int32)
            ends = np.cumsum(size)
            start = pa.table({
                "w": np.repeat(np.arange(len(size), dtype=np.int32), size), "pos": (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int32),
                "tok": to_id[np.frombuffer(b"".join(words[first:at]), np.uint8)],
            })
            self.con.register("start", start)
            for w, ids, where in self.con.execute(_CONTRACT).fetchall():
                out[first + w] = (ids, where) if places else ids
            self.con.unregister("start")
        return out

    def learn(self, words: list[str]) -> None:
        """Adds the ids of ``words`` (distinct) to ``known``."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [k for k, r in enumerate(raw) if len(r) <= PIECE]
        for k, ids in zip(short, self.contract([raw[k] for k in short])):
            self.known[words[k]] = ids
        for k, r in enumerate(raw):
            if len(r) > PIECE:
                self.known[words[k]] = self.contract_long(r)

    def contract_long(self, raw: bytes) -> list[int]:
        """The ids of a word of any length, joined from the encodings of overlapping pieces.

        A piece is some times as long as the longest token that the word's bytes can make.
        """
        bits = sum(1 << b for b in set(raw))
        reach = max((n for made_of, n in self.made_of if not made_of & ~bits), default=1)
        size = min(PIECE, max(48, 4 * reach))
        stride = size - size // 3
        cut = [raw[a : a + size] for a in range(0, len(raw), stride)]
        distinct = list(dict.fromkeys(cut))
        pieces = dict(zip(distinct, self.contract(distinct, places=True)))
        out: list[int] = []
        base, (ids, where) = 0, pieces[cut[0]]  # the piece that is being read, and where it begins
        have, k = 0, 1  # tokens of it that are in ``out`` already; the next piece of the cut
        while base + size < len(raw):
            while k * stride <= base:
                k += 1
            mine = {(base + p, i): n for n, (p, i) in enumerate(zip(where, ids)) if n >= have - 1 and n + 1 < len(ids)}
            ahead = pieces[cut[k]] if k < len(cut) and k * stride < base + size else ([], [])
            shared = next((m for m, (p, i) in enumerate(zip(ahead[1], ahead[0])) if (k * stride + p, i) in mine), None)
            if shared is not None:  # both hold this token at this place: go on behind it in the next piece
                n = mine[k * stride + ahead[1][shared], ahead[0][shared]]
                out += ids[have : n + 1]
                base, (ids, where), have = k * stride, ahead, shared + 1
                continue
            for turn in range(len(ids) * 2 // 3, have, -1):  # begin a piece with a token of this one, so that both share it
                fresh = raw[base + where[turn] : base + where[turn] + size]
                if fresh not in pieces:
                    if len(pieces) > len(distinct) + 4096:
                        pieces = {c: pieces[c] for c in distinct}
                    pieces[fresh] = self.contract([fresh], places=True)[0]
                if pieces[fresh][0][0] == ids[turn]:
                    break
            else:
                return self._round_by_round(raw)
            out += ids[have : turn + 1]
            base, (ids, where), have = base + where[turn], pieces[fresh], 1
        return out + ids[have:]

    def _round_by_round(self, raw: bytes) -> list[int]:
        """The ids of a word whose pieces share no token: all of it in each round, and one round kept at a time."""
        self.con.register("start", pa.table({"pos": pa.array(range(len(raw)), pa.int64()), "tok": pa.array([self.bytes_to_id[b] for b in raw], pa.int32())}))
        self.con.execute("CREATE OR REPLACE TABLE t AS SELECT 0 AS step, 0 AS w, pos, tok FROM start")
        self.con.unregister("start")
        while True:
            self.con.execute(f"CREATE OR REPLACE TABLE later AS {_ROUND}")
            if not self.con.execute("SELECT count(*) FROM later").fetchone()[0]:
                return [i for (i,) in self.con.execute("SELECT tok FROM t ORDER BY pos").fetchall()]
            self.con.execute("DROP TABLE t; ALTER TABLE later RENAME TO t")

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        """The texts of lists of ids: an ordered aggregation of the tokens' letters, which stand for bytes."""
        import numpy as np

        size = np.array([len(x or ()) for x in ids], np.int64)
        flat = pa.array([i for x in ids for i in x or ()], pa.int32())
        start = pa.table({"w": pa.array(np.repeat(np.arange(len(ids)), size)), "pos": pa.array(np.arange(size.sum())), "tok": flat})
        self.con.register("start", start)
        self.con.register("letters", self.letters)
        out: list[str | None] = [None if x is None else "" for x in ids]
        byte = self.byte_of
        for w, text in self.con.execute("SELECT w, string_agg(piece, '' ORDER BY pos) FROM start JOIN letters USING (tok) GROUP BY w").fetchall():
            out[w] = bytes(byte[c] for c in text).decode("utf-8", "replace")
        self.con.unregister("start")
        self.con.unregister("letters")
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        fresh = dict.fromkeys(w for words in split for w in words)
        self.learn([w for w in fresh if w not in self.known])
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) for every document, without special tokens; their strings in a text are ordinary text.

    An empty and a null text have no ids: an empty list. Repeated rows are encoded each; texts of any length are
    encoded whole. There is no shuffle: a task encodes its own rows.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of every row of ids: the inverse of ``encode``. Null ids give a null text, an empty list an empty one."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        for batch in batches:
            texts: list[str | None] = []
            for a in range(0, batch.num_rows, 500):
                texts += encoder.decode(batch.column(1).slice(a, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
