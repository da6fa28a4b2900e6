"""BPE encoding and decoding by a contiguous rank array.

A short word keeps its parts and the merge rank of every adjacent pair in two contiguous
rows.  The encoder scans for the smallest rank (leftmost on ties), deletes that boundary and
refreshes the two neighbouring ranks, until no pair can merge.  Words of about one length lie
below each other in one array and take each step together.  Words longer than ``SHORT_WORD``
bytes, for which the repeated scan would be quadratic, merge in the same order through a heap.

Only distinct chunks of a group of texts reach the encoder (:mod:`.chunks`).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from beaconlake.llm.chunks import ChunkMemo

SHORT_WORD = 96
PIECE_ENTRIES = 200_000
NEVER = np.int32(2**31 - 1)
#: The pre-tokenizer pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder of one byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        ids = {raw(token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        merges = [(raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pair = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pair)
        self.pair_keys, self.pair_ranks = pair[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges] + [-1], dtype=np.int64)
        self.rank_of = dict(zip(pair.tolist(), range(len(merges))))
        self.find_pieces = regex.compile(PIECES).findall
        self.marks = {content[0] for content in self.special}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.memo = ChunkMemo(self.encode_strings)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of adjacent parts given by their ids; NEVER where no merge exists or a part is -1."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0), self.pair_ranks[at], NEVER)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of about one length: all words of the array take one merge each step.

        Row i holds the parts of word i (-1 behind the last) and the ranks of adjacent parts.
        """
        width = max(map(len, words))
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        parts = np.where(np.arange(width) < sizes[:, None], self.byte_ids[flat], -1)
        parts = np.concatenate((parts, np.full((len(words), 1), -1)), axis=1)
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        columns = np.arange(width + 1)
        live = np.arange(len(words))
        while True:
            at = ranks[live].argmin(axis=1)
            least = ranks[live, at]
            more = least < NEVER
            live, at, least = live[more], at[more], least[more]
            if not len(live):
                break
            shift = np.minimum(columns + (columns > at[:, None]), width)
            own = np.take_along_axis(parts[live], shift, axis=1)
            row = np.arange(len(live))
            own[row, at] = self.merged[least]
            near = np.take_along_axis(ranks[live], np.minimum(shift[:, :-1], width - 1), axis=1)
            near[:, -1] = NEVER
            near[row, at] = self.ranks(own[row, at], own[row, np.minimum(at + 1, width)])
            left = at > 0
            near[row[left], at[left] - 1] = self.ranks(own[row[left], at[left] - 1], own[row[left], at[left]])
            parts[live], ranks[live] = own, near
        ends = (parts >= 0).sum(axis=1)
        packed = parts.astype("<u4")
        return [packed[i, :n].tobytes() for i, n in enumerate(ends.tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """The same merges for one long word: the pairs wait in a heap ordered by rank, then place."""
        rank, n = self.rank_of.get, len(word)
        part, end, before, alive = self.byte_ids[list(word)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank(part[i] << 32 | part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or part[i] != a or j >= n or part[j] != b:
                continue
            part[i], end[i], alive[j] = int(self.merged[r]), end[j], False
            if end[i] < n:
                before[end[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([part[i] for i in range(n) if alive[i]], dtype="<u4").tobytes()

    def merge_all(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces of the pattern."""
        words = sorted(((p, p.encode("utf-8", "surrogatepass")) for p in pieces), key=lambda x: len(x[1]))
        out: dict[str, bytes] = {}
        at = 0
        while at < len(words):
            size = len(words[at][1])
            if size > SHORT_WORD:
                out[words[at][0]] = self.merge_long(words[at][1])
                at += 1
                continue
            to = at
            while to < len(words) and to - at < 8192 and len(words[to][1]) <= min(SHORT_WORD, size + size // 4):
                to += 1
            out |= zip((p for p, _ in words[at:to]), self.merge_short([w for _, w in words[at:to]]))
            at = to
        return out

    def encode_strings(self, texts: list[str]) -> list[bytes]:
        """Packed ids of strings, each on its own; special tokens in them become their ids."""
        cuts = []
        for text in texts:
            if any(m in text for m in self.marks) and any(s in text for s in self.special):
                cuts.append([p for t in self.cut_special(text) for p in ([t] if t in self.special else self.find_pieces(t))])
            else:
                cuts.append(self.find_pieces(text))
        wanted = {p for pieces in cuts for p in pieces}
        fresh = [p for p in wanted if p not in self.pieces]
        look = self.merge_all([p for p in fresh if p not in self.special])
        look |= {p: self.special[p].to_bytes(4, "little") for p in fresh if p in self.special}
        if len(self.pieces) < PIECE_ENTRIES:
            self.pieces |= {p: v for p, v in look.items() if len(p) <= 32}
        pieces = self.pieces
        return [b"".join([pieces[p] if p in pieces else look[p] for p in own]) for own in cuts]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null encodes as empty."""
        return next(self.memo.encode_all([text]))

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, RankArrayBPE] = {}


def load(path: str) -> RankArrayBPE:
    """The vocabulary at ``path``, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = RankArrayBPE(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, tokenizer_path: str, *, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the column ``ids``: packed little-endian unsigned 32-bit token ids of the whole text.

    All other columns are kept; a column already named ``ids`` is replaced.  Null and empty texts
    give an empty value.  One task holds one Arrow batch and a bounded memo.
    """
    return _map_column(docs, text, ids, "binary", lambda values: load(tokenizer_path).memo.encode_all(values))


def decode_ids(docs: DataFrame, tokenizer_path: str, *, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text`` decoded from packed ids; null ids decode to the empty text."""
    return _map_column(docs, ids, text, "string", lambda values: (load(tokenizer_path).decode(v or b"") for v in values))


def _map_column(docs: DataFrame, source: str, target: str, kind: str, work) -> DataFrame:
    kept = docs.drop(target)
    schema = kept.select("*").schema.add(target, kind)
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(list(work(batch.column(source).to_pylist())), type=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, target])

    if source == target:
        raise ValueError("source and target columns must differ")
    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """One row per document: key, the columns ``keep``, n_tokens, ids_sha256, decoded_sha256, round_trip.

    Encodes and decodes in the same task, so no text leaves it, and ids only ``with_ids`` (column
    token_ids).  ``round_trip`` says whether the decoded text equals the input (null counts as
    empty).  Rows that repeat a key each give a row; an empty table gives none.
    """
    few = docs.select(key, *keep, text)
    schema = few.select(key, *keep).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("round_trip", "boolean"), ("token_ids", "binary")):
        if with_ids or name != "token_ids":
            schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            n, sha_ids, sha_text, same, ids = [], [], [], [], []
            values = batch.column(batch.num_columns - 1).to_pylist()
            for value, packed in zip(values, bpe.memo.encode_all(values)):
                back = bpe.decode(packed)
                n.append(len(packed) // 4)
                sha_ids.append(hashlib.sha256(packed).hexdigest())
                sha_text.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == (value or ""))
                if with_ids:
                    ids.append(packed)
            made = [pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string()), pa.array(same, pa.bool_())]
            made += [pa.array(ids, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return few.mapInArrow(run, schema)
