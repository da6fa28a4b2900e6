"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes, a space and the text, into tokens.  For each of them an array
names the token that owns every byte (``np.repeat`` of the token numbers by their lengths).  Where
the pair of owners changes, a new pair of overlapping tokens begins: a link.  Where both change at
once, both tokenizers cut, and a group of tokens ends.

How often ids are linked in the whole corpus is counted by blocks of documents, each of which
knows its different id pairs; only those, and never single links, are joined with the totals.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from beaconlake.llm.bpe import RankArrayBPE
from beaconlake.llm.chunks import ChunkMemo
from beaconlake.llm.scratch import Scratch

#: Bytes of text whose owner arrays stand in memory at once.
SLICE_BYTES = 1 << 20
#: A longer text is aligned in parts of about so many characters, cut where both tokenizers cut.
PART_CHARS = 1 << 20
#: Links after which a block of documents ends.
BLOCK_LINKS = 1 << 21
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class _Vocabulary:
    """Bytes of the tokens of one tokenizer, and an encoder for texts that begin with the space."""

    def __init__(self, encoder: ChunkMemo, tokens: list[bytes]):
        self.encoder = encoder
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decimals(self, end: bytes) -> np.ndarray:
        """At 2 * id the id as a decimal with a comma, at 2 * id + 1 with ``end``."""
        return np.array([b"%d%s" % (i, mark) for i in range(len(self.size)) for mark in (b",", end)], dtype=object)

    @classmethod
    def byte_level(cls, path: str) -> _Vocabulary:
        bpe = RankArrayBPE(path)
        bpe.special, bpe.marks = {}, set()  # their strings are plain text here
        return cls(bpe.memo, [bpe.tokens.get(i, b"") for i in range(max(bpe.tokens) + 1)])

    @classmethod
    def pieces(cls, path: str) -> _Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        # Texts are cut at single spaces: no piece may reach over such a cut.
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError(f"{path}: a piece reaches over a space")
        tokens = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]
        # The tokenizer itself adds the space that every chunk begins with.
        encode = lambda chunks: [np.array(ids, "<u4").tobytes() for ids in model.encode([c[1:] for c in chunks])]
        return cls(ChunkMemo(encode), tokens)

    def joined(self, ids: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The bytes of the tokens in a row; ``begin``: byte at which each begins."""
        return self.flat[(self.start[ids] - begin)[owner] + np.arange(len(owner))]


class Aligned:
    """The tokens, links and groups of several texts, in flat arrays with offsets by text."""

    def __init__(self, texts: list[str], ids_a: list[bytes], ids_b: list[bytes], va: _Vocabulary, vb: _Vocabulary):
        source = [t.encode("utf-8", "surrogatepass") for t in texts]
        while True:
            lengths = np.array([len(s) for s in source], dtype=np.int64)
            self.doc_at = np.concatenate(([0], np.cumsum(lengths)))
            self.a, self.a_at, begin_a, size_a = self._tokens(ids_a, va)
            self.b, self.b_at, begin_b, size_b = self._tokens(ids_b, vb)
            bad = (size_a != lengths) | (size_b != lengths)
            if not bad.any():
                owner_a = np.repeat(np.arange(len(self.a)), va.size[self.a])
                owner_b = np.repeat(np.arange(len(self.b)), vb.size[self.b])
                buf = np.frombuffer(b"".join(source), dtype=np.uint8)
                differs = (va.joined(self.a, owner_a, begin_a) != buf) | (vb.joined(self.b, owner_b, begin_b) != buf)
                if not differs.any():
                    break
                bad = np.diff(np.concatenate(([0], np.cumsum(differs)))[self.doc_at]) > 0
            for i in np.flatnonzero(bad):  # such a text has no tokens
                source[i] = ids_a[i] = ids_b[i] = b""
        turn_a, turn_b = self._turns(owner_a), self._turns(owner_b)
        starts = np.flatnonzero(turn_a | turn_b)
        self.link_a, self.link_b = self.a[owner_a[starts]], self.b[owner_b[starts]]
        self.link_at = np.searchsorted(starts, self.doc_at)
        cuts = np.concatenate(([0], np.cumsum(turn_a & turn_b)))
        self.group_at = cuts[self.doc_at]
        self.group_a, self.group_b = cuts[begin_a + 1] - 1, cuts[begin_b + 1] - 1
        self.whole = lengths > 0

    @staticmethod
    def _tokens(packed: list[bytes], v: _Vocabulary):
        """Ids, their offsets by text, the byte at which each begins, and the bytes of each text."""
        ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
        at = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)))
        ends = np.concatenate(([0], np.cumsum(v.size[ids])))
        return ids, at, ends[:-1], np.diff(ends[at])

    @staticmethod
    def _turns(owner: np.ndarray) -> np.ndarray:
        out = np.ones(len(owner), dtype=bool)
        out[1:] = owner[1:] != owner[:-1]
        return out

    def written(self, words_a: np.ndarray, words_b: np.ndarray) -> Iterator[bytes]:
        """Of each text its groups: ids of A, a bar, ids of B, groups parted by semicolons; from the decimals of ids."""
        n_a, n_b = len(self.a), len(self.b)
        word = np.empty(n_a + n_b, dtype=object)
        word[np.arange(n_a) + np.searchsorted(self.group_b, self.group_a)] = words_a[2 * self.a + self._last(self.group_a)]
        word[np.arange(n_b) + np.searchsorted(self.group_a, self.group_b, "right")] = words_b[2 * self.b + self._last(self.group_b)]
        word, at = word.tolist(), (self.a_at + self.b_at).tolist()
        for i in range(len(at) - 1):
            yield b"".join(word[at[i] : at[i + 1]])[:-1]

    @staticmethod
    def _last(group: np.ndarray) -> np.ndarray:
        """Whether each token is the last of its group."""
        last = np.ones(len(group), dtype=bool)
        last[:-1] = group[1:] != group[:-1]
        return last


class Aligner:
    """Two vocabularies and the alignment of texts by them."""

    def __init__(self, path_a: str, path_b: str):
        self.va, self.vb = _Vocabulary.byte_level(path_a), _Vocabulary.pieces(path_b)
        self.words = self.va.decimals(b"|"), self.vb.decimals(b";")

    def slices(self, texts: list[str | None]) -> Iterator[tuple[list[int], Aligned]]:
        """Texts, each with the space before it, aligned together up to SLICE_BYTES; with the number of the text each part is of."""
        owner: list[int] = []
        parts: list[str] = []
        held = 0
        for i, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                owner.append(i)
                parts.append(part)
                held += len(part)
                if held >= SLICE_BYTES:
                    yield owner, self._align(parts)
                    owner, parts, held = [], [], 0
        if parts:
            yield owner, self._align(parts)

    def _align(self, parts: list[str]) -> Aligned:
        return Aligned(parts, list(self.va.encoder.encode_all(parts)), list(self.vb.encoder.encode_all(parts)), self.va, self.vb)

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """The text behind a space, cut before spaces between letters or digits, where tokens of both begin."""
        text, at = " " + text, 0
        while len(text) - at > 2 * PART_CHARS and (m := _CUT.search(text, at + PART_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


_loaded: dict[tuple[str, str], Aligner] = {}


def load(path_a: str, path_b: str) -> Aligner:
    """The aligner of two vocabulary files, made once per Python worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


class _Text:
    """What the parts of one text add up to."""

    def __init__(self):
        self.counts = np.zeros(4, dtype=np.int64)
        self.sha = hashlib.sha256()
        self.groups: list[bytes] = []
        self.whole = True


def _read(aligner: Aligner, texts: list[str | None], keep_groups: bool = False) -> Iterator[tuple[int, _Text | None, np.ndarray]]:
    """(number of the text, its totals, its links as id of A << 32 | id of B) of each text, in order; None without tokens."""
    at, now, links = -1, None, []
    none = np.zeros(0, np.int64)

    def ended():
        if now is not None and now.whole:
            return at, now, np.concatenate(links)
        return at, None, none

    for owner, made in aligner.slices(texts):
        pair = (made.link_a << 32) | made.link_b
        sums = np.stack([np.diff(x) for x in (made.a_at, made.b_at, made.group_at, made.link_at)], axis=1)
        for k, (i, written) in enumerate(zip(owner, made.written(*aligner.words))):
            if i != at:
                if at >= 0:
                    yield ended()
                yield from ((j, None, none) for j in range(at + 1, i))
                at, now, links = i, _Text(), []
            elif now.whole:
                now.sha.update(b";")
            now.whole &= bool(made.whole[k])
            now.counts += sums[k]
            now.sha.update(written)
            if keep_groups:
                now.groups.append(written)
            links.append(pair[made.link_at[k] : made.link_at[k + 1]])
    if at >= 0:
        yield ended()
    yield from ((j, None, none) for j in range(at + 1, len(texts)))


def token_groups(docs: DataFrame, path_a: str, path_b: str, *, text: str = "text", groups: str = "groups") -> DataFrame:
    """``docs`` with the column ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids of A and B between cuts that both make.

    ``path_a`` is a byte-level BPE (tokenizers JSON), which gets the text behind a space, ``path_b``
    a sentencepiece model that adds this space.  All other columns are kept; a column already
    named ``groups`` is replaced.  Null and empty texts, and those whose tokens don't join to the
    text again, give the empty string.
    """
    kept = docs.drop(groups)
    schema = kept.select("*").schema.add(groups, "string")  # add() changes the schema it is called on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        for batch in batches:
            made = [b";".join(t.groups).decode() if t else "" for _, t, _ in _read(aligner, batch.column(text).to_pylist(), True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def _blocks(docs: DataFrame, path_a: str, path_b: str, key: str, text: str, block_links: int) -> DataFrame:
    """A row per block of documents: their keys and totals, their links as places in ``pairs``, and how often each pair is linked."""
    few = docs.select(F.col(key).alias("key"), F.col(text))
    kind = few.schema[0].dataType.simpleString()
    schema = f"block bigint, keys array<{kind}>, counts array<bigint>, shas array<string>, links binary, pairs array<bigint>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        keys, counts, shas, links, held = [], [], [], [], 0

        def packed() -> pa.RecordBatch:
            pairs, place = np.unique(np.concatenate(links), return_inverse=True)
            times = np.bincount(place, minlength=len(pairs))
            # The commonest pairs first: then most places are small, and the planes of their bytes compress.
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), dtype="<u4")
            rank[order] = np.arange(len(order))
            planes = np.ascontiguousarray(rank[place].view(np.uint8).reshape(-1, 4).T).tobytes()
            row = {"block": [block], "keys": [pa.concat_arrays(keys)], "counts": [np.concatenate(counts)], "shas": [shas], "links": [pa.compress(planes, "zstd", asbytes=True)], "pairs": [pairs[order]], "times": [times[order]]}
            types = (pa.int64(), pa.list_(keys[0].type), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) if not isinstance(v[0], pa.Array) else pa.ListArray.from_arrays([0, len(v[0])], v[0]) for v, t in zip(row.values(), types)], names=list(row))

        for batch in batches:
            first = 0
            for i, found, own in _read(aligner, batch.column(1).to_pylist()):
                counts.append(found.counts if found else np.zeros(4, np.int64))
                shas.append(found.sha.hexdigest() if found else "")
                links.append(own)
                held += len(own)
                if held >= block_links or i == batch.num_rows - 1:
                    keys.append(batch.column(0)[first : i + 1])
                    first = i + 1
                if held >= block_links:
                    yield packed()
                    block += 1
                    keys, counts, shas, links, held = [], [], [], [], 0
        if keys:
            yield packed()

    return few.mapInArrow(run, schema)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and pair: block, slot (place of the pair in the block), pair, n."""
    for batch in batches:
        for k in range(batch.num_rows):
            pairs, times = batch.column(1)[k].values, batch.column(2)[k].values
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.arange(n, dtype=np.int32)), pairs, times], names=["block", "slot", "pair", "n"])


def pair_counts(slots: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per linked id pair: pair (id of A << 32 | id of B), links (in the corpus), best (no id of A is linked more often with this id of B)."""
    total = scratch.table(slots.groupBy("pair").agg(F.sum("n").alias("links")), "totals")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = total.groupBy(b.alias("_b")).agg(F.max("links").alias("_most"))
    # One row per id of B at most, which the vocabulary bounds.
    return total.join(F.broadcast(most), b == F.col("_b")).select("pair", "links", (F.col("links") == F.col("_most")).alias("best"))


def _scored(key_type: pa.DataType):
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Totals of the documents of one block; ``right`` has the corpus-wide count of each of its pairs."""
        keys = left.column("keys").combine_chunks().values
        shas = left.column("shas").combine_chunks().values
        counts = left.column("counts").combine_chunks().values.to_numpy().reshape(-1, 4)
        planes = np.frombuffer(_decompressed(left.column("links")[0].as_py(), int(counts[:, 3].sum()) * 4), np.uint8)
        place = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        slot = right.column("slot").to_numpy()
        links, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        links[slot], best[slot] = right.column("links").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(counts[:, 3])))
        added = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[place])))[at])
        columns = [keys.cast(key_type), *(pa.array(counts[:, k]) for k in range(4)), pa.array(added(best)), pa.array(added(links)), shas]
        return pa.Table.from_arrays(columns, names=names)

    return run


def _decompressed(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def align(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", block_links: int = BLOCK_LINKS, label: str = "alignment") -> tuple[DataFrame, DataFrame]:
    """Totals by document, and the table of linked id pairs.

    The first has a row per document: key, n_a, n_b (tokens), n_groups, n_links, n_best (links whose
    pair is the one most linked with its id of B in the corpus, ties included), count_sum (over
    links, how often the corpus links their pair), groups_sha256 (of the text of
    :func:`token_groups`).  The second has a row per pair: pair (id of A << 32 | id of B), links, best.

    Null and empty texts, and those whose tokens don't join to space and text again (one that holds
    U+2581, say), have no tokens: zeros and the empty string.  Rows that repeat a key each give a row
    and count each; null keys are kept; an empty table gives no rows.  A task holds one block of
    documents, or one document beyond that; a text over 2 * PART_CHARS is aligned in parts.
    """
    scratch = Scratch(docs.sparkSession, label)
    blocks = scratch.table(_blocks(docs, path_a, path_b, key, text, block_links), "blocks")
    slots = blocks.select("block", "pairs", "times").mapInArrow(_slots, "block bigint, slot int, pair bigint, n bigint")
    counted = scratch.table(pair_counts(slots, scratch), "pairs")
    kind = docs.schema[key].dataType
    known = slots.select("block", "slot", F.col("pair").alias("_pair")).join(counted, F.col("_pair") == F.col("pair")).select("block", "slot", "links", "best")
    held = blocks.select("block", "keys", "counts", "shas", "links")
    schema = f"key {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    made = held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scored(to_arrow_type(kind)), schema)
    return made.withColumnRenamed("key", key), counted


def op11_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Contract columns of :func:`align`, which states nulls, repeats and empty tables."""
    return align(docs, path_a, path_b)[0]
