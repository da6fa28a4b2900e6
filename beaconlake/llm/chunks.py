"""Encoding many texts by the distinct chunks in them.

A text is cut at each single space between a visible character and another; the space stays
with what follows it.  The pieces of a byte-level tokenizer's pattern never cross such a cut,
so every chunk encodes on its own.  A group of texts asks a bounded memo for its chunks and
hands those it lacks, once each, to the tokenizer.  Where a run of blanks would make a cut
depend on its surroundings, the whole text counts as one chunk and is not remembered.
A group's chunks are numbered first, so that the memo is asked once for each distinct one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds of the memo (entries) and of a group of texts (characters), per Python worker.
MEMO_ENTRIES = 500_000
GROUP_CHARS = 1 << 22
_LONG = 32


class ChunkMemo:
    """Packed ids of texts, from ``encode`` (distinct strings to packed ids, in order); ``encode_spaced`` does so for chunks given without the space before them."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], encode_spaced: Callable[[list[str]], list[bytes]] | None = None):
        self.encode = encode
        self.encode_spaced = encode_spaced or (lambda chunks: encode([" " + s for s in chunks]))
        self.known: dict[str, bytes] = {}
        self.refused = 0

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text, in order; null encodes as empty."""
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self.refused > 8 * MEMO_ENTRIES:
            self.known, self.refused = {}, 0
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = offsets[:-1]
        spaced = np.ones(len(at), dtype=bool)  # all but the head of each text
        spaced[first] = False
        used = np.zeros(len(distinct), dtype=bool)
        used[at[spaced]] = True
        found = [self.known.get(c) if u else None for c, u in zip(distinct, used.tolist())]
        lacking = used & np.fromiter((f is None for f in found), bool, len(found))
        odd = np.zeros(len(distinct), dtype=bool)
        odd[[i for i in np.flatnonzero(lacking).tolist() if not distinct[i] or distinct[i][0].isspace()]] = True
        text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        whole = np.zeros(len(texts), dtype=bool)
        whole[text_of[spaced & odd[at]]] = True
        wanted = np.zeros(len(distinct), dtype=bool)
        wanted[at[spaced & ~whole[text_of]]] = True
        fresh = np.flatnonzero(wanted & lacking).tolist()
        alone = [text if entire else distinct[head] for text, entire, head in zip(texts, whole.tolist(), at[first].tolist())]
        made = iter(self.encode([x for x in alone if x]))
        more = dict(zip([distinct[i] for i in fresh], self.encode_spaced([distinct[i] for i in fresh])))
        self._remember(more)
        for i, ids in zip(fresh, more.values()):
            found[i] = ids
        packs = np.empty(len(found), dtype=object)
        packs[:] = found
        parts = packs[at].tolist()
        for x, entire, a, b in zip(alone, whole.tolist(), first.tolist(), offsets[1:].tolist()):
            own = next(made) if x else b""
            yield own if entire else own + b"".join(parts[a + 1 : b])

    def _remember(self, more: dict[str, bytes]) -> None:
        room = MEMO_ENTRIES - len(self.known)
        if len(more) <= room:
            self.known |= {c: p for c, p in more.items() if len(c) <= _LONG}
        else:
            self.refused += len(more)
            for c in list(more)[: max(0, room)]:
                if len(c) <= _LONG:
                    self.known[c] = more[c]
