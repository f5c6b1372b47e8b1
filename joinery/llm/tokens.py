"""Byte-pair token ids of a whole corpus by a traversal of the trie of its words.

Texts are cut into words by the vocabulary's pattern. The distinct words of a batch, in byte order, are the
depth-first order of their trie: a stack holds, for each byte of the path to the present node, the last token of
the encoding of that prefix. Going to the next word drops the states below the common prefix, so the encoding of
a shared prefix is worked out once. A prefix has exactly one last token t for which the last token before t and t
stay apart when their bytes are merged by rank; that is the state of the node, and following the states back from
the end of a word gives its ids.

No rows move between tasks: each task keeps the words it has met. A word's ids depend on the word alone.

Defined results: a null and an empty text give the empty list, marker strings are ordinary text, every row of the
input is one row of the output (repeated rows included), null ids stay null, an empty table gives an empty table.
Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

#: The pattern that goes with the rank files, see the README beside them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a task keeps before it forgets them all and starts again (memory only, results are the same).
KEPT_WORDS = 400_000


class PrefixEncoder:
    """Encodes words by last-token states along a trie."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        #: every ending of a token: the token's id if the ending is a token itself, else -1
        self.endings: dict[bytes, int] = {}
        for token in self.ranks:
            for i in range(len(token)):
                self.endings.setdefault(token[i:], self.ranks.get(token[i:], -1))
        self._apart: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging by rank, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay the same two tokens when their joined bytes are merged."""
        known = self._apart.get((left, right))
        if known is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            known = self._apart[left, right] = a + b not in self.ranks and self.merged(a + b) == [a, b]
        return known

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each word; shared prefixes are encoded once."""
        out: dict[str, tuple[int, ...]] = {}
        last: list[int] = [-1]  # last[i]: the last token of the path's first i bytes
        path = b""
        endings, bytes_of = self.endings, self.bytes_of
        for data, word in sorted((w.encode("utf-8"), w) for w in words):
            shared, most = 0, min(len(data), len(path))
            while shared < most and data[shared] == path[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(data) + 1):
                fits, j = [], i - 1
                while j >= 0 and (token := endings.get(data[j:i])) is not None:
                    if token >= 0:
                        fits.append((j, token))
                    j -= 1
                last.append(next(t for j, t in reversed(fits) if j == 0 or self.apart(last[j], t)))
            path = data
            ids, i = [], len(data)
            while i:
                ids.append(last[i])
                i -= len(bytes_of[last[i]])
            out[word] = tuple(reversed(ids))
        return out


_encoders: dict[int, PrefixEncoder] = {}


def encode_table(docs: DataFrame, rank_file: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every row's text, without special tokens.

    rank_file is read on the driver (under 1 MB, fixed by the vocabulary) and broadcast, so executors need not have it.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        data = shared.value
        encoder = _encoders.get(hash(data)) or _encoders.setdefault(hash(data), PrefixEncoder(data))
        cut, known = regex.compile(PATTERN), {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, ends = array("i"), array("i", [0])
            if len(known) > KEPT_WORDS:
                known.clear()
            for at in range(0, len(texts), 500):
                split = [cut.findall(t) if t else [] for t in texts[at : at + 500]]
                known.update(encoder.encode({w for words in split for w in words if w not in known}))
                for words in split:
                    for word in words:
                        ids.extend(known[word])
                    ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column(0), lists], names=[id_col, "ids"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
