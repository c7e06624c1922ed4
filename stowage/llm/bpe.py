"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last WINDOW code points sets cuts, so passages that documents share fall into
the same chunks wherever they stand. A chunk's body is encoded once for each worker and then reused;
on a miss its blank-separated pieces are, whose encodings are kept as well. The text around a cut is
the join: it is re-encoded from the last blank before the cut to the first one after it, further on
past more cuts if need be. Encodings of text on either side of a blank never depend on each other in
the tokenizers accepted here, so the repaired join agrees exactly with the encoding of the whole.

Both stores are bounded and start anew when full, and go when another operator takes the worker; they hold nothing that cannot be made again, so a
lost executor costs only the repetition. Nothing is shuffled.

Defined results: null text is empty, with no tokens and an empty decoding; repeated rows are encoded
as often as they stand; an empty table gives no rows; other columns of the input pass through on
request, those named like a result are replaced.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import drop_others, keeps, tidy

WINDOW, CHUNK_BITS = 16, 9
#: Bounds of a worker's stores: pieces in a generation, their code points each, and code points in all chunks.
PIECES, PIECE_LENGTH, CHUNK_TEXT = 100_000, 64, 2_000_000
#: Bytes of results for each batch handed back.
BATCH_BYTES = 2_000_000


def cuts(text: str, window: int = WINDOW, bits: int = CHUNK_BITS) -> np.ndarray:
    """Places between code points where chunks end, from the code points before them alone."""
    if len(text) < 2 * window:
        return np.empty(0, np.int64)
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    factor, width = np.uint32(0x01000193), 1
    while width < window:
        h = h[:-width] * factor + h[width:]
        factor, width = np.uint32(int(factor) ** 2 & 0xFFFFFFFF), 2 * width
    return np.flatnonzero((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits) == 0) + window


class Codec:
    """Encodes and decodes whole texts; one for each worker and tokenizer file."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.splits = self._blank_splits(json.loads(self.tokenizer.to_str()))
        self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        #: Pieces in two generations: what is used again outlives the older one.
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.held = 0

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @staticmethod
    def _blank_splits(spec: dict) -> bool:
        """Whether blanks part the text and vanish, and decoding joins tokens by blanks."""
        steps = spec.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        first = steps[0] if steps else {}
        drops = first.get("type") in {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"} or (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]" in first["pattern"].get("Regex", ""))
        plain = all(s.get("type") in {"Split", "ByteLevel", "Whitespace", "WhitespaceSplit"} and not s.get("add_prefix_space") for s in steps)
        return bool(drops and plain and spec.get("decoder") is None and spec["model"]["type"] == "BPE")

    def whole(self, text: str) -> tuple[bytes, str]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if not self.splits:
            return self.whole(text)
        flat = text.replace("\n", " ").replace("\t", " ")
        bodies, at = [], 0  # chunk bodies and repaired joins, in turn
        for cut in cuts(text).tolist():
            if cut <= at:
                continue  # the last join went past this cut
            left, right = flat.rfind(" ", at, cut), flat.find(" ", cut)
            if left < 0:
                continue  # no blank yet: the join goes on
            bodies.append((flat[at:left], True))
            right = len(flat) if right < 0 else right
            bodies.append((flat[left + 1 : right], False))
            at = right + 1
        bodies.append((flat[at:], True))
        parts = [self._pieces(body, keep) for body, keep in bodies]
        return b"".join(p[0] for p in parts), "".join(p[1] for p in parts)[1:]

    def _pieces(self, body: str, keep: bool) -> tuple[bytes, str]:
        if keep and (found := self.chunks.get(body)):
            return found
        pieces = body.split(" ")
        known, long = self.known, {}
        if new := [p for p in set(pieces) if p not in known]:
            if len(known) + len(new) > PIECES:
                self.older, known, new = known, {}, list(set(pieces))
                self.known = known
            if self.older:
                known |= {p: v for p in new if (v := self.older.get(p)) is not None}
                new = [p for p in new if p not in known]
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                ids = e.ids
                value = array("I", ids).tobytes(), " " + " ".join([self.tokens[i] for i in ids]) if ids else ""
                (known if len(p) <= PIECE_LENGTH else long)[p] = value
        both = [known[p] for p in pieces] if not long else [long[p] if p in long else known[p] for p in pieces]
        found = b"".join([x[0] for x in both]), "".join([x[1] for x in both])
        if keep and len(body) < CHUNK_TEXT // 100:
            if self.held + len(body) > CHUNK_TEXT:
                self.chunks, self.held = {}, 0
            self.chunks[body] = found
            self.held += len(body)
        return found


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ids (binary, little-endian unsigned 32-bit) and decoded (string)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"ids", "decoded"}]
    columns = [*keep, *([text] if text not in keep else [])]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    place, n = columns.index(text), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("bpe")
        codec = Codec.at(path)
        keeps("bpe", Codec._made.clear)
        for batch in batches:
            start, ids, said, size = 0, [], [], 0
            for i, value in enumerate(batch.column(place)):
                a, b = codec.encode(value.as_py() or "")
                ids.append(a)
                said.append(b)
                size += len(a) + len(b)
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(start, len(ids)) for k in range(n)], pa.array(ids, pa.binary()), pa.array(said, pa.string())], names=[*keep, "ids", "decoded"])
                    start, ids, said, size = i + 1, [], [], 0
        tidy()

    return docs.select(*columns).mapInArrow(run, schema)
