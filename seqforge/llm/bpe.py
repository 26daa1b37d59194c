"""Byte-level BPE encoding and decoding.

Encoding cuts a text at special tokens and into words by the tokenizer's pattern. In each word a priority queue holds
the merges that two neighbours of a doubly linked list of symbols allow, lowest rank first and leftmost among equals;
an entry whose symbols have changed since is stale and skipped. Decoding concatenates the vocabulary's byte strings.
Words repeat, so a worker keeps the ids of the words it has seen, in a dictionary that becomes the older one when it
holds CACHED_BYTES; what the older one has needs no merges, and it goes when the next is full.

Defined cases: a null or empty text has no ids and decodes to the empty string; texts of any length are encoded whole;
rows are independent, so ties and repeated rows need nothing; an empty table gives an empty result; columns other than
the text are passed through by encode and decode, but for one named as what they add, which is replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_batches, table, text_or_empty

#: Bytes that each of a worker's two dictionaries of words holds, about.
CACHED_BYTES = 48 << 20
#: A longer word isn't kept.
CACHED_CHARS = 64
#: What an entry costs beside its word and ids: two objects' headers and a slot.
_ENTRY_BYTES = 200


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the
    other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE from the text of its JSON file; a file that names another way to cut words is refused."""

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, source: str):
        spec = json.loads(source)
        cutter = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE that cuts words by the usual pattern")
        byte = _byte_chars()
        raw = lambda s: bytes(byte[c] for c in s)
        self.strings = {i: raw(s) for s, i in spec["model"]["vocab"].items() if all(c in byte for c in s)}
        ids = {b: i for i, b in self.strings.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in special.items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.first = [ids[bytes([b])] for b in range(256)]
        self.pairs: list[dict[int, tuple[int, int]]] = [{} for _ in range(max(self.strings) + 1)]  # left id -> right id -> (rank, merged id)
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.pairs[ids[a]].setdefault(ids[b], (rank, ids[a + b]))
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.by_id = [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word. A queue entry is rank and place in one number; it is stale if the pair that now stands
        at its place has another rank."""
        sym = [self.first[b] for b in word]
        n = len(sym)
        if n < 2:
            return sym
        pairs = self.pairs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [got[0] * n + i for i in range(n - 1) if (got := pairs[sym[i]].get(sym[i + 1]))]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            if j < 0 or (a := sym[i]) < 0:
                continue
            got = pairs[a].get(sym[j])
            if got is None or got[0] != rank:
                continue
            sym[i] = new = got[1]
            sym[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if got := pairs[new].get(sym[k]):
                    heappush(queue, got[0] * n + i)
            h = before[i]
            if h >= 0 and (got := pairs[sym[h]].get(new)):
                heappush(queue, got[0] * n + h)
        return [s for s in sym if s >= 0]

    def _learn(self, words: list[str]) -> None:
        if self.held >= CACHED_BYTES:
            self.older, self.seen, self.held = self.seen, {}, 0
        seen, older = self.seen, self.older
        for word in words:
            if word not in seen:
                ids = older.get(word)
                if ids is None:
                    ids = np.array(self.merged(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                seen[word] = ids
                if len(word) <= CACHED_CHARS:
                    self.held += len(word) + len(ids) + _ENTRY_BYTES

    def encode(self, text: str) -> np.ndarray:
        """The ids as unsigned 32-bit integers."""
        out: list[bytes] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
                continue
            words = self.PATTERN.findall(piece)
            got = list(map(self.seen.get, words))
            if None in got:
                self._learn(words)
                got = list(map(self.seen.__getitem__, words))
                for word in {w for w in words if len(w) > CACHED_CHARS}:
                    del self.seen[word]
            out += got
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.by_id.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


@lru_cache(1)
def _loaded(file: str) -> Tokenizer:
    with open(SparkFiles.get(file), encoding="utf-8") as f:
        return Tokenizer(f.read())


def _shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to the executors; returns its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of the text in out_col, which replaces a column of that name; tokenizer: path of a byte-level
    BPE's JSON file."""
    docs = docs.drop(out_col)
    file = _shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(file)
        for part in chunks(batches, text_col):
            ids = [t.encode(x.as_py() or "").astype(np.int32) for x in part.column(text_col)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), values)], names=[*part.schema.names, out_col])

    return map_batches(docs, run, _with(docs, f"{out_col} array<int>"))


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """coded with the text of its ids in out_col, which replaces a column of that name; bytes that aren't UTF-8 become
    U+FFFD."""
    coded = coded.drop(out_col)
    file = _shipped(coded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(file)
        for b in batches:
            texts = [t.decode(x.as_py() or []) for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return map_batches(coded, run, _with(coded, f"{out_col} string"))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each document: the id, n_tokens, ids_sha256, decoded_sha256, the decoded text if named in keep."""
    file = _shipped(docs.sparkSession, tokenizer)
    decoded_too = "decoded" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(file)
        for part in chunks(batches, text_col):
            rows = []
            for x in part.column(text_col):
                ids = t.encode(x.as_py())
                text = t.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text if decoded_too else None))
            n, a, d, text = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
            out = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(text, pa.string())] * decoded_too, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["decoded"] * decoded_too)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * decoded_too
    return map_batches(docs.select(id_col, text_or_empty(text_col).alias(text_col)), run, schema)


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
