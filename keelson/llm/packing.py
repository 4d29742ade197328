"""Hierarchical best-fit packing of token sequences.

Documents are encoded whole and end in one end token; only those longer than a sequence are cut. Full pieces are
sequences of their own. The others are packed best-fit, longest first, inside parts of bounded size; bins
filled to ``NEARLY_FULL`` are emitted, and the underfull bins of several parts are merged as items of the next round,
until one part has seen all that is left or a round merges almost nothing. A part holds about ``PART_ITEMS`` items in every round, so
no task grows with the input.

Every round writes its small assignment table (item, bin, offset) to the shared checkpoint folder; the position of a
piece is the sum of its offsets up the tree, found by joins on unique ids.

The tokenizer splits a text into pieces (letter runs, single digits, other runs) that it encodes on their own, so a task
encodes each distinct piece once and strings the ids together; the test holds this against encoding whole texts.

Defined results: a null or empty text is one piece of the end token alone; a null or repeated id is a document of its own;
an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import give_back
from keelson.llm.hashing import CHUNK, IS_SPACE, hash_spans
from keelson.session import materialize

LENGTH = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
NEARLY_FULL = 0.995
PART_ITEMS = 50_000
FAN_IN = 8
CACHE_PIECES = 150_000
#: Rows whose texts are Python objects at a time.
ROWS = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _has_rule(tokenizer) -> bool:
    """Whether a tokenizer normalizes and splits by :data:`NORMALIZERS` and :data:`SPLIT`, with byte letters and nothing else."""
    # Each part's own state: the whole file's would hold the vocabulary a second time, as Python objects.
    made, cut = (json.loads(part.__getstate__()) if part else {} for part in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    cut = cut.get("pretokenizers") or [{}]
    split, after = cut[0], cut[1:]
    return (
        [(n.get("type"), n.get("content"), n.get("pattern")) for n in made.get("normalizers") or []]
        == [(n, " " if n == "Replace" else None, {"Regex": r"\s+"} if n == "Replace" else None) for n in NORMALIZERS]
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
        and [(a.get("type"), a.get("add_prefix_space"), a.get("use_regex")) for a in after] == [("ByteLevel", False, False)]
        and not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())
    )


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable Latin-1 stands for itself,
    the other bytes get the characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The rule that this module can apply itself (fixed values of a tokenizer file): normalizers and the pattern of the pieces.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters alone are split into pieces here, by the tokenizer's own rule (letter runs, single digits, other runs);
#: NFC leaves them as they are. An apostrophe may start a contraction, which has a rule of its own.
_PLAIN = re.compile(r"[!-&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\x20\x09-\x0D]*+")
_KIND = np.full(256, 3, np.int8)
_KIND[IS_SPACE] = 0
_KIND[48:58] = 2
_KIND[97:123] = 1
_KIND[128:] = 1


class Encoder:
    """Texts to their ids, each distinct piece encoded once by the tokenizer's model.

    What was encoded is kept by the piece's 64-bit hash, for at most ``CACHE_PIECES`` pieces. Words outside the plain
    alphabet, and those that hold an added token, go through the whole tokenizer, word by word. A tokenizer with another
    rule of normalizing or splitting encodes whole texts itself.
    """

    def __init__(self, file: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if "/" in file else public_tokenizers.path(file))
        self.own_rule = _has_rule(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted; the ids of key k are ids[at[k] : at[k] + n[k]]
        self.at, self.n, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def _learn(self, keys: np.ndarray, found: list[bytes]) -> None:
        made = [
            [t.id for t in self.model.tokenize(p.decode() if p.isascii() else "".join([self.letters[b] for b in p]))]
            for p in found
        ]
        n = np.array([len(m) for m in made], np.int64)
        at = self.used + np.cumsum(n) - n
        flat = np.array([i for m in made for i in m], np.uint32)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        order = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, into, keys[order])
        self.at, self.n = np.insert(self.at, into, at[order]), np.insert(self.n, into, n[order])

    def _plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        lower = [t.lower().encode() for t in texts]
        raw = b"\n".join(lower)
        buf = np.frombuffer(raw, np.uint8)
        kind = _KIND[buf]
        new = np.empty(len(buf), bool)
        if len(buf):
            new[0] = True
            np.not_equal(kind[1:], kind[:-1], out=new[1:])
            new |= kind == 2
        edges = np.append(np.flatnonzero(new), len(buf))
        real = kind[edges[:-1]] != 0
        starts, ends = edges[:-1][real], edges[1:][real]
        keys, first, which = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.forget()
        spot = np.searchsorted(self.keys, keys)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == keys[known]
        if not known.all():
            at = first[~known]
            self._learn(keys[~known], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            spot = np.searchsorted(self.keys, keys)
        n = self.n[spot][which]
        last = np.cumsum(n)
        take = np.arange(last[-1] if len(last) else 0) - np.repeat(last - n, n) + np.repeat(self.at[spot][which], n)
        ids = self.ids[take]
        text_ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in lower]))  # pieces before each text's end
        return np.split(ids, np.concatenate(([0], last))[text_ends][:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        if not self.own_rule:
            return [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        out: list = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if self.plain(t)]
        for i, ids in zip(easy, self._plain_ids([texts[i] for i in easy])):
            out[i] = ids
        for i, text in enumerate(texts):
            if out[i] is None:
                found = re.findall(r"[^\x20\x09-\x0D]+", text)
                fine = [self.plain(w) for w in found]
                made = iter(self._plain_ids([w for w, f in zip(found, fine) if f]))
                parts = [
                    next(made) if f else np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
                    for w, f in zip(found, fine)
                ]
                out[i] = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return out


@cache
def encoder(file: str) -> Encoder:
    """One per worker process, which serves many tasks."""
    return Encoder(file)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about a megabyte."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece with the columns of :data:`PIECES`."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in (b.slice(at, ROWS) for b in iterator for at in range(0, b.num_rows, ROWS)):
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                rows = []
                for doc, ids in zip(docs[a:b], encode(texts[a:b])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), length)):
                        own = ids[at : at + length]
                        rows.append((doc, k, at, len(own), zlib.crc32(own.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
            give_back()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indexes: longest first, each into the fullest bin that takes it."""
    room: list[tuple[int, int]] = []  # sorted (free, bin)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > sizes[i]:
            insort(room, (free - sizes[i], b))
    return bins


def _round(items: DataFrame, part, capacity: int) -> DataFrame:
    """(item, bin, offset, fill, part): each part of ``items`` (item, size) packed on its own."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        ids, sizes = pdf["item"].tolist(), pdf["size"].tolist()
        rows = []
        for members in best_fit(sizes, capacity):
            at, fill = 0, sum(sizes[i] for i in members)
            for i in members:
                rows.append((ids[i], ids[members[0]], at, fill))
                at += sizes[i]
        return pd.DataFrame(rows, columns=["item", "bin", "offset", "fill"])

    return items.groupBy(part.alias("_p_part")).applyInPandas(one, "item long, bin long, offset long, fill long")


def pack(sized: DataFrame, capacity: int = LENGTH, part_items: int = PART_ITEMS, fan_in: int = FAN_IN, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``sized`` (``item``, unique, and ``size`` <= capacity) to (item, sequence_id, offset)."""
    left = sized.where(F.col("size") < capacity).select("item", "size")
    full = sized.where(F.col("size") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n = left.count()
    n_parts = max(1, -(-n // part_items))
    levels: list[DataFrame] = []
    while n:
        part = F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(n_parts))
        done = materialize(_round(left, part, capacity), f"pack_round_{len(levels)}")
        levels.append(done)
        under = done.where((F.col("offset") == 0) & (F.col("fill") < int(nearly_full * capacity)))
        left = under.select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        before, n = n, left.count()
        if n_parts == 1 or n > 0.99 * before and len(levels) > 1:
            break
        n_parts = min(-(-n_parts // fan_in), max(1, -(-n // part_items)) if n_parts <= fan_in else n_parts)
        n_parts = max(n_parts, -(-n // part_items))
    if not levels:
        return full
    placed = levels[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for level in levels[1:]:
        up = level.select(F.col("item").alias("_p_item"), F.col("bin").alias("_p_bin"), F.col("offset").alias("_p_off"))
        placed = placed.join(up, F.col("sequence_id") == F.col("_p_item"), "left").select(
            "item",
            F.coalesce("_p_bin", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("_p_off", F.lit(0))).alias("offset"),
        )
    return placed.unionByName(full)


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each one gets."""
    cut = materialize(pieces(df, doc_id, text, tokenizer).withColumn("_p_uid", F.monotonically_increasing_id()), "pieces")
    place = pack(cut.select(F.col("_p_uid").alias("item"), F.col("length").alias("size")))
    return cut.join(place, F.col("_p_uid") == F.col("item")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
