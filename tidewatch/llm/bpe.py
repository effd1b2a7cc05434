"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in blocks of bounded size.  A block keeps its words once, and each text
as positions into that dictionary.  The dictionaries of all blocks meet by a hash of the word,
where each distinct word is encoded once; the ids go back to the blocks and are put in place by
position.  Blocks are stored in a table bucketed by block, so that only dictionaries and ids are
shuffled.  Decoding joins ids with the pieces of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: The word pattern of the vocabulary file and its white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters alone are split here; the library splits all others.  Their lower
#: case is one character each, and none is changed by composition.
PLAIN = regex.compile(r"[\t\n\r !-~¡-¬®-ÿŒœ–—‘-„…€]*")
#: Characters of text in a block, unless one text is longer.
BLOCK_CHARS = 12_000_000
#: Distinct words whose ids a task remembers.
REMEMBERED = 500_000
#: Words that the library encodes at once; it keeps a kilobyte or more of each until their ids are taken.
ENCODED = 2_000


class Splitter:
    """Words of a text as the tokenizer's normalizer and pre-tokenizer give them, and special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: i for i, token in added.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(WORDS)
        model = json.loads(self.tokenizer.to_str())
        normal = [n.get("type") for n in (model.get("normalizer") or {}).get("normalizers", [])]
        pieces = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = pieces[0].get("pattern", {}).get("Regex") if pieces else None
        self.known = normal == ["NFC", "Replace", "Lowercase"] and pattern == WORDS
        self.bytes = {b: c for b, c in zip(range(256), byte_alphabet())}

    def split(self, text: str) -> list[str]:
        """Words; a special token stands for itself, marked by a leading line feed."""
        if self.marks and self.marks.search(text):
            out = []
            for part in self.marks.split(text):
                out += ["\n" + part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.known and PLAIN.fullmatch(text):
            return self.words.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        back = {c: b for b, c in self.bytes.items()}
        return [
            bytes(back[c] for c in piece).decode() for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        ]

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(words), ENCODED):
            part = words[at:at + ENCODED]
            plain = [w for w in part if w[0] != "\n"]
            coded = iter(self.tokenizer.encode_batch_fast(plain, add_special_tokens=False))
            out += [[self.special[w[1:]]] if w[0] == "\n" else next(coded).ids for w in part]
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


def _pack(words: list[str]) -> bytes:
    return zlib.compress("\0".join(words).encode(), 1)


def _unpack(blob: bytes) -> list[str]:
    return zlib.decompress(blob).decode().split("\0") if blob else []


def blocks(docs: DataFrame, path: str, parts: int) -> DataFrame:
    """``block, docs, positions, words``: one row per block, all columns in compressed binary form.

    ``docs`` holds doc_ids and word counts, ``positions`` the words of all texts as indexes, and
    ``words`` the dictionary in ``parts`` lists by a hash of the word.
    """
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(path)
        ids, counts, codes, size, known = [], [], [], 0, {}

        def finish() -> pd.DataFrame:
            words = list(known)
            part = np.array([zlib.crc32(w.encode()) % parts for w in words], np.int64)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            seen = np.bincount(flat, minlength=len(words))
            order = np.lexsort((-seen, part))  # lists by part, frequent words first
            new = np.empty(len(words), np.int32)
            new[order] = np.arange(len(words), dtype=np.int32)
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            lists = [_pack([words[i] for i in order[a:b]]) if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:])]
            table = np.array([ids, counts], np.int64)
            # the four bytes of the positions apart: the high ones are mostly zero
            planes = new[flat].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
            return pd.DataFrame({
                "block": [uuid.uuid4().hex], "docs": [zlib.compress(table.tobytes(), 1)],
                "positions": [zlib.compress(planes, 1)], "words": [lists], "sizes": [np.diff(bounds).tolist()],
            })

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                words = splitter.split(text) if text else []
                coded = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                ids.append(doc_id)
                counts.append(len(words))
                codes.append(coded)
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield finish()
                    ids, counts, codes, size, known = [], [], [], 0, {}
        if ids:
            yield finish()

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(split, "block string, docs binary, positions binary, words array<binary>, sizes array<int>")


def encode_words(lists: DataFrame, path: str) -> DataFrame:
    """``block, part, ids, lengths`` for ``block, part, words``: every word of a part encoded once."""
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(path)
        known: dict[str, np.ndarray] = {}
        part = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.part != part or len(known) > REMEMBERED:
                    known, part = {}, row.part
                words = _unpack(row.words)
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(i, np.int32) for i in splitter.encode(new))))
                coded = [known[w] for w in words]
                lengths = np.array([len(c) for c in coded], np.int32)
                ids = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                yield pd.DataFrame({
                    "block": [row.block], "part": [row.part],
                    "ids": [zlib.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)],
                    "lengths": [zlib.compress(lengths.astype("<u4").tobytes(), 1)],
                })

    dealt = lists.repartition("part").sortWithinPartitions("part")
    return dealt.mapInPandas(encode, "block string, part int, ids binary, lengths binary")


def encoded(docs: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """``block, docs, positions, table``: blocks with the ids of their words.

    Texts come out of it by ``texts_of``.  ``parts`` is the number of lists the vocabulary of the
    corpus is dealt to, by default as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or wide
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    blocks(docs, path, parts).write.bucketBy(wide, "block").format("parquet").saveAsTable(name)
    stored = spark.table(name)
    lists = stored.select("block", F.posexplode("words").alias("part", "words")).filter(F.length("words") > 0)
    table = (
        encode_words(lists, path).groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("part", "ids", "lengths"))).alias("table"))
    )
    return stored.select("block", "docs", "positions").join(table, "block", "left")


def _planes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def texts_of(row) -> Iterator[tuple[int, np.ndarray]]:
    """doc_id and ids of each text of a block."""
    ids = [_planes(t["ids"]) for t in (row.table if row.table is not None else [])]
    lengths = [np.frombuffer(zlib.decompress(t["lengths"]), "<u4") for t in (row.table if row.table is not None else [])]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    lengths = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    doc_ids, counts = np.frombuffer(zlib.decompress(row.docs), np.int64).reshape(2, -1)
    positions = _planes(row.positions)
    at = 0
    for doc_id, count in zip(doc_ids.tolist(), counts.tolist()):
        words = positions[at:at + count]
        at += count
        size = lengths[words]
        ends = np.cumsum(size)
        total = int(ends[-1]) if count else 0
        yield doc_id, ids[np.repeat(begin[words] - (ends - size), size) + np.arange(total)]


class Pieces:
    """The id-to-piece table, and the decoder that joins a text's ids with it."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        size = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.table = np.array([tokenizer.id_to_token(i) or "" for i in range(size)] or [""], dtype=object)
        if json.loads(tokenizer.to_str()).get("decoder") is not None:
            raise ValueError("this decoder joins pieces by a blank, as a vocabulary file without a decoder asks for")

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.table[ids].tolist())


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` digests of every row with a doc_id: see ``digests``."""
    return digests(encoded(docs, path), path)


def digests(blocks_with_ids: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text; null texts are empty.

    ids are hashed as little-endian unsigned 32-bit integers, decoded texts as UTF-8.
    """
    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(path)
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = [
                    (doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                     hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
                    for doc_id, ids in texts_of(row)
                ]
                yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return blocks_with_ids.mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
