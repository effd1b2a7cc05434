"""Token ids in shards compressed by Re-Pair grammars.

A shard holds the ids of consecutive documents.  Frequent pairs of neighbouring symbols become
nonterminals, round after round; the file keeps the rules, how many ids each rule expands to, and
the shortened sequence, so any id range is decoded by walking down only the symbols that cover it.
A shard is one row of a Parquet table, so a shard file is complete or absent.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from tidewatch.llm.bpe import byte_alphabet

#: Texts without these characters are split here and their words remembered; the library takes others whole.
UNUSUAL = re.compile(r"[^\t\n\r !-~¡-ſ–—‘-„…€]")
#: The letters and numbers among the usual characters.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: Fixed value: how the vocabulary file's pre-tokenizer splits a text, for usual characters.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s\0{LETTERS}{NUMBERS}]+|\s+(?![^\s\0])|\s+|\0"
#: Between strings that are handled together; no usual text has it.
BETWEEN = "\0"
#: Words that are one piece.
PLAIN = rf"^ ?[{LETTERS}]+$"
#: A piece has a blank inside or at its end only where white space precedes or follows it.
SPACED = re.compile(r"[\t\n\r ] ")
REMEMBERED = 400_000
#: Bytes of texts that are encoded at once, unless one text has more.
AT_ONCE = 4_000_000
#: Ids after which a task begins a new shard.
SHARD_IDS = 1 << 20
#: Ids that a rule may stand for to be expanded once and for all when a shard is read.
FEW = 64


class Known:
    """Strings numbered as they are first met, and the ids of each."""

    def __init__(self):
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.begin = self.lengths

    def new(self) -> list[str]:
        """Those without ids, in order."""
        return list(islice(reversed(self.number), len(self.number) - len(self.lengths)))[::-1]

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        self.begin = np.cumsum(self.lengths) - self.lengths

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        size = self.lengths[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.begin[numbers] - (ends - size), size) + np.arange(total)]


class Encoder:
    """The library's ids of whole texts; usual texts are put together from remembered words.

    A text is cut before the blanks, which begin pieces unless white space precedes them.  Only words
    not met before are split into pieces, and the library's model encodes only pieces not met before.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = re.compile(PIECES)
        described = json.loads(self.tokenizer.to_str())
        splits = described.get("pre_tokenizer") or {}
        self.usual = (
            splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
            and described["model"].get("type") == "BPE" and not described["model"].get("dropout") and described.get("normalizer") is None
        )
        #: The model takes bytes as the pre-tokenizer spells them; those of usual texts that are spelled otherwise.
        self.spelling = {chr(b): c for b, c in enumerate(byte_alphabet()) if c != chr(b)}
        between = self.spelling[BETWEEN]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = Split(between, "isolated")
        self.between = self.tokenizer.token_to_id(between)
        self.usual = self.usual and self.between is not None
        self._forget()

    def _forget(self) -> None:
        self.words, self.known = Known(), Known()
        self.known.numbers([BETWEEN])
        self.known.learn(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _learn(self) -> None:
        new = self.words.new()
        plain = pc.match_substring_regex(pa.array(new, pa.string()), PLAIN).to_numpy(zero_copy_only=False)
        split = self.known.numbers(self.pieces.findall("".join(new[at] + BETWEEN for at in np.flatnonzero(~plain).tolist())))
        pieces = np.ones(len(new), np.int64)
        pieces[~plain] = np.diff(np.flatnonzero(split == 0), prepend=-1)
        numbers = np.empty(pieces.sum(), np.int64)
        own = np.repeat(plain, pieces)
        numbers[own] = self.known.numbers([new[at] for at in np.flatnonzero(plain).tolist()])
        numbers[~own] = split
        spelled = "".join(piece + BETWEEN for piece in self.known.new()).encode().decode("latin-1")
        for byte, character in self.spelling.items():
            spelled = spelled.replace(byte, character)
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.int32)
        ends = ids == self.between
        self.known.learn(ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1)
        # a word's ids are those of its pieces
        until = np.r_[0, np.cumsum(self.known.lengths[numbers])]
        ends = np.cumsum(pieces)
        self.words.learn(self.known.ids_of(numbers), until[ends] - until[ends - pieces])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and how many each has."""
        if len(self.words.number) > REMEMBERED:
            self._forget()
        usual = np.full(len(texts), self.usual)
        for found in (pc.match_substring_regex(texts, UNUSUAL.pattern), *(pc.match_substring(texts, s) for s in self.special)):
            usual &= ~found.to_numpy(zero_copy_only=False)
        spaced = usual & pc.match_substring_regex(texts, SPACED.pattern).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(usual & ~spaced)
        words = pc.split_pattern(pc.replace_substring(texts.take(pa.array(cut)), " ", "\0 "), "\0")
        distinct = words.flatten().dictionary_encode()
        numbers = self.words.numbers(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        pieces = {at: self.words.numbers(self.pieces.findall(texts[at].as_py())) for at in np.flatnonzero(spaced).tolist()}
        if len(self.words.number) > len(self.words.lengths):
            self._learn()
        numbers = numbers[distinct.indices.to_numpy()]
        until = np.r_[0, np.cumsum(self.words.lengths[numbers])]
        sizes = np.zeros(len(texts), np.int64)
        sizes[cut] = np.diff(until[words.offsets.to_numpy() - words.offsets[0].as_py()])
        ids = self.words.ids_of(numbers)
        if len(cut) == len(texts):
            return ids, sizes
        coded = dict(zip(cut.tolist(), np.split(ids, np.cumsum(sizes[cut])[:-1])))
        coded |= {at: self.words.ids_of(code) for at, code in pieces.items()}
        for at in np.flatnonzero(~usual).tolist():
            coded[at] = np.array(self.tokenizer.encode(texts[at].as_py(), add_special_tokens=False).ids, np.int32)
        coded = [coded[at] for at in range(len(texts))]
        return np.concatenate(coded), np.fromiter(map(len, coded), np.int64, len(coded))


def compress(ids: np.ndarray, vocabulary: int, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), expansion lengths of the nonterminals, and the shortened sequence.

    A round replaces, from left to right, all pairs that occur at least a quarter as often as the most
    frequent one and ``least`` times; where pairs overlap the more frequent wins.  Rounds go on until no
    pair occurs ``least`` times.  Symbol ``vocabulary + k`` stands for rule ``k``; rules use earlier symbols only.
    """
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    lengths = [np.ones(0, np.int64)]
    made = 0
    # where pairs begin that may occur ``least`` times: a pair of earlier symbols never becomes more frequent
    live = np.arange(len(seq) - 1)
    while len(live):
        width = vocabulary + made
        pairs = seq.take(live)
        pairs *= width
        pairs += seq.take(live + 1)
        # a cheap count by hash first: few pairs are frequent enough to be sorted
        table = 1 << min(20, max(12, len(live).bit_length()))
        bucket = pairs * 0x9E3779B1
        bucket >>= 12
        bucket &= table - 1
        rough = np.bincount(bucket, minlength=table)
        fullest = pairs[bucket == rough.argmax()]
        rough = rough.take(bucket)
        fits = np.flatnonzero(rough >= least)
        if not len(fits):
            break
        live, pairs, rough = live.take(fits), pairs.take(fits), rough.take(fits)
        # and of these only those that may reach the floor, as the most frequent of the fullest bucket shows it
        often = pairs[rough >= max(least, int(np.unique(fullest, return_counts=True)[1].max()) >> 2)]
        kinds, counts = np.unique(often, return_counts=True)
        if counts.max() < least:
            break
        floor = max(least, int(counts.max()) >> 2)
        chosen = kinds[counts >= floor]
        rank = np.argsort(np.argsort(-counts[counts >= floor], kind="stable"), kind="stable")
        fits = np.flatnonzero(rough >= floor)
        at, pairs = live.take(fits), pairs.take(fits)
        place = np.searchsorted(chosen, pairs)
        place[place == len(chosen)] = 0
        fits = chosen[place] == pairs
        at, place = at[fits], place[fits]
        keep = _apart(at, rank[place])
        at, place = at[keep], place[keep]
        seen = np.bincount(place, minlength=len(chosen)) > 0
        used, symbol = np.flatnonzero(seen), (np.cumsum(seen) - 1)[place]
        rules.append(np.stack([chosen[used] // width, chosen[used] % width], 1))
        so_far = np.concatenate(lengths)
        pair_of = rules[-1]
        size = np.where(pair_of < vocabulary, 1, so_far[np.maximum(pair_of - vocabulary, 0)] if len(so_far) else 1).sum(axis=1)
        lengths.append(size)
        seq[at] = vocabulary + made + symbol
        stays, open_ = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        stays[at + 1] = False
        open_[live] = True
        open_[at] = True
        open_[np.maximum(at - 1, 0)] = True
        seq, live = seq[stays], np.flatnonzero(open_[stays][:-1])
        made += len(used)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), np.concatenate(lengths), seq


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs that begin ``at`` to replace so that none overlap, the lower ``rank`` first.

    Pairs overlap only with direct neighbours.  A pair that beats both neighbours (by rank, then
    by place) is taken and its neighbours fall; this repeats until all are decided.
    """
    n = len(at)
    left = np.r_[False, np.diff(at) == 1] if n else np.zeros(0, bool)
    right = np.r_[left[1:], False] if n else left
    open_ = left | right
    taken = ~open_
    for _ in range(64):
        live = np.flatnonzero(open_)
        if not len(live):
            return taken
        before = left[live] & open_[np.maximum(live - 1, 0)]
        after = right[live] & open_[np.minimum(live + 1, n - 1)]
        wins = (~before | (rank[live] < rank[np.maximum(live - 1, 0)])) & (~after | (rank[live] <= rank[np.minimum(live + 1, n - 1)]))
        won = live[wins]
        taken[won] = True
        open_[won] = False
        near = won[left[won]] - 1
        open_[near] = False
        near = won[right[won]] + 1
        open_[near] = False
    # a long run of falling ranks: the rest in one pass from left to right
    last = -2
    for k in np.flatnonzero(open_):
        if at[k] > last + 1 and not (left[k] and taken[k - 1]) and not (right[k] and taken[k + 1]):
            taken[k], last = True, at[k]
    return taken


class Shard:
    """A stored shard: random access to its ids."""

    def __init__(self, vocabulary: int, rules: bytes, lengths: bytes, sequence: bytes):
        self.vocabulary = vocabulary
        self.rules = unpack(rules).reshape(-1, 2)
        self.lengths = unpack(lengths)
        self.sequence = unpack(sequence)
        self.ends = np.cumsum(self.sizes(self.sequence))
        #: The ids of the symbols that stand for few, and where they begin.
        few = vocabulary + np.flatnonzero(self.lengths <= FEW)
        self.table = np.r_[np.arange(vocabulary), self._down(few, 1)]
        self.begin = np.r_[np.arange(vocabulary), np.zeros(len(self.lengths), np.int64)]
        self.begin[few] = vocabulary + np.cumsum(self.sizes(few)) - self.sizes(few)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.vocabulary, 1, self.lengths[np.maximum(symbols - self.vocabulary, 0)])

    def _down(self, symbols: np.ndarray, most: int) -> np.ndarray:
        """The symbols a level of the grammar at a time, until each stands for ``most`` ids or fewer."""
        while True:
            deep = self.sizes(symbols) > most
            if not deep.any():
                return symbols
            width = np.where(deep, 2, 1)
            ends = np.cumsum(width)
            out = np.empty(ends[-1], np.int64)
            out[ends[~deep] - 1] = symbols[~deep]
            pair = self.rules[symbols[deep] - self.vocabulary]
            out[ends[deep] - 2], out[ends[deep] - 1] = pair[:, 0], pair[:, 1]
            symbols = out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of the symbols."""
        symbols = self._down(symbols, FEW)
        size = self.sizes(symbols)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.table[np.repeat(self.begin[symbols] - (ends - size), size) + np.arange(total)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the shard; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, stop, "left"))
        found = self.expand(self.sequence[first:last + 1])
        skip = start - (int(self.ends[first - 1]) if first else 0)
        return found[skip:skip + stop - start]


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their four bytes apart, deflated."""
    return zlib.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


SHARD = (
    "part int, number int, first_doc long, n_ids long, vocabulary int, docs binary, sizes binary, rules binary, "
    "lengths binary, sequence binary"
)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, shard_ids: int = SHARD_IDS, least: int = 8,
) -> None:
    """Encode ``doc_id, text`` and write the shards to ``path`` in ascending order of doc_id.

    Null texts are empty, rows without doc_id are left out, and rows of one doc_id are ordered by
    text.  ``end_id`` is appended to each document.  A pair of ids becomes a rule of its shard while it
    occurs ``least`` times there: a rule for fewer costs more bytes than it saves.
    """
    fields = pa.schema(
        [("part", pa.int32()), ("number", pa.int32()), ("first_doc", pa.int64()), ("n_ids", pa.int64()), ("vocabulary", pa.int32())]
        + [(name, pa.binary()) for name in ("docs", "sizes", "rules", "lengths", "sequence")]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has one core: the library's threads would only add memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer)
        size = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        vocabulary = max(size, *encoder.tokenizer.get_added_tokens_decoder(), (end_id or 0)) + 1
        tail = np.array([] if end_id is None else [end_id], np.int32)
        ids, doc_ids, sizes, held, number, part = [], [], [], 0, 0, None

        def shard() -> pa.RecordBatch:
            whole = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            rules, lengths, sequence = compress(whole, vocabulary, least)
            return pa.RecordBatch.from_pydict({
                "part": [part], "number": [number], "first_doc": [doc_ids[0]], "n_ids": [len(whole)], "vocabulary": [vocabulary],
                "docs": [zlib.compress(np.array(doc_ids, "<i8").tobytes(), 1)], "sizes": [zlib.compress(np.array(sizes, "<i8").tobytes(), 1)],
                "rules": [pack(rules.ravel())], "lengths": [pack(lengths)], "sequence": [pack(sequence)],
            }, fields)

        for batch in batches:
            texts = batch.column("text").fill_null("")
            long = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(long, (long[at - 1] if at else 0) + AT_ONCE, "right")))
                part = batch.column("part")[at].as_py()
                found, lengths = encoder.encode(texts.slice(at, stop - at))
                ends = np.cumsum(lengths)
                for doc_id, begin, end in zip(batch.column("doc_id").slice(at, stop - at).to_pylist(), ends - lengths, ends):
                    ids += [found[begin:end], tail]
                    doc_ids.append(doc_id)
                    sizes.append(end - begin + len(tail))
                    held += sizes[-1]
                    if held >= shard_ids:
                        yield shard()
                        ids, doc_ids, sizes, held, number = [], [], [], 0, number + 1
                at = stop
        if doc_ids:
            yield shard()

    spark = docs.sparkSession
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").select(
        F.spark_partition_id().alias("part"), "doc_id", "text"
    )
    dealt.mapInArrow(write, SHARD).write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards at ``path``.

    ``start`` counts the ids of all documents before it; it comes from the shards' totals, of
    which there is one row each.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "number", "n_ids").select(
        "part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset")
    )

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                shard = Shard(row.vocabulary, row.rules, row.lengths, row.sequence)
                doc_ids = np.frombuffer(zlib.decompress(row.docs), "<i8")
                sizes = np.frombuffer(zlib.decompress(row.sizes), "<i8")
                ends = np.cumsum(sizes)
                ids = memoryview(shard.ids(0, int(ends[-1])).astype("<u4"))
                crcs = [zlib.crc32(ids[int(end - size):int(end)]) for end, size in zip(ends, sizes)]
                yield pd.DataFrame({
                    "part": row.part, "number": row.number, "doc_id": doc_ids, "start": ends - sizes, "n_tokens": sizes,
                    "ids_crc32": np.array(crcs, np.int64),
                })

    found = shards.mapInPandas(read, "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "number"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
