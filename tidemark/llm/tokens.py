"""Token ids of documents in files of bit-plane shuffled, zstandard-compressed blocks.

File format: a Parquet folder whose rows are chunks, so that any storage Spark can write will do. A
chunk holds the ids of whole consecutive documents. Its ids are cut into blocks of 65,536; the
little-endian 32-bit ids of a block are transposed into planes, one for each byte (or each bit) of an
id, and every plane is a zstandard frame of its own. The chunk index beside them says which documents the
chunk holds, their lengths, where the chunk begins in its shard, and the size of every frame (0: the
plane holds zeros only). Shards are the tasks that wrote; they follow one another in document order.

Order is by doc_id, null first; rows of one doc_id are ordered by a hash of the text and the text.

Edge cases: a null or empty text is the end id alone; repeated rows are encoded as often as they
occur; a text that spells the tokenizer's special token gets its id, as the library does by default.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, new_path, pieces, text_buffers

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 18
KNOWN = 200_000  # units and parts of units that a task keeps for sure; more only cost time
WORD_BYTES = 8 << 20  # of plain words and their ids that a task keeps
LINES = 256  # parts that the library gets at once
TEXT_BYTES = 2 << 20  # of texts that are cut at once
RUNS = 1 << 15  # whose ids are copied at once
PLAIN = "\u0300"  # below this code point, letters are the same in every version of Unicode
HIGH = PLAIN.encode()[0]  # bytes of plain characters are below this one
LEVEL = 3

# The code points that the tokenizer's pattern takes for white space.
WHITE_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE = "[" + "".join(map(chr, WHITE_POINTS)) + "]"
BLACK = WHITE.replace("[", "[^")
MARKS = string.punctuation
PLAIN_WORD = np.array([chr(i).isalpha() or chr(i) in string.digits for i in range(ord(PLAIN))])  # by code point


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(256 + i) for i, byte in enumerate(others)}


BYTE_CHARACTERS = _byte_characters()
LINE_CHARACTERS = {byte: x for byte, x in BYTE_CHARACTERS.items() if byte != 0x0A}
LINE_POINTS = np.array([ord(LINE_CHARACTERS.get(byte, chr(byte))) for byte in range(256)], "<u4")
BLANK = BYTE_CHARACTERS[0x20]
_UNITS = re.compile(f"{WHITE}*{BLACK}+|{WHITE}+")

INDEX = "shard int, chunk int, start_in_shard long, n_ids long, doc_ids array<{id}>, lengths array<long>, frames array<int>, planes binary"


class Encoder:
    """A tokenizer of the library, with the ids of frequent units and of their parts remembered.

    A unit is a run of white space and the run of other characters after it. The tokenizer's pattern
    never joins what lies on two sides of such a cut, so the ids of a text are those of its units.
    The different units of many texts are found at once, and the library is asked for each new part of theirs.
    Plain words, which are most of the parts, stay in Arrow throughout; other units are strings of Python.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.lines = Tokenizer(self.model)  # the model on each line of a text that is written as bytes
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int32)  # bytes of each id
        self.sizes[[*vocabulary.values()]] = [len(x) for x in vocabulary]
        self.parts = regex.compile(public_tokenizers.PATTERN)
        self.rest()

    def direct(self, texts: list[str]) -> list[bytes]:
        found = (x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def _parts(self, unit: str) -> list[str]:
        """What the tokenizer's pattern makes of a unit of plain characters."""
        return [unit] if unit.isalpha() else self.parts.findall(unit)

    def _single(self, part: str) -> bytes:
        """The ids of a part, which the pattern leaves whole."""
        found = [x.id for x in self.model.tokenize(part.encode().decode("latin-1").translate(BYTE_CHARACTERS))]
        return struct.pack(f"<{len(found)}I", *found)

    def _lines(self, parts: list[str], written: list[str]) -> None:
        """Learn parts from the lines that write their bytes; where a part ends follows from the sizes of the ids."""
        for start in range(0, len(parts), LINES):
            lines = written[start : start + LINES]
            ids = np.array(self.lines.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
            reached = np.cumsum(self.sizes[ids])
            cuts = 4 * np.searchsorted(reached, ends, "right")
            if int(ends[-1]) != (int(reached[-1]) if len(reached) else 0):  # bytes that the vocabulary lacks
                self.known.update((part, self._single(part)) for part in parts[start : start + LINES])
                continue
            raw, at = ids.tobytes(), 0
            for part, cut in zip(parts[start : start + LINES], cuts.tolist(), strict=True):
                self.known[part] = raw[at:cut]
                at = cut

    def _learn_parts(self, parts: Iterable[str]) -> None:
        printed, others = [], []
        for part in parts:
            if part.isascii() and part.isprintable():
                printed.append(part)
            elif "\n" in part:
                self.known[part] = self._single(part)
            else:
                others.append(part)
        if printed:
            self._lines(printed, "\n".join(printed).replace(" ", BLANK).split("\n"))
        if others:
            self._lines(others, "\n".join(others).encode().decode("latin-1").translate(LINE_CHARACTERS).split("\n"))

    def _remembered(self, units: set[str]) -> set[str]:
        """The units that are not known; those known of old become known again."""
        units = units.difference(self.known)
        old = units.intersection(self.older)
        self.known.update(zip(old, map(self.older.__getitem__, old), strict=True))
        return units.difference(old)

    def _of_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit; those with letters that are not plain are left to the whole tokenizer."""
        new = self._remembered(set(units))
        words = [x for x in new if x[:1] == " " and x[1:].isalpha() and (x.isascii() or max(x) < PLAIN)]
        unsure, cut, parts = [], {}, set()
        for unit in new.difference(words):
            if not unit.isascii() and max(unit) >= PLAIN:
                unsure.append(unit)
            else:
                cut[unit] = self._parts(unit)
                parts.update(cut[unit])
        self._learn_parts(chain(words, self._remembered(parts).difference(words)))
        get = self.known.__getitem__
        for unit, own in cut.items():
            self.known[unit] = b"".join(map(get, own))
        self.known.update(zip(unsure, self.direct(unsure), strict=True))
        return list(map(get, units))

    def _forget(self) -> None:
        """What was not used since as much again was learnt goes."""
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        if self.words.nbytes + self.word_ids.nbytes + self.word_sizes.nbytes > WORD_BYTES:
            self._no_words()

    def _no_words(self) -> None:
        self.words = pa.array([], pa.string())
        self.word_ids, self.word_sizes = np.empty(0, "<u4"), np.empty(0, np.int64)

    def rest(self) -> None:
        """Keep no units: between tasks the worker's memory is other stages' too, and few are worth it."""
        self.known, self.older = {}, {}
        self._no_words()

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of words that the pattern leaves whole and that hold no line end."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_buffer()
        written = LINE_POINTS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le")  # a character for each byte
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64))
        lines = (ends + np.arange(len(words)))[LINES - 1 :: LINES].tolist()  # ends of every so many lines
        found = []
        for start, end in pairwise([-1, *lines, len(written)]):
            if start < end:
                found.append(np.array(self.lines.encode_batch_fast([written[start + 1 : end]], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(found)
        reached = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        cuts = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[cuts] != ends).any():  # bytes that the vocabulary lacks
            raw = [self._single(x) for x in words.to_pylist()]
            return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        return ids, np.diff(cuts, prepend=0)

    def _of_plain(self, words: pa.Array) -> np.ndarray:
        """Which of the kept words each one is; new ones are learnt."""
        before = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()
        self.words = coded.dictionary  # begins with those of before
        if len(self.words) > before:
            ids, sizes = self._new_words(self.words[before:])
            self.word_ids = np.concatenate([self.word_ids, ids])
            self.word_sizes = np.concatenate([self.word_sizes, sizes])
        return coded.indices.to_numpy()[before:]

    def _of_words(self, words: pa.Array, spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of words without spaces; before the first `spaced` of them there is one.

        A single line end between other characters is a part of its own, and what follows it begins anew.
        """
        split = pc.split_pattern(words, "\n")
        starts = split.offsets.to_numpy().astype(np.int64)
        lines = split.flatten()
        owner = np.repeat(np.arange(len(words)), np.diff(starts))
        blank, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
        blank[starts[:spaced]] = True
        last[starts[1:] - 1] = True
        stems, tails, plain = _stems(lines)
        fine = np.logical_and.reduceat(plain, starts[:-1])
        kept = fine[owner]
        parts = pc.binary_join_element_wise(pc.if_else(pa.array(blank[kept]), " ", ""), stems.filter(pa.array(kept)), "")
        stem_of = self._of_plain(parts)
        cut = (fine | (np.diff(starts) == 1))[owner]
        tails, tail_of = _strings(tails.filter(pa.array(cut)))
        odd = np.flatnonzero(~fine)
        at = starts[odd]
        rest = pc.if_else(pa.array(cut[at]), stems.take(pa.array(at)), words.take(pa.array(odd))).to_pylist()
        others = [f" {x}" if i < spaced else x for i, x in zip(odd.tolist(), rest, strict=True)]
        found = self._of_units(["", "\n", *tails, *others])
        ids = np.concatenate([self.word_ids, np.frombuffer(b"".join(found), "<u4")])
        sizes = np.concatenate([self.word_sizes, np.fromiter(map(len, found), np.int64, len(found)) // 4])
        nothing = len(self.words)
        which = np.full((len(lines), 3), nothing, np.int32)  # of each line its stem, its tail and its end
        which[kept, 0] = stem_of
        which[cut, 1] = tail_of + (nothing + 2)
        which[kept & ~last, 2] = nothing + 1
        which[at, 0] = np.arange(len(odd)) + (nothing + 2 + len(tails))
        own = np.add.reduceat(sizes[which].sum(axis=1), starts[:-1])
        return _runs_of(ids, sizes, which.reshape(-1)), own

    def _spaced(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts in which each space begins a unit: none ends a text or follows another."""
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        words = split.flatten()
        later = np.ones(len(words), bool)
        later[bounds[:-1]] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        spaced = len(coded.dictionary)
        firsts = words.take(pa.array(bounds[:-1]))
        ids, sizes = self._of_words(pa.concat_arrays([coded.dictionary, firsts]), spaced)
        which = np.empty(len(words), np.int32)
        which[later] = coded.indices.to_numpy()
        which[bounds[:-1]] = np.arange(spaced, len(sizes))
        raw = _runs_of(ids, sizes, which).tobytes()
        ends = np.cumsum(sizes[which])[bounds[1:] - 1]
        return [raw[a:b] for a, b in pairwise([0, *(4 * ends).tolist()])]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        self._forget()
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        spaced = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)
        kinds = np.where(whole, 0, np.where(spaced, 1, 2))
        ids: list[bytes] = [b""] * len(texts)
        for kind, run in enumerate((self.direct, self._runs, self._spaced)):
            places = np.flatnonzero(kinds == kind)
            if len(places):
                some = texts.take(pa.array(places))
                for i, found in zip(places.tolist(), run(some if kind == 2 else some.to_pylist()), strict=True):
                    ids[i] = found
        return ids

    def _runs(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts but those with special tokens."""
        return [b"".join(self._of_units(_UNITS.findall(text))) for text in texts]


def _runs_of(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """`ids` are runs of the given sizes: those runs that `which` names, one after the other."""
    starts, found = np.cumsum(sizes) - sizes, []
    for at in range(0, len(which), RUNS):
        some = which[at : at + RUNS]
        counts = sizes[some]
        ends = np.cumsum(counts)
        found.append(ids[np.repeat(starts[some] - (ends - counts), counts) + np.arange(counts.sum())])
    return np.concatenate(found) if found else ids[:0]


def _strings(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different texts, none of which holds a space, and which of them each one is."""
    coded = texts.dictionary_encode()
    if len(texts) == 0:
        return [], np.empty(0, np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")
    return joined[0].as_py().split(" "), coded.indices.to_numpy()


def _stems(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Words without their last marks, those marks, and whether the rest is plain letters or digits alone.

    After a plain letter or digit, the tokenizer's pattern takes such marks for a part of its own;
    words where it may not are their own stems.
    """
    stems = pc.utf8_rtrim(words, MARKS)
    data, bounds = text_buffers(words)
    stops = bounds[:-1] + pc.binary_length(stems).to_numpy()
    padded = np.concatenate([np.zeros(2, np.uint8), data])  # byte i is at i + 2
    last, before = padded[stops + 1].astype(np.int32), padded[stops].astype(np.int32)
    points = np.where((last >= 0x80) & (last < 0xC0) & (before >= 0xC2) & (before < 0xCC), (before & 0x1F) << 6 | last & 0x3F, np.where(last < 0x80, last, 0))
    sure = PLAIN_WORD[points] & (stops > bounds[:-1])
    stops = np.where(sure, stops, bounds[1:])
    sizes = bounds[1:] - stops
    ends = np.concatenate([[0], np.cumsum(sizes)])
    marks = data[np.repeat(stops - ends[:-1], sizes) + np.arange(ends[-1])]
    tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(marks))
    stems = pc.if_else(pa.array(sure), stems, words)
    high = np.concatenate([[0], np.cumsum(data >= HIGH)])
    plain = pc.or_(pc.utf8_is_alpha(stems), pc.ascii_is_decimal(stems)).to_numpy(zero_copy_only=False)
    return stems, tails, plain & sure & (high[stops] == high[bounds[:-1]])


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder: workers serve many tasks, and what one task learnt helps the next."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def pack(ids: bytes, bits: bool = False) -> tuple[list[int], bytes]:
    """(sizes of frames, frames): the planes of each block, lowest byte or bit first."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    sizes, out = [], []
    for start in range(0, len(ids), 4 * BLOCK_IDS):
        rows = np.frombuffer(ids, np.uint8, min(4 * BLOCK_IDS, len(ids) - start), start).reshape(-1, 4)
        if bits:
            rows = np.unpackbits(rows, axis=1, bitorder="little")
        for plane in rows.T:
            if plane.any():
                plane = np.packbits(plane, bitorder="little") if bits else np.ascontiguousarray(plane)
                out.append(press.compress(plane))
                sizes.append(len(out[-1]))
            else:
                sizes.append(0)
    return sizes, b"".join(out)


def unpack(count: int, sizes: list[int], frames: bytes) -> np.ndarray:
    """The ids that `pack` stored; whether as bytes or bits follows from the number of frames."""
    open_ = zstandard.ZstdDecompressor()
    blocks = -(-count // BLOCK_IDS)
    planes = len(sizes) // blocks if blocks else 4
    out, at, k = np.zeros((count, 4), np.uint8), 0, 0
    for start in range(0, count, BLOCK_IDS):
        size = min(BLOCK_IDS, count - start)
        rows = np.zeros((size, planes), np.uint8)
        for plane in range(planes):
            if sizes[k]:
                raw = np.frombuffer(open_.decompress(frames[at : at + sizes[k]]), np.uint8)
                rows[:, plane] = raw if planes == 4 else np.unpackbits(raw, count=size, bitorder="little")
                at += sizes[k]
            k += 1
        out[start : start + size] = rows if planes == 4 else np.packbits(rows, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, bits: bool = False) -> None:
    """Encode every whole text and write the files, in ascending doc_id order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = INDEX.format(id=kind)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(tokenizer), TaskContext.get().partitionId()
        number = start = held = 0
        ids: list[bytes] = []
        owners: list = []

        def chunk() -> pa.RecordBatch:
            sizes, frames = pack(b"".join(ids), bits)
            lengths = pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64()))
            doc_ids = pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays(owners))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start]), pa.array([held]), doc_ids, lengths, pa.array([sizes], pa.list_(pa.int32())), pa.array([frames], pa.binary())],
                ["shard", "chunk", "start_in_shard", "n_ids", "doc_ids", "lengths", "frames", "planes"],
            )

        for piece in pieces(batches, most=TEXT_BYTES):
            names = piece.column("doc_id")
            for i, found in enumerate(coder.encode(pc.fill_null(piece.column("text"), ""))):
                found += end
                if held and held + len(found) // 4 > CHUNK_IDS:
                    yield chunk()
                    number, start, held, ids, owners = number + 1, start + held, 0, [], []
                ids.append(found)
                owners.append(names.slice(i, 1))
                held += len(found) // 4
        if held:
            yield chunk()
        coder.rest()

    order = ["doc_id", "_h", "text"]
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(frugal(run), schema).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, chunk, and the ids if asked for.

    Where a shard begins follows from the totals of the shards before it: as many rows as there were
    write tasks, which is the bound of what is broadcast.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = chunks.join(F.broadcast(starts), F.col("shard") == F.col("_shard"))
    placed = placed.withColumn("start", F.col("_start") + F.col("start_in_shard")).drop("_shard", "_start", "start_in_shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                ids = unpack(row["n_ids"].as_py(), row["frames"].as_py(), row["planes"].as_py())
                lengths = np.array(row["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                raw, n = memoryview(ids.tobytes()), len(lengths)
                columns = [
                    row["doc_ids"].values,
                    pa.array(row["start"].as_py() + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(lengths.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    pa.array([row["shard"].as_py()] * n, pa.int32()),
                    pa.array([row["chunk"].as_py()] * n, pa.int32()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "chunk"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, shard int, chunk int" + ", ids array<int>" * with_ids
    return placed.mapInArrow(frugal(run), schema)


def token_output(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the files (to a new folder of the shared one unless `path` is given) and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
