"""BPE encoding and decoding through a distinct-word table.

A *word* is a run of white space with the non-space run after it, or the part of a quicker split
that is as good where white space is plain. The byte-level pre-tokenizer always cuts between a
non-space and a white-space character, so encoding words one by one gives the ids of the whole
text (added tokens hold no white space).

Plan: Spark splits the texts and counts distinct words; the frequent ones (at most
``HOT_WORDS`` and ``HOT_BYTES``, cut by a histogram of counts, so the bounds hold at any size)
are encoded once and broadcast; every other occurrence goes as (row, position, word) to the task
that owns the word, which encodes each distinct word once, and comes back to its text by
position. No word beyond the table can be hot, as its count is below the cut. Decoding joins the
ids of both kinds of words with the table of the vocabulary's pieces.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+"
HOT_WORDS, HOT_BYTES = 1 << 20, 1 << 26
#: Words that a worker of ``LocalEncoder`` remembers.
CACHE_WORDS = 1 << 20

_find = re.compile(WORD).findall
_tokenizers: dict = {}
_lengths: dict = {}
_encoders: dict = {}
_EDGE = (" ", "\n")


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a process, without truncation and padding."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers.

    Words that start with a space or line end and end in a non-space are encoded as one text,
    since the tokenizer cuts between them, and told apart by the byte lengths of the ids.
    """
    chain = [w[:1] in _EDGE and w[-1] not in WHITE_SPACE for w in words]
    if all(chain):
        return list(encode_chain(path, words))
    out: list[bytes] = [b""] * len(words)
    alone = [i for i, w in enumerate(words) if w and not chain[i]]
    for at in range(0, len(alone), 4096):
        part = alone[at : at + 4096]
        for i, x in zip(part, tokenizer(path).encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = struct.pack(f"<{len(x.ids)}I", *x.ids)
    chained = [i for i, c in enumerate(chain) if c]
    for i, ids in zip(chained, encode_chain(path, [words[i] for i in chained]), strict=True):
        out[i] = ids
    return out


def encode_chain(path: str, words: list[str]) -> Iterator[bytes]:
    """Ids of words between which the tokenizer cuts, some thousands as one text."""
    import numpy as np

    if path not in _lengths:
        _lengths[path] = np.array([len(x) for x in pieces(path)], np.int64)
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        ids = np.array(tokenizer(path).encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
        size = np.fromiter(map(len, map(str.encode, part)), np.int64, len(part))
        ends = (4 * (np.searchsorted(np.cumsum(_lengths[path][ids]), np.cumsum(size)) + 1)).tolist()
        raw = ids.tobytes()
        yield from [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of every id."""
    t = tokenizer(path)
    table = byte_alphabet()
    vocab = t.get_vocab(with_added_tokens=True)
    added = {k: v.content for k, v in t.get_added_tokens_decoder().items()}
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        out[i] = added[i].encode() if i in added else bytes(table[c] for c in piece)
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Places(dict):
    """Numbers pieces as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def local_encoder(path: str) -> LocalEncoder:
    """This worker's encoder: words of earlier tasks are remembered, up to its bound."""
    if path not in _encoders:
        _encoders[path] = LocalEncoder(path)
    return _encoders[path]


class LocalEncoder:
    """Encodes texts in one worker, each distinct word once while it is remembered."""

    def __init__(self, path: str, size: int = CACHE_WORDS):
        self.path, self.size, self.place, self.ids = path, size, Places(), []

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.ids) > self.size:
            self.place, self.ids = Places(), []
        place = self.place.__getitem__
        split = [list(map(place, pieces_of(t))) for t in texts]
        new = list(itertools.islice(self.place, len(self.ids), None))  # a dict keeps the order of its keys
        self.ids += encode_words(self.path, [spelled(w) if w[:1] in _MARKS else " " + w for w in new])
        get = self.ids.__getitem__
        for places in split:
            yield b"".join(map(get, places))


#: White space after a space, or blank lines: there the quick split would cut a run of white space.
_unclear = re.compile(f" [{WHITE_SPACE}]|\n\n").search
#: Marks a piece of the quick split that is no word after a space.
_BARE = "\0"
_MARKS = (_BARE, "\n")


def pieces_of(text: str) -> list[str]:
    """A split as good as ``WORD``'s and quicker: before spaces and line ends.

    A piece stands for a space and itself, unless it starts with a line end or _BARE.
    """
    if _unclear(text) or text.endswith(" ") or _BARE in text:
        return list(map(piece, _find(text)))
    out = text.replace("\n", " \n").split(" ")
    if out[0]:
        out[0] = _BARE + out[0]
    else:
        del out[0]
    return out


def spelled(piece: str) -> str:
    return piece[1:] if piece[:1] == _BARE else piece if piece[:1] == "\n" else " " + piece


def piece(word: str) -> str:
    """The piece that stands for a word."""
    if word[:1] == "\n":
        return word
    return word[1:] if word[:1] == " " and word[1:2] not in ("\n", _BARE) else _BARE + word


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the vocabulary: its size bounds what is broadcast."""
    found = pieces(path)
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(found)), pa.int32()), "piece": pa.array(found, pa.binary())}))


def id_lists(raw: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    import numpy as np

    ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def hot_table(rows: DataFrame, path: str, limit: int) -> pa.Table:
    """(word, n, ids, decoded) of the most frequent words, at most limit rows and about HOT_BYTES,
    each encoded once; decoded is null where it is the word again.

    A task counts the words that it saw more than once: others are not frequent in it. The cut
    comes from a histogram of the counts' logarithms, so the bounds hold at any size.
    """

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pieces_of(t))
            if len(seen) > CACHE_WORDS:
                yield counted(seen)
                seen = Counter()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        often = {spelled(w): n for w, n in seen.items() if n > 1}
        return pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], ["word", "n"])

    counts = common.stored(rows.select("text").mapInArrow(common.frugal(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    total, size, cut = 0, 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("count"), F.sum(F.octet_length("word") + 16).alias("bytes")).orderBy(F.desc("level")).collect():
        total, size = total + row["count"], size + row["bytes"]
        if total > limit or size > HOT_BYTES:
            break
        cut = row["level"]
    hot = counts.filter(level >= cut) if cut is not None else counts.limit(0)

    def encoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), id_lists(encode_words(path, b.column(0).to_pylist()))], ["word", "n", "ids"])

    ids = hot.select("word", "n").mapInArrow(common.frugal(encoded), "word string, n long, ids array<int>")
    each = ids.select("word", "n", F.posexplode("ids").alias("k", "id")).join(F.broadcast(piece_table(rows.sparkSession, path)), "id")
    found = each.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("k", "id", "piece"))).alias("x"))
    decoded = F.aggregate("x", F.lit(b""), lambda acc, x: F.concat(acc, x["piece"]))
    found = found.select("word", "n", F.transform("x", lambda x: x["id"]).alias("ids"), decoded.alias("decoded"))
    again = F.col("decoded") == F.encode("word", "UTF-8")
    return common.stored(found.select("word", "n", "ids", F.when(~again, F.col("decoded")).alias("decoded")), "hot-words").toArrow()


class HotTable:
    """The broadcast table, opened once in a worker. Words are numbered from 1, frequent ones first."""

    def __init__(self, table: pa.Table):
        sink = pa.BufferOutputStream()
        table = table.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids", "decoded"])
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.data, self._number, self._ids = sink.getvalue().to_pybytes(), None, None

    def __getstate__(self):
        return {"data": self.data, "_number": None, "_ids": None}

    def number(self) -> dict[str, int]:
        """A piece's number."""
        if self._number is None:
            words = pa.ipc.open_stream(self.data).read_all().column(0).to_pylist()
            self._number = {piece(w): k for k, w in enumerate(words, 1)}
        return self._number

    def ids(self) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded bytes by number; 0 has none."""
        if self._ids is None:
            table = pa.ipc.open_stream(self.data).read_all()
            ids, decoded = [b""], [b""]
            for batch in table.to_batches():
                lists = batch.column(1)
                raw, ends = lists.flatten().to_numpy().astype("<u4").tobytes(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                ids += [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                decoded += [w.encode() if d is None else d for w, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            self._ids = ids, decoded
        return self._ids


def skeletons(rows: DataFrame, shared) -> DataFrame:
    """(rid, doc_id, skeleton): each text as its words' numbers, 0 where the table has none.

    Numbers go byte by byte of all words, compressed: half the size of the text.
    """

    def run(batches):
        import numpy as np
        import zstandard

        number, z = shared.value.number(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                words = pieces_of(t)
                found = np.fromiter(map(number.get, words, itertools.repeat(0)), "<u4", len(words))
                out.append(z.compress(np.ascontiguousarray(found.view(np.uint8).reshape(-1, 4).T).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["rid", "doc_id", "skeleton"])

    return rows.mapInArrow(common.frugal(run), "rid long, doc_id long, skeleton binary")


def numbers(skeleton: bytes) -> list[int]:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(skeleton)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().tolist()


def encode(docs: DataFrame, path: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row.

    ids: little-endian unsigned 32-bit; decoded: the text that decoding the ids gives. A null
    text counts as empty, a null doc_id stays null, repeated rows give repeated rows, very long
    texts are encoded whole; other columns are ignored. Words of equal counts are in the table
    together or not at all. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = common.numbered(docs).select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(HotTable(hot_table(rows, path, hot_words)))
    n = common.partitions(spark)

    def find_rare(batches):
        known = shared.value.number()
        for b in batches:
            rids, places, words = [], [], []
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                split = pieces_of(t)
                found = [i for i, x in enumerate(map(known.get, split)) if x is None]
                rids += [rid] * len(found)
                places += found
                words += [spelled(split[i]) for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(places, pa.int32()), pa.array(words, pa.string())], ["rid", "at", "word"])

    def encode_sorted(batches):
        last, last_ids = None, b""
        for b in batches:
            found = b.column(2).to_pylist()
            new = list(dict.fromkeys(w for w in found if w != last))
            ids = dict(zip(new, encode_words(path, new), strict=True))
            if last is not None:
                ids[last] = last_ids
            if found:
                last, last_ids = found[-1], ids[found[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), id_lists([ids[w] for w in found])], ["rid", "at", "ids"])

    rare = rows.select("rid", "text").mapInArrow(common.frugal(find_rare), "rid long, at int, word string")
    answered = rare.repartition(n, "word").sortWithinPartitions("word").mapInArrow(common.frugal(encode_sorted), "rid long, at int, ids array<int>")
    each = answered.repartition(n, "rid").select("rid", "at", F.posexplode("ids").alias("k", "id")).join(F.broadcast(piece_table(spark, path)), "id")
    answers = each.groupBy("rid").agg(F.collect_list(F.struct("at", "k", "id", "piece")).alias("rare"))

    def assemble(batches):
        known, decoded = (x.__getitem__ for x in shared.value.ids())
        for b in batches:
            ids, sizes, texts = [], [], []
            for skeleton, (at, rare_ids, rare_pieces) in zip(b.column(1).to_pylist(), rare_words(b.column(2)), strict=True):
                words = numbers(skeleton)
                parts, plain = list(map(known, words)), list(map(decoded, words))
                for i, x, y in zip(at, rare_ids, rare_pieces, strict=True):
                    parts[i], plain[i] = x, y
                ids.append(b"".join(parts))
                sizes.append(len(ids[-1]) // 4)
                texts.append(b"".join(plain).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    joined = skeletons(rows, shared).join(answers, "rid", "left").select("doc_id", "skeleton", "rare")
    return joined.mapInArrow(common.frugal(assemble), "doc_id long, n_tokens long, ids binary, decoded string")


def rare_words(lists: pa.ListArray) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """For each row: places, ids and pieces of its rare words, from list<struct<at, k, id, piece>>."""
    import numpy as np

    size = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten()
    at, k, ids = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((k, at, row))
    at, raw, row = at[order], ids[order].astype("<u4").tobytes(), row[order]
    piece = flat.field(3).take(pa.array(order)).to_pylist()
    heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))) if len(at) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(at)).tolist()
    cuts = np.searchsorted(row[heads], np.arange(len(size) + 1)).tolist()
    places, heads = at[heads].tolist(), heads.tolist()
    for a, b in itertools.pairwise(cuts):
        spans = list(zip(heads[a:b], ends[a:b], strict=True))
        yield places[a:b], [raw[4 * x : 4 * y] for x, y in spans], [piece[x] if y == x + 1 else b"".join(piece[x:y]) for x, y in spans]


def digest(encoded: DataFrame) -> DataFrame:
    """The digests of the query."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
