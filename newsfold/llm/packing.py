"""Packing into sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and a rest. Rests are put into length classes of ``GRAIN`` tokens. Over
the class histogram a linear program finds how often to use which pattern (a multiset of classes that fits a sequence):
a revised simplex holds the basis, and a knapsack dynamic program prices the next pattern. The patterns are rounded
down, what is left over (a few items a class) is filled in greedily, and the items of each class, ranked, are dealt to the
patterns' places in order. The histogram has one cell a class, so the program's size doesn't depend on the corpus.

Texts are encoded once. All cuts are known from a document's length alone, so each piece's checksum is taken while its
document is read, and only narrow rows are shuffled. A piece never needs another cut, so padding is what rounding
lengths up to the class and the last patterns leave.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsfold.functions.runtime import parts, ranked, written
from newsfold.llm.text import documents

LENGTH, END_ID, GRAIN = 2048, 1, 8
#: The program ends when no pattern would save more than this share; needs are spread by; steps after which the
#: inverse is corrected.
GAP, SPREAD, REFRESH = 1e-6, 1e-5, 100
#: Chunks, and pieces of them, that a worker remembers; bytes of texts encoded together; characters of a piece.
REMEMBER, TOGETHER, LONGEST = 400_000, 16_000_000, 40
#: Letters and signs (none that contractions or special tokens begin with) that need no look at their neighbours.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x132, 0x149)]))
SIGNS = ".,;:!?*$&%#+=-_/|\"()[]{}@~^"
NONE = np.iinfo(np.int32).max


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merges:
    """The vocabulary's merges as arrays: words of one length are merged side by side."""

    def __init__(self, tok):
        model = json.loads(tok.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        sign = {}
        for text, _ in tok.pre_tokenizer.pre_tokenize_str("".join(map(chr, range(33, 127)))):  # these stand for themselves
            sign |= {ord(c): c for c in text}
        self.inner, self.last = (np.array([vocab.get(sign.get(b, "") + e, -1) for b in range(256)], np.int32) for e in ("", end))
        for c in LETTERS:
            mapped = "".join(t for t, _ in tok.pre_tokenizer.pre_tokenize_str(c))
            for byte, m in zip(c.encode(), mapped, strict=True):
                self.inner[byte], self.last[byte] = vocab[m], vocab[m + end]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: the pair of least rank is merged, the leftmost of equals first, until none has a rank."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            raw = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            pairs = self._ranks(ids[:, :-1], ids[:, 1:])
            while True:  # in each round every word left merges a pair, so all have equally many parts
                j = pairs.argmin(axis=1) if pairs.shape[1] else np.zeros(len(at), np.int64)
                least = pairs[np.arange(len(at)), j] if pairs.shape[1] else np.full(len(at), NONE)
                done = least == NONE
                width, data = 4 * ids.shape[1], ids[done].astype("<u4").tobytes()
                for k, i in enumerate(at[done]):
                    out[i] = data[k * width : (k + 1) * width]
                if done.all():
                    break
                at, j, least = at[~done], j[~done, None], least[~done]
                ids, pairs = ids[~done], pairs[~done]
                ids = np.take_along_axis(ids, (c := np.arange(ids.shape[1] - 1)) + (c > j), axis=1)
                np.put_along_axis(ids, j, self.made[least][:, None], axis=1)
                pairs = np.take_along_axis(pairs, (c := np.arange(pairs.shape[1] - 1)) + (c >= j), axis=1)
                for step in (-1, 0):  # the pairs that end and begin with the new part
                    k = np.flatnonzero((j[:, 0] + step >= 0) & (j[:, 0] + step < pairs.shape[1]))
                    col = j[k, 0] + step
                    pairs[k, col] = self._ranks(ids[k, col], ids[k, col + 1])
        return out


class Encoder:
    """Ids of texts as the library gives them, without added special tokens.

    The pre-tokenizer splits at every space and line end, so the chunks between them encode by themselves, each as the
    chain of its pieces. Arrow finds the distinct chunks of many texts; those seen before are looked up. Of the new ones
    those that are letters (``LETTERS``, which normalise one by one; checked) with or without signs behind them give
    their pieces by one expression, and new pieces are merged together; all others go to the library.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.merges = Merges(self.tok)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        letters = "".join(c for c in LETTERS if self.tok.normalizer.normalize_str(c) == c.lower() and len(c.lower()) == 1 and c.isalpha())
        self.simple = re.compile(f"^([{letters}]{{0,{LONGEST}}})([{re.escape(SIGNS)}]{{0,{LONGEST}}})(.*)$", re.M).findall

    def _new(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks (without line ends)."""
        if len(self.pieces) > REMEMBER:
            self.pieces = {"": b""}
        cut, pieces = self.simple("\n".join(chunks).lower()), self.pieces
        new = list({x for a, b, rest in cut if not rest for x in (a, b)}.difference(pieces))
        pieces.update(zip(new, self.merges.encode([x.encode() for x in new]), strict=True))
        return [array("I", self.tok.encode(c, add_special_tokens=False).ids).tobytes() if rest else pieces[a] + pieces[b] for c, (a, b, rest) in zip(chunks, cut, strict=True)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        got = list(map(self.known.get, chunks))
        if at := [i for i, x in enumerate(got) if x is None]:
            if len(self.known) + len(at) > REMEMBER:
                self.known = {}
            new = [chunks[i] for i in at]
            for i, c, x in zip(at, new, self._new(new), strict=True):
                got[i] = self.known[c] = x
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        bounds = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        coded = self.chunks(words.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at = words.indices.to_numpy()
        length = size[at]
        ends = np.append(0, length.cumsum())
        ids = flat[np.repeat((size.cumsum() - size)[at] - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[bounds - bounds[0]]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder: it keeps what it has learnt from one task to the next."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch):
    """The batch in slices of ``TOGETHER`` bytes of text, about."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, side="right")))
        yield batch.slice(at, to - at)
        at = to


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces of every row: full sequences and a rest."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(path).encode
        for part in (x for batch in batches for x in _slices(batch)):
            ids, bounds = encode(part.column("text"))
            data, tokens = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.diff(bounds) + 1  # with the end id
            pieces = -(-tokens // length)
            row = np.repeat(np.arange(len(tokens)), pieces)
            start = length * (np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces))
            size = np.minimum(length, tokens[row] - start)
            last = start + size == tokens[row]
            crc = [zlib.crc32(end, c) if z else c for z, c in ((z, zlib.crc32(data[4 * a : 4 * b])) for a, b, z in zip((bounds[row] + start).tolist(), (bounds[row] + start + size - last).tolist(), last.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(tokens[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def _best_pattern(y: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value, by a knapsack over capacities."""
    f, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        f[c] = f[c - 1]
        if k:
            v = y[:k] + f[c - sizes[:k]]
            i = int(v.argmax())
            if v[i] > f[c] + 1e-12:
                f[c], took[c] = v[i], i
    a, c = np.zeros(len(sizes)), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            a[took[c]] += 1
            c -= sizes[took[c]]
    return float(f[room]), a


def _greedy_patterns(sizes: np.ndarray, room: int) -> np.ndarray:
    """A column for each class and number of its items: these, and then the largest classes that still fit."""
    out = []
    for i, size in enumerate(sizes):
        for n in range(1, room // size + 1):
            a, free = np.zeros(len(sizes)), room - n * size
            a[i] = n
            while (k := int(np.searchsorted(sizes, free, side="right")) - 1) >= 0:
                a[k] += free // sizes[k]
                free %= sizes[k]
            out.append(a)
    return np.stack(out, axis=1)


def column_generation(need: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often to use each, a basic optimum of the linear relaxation.

    It goes on until the best of all patterns, priced by the knapsack, is worth at most ``1 + GAP`` sequences: the bound
    then lies within that share. Needs are spread a little, so that steps aren't of length zero and no basis comes again.
    Should rounding errors stop it all the same, it ends when as many steps as twice the classes gain less than ``GAP``.
    """
    m = len(sizes)
    need = need * (1 + SPREAD * np.modf(np.arange(1, m + 1) * 0.618034)[0])
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / columns.diagonal())
    x = inverse @ need
    pool, steps, past = _greedy_patterns(sizes, room), 0, np.inf
    while True:
        y = inverse.sum(axis=0)
        worths = y @ pool  # what lies at hand is cheaper to price than a new pattern
        a, worth = pool[:, worths.argmax()], worths.max()
        if worth <= 1 + GAP:
            worth, a = _best_pattern(y, sizes, room)
        if worth <= 1 + GAP:
            return columns, x
        d = inverse @ a
        ratio = np.full(m, np.inf)
        np.divide(x, d, out=ratio, where=d > 1e-6)
        r = int(ratio.argmin())
        step = max(ratio[r], 0.0)
        x = np.maximum(x - step * d, 0)
        x[r] = step
        columns[:, r] = a
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
        steps += 1
        if steps % REFRESH == 0:
            inverse = 2 * inverse - inverse @ (columns @ inverse)  # a Newton step takes the rounding errors back
            x = np.maximum(inverse @ need, 0)
        if steps % (2 * m + REFRESH) == 0:
            if x.sum() > (1 - GAP) * past:
                return columns, x
            past = x.sum()


def patterns(counts: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern by class, times) that use every item once; counts[c] items have class c, class room fills a sequence."""
    left = counts.astype(np.int64).copy()
    out = [({room: 1}, int(left[room]))] if left[room] else []
    left[room] = 0
    sizes = np.flatnonzero(left)
    if sizes.size:
        columns, x = column_generation(left[sizes].astype(float), sizes, room)
        for k in np.argsort(-x):
            a = columns[:, k].astype(np.int64)
            used = a > 0
            times = int(min(np.floor(x[k] + 1e-9), (left[sizes][used] // a[used]).min()))
            if times:
                left[sizes] -= times * a
                out.append(({int(sizes[i]): int(a[i]) for i in np.flatnonzero(used)}, times))
    while left.any():  # largest that fits
        free, own = room, {}
        for c in np.flatnonzero(left)[::-1]:
            n = int(min(left[c], free // c))
            if n:
                own[int(c)] = n
                free -= n * int(c)
        times = int(min(left[c] // n for c, n in own.items()))
        for c, n in own.items():
            left[c] -= n * times
        out.append((own, times))
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, last rank, items a sequence, first sequence) of every pattern's share of a class."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for pattern, times in plan:
        for c, n in pattern.items():
            at = taken.get(c, 0)
            out.append((c, at, at + n * times - 1, n, base))
            taken[c] = at + n * times
        base += times
    return out


def pack(pieces: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """pieces (doc_id, start, length, ...; a written table) with sequence_id and offset, gapless from 0 in a sequence."""
    spark = pieces.sparkSession
    room = length // grain
    rows = pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    counts = np.zeros(room + 1, np.int64)
    for c, n in rows.groupBy("class").count().collect():  # a row a class
        counts[c] = n
    table = spark.createDataFrame(places(patterns(counts, room)) or [(0, 0, -1, 1, 0)], "class int, lo long, hi long, per long, base long")
    rows = ranked(rows, ["class"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], parts(spark, int(counts.sum())))
    # the table has some patterns for each of at most length / grain classes
    put = rows.join(F.broadcast(table), "class").where("rank between lo and hi")
    at = F.col("rank") - F.col("lo")
    put = put.withColumn("sequence_id", F.col("base") + F.floor(at / F.col("per")).cast("long")).withColumn("nth", at % F.col("per"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every row of docs with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: its piece is the end id alone. Repeated rows are packed each. Empty tables give no pieces; other
    columns are ignored. path: a tokenizer file that every executor can read.
    """
    return pack(written(cut_pieces(docs, path, length)), length)


def sequences(docs: DataFrame, placed: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids) with the ids themselves, padded to length unless the sequence is a power of two long.

    doc_id has to be unique in docs. This is the training data to write; it encodes once more and shuffles the ids.
    """

    def run(batches):
        encode = encoder(path).encode
        for part in (x for batch in batches for x in _slices(batch)):
            ids, bounds = encode(part.column("text"))
            whole = np.insert(ids, bounds[1:], end_id).astype(np.int32)
            at = bounds + np.arange(len(bounds))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(whole))], ["doc_id", "ids"])

    coded = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")
    cut = coded.join(placed, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    whole = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = whole.select("sequence_id", F.flatten("p.ids").alias("ids"))
    n = F.size("ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(length - n)
    return ids.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("ids"))


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
