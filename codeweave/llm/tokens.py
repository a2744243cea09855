"""Token ids in Simple-8b files.

A file holds consecutive documents: a header, their ids and lengths, word offsets of blocks of 1024 token ids, and
64-bit words. The top four bits of a word are its selector: 0-13 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1
ids of 60 // count bits, low bits first; 15 is an escape, and the word after it holds one id of up to 64 bits. Each
block starts a new word, so blocks are coded and decoded side by side, a word of every block at a time.

Files are written under their final name by a rename, so a repeated task replaces its own files with equal ones.

Encoding uses the tokenizer library on pieces. A text is cut where ASCII white space follows anything else, and where
other ASCII characters follow ASCII letters or digits. Byte-level BPE pre-tokenisation always cuts there, so the ids of
a text are those of its pieces in a row. Each worker keeps the ids of the first pieces it sees in a bounded table, by two
64-bit hashes (begun anew if it serves badly), and has the library encode the others; whole runs of texts are cut,
looked up and put together at once. Texts that hold an added token's string are encoded by the library as a whole.

Defined results: a null text is an empty one (its ids are just the end id); documents are ordered by id (null first,
marked as such in the file), those of one id by their text's hash; empty tables give no files; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweave.llm import shared
from codeweave.llm.textcols import BYTE, mix, powers, runs, seeded

END_ID = 2
FILE_IDS = 2_000_000
BLOCK = 1024
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
MAGIC = b"S8BFILE2"
#: Pieces that a worker remembers (a power of two); its tables take some 25 MB.
PIECES = 1 << 19
#: Ids that are packed at a time, which keeps the arrays in cache.
PACK_IDS = 128 * BLOCK

# The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """The larger of each value and the one `by` places on, if there is one."""
    m = max(len(x) - by, 0)
    out = x.copy()
    np.maximum(x[:m], x[len(x) - m :], out=out[:m])
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids → (words, word offset of each block and the count of all)."""
    parts = [_pack(ids[i : i + PACK_IDS]) for i in range(0, len(ids), PACK_IDS)] or [_pack(ids)]
    base = np.cumsum([0] + [len(w) for w, _ in parts])
    offsets = [o[:-1] + b for (_, o), b in zip(parts, base[:-1], strict=True)]
    return np.concatenate([w for w, _ in parts]), np.concatenate([*offsets, base[-1:]])


def _pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    ids = ids.astype(np.uint64)
    # bits[i]: the width class an id needs; fits[i]: the first selector whose count of ids from i all fit.
    top = int(ids.max()).bit_length() if n else 0
    width = np.zeros(n, np.uint8)
    for k in range(min(top, 61)):
        width += ids >= np.uint64(1 << k)
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.uint16)
    choice = np.full(n, ESCAPE, np.uint8)
    most = {1: width}
    for c in sorted(COUNTS):  # the widest id among the c from i on, from two overlapping runs of a power of two
        p = 1 << (c.bit_length() - 1)
        if p not in most:
            most[p] = _ahead(most[p // 2], p // 2)
        run = _ahead(most[p], c - p)
        choice[(run <= 60 // c) & (left >= c)] = COUNTS.index(c)
    count = np.array([*COUNTS, 0, 1], np.uint8)[choice]
    # Words begin where each block's chain of counts leads; the chains of all blocks advance together.
    at = np.arange(blocks) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    begins = np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + count[at]
        live = at < stop
        at, stop = at[live], stop[live]
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    start = np.flatnonzero(begins)
    sel = choice[start]
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel):
        of = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[place[of]] = np.uint64(ESCAPE << 60)
            words[place[of] + 1] = ids[start[of]]
            continue
        c, w = COUNTS[s], 60 // COUNTS[s]
        word = np.full(len(of), int(s) << 60, np.uint64)
        for k in range(c):
            word |= ids[start[of] + k] << np.uint64(k * w)
        words[place[of]] = word
    offsets = np.concatenate([place[np.searchsorted(start, np.arange(blocks) * BLOCK)], [len(words)]])
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words."""
    out = np.zeros(n, np.uint64)
    step = PACK_IDS // BLOCK
    for i in range(0, len(offsets) - 1, step):
        some = offsets[i : i + step + 1]
        _unpack(words[some[0] : some[-1]], some - some[0], out[i * BLOCK : (i + step) * BLOCK])
    return out


def _unpack(words: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Without escapes every word has a selector; with them blocks are read side by side, a word of each at a time."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    if not (sel == ESCAPE).any():
        count = np.array([*COUNTS, 0, 0])[sel]
        _spread(words, np.arange(len(words)), np.cumsum(count) - count, sel, out)
        return
    at, stop = offsets[:-1].copy(), offsets[1:]
    to = np.arange(len(at)) * BLOCK
    live = np.arange(len(at))
    found = []
    while len(live):
        sel = (words[at[live]] >> np.uint64(60)).astype(np.int64)
        found.append((at[live], to[live], sel))
        to[live] += np.array([*COUNTS, 0, 1])[sel]
        at[live] += np.where(sel == ESCAPE, 2, 1)
        live = live[at[live] < stop[live]]
    if found:
        _spread(words, *(np.concatenate(x) for x in zip(*found, strict=True)), out)


def _spread(words: np.ndarray, at: np.ndarray, to: np.ndarray, sel: np.ndarray, out: np.ndarray) -> None:
    for s in np.unique(sel):
        of = np.flatnonzero(sel == s)
        a, t = at[of], to[of]
        if s == ESCAPE:
            out[t] = words[a + 1]
            continue
        w, word = 60 // COUNTS[s], words[a]
        for k in range(COUNTS[s]):
            out[t + k] = (word >> np.uint64(k * w)) & np.uint64((1 << w) - 1)


def file_bytes(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """null: which documents have no id."""
    words, offsets = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets), len(words)], "<u8")
    parts = [doc_ids.astype("<i8"), lengths.astype("<u8"), offsets.astype("<u4"), words.astype("<u8"), np.packbits(null)]
    return b"".join([MAGIC, head.tobytes(), *(x.tobytes() for x in parts)])


def file_content(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, which have none, lengths, token ids) of a file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, n_offsets, n_words = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    at = 40
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    offsets = np.frombuffer(data, "<u4", n_offsets, at + 16 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at + 16 * docs + 4 * n_offsets)
    null = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 16 * docs + 4 * n_offsets + 8 * n_words))[:docs].astype(bool)
    return doc_ids, null, lengths, unpack(words, offsets, n)


def _white_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters (of bytes >= 0x80) that end before places `at` are white space."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    general = (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    others = ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return general | others | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))


#: Kinds of bytes: others, ASCII letters and digits, ASCII white space, parts of longer characters.
KIND = np.zeros(256, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[[0x20, *range(0x09, 0x0E)]] = 2
KIND[0x80:] = 3
SECOND = seeded(256, 6)


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of a run of texts, and the end of all; no piece is empty or in two texts."""
    n = len(data)
    kind = KIND[data]
    before, here = kind[:-1], kind[1:]
    begins = np.zeros(n + 1, bool)
    begins[1:n] = (here == 2) & (before != 2) | (here == 0) & (before == 1)
    doubtful = np.flatnonzero((here == 2) & (before == 3)) + 1
    begins[doubtful[_white_ends(data, doubtful)]] = False
    begins[offsets] = True
    return np.flatnonzero(begins)


class Encoder:
    """Texts → ids, through a bounded table of pieces that has their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What each id stands for in bytes: every character of a byte-level token is a byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        #: Strings that the library takes out of a text before it cuts: texts that hold one are left to it as a whole.
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(2 * PIECES, -1, np.int32)
        self.hash, self.check = np.zeros(PIECES, np.uint64), np.zeros(PIECES, np.uint64)
        self.start, self.count = np.zeros(PIECES, np.int32), np.zeros(PIECES, np.int32)
        self.pool = np.zeros(4 * PIECES, np.uint32)
        self.used, self.filled = 0, 0

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The pieces' places in the table, -1 for others."""
        mask = len(self.slot) - 1
        slot = (h >> np.uint64(65 - len(self.slot).bit_length())).astype(np.int64)
        out = self.slot[slot]
        todo = np.flatnonzero((out >= 0) & ((self.hash[out] != h) | (self.check[out] != check)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            at = self.slot[slot]
            out[todo] = at
            more = (at >= 0) & ((self.hash[at] != h[todo]) | (self.check[at] != check[todo]))
            todo, slot = todo[more], slot[more]
        return out

    def _add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Different pieces that the table doesn't have, as many as it has room for."""
        n = min(len(h), PIECES - self.used)
        n = min(n, int(np.searchsorted(np.cumsum(count), len(self.pool) - self.filled, "right")))
        if n <= 0:
            return
        new = np.arange(self.used, self.used + n)
        total = int(count[:n].sum())
        self.pool[self.filled : self.filled + total] = ids[:total]
        self.hash[new], self.check[new], self.count[new] = h[:n], check[:n], count[:n]
        self.start[new] = self.filled + np.cumsum(count[:n]) - count[:n]
        mask = len(self.slot) - 1
        slot = (h[:n] >> np.uint64(65 - len(self.slot).bit_length())).astype(np.int64)
        while len(new):
            free = self.slot[slot] < 0
            self.slot[slot[free]] = new[free]
            left = self.slot[slot] != new
            new, slot = new[left], (slot[left] + 1) & mask
        self.used, self.filled = self.used + n, self.filled + total

    def _fresh(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count for each) of pieces. Those that begin with white space and end without are encoded as one text, which has a cut at each."""
        joins = [x[0] in WHITE and x[-1] not in WHITE for x in new]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(new)
        alone = [k for k, x in enumerate(joins) if not x]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([new[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        joined = [k for k, x in enumerate(joins) if x]
        for i in range(0, len(joined), 500):
            some = [new[k] for k in joined[i : i + 500]]
            ids = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum([len(x.encode()) for x in some])
            reach = np.cumsum(self.bytes[ids])
            at = np.searchsorted(reach, ends) + 1
            if reach[-1] != ends[-1] or (reach[at - 1] != ends).any():
                raise ValueError("the tokenizer doesn't keep bytes")
            for k, part in zip(joined[i : i + 500], np.split(ids, at[:-1]), strict=True):
                out[k] = part
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array([len(x) for x in out], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first of each text and the count of all) of a run of texts."""
        whole = self._whole(data, offsets)
        cut = pieces(data, offsets)
        start, end = cut[:-1], cut[1:]
        size = end - start
        # Both hashes are sums over a piece's bytes, weighed by powers; pieces of over 64 bytes, where such sums can be made to meet, go by their place.
        power, inverse = powers(len(data) + 1)
        keys = []
        for table in (BYTE, SECOND):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * power[: len(data)], out=total[1:])
            keys.append(mix((total[end] - total[start]) * inverse[start] + size.astype(np.uint64)))
        h, check = keys
        long = size > 64
        place = self._find(h, check)
        place[long] = -1
        missing = np.flatnonzero(place < 0)
        count, begin, pool = self.count[place].astype(np.int64), self.start[place].astype(np.int64), self.pool
        if len(missing):
            tag = np.stack([h[missing], check[missing]], axis=1)
            tag[long[missing]] = np.stack([start[missing[long[missing]]], size[missing[long[missing]]]], axis=1)
            order = np.lexsort((tag[:, 1], tag[:, 0]))
            same = np.zeros(len(order), bool)
            same[1:] = (tag[order[1:]] == tag[order[:-1]]).all(axis=1)
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(~same) - 1
            first = missing[order[~same]]
            raw = data.tobytes()
            ids, n = self._fresh([raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            # Their ids stand behind the table's for now.
            if self.filled + len(ids) > len(pool):
                pool = np.concatenate([pool[: self.filled], ids])
            pool[self.filled : self.filled + len(ids)] = ids
            count[missing], begin[missing] = n[which], (self.filled + np.cumsum(n) - n)[which]
        upto = np.concatenate([[0], np.cumsum(count)])
        out = pool[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        at = upto[np.searchsorted(start, offsets)]
        if len(missing):
            if self.used == PIECES and len(missing) > 0.3 * len(place):
                self.clear()
            short = ~long[first]
            self._add(h[first[short]], check[first[short]], ids[np.repeat(short, n)], n[short])
        if len(whole):
            rows = np.split(out, at[1:-1])
            for r in whole:
                text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                rows[r] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            out, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return out, at

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that hold a string of self.added."""
        raw, found = data.tobytes(), set()
        for x in self.added:
            at = raw.find(x)
            while at >= 0:
                r = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(x) <= offsets[r + 1]:
                    found.add(r)
                at = raw.find(x, at + 1)
        return sorted(found)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """This worker's encoder; no path: the public 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = pa.schema([("part", pa.string()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, place: list[Column] | None = None) -> DataFrame:
    """docs (doc_id long, text string) → files in `folder`, in ascending order of doc_id; returns their manifest.

    place: a string column and one of row numbers, whose order is the files' instead. Rows are taken as they are read then,
    without a shuffle: a file has rows of one string and of numbers in a row, and the manifest orders the files.
    """
    spark, placed = docs.sparkSession, place is not None
    shared.ship(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = f"{TaskContext.get().partitionId():010d}", 0
        coder = encoder(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        first, after = ("", 0), ("", 0)  # places of what is held, and of what would go on from there

        def flush() -> pa.RecordBatch:
            nonlocal k
            doc_ids, null, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            data = file_bytes(doc_ids, null, lengths, ids)
            name = f"{folder}/part-{task}-{k:06d}.s8b"
            system, path = _files(name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            temporary = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(data)
            system.move(temporary, path)
            row = pa.record_batch([[first[0]], [first[1]], [name], [len(doc_ids)], [len(ids)]], schema=MANIFEST)
            k += 1
            return row

        for whole in batches:
            for batch in _stretches(whole) if placed else [whole]:
                if not batch.num_rows:
                    continue
                at = (batch["by_0"][0].as_py(), batch["by_1"][0].as_py()) if placed else after
                if held and at != after:
                    yield flush()
                doc_ids, null = batch["doc_id"].fill_null(0).to_numpy(), batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
                for i, j, data, offsets in runs(batch["text"], 1 << 18):
                    if not held:
                        first = (at[0], at[1] + i) if placed else (task, k)
                    ids, cut = coder.encode(data, offsets)
                    ended = np.full(len(ids) + j - i, end_id, np.uint32)
                    ended[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(cut))] = ids
                    held.append((doc_ids[i:j], null[i:j], np.diff(cut) + 1, ended))
                    if sum(len(x[3]) for x in held) >= FILE_IDS:
                        yield flush()
                after = (at[0], at[1] + batch.num_rows) if placed else after
        if held:
            yield flush()

    # Rows of one id are dealt out by their text's hash, so many of them are no task's burden.
    by = place or [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(f"by_{n}") for n, c in enumerate(by)])
    if not placed:
        names = [f"by_{n}" for n in range(len(by))]
        rows = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    return shared.stored(rows.mapInArrow(shared.lean(each), "part string, file long, path string, n_docs long, n_ids long"), "manifest")


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with one by_0 and by_1 in a row."""
    name, number = batch["by_0"], batch["by_1"].to_numpy()
    other = pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False) | (np.diff(number) != 1) if batch.num_rows else np.zeros(0, bool)
    cut = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    return (batch.slice(i, j - i) for i, j in zip(cut[:-1], cut[1:], strict=True))


def read(manifest: DataFrame) -> DataFrame:
    """A row per document of the manifest's files: doc_id, start (ids before it), n_tokens, ids_crc32.

    Starts come from sums over the manifest: by part, then by file within its part.
    """
    spark = manifest.sparkSession
    shared.ship(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, k, name in zip(*(batch[c].to_pylist() for c in ("part", "file", "path")), strict=True):
                system, path = _files(name)
                with system.open_input_stream(path) as f:
                    doc_ids, null, lengths, ids = file_content(f.read())
                data = memoryview(ids.astype("<u4").tobytes())
                stop = np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for n, b in zip(lengths.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (pa.repeat(part, len(doc_ids)), np.full(len(doc_ids), k, np.int64), pa.array(doc_ids, mask=null), stop - lengths, lengths, np.array(crc, np.int64))],
                    ["part", "file", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("part_start"))
    files = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before("part", "file")), F.lit(0)).alias("file_start"))
    starts = files.join(parts, "part").select("part", "file", (F.col("part_start") + F.col("file_start")).alias("base"))
    tasks = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    rows = manifest.select("part", "file", "path").repartition(tasks).mapInArrow(shared.lean(each), "part string, file long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(shared.small(starts, 100_000), ["part", "file"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised, written to token files and read back from them."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(write(docs, shared.place(spark, "tokens")))
