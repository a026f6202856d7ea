"""Token ids in ORC: run-length encoded stripes in document order, with row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, new_folder, prepare, tidy

END = 1
#: ORC settings: a stripe is read by one task; the index and the Bloom filter of each 1,000 rows prune within it.
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Pieces of words that a worker's memory holds in each of two generations, about 40 MB each.
CACHE = 200_000

#: Rows, or bytes of text, that are encoded together: each of their distinct words is looked at once.
GATHER_ROWS, GATHER_BYTES = 8192, 12 << 20

#: The normalizer and pre-tokenizer that PIECE stands for, as the vocabulary's file states them (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Pieces that this pre-tokenizer makes of lower-cased Latin-1 text without white space (fixed values).
PIECE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\na-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Characters whose class or folding the libraries could see differently, and special tokens' start.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0Ā-\U0010ffff]|<\\|")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, with a memory of pieces of words.

    White space always ends a piece and leaves no id, so a text's ids are those of its words in turn, and a word's
    those of its pieces, each of which the library's model encodes once. A word with any character beyond plain
    Latin-1, or with the start of a special token, goes through the library's whole pipeline instead. So does every whole
    text if the file states another normalizer or pre-tokenizer than KNOWN, or adds tokens that could span words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        said = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in said["added_tokens"]]
        self.plain = (said["normalizer"], said["pre_tokenizer"]) == KNOWN and said["truncation"] is None and said["padding"] is None and all(re.fullmatch(r"<\|\w+\|>", t) for t in added)
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.byte_chars = {b: chr(b if b in shown else next(rest)) for b in range(256)}
        self.pieces = _Memory()

    def piece(self, text: str) -> bytes:
        """The model's ids of one piece."""
        said = text if text.isascii() else text.encode().decode("latin-1").translate(self.byte_chars)
        return array("i", [t.id for t in self.model.tokenize(said)]).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the library's whole pipeline."""
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lists(self, words: list[str]) -> pa.ListArray:
        """Ids of distinct words without white space: plain ones by their pieces, others by the whole pipeline."""
        if not words:
            return _lists([])
        odd = [i for i, w in enumerate(words) if ODD.search(w)] if ODD.search("".join(words)) else []
        plain = list(words) if odd else words
        for i in odd:
            plain[i] = ""
        pieces = PIECE.findall("\n".join(plain).lower() + "\n")
        self.pieces.of(list(set(pieces)), lambda new: [_STOP if p == "\n" else self.piece(p) for p in new])
        ids = np.frombuffer(b"".join(map(self.pieces.now.__getitem__, pieces)), dtype=np.int32)
        stops = np.flatnonzero(ids == -1)
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops - np.arange(len(stops))]).astype(np.int32)), pa.array(ids[ids != -1]))
        if odd:
            place = np.arange(len(words))
            place[odd] = len(words) + np.arange(len(odd))
            found = pa.concat_arrays([found, _lists(self.whole([words[i] for i in odd]))]).take(pa.array(place))
        return found

    def arrow(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of a string array, the end id last."""
        if not self.plain:
            return _lists([x + _END for x in self.whole([t or "" for t in texts.to_pylist()])])
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        starts, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del split
        flat = self.lists(_strings(coded.dictionary)).take(coded.indices)
        del coded
        # the ids of a text: those of its words, and the end id after them
        ends = flat.offsets.to_numpy()[starts - starts[0]]
        ids = np.insert(flat.flatten().to_numpy(), ends[1:], np.int32(END))
        return pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(ids))

    def text(self, text: str | None) -> list[int]:
        return self.arrow(pa.array([text], pa.string()))[0].as_py()


class _Memory:
    """Values by key in two generations: the older one goes when the newer has CACHE keys, less what is asked for again."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: list[str], make) -> list[bytes]:
        """The keys' values; ``make`` gives those of the keys that are not held."""
        if len(self.now) > CACHE:
            self.now, self.old = {}, self.now
        got = list(map(self.now.get, keys))
        away = [i for i, x in enumerate(got) if x is None]
        if self.old:
            for i in away:
                got[i] = self.old.get(keys[i])
            new = [i for i in away if got[i] is None]
        else:
            new = away
        for i, x in zip(new, make([keys[i] for i in new]) if new else []):
            got[i] = x
        self.now.update(zip([keys[i] for i in away], [got[i] for i in away]))
        return got


def _strings(array: pa.Array) -> list[str]:
    """The strings of an array without spaces."""
    if not len(array):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array), " ")
    return joined[0].as_py().split(" ")


def _lists(ids: list[bytes]) -> pa.ListArray:
    at = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


_END = np.array([END], dtype=np.int32).tobytes()
_STOP = np.array([-1], dtype=np.int32).tobytes()

_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder, with the words that its earlier tasks met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _gathered(batches):
    """(doc_ids, texts) of several batches together."""
    held: list[pa.RecordBatch] = []

    def out():
        found = pa.concat_arrays([b.column(0).cast(pa.int64()) for b in held]), pa.concat_arrays([b.column(1).cast(pa.string()) for b in held])
        held.clear()
        return found

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHER_ROWS or sum(b.nbytes for b in held) >= GATHER_BYTES:
            yield out()
    if held:
        yield out()


def write_tokens(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write (part, pos, doc_id, ids) in ascending doc_id order: file by file, and within each file.

    Null and empty texts are just the end id. A null doc_id sorts first; rows of one doc_id are ordered by a hash
    of their texts, which also deals them, so that many rows without an id do not meet in one task. Further columns are not read; an empty table gives an empty folder.
    A very long text is encoded whole, in the memory of its words and ids.
    """
    path = path or default_path()
    schema = "part int, pos long, doc_id long, ids array<int>"
    arrow = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        encoder, part, pos = encoder_of(path), TaskContext.get().partitionId(), 0
        for doc_ids, texts in _gathered(batches):
            n = len(texts)
            ids = encoder.arrow(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), doc_ids, ids], schema=arrow)
            pos += n
        tidy()

    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    rows.mapInArrow(run, schema).write.options(**ORC).orc(folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(part, pos, doc_id, ids) of a folder; of the given documents only, met through statistics and Bloom filters."""
    rows = spark.read.schema("part int, pos long, doc_id long, ids array<int>").orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; start counts the ids of all documents before."""

    def run(batches):
        for batch in batches:
            n, lists = batch.num_rows, batch.column(3)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())], names=["part", "pos", "doc_id", "n_tokens", "ids_crc32"]
            )

    rows = cut(read_tokens(spark, folder).mapInArrow(run, "part int, pos long, doc_id long, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("s"))
    base = files.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return near.join(base, "part").select("doc_id", (F.col("base") + F.col("near")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' ids into the shared folder and index them; the folder stays, as the product."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path)
    return token_index(docs.sparkSession, folder)
