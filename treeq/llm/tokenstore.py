"""Token IDs in a content-addressed store.

Whole texts are encoded; a rolling hash over the ids cuts each document's stream
into chunks at places that depend on content alone, so equal passages give equal
chunks (Muthitacharoen et al., SOSP 2001). The store is a folder of Parquet files:

* ``chunks``: ``digest`` (BLAKE2b, 16 bytes) and ``payload``, the chunk's ids as
  little-endian unsigned integers of 2 bytes (4 if the vocabulary needs it), each
  unique chunk once;
* ``recipes``: for every document, in ascending order of ``doc_id``, its place,
  ``start`` (ids of all documents before it), ``n_tokens``, the digests of its
  chunks and the Merkle root over them;
* ``manifest``: a Merkle tree over the documents' roots in that order, ``FANOUT``
  children to a node; the one node on the top level stands for the whole store.

Chunks and recipes leave one pass over the texts in one shuffle, after which Spark
drops repeated chunks, sorting and spilling where it must. Reading recomputes every
digest and root, and raises if one differs.

Defined cases: a null or empty text is the end id alone. Null ids come first in the
order; rows with equal ids are in the order of their content, and equal rows are
interchangeable. Other columns are ignored. An empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeq.llm.common import Scratch, before, documents, ordered, tidy

END = 2
WINDOW = 16
#: A place is a cut if these bits of the rolling hash are zero: every 256 ids on average.
CUT = np.uint64(0xFF << 16)
SHORTEST, LONGEST = 64, 1024
FANOUT = 1024
#: Words and their ids that a worker remembers, and chunks that a task knows it sent.
MEMO, SENT = 200_000, 100_000
#: Words of letters that are encoded as one text, and such texts that are held at once.
JOINED, CALLS = 500, 32
#: Rows and characters that are encoded at once.
ROWS, CHARACTERS = 8192, 1 << 21
_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The tokenizer, the type of its ids, a memory of words, which ids end a word, and
    a pattern of the texts whose case must stay."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        if hasattr(t.model, "_resize_cache"):
            t.model._resize_cache(0)  # words are remembered here
        n = t.get_vocab_size()
        ends = np.array([(t.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        added = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
        cased = "|".join([r"[^\x{0}-\x{12F}\x{131}-\x{2FF}]", *[f"(?i:{x})" for x in added]])
        _TOKENIZERS[path] = (t, "<u2" if n <= 1 << 16 else "<u4", {"": b""}, ends, cased)
    return _TOKENIZERS[path]


def plain(word: str) -> bool:
    """Letters only, also after normalization: one word to the tokenizer."""
    return word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", word) and word.lower().isalpha()))


def _words(words: list[str], path: str) -> dict[str, bytes]:
    """The ids of every word. Words of letters are encoded many to a call, spaces between."""
    t, kind, _, ends, _ = _tokenizer(path)
    found: dict[str, bytes] = {}
    letters = [w for w in words if plain(w)]
    groups = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
    for at in range(0, len(groups), CALLS):
        some = groups[at : at + CALLS]
        for group, e in zip(some, t.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=kind)
            stops = (np.flatnonzero(ends[ids]) + 1) * ids.itemsize
            if len(stops) == len(group) and stops[-1] == ids.nbytes:
                data, stops = ids.tobytes(), stops.tolist()
                found.update((w, data[a:b]) for w, a, b in zip(group, [0, *stops], stops))
    rest = [w for w in words if w not in found]
    for w, e in zip(rest, t.encode_batch_fast(rest, add_special_tokens=False)):
        found[w] = np.array(e.ids, dtype=kind).tobytes()
    return found


@lru_cache(maxsize=1)
def ended() -> str:
    """A pattern of a letter, the marks that end its word, and what follows.

    Marks aren't those that a contraction or a special token may begin with. Not of letters that normalization ends with a combining mark, which would join
    the marks behind it. Letters past U+1FFFF are ideographs and stay letters.
    """
    letters = filter(str.isalpha, map(chr, range(0x20000)))
    apart = "".join(c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1].isalpha())
    return rf"([^\PL{apart}])([.,!?;:*#&%$]+)(\s|$)"


def simplified(texts: pa.Array, cased: str) -> pa.Array:
    """Texts with the same ids and fewer distinct words.

    A space goes between a letter and the marks that end its word. Texts within
    the Latin letters below U+0300, which normalization leaves as they are, are
    lower-cased; U+0130 isn't, as it becomes two characters, nor is a text with what
    would read as a special token then. ``cased`` matches all that stays.
    """
    wide = pc.match_substring_regex(texts, cased)
    texts = pc.if_else(wide, texts, pc.utf8_lower(texts))
    return pc.replace_substring_regex(texts, ended(), r"\1 \2\3")


def encode(texts: pa.Array, path: str, splits: bool = True) -> list[bytes]:
    """The ids of every text, as bytes.

    ``splits`` says that the tokenizer lower-cases, never joins across ASCII white
    space, and splits letters from marks. Then each distinct word is looked up once,
    only words not seen before are encoded, and a text's ids are gathered from its
    words'.
    """
    t, kind, memo, _, cased = _tokenizer(path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not splits:
        return [np.array(e.ids, dtype=kind).tobytes() for e in t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    lists = pc.ascii_split_whitespace(simplified(texts, cased))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    own = list(map(memo.get, distinct))
    if new := [i for i, x in enumerate(own) if x is None]:
        found = _words([distinct[i] for i in new], path)
        for i in new:
            own[i] = found[distinct[i]]
        if len(memo) < MEMO:  # the words that come first are the frequent ones
            memo.update(found)
    width = np.dtype(kind).itemsize
    pool = np.frombuffer(b"".join(own), dtype=kind)
    sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // width
    first = np.cumsum(sizes) - sizes
    at = coded.indices.to_numpy()
    n = sizes[at]
    upto = np.concatenate([[0], np.cumsum(n)])
    small = np.int32 if max(upto[-1], len(pool)) < 1 << 31 else np.int64
    stream = pool[np.repeat((first[at] - upto[:-1]).astype(small), n) + np.arange(upto[-1], dtype=small)].tobytes()
    borders = (upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * width).tolist()
    return [stream[a:b] for a, b in zip(borders, borders[1:])]


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit number for each id (the finishing steps of SplitMix64)."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def mixed_table() -> np.ndarray:
    return mixed(np.arange(1 << 16))


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place, the hash of the last ``WINDOW`` ids, by doubling the window."""
    h, width = mixed_table()[ids] if ids.dtype.itemsize == 2 else mixed(ids), 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    return h


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document; the last is its length."""
    n = len(ids)
    if n <= SHORTEST:
        return [n]
    places = (np.flatnonzero((rolling(ids) & CUT) == 0) + 1).tolist()
    ends, start = [], 0
    for p in [*places, n]:
        while p - start > LONGEST:
            start += LONGEST
            ends.append(start)
        if p - start >= SHORTEST and p < n:
            ends.append(p)
            start = p
    if start < n:
        ends.append(n)
    return ends


def root(digests: list[bytes]) -> bytes:
    """Merkle root: pairs are hashed level by level, an odd one moves up."""
    level = list(digests)
    while len(level) > 1:
        level = [blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions of some ``CHARACTERS`` bytes; a longer row is one."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = int(np.searchsorted(sizes, done + CHARACTERS, side="right"))
        stop = min(max(stop, start + 1), start + ROWS)
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start = stop


RECIPES = "place long, doc_id long, start long, n_tokens long, digests array<binary>, root binary"
MANIFEST = "level int, node long, root binary"
_ROWS = "key binary, copy long, doc_id long, n_tokens long, digests array<binary>, root binary, payload binary, recipe boolean"


def _encoded(docs: DataFrame, path: str, end: int, splits: bool) -> DataFrame:
    """Recipe rows of all documents, and chunk rows, which a task may repeat.

    A chunk's ``key`` is its digest and its ``copy`` is null. A recipe's key says
    where it goes, and its copy tells it from recipes of equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kind = _tokenizer(path)[1]
        width, last = int(kind[2]), np.array([end], dtype=kind).tobytes()
        sent: set[bytes] = set()
        copy = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in portions(whole)):
            ids = batch.column(0).to_pylist()
            keys, lengths, digests, roots, chunks = [], [], [], [], {}
            if len(sent) > SENT:
                sent.clear()
            for doc_id, data in zip(ids, encode(batch.column(1), path, splits)):
                data += last
                own, at = [], 0
                for e in cuts(np.frombuffer(data, dtype=kind)):
                    piece = data[at * width : e * width]
                    d = blake2b(piece, digest_size=16).digest()
                    own.append(d)
                    if d not in sent:
                        sent.add(d)
                        chunks[d] = piece
                    at = e
                whole = root(own)
                lengths.append(len(data) // width)
                digests.append(own)
                roots.append(whole)
                keys.append(blake2b(whole + repr(doc_id).encode(), digest_size=16).digest())
            n, c = len(ids), len(chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*keys, *chunks], pa.binary()),
                    pa.array([*range(copy, copy + n), *[None] * c], pa.int64()),
                    pa.array(ids + [None] * c, pa.int64()),
                    pa.array(lengths + [None] * c, pa.int64()),
                    pa.array(digests + [None] * c, pa.list_(pa.binary())),
                    pa.array(roots + [None] * c, pa.binary()),
                    pa.array([None] * n + list(chunks.values()), pa.binary()),
                    pa.array([True] * n + [False] * c),
                ],
                ["key", "copy", "doc_id", "n_tokens", "digests", "root", "payload", "recipe"],
            )
            copy += n
            del keys, lengths, digests, roots, chunks
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)


def write(docs: DataFrame, at: str, path: str, end: int = END, splits: bool = True) -> None:
    """Encodes ``docs(doc_id, text)`` into a store in the folder ``at``.

    ``splits``: see ``encode``; pass False for a tokenizer that joins across spaces.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = scratch.path("staged")
    rows = _encoded(docs, path, end, splits).repartition(parts, "key").dropDuplicates(["key", "copy"])
    rows.write.partitionBy("recipe").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(staged)
    everything = spark.read.schema(_ROWS).parquet(staged)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(at))
    chunks = jvm.org.apache.hadoop.fs.Path(f"{staged}/recipe=false")
    if fs.exists(chunks):
        fs.rename(chunks, jvm.org.apache.hadoop.fs.Path(f"{at}/chunks"))
    else:
        spark.createDataFrame([], "key binary, payload binary").write.parquet(f"{at}/chunks")
    keys = ["doc_id", "root", "n_tokens"]
    recipes = everything.filter("recipe").select("doc_id", "root", "n_tokens", "digests")
    placed = ordered(recipes, keys, scratch, "recipes")
    placed = before(placed, {"place": F.lit(1), "start": F.col("n_tokens")}, keys)
    placed.select("place", "doc_id", "start", "n_tokens", "digests", "root").write.option("compression", "zstd").parquet(f"{at}/recipes")
    manifest(spark, at).write.parquet(f"{at}/manifest")
    scratch.delete(scratch.root)


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """``level, node, root`` of the Merkle tree over the recipes' roots."""
    level, depth = spark.read.schema("place long, root binary").parquet(f"{at}/recipes"), 0
    nodes = None
    while True:
        depth += 1
        grouped = level.groupBy(F.floor(F.col("place") / FANOUT).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "root"))).alias("own"))
        joined = F.array_join(F.transform("own", lambda x: F.hex(x["root"])), "")  # FANOUT children at most
        level = grouped.select("place", F.unhex(F.sha2(joined, 256)).alias("root"))
        this = level.select(F.lit(depth).alias("level"), F.col("place").alias("node"), "root")
        nodes = this if nodes is None else nodes.unionByName(this)
        if level.limit(2).count() < 2:
            return nodes


POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(i)) & np.uint64(1) == 1, b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1) == 1, POLY, np.uint64(0))
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each crc adds to that of a string that has ``after`` more bytes behind it.

    crc32(a + b) is the xor of a's, shifted by b's length, and b's.
    """
    out = crc.astype(np.uint64)
    power = np.full(1, 1 << 23, dtype=np.uint64)  # x to the 8
    n = after.astype(np.uint64)
    while n.any():
        odd = n & np.uint64(1) == 1
        if odd.any():
            out[odd] = _times(out[odd], np.broadcast_to(power, int(odd.sum())).copy())
        power = _times(power, power)
        n = n >> np.uint64(1)
    return out


def check_chunks(spark: SparkSession, at: str, width: int) -> DataFrame:
    """``digest, n, crc`` of every stored chunk, each checked against its digest."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, crc = batch.column(0).to_pylist(), [], []
            for key, data in zip(keys, batch.column(1).to_pylist()):
                if blake2b(data, digest_size=16).digest() != key:
                    raise ValueError(f"chunk {key.hex()} differs from its digest")
                ids = np.frombuffer(data, dtype=kind)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return spark.read.schema("key binary, payload binary").parquet(f"{at}/chunks").mapInArrow(run, "digest binary, n long, crc long")


def read_back(spark: SparkSession, at: str, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_chunks`` of every document in the store.

    The crc is put together from those of its chunks, so payloads are read once
    where they lie and never shuffled.
    """
    scratch = Scratch(spark, "readback")
    width = int(_tokenizer(path)[1][2])
    chunks = scratch.save(check_chunks(spark, at, width), "chunks")
    recipes = spark.read.schema(RECIPES).parquet(f"{at}/recipes")

    @F.pandas_udf("boolean")
    def rooted(digests: pd.Series, roots: pd.Series) -> pd.Series:
        return pd.Series([root(list(d)) == r for d, r in zip(digests, roots)], dtype=bool)

    @F.pandas_udf("long")
    def moved(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(shifted(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    stored = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").withColumnRenamed("root", "expected")
    wrong = manifest(spark, at).join(stored, ["level", "node"], "full").filter(~F.col("root").eqNullSafe(F.col("expected")))
    if not wrong.isEmpty():
        raise ValueError("the manifest differs from the recipes")
    sound = F.when(rooted("digests", "root"), F.col("digests")).otherwise(F.raise_error(F.lit("a recipe differs from its root")))
    used = recipes.select("place", "doc_id", "start", "n_tokens", F.posexplode(sound).alias("seq", "digest"))
    used = used.join(chunks, "digest", "left").select(
        "place", "doc_id", "start", "n_tokens", "seq", F.coalesce("n", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("n"), "crc"
    )
    upto = F.sum("n").over(Window.partitionBy("place").orderBy("seq"))
    part = used.withColumn("tail", (F.col("n_tokens") - upto) * 4).withColumn("part", moved("crc", "tail"))
    whole = part.groupBy("place", "doc_id", "start", "n_tokens").agg(
        F.sum("n").alias("total"), F.bit_xor("part").alias("ids_crc32"), F.count("*").alias("n_chunks")
    )
    checked = F.when(F.col("total") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's chunks don't add up")).cast("long"))
    return whole.select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"), "n_chunks")


def read_ids(spark: SparkSession, at: str, path: str) -> DataFrame:
    """``doc_id, ids``: whole documents put together again, ids as bytes."""
    chunks = spark.read.schema("key binary, payload binary").parquet(f"{at}/chunks")
    used = spark.read.schema(RECIPES).parquet(f"{at}/recipes").select("place", "doc_id", F.posexplode("digests").alias("seq", "key")).join(chunks, "key")
    own = F.sort_array(F.collect_list(F.struct("seq", "payload")))
    joined = F.aggregate(own, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["payload"]))
    return used.groupBy("place", "doc_id").agg(joined.alias("ids")).drop("place")


def store_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a store in the shared folder and returns what reading it back gives."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    at = Scratch(docs.sparkSession, "store").path("store")
    write(docs, at, path)
    return read_back(docs.sparkSession, at, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(documents(spark, sf_dir))
