"""Alignment of two tokenizers' tokens over the same bytes.

``align`` is relational: it posexplodes the tokens of each key, sums their lengths in a
window, joins both sides on key and end, and numbers the groups between common ends by a
running count of cuts; a group's tokens are the range of places between two cuts. Ends are
bytes. Tokens lie in buckets by key, so none of these steps deals them out again.

Neither tokenizer joins across a space between two characters that aren't white space,
so such a space begins a token on both sides. ``aligned`` cuts texts there into segments, counts each
distinct one over the corpus, and aligns only those; a document's groups are those of its
segments in order. ``splits=False`` makes a segment of each whole text, for tokenizers that
do join. Texts go on as codes of their segments. The ``HOT`` most frequent segments, all
short, are a broadcast table; each text gets its rarer ones by joins, on the segment and then on
the text, so a frequent segment's occurrences never meet in one task.

Defined cases: a text that is null, empty, or whose tokens' bytes don't give back a space
and the text on either side has no tokens and counts for nothing. Whole texts are
encoded, however long; a task holds a text with its segments. Strings of special tokens are
plain text. Repeated rows and equal texts count each. Ties in an id pair's count are all
best. Null ids stay. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeq.llm.common import Scratch, bounded, documents, tidy

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A space between two characters that aren't white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Texts with a space that is no such space, or without characters, as RE2 has it.
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ODD = rf"^ | $|^$| {_BLANK}|{_BLANK} "
#: Segments that are broadcast, and their longest in bytes, which bounds a row to some 600 bytes.
HOT, HOT_LENGTH = 600_000, 48
#: Bytes of text that are cut at once, of segments that are encoded at once, and of packed codes.
BYTES, ENCODED, CODES = 8 << 20, 1 << 20, 1 << 19
_LOADED: dict[tuple[str, str], tuple] = {}


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def loaded(a: str, b: str) -> tuple:
    """Both tokenizers and the bytes of their ids."""
    if (a, b) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        left, right = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        left.encode_special_tokens = True
        place = byte_of()
        of_a = [bytes(place[c] for c in t) if t and all(c in place for c in t) else (t or "").encode() for t in map(left.id_to_token, range(left.get_vocab_size()))]
        of_b = []
        for i in range(right.vocab_size()):
            piece = right.id_to_piece(i)
            of_b.append(bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode())
        _LOADED[a, b] = left, right, of_a, of_b
    return _LOADED[a, b]


def encoded(segments: list[str], a: str, b: str) -> Iterator[tuple[list[int], list[int]] | None]:
    """Ids of both sides for each segment, or None where they don't give back its bytes."""
    left, right, of_a, of_b = loaded(a, b)
    ours = [e.ids for e in left.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
    theirs = right.encode(segments, num_threads=1) if segments else []
    for s, x, y in zip(segments, ours, theirs):
        whole = (" " + s).encode()
        yield (x, y) if b"".join(map(of_a.__getitem__, x)) == whole == b"".join(map(of_b.__getitem__, y)) else None


def pieces(texts: pa.Array, splits: bool) -> pa.ListArray:
    """The segments of every text; none of a null or empty one. The space before a segment isn't part of it."""
    texts = pc.fill_null(texts, "")
    if not splits:
        return pa.array([[t] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))
    odd = pc.match_substring_regex(texts, ODD)
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    if len(plain) == len(texts):
        return plain
    rest = pa.array([BETWEEN.split(t) if t else [] for t in texts.filter(odd).to_pylist()], plain.type)
    order = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    return pa.concat_arrays([plain, rest]).take(pa.array(order))


def portions(batch: pa.RecordBatch, column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions of some ``most`` bytes of text; a longer row is one."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(int(np.searchsorted(sizes, done + most, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        tidy()
        start = stop


def whole(texts: pa.Array, a: str, b: str, splits: bool, fine: set[str]) -> pa.Array:
    """Which texts the tokens of both sides give back. ``fine`` remembers characters that do.

    Texts of such characters pass at once; of others, the segments are encoded.
    """
    texts = pc.fill_null(texts, "")
    other = f"[^{''.join(rf'\x{{{ord(c):X}}}' for c in sorted(fine))}]" if fine else "(?s)."
    odd = pc.match_substring_regex(texts, other)
    passed = dict.fromkeys(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist(), True)
    for i in passed:
        text = texts[i].as_py()
        new = sorted(set(text).difference(fine))
        fine.update(c for c, x in zip(new, encoded(new, a, b)) if x)
        passed[i] = fine.issuperset(text) or None not in encoded(BETWEEN.split(text) if splits else [text], a, b)
    good = pc.not_equal(texts, "").to_numpy(zero_copy_only=False).copy()
    good[list(passed)] = list(passed.values())
    return pa.array(good)


def keys_of(segments: pa.Array) -> pa.Array:
    """A short name for each segment: itself, or a digest of a long one."""
    short = pc.less_equal(pc.binary_length(segments), HOT_LENGTH)
    keys = pc.binary_join_element_wise("=", segments, "")
    if pc.all(short).as_py() is False:
        long = pa.array(["#" + sha256(s.encode()).hexdigest() for s in segments.filter(pc.invert(short)).to_pylist()], keys.type)
        keys = pc.replace_with_mask(keys, pc.invert(short), long)
    return keys


def counted(docs: DataFrame, a: str, b: str, splits: bool, count: int) -> DataFrame:
    """``key, text, n``: the distinct segments of the texts that have tokens, with their occurrences.

    ``text`` is null where the key holds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine: set[str] = set()
        for batch in batches:
            for part in portions(batch, 0):
                texts = part.column(0)
                found = pieces(texts.filter(whole(texts, a, b, splits, fine)), splits).flatten().value_counts()
                segments = found.field("values")
                keys = keys_of(segments)
                text = pc.if_else(pc.starts_with(keys, "#"), segments, None)
                yield pa.RecordBatch.from_arrays([keys, text, found.field("counts")], ["key", "text", "n"])
        tidy()

    rows = docs.select("text").mapInArrow(run, "key string, text string, n long")
    return rows.repartition(count, "key").groupBy("key", "text").agg(F.sum("n").alias("n"))


TOKENS = ["a", "a_bytes", "b", "b_bytes"]
#: Segments that are encoded as one text.
JOINED = 500


def side_of(groups: list[list[int]], texts: list[bytes], ends: list[np.ndarray], of: list[bytes], sizes: np.ndarray):
    """Ids of all texts, and how many each of their segments has; None where a segment's end is no token's."""
    ids, counts = [], []
    for own, text, stops in zip(groups, texts, ends):
        x = np.array(own, dtype=np.int32)
        upto = np.cumsum(sizes[x])
        at = np.searchsorted(upto, stops)
        if b"".join(map(of.__getitem__, own)) != text or (upto[np.minimum(at, len(upto) - 1)] != stops).any():
            return None
        ids.append(x)
        counts.append(np.diff(at + 1, prepend=0))
    empty = np.zeros(0, dtype=np.int32)
    return np.concatenate([empty, *ids]), np.concatenate([empty, *counts])


def tokens_of(segments: list[str], a: str, b: str, splits: bool) -> list[np.ndarray]:
    """Ids and counts of both sides. Many segments are encoded as one text where no token joins across their spaces."""
    left, right, of_a, of_b = loaded(a, b)
    size_a, size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (of_a, of_b))
    out: list[list[np.ndarray]] = [[], [], [], []]
    for lo in range(0, len(segments), JOINED):
        some = segments[lo : lo + JOINED]
        joins = splits and all(s and not s[0].isspace() and not s[-1].isspace() for s in some)
        for parts in ([[some], [[s] for s in some]] if joins else [[[s] for s in some]]):
            texts = [" ".join(p) for p in parts]
            raw = [(" " + t).encode() for t in texts]
            ends = [np.cumsum([len(s.encode()) + 1 for s in p]) for p in parts]
            ours = side_of([e.ids for e in left.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], raw, ends, of_a, size_a)
            theirs = side_of(right.encode(texts, num_threads=1), raw, ends, of_b, size_b)
            if ours and theirs:
                break
        else:
            # their characters come back one by one, but not together
            raise ValueError(f"the tokens don't give back one of {some[:3]!r}")
        for held, x in zip(out, [*ours, *theirs]):
            held.append(x)
    return [np.concatenate([np.zeros(0, dtype=np.int32), *x]) for x in out]


def tokenized(segments: DataFrame, a: str, b: str, splits: bool) -> DataFrame:
    """``key, n`` with the ids of both sides and the lengths of their tokens as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, of_a, of_b = loaded(a, b)
        size_a, size_b = (np.array(list(map(len, x)), dtype=np.int32) for x in (of_a, of_b))
        for batch in batches:
            for part in portions(batch, 1, ENCODED):
                keys = part.column(0)
                texts = pc.coalesce(part.column(1), pc.utf8_slice_codeunits(keys, 1)).to_pylist()
                ids_a, n_a, ids_b, n_b = tokens_of(texts, a, b, splits)
                columns = []
                for ids, n, sizes in ((ids_a, n_a, size_a), (ids_b, n_b, size_b)):
                    offsets = pa.array(np.cumsum([0, *n], dtype=np.int32))
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, sizes[ids])]
                yield pa.RecordBatch.from_arrays([keys, part.column(2), *columns], ["key", "n", *TOKENS])
        tidy()

    return segments.mapInArrow(run, "key string, n long, " + ", ".join(f"{c} array<int>" for c in TOKENS))


@contextmanager
def dealt_by_key(spark: SparkSession):
    """Lets joins on a key and more columns use a partitioning by the key alone."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def align(tokens: DataFrame) -> DataFrame:
    """``key, cuts`` of ``tokens(key, a, a_bytes, b, b_bytes)``: for each key its cuts in order, ``grp, a_to, b_to``.

    A cut is an end that both sides share; ``grp`` is the running count of cuts before it, and the places of the
    two tokens that end there close group ``grp``. They are the group's link. A token holds at
    least one byte, so no two tokens of a side end together.
    """

    def side(name: str) -> DataFrame:
        rows = tokens.select("key", F.posexplode(f"{name}_bytes").alias(f"{name}_to", "bytes"))
        upto = Window.partitionBy("key").orderBy(f"{name}_to").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("key", f"{name}_to", F.sum("bytes").over(upto).alias("end"))

    both = side("a").join(side("b"), ["key", "end"])
    grp = (F.row_number().over(Window.partitionBy("key").orderBy("end")) - 1).alias("grp")
    cuts = both.select("key", F.struct(grp, "a_to", "b_to").alias("cut"))
    return cuts.groupBy("key").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def ranges(ids: Column, to: str) -> Callable[[Column, Column], Column]:
    """The part of ``ids`` that belongs to a cut: what comes after the one before, up to its own place."""

    def own(cut: Column, i: Column) -> Column:
        last = F.coalesce(F.get("cuts", i - 1)[to], F.lit(-1))
        return F.slice(ids, last + 2, cut[to] - last)

    return own


def groups(tokens: DataFrame) -> DataFrame:
    """``key, grp, a, b``: the ids of both sides in each group; the last of each are linked."""
    joined = tokens.join(align(tokens), "key")
    both = F.transform("cuts", lambda c, i: F.struct(ranges(F.col("a"), "a_to")(c, i).alias("a"), ranges(F.col("b"), "b_to")(c, i).alias("b")))
    return joined.select("key", F.posexplode(both).alias("grp", "g")).select("key", "grp", "g.a", "g.b")


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_NUMBERS = ", ".join(f"{c} long" for c in FIGURES)


def segment_table(docs: DataFrame, scratch: Scratch, a: str, b: str, splits: bool) -> DataFrame:
    """``key, n, groups, n_a, n_best, count_sum`` of every distinct segment of the texts that have tokens, in buckets by key.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``, so the other figures are counts of its marks.
    """
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = scratch.bucketed(tokenized(counted(docs, a, b, splits, count), a, b, splits), "tokens", ["key"], count)
    with dealt_by_key(docs.sparkSession):
        joined = tokens.join(align(tokens), "key").withColumns({"sa": F.col("a").cast("array<string>"), "sb": F.col("b").cast("array<string>")})
        shown = lambda ids, to: lambda c, i: F.array_join(ranges(F.col(ids), to)(c, i), ",")
        string = F.transform("cuts", lambda c, i: F.concat(shown("sa", "a_to")(c, i), F.lit("|"), shown("sb", "b_to")(c, i)))
        parts = joined.select(
            "key", "n", F.array_join(string, ";").alias("groups"),
            F.size("a").cast("long").alias("n_a"),
            F.transform("cuts", lambda c: F.get("a", c["a_to"])).alias("link_a"), F.transform("cuts", lambda c: F.get("b", c["b_to"])).alias("link_b"),
        )
        parts = scratch.bucketed(parts, "parts", ["key"], count)
        scratch.drop(tokens)
        links = parts.select("key", "n", F.explode(F.arrays_zip("link_a", "link_b")).alias("x")).select("key", "n", F.col("x.link_a").alias("a"), F.col("x.link_b").alias("b"))
        counts = scratch.save(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
        best = counts.groupBy("b").agg(F.max("count").alias("most"))
        valued = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
        valued = scratch.save(valued, "valued")
        sums = links.drop("n").join(bounded(valued), ["a", "b"]).groupBy("key")
        sums = sums.agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        table = scratch.bucketed(parts.join(sums, "key").select("key", "n", "groups", "n_a", "n_best", "count_sum"), "table", ["key"], count)
        scratch.drop(parts)
    return table


def listed(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), values)


def coded(docs: DataFrame, hot, a: str, b: str, splits: bool) -> DataFrame:
    """``doc_id, codes, rare``: a text's segments as places in the broadcast table, and after its end, in ``rare``.

    Codes are null for a text without tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value
        fine: set[str] = set()
        for batch in batches:
            for part in portions(batch, 1):
                texts = part.column(1)
                has = whole(texts, a, b, splits, fine)
                lists = pieces(texts.filter(has), splits)
                own = lists.flatten().dictionary_encode()
                keys = keys_of(own.dictionary)
                place = pc.fill_null(pc.index_in(keys, value_set=frequent), -1).to_numpy().astype(np.int64)
                at = own.indices.to_numpy()
                sizes = np.zeros(len(texts), dtype=np.int64)
                sizes[has.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(texts)), sizes)
                codes = place[at]
                far = codes < 0
                pairs, turn = np.unique(row[far] * len(keys) + at[far], return_inverse=True)
                rows, words = np.divmod(pairs, max(1, len(keys)))
                codes[far] = len(frequent) + turn - np.searchsorted(rows, row[far])
                data, upto = codes.astype("<u4").tobytes(), np.cumsum([0, *sizes]) * 4
                packed = [zlib.compress(data[x:y], 1) if y > x else None for x, y in zip(upto.tolist(), upto[1:].tolist())]
                rare = listed(np.bincount(rows, minlength=len(texts)), keys.take(pa.array(words)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), rare], ["doc_id", "codes", "rare"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, codes binary, rare array<string>")


def figured(groups: pa.Array, n_a: np.ndarray, best: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """``FIGURES`` from the strings of groups, the tokens of one side, and what follows from counts."""
    marks = [pc.count_substring(groups, m).to_numpy(zero_copy_only=False).astype(np.int64) for m in "|;,"]
    return np.stack([n_a, sum(marks) + 1 - n_a, marks[0], marks[0], best, sums], axis=1)


def composed(worth):
    """What turns codes into a document's figures, from the broadcast table and what each row brings of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, numbers = worth.value
        figures = figured(groups, *numbers)
        for batch in batches:
            for part in portions(batch, 1, CODES):
                data = [zlib.decompress(x) if x else b"" for x in part.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in data], dtype=np.int64)
                at = np.frombuffer(b"".join(data), dtype="<u4").astype(np.int64)
                own = part.column(2)
                n = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(n) - n
                x = own.flatten()
                pos, *own_numbers = (x.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("pos", "n_a", "n_best", "count_sum"))
                order = np.empty(len(x), dtype=np.int64)
                order[np.repeat(first, n) + pos] = np.arange(len(x))
                rare = x.field("groups").take(pa.array(order))
                pool = pa.concat_arrays([groups, rare])
                values = np.concatenate([figures, figured(rare, *[v[order] for v in own_numbers])])
                at += np.where(at >= len(groups), np.repeat(first, sizes), 0)
                joined = pc.binary_join(listed(sizes, pool.take(pa.array(at))), ";")
                sums = np.zeros((len(sizes), len(FIGURES)), dtype=np.int64)
                some = np.flatnonzero(sizes)
                if len(some):
                    sums[some] = np.add.reduceat(values[at], (np.cumsum(sizes) - sizes)[some], axis=0)
                digests = [sha256(s.as_buffer()).hexdigest() if k else "" for s, k in zip(joined, sizes.tolist())]
                columns = [part.column(0), *[pa.array(sums[:, j]) for j in range(len(FIGURES))], pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FIGURES, "groups_sha256"])
        tidy()

    return run


def one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, splits: bool = True, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``FIGURES`` and ``groups_sha256`` of every row of ``docs(doc_id, text)``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "crosstok")
    a, b = a or public_tokenizers.path(A), b or public_tokenizers.path(B)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = segment_table(docs, scratch, a, b, splits)
    short = table.filter(F.col("key").startswith("="))
    columns = ["key", "groups", "n_a", "n_best", "count_sum"]
    frequent = short.orderBy(F.desc("n"), "key").limit(hot).select(*columns).toArrow()  # bounded in rows and bytes
    keys, groups, *numbers = (one(frequent.column(c)) for c in columns)
    del frequent
    known = spark.sparkContext.broadcast(keys.cast(pa.string()))
    worth = spark.sparkContext.broadcast((groups.cast(pa.string()), [x.to_numpy() for x in numbers]))
    del keys, groups, numbers
    tidy()
    texts = scratch.save(coded(docs, known, a, b, splits).withColumn("row", F.monotonically_increasing_id()), "codes")
    rare = texts.select("row", F.posexplode("rare").alias("pos", "key"))
    brought = rare.join(table.drop("n"), "key").select("row", F.struct("pos", "groups", "n_a", "n_best", "count_sum").alias("x"))
    brought = brought.groupBy("row").agg(F.collect_list("x").alias("own"))  # a text's own segments
    met = texts.select("row", "doc_id", "codes").join(brought, "row", "left").select("doc_id", "codes", "own")
    return met.mapInArrow(composed(worth), f"doc_id long, {_NUMBERS}, groups_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))
