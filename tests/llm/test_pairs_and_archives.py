"""Hard negatives, alignment of tokenizers and archives, against brute force and round trips."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from treeq.llm import crosstok, hardneg, warc

VECTORS = "vec_id long, embedding array<float>, label int, score string, v string"


def mined(rows, positives=5, negatives=5, every=100):
    """Brute force over ``(id, vector, label)``, as Python integers."""
    usable = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, label in sorted(usable):
        if a % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), i, c) for i, w, c in usable if i != a and len(w) == len(v)]
        best = sorted((-s, i) for s, i, c in scores if c == label)[:positives]
        for turn, (s, p) in enumerate(best, 1):
            near = sorted((-n, i) for n, i, c in scores if c != label and 80 * -s <= 100 * n <= 100 * -s)[:negatives]
            out += [(a, p, turn, rank, i, -s, -n) for rank, (n, i) in enumerate(near, 1)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    return sorted(tuple(r) for r in hardneg.mine(hardneg.valid(df, F.col("label")), F.col("vec_id") % 100 == 0, **kw).collect())


def test_hard_negatives_of_table(spark, sf_dir, duck, same):
    same(hardneg.query(spark, sf_dir), duck.sql(hardneg.ORACLE_SQL))


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(hardneg, "ANCHORS", 3)  # several blocks of anchors
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0, 1.125]) for _ in range(4)], rng.randrange(3)) for i in range(700)]  # many ties
    rows += [(7000, None, 1), (7100, [1.0, None, 0.0, 0.0], 1), (7200, [1.0, float("nan"), 0.0, 0.0], 1), (7300, [1.0, float("inf"), 0.0, 0.0], 1), (7400, [1.0] * 4, None)]
    rows += [(8000 + i, [0.5, 0.75], i % 2) for i in range(0, 300, 50)]  # another length
    rows += [(9000, [], 0), (9001, [], 1), (9002, [], 0)]  # products of 0
    assert found(spark, rows) == mined(rows)
    assert found(spark, rows, positives=2, negatives=3) == mined(rows, 2, 3)


def test_hard_negatives_beyond_exact_floats(spark):
    # 256 * 2^25 squared is 2^66 / 2^... : products above 2^53 whose last bits decide
    rows = [(i, [float(1 << 20), float(i) / 256, 1.0], i % 2) for i in range(0, 40)]
    rows += [(100, [float(1 << 20), 3.0, 1.0], 0), (101, [1e30, 1.0, 1.0], 1)]
    assert [r for r in found(spark, rows) if abs(r[5]) < 1 << 62] == [r for r in mined(rows) if abs(r[5]) < 1 << 62]


def test_hard_negatives_of_copies_and_nothing(spark):
    rows = [(i, [1.0, 2.0], i % 2) for i in range(300)]  # a group of copies
    assert found(spark, rows) == mined(rows)
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 0)]) == []
    twice = found(spark, [(100, [1.0], 0), (100, [1.0], 0), (1, [1.0], 0), (2, [1.0], 1)])
    assert twice == [(100, 1, 1, 1, 2, 65536, 65536)]


TEXTS = [
    (1, "Plain words, and more words."),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "  two  spaces \n and\tothers   x "),
    (6, "<|endoftext|> <s> </s> <unk> <0x41> are text"),
    (7, "a▁b has a mark that stands for a space"),
    (8, "naïve café — 中文 テスト 👩‍👩‍👧 é ‮"),
    (9, "x" * 5000),
    (10, "Plain words, and more words."),
    (10, "Plain words, and more words."),
    (None, "a null id"),
    (11, "\x00 nul \x1c and\x1fothers"),
    (12, "word " * 3000),
    (13, "'s 're it's   don't\n\n\nend\n"),
]


def brute(rows):
    left, right, of_a, of_b = crosstok.loaded(*map(crosstok.public_tokenizers.path, (crosstok.A, crosstok.B)))
    kept, counts = [], Counter()
    for doc_id, text in rows:
        sides = [left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)] if text else [[], []]
        want = (" " + (text or "")).encode()
        if not text or any(b"".join(of[i] for i in ids) != want for ids, of in zip(sides, (of_a, of_b))):
            kept.append((doc_id, None))
            continue
        ends = []
        for ids, of in zip(sides, (of_a, of_b)):
            at, own = 0, {}
            for i in ids:
                at += len(of[i])
                own[at] = i
            ends.append(own)
        common = sorted(ends[0].keys() & ends[1].keys())
        groups = []
        for lo, hi in zip([0, *common], common):
            groups.append("|".join(",".join(str(i) for e, i in own.items() if lo < e <= hi) for own in ends))
        links = [(ends[0][e], ends[1][e]) for e in common]
        counts.update(links)
        kept.append((doc_id, (*map(len, sides), groups, links)))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, x in kept:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = x
            best = sum(counts[k] == most[k[1]] for k in links)
            out.append((doc_id, a, b, len(groups), len(links), best, sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"hot": 0}, {"splits": False}])
def test_alignment_of_odd_texts(spark, options):
    docs = spark.createDataFrame([(i, t, "k", "n") for i, t in TEXTS], "doc_id long, text string, key string, n string")
    got = sorted((tuple(r) for r in crosstok.aligned(docs, **options).collect()), key=str)
    assert got == brute(TEXTS)


def test_alignment_of_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in crosstok.query(spark, sf_dir).collect()), key=str) == brute(rows)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.aligned(docs).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in crosstok.aligned(none).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_groups_of_tokens(spark):
    tokens = spark.createDataFrame([("k", [1, 2, 3], [2, 1, 2], [7, 8], [3, 2])], "key string, a array<int>, a_bytes array<int>, b array<int>, b_bytes array<int>")
    assert sorted((r.grp, r.a, r.b) for r in crosstok.groups(tokens).collect()) == [(0, [1, 2], [7]), (1, [3], [8])]


LONG, SHORT = "<p>" + "repeated payload " * 10 + "</p>", "short"
PAGES = [
    (5, "http://a.example/1", LONG),
    (3, "http://a.example/ä b\r\nX: y", LONG),
    (9, None, LONG),
    (None, "http://a.example/null", LONG),
    (1, "http://a.example/2", SHORT),
    (2, "http://a.example/2", SHORT),
    (4, "http://a.example/3", None),
    (6, "http://a.example/4", ""),
    (7, "http://a.example/5", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 10),
    (8, "http://a.example/6", "ü" * 3_000_000),
    (10, "http://a.example/7", "x" * 100),
    (11, "http://a.example/7", "x" * 100),
    (12, "http://a.example/7", "x" * 99),
    (13, "http://a.example/7", "x" * 99),
    (3, "http://a.example/again", LONG),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")


def expected():
    first = {}
    for i, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        revisit = data in first and i != first[data]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


def test_archives_of_table(spark, sf_dir, duck, same):
    same(warc.query(spark, sf_dir), duck.sql(warc.ORACLE_SQL))


def test_archives_give_back_pages(spark, pages, tmp_path):
    at = str(tmp_path / "archive")
    warc.archive(pages, at)
    assert sorted((tuple(r) for r in warc.read_pages(spark, at).collect()), key=str) == expected()
    payloads = {r.record_id: bytes(r.payload) for r in warc.read(spark, at, "record_type = 'response'").collect()}
    assert payloads["<urn:page:7>"] == PAGES[8][2].encode()
    assert payloads["<urn:page:4>"] == b""
    targets = {r.record_id: r.target_uri for r in warc.read(spark, at).collect()}
    assert targets["<urn:page:3>"] in ("http://a.example/%C3%A4%20b%0D%0AX:%20y", "http://a.example/again")
    assert targets["<urn:page:9>"] is None


def test_archives_of_nothing(spark, pages, tmp_path):
    at = str(tmp_path / "archive")
    warc.archive(pages.limit(0), at)
    assert warc.read_pages(spark, at).collect() == []


def test_predicates_reach_the_reader(spark, pages, tmp_path):
    at = str(tmp_path / "archive")
    warc.archive(pages, at)
    read = lambda *a, **k: warc.read(spark, at, *a, **k)
    kept = read("record_type = 'revisit' AND payload_length >= 100 AND refers_to IN ('<urn:page:3>', '<urn:page:x>')")
    assert sorted(r.record_id for r in kept.collect()) == ["<urn:page:5>", "<urn:page:9>", "<urn:page:>"]
    assert "Filter (" not in kept._jdf.queryExecution().executedPlan().toString()  # the reader does it all
    assert read("target_uri LIKE 'http://a.example/2%'").count() == 2
    assert read("target_uri IS NULL").count() == 1
    assert read("payload_length < 100 AND length(http) > 0").count() == 6
    assert read("payload IS NOT NULL", payloads=False).count() == 0
    assert read(payloads=False).count() == len(PAGES)


class Watched:
    """An archive that counts what is read of it."""

    def __init__(self, data):
        import io

        self.file, self.got = io.BytesIO(data), 0

    def read(self, n):
        x = self.file.read(n)
        self.got += len(x)
        return x

    def seek(self, n):
        self.file.seek(n)

    def tell(self):
        return self.file.tell()


def responses(n, size):
    import random

    rng = random.Random(1)
    for i in range(n):
        yield {"record_type": "response" if i % 10 else "metadata", "record_id": f"<urn:page:{i}>", "payload_length": size, "payload": rng.randbytes(size)}


def test_unwanted_payloads_are_skipped():
    data = b"".join(warc.member(warc.record(r)) for r in responses(50, 200_000))
    early = [warc.EqualTo(("record_type",), "metadata")]
    file = Watched(data)
    got = list(warc.records(file, early, [], True))
    assert [r["record_id"] for r in got] == [f"<urn:page:{i}>" for i in range(0, 50, 10)]
    assert file.got < len(data) * 0.7  # a few KB of each record that fails
    assert len(got[0]["payload"]) == 200_000


def test_foreign_archives(spark, tmp_path):
    """Members without lengths in front, plain files, folded headers, other records than HTTP's."""
    import gzip

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nX-Note: one\r\n two\r\nContent-Length: 7\r\n\r\nsoft: x\r\n\r\n"
    response = warc.record({"record_type": "response", "record_id": "<urn:r>", "payload_length": 5, "payload": b"hello"})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(response))
    (tmp_path / "b.warc").write_bytes(info + response)
    (tmp_path / "other.txt").write_bytes(b"no archive")
    at = str(tmp_path)
    assert sorted((r.record_type, bytes(r.payload)) for r in warc.read(spark, at).collect()) == [("response", b"hello")] * 2 + [("warcinfo", b"soft: x")] * 2
    assert warc.read(spark, at, "record_type = 'response'").count() == 2
    (tmp_path / "c.warc").write_bytes(response[:-20])
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, at).collect()
