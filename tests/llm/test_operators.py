"""Small tests of the corpus operators: against brute force, SQL, and on odd tables."""

from __future__ import annotations

import collections
import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treeq.llm import ann, decontam, langid, linededup, mixing, quality, queries, sample, simhash, tokenstore, toxicity, urlfilter
from treeq.llm.common import Scratch, components

LONG = "lorem ipsum dolor sit amet " * 30_000
#: An id, a text, a language and a source; nulls in every place, repeated and equal rows.
ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \t\n ", "en", None),
    (4, "one two three four five six seven eight nine ten eleven twelve", "en", "b"),
    (4, "one two three four five six seven eight nine ten eleven twelve", "en", "b"),
    (5, "one two three four five six seven eight nine ten eleven twelve", "fr", None),
    (None, "one two three four five six seven eight nine ten eleven twelve\nmore", None, "c"),
    (6, LONG, "de", "c"),
    (7, "été ÀÉ ß 日本 😀 \x00 x", "fr", "b"),
]
EXTRA = ("__doc", "__th", "__score", "__key", "__copies", "__words", "__size", "__row", "__deleted", "doc", "th", "deleted", "score", "copies", "fp", "size", "words", "target", "rank", "key", "pos", "root", "place", "item_id", "embedding", "label", "n", "h", "list")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def sql_of(name, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        c.register(t, df.toArrow())
    return c.sql(queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name]))


# components


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark, "test")).collect()}
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


# 1


def test_decontamination_tolerates_substitutions(spark):
    item = [f"w{i}" for i in range(40)]
    changed = [w if i % 9 else "zzz" for i, w in enumerate(item)]
    docs = [(1, " ".join(["x"] * 50 + changed + ["y"] * 9)), (2, " ".join(f"w{i * 3 % 40}" for i in range(200))), (3, " ".join(item[:14]).upper()), (4, " ".join(item[20:27])), (None, " ".join(item))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (10, "an item of six words only")], "item_id long, text string")
    found = decontam.findings(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (3, 7), (None, 7)}
    assert {r["doc_id"] for r in decontam.decontaminate(d, b).collect()} == {2, 4}
    # one of six words may be substituted, two may not
    short = spark.createDataFrame([(1, "here: An item, of six words only!"), (2, "an item of seven words only"), (3, "an item of seven words maybe")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.findings(short, b).collect()) == [1, 2]


@pytest.mark.parametrize("n", range(5, 17))
def test_masks_miss_no_overlap(n):
    """Whichever words may be substituted, one mask fits between them."""
    lost = n - decontam.needed(n, 0.8)
    found = decontam.masks(n, lost)
    assert len(found) <= decontam.MASKS
    for gone in itertools.combinations(range(n), lost):
        assert any(not {at + i for i in mask} & set(gone) for mask in found for at in range(n - mask[-1]))


def test_decontamination_equals_all_alignments(spark):
    """Items of 5 to 14 words with every pattern of one or two substituted words, among words of other items."""
    items = {n: [f"i{n}w{i}" for i in range(n)] for n in range(4, 15)}
    docs = []
    for n, words in items.items():
        for k in (0, 1, 2, 3):
            for gone in itertools.combinations(range(n), k):
                if k < 3 or gone[0] == 0:
                    docs.append(["x"] * (len(docs) % 4) + ["zz" if i in gone else w for i, w in enumerate(words)] + items[4][:2])
    docs += [items[12][3:], items[13][:-2], items[14][2:] + items[5][1:]]
    want = {}
    for d, text in enumerate(docs):
        for n, item in items.items():
            if n < decontam.MIN_WORDS:
                continue
            w = min(n, decontam.WINDOW)
            for shift in range(-n, len(text)):
                same = [0 <= shift + j < len(text) and text[shift + j] == word for j, word in enumerate(item)]
                most = max(sum(same[j : j + w]) for j in range(n - w + 1))
                if most >= 0.8 * w:
                    want[d, n] = max(want.get((d, n), 0), most)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in decontam.findings(d, b).collect()} == want


def test_decontamination_without_broadcast(spark, sf_dir, monkeypatch):
    near = decontam.query(spark, sf_dir).collect()
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontam.query(spark, sf_dir).collect())) == sorted(map(tuple, near))


def test_decontamination_odd(odd, none, spark):
    items = spark.createDataFrame([(1, ODD[3][1], "x"), (None, None, "y")], "item_id long, text string, words string")
    assert {r["doc_id"] for r in decontam.findings(odd, items).collect()} == {4, 5, None}
    kept = decontam.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == 5
    assert decontam.findings(none, items).count() == 0 and decontam.decontaminate(odd, items.limit(0)).count() == len(ODD)


# 2


def brute(ids, x, k):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = n @ n[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [r for r in table.collect() if r["embedding"] is not None]
    want = brute(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float), 5)
    got = collections.defaultdict(list)
    for r in sorted(ann.query(spark, sf_dir).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q, v in got.items() for i, s in v if i in scores[q])


def test_neighbours_odd(spark):
    v = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (150, [2.0, 1.0])] + [(i, [1.0, 0.0]) for i in range(1, 40)]
    v += [(900, None), (901, [0.0, 0.0]), (902, [float("nan"), 1.0]), (903, [float("inf"), 1.0]), (904, [1.0, None]), (905, [1.0]), (None, [1.0, 1.0]), (950, [1e-300, 1e-300])]
    df = spark.createDataFrame([(*r, "x") for r in v], "vec_id long, embedding array<double>, rank string")
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[100] == [0, 1, 2, 3, 4] and len(got[150]) == 5 and set(got) == {0, 100, 150, 950}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.filter("vec_id = 150"), F.lit(True)).count() == 0


def test_probes_follow_the_data():
    rng = np.random.default_rng(6)
    even = ann.unit(rng.normal(size=(3000, 32)))
    middle = rng.normal(size=(40, 32))
    tight = ann.unit(middle[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 32)))
    few, many = (ann.probes_for(0.98, x[:200], x[200:], ann.centroids(x[200:], 40), 5) for x in (tight, even))
    assert few <= 5 and 20 <= many <= 40
    assert ann.probes_for(0.98, even[:0], even, even[:1], 5) == 1


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(5)
    x = ann.unit(rng.normal(size=(3000, 64))) @ ann.rotation(64)
    q = ann.unit(rng.normal(size=(40, 64))) @ ann.rotation(64)
    rows, cols = ann.scan(q, ann.blocked(x), 5)
    nearest = np.argsort(((q[:, None, :] - x[None]) ** 2).sum(axis=2), axis=1)[:, :5]
    found = set(zip(rows.tolist(), cols.tolist()))
    assert sum((i, int(j)) not in found for i in range(40) for j in nearest[i]) <= 10 and len(rows) <= 40 * 5
    few = ann.scan(q, ann.blocked(x[:3]), 5)
    assert sorted(zip(few[0].tolist(), few[1].tolist())) == [(i, j) for i in range(40) for j in range(3)]


def test_queries_stream_by_their_cells(spark, sf_dir, monkeypatch):
    """Small cells, batches and turns give what large ones do."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = sorted(map(tuple, ann.search(table, F.col("vec_id") % 50 == 0, recall=1.0).select("query_id", "vec_id").collect()))
    monkeypatch.setattr(ann, "CELL", 7)
    monkeypatch.setattr(ann, "QUERIES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = sorted(map(tuple, ann.search(table, F.col("vec_id") % 50 == 0, recall=1.0).select("query_id", "vec_id").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(set(got) & set(want)) >= 0.95 * len(want)


# 3


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_encode_equals_the_library(tokenizer):
    import pyarrow as pa

    path, t = tokenizer
    texts = ["don't stop.", "İstanbul Straße. ΣΑΣ. ΟΔΟΣ!", "a..b ... x.,! 12. 3.5 ½. é. é. क़.", "x<|endoftext|>. <|startoftext|>!", "A <|ENDOFTEXT|> b<|StartOfText|>.", "\u0130. \u0958. \ufb2a!", "tab\tnew\nline nbsp\xa0em\u2003", "", " lead trail ", "I'll we've'd 's O'Re.", "J̌. ﬁ. ſ. a̸. ǅ.", "\x0b\x0c\x1c\x85 z.", LONG[:200]]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in tokenstore.encode(pa.array(texts), path)] == want
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in tokenstore.encode(pa.array([*texts, None]), path, splits=False)] == [*want, []]


def test_store_round_trip(spark, odd, none, sf_dir, tokenizer, tmp_path):
    path, t = tokenizer
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    at = str(tmp_path / "store")
    tokenstore.write(docs, at, path)
    got = sorted(tokenstore.read_back(spark, at, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x or 0))
    start, want = 0, collections.Counter()
    for r in docs.collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    chunks = spark.read.parquet(f"{at}/chunks").select("key")
    assert chunks.count() == chunks.distinct().count()
    whole = {(r["doc_id"], zlib.crc32(np.frombuffer(bytes(r["ids"]), dtype="<u2").astype("<u4").tobytes())) for r in tokenstore.read_ids(spark, at, path).collect()}
    assert whole == {(d, c) for d, _, c in want}
    bad = str(tmp_path / "bad")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{at}/{part}").write.parquet(f"{bad}/{part}")
    spark.read.parquet(f"{at}/chunks").withColumn("payload", F.concat("payload", F.unhex(F.lit("0000")))).write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="differs"):
        tokenstore.read_back(spark, bad, path).collect()
    assert tokenstore.store_and_read(none).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49_000, 20_000).astype("<u2")
    ends = tokenstore.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= tokenstore.LONGEST and sizes[:-1].min() >= tokenstore.SHORTEST
    moved = tokenstore.cuts(np.concatenate([ids[:100], ids]))
    assert len({len(ids) - e for e in ends} & {len(ids) + 100 - e for e in moved}) > 0.9 * len(ends)


# 4, 6 and 8


def test_quality(spark, sf_dir, odd, none):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    big = sf_dir.replace("sf0.001", "sf0.01")
    scored = quality.query(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
    model = quality.fit(docs, labels)
    # labels of held-out rows teach nothing
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = quality.fit(docs, labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(model.weights, flipped.weights)
    rows = odd.select("doc_id", quality.score(odd, model).alias("s")).collect()
    assert len(rows) == len(ODD) and all(0 <= r["s"] <= 1 for r in rows)
    assert quality.keep_good(odd, labels).columns == odd.columns and quality.keep_good(none, labels).count() == 0
    assert quality.fit(docs, labels.limit(0)).scores([[]])[0] == pytest.approx(0.5)
    assert len(quality.terms_of(None)) == len(quality.terms_of(" ")) == 0


def sparse(rows):
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate([np.asarray(r, dtype=np.int32) for r in rows])


def test_quality_by_brute_force():
    """Ratios by counting, and the dual's maximum by gradient steps over dense rows."""
    rng = np.random.default_rng(3)
    rows = [sorted({int(x) for x in rng.integers(0, 30, 8)} | ({31} if i % 3 else {32}) | ({33} if rng.random() < 0.5 else set())) for i in range(60)]
    y = np.array([int(i % 3 > 0) ^ int(rng.random() < 0.1) for i in range(60)])
    starts, terms = sparse(rows)
    ratio = quality.log_ratios(starts, terms, y)
    share = {k: {t: 1 + sum(t in r for r, c in zip(rows, y) if c == k) for t in range(40)} for k in (0, 1)}
    total = {k: sum(v.values()) + quality.DIMS - 40 for k, v in share.items()}
    for t in range(40):
        want = np.log(share[1][t] / total[1]) - np.log(share[0][t] / total[0]) if sum(t in r for r in rows) >= quality.LEAST else 0.0
        assert ratio[t] == pytest.approx(want)
    sign = np.where(y == 1, 1.0, -1.0)
    w, bias, alpha = quality.descend(starts, terms, sign, ratio, 0.1, 2000, least=1e-10)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    x[:, 40] = 1.0
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    plain = np.zeros(60)
    for _ in range(5_000):
        plain = np.clip(plain + (1 - q @ plain) / np.linalg.norm(q, 2), 0, 0.1)
    value = lambda a: a.sum() - a @ q @ a / 2
    assert value(plain) <= value(alpha) + 1e-9 and value(alpha) == pytest.approx(value(plain), rel=1e-4)
    assert np.allclose(np.append(w[:40], bias), (alpha * sign) @ x)
    slack = 1 - q @ alpha
    assert np.all(slack[alpha < 1e-9] < 1e-6) and np.all(slack[alpha > 0.1 - 1e-9] > -1e-6) and np.all(np.abs(slack[(alpha > 1e-9) & (alpha < 0.1 - 1e-9)]) < 1e-6)


def test_quality_terms_by_definition():
    text = "The cat, the CAT! Cat! Cat! 3.5"
    words = text.split()
    shapes = [quality.code(w) >> 32 for w in words]
    shapes[5] = quality.SAME
    plain = [quality.code(w) & 0xFFFFFFFF for w in words]
    for w in ("abc", "ABC", "Abc", "aBc", "É", "Éa", "abc.", "abc!!!", "abc.,", "(abc)", "...", "3.5"):
        assert quality.code(w) >> 32 == zlib.crc32(quality.shape(w).encode()) & ~1
    assert plain[0] == plain[2] and plain[1] == plain[3] == plain[4] and shapes[1] != shapes[3]
    one = lambda tag, *parts: quality.grams(tag, *[np.array([p], dtype=np.uint64) for p in parts])[0]
    want = {one(n, *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)} | {one(3 + n, *plain[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}
    assert set(quality.terms_of(text).tolist()) == want


def test_shapes():
    assert [quality.shape(w) for w in ("Word,", "WORD!!", "a***", "3.14", "naïve", "ÀÉx", "a-1-b-2-c-3-d")] == ["Aa,", "A!!", "a**", "9.9", "a", "Aa", "a-9-a-9-a-9-a"]


def test_toxicity(spark, sf_dir, odd, none):
    big = sf_dir.replace("sf0.001", "sf0.1")
    scored = toxicity.query(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] for r in scored if r["toxic"] == 1]) >= 0.93
    assert np.mean([r["predicted"] for r in scored if r["toxic"] == 0]) <= 0.005
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = odd.select(toxicity.score(odd, model).alias("s")).collect()
    assert len(rows) == len(ODD) and all(0 <= r["s"] <= 1 for r in rows)
    assert none.select(toxicity.score(none, model)).count() == 0
    assert toxicity.fit(docs.limit(0), labels).score([]) < 0.3


def test_samples_keep_whole_texts(spark):
    long = " ".join(f"{i:x}z" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for terms in (toxicity.terms_of, quality.terms_of):
        starts, found, y = sample.labelled(docs, labels, "toxic", F.lit(True), terms)
        assert found[: starts[1]].tolist() == list(terms(long)) and found[starts[1] :].tolist() == list(terms("a b")) and y.tolist() == [1, 0]
    assert len(toxicity.terms_of(long)) > 20_000


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(10))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    starts, _, y = sample.labelled(docs, labels, "toxic", F.lit(True), lambda t: range(len(t.split())), total=105)
    assert len(y) == 10 and starts[-1] == 100


def test_margins_are_sums_over_pairs():
    rng = np.random.default_rng(9)
    m = toxicity.FactorizationMachine(np.arange(50), 0.3, rng.normal(size=50), rng.normal(size=(50, toxicity.RANK)))
    for size in (0, 1, 2, 17):
        at = rng.choice(50, size, replace=False)
        want = 0.3 + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(at, 2))
        assert m.margin(at) == pytest.approx(want)


def test_pairs_are_learned():
    """Toxic only if exactly one of two words occurs: neither tells the classes apart alone."""
    rng = np.random.default_rng(0)
    vocab = [f"word{i}" for i in range(60)]
    docs, y = [], []
    for a, b in rng.integers(0, 2, (1200, 2)):
        docs.append(" ".join([*rng.choice(vocab, 12), *["alpha"] * a, *["omega"] * b]))
        y.append(int(a != b))
    rows, y = [toxicity.terms_of(t) for t in docs], np.array(y)
    starts, terms = sparse(rows[:900])
    model = toxicity.fitted(starts, terms, y[:900])
    assert model.place[toxicity.slot("w alpha")] >= 0 and model.place[toxicity.slot("w omega")] >= 0
    scores = np.array([model.score(r) for r in rows[900:]])
    assert np.mean((scores >= 0.5) == y[900:]) > 0.95
    assert model.texts(docs[900:], {}) == pytest.approx(scores.tolist())
    additive = toxicity.FactorizationMachine(model.place, model.bias, model.weights, np.zeros_like(model.factors))
    assert np.mean([(additive.score(r) >= 0.5) == c for r, c in zip(rows[900:], y[900:])]) < 0.8


def test_one_strong_term_is_enough():
    """Among terms of few documents, however many; weak terms stay in the fit."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(1500):
        bad = i % 10 == 0
        rows.append(sorted({*rng.integers(1000, 60_000, rng.integers(5, 400)).tolist(), *([int(rng.integers(0, 8))] if bad else [])}))
        y.append(int(bad))
    y = np.array(y)
    starts, terms = sparse(rows[:1000])
    strong = toxicity.strengths(np.repeat(np.arange(1000), np.diff(starts)), terms, y[:1000])
    assert ((strong > 0) <= (np.bincount(terms, minlength=toxicity.DIMS) >= 2)).all() and strong[:8].min() > 5 * np.median(strong[1000:60_000][strong[1000:60_000] > 0])
    model = toxicity.fitted(starts, terms, y[:1000])
    scores = np.array([model.score(r) for r in rows[1000:]])
    assert ((scores >= toxicity.LEAST) == y[1000:]).mean() > 0.97


def test_toxic_terms():
    """Words, their first letters, and beginnings that two words share."""
    s = toxicity.slot
    want = {s("w abcdef"), s("4 abcd"), s("5 abcde"), s("w abcdxyz"), s("5 abcdx"), toxicity.shared(s("4 abcd")), s("w ab")}
    assert set(toxicity.terms_of("Abcdef, abcdxyz (ABCDEF) ab")) == want


def test_languages(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.profiles(docs.select("doc_id", "text", "lang"), F.lit(True))
    counts = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        counts[r["lang"]].update(langid.codes(r["text"] or "").tolist())
    want = {lang: [c for c, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[: langid.TOP]] for lang, n in counts.items() if lang}
    assert {k: v.tolist() for k, v in found.items()} == want
    rows = odd.select("doc_id", langid.predict(odd, found).alias("p")).collect()
    assert len(rows) == len(ODD) and [r["p"]["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    joined = docs.select("lang", langid.predict(docs, found).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang_pred"] for r in joined]) > 0.95
    # by brute force, with plain ranks
    profiles, text = langid.Profiles(found), docs.filter("length(text) > 500").first()["text"]
    own = [c for c, _ in sorted(collections.Counter(langid.codes(text).tolist()).items(), key=lambda x: (-x[1], x[0]))[: langid.TOP]]
    out = {lang: sum(abs(i - p.index(c)) if c in p else langid.TOP for i, c in enumerate(own)) for lang, p in want.items()}
    best = min(sorted(out), key=out.get)
    assert profiles.predict(text) == (best, pytest.approx(1 - out[best] / (langid.TOP * len(own))))
    assert langid.profiles(none, F.lit(True)) == {} and langid.Profiles({}).predict("text") == ("und", 0.0)


# 5


def test_simhash(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                up[top(a)] = top(b)
    least: dict = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    want = [(d, f"{f:016x}", least.get(top(f))) for d, f in rows]
    assert sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got))) == sorted(map(str, want))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 6, 7, None} and kept.count() == 5
    one_id = spark.createDataFrame([(1, "a b c d e f"), (1, "quite another text with other words in it"), (1, "a b c d e f")], "doc_id long, text string")
    assert simhash.one_of_each(one_id).count() == 2


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick\tBROWN fox jumps over Été the lazy dog again and again and again"
    words = "the quick brown fox jumps over Été the lazy dog again and again and again".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == bits and simhash.fingerprint("a b") == xxhash.xxh64_intdigest("a b", 42) and simhash.fingerprint(" ") == 0


def test_crowds_link_the_same(spark):
    rng = np.random.default_rng(4)
    center = int(rng.integers(0, 1 << 62))
    near = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (60, 3))}
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in near] + [int(x) for x in rng.integers(0, 1 << 62, 40)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = Scratch(spark, "test")
    pairs = {(r["a"], r["b"]) for r in simhash.links(df, scratch).collect()}
    mask = (1 << 64) - 1
    assert pairs == {(a, b) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 4}
    stars = components(simhash.links(df, scratch, crowd=3).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), scratch)
    whole = components(simhash.links(df, scratch).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), scratch)
    assert sorted(map(tuple, stars.collect())) == sorted(map(tuple, whole.collect()))


def test_crowds_keep_those_at_their_edge(spark):
    """A fingerprint whose one chain to a crowd starts at the crowd's key, which it only asks for."""
    crowd = [i << 26 | i << 45 | 1 << 52 for i in range(1, 9)]
    edge = crowd[0] ^ (1 << 13) ^ (1 << 26) ^ (1 << 39) ^ (1 << 52)
    df = spark.createDataFrame([(x,) for x in (*crowd, edge)], "fp long")
    every = {frozenset((a, b)) for a in (*crowd, edge) for b in (*crowd, edge) if a != b and (a ^ b).bit_count() <= 4}
    found = {frozenset((r["a"], r["b"])) for r in simhash.links(df, Scratch(spark, "test"), crowd=3).collect()}
    assert any(edge in x for x in every) and {x for x in found if edge in x} == {x for x in every if edge in x}


# 7


def test_urls_odd(spark, same):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com", "https://x.net/es/a", "https://x.net/Es/", "ftp://net?/es/", "a://b://com/", "http://notexample.com/en/", "http://com/", "http://.net/fr/q", "http://x.net/fr/q"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*urls, *urls])], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(urlfilter.RULES, "verdict string, host string, path string")
    same(urlfilter.judge(pages, rules), sql_of("op7_url_filter", pages=pages))
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_large_url_lists(spark, monkeypatch):
    """A filter that is joined by block finds what one in the row finds."""
    pages = spark.createDataFrame([(i, f"http://{'a.' * (i % 3)}h{i % 50}.org/p{i % 7}/x") for i in range(300)], "page_id long, url string")
    rules = spark.createDataFrame([("block", f"h{i}.org", f"/p{i % 5}") for i in range(40)], "verdict string, host string, path string")
    want = sorted(map(str, urlfilter.judge(pages, rules).collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    assert sorted(map(str, urlfilter.judge(pages, rules).collect())) == want and sum("block" in x for x in want) == sum(i % 50 < 40 and i % 7 == (i % 50) % 5 for i in range(300))


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    words = urlfilter.bloom(keys, 100)
    asked = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("block", urlfilter.block_of(F.col("key"), 100))
    passed = asked.join(words, "block").filter(F.col("word").bitwiseAND(urlfilter.bits_of(F.col("key"))) == urlfilter.bits_of(F.col("key")))
    ids = {r["id"] for r in passed.collect()}
    assert set(range(500)) <= ids and len(ids) < 700


# 9


def test_lines_odd(spark, same):
    run = "first line of six words here\nsecond line of six words here\n\nthird"
    texts = [run, f"intro\n{run}\nend", run, None, "", "\n \n", "short\nshort\nshort", "ten words in one line are enough to count here", "x\nten words in one line are enough to count here\ny", "a b c d e\nf g h i j\na b c d e\nf g h i j"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    got = linededup.deleted_lines(docs).select(
        F.col("__doc").alias("doc_id"), F.col("__n").cast("long").alias("n_lines"), F.coalesce(F.size("__deleted"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.array_join("__deleted", ","), F.lit("")).alias("deleted_lines")
    )
    same(got, sql_of("op9_line_dedup", documents=docs))
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert kept[0] == run and kept[1] == "intro\n\nend" and kept[3] is None and kept[8] == "x\ny" and kept[9] == "a b c d e\nf g h i j"
    assert linededup.dedup_lines(docs).columns == docs.columns


def test_lines_tables(odd, none, spark):
    assert linededup.dedup_lines(odd).count() == len(ODD)
    assert linededup.dedup_lines(none).count() == 0
    twice = spark.createDataFrame([(1, "w " * 20), (1, "w " * 20)], "doc_id long, text string")
    assert [r["text"] for r in linededup.dedup_lines(twice).collect()] == ["w " * 20] * 2


def test_lines_closing(spark):
    """All lines of the longest runs that an earlier place holds, by brute force."""
    head, end = " ".join(["word"] * 12), "a short end"
    docs = spark.createDataFrame([(0, f"{head}\n{end}"), (1, f"x\n{head}\n{end}\ny")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == {0: f"{head}\n{end}", 1: "x\ny"}
    rng = np.random.default_rng(5)
    made = [[" ".join([f"v{x}"] * (1 + x % 4)) for x in rng.integers(0, 5, n)] for n in (12, 40, 30, 25, 7)]
    made += [made[1][5:30] + ["once"] + made[2], made[3][:-1], made[4]]
    want = {i: set() for i in range(len(made))}
    for (d, p), (e, q) in itertools.combinations([(d, p) for d, text in enumerate(made) for p in range(len(text))], 2):
        same = list(itertools.takewhile(lambda x: x[0] == x[1], zip(made[d][p:], made[e][q:])))
        if sum(len(x.split()) for x, _ in same) >= 10:
            want[e] |= set(range(q, q + len(same)))
    table = spark.createDataFrame([(i, "\n".join(text)) for i, text in enumerate(made)], "doc_id long, text string")
    got = {r["__doc"]: set(r["__deleted"] or []) for r in linededup.deleted_lines(table).collect()}
    assert got == want and got != {r["__doc"]: set(r["__deleted"] or []) for r in linededup.deleted_lines(table, closing=False).collect()}


def test_suffix_array(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "\n".join(f"l{x}" for x in rng.integers(0, 4, 30))) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = linededup.suffix_array(linededup.with_lines(df), 64, Scratch(spark, "test")).collect()
    lines = {r["__doc"]: {} for r in got}
    for r in got:
        lines[r["__doc"]][r["seq"]] = (r["h"], r["g"])
    suffix = {(r["__doc"], r["seq"]): [lines[r["__doc"]][s] for s in range(r["seq"], 30)] for r in got}
    rank = {(r["__doc"], r["seq"]): r["rank"] for r in got}
    order = sorted(suffix, key=suffix.get)
    assert len(got) == 180 and all((rank[a] < rank[b]) == (suffix[a] < suffix[b]) for a, b in zip(order, order[1:]))


# 10


def test_mixing_odd(odd, none, same):
    same(mixing.digest(odd.dropDuplicates(["doc_id"])), sql_of("op10_source_mixing", documents=odd.dropDuplicates(["doc_id"]).select("doc_id", "text", "source")))
    rows = mixing.digest(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mixing.digest(none).count() == 0
    assert mixing.mixed(odd, F.array("source")).columns == odd.columns


def test_mixing_meets_targets(spark, sf_dir):
    taken = collections.Counter()
    target = {}
    largest = 0
    for r in mixing.query(spark, sf_dir.replace("sf0.001", "sf0.01")).collect():
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        largest = max(largest, r["size"])
    assert all(abs(taken[s] - target[s]) <= largest for s in target)


def test_quotas_by_dealing_anew():
    rng = np.random.default_rng(6)
    for _ in range(50):
        sizes = {i: int(x) for i, x in enumerate(rng.integers(1, 1000, 9))}
        weights = {i: mixing.WEIGHTS[i % 3] for i in sizes}
        goal = 1.5 * sum(sizes.values())
        left, open_, want = goal, set(sizes), dict.fromkeys(sizes, 0.0)
        while left > 1e-9:
            total = sum(weights[i] for i in open_)
            add = {i: left * weights[i] / total for i in open_}
            left = 0.0
            for i, a in add.items():
                want[i] += a
                if want[i] > 2 * sizes[i]:
                    left += want[i] - 2 * sizes[i]
                    want[i] = 2.0 * sizes[i]
            open_ = {i for i in open_ if want[i] < 2 * sizes[i]}
        got = mixing.quotas(sizes, weights, goal)
        assert all(abs(got[i] - want[i]) < 1e-6 * goal for i in sizes)


def test_flow_prefers_first_passes():
    # the shared pattern fills the gap of the small source before anything repeats
    assert mixing.route([10, 10, 10], [[0], [1], [0, 1]], [15, 15], 2) == [10, 10, 10]
    assert sum(mixing.route([10, 10], [[0], [0, 1]], [5, 30], 2)) == 25


def test_flow_is_least_cost():
    """Against all integer flows of small cases: most words, then fewest repeated ones."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        supply = rng.integers(0, 4, 3).tolist()
        member = [sorted(set(rng.integers(0, 3, 2).tolist())) for _ in supply]
        demand = rng.integers(0, 6, 3).tolist()
        best = None
        for flow in itertools.product(*[range(2 * s + 1) for s in supply]):
            # a flow fits if no set of patterns sends more than their sources ask
            if all(sum(flow[i] for i in some) <= sum(demand[s] for s in {s for i in some for s in member[i]}) for k in (1, 2, 3) for some in itertools.combinations(range(3), k)):
                worth = sum(flow), -sum(max(0, f - s) for f, s in zip(flow, supply))
                best = max(best or worth, worth)
        got = mixing.route(supply, member, demand, 2)
        assert (sum(got), -sum(max(0, f - s) for f, s in zip(got, supply))) == best


def test_mixing_as_tables(spark, odd, monkeypatch):
    """Quotas and flows computed as tables give what the driver does; so do overlapping sources."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 37}" if i % 11 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    some = mixing.sized(docs, F.when(F.col("doc_id") % 5 == 0, F.array("source", F.lit("s1"))).otherwise(F.array("source")))
    key = lambda df: sorted(map(str, df.collect()))
    cols = ["doc_id", "__copies", "__total", "__target"]
    want = key(mixing.digest(docs)), key(mixing.digest(odd)), key(mixing.mix(some).select(*cols))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 0)
    assert (key(mixing.digest(docs)), key(mixing.digest(odd)), key(mixing.mix(some).select(*cols))) == want
    assert mixing.digest(docs.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "MAX_ROUTED", 3)
    with pytest.raises(ValueError):
        mixing.mix(some)


def test_names_are_kept(odd, spark, sf_dir):
    """Columns that operators also use come back with their values."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = spark.createDataFrame([(1, ODD[3][1])], "item_id long, text string")
    for made in (linededup.dedup_lines(odd), decontam.decontaminate(odd, items), quality.keep_good(odd, labels, 0.0), simhash.one_of_each(odd), mixing.mixed(odd, F.array("source"))):
        assert made.columns == odd.columns and made.schema.simpleString() == odd.schema.simpleString()
        rows = made.collect()
        assert rows and all(r[c] == "x" for r in rows for c in EXTRA)
