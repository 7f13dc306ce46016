"""Whitening, spelling variants and SentencePiece ids against brute force, on odd rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import pieces, queries, spelling, whitening

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ("k", "v", "w", "i", "n", "d", "x", "word", "key", "block", "no", "seq", "ids", "component", "gram", "form", "len", "deviation")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


def whitened(rows, components=16):
    """The contract by numpy and Python's integers: {(vec_id, component): row}."""
    kept = [(k, [float(c) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    value, unit = np.linalg.eigh(c.T @ c / n)
    value, unit = value[::-1][:components], unit[:, ::-1][:, :components]
    w = ((n * x - s) / n) @ unit / np.sqrt(value)
    dev = [sum(int(v) ** 2 for v in r) for r in n * x - s]
    share = value / (sum(int(v) ** 2 for r in n * fit - s for v in r) / n**3)
    return [(k, j + 1, n, dev[i], w[i, j], share[j]) for i, (k, _) in enumerate(kept) for j in range(len(value))]


def same_vectors(got, want):
    """Equal rows, each component up to its sign."""
    order = lambda r: (str(r[0]), r[1], abs(r[4]))
    got, want = sorted([tuple(r) for r in got], key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    sign = {}
    for g, w in zip(got, want, strict=True):
        if abs(w[4]) > 1e-3:
            sign.setdefault(g[1], np.sign(g[4] * w[4]))
        assert abs(g[4] * sign.get(g[1], 1) - w[4]) < 1e-8 * max(1, abs(w[4])) and g[5] == pytest.approx(w[5], rel=1e-9)
    assert all(r[6] < 1e-8 for r in got)


def test_whitening_is_that_of_numpy(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    same_vectors(whitening.op11_whiten(spark, SMALL).collect(), whitened([(r.vec_id, r.embedding) for r in table.collect()]))


def test_whitening_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(3, 2), rng.gauss(0, 40)]) for i in range(60)]
    rows += [rows[0], (None, rows[1][1]), (7, rows[2][1])] + [(200 + i, [0.5, 0.25, 0.125]) for i in range(40)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 1.0, 1.0]), (93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1.0, 2.0])]
    table = clashing(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")).repartition(3)
    plain = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding is None or len(r.embedding) == 3]
    same_vectors(whitening.whiten(table).collect(), whitened(plain))
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.filter("vec_id in (90, 91, 94)")).count() == 0
    flat = whitening.whiten(table.filter("vec_id >= 200")).collect()
    assert len(flat) == 120 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, 0.0) for r in flat)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id bigint, embedding array<double>")).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and len(line) == 18


def test_whitening_of_huge_and_wide_entries(spark):
    rows = [(i, [1e30 * (-1) ** i, 1e9 + i, float(i % 7)]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 150 and {r.deviation for r in got} == {None} and all(abs(r.identity_error) < 1e-4 for r in got)


def spelled(rows, length=6, least=5):
    """The contract by all pairs."""
    count = Counter()
    for k, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if k is None else k}:{r}".encode())
            count[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 199 == 0 else r] += 1
    n = {w: c for w, c in count.items() if len(w) >= length and c >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        return a != b and (any(b[:i] + b[i + 1 :] == a for i in range(len(b))) if len(a) + 1 == len(b) else len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)

    beside = {a: [b for b in n if near(a, b)] for a in n}
    best = {a: min(b, key=lambda w: (-n[w], w)) for a, b in beside.items() if b}
    form = {a: b for a, b in best.items() if n[b] >= 5 * n[a]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(beside[w]), n[form[w]] if w in form else None) for w in n)


def test_spelling_is_that_of_all_pairs_and_of_sql(spark):
    got = sorted(map(tuple, spelling.op12_spelling(spark, SMALL).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    wanted = sorted(con.execute(queries.oracle_sql()["op12_spelling"]).fetchall())
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(wanted) == key(spelled([(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]))


def test_spelling_of_repeated_bigrams_chains_and_odd_rows(spark):
    rng = random.Random(11)
    words = {w: rng.choice((5, 6, 30, 150)) for w in ("".join(rng.choice("abÀé") for _ in range(rng.randint(6, 8))) for _ in range(220))}
    words |= {"chainaaaa": 5, "chainaaab": 25, "chainaabb": 125, "chainabbb": 625, "tieaaaaaa": 5, "tieaaaaab": 40, "tieaaaaac": 40, "aaaaaaaaaa": 9, "aaaaaaaaa": 99}
    rows = [(None if w == "tieaaaaaa" else 1000 + i, f" {w.upper() if w.isascii() else w}\n" * n) for i, (w, n) in enumerate(words.items())]
    rows += [(1, None), (2, ""), (3, "short " * 9), (4, "x" * 300_000 + " " + "über0über " * 7), (5, "×÷×÷×÷ " * 8)]
    table = clashing(spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string")).repartition(4)
    got = spelling.variants(table).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, spelled(rows + rows[:3])))
    assert {r.word: r.root for r in got}["chainaaaa"] == "chainabbb" and {r.word: r.form for r in got}["tieaaaaaa"] == "tieaaaaab"
    assert spelling.variants(table.limit(0)).count() == 0


def coded(rows):
    from sentencepiece import SentencePieceProcessor

    model, out = SentencePieceProcessor(model_file=MODEL), []
    for k, t in rows:
        ids = model.encode(t or "")
        out.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    return sorted(map(str, out))


def test_pieces_are_those_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(str(tuple(r)) for r in pieces.op13_pieces(spark, SMALL).collect()) == coded([(r.doc_id, r.text) for r in docs.collect()])


def test_pieces_of_odd_texts(spark):
    rng = random.Random(3)
    letters = [" ", "  ", "▁", "\n", "\t", "a", "the", "é", "漢字", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "　", "é", "1", "..", "�"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " "), (503, "   "), (504, "▁"), (None, "no id"), (505, "w" * 200_000), (506, "word " * 40_000), (507, " " * 5000)]
    table = clashing(spark.createDataFrame(rows + rows[:4], "doc_id bigint, text string")).repartition(3)
    wanted = coded(rows + rows[:4])
    for size in (pieces.BLOCK_CHARS, 50):
        assert sorted(str(tuple(r)) for r in pieces.encoded(table, MODEL, block_chars=size).collect()) == wanted
    assert pieces.encoded(table.limit(0), MODEL).count() == 0


def test_each_distinct_word_is_segmented_once(spark, monkeypatch):
    rows = [(i, "one two  three one") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    asked = pieces.numbered(table, MODEL, "text", "doc_id", 100, texts=False)
    assert {r.word for r in asked.collect()} == {"▁one", "▁two", "▁▁three"} and asked.count() > 9
    assert {r.no for r in asked.filter("word = '▁one'").collect()} == {0}
    own, calls = pieces.pieces(MODEL), []

    class Batches:
        """The asked words in batches of four, as one task gets them."""

        def __init__(self):
            import pyarrow as pa

            self.rows = pa.RecordBatch.from_pandas(asked.toPandas().sort_values("word", ignore_index=True))

        def repartition(self, _):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            return list(run(self.rows.slice(i, 4) for i in range(0, self.rows.num_rows, 4)))

    monkeypatch.setattr(pieces.Pieces, "encode", lambda self, words, f=pieces.Pieces.encode: calls.extend(words) or f(self, words))
    got = pieces.answers(Batches(), MODEL)
    assert sorted(calls) == ["▁one", "▁two", "▁▁three"] and own is pieces.pieces(MODEL)
    assert sum(b.column("n")[0].as_py() for b in got) == asked.count()


def test_packed_numbers_come_back():
    import numpy

    rng = numpy.random.default_rng(1)
    for a in ([], [0], [127, 128, 16383, 16384, 2097151, 2097152, 268435455], rng.integers(0, 1 << 28, 5000), rng.integers(0, 300, 5000)):
        assert pieces.unpack(pieces.pack(numpy.array(a, numpy.int64))).tolist() == list(a)


def test_texts_that_change_between_readings_fail(spark):
    table = spark.createDataFrame([(i, f"w{i}") for i in range(20)], "doc_id bigint, text string").repartition(2)
    sent = pieces.answers(pieces.numbered(table, MODEL, "text", "doc_id", 100, texts=False), MODEL)
    other = pieces.numbered(table.withColumn("text", F.concat("text", F.lit("x"))), MODEL, "text", "doc_id", 100, texts=True)
    with pytest.raises(Exception, match="read alike twice"):
        pieces.assembled(sent, other, MODEL, "bigint").collect()
