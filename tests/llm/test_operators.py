"""Each operator on nulls, empty texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, lines, lm, media, mixing, nearcopies, quality, sharding, simhash, tokenize, trie, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
TEXTS = [None, "", "  \n\t ", TEXT, TEXT, TEXT + " sixteen", "Ünïcode ß " * 40, "word " * 6000, "a\nb\n" + TEXT, "x" * 577]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, shard string, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 4}", None, "clash", "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "no id at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_media_round_trip(docs, empty):
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_columns(docs).collect())
    want = []
    for i, t in texts(docs):
        b = t.encode()
        p = b.ljust(max(1, -(-len(b) // 576)) * 576, b"\xff")
        want.append((str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want)
    assert media.media_columns(empty).count() == 0


def test_mix_reaches_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts(docs)) and Counter(r.size for r in rows) == Counter(len(WORD.findall(t)) for _, t in texts(docs))
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    total = sum(r.size for r in rows)
    targets = {(r.source): (r.target, r.source_size) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 for t, s in targets.values())
    assert sum(r.taken for r in rows) <= 1.5 * total + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_cut_mix_is_that_of_brute_force(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for d in (table, docs.select("doc_id", "text", "source")):
        given = d.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h")).collect()
        size = {}
        for r in given:
            size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
        order = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
        weight, most = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 2 * n for s, n in size.items()}
        left, open_, target = 1.5 * sum(size.values()), set(order), {}
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if most[s] < weight[s] * level}
            for s in full or open_:
                target[s] = most[s] if full else weight[s] * level
                left -= target[s] if full else 0
            open_ = open_ - full if full else set()
        want = Counter()
        for s in order:
            at, queue = 0, sorted((r for r in given if r.source == s), key=lambda r: (r.h, r.doc_id is not None, r.doc_id, len(WORD.findall(r.text or ""))))
            took = [0] * len(queue)
            for _ in (0, 1):
                for i, r in enumerate(queue):
                    n = len(WORD.findall(r.text or ""))
                    took[i] += max(0, min(n, math.floor(target[s] + 1e-9) - at))
                    at += n
            want.update((r.doc_id, len(WORD.findall(r.text or "")), size[s], round(target[s], 6), t) for r, t in zip(queue, took))
        got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(d, whole=False).collect())
        assert got == want
        assert all(r.taken <= 2 * r.size for r in mixing.mix(d, whole=False).collect())


def test_cut_mix_serves_packets_by_finish_time(spark, monkeypatch):
    """A document taken in part, or given back in part, is the one at its source's edge; all others are served up to the cut."""
    cuts, find = [], mixing._cut
    monkeypatch.setattr(mixing, "_cut", lambda *a: cuts.append(find(*a)) or cuts[-1])
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cut = {(r.doc_id, r.source): r for r in mixing.mix(table, whole=False).collect()}
    served = {(r.doc_id, r.source): r.taken for r in mixing.mix(table).collect()}
    assert len(cuts) == 2 and cuts[0] == cuts[1] and cuts[0] is not None
    apart = Counter(k[1] for k, r in cut.items() if r.taken != served[k])
    assert len(apart) > 1 and max(apart.values()) <= 2
    for s in {k[1] for k in cut}:
        own = [r for k, r in cut.items() if k[1] == s]
        assert sum(r.taken for r in own) == math.floor(own[0].target + 1e-9)


def test_shards_are_gapless_and_keep_equal_texts_together(docs, empty):
    rows = sharding.shard(docs, 3).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.text == TEXT}) == 1
    assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    assert sharding.shard(empty, 3).count() == 0


def best_capacity(sizes, n):
    for c in range(max(sizes), sum(sizes) + 1):
        k, cur = 1, 0
        for x in sizes:
            k, cur = (k + 1, x) if cur + x > c else (k, cur + x)
        if k <= n:
            return c


@pytest.mark.parametrize("sizes,n", [([5, 1, 1, 1, 9, 2, 2, 4], 3), ([1] * 10, 4), ([7], 3), ([3, 3, 3, 3, 100, 1, 1], 4)])
def test_minimax_cut(spark, sizes, n):
    row = sharding.cut_points(spark.createDataFrame([(i, i, b) for i, b in enumerate(sizes)], "o bigint, bucket int, b bigint"), n).first()
    assert row.capacity == best_capacity(sizes, n)
    cuts = [*row.starts, len(sizes)]
    assert len(row.starts) <= n and all(sum(sizes[a:b]) <= row.capacity for a, b in zip(cuts, cuts[1:]))


def test_simhash_components(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts(docs)) and by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16
    assert by[3].component_id == by[4].component_id == 3 and by[1].component_id == 0
    kept = simhash.deduplicated(docs).collect()
    assert len(kept) == len({r.component_id for r in rows})
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_of_similarity_from_0_8(spark, docs, empty):
    import random

    draw, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([60, 150, 600]))]
        rows.append((3 * i, " ".join(words)))
        at = draw.randrange(len(words) - 4)
        rows.append((3 * i + 1, " ".join(words[:at] + ["changed"] + words[at + 1 :]).upper() if i % 2 else " ".join(words)))
        rows.append((3 * i + 2, " ".join(words[: len(words) // 2] + [f"v{draw.randrange(10**6)}" for _ in words[len(words) // 2 :]])))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    for a in range(0, 180, 3):
        for b in (a + 1, a + 2):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert not 0.5 < j < 0.8 and (got[a] == got[b]) == (j >= 0.8), (a, b, j)
    assert len(set(got.values())) == 120
    assert len(nearcopies.near_copies(docs).collect()) == docs.count() and nearcopies.near_copies(empty).count() == 0
    kept = [r.doc_id for r in nearcopies.deduplicated(docs).collect()]
    assert kept.count(0) == 1 and kept.count(3) == 1 and not {1, 2, 4} & set(kept)


def family(shared, own, changed, pairs):
    """Texts of `shared` common words and `own` words of their own, each with a copy whose last `changed` words differ: ids 2 i and 2 i + 1."""
    rows, common = [], [f"c{k}" for k in range(shared)]
    for i in range(pairs):
        text = common + [f"t{i}x{k}" for k in range(own)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[: len(text) - changed] + [f"u{i}x{k}" for k in range(changed)]))]
    return rows


def copies(spark, rows):
    return {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_texts_that_share_boilerplate_are_no_near_copies(spark):
    got = copies(spark, family(204, 43, 18, 150))  # 0.70 within the family, 0.86 of each pair
    assert all(got[i] // 2 == i // 2 for i in got)


def test_near_copies_within_a_family_are_found(spark):
    got = copies(spark, family(204, 65, 20, 300))  # 0.61 within the family, 0.86 of each pair
    assert all(got[i] == i - i % 2 for i in got)


def test_pairs_just_from_0_8_are_found(spark):
    long = family(0, 104, 11, 400)  # 89 of 111 shingles
    short = [(1000 + 2 * i + k, " ".join(f"s{i}x{j}" for j in range(8 + k))) for i in range(400) for k in (0, 1)]  # 4 of 5
    got = copies(spark, long + short)
    for ids in (range(0, 800, 2), range(1000, 1800, 2)):
        assert sum(got[i] == got[i + 1] for i in ids) >= 0.98 * len(ids)
    assert all(got[i] // 2 == i // 2 for i in got)


def test_near_copies_come_from_the_trie_of_simhashes_too(spark, monkeypatch):
    import pyarrow as pa

    draw, rows = random.Random(12), []
    for i in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([5, 40, 400]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + words[-1:] * (1 + i % 3 * i)))]
    rows += [(100, "a b c d e f a b c d e f a b c d e f"), (101, "b c d e f a b c d e f a"), (102, None), (103, " ")]
    rows = [(i, t) for i, t in rows if i < 80] + rows[80:]
    values, sizes = nearcopies.shingle_sets(pa.RecordBatch.from_pydict({"t": [t for _, t in rows]}), "t", 5)
    at, fp, own = 0, {}, {}
    for (i, _), n in zip(rows, sizes.tolist(), strict=True):
        h, at = [int(x) for x in values[at : at + n]], at + n
        own[i], fp[i] = set(h), sum((2 * sum(x >> b & 1 for x in h) > n) << b for b in range(64))
    up = {i: i for i in fp}
    for a in sorted(fp):
        for b in sorted(fp):
            alike = own[a] == own[b] or own[a] and own[b] and (fp[a] ^ fp[b]).bit_count() <= 3 and 9 * len(own[a] & own[b]) >= 4 * (len(own[a]) + len(own[b]))
            if a < b and alike:
                up = {k: up[a] if x == up[b] else x for k, x in up.items()}
    monkeypatch.setattr(nearcopies, "band_links", lambda nodes: nodes.select(nodes.node.alias("a"), nodes.node.alias("b")).limit(0))
    got = copies(spark, rows)
    assert got == up and 5 < sum(got[i] == got[i + 1] and own[i] != own[i + 1] for i in range(0, 80, 2)) < 40 and got[100] == got[101] and got[102] == got[103]


def test_trie_joins_what_brute_force_joins():
    import numpy as np

    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    values = set()
    for _ in range(800):
        x = base
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            x ^= 1 << int(b)
        values.add(x)
    v = np.array(sorted(values), np.uint64)
    up = list(range(len(v)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(v)):
        for j in range(i + 1, len(v)):
            if (int(v[i]) ^ int(v[j])).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert trie.trie_links(v, 3).tolist() == [find(i) for i in range(len(v))]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, TEXT), (2, "two THREE"), (3, None), (4, ""), (2, "two THREE"), (5, "nowhere to be found")], "item_id bigint, text string")
    rows = {(r.doc_id, r.text): r for r in decontaminate.mark_contaminated(docs, items).collect()}
    r = rows[(3, TEXT)]
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.longest_match) == (15, 15, 2, True, 15)
    assert r.items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert rows[(0, None)].n_words == 0 and not rows[(0, None)].contaminated
    assert decontaminate.mark_contaminated(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.mark_contaminated(empty, items).count() == 0


def test_suffix_array_is_sorted_and_finds_all_places():
    import numpy as np

    rng = np.random.default_rng(5)
    words = rng.integers(1, 4, 400).astype(np.uint64)
    words[[60, 61, 200, 399]] = 0
    a = decontaminate.SuffixArray(words)
    a.deepen(20)
    text = [tuple(words[i : i + 20].tolist()) for i in range(400)]
    cut = [t[: t.index(0)] if 0 in t else t for t in text]  # order past a document's end does not matter
    for i, j in zip(a.sa, a.sa[1:]):
        n = min(len(cut[i]), len(cut[j]))
        assert cut[i][:n] <= cut[j][:n]
    for n in (1, 2, 5, 9):
        q = rng.integers(0, 390, 50)
        lo, hi = np.zeros(50, np.int64), np.full(50, 400)
        for k in range(n):
            lo, hi = a.narrow(lo, hi, k, np.maximum(words[q + k], 1))
        for x, i, j in zip(q, lo, hi):
            want = np.maximum(words[x : x + n], 1)
            assert sorted(a.sa[i:j].tolist()) == [p for p in range(401 - n) if (words[p : p + n] == want).all()]


def test_longest_verbatim_match_and_its_place(spark):
    item = " ".join(f"a{i}" for i in range(30))
    other = " ".join([f"a{i}" for i in range(14)] + [f"b{i}" for i in range(14)])
    items = spark.createDataFrame([(2, item), (10, other), (3, "short one")], "item_id bigint, text string")
    words = item.split()
    rows = [(1, "x y " + " ".join(words[3:25]) + " z"), (2, " ".join(words[:14]) + " " + " ".join(words[14:30])), (3, "short one short one"), (4, " ".join(words[:12])), (5, " ".join(words[5:18]) + " q " + " ".join(words[5:18])), (6, " ".join(words[:14]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("match_item", F.lit("clash"))
    got = {r.doc_id: (r.longest_verbatim, r.match_item, r.match_start, r.match_item_start) for r in decontaminate.mark_contaminated(docs, items).collect()}
    assert got == {1: (22, "2", 2, 3), 2: (30, "2", 0, 0), 3: (2, "3", 0, 0), 4: (0, None, None, None), 5: (13, "2", 0, 5), 6: (14, "10", 0, 0)}


def test_decontamination_is_what_sql_gives(spark):
    import duckdb

    from gradeloom.llm import queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = decontaminate.op10_decontaminate(spark, d)
    want = con.execute(queries.oracle_sql()["op10_decontaminate"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_tokens_are_those_of_whole_texts(docs, empty):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokenize.token_files(docs, path, file_bytes=4000).collect())
    ids = {x: [*t.encode(x, add_special_tokens=False).ids, 0] for _, x in texts(docs)}
    assert Counter((n, c) for _, n, c in got) == Counter((len(ids[x]), zlib.crc32(np.array(ids[x], "<u4").tobytes())) for _, x in texts(docs))
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and got[0][0] == 0
    assert tokenize.token_files(empty, path).count() == 0


def test_tokens_of_marks_digits_blanks_and_added_tokens():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, own = Tokenizer.from_file(path), tokenize.PieceEncoder(path)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "don't we'll 's x's", "½ ² a²b ٣٤", "  x　y \x1c\x1fz's  ", "", "日本語 テキスト１２", "’s naïve—test_1 a_b 3,14", " x\t\n y  ", "(so) she's… 'tis <b>", "e\u0301 \u200b \ufeff", "\n\n", " "]
    ids, n = own.encode(odd * 2, 0)
    want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in odd * 2]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert own.encode([], 0)[0].tolist() == [] and np.array_equal(own.encode(["x"], 7)[0][-1:], [7])


def test_language_model_base_score_is_exact(docs, empty):
    rows = lm.score_texts(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    toks = [(i, [*WORD.findall(t.lower().replace("ü", "Ü") if False else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)), "\n"]) for i, t in texts(docs)]
    count = Counter(w for i, ws in toks if not held(i) for w in ws)
    floor = sum(count.values()) + len(count) + 1
    want = sorted((len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 1) / floor) for w in ws), 4)) for _, ws in toks)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score <= 0 for r in rows) and lm.score_texts(empty).count() == 0


def test_language_model_scores_do_not_depend_on_the_filters_bound(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, r.score) for r in lm.score_texts(docs).collect())
    monkeypatch.setattr(lm, "RANGE_TEXT", 1 << 15)
    monkeypatch.setattr(lm, "FILTER_BYTES", 1 << 15)
    got = sorted((r.doc_id, r.score) for r in lm.score_texts(docs).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(a == pytest.approx(b, rel=0.02) for (_, a), (_, b) in zip(got, want, strict=True))


@pytest.mark.parametrize("head,filter_bytes", [(1 << 20, 1 << 24), (50, 64), (0, 0)])
def test_language_model_scores_are_those_of_brute_force(spark, monkeypatch, head, filter_bytes):
    monkeypatch.setattr(lm, "HEAD_TOKENS", head)
    monkeypatch.setattr(lm, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(lm, "RANGE_TEXT", 1 << 14)
    monkeypatch.setattr(lm, "SEND_AT", 5000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    toks = {i: [*WORD.findall(lower(t)), "\n"] for i, t in rows}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for i in train for w in toks[i]), Counter(p for i in train for p in zip(["\n", *toks[i]], toks[i]))
    floor = sum(one.values()) + len(one) + 1

    def quantised(c):
        if c < 1:
            return 0.0
        j = 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
        return 1.0 if j < 2 else (math.ceil(1.5 ** (j - 1) - 1e-9) + math.ceil(1.5**j - 1e-9) - 1) / 2

    def brute(ws):
        out = 0.0
        for v, w in zip(["\n", *ws], ws):
            c2, c1, c0 = quantised(two[v, w]), quantised(one[w]), quantised(one[v])
            out += math.log10(min(1.0, 0.8 * (c1 + 1) / floor + 0.2 * min(c2, c0, c1) / max(c0, 1.0)))
        return out

    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    assert len(got) == len(rows) and all(r.n_known == sum(one[w] > 0 for w in toks[i]) for i, r in got.items())
    assert all(r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / floor) for w in toks[i])) for i, r in got.items())
    # a false level, one probe chain in 400, moves a score a little
    assert all(r.score == pytest.approx(brute(toks[i]), rel=0.02, abs=0.7) for i, r in got.items())


def test_packed_pairs_come_back():
    import numpy as np

    rng = np.random.default_rng(1)
    for bits in (0, 1, 7, 13):
        h = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1000, dtype=np.uint64)
        drop = np.uint64(max(0, 64 - lm.KEPT - bits))
        k = h >> drop << drop
        if bits:
            k = k[(k >> np.uint64(64 - bits)) == 1]
        assert (lm.unpack(lm.pack(k, bits), bits, 1 if bits else 0) == k).all()


def test_quality_of_unseen_rows(spark, docs, empty):
    clean = [(i, f"Words number {i} make a plain sentence, as people write. And one more follows it here.", 1) for i in range(120)]
    noisy = [(i, f"junk{i}### noise$$$ more{i}&&& stuff%%% again{i}*** and### on$$$", 0) for i in range(120, 200)]
    all_ = spark.createDataFrame([(i, t) for i, t, _ in clean + noisy], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in clean + noisy] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.learn(all_, labels)
    truth = {i: q for i, _, q in clean + noisy}
    rows = [r for r in quality.score(all_, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.predicted == truth[r.doc_id] for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs, model).count() == docs.count() and quality.score(empty, model).count() == 0
    assert quality.score(docs, quality.learn(empty, labels)).filter("score is null").count() == 0
    # keys of any type, several texts and labels of one key
    named = all_.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text").unionByName(spark.createDataFrame([("k1", "another text of it"), (None, None)], "doc_id string, text string"))
    marks = labels.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "quality")
    other = quality.learn(named, marks.unionByName(marks.limit(3)), most_rows=50)
    assert quality.score(named, other).count() == 202 and quality.learn(named, marks, most_rows=50)[1:] == other[1:]


def test_lines_keep_one_occurrence(spark, docs, empty):
    long = "the quick brown fox jumps over the lazy dog while many people look on in wonder and say nothing at all today"
    rows = [(1, f"{long}\nshort line\n{long}"), (2, f"{long.upper()}\nshort line"), (3, long.replace("wonder", "wander")), (4, "short line"), (5, None)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].text == f"{long}\nshort line" and got[2].text == "short line" and got[4].n_removed == 0 and got[5].text is None
    assert lines.dedup_lines(docs).count() == docs.count() and lines.dedup_lines(empty).count() == 0


def test_lines_of_any_length_that_repeat(spark):
    rows = [(1, "short line\n\nx"), (2, "Short  LINE\n\nX\nx y"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_lines": F.lit("clash"), "removed_lines": F.lit("clash")})
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs, least_words=1).collect())
    # the first x is that of the null key; empty lines and null texts stay
    assert got[(None, "x", 1, 0)] == 1
    assert got[(3, None, 0, 0)] == 1 and got[(4, "", 1, 0)] == 1 and got[(5, "", 1, 1)] == 2
    assert got[(1, "short line\n", 3, 1)] == 1 and got[(2, "\nx y", 4, 2)] == 1


def test_lines_that_are_alike_are_found(spark):
    long = "the quick brown fox jumps over the lazy dog while many people look on in wonder and say nothing at all today"
    rows = [(1, f"{long}\nalone"), (2, long.replace("wonder", "wander")), (3, "alome"), (4, long[: len(long) // 2]), (5, "a loan, not alike at all")]
    got = {r.doc_id: r.removed_lines for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), least_words=1).collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: [], 5: []}


def test_lines_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts, pairs = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 6, 9, 14, 25, 60]))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 8)):
            k = rng.randrange(len(other[at]))
            other[at] = other[at][:k] + rng.choice("xyz") + other[at][k + rng.randint(0, 1) :]
        texts += [" ".join(words), " ".join(other)]
    own = sorted(set(texts), key=len)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if len(b) > len(a) / 0.8:
                break
            if lines.similar(a, b):
                pairs.append((a, b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    removed = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs, least_words=1).collect()}
    # a line is removed where brute force has an earlier one in its group, and nowhere else
    up = {t: t for t in own}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, b in pairs:
        up[find(a)] = find(b)
    seen, wanted = set(), {}
    for i, t in enumerate(texts):
        wanted[i] = int(find(t) in seen)
        seen.add(find(t))
    assert all(wanted[i] >= n for i, n in removed.items())
    assert sum(removed.values()) >= 0.95 * sum(wanted.values()) > 300


@pytest.mark.parametrize("a,b,d", [("", "", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("flaw", "lawn", 2)])
def test_edit_distance(a, b, d):
    assert lines.edit_distance(a, b, 9) == d and lines.edit_distance(b, a, max(0, d - 1)) == d


def test_warc_round_trip(spark):
    page = "<html lang=en><title>T &amp; t</title><body><script>x()</script><p>Hello <b>world</b></p><a href='/x'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/x y", page), (2, None, None), (2, None, None)], "page_id bigint, url string, html string")
    rows = warc.derivatives(pages).collect()
    assert Counter(r.record_type for r in rows) == {"metadata": 3, "conversion": 3}
    own, member = warc.response(1, "http://a.example/x y", page)
    one = [r for r in rows if r.page_id == 1]
    assert {r.refers_to for r in one} == {own} and all(r.target_uri == "http://a.example/x%20y" for r in one)
    headers, block = warc.parse(member)
    (_, _, head, fields), (_, _, _, text) = warc.derive(headers, block)
    assert text == b"T & t\nHello world\nl" and b"outlink: /x" in fields and b"title: T & t" in fields and ("WARC-Refers-To", own) in head
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_warc_reads_any_markup_in_linear_time_and_ids_are_unique(spark, monkeypatch):
    import time

    for odd in ("<a ", "<script ", "<title>", "<!--", "<p ", "</", "<script></script ", "<html ", "<a href='", "<", "<style>"):
        start = time.process_time()
        warc.derive({"WARC-Record-ID": "<x>", "WARC-Date": "d"}, b"HTTP/1.1 200 OK\r\n\r\n" + (odd * (1_000_000 // len(odd))).encode())
        assert time.process_time() - start < 20, odd
    assert warc.plain_text(warc.shown("a<script>x</script >b<style>y")) == "a b"
    rows = [(i, "u", "<p>x") for i in (1, 1, 2, 3, 3, 3)] + [(None, None, None)] * 2 + [(9, "v", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3).withColumns({c: F.lit("clash") for c in ("file", "record_id", "nth", "h")})
    for most in (1 << 16, 0):
        monkeypatch.setattr(warc, "MOST_KINDS", most)
        got = warc.derivatives(pages).collect()
        assert len({r.record_id for r in got}) == 18 and len({r.refers_to for r in got}) == 9
        assert Counter(r.page_id for r in got) == Counter(2 * [r[0] for r in rows])


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.run(spark, d).filter(F.col("shard").isNull()).count() == 0
