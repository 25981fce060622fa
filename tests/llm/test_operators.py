"""Every operator against brute force on whole small tables, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factorloom.llm import ann, decontam, htmltext, langid, lattice, pieces, scoring, sharding, simhash, suffixdedup, tokencount, vptree, xsort
from factorloom.llm.common import text_bytes


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- 1 ---


def leaks(docs, items, size=13):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].update(() if i is None else (i,))
    out = []
    for d, t in docs:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[x]
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


COLUMNS_1 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 2000])
def test_decontamination(spark, sf_dir, documents, block_bytes):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontam.find_contamination(documents, bench, block_bytes=block_bytes).select(COLUMNS_1).collect()
    want = leaks([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(map(tuple, got)) == sorted(want) and any(r.contaminated for r in got)


def test_decontamination_odd(spark, odd, none):
    items = [(1, "quick BROWN fox"), (2, None), (None, "lazy dog"), (3, "quick brown fox"), (4, "word5 alpha5 word6"), (5, ""), (1, "quick BROWN fox")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    got = decontam.find_contamination(odd, bench).select(COLUMNS_1).collect()
    assert sorted(map(tuple, got), key=key) == sorted(leaks([(r.doc_id, r.text) for r in odd.collect()], items), key=key)
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(odd, bench.where("false")).where("contaminated or n_hit > 0").count() == 0


# --- 2 ---


def print_of(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(ids, fps, radius=2):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius), strict=True):
        parent[root(int(a))] = root(int(b))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("shard_points", [simhash.SHARD_POINTS, 20])
def test_simhash(documents, shard_points):
    rows = documents.collect()
    fps = [print_of(r.text) for r in rows]
    want = [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, groups_of([r.doc_id for r in rows], fps), strict=True)]
    assert sorted(map(tuple, simhash.near_duplicates(documents, shard_points=shard_points).collect())) == sorted(want)


def test_simhash_chains(spark):
    """Chains of fingerprints two bits apart are one component, through any number of shards."""
    rng = np.random.default_rng(0)
    fps = [int(x) for x in rng.integers(0, 2**63, 300)]
    for i in range(40):
        fps.append(fps[-1] ^ (3 << (i % 60)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    from factorloom.llm.components import components

    label = {r.node: r.label for r in components(simhash.links(df, 2, 16)).collect()}
    chain = {label[int(np.uint64(f).view(np.int64))] for f in fps[299:]}
    assert len(chain) == 1


def test_vantage_points():
    rng = np.random.default_rng(1)
    p = np.unique(np.concatenate([rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**10, 200, dtype=np.uint64)]))
    q = np.concatenate([p[:100] ^ np.uint64(5), p[100:200]])
    got = {(int(a), int(b)) for i, j in vptree.pairs(p, q, 2, 8) for a, b in zip(i, j, strict=True)}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(q[:, None] ^ p[None, :]) <= 2), strict=True)}
    assert got == want


def test_simhash_odd(odd, none):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert got[1, "0" * 16] == got[2, "0" * 16] == got[3, "0" * 16] == 1
    assert {r.component_id for r in simhash.near_duplicates(odd).where("doc_id in (4, 5)").collect()} == {4}
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7, 8, 9]


# --- 3 ---


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    f = sharding.Feistel(n)
    x = f.once(np.arange(f.side**2))
    assert sorted(x.tolist()) == list(range(f.side**2))
    got = [r.p for r in spark.range(n).select(f.column(F.col("id")).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef(got, range(n))[0, 1]) < 0.2


def test_sharding(documents, odd, none):
    for df in (documents, odd):
        rows = sharding.shard(df, 24).collect()
        assert sorted(r.shard + 24 * r.slot for r in rows) == list(range(df.count()))
        sizes = Counter(r.shard for r in rows)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
        want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode())) for r in df.collect())
        assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == Counter(want)
    a, b = (sorted(map(str, sharding.shard(documents.repartition(k), 24).collect())) for k in (2, 5))
    assert a == b and sharding.shard(none, 24).count() == 0


# --- 4 ---


def test_language(documents, odd, none):
    model = langid.train(documents)
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect()} == {True}
    und = {r.doc_id for r in langid.predict(odd, model).where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3, 7}
    assert langid.predict(none, model).count() == 0
    untaught = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert untaught.where("lang_pred != 'und' or accepted").count() == 0


def test_language_in_pieces(monkeypatch):
    """A text longer than a step gets the same scores as one that fits."""
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(langid.BUCKETS + 1, 2)).astype(np.float32), np.zeros(2))
    model.table[-1] = 0
    data, at = text_bytes(pa.array(["the quick brown fox " * 300, "", "dog"]))
    whole = model.scores(data, at)[0]
    monkeypatch.setattr(langid, "STEP_BYTES", 1000)
    np.testing.assert_allclose(model.scores(data, at)[0], whole, atol=0.02)


# --- 5 ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work well for you.</div>
<main><article><h1>Fish &amp; chips</h1><p>First   para&shy;graph,<br>with a break.<p>Second one &#233;t&eacute;.</p>
<div class="ad">Buy now, it is cheap!</div><ul><li>Point one</li><li>Point two</li></ul><script>var x = "</p>";</script></article>
<section id="comments"><p>I read this whole article twice and liked it a lot.</p></section></main>
<aside><p>Related: other things that you may want to read now.</p></aside><form>Name <input><button>Go</button></form>
<footer>&copy; Site</footer></body></html>"""


def test_html(spark):
    assert htmltext.extract(PAGE) == "Fish & chips\nFirst para\xadgraph, with a break.\nSecond one été.\nPoint one\nPoint two"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<nav><a href=x>Home</a>"), (1, "u", PAGE)], "page_id long, url string, html string")
    rows = htmltext.main_text(df).collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id in (2, 3, 4, 5)] == [""] * 4
    assert htmltext.main_text(df.where("false")).count() == 0


def test_min_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 8))
        gain = rng.normal(0, 2, n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda on, gain=gain, edges=edges: sum(abs(g) for g, o in zip(gain, on, strict=True) if (g > 0) != o) + sum(c for a, b, c in edges if on[a] != on[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext._flow_cut(gain, edges)) == pytest.approx(best)


def test_pages_of_the_tables(spark, sf_dir):
    import html

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert htmltext.extract(r.html) == "\n".join(p for p in parts if p)


# --- 6 ---


@pytest.fixture(scope="module")
def vocab():
    return lattice.load_vocab(pieces.MODEL)


def segmentations(v, word, score):
    ids = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_ids.tolist())}
    out = []

    def go(i, path, s):
        if i == len(word):
            out.append((s, path))
            return
        n = 1
        while i + n < len(word) and word[i + n] & 0xC0 == 0x80:
            n += 1
        for k in range(1, v.longest + 1):
            if i + k <= len(word) and (p := ids.get(word[i : i + k])) is not None:
                go(i + k, [*path, p], s + score(p, k))
        if word[i : i + n] not in ids:
            go(i + n, [*path, v.unknown], s + score(v.unknown, n))

    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 2, 4])
@pytest.mark.parametrize("text", ["the hat", "thouhe  n\nq", "é𓀀ok", "a", " ", "   x", "▁odd"])
def test_n_best(vocab, text, n):
    e = pieces.Encoder(vocab, n)
    text = text.replace(lattice.MARK, " ")
    ids, bound, scores, changes, same = e.step(*text_bytes(pa.array([text])))
    score = lambda p, k: vocab.unknown_score if p == vocab.unknown else float(vocab.scores[p])
    want = segmentations(vocab, (" " + text).encode(), score)[:n]
    assert scores[0] == [w[0] for w in want] and same and changes[0][0] == [] if n > 1 else scores[0] == [want[0][0]]
    assert e.decode(ids).tobytes() == (" " + text).encode()


def test_encoding_against_the_library(vocab, documents):
    """No segmentation of the public library's own lattice over the same pieces scores better."""
    sp = pytest.importorskip("sentencepiece")
    proto = open(pieces.MODEL, "rb").read()
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(proto)
        m.trainer_spec.model_type = 1
        uni = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    except Exception as e:
        pytest.skip(f"no model editing here: {e}")
    rows = pieces.encode(documents.limit(20)).collect()
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        total = 0.0
        for i in uni.encode(text[r.doc_id]):
            b = np.flatnonzero(vocab.byte_ids == i)
            total += vocab.scores[i] if not len(b) else vocab.unknown_score if (b[0] & 0xC0) != 0x80 else 0.0  # the bytes of an unknown character
        assert r.decoded and total <= r.scores[0] + 1e-6


def test_encoding_odd(odd, none):
    rows = pieces.encode(odd).collect()
    assert len(rows) == odd.count() and all(r.decoded for r in rows)
    assert all(r.n_pieces == 0 and list(r.ids) == [] and r.scores == [0.0] for r in rows if r.doc_id in (1, 2))
    assert pieces.encode(none).count() == 0
    a, b = (r.ids_sha256 for r in pieces.encode(odd, digest=True).where("doc_id in (4, 5)").limit(2).collect())
    assert a == b
    first = next(r for r in rows if r.doc_id == 9)
    assert hashlib.sha256(np.array(first.ids, "<i4").tobytes()).hexdigest() == pieces.encode(odd, digest=True).where("doc_id = 9").first().ids_sha256


# --- 7 ---


def nearest(rows, asks, k):
    out = {}
    for q, v in asks:
        s = sorted(((-float(np.dot(v, x) / math.sqrt(np.dot(v, v)) / math.sqrt(np.dot(x, x))), i) for i, x in rows if i != q))
        out[q] = [i for _, i in s[:k]]
    return out


def test_ann_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in df.collect()]
    want = nearest(rows, [(i, v) for i, v in rows if i % 50 == 0], 5)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)


def test_ann_odd(spark):
    same = [0.5, 0.25, -1.0]
    rows = [(0, same), (50, same), *[(i, same) for i in range(100, 140)], (60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 1.0]), (63, [float("nan"), 1.0, 1.0]), (64, [1.0, 1.0]), (65, [0.1, 0.9, 0.3]), (0, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    by = {q: [r.vec_id for r in out if r.query_id == q] for q in (0, 50, 100)}
    assert by == {0: [50, 100, 101, 102, 103], 50: [0, 100, 101, 102, 103], 100: [0, 50, 101, 102, 103]}
    assert all(r.score == pytest.approx(1.0) for r in out)
    few = ann.search(df.where("vec_id in (0, 65)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 65)]
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_walk_is_sorted():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    s = [a[i] + b[j] for i, j in ann.walk(a, b)]
    assert len(s) == 35 and s == sorted(s)


# --- 8 ---


def repeats(texts, span):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        on = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                on[i : i + span] = True
        keep = bytes(np.frombuffer(t, np.uint8)[~on]) if t else b""
        out.append((len(t), int(on.sum()), len(suffixdedup.runs(on)[0]), hashlib.sha256(keep).hexdigest()))
    return out


def digest_rows(df, **o):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.digests(df, **o).collect())


@pytest.mark.parametrize("options", [{}, {"hot_bytes": 2000}, {"shard_bytes": 10_000}])
def test_suffix_dedup(documents, options):
    rows = documents.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, repeats([(r.text or "").encode() for r in rows], 400), strict=True))
    assert digest_rows(documents, **options) == want


@pytest.mark.parametrize("hot", [suffixdedup.HOT_BYTES, 300])
def test_suffix_dedup_odd(odd, none, hot):
    rows = odd.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, repeats([(r.text or "").encode() for r in rows], 400), strict=True))
    assert digest_rows(odd, hot_bytes=hot) == want
    assert digest_rows(none) == []
    cut = suffixdedup.remove(odd)
    assert cut.columns == odd.columns and {r.doc_id: r.text for r in cut.collect()}[8] == ""


def test_suffix_cut_keeps_characters_whole(spark):
    both = "é" * 150 + "ä" * 60
    df = spark.createDataFrame([(1, "a" + both + "x"), (2, "bb" + both + "y")], "doc_id long, text string")
    assert sorted(r.text for r in suffixdedup.remove(df).collect()) == ["ax", "bby"]


@pytest.mark.parametrize("memory", [64, 600, 1 << 20])
def test_suffix_sorting(memory):
    rng = np.random.default_rng(memory)
    for it in range(150):
        t = rng.integers(1, int(rng.choice([2, 3, 4, 60])), int(rng.integers(1, 90)))
        if it % 3 == 0:
            t = np.concatenate([t, t[: len(t) // 2], t[:7], t[:7]])
        full = np.append(t, 0).astype(np.int32)
        space = xsort.Space(memory)
        assert xsort.suffix_order(full, space).tolist() == sorted(range(len(full)), key=lambda i: full.tolist()[i:])
        space.close()
        span = int(rng.choice([1, 2, 4]))
        seen = Counter(tuple(t[i : i + span]) for i in range(len(t) - span + 1))
        want = [i + span <= len(t) and seen[tuple(t[i : i + span])] > 1 for i in range(len(t))]
        assert xsort.repeated(t.astype(np.uint16), span, memory).tolist() == want


# --- 9 ---


def test_scoring(documents):
    rows = documents.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    c = Counter()
    for r in rows:
        if not held[r.doc_id]:
            c.update([*(r.text or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    for r in scoring.score(documents).collect():
        w = [*next(x.text for x in rows if x.doc_id == r.doc_id).encode().lower().split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0


def test_marginals(vocab):
    logp = scoring.prior(vocab)
    assert np.exp(logp).sum() == pytest.approx(1)
    words = ["the", "thouhenor", "é𓀀x", "a"]
    score = lambda p, k: k * (logp[p] - math.log(256)) if p == vocab.unknown else logp[p]
    want = [np.logaddexp.reduce([s for s, _ in segmentations(vocab, f" {w}".encode(), score)]) for w in words]
    assert scoring.word_logp(vocab, pa.array(words), logp) == pytest.approx(want)
    counts = scoring.expected_counts(vocab, pa.array(words), np.ones(4), logp)
    for w in words:
        paths = segmentations(vocab, f" {w}".encode(), score)
        z = np.logaddexp.reduce([s for s, _ in paths])
        for s, path in paths:
            for p in path:
                counts[p] -= math.exp(s - z)
    assert np.abs(counts).max() < 1e-6


def test_scoring_odd(odd, none):
    rows = {r.doc_id: r for r in scoring.score(odd).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 1
    assert scoring.score(odd).count() == odd.count() and scoring.score(none).count() == 0
    held_only = scoring.score(odd.where("doc_id = 9").withColumn("doc_id", F.lit(9).cast("long"))).collect()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in [*rows.values(), *held_only])


# --- 10 ---


def test_edits():
    import random

    rng, counter = random.Random(3), tokencount.Counter(tokencount.load_ranks())
    parts = ["a", "the ", "  ", "\n", "'", "l", "s", "12", "é", "!", "  \n ", "Zz", " "]
    for it in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400 if it % 5 == 0 else 20)))
        tree = tokencount.Tree(text, counter)
        for _ in range(4):
            pos, gone, new = rng.randint(0, len(text) + 1), rng.choice([0, 1, 3, 30]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4])))
            tree.edit(pos, gone, new)
            pos = min(pos, len(text))
            text = text[:pos] + new + text[pos + gone :]
            assert tree.text() == text and tree.total == len(counter.encoding.encode_ordinary(text))


def test_edits_touch_little():
    counter = tokencount.Counter(tokencount.load_ranks())
    tree = tokencount.Tree("the quick brown fox jumps. " * 3000, counter)
    tree.edit(40_000, 5, "lazy dog")
    assert 0 < tree.reencoded < 200


def test_token_counts(documents, odd, none):
    enc = tokencount.Counter(tokencount.load_ranks()).encoding
    for df in (documents, odd):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for r in tokencount.count(df, tokencount.sample_edits(F.col("text"))).collect():
            t = text[r.doc_id]
            assert r.n_tokens == len(enc.encode_ordinary(t))
            n = len(t)
            t = "Edited: " + t
            for pos, gone, new in ((n // 2, 7, ""), (n * 3 // 4, 5, " it's Ωmega 42")):
                pos = min(pos, len(t))
                t = t[:pos] + new + t[pos + gone :]
            assert (r.n_tokens_edited, r.n_chars_edited) == (len(enc.encode_ordinary(t)), len(t))
    assert tokencount.count(none, tokencount.sample_edits(F.col("text"))).count() == 0
    assert tokencount.count(odd, F.lit(None).cast("array<struct<pos:int,removed:int,added:string>>")).where("n_tokens != n_tokens_edited").count() == 0
