"""Training-data operators against brute force and on awkward input."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import ann, audio, bpe, brown, grammar, langid, licences, mixing, neardup, passages, queries, suffix, tokenfile
from veilgrid.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node long, size long"
rnd = random.Random(3)
WORDS = [f"{a}{b}" for a in ("sta", "mor", "té", "ven", "lu", "ghi") for b in ("ra", "no", "le", "ño", "tu")]
PASSAGE = " ".join(rnd.choice(WORDS) for _ in range(120))
LONG = " ".join(rnd.choice(WORDS) for _ in range(6000))


def _text(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


BASE = _text(300)
TEXTS = [None, "", "   ", "a", "!!! 123", "one two", "one two", BASE, BASE, BASE.replace(" ", "  ", 3), BASE + " extra words here", PASSAGE + " " + _text(50), _text(40) + " " + PASSAGE, LONG, "x" * 5000, "é" * 900, "Released under the MIT License.\nfoo", "\x00 odd \x1c chars", "<|endoftext|> said"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "aa" if k % 2 else None, None if k % 5 == 4 else f"s{k % 3}", None, 0.5, "k", 1, 1) for k, t in enumerate(TEXTS)]
    rows += [(3, "a", "aa", "s0", None, 0.5, "k", 1, 1), (None, BASE, None, None, None, None, None, None, None), (None, "short", "bb", "s1", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def _rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_encode_decode(docs, none):
    tok = _tok()
    want = Counter()
    for d, t in _rows(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(d, tuple(ids), tok.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(docs, queries.tokenizer_path()).collect()) == want
    assert bpe.encode_decode(none, queries.tokenizer_path()).count() == 0


def test_slices_of_texts_encode_as_the_library(monkeypatch):
    tok = _tok()
    rng = random.Random(5)
    letters = [*map(chr, range(32, 127)), *map(chr, range(0x80, 0x250))] + [" ", "\n", ".", ",", "#", "\u00e9", "<|", "a", "b", "\x1d", "\u03a9", "\u0301"] * 20
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(4000)]
    texts += [w + e for w in ("Hello", "\u00c9T\u00c9", "\u00b5m", "\u00aab", "a" * 3000) for e in ("", ".", ",.", "&#", "\x85", "\xa0x")] + ["", None]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for chars, memo in ((100, 50), (20_000, 500), (8_000_000, 400_000)):  # generations of the memo turn in the first two
        monkeypatch.setattr(bpe, "_SLICE_CHARS", chars)
        assert list(bpe.PieceEncoder(queries.tokenizer_path(), memo).encode_raw(texts)) == want
    # what lets Arrow cut and judge pieces as Python does
    some = [chr(c) for c in range(0x250) if not 0x1C <= c <= 0x1F]
    cut = pa.compute.utf8_split_whitespace(pa.array([f"a{c}b" for c in some])).to_pylist()
    assert [[x for x in xs if x] for xs in cut] == [f"a{c}b".split() for c in some]
    assert all(a == c.isalpha() for c, a in zip(some, pa.compute.utf8_is_alpha(pa.array(some)).to_pylist(), strict=True) if not "\x80" <= c <= "\xbf")


def test_tree_concatenation_is_exact():
    enc = bpe.PieceEncoder(queries.tokenizer_path(), leaf=48)
    parts = ["the", "tion", "a", "é", "!", "'s", "'re", "1", "İ", "Σ", "한", "😀", "$$$", "x" * 9]
    for _ in range(60):
        some = rnd.sample(parts, rnd.randint(1, 6))
        t = "".join(rnd.choice(some) for _ in range(200))
        assert enc.tree(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, none):
    tok = _tok()
    path = new_path(spark, "test-tokens")
    tokenfile.write_tokens(docs, queries.tokenizer_path(), path, shard_ids=500)
    got = tokenfile.read_tokens(spark, path).collect()
    order = sorted(_rows(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    at, want = 0, []
    for d, t in order:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((s, d, n, c) for d, s, n, c in want)
    path = new_path(spark, "test-tokens")
    tokenfile.write_tokens(none, queries.tokenizer_path(), path)
    assert tokenfile.read_tokens(spark, path).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 400, 30)
        ids = rng.integers(0, 12, int(lengths.sum())).astype(np.uint32)
        s = grammar.Shard(grammar.pack(np.arange(30), np.ones(30, bool), lengths, ids, 50))
        assert np.array_equal(s.ids(), ids) and len(s.rules)
        ends = np.cumsum(lengths)
        for k in (0, 7, 29):
            own = ids[ends[k] - lengths[k] : ends[k]]
            assert np.array_equal(s.document(k), own) and np.array_equal(s.document(k, 3, 9), own[3:9])


def test_grammar_chooses_pairs_one_by_one():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pairs = np.unique(rng.integers(0, 12, (40, 2)), axis=0).astype(np.uint32)
        counts = rng.integers(1, 20, len(pairs))
        role, want = {}, []
        for k in sorted(range(len(pairs)), key=lambda k: (-counts[k], *pairs[k].tolist())):
            a, b = pairs[k].tolist()
            if counts[k] >= 3 and (a not in role and b not in role if a == b else role.get(a, "l") == "l" and role.get(b, "r") == "r"):
                role |= {a: "both"} if a == b else {a: "l", b: "r"}
                want.append(k)
        assert grammar._choose(pairs, counts, 3, 5).tolist() == want[:5]


def test_grammar_replaces_every_pair_that_pays():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 40, 6000), np.zeros(500, int), np.tile([7, 7, 9], 200)]).astype(np.uint32)
    lengths = np.full(71, 100)
    for vocab in (50, 65_530, 70_000):  # rules past 16 bits, and none that fit them
        seq, rules, symbols = grammar.compress(ids, lengths, vocab)
        ends = np.cumsum(symbols)
        met = Counter()
        for e, n in zip(ends.tolist(), symbols.tolist(), strict=True):
            own, k = seq[e - n : e].tolist(), 0
            while k < n - 1:  # equal symbols count from the left
                met[own[k], own[k + 1]] += 1
                k += 2 if k + 2 < n and own[k] == own[k + 1] == own[k + 2] else 1
        assert len(rules) and max(met.values()) < grammar.LEAST + 1
        s = grammar.Shard(grammar.pack(np.arange(71), np.ones(71, bool), lengths, ids, vocab))
        assert np.array_equal(s.ids(), ids) and np.array_equal(s.document(61), ids[6100:6200])


def test_audio(docs, none):
    out = audio.features(audio.store_media(docs)).collect()
    by_text = {}
    want = Counter((d, len((t or "").encode())) for d, t in _rows(docs))
    assert Counter((r.doc_id, r.n_bytes) for r in out) == want
    for r in out:
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
        tensors, spans = audio.read_tensors(bytes(r.tensors))
        assert tensors.shape[1:] == (audio.BLOCK, audio.MELS) and len(spans) == len(tensors) and np.isfinite(tensors).all()
        assert by_text.setdefault(r.payload_sha256, bytes(r.tensors)) == bytes(r.tensors)
    raw = BASE.encode()
    raw += bytes(-len(raw) % 64)
    assert any(r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-64:]) for r in out)
    assert audio.features(audio.store_media(none)).count() == 0
    lm = audio.LogMel()
    x = np.sin(np.arange(3000) / 7).astype(np.float32)
    n, taps = np.arange(-(-len(x) * 2 // 3)), [p[::-1] for p in lm.phases]
    slow = [sum(taps[k * 3 % 2][j] * (x[k * 3 // 2 - j] if k * 3 // 2 - j >= 0 else 0) for j in range(audio.TAPS)) for k in n[:200]]
    assert np.allclose(lm.resample(x)[:200], slow, atol=1e-4)


def test_language_id(spark, docs, none):
    rows = [(k, " ".join(rnd.choice(["the", "and", "with", "house"] if k % 2 else ["der", "und", "nicht", "haus"]) for _ in range(30)), "en" if k % 2 else "de") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df, F.col("doc_id") < 30, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(True), ["doc_id"]).collect()}
    assert [got[k] for k in (0, 1, 2, 4)] == ["und"] * 4 and got[3] != "und"
    assert langid.identify(none, F.lit(True), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False), ["doc_id"]).collect()} == {"und"}


def test_language_id_of_other_scripts_against_brute_force(spark, monkeypatch):
    """Languages of one script differ, and sums made in parts equal a bundle made trigram by trigram."""
    words = {"ru": "и не на что дом", "bg": "и не на какво къща", "uk": "і не на що дім", "el": "και δεν στο σπίτι", "he": "לא את של בית", "ja": "です ます した 家"}
    rows = [(k, lang, " ".join(rnd.choice(words[lang].split()) for _ in range(25))) for k, lang in enumerate([*words] * 8)]
    monkeypatch.setattr(langid, "PENDING", 200)
    monkeypatch.setattr(langid, "DISTINCT", 50)
    monkeypatch.setattr(langid, "KEPT", 20)
    parts = langid._Bundles()
    sums = {lang: np.zeros(langid.DIM) for lang in words}
    for _, lang, text in rows[:24]:
        parts.add(lang, langid.trigrams(text))
        for g in langid.trigrams(text):
            sums[lang] += langid.gram_vectors(np.array([g]))[0]
    found = parts.all()
    assert all((found[lang] == sums[lang]).all() for lang in words)
    profiles = langid.Profiles(sorted(words), np.stack([sums[lang] for lang in sorted(words)]))
    for _, lang, text in rows[24:]:
        v = sum(langid.gram_vectors(np.array([g]))[0].astype(float) for g in langid.trigrams(text))
        best = max((float(v @ sums[x] / np.linalg.norm(v) / np.linalg.norm(sums[x])), x) for x in words)
        pred, score = profiles.predict(text)
        assert pred == best[1] == lang and abs(score - best[0]) < 1e-4
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert all(r.lang_pred == r.lang for r in langid.identify(df, F.col("doc_id") < 24, ["doc_id", "lang"]).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, 5, query=F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(3000), -s))[:5].tolist()
        hit += len(set(want) & set(got[q].values()))
        if q in (0, 100):
            assert [got[q][k] for k in range(1, 6)] == want
    assert hit / 300 >= 0.9 and set(got) == set(range(0, 3000, 50))
    extra = df.withColumn("score", F.lit(1)).withColumn("members", F.lit("x")).withColumn("tree", F.lit(0))
    again = {(r.query_id, r.rank): r.vec_id for r in ann.neighbours(extra, 5, query=F.col("vec_id") % 50 == 0).collect()}
    assert again == {(q, rank): v for q, x in got.items() for rank, v in x.items()}
    tiny = spark.createDataFrame(rows[:3], df.schema)
    assert [(r.query_id, r.rank) for r in ann.neighbours(tiny, 5, query=F.lit(True)).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert ann.neighbours(df.limit(0), 5, query=F.lit(True)).count() == 0


def test_clustered_vectors_need_few_leaves():
    rng = np.random.default_rng(6)
    visits = []
    for clusters in (40, 160):
        x = np.repeat(rng.normal(size=(clusters, 24)), 100, axis=0) + 0.1 * rng.normal(size=(clusters * 100, 24))
        u = ann._unit(x)
        forest = ann.Forest(u, len(u) // 100, 8)
        picks = rng.choice(len(u), 40, replace=False)
        near = {k: x[np.argsort(-(u @ u[q]))[1:6]].tolist() for k, q in enumerate(picks.tolist())}
        visits.append(ann.visits_for(forest, u[picks], near, 0.95))
    assert visits[1] <= 2 * visits[0]  # four times the rows


def test_suffix_arrays():
    for _ in range(300):
        t = [rnd.randint(1, rnd.randint(1, 3)) for _ in range(rnd.randint(0, 50))]
        t = np.array(t + t[: len(t) // 2] + [0], np.uint16)
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        plcp = suffix.permuted_common_prefixes(t, sa, 400)
        for a, b in itertools.pairwise(sa.tolist()):
            n = next((k for k, (x, y) in enumerate(zip(t[a:], t[b:], strict=False)) if x != y), min(len(t) - a, len(t) - b))
            assert plcp[b] == n


@pytest.mark.parametrize("anchor_bytes", [1_000_000, 700])
def test_repeated_passages(docs, none, anchor_bytes):
    rows = _rows(docs)
    raws = [(t or "").encode() for _, t in rows]
    met = Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    want = Counter()
    for (d, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - 399):
            if met[r[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[(d, len(r), bytes(b for b, g in zip(r, gone, strict=True) if not g))] += 1
    out = passages.remove_repeats(docs, 400, anchor_bytes=anchor_bytes).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in out) == want
    assert passages.remove_repeats(none, 400).count() == 0


def test_near_duplicates(docs, none, monkeypatch):
    rows = _rows(docs)
    n = len(rows)
    doc, value, count = neardup.shingles([t for _, t in rows])
    own = [(value[doc == k], count[doc == k]) for k in range(n)]
    root = list(range(n))

    def top(k):
        return k if root[k] == k else top(root[k])

    for i, j in itertools.combinations(range(n), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or neardup.similarity(*own[i], *own[j]) >= 0.8:
            root[top(j)] = top(i)
    groups = {}
    for k in range(n):
        groups.setdefault(top(k), []).append(rows[k][0])
    want = Counter((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g)
    for crowd, huge in ((32, 6400), (1, 6400), (1, 1)):
        monkeypatch.setattr(neardup, "CROWD", crowd)
        monkeypatch.setattr(neardup, "HUGE", huge)
        assert Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()) == want
    assert neardup.near_duplicates(none).count() == 0


def test_one_document_of_each_class_stays(spark):
    import corpus_pipeline

    other = " ".join(f"x{k}" for k in range(300))
    rows = [(1, BASE), (1, BASE + " more"), (1, BASE + " more"), (2, BASE + " again"), (None, other), (None, other + " more"), (None, other + " again"), (1, "apart")]
    docs = spark.createDataFrame([(d, t, None, None, len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text[:20]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == {(1, BASE[:20]): 1, (None, other[:20]): 1, (1, "apart"): 1}


def test_probability_jaccard_estimate():
    a, b = {k: rnd.randint(1, 5) for k in range(60)}, {k: rnd.randint(1, 5) for k in range(20, 90)}
    brute = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in {*a} & {*b})
    ea, wa, eb, wb = (np.array(list(x)) for y in (a, b) for x in (y.keys(), y.values()))
    assert abs(neardup.similarity(ea, wa, eb, wb) - brute) < 1e-9
    doc = np.repeat([0, 1], [len(a), len(b)])
    sig = neardup.signatures(2, doc, np.concatenate([ea, eb]).astype(np.uint64), np.concatenate([wa, wb]), 4000)
    assert abs((sig[0] == sig[1]).mean() - brute) < 0.04


def test_mix(spark, docs, none):
    rows = [(k, " ".join(["w"] * rnd.randint(1, 9)), None if s == 3 else f"s{s}") for k, s in enumerate(s for s in range(4) for _ in range(300 * (s + 1)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, 3.0) for k in range(0, 3000, 2)], "doc_id long, weight double")
    out = mixing.mix(df, labels).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7), labels).collect()))
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert abs(sum(x[0] for x in by.values()) - 1.5 * total) < 1e-6
    assert all(abs(t - n) <= 5 and t <= 2 * s + 1e-9 for t, n, s in by.values())
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0


def test_brown_scores(docs, none):
    out = brown.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2, most=5, endings=4, classes=4, head=8).collect()
    low = {i: i + 32 for i in range(65, 91)}
    split = lambda t: (t or "").translate(low).encode().split()
    train = [split(t) + [b"\n"] for d, t in _rows(docs) if (d or 0) % 7 != 2]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in _rows(docs):
        own = split(t) + [b"\n"]
        want[(d, len(own), sum(w in c for w in own), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert brown.score(none, F.lit(True)).count() == 0


def test_exchange_reaches_every_word_with_contexts(spark):
    """Words far beyond the seed, with unrelated endings, are clustered by the words around them."""
    rng = random.Random(5)
    kinds = [[bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(9)).decode() for _ in range(80)] for _ in range(2)]
    texts = [" ".join(x for _ in range(40) for x in ("left", rng.choice(kinds[0]), "right", rng.choice(kinds[1]))) for _ in range(60)]
    rows = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id long, text string, train boolean")
    units, ends, _ = brown.collect_units(brown.word_counts(rows), 5, 2, 3)
    parts = brown.encode(rows, units, True)
    cls, m, trace = brown.cluster(parts, units, ends, 2, 5)
    assert units.first_ending - 1 == 162 and len(trace) > 1 and trace == sorted(trace) and m.sum() == 60 * 161
    own = [Counter(cls[units.of([w.encode() for w in k])].tolist()) for k in kinds]
    assert all(c.most_common(1)[0][1] >= 76 for c in own) and own[0].most_common(1)[0][0] != own[1].most_common(1)[0][0]


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    group = rng.integers(1, 4, 30)
    pairs = rng.poisson(np.where((group[:, None] % 3) + 1 == group[None, :], 9, 0.3)).astype(float)
    pairs[0], pairs[:, 0] = 1, 1
    cls = brown.exchange(pairs, 4)
    assert all(len({*cls[1:][group[1:] == g].tolist()}) == 1 for g in (1, 2, 3)) and (cls == 0).sum() == 1


def test_licences(spark, docs, none):
    rows = [("p/LICENSE", "Released under the MIT License."), ("p/a/b/x.c", "int main"), ("p/y.c", "This work is licensed under the GNU General Public License, version 3.\ncode"), ("q/z", None), (None, "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, path string, text string")
    out = {r.doc_id: (r.licence, r.origin, r.distance) for r in licences.scan(df, F.col("path").endswith("LICENSE"), ["doc_id"]).collect()}
    assert out == {0: ("MIT", "own", None), 1: ("MIT", "inherited", 2), 2: ("GPL-3.0", "own", None), 3: (None, "none", None), 4: (None, "none", None)}
    assert licences.scan(docs.withColumn("path", F.lit("a/b")), F.lit(True), ["doc_id"]).count() == docs.count()
    assert licences.scan(none.withColumn("path", F.lit("a")), F.lit(True), ["doc_id"]).count() == 0


def test_pipeline_against_brute_force(spark, docs, none, tmp_path):
    import corpus_pipeline

    frame = docs.filter("doc_id is not null").select(*corpus_pipeline.COLUMNS).dropDuplicates(["doc_id"])
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = frame
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / f"{k}"))
        kept = spark.read.parquet(str(tmp_path / f"{k}"))
        ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
        if k == 0:
            assert ids == sorted(d for d, t in _rows(frame) if t and any(c.isalpha() for c in t))
        if k == 1:
            assert 7 in ids and 8 not in ids and 9 not in ids and 10 not in ids and 5 in ids and 6 not in ids and 11 in ids
        if k == 2:
            texts = dict(_rows(kept))
            assert PASSAGE[:390] not in texts[11] and texts[13] == LONG
        if k < 4:
            assert kept.columns == corpus_pipeline.COLUMNS
    tok = _tok()
    mixed = spark.read.parquet(str(tmp_path / "3"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in kept.collect()) == Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in _rows(mixed))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()
    assert pa.__version__
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, none.select(*corpus_pipeline.COLUMNS), str(tmp_path)).count() == 0


def _scan_in_sql(spark, name, rows, folder):
    """The rows of an op3 query over documents (doc_id, source, text), and of its SQL."""
    import duckdb

    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES[name](spark, str(folder)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(got, key=str), sorted(con.sql(queries.ORACLES[name]).fetchall(), key=str)


def _licence_rows():
    from pathlib import Path

    whole = {p.stem: p.read_text() for p in Path(licences.__file__).with_name("licence_texts").glob("*.txt")}
    prose = "\n".join(_text(12) + " the tool and its users are of that kind." for _ in range(30))
    notice = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version.\n *\n * You should have"
    return [
        *[(k, "Copyright (c) 2019 Jane Doe\n\n" + t) for k, t in sorted(whole.items())],
        ("MIT", "# Copyright (c) 2019 Jane Doe. Released under the MIT License.\nimport os"), ("MIT", "# This file is released under the MIT License,\n# see there."),
        ("MIT", prose + "\n\n" + whole["MIT"].split("\n", 2)[2] + "\n" + prose), ("ISC", "/*\n * " + whole["ISC"].split("\n", 2)[2].split("\n\n")[0].replace("\n", "\n * ") + "\n */\nint main;"),
        ("GPL-3.0", notice.format(3)), ("GPL-2.0", notice.format(2)), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint main"), ("Zlib", "/* SPDX-License-Identifier: (Zlib OR zzz-or-later) */\nAll rights reserved."),
        ("Proprietary", "Copyright 2020 Foo Inc. All rights reserved."), ("Proprietary", "All rights reserved.\x01 more"), (None, "Licensed under the Foo License, Version 2.0"), (None, "mit"), (None, prose), (None, ""), (None, None),
        (None, "SPDX-License-Identifier: NONE"), ("MIT", "Released under the MIT License."), ("MIT", "Released under the MIT License."),
    ]


def test_whole_licences(spark, docs, none):
    cases = _licence_rows()
    df = spark.createDataFrame([(k, f"d{k}/x", t) for k, (_, t) in enumerate(cases)], "doc_id long, path string, text string")
    out = {r.doc_id: r.own_licence for r in licences.scan(df, F.lit(False), ["doc_id"]).collect()}
    assert [out[k] for k in range(len(cases))] == [want for want, _ in cases]


def test_whole_licences_against_sql(spark, tmp_path):
    rows = [(k, f"s{k % 3}", t) for k, (_, t) in enumerate(_licence_rows())] + [(3, "s9", "other text of a repeated id"), (1050, None, "inherits nothing"), (1, "s1", "near s1"), (2000, "s1", "Licensed by İapache. MİT LİCENSE İ")]
    got, want = _scan_in_sql(spark, "op3_licence_texts", rows, tmp_path)
    assert got == want and {r[5] for r in got} == {"own", "inherited", "none"}


def test_licence_lines_against_sql(spark, tmp_path):
    lines = ["Releaſed under the MIT Licenſe.\nall rights reſerved", "ALL RIGHTſ RESERVED.", "ſpdx released under the mit license", "Redistribution permitted under the MİT license İ", "Licensed under the Apache License, Version 2.0. İstanbul", "nothing here", "", None]
    got, want = _scan_in_sql(spark, "op3_licence_scan", [(k, f"s{k % 2}", t) for k, t in enumerate(lines)], tmp_path)
    assert got == want and sum(r[5] == "own" for r in got) > 2
