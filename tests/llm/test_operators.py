"""The ten operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import _counts, _text, chat_format, decontam, embed_dedup, lang_id, line_dedup, lm_score, minhash, mixing, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width=5):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def made_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base = [line(rng.randint(30, 90)) for _ in range(n // 3)]
    out = list(base)
    passage = line(70)
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        kind = rng.random()
        out.append(" ".join(w) if kind < 0.6 else f"{line(20)}\n{passage}\n{line(15)}" if kind < 0.85 else rng.choice(out))
    return [*out, "", None, "   \n\t ", "one two", "one two", "é ñ " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts()
    rows = [(k, t, "en", f"src{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Clashing column names, null ids and repeated rows."""
    rows = [(1, "a b c d e f g", "x", 0), (1, "a b c d e f g", "x", 0), (None, "a b c d e f g", None, 1), (2, None, None, 2), (3, "", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long").withColumns({"uid": F.lit(1), "doc": F.lit("d"), "line": F.lit(9), "n_lines": F.lit(5), "removed": F.lit("r"), "copies": F.lit(1), "component_id": F.lit(7)})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


# -- text hashing ----------------------------------------------------------------------


def test_words_are_split_like_bytes_and_fold_ascii_only():
    texts = ["Ab aB\x0bAB é É", "", "x", " x", "a" * 10]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    hashes, _, owner = _text.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    flat = [w for r in raw for w in r.lower().split()]
    assert len(hashes) == len(flat) and owner.tolist() == [k for k, r in enumerate(raw) for _ in r.split()]
    for i in range(len(flat)):
        for j in range(len(flat)):
            assert (hashes[i] == hashes[j]) == (flat[i] == flat[j])


def test_spans_of_any_bytes():
    rng = random.Random(5)
    for _ in range(300):
        texts = [bytes(rng.choice(b"aB \t\n\r\x0e\x08\xc3") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 5))]
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        hashes, starts, owner = _text.words(data, bounds)
        expected = [(k, w.lower()) for k, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
        assert owner.tolist() == [k for k, _ in expected]
        assert all(data[a : a + len(w)].tobytes().lower() == w for a, (_, w) in zip(starts.tolist(), expected, strict=True))
        assert len({*hashes.tolist()}) == len({w for _, w in expected})


def test_long_text_is_hashed_like_its_pieces():
    text = b"lorem ipsum dolor " * 80_000
    data = np.frombuffer(text, np.uint8)
    hashes, starts, _ = _text.words(data, np.array([0, len(data)]))
    assert len(hashes) == 240_000 and len(set(hashes.tolist())) == 3 and starts[-1] == len(text) - 6


# -- 1 ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["eau", "oi", "ou"]}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(k, rng.randint(3, 60)), k, None, 0) for i, k in enumerate(rng.choice(list(syllables)) for _ in range(200))]
    rows += [(500, text("aa", 40) + " " + text("bb", 20), None, None, 0), (501, "12 34 !!", "aa", None, 0), (502, None, "bb", None, 0), (503, "", None, None, 0), (504, "k", None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_id(languages):
    out = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(languages.where(~out))
    assert model[0] == ["aa", "bb", "cc"]
    assert np.allclose(model[1].sum(axis=0), 1)
    found = {r["doc_id"]: r for r in lang_id.identify(languages, *model).collect()}
    labelled = [r for r in languages.collect() if r["lang"] and r["doc_id"] < 500]
    assert all(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in labelled)
    assert any(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in labelled)
    mixed = found[500]
    assert mixed["languages"] == ["aa", "bb"] and 0.5 < mixed["score"] < 0.8 and abs(sum(mixed["shares"]) - 1) < 1e-6
    assert {found[k]["lang_pred"] for k in (501, 502, 503)} == {"und"} and found[504]["lang_pred"] in model[0]
    kept = {r["doc_id"] for r in lang_id.keep_identified(languages, *model).collect()}
    assert kept == {r["doc_id"] for r in languages.collect()} - {501, 502, 503}


def test_language_id_without_rows(spark, odd):
    model = lang_id.fit(empty(spark))
    assert lang_id.identify(empty(spark), *model).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(odd, *model).collect()} == {"und"}


def test_em_finds_proportions():
    table = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    counts = np.rint(1e5 * table @ [0.3, 0.7])
    theta, _ = lang_id.proportions(table, counts, steps=500)
    assert abs(theta[0] - 0.3) < 0.01


# -- 2 ---------------------------------------------------------------------------------


def brute_vectors(rows, threshold):
    links = []
    for i, (_, x, a) in enumerate(rows):
        for j, (_, y, b) in enumerate(rows[:i]):
            if a is not None and a == b and x and y and len(x) == len(y) and all(v is not None and math.isfinite(v) for v in [*x, *y]):
                nx, ny = math.sqrt(sum(v * v for v in x)), math.sqrt(sum(v * v for v in y))
                if nx and ny and sum(u * v for u, v in zip(x, y, strict=True)) / nx / ny >= threshold:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 20, "block_rows": 16, "most_pivots": 7}])
def test_vectors(spark, settings):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(25, 8))
    rows = []
    for k in range(160):
        x = base[rng.integers(25)] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2, 0.5])
        rows.append((k, [float(np.float32(v)) for v in x * rng.choice([1, 3])], None if k % 23 == 0 else int(k % 2)))
    rows += [(160, None, 0), (161, [], 0), (162, [0.0] * 8, 0), (163, [float("nan")] * 8, 0), (164, [1.0, 2.0], 0), (165, [2.0, 4.0], 0), (166, [1.0, None], 0), (167, rows[1][1], rows[1][2])]
    links = brute_vectors(rows, 0.93)
    degree, expected = Counter(i for p in links for i in p), components(len(rows), links)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x"))
    found = {r["vec_id"]: r for r in embed_dedup.near_vectors(frame, **settings).collect()}
    assert len(found) == len(rows) and len(links) > 100
    for k in found:
        assert (found[k]["n_links"], found[k]["component_id"], found[k]["kept"]) == (degree[k], expected[k], expected[k] == k)
    assert embed_dedup.near_vectors(frame.where("false")).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (1, [1.0, 0.02, 0.0], 0), (3, [0.0, 0.0, 1.0], 0), (3, [0.0, 0.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(frame).collect())
    assert found == {(1, 2, 1, True): 2, (1, 0, 1, True): 1, (2, 2, 1, False): 1, (3, 1, 3, True): 2}


# -- 3 ---------------------------------------------------------------------------------


def test_losses_of_both_models(docs, spark):
    aim = docs.where("doc_id < 20").select("text")
    found = {r["doc_id"]: r for r in lm_score.score(docs, aim, core=4, prior=7.0, part_words=300).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    corpora = [[words(r["text"]) for r in rows], [words(r["text"]) for r in rows if r["doc_id"] < 20]]
    uni = [Counter(w for t in c for w in t) for c in corpora]
    bi = [Counter(p for t in c for p in zip(t, t[1:], strict=False)) for c in corpora]
    size = len(set(uni[0]) | set(uni[1])) + 1
    p1 = lambda k, w: (uni[k][w] + 1) / (sum(uni[k].values()) + size)
    for r in rows:
        w = words(r["text"])
        if not w:
            assert found[r["doc_id"]]["score"] is None
            continue
        loss = [-math.log(p1(k, w[0])) - sum(math.log((bi[k][a, b] + 7 * p1(k, b)) / (uni[k][a] + 7)) for a, b in zip(w, w[1:], strict=False)) for k in (0, 1)]
        got = found[r["doc_id"]]
        assert got["n_tokens"] == len(w)
        assert abs(got["h_background"] - loss[0] / len(w)) < 1e-5 and abs(got["score"] - (loss[1] - loss[0]) / len(w)) < 1e-5


def test_losses_keep_every_word(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{int(90_000 * rng.random() ** 1.3)}" for _ in range(4000)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in lm_score.score(frame, frame.where("doc_id < 25").select("text"), core=50, part_words=40_000).collect()}
    corpora = [[t.split() for t in texts], [t.split() for t in texts[:25]]]
    uni = [Counter(w for t in c for w in t) for c in corpora]
    bi = [Counter(p for t in c for p in zip(t, t[1:], strict=False)) for c in corpora]
    assert len(uni[0]) > 65_535
    mass = [sum(u.values()) + len(uni[0]) + 1 for u in uni]
    p1s = [{w: (uni[k][w] + 1) / mass[k] for w in uni[0]} for k in (0, 1)]
    for d, w in enumerate(corpora[0]):
        loss = [-math.log(p1s[k][w[0]]) - sum(math.log((bi[k][a, b] + 50 * p1s[k][b]) / (uni[k][a] + 50)) for a, b in zip(w, w[1:], strict=False)) for k in (0, 1)]
        assert abs(found[d]["h_background"] - loss[0] / len(w)) < 1e-5 and abs(found[d]["h_target"] - loss[1] / len(w)) < 1e-5


def test_losses_edges(spark, odd):
    assert lm_score.score(empty(spark), empty(spark)).count() == 0
    rows = lm_score.score(odd, odd.where("false"), core=2).collect()
    assert len(rows) == 5 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and sum(r["n_tokens"] for r in rows) == 21


# -- 4 ---------------------------------------------------------------------------------


def brute_removed(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("settings", [{}, {"bucket_rows": 3, "shard_rows": 2}, {"group_rows": 1}])
def test_repeated_strings(spark, settings):
    texts = [*made_texts(5, 40), "ab" * 200, "z" * 500, "x" + "ab" * 150, "q" * 199, "q" * 199]
    rows = [(k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchor", F.lit(1))
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame, **settings).collect()}
    raw = [(t or "").encode() for t in texts]
    for k, gone in enumerate(brute_removed(raw, 200)):
        runs = [(i, j) for i, j in zip([i for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1])], [i + 1 for i in range(len(gone)) if gone[i] and (i + 1 == len(gone) or not gone[i + 1])], strict=True)]
        assert [tuple(s) for s in found[k]["spans"]] == runs
        assert found[k]["kept"] == bytes(x for x, g in zip(raw[k], gone, strict=True) if not g) and found[k]["n_bytes"] == len(raw[k])
    assert sum(len(r["spans"]) for r in found.values()) > 10


def test_long_text_has_each_anchor_once(spark):
    rng = random.Random(12)
    text = rng.randbytes(1_150_000).hex()
    passage = text[1_000_000:1_000_450]
    texts = [text, rng.randbytes(600_000).hex() + passage + rng.randbytes(700_000).hex(), rng.randbytes(500_000).hex()]
    raw = [t.encode() for t in texts]
    seen = Counter(hash(b[i : i + 200]) for b in raw for i in range(len(b) - 199))
    expected = []
    for b in raw:
        spans = []
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 200)
                else:
                    spans.append((i, i + 200))
        expected.append(spans)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(expected)) and [len(s) for s in expected] == [1, 1, 0]


def test_repeated_rows_are_other_places(spark):
    text = " ".join(str(i * i) for i in range(80))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text[:150]), (2, "short")], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(frame).collect()
    assert sorted(len(r["kept"]) for r in rows) == [0, 0, 5, 150]
    assert suffix_dedup.remove_repeats(frame.where("false")).count() == 0


def test_merged_transform_matches_sorting():
    rng = np.random.default_rng(1)
    columns = rng.integers(0, 3, (14, 40)).astype(np.uint16)
    columns[:, 5] = columns[:, 30]
    columns[3:, 9] = columns[3:, 22]
    shards = [suffix_dedup.aligned_bwt(columns[:, k : k + 7]) for k in range(0, 40, 7)]
    first, last = suffix_dedup.merged_repeats(shards, 6, 256)
    for r in range(40):
        hits = [j for j in range(9) if any((columns[j : j + 6, r] == columns[j : j + 6, o]).all() for o in range(40) if o != r)]
        assert (first[r], last[r]) == ((hits[0], hits[-1]) if hits else (14, -1))


# -- 5 ---------------------------------------------------------------------------------


def test_near_duplicates(docs):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    sets = [shingle_set(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    expected = components(len(sets), links)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert len(links) > 10
    for k, s in enumerate(sets):
        assert (found[k]["n_shingles"], found[k]["component_id"], found[k]["kept"]) == (len(s), expected[k], expected[k] == k)


def test_near_duplicates_edges(spark, odd):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    rows = minhash.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]


def test_family_below_and_above_the_threshold(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(1 + k % 5):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, stars=0).collect()}
    assert [found[k] for k in range(len(texts))] == components(len(texts), links)


def test_min_and_max_estimate_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    mult, add, _ = minhash._draw(400, 1, 1)
    same = (minhash.minmax(a, mult, add) == minhash.minmax(b, mult, add)).mean()
    assert abs(same - 0.6) < 0.06


# -- 6 ---------------------------------------------------------------------------------


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 2, "user", None), (3, 0, "user", "x"), (None, 0, "user", "y"), (4, 1, "assistant", "b"), (4, 0, "user", "a"), (5, 0, "user", "a"), (5, 1, "assistant", "b")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 4, 5), (13, 1, 99), (14, None, 1)], "pair_id long, chosen_id long, rejected_id long")
    found = {r["pair_id"]: r for r in chat_format.format_preferences(frame, pairs).collect()}
    assert set(found) == {10, 11, 12}
    r = found[10]
    assert r["n_common"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n"
    assert r["chosen"] == "<|assistant|>\ngood<|end|>\n" and r["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    a, b = map(int, r["chosen_mask"].split("-"))
    assert r["chosen"][a:b] == "good<|end|>\n" and r["rejected_mask"].count("-") == 1
    assert found[11]["prompt"] == "" and found[11]["n_common"] == 0
    assert (found[12]["n_common"], found[12]["chosen"], found[12]["chosen_mask"]) == (2, "", "")
    assert chat_format.format_preferences(frame.where("false"), chat_format.neighbours(frame.where("false"))).count() == 0


# -- 7 ---------------------------------------------------------------------------------


def brute_leaks(texts, items, percent=75):
    out = {}
    for d, text in texts:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v:
                continue
            width, n = min(len(v), 5), len(v)
            bag = Counter(tuple(v[k : k + width]) for k in range(n - width + 1))
            m = min(n, len(w))
            for s in range(len(w) - m + 1 if m >= width else 0):
                own = Counter(tuple(w[k : k + width]) for k in range(s, s + m - width + 1))
                least = sum((own & bag).values())
                most = sum((own | bag).values())
                if 100 * least >= percent * most:
                    key = (d, i)
                    if least / most > out.get(key, (0,))[0]:
                        out[key] = (least / most, s)
    return out


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_leaks(spark, pass_bytes):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 20, 33])))) for k in range(24)] + [(90, None), (91, "")]
    texts = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            leak = words(rng.choice(items[:24])[1])
            leak = [x.decode() for x in leak]
            for _ in range(rng.randint(0, 2)):
                leak[rng.randrange(len(leak))] = "zzz"
            at = rng.randint(0, len(w))
            w[at:at] = leak
        texts.append((d, " ".join(w)))
    texts += [(60, None), (61, ""), (None, items[3][1])]
    long = max((x for _, x in items if x), key=len).split()
    items.append((None, " ".join(f"n{k}" for k in range(12))))
    texts += [(62, " ".join(long[:-2])), (63, " ".join(long[:12])), (64, "before " + items[-1][1])]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(texts, items)
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontam.find_leaks(frame, bench, pass_bytes=pass_bytes).collect()}
    assert found == expected and len(expected) > 8
    kept = decontam.drop_leaking(frame, bench, pass_bytes=pass_bytes)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in texts if d is not None and d not in {k for k, _ in expected})
    assert decontam.find_leaks(frame, bench.where("false")).count() == 0 and decontam.find_leaks(frame.where("false"), bench).count() == 0


def test_leak_index():
    """Every pair within the radius is found, and windows at the threshold lie within it."""
    rng = np.random.default_rng(7)
    passed = far = 0
    for _ in range(300):
        item = rng.integers(0, 2**63, rng.integers(7, 60)).astype(np.uint64)
        window = item.copy()
        window[rng.permutation(len(item))[: len(item) // 7]] = rng.integers(0, 2**63, len(item) // 7).astype(np.uint64)
        a, b = decontam._whole(item)[None], decontam.fingerprints(window, len(window))
        far = max(far, int(np.bitwise_count(a ^ b).sum()))
        assert len(decontam.candidates(b, a, 75, 8)[0]) == 1
        other = decontam._whole(rng.integers(0, 2**63, 30).astype(np.uint64))[None]
        passed += len(decontam.candidates(other, a, 75, 8)[0])
    assert far <= 75 and passed < 60


def test_leak_long(spark):
    item = " ".join(f"x{k}" for k in range(3000))
    text = "a " * 400000 + item + " b" * 9
    docs = spark.createDataFrame([(1, text), (2, "a " * 600000)], "doc_id long, text string")
    found = decontam.find_leaks(docs, spark.createDataFrame([(5, item), (6, " ".join(item.split()[50:90]))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in found] == [(1, 5, 400000, 3000), (1, 6, 400050, 40)]


# -- 8 ---------------------------------------------------------------------------------


@pytest.mark.parametrize("settings", [{}, {"often": 1, "buckets": 1 << 10, "part_entries": 50}, {"long": 2, "few": 1}, {"often": 0, "long": 1, "few": 1}, {"few": 1}])
def test_lines(spark, settings):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rng.shuffle(w)
            lines.append(" ".join(w))
        texts.append("\n".join(lines) + rng.choice(["", "\n", "\n\n"]))
    rows = [*enumerate(texts), (40, None), (41, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    earlier, gone = [], defaultdict(set)
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            s = set(words(line))
            if s:
                if any(100 * len(s & e) >= 75 * len(s | e) for e in earlier):
                    gone[d].add(k)
                earlier.append(s)
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame, **settings).collect()}
    assert sum(map(len, gone.values())) > 20
    for d, t in rows:
        assert set(found[d]["removed"]) == gone[d]
        assert found[d]["text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]))


def test_lines_of_rows_that_share_an_id(spark):
    rng = random.Random(13)
    line = lambda: " ".join(f"u{rng.random()}" for _ in range(6))
    first, twice, shared = line(), line(), line()
    rows = [(1, first), (None, f"{first}\n{line()}"), (None, f"{twice}\n{line()}"), (None, f"{line()}\n{line()}"), (None, f"{twice}\n{line()}\n{line()}"), (7, f"{shared}\n{line()}"), (7, f"{line()}\n{shared}"), (7, f"{line()}\n{line()}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["text"]: r["removed"] for r in line_dedup.dedup_lines(frame).collect()}
    left = Counter(x for t in found for x in t.split("\n"))
    assert left == {x: 1 for _, t in rows for x in t.split("\n")}
    assert sum(map(len, found.values())) == 3 and len(found) == len(rows)
    assert found[first] == [] and found[rows[3][1]] == found[rows[7][1]] == []


def test_lines_of_different_texts_under_one_id(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 12))] for _ in range(12)]

    def line():
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    rows = [(rng.choice([1, 2, None]), "\n".join(line() for _ in range(rng.randint(1, 4)))) for _ in range(30)]
    rows = sorted(set(rows), key=str)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    place, removed = {}, set()
    for r in line_dedup.dedup_lines(frame.withColumn("raw", F.col("text")), often=1).collect():
        raw = r["raw"].split("\n")
        assert r["n_lines"] == len(raw) and r["text"] == "\n".join(x for k, x in enumerate(raw) if k not in r["removed"])
        for k, x in enumerate(raw):
            place[(r["doc_id"] is None, r["doc_id"] or 0, k), r["raw"]] = set(words(x))
            if k in r["removed"]:
                removed.add(((r["doc_id"] is None, r["doc_id"] or 0, k), r["raw"]))
    assert len({x[1] for x in place}) == len(rows)
    for at, s in place.items():
        alike = [o for o, t in place.items() if o != at and 100 * len(s & t) >= 75 * len(s | t)]
        before, level = [o for o in alike if o[0] < at[0]], [o for o in alike if o[0] == at[0]]
        assert at in removed if before else at not in removed or level
        assert before or not level or any(o not in removed for o in [at, *alike])
    assert len(removed) > 20


def test_equal_lines_of_a_block_are_dealt_out_once(spark):
    texts = spark.createDataFrame([(k, k, "many equal words here\nand a line of its own " + "x" * k) for k in range(40)], "doc long, h long, text string").coalesce(1)
    lines = line_dedup._lines(texts, spark.sparkContext.broadcast(np.arange(1 << 10, dtype=np.uint64)), 75)
    equal = [r for r in lines.collect() if r["line"] == 0]
    assert len(equal) == 40 and [(r["doc"], r["m"]) for r in equal if r["m"]] == [(0, 40)]
    assert all(len(r["prefix"]) == (12 if r["m"] else 0) for r in equal)  # 75 of 4 words: two, and one more
    assert all(r["m"] == 1 for r in lines.collect() if r["line"] == 1)


def test_counts_take_few_bytes():
    for values, width in (([0, 255], 1), ([1, 256], 2), ([1, 1 << 16], 4), ([1, 1 << 40], 8), ([-1, 5], 8)):
        thin = _counts._thin(np.array(values, np.int64))
        assert len(thin) == 1 + 2 * width and _counts._wide(thin).tolist() == values
    parts = [np.array([1, 1, 3]), np.array([3] * 40), np.array([0])]
    assert line_dedup._counted(iter(parts), 4).tolist() == [1, 2, 0, 41] and line_dedup._counted(iter([]), 2).tolist() == [0, 0]


def test_lines_edges(spark, odd):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    out = line_dedup.dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == 5 and set(odd.columns) == set(out.columns)
    assert sorted((r["text"] or "-") if r["doc_id"] is None or r["doc_id"] == 1 else "" for r in rows)[-2:] == ["a b c d e f g"] * 2
    assert [r["removed"] for r in rows if r["doc_id"] is None] == [[0]]


# -- 9 ---------------------------------------------------------------------------------


def test_targets_share_out_what_is_capped():
    aim = mixing.targets({"a": 10, "b": 1000, None: 1000})
    assert aim["a"] == 30 and abs(sum(aim.values()) - 2010) < 1e-9
    assert abs(aim["b"] / aim[None] - 2) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("leaf_rows", [4096, 5])
def test_mix(docs, leaf_rows):
    rows = mixing.mix(docs, leaf_rows=leaf_rows).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] == r["copies"] * r["size"]
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1)
        by[r["source"]].append(r)
    assert len(rows) == len(texts) and None in by
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(docs.repartition(2), leaf_rows=leaf_rows).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_of_rows_without_an_id(spark):
    rows = [(None if k % 3 else 4, f"w{k % 50} " * (2 + k % 5), "ab"[k % 2]) for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(frame, leaf_rows=16).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((d, s, len(t.split())) for d, t, s in rows)
    for name in "ab":
        own = [r for r in out if r["source"] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(frame.repartition(2), leaf_rows=16).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_mix_edges(spark, odd):
    assert mixing.mix(empty(spark)).count() == 0
    rows = mixing.mix(odd).collect()
    assert len(rows) == 5 and sum(r["taken"] for r in rows if r["size"] == 0) == 0


# -- 10 --------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(6)
    good, bad = ["river", "stone", "valley", "morning", "slowly"], ["buy!!", "CLICK", "$$$", "free!!", "now***"]
    rows, labels = [], []
    for k in range(400):
        y = int(k % 4 != 0)
        rows.append((k, " ".join(rng.choice(good if rng.random() < (0.9 if y else 0.3) else bad) for _ in range(rng.randint(4, 40))), "en", "s", 0))
        labels.append((k, y))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0)]
    labels += [(901, None), (999, 1), (None, 0)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, label int")
    out = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs, marks.where(~out), sample=150)
    found = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    test = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(found) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    pairs = [(found[a]["score"], found[b]["score"]) for a in test for b in test if a % 4 and not b % 4]
    assert sum(x > y for x, y in pairs) / len(pairs) > 0.95
    assert found[900]["score"] == found[901]["score"]


def test_quality_without_labels(spark, odd):
    model = quality.fit(odd, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0


def test_digest_is_of_the_kept_bytes(spark):
    frame = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    row = suffix_dedup.remove_repeats(frame).select(F.sha2("kept", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"abc").hexdigest()
