import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import bpe, fingerprints, lines, mixing, quality_rules, simhash
from tests.llm import helpers


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_bpe_equals_library(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    encoder = bpe.Encoder(vocabulary, bpe.build_transducer(vocabulary, [" the", "hello", " hell", "a"]))
    rnd = random.Random(5)
    letters = " \n\t\r\x0b\x1c\x85\xa0　aAé’'sdtllmve0½²ⅷ_#*<|>日😀́‍ß.,-\xad﻿\x00"
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 3000, "é" * 200, "I'll don't  we're\n\n x"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    for text, got in zip(texts, encoder.encode_batch(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, text
        assert encoder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_transducer_is_minimal_and_exact():
    words = sorted({w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "a", "to"]})
    t = bpe.Transducer.load(bpe.Transducer.compile(words, [[i, i + 1] for i in range(len(words))]).dump())
    assert t.index(words).tolist() == list(range(len(words)))
    assert t.index([b"", b"t", b"ta", b"tapx", b"zzz"]).tolist() == [-1] * 5
    assert t.ids_of(3).tolist() == [3, 4]
    # tap/top share their suffix states with stop: fewer states than letters in a trie.
    assert len(t.final) < 11
    assert bpe.Transducer.compile([], []).index([b"a"]).tolist() == [-1]


def test_bpe_merge_many_equals_merge(vocabulary):
    rnd = random.Random(1)
    words = [bytes(rnd.choice(b"abcdehinorst \xc3\xa9") for _ in range(rnd.randint(1, 70))) for _ in range(800)]
    for w, got in zip(words, vocabulary.merge_many(words), strict=True):
        assert list(np.frombuffer(got, "<u4")) == vocabulary.merge(w)


def test_bpe_awkward_rows(spark):
    docs = helpers.table(spark)
    rows = bpe.encode_documents(docs, bpe.Codec(docs)).collect()
    assert len(rows) == len(helpers.AWKWARD)
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in helpers.AWKWARD}
    assert {r.decoded_sha256 for r in rows} == texts
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    none = helpers.empty(spark)
    assert bpe.encode_documents(none, bpe.Codec(none)).collect() == []


def brute_components(fps: dict) -> dict:
    keys = sorted(set(fps.values()))
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= simhash.MAX_BITS:
                root[find(a)] = find(b)
    least = {}
    for d, k in fps.items():
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: least[find(k)] for d, k in fps.items()}


def brute_fingerprint(text: str) -> int:
    import re

    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 120))] for _ in range(40)]
    rows = []
    for i in range(300):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "  ".join(words), "en", "a"))
    got = simhash.near_duplicates(helpers.table(spark, rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_of_a_dense_ball(spark, block):
    """A hot key: all fingerprints near one another, cut into blocks."""
    rng = np.random.default_rng(4)
    centre = 0x0123456789ABCDEF
    fps = {centre}
    while len(fps) < 150:
        bits = rng.choice(64, 2, replace=False)
        fps.add(centre ^ (1 << int(bits[0])) ^ (1 << int(bits[1])))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, block).collect()]
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert bin(a ^ b).count("1") <= simhash.MAX_BITS
        root[find(a)] = find(b)
    want = brute_components({x: x for x in fps})
    groups = lambda f: sorted(map(sorted, {k: [x for x in fps if f(x) == k] for k in map(f, fps)}.values()))
    assert groups(find) == groups(want.get)


@pytest.mark.parametrize("b", [5, 6, 7, 8])
def test_band_keys_lose_no_pair(spark, b):
    """Fingerprints that differ in any four bits meet under a key."""
    rng = np.random.default_rng(b)
    pairs = []
    for _ in range(40):
        x, y = int(rng.integers(0, 1 << 63)), 0
        for k in rng.choice(64, simhash.MAX_BITS, replace=False):
            y |= 1 << int(k)
        pairs.append((x, x ^ y))
    fps = {v for p in pairs for v in p}
    df = spark.createDataFrame([(simhash._signed(v),) for v in fps], "fp long")
    keys = {}
    for r in simhash.band_keys(df, b).collect():
        keys.setdefault(r.fp, set()).add((r.band, r.value))
    assert all(keys[simhash._signed(x)] & keys[simhash._signed(y)] for x, y in pairs)


def test_bands_follow_the_number_of_fingerprints():
    found = [simhash.band_count(n) for n in (0, 10_000, 10**6, 10**8, 10**10, 10**11)]
    assert found == sorted(found) and found[0] == 5 and found[3] == 6
    for n, b in zip((10**6, 10**8, 10**10), found[2:], strict=False):
        assert n / 2 ** (64 * (b - simhash.MAX_BITS) / b) <= simhash.PER_KEY


def test_pivots_discard_no_link():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    b = a.copy()
    for k in range(500):
        for bit in rng.choice(64, simhash.MAX_BITS, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    refs = simhash.pivots()
    gap = np.abs(simhash.distance_table(a, refs) - simhash.distance_table(b, refs)).max(axis=0)
    assert (gap <= simhash.MAX_BITS).all()


def test_simhash_awkward_rows(spark):
    rows = simhash.near_duplicates(helpers.table(spark)).collect()
    assert len(rows) == len(helpers.AWKWARD)
    of = {r.doc_id: r for r in rows}
    assert of[2].fingerprint == of[3].fingerprint == of[4].fingerprint == "0" * 16
    assert {of[k].component_id for k in (2, 3, 4)} == {2}
    assert of[5].component_id == 1 and of[None].component_id is None
    assert simhash.near_duplicates(helpers.empty(spark)).collect() == []


def test_fingerprint_estimates_likeness():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    terms, errors = fingerprints.Draws(), []
    for _ in range(60):
        a = " ".join(rnd.choice(vocab) for _ in range(200))
        b = a[: len(a) // 2] + " " + " ".join(rnd.choice(vocab) for _ in range(90))
        got = fingerprints.likeness(fingerprints.fingerprint(a, terms), fingerprints.fingerprint(b, terms))
        errors.append(got - fingerprints.expected_likeness(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def plain_fingerprint(text: str) -> list[int]:
    """The samples by loops over words and samples."""
    import math
    from collections import Counter

    import xxhash

    full, lanes = (1 << 64) - 1, range(3 * fingerprints.SAMPLES)

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    step, best = 0x9E3779B97F4A7C15, [(math.inf, 0)] * fingerprints.SAMPLES
    for word, n in (Counter(text.split()) or {"": 1}).items():
        term = xxhash.xxh64_intdigest(word.encode(), 4)
        mixed = [mix((term + (k + 1) * step) & full) for k in lanes]
        u = [(((x >> 40) + 0.5) / 2**24, ((x & 0xFFFFFF) + 0.5) / 2**24) for x in mixed]
        for k in range(fingerprints.SAMPLES):
            (a, b), (c, d), (beta, _) = (u[k + j * fingerprints.SAMPLES] for j in range(3))
            r, gamma = -math.log(a * b), -math.log(c * d)
            t = math.floor(math.log(1 + math.log(n)) / r + beta)
            value = math.log(gamma) - r * (t - beta) - r
            sample = mix(term ^ ((t * step + 1) & full)) >> 48
            best[k] = min(best[k], (value, sample))
    return [b for _, b in best]


def test_fingerprint_equals_plain_sampler(monkeypatch):
    rnd = random.Random(8)
    texts = ["", "a", "a a a b", *(" ".join(rnd.choice(["x", "y", "z", "é", "w" * 30]) + str(rnd.randrange(40)) for _ in range(300)) for _ in range(4))]
    draws = fingerprints.Draws()
    got = [fingerprints.fingerprint(t, draws).tolist() for t in texts]
    want = [plain_fingerprint(t) for t in texts]
    # Single precision may turn a near tie.
    assert np.mean(np.array(got) == np.array(want)) > 0.99
    monkeypatch.setattr(fingerprints, "KEPT", 16)  # the table is emptied within a text
    assert [fingerprints.fingerprint(t, fingerprints.Draws()).tolist() for t in texts] == got


def test_ranges_cut_a_hot_id_by_hash():
    bounds = fingerprints.cut_points([3, 7, 7, 7, 9])
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 63), 1 << 63, 4000)
    keys = np.repeat([1, 3, 7, 8], 1000)
    got = fingerprints.range_of(keys, hashes, bounds)
    order = np.lexsort((hashes, keys))
    assert (np.diff(got[order]) >= 0).all()
    hot = np.bincount(got[keys == 7], minlength=6)
    assert (hot > 0).sum() == 4 - 1 and hot.max() < 600
    plain = [sum((b, c) <= (k, h) for b, c in zip(*(x.tolist() for x in bounds), strict=True)) for k, h in zip(keys.tolist(), hashes.tolist(), strict=True)]
    assert got.tolist() == plain


@pytest.mark.parametrize("hot_share", [3, 2000])
def test_fingerprints_of_repeated_rows(spark, monkeypatch, hot_share):
    """A third of the rows are one row; ids are null or shared by many texts."""
    monkeypatch.setattr(fingerprints, "BLOCK", 7)
    rows = [(5, "the same row again", "en", "a")] * 40 + [(None, f"no id {i} {i % 9}", "en", "a") for i in range(40)]
    rows += [(i % 11, f"text {i} of some id", "en", "a") for i in range(40)] + [(None, "twice", "en", "a")] * 2
    docs = helpers.table(spark, rows).repartition(5)
    got = sorted((r.doc_id or 0, r.doc_id is None, *r[1:]) for r in fingerprints.fingerprint_documents(docs, hot_share=hot_share).collect())
    h = {t: x for t, x in docs.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(((i is not None, i or 0, h[t], t) for i, t, _, _ in rows))
    draws, want = fingerprints.Draws(), []
    for (has, i, _, t), (_, _, _, n) in zip(order, order[1:] + order[:1], strict=True):
        own, after = fingerprints.fingerprint(t, draws), fingerprints.fingerprint(n, draws)
        want.append((i if has else 0, not has, *fingerprints._results(t, own, n, after, draws)))
    assert got == sorted(want)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_fingerprints_follow_id_order(spark, parts):
    docs = helpers.table(spark).repartition(parts)
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == len(helpers.AWKWARD)
    order = sorted(((i is not None, i or 0, t or "") for i, t, _, _ in helpers.AWKWARD))
    want = set()
    for (has, i, t), (_, _, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        want.add((i if has else None, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in rows} == want
    same = {r.fingerprint for r in rows if r.doc_id in (1, 5)}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert fingerprints.fingerprint_documents(helpers.empty(spark)).collect() == []


def test_line_dedup(spark):
    rows = [(i, f"menu\nline {i}\n  menu  \n\nmenu", "en", "a") for i in range(9)]
    rows += [(20 + i, "menu\nother", "en", "b" if i else None) for i in range(4)] + [(40, None, "en", "a")]
    out = {r.doc_id: r for r in lines.line_dedup(helpers.table(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert out[3].clean_text == "line 3\n" and (out[3].n_lines, out[3].n_dropped) == (5, 3)
    # Lines of all three pages of a small host go; the only page of a host keeps its own.
    assert out[21].clean_text == "" and out[21].n_dropped == 2 and out[20].n_dropped == 0
    assert out[40].clean_text is None and out[40].n_lines == 0
    assert len(lines.line_dedup(helpers.table(spark)).collect()) == len(helpers.AWKWARD)
    assert lines.line_dedup(helpers.empty(spark)).collect() == []


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [(i, f"menu\nline {i}", "en", "a") for i in range(9)]
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert {r.clean_text for r in lines.line_dedup(helpers.table(spark, rows)).collect()} == {f"line {i}" for i in range(9)}


def test_dedup_lines_keeps_clashing_columns(spark):
    docs = helpers.table(spark).withColumns({c: F.lit(3) for c in ("_lines", "_kept", "_bad", "_row", *lines.ADDED)})
    rows = lines.dedup_lines(docs)
    assert rows.columns[: len(docs.columns)] == docs.columns and len(set(rows.columns)) == len(docs.columns) + 3
    assert {tuple(r[c] for c in lines.ADDED) for r in rows.collect()} == {(3, 3, 3)}


def test_hosts_of_urls(spark):
    urls = ["https://www.Site.org/a?b", "http://user@x.y:80/", "//cdn.z/q", "no url", None, "ftp://h"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(lines.host_of(F.col("u"))).collect()]
    assert got == ["site.org", "x.y", "cdn.z", None, None, "h"]


def test_mixing_meets_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    known = spark.read.parquet(f"{data}/labels.parquet")
    rows = mixing.mix(docs, known).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    t = np.array([r.n_tokens for r in rows], dtype=float)
    p = np.array([r.posterior for r in rows])
    rate = np.array([r.rate for r in rows])
    aim = mixing.targets(t @ p)
    assert np.allclose((rate * t) @ p, aim, rtol=1e-4)
    assert np.allclose(p.sum(axis=1), 1)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.domain == lang[r.doc_id] for r in rows if r.n_tokens > 50]) > 0.9
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


def test_mixing_projects_onto_nonnegative_rates(spark):
    """Rates stay at or above zero where the targets ask for less than nothing."""
    rows = [([0.9, 0.1], 10), ([0.1, 0.9], 10), ([0.5, 0.5], 10)]
    members = spark.createDataFrame([(t, p) for p, t in rows], "_tokens long, _p array<double>")
    history = mixing.fit_rates(members, 2, temper=0.0)
    got = [r[0] for r in members.select(mixing.rate_column(history)).collect()]
    assert min(got) >= 0
    assert [r[0] for r in members.select(mixing.rate_column([[-5.0, -5.0], [1.0, 0.0]])).collect()] == [0.9, 0.1, 0.5]


def test_mixing_to_given_weights(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    known = spark.read.parquet(f"{data}/labels.parquet")
    rows = mixing.mix(docs, known, weights={"fr": 40, "en": 40, "de": 20}, budget=50_000.0).collect()
    t, rate = np.array([r.n_tokens for r in rows], dtype=float), np.array([r.rate for r in rows])
    got = (rate * t) @ np.array([r.posterior for r in rows])
    assert np.allclose(got, [10_000, 20_000, 0, 20_000], atol=500)
    with pytest.raises(ValueError):
        mixing.mix(docs, known, weights={"xx": 1.0})
    with pytest.raises(ValueError):  # one document's posterior cannot be split
        one = spark.createDataFrame([(10, [0.5, 0.5])], "_tokens long, _p array<double>")
        mixing.fit_rates(one, 2, weights=np.array([1.0, 0.0]))


def test_apply_mix_keeps_clashing_columns(spark):
    docs = helpers.table(spark).withColumns({"_p": F.lit(7), "_n": F.lit(8), "_row": F.lit(9), "_m": F.lit(6)})
    mixed = mixing.apply_mix(docs, helpers.labels(spark, [(1, 1, 0), (8, 1, 0)])).collect()
    assert {(r._p, r._n, r._row, r._m) for r in mixed} == {(7, 8, 9, 6)} and mixed[0].__fields__ == docs.columns


def test_mixing_awkward_rows(spark):
    docs = helpers.table(spark)
    for known in ([], [(1, 1, 0), (8, 1, 0), (4, 0, 0)]):
        rows = mixing.mix(docs, helpers.labels(spark, known)).collect()
        assert len(rows) == len(helpers.AWKWARD)
        assert all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3, 4))
    none = helpers.empty(spark)
    assert mixing.mix(none, helpers.labels(spark, [])).collect() == []
    mixed = mixing.apply_mix(docs, helpers.labels(spark, [(1, 1, 0)]))
    assert mixed.columns == docs.columns


def brute_metrics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    kept = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    covered = {k for i, g in enumerate(grams) if counts[g] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(kept) - len(set(kept)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_rules_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*helpers.table(spark).columns[:5])
    rows = quality_rules.quality_rules(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_metrics(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in rows) > 0.6 * len(rows)


def test_quality_rules_awkward_rows(spark):
    rows = quality_rules.quality_rules(helpers.table(spark)).collect()
    assert len(rows) == len(helpers.AWKWARD)
    texts = {i: t for i, t, _, _ in helpers.AWKWARD}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_metrics(texts[r.doc_id])
    assert quality_rules.quality_rules(helpers.empty(spark)).collect() == []
