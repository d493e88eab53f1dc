import zlib

import numpy as np
from pyspark.sql import functions as F

from folium.llm import quality_model, toxicity
from folium.llm.common import training_rows
from tests.llm import helpers


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    n = 7
    m = quality_model.FactorisationMachine(0.3, rng.normal(size=quality_model.FEATURES), rng.normal(size=(quality_model.FEATURES, 4)))
    idx, val = rng.integers(0, 100, n), rng.normal(size=n)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(n) for j in range(i))
    want = 0.3 + (m.w[idx] * val).sum() + pairs
    assert np.isclose(m.raw(idx, val, np.array([0]))[0], want)


def test_quality_learns_and_awkward_rows_score(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    known = spark.read.parquet(f"{data}/labels.parquet")
    model = quality_model.train(docs, known)
    rows = quality_model.classify(docs, model).join(known, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = quality_model.classify(helpers.table(spark), model).collect()
    assert len(out) == len(helpers.AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 5)}) == 1
    assert quality_model.classify(helpers.empty(spark), model).collect() == []


def test_models_without_labels(spark):
    docs = helpers.table(spark)
    nothing = helpers.labels(spark, [])
    for module in (quality_model, toxicity):
        rows = module.classify(docs, module.train(docs, nothing)).collect()
        assert {r.score for r in rows} == {0.5}


def test_training_rows_are_bounded_and_not_held_out(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    known = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = training_rows(docs, known.unionAll(known), "quality", (20, 10))
    assert sorted(y for _, y in rows) == [0] * 20 + [1] * 10
    assert all(zlib.crc32(t.encode()) % 3 != 1 for t, _ in rows)
    assert rows == training_rows(docs.repartition(5), known, "quality", (20, 10))


def test_network_gradients():
    p = toxicity.new_parameters(1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, 2 * toxicity.EMBED))
    ids = rng.integers(1, 9, (5, 6))
    ids[0, 3:] = 0
    y, weight = np.array([0, 1, 0, 1, 1.0]), np.full(5, 0.2)
    _, g, d_rows = toxicity.gradients(p, x, ids, y, weight)
    for name in ("Wf", "Ub", "Uf", "bb", "Wa", "va", "wo", "bo"):
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        eps, old = 1e-6, p[name][at]
        p[name][at] = old + eps
        up = toxicity.gradients(p, x, ids, y, weight)[0]
        p[name][at] = old - eps
        down = toxicity.gradients(p, x, ids, y, weight)[0]
        p[name][at] = old
        assert np.isclose((up - down) / (2 * eps), g[name][at], atol=1e-6), name
    old = x[3, 2]
    x[3, 2] = old + 1e-6
    up = toxicity.gradients(p, x, ids, y, weight)[0]
    x[3, 2] = old - 1e-6
    down = toxicity.gradients(p, x, ids, y, weight)[0]
    assert np.isclose((up - down) / 2e-6, d_rows[3, 2], atol=1e-6)


def test_windows_cover_every_word():
    for n in (0, 1, 15, 16, 17, 24, 25, 100):
        at = toxicity.windows_of(n)
        assert set(at[at >= 0]) == set(range(n)) and at.shape[1] == toxicity.WINDOW
        if n > toxicity.WINDOW:
            assert (np.diff(at[:, 0]) <= toxicity.STRIDE).all()


def test_toxicity_finds_a_lexicon(spark):
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        words = list(rng.choice(plain, 60))
        if i % 3 == 0:
            for k in rng.integers(0, 60, 2):
                words[k] = rng.choice(["gribble", "snorfer", "blatt"])
        rows.append((" ".join(words), int(i % 3 == 0)))
    net = toxicity.fit(rows[:180])
    score = net.score([t for t, _ in rows[180:]])
    y = np.array([b for _, b in rows[180:]])
    assert ((score >= toxicity.THRESHOLD) == y).mean() > 0.9
    # A toxic word at the end of a long text counts like one at its start.
    long = " ".join(rng.choice(plain, 3000))
    assert net.score([long + " gribble gribble", long])[0] > net.score([long])[0]
    out = toxicity.classify(helpers.table(spark), net).collect()
    assert len(out) == len(helpers.AWKWARD) and all(0 <= r.score <= 1 for r in out)


def small_network():
    rows = [(f"a{i % 9} b{i % 7} {'bad' if i % 2 else 'fine'} c", i % 2) for i in range(40)]
    return toxicity.fit(rows)


def fresh(net):
    return toxicity.Network(net.p, net.rows)


def plain_score(net, text):
    """The score by loops over windows, time steps and units, in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    words = [w for w in map(toxicity.clean_word, text.split()) if w]
    inputs = []
    for w in words:
        [(_, (whole, parts))] = toxicity.hash_words([w])
        grams = net.rows[1].find(parts)[:, 0]
        inputs.append(np.concatenate([p["Ew"][net.rows[0].find(whole)[0]], np.maximum(0, np.max([p["Ec"][g] for g in grams], axis=0))]))
    best = -np.inf
    for at in toxicity.windows_of(len(words)):
        seen = [inputs[i] for i in at if i >= 0]
        h, states = toxicity.HIDDEN, {}
        for side in "fb":
            state, out = np.zeros(h), []
            for x in seen if side == "f" else seen[::-1]:
                gate, rec = x @ p[f"W{side}"] + p[f"b{side}"], state @ p[f"U{side}"]
                new = np.empty(h)
                for u in range(h):
                    z, r = sig(gate[u] + rec[u]), sig(gate[h + u] + rec[h + u])
                    new[u] = z * state[u] + (1 - z) * np.tanh(gate[2 * h + u] + r * rec[2 * h + u])
                state = new
                out.append(new)
            states[side] = out if side == "f" else out[::-1]
        both = [np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)] or [np.zeros(2 * h)]
        energy = np.array([np.tanh(s @ p["Wa"] + p["ba"]) @ p["va"] for s in both])
        share = np.exp(energy) / np.exp(energy).sum()
        best = max(best, sum(a * s for a, s in zip(share, both, strict=True)) @ p["wo"] + p["bo"][0])
    return sig(best)


def test_toxicity_scores_equal_plain_loops():
    net = small_network()
    rng = np.random.default_rng(5)
    pool = ["bad", "fine", "c", "a1", "b2", "|", "Été!", "日本", "x" * 40, *(f"w{i}" for i in range(30))]
    texts = ["", " | - ", "bad", *(" ".join(rng.choice(pool, n)) for n in (1, 3, 15, 16, 17, 31, 100))]
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_toxicity_table_overflow(monkeypatch):
    net = small_network()
    texts = [" ".join(f"t{k}{i}" for i in range(50)) + (" bad" if k % 2 else "") for k in range(12)]
    want = net.score(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 128)
    monkeypatch.setattr(toxicity, "GROUP", 64)
    assert np.allclose(fresh(net).score(texts), want, atol=1e-5)


def test_toxicity_pieces_with_symbols(monkeypatch):
    net = small_network()
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(["bad", *("| - *".split() * 60), *words[:k], *("| - *".split() * 40), *words[k:]]) for k in range(0, 90, 10)]
    want = net.score(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 160)
    monkeypatch.setattr(toxicity, "GROUP", 40)
    assert np.allclose(fresh(net).score(texts), want, atol=1e-5)


def test_toxicity_very_long_symbol_text(monkeypatch):
    net = small_network()
    long = " ".join(f"w{i} | - |" for i in range(30_000))  # 120,000 tokens
    texts = [long, long + " bad bad", "bad " + long]
    got = net.score(texts)
    monkeypatch.setattr(toxicity, "GROUP", 1 << 18)  # every text in one piece
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 1 << 18)
    assert np.allclose(fresh(net).score(texts), got, atol=1e-5)
    assert got[1] > got[0]
