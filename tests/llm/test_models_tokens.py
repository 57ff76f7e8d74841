from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from skytab.llm import language, tokens, toxicity

DOCS = "doc_id long, text string, lang string, score string"


def sample_docs(n, seed=1):
    rng = random.Random(seed)
    parts = {"en": "the ing tion and wh ly st er".split(), "de": "sch ung keit ein der ß ä ver".split(), "fr": "eau ou è é que tre la oi".split()}
    rows = []
    for k in range(n):
        lang = list(parts)[k % 3]
        word = lambda: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))  # noqa: E731, B023
        rows.append((k, " ".join(word() for _ in range(rng.randrange(5, 120))), lang, ""))
    return rows


def test_language_held_out_accuracy(spark):
    docs = spark.createDataFrame(sample_docs(600), DOCS)
    model = language.train_language_model(docs.filter("doc_id % 3 <> doc_id % 9"))
    got = language.identify_language(docs, model).toPandas()
    truth = {r[0]: r[2] for r in sample_docs(600)}
    right = got.lang_pred == got.doc_id.map(truth)
    assert right.mean() > 0.97 and right[got.accepted].mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [*sample_docs(60), (900, None, "en", ""), (901, "", "de", ""), (902, "12 34 !?", "fr", ""), (903, "schung", None, ""), (None, "eau", "fr", ""), (904, sample_docs(3)[1][1] * 40000, "de", "")]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train_language_model(docs)
    got = {r.doc_id: r for r in language.identify_language(docs, model).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "de" and got[904].lang_pred == "de" and len(got) == len(rows)
    none = language.train_language_model(docs.filter("lang = 'xx'"))
    assert none is None and {r.lang_pred for r in language.identify_language(docs, none).collect()} == {"und"}
    assert language.identify_language(docs.limit(0), model).count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """Rows that repeat a doc_id do not multiply; at most ``sample`` rows are fitted on."""
    seen = []
    monkeypatch.setattr(language, "fit", lambda rows, s: seen.append(len(rows)))
    rows = [(k % 2, r[1], r[2], "") for k, r in enumerate(sample_docs(40))]
    docs = spark.createDataFrame([*rows, *rows, (0, None, "en", "")], DOCS)
    language.train_language_model(docs)
    language.train_language_model(docs, language.Settings(sample=7))
    assert seen == [40, 7]


def test_logits_equal_plain_sums():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    m = language.Model(["a", "b", "c"], rng.normal(size=(1 << 10, 3)).astype(np.float32), np.array([0.1, 0.2, 0.3]), 1.0, 0.0, 10)
    texts = ["Ab", "", "hello World", "é ß", "x" * 50]

    def bucket(run):
        code, salt = int.from_bytes(run, "big"), int(language._SALT[len(run) - 2])
        h = np.array([(code * salt + len(run)) % (1 << 64)], np.uint64)
        return int(language.mix(h)[0] >> np.uint64(54))

    for text, got in zip(texts, language.logits(pa.array(texts), m)):
        b = "".join(c.lower() if c.isascii() else c for c in text).encode()
        runs = [b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)]
        plain = sum((m.table[bucket(r)].astype(float) for r in runs), np.zeros(3)) / max(len(runs), 1) + m.bias
        assert np.allclose(got, plain, atol=1e-5)
    long = texts[2] * 300_000  # read in parts
    part = language.logits(pa.array([texts[2] * 3000]), m)
    assert np.allclose(language.logits(pa.array([long]), m), part, atol=1e-3)


def test_fit_equals_plain_descent():
    """The minibatch steps of the fit, written out document by document and bucket by bucket."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(23):
        b = np.sort(rng.choice(16, 4, replace=False))
        rows.append((["x", "y"][k % 2], b, rng.integers(1, 5, 4).astype(float)))
    s = language.Settings(buckets_bits=4, dim=3, epochs=2, batch=4)
    model = language.fit(rows, s)
    rng = np.random.default_rng(s.seed)
    emb, out, bias = rng.normal(0, 0.1, (16, 3)), np.zeros((3, 2)), np.zeros(2)
    train = np.array([k for k in range(23) if k % 5 != 4])
    for epoch in range(2):
        rate = s.rate * (1 - epoch / 2)
        rng.shuffle(train)
        for lo in range(0, len(train), 4):
            back, d_out, d_bias = [], np.zeros((3, 2)), np.zeros(2)
            batch = train[lo : lo + 4]
            for k in batch:
                share = rows[k][2] / rows[k][2].sum()
                h = sum(w * emb[b] for w, b in zip(share, rows[k][1]))
                e = np.exp(h @ out + bias)
                g = e / e.sum()
                g[k % 2] -= 1
                d_out += np.outer(h, g)
                d_bias += g / len(batch)
                back.append((k, share, out @ g))
            out -= rate * d_out
            bias -= rate * 0.1 * d_bias
            for k, share, d in back:
                for w, b in zip(share, rows[k][1]):
                    emb[b] -= rate * 8 * w * d
    assert np.allclose(model.table, emb @ out, atol=1e-5) and np.allclose(model.bias, bias)


def toxic_docs(n, seed=2):
    rng = random.Random(seed)
    syl = "the ing tion and wh ly st er on ha re".split()
    rows, labels = [], []
    for k in range(n):
        w = ["".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(10, 60))]
        toxic = k % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scumbag", "moron"])
        rows.append((k, " ".join(w) + ".", "en", ""))
        labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows, labels = toxic_docs(600)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, labels, toxicity.train_toxicity_model(docs, labels.filter("doc_id % 4 <> 2"))


def test_toxicity_held_out(spark, toxic_model):
    docs, labels, model = toxic_model
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter("doc_id % 4 = 2").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].predicted.mean() > 0.95


def test_toxicity_tolerates_gaps(spark, toxic_model):
    _, _, model = toxic_model
    toxic = ["the i.d.i.o.t and on", "the IDIOT!", "the id-iot wh", "the mo_ron er", "i d i o t", "the idxiot on", "morxon", "on ha scumxbag re", "ididot wh"]
    clean = ["the hand station winger", None, "", "!!! ???", "sure", "er", "on", "handing the ston and"]
    rows = [(k, t, None, "") for k, t in enumerate([*toxic, *clean])]
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), model).collect()}
    assert [got[k] for k in range(len(rows))] == [1] * len(toxic) + [0] * len(clean)


def test_toxicity_repeated_ids(spark, toxic_model):
    """Rows that share a doc_id are as many as before, in training and in scores; contradicting labels are toxic."""
    docs, labels, _ = toxic_model
    twice = docs.unionByName(docs.filter("doc_id < 50")).unionByName(docs.filter("doc_id < 50"))
    more = labels.union(spark.createDataFrame([(5, 0), (None, 1), (7, 3)], "doc_id long, toxic int"))
    model = toxicity.train_toxicity_model(twice, more)
    got = toxicity.score_toxicity(twice, model)
    assert got.count() == 700 and got.join(labels, "doc_id").filter("predicted <> toxic").count() < 20


def test_toxicity_edges(spark, toxic_model):
    docs, labels, model = toxic_model
    assert toxicity.train_toxicity_model(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score_toxicity(docs.limit(5), None).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "station " * 300_000 + "idiot", "", ""), (None, "x" * 200_000, "", "")], DOCS)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(long, model).collect()}
    assert got == {1: 1, None: 0}


def test_fit_without_much_to_see():
    s = toxicity.Settings(landmarks=8)
    fit = lambda rows: toxicity.fit_sentences(rows, s)
    assert fit([]) is None and fit([(1, 1, "a b")]) is None and fit([(1, 1, "!!!"), (2, 0, "...")]) is None
    for rows in ([(1, 1, "x"), (2, 0, "y z")], [(1, 1, "!!"), (2, 1, "badword"), (3, 0, "plain words here")], [(1, 1, "same"), (2, 0, "same other")]):
        machine = fit(rows)
        if machine is not None:
            assert np.isfinite(toxicity.Scorer(*machine, s).margins(["x", "badword", None, "plain"])).all()


def test_kernel_equals_plain_subsequences():
    """Features of a word are all its four-letter subsequences within the span, gaps weighted."""
    from itertools import combinations

    s = toxicity.Settings()
    names = ["abcabd", "x", "\U0001F600b\U0001F601"]
    found = toxicity._features(names, s)

    def code(u):
        out = 0
        for c in u:
            out = (out * int(toxicity._BASE) + ord(c)) % (1 << 64)
        return out

    for k, name in enumerate(names):
        word, plain = f"\x02{name}\x03", {}
        for c in combinations(range(len(word)), 4):
            if c[-1] - c[0] < s.span:
                u = "".join(word[i] for i in c)
                plain[code(u)] = plain.get(code(u), 0) + s.decay ** (c[-1] - c[0] - 3)
        norm = sum(v * v for v in plain.values()) ** 0.5
        own = slice(found.start[k], found.start[k + 1])
        assert {int(u): pytest.approx(v, rel=1e-5) for u, v in zip(found.codes[own], found.values[own])} == {u: v / norm for u, v in plain.items()}


def test_scores_equal_plain_margins(spark, toxic_model):
    """A text's score from the definition: kernel sums of its two best words over the landmarks' gains, and its size."""
    docs, _, m = toxic_model
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    gain = dict(zip(m.codes.tolist(), m.gain.tolist()))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, m).collect()}
    for k, text in texts.items():
        margins = []
        for w in sorted(toxicity.words(text)):
            f = toxicity._features([w], m.settings)
            margins.append(m.bias + max(0.0, sum(v * gain.get(int(u), 0.0) for u, v in zip(f.codes, f.values))))
        first, second = sorted(margins)[:-3:-1]
        z = m.slope @ [min(max(first, -2), 3), min(max(second, m.floor, -2), 3), max(np.log1p(len(margins)), np.log1p(4))] + m.shift
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


NAME = "byte_bpe_50k"
TEXTS = ["", "a", "Hello world <|endoftext|>  x\n\n y\t z", "ñandú's  it's 123abc\r\n", "é" * 300, " " * 50, "x" * 500, "!?" * 400, "\U0001F600 कत", "१२३ ²³", "One. Two! Three?\nFour"]


def test_ids_equal_the_json_form():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(f"{NAME}.json"))
    long = [" " * 1_000_000, "\n" * 1_000_000, "x" + " \t" * 30_000 + "y <|endoftext|>", "a" * 300_000]
    for text in [*TEXTS, "a<|endoftext|>b", *long]:
        assert [*t.encode(text, add_special_tokens=False).ids, 0] == tokens.token_ids(text, NAME).tolist()


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        length, n = 64, rng.randint(1, 40)
        ends = np.cumsum([rng.randint(1, 40) for _ in range(n)])
        costs = np.array([rng.choice([0, 6, 48]) for _ in range(n)])
        pad = lambda x: 0 if x in (32, 64) else length - x
        at, best = [0, *ends.tolist()], [0] + [10**9] * n
        for i in range(1, n + 1):
            best[i] = min(best[j] + pad(at[i] - at[j]) + costs[i - 1] for j in range(i) if at[i] - at[j] <= length)
        cuts = tokens.choose_cuts(ends, costs, length)
        price = dict(zip(ends.tolist(), costs.tolist()))
        assert sum(pad(b - a) + price[b] for a, b in zip([0, *cuts], cuts)) == best[n] and cuts[-1] == ends[-1]


def documents(spark):
    rng = random.Random(5)
    texts = [None, *TEXTS, "word" * 6000, *(". ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 900))) for _ in range(60))]
    return {k: t for k, t in enumerate(texts)}, spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, offset string")


def test_packing_round_trip(spark):
    texts, docs = documents(spark)
    got = tokens.pack_documents(docs.repartition(3), tokens.Packing(block=5000)).toPandas()
    for k, own in got.sort_values("start").groupby("doc_id"):
        ids = tokens.token_ids(texts[k], NAME)
        assert np.array_equal(np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]), ids)
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and set(own.doc_tokens) == {len(ids)}
    assert set(got.doc_id) == set(texts)
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() == own.sequence_length.iloc[0] <= 1024
    total = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in total)
    assert padding < 0.05 * total.sum()
    assert tokens.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    a, b = (tokens.permute(np.arange(n), n, key) for key in (5, 6))
    assert sorted(a.tolist()) == list(range(n)) and (n < 10 or (a != b).any())


ORDER = tokens.Order(length=128, shard=64, tasks=5)


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    texts, docs = documents(spark)
    path = str(tmp_path_factory.mktemp("order"))
    return texts, tokens.training_order(docs.repartition(3), ORDER, path).toPandas().sort_values("slot"), path


def test_training_order_round_trip(spark, shards):
    texts, got, path = shards
    assert got.slot.tolist() == list(range(len(got))) and len(got) > 640
    assert (got.shard == got.slot // 64).all() and (got.byte_offset == got.slot % 64 * 258).all()
    files = {r.shard: r.path.removeprefix("file:") for r in tokens.shard_files(spark, path, ORDER).select("shard", "path").collect()}
    assert sorted(files) == list(range(-(-len(got) // 64)))
    payload = {}
    for r in got.itertuples():  # any reader can seek to a slot
        with open(files[r.shard], "rb") as f:
            f.seek(r.byte_offset)
            payload[r.slot] = f.read(256)
            assert f.read(2) == b"\0\0" and zlib.crc32(payload[r.slot]) == r.crc32
    stream = {}
    for r in got.itertuples():
        stream.setdefault(r.part, []).append((r.place, np.frombuffer(payload[r.slot], "<u2")[: r.n_tokens]))
    for part, own in got.sort_values("place").groupby("part"):
        order = list(dict.fromkeys(i for ids in own.doc_ids for i in ids))
        assert np.array_equal(np.concatenate([x for _, x in sorted(stream[part], key=lambda p: p[0])]), np.concatenate([tokens.token_ids(texts[i], NAME) for i in order]))
    assert set(np.concatenate(got.doc_ids.to_list())) == set(texts)


def test_training_order_resumes(spark, shards):
    """A reader that stops after a slot and starts again there has read every sequence once."""
    _, got, path = shards
    read = lambda slot: [(r.slot, zlib.crc32(r.ids)) for r in tokens.read_from(spark, path, slot, ORDER).orderBy("slot").collect()]
    whole = read(0)
    assert whole == list(zip(got.slot, got.crc32))
    for stop in (1, 63, 64, 100, len(got) - 1):
        assert whole[:stop] + read(stop) == whole
    assert read(len(got)) == []


def test_training_order_edges(spark, tmp_path):
    _, docs = documents(spark)
    assert tokens.training_order(docs.limit(0), ORDER, str(tmp_path)).count() == 0
    rows = spark.createDataFrame([(None, "One. Two"), (7, None), (7, "three"), (7, "three")], "doc_id long, text string").coalesce(1)
    got = tokens.training_order(rows, ORDER).collect()
    assert len(got) == 1 and got[0].doc_ids == [None, 7, 7, 7]
    packed = tokens.pack_documents(rows).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == [(0, 4), (7, 1), (7, 2), (7, 2)]


def test_training_order_refuses_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(tokens, "sentence_ends", lambda name: np.zeros(70_000, bool))
    with pytest.raises(ValueError, match="two bytes"):
        tokens.token_sequences(spark.createDataFrame([], "doc_id long, text string"))


def test_long_white_space_packs(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 600_000 + "x")], "doc_id long, text string")
    got = {r.doc_id: r.n for r in tokens.pack_documents(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert got == {k: len(tokens.token_ids(t, NAME)) for k, t in ((1, " " * 1_000_000), (2, "\n" * 600_000 + "x"))}
