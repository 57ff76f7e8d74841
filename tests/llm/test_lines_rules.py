from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from skytab.llm import lines, mixing, quality, url_rules

LONG = "this line is long enough to count"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def dedup(docs):
    holds = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holds[key(line)].add(i)
    out = {}
    for i, t in docs.items():
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holds[key(x)]) < 3 or max(holds[key(x)]) == i]
        out[i] = ("\n".join(kept), len(all_lines), len(all_lines) - len(kept))
    return out


DOCS = {1: f"{LONG}\nown 1\n{LONG}", 2: f" \t{LONG.upper()}\r\nshort", 3: f"{LONG}\n\n{LONG}", 4: None, 5: "", 6: "ß" * 20, 7: "ß" * 20 + "\n\x0b", 8: "ß" * 20, 9: "short\nshort", 10: "short\n" * 3, 11: LONG + "\u00a0"}
SCHEMA = "doc_id long, text string, n_lines string, key string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], SCHEMA)


def result(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


def test_lines_equal_brute_force(spark):
    done = lines.dedup_lines(frame(spark, DOCS))
    assert result(done) == dedup(DOCS)
    assert "key" in done.columns and dict(done.dtypes)["n_lines"] == "bigint"


def test_lines_edges(spark):
    rows = [(None, f"{LONG}\na", "", ""), *((k, LONG, "", "") for k in (1, 2, 3, 3))]
    got = sorted((r.doc_id or -1, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, f"{LONG}\na"), (1, ""), (2, ""), (3, LONG), (3, LONG)]
    assert lines.dedup_lines(frame(spark, DOCS).limit(0)).count() == 0


def test_filters_take_rows_away(spark):
    """Few postings of rare lines pass the filters, and no posting of a frequent one is lost, in pieces and shards too."""
    rows = [(k, "\n".join([f"a line of its own, number {k}", f"a line that many share {k % 5}"]), "", "") for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    store = lines.line_store(docs, lines.Settings(piece=60, shard_keys=2))
    assert store.shards == 3 and store.postings.count() == 800
    passed = store.probe(store.postings)
    frequent = store.counts.filter("n_docs >= 3").select("key")
    assert passed.join(frequent, "key", "left_semi").count() == 400
    assert passed.count() < 420
    assert store.droppable(store.postings).count() == 395


def test_filters_grow(spark):
    """A store built small and filled later keeps no list of keys that its filters cannot take."""
    text = lambda k: (k, f"a line that three documents share {k // 3}", "", "")
    small = lines.line_store(spark.createDataFrame([text(k) for k in range(3)], SCHEMA), lines.Settings(shard_keys=64))
    grown = small.insert(spark.createDataFrame([text(k) for k in range(3, 1500)], SCHEMA))
    assert {r.spare for r in grown.filters.collect()} == {0}
    assert grown.droppable(grown.postings).count() == 1000
    huge = spark.createDataFrame([(k, "x" * 2_000_000 + "\n" + LONG, "", "") for k in range(3)], SCHEMA)
    assert [r.n_dropped for r in lines.dedup_lines(huge).orderBy("doc_id").collect()] == [2, 2, 0]


def test_store_is_reversible(spark):
    df = frame(spark, DOCS)
    store = lines.line_store(df.filter("doc_id < 3"))
    store = store.insert(df.filter("doc_id >= 2"))
    assert result(lines.dedup_lines(df, store=store)) == dedup(DOCS)
    rest = {i: t for i, t in DOCS.items() if i not in (3, 7)}
    fewer = store.delete(spark.createDataFrame([(3,), (7,), (99,)], "doc_id long"))
    assert result(lines.dedup_lines(frame(spark, rest), store=fewer)) == dedup(rest)
    again = fewer.insert(df)
    assert result(lines.dedup_lines(df, store=again)) == dedup(DOCS)
    counts = lambda s: sorted((bytes(r.key), r.n_docs, r.last_doc) for r in s.counts.collect())
    assert counts(again) == counts(store)


def test_cuckoo():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 3000)
    c = lines.Cuckoo(int(3000 / 4 / 0.85))
    c.insert(keys)
    assert c.may_hold(keys).all()
    assert c.may_hold(rng.integers(-(1 << 62), 1 << 62, 20000)).mean() < 0.01
    c.remove(keys[:1500])
    c = lines.Cuckoo.from_bytes(c.to_bytes())
    assert c.may_hold(keys[1500:]).all() and c.may_hold(keys[:1500]).mean() < 0.02
    full = lines.Cuckoo(2)
    full.insert(keys[:50])
    assert full.spare and full.may_hold(keys[:50]).all()
    full.remove(keys[:50])
    assert not full.spare and not full.slots.any()


def judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (key(m[1]) if not m[1].strip() == m[1] else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", "/x", "allow"), ("a.org", "/xy", "block"), (None, "/", "block")]


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/1?q#f", "http://example.net/EN/", "http://xnet/", "a://b://c.net/", "http://a.org", "http://b.A.org/xyz", "http://b.a.org/xq", "http://x.example.com/de/?/", "http://x.example.com?/de/", "http://x.org/fr/#", "http://.net/", "http://net./", "http://ex.net:80/", "x://u@s.net/a\nb", "http://ünì.net/" + "p" * 5000]
    rows = [(k % 19, u, "h") for k, u in enumerate(urls)]
    got = url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    rules = [r for r in RULES if None not in r]
    expected = Counter((k % 19, *judge(u, rules)) for k, u in enumerate(urls))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == expected


def test_urls_meet_rules_on_short_prefixes(spark):
    """With prefixes of one byte most meetings are false, and the digest turns every one of them down."""
    rng = np.random.default_rng(3)
    rules = sorted({(".".join(f"d{rng.integers(6)}" for _ in range(rng.integers(1, 4))), ["", "/", "/a", "/ab/"][rng.integers(4)], ["block", "allow"][rng.integers(2)]) for _ in range(400)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = ["http://" + ".".join(f"D{rng.integers(7)}" for _ in range(rng.integers(1, 6))) + ["", "/", "/abc", "/ab/c?x"][rng.integers(4)] for _ in range(300)]
    urls.append("http://" + "a." * 20_000 + "d1/ab/")  # many labels
    got = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), prefix_bytes=1)
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {(k, *judge(u, rules)) for k, u in enumerate(urls)}
    met = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    assert met and all("sha2" not in x.split("LeftOuter")[0] for x in met)


def test_urls_without_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_rules.judge_urls(pages, none).collect()] == [(None, "allow")]
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(RULES, none.schema)).count() == 0


def features(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for d in range(3)}
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "a a a a a", "x\nx\n x\n\nx", "# $ % \U0001F600 é", "a b c d a b c e a b c", "one two " * 5000, "\u00a0 \u2003", "A\x1cB C"]


def test_quality_measures(spark):
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measures(df).collect()}
    assert got == {k: features(t) for k, t in enumerate(TEXTS)}


def test_cutoffs_hold_their_risk(spark):
    """Good documents of language a never have marks, those of b often do; c has too few labels."""
    plain = " ".join(f"word{k}" for k in range(60))
    marked = " ".join(f"w{k}###" for k in range(60))
    rows, labels = [], []
    for k in range(1700):
        lang = "a" if k < 800 else "b" if k < 1600 else "c"
        bad = k % 7 == 0
        rows.append((k, marked if bad or (lang == "b" and k % 5 == 0) else plain, lang if k < 1695 else None, "0.5"))
        labels.append((k, 0 if bad else 1))
    rows += [(9000, "too short", "a", ""), (9001, "a b c " * 30, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    by = defaultdict(Counter)
    for r in got.collect():
        by[r.lang][r.text == marked, r.kept, r.base_failed] += 1
    assert by["a"][True, True, False] == 0 and by["a"][False, True, False] == 685 and by["a"][False, False, True] == 2
    assert by["b"][True, False, False] == 0 and by["c"][True, False, False] == 0
    assert got.columns == ["doc_id", "text", "lang", *quality.COUNTS, "base_failed", "rejected_by", "kept"]
    assert quality.quality_rules(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_small_holdouts_show_the_risk_they_can(spark):
    """A stratum of 250 good documents gets cutoffs that reject none of them; one of 100 gets none."""
    plain = " ".join(f"word{k}" for k in range(60))
    rows = [(k, plain, "a" if k < 250 else "b", "") for k in range(350)] + [(1000, plain.replace("w", "#"), "a", ""), (1001, plain.replace("w", "#"), "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(k, 1) for k in range(350)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.quality_rules(docs, labels).filter("not kept").collect()] == [1000]
    measured = quality.measures(docs).withColumnRenamed("lang", "stratum")
    cutoffs = quality.select_cutoffs(measured, labels).collect()
    assert {r.stratum for r in cutoffs} == {"a"} and all(0.01 < r.risk < 0.05 and r.n_rejected == 0 for r in cutoffs)


@pytest.mark.parametrize("k,n,p", [(0, 50, 0.01), (3, 1000, 0.01), (40, 5000, 0.01), (900, 100_000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), F.lit(p))).first()[0]
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    assert got == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), rel=1e-6, abs=1e-6)


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(1, 60)), "s%d" % (k % 7 % 3), ["en", "de", None][k % 5 % 3], "t%d" % (k % 2), "x") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, tokens string")
    s = mixing.Settings(targets={"source": {"s0": 0.2, "s1": 0.5, "s2": 0.3}, "lang": {"en": 0.5}}, budget=0.3, rounds=12)
    got = mixing.mix_sources(docs, s).toPandas()
    assert len(got) == 3000 and got["tokens"].dtype == "int64"
    want = (got.weight * got.tokens).groupby(got.source).sum()
    want = want / want.sum()
    assert np.allclose(want, [0.2, 0.5, 0.3], atol=1e-3)
    lang = (got.weight * got.tokens).groupby(got.lang.fillna("")).sum()
    assert lang["en"] / lang.sum() == pytest.approx(0.5, abs=1e-3)
    assert (got.probability * got.tokens).sum() == pytest.approx(0.3 * got.tokens.sum(), rel=1e-6)
    taken = got[got.selected]
    assert taken.tokens.sum() == pytest.approx(0.3 * got.tokens.sum(), rel=0.1)
    assert got.margin_error.max() < 1e-3
    more = mixing.mix_sources(docs, mixing.Settings(targets=s.targets, budget=0.5, rounds=12)).filter("selected").toPandas()
    assert set(taken.doc_id) <= set(more.doc_id)


def test_mixing_edges(spark):
    schema = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "s", "en"), (None, "a | b | c", "s", None)], schema)
    got = mixing.mix_sources(docs, mixing.Settings(budget=1.0)).collect()
    assert len(got) == 4 and {r.topic for r in got} == {"none", "table"} and min(r.tokens for r in got) == 1
    assert len({r.selected for r in got if r.doc_id == 1}) == 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_replaces_its_columns(spark):
    """Columns of the operator's names give way to its own; a very long text counts all its words."""
    schema = "doc_id long, text string, source string, lang string, weight string, probability string, selected string, margin_error string"
    docs = spark.createDataFrame([(1, "w " * 500_000, "a", "en", "x", "x", "x", "x"), (2, "w", "b", "en", "x", "x", "x", "x")], schema)
    got = mixing.mix_sources(docs, mixing.Settings(budget=1.0, rounds=1))
    assert got.columns == ["doc_id", "text", "source", "lang", "tokens", "topic", "weight", "probability", "margin_error", "selected"]
    assert {r.doc_id: r.tokens for r in got.collect()} == {1: 500_000, 2: 1} and dict(got.dtypes)["weight"] == "double"
