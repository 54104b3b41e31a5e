"""Queries and operators against brute force on small fixtures."""

import math
import re
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import common, html_extract, language_id, line_dedup, minhash, mixing, pii, quality_classifier
from statloom.llm.common import table, written
from statloom.llm.queries import QUERIES
from tests.llm import brute

VOCABULARY = [f"w{k}" for k in range(2000)]


def written_tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def edited(rng, base, edits):
    text = list(base)
    for at in rng.integers(0, len(text), edits):
        text[at] = str(rng.choice(VOCABULARY))
    return " ".join(text)


def near_texts():
    rng = np.random.default_rng(5)
    texts = []
    for size in (40, 120, 300) * 6:
        base = list(rng.choice(VOCABULARY, size))
        texts += [edited(rng, base, k) for k in (0, 0, 1, 2, 4, 9)]
    shared = " ".join(rng.choice(VOCABULARY, 60))
    texts += [shared + " " + " ".join(rng.choice(VOCABULARY, n)) for n in (3, 5, 8, 12, 20, 40, 60, 80)]
    return [*texts, "too few words", "Too FEW words!", "too few", "", "...", "...", None, None]


def test_near_dedup_query(spark, tmp_path):
    texts = near_texts()
    sf = written_tables(spark, tmp_path, documents=([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    pairs = list(brute.weighted_jaccard(texts, minhash.DAMP, lambda total: total / minhash.CELLS))
    assert not any(abs(s - minhash.SIMILARITY) < 1e-3 for _, _, s in pairs)
    similar = [(i, j) for i, j, s in pairs if s >= minhash.SIMILARITY]
    assert 60 < len(similar) and any(0.6 < s < 0.8 for _, _, s in pairs)
    want = brute.classes(texts, similar)
    got = QUERIES["op1_minhash_near_dedup"](spark, sf).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(r.class_size == sizes[r.class_id] for r in got)
    assert Counter(r.class_id for r in got if r.kept) == {c: 1 for c in sizes}


def test_components_in_one_task(spark):
    """Few links need no exchange, and their components are those of the star rounds."""
    rng = np.random.default_rng(9)
    ends = [*rng.integers(-(1 << 62), 1 << 62, 300).tolist(), *range(400)]
    pairs = [(ends[i], ends[j]) for i, j in rng.integers(0, 700, (500, 2)) if i != j] + [(k, k + 1) for k in range(1000, 1400)] + [(5000, k) for k in range(5001, 5100)]
    links = written(spark.createDataFrame(pairs, "a long, b long"), "t")
    out = minhash.components(links)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.v: r.c for r in out.collect()}
    assert got == {r.v: r.c for r in minhash.components(links, most=0).collect()}
    assert got[1399] == 1000 and got[5099] == 5000 and 1000 not in got and len(got) > 700
    assert minhash.components(links.where("a = b")).count() == 0


def test_spread_join_without_hot_keys(spark):
    """One join where no key is hot, two where some are, with the same rows."""
    rows = [(k % 7 if k % 3 else None, k) for k in range(3000)]
    left = spark.createDataFrame(rows, "a long, x long")
    for k, n in ((0, 5), (1, 2000)):
        right = written(spark.createDataFrame([(j, f"p{j}", n) for j in range(k, 5)], "a long, p string, _n long"), "t")
        out, every = common.spread_join(left, right, ["a"]), common.spread_join(left, right, ["a"], how="left")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == (1 if n == 5 else 2) and ("_salt" in plan) == (n != 5)
        want = sorted((a, x, f"p{a}") for a, x in rows if a is not None and k <= a < 5)
        assert sorted(map(tuple, out.collect())) == want
        assert every.count() == len(rows) and every.where("p IS NOT NULL").count() == len(want)


def test_texts_alone_do_not_move(spark, monkeypatch):
    """Rows without a partner keep out of the joins that move texts; what they are is told all the same."""
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice(VOCABULARY, 30)) for _ in range(400)]
    texts += [*texts[:20], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moved, own = [], minhash.spread_join

    def seen(left, *args, **more):
        if "text" in left.columns:
            moved.append(left.count())
        return own(left, *args, **more)

    monkeypatch.setattr(minhash, "spread_join", seen)
    got = {r.doc_id: (r.class_id, r.class_size, r.is_first) for r in minhash.near_duplicates(docs).collect()}
    assert len(moved) == 2 and all(n < 150 for n in moved)
    assert got == {k: (k - 400, 2, False) if 400 <= k < 420 else (k, 1 + (k < 20), True) for k in range(422)}


def test_near_dedup_of_a_large_group(spark):
    """A group of near copies with many edits each: hubs over several rounds and salts."""
    rng = np.random.default_rng(8)
    base = list(rng.choice(VOCABULARY, 60))
    texts = [edited(rng, base, int(k)) for k in rng.integers(1, 4, 400)]
    pairs = list(brute.weighted_jaccard(texts, minhash.DAMP, lambda total: total / minhash.CELLS))
    want = brute.classes(texts, [(i, j) for i, j, s in pairs if s >= minhash.SIMILARITY])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # bands miss a pair at 0.8 with probability 0.002, but a class falls apart only where all its links are missed
    same = sum(got[k] == want[k] for k in range(len(texts)))
    assert same >= 0.98 * len(texts)
    joined = defaultdict(set)
    for k, c in got.items():
        joined[c].add(want[k])
    assert all(len(x) == 1 for x in joined.values())


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_on_blank_and_repeated_lines(spark, seed):
    """Runs with blank and long lines, within and across documents, against the SQL of every run."""
    rng = np.random.default_rng(seed)
    lines = ["", " ", "\t", *[" ".join(rng.choice(VOCABULARY[:50], int(n))) for n in (1, 2, 5, 9, 14, 30, 55)]]
    parts = ["\n".join(rng.choice(lines, 12)) for _ in range(4)]
    texts = ["\n".join(str(rng.choice([*parts, *lines])) for _ in range(int(n))) for n in rng.integers(1, 8, 40)] + [None, "", "\n\n\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, ",".join(map(str, r.deleted)), r.text) for r in line_dedup.dedup_lines(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == {r[0]: (r[1], r[3], r[4]) for r in con.execute(f"SELECT doc_id, n_lines, n_deleted, deleted, text FROM ({line_dedup.SQL})").fetchall()}


def test_line_dedup_of_very_many_blank_lines(spark):
    w = " ".join(VOCABULARY[:60])
    df = spark.createDataFrame([(1, w + "\n" * 30_000 + w), (2, "start\n" + w + "\n" * 30_000 + w)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert rows[1].deleted == [30_000] and rows[2].text == "start" and len(rows[2].deleted) == 30_001


def test_surrogates_are_distinct_and_refer_alike(spark, tmp_path):
    rng = np.random.default_rng(3)
    first, last = ["Anna", "John", "Peter", "Maria", "Andrea", "Иван"], ["Smith", "Müller", "García", "Петров", "O'Neil"]
    emails = [f"{a}.{b}@{c}.com".lower() for a in ("a", "bo", "cy") for b in ("x", "yz") for c in ("ab", "mail", "q-r")]
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    ips = [f"10.{a}.{b}.7" for a in range(3) for b in range(3)]
    cards = ["4111111111111111", "5500005555555559", "340000000000009"]
    kinds = {"email": emails, "iban": ibans, "ip": ips, "card": cards}
    texts, holds = [], []
    for _ in range(60):
        k = str(rng.choice(list(kinds)))
        v = str(rng.choice(kinds[k]))
        shown = " ".join(v[i : i + 4] for i in range(0, len(v), 4)) if k in ("iban", "card") and rng.random() < 0.5 and v != cards[2] else v
        given, name = str(rng.choice(first)), str(rng.choice(last))
        title = str(rng.choice(["Mr.", "Dr.", "Mr."])) if given in ("John", "Peter", "Иван") else str(rng.choice(["Mrs.", "Dr.", "Prof."]))
        texts.append(f"{title} {given} {name} has {shown} and then {name} left, {given} {name} too.")
        holds.append((k, v, given, name))
    sf = written_tables(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in QUERIES["op3_pii_surrogates"](spark, sf).collect()}
    seen = defaultdict(set)
    for i, (k, v, given, name) in enumerate(holds):
        m = re.fullmatch(r"\S+ (\S+) (\S+) has (.+) and then (\S+) left, (\S+) (\S+) too\.", rows[i].text)
        assert m, rows[i].text
        assert m[2] == m[4] == m[6] and m[1] == m[5]
        assert rows[i].n_person == 4 and rows[i][f"n_{k}"] == 1
        seen[("given", given)].add(m[1])
        seen[("last", name)].add(m[2])
        seen[(k, v)].add(m[3].replace(" ", "") if k in ("iban", "card") else m[3])
        if k == "iban":
            bare = m[3].replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and bare[:2] == v[:2]
        if k == "card":
            digits = [int(c) for c in m[3].replace(" ", "")][::-1]
            assert sum(d if j % 2 == 0 else sum(divmod(2 * d, 10)) for j, d in enumerate(digits)) % 10 == 0
    assert all(len(x) == 1 for x in seen.values()), seen
    for kind in ("given", "last", *kinds):
        made = [next(iter(x)) for (k, _), x in seen.items() if k == kind]
        assert len(set(made)) == len(made) and not set(made) & {v for k, v in seen if k == kind}


def test_case_of_surrogates(spark):
    texts = ["John.Smith@Example.com", "john.smith@example.com", "JOHN.SMITH@EXAMPLE.COM", "DE88370400440532013000"]
    got = [r.text for r in pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0].lower() == got[1] == got[2].lower() and got[2].isupper()
    assert [c.isupper() for c in got[0]] == [c.isupper() for c in texts[0]]
    assert got[3] == texts[3]  # wrong check digits


def test_best_region():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.integers(-4, 4, int(rng.integers(0, 25))).astype(float).tolist()
        low, high = html_extract.best_region(scores)
        total, want_low, want_high = brute.best_region(scores)
        assert sum(scores[low:high]) == total
        assert total == 0 or (low, high) == (want_low, want_high) or sum(scores[min(low, want_low) : max(low, want_low)]) == 0


def test_mixing_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), str(rng.choice(["a", "b", "c", "d"], p=[0.6, 0.2, 0.15, 0.05]))) for k in range(600)]
    rows += [(1000, "x y z", "a")] * 400 + [(1001, "x", None)] * 30 + [(None, "u v", None), (1002, None, "b"), (1003, "", "e")]
    sf = written_tables(spark, tmp_path, documents=(rows, "doc_id long, text string, source string"))
    got = QUERIES["op5_mixing"](spark, sf).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.SPLIT.findall(t or ""))
    want = brute.targets(sizes)
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((d, len(brute.SPLIT.findall(t or "")), s) for d, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r["size"] * math.floor(rate + 1e-9) <= r.taken <= r["size"] * math.ceil(rate - 1e-9) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs).groupBy("doc_id", "source", F.length("text").alias("n")).agg(F.sum("copies").alias("c")).collect()
    plan = Counter()
    for r in got:
        plan[(r.doc_id, r.source)] += r.taken // r["size"] if r["size"] else 0
    assert {k: v for k, v in plan.items() if v} == dict(Counter({(r.doc_id, r.source): r.c for r in mixed}))


def test_decontamination_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = VOCABULARY[:40]
    items = [(k if k % 7 else None, " ".join(rng.choice(words, int(n)))) for k, n in enumerate(rng.integers(0, 30, 30))] + [(5, None), (6, "W1, w2")]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 200, 40)] + [items[k][1] + " tail " + items[k + 1][1].upper() for k in range(20)] + [None, ""]
    sf = written_tables(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    from statloom.llm import decontamination as D

    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    for how in ({}, {"block_bytes": 200}):
        for r in D.find_hits(docs, bench, **how).collect():
            hit, ids = brute.hits(r.text, items)
            spans = [x for a, b in zip(r.spans[::2], r.spans[1::2], strict=True) for x in range(a, b)]
            assert sorted(hit) == spans and sorted(set(ids)) == r.items and r.n_words == len(brute.WORD.findall(brute.lowered(r.text)))
    assert sorted(map(str, D.decontaminate(docs, bench).collect())) == sorted(map(str, D.decontaminate(docs, bench, block_bytes=200).collect()))
    assert len(D.blocks(bench, 200)) > 5 and all(b.agg(F.sum(F.length("text"))).head()[0] <= 200 or b.count() == 1 for b in D.blocks(bench, 200))


def test_chain_marginals():
    rng = np.random.default_rng(4)
    field = quality_classifier.Field(3)
    field.w, field.t = rng.normal(size=3), rng.normal(size=(2, 2))
    x = rng.normal(size=(14, 3))
    bounds = np.array([0, 1, 7, 14])
    got, pairs = field.marginals(x, bounds)
    for a, b in pairwise(bounds):
        assert got[a:b] == pytest.approx(brute.chain_marginals((x[a:b] @ field.w).tolist(), field.t.tolist()))
    assert pairs[[2, 9]].sum((1, 2)) == pytest.approx([1, 1])
    lengths = rng.integers(1, 9, 14).astype(float)
    q = np.array([np.average(got[a:b], weights=lengths[a:b]) for a, b in pairwise(bounds)])
    z = np.log(q / (1 - q))
    assert field.document(x, lengths, bounds) == pytest.approx(z)


def test_quality_features_see_neighbours(spark):
    """The score of a document follows from its lines, their neighbours and lengths alone: the field's own steps on single documents."""
    texts = ["good line of words here\nBUY!!! $$$ now\nanother calm line follows it", "", None, "one line only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = quality_classifier.Field(3 * quality_classifier.N_LINE)
    field.w = np.random.default_rng(0).normal(size=3 * quality_classifier.N_LINE) / 5
    import pyarrow as pa

    for r in quality_classifier.score(docs, field).collect():
        (_, _, x, lengths, bounds), = quality_classifier.line_features(pa.array([r.text], pa.string()))
        rows = [np.concatenate((x[k], x[k - 1] if k else 0 * x[k], x[k + 1] if k + 1 < len(x) else 0 * x[k])) for k in range(len(x))]
        good = brute.chain_marginals([float(v @ field.w) for v in rows], field.t.tolist())
        q = float(np.average(good, weights=lengths))
        assert r.score == pytest.approx(1 / (1 + math.exp(-math.log(q / (1 - q)))), abs=1e-6)
        assert [int(n) - 1 for n in lengths] == [len(s.encode()) for s in (r.text or "").splitlines(keepends=True) or [""]]


def test_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"bab", b" abab", b"\xc3", b"\xa4", "ä".encode()]
    model = language_id.Unigrams(pieces, ["x", "y"])
    model.p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    words = ["abab", "b", "aäb", "ab" * 60]
    data = np.frombuffer("".join(" " + w for w in words).encode(), np.uint8)
    s, e = language_id.word_spans(data, np.array([0, len(data)]))
    got = model.score(data, s, e)
    for k, lang in enumerate(model.langs):
        p = dict(zip(pieces, model.p[:, model.langs.index(lang)], strict=True))
        for i, w in enumerate(words[:3]):
            assert got[i, k] == pytest.approx(math.log(brute.segmentations((" " + w).encode(), p)))
    # a word is scored whole, however long: the forward sums go on over its whole length
    one = language_id.Unigrams(pieces, ["x"])
    one.p = np.full((len(pieces), 1), 1e-6)
    long = np.frombuffer(b" " + b"ab" * 3000, np.uint8)
    ways = np.array([[1.0, 0.0]])
    value = one.score(long, *(np.array([v]) for v in (0, len(long))))[0, 0]
    assert np.isfinite(value) and value < math.log(1e-6) * 1500 and ways.shape == (1, 2)


def test_learning_scales_with_long_words():
    pieces = [b" ", b"a", b"b", b"ab"]
    short, long_ = language_id.Unigrams(pieces, ["x"]), language_id.Unigrams(pieces, ["x"])
    for model, word in ((short, b" ababab"), (long_, b" " + b"ab" * 900)):
        data = np.frombuffer(word, np.uint8)
        for _ in range(40):
            model.learn(data, np.array([0]), np.array([len(data)]), np.array([[1.0]]))
        assert model.p[3, 0] > 0.7 and np.isfinite(model.p).all()


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = np.random.default_rng(6)
    common = "\n".join(" ".join(rng.choice(VOCABULARY, 12)) for _ in range(6))
    item = " ".join(rng.choice(VOCABULARY, 25))
    good = ["\n".join(" ".join(rng.choice(VOCABULARY, 15)) + "." for _ in range(5)) for _ in range(40)]
    bad = ["\n".join("BUY!!! $$$ ### CLICK " + str(rng.choice(VOCABULARY)) for _ in range(5)) for _ in range(15)]
    texts = [*good, *bad, *[good[k] + "\n" + common for k in range(4)], good[5] + " extra", good[5], good[6] + "\n" + item, item, None, ""]
    rows = [(k, t, "en", str(rng.choice(["a", "b"])), len(t or "")) for k, t in enumerate(texts)]
    sf = written_tables(
        spark, tmp_path,
        documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        labels=([(k, int(k < 40), 0) for k in range(55)], "doc_id long, quality int, toxic int"),
        benchmark=([(1, item)], "item_id long, text string"),
    )
    docs = table(spark, sf, "documents")
    columns = docs.columns
    before = docs.collect()
    stage = dict(corpus_pipeline.STAGES)
    # quality: documents that the classifier rejects go
    field = quality_classifier.fit(docs, table(spark, sf, "labels"))
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, field).collect()}
    docs = written(stage["quality_classifier"](spark, docs, sf), "t")
    assert docs.columns == columns and sorted(docs.collect()) == sorted(r for r in before if scores[r.doc_id] >= 0.3)
    assert not {r.doc_id for r in docs.collect()} & set(range(40, 55)) and set(range(40)) <= {r.doc_id for r in docs.collect()}
    # line dedup against the SQL of every run
    before = docs.collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in before])
    want = {r[0]: r[3] for r in con.execute(f"SELECT doc_id, n_lines, n_deleted, text FROM ({line_dedup.SQL}) WHERE n_lines = 0 OR n_deleted < n_lines").fetchall()}
    docs = written(stage["line_dedup"](spark, docs, sf), "t")
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text or "") for r in docs.collect())
    # near-duplicates
    before = sorted(docs.collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in before]
    similar = [(i, j) for i, j, s in brute.weighted_jaccard(texts, minhash.DAMP, lambda n: n / minhash.CELLS) if s >= minhash.SIMILARITY]
    firsts = {before[k].doc_id for k in set(brute.classes(texts, similar))}
    docs = written(stage["minhash_near_dedup"](spark, docs, sf), "t")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == firsts
    # decontamination
    before = docs.collect()
    docs = written(stage["decontamination"](spark, docs, sf), "t")
    after = {r.doc_id: r.text for r in docs.collect()}
    for r in before:
        hit, _ = brute.hits(r.text, [(1, item)])
        words = brute.WORD.findall(brute.lowered(r.text))
        if len(hit) > 0.5 * len(words):
            assert r.doc_id not in after
        else:
            assert brute.WORD.findall(brute.lowered(after[r.doc_id])) == [w for k, w in enumerate(words) if k not in hit]
    # mixing
    before = docs.collect()
    out = stage["mixing"](spark, docs, sf).collect()
    sizes = defaultdict(int)
    for r in before:
        sizes[r.source] += len(brute.SPLIT.findall(r.text or ""))
    want = brute.targets(sizes)
    taken = defaultdict(int)
    for r in out:
        taken[r.source] += r.copies * len(brute.SPLIT.findall(r.text))
    assert all(abs(taken[s] - want[s]) <= max(len(brute.SPLIT.findall(r.text or "")) for r in before) for s in want)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, out))


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string"
    rows = [(1, "a b c d e f g h", "en", "s", 1, "mine", "own"), (1, "a b c d e f g h", "en", "s", 1, "mine", "own"), (None, None, None, None, None, "m", "o"), (2, "", "en", "s", 0, "m", "o")]
    labels = ([], "doc_id long, quality int, toxic int")
    bench = ([(1, None)], "item_id long, text string")
    sf = written_tables(spark, tmp_path / "some", documents=(rows, schema), labels=labels, benchmark=bench)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "copies_in", "copies"]
    assert [tuple(r) for r in out.collect()] == [(1, "a b c d e f g h", "en", "s", 15, "mine", "own", 1)]
    empty = written_tables(spark, tmp_path / "none", documents=([], schema), labels=labels, benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0
